"""Policy-document analytics on Spark."""

"""Operators of a training-data pipeline: near-dedup, tokenising, mixing,
chat formatting, archives, language ID, HTML extraction, vector search and
quality.  Nothing else in the package imports this subpackage."""

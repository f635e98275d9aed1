"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.  Where that is unset, local mode
    gets a temporary one, which is then set for the session; on a cluster, whose
    executors would not see it, this is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="clauseforge-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the plan
    is cut there, so a lost executor costs a re-read and not a recomputation.
    The table goes when the session ends, or by ``discard``.  The driver's JVM then returns
    the native memory that planning and compiling took."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/clauseforge/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    store, where = _path(spark, path)
    store.deleteOnExit(where)
    out = spark.read.schema(schema).parquet(path)
    out.table_path = path
    give_back_jvm(spark)
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that no plan reads any more."""
    store, where = _path(df.sparkSession, df.table_path)
    store.delete(where, True)


def give_back() -> None:
    """Return what this process has freed to the system.  Python workers serve one task
    after another, of later stages too, and would keep the most that any of them took."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc has it
        trim(0)


def give_back_jvm(spark: SparkSession) -> bool:
    """The same for what the driver's JVM holds outside its heap, which its many threads
    otherwise keep, each for itself.  Whether this JVM has the command for that."""
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    with contextlib.suppress(Py4JError):
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        args = new_array(jvm.java.lang.Object, 4)
        args[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        args[1] = "systemTrimNativeHeap"
        # by the interface's method, since the server's own class is not open to callers
        found = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods()
        next(m for m in found if m.getName() == "invoke").invoke(server, args)
        return True
    return False

"""Shared-folder tables: the way the operators cut lineage and survive lost executors.

Everything an operator keeps between jobs is a Parquet table in the folder that the
cluster names in ``spark.checkpoint.dir``; only where that is unset (tests, a laptop)
does a local folder stand in.
"""

from __future__ import annotations

import contextlib
import gc
import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from linkwell.sources.names import spread

_local: dict[str, str] = {}
_released = 0.0
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = _local.setdefault("dir", tempfile.mkdtemp(prefix="linkwell-"))
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/linkwell/{uuid.uuid4().hex}-{name}"
    for scope in _scopes:
        scope.append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes, at the end, all tables that were written meanwhile but those in the list that it gives."""
    made: list[str] = []
    keep: list[str] = []
    _scopes.append(made)
    try:
        yield keep
    finally:
        _scopes.remove(made)
        for path in set(made) - set(keep):
            drop_path(spark, path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of at most ``rows`` rows: whole texts go to Python workers, and the
    batches of both sides are held beside the JVM's heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if int(before) <= 0 or int(before) > rows:
        spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back with its own schema."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.option("compression", codec).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.lw_path = path
    if _scopes:  # a stage of several: what its jobs leave in the driver would add up
        release(spark)
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for table in tables:
        drop_path(table.sparkSession, table.lw_path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs (it does so when the driver's
    references are collected), so that disk use follows one step and not their sum, and gives
    the driver's freed memory back. Steps of a few seconds leave theirs to the next call."""
    global _released
    if time.monotonic() < _released + 3:
        return
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim(spark)
    _released = time.monotonic()


def trim(spark: SparkSession) -> bool:
    """Gives back to the system what the driver's JVM has freed outside of its heap, which the allocator
    keeps otherwise: compilers and codecs leave hundreds of MB over a long run. False where the
    JVM has no such command (before 17.0.9, or not on Linux); memory then stays as it is."""
    sc = spark.sparkContext
    jvm, array = sc._jvm, sc._gateway.new_array
    call = array(jvm.java.lang.Object, 4)
    call[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    call[1], call[2], call[3] = "systemTrimNativeHeap", array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)
    # the server's class is not public: its method is found by that of the interface
    methods = jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods()
    invoke = next(m for m in methods if m.getName() == "invoke")
    try:
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), call)
    except Py4JJavaError:
        return False
    return True


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def free_name(name: str, taken: list[str]) -> str:
    """``name``, followed by as many _ as no taken name is like it (Spark ignores case)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Shared storage for intermediate results: the only place where lineage is cut.

Everything is written below ``spark.checkpoint.dir``, which a cluster points at a
folder that every executor sees; a private folder is used only where it is unset and the master is local.
"""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session (as a URI or path that Spark's writers accept)."""
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError(f"set {_KEY} to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lowstress-")
        spark.conf.set(_KEY, found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nobody holds any more (it does when the driver collects its garbage)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def rest(spark: SparkSession) -> None:
    """Between two long steps: let driver and executors collect their garbage, so that one step's heap and classes do not add to the next one's."""
    release(spark)
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc') as done").write.format("noop").mode("overwrite").save()


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Within this, batches that go to Python workers have at most so many rows (texts may be long)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _stored(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lowstress/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, after what earlier plans have left was released."""
    release(df.sparkSession)
    return _stored(df, name)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> int:
    """Delete the tables that this application has written here, once the results that read them are stored; returns how many."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    _delete(spark, paths)
    return len(paths)


def settled(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``build`` returns as a stored table. The tables that it has stored on the way are deleted, and its shuffle files released: nothing else may read them."""
    written = _written.setdefault(spark.sparkContext.applicationId, [])
    before = len(written)
    out = materialize(build(), name)
    between = written[before:-1]
    del written[before:-1]
    _delete(spark, between)
    release(spark)
    return out


#: Rows of a few numbers that one task is given where a table is dealt by hand.
PART_ROWS = 1 << 18


def parts(df: DataFrame) -> int:
    """Parts to deal a stored table into (its rows are counted from the files' footers): they grow with it, so that tasks do not."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // PART_ROWS))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage: ``df`` as a stored table, whose size Spark reads from its files.

    ``DataFrame.checkpoint`` would keep the estimated size of its plan. Estimates of joins are products, so in a loop they
    get twice as many digits each round, until numbers of megabytes fill the driver.
    """
    return _stored(df, "step")

"""Intermediate tables that several steps read.

A table written to the shared folder survives lost executors, cuts the plan
short and has a known size, so Spark itself decides what is small enough to
broadcast.

    with scratch(spark):
        hits = hybrid_search(...)
        hits.write.parquet(...)

deletes on leaving what was stored inside. Without the scope tables stay until
``release`` or, in local mode without a named folder, until Python ends.
"""

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
_scopes: list[list[str]] = []
_made: list[str] = []
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Only a local master falls back to a temporary folder (one per process,
    deleted at its end); a cluster without a named folder is an error. The
    caller's settings are never changed.
    """
    global _own
    named = (
        spark.conf.get("spark.checkpoint.dir", None)
        or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        or spark.sparkContext.getCheckpointDir()
    )
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="darwise-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return _own


def scratch_path(spark: SparkSession, kind: str = "table") -> str:
    """A new path in the shared folder, deleted with the scope it was made in."""
    path = f"{scratch_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    (_scopes[-1] if _scopes else _made).append(path)
    return path


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    _scopes.append([])
    try:
        yield
    finally:
        _delete(spark, _scopes.pop())


def release(spark: SparkSession) -> None:
    """Delete every table stored outside a scope."""
    _delete(spark, _made)
    _made.clear()


@contextlib.contextmanager
def short_lived_shuffles(spark: SparkSession):
    """Inside, the shuffle files of a write go as soon as it has ended."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a written table."""
    path = scratch_path(df.sparkSession)
    with short_lived_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

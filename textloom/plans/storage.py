"""Lineage cuts through tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[weakref.ref, str]] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local one only where it is unset (tests)."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        existing = sc._jsc.sc().getCheckpointDir()
        if existing.isDefined():
            return existing.get()
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="textloom-")
        sc.setCheckpointDir(configured)
        return sc._jsc.sc().getCheckpointDir().get()
    return configured


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back: a lineage cut that outlives lost executors.

    The shuffle files of the write, which nothing reads after it, are removed when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _made.append((weakref.ref(spark), path))
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a table made by :func:`stored` that no plan needs any more."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/tables/" in file:
            _delete(spark, file)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _cleanup() -> None:
    for ref, path in _made:
        spark = ref()
        try:
            if spark is not None and spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session has ended; the folder belongs to the cluster
            pass

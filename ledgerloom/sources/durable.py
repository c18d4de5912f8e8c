"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only by a local master whose session sets no spark.checkpoint.dir, as in tests.
LOCAL_FOLDER = "/tmp/checkpoints/ledgerloom"


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or LOCAL_FOLDER).rstrip("/")


#: Shuffle files of a finished write are of no more use; the session may still say otherwise.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Joins of tables that are partitioned by some of the columns they are joined by need no shuffle if this is false.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
_PATH = "ledgerloom_path"


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """``name`` is ``value`` for what is planned within."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` and read it back: a short plan that outlives lost executors. Its shuffle files go once it is whole."""
    spark = df.sparkSession
    path = f"{shared(spark)}/{label}-{uuid.uuid4().hex}"
    with setting(spark, CLEAN_SHUFFLES, "true"):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _PATH, path)
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``durable`` that nothing will read any more."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, _PATH)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

"""What the operators share: the word definition and durable intermediate tables."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word; a word is a maximal run of anything else.
SPACE = r"[\x20\x09-\x0D]+"

#: Used only by a local master whose session sets no spark.checkpoint.dir, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/ledgerloom"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        return LOCAL_CHECKPOINTS
    raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")


#: Shuffle files of a finished write are of no more use; the session may still say otherwise.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PATHS = "ledgerloom_path"


def written(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    The copy survives the loss of any executor and is read as often as needed
    without recomputing what is above it. Its shuffle files go once it is whole.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_SHUFFLES)
        else:
            spark.conf.set(CLEAN_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _PATHS, path)
    for made in _SCOPES:
        made.append(out)
    return out


_SCOPES: list[list[DataFrame]] = []


@contextmanager
def scratch():
    """Gives a list of the tables that ``written`` makes inside; those still in it at the end are deleted."""
    made: list[DataFrame] = []
    _SCOPES.append(made)
    try:
        yield made
    finally:
        _SCOPES.remove(made)
        dropped(*made)


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing will read any more, recomputation included."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, _PATHS)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def words(text):
    """Array of the words of a text column (null text: no words)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")

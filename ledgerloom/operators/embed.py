"""Vectors of texts: batches for an embedder that limits its requests, and hashed word counts where there is none."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_INPUTS = 2048
MAX_CHARS = 1_000_000


class Embedder(Protocol):
    """Gives (index, vector) of each of the texts of a request, in any order."""

    def embed(self, texts: list[str]) -> Iterable[tuple[int, list[float]]]: ...


def batches(texts: Iterable[str], inputs: int = MAX_INPUTS, chars: int = MAX_CHARS) -> Iterator[list[str]]:
    """``texts`` in order, in lists of no more than ``inputs`` and of ``chars`` together; a longer text is a list of its own."""
    now, size = [], 0
    for t in texts:
        if now and (len(now) == inputs or size + len(t) > chars):
            yield now
            now, size = [], 0
        now.append(t)
        size += len(t)
    if now:
        yield now


def vectors_of(embedder: Embedder, texts: list[str]) -> list[list[float]]:
    """The vectors of one request in the order of its texts; raises where one is missing, given twice or not asked for."""
    found = dict(got := list(embedder.embed(texts)))
    if len(got) != len(texts) or found.keys() != set(range(len(texts))):
        raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
    return [list(map(float, found[i])) for i in range(len(texts))]


def embedded(
    df: DataFrame, embedder: Embedder, text: str = "text", into: str = "vector", inputs: int = MAX_INPUTS, chars: int = MAX_CHARS
) -> DataFrame:
    """``df`` with the vector of each ``text``, asked for in batches within each partition.

    Null texts are sent as empty ones. A column called ``into`` is replaced. A task that is run again asks again.
    """
    kept = df.drop(into)
    schema = kept.withColumn(into, F.array().cast("array<double>")).schema

    def run(frames):
        for frame in frames:
            texts = frame[text].fillna("").tolist()
            found = [v for b in batches(texts, inputs, chars) for v in vectors_of(embedder, b)]
            yield frame.assign(**{into: found})

    return kept.mapInPandas(run, schema)


def _bucket(word: Column, dimensions: int) -> Column:
    return (F.conv(F.substring(F.md5(word), 1, 4), 16, 10).cast("int") % dimensions).alias("bucket")


def hashed(df: DataFrame, key: str, text: str, dimensions: int = 64) -> DataFrame:
    """(key, vector): counts of the words ``[a-z0-9]+`` of the lower-case text by hash, of length 1.

    Offline stand-in for an embedder; it knows words, not meanings. Rows of one key are one
    text; null texts and texts without words have zeros only.
    """
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    words = rows.select("key", F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("word")).filter("word <> ''")
    # no more than ``dimensions`` buckets for a key, so none is long
    counts = words.groupBy("key", _bucket(F.col("word"), dimensions)).agg(F.count("*").alias("n"))
    size = F.sqrt(F.sum(F.col("n") * F.col("n")))
    maps = counts.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("m"), size.alias("size"))
    maps = maps.withColumnRenamed("key", "of")
    cells = F.transform(
        F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.try_element_at("m", i) / F.col("size"), F.lit(0.0))
    )
    known = rows.select("key").distinct().join(maps, F.col("key").eqNullSafe(F.col("of")), "left")
    return known.select(F.col("key").alias(key), cells.alias("vector"))

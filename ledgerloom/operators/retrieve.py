"""Exact top-k cosine search with a similarity floor, and text windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FLOOR = 0.30
MAX_CHARS = 6000
OVERLAP = 500
SHARD_FLOATS = 1 << 22
BLOCK_SCORES = 1 << 22
LANES = 8


def _block_top_k(k: int, floor: float | None):
    """Over rows (task, asks, query_id, point_id, vector) in that order: a task's points, then its queries."""

    def best(queries, q_ids, points, norms, p_ids):
        size = np.sqrt((queries * queries).sum(axis=1))
        fine = size > 0
        queries, q_ids, size = queries[fine], q_ids[fine], size[fine]
        step = max(1, BLOCK_SCORES // max(1, len(points)))
        for lo in range(0, len(queries), step):
            scores = np.round(queries[lo : lo + step] @ points.T / size[lo : lo + step, None] / norms, 6)
            for q_id, row in zip(q_ids[lo : lo + step], scores):
                at = np.arange(len(row))
                if len(row) > k:
                    at = np.flatnonzero(row >= np.partition(row, -k)[-k])
                if floor is not None:
                    at = at[row[at] >= floor]
                # ids are in order, so a stable sort by score leaves ties in the order of ids
                at = at[np.argsort(-row[at], kind="stable")][:k]
                if len(at):
                    yield [q_id] * len(at), p_ids[at], row[at]

    def matrix(lists):
        return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)

    def run(batches):
        task, held, points = None, [], None
        for batch in batches:
            tasks, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            cuts = np.flatnonzero((np.diff(tasks) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
                if lo == hi:
                    continue
                if tasks[lo] != task:
                    task, held, points = tasks[lo], [], None
                q_ids, p_ids, vectors = (batch.column(i).slice(lo, hi - lo) for i in range(2, 5))
                if not asks[lo]:
                    held.append((p_ids.to_numpy(zero_copy_only=False), matrix(vectors)))
                    continue
                if points is None:
                    if not held:
                        continue
                    ids, points = np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])
                    norms, held = np.sqrt((points * points).sum(axis=1)), []
                    order = np.argsort(ids, kind="stable")
                    order = order[norms[order] > 0]
                    ids, points, norms = ids[order], points[order], norms[order]
                if not len(ids):
                    continue
                asked = q_ids.to_numpy(zero_copy_only=False)
                for found in best(matrix(vectors), asked, points, norms, ids):
                    columns = [pa.array(found[0], q_ids.type), pa.array(found[1], p_ids.type), pa.array(found[2], pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "point_id", "score"])

    return run


def top_k(queries: DataFrame, points: DataFrame, k: int = 5, floor: float | None = FLOOR) -> DataFrame:
    """(query_id, rank, point_id, score): a stated query set against all points, floor before limit.

    Points are cut into shards of at most SHARD_FLOATS or so; all queries stream through each
    shard, in LANES tasks, as matrix products, and leave it with their k best. Vectors of
    another length than the query's, of length zero, null or with null entries are not compared.
    """
    whole = "vector IS NOT NULL AND size(vector) > 0 AND NOT exists(vector, x -> x IS NULL)"
    q = queries.select(F.col("id").alias("query_id"), "vector").filter(whole)
    p = points.select(F.col("id").alias("point_id"), "vector").filter(whole)
    n_shards = 1 + (p.agg(F.sum(F.size("vector").cast("long"))).first()[0] or 0) // SHARD_FLOATS
    dim = F.size("vector").cast("long") * (n_shards * LANES)
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q_type, p_type = q.schema["query_id"].dataType, p.schema["point_id"].dataType
    held = p.withColumn("lane", numbers(LANES)).select(
        (dim + F.pmod(F.xxhash64("point_id"), F.lit(n_shards)) * LANES + F.col("lane")).alias("task"),
        F.lit(False).alias("asks"), F.lit(None).cast(q_type).alias("query_id"), "point_id", "vector",
    )
    sent = q.withColumn("shard", numbers(n_shards)).select(
        (dim + F.col("shard") * LANES + F.pmod(F.xxhash64("query_id"), F.lit(LANES))).alias("task"),
        F.lit(True).alias("asks"), "query_id", F.lit(None).cast(p_type).alias("point_id"), "vector",
    )
    dealt = held.unionAll(sent).repartition(n_shards * LANES, "task").sortWithinPartitions("task", "asks")
    kind = f"query_id {q_type.simpleString()}, point_id {p_type.simpleString()}, score double"
    found = dealt.mapInArrow(_block_top_k(k, floor), kind)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id")
    ranked = found.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "point_id", "score")


def windows(df: DataFrame, key: str, text: str, size: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(key, part, piece): texts over ``size`` in sliding windows, shorter ones whole with no part."""
    step = size - overlap
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))
    cut = F.transform(
        starts, lambda s, i: F.struct((i + 1).cast("long").alias("part"), F.col(text).substr(s + 1, F.lit(size)).alias("piece"))
    )
    whole = F.array(F.struct(F.lit(None).cast("long").alias("part"), F.col(text).alias("piece")))
    out = df.select(F.col(key), F.explode(F.when(n > size, cut).otherwise(whole)).alias("x"))
    return out.select(key, "x.part", "x.piece")

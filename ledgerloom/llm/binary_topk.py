"""Exact top-k search over binary codes by incremental multi-index hashing.

A code of 64 bits is cut into four segments of 16. The index keeps, per shard
of codes, the codes in order of each segment's value. A query looks up, for
radius 0, 1, 2, ... all segment values at exactly that distance from its own
and verifies the codes found there. After radius r every code within
4 (r + 1) - 1 bits has been seen, since it must be within r in some segment;
the search of a query ends when its k-th verified distance is that near.

The index is cut into shards of bounded size by a hash of the code. Each shard is
built LANES times, whatever the number of queries, and every lane streams its
part of all queries through the index it holds: what is shuffled are LANES
copies of the codes, one code per query and shard, and the k + 1 answers to it.
Memory is one shard and one batch of queries. Equal codes are searched once; of
equal codes only the k + 1 smallest ids can be in an answer, and a limited
window prunes the others before its shuffle, so one vector that a third of all
rows share stays small.

Defined results
    * a null or empty embedding has no code: it is neither found nor a query.
    * neighbours are ordered by distance, then id; a row is not its own
      neighbour; rows that repeat an id are one row, with the least of their codes.
    * with fewer than k other rows there are fewer neighbours.
    * coordinates past the 64th are ignored, missing ones count as bit 0.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

BITS = 64
SEGMENTS = 4
WIDTH = BITS // SEGMENTS
K = 10
SHARD_CODES = 1 << 20
LANES = 8


def sign_code(embedding):
    """64 sign bits of a float array as a signed long; null for null or empty input."""
    bits = F.aggregate(
        F.slice(embedding, 1, BITS),
        F.lit(0).cast("long"),
        lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(
            F.when(F.coalesce(x >= 0, F.lit(False)), F.lit(1)).otherwise(F.lit(0)).cast("long")
        ),
    )
    return F.when(F.size(embedding) > 0, bits)


def _masks() -> list[np.ndarray]:
    """For each radius, the values of WIDTH bits with that many ones."""
    return [
        np.array([sum(1 << b for b in c) for c in combinations(range(WIDTH), r)], dtype=np.int64)
        for r in range(WIDTH + 1)
    ]


class SegmentIndex:
    """Codes of a shard, in order of each segment's value."""

    masks = None

    def __init__(self, codes: np.ndarray, ids: np.ndarray):
        if SegmentIndex.masks is None:
            SegmentIndex.masks = _masks()
        self.codes, self.ids = codes, ids
        self.parts = []
        for s in range(SEGMENTS):
            v = ((codes >> np.uint64(WIDTH * s)) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)
            order = np.argsort(v, kind="stable")
            starts = np.searchsorted(v[order], np.arange((1 << WIDTH) + 1))
            self.parts.append((order, starts))

    def search(self, code: np.uint64, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids) of the k nearest by distance, then id."""
        seen = np.zeros(len(self.codes), dtype=bool)
        found = np.empty(0, dtype=np.int64)
        dist = np.empty(0, dtype=np.int64)
        value = int(code)
        for r, masks in enumerate(self.masks):
            for s, (order, starts) in enumerate(self.parts):
                at = ((value >> (WIDTH * s)) & ((1 << WIDTH) - 1)) ^ masks
                lo, n = starts[at], starts[at + 1] - starts[at]
                hit = n > 0
                lo, n = lo[hit], n[hit]
                total = int(n.sum())
                if not total:
                    continue
                where = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)
                new = order[where]
                new = new[~seen[new]]
                seen[new] = True
                found = np.concatenate((found, new))
                dist = np.concatenate(
                    (dist, np.bitwise_count(self.codes[new] ^ code).astype(np.int64))
                )
            covered = SEGMENTS * (r + 1) - 1
            if int((dist <= covered).sum()) >= k or len(found) == len(self.codes):
                break
        best = np.lexsort((self.ids[found], dist))[:k]
        return dist[best], self.ids[found[best]]


_FOUND = "q_code long, distance int, vec_id long"


def _search(k: int):
    """Over rows (task, is_query, code, vec_id) in that order: a task's codes, then its queries."""

    def run(batches):
        task, codes, ids, index = None, [], [], None
        for batch in batches:
            tasks, asks, code, vec_id = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            code = code.astype(np.int64).view(np.uint64)
            cuts = np.flatnonzero((np.diff(tasks) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
                if lo == hi:
                    continue
                if tasks[lo] != task:
                    task, codes, ids, index = tasks[lo], [], [], None
                if not asks[lo]:
                    codes.append(code[lo:hi])
                    ids.append(vec_id[lo:hi].astype(np.int64))
                    continue
                if index is None:
                    index = SegmentIndex(
                        np.concatenate([np.empty(0, np.uint64), *codes]), np.concatenate([np.empty(0, np.int64), *ids])
                    )
                    codes, ids = [], []
                queries = code[lo:hi]
                got = [index.search(q, k) for q in queries]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(queries, [len(d) for d, _ in got]).view(np.int64)),
                        pa.array(np.concatenate([d for d, _ in got]).astype(np.int32)),
                        pa.array(np.concatenate([x for _, x in got])),
                    ],
                    names=["q_code", "distance", "vec_id"],
                )

    return run


def _numbers(n: int):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def nearest(
    df: DataFrame,
    is_query,
    k: int = K,
    key: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """(query_id, rank, neighbour_id, distance) for every row where ``is_query`` holds."""
    coded = df.select(
        F.col(f"`{key}`").cast("long").alias("vec_id"),
        sign_code(F.col(f"`{embedding}`")).alias("code"),
        is_query.alias("is_query"),
    ).filter("code IS NOT NULL AND vec_id IS NOT NULL")
    one = coded.groupBy("vec_id").agg(F.min("code").alias("code"), F.max("is_query").alias("is_query"))
    coded = written(one, "mih-codes")
    by_code = W.partitionBy("code").orderBy("vec_id")
    index = (
        coded.withColumn("r", F.row_number().over(by_code)).filter(F.col("r") <= k + 1).select("vec_id", "code")
    )
    index = written(index, "mih-index")
    queries = coded.filter("is_query").select("vec_id", "code")
    asked = queries.select("code").distinct()
    n_shards = max(1, -(-index.count() // SHARD_CODES))
    lane = F.pmod(F.xxhash64("code", F.lit("lane")), F.lit(LANES))
    held = index.withColumn("lane", _numbers(LANES)).select(
        (F.pmod(F.xxhash64("code"), F.lit(n_shards)) * LANES + F.col("lane")).alias("task"),
        F.lit(False).alias("asks"),
        "code",
        "vec_id",
    )
    sent = asked.withColumn("shard", _numbers(n_shards)).select(
        (F.col("shard") * LANES + lane).alias("task"), F.lit(True).alias("asks"), "code", F.lit(0).cast("long").alias("vec_id")
    )
    dealt = held.unionAll(sent).repartition(n_shards * LANES, "task").sortWithinPartitions("task", "asks")
    found = dealt.mapInArrow(_search(k + 1), _FOUND)
    best = W.partitionBy("q_code").orderBy("distance", "vec_id")
    found = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1)
    answers = (
        queries.withColumnRenamed("vec_id", "query_id")
        .join(found, F.col("code") == F.col("q_code"))
        .filter("query_id <> vec_id")
        .withColumn(
            "rank",
            F.row_number().over(W.partitionBy("query_id").orderBy("distance", "vec_id")).cast("long"),
        )
        .filter(F.col("rank") <= k)
    )
    return answers.select(
        "query_id", "rank", F.col("vec_id").alias("neighbour_id"), F.col("distance").cast("long").alias("distance")
    )


def oracle_sql(k: int = K) -> str:
    """Brute force in DuckDB SQL, for tables whose ids have one vector each."""
    return f"""
WITH c AS (SELECT DISTINCT vec_id, list_transform(embedding[1:{BITS}], lambda x: CASE WHEN x >= 0 THEN 1 ELSE 0 END) AS bits
           FROM embeddings WHERE len(embedding) > 0 AND vec_id IS NOT NULL),
d AS (SELECT q.vec_id AS query_id, x.vec_id AS neighbour_id,
      CAST(list_sum(list_transform(generate_series(1, len(q.bits)), lambda i: CASE WHEN q.bits[i] <> x.bits[i] THEN 1 ELSE 0 END)) AS BIGINT) AS distance
      FROM c q, c x WHERE q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM d)
SELECT query_id, rank, neighbour_id, distance FROM r WHERE rank <= {k}
"""

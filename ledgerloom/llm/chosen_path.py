"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles, reduced to a min-hash
signature. In each run a set walks down sampled coordinates: a node of the tree
samples coordinates by a hash of its path, and sets that share the value there
share a child. On average 1 / threshold children are sampled, so a pair at the
threshold is expected to meet in one leaf of each run. The number of runs
follows from the survival of that branching process and the target recall.
Nodes above ``TILE`` sets are split further, with a wider choice so that recall
holds; small ones are brute-forced with exact intersections. What stays large,
or has members so alike that splitting only repeats them, is a group of like
texts. Each member of such nodes has one home, the largest of them, and homes
that meet in a node are one group, whose members are compared once, in tiles,
one task each, however many nodes they share. No tile returns pairs: only link counts and a
spanning forest leave it.

Equal sets are one representative, so copies are never paired. A pair that
meets in several small leaves counts in the least of them alone, and one that
meets in a small leaf does not count in the tiles.

Defined results
    * fewer than five words: one shingle of all words; no word: no links.
    * null ids are never a class id unless all ids of the class are null.
    * repeated rows are copies and count as links of each other.
    * extra columns are ignored by ``join`` and kept by ``first_of_class``.
    * ``first_of_class`` decides by row, not by id: rows of one id whose texts
      are in different classes are judged each by its own class. Of a class the
      row of the least id stays, of equal ones any one. Rows without an id, and
      rows without a word, which are in no class, all stay.
    * thresholds below LEAST_THRESHOLD are refused, as links would be lost.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, words, written

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
DEPTH = 3
TILE = 256
COORDINATES = 64
DEEPER = 3
DEEPER_CHILDREN = 3.0
#: Members of a large node agree on this share of coordinates, judged by LIKE_PROBES of them: split no further.
LIKE = 0.5
LIKE_PROBES = 4
#: Below it, a pair at the threshold agrees too rarely on LIKE of its coordinates for the target recall.
LEAST_THRESHOLD = 0.7
COLUMN_BLOCK = 8192
#: Members and shingles of one side of a tile of a group of like texts.
LARGE_TILE = 1024
LARGE_TILE_SHINGLES = 3_000_000
GOLDEN = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _constants(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(GOLDEN) + np.uint64(seed))


_STEPS = _constants(WORDS, 11) | np.uint64(1)
_SALTS = _constants(COORDINATES, 12)
_ODD = _constants(COORDINATES, 14) | np.uint64(1)


def shingles(word_hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the windows of five words."""
    h = word_hashes.view(np.uint64)
    if not len(h):
        return h
    n = max(1, len(h) - WORDS + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(min(WORDS, len(h))):
        out += mix64(h[j : j + n] * _STEPS[j])
    return np.unique(mix64(out + np.uint64(min(len(h), WORDS))))


def signature(s: np.ndarray) -> np.ndarray:
    """Least products with odd factors; the shingle hashes are well mixed already."""
    return np.array([(s * odd).min() for odd in _ODD], dtype=np.uint64)


def survival(depth: int, mean: float = 1.0) -> float:
    """Chance that a branching process with Poisson offspring lives for ``depth`` levels."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-mean * p)
    return p


def runs_for(recall: float, depth: int = DEPTH) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(depth)))


def children(rows: np.ndarray, nodes: np.ndarray, sigs: np.ndarray, mean: float):
    """(rows, child nodes) of sets ``rows`` of ``sigs`` at ``nodes``; a node's choice depends on it alone."""
    limit = np.uint64(min(mean / COORDINATES, 0.999) * 2.0**64)
    i, at = np.nonzero(mix64(nodes[:, None] + _SALTS[None, :]) < limit)
    value = sigs[rows[i], at]
    return rows[i], mix64(mix64(value + nodes[i]) + at.astype(np.uint64) * np.uint64(GOLDEN))


def leaves(sigs: np.ndarray, runs: int, threshold: float):
    """(rows, nodes) at ``DEPTH`` of every set in every run, all sets at once."""
    rows = np.repeat(np.arange(len(sigs)), runs)
    nodes = np.tile(_constants(runs, 13), len(sigs))
    for _ in range(DEPTH):
        rows, nodes = children(rows, nodes, sigs, 1 / threshold)
    return rows, nodes


def _hashed(df: DataFrame, text: str):
    return F.transform(words(F.col(f"`{text}`")), lambda w: F.xxhash64(w))


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _rows(column):
    for x in column:
        v = x.values
        yield np.empty(0, np.int64) if v is None else v.to_numpy()


def fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, digest, sig, short, size) per row; no digest where the text has no word."""
    kind = df.schema[key].dataType.simpleString()
    slim = df.select(F.col(f"`{key}`").alias("id"), _hashed(df, text).alias("w"))

    def run(batches):
        for batch in batches:
            digests, sigs, shorts, sizes = [], [], [], []
            for w in _rows(batch.column(1)):
                s = shingles(w)
                digests.append(_digest(s) if len(s) else None)
                sizes.append(len(s))
                sig = signature(s) if len(s) else None
                sigs.append(None if sig is None else sig.tobytes())
                shorts.append(None if sig is None else mix64(sig).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array(shorts, pa.binary()), pa.array(sizes, pa.int64())],
                names=["id", "digest", "sig", "short", "size"],
            )

    return slim.mapInArrow(run, f"id {kind}, digest binary, sig binary, short binary, size long")


def _signatures(column) -> np.ndarray:
    joined = b"".join(x.as_py() for x in column)
    return np.frombuffer(joined, dtype=np.uint64).reshape(-1, COORDINATES)


def _walk(first: bool, runs: int, threshold: float):
    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                sigs = _signatures(batch.column(1))
                if first:
                    rows, nodes = leaves(sigs, runs, threshold)
                else:
                    at = batch.column(2).to_numpy().view(np.uint64)
                    rows, nodes = children(np.arange(len(sigs)), at, sigs, DEEPER_CHILDREN / threshold)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(nodes.view(np.int64))], names=["digest", "node"]
                )

    return run


def _partnered(node: np.ndarray, short: np.ndarray) -> np.ndarray:
    """Which of the rows, sorted by node, have a partner in their node by half their coordinates."""
    keep = np.zeros(len(node), dtype=bool)
    at, lag = np.arange(len(node)), 1
    while len(at):
        at = at[at + lag < len(node)]
        at = at[node[at] == node[at + lag]]
        like = (short[at] == short[at + lag]).sum(axis=1) >= COORDINATES // 2
        keep[at[like]] = True
        keep[at[like] + lag] = True
        lag += 1
    return keep


def _plausible(batches):
    """Rows (digest, node, n, short) in order of node; those without a plausible partner go."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        node = table.column("node").to_numpy()
        end = int(np.searchsorted(node, node[-1])) if len(node) else 0
        held = table.slice(end)
        yield from _kept_rows(table.slice(0, end))
    if held is not None:
        yield from _kept_rows(held)


def _kept_rows(table):
    if table.num_rows:
        table = table.combine_chunks()
        short = np.frombuffer(b"".join(table.column("short").to_pylist()), dtype=np.uint16).reshape(-1, COORDINATES)
        keep = _partnered(table.column("node").to_numpy(), short)
        yield from table.select(["digest", "node"]).filter(pa.array(keep)).combine_chunks().to_batches()


def _distinct_nodes(at: DataFrame) -> DataFrame:
    """(node, n) with two members or more, one node for each distinct member list."""
    return (
        at.groupBy("node")
        .agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("digest")).alias("members"))
        .filter("n > 1")
        .groupBy("n", "members")
        .agg(F.min("node").alias("node"))
        .select("node", "n")
    )


def _alike(members: DataFrame, reps: DataFrame) -> DataFrame:
    """Nodes whose members agree on at least ``LIKE`` of the probed coordinates, by pairs."""
    step = COORDINATES // LIKE_PROBES
    probes = F.array(*(F.struct(F.lit(i).alias("i"), F.substring("short", 2 * i * step + 1, 2).alias("v")) for i in range(LIKE_PROBES)))
    seen = members.join(reps.select("digest", "short"), "digest").select("node", "n", F.explode(probes).alias("p"))
    same = seen.groupBy("node", "n", "p").agg(F.count("*").cast("double").alias("c"))
    share = F.sum(F.col("c") * F.col("c")) / (F.first("n").cast("double") * F.first("n") * LIKE_PROBES)
    return same.groupBy("node").agg(share.alias("share")).filter(F.col("share") >= LIKE).select("node")


def _buckets(reps: DataFrame, runs: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(digest, node) of small nodes and of large ones, one node per distinct member list."""
    at = written(
        reps.select("digest", "sig").mapInArrow(_walk(True, runs, threshold), "digest binary, node long"),
        "path-nodes",
    )
    done, large, used = [], [], [at]
    for level in range(DEEPER + 1):
        sizes = written(_distinct_nodes(at), "path-sizes")
        done.append(at.join(sizes.filter(F.col("n") <= TILE), "node"))
        members = at.join(sizes.filter(F.col("n") > TILE), "node")
        if level == DEEPER:
            large.append(members)
            break
        alike = written(_alike(members, reps), "path-alike")
        large.append(members.join(alike, "node", "left_semi"))
        split = members.join(alike, "node", "left_anti")
        at = split.select("digest", "node").join(reps.select("digest", "sig"), "digest")
        at = written(
            at.select("digest", "sig", "node")
            .mapInArrow(_walk(False, runs, threshold), "digest binary, node long")
            .distinct(),
            "path-nodes",
        )
        used.append(at)
        if at.isEmpty():
            break
    out = large[0].select("digest", "node", "n")
    for x in large[1:]:
        out = out.unionByName(x.select("digest", "node", "n"))
    small, out = written(_small(done, reps), "path-buckets"), written(out, "path-large-nodes")
    dropped(*used)
    return small, out


def _large_tiles(large: DataFrame, reps: DataFrame) -> DataFrame:
    """(digest, a, b, lo, hi, side): tiles of groups of like texts, each pair of members in one tile.

    Each member has one home, the largest of its nodes. Homes that meet in a node
    are one group, named by its least node, so a pair is never met twice.
    """
    home = large.groupBy("digest").agg(F.max(F.struct("n", "node"))["node"].alias("home"))
    home = written(home, "path-homes")
    meet = large.select("digest", "node").join(home, "digest").filter("node <> home")
    named = components(meet.select(F.col("home").alias("u"), F.col("node").alias("v")))
    named = named.select(F.col("digest").alias("home"), F.col("root"))
    mine = home.join(named, "home", "left").select("digest", F.coalesce("root", "home").alias("a"))
    mine = written(mine.join(reps.select("digest", "size"), "digest"), "path-groups")
    dropped(home)
    blocks = F.ceil(F.greatest(F.count("*") / LARGE_TILE, F.sum("size") / LARGE_TILE_SHINGLES)).cast("int")
    sizes = written(mine.groupBy("a").agg(blocks.alias("blocks")), "path-blocks")
    k = F.pmod(F.xxhash64("digest", "a"), F.col("blocks")).cast("int")
    t = mine.join(sizes, "a").withColumn("k", k)
    t = t.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return t.select(
        "digest",
        "a",
        F.col("a").alias("b"),
        F.least("k", "j").alias("lo"),
        F.greatest("k", "j").alias("hi"),
        (F.col("k") > F.col("j")).cast("int").alias("side"),
    )


def _small(done: list[DataFrame], reps: DataFrame) -> DataFrame:
    """(digest, node) of nodes of one tile, without sets that have no plausible partner there.

    A pair at the threshold differs in a fifth of its coordinates; one that
    differs in half of all 64 is beyond six standard deviations.
    """
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    out = out.select("digest", "node").join(reps.select("digest", "short"), "digest")
    out = out.repartition("node").sortWithinPartitions("node").select("digest", "node", "short")
    kept = written(out.mapInArrow(_plausible, "digest binary, node long"), "path-plausible")
    return kept.join(_distinct_nodes(kept), "node").select("digest", "node")


def overlaps(sets: list[np.ndarray], cut: int = 0) -> np.ndarray:
    """Sizes of all intersections, or of those of the first ``cut`` sets with the others.

    Tokens seen once are dropped, the rest multiplied by blocks.
    """
    n = len(sets)
    out = np.zeros((cut or n, n - cut), dtype=np.float32)
    who = np.repeat(np.arange(n), [len(s) for s in sets])
    _, token, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen[token] > 1
    who, token = who[shared], token[shared]
    order = np.argsort(token, kind="stable")
    who, token = who[order], token[order]
    if len(token):
        token = np.concatenate(([0], np.cumsum(np.diff(token) > 0)))
        for lo in range(0, int(token[-1]) + 1, COLUMN_BLOCK):
            a, b = np.searchsorted(token, [lo, lo + COLUMN_BLOCK])
            m = np.zeros((n, COLUMN_BLOCK), dtype=np.float32)
            m[who[a:b], token[a:b] - lo] = 1
            out += m[: cut or n] @ m[cut:].T
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each component, by repeated hooking of minima."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _verify(threshold: float):
    def run(key, table):
        table = table.sort_by([("side", "ascending"), ("digest", "ascending")])
        node, _, lo, hi = (x.as_py() for x in key)
        digests = table.column("digest").to_pylist()
        side = table.column("side").to_numpy()
        copies = table.column("copies").to_numpy()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("s").to_pylist()]
        met = [set(x) for x in table.column("nodes").to_pylist()]
        size = np.array([len(s) for s in sets], dtype=np.float64)
        cut = int((side == 0).sum()) if lo != hi else 0
        if lo != hi and cut in (0, len(sets)):  # the other side has no members
            a = b = np.empty(0, dtype=np.int64)
        else:
            same = overlaps(sets, cut)
            a, b = [], []
            for i in range(len(same)):  # a row at a time, as the matrix may be large
                linked = same[i] >= threshold * (size[i] + size[cut:] - same[i]) - 1e-9
                j = np.flatnonzero(linked) + cut
                j = j[j > i]
                a.append(np.full(len(j), i))
                b.append(j)
            a, b = np.concatenate(a), np.concatenate(b)
        root = _roots(len(sets), a, b)
        pairs = zip(a.tolist(), b.tolist(), strict=True)
        if lo < 0:  # a small node
            owned = (min(met[i] & met[j]) == node for i, j in pairs)
        else:
            owned = (met[i].isdisjoint(met[j]) for i, j in pairs)
        mine = np.fromiter(owned, dtype=bool, count=len(a))
        a, b = a[mine], b[mine]
        links = np.bincount(a, copies[b], len(sets)) + np.bincount(b, copies[a], len(sets))
        return pa.table(
            {
                "digest": pa.array(digests, pa.binary()),
                "root": pa.array([digests[r] for r in root], pa.binary()),
                "links": pa.array(links.astype(np.int64)),
            }
        )

    return run


def components(edges: DataFrame) -> DataFrame:
    """(digest, root) of linked nodes, by alternating large and small stars.

    The least neighbours are written before the joins, so that joins split at hubs.
    """
    e = written(edges.filter("u <> v").select("u", "v").distinct(), "path-edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        low = written(low, "path-low")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.filter("u <> v").distinct(), "path-large")
        dropped(low)
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = written(down.groupBy("u").agg(F.min("v").alias("m")), "path-low")
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v")))
        new = written(small.filter("u <> v").distinct(), "path-small")
        mark = (F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"))
        done = new.agg(*mark).first() == e.agg(*mark).first()
        dropped(low, large, e)
        if done:
            return new.select(F.col("u").alias("digest"), F.col("v").alias("root"))
        e = new


def _sets(df: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """(digest, s) of the wanted representatives, from the texts of their rows.

    Whole texts are dealt out, which are smaller than the hashes of their words.
    """
    rows = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    if wanted is not None:
        rows = rows.join(wanted.select("id").distinct().hint("merge"), "id", "left_semi")
    rows = rows.select(_hashed(rows, "text").alias("w"))

    def run(batches):
        for batch in batches:
            got = [shingles(w) for w in _rows(batch.column(0))]
            got = [s for s in got if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_digest(s) for s in got], pa.binary()), pa.array([s.tobytes() for s in got], pa.binary())],
                names=["digest", "s"],
            )

    found = rows.mapInArrow(run, "digest binary, s binary")
    return found.dropDuplicates(["digest"])


def classes(
    df: DataFrame, key="doc_id", text="text", threshold=THRESHOLD, recall=RECALL
) -> DataFrame:
    """(id, digest, root, class_id, n_links) per row; digest names the row's set, root its class."""
    if threshold < LEAST_THRESHOLD:
        raise ValueError(f"threshold {threshold} is below {LEAST_THRESHOLD}")
    prints = written(fingerprints(df, key, text), "path-prints")
    reps = written(
        prints.filter("digest IS NOT NULL")
        .groupBy("digest")
        .agg(
            F.count("*").alias("copies"),
            F.min("id").alias("id"),
            *(F.first(c).alias(c) for c in ("sig", "short", "size")),
        ),
        "path-reps",
    )
    ids = written(prints.select("id", "digest"), "path-ids")
    dropped(prints)
    small, large = _buckets(reps, runs_for(recall), threshold)
    met = small.unionByName(large.select("digest", F.lit(None).cast("long").alias("node")).distinct())
    met = met.groupBy("digest").agg(F.collect_set("node").alias("nodes"))
    asked = written(met.join(reps.select("digest", "copies", "id"), "digest"), "path-asked")
    one = F.lit(-1)
    tiles = small.select(
        "digest", F.col("node").alias("a"), F.col("node").alias("b"), one.alias("lo"), one.alias("hi"), F.lit(0).alias("side")
    ).unionByName(_large_tiles(large, reps))
    tiles = written(tiles, "path-tiles")
    slim = written(reps.select("digest", "copies", "id"), "path-slim")
    dropped(reps, small, large)
    # a representative whose rows all lack an id cannot be looked up by it
    no_ids = not asked.filter("id IS NULL").isEmpty()
    sets = written(_sets(df, key, text, None if no_ids else asked), "path-sets")
    found = (
        tiles.join(asked.drop("id").join(sets, "digest"), "digest")
        .groupBy("a", "b", "lo", "hi")
        .applyInArrow(_verify(threshold), "digest binary, root binary, links long")
    )
    found = written(found, "path-found")
    dropped(tiles, asked, sets)
    roots = components(found.select(F.col("digest").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("digest").agg(F.sum("links").alias("links"))
    known = (
        slim.join(links, "digest", "left").join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    )
    known = written(known, "path-known")
    dropped(found, slim)
    first = known.groupBy("root").agg(F.min("id").alias("class_id"))
    named = known.join(first, "root").select(
        "digest", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    out = ids.join(named, "digest", "left").select(
        "id", "digest", "root",
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
    out = written(out, "path-classes")
    dropped(ids, known)
    return out


def join(df: DataFrame, key="doc_id", text="text", **options) -> DataFrame:
    """(key, class_id, n_links): class of linked documents and number of links of each row."""
    return classes(df, key, text, **options).select(F.col("id").alias(key), "class_id", "n_links")


def first_of_class(df: DataFrame, key="doc_id", text="text", **options) -> DataFrame:
    """One row of each class, that with the least id; rows without an id or without a word all stay."""
    rows = classes(df, key, text, **options).filter("id IS NOT NULL")
    least = F.min(F.struct("id", "digest")).alias("k")
    keepers = rows.filter("digest IS NOT NULL").groupBy("root").agg(least)
    keepers = written(keepers.select("root", F.col("k.id").alias("k_id"), F.col("k.digest").alias("k_digest")), "path-keepers")
    stays = F.col("digest").isNull() | ((F.col("digest") == F.col("k_digest")) & (F.col("id") == F.col("k_id")))
    by_id = rows.join(keepers, "root", "left").groupBy("id").agg(F.count("*").alias("n"), F.count_if(stays).alias("n_stay"))
    by_id = written(by_id.filter("n > 1 OR n_stay = 0"), "path-ids-judged")
    here = F.col(f"`{key}`")
    gone = by_id.filter("n_stay = 0").select(F.col("id").alias("__gone"))
    open_ids = by_id.filter("n_stay > 0").select(F.col("id").alias("__open"))
    left = df.join(gone, here == F.col("__gone"), "left_anti")
    if open_ids.isEmpty():
        return left
    # rows that their id does not decide are looked at again with their sets
    again = left.join(open_ids, here == F.col("__open"), "left_semi")
    again = written(again.withColumn("__row", F.monotonically_increasing_id()), "path-again")
    prints = fingerprints(again, "__row", text).select(F.col("id").alias("__row"), F.col("digest").alias("__digest"))
    sets = again.select("__row", here.alias("__id")).join(prints, "__row")
    own = sets.filter("__digest IS NOT NULL").groupBy("__digest", "__id").agg(F.min("__row").alias("__row"))
    own = own.join(keepers, (F.col("__digest") == F.col("k_digest")) & (F.col("__id") == F.col("k_id")))
    kept = sets.filter("__digest IS NULL").select("__row").unionByName(own.select("__row"))
    settled = left.join(open_ids, here == F.col("__open"), "left_anti")
    return settled.unionByName(again.join(kept, "__row", "left_semi").drop("__row"))

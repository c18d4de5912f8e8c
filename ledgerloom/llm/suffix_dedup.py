"""Suffix-array removal of long byte strings that repeat across documents.

Every 50-byte string owns one anchor: the leftmost of its 16-byte grams of least
hash, so equal strings have equal anchors at the same place. Consecutive strings
of a document with one anchor form a context. A first pass emits anchors only;
those seen under one document id are dropped after a pre-aggregation. A second
pass cuts the contexts of the anchors that are left. Equal contexts are one row
with their least document id. Contexts are cut to the
strings that another context of their anchor may hold. Shards of them get a
suffix array by induced sorting: suffixes are classified, the leftmost-smaller substrings are
sorted (recursively where they repeat), and the array is induced linearly.
Permuted common prefixes cut the array into groups of suffixes that share 50
bytes; the least document id of a group says who may keep the string.

An anchor with many different contexts (a common phrase) is split: the strings
that hold it at an early place and those that hold it at a late one share more
than the gram, so each half gets a longer anchor of its own, as often as needed.
No task sees the occurrences of a hot anchor or context together; rows meet
their contexts in joins that split.

Defined results
    * null or empty text: 0 bytes, nothing removed, the hash of no bytes.
    * texts under 50 bytes lose nothing.
    * rows with equal ids never remove bytes of each other; each is judged alone.
    * a row without an id keeps all its bytes and removes none of others.
    * extra columns are ignored by ``dedup`` and kept by ``dedup_documents``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

LENGTH = 50
GRAM = 16
#: Places that the gram can take in a string.
PLACES = LENGTH - GRAM + 1
#: Distinct contexts a shard holds on average, and those above which an anchor is split.
SHARD_CONTEXTS = 4_000
SPLIT_ABOVE = 2_000
#: Bytes of text that a pass takes at once; a longer text is taken whole.
CHUNK = 1 << 17
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_FINISH = np.uint64(0xD6E8FEB86659FD93)
#: Low bits of a hash that give way to the gram's place, so that the least is the leftmost.
_PLACE_BITS = np.uint64(31)


# ---- induced sorting --------------------------------------------------------

#: Buckets of fewer suffixes are swept together, up to so many at once.
_FEW = 256
_TOGETHER = 1024


def _sweep(sa, kinds, lands, heads, tails, first=-1):
    """Scan ``sa`` upwards; append each entry's predecessor to the front part of its bucket.

    ``lands`` has, per suffix, the bucket of its predecessor, the number of
    buckets where it is not to be placed. Buckets hold their given entries at the
    end; free places are -1. A bucket is scanned in rounds, as it may receive
    entries while it is scanned. Small buckets are scanned together as far as
    none of them receives any.
    """
    n = len(heads)
    free = heads.copy()

    def push(entries, c):
        some = c < n
        entries, c = entries[some], c[some]
        if not len(c):
            return
        order = c.argsort(kind="stable")
        c = c[order]
        edge = np.flatnonzero(c[1:] != c[:-1])
        edge += 1
        if not len(edge):  # one bucket
            at = free[c[0]]
            sa[at : at + len(c)] = entries - 1
            free[c[0]] += len(c)
            return
        bounds = np.empty(len(edge) + 2, dtype=np.int64)
        bounds[0], bounds[1:-1], bounds[-1] = 0, edge, len(c)
        count = bounds[1:] - bounds[:-1]
        bucket = c[bounds[:-1]]
        sa[(free[bucket] - bounds[:-1]).repeat(count) + np.arange(len(c))] = entries[order] - 1
        free[bucket] += count

    def rounds(b):
        lo = heads[b]
        while lo < free[b]:
            hi = free[b]
            part = sa[lo:hi].copy()
            push(part, lands[part])
            lo = hi
        rest = sa[lo : tails[b]]
        rest = rest[rest >= 0]
        push(rest, lands[rest])

    if first >= 0:
        b = kinds[first]
        sa[free[b]] = first
        free[b] += 1
    b = 0
    while b < n:
        if tails[b] - heads[b] >= _FEW:
            rounds(b)
            b += 1
            continue
        end = max(b + 1, int(tails.searchsorted(heads[b] + _TOGETHER, side="right")))
        entries = sa[heads[b] : tails[end - 1]]
        entries = entries[entries >= 0]
        if not len(entries):
            b = end
            continue
        c = lands[entries]
        least = np.minimum.accumulate(c)
        own = kinds[entries]
        late = (own[1:] >= least[:-1]).argmax() if len(own) > 1 else 0
        stop = int(least[late] if len(own) > 1 and own[late + 1] >= least[late] else least[-1])
        if stop <= b:
            rounds(b)
            b += 1
            continue
        if stop < end:
            some = own < stop
            entries, c = entries[some], c[some]
        push(entries, c)
        b = min(stop, end)


def _induce(s, smaller, seeds, heads, tails):
    """Suffix array from its sorted leftmost-smaller suffixes ``seeds``."""
    n, top = len(s), len(heads)
    sa = np.full(n, -1, dtype=np.int32)
    c = s[seeds]
    order = np.argsort(c, kind="stable")
    count = np.bincount(c, minlength=top)
    first = np.cumsum(count) - count
    at = (tails - count)[c[order]] + np.arange(len(c)) - first[c[order]]
    sa[at] = seeds[order]
    lands = np.full(n, top, dtype=s.dtype)
    np.copyto(lands[1:], s[:-1], where=~smaller[:-1])
    _sweep(sa, s, lands, heads, tails, first=n - 1)
    sa[at] = -1
    # the other half goes downwards: the same sweep over the mirrored array
    mirrored = (top - 1 - s).astype(s.dtype)
    lands[:] = top
    np.copyto(lands[1:], mirrored[:-1], where=smaller[:-1])
    _sweep(sa[::-1], mirrored, lands, (n - tails)[::-1].copy(), (n - heads)[::-1].copy())
    return sa


def suffix_array(s: np.ndarray | list, largest: int | None = None) -> np.ndarray | list:
    """Suffix array of the integers ``s``, 0 or more and not much above ``len(s)``, by induced sorting.

    The end of ``s`` is less than any value. A list gives a list. Callers may
    state the largest value, which is found without it.
    """
    if isinstance(s, list):
        return suffix_array(np.array(s, dtype=np.int64)).tolist()
    n = len(s)
    if n < 2:
        return np.arange(n)
    count = np.bincount(s)
    rank = np.cumsum(count > 0) - 1
    count = count[count > 0]
    s = rank.astype(np.uint16 if len(count) < 1 << 16 else np.int32)[s]  # 16 bits sort by radix
    tails = np.cumsum(count)
    heads = tails - count
    # a suffix is smaller than the next one if the next different value is larger
    change = np.append(np.flatnonzero(s[1:] != s[:-1]), n - 1)
    up = np.append(s[change[:-1]] < s[change[:-1] + 1], False)
    smaller = np.repeat(up, np.diff(np.concatenate(([-1], change))))
    starts = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if not len(starts):
        return _induce(s, smaller, starts, heads, tails)
    sa = _induce(s, smaller, starts, heads, tails)
    is_start = np.zeros(n, dtype=bool)
    is_start[starts] = True
    order = sa[is_start[sa]]
    ends = np.append(starts[1:] + 1, n)
    which = np.empty(n, dtype=np.int64)
    which[starts] = np.arange(len(starts))
    length = (ends - starts)[which[order]]
    same = length[1:] == length[:-1]
    same &= (which[order[1:]] != len(starts) - 1) & (which[order[:-1]] != len(starts) - 1)
    left = np.flatnonzero(same)
    step = 0
    while len(left):
        equal = s[order[left] + step] == s[order[left + 1] + step]
        same[left[~equal]] = False
        step += 1
        left = left[equal & (length[left] > step)]
    name = np.concatenate(([0], np.cumsum(~same)))
    if name[-1] + 1 < len(starts):
        names = np.empty(len(starts), dtype=np.int64)
        names[which[order]] = name
        order = starts[suffix_array(names)]
    return _induce(s, smaller, order, heads, tails)


def common_prefixes(s: np.ndarray, sa: np.ndarray, firsts: np.ndarray, steps: np.ndarray, most: int) -> np.ndarray:
    """Per place of the texts that begin at ``firsts`` (``steps`` places each), the prefix it shares with the suffix before it in ``sa``, up to ``most``.

    Computed in text order (permuted), where it falls by at most one per step,
    for all texts side by side. Other places are 0.
    """
    n = len(s)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate((s, np.full(most + 1, -1, dtype=s.dtype)))
    out = np.zeros(n, dtype=np.int64)
    lanes = np.flatnonzero(steps > 0)
    held = np.zeros(len(firsts), dtype=np.int64)
    t = 0
    while len(lanes):
        i = firsts[lanes] + t
        j = before[i]
        h = np.maximum(held[lanes] - 1, 0)
        h[j < 0] = 0
        live = np.flatnonzero((j >= 0) & (h < most))
        while len(live):
            x, y = i[live] + h[live], j[live] + h[live]
            live = live[(padded[x] == padded[y]) & (x < n) & (y < n)]
            h[live] += 1
            live = live[h[live] < most]
        out[i] = h
        held[lanes] = h
        t += 1
        lanes = lanes[steps[lanes] > t]
    return out


def least_owner(data: np.ndarray, ends: np.ndarray, owners: np.ndarray, length: int = LENGTH):
    """For each place of the contexts where ``length`` bytes start, the least owner of those bytes.

    Contexts are ``data`` cut at ``ends``. Returns (owners, places per context).
    """
    size = np.diff(np.concatenate(([0], ends)))
    places = np.maximum(size - length + 1, 0)
    n = len(data) + len(ends)
    s = np.empty(n, dtype=np.int32)
    s[ends + np.arange(len(ends))] = np.arange(len(ends))  # a context ends with a value of its own
    body = np.ones(n, dtype=bool)
    body[ends + np.arange(len(ends))] = False
    s[body] = data.astype(np.int32) + len(ends)
    firsts = ends - size + np.arange(len(ends))
    sa = suffix_array(s)
    shared = common_prefixes(s, sa, firsts, places, length)
    owner = np.full(n, -1, dtype=np.int64)
    at = np.repeat(firsts - (np.cumsum(places) - places), places) + np.arange(places.sum())
    owner[at] = np.repeat(owners, places)
    full = np.zeros(n, dtype=bool)
    full[at] = True
    # suffixes that share their first bytes with a full one are full themselves
    ranked = sa[full[sa]]
    if not len(ranked):
        return np.empty(0, np.int64), places
    edge = np.flatnonzero(np.concatenate(([True], shared[ranked[1:]] < length)))
    low = np.minimum.reduceat(owner[ranked], edge)
    best = np.empty(n, dtype=np.int64)
    best[ranked] = np.repeat(low, np.diff(np.append(edge, len(ranked))))
    return best[at], places


# ---- anchors and contexts ---------------------------------------------------


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of ``GRAM`` bytes, by doubling."""
    h, width = (b.astype(np.uint64) + np.uint64(1)) * _FACTOR, 1
    while width < GRAM:
        h ^= h >> np.uint64(29)
        h = h[:-width] * _FINISH + (h[width:] ^ np.uint64(width)) * _FACTOR
        width *= 2
    h ^= h >> np.uint64(32)
    h *= _FINISH
    return h ^ (h >> np.uint64(31))


def context_runs(b: np.ndarray, begins: np.ndarray):
    """(anchor hash, first start, last start, anchor place) of the runs of strings with one anchor.

    ``b`` holds texts from ``begins`` (ascending, the last entry is the end);
    strings never cross texts.
    """
    none = np.empty(0, np.int64)
    if len(b) < LENGTH:
        return none, none, none, none
    h = gram_hashes(b)
    low = ((h >> _PLACE_BITS) << _PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= PLACES:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = PLACES - width
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    anchor = (low & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    sizes = np.maximum(np.diff(begins) - LENGTH + 1, 0)  # strings of each text
    ends = np.cumsum(sizes)
    starts = np.repeat(begins[:-1] - (ends - sizes), sizes) + np.arange(ends[-1])
    if not len(starts):
        return none, none, none, none
    a = anchor[starts]
    new = np.concatenate(([True], a[1:] != a[:-1]))
    new[(ends - sizes)[sizes > 0]] = True
    edge = np.flatnonzero(new)
    last = np.append(edge[1:], len(starts)) - 1
    return h[a[edge]].view(np.int64), starts[edge], starts[last], a[edge]


_SLIM = "id long, h long"


def _slim(df: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return df.select(
        F.col(f"`{key}`").cast("long").alias("id"), F.xxhash64(body).alias("h"), body.cast("binary").alias("body")
    )


def _chunks(batch, column):
    """(rows, bytes, begins) of runs of rows, about ``CHUNK`` bytes at once."""
    x = batch.column(column).cast(pa.large_binary())
    offsets = np.frombuffer(x.buffers()[1], dtype=np.int64)[x.offset : x.offset + len(x) + 1]
    data = np.frombuffer(x.buffers()[2] or b"", dtype=np.uint8)
    lo = 0
    while lo < len(x):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, side="right")) - 1)
        hi = min(hi, len(x))
        yield slice(lo, hi), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _emit_anchors(batches):
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for rows, data, begins in _chunks(batch, 1):
            anchor, start, _, _ = context_runs(data, begins)
            row = np.searchsorted(begins, start, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows][row]), pa.array(anchor)], names=["id", "anchor"])


def _cut_bytes(data: np.ndarray, lo: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.cumsum(size)
    at = np.repeat(lo - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(offsets), pa.py_buffer(data[at].tobytes())])


def _emit_contexts(batches):
    names = ["id", "h", "anchor", "start", "place", "context"]
    for batch in batches:
        ids, hs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        wanted = batch.column(3)
        for rows, data, begins in _chunks(batch, 2):
            anchor, start, last, at = context_runs(data, begins)
            shared = np.isin(anchor, wanted.slice(rows.start, rows.stop - rows.start).flatten().to_numpy())
            anchor, start, last, at = anchor[shared], start[shared], last[shared], at[shared]
            row = np.searchsorted(begins, start, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[rows][row]),
                    pa.array(hs[rows][row]),
                    pa.array(anchor),
                    pa.array(start - begins[row]),
                    pa.array((at - start).astype(np.int32)),
                    _cut_bytes(data, start, last - start + LENGTH),
                ],
                names=names,
            )


def _reach(data, begin, size, anchor, origin, step):
    """Per context, how many bytes from ``origin`` on (``step`` 1) or back (-1) it shares with another of its anchor."""
    keys = np.zeros((len(begin), 8 + LENGTH), dtype=np.uint8)
    keys[:, :8] = anchor.astype(">i8").view(np.uint8).reshape(-1, 8)
    room = np.minimum(begin + size - origin if step > 0 else origin - begin + 1, LENGTH)
    for j in range(LENGTH):
        some = np.flatnonzero(room > j)
        keys[some, 8 + j] = data[origin[some] + step * j]
    order = np.argsort(keys.view(f"V{8 + LENGTH}").ravel(), kind="stable")
    keys, room = keys[order], room[order]
    equal = keys[1:] == keys[:-1]
    shared = np.where(equal.all(axis=1), LENGTH, equal.argmin(axis=1) - 8)  # neighbours in this order share most
    shared = np.maximum(np.minimum(shared, np.minimum(room[1:], room[:-1])), 0)
    out = np.zeros(len(begin), dtype=np.int64)
    out[order[1:]] = shared
    out[order[:-1]] = np.maximum(out[order[:-1]], shared)
    return out


def _sort_shard(table):
    """(anchor, ck, lo, hi, owner): per context its runs of strings with one least owner.

    A context is cut to the strings whose bytes before and after the gram may
    each occur in another context of its anchor: no other string can be equal to
    one there. What is left is sorted.
    """
    anchor = table.column("anchor").to_numpy()
    ck, owner = table.column("ck").to_numpy(), table.column("owner").to_numpy()
    context = table.column("context").combine_chunks().cast(pa.large_binary())
    offsets = np.frombuffer(context.buffers()[1], dtype=np.int64)[context.offset : context.offset + len(context) + 1]
    data = np.frombuffer(context.buffers()[2], dtype=np.uint8)
    size = np.diff(offsets)
    places = size - LENGTH + 1
    begin = np.cumsum(places) - places
    low = np.repeat(owner, places)
    gram = table.column("place").to_numpy().astype(np.int64)  # where it begins in the context
    after = _reach(data, offsets[:-1], size, anchor, offsets[:-1] + gram, 1)
    before = _reach(data, offsets[:-1], size, anchor, offsets[:-1] + gram + GRAM - 1, -1) - GRAM
    # strings by where they begin
    first = np.maximum(0, gram - before)
    last = np.minimum(places - 1, gram + after - LENGTH)
    many = np.flatnonzero((before >= 0) & (first <= last))
    if len(many):
        first, size = first[many], (last - first)[many] + LENGTH
        ends = np.cumsum(size)
        at = np.repeat(offsets[:-1][many] + first - (ends - size), size) + np.arange(ends[-1])
        best, n = least_owner(data[at], ends, owner[many])
        low[np.repeat((begin[many] + first) - (np.cumsum(n) - n), n) + np.arange(len(best))] = best
    new = np.ones(len(low), dtype=bool)  # a run of places with one owner begins
    new[1:] = low[1:] != low[:-1]
    new[begin] = True
    edge = np.flatnonzero(new)
    row = np.searchsorted(begin, edge, side="right") - 1
    end = np.append(edge[1:], len(low))
    lists = {"anchor": anchor[row], "ck": ck[row], "lo": edge - begin[row], "hi": end - begin[row], "owner": low[edge]}
    return pa.table(lists)


def _shared(rows: DataFrame) -> DataFrame:
    """Anchors that more than one document id has."""
    return rows.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("anchor")


def _halves(rows: DataFrame) -> DataFrame:
    """Contexts whose strings hold the anchor at places ``first`` to ``last``, cut at the middle of that range.

    What all strings of a half have in common is longer than the anchor and becomes its new one.
    """
    middle = "(first + last) DIV 2"
    sides = F.explode(
        F.expr(
            f"array(struct(first AS lo, {middle} AS hi), struct({middle} + 1 AS lo, last AS hi))"
        )
    )
    cut = rows.withColumn("half", sides).withColumns(
        {
            "i": F.expr("greatest(0, place - half.hi)"),
            "j": F.expr(f"least(length(context) - {LENGTH}, place - half.lo)"),
        }
    )
    cut = cut.filter("i <= j")
    common = F.expr(f"substring(context, place - half.lo + 1, {LENGTH} - half.hi + half.lo)")
    return cut.select(
        "id",
        "h",
        F.xxhash64("anchor", "half.lo", common).alias("anchor"),
        (F.col("start") + F.col("i")).alias("start"),
        (F.col("place") - F.col("i")).alias("place"),
        F.expr(f"substring(context, i + 1, j - i + {LENGTH})").alias("context"),
        F.col("half.lo").alias("first"),
        F.col("half.hi").alias("last"),
    )


def _found_and_distinct(found: DataFrame):
    """Written contexts and their distinct ones, with hot anchors split until each has few contexts.

    Split contexts stay among the written ones, where nothing will match them.
    """
    parts, distinct, used = [found], [], []
    while True:
        d = found.groupBy("anchor", "context").agg(F.min("id").alias("owner"), F.min("place").alias("place"))
        d = written(d, "suffix-distinct")
        used.append(d)
        hot = d.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > SPLIT_ABOVE).select("anchor")
        hot = written(hot, "suffix-hot")
        used.append(hot)
        if hot.isEmpty():
            return parts, [*distinct, d], used
        distinct.append(d.join(hot, "anchor", "left_anti"))
        halves = written(_halves(found.join(hot, "anchor", "left_semi")), "suffix-halves")
        twice = written(_shared(halves), "suffix-twice")
        found = halves.join(twice, "anchor", "left_semi").withColumn("ck", F.xxhash64("context"))
        found = written(found, "suffix-contexts")
        dropped(halves, twice)
        parts.append(found)


def _all(parts: list[DataFrame], *columns: str) -> DataFrame:
    out = parts[0].select(*columns)
    for x in parts[1:]:
        out = out.unionByName(x.select(*columns))
    return out


def spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, h, spans): per document the runs of bytes that it must give up, as lo << 32 | hi; they may overlap."""
    slim = _slim(df, key, text).filter("id IS NOT NULL")
    seen = written(slim.select("id", "body").mapInArrow(_emit_anchors, "id long, anchor long"), "suffix-anchors")
    twice = written(_shared(seen), "suffix-twice")
    wanted = seen.join(twice, "anchor", "left_semi").groupBy("id").agg(F.collect_set("anchor").alias("anchors"))
    wanted = written(wanted, "suffix-wanted")
    dropped(seen, twice)
    found = slim.join(wanted, "id").select("id", "h", "body", "anchors")
    kinds = f"{_SLIM}, anchor long, start long, place int, context binary"
    found = found.mapInArrow(_emit_contexts, kinds)
    found = found.withColumns({"first": F.lit(0), "last": F.lit(PLACES - 1), "ck": F.xxhash64("context")})
    found = written(found, "suffix-contexts")
    dropped(wanted)
    parts, distinct, used = _found_and_distinct(found)
    contexts = _all(distinct, "anchor", "context", "owner", "place")
    shards = max(1, -(-contexts.count() // SHARD_CONTEXTS))
    keyed = contexts.select("anchor", F.xxhash64("context").alias("ck"), "context", "owner", "place")
    low = keyed.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")).applyInArrow(
        _sort_shard, "anchor long, ck long, lo long, hi long, owner long"
    )
    low = written(low, "suffix-owners")
    dropped(*used)
    hit = _all(parts, "id", "h", "anchor", "ck", "start").join(low, ["anchor", "ck"]).filter("owner < id")
    run = F.expr(f"shiftleft(start + lo, 32) + start + hi + {LENGTH - 1}")
    hit = hit.select("id", "h", run.alias("run")).groupBy("id", "h").agg(F.collect_set("run").alias("spans"))
    hit = written(hit, "suffix-spans")
    dropped(*parts, low)
    return hit


def merged(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Maximal covered runs of the runs (lo, hi)."""
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    first = np.flatnonzero(np.concatenate(([True], lo[1:] > reach[:-1])))
    last = np.append(first[1:], len(lo)) - 1
    return list(zip(lo[first].tolist(), reach[last].tolist(), strict=True))


def cut(data: bytes, gone: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for lo, hi in gone:
        out.append(data[at:lo])
        at = hi
    out.append(data[at:])
    return b"".join(out)


def _gone(x) -> list[tuple[int, int]]:
    """Maximal runs of a row's spans; none where the row has none."""
    if not x.is_valid:
        return []
    both = x.values.to_numpy()
    return merged(both >> 32, both & 0xFFFFFFFF) if len(both) else []


def dedup(df: DataFrame, key="doc_id", text="text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) per row."""
    d = _slim(df, key, text).join(spans(df, key, text), ["id", "h"], "left").select("id", "body", "spans")

    def run(batches):
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                data, gone = batch.column(1)[i].as_py(), _gone(batch.column(2)[i])
                kept = hashlib.sha256(cut(data, gone)).hexdigest()
                rows.append((len(data), sum(hi - lo for lo, hi in gone), len(gone), kept))
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return d.mapInArrow(run, f"`{key}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup_documents(df: DataFrame, key="doc_id", text="text") -> DataFrame:
    """Every document with its own columns and the removed bytes gone from its text.

    A character that loses only some of its bytes is dropped whole.
    """
    names = df.columns
    s = spans(df, key, text).withColumnsRenamed({"id": "__s_id", "h": "__s_h", "spans": "__s_spans"})
    body = F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    d = df.join(s, (df[f"`{key}`"] == s["__s_id"]) & (body == s["__s_h"]), "left").drop("__s_id", "__s_h")
    at = names.index(text)

    def run(batches):
        for batch in batches:
            texts = []
            for i in range(batch.num_rows):
                value, gone = batch.column(at)[i].as_py(), _gone(batch.column(len(names))[i])
                if gone:
                    value = cut(value.encode("utf-8"), gone).decode("utf-8", "ignore")
                texts.append(value)
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return d.mapInArrow(run, df.schema)

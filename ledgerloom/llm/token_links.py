"""Where the tokens of two vocabularies meet: groups, links and how often a link occurs.

Both vocabularies cut the same bytes. Python tokenises, and gives each document's
ids in two orders: group by group, with marks between them, and for each byte where
any token ends those of both sides' tokens that hold it. The tokeniser has the ends as
numbers already, and there a merge of them costs little, while sorting inside of
lambdas' arguments, and texts made in lambdas, cost more than tokenising. Spark makes the
text of the groups and the links of these orders, the links by a higher-order function,
and counts. Nothing is compared pairwise; a text of n tokens takes n log n steps and
is held by one task.

How many documents hold a pair is one aggregation. To bring the counts back to
the links, pairs that are so frequent that there can only be FREQUENT of them are
broadcast, and only links of rarer pairs are shuffled; so no pair's links meet in
one task, however frequent it is. Where there are no more than FREQUENT pairs at
all, none is shuffled.

Defined results
    * null or empty text, or one whose tokens are not the bytes of a space and
      the text: no tokens, zeros, and an empty groups_sha256.
    * special strings inside texts are plain text.
    * rows of one id are documents of their own, each with a row.
    * extra columns are ignored.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocab
from .common import dropped, written
from .token_counts import LETTERS, SPLIT

#: Pairs that may be broadcast. A pair of more than 1 / FREQUENT of all (document, pair) rows is one of fewer than so many.
FREQUENT = 100_000
OUT_ROWS = 64


# ---- tokenising --------------------------------------------------------------


class ByteLevel:
    """A byte-level vocabulary of the tokenizers library, and the bytes of its entries.

    Where the ids of the merged entries rise with the order of the merges, merging
    by ids and by merges is the same, and tiktoken does it in a quarter of the
    time; this is checked when the file is read. It is left to do so for texts of
    characters whose classes the two libraries cannot see differently.
    """

    def __init__(self, data: bytes):
        import os
        import re

        import numpy as np
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the machine already
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(data.decode("utf-8"))
        self.library.encode_special_tokens = True
        model, back = json.loads(data)["model"], {c: b for b, c in enumerate(LETTERS)}
        self.entries = [b""] * (max(model["vocab"].values()) + 1)
        for token, i in model["vocab"].items():
            if all(c in back for c in token):
                self.entries[i] = bytes(back[c] for c in token)
        self.lengths = np.array([len(e) for e in self.entries], np.int32)
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        self.quick = None
        if all(x < y for x, y in zip(merged, merged[1:])):
            ranks = {e: i for i, e in enumerate(self.entries) if e}
            self.quick = tiktoken.Encoding("local", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.unusual = re.compile("[^\t-\r -~\u00a0-\u024f\u2010-\u2027\u20ac]")

    def encode(self, text: str):
        """(ids, whether their bytes are those of the text without a further look)."""
        if self.quick is None or self.unusual.search(text):
            return self.library.encode(text, add_special_tokens=False).ids, False
        return self.quick.encode_to_numpy(text, disallowed_special=()), True


class Pieces:
    """A sentencepiece vocabulary, and the bytes of its pieces."""

    def __init__(self, data: bytes):
        import numpy as np
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.entries = []
        for i in range(self.library.get_piece_size()):
            piece = self.library.id_to_piece(i)
            if self.library.is_byte(i):
                self.entries.append(bytes([int(piece[3:-1], 16)]))
            else:
                self.entries.append(piece.replace("▁", " ").encode("utf-8"))
        self.lengths = np.array([len(e) for e in self.entries], np.int32)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


COUNTS = ("n_a", "n_b", "n_groups")
ORDERS = ("runs", "a_links", "b_links")
TOKENS = [
    *(T.StructField(n, T.LongType(), False) for n in COUNTS),
    *(T.StructField(n, T.ArrayType(T.IntegerType(), False), False) for n in ORDERS),
]
#: In ``runs``: behind the ids of side a in a group, and between groups.
_OVER, _CUT = -1, -2


def tokenised(docs: DataFrame, a_path: str, b_path: str, key="doc_id", text="text") -> DataFrame:
    """(key, n_a, n_b, n_groups, runs, a_links, b_links) per row.

    Numbers of tokens and groups; ids group by group; and for each byte where any token ends the id of each side's token that holds it.
    """
    spark = docs.sparkSession
    a_file, b_file = vocab.shipped(spark, a_path), vocab.shipped(spark, b_path)
    slim = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    schema = T.StructType([slim.schema["key"], *TOKENS])

    def run(batches):
        import numpy as np

        a = vocab.parsed(a_file.value, "links-byte-level", ByteLevel)
        b = vocab.parsed(b_file.value, "links-pieces", Pieces)
        nothing = (0, 0, 0, *[np.array([], np.int32)] * 3)

        def sides(texts):
            for text, y in zip(texts, b.encode(texts), strict=True):
                raw = b" " + text.encode("utf-8")
                if not text or b"".join(map(b.entries.__getitem__, y)) != raw:
                    yield nothing
                    continue
                x, known = a.encode(" " + text)
                if not known and b"".join(map(a.entries.__getitem__, x)) != raw:
                    yield nothing
                    continue
                x, y = np.asarray(x, np.int32), np.array(y, np.int32)
                x_ends, y_ends = np.cumsum(a.lengths[x], dtype=np.int32), np.cumsum(b.lengths[y], dtype=np.int32)
                # an entry has a byte at least and both sides end where the text does
                x_next, y_next = np.searchsorted(y_ends, x_ends), np.searchsorted(x_ends, y_ends)
                x_met, y_met = y_ends[x_next] == x_ends, x_ends[y_next] == y_ends
                own = ~y_met
                order = np.argsort(np.concatenate([x_ends, y_ends[own]]), kind="stable")
                x_links = np.concatenate([x, x[y_next[own]]])[order]
                y_links = np.concatenate([y[x_next], y[own]])[order]
                # before a group stand the tokens of the groups before it and two marks for each
                x_low, y_low = (np.concatenate([[0], np.flatnonzero(m) + 1]) for m in (x_met, y_met))
                k = np.arange(len(x_low) - 1)
                x_group, y_group = np.repeat(k, np.diff(x_low)), np.repeat(k, np.diff(y_low))
                runs = np.full(len(x) + len(y) + 2 * len(k), _CUT, np.int32)
                runs[np.arange(len(x)) + y_low[x_group] + 2 * x_group] = x
                runs[np.arange(len(y)) + x_low[y_group + 1] + 2 * y_group + 1] = y
                runs[x_low[1:] + y_low[:-1] + 2 * k] = _OVER
                yield len(x), len(y), len(k), runs[:-1], x_links, y_links

        for batch in batches:
            for lo in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(lo, OUT_ROWS)
                columns = list(zip(*sides(part.column(1).to_pylist()), strict=True))
                arrays = [pa.array(c, pa.int64()) for c in columns[: len(COUNTS)]]
                for column in columns[len(COUNTS) :]:
                    offsets = np.cumsum([0, *map(len, column)], dtype=np.int32)
                    arrays.append(pa.ListArray.from_arrays(offsets, np.concatenate(column).astype(np.int32, copy=False)))
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["key", *(f.name for f in TOKENS)])

    return slim.mapInArrow(run, schema)


# ---- groups and links --------------------------------------------------------

def aligned(tokens: DataFrame) -> DataFrame:
    """``tokens`` with groups (their text form) and links (a id * 2**32 + b id) of each row in place of its ids."""
    joined = F.array_join(F.col("runs").cast("array<string>"), ",")
    groups = F.replace(F.replace(joined, F.lit(f",{_OVER},"), F.lit("|")), F.lit(f",{_CUT},"), F.lit(";"))
    links = F.zip_with("a_links", "b_links", lambda x, y: F.shiftleft(x.cast("long"), 32) + y)
    return tokens.select(*(c for c in tokens.columns if c not in ORDERS), groups.alias("groups"), links.alias("links"))


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold each pair, and whether that is the most of any pair of its a id."""
    n = links.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    n = written(n, "links-pairs")
    most = n.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    return n.join(most, F.shiftright("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(links: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(uid, n_best, count_sum) of each row of (uid, links) that has links."""
    counts = written(pair_counts(links), "links-counts")
    each = links.select("uid", F.explode("links").alias("pair"))
    sums = [F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("m")).alias("count_sum")]
    one = F.lit(1).cast("long").alias("m")
    seen = counts.agg(F.sum("n").alias("t"), F.count("*").alias("k")).first()
    if seen["k"] <= frequent:
        return each.join(F.broadcast(counts), "pair").select("*", one).groupBy("uid").agg(*sums)
    # the counts add up to t, so fewer than ``frequent`` pairs have more than t / frequent
    often = counts.filter(F.col("n") * frequent > seen["t"])
    known = each.join(F.broadcast(often), "pair").select("*", one).groupBy("uid").agg(*sums)
    rare = each.join(F.broadcast(often.select("pair")), "pair", "left_anti").groupBy("uid", "pair").agg(F.count("*").alias("m"))
    found = rare.join(counts.filter(F.col("n") * frequent <= seen["t"]), "pair").groupBy("uid").agg(*sums)
    both = known.unionByName(found).groupBy("uid")
    return both.agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, key="doc_id", text="text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row."""
    a_path = a_path or vocab.default_path("byte_bpe_50k.json")
    b_path = b_path or vocab.default_path("piece_bpe_32k.model")
    tokens = tokenised(docs, a_path, b_path, key, text).withColumn("uid", F.monotonically_increasing_id())
    made = aligned(tokens).withColumn("groups_sha256", F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise(F.lit("")))
    made = written(made.drop("groups"), "links-documents")
    sums = with_counts(made.select("uid", "links"))
    zero = F.lit(0).cast("long")
    return made.withColumn("n_links", F.size("links").cast("long")).join(sums, "uid", "left").select(
        F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )

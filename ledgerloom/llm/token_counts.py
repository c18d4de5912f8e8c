"""Token counts by the whole-token shortcut.

Offline, on the driver, every vocabulary string that can be a pre-token is put
through the merges alone; those that come out as one token are proved whole.
A text is then split into pre-tokens: whole ones count 1 without any merging,
and only the rest is merged, once per distinct string and worker (the memo is
emptied when it is full, which costs time and never changes a count).

Row-wise, no shuffle; a task holds one Arrow batch, the tables and the memo.

Defined results
    * null or empty text: 0 tokens, 0 bytes, not over the limit.
    * the special string of the vocabulary counts as one token wherever it
      stands, as the library counts it by default.
    * repeated rows and ids are counted row by row; extra columns are ignored.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab

#: fixed values: the split of byte-level BPE, white space named as the property the library uses
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
TOKEN_LIMIT = 1024
MEMO_ENTRIES = 400_000
LONG_PIECE = 200


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    of = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [of[b] for b in range(256)]


LETTERS = byte_letters()


def merged_count(symbols: list[str], ranks: dict) -> int:
    """Tokens left after the merges: the lowest-ranked pair first, leftmost first."""
    while len(symbols) > 1:
        best = min(range(len(symbols) - 1), key=lambda i: ranks.get((symbols[i], symbols[i + 1]), 1 << 60))
        pair = (symbols[best], symbols[best + 1])
        if pair not in ranks:
            break
        out, i = [], 0
        while i < len(symbols):
            if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
                out.append(pair[0] + pair[1])
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out
    return len(symbols)


def letters_of(text: str) -> str:
    return "".join([LETTERS[b] for b in text.encode("utf-8")])


class WholeTokens:
    """The proved table, the specials and the merger of one vocabulary file."""

    def __init__(self, data: bytes, whole: frozenset[str] | None = None):
        import regex
        from tokenizers import Tokenizer

        file = json.loads(data)
        self.specials = [x["content"] for x in file["added_tokens"]]
        self.split = regex.compile(SPLIT)
        self.cut = (
            regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))))
            if self.specials
            else None
        )
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in file["model"]["merges"]]
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.model = Tokenizer.from_str(data.decode("utf-8")).model
        self.whole = self.prove(file["model"]["vocab"]) if whole is None else whole
        self.memo = dict.fromkeys(self.whole, 1)

    def prove(self, strings) -> frozenset[str]:
        """Vocabulary strings that are one pre-token and merge to one token alone."""
        back = {c: b for b, c in enumerate(LETTERS)}
        out = set()
        for s in strings:
            try:
                text = bytes(back[c] for c in s).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue
            if self.split.fullmatch(text) and self.split.match(text).end() == len(text):
                if merged_count(list(s), self.ranks) == 1:
                    out.add(text)
        return frozenset(out)

    def piece(self, text: str) -> int:
        return len(self.model.tokenize(letters_of(text)))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.cut is None or self.cut.search(text) is None:
            return self._plain(text)
        parts = self.cut.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))

    def _plain(self, text: str) -> int:
        memo, n = self.memo, 0
        rest = []
        for p in self.split.findall(text):
            c = memo.get(p)
            if c is None:
                rest.append(p)
            else:
                n += c
        for p in rest:
            c = memo.get(p)
            if c is None:
                c = self.piece(p)
                if len(p) <= LONG_PIECE:
                    if len(memo) >= MEMO_ENTRIES:
                        self.memo = memo = dict.fromkeys(self.whole, 1)
                    memo[p] = c
            n += c
        return n


def count_tokens(
    df: DataFrame,
    path: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    limit: int = TOKEN_LIMIT,
) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) per row."""
    spark = df.sparkSession
    path = path or vocab.default_path("byte_bpe_50k.json")
    file = vocab.shipped(spark, path)
    # Bounded by the vocabulary, like the file itself.
    proved = spark.sparkContext.broadcast(vocab.parsed(file.value, "whole", WholeTokens).whole)
    slim = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("text"))
    kind = slim.schema[key].dataType.simpleString()

    def run(batches):
        table = vocab.parsed(file.value, "whole-worker", lambda x: WholeTokens(x, proved.value))
        for batch in batches:
            n = [table.count(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64())], names=[key, "n_tokens"]
            )

    # The byte count stays on the JVM side; a second column carries it through Python.
    slim = slim.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))

    def run_all(batches):
        for batch in batches:
            (out,) = run([batch])
            yield pa.RecordBatch.from_arrays(
                [out.column(0), batch.column(2), out.column(1)], names=[key, "n_bytes", "n_tokens"]
            )

    out = slim.mapInArrow(run_all, f"`{key}` {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)

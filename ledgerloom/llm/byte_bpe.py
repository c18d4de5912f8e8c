"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

``encode`` maps texts to token ids, ``decode`` maps ids to raw bytes. Long
texts are cut at safe boundaries before the library sees them: a single blank
between two printable ASCII characters. No match of the split pattern contains
a blank after a non-blank, and what follows the cut is matched from the cut on,
so the pieces encode to the same ids as the whole text.

Both are row-wise (no shuffle); a task holds one Arrow batch of texts.

Defined results
    * null or empty text: no ids; decoding gives empty bytes.
    * a long text without a safe boundary is encoded whole.
    * repeated rows and ids are encoded row by row; extra columns are ignored
      by ``encode`` and carried by ``encode_documents``.
    * strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocab

PIECE_CHARS = 100_000
OUT_ROWS = 1_000
_SAFE = re.compile(r"(?<=[!-~]) (?=[!-~])")


def _encoding(data: bytes, pattern: str):
    import tiktoken

    ranks = {
        base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)
    }
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, limit: int = PIECE_CHARS):
    """Cut a text into parts of about ``limit`` characters at safe boundaries."""
    start = 0
    while len(text) - start > limit:
        cut = _SAFE.search(text, start + limit)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def encode_text(enc, text: str | None, limit: int = PIECE_CHARS) -> list[int]:
    if not text:
        return []
    if len(text) <= limit:
        return enc.encode_ordinary(text)
    out: list[int] = []
    for part in pieces(text, limit):
        out += enc.encode_ordinary(part)
    return out


def encode_documents(
    df: DataFrame,
    path: str | None = None,
    text: str = "text",
    ids: str = "token_ids",
    pattern: str | None = None,
) -> DataFrame:
    """Every row of ``df`` with its columns and the ids of its text in column ``ids``.

    An existing column of that name is replaced.
    """
    rank_file = vocab.shipped(
        df.sparkSession, path or vocab.default_path("byte_bpe_multi_50k.tiktoken")
    )
    pat = pattern or vocab.default_pattern()
    df = df.drop(ids)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches):
        enc = vocab.parsed(rank_file.value, "tiktoken" + pat, lambda x: _encoding(x, pat))
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for lo in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(lo, OUT_ROWS)
                got = [encode_text(enc, x.as_py()) for x in part.column(at)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(got, pa.list_(pa.int32()))],
                    names=[*part.schema.names, ids],
                )

    return df.mapInArrow(run, schema)


def encode(
    df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, token_ids) per row."""
    slim = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("text"))
    return encode_documents(slim, path).drop("text")


def decode(df: DataFrame, path: str | None = None, ids: str = "token_ids") -> DataFrame:
    """``df`` with column ``decoded``: the bytes the ids stand for (null ids: empty)."""
    rank_file = vocab.shipped(
        df.sparkSession, path or vocab.default_path("byte_bpe_multi_50k.tiktoken")
    )
    pat = vocab.default_pattern()
    df = df.drop("decoded")
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches):
        enc = vocab.parsed(rank_file.value, "tiktoken" + pat, lambda x: _encoding(x, pat))
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            for lo in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(lo, OUT_ROWS)
                got = []
                for x in part.column(at):
                    x = x.values
                    got.append(enc.decode_bytes(x.to_numpy().tolist()) if x else b"")
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(got, pa.binary())],
                    names=[*part.schema.names, "decoded"],
                )

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, path: str | None = None) -> DataFrame:
    """Encode, decode, and reduce both to digests per document."""
    both = decode(encode(df, path), path)
    joined = F.regexp_replace(F.col("token_ids").cast("string"), r"[\[\] ]+", "")
    return both.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def encoded(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` with its ids, their number and the hash of the bytes they decode to."""
    both = decode(encode_documents(df, path), path)
    return both.withColumns(
        {
            "n_tokens": F.size("token_ids").cast("long"),
            "decoded_sha256": F.sha2("decoded", 256),
        }
    ).drop("decoded")

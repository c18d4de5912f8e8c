"""Token ids in binary files: fixed-size blocks of ids, shuffled into planes, with a chunk index.

A folder of token files has two tables, written by Spark's own writers, so that a
lost task is written again and never seen twice:

    chunks  part, no, at, n_ids, n_bytes, planes, docs, data
    index   part, no, first_id, n_ids, n_bytes, planes

Documents lie in ascending order of their key; a part is one range of it, and the
ids of a part are cut into blocks of BLOCK, of which only the last is shorter. A
chunk is one encoded block, with its place in its part and a directory of the
documents that reach into it (key, place, number of ids); the index has the place
of each chunk among all ids without the data. A block is transposed, so that all
ids' lowest bit (or byte) lie together, then the next; planes that no id needs
are left out, and each plane is one zstandard frame. Header of a block, little
endian: magic, kind, number of planes, ids, crc32 of the ids, then the length of
each plane.

One range shuffle moves the ids to their place; a task holds one block and one
document. Reading decodes each block where it lies, without a shuffle; only the
documents that reach into several blocks are put together by one.

Defined results
    * null or empty text: no ids but the end id.
    * documents without an id come last; rows of one id are ordered by their ids' hash, equal rows at random.
    * special strings inside texts are what the library takes them for.
    * a block whose ids do not have the crc of its header fails the read.
    * extra columns are ignored; an empty table gives files without chunks.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocab
from .common import dropped, shared_dir, written
from .token_counts import letters_of

BLOCK = 65_536
LEVEL = 3
END_ID = 1
BITS, BYTES = 0, 1
MAGIC = b"IDPL"
HEAD = struct.Struct("<4sBBII")
MEMO_ENTRIES = 600_000
LONG_PIECE = 200
#: UTF-8 of the letters from U+00C0 to U+00FF
LATIN = rb"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]"
OUT_ROWS = 1_000


# ---- one block ---------------------------------------------------------------


def encode_block(ids, kind: int = BYTES, level: int = LEVEL) -> bytes:
    """The ids (unsigned, below 2**32) as planes, lowest first."""
    import numpy as np
    import zstandard

    ids = np.ascontiguousarray(ids, dtype="<u4")
    top = int(ids.max()) if len(ids) else 0
    rows = ids.view(np.uint8).reshape(-1, 4)
    if kind == BYTES:
        planes = rows.T[: (top.bit_length() + 7) // 8]
    else:
        bits = np.unpackbits(rows[:, : (top.bit_length() + 7) // 8], axis=1, bitorder="little")
        planes = np.packbits(bits.T[: top.bit_length()], axis=1, bitorder="little")
    packer = zstandard.ZstdCompressor(level=level)
    frames = [packer.compress(np.ascontiguousarray(p).tobytes()) for p in planes]
    head = HEAD.pack(MAGIC, kind, len(frames), len(ids), zlib.crc32(ids.tobytes()))
    return head + struct.pack(f"<{len(frames)}I", *map(len, frames)) + b"".join(frames)


def decode_block(data: bytes):
    """The ids of a block as an array of unsigned 32-bit integers."""
    import numpy as np
    import zstandard

    magic, kind, n_planes, n, crc = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    lengths = struct.unpack_from(f"<{n_planes}I", data, HEAD.size)
    at = HEAD.size + 4 * n_planes
    opener, planes = zstandard.ZstdDecompressor(), []
    for length in lengths:
        planes.append(np.frombuffer(opener.decompress(data[at : at + length]), np.uint8))
        at += length
    rows = np.zeros((n, 4), np.uint8)
    if kind == BYTES:
        for i, p in enumerate(planes):
            rows[:, i] = p
    elif planes:
        bits = np.zeros((8 * ((n_planes + 7) // 8), n), np.uint8)
        bits[:n_planes] = np.unpackbits(np.stack(planes), axis=1, count=n, bitorder="little")
        rows[:, : (n_planes + 7) // 8] = np.packbits(bits.T, axis=1, bitorder="little")
    ids = rows.view("<u4").reshape(-1)
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("a block of token ids is damaged")
    return ids


# ---- texts to ids ------------------------------------------------------------


class WordIds:
    """Ids of texts from a vocabulary that drops white space, each distinct piece of them encoded once.

    No match of its split pattern holds white space, and no rule looks across
    it. So words of ASCII characters and Latin-1 letters, for which composing
    and lower case are plain, are split here and merged by the library's model;
    all other words, and texts that hold a special string, go to the library whole.
    """

    def __init__(self, data: bytes):
        import re

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(data.decode("utf-8"))
        self.model = self.library.model
        self.wide = self.library.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.specials = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        # the vocabulary's own split, case folded, after words that must go to the library
        self.split = re.compile(
            rb"(?<!\S)(?:[^\s\x80-\xff]|" + LATIN + rb")*+[\x80-\xff]\S*"
            rb"|(?i:'s|'t|'re|'ve|'m|'ll|'d)|(?:[A-Za-z]+|" + LATIN + rb")+|[0-9]|(?:[^\sA-Za-z0-9\x80-\xff]+)"
        )
        self.plain = re.compile(rb"(?:[\x00-\x7f]|" + LATIN + rb")*")
        self.memo = Memo(self._piece)

    def _bytes(self, ids: list[int]) -> bytes:
        return array("I" if self.wide else "H", ids).tobytes()

    def _piece(self, piece: bytes) -> bytes:
        if self.plain.fullmatch(piece):
            ids = [t.id for t in self.model.tokenize(letters_of(piece.decode("utf-8").lower()))]
        else:
            ids = self.library.encode(piece.decode("utf-8"), add_special_tokens=False).ids
        return self._bytes(ids)

    def encode(self, text: bytes) -> bytes:
        """Little-endian ids of a text, of two bytes where the vocabulary allows."""
        if any(s in text for s in self.specials):
            return self._bytes(self.library.encode(text.decode("utf-8"), add_special_tokens=False).ids)
        if len(self.memo) >= MEMO_ENTRIES:
            self.memo.clear()
        return b"".join(map(self.memo.__getitem__, self.split.findall(text)))


class Memo(dict):
    """Ids of pieces, found when first asked for; long pieces are not kept."""

    def __init__(self, find):
        self.find = find

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.find(piece)
        if len(piece) <= LONG_PIECE:
            self[piece] = ids
        return ids


def _encoded(docs: DataFrame, path: str, key: str, text: str) -> DataFrame:
    """(key, wide, ids, uid): ids as little-endian bytes; wide says that each has four."""
    file = vocab.shipped(docs.sparkSession, path)
    slim = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    kind = slim.schema["key"].dataType.simpleString()

    def run(batches):
        words = vocab.parsed(file.value, "word-ids", WordIds)
        for batch in batches:
            for lo in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(lo, OUT_ROWS)
                ids = [words.encode(x) for x in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([words.wide] * len(ids)), pa.array(ids, pa.binary())], names=["key", "wide", "ids"]
                )

    got = slim.mapInArrow(run, f"key {kind}, wide boolean, ids binary")
    return got.withColumn("uid", F.monotonically_increasing_id())


# ---- files -------------------------------------------------------------------

def _rows_schema(kind_of_key: str) -> str:
    docs = f"array<struct<key: {kind_of_key}, at: bigint, n: bigint>>"
    return f"part int, no long, at long, n_ids long, n_bytes long, planes int, docs {docs}, data binary"


def _packing(end_id, block: int, kind: int, level: int):
    def run(batches):
        import numpy as np

        part, no, at = TaskContext.get().partitionId(), 0, 0
        held, n_held, docs = [], 0, []  # ids not yet written, and the documents that reach into them
        end = np.array([] if end_id is None else [end_id], "<u4")

        def row(ids, inside):
            data = encode_block(ids, kind, level)
            kind_of = pa.struct([("key", key_type), ("at", pa.int64()), ("n", pa.int64())])
            known = [dict(zip(("key", "at", "n"), d, strict=True)) for d in inside]
            values = [part, no, no * block, len(ids), len(data), data[5], known, data]
            types = [pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.list_(kind_of), pa.binary()]
            names = ["part", "no", "at", "n_ids", "n_bytes", "planes", "docs", "data"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

        key_type = pa.null()
        for batch in batches:
            key_type = batch.column(0).type
            for key, wide, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = np.concatenate([np.frombuffer(raw.as_buffer(), "<u4" if wide else "<u2").astype("<u4"), end])
                docs.append((key, at, len(ids)))
                at += len(ids)
                held.append(ids)
                n_held += len(ids)
                if n_held < block:
                    continue
                both = np.concatenate(held)
                for lo in range(0, n_held - block + 1, block):
                    edge = (no + 1) * block
                    yield row(both[lo : lo + block], [d for d in docs if d[1] < edge])
                    docs = [d for d in docs if d[1] + d[2] > edge or d[1] >= edge]
                    no += 1
                n_held %= block
                held = [both[len(both) - n_held :].copy()]
        if docs:
            yield row(np.concatenate(held), docs)

    return run


def write_ids(
    docs: DataFrame, path: str, vocabulary: str | None = None, key="doc_id", text="text",
    end_id: int | None = END_ID, block: int = BLOCK, kind: int = BYTES, level: int = LEVEL,
) -> str:
    """Write the token files of ``docs`` to the folder ``path``, which must not exist; returns it."""
    spark = docs.sparkSession
    ids = written(_encoded(docs, vocabulary or vocab.default_path("word_bpe_49k.json"), key, text), "planes-ids")
    order = [F.col("key").asc_nulls_last(), F.xxhash64("ids"), F.col("uid")]
    placed = ids.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "wide", "ids")
    schema = _rows_schema(ids.schema["key"].dataType.simpleString())
    packed = placed.mapInArrow(_packing(end_id, block, kind, level), schema)
    packed.write.option("compression", "uncompressed").parquet(f"{path}/chunks")  # planes are compressed already
    dropped(ids)
    chunks = spark.read.schema(schema).parquet(f"{path}/chunks").select("part", "no", "at", "n_ids", "n_bytes", "planes")
    # one row for each task of the write, so few that the driver adds them up
    first, parts = 0, []
    for r in sorted(chunks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        parts.append((r["part"], first))
        first += r["n"]
    # bounded by the tasks of the write
    known = F.broadcast(spark.createDataFrame(parts, "part int, first_id long"))
    at = (F.col("first_id") + F.col("at")).alias("first_id")
    index = chunks.join(known, "part").select("part", "no", at, "n_ids", "n_bytes", "planes")
    index.write.parquet(f"{path}/index")
    return path


def read_ids(spark: SparkSession, path: str, key="doc_id") -> DataFrame:
    """(key, start, n_tokens, ids) of every document in the files: ids of all documents before it, how many
    ids it has, and they themselves as little-endian unsigned 32-bit integers."""
    chunks = spark.read.parquet(f"{path}/chunks").select("part", "at", "n_ids", "docs", "data")
    kind_of_key = chunks.schema["docs"].dataType.elementType["key"].dataType.simpleString()
    schema = f"part int, at long, n long, key {kind_of_key}, chunk_at long, ids binary"

    def pieces(whole: bool):
        inside = F.filter(
            "docs", lambda d: ((d["at"] >= F.col("at")) & (d["at"] + d["n"] <= F.col("at") + F.col("n_ids"))) == F.lit(whole)
        )
        return chunks.withColumn("docs", inside).filter(F.size("docs") > 0).mapInArrow(_unpacking, schema)

    one = pieces(True).select("part", "at", "n", "key", "ids")
    # a document of several chunks is put together in their order; it has ids, so its place is its own
    parts = pieces(False).groupBy("part", "at").agg(
        F.first("n").alias("n"), F.first("key").alias("key"), F.array_sort(F.collect_list(F.struct("chunk_at", "ids"))).alias("x")
    )
    joined = F.aggregate("x", F.lit(b""), lambda acc, y: F.concat(acc, y["ids"]))
    found = one.unionByName(parts.select("part", "at", "n", "key", joined.alias("ids")))
    # bounded by the tasks of the write: one row for each
    first = spark.read.parquet(f"{path}/index").filter("no = 0").select("part", "first_id")
    return found.join(F.broadcast(first), "part").select(
        F.col("key").alias(key), (F.col("first_id") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), "ids"
    )


def _unpacking(batches):
    for batch in batches:
        ats, _, docs, datas = batch.columns[1:]
        part = batch.column(0)
        for i in range(batch.num_rows):
            ids, at = decode_block(datas[i].as_buffer()), ats[i].as_py()
            known = docs[i].values
            starts, ns = known.field("at").to_pylist(), known.field("n").to_pylist()
            cut = [ids[max(a - at, 0) : max(a + n - at, 0)].tobytes() for a, n in zip(starts, ns, strict=True)]
            m = len(cut)
            for lo in range(0, m, OUT_ROWS):
                hi = min(lo + OUT_ROWS, m)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part[i].as_py()] * (hi - lo), pa.int32()), known.field("at")[lo:hi], known.field("n")[lo:hi],
                        known.field("key")[lo:hi], pa.array([at] * (hi - lo), pa.int64()), pa.array(cut[lo:hi], pa.binary()),
                    ],
                    names=["part", "at", "n", "key", "chunk_at", "ids"],
                )


def digests(docs: DataFrame, **options) -> DataFrame:
    """Write the token files, read them back, and reduce each document's ids to their crc32."""
    path = f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    back = read_ids(docs.sparkSession, write_ids(docs, path, **options))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

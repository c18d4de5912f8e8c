import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import bit_planes

TEXTS = [
    None, "", "  \n\t ", "Hello, World's BEST 123 words", "a<|endoftext|>b <|startoftext|> x", "ΣΊΣΥΦΟΣ ὈΔΥΣΣΕΎΣ\u0085next one\x1cfield",
    "é ́e Å ß İstanbul ŉ", "x" * 700 + " 12 " + "é" * 300, "don't we'll I'd 're", "漢字 かな 🙂🙂 ​zero", "　wide space",
]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def expected(rows):
    lib, start, out = library(), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_block_round_trip():
    rnd = random.Random(1)
    for kind in (bit_planes.BITS, bit_planes.BYTES):
        for ids in ([], [0], [0] * 9, [1] * 5, [2**32 - 1, 0, 7], [rnd.randrange(50_000) for _ in range(1001)], [256, 65535, 65536]):
            data = bit_planes.encode_block(np.array(ids, "<u4"), kind)
            assert bit_planes.decode_block(data).tolist() == ids
    planes = max(ids).bit_length()
    assert bit_planes.encode_block(np.array(ids, "<u4"), bit_planes.BITS)[5] == planes


def test_damaged_block_is_refused():
    data = bytearray(bit_planes.encode_block(np.arange(100)))
    data[10] ^= 1
    with pytest.raises(ValueError):
        bit_planes.decode_block(bytes(data))
    with pytest.raises(ValueError):
        bit_planes.decode_block(b"XXXX" + bytes(data[4:]))


def test_words_encode_as_the_library(spark):
    words = bit_planes.WordIds(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read())
    lib = library()
    rnd = random.Random(3)
    letters = "aAzZ09'sSéÉßÿ×÷µªḦIİ\u0307\u0331\u0308hHtTwWéŉǆΣς<|>,.#- \n\t\x1c\x85\xa0漢🙂\u200b"
    drawn = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(3000)]
    texts = TEXTS + drawn
    got = [words.encode((t or "").encode()) for t in texts * 2]
    want = [np.array(lib.encode(t or "", add_special_tokens=False).ids, "<u2").tobytes() for t in texts] * 2
    assert got == want


def test_files_against_brute_force(spark):
    rows = [(i * 7 % 31, t) for i, t in enumerate(TEXTS)] + [(100 + i, f"text {i} " * (i % 50)) for i in range(120)]
    rows += [(200, "long " * 3000), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"ids": F.lit("x"), "key": F.lit(1), "part": F.lit(2), "uid": F.lit(3), "start": F.lit(4)}
    )
    for block, kind in ((64, bit_planes.BITS), (1000, bit_planes.BYTES), (bit_planes.BLOCK, bit_planes.BITS)):
        got = bit_planes.digests(df.repartition(3), block=block, kind=kind).collect()
        assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == expected(rows), block


def test_files_have_fixed_blocks_and_an_index(spark, tmp_path):
    rows = [(i, "word " * i) for i in range(1, 60)]
    path = bit_planes.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "out"), block=100)
    index = spark.read.parquet(f"{path}/index").collect()
    by_part = {}
    for r in sorted(index):
        by_part.setdefault(r["part"], []).append(r)
    assert all(r["n_ids"] == 100 for rs in by_part.values() for r in rs[:-1])
    firsts = sorted((r["first_id"], r["n_ids"]) for r in index)
    assert all(a + n == b for (a, n), (b, _) in zip(firsts, firsts[1:]))
    chunk = spark.read.parquet(f"{path}/chunks").first()
    assert len(bit_planes.decode_block(chunk["data"])) == chunk["n_ids"] and chunk["n_bytes"] == len(chunk["data"])


def test_repeated_ids_empty_documents_and_empty_table(spark):
    df = spark.createDataFrame([(1, "b a"), (1, "b a"), (1, "c"), (2, ""), (3, None)], "doc_id long, text string")
    got = bit_planes.digests(df, end_id=None, block=2).collect()
    assert sorted(r["n_tokens"] for r in got) == [0, 0, 1, 2, 2]
    assert [r["start"] for r in got if r["doc_id"] in (2, 3)] == [5, 5]
    assert sorted(r["start"] for r in bit_planes.digests(df, block=2).collect())[-2:] == [8, 9]
    assert bit_planes.digests(df.limit(0)).count() == 0


def test_all_of_a_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = bit_planes.digests(df, block=1024).collect()
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == expected(rows)

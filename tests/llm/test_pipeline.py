import random

import public_tokenizers
import pytest

import corpus_pipeline
from ledgerloom.llm import byte_bpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fixture():
    rnd = random.Random(3)
    words = "the of and to in that is was for with river stone market house letter winter garden quiet morning people".split()
    text = lambda n: ". ".join(" ".join(rnd.choice(words) + rnd.choice(["", "s", "ed"]) for _ in range(9)).capitalize() for _ in range(n)) + "."
    passage = text(3)
    rows = [(i, text(12), "en", f"s{i % 3}", 1) for i in range(1, 13)]
    rows.append((20, rows[0][1], "en", "s0", 1))  # an exact copy
    rows.append((21, rows[1][1].replace("river", "lake", 1), "en", "s1", 1))  # a near copy
    rows += [(30 + i, text(6) + " " + passage + " " + text(6), "en", None, 1) for i in range(2)]  # a shared passage
    rows += [(40, "### $$$ %%%", "en", "s2", 1), (41, None, None, "s2", None), (42, "", "en", "s2", 0)]
    return rows, passage


def test_stages_take_effect(spark, tmp_path):
    rows, passage = fixture()
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
    ids = {name: [r["doc_id"] for r in got] for name, got in seen.items()}
    clean = {*range(1, 13), 20, 21, 30, 31}
    assert set(ids["quality_rules"]) == clean
    assert set(ids["ngram_jaccard_join"]) == clean - {20, 21}
    texts = {r.doc_id: r.text for r in seen["suffix_array_dedup"]}
    assert passage in texts[30] and passage not in texts[31]
    assert set(ids["mix_sources"]) <= clean - {20, 21}
    assert len(ids["byte_bpe"]) == len(ids["mix_sources"])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, whole.collect())) == sorted(map(str, seen["byte_bpe"]))


def test_an_empty_table_passes_through(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("filler", ["word ", "x", "é¿ ", "\n", " "])
def test_cut_texts_encode_as_whole_ones(filler):
    """Texts above the length of a piece, with and without safe places to cut."""
    enc = byte_bpe._encoding(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)
    text = ("Some words, 123 numbers; " + filler * 40) * 60
    limit = 500
    want = enc.encode_ordinary(text)
    assert byte_bpe.encode_text(enc, text, limit) == want
    long = text * (1 + byte_bpe.PIECE_CHARS // len(text))
    assert len(long) > byte_bpe.PIECE_CHARS
    assert byte_bpe.encode_text(enc, long) == enc.encode_ordinary(long)

import hashlib
import random

import numpy as np
import pytest

from ledgerloom.llm import suffix_dedup

SCHEMA = "doc_id long, text string, id string, anchor long, h int"


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row, by a table of all strings."""
    first = {}
    for key, text, *_ in rows:
        b = (text or "").encode()
        for i in range(len(b) - 49) if key is not None else ():
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], key), key)
    out = []
    for key, text, *_ in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49) if key is not None else ():
            if first[b[i : i + 50]] < key:
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((key, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=str)


def cases():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeä") for _ in range(rnd.randint(1, 8))) for _ in range(200)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passages = [text(14) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [text(rnd.randint(0, 25)), rnd.choice([*passages, ""]), text(rnd.randint(0, 9)), rnd.choice([*passages, ""])]
        rows.append((i, " ".join(parts)))
    copy = rows[7][1].split(" ")
    rows += [(100 + i, " ".join([*copy[:i], "new", *copy[i + 1 :]])) for i in range(12)]  # near copies
    rows += [rows[3], (3, rows[4][1]), (None, rows[5][1]), (200, None), (201, ""), (202, "ab " * 300), (203, "ab " * 200)]
    rows += [(300, "x" * 30_000 + passages[0]), (301, "\u0000" * 120 + passages[1]), (302, "\u0000" * 70)]
    return [(k, t, "other", 1, 2) for k, t in rows]


@pytest.mark.parametrize("split", [2_000, 2])
def test_equals_brute_force(spark, monkeypatch, split):
    """Nulls, repeated ids and rows, long runs of one byte and clashing columns; hot anchors split to the end with 2."""
    monkeypatch.setattr(suffix_dedup, "SPLIT_ABOVE", split)
    rows = cases()
    got = suffix_dedup.dedup(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert order(got) == order(brute(rows))


def test_a_phrase_of_all_texts_makes_no_large_shard(spark):
    """One phrase in different texts: its contexts are split, so that none is with many others."""
    rnd = random.Random(2)
    rows = [(i, "".join(rnd.choice("abcdefgh ") for _ in range(120)).join(["of the common phrase "] * 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    suffix_dedup.SPLIT_ABOVE, before = 20, suffix_dedup.SPLIT_ABOVE
    try:
        got = suffix_dedup.dedup(df).collect()
    finally:
        suffix_dedup.SPLIT_ABOVE = before
    assert order(got) == order(brute(rows))


def test_suffix_array_of_small_alphabets(monkeypatch):
    rnd = random.Random(1)
    for few, together in ((1, 1), (4, 7), (256, 1024)):
        monkeypatch.setattr(suffix_dedup, "_FEW", few)
        monkeypatch.setattr(suffix_dedup, "_TOGETHER", together)
        for _ in range(60):
            n, k = rnd.randint(1, 150), rnd.choice([1, 2, 3, 30])
            s = [rnd.randrange(k) for _ in range(n)]
            assert suffix_dedup.suffix_array(np.array(s)).tolist() == sorted(range(n), key=lambda i: s[i:])
    s = [0, 1, 0, 2] * 200
    assert suffix_dedup.suffix_array(np.array(s)).tolist() == sorted(range(800), key=lambda i: s[i:])


def test_documents_lose_the_bytes(spark):
    passage = "a passage that is certainly longer than fifty bytes, with é in it"
    rows = [(1, f"one {passage} end", "x"), (2, f"two {passage} fin", "y"), (2, f"two {passage} fin", "y"), (None, passage, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = order(suffix_dedup.dedup_documents(df).collect())
    assert suffix_dedup.dedup_documents(df).columns == df.columns
    assert got == order([rows[0], (2, "twofin", "y"), (2, "twofin", "y"), rows[3]])

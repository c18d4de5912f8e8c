import math
import random

import pytest

from ledgerloom.operators import embed


def shuffling():
    """An embedder that answers out of order and refuses requests above its limits; local, so that workers get it by value."""

    class Shuffling:
        def embed(self, texts):
            assert 0 < len(texts) <= 3 and (len(texts) == 1 or sum(map(len, texts)) <= 10)
            got = [(i, [len(t), sum(map(ord, t))]) for i, t in enumerate(texts)]
            random.shuffle(got)
            return got

    return Shuffling()


def test_batches_keep_order_and_limits():
    rng = random.Random(3)
    texts = ["x" * rng.choice([0, 1, 3, 9, 30]) for _ in range(200)]
    got = list(embed.batches(texts, 3, 10))
    assert [t for b in got for t in b] == texts
    assert all(len(b) <= 3 and (len(b) == 1 or sum(map(len, b)) <= 10) for b in got)
    assert list(embed.batches([])) == []


def test_vectors_are_restored_by_index(spark):
    texts = [None, "", "a", "bb", "c" * 50, "bb"] * 20
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "old") for i, t in rows], "id int, text string, vector string").repartition(3)
    got = {r["id"]: r["vector"] for r in embed.embedded(df, shuffling(), inputs=3, chars=10).collect()}
    assert got == {i: [len(t or ""), sum(map(ord, t or ""))] for i, t in rows}
    assert embed.embedded(df.filter("id < 0"), shuffling()).count() == 0


@pytest.mark.parametrize("answer", [[(0, [1.0])], [(0, [1.0]), (0, [2.0])], [(0, [1.0]), (2, [1.0])], [(0, [1.0]), (1, [1.0]), (1, [1.0])]])
def test_wrong_answers_are_refused(answer):
    class Wrong:
        def embed(self, texts):
            return answer

    with pytest.raises(ValueError, match="vectors for 2 texts"):
        embed.vectors_of(Wrong(), ["a", "b"])


def test_hashed_counts(spark):
    rows = [(1, "Tax tax credit"), (2, None), (3, ""), (None, "tax"), (4, "word " * 100_000), (5, "a"), (5, "b")]
    got = {r["k"]: r["vector"] for r in embed.hashed(spark.createDataFrame(rows, "k int, text string"), "k", "text", 4096).collect()}
    assert sorted(x for x in got[1] if x) == pytest.approx([1 / math.sqrt(5), 2 / math.sqrt(5)])
    assert not any(got[2]) and not any(got[3]) and sum(got[None]) == max(got[4]) == 1.0
    assert len([x for x in got[5] if x]) == 2 and len(got) == 6

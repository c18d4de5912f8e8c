import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from ledgerloom.llm import filter_audit

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    """Every document through every order, one filter after the other."""
    rows = []
    for i, text, source in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
        }
        good = any(k == i and q == 1 for k, q, _ in labels if i is not None)
        toxic = any(k == i and x == 1 for k, _, x in labels if i is not None)
        rows.append((source or "", fails, good, toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine, removed_by = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left, gone = mine, []
            for step, f in enumerate(order, 1):
                out_now, stay = [r for r in left if r[1][f]], [r for r in left if not r[1][f]]
                removed_by[f] += len(out_now)
                out[part, "".join(order), step] = [
                    len(stay), len(out_now), sum(r[1][f] for r in gone),
                    sum(r[1][f] and sum(r[1].values()) == 1 for r in mine), sum(r[2] for r in out_now), sum(r[3] for r in out_now),
                ]
                left, gone = stay, gone + out_now
        for key in out:
            if key[0] == part:
                out[key].append(removed_by[key[1][key[2] - 1]])
    return {k: tuple(v) for k, v in out.items()}


def found(spark, docs, labels, parts=3):
    d = spark.createDataFrame(docs, DOCS).repartition(parts)
    # columns of the caller's own, named as those in use here
    for name in ("id", "part", "digest", "failed", "good", "toxic", "n", "of", "first"):
        d = d.withColumn(name, F.lit("x"))
    rows = filter_audit.audit(d, spark.createDataFrame(labels, LABELS)).collect()
    assert len({(r["part"], r["filter_order"], r["step"]) for r in rows}) == len(rows)
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in rows}


def made(seed):
    rnd = random.Random(seed)
    long = [" ".join(rnd.choice(["lorem", "ipsum", "Dolor", "SIT", "amet#"][: rnd.randint(1, 5)]) + str(rnd.randrange(9**k)) for _ in range(210)) for k in (1, 2, 4, 6)]
    texts = [None, "", "one", "A B C", "x $ y", "Été \U0001f642   b", "w " * 300, *long, "a\x0bb\x0cc\r\nd " * 60]
    docs = [(rnd.choice([None, *range(40)]), rnd.choice(texts), rnd.choice([None, "", "web", "book"])) for _ in range(90)]
    docs += [(1000 + i, "hot copy " * 120, "web") for i in range(60)]
    labels = [(rnd.choice([None, *range(45)]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(50)]
    return docs, labels


def test_equals_brute_force(spark):
    for seed in (1, 2):
        docs, labels = made(seed)
        assert found(spark, docs, labels) == brute(docs, labels)


def test_repeated_least_id_and_rows_without_id(spark):
    docs = [(5, "a", "s"), (5, "a", "s"), (5, "a", None), (7, "a", "s"), (None, "a", "s"), (None, "b", "s"), (3, "b", "t"), (2, None, "t"), (4, "", "t")]
    got = found(spark, docs, [(7, 1, 0), (7, 0, 1), (None, 1, 1)])
    assert got == brute(docs, [(7, 1, 0), (7, 0, 1), (None, 1, 1)])


def test_lattice_and_steps(spark):
    counts = spark.createDataFrame([("p", 0, 0, 0, 3)], "part string, failed int, good int, toxic int, n long")
    got = filter_audit.edges(counts).collect()
    assert len(got) == 80 and all(r["kept"] == 3 and r["removed"] == 0 for r in got)
    assert all(not r["applied"] & r["filter"] for r in got)
    steps = filter_audit.steps(spark)
    assert steps.count() == 600 and steps.select("applied", "filter").distinct().count() == 80


def test_empty_tables(spark):
    assert found(spark, [], []) == {}
    docs = [(1, "a b", "s")]
    assert found(spark, docs, []) == brute(docs, [])

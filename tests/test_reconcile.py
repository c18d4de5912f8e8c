import random
from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.operators import findings, reconcile

SCHEMA = (
    "ord long, doc_type string, gstin string, number string, invoice_date date, taxable decimal(18,2), "
    "igst decimal(18,2), cgst decimal(18,2), sgst decimal(18,2), cess decimal(18,2), itc string, period string"
)
GSTINS = ("27AAPFU0939F1ZV", "27AAPFA0939F1ZF")


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def ratio(a, b):
    return 100.0 if a == b else 200.0 * lcs(a, b) / (len(a) + len(b))


def naive(books, other):
    """All pairs of a type, ranked, each document once."""
    ranked = []
    for b in books:
        for g in other:
            if b[1] != g[1]:
                continue
            strict, day, tax, total = b[3] == g[3], b[4] == g[4], b[5] == g[5], sum(b[6:10]) == sum(g[6:10])
            heads = b[6:10] == g[6:10]
            loose = [x[3].replace("/", "") for x in (b, g)]
            sim = ratio(*loose)
            num = strict or sim >= 88
            wrong = [num, day, tax, total, heads].count(False)
            if b[2] == g[2]:
                pri = 0 if wrong == 0 else None if not (num or day) else 1 if wrong == 1 else 2 if num and day else None
                close = sim + 100.0
            else:
                gsim = ratio(b[2], g[2])
                pri = 3 if gsim >= 85 and strict and day and tax and total and heads else None
                close = sim + gsim
            if pri is not None:
                ranked.append((pri, wrong - 5, -close, b[0], g[0]))
    used_b, used_g, out = set(), set(), set()
    for *_, b, g in sorted(ranked):
        if b not in used_b and g not in used_g:
            used_b.add(b), used_g.add(g), out.add((b, g))
    return out


def docs(rnd, n, base):
    return [
        (
            base + i, rnd.choice(["invoice", "credit_note"]), rnd.choice(GSTINS), f"INV/{rnd.randint(1, 4):06d}",
            date(2024, 4, rnd.randint(1, 2)), Decimal(rnd.choice([100, 200])), Decimal(rnd.choice([18, 20])),
            Decimal(0), Decimal(0), Decimal(0), rnd.choice(["Y", "N", None]), "042024",
        )
        for i in range(n)
    ]


def test_matches_equal_the_naive_loop(spark):
    for seed in (1, 2):
        rnd = random.Random(seed)
        b, g = docs(rnd, 25, 0), docs(rnd, 25, 1000)
        got = reconcile.results(spark.createDataFrame(b, SCHEMA), spark.createDataFrame(g, SCHEMA))
        pairs = got.filter("b IS NOT NULL AND g IS NOT NULL").select(F.col("b.ord"), F.col("g.ord")).collect()
        assert {tuple(r) for r in pairs} == naive(b, g)
        assert got.filter("b IS NOT NULL").count() == 25
        assert got.filter("g IS NOT NULL").count() == 25


def test_bridge_closes(spark):
    rnd = random.Random(3)
    b, g = (spark.createDataFrame(docs(rnd, 20, k), SCHEMA) for k in (0, 1000))
    r, mb, mg = reconcile.reconcile_full(b, g)
    lines = findings.bridge(r, mb, mg).collect()
    t = findings.totals(b, g).first()
    assert len(lines) == 5
    assert t.books + sum(x.amount for x in lines) == t.available


def test_pairs_that_agree_in_all_are_not_scored_again(spark, monkeypatch):
    rnd = random.Random(5)
    b = [(i, "invoice", GSTINS[i % 2], f"INV/{i:06d}", *docs(rnd, 1, 0)[0][4:]) for i in range(40)]
    b += [(40, "invoice", " " + GSTINS[0].lower(), " inv/000000", *b[0][4:])]  # a copy, by its normal form
    g = [(1000 + r[0], *r[1:]) for r in b[:40]]
    g[7] = (*g[7][:5], g[7][5] + 10, *g[7][6:])
    written, whole = {}, reconcile.durable

    def kept(df, label):
        out = whole(df, label)
        written.setdefault(label, []).append(out)
        return out

    monkeypatch.setattr(reconcile, "durable", kept)
    for tol in (0, 5):
        written.clear()
        books, other = spark.createDataFrame(b, SCHEMA), spark.createDataFrame(g, SCHEMA)
        r, mb, mg = reconcile.reconcile_full(books, other, tol)
        got = {(x.b.ord, x.g.ord): x for x in r.collect()}
        assert set(got) == {(i, 1000 + i) for i in range(40)}
        assert [x.ord for x in mb.collect()] == [40] and mg.count() == 0
        assert written["candidates"][0].filter("b.ord <> 7").isEmpty()
        assert got[7, 1007].category == "PARTIAL" and got[8, 1008].category == "EXACT"
        # what a pair says of its documents is whole, though it was stored once
        keyed = {s: {x.ord: x for x in reconcile.keyed(d).collect()} for s, d in (("b", books), ("g", other))}
        for (i, j), x in got.items():
            assert x.b.asDict() == keyed["b"][i].asDict() and x.g.asDict() == keyed["g"][j].asDict()


def test_what_is_not_wanted_of_a_document_is_not_kept(spark, monkeypatch):
    rnd = random.Random(6)
    b = [(i, "invoice", GSTINS[i % 2], f"INV/{i:06d}", *docs(rnd, 1, 0)[0][4:]) for i in range(12)]
    b.append((40, *b[0][1:]))
    g = [(1000 + r[0], *r[1:]) for r in b[:10]]
    g[3] = (*g[3][:5], g[3][5] + 10, *g[3][6:])
    g.append((2000, "invoice", GSTINS[0], "X9", *b[0][4:]))
    books, other = spark.createDataFrame(b, SCHEMA), spark.createDataFrame(g, SCHEMA)
    written, whole = {}, reconcile.durable

    def kept(df, label):
        written[label] = whole(df, label)
        return written[label]

    monkeypatch.setattr(reconcile, "durable", kept)
    all_of_it = reconcile.reconcile_full(books, other)
    for keep in (("ord",), ("ord", "doc_type"), ("ord", "number", *reconcile.HEADS)):
        got = reconcile.reconcile_full(books, other, keep=keep)
        for r, full in zip(got[1:], all_of_it[1:], strict=True):
            assert r.columns == [c for c in full.columns if c in keep]
            assert sorted(r.collect()) == sorted(full.select(*r.columns).collect())
        shown = got[0].schema["b"].dataType.names
        assert set(keep) <= set(shown) and "gstin_norm" not in shown and ("strict" in shown) == ("number" in keep)
        ends = [F.when(F.col(s).isNotNull(), F.struct(*(f"{s}.{c}" for c in shown))).alias(s) for s in ("b", "g")]
        same = [r.select(*ends, "category", "mismatches") for r in (got[0], all_of_it[0])]
        assert same[0].exceptAll(same[1]).isEmpty() and same[1].exceptAll(same[0]).isEmpty()
        gone = written["met"].filter("exact OR b_copy > 1").select("b.gstin", "b.taxable", "g.taxable").distinct().collect()
        assert [tuple(x) for x in gone] == [(None, None, None)]


def test_invalid_numbers_are_found_where_documents_lie(spark):
    rnd = random.Random(7)
    b = [*docs(rnd, 8, 0), (90, "invoice", "27AAPFU0939F1ZX", *docs(rnd, 1, 0)[0][3:]), (91, "credit_note", None, *docs(rnd, 1, 0)[0][3:])]
    b, g = spark.createDataFrame(b, SCHEMA), spark.createDataFrame(docs(rnd, 8, 1000), SCHEMA)
    r, mb, mg = reconcile.reconcile_full(b, g)
    alone = findings.register(r.limit(0), mb.limit(0), mg.limit(0), b, g).filter("code = 'EX-06'")
    got = {(x.b_ord, x.g_ord, x.itc_at_risk) for x in alone.collect()}
    total = {x.ord: sum(x[h] for h in reconcile.HEADS) for x in b.filter("ord = 90").collect()}[90]
    assert got == {(90, None, total), (91, None, 0)}
    plan = alone._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" not in plan


def test_findings_that_show_their_documents_need_no_join_to_be_described(spark):
    rnd = random.Random(8)
    rows = [*docs(rnd, 14, 0), (90, "invoice", "27AAPFU0939F1ZX", *docs(rnd, 1, 0)[0][3:])]
    b = spark.createDataFrame(rows, SCHEMA).withColumn("row_ref", F.concat(F.lit("book.csv:"), "ord"))
    g = spark.createDataFrame(docs(rnd, 14, 1000), SCHEMA)
    full = reconcile.reconcile_full(b, g)
    joined = findings.described(findings.register(*full, b, g), b, g)
    shown = findings.described(findings.register(*full, b, g, shown=True), b, g).select(*joined.columns)
    assert joined.count() > 14
    assert sorted(map(repr, joined.collect())) == sorted(map(repr, shown.collect()))
    none = [d.limit(0) for d in full]
    alone = findings.described(findings.register(*none, b, g, shown=True), b, g)
    assert "Join" not in alone._jdf.queryExecution().optimizedPlan().toString()


def test_documents_that_lie_by_their_number_are_not_shuffled_to_meet(spark, monkeypatch):
    rnd = random.Random(9)
    b, g = docs(rnd, 30, 0), docs(rnd, 30, 1000)
    b += [(40, "invoice", None, *b[0][3:]), (41, "invoice", None, *b[0][3:])]
    g += [(1040, "invoice", None, *b[0][3:]), (1041, *b[3][1:]), (900, *b[3][1:])]
    books, other = spark.createDataFrame(b, SCHEMA), spark.createDataFrame(g, SCHEMA)
    both = reconcile.together(books, other).withColumn("digits", F.substring("number", 5, 6)).repartition("digits")
    plans, whole = {}, reconcile.durable

    def kept(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return whole(df, label)

    monkeypatch.setattr(reconcile, "durable", kept)
    for tol in (0, 5):
        full = reconcile.reconcile_full(books, other, tol)
        assert plans["met"].count("Exchange hashpartitioning") == 1  # both sides in one
        got = reconcile.reconcile_together(both, tol, within="digits", least=True)
        assert plans["met"].count("Exchange hashpartitioning(digits") == 1 and plans["met"].count("Exchange hashpartitioning") == 1
        for x, y in zip(got[:3], full, strict=True):
            assert sorted(map(repr, x.select(*y.columns).collect())) == sorted(map(repr, y.collect()))
        for x, y in zip(got[3:], (books, other), strict=True):
            assert sorted(map(repr, x.collect())) == sorted(map(repr, y.collect()))
        same = {n: [r for r in rows if r[1:4] == b[3][1:4]] for n, rows in (("b", b), ("g", g))}
        least = {n: {r.least_ord for r in d.collect() if r.number == b[3][3] and r.gstin == b[3][2] and r.doc_type == b[3][1]} for n, d in zip("bg", got[1:3])}
        assert least["g"] == {min(r[0] for r in same["g"])} == {900}

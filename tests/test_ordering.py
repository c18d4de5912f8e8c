import random
from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.operators import evaluate, findings, ordering, reconcile

GSTINS = ("27AAPFU0939F1ZV", "27AAPFA0939F1ZF")
SCHEMA = (
    "ord long, doc_type string, gstin string, number string, invoice_date date, taxable decimal(18,2), "
    "igst decimal(18,2), cgst decimal(18,2), sgst decimal(18,2), cess decimal(18,2), itc string, period string"
)


def test_places_with_nulls_ties_and_other_columns(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2, 2, 2]), i, "x") for i in range(400)]
    df = spark.createDataFrame(rows, "k int, id int, ordinal string").repartition(5)
    for parts in (1, 3, 50):
        got = ordering.with_ordinal(df, F.col("k"), F.col("id"), partitions=parts).orderBy("ordinal").collect()
        assert [r["ordinal"] for r in got] == list(range(400))
        assert [(r["k"], r["id"]) for r in got] == sorted(((k, i) for k, i, _ in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    # equal rows stand next to each other
    tied = ordering.with_ordinal(df, F.col("k")).collect()
    assert sorted(r["ordinal"] for r in tied) == list(range(400))
    assert ordering.with_ordinal(df.filter("id < 0"), F.col("k")).count() == 0


def _doc(ord_, kind, number, day=1, tax=18, gstin=GSTINS[0]):
    return (ord_, kind, gstin, number, date(2024, 4, day), Decimal(100), Decimal(tax), *(Decimal(0),) * 3, "Y", "042024")


def test_results_and_findings_in_order(spark):
    books = [
        _doc(1, "invoice", "A/1"), _doc(2, "invoice", "LONELY-XYZ", 9), _doc(3, "credit_note", "C/77"),
        _doc(4, "invoice", "A/1"), _doc(5, "invoice", "B/2", tax=20), _doc(6, "invoice", "Q-1", 20, gstin="BAD"),
    ]
    other = [_doc(1, "invoice", "B/2"), _doc(2, "invoice", "A/1"), _doc(3, "invoice", "ELSEWHERE", 25, tax=3)]
    b, g = (spark.createDataFrame(x, SCHEMA) for x in (books, other))
    r, mb, mg = reconcile.reconcile_full(b, g, ranked=True)
    placed = ordering.ordered_results(r, partitions=3)
    got = [(x["b"] and x["b"]["ord"], x["g"] and x["g"]["ord"]) for x in placed.orderBy("ordinal").collect()]
    # credit notes come first; then what matches exactly, what does so with a difference, the orphans of each side
    assert got == [(3, None), (1, 2), (5, 1), (2, None), (6, None), (None, 3)]
    register = findings.register(placed, mb, mg, b, g)
    listed = ordering.ordered_findings(register, placed, b, g, partitions=3).orderBy("ordinal").collect()
    assert [(x["ordinal"], x["b_ord"], x["g_ord"], x["code"]) for x in listed] == [
        (0, 3, None, "EX-12"), (1, 5, 1, "EX-04"), (2, 2, None, "EX-01"), (3, 6, None, "EX-01"), (4, None, 3, "EX-02"),
        (5, 4, None, "EX-10"), (6, 6, None, "EX-06"),
    ]


def test_first_unrecovered(spark):
    rows = [(i, None if i % 2 else "00001", f"e{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "ordinal long, case_id string, evidence string").repartition(4)
    assert [r["ordinal"] for r in evaluate.unrecovered(df).collect()] == list(range(1, 21, 2))
    assert evaluate.unrecovered(df.filter("case_id IS NOT NULL")).count() == 0


def test_findings_with_a_place_need_neither_results_nor_all_documents(spark):
    books = [_doc(i, "invoice" if i % 3 else "credit_note", f"N/{i % 7}", 1 + i % 4, 18 + i % 2) for i in range(30)] + [_doc(40, "invoice", "Q-1", 20, gstin="BAD")]
    other = [_doc(i, "invoice" if i % 4 else "credit_note", f"N/{i % 9}", 1 + i % 5, 18 + i % 3) for i in range(30)]
    b, g = (spark.createDataFrame(x, SCHEMA) for x in (books, other))
    r, mb, mg = reconcile.reconcile_full(b, g, ranked=True)
    placed = ordering.ordered_results(r, partitions=3)
    whole = ordering.ordered_findings(findings.register(placed, mb, mg, b, g), placed, b, g, partitions=3)
    full = reconcile.reconcile_together(reconcile.together(b, g), ranked=True, least=True)
    found = findings.register(ordering.with_place(full[0]), *full[1:])
    lean = ordering.placed_findings(found, partitions=3)
    said = [sorted((x["ordinal"], x["b_ord"] or -1, x["g_ord"] or -1, x["code"]) for x in d.collect()) for d in (whole, lean)]
    assert said[0] == said[1] and len(said[0]) > 30
    assert lean._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # that with the counts

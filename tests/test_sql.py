import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import sql, text

RAW = [
    (1, " 27aapfu0939f1zv\t", "12-Mar-68", "(₹ 1,200.505)"),
    (2, "27AAPFU0939F1ZX", "1/4/24", " "),
    (3, "", "2024-02-30", "12a"),
    (4, None, None, None),
    (5, "INV/00-9 ", "31/12/70", "0.125"),
    (6, "x" * 3000, "2024-12-31", "9" * 20),
]


def test_scalars_equal_columns_without_python(spark):
    sql.register(spark)
    sql.register(spark)
    df = spark.createDataFrame(RAW, "id int, g string, d string, a string")
    by_sql = spark.sql(
        """SELECT id, norm_text(g) n, gstin_is_valid(g) v, invoice_loose_key(g) l, ledger_date(d) d, ledger_amount(a) a,
        gstin_similarity(g, d) s, expected_period(ledger_date(d)) p FROM {raw}""",
        raw=df,
    )
    g, d = F.col("g"), text.parse_date(F.col("d"))
    by_column = df.select(
        "id", text.norm(g).alias("n"), text.is_valid_gstin(g).alias("v"), text.loose_key(g).alias("l"), d.alias("day"),
        text.parse_amount(F.col("a")).alias("amount"), text.indel_ratio(text.norm(g), text.norm(F.col("d"))).alias("s"),
        F.date_format(d, "MMyyyy").alias("p"),
    )
    got = {r["id"]: tuple(r) for r in by_sql.collect()}
    assert got == {r["id"]: tuple(r) for r in by_column.collect()}
    assert got[1][2] is True and got[2][2] is False and got[4][2] is False
    plan = by_sql._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_headers_by_table_function(spark):
    sql.register(spark)
    one = "Contents\n 7. Levy. - (1) tax.\n[Rule 12A. Credit of tax. — x\n5. lower. - no\n"
    rows = [(1, one), (2, None), (3, ""), (4, "1. Alpha. -\n  2. Beta. - b\n3. Gamma. - c"), (5, "9. Z. - y" + " z" * 200_000)]
    df = spark.createDataFrame(rows, "id int, body string")
    got = spark.sql("SELECT t.id, h.* FROM {t} t, LATERAL provision_headers(t.body) h", t=df).collect()
    by = {i: [(r.position, r.section_number, r.section_title) for r in sorted(got) if r.id == i] for i in range(1, 6)}
    assert by[1] == [(0, "7", "Levy"), (1, "12A", "Credit of tax")]
    assert by[2] == by[3] == [] and by[5] == [(0, "9", "Z")]
    # what a header takes up holds no other
    assert [x[1] for x in by[4]] == ["1", "3"]
    assert all(dict(rows)[r.id][r.body_start :].strip() for r in got)


def test_headers_refuse_what_is_no_text(spark):
    sql.register(spark)
    with pytest.raises(Exception, match="takes a text, not int"):
        spark.sql("SELECT * FROM provision_headers(CAST(1 AS INT))").collect()


def test_headers_show_how_their_provisions_open(spark):
    sql.register(spark)
    rows = [(1, "7. Levy. - ₹ tax.\n8. Credit. - " + "x" * 200)]
    df = spark.createDataFrame(rows, "id int, body string")
    got = spark.sql("SELECT h.* FROM {t} t, LATERAL provision_headers(t.body) h", t=df).collect()
    assert len(got) == 2
    assert all(r.opening == rows[0][1][r.body_start : r.body_start + sql.OPENING] for r in got)


def test_formats_are_tried_only_where_they_can_fit(spark):
    shown = {"d-M-yyyy": "1-4-2024", "d/M/yyyy": "1/4/2024", "yyyy-M-d": "2024-4-1", "d-MMM-yyyy": "1-Apr-2024", "d-MMM-yy": "1-Apr-24", "d/M/yy": "1/4/24"}
    df = spark.createDataFrame([(f, x) for f, x in shown.items()], "f string, x string")
    fits = df.select("f", *(F.col("x").rlike(shape).alias(f) for f, shape in text.DATE_FORMATS.items())).collect()
    assert {r["f"]: [f for f in shown if r[f]] for r in fits} == {f: [f] for f in shown}
    assert all(r[0].isoformat() == "2024-04-01" for r in df.select(text.parse_date(F.col("x"))).collect())


def test_check_digits_of_any_text_are_as_with_lambdas(spark):
    a = text.ALPHABET
    rnd = random.Random(1)
    made = ["".join(rnd.choice(a + extra) for _ in range(rnd.choice((15, 15, 14, 9)))) for extra in ("", "az -é") for _ in range(60)]
    df = spark.createDataFrame([(x,) for x in [*made, "", None, "27AAPFU0939F1ZV"]], "x string")
    total = (
        f"aggregate(transform(sequence(1, 14), i -> (instr('{a}', substr(x, i, 1)) - 1) * (CASE WHEN i % 2 = 1 THEN 1 ELSE 2 END)), 0, "
        "(s, p) -> s + CAST(floor(p / 36) AS INT) + p % 36)"
    )
    want = F.expr(f"substr('{a}', 1 + pmod(36 - pmod({total}, 36), 36), 1)")
    got = df.select("x", want.alias("w"), text.check_digit(F.col("x")).alias("c"), F.expr(text.check_digit_sql("x")).alias("s")).collect()
    assert all(r.w == r.c == r.s for r in got) and sum(r.w is not None for r in got) == 122
    assert "27AAPFU0939F1ZV" not in {r.x for r in df.filter(~text.is_valid_gstin(F.col("x"))).collect()}
    # letters and digits, as all but a few texts are, are looked up without a lambda
    assert text.check_digit_sql("x").count("instr(") == 15

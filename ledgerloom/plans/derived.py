"""Both sides of a reconciliation derived from the order tables, with one injected defect class each.

The class of a document is (31 * orderkey + 7 * suppkey) % 24: 1 to 12 name the
exception it should raise, 13 an invalid registration number, everything else is clean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import check_digit_sql

TABLES = ("lineitem", "orders", "customer", "supplier")

BASE = """
SELECT l_orderkey * 100000 + l_suppkey AS stem, l_orderkey AS okey, l_suppkey AS skey, l_returnflag AS flag,
       (31 * l_orderkey + 7 * l_suppkey) % 24 AS defect,
       CAST(min(l_shipdate) AS DATE) AS invoice_date,
       CAST(sum(round(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2)) AS DECIMAL(18,2)) AS taxable,
       CAST(sum(round(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) * CAST(l_tax AS DECIMAL(4,2)), 2)) AS DECIMAL(18,2)) AS tax
FROM lineitem GROUP BY l_orderkey, l_suppkey, l_returnflag
"""

SHAPED = """
SELECT (stem * 8 + CASE flag WHEN 'A' THEN 0 WHEN 'N' THEN 2 ELSE 4 END) AS ord, okey, defect, invoice_date, taxable,
       CASE flag WHEN 'N' THEN 'invoice' WHEN 'R' THEN 'credit_note' ELSE 'debit_note' END AS doc_type,
       CASE WHEN defect = 13 THEN bad ELSE good END AS own, near,
       CASE WHEN w_nation = c_nationkey THEN CAST(0 AS DECIMAL(18,2)) ELSE tax END AS igst,
       CASE WHEN w_nation = c_nationkey THEN CAST(round(tax * CAST(0.5 AS DECIMAL(2,1)), 2) AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END AS cgst,
       CASE WHEN w_nation = c_nationkey THEN CAST(tax - round(tax * CAST(0.5 AS DECIMAL(2,1)), 2) AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END AS sgst,
       CAST(0 AS DECIMAL(18,2)) AS cess
FROM base JOIN orders ON o_orderkey = okey JOIN customer ON c_custkey = o_custkey JOIN who ON w_key = skey
"""


def suppliers(check) -> str:
    """SQL of the registration numbers of each supplier: good, one letter off, and with a wrong check digit."""
    alphabet = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ0"

    def body(letters: str) -> str:
        return f"(lpad(CAST(s_nationkey + 1 AS STRING), 2, '0') || '{letters}' || lpad(CAST(s_suppkey AS STRING), 4, '0') || 'A1Z')"

    good, near = body("AAAPA"), body("AABPA")
    wrong = f"substr('{alphabet}', CAST(1 + instr('{alphabet}', {check(good)}) AS INT), 1)"
    return (
        f"SELECT s_suppkey AS w_key, s_nationkey AS w_nation, {good} || {check(good)} AS good, "
        f"{near} || {check(near)} AS near, {good} || {wrong} AS bad FROM supplier"
    )


def sides() -> dict[str, str]:
    """SQL of both sides, in words that both dialects know."""
    number = "'INV/' || lpad(CAST(okey AS STRING), 6, '0')"
    heads = "taxable, igst, cgst, sgst, cess"
    none = "CAST(NULL AS STRING)"
    keep = "defect NOT IN (2, 11)"
    books = (
        f"SELECT ord, doc_type, own AS gstin, {number} AS number, invoice_date, {heads}, "
        f"{none} AS itc, {none} AS period, defect FROM shaped WHERE {keep}"
    )
    books += " UNION ALL " + books.replace("SELECT ord,", "SELECT ord + 1 AS ord,", 1).replace(keep, "defect = 10")
    period = "lpad(CAST(month({0}) AS STRING), 2, '0') || CAST(year({0}) AS STRING)"
    late = period.format("invoice_date").replace("month(invoice_date)", "(month(invoice_date) % 12 + 1)")
    statement = (
        "SELECT ord, doc_type, CASE WHEN defect = 6 THEN near ELSE own END AS gstin, "
        f"CASE WHEN defect = 7 THEN 'BILL/' || CAST(okey AS STRING) ELSE {number} END AS number, invoice_date, "
        "CASE WHEN defect = 3 THEN CAST(taxable + 10 AS DECIMAL(18,2)) ELSE taxable END AS taxable, "
        "CASE WHEN defect = 4 THEN CAST(igst + 5 AS DECIMAL(18,2)) ELSE igst END AS igst, "
        "CASE WHEN defect = 5 THEN CAST(cgst + 1 AS DECIMAL(18,2)) ELSE cgst END AS cgst, "
        "CASE WHEN defect = 5 THEN CAST(sgst - 1 AS DECIMAL(18,2)) ELSE sgst END AS sgst, cess, "
        f"CASE WHEN defect = 9 THEN 'N' ELSE 'Y' END AS itc, CASE WHEN defect = 8 THEN {late} ELSE {period.format('invoice_date')} END AS period, "
        "defect FROM shaped WHERE defect NOT IN (1, 12)"
    )
    return {"books": books, "statement": statement}


#: The digits that all numbers made of an order key share: documents of one number have one of it.
DIGITS = "CAST(lpad(CAST({0} AS STRING), 6, '0') AS BIGINT)"


def shaped(spark: SparkSession, sf_dir: str, digits: bool = False) -> DataFrame:
    """What both sides are made of, over the tables of ``sf_dir``; with ``digits``, which they are partitioned by then."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    # one shuffle of the lines serves the sums and the join with the orders, which know their customer's nation by then
    lines = frames["lineitem"].select("l_orderkey", "l_suppkey", "l_returnflag", "l_shipdate", "l_extendedprice", "l_discount", "l_tax")
    sums = BASE.replace("FROM lineitem", "FROM {lineitem}")
    if digits:
        lines = lines.withColumn("digits", F.expr(DIGITS.format("l_orderkey"))).repartition("digits")
        sums = sums.replace("SELECT", "SELECT digits,", 1).replace("GROUP BY", "GROUP BY digits,")
    else:
        lines = lines.repartition("l_orderkey")
    base = spark.sql(sums, lineitem=lines)
    who = spark.sql(suppliers(check_digit_sql).replace("FROM supplier", "FROM {supplier}"), supplier=frames["supplier"])
    orders = frames["orders"].join(frames["customer"], F.expr("c_custkey = o_custkey")).select("o_orderkey", "c_nationkey")
    # what follows from the keys is worked out after the suppliers are joined, which may shuffle all rows
    met = F.expr("o_orderkey = okey")
    if digits:
        orders = orders.withColumn("o_digits", F.expr(DIGITS.format("o_orderkey"))).repartition("o_digits")
        met = met & F.expr("o_digits = digits")
    joined = base.drop("stem", "defect").join(orders, met).join(who, F.expr("w_key = skey"))
    joined = joined.withColumns({"stem": F.expr("okey * 100000 + skey"), "defect": F.expr("(31 * okey + 7 * skey) % 24")})
    select = SHAPED[: SHAPED.index("FROM base")] + "FROM {joined}"
    return spark.sql(select.replace("SELECT", "SELECT digits,", 1) if digits else select, joined=joined)


def together(made: DataFrame) -> DataFrame:
    """Both sides of ``shaped`` rows with ``digits`` in one pass, partitioned as these are; ``side`` says b or g."""
    arms = []
    for side, text in zip("bg", (sides()[s] for s in ("books", "statement")), strict=True):
        for arm in text.split(" UNION ALL "):
            columns, where = arm.removeprefix("SELECT ").split(" FROM shaped WHERE ")
            arms.append(f"CASE WHEN {where} THEN struct('{side}' AS side, {columns}) END")
    # no filter inside of the array, which Spark would interpret
    return made.selectExpr("digits", f"inline(array({', '.join(arms)}))").filter("side IS NOT NULL").drop("defect")


def side_of(made: DataFrame, side: str) -> DataFrame:
    """``books`` or ``statement`` of ``shaped`` rows."""
    return made.sparkSession.sql(sides()[side].replace("FROM shaped", "FROM {shaped}"), shaped=made)


def documents(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """``books`` or ``statement`` over the tables of ``sf_dir``."""
    return side_of(shaped(spark, sf_dir), side)

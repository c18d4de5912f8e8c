"""Labelled cases, one per order: a supplier of its own, a document on each side, one defect or none.

The defect of a case is o_orderkey % 18: 1 to 12 name the code that has to be
raised, 13 an invalid registration number on both sides, the rest are clean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import check_digit_sql

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _letters(k: str) -> str:
    parts = [f"substr('{LETTERS}', CAST(1 + (({k}) DIV {26**i}) % 26 AS INT), 1)" for i in (3, 2, 1, 0)]
    return " || ".join(parts)


def _gstin(fifth: str) -> str:
    body = f"'27' || {_letters('o_orderkey DIV 10000')} || '{fifth}' || lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0') || 'A1Z'"
    return f"({body})"


BASE = f"""
SELECT o_orderkey, o_orderkey % 18 AS defect, 'SYN' || lpad(CAST(o_orderkey AS STRING), 9, '0') AS number,
       {_gstin('A')} AS body, {_gstin('B')} AS near_body,
       CASE WHEN o_orderkey % 18 IN (11, 12) THEN 'credit_note' WHEN o_orderkey % 18 IN (1, 2) OR o_orderkey % 4 <> 1 THEN 'invoice' ELSE 'debit_note' END AS doc_type,
       date_add(DATE'2024-04-01', CAST(o_orderkey % 28 AS INT)) AS invoice_date,
       CAST(1000 + o_orderkey % 9000 AS DECIMAL(18,2)) AS taxable
FROM {{orders}}
"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = spark.sql(BASE, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    good = f"body || {check_digit_sql('body')}"
    near = f"near_body || {check_digit_sql('near_body')}"
    # the check digit after the right one
    bad = "body || substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ0', 1 + instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr(good, 15, 1)), 1)"
    return base.withColumn("good", F.expr(good)).withColumns({"near": F.expr(near), "bad": F.expr(bad)})


def truth(cases: DataFrame) -> DataFrame:
    """(case_id, code) per case; a clean one has no code."""
    code = F.when(F.col("defect").between(1, 12), F.format_string("EX-%02d", F.col("defect"))).when(F.col("defect") == 13, "EX-06")
    return cases.select(F.substring("number", 4, 9).alias("case_id"), code.alias("code"))


def sides(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(books, statement) of the cases."""
    tax = "CAST(taxable * 0.18 AS DECIMAL(18,2))"
    half = "CAST(taxable * 0.09 AS DECIMAL(18,2))"
    zero = "CAST(0 AS DECIMAL(18,2))"
    own = "CASE WHEN defect = 13 THEN bad ELSE good END"
    split = "o_orderkey % 3 = 0 OR defect = 5"
    books = cases.filter("defect NOT IN (2, 11)").withColumn("copy", F.expr("explode(sequence(0, IF(defect = 10, 1, 0)))"))
    books = books.selectExpr(
        "o_orderkey * 4 + copy AS ord", "doc_type", f"{own} AS gstin", "number", "invoice_date", "taxable",
        f"IF({split}, {zero}, {tax}) AS igst", f"IF({split}, {half}, {zero}) AS cgst", f"IF({split}, {half}, {zero}) AS sgst",
        f"{zero} AS cess", "CAST(NULL AS STRING) AS itc", "CAST(NULL AS STRING) AS period",
    )
    other = cases.filter("defect NOT IN (1, 12)").selectExpr(
        "o_orderkey * 4 AS ord", "doc_type", f"IF(defect = 6, near, {own}) AS gstin", "IF(defect = 7, 'BILL-7', number) AS number",
        "invoice_date", "CAST(IF(defect = 3, taxable + 10, taxable) AS DECIMAL(18,2)) AS taxable",
        f"CAST(IF({split}, {zero}, {tax}) + IF(defect = 4, 5, 0) AS DECIMAL(18,2)) AS igst",
        f"CAST(IF({split}, {half}, {zero}) + IF(defect = 5, 1, 0) AS DECIMAL(18,2)) AS cgst",
        f"CAST(IF({split}, {half}, {zero}) - IF(defect = 5, 1, 0) AS DECIMAL(18,2)) AS sgst",
        f"{zero} AS cess", "IF(defect = 9, 'N', 'Y') AS itc", "IF(defect = 8, '052024', '042024') AS period",
    )
    return books, other

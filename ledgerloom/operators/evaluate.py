"""How well findings recover the labels of synthetic cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .findings import SEVERITY

CASE = r"SYN(\d{5,})"


def case_id(books_number: Column, statement_number: Column) -> Column:
    """The case of a finding, from the number in the books or else that in the statement; null if neither has one."""
    found = [F.nullif(F.regexp_extract(F.coalesce(n, F.lit("")), CASE, 1), F.lit("")) for n in (books_number, statement_number)]
    return F.coalesce(*found)


def by_code(truth: DataFrame, actual: DataFrame) -> DataFrame:
    """(code, tp, fp, fn, precision, recall, f1) over (case_id, code) rows; NaN where nothing is to be divided.

    Findings of cases that are not in ``truth``, which has a row without a code for a clean case, do not count.
    """
    codes = truth.sparkSession.createDataFrame([(c,) for c in SEVERITY], "code string")
    known = truth.select("case_id").distinct()
    t = truth.filter("code IS NOT NULL").distinct().withColumn("t", F.lit(1))
    a = actual.distinct().join(known, "case_id", "left_semi").withColumn("a", F.lit(1))
    both = t.join(a, ["case_id", "code"], "full")
    sums = both.groupBy("code").agg(
        F.count_if(F.col("t").isNotNull() & F.col("a").isNotNull()).alias("tp"),
        F.count_if(F.col("t").isNull()).alias("fp"),
        F.count_if(F.col("a").isNull()).alias("fn"),
    )
    out = codes.join(sums, "code", "left").fillna(0, ["tp", "fp", "fn"])
    nan = F.lit(float("nan"))
    ratio = lambda x, y: F.when(x + y > 0, x / (x + y)).otherwise(nan)
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("fn")))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(~F.isnan(p) & ~F.isnan(r) & (p + r > 0), 2 * p * r / (p + r)).otherwise(nan))


def clean(truth: DataFrame, actual: DataFrame) -> DataFrame:
    """(clean_cases, false_positives): cases without a label, and those of them with a finding."""
    lone = truth.groupBy("case_id").agg(F.count("code").alias("n")).filter("n = 0").select("case_id")
    hit = actual.select("case_id").distinct().withColumn("hit", F.lit(1))
    return lone.join(hit, "case_id", "left").agg(
        F.count("*").alias("clean_cases"), F.count("hit").alias("false_positives")
    )


def gate(codes: DataFrame, cleans: DataFrame, unrecovered: int) -> bool:
    """Whether every code with cases has precision and recall 1, no clean case a finding and every finding a case."""
    bad = codes.filter("tp + fp + fn > 0 AND (precision < 1 OR recall < 1)")
    return not unrecovered and cleans.first()["false_positives"] == 0 and bad.isEmpty()


def unrecovered(found: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` evidences, by ``ordinal``, of findings without a case, for the report."""
    return found.filter("case_id IS NULL").orderBy("ordinal").limit(n).select("ordinal", "evidence")

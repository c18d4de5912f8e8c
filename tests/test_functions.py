from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("g,ok", [("27AAPFU0939F1ZV", True), (" 27aapfu0939f1zv ", True), ("27AAPFU0939F1Z9", False), ("x", False), (None, False)])
def test_gstin(spark, g, ok):
    assert one(spark, g, text.is_valid_gstin) is ok


@pytest.mark.parametrize("x,want", [("1,234.125", "1234.12"), ("(₹ 5)", "-5.00"), ("", "0.00"), (None, "0.00"), ("abc", None)])
def test_amount(spark, x, want):
    assert one(spark, x, text.parse_amount) == (None if want is None else Decimal(want))


@pytest.mark.parametrize("x", ["01-04-2024", "1/4/2024", "2024-04-01", "01-Apr-2024", "01-APR-24", "1/4/24"])
def test_date(spark, x):
    assert one(spark, x, text.parse_date) == date(2024, 4, 1)


def test_impossible_date(spark):
    assert one(spark, "31-02-2024", text.parse_date) is None


@pytest.mark.parametrize("a,b,want", [("INV1234", "INV1243", 85.714), ("", "", 100.0), ("", "A", 0.0), ("ABCD12345", "ABCD12346", 88.889)])
def test_indel(spark, a, b, want):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(text.indel_ratio(F.col("a"), F.col("b"))).first()[0]
    assert abs(got - want) < 1e-3


def test_point_id(spark):
    import uuid

    assert one(spark, "s:1:None:ab", text.point_id) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "s:1:None:ab"))

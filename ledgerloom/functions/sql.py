"""The scalar rules as SQL functions, and the headers of provisions as a table function.

``register`` makes them known to a session. The scalar functions are SQL text that
Catalyst inlines, so a query that uses them has no Python in its plan. The table
function is called laterally: ``FROM statutes s, LATERAL provision_headers(s.body) h``.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

from .text import DATE_FORMATS, GSTIN_SHAPE, check_digit_sql

_TRIM = r"regexp_replace({}, r'(?U)^\s+|\s+$', '')"
_AMOUNT = r"regexp_replace(regexp_replace(coalesce(x, ''), r'(?U)[,\s₹]', ''), r'^\((.*)\)$', '-$1')"


def _dates() -> str:
    tried = "CASE WHEN {0} RLIKE r'{2}' THEN CAST(try_to_timestamp({0}, '{1}') AS DATE) END"
    got = ", ".join(tried.format(_TRIM.format("x"), f, shape) for f, shape in DATE_FORMATS.items())
    # two digits of a year from 69 on are of the last century
    short = f"{_TRIM.format('x')} RLIKE r'[-/][0-9]{{2}}$' AND NOT {_TRIM.format('x')} RLIKE r'^[0-9]{{4}}-'"
    got = f"coalesce({got})"
    return f"CASE WHEN {short} AND year({got}) >= 2069 THEN add_months({got}, -1200) ELSE {got} END"


#: name: (parameters, type, body); a body uses functions that stand above it
FUNCTIONS = {
    "norm_text": ("x STRING", "STRING", f"upper({_TRIM.format('x')})"),
    "gstin_check_digit": ("x STRING", "STRING", check_digit_sql("x")),
    "gstin_is_valid": (
        "x STRING",
        "BOOLEAN",
        f"coalesce(norm_text(x) RLIKE r'{GSTIN_SHAPE}' AND substr(norm_text(x), 15, 1) = gstin_check_digit(norm_text(x)), false)",
    ),
    "invoice_strict_key": ("x STRING", "STRING", "norm_text(x)"),
    "invoice_loose_key": ("x STRING", "STRING", "regexp_replace(norm_text(x), '[^A-Z0-9]', '')"),
    "indel_ratio": (
        "a STRING, b STRING",
        "DOUBLE",
        """CASE WHEN a = b THEN 100D WHEN length(a) = 0 OR length(b) = 0 THEN 0D
        ELSE 200D * aggregate(split(a, ''), transform(sequence(0, length(b)), z -> 0),
          (prev, c) -> aggregate(sequence(1, length(b)), array(0), (cur, j) -> array_append(cur,
            CASE WHEN substr(b, j, 1) = c THEN get(prev, j - 1) + 1 ELSE greatest(get(prev, j), get(cur, j - 1)) END)),
          row -> get(row, length(b))) / (length(a) + length(b)) END""",
    ),
    "gstin_similarity": ("a STRING, b STRING", "DOUBLE", "indel_ratio(norm_text(a), norm_text(b))"),
    "invoice_similarity": ("a STRING, b STRING", "DOUBLE", "indel_ratio(invoice_loose_key(a), invoice_loose_key(b))"),
    "ledger_date": ("x STRING", "DATE", _dates()),
    "ledger_amount": (
        "x STRING",
        "DECIMAL(18,2)",
        f"CASE WHEN {_AMOUNT} = '' THEN 0 ELSE try_cast(bround(try_cast({_AMOUNT} AS DECIMAL(38,10)), 2) AS DECIMAL(18,2)) END",
    ),
    "expected_period": ("d DATE", "STRING", "date_format(d, 'MMyyyy')"),
}


#: Characters of a provision that ``provision_headers`` shows.
OPENING = 80


@udtf
class ProvisionHeaders:
    """(position, section_number, section_title, char_start, body_start, opening) of each header of a text, in characters from 0.

    ``opening`` is the first ``OPENING`` characters behind the header: taking them here reads a text once, while
    ``substr`` of the whole text beside each header reads it as often as it has headers. Headers are found from left to right, each behind the end of the one before.
    Null text has none; an argument that is not a text is refused when the query is analysed.
    """

    @staticmethod
    def analyze(body: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(body.dataType, (T.StringType, T.NullType)):
            raise ValueError(f"provision_headers takes a text, not {body.dataType.simpleString()}")
        numbers = ("position", "char_start", "body_start")
        names = ("position", "section_number", "section_title", "char_start", "body_start", "opening")
        return AnalyzeResult(T.StructType([T.StructField(n, T.LongType() if n in numbers else T.StringType()) for n in names]))

    def __init__(self):
        from ledgerloom.functions.sql import OPENING
        from ledgerloom.operators.chunk import SECTION

        self.shown = OPENING
        self.header = re.compile(f"^{SECTION}", re.M | re.A)

    def eval(self, body):
        for i, m in enumerate(self.header.finditer(body or "")):
            yield i, m[1], m[2].strip(), m.start(), m.end(), body[m.end() : m.end() + self.shown]


def register(spark: SparkSession) -> None:
    """Make all functions known to the session; doing so again changes nothing."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("provision_headers", ProvisionHeaders)

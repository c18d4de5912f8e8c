"""Command line: reconcile a ledger with a statement and write the working paper."""

from __future__ import annotations

import argparse
import sys
from decimal import Decimal, InvalidOperation

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import findings, reconcile
from .sources import ledger, statement, writers
from .sources.errors import SchemaMismatchError

REGISTER = ("label", "severity", "itc_at_risk", "evidence")
DOCUMENT = ("doc_type", "gstin", "number", "invoice_date", "taxable", "total")


def working_paper(spark: SparkSession, books_path: str, statement_path: str, output: str, tolerance: Decimal) -> dict:
    """Write the three-sheet workbook; returns its totals."""
    books, other = ledger.read_ledgers(spark, books_path), statement.read_statements(spark, statement_path)
    done = reconcile.reconcile_full(books, other, tolerance)
    lines = findings.bridge(*done).collect()  # five rows
    totals = findings.totals(books, other).first().asDict()
    amounts = {r["line"]: (r["n"], r["amount"]) for r in lines}
    totals["closing_variance"] = totals["books"] + sum(a for _, a in amounts.values()) - totals["available"]
    found = findings.described(findings.register(*done, books, other), books, other)
    order = found.orderBy("code", F.coalesce("b_ord", "g_ord"), "pos")
    columns = [*REGISTER, *(f"{s}.{c}" for s in "bg" for c in DOCUMENT)]
    shown = order.select(*(F.col(c).cast("string").alias(c.replace(".", "_")) if c != "itc_at_risk" else F.col(c) for c in columns))
    counts = {"books": books.count(), "statement": other.count(), "findings": found.count()}

    def bridge_rows():
        yield "Line", "Documents", "Amount"
        yield "ITC as per books", counts["books"], totals["books"]
        for name in findings.LINES:
            yield name.replace("_", " "), *amounts[name]
        yield "ITC as per 2B, available", counts["statement"], totals["available"]
        yield "Blocked", None, totals["blocked"]
        yield "Closing variance", None, totals["closing_variance"]

    def register_rows():
        yield [c.replace("b.", "books ").replace("g.", "2b ") for c in columns]
        yield from (list(r) for r in shown.toLocalIterator())

    def run_rows():
        yield "Books file", books_path, writers.file_hash(books_path)
        yield "Statement file", statement_path, writers.file_hash(statement_path)
        yield "Tax tolerance", str(tolerance)
        yield "Invoice number threshold", reconcile.NUMBER_FLOOR
        yield "GSTIN threshold", reconcile.GSTIN_FLOOR
        yield "Books documents", counts["books"]
        yield "Statement documents", counts["statement"]

    sheets = {"ITC Bridge": bridge_rows(), "Exception Register": register_rows(), "Reproducibility": run_rows()}
    writers.write_workbook(output, sheets)
    return totals | counts


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit codes: 0 written, 1 bad input, 2 the bridge does not close."""
    parser = argparse.ArgumentParser(prog="ledgerloom")
    parser.add_argument("books")
    parser.add_argument("statement")
    parser.add_argument("--output", "-o", default="working_paper.xlsx")
    parser.add_argument("--tax-tolerance", default="0")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        tolerance = Decimal(args.tax_tolerance)
        for path in (args.books, args.statement):
            with open(path, "rb") as f:
                if not f.read(1):  # Spark does not list files of no bytes
                    raise SchemaMismatchError(f"{path} is empty")
        got = working_paper(spark, args.books, args.statement, args.output, tolerance)
    except (SchemaMismatchError, InvalidOperation, FileNotFoundError) as problem:
        print(f"Input format error: {problem}", file=sys.stderr)
        return 1
    print(f"Wrote {args.output}")
    for name, value in got.items():
        print(f"  {name.replace('_', ' ')}: {value}")
    if got["closing_variance"] != 0:
        print("The bridge does not close: a defect of the engine, not a finding.", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""Scalar functions over strings, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the alphabet of the check digit and the shape of a registration number
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GSTIN_SHAPE = r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][A-Z0-9]Z[A-Z0-9]$"
#: Formats of dates in the order they are tried, and a shape that every text of the format has: trying one that cannot fit is dear.
DATE_FORMATS = {
    "d-M-yyyy": "^[0-9]+-[0-9]+-[-+]?[0-9]{4,}$",
    "d/M/yyyy": "^[0-9]+/[0-9]+/[-+]?[0-9]{4,}$",
    "yyyy-M-d": "^[-+]?[0-9]{4,}-[0-9]+-[0-9]+$",
    "d-MMM-yyyy": "^[0-9]+-[^-]*[A-Za-z][^-]*-[-+]?[0-9]{4,}$",
    "d-MMM-yy": "^[0-9]+-[^-]*[A-Za-z][^-]*-[0-9]{2}$",
    "d/M/yy": "^[0-9]+/[0-9]+/[0-9]{2}$",
}

#: The letter whose doubled value has the digit sum i in base 36, for each i.
_DOUBLED = "".join(ALPHABET[i // 2 + 18 * (i % 2)] for i in range(36))


def check_digit_sql(g: str) -> str:
    """Spark SQL text of the base-36 check digit over the first 14 characters of ``g``.

    Where these are of the alphabet, each adds its place in one of two alphabets, which needs no lambdas.
    """
    places = " + ".join(f"instr('{_DOUBLED if i % 2 == 0 else ALPHABET}', substr({g}, {i}, 1))" for i in range(1, 15))
    any_text = (
        f"aggregate(transform(sequence(1, 14), i -> (instr('{ALPHABET}', substr({g}, i, 1)) - 1) * (CASE WHEN i % 2 = 1 THEN 1 ELSE 2 END)), 0, "
        "(s, p) -> s + CAST(floor(p / 36) AS INT) + p % 36)"
    )
    total = f"CASE WHEN length({g}) >= 14 AND NOT substr({g}, 1, 14) RLIKE '[^0-9A-Z]' THEN {places} - 14 ELSE {any_text} END"
    return f"substr('{ALPHABET}', 1 + pmod(36 - pmod({total}, 36), 36), 1)"


def norm(x: Column) -> Column:
    """Upper case without white space at the ends."""
    return F.upper(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))


def is_valid_gstin(x: Column) -> Column:
    g = norm(x)
    digit = F.call_function("substr", F.lit(ALPHABET), 1 + _check_index(g), F.lit(1))
    return F.coalesce(g.rlike(GSTIN_SHAPE) & (F.substring(g, 15, 1) == digit), F.lit(False))


def _check_index(g: Column) -> Column:
    def part(i):
        v = (F.instr(F.lit(ALPHABET), g.substr(i, F.lit(1))) - 1) * F.when(i % 2 == 1, 1).otherwise(2)
        return F.floor(v / 36).cast("int") + v % 36

    places = [F.instr(F.lit(ALPHABET if i % 2 else _DOUBLED), g.substr(i, 1)) for i in range(1, 15)]
    any_text = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(14)), part), F.lit(0), lambda s, p: s + p)
    total = F.when(g.rlike("^[0-9A-Z]{14}"), sum(places[1:], places[0]) - 14).otherwise(any_text)
    return F.pmod(36 - F.pmod(total, F.lit(36)), F.lit(36))


def check_digit(g: Column) -> Column:
    return F.call_function("substr", F.lit(ALPHABET), 1 + _check_index(g), F.lit(1))


strict_key = norm


def loose_key(x: Column) -> Column:
    return F.regexp_replace(norm(x), "[^A-Z0-9]", "")


def indel_ratio(a: Column, b: Column) -> Column:
    """200 * LCS / (|a| + |b|); 100 where the strings are equal.

    In a select that also names an output like a column of ``a`` or ``b``, Spark takes that output for the
    column inside lambdas: compute the ratio in a select of its own there.
    """
    row = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))

    def next_row(prev, ch):
        def cell(cur, j):
            up = F.when(b.substr(j, F.lit(1)) == ch, F.get(prev, j - 1) + 1).otherwise(
                F.greatest(F.get(prev, j), F.get(cur, j - 1))
            )
            return F.array_append(cur, up)

        return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)), cell)

    lcs = F.aggregate(F.split(a, ""), row, next_row, lambda r: F.get(r, F.length(b)))
    empty = (F.length(a) == 0) | (F.length(b) == 0)
    return (
        F.when(a == b, F.lit(100.0))
        .when(empty, F.lit(0.0))
        .otherwise(F.lit(200.0) * lcs / (F.length(a) + F.length(b)))
    )


def parse_date(x: Column) -> Column:
    """The first of six day-first or ISO forms that fits; null where none does."""
    x = F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    got = F.coalesce(*(F.when(x.rlike(shape), F.try_to_date(x, f)) for f, shape in DATE_FORMATS.items()))
    short = x.rlike(r"[-/][0-9]{2}$") & ~x.rlike(r"^[0-9]{4}-")
    return F.when(short & (F.year(got) >= 2069), F.add_months(got, -1200)).otherwise(got)


def parse_amount(x: Column) -> Column:
    """Decimal with two places, half-even; blank is 0, (x) is negative, null where it is no number or has more than 16 digits before the point."""
    t = F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r"(?U)[,\s₹]", "")
    t = F.regexp_replace(t, r"^\((.*)\)$", "-$1")
    value = F.bround(t.try_cast("decimal(38,10)"), 2).try_cast("decimal(18,2)")
    return F.when(t == "", F.lit(0).cast("decimal(18,2)")).otherwise(value)


def doc_type(voucher: Column) -> Column:
    v = F.lower(F.coalesce(voucher, F.lit("")))
    return (
        F.when(v.contains("credit"), "credit_note").when(v.contains("debit"), "debit_note").otherwise("invoice")
    )


def point_id(key: Column) -> Column:
    """Name-based (version 5) UUID of ``key`` in the DNS namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8")), F.encode(key, "UTF-8")))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    variant = F.substring(F.lit("89ab"), F.lit(1) + nibble % 4, F.lit(1))
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def drop_noise_lines(x: Column) -> Column:
    keep = F.filter(F.split(x, "\n"), lambda s: ~s.rlike(r"^\s*([0-9]{1,4}|Page [0-9]+ of [0-9]+)\s*$"))
    return F.array_join(keep, "\n")


def truncate_at_second(x: Column, marker: str) -> Column:
    first = F.instr(x, marker)
    second = F.call_function("locate", F.lit(marker), x, first + len(marker))
    return F.when((first > 0) & (second > 0), x.substr(F.lit(1), second - 1)).otherwise(x)

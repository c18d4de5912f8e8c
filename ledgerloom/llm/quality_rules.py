"""Quality rules: a threshold table compiled into one Spark projection.

``RULES`` is plain data. ``apply_rules`` turns it into column expressions over
a small set of measures; the whole operator is one scan and one projection
chain, with no shuffle, no user function and no Python worker, so a hot source
costs no more than any other and a task needs memory for one batch of texts.

Defined results
    * null or empty text: all counts 0, ``base_failed`` true, ``kept`` false.
    * a text shorter than five words has no window: ``n_repeat_words`` is 0.
    * repeated rows and repeated ids are judged row by row.
    * extra columns are kept by ``filter_documents`` whatever their names; the
      measures live under names starting with ``__q_`` and are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

# fixed values: frequent function words of English, French, German and Spanish
STOP_WORDS = (
    "the of and to a in is it that for on with as are was be by this from or he not "
    "de la le les des et en un une du que est pour dans qui au sur par pas elle "
    "der die das und den von zu mit ist ein eine dem nicht sich im auf für als auch "
    "el los las y del se por con para lo su al una no"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure must lie within [low, high] once the text has ``from_words`` words."""

    measure: str
    low: float | None = None
    high: float | None = None
    from_words: int = MIN_WORDS


#: The threshold table. Ratios are per word, per word character or per line as named.
RULES = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbol_ratio", None, 0.05),
    Rule("shout_ratio", None, 0.05),
    Rule("upper_ratio", None, 0.40),
    Rule("stop_word_ratio", 0.04, None, from_words=50),
    Rule("dup_line_ratio", None, 0.50),
)


def _kept_chars(text: Column, drop: str) -> Column:
    """Characters of the text that are left when runs matching ``drop`` go."""
    return F.length(F.regexp_replace(text, drop, "")).cast("long")


def _stop_forms() -> list[str]:
    forms = {f for w in STOP_WORDS for f in (w, w.capitalize(), w.upper())}
    return sorted(f + end for f in forms for end in ("", ".", ","))


def _spaced(text: Column) -> Column:
    """The text with every white-space character that ends words as one blank."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def _pairs(a: Column, b: Column, ahead: int) -> Column:
    """hash(a[i], b[i + ahead]) for every i that has both."""
    return F.slice(
        F.zip_with(a, F.slice(b, ahead + 1, 1 << 30), lambda x, y: F.xxhash64(x, y)),
        1,
        F.greatest(F.least(F.size(a), F.size(b) - ahead), F.lit(0)),
    )


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts and ratios, as columns starting with ``__q_``.

    Windows are compared by 64-bit hashes built by doubling (2, 4, then 5
    words): two unequal windows of one text of n words share a hash with
    probability below n^2 / 2^65. Stacked projections keep every array that
    is used twice from being computed twice.
    """
    df = df.withColumn("__q_text", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    t, h = F.col("__q_text"), F.col("__q_hashes")
    blank = _spaced(t)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns(
        {
            "__q_hashes": F.transform(
                F.array_remove(F.split(blank, " "), ""), lambda x: F.xxhash64(x)
            ),
            "__q_chars": F.length(F.replace(blank, F.lit(" "), F.lit(""))).cast("long"),
            "__q_symbols": _kept_chars(t, r"[^#*$%&|<>]+"),
            "__q_shouts": _kept_chars(t, r"[^!?]+"),
            "__q_upper": _kept_chars(t, r"[^\p{Lu}]+"),
            "__q_lines": lines,
        }
    ).drop("__q_text")
    df = df.withColumns(
        {
            "__q_n": F.size(h).cast("long"),
            "__q_stops": F.size(
                F.filter(h, lambda x: x.isin([F.xxhash64(F.lit(f)) for f in _stop_forms()]))
            ),
            "__q_n_lines": F.size("__q_lines"),
            "__q_dups": (
                F.size("__q_lines") - F.size(F.array_distinct(F.col("__q_lines")))
            ).cast("long"),
            "__q_two": _pairs(h, h, 1),
        }
    ).drop("__q_lines")
    two, four, w = F.col("__q_two"), F.col("__q_four"), F.col("__q_windows")
    df = df.withColumn("__q_four", _pairs(two, two, 2)).drop("__q_two")
    df = df.withColumn("__q_windows", _pairs(four, h, 4)).drop("__q_four", "__q_hashes")
    # Only texts with a repeated window are sorted.
    df = df.withColumn(
        "__q_sorted",
        F.when(
            F.size(F.array_distinct(w)) < F.size(w),
            F.sort_array(F.transform(w, lambda k, i: F.struct(k.alias("k"), i.alias("i")))),
        ),
    ).drop("__q_windows")
    s = F.col("__q_sorted")
    df = df.withColumn(
        "__q_starts",
        F.sort_array(
            F.transform(
                F.filter(
                    s,
                    lambda x, j: (
                        F.coalesce(F.get(s, j - 1)["k"] == x["k"], F.lit(False))
                        | F.coalesce(F.get(s, j + 1)["k"] == x["k"], F.lit(False))
                    ),
                ),
                lambda x: x["i"],
            )
        ),
    ).drop("__q_sorted")
    covered = F.aggregate(
        F.col("__q_starts"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct(
            (acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).cast("long").alias("n"),
            (i + WINDOW).alias("end"),
        ),
        lambda acc: acc["n"],
    )
    return df.withColumn("__q_repeats", F.coalesce(covered, F.lit(0).cast("long")))


def _measures() -> dict[str, Column]:
    n, chars, lines = F.col("__q_n"), F.col("__q_chars"), F.col("__q_n_lines")

    def per(x, y):
        return F.when(y > 0, x / y)

    return {
        "mean_word_chars": per(chars, n),
        "symbol_ratio": per(F.col("__q_symbols"), chars),
        "shout_ratio": per(F.col("__q_shouts"), chars),
        "upper_ratio": per(F.col("__q_upper"), chars),
        "stop_word_ratio": per(F.col("__q_stops"), n),
        "dup_line_ratio": per(F.col("__q_dups"), lines),
    }


def base_failed() -> Column:
    n = F.col("__q_n")
    return (n < MIN_WORDS) | (100 * F.col("__q_repeats") > MAX_REPEAT_PERCENT * n)


def failed_rules(rules=RULES) -> Column:
    """Names of the rules a row breaks, in table order, compiled from the table."""
    of = _measures()

    def broken(r: Rule) -> Column:
        x = of[r.measure]
        out = F.lit(False)
        if r.low is not None:
            out = out | (x < r.low)
        if r.high is not None:
            out = out | (x > r.high)
        out = out & (F.col("__q_n") >= r.from_words)
        return F.when(F.coalesce(out, F.lit(False)), F.lit(r.measure))

    return F.filter(F.array(*map(broken, rules)), lambda x: x.isNotNull())


def apply_rules(df: DataFrame, key: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """One row per input row: the base counts, the verdicts and the broken rules."""
    m = measured(df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias(text)), text)
    m = m.withColumns({"__q_base": base_failed(), "__q_failed": failed_rules(rules)})
    return m.select(
        key,
        F.col("__q_n").alias("n_words"),
        F.col("__q_chars").alias("word_chars"),
        F.col("__q_symbols").alias("n_symbols"),
        F.col("__q_dups").alias("n_dup_lines"),
        F.col("__q_repeats").alias("n_repeat_words"),
        F.col("__q_base").alias("base_failed"),
        (~F.col("__q_base") & (F.size("__q_failed") == 0)).alias("kept"),
        F.array_join("__q_failed", ",").alias("failed_rules"),
    )


def filter_documents(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows the rules keep, with their own columns only."""
    m = measured(df, text)
    m = m.withColumns({"__q_base": base_failed(), "__q_failed": failed_rules(rules)})
    # written first: a filter pushed below the projections would repeat their arrays in itself
    keep = (~F.col("__q_base") & (F.size("__q_failed") == 0)).alias("__q_keep")
    judged = written(m.select(*(F.col(f"`{c}`") for c in df.columns), keep), "quality-judged")
    return judged.filter("__q_keep").drop("__q_keep")

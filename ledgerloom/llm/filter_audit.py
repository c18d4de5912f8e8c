"""How filters interact: what each removes in every order they may be applied.

A filter order is a path through the lattice of filter sets, and a step is one
of its edges: the set applied already, and the next filter. With five filters
there are 80 edges and 600 steps in 120 orders. Documents are reduced to
signatures (part, filters failed, good, toxic) with a count, the signatures
contribute to the 80 edges, and the edges are joined to the 600 steps. So the
work on documents is one projection and two aggregations of short rows, and
what is larger than the corpus' signatures never meets the orders.

Equal texts fail the same filters but one, the test for copies. It follows from
counts by text digest and id: the rows of a digest's least id are no copies, all
others are. No join on the digest is needed, so a text that a third of all
documents have is one row after the first partial aggregation, and rows
without an id go their own way past the join with the labels.

Defined results
    * null or empty text: no words, no characters, equal to every other such text.
    * null source: part "" (with an empty source, if there is one).
    * rows of the least id of a text are all no copies; a row without an id is
      neither a copy nor what makes another one.
    * a document is good (toxic) if any of its labels says so; null labels say nothing.
    * repeated rows count each; extra columns are ignored; an empty table has no parts.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, words, written

FILTERS = "ABCDE"
MIN_WORDS = 200
DISTINCT_SHARE = 50
CAPITAL_SHARE = 2
MARKS = "#$%&*|"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_failures(text: Column) -> dict[str, Column]:
    """The conditions that a text alone decides, by filter: true where it fails."""
    found = words(text)
    whole = F.coalesce(text, F.lit(""))
    n_capitals = F.length(whole) - F.length(F.translate(whole, CAPITALS, ""))
    return {
        "A": F.size(found) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(found)) < DISTINCT_SHARE * F.size(found),
        "C": 100 * n_capitals > CAPITAL_SHARE * F.length(whole),
        "D": F.length(whole) != F.length(F.translate(whole, MARKS, "")),
    }


def signatures(docs: DataFrame, labels: DataFrame, key="doc_id", text="text", source="source") -> DataFrame:
    """(part, failed, good, toxic, n): documents by part, by the filters they fail as bits, and by their labels."""
    t = F.col(f"`{text}`")
    d = docs.select(
        F.col(f"`{key}`").alias("id"),
        F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce(t, F.lit("")).cast("binary"), 256)).alias("digest"),
        _bits({f: c for f, c in text_failures(t).items()}).alias("failed"),
    )
    d = written(d, "audit-documents")
    said = labels.filter(f"`{key}` IS NOT NULL").groupBy(F.col(f"`{key}`").alias("id")).agg(
        *(F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic")))
    )
    labelled = d.filter("id IS NOT NULL").join(said, "id", "left")
    nameless = d.filter("id IS NULL").select("*", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic"))
    known = labelled.unionByName(nameless).na.fill(0, ["good", "toxic"])
    group = ("digest", "failed", "part", "good", "toxic")
    # rows of one id and text first, so that the next step knows how many have the least id
    by_id = known.groupBy("id", *group).agg(F.count("*").alias("n"))
    by_text = by_id.groupBy(*group).agg(
        F.min("id").alias("least"),
        F.sum("n").alias("n"),
        F.coalesce(F.min_by("n", "id"), F.lit(0)).alias("n_least"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("n_nameless"),
    )
    by_text = written(by_text, "audit-texts")
    dropped(d)
    # of texts with several rows here, the least id over all of them
    least = by_text.groupBy("digest").agg(F.min("least").alias("first"), F.count("*").alias("rows"))
    several = least.filter("rows > 1").select(F.col("digest").alias("of"), "first")
    own = by_text.join(several, F.col("digest") == F.col("of"), "left")
    is_first = F.col("first").isNull() | (F.col("least") == F.col("first"))
    n_first = F.when(F.coalesce(is_first, F.lit(False)), F.col("n_least")).otherwise(0) + F.col("n_nameless")
    copies = FILTERS.index("E")
    both = F.array(
        F.struct(F.col("failed").alias("failed"), n_first.alias("n")),
        F.struct((F.col("failed") + F.lit(1 << copies)).alias("failed"), (F.col("n") - n_first).alias("n")),
    )
    return (
        own.select("part", "good", "toxic", F.inline(both))
        .filter("n > 0")
        .groupBy("part", "failed", "good", "toxic")
        .agg(F.sum("n").alias("n"))
    )


def _bits(failures: dict[str, Column]) -> Column:
    out = F.lit(0)
    for f, failed in failures.items():
        out = out + F.when(failed, F.lit(1 << FILTERS.index(f))).otherwise(0)
    return out


def edges(counts: DataFrame) -> DataFrame:
    """(part, applied, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost) of every edge.

    ``applied`` is the set of filters before the edge, as bits; ``filter`` is the bit of the next one.
    """
    n = len(FILTERS)
    lattice = F.expr(
        f"flatten(transform(sequence(0, {(1 << n) - 1}), s -> transform("
        f"filter(transform(sequence(0, {n - 1}), i -> shiftleft(1, i)), f -> (s & f) = 0), "
        "f -> named_struct('applied', s, 'filter', f))))"
    )
    each = counts.select("*", F.inline(lattice))
    reached = F.col("failed").bitwiseAND(F.col("applied")) == 0
    fails = F.col("failed").bitwiseAND(F.col("filter")) != 0
    lost = reached & fails

    def total(when: Column, name: str) -> Column:
        return F.sum(F.when(when, F.col("n")).otherwise(0)).alias(name)

    return each.groupBy("part", "applied", "filter").agg(
        total(reached & ~fails, "kept"),
        total(lost, "removed"),
        total(~reached & fails, "redundant"),
        total(F.col("failed") == F.col("filter"), "unique_fails"),
        total(lost & (F.col("good") == 1), "good_lost"),
        total(lost & (F.col("toxic") == 1), "toxic_lost"),
    )


def steps(spark) -> DataFrame:
    """(filter_order, step, applied, filter): the edge of each step of each order. 600 rows, whatever the data."""
    rows = []
    for order in permutations(FILTERS):
        applied = 0
        for i, f in enumerate(order, 1):
            bit = 1 << FILTERS.index(f)
            rows.append(("".join(order), i, applied, bit))
            applied |= bit
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, filter int")


def audit(docs: DataFrame, labels: DataFrame, key="doc_id", text="text", source="source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)
    of every step of every filter order, by part."""
    found = written(edges(signatures(docs, labels, key, text, source)), "audit-edges")
    path = steps(docs.sparkSession)
    shapley = (
        found.join(F.broadcast(path), ["applied", "filter"])  # 600 rows
        .groupBy("part", "filter")
        .agg(F.sum("removed").alias("shapley"))
    )
    return (
        found.join(F.broadcast(path), ["applied", "filter"])
        .join(shapley, ["part", "filter"])
        .select(
            "part", "filter_order", "step",
            *(F.col(c).cast("long").alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")),
        )
    )


def oracle_sql() -> str:
    w = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
    t = "coalesce(text, '')"
    return f"""
WITH f AS (SELECT doc_id, coalesce(source, '') AS part, {t} AS t, {w} AS w FROM documents),
flags AS (SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM f),
named AS (SELECT part, a, b, c, d, e,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = flags.doc_id AND l.quality = 1) AS good,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = flags.doc_id AND l.toxic = 1) AS toxic FROM flags),
docs AS (SELECT part, list_filter([CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END,
    CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END], lambda x: x IS NOT NULL) AS fails,
    good, toxic, count(*) AS n FROM named GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT v.l || w.l || x.l || y.l || z.l AS filter_order FROM letters v, letters w, letters x, letters y, letters z
    WHERE len(list_distinct([v.l, w.l, x.l, y.l, z.l])) = 5),
path AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS f,
    string_split(substr(filter_order, 1, step - 1), '') AS before FROM orders, range(1, 6) r(step)),
met AS (SELECT part, filter_order, step, f, n, good, toxic, fails, list_contains(fails, f) AS failing,
    NOT list_has_any(fails, before) AS reached FROM docs, path),
sums AS (SELECT part, filter_order, step, f,
    CAST(sum(CASE WHEN reached AND NOT failing THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN reached AND failing THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN NOT reached AND failing THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN fails = [f] THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN reached AND failing AND good THEN n ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN reached AND failing AND toxic THEN n ELSE 0 END) AS BIGINT) AS toxic_lost FROM met GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM sums"""

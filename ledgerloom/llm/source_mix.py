"""Mixing sources to target weights by entropy balancing, without user functions.

Among all document rates 0 <= r_d <= cap that give each source its target of
words, take those closest to 1 in relative entropy
    sum_d (r_d log r_d - r_d + 1)   subject to   sum_{d in s} size_d r_d = T_s.
The convex dual has one multiplier per source, and its optimum tilts each
document's rate exponentially by its size: r_d = min(cap, exp(lambda_s size_d)).
A source that must shrink so gives up long documents before short ones, one that
must grow repeats long ones first: the fewest documents change their rate.

Newton iterations run for all sources at once. Each adds up gradient
    sum_d size_d r_d - T_s   and curvature   sum_{d below the cap} size_d^2 r_d
over a distributed table of the documents, which holds one row per source and
size since documents of one size share their rate; steps are taken on the
logarithm of the words reached, kept inside a bracket, and end when every
source's residual is below TOLERANCE. Terms are added as decimals, exactly, so
no order of addition changes a digit and reruns agree.

Rates become whole copies by sequential Poisson sampling: everybody gets
floor(r), and documents in order of hash / (r - floor(r)) get one more until the
source's remaining words are met. The order's cut is found by two rounds of
per-source histograms (4096 bins each), so no task ever sees a source's
documents together; two further rounds exchange one document per source against
what is left over.

Everything a document needs is in its row and in one row per source, so
``apply_mix`` never shuffles texts unless there are too many sources to send.

Defined results
    * null text: size 0; a document without words has rate 1 and adds no words. A null source is a source, the last one.
    * an empty table gives an empty result; sources without words get target 0.
    * rows with equal id and size are decided alike; reruns agree.
    * a column of the input that has the name of a result column is not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dropped, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
BINS = 4096
NEWTON_STEPS = 100
TOLERANCE = 1e-7
EXACT = "decimal(34,10)"
EXCHANGES = 2


def word_count(text: Column) -> Column:
    spaced = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.size(F.array_remove(F.split(spaced, " "), "")).cast("long")


def tilted(size: Column, lam: Column, cap) -> Column:
    """Rate of a document; one that is whole up to rounding errors is whole."""
    rate = F.least(F.lit(cap).cast("double"), F.exp(lam * size))
    return F.when(F.abs(rate - F.round(rate)) < 1e-9, F.round(rate)).otherwise(rate)


def _bin(key: Column, rate: Column, level: int) -> Column:
    """The level-th 12 bits of a document's place in the order; null where the rate is whole."""
    u = F.shiftrightunsigned(F.xxhash64(key, F.lit("mix")), 12) / F.lit(float(1 << 52))
    rest = rate - F.floor(rate)
    place = F.least((u / (u + rest) * F.lit(float(BINS * BINS))).cast("long"), F.lit(BINS * BINS - 1))
    bits = F.shiftright(place, 12) if level == 0 else place.bitwiseAND(BINS - 1)
    return F.when(rest > 0, bits)


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """(source, source_size, target) from per-source sums: weighted shares, capped, excess reshared.

    Resharing until nobody is above the cap ends at min(cap, level * weight)
    with one level for all; the level is read off the sources in order of
    cap / weight. One row per source enters these windows.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    ranked = sizes.withColumn(
        "weight",
        F.element_at(
            F.array(*(F.lit(float(w)) for w in weights)),
            (F.pmod(F.row_number().over(order) - 1, F.lit(n)) + 1).cast("int"),
        ),
    ).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    whole = W.partitionBy()
    filled = (
        W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    ranked = (
        ranked.withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("all_weight", F.sum("weight").over(whole))
        .withColumn("most_so_far", F.sum("most").over(filled) - F.col("most"))
        .withColumn("weight_left", F.col("all_weight") - F.sum("weight").over(filled) + F.col("weight"))
        .withColumn("level", (F.col("budget") - F.col("most_so_far")) / F.col("weight_left"))
    )
    # The level is that of the first source, in this order, which it leaves below its cap;
    # from there on levels only fall, so it is the largest.
    open_level = F.max(
        F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    ).over(whole)
    return ranked.select(
        "source",
        "source_size",
        F.least("most", F.coalesce(open_level * F.col("weight"), F.col("most"))).alias("target"),
    )


def balanced(lengths: DataFrame, goals: DataFrame, cap=CAP) -> DataFrame:
    """``goals`` (source, source_size, target) with ``lambda``, from (source, size, n)."""
    top = F.log(F.lit(float(cap)))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
    full = share >= F.lit(float(cap)) * (1 - 1e-12)
    state = goals.select(
        "source",
        "source_size",
        "target",
        F.when(full, top).otherwise(F.lit(0.0)).alias("lambda"),
        # sizes are 1 at least, so these rates fall short of the target and exceed it
        F.when(share < 1, F.log(share)).otherwise(F.lit(0.0)).alias("lo"),
        F.when(share < 1, F.lit(0.0)).otherwise(top).alias("hi"),
        F.lit(None).cast("double").alias("residual"),
    )
    state = written(state, "mix-newton")
    for _ in range(NEWTON_STEPS):
        lam, size = F.col("lambda"), F.col("size")
        rate = F.least(F.lit(float(cap)), F.exp(lam * size))
        sums = (
            _same_source(lengths, state.select("source", "lambda"), "inner")
            .groupBy("source")
            .agg(
                F.sum((F.col("n") * size * rate).cast(EXACT)).cast("double").alias("reached"),
                F.sum(F.when(lam * size < top, F.col("n") * size * size * rate).otherwise(0.0).cast(EXACT))
                .cast("double")
                .alias("slope"),
            )
        )
        at = _same_source(state, sums)
        residual = F.when(F.col("target") > 0, F.abs(F.col("reached") / F.col("target") - 1)).otherwise(F.lit(0.0))
        over = F.col("reached") > F.col("target")
        at = at.withColumns(
            {
                "residual": residual,
                "lo": F.when(over, F.col("lo")).otherwise(F.greatest("lo", "lambda")),
                "hi": F.when(over, F.least("hi", "lambda")).otherwise(F.col("hi")),
            }
        )
        to = F.when(
            F.col("slope") > 0, lam - F.col("reached") / F.col("slope") * F.log(F.col("reached") / F.col("target"))
        )
        middle = F.when(F.col("lo") > 0, F.sqrt(F.col("lo") * F.col("hi"))).otherwise((F.col("lo") + F.col("hi")) / 2)
        to = F.when((to > F.col("lo")) & (to < F.col("hi")), to).otherwise(middle)
        after = written(
            at.withColumn("lambda", F.when(F.col("residual") <= TOLERANCE, lam).otherwise(to)).drop("reached", "slope"),
            "mix-newton",
        )
        dropped(state)
        state = after
        if (state.agg(F.max("residual")).first()[0] or 0.0) <= TOLERANCE:
            break
    return state.drop("lo", "hi", "residual")


def _same_source(a: DataFrame, b: DataFrame, how: str = "left") -> DataFrame:
    """Join on the null-safe source; ``b`` has one row per source, in column ``source``."""
    b = b.withColumnRenamed("source", "__m_source")
    return a.join(b, a["source"].eqNullSafe(b["__m_source"]), how).drop("__m_source")


def _cut(hist: DataFrame, need: str, level: int) -> DataFrame:
    """Per source the first bin whose running sum passes ``need``, and the sum before it."""
    by = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = hist.withColumn("upto", F.sum("mass").over(by))
    return (
        run.filter(F.col("upto") > F.col(need))
        .groupBy("source")
        .agg(
            F.min(F.struct("bin", (F.col("upto") - F.col("mass")).alias("before"), "mass")).alias("c")
        )
        .select(
            "source",
            F.col("c.bin").alias(f"bin{level}"),
            F.col("c.before").alias(f"before{level}"),
            F.col("c.mass").alias(f"mass{level}"),
        )
    )


def _copies(key: Column, size: Column) -> Column:
    """Copies of a row, from the columns that ``fit`` found for its source."""
    rate = tilted(size, F.col("lambda"), F.col("cap"))
    b0, b1 = _bin(key, rate, 0), _bin(key, rate, 1)
    inside = (b0 == F.col("bin0")) & (
        (b1 < F.col("bin1")) | ((b1 == F.col("bin1")) & F.col("take_last"))
    )
    # without a bin at which the words are met, all documents get one more
    more = b0.isNotNull() & F.coalesce((b0 < F.col("bin0")) | inside, F.lit(True))
    n = F.floor(rate) + F.when(more, 1).otherwise(0)
    for i in range(EXCHANGES):
        hit = F.coalesce(
            key.eqNullSafe(F.col(f"swap{i}.id")) & (size == F.col(f"swap{i}.size")), F.lit(False)
        )
        n = n + F.when(hit, F.col(f"swap{i}.step")).otherwise(0)
    return n.cast("int")


def fit(slim: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """One row per source with its target, multiplier and rounding, from (id, source, size)."""
    none = F.lit(None)
    lengths = written(slim.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-lengths")
    sums = lengths.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    rated = balanced(lengths, targets(sums, weights, share, cap), cap).withColumn("cap", F.lit(float(cap)))
    sized = tilted(F.col("size"), F.col("lambda"), F.col("cap"))
    base = (
        _same_source(lengths, rated.select("source", "lambda", "cap"), "inner")
        .groupBy("source")
        .agg(F.sum(F.col("n") * F.col("size") * F.floor(sized)).alias("base"))
    )
    rated = _same_source(rated, base).withColumn("extra", F.col("target") - F.col("base")).drop("base")
    rated = written(rated, "mix-rates")
    # from here on the order: per row its place, in the first round by its upper half
    slim_rate = tilted(F.col("size"), F.col("lambda"), F.col("cap"))
    hist0 = (
        _same_source(slim, rated.select("source", "lambda", "cap", "extra"), "inner")
        .withColumn("bin", _bin(F.col("id"), slim_rate, 0))
        .filter("bin IS NOT NULL")
        .groupBy("source", "bin")
        .agg(F.sum("size").alias("mass"), F.first("extra").alias("extra"))
    )
    found = written(_same_source(rated, _cut(hist0, "extra", 0)), "mix-cut0")
    hist1 = (
        _same_source(slim, found.select("source", "lambda", "cap", "bin0", "extra", "before0"), "inner")
        .filter(_bin(F.col("id"), slim_rate, 0) == F.col("bin0"))
        .groupBy("source", _bin(F.col("id"), slim_rate, 1).alias("bin"))
        .agg(
            F.sum("size").alias("mass"),
            F.first(F.col("extra") - F.col("before0")).alias("need"),
        )
    )
    found = _same_source(found, _cut(hist1, "need", 1)).withColumn(
        "take_last",
        F.coalesce(
            2 * (F.col("extra") - F.col("before0") - F.col("before1")) >= F.col("mass1"),
            F.lit(False),
        ),
    )
    swap = f"struct<id:{slim.schema['id'].dataType.simpleString()},size:bigint,step:int>"
    found = found.withColumns({f"swap{i}": none.cast(swap) for i in range(EXCHANGES)})
    found = written(found, "mix-cut1")
    most = int(cap)
    for i in range(EXCHANGES):
        rows = _same_source(slim, found, "inner").withColumn(
            "copies", _copies(F.col("id"), F.col("size"))
        )
        left = rows.groupBy("source").agg(
            (F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("left")
        )
        left = written(left, "mix-left")
        step = F.when(F.col("left") > 0, F.lit(1)).otherwise(F.lit(-1))
        gain = F.abs(F.col("left")) - F.abs(F.col("left") - step * F.col("size"))
        can = F.when(step > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
        best = (
            _same_source(rows, left, "inner")
            .filter(can & (gain > 0))
            .groupBy("source")
            .agg(
                F.max(
                    F.struct(
                        gain.alias("gain"),
                        F.xxhash64("id").alias("tie"),
                        F.struct("id", "size", step.cast("int").alias("step")).alias("swap"),
                    )
                ).alias("best")
            )
            .select("source", F.col("best.swap").alias("found"))
        )
        found = _same_source(found, best).withColumn(f"swap{i}", F.col("found").cast(swap)).drop("found")
        found = written(found, "mix-swap")
    return found


def apply_mix(df: DataFrame, fitted: DataFrame, key: str, size: Column, source: str) -> DataFrame:
    """``df`` with columns ``__m_*``: size, source_size, target, rate and copies of each row."""
    f = fitted.withColumnRenamed("source", "__m_source")
    f = f.select("__m_source", F.struct(*(c for c in f.columns if c != "__m_source")).alias("__m"))
    df = df.withColumn("__m_size", size)
    out = df.join(f, df[f"`{source}`"].eqNullSafe(f["__m_source"]), "left").drop("__m_source")
    names = fitted.columns
    flat = out.select(
        *(F.col(f"`{c}`") for c in df.columns),
        *(F.col(f"__m.{c}").alias(f"__m_{c}") for c in names if c != "source"),
    )
    # _copies speaks of the fitted columns by their own names
    inner = flat.select(
        F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__m_row"),
        F.col(f"`{key}`").alias("__m_id"),
        *(F.col(f"__m_{c}").alias(c) for c in names if c != "source"),
    )
    inner = inner.withColumn("copies", _copies(F.col("__m_id"), F.col("__m_row.__m_size")))
    return inner.select(
        *(F.col(f"__m_row.`{c}`").alias(c) for c in df.columns),
        F.col("source_size").alias("__m_source_size"),
        F.col("target").alias("__m_target"),
        tilted(F.col("__m_row.__m_size"), F.col("lambda"), F.col("cap")).alias("__m_rate"),
        F.col("copies").alias("__m_copies"),
    )


def slim_sizes(df: DataFrame, key="doc_id", text="text", source="source") -> DataFrame:
    """(id, source, size), read from the texts once and kept in the shared folder."""
    return written(
        df.select(
            F.col(f"`{key}`").alias("id"),
            F.col(f"`{source}`").alias("source"),
            word_count(F.col(f"`{text}`")).alias("size"),
        ),
        "mix-sizes",
    )


def mix(df: DataFrame, key="doc_id", text="text", source="source") -> DataFrame:
    """(key, size, source_size, target, taken, copies, rate) per row."""
    slim = slim_sizes(df, key, text, source)
    out = apply_mix(slim, fit(slim), "id", F.col("size"), "source")
    return out.select(
        F.col("id").alias(key),
        "size",
        F.col("__m_source_size").alias("source_size"),
        F.col("__m_target").alias("target"),
        (F.col("__m_copies") * F.col("size")).cast("long").alias("taken"),
        F.col("__m_copies").alias("copies"),
        F.col("__m_rate").alias("rate"),
    )


def mix_documents(df: DataFrame, key="doc_id", text="text", source="source") -> DataFrame:
    """Every document as often as the mix takes it, with its own columns only."""
    fitted = fit(slim_sizes(df, key, text, source))
    out = apply_mix(df, fitted, key, word_count(F.col(f"`{text}`")), source)
    out = out.withColumn("__m_copy", F.explode(F.array_repeat(F.lit(1), F.col("__m_copies"))))
    return out.select(*(F.col(f"`{c}`") for c in df.columns))

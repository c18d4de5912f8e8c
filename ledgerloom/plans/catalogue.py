"""The registered queries of the reconciliation and retrieval operators, and their DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sql, text
from ..operators import chunk, embed, evaluate, findings, ordering, reconcile, retrieve
from ..sources import ledger, statement, writers
from ..sources.durable import durable, shared
from ..sources.versions import Collection
from ..streaming import Matching, match_stream, rollup
from . import cases, derived

BOOK_COLUMNS = ["ord", "doc_type", "gstin", "number", "invoice_date", "taxable", "igst", "cgst", "sgst", "cess"]


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _reconciled(spark, sf_dir, keep=None, tol=0, without=(), **more):
    """The sides go from the lines to the match without a table or a shuffle between."""
    docs = derived.together(derived.shaped(spark, sf_dir, digits=True)).drop(*without)
    return reconcile.reconcile_together(docs, tol, keep, "digits", **more)


#: What the match itself does not look at.
UNMATCHED = ("itc", "period")
#: What the bridge and findings look at.
SUMMED = ("ord", "doc_type", "invoice_date", *reconcile.HEADS, "itc", "period")
FOUND_IN = (*SUMMED, "gstin")


def _results(spark, sf_dir, tol=0):
    got = _reconciled(spark, sf_dir, ("ord",), tol, UNMATCHED)[0]
    return got.select(
        F.col("b.ord").alias("b_ord"), F.col("g.ord").alias("g_ord"), "category", F.array_join("mismatches", ",").alias("mismatches")
    )


def _candidates(spark, sf_dir):
    docs = derived.together(derived.shaped(spark, sf_dir, digits=True)).drop(*UNMATCHED)
    docs = reconcile.numbered_copies(docs, "digits", "side").filter("copy_no = 1").drop("copy_no", "digits")
    # written, as each kind of candidate looks at both sides anew
    docs = durable(docs, "primaries")
    c = reconcile.candidates(*(docs.filter(F.col("side") == s).drop("side") for s in "bg"))
    return c.select(
        F.col("b.ord").alias("b_ord"), F.col("g.ord").alias("g_ord"), "category",
        F.array_join("mismatches", ",").alias("mismatches"), F.col("n_ok").cast("long").alias("n_ok"), F.round("similarity", 6).alias("similarity"),
    )


def _register(spark, sf_dir):
    r = findings.register(*_reconciled(spark, sf_dir, FOUND_IN))
    return r.select("b_ord", "g_ord", "code", "severity", "itc_at_risk")


def _by(column):
    def run(spark, sf_dir):
        return _register(spark, sf_dir).groupBy(column).agg(
            F.count("*").alias("n"), F.sum("itc_at_risk").cast("decimal(18,2)").alias("itc_at_risk")
        )

    return run


def _bridge(spark, sf_dir):
    r, mb, mg, *_ = _reconciled(spark, sf_dir, SUMMED)
    return findings.bridge(r, mb, mg)


def _variance(spark, sf_dir):
    r, mb, mg, b, g = _reconciled(spark, sf_dir, SUMMED)
    total = findings.bridge(r, mb, mg).agg(F.sum("amount").cast("decimal(18,2)").alias("lines"))
    t = findings.totals(b, g).crossJoin(total)
    variance = (F.col("books") + F.col("lines") - F.col("available")).cast("decimal(18,2)")
    return t.select("books", "available", "blocked", "lines", variance.alias("closing_variance"))


def _surplus(spark, sf_dir):
    b = derived.documents(spark, sf_dir, "books")
    return reconcile.numbered_copies(b).filter("copy_no > 1").select("ord", "number", F.col("copy_no").cast("long").alias("copy_no"))


def _labelled(spark, sf_dir):
    """(truth, (case_id, code) found, findings without a case) of the labelled cases."""
    made = durable(cases.labelled(spark, sf_dir), "cases")
    b, g = (durable(x, f"cases-{i}") for i, x in enumerate(cases.sides(made)))
    found = findings.register(*reconcile.reconcile_full(b, g), b, g, shown=True)
    found = findings.described(found, b, g).withColumn("case_id", evaluate.case_id(F.col("b.number"), F.col("g.number")))
    found = durable(found.select("case_id", "code", "evidence", "label"), "case-findings")
    return cases.truth(made), found.filter("case_id IS NOT NULL").select("case_id", "code"), found.filter("case_id IS NULL")


def _evaluation(spark, sf_dir):
    truth, actual, _ = _labelled(spark, sf_dir)
    return evaluate.by_code(truth, actual)


def _clean(spark, sf_dir):
    truth, actual, lost = _labelled(spark, sf_dir)
    n = lost.agg(F.count("*").alias("unrecovered"))
    return evaluate.clean(truth, actual).crossJoin(n)  # one row with one row


def _described(spark, sf_dir):
    full = _reconciled(spark, sf_dir)
    d = findings.described(findings.register(*full, shown=True), *full[3:])
    return d.select("b_ord", "g_ord", "label", "evidence")


def _written(spark, sf_dir, side):
    """The files of one side, written and read back."""
    docs = derived.documents(spark, sf_dir, side).drop("defect")
    folder = f"{shared(spark)}/samples-{uuid.uuid4().hex}/{side}"
    if side == "books":
        writers.write_ledgers(docs.withColumn("state", F.substring("gstin", 1, 2)), folder)
        return ledger.scan_ledgers(spark, folder)
    writers.write_statements(docs, folder)
    return statement.scan_statements(spark, folder)


def _ingested(side):
    def run(spark, sf_dir):
        return _written(spark, sf_dir, side).select(*[c for c in BOOK_COLUMNS if c != "ord"], "itc", "period", "problem")

    return run


def _statute_texts(spark, sf_dir):
    p = _read(spark, sf_dir, "part").withColumn(
        "r", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    )
    k = F.expr("(r - 1) DIV 7")
    heading = F.when((F.col("r") - 1) % 7 == 0, F.concat(F.lit("CHAPTER "), F.expr("repeat('X', CAST(1 + (r - 1) DIV 7 % 9 AS INT))"), F.lit("  OF PART "), k.cast("string"), F.lit(" \n")))
    line = F.concat(
        F.coalesce(heading, F.lit("")), F.lit(" "), (F.col("p_partkey") % 900 + 1).cast("string"), F.lit(". On "), "p_name",
        F.lit(".  - (1) The "), "p_type", F.lit("\tis  supplied.\n\n(2) Of size "), F.col("p_size").cast("string"), F.lit(".\n"),
    )
    docs = p.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("r", line.alias("line")))).alias("x"))
    return docs.select("p_brand", F.concat(F.lit("Contents\n"), F.array_join("x.line", "")).alias("text"))


def _statute(spark, sf_dir):
    docs = _statute_texts(spark, sf_dir)
    c = chunk.provisions(docs, "p_brand", "text")
    cite = chunk.citation(F.col("source_document"), F.col("section_number"), F.col("section_title"))
    return c.select("source_document", "chapter", "section_number", "section_title", "text", "part", cite.alias("citation"))


def _quotas(spark, sf_dir):
    """Cases of each code where a share of the orders is clean: equal, the first codes one more."""
    n = _read(spark, sf_dir, "orders").agg(F.count("*").alias("n"))
    codes = spark.createDataFrame([(i, c) for i, c in enumerate(findings.SEVERITY)], "i int, code string")
    return codes.crossJoin(n).select("code", F.expr("n DIV 12 + IF(i < n % 12, 1, 0)").cast("long").alias("quota"))


def _vouchers(spark, sf_dir):
    kinds = F.array(*(F.lit(x) for x in ("Purchase", " CREDIT Note", "Debit note", "Credit against debit", "")))
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.get(kinds, (F.col("o_orderkey") % 6).cast("int")).alias("v"))
    return o.select("o_orderkey", text.doc_type(F.col("v")).alias("doc_type"))


def _nested(spark, sf_dir):
    """Numbers of each supplier's documents in order, as one JSON text."""
    b = derived.documents(spark, sf_dir, "books")
    by = b.groupBy("gstin", "doc_type").agg(F.array_sort(F.collect_list(F.struct("ord", "number"))).alias("x"))
    return by.select("gstin", "doc_type", F.size("x").cast("long").alias("n"), F.md5(F.to_json("x.number")).alias("numbers_md5"))


def _tolerant(spark, sf_dir):
    return _results(spark, sf_dir, 5)


def _ordered_results(spark, sf_dir):
    r = ordering.ordered_results(_reconciled(spark, sf_dir, ("ord", "doc_type"), without=UNMATCHED, ranked=True)[0])
    return r.select("ordinal", F.col("b.ord").alias("b_ord"), F.col("g.ord").alias("g_ord"), "category", F.array_join("mismatches", ",").alias("mismatches"))


def _ordered_findings(spark, sf_dir):
    r, *more = _reconciled(spark, sf_dir, FOUND_IN, ranked=True, least=True)
    found = findings.register(ordering.with_place(r), *more).drop("severity", "itc_at_risk")
    return ordering.placed_findings(found).select("ordinal", "b_ord", "g_ord", "code")


def _sql_scalars(spark, sf_dir):
    """The scalar rules in SQL text over the documents of both sides."""
    sql.register(spark)
    sides = {s: derived.documents(spark, sf_dir, s).select("ord", "gstin", "number", "invoice_date", "taxable") for s in ("books", "statement")}
    return spark.sql(
        """SELECT b.ord, gstin_is_valid(b.gstin) AS valid, gstin_check_digit(norm_text(b.gstin)) AS digit, invoice_strict_key(b.number) AS strict,
          invoice_loose_key(b.number) AS loose, ledger_date(date_format(b.invoice_date, 'd-MMM-yy')) AS day,
          ledger_amount(concat('(₹ ', b.taxable, ')')) AS amount, expected_period(b.invoice_date) AS period,
          round(invoice_similarity(b.number, g.number), 6) AS number_similarity, round(gstin_similarity(b.gstin, g.gstin), 6) AS gstin_similarity
        FROM {books} b LEFT JOIN {statement} g ON b.ord = g.ord""",
        **sides,
    )


def _sql_headers(spark, sf_dir):
    """Headers of provisions by the table function, and the words of each in SQL text."""
    sql.register(spark)
    return spark.sql(
        """SELECT s.p_brand AS source_document, h.position, h.section_number, h.section_title,
          substr(h.opening, 1, 7) AS opening FROM {statutes} s, LATERAL provision_headers(s.text) h""",
        statutes=_statute_texts(spark, sf_dir),
    )


def _collected(spark, sf_dir):
    """A collection of all vectors, those of toxic documents put in anew with a mark, those of poor ones deleted."""
    e, labels = _read(spark, sf_dir, "embeddings").withColumn("mark", F.lit("first")), _read(spark, sf_dir, "labels")
    points = Collection(spark, f"{shared(spark)}/collection-{uuid.uuid4().hex}", "vec_id", "embedding")
    points.ensure(e.select(F.max(F.size("embedding"))).first()[0], 16)
    points.upsert(e)
    toxic = labels.filter("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    points.upsert(e.join(toxic, "vec_id", "left_semi").withColumn("mark", F.lit("anew")))
    got = points.delete(labels.filter("quality = 0").select(F.col("doc_id").alias("vec_id")))
    return got.select("vec_id", "mark", F.size("embedding").cast("long").alias("dimensions"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("x0"))


def _text_vectors(spark, sf_dir):
    v = embed.hashed(_read(spark, sf_dir, "documents"), "doc_id", "text")
    cells = v.select("doc_id", F.posexplode("vector").alias("bucket", "weight"))
    return cells.filter("weight > 0").select("doc_id", F.col("bucket").cast("long").alias("bucket"), F.round("weight", 6).alias("weight"))


def _streamed(spark, sf_dir):
    """Both sides arrive in three batches, dealt out by hash, and are matched as they do."""
    folder = f"{shared(spark)}/arrivals-{uuid.uuid4().hex}"
    sides = [derived.documents(spark, sf_dir, s).drop("defect").withColumn("side", F.lit(s)) for s in ("books", "statement")]
    both = sides[0].unionByName(sides[1])
    both.withColumn("wave", F.pmod(F.xxhash64("side", "ord"), F.lit(3))).repartition(3, "wave").drop("wave").write.parquet(f"{folder}/in")
    arriving = spark.readStream.schema(both.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    match_stream(arriving, f"{folder}/state", f"{folder}/log", 8).awaitTermination()
    got = Matching(spark, f"{folder}/state").results().filter("category <> 'SURPLUS'")
    return got.withColumn("mismatches", F.array_join("mismatches", ","))


def _daily(spark, sf_dir):
    """The rollup run as a stream over the file until it is read."""
    kinds = _read(spark, sf_dir, "events").schema
    source = spark.readStream.schema(kinds).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    folder = f"{shared(spark)}/stream-{uuid.uuid4().hex}"
    counted = rollup(source, "ts", "event_type", "value", late="3650 days")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    done = counted.writeStream.outputMode("complete").foreachBatch(keep)
    done.option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{folder}/out")
    return got.select(F.col("window_start").cast("date").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def _validity(spark, sf_dir):
    sides = [derived.documents(spark, sf_dir, s).select("gstin") for s in ("books", "statement")]
    b = sides[0].unionByName(sides[1]).distinct()
    return b.select("gstin", text.is_valid_gstin(F.col("gstin")).alias("valid"), text.check_digit(F.col("gstin")).alias("digit"))


def _keys(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit(" inv/00-"), F.col("o_orderkey"), F.lit(" ")).alias("n"))
    return o.select("o_orderkey", text.strict_key(F.col("n")).alias("strict"), text.loose_key(F.col("n")).alias("loose"))


def _amounts(spark, sf_dir):
    p = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("(₹ "), p, F.lit(")"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit(" 1,"), p)).otherwise("  ")
    return _read(spark, sf_dir, "orders").select("o_orderkey", text.parse_amount(raw).alias("amount"))


def _dates(spark, sf_dir):
    d = F.col("o_orderdate").cast("date")
    k = F.col("o_orderkey") % 6
    raw = F.date_format(d, "dd-MM-yyyy")
    for i, f in enumerate(("dd/MM/yyyy", "yyyy-MM-dd", "dd-MMM-yyyy", "dd-MMM-yy", "dd/MM/yy"), 1):
        raw = F.when(k == i, F.date_format(d, f)).otherwise(raw)
    return _read(spark, sf_dir, "orders").select("o_orderkey", text.parse_date(raw).alias("parsed"))


def _indel(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(text.indel_ratio(F.col("p_name"), F.col("p_type")), 6).alias("ratio"))


def _ids(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    key = F.concat_ws(":", "source", F.col("doc_id").cast("string"), F.lit("None"), F.substring(F.sha2("text", 256), 1, 16))
    return d.select("doc_id", text.point_id(key).alias("point_id"))


def _noise(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(text.drop_noise_lines(F.col("text"))).alias("clean_md5"))


def _marker(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    return d.select("doc_id", F.length(text.truncate_at_second(F.col("text"), "the")).cast("long").alias("n_chars"))


def _windows(spark, sf_dir):
    w = retrieve.windows(_read(spark, sf_dir, "documents"), "doc_id", "text")
    return w.select("doc_id", "part", F.md5("piece").alias("piece_md5"))


def _topk(floor):
    def run(spark, sf_dir):
        e = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
        return retrieve.top_k(e.filter("id % 100 = 0"), e, 5, floor)

    return run


def _rollup(spark, sf_dir):
    b = derived.documents(spark, sf_dir, "books")
    total = F.col("igst") + F.col("cgst") + F.col("sgst") + F.col("cess")
    return b.groupBy("gstin").agg(
        F.count("*").alias("n"), F.sum("taxable").cast("decimal(18,2)").alias("taxable"), F.sum(total).cast("decimal(18,2)").alias("tax")
    )


QUERIES = {
    "match_category_counts": lambda s, d: _results(s, d).groupBy("category").agg(F.count("*").alias("n")),
    "match_results": _results,
    "candidates": _candidates,
    "documents_books": lambda s, d: derived.documents(s, d, "books").select(*BOOK_COLUMNS),
    "documents_2b": lambda s, d: derived.documents(s, d, "statement").select(*BOOK_COLUMNS, "itc", "period"),
    "dedup_surplus": _surplus,
    "orphans_books": lambda s, d: _results(s, d).filter("category = 'IN_BOOKS_NOT_2B'").select("b_ord"),
    "orphans_2b": lambda s, d: _results(s, d).filter("category = 'IN_2B_NOT_BOOKS'").select("g_ord"),
    "finding_register": _register,
    "findings_by_code": _by("code"),
    "findings_by_severity": _by("severity"),
    "itc_bridge": _bridge,
    "bridge_variance": _variance,
    "supplier_rollup": _rollup,
    "eval_precision_recall": _evaluation,
    "gstin_validity": _validity,
    "invoice_keys": _keys,
    "parse_amounts": _amounts,
    "parse_dates": _dates,
    "indel_similarity": _indel,
    "chunk_ids": _ids,
    "noise_lines": _noise,
    "truncate_marker": _marker,
    "chunk_windows": _windows,
    "vector_topk": _topk(None),
    "vector_floor": _topk(retrieve.FLOOR),
    "eval_clean_cases": _clean,
    "finding_texts": _described,
    "ingest_books": _ingested("books"),
    "ingest_statements": _ingested("statement"),
    "statute_chunks": _statute,
    "plan_quotas": _quotas,
    "voucher_types": _vouchers,
    "supplier_nested": _nested,
    "tolerance_results": _tolerant,
    "event_rollup": _daily,
    "stream_results": _streamed,
    "ordered_results": _ordered_results,
    "ordered_findings": _ordered_findings,
    "sql_scalars": _sql_scalars,
    "sql_headers": _sql_headers,
    "collection_versions": _collected,
    "text_vectors": _text_vectors,
}


# ---- DuckDB twins -----------------------------------------------------------


def _digit(g: str) -> str:
    a = text.ALPHABET
    v = f"((instr('{a}', substr({g}, i, 1)) - 1) * (CASE WHEN i % 2 = 1 THEN 1 ELSE 2 END))"
    total = f"list_sum(list_transform(generate_series(1, 14), lambda i: {v} // 36 + {v} % 36))"
    return f"substr('{a}', CAST(1 + (36 - {total} % 36) % 36 AS BIGINT), 1)"


def _lcs_ratio(a: str, b: str) -> str:
    zeros = f"list_transform(generate_series(0, length({b})), lambda z: CAST(0 AS BIGINT))"
    cell = f"CASE WHEN substr({a}, i, 1) = substr({b}, j, 1) THEN prev[j] + 1 ELSE greatest(prev[j + 1], cur[j]) END"
    row = f"list_reduce(generate_series(1, length({b})), lambda cur, j: list_append(cur, {cell}), [CAST(0 AS BIGINT)])"
    lcs = f"list_reduce(generate_series(1, length({a})), lambda prev, i: {row}, {zeros})[length({b}) + 1]"
    return f"(CASE WHEN {a} = {b} THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * {lcs} / (length({a}) + length({b})) END)"


def _folded() -> str:
    """The pairs of a group that commit, best first, each document once."""
    return """list_reduce(list({'e': [[b_ord, g_ord]], 'mb': [b_ord], 'mg': [g_ord]} ORDER BY r), lambda acc, x:
    CASE WHEN list_contains(acc.mb, x.mb[1]) OR list_contains(acc.mg, x.mg[1]) THEN acc
    ELSE {'e': list_concat(acc.e, x.e), 'mb': list_concat(acc.mb, x.mb), 'mg': list_concat(acc.mg, x.mg)} END).e"""


def _with(final: str, tol: int = 0) -> str:
    s = derived.sides()
    heads = ("igst", "cgst", "sgst", "cess")
    near = lambda c: f"abs(b.{c} - g.{c}) <= {tol}" if tol else f"b.{c} = g.{c}"
    values = " AND ".join(near(c) for c in ("taxable", "total", *heads))
    heads_near = " AND ".join(near(c) for c in heads)
    key = "partition by upper(trim(gstin)), doc_type, upper(trim(number)) order by ord"
    return f"""
WITH base AS ({derived.BASE}), who AS ({derived.suppliers(_digit)}), shaped AS ({derived.SHAPED}), books AS ({s["books"]}), statement AS ({s["statement"]}),
bk AS (SELECT *, igst + cgst + sgst + cess AS total, row_number() OVER ({key}) AS copy_no, regexp_replace(number, '[^A-Z0-9]', '', 'g') AS loose FROM books),
gk AS (SELECT *, igst + cgst + sgst + cess AS total, row_number() OVER ({key}) AS copy_no, regexp_replace(number, '[^A-Z0-9]', '', 'g') AS loose FROM statement),
b1 AS (SELECT * FROM bk WHERE copy_no = 1), g1 AS (SELECT * FROM gk WHERE copy_no = 1),
pairs AS (SELECT b, g FROM b1 b JOIN g1 g ON b.doc_type = g.doc_type AND b.gstin = g.gstin AND b.invoice_date = g.invoice_date
  UNION ALL SELECT b, g FROM b1 b JOIN g1 g ON b.doc_type = g.doc_type AND b.gstin = g.gstin AND {values} AND b.invoice_date <> g.invoice_date),
scored AS (SELECT b, g, CASE WHEN b.number = g.number THEN 100.0::DOUBLE ELSE {_lcs_ratio("b.loose", "g.loose")} END AS nsim FROM pairs),
checked AS (SELECT b, g, nsim, (b.number = g.number OR nsim >= 88) AS nok, b.invoice_date = g.invoice_date AS dok,
  list_filter([CASE WHEN NOT (b.number = g.number OR nsim >= 88) THEN 'doc_number' END, CASE WHEN b.invoice_date <> g.invoice_date THEN 'document_date' END,
    CASE WHEN NOT ({near('taxable')}) THEN 'taxable_value' END, CASE WHEN NOT ({near('total')}) THEN 'total_tax' END,
    CASE WHEN NOT ({heads_near}) THEN 'head_wise' END], lambda x: x IS NOT NULL) AS wrong FROM scored),
anchored AS (SELECT b, g, CASE WHEN len(wrong) = 0 THEN 'EXACT' WHEN NOT nok AND NOT dok THEN NULL WHEN len(wrong) = 1 THEN 'PARTIAL'
    WHEN nok AND dok THEN 'UNMATCHED' END AS category, array_to_string(wrong, ',') AS mismatches, 5 - len(wrong) AS n_ok, nsim + 100 AS similarity FROM checked),
relaxed AS (SELECT b, g, {_lcs_ratio("b.gstin", "g.gstin")} AS gsim FROM b1 b JOIN g1 g ON b.doc_type = g.doc_type AND b.number = g.number
    AND b.invoice_date = g.invoice_date AND b.gstin <> g.gstin AND {values}),
cands AS MATERIALIZED (SELECT b.ord AS b_ord, g.ord AS g_ord, b.doc_type AS doc_type, b.gstin AS gstin, b.number AS number, b.invoice_date AS invoice_date,
    category, mismatches, n_ok, similarity FROM anchored WHERE category IS NOT NULL
  UNION ALL SELECT b.ord, g.ord, b.doc_type, b.gstin, b.number, b.invoice_date, 'PROBABLE', 'gstin', 5, gsim + 100 FROM relaxed WHERE gsim >= 85),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY CASE category WHEN 'EXACT' THEN 0 WHEN 'PARTIAL' THEN 1 WHEN 'UNMATCHED' THEN 2 ELSE 3 END, -n_ok, -similarity, b_ord, g_ord) AS r FROM cands),
first_won AS MATERIALIZED (SELECT x[1] AS wb, x[2] AS wg FROM (SELECT unnest({_folded()}) AS x FROM ranked WHERE category <> 'PROBABLE' GROUP BY doc_type, gstin)),
rest AS (SELECT * FROM ranked ANTI JOIN first_won f ON b_ord = f.wb ANTI JOIN first_won h ON g_ord = h.wg WHERE category = 'PROBABLE'),
won AS MATERIALIZED (SELECT * FROM first_won UNION ALL SELECT x[1], x[2] FROM (SELECT unnest({_folded()}) AS x FROM rest GROUP BY doc_type, number, invoice_date)),
outcome AS MATERIALIZED (SELECT b_ord, g_ord, category, mismatches FROM cands JOIN won ON b_ord = wb AND g_ord = wg
  UNION ALL SELECT ord, NULL, 'IN_BOOKS_NOT_2B', '' FROM b1 ANTI JOIN won ON ord = wb
  UNION ALL SELECT NULL, ord, 'IN_2B_NOT_BOOKS', '' FROM g1 ANTI JOIN won ON ord = wg),
results AS (SELECT b, g, category, mismatches FROM outcome LEFT JOIN b1 b ON b.ord = b_ord LEFT JOIN g1 g ON g.ord = g_ord),
register AS (
  SELECT b.ord AS b_ord, g.ord AS g_ord, 'EX-01' AS code, b.total AS itc_at_risk FROM results WHERE category = 'IN_BOOKS_NOT_2B' AND b.doc_type <> 'credit_note'
  UNION ALL SELECT b.ord, g.ord, 'EX-12', 0 FROM results WHERE category = 'IN_BOOKS_NOT_2B' AND b.doc_type = 'credit_note'
  UNION ALL SELECT b.ord, g.ord, 'EX-02', 0 FROM results WHERE category = 'IN_2B_NOT_BOOKS' AND g.doc_type <> 'credit_note'
  UNION ALL SELECT b.ord, g.ord, 'EX-11', g.total FROM results WHERE category = 'IN_2B_NOT_BOOKS' AND g.doc_type = 'credit_note'
  UNION ALL SELECT b.ord, g.ord, 'EX-06', 0 FROM results WHERE mismatches = 'gstin'
  UNION ALL SELECT b.ord, g.ord, 'EX-03', 0 FROM results WHERE contains(mismatches, 'taxable_value')
  UNION ALL SELECT b.ord, g.ord, 'EX-04', abs(b.total - g.total) FROM results WHERE contains(mismatches, 'total_tax')
  UNION ALL SELECT b.ord, g.ord, 'EX-05', 0 FROM results WHERE contains(mismatches, 'head_wise') AND NOT contains(mismatches, 'total_tax')
  UNION ALL SELECT b.ord, g.ord, 'EX-07', 0 FROM results WHERE contains(mismatches, 'doc_number')
  UNION ALL SELECT b.ord, g.ord, 'EX-09', b.total FROM results WHERE b.ord IS NOT NULL AND g.itc = 'N' AND b.doc_type <> 'credit_note'
  UNION ALL SELECT b.ord, g.ord, 'EX-08', 0 FROM results WHERE b.ord IS NOT NULL AND g.period <> strftime(g.invoice_date, '%m%Y')
  UNION ALL SELECT ord, NULL, 'EX-10', total FROM bk WHERE copy_no > 1 UNION ALL SELECT NULL, ord, 'EX-10', total FROM gk WHERE copy_no > 1
  UNION ALL SELECT ord, NULL, 'EX-06', CASE WHEN doc_type = 'credit_note' THEN 0 ELSE total END FROM bk WHERE gstin IN (SELECT bad FROM who)
  UNION ALL SELECT NULL, ord, 'EX-06', CASE WHEN doc_type = 'credit_note' THEN 0 ELSE total END FROM gk WHERE gstin IN (SELECT bad FROM who)),
named AS (SELECT b_ord, g_ord, code, CASE WHEN code IN ('EX-02', 'EX-07', 'EX-08', 'EX-12') THEN 'low' WHEN code IN ('EX-03', 'EX-05') THEN 'medium' ELSE 'high' END AS severity,
  CAST(itc_at_risk AS DECIMAL(18,2)) AS itc_at_risk FROM register),
signed AS (SELECT 'books_only' AS line, CASE WHEN b.doc_type = 'credit_note' THEN b.total ELSE -b.total END AS amount FROM results WHERE category = 'IN_BOOKS_NOT_2B'
  UNION ALL SELECT '2b_only', CASE WHEN g.itc = 'N' THEN 0 WHEN g.doc_type = 'credit_note' THEN -g.total ELSE g.total END FROM results WHERE category = 'IN_2B_NOT_BOOKS'
  UNION ALL SELECT 'matched', CASE WHEN g.itc = 'N' THEN 0 WHEN g.doc_type = 'credit_note' THEN -g.total ELSE g.total END
     - CASE WHEN b.doc_type = 'credit_note' THEN -b.total ELSE b.total END FROM results WHERE b.ord IS NOT NULL AND g.ord IS NOT NULL
  UNION ALL SELECT 'books_duplicates', CASE WHEN doc_type = 'credit_note' THEN total ELSE -total END FROM bk WHERE copy_no > 1
  UNION ALL SELECT '2b_duplicates', CASE WHEN itc = 'N' THEN 0 WHEN doc_type = 'credit_note' THEN -total ELSE total END FROM gk WHERE copy_no > 1),
lines AS (SELECT line, count(amount) AS n, CAST(coalesce(sum(amount), 0) AS DECIMAL(18,2)) AS amount
  FROM (SELECT unnest(['books_only', 'books_duplicates', '2b_only', '2b_duplicates', 'matched']) AS line) LEFT JOIN signed USING (line) GROUP BY line)
{final}"""


_TOPK = """
WITH p AS (SELECT q.vec_id AS query_id, x.vec_id AS point_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q, embeddings x WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank, point_id, score FROM p {} QUALIFY rank <= 5"""

_TEXTS = """SELECT b_ord, g_ord, code || ': ' || CASE code WHEN 'EX-01' THEN 'In books, not in GSTR-2B' WHEN 'EX-02' THEN 'In GSTR-2B, not in books'
  WHEN 'EX-03' THEN 'Taxable value mismatch' WHEN 'EX-04' THEN 'Tax amount mismatch' WHEN 'EX-05' THEN 'Tax head mismatch (total agrees, head-wise split doesn''t)'
  WHEN 'EX-06' THEN 'GSTIN invalid or mismatched' || CASE WHEN b_ord IS NULL OR g_ord IS NULL THEN ' (structurally invalid GSTIN)' ELSE '' END
  WHEN 'EX-07' THEN 'Invoice number variance' WHEN 'EX-08' THEN 'Period timing difference' WHEN 'EX-09' THEN 'ITC flagged unavailable in 2B but claimed in books'
  WHEN 'EX-10' THEN 'Duplicate booking' WHEN 'EX-11' THEN 'Credit note in 2B with no reversal in books' ELSE 'Credit note booked but not yet reflected in 2B' END AS label,
  CASE WHEN code IN ('EX-01', 'EX-12') THEN 'books=' || b_ord WHEN code IN ('EX-02', 'EX-11') THEN 'gstr2b=' || g_ord
  WHEN code = 'EX-06' AND b_ord IS NOT NULL AND g_ord IS NOT NULL THEN b.gstin || ' vs ' || g.gstin
  WHEN code = 'EX-06' THEN 'invalid_gstin=' || chr(39) || coalesce(b.gstin, g.gstin) || chr(39) || ' at ' || coalesce(b_ord, g_ord)
  WHEN code = 'EX-03' THEN b.taxable || ' vs ' || g.taxable WHEN code = 'EX-04' THEN b.total || ' vs ' || g.total
  WHEN code = 'EX-05' THEN concat_ws('/', b.igst, b.cgst, b.sgst, b.cess) || ' vs ' || concat_ws('/', g.igst, g.cgst, g.sgst, g.cess)
  WHEN code = 'EX-07' THEN b.number || ' vs ' || g.number WHEN code = 'EX-08' THEN 'invoice month=' || strftime(g.invoice_date, '%m%Y') || ' return_period=' || g.period
  WHEN code = 'EX-09' THEN '2b itc_availability=N for ' || g_ord
  ELSE 'duplicate of ' || concat_ws('|', coalesce(b.gstin, g.gstin), coalesce(b.doc_type, g.doc_type), coalesce(b.number, g.number)) || ' at ' || coalesce(b_ord, g_ord) END AS evidence
FROM named LEFT JOIN bk b ON b.ord = b_ord LEFT JOIN gk g ON g.ord = g_ord"""

_STATUTE = """
WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
h AS (SELECT *, (r - 1) // 7 AS k, r // 7 AS k2, CAST(p_partkey % 900 + 1 AS STRING) AS number FROM p)
SELECT p_brand AS source_document, 'Chapter ' || repeat('X', CAST(1 + k % 9 AS BIGINT)) || ': OF PART ' || k AS chapter, number AS section_number,
  'On ' || p_name AS section_title, 'On ' || p_name || '. (1) The ' || p_type || ' is supplied.' || chr(10) || chr(10) || '(2) Of size ' || p_size || '.'
  || CASE WHEN r % 7 = 0 AND r < n THEN chr(10) || 'CHAPTER ' || repeat('X', CAST(1 + k2 % 9 AS BIGINT)) || ' OF PART ' || k2 ELSE '' END AS text,
  CAST(NULL AS INTEGER) AS part, p_brand || ', Section ' || number || ' (On ' || p_name || ')' AS citation FROM h"""

_PLACED = """placed AS (SELECT row_number() OVER (ORDER BY coalesce(b.doc_type, g.doc_type), CASE o.category WHEN 'IN_BOOKS_NOT_2B' THEN 1 WHEN 'IN_2B_NOT_BOOKS' THEN 2 ELSE 0 END,
    r, o.b_ord, o.g_ord) - 1 AS ordinal, o.* FROM outcome o LEFT JOIN ranked k ON k.b_ord = o.b_ord AND k.g_ord = o.g_ord LEFT JOIN b1 b ON b.ord = o.b_ord LEFT JOIN g1 g ON g.ord = o.g_ord)"""

_EMITTED = f"""SELECT row_number() OVER (ORDER BY stage, k1, step, b_ord, g_ord) - 1 AS ordinal, b_ord, g_ord, code FROM (
  SELECT n.b_ord, n.g_ord, n.code, CASE WHEN n.code = 'EX-10' THEN CASE WHEN n.g_ord IS NULL THEN 1 ELSE 2 END
      WHEN n.code = 'EX-06' AND n.g_ord IS NULL THEN 3 WHEN n.code = 'EX-06' AND n.b_ord IS NULL THEN 4 ELSE 0 END AS stage,
    CASE stage WHEN 0 THEN p.ordinal WHEN 1 THEN fb.f WHEN 2 THEN fg.f ELSE coalesce(n.b_ord, n.g_ord) END AS k1,
    list_position(['EX-06', 'EX-03', 'EX-04', 'EX-05', 'EX-07', 'EX-09', 'EX-08'], n.code) AS step
  FROM named n LEFT JOIN placed p ON p.b_ord IS NOT DISTINCT FROM n.b_ord AND p.g_ord IS NOT DISTINCT FROM n.g_ord
  LEFT JOIN (SELECT ord, min(ord) OVER (PARTITION BY upper(trim(gstin)), doc_type, upper(trim(number))) AS f FROM books) fb ON fb.ord = n.b_ord
  LEFT JOIN (SELECT ord, min(ord) OVER (PARTITION BY upper(trim(gstin)), doc_type, upper(trim(number))) AS f FROM statement) fg ON fg.ord = n.g_ord)"""


def _and(ctes: str, final: str) -> str:
    """``_with`` with more common tables before its last query."""
    head = _with("")
    return f"{head.rstrip()},\n{ctes}\n{final}"


ORACLES = {
    "match_category_counts": _with("SELECT category, count(*) AS n FROM outcome GROUP BY 1"),
    "match_results": _with("SELECT b_ord, g_ord, category, mismatches FROM outcome"),
    "candidates": _with("SELECT b_ord, g_ord, category, mismatches, CAST(n_ok AS BIGINT) AS n_ok, round(similarity, 6) AS similarity FROM cands"),
    "documents_books": _with(f"SELECT {', '.join(BOOK_COLUMNS)} FROM books"),
    "documents_2b": _with(f"SELECT {', '.join(BOOK_COLUMNS)}, itc, period FROM statement"),
    "dedup_surplus": _with("SELECT ord, number, copy_no FROM bk WHERE copy_no > 1"),
    "orphans_books": _with("SELECT b_ord FROM outcome WHERE category = 'IN_BOOKS_NOT_2B'"),
    "orphans_2b": _with("SELECT g_ord FROM outcome WHERE category = 'IN_2B_NOT_BOOKS'"),
    "finding_register": _with("SELECT * FROM named"),
    "findings_by_code": _with("SELECT code, count(*) AS n, CAST(sum(itc_at_risk) AS DECIMAL(18,2)) AS itc_at_risk FROM named GROUP BY 1"),
    "findings_by_severity": _with("SELECT severity, count(*) AS n, CAST(sum(itc_at_risk) AS DECIMAL(18,2)) AS itc_at_risk FROM named GROUP BY 1"),
    "itc_bridge": _with("SELECT line, n, amount FROM lines"),
    "bridge_variance": _with(
        "SELECT books, available, blocked, (SELECT CAST(sum(amount) AS DECIMAL(18,2)) FROM lines) AS lines, CAST(0 AS DECIMAL(18,2)) AS closing_variance FROM "
        "(SELECT CAST(sum(CASE WHEN doc_type = 'credit_note' THEN -total ELSE total END) AS DECIMAL(18,2)) AS books FROM bk), "
        "(SELECT CAST(sum(CASE WHEN itc = 'N' THEN 0 WHEN doc_type = 'credit_note' THEN -total ELSE total END) AS DECIMAL(18,2)) AS available, "
        "CAST(sum(CASE WHEN itc = 'N' THEN total ELSE 0 END) AS DECIMAL(18,2)) AS blocked FROM gk)"
    ),
    "supplier_rollup": _with("SELECT gstin, count(*) AS n, CAST(sum(taxable) AS DECIMAL(18,2)) AS taxable, CAST(sum(total) AS DECIMAL(18,2)) AS tax FROM bk GROUP BY 1"),
    "eval_precision_recall": f"SELECT 'EX-' || lpad(CAST(code AS STRING), 2, '0') AS code, count(*) AS tp, CAST(0 AS BIGINT) AS fp, CAST(0 AS BIGINT) AS fn, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1 FROM (SELECT CASE WHEN o_orderkey % 18 = 13 THEN 6 ELSE o_orderkey % 18 END AS code FROM orders) WHERE code BETWEEN 1 AND 12 GROUP BY 1",
    "eval_clean_cases": "SELECT count(*) AS clean_cases, CAST(0 AS BIGINT) AS false_positives, CAST(0 AS BIGINT) AS unrecovered FROM orders WHERE o_orderkey % 18 NOT BETWEEN 1 AND 13",
    "finding_texts": _with(_TEXTS),
    "ingest_books": _with(f"SELECT {', '.join(c for c in BOOK_COLUMNS if c != 'ord')}, CAST(NULL AS STRING) AS itc, CAST(NULL AS STRING) AS period, CAST(NULL AS STRING) AS problem FROM books"),
    "ingest_statements": _with(f"SELECT {', '.join(c for c in BOOK_COLUMNS if c != 'ord')}, itc, period, CAST(NULL AS STRING) AS problem FROM statement"),
    "statute_chunks": _STATUTE,
    "plan_quotas": "SELECT 'EX-' || lpad(CAST(i AS STRING), 2, '0') AS code, (SELECT count(*) FROM orders) // 12 + CASE WHEN i <= (SELECT count(*) FROM orders) % 12 THEN 1 ELSE 0 END AS quota FROM range(1, 13) t(i)",
    "voucher_types": "SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (1, 3) THEN 'credit_note' WHEN o_orderkey % 6 = 2 THEN 'debit_note' ELSE 'invoice' END AS doc_type FROM orders",
    "supplier_nested": _with("SELECT gstin, doc_type, count(*) AS n, md5('[' || string_agg('\"' || number || '\"', ',' ORDER BY ord, number) || ']') AS numbers_md5 FROM books GROUP BY 1, 2"),
    "ordered_results": _and(_PLACED, "SELECT ordinal, b_ord, g_ord, category, mismatches FROM placed"),
    "ordered_findings": _and(_PLACED, _EMITTED),
    "sql_scalars": _with(f"""SELECT b.ord, {_digit('b.gstin')} = substr(b.gstin, 15, 1) AS valid, {_digit('b.gstin')} AS digit, upper(trim(b.number)) AS strict, b.loose,
      CAST(b.invoice_date AS DATE) AS day, CAST(-b.taxable AS DECIMAL(18,2)) AS amount, strftime(b.invoice_date, '%m%Y') AS period,
      CASE WHEN g.ord IS NOT NULL THEN round({_lcs_ratio('b.loose', 'g.loose')}, 6) END AS number_similarity,
      CASE WHEN g.ord IS NOT NULL THEN round({_lcs_ratio('b.gstin', 'g.gstin')}, 6) END AS gstin_similarity FROM bk b LEFT JOIN gk g ON b.ord = g.ord"""),
    "sql_headers": """SELECT p_brand AS source_document, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS position, CAST(p_partkey % 900 + 1 AS STRING) AS section_number,
      'On ' || p_name AS section_title, '(1) The' AS opening FROM part""",
    "collection_versions": """SELECT vec_id, CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = vec_id AND l.toxic = 1) THEN 'anew' ELSE 'first' END AS mark,
      len(embedding) AS dimensions, round(CAST(embedding[1] AS DOUBLE), 6) AS x0 FROM embeddings WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = vec_id AND l.quality = 0)""",
    "text_vectors": """WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS w FROM documents),
      c AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 4) AS BIGINT) % 64 AS bucket, count(*) AS n FROM w WHERE w <> '' GROUP BY 1, 2)
      SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM c""",
    "stream_results": _with("SELECT b_ord, g_ord, category, mismatches FROM outcome"),
    "tolerance_results": _with("SELECT b_ord, g_ord, category, mismatches FROM outcome", 5),
    "event_rollup": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "gstin_validity": _with(f"SELECT DISTINCT gstin, {_digit('gstin')} = substr(gstin, 15, 1) AS valid, {_digit('gstin')} AS digit FROM (SELECT gstin FROM books UNION ALL SELECT gstin FROM statement)"),
    "invoice_keys": "SELECT o_orderkey, 'INV/00-' || o_orderkey AS strict, 'INV00' || o_orderkey AS loose FROM orders",
    "parse_amounts": "SELECT o_orderkey, CAST(CASE o_orderkey % 3 WHEN 0 THEN -CAST(o_totalprice AS DECIMAL(18,2)) WHEN 1 THEN CAST('1' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS DECIMAL(18,2)) ELSE 0 END AS DECIMAL(18,2)) AS amount FROM orders",
    "parse_dates": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS parsed FROM orders",
    "indel_similarity": f"SELECT p_partkey, round({_lcs_ratio('p_name', 'p_type')}, 6) AS ratio FROM part",
    "chunk_ids": """WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(concat_ws(':', source, CAST(doc_id AS STRING), 'None', substr(sha256(text), 1, 16)))) AS h FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(1 + (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 AS BIGINT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h""",
    "noise_lines": r"SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda s: NOT regexp_matches(s, '^\s*([0-9]{1,4}|Page [0-9]+ of [0-9]+)\s*$')), chr(10))) AS clean_md5 FROM documents",
    "truncate_marker": "SELECT doc_id, CASE WHEN instr(text, 'the') > 0 AND instr(substr(text, instr(text, 'the') + 3), 'the') > 0 THEN instr(text, 'the') + 1 + instr(substr(text, instr(text, 'the') + 3), 'the') ELSE length(text) END AS n_chars FROM documents",
    "chunk_windows": "SELECT doc_id, CAST(NULL AS BIGINT) AS part, md5(text) AS piece_md5 FROM documents WHERE length(text) <= 6000 UNION ALL SELECT doc_id, s // 5500 + 1, md5(substr(text, s + 1, 6000)) FROM (SELECT doc_id, text, unnest(range(0, length(text), 5500)) AS s FROM documents WHERE length(text) > 6000)",
    "vector_topk": _TOPK.format(""),
    "vector_floor": _TOPK.format("WHERE score >= 0.3"),
}

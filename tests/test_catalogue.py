from ledgerloom.functions.text import check_digit_sql
from ledgerloom.plans import catalogue, derived

SMALL = "/root/testdata/sf0.001"


def test_an_ingest_query_writes_the_side_it_reads_and_no_other(monkeypatch):
    wrote = []
    monkeypatch.setattr(catalogue, "shared", lambda spark: "/nowhere")
    monkeypatch.setattr(catalogue.derived, "documents", lambda spark, sf_dir, side: _Docs())
    monkeypatch.setattr(catalogue.F, "substring", lambda *a: None)
    monkeypatch.setattr(catalogue.F, "col", lambda c: None)
    monkeypatch.setattr(catalogue.writers, "write_ledgers", lambda docs, path: wrote.append("books"))
    monkeypatch.setattr(catalogue.writers, "write_statements", lambda docs, path: wrote.append("statement"))
    monkeypatch.setattr(catalogue.ledger, "scan_ledgers", lambda spark, path: _Docs())
    monkeypatch.setattr(catalogue.statement, "scan_statements", lambda spark, path: _Docs())
    catalogue.QUERIES["ingest_books"](None, "")
    assert wrote == ["books"]
    catalogue.QUERIES["ingest_statements"](None, "")
    assert wrote == ["books", "statement"]


class _Docs:
    def drop(self, *a):
        return self

    def withColumn(self, *a):
        return self

    def select(self, *a):
        return self


def test_what_follows_from_keys_is_not_shuffled_to_the_suppliers(spark):
    made = derived.shaped(spark, SMALL)
    lines = made._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, x in enumerate(lines) if "Join Inner" in x and "s_suppkey" in x or "Join Inner" in x and "w_key" in x)
    below = "\n".join(lines[at + 1 :])
    assert "stem#" not in below and "defect#" not in below


def test_both_sides_are_made_of_the_same_rows_as_by_the_sql(spark):
    for t in derived.TABLES:
        spark.read.parquet(f"{SMALL}/{t}.parquet").createOrReplaceTempView(t)
    spark.sql(derived.BASE).createOrReplaceTempView("base")
    spark.sql(derived.suppliers(check_digit_sql)).createOrReplaceTempView("who")
    plain, made = spark.sql(derived.SHAPED), derived.shaped(spark, SMALL)
    assert made.schema == plain.schema and made.count() > 1000
    assert made.exceptAll(plain).isEmpty() and plain.exceptAll(made).isEmpty()


def test_candidates_do_not_look_for_copies_again(spark):
    asked = []
    seen, catalogue.durable = catalogue.durable, lambda df, label: asked.append(df) or seen(df, label)
    try:
        got = catalogue.QUERIES["candidates"](spark, SMALL)
    finally:
        catalogue.durable = seen
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "lineitem" not in plan
    # the copies are found where the sums are made
    (made,) = asked
    plan = made._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("HashAggregate")]
    assert plan.count("Window") >= 1 and "Exchange hashpartitioning" not in above

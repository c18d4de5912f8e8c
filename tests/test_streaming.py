import random

import pytest
from pyspark.sql import functions as F
from test_reconcile import SCHEMA, docs

from ledgerloom.operators import reconcile
from ledgerloom.sources.versions import Collection
from ledgerloom.streaming import Matching, match_stream


def rows_of(df):
    return sorted((repr(r["b_ord"]), repr(r["g_ord"]), r["category"], tuple(r["mismatches"])) for r in df.collect())


def arrivals(spark, n=24):
    rnd = random.Random(11)
    b, g = (spark.createDataFrame(docs(rnd, n, k), SCHEMA) for k in (0, 1000))
    full, more_b, more_g = reconcile.reconcile_full(b, g)
    want = full.select(F.col("b.ord").alias("b_ord"), F.col("g.ord").alias("g_ord"), "category", "mismatches")
    surplus = len({*[r.ord for r in more_b.collect()], *[r.ord for r in more_g.collect()]})
    both = b.withColumn("side", F.lit("books")).unionByName(g.withColumn("side", F.lit("statement")))
    return both.collect(), both.schema, rows_of(want), surplus


def test_any_order_of_arrival_gives_the_batch_result(spark, tmp_path):
    rows, schema, want, surplus = arrivals(spark)
    for seed in (1, 2):
        order = rows[:]
        random.Random(seed).shuffle(order)
        m = Matching(spark, str(tmp_path / f"s{seed}"), buckets=4)
        for i, lo in enumerate(range(0, len(order), 25)):
            m.update(spark.createDataFrame(order[lo : lo + 25], schema), i)
        got = m.results()
        assert rows_of(got.filter("category <> 'SURPLUS'")) == want
        assert got.filter("category = 'SURPLUS'").count() == surplus


def test_a_restarted_batch_changes_nothing(spark, tmp_path, monkeypatch):
    rows, schema, want, _ = arrivals(spark, 12)
    df = spark.createDataFrame(rows, schema).repartition(3)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state, log = str(tmp_path / "state"), str(tmp_path / "log")
    committed, commit = [], Matching(spark, state).state.__class__.commit

    def failing(self, base, changes, **said):
        committed.append(said)
        if len(committed) == 2:
            raise OSError("lost")
        return commit(self, base, changes, **said)

    monkeypatch.setattr(Matching(spark, state).state.__class__, "commit", failing)
    with pytest.raises(Exception):
        match_stream(stream, state, log, 4).awaitTermination()
    before = rows_of(Matching(spark, state).results())
    match_stream(stream, state, log, 4).awaitTermination()
    m = Matching(spark, state, 4)
    assert rows_of(m.results().filter("category <> 'SURPLUS'")) == want and rows_of(m.results()) != before
    version = m.state.current()["version"]
    m.update(df, 0)  # a batch that is there already
    assert m.state.current()["version"] == version


def test_a_batch_without_sides_is_refused(spark, tmp_path):
    rows, schema, *_ = arrivals(spark, 2)
    with pytest.raises(ValueError):
        Matching(spark, str(tmp_path / "s")).update(spark.createDataFrame(rows, schema).withColumn("side", F.lit("x")), 0)
    assert Matching(spark, str(tmp_path / "s")).results().count() == 0


POINT = "point_id string, vector array<double>, title string"


def points(spark, *rows):
    return spark.createDataFrame(list(rows), POINT)


def test_an_upsert_touches_its_buckets_only(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"))
    c.ensure(2, buckets=16)
    c.upsert(points(spark, *((f"p{i}", [1.0, float(i)], "x") for i in range(200))))
    before = c.versions.current()["tables"]["points"]["buckets"]
    got = c.upsert(points(spark, ("p7", [0.0, 0.0], "a"), ("p7", [0.0, 0.0], "b"), ("new", [5.0, 5.0], None)))
    after = c.versions.current()["tables"]["points"]["buckets"]
    assert sum(before[b] != after[b] for b in after) <= 2
    table = {r.point_id: (r.vector, r.title) for r in got.collect()}
    assert len(table) == 201 and table["p7"] == ([0.0, 0.0], "b") and table["p8"] == ([1.0, 8.0], "x")
    assert c.delete(points(spark, ("p7", None, None), ("nobody", None, None))).count() == 200
    assert {r.point_id for r in c.read().collect()} == set(table) - {"p7"}


def test_refused_points_and_failed_writers_leave_the_version(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"))
    c.ensure(1, buckets=4)
    c.upsert(points(spark, ("a", [1.0], "x")))
    for bad in (("b", [1.0, 2.0], "x"), (None, [1.0], "x"), ("b", None, "x")):
        with pytest.raises(ValueError):
            c.upsert(points(spark, bad))
    with pytest.raises(ValueError):
        c.ensure(3)
    now = c.versions.current()
    c.versions.put(points(spark, ("z", [1.0], "x")).withColumn("bucket", F.lit(1)), [1])  # a writer that stops here
    (tmp_path / "c" / "manifests" / f"v{now['version'] + 1}.json").write_text('{"version": 9, "tab')  # or here
    assert [r.point_id for r in c.read().collect()] == ["a"]
    assert c.upsert(points(spark, ("b", [2.0], "y"))).count() == 2
    with pytest.raises(ValueError):
        c.versions.commit(now, {})  # a version was made since
    c.drop()
    assert c.versions.current()["version"] == 0


def test_vacuum_keeps_what_the_last_versions_name(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"))
    for i in range(4):
        c.upsert(points(spark, ("a", [float(i)], "x")))
    assert c.versions.vacuum(1) == 3
    assert [r.vector for r in c.read().collect()] == [[3.0]]

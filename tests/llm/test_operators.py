import base64
import hashlib
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import binary_topk, html_text, quality_rules, source_mix, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of a text."""
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(w) - 4):
        windows.setdefault(tuple(w[i : i + 5]), []).append(i)
    again = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    failed = len(w) < 10 or 100 * len(again) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again), failed


def test_quality_measures_equal_brute_force(spark):
    rnd = random.Random(1)
    texts = [None, "", " \n\t ", "a\na\n\nb\r\nb\r\n a", "x y z u v " * 3, "one\x0btwo\x85three four", "😀 <b> #1 | $5 & 10% *"]
    texts += [" ".join(rnd.choice("ab c\n # the".split(" ")) for _ in range(rnd.randint(1, 60))) for _ in range(60)]
    texts.append(" ".join(f"w{i % 3000}" for i in range(20_000)))
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, "the same id twice")]
    got = quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((r.doc_id, *(r[n] for n in names)) for r in got) == sorted((i, *base(t)) for i, t in rows)
    assert all(not r.kept for r in got if r.base_failed)


def targets(sizes):
    """Target of each source by the rule: shares by weight, stopped at twice the source's size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s] + 1e-9}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def test_mix_equals_the_rule(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 40)), rnd.choice(["b", "a", None, "ä", "c", "c", "c"])) for i in range(500)]
    rows += [(None, "no id here", "a"), (3, "a repeated id", "a"), (900, None, "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = source_mix.mix(df).collect()
    sizes, taken = {}, {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    source_of = {(k, len(WORD.findall(t or ""))): s for k, t, s in rows}
    want = targets(sizes)
    for r in got:
        s = source_of[(r.doc_id, r["size"])]
        assert 0 <= r.taken <= 2 * r["size"]
        if sum(1 for x in source_of.items() if x[0] == (r.doc_id, r["size"])) == 1 and sizes[s] == r.source_size:
            assert abs(r.target - want[s]) < 1e-6
            taken[s] = taken.get(s, 0) + r.taken
    assert len(got) == len(rows)
    assert all(abs(taken[s] - want[s]) <= 80 for s in taken)
    again = source_mix.mix(df.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_rates_are_the_tilt_that_meets_each_target(spark):
    rnd = random.Random(5)
    rows = []
    for s, n, long in (("a", 60, 30), ("b", 300, 900), ("c", 200, 25), ("d", 40, 20_000), ("e", 1, 7)):
        rows += [(len(rows) + i, " ".join(["w"] * rnd.randint(1, long)), s) for i in range(n)]
    rows += [(9_000, "", "a"), (9_001, None, "only empty")]
    got = source_mix.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    source_of = {k: s for k, _, s in rows}
    for s in set(source_of.values()):
        mine = [r for r in got if source_of[r.doc_id] == s]
        target = mine[0].target
        lo, hi = -800.0, math.log(2.0)  # bisection on the one multiplier
        for _ in range(200):
            mid = (lo + hi) / 2
            reached = sum(r["size"] * min(2.0, math.exp(min(mid * r["size"], 1))) for r in mine)
            lo, hi = (mid, hi) if reached < target else (lo, mid)
        for r in mine:
            want = min(2.0, math.exp(min(hi * r["size"], 1))) if target else 1.0
            assert abs(r.rate - want) <= 1e-5, (s, r)
        moved = [r for r in mine if r.copies not in {math.floor(r.rate), math.ceil(r.rate)}]
        assert len(moved) <= source_mix.EXCHANGES
        assert abs(sum(r.taken for r in mine) - target) <= max(r["size"] for r in mine)


def test_nearest_codes_equal_brute_force(spark):
    rnd = np.random.default_rng(1)
    vectors = rnd.normal(size=(300, 16)).round(3)
    vectors[50:60] = vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(7, vectors[7].tolist()), (400, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = binary_topk.nearest(df, F.col("vec_id") % 100 == 0, k=5).collect()
    codes = {r.vec_id: r.code for r in df.filter("embedding IS NOT NULL").select("vec_id", binary_topk.sign_code(F.col("embedding")).alias("code")).collect()}
    bits = {k: (c if isinstance(c, (bytes, bytearray)) else int(c) & (2**64 - 1)) for k, c in codes.items()}
    number = lambda c: int.from_bytes(c, "big") if isinstance(c, (bytes, bytearray)) else c
    want = []
    for q in (0, 100, 200):
        near = sorted((bin(number(bits[q]) ^ number(bits[k])).count("1"), k) for k in bits if k != q)[:5]
        want += [(q, i, k, d) for i, (d, k) in enumerate(near, 1)]
    assert sorted(map(tuple, got)) == want


def test_shards_and_batches_do_not_change_neighbours(spark, monkeypatch):
    rnd = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rnd.normal(size=(1_500, 64)))]
    rows += [(2_000 + i, rows[0][1]) for i in range(40)]  # a vector that many rows share
    rows += [(5, rows[9][1]), (None, rows[3][1]), (6_000, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = binary_topk.nearest(df, F.col("vec_id") % 20 == 0, k=7).collect()
    monkeypatch.setattr(binary_topk, "SHARD_CODES", 300)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        cut = binary_topk.nearest(df.repartition(3), F.col("vec_id") % 20 == 0, k=7).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, whole)) == sorted(map(tuple, cut)) and len(whole) == 77 * 7
    codes = df.select("vec_id", binary_topk.sign_code(F.col("embedding")).alias("code")).dropna()
    code = {r.vec_id: r.code for r in codes.groupBy("vec_id").agg(F.min("code").alias("code")).collect()}
    for q in (0, 20, 2_020):
        near = sorted(((code[q] ^ code[x]) & (2**64 - 1)).bit_count() * 10**6 + x for x in code if x != q)[:7]
        assert [(r.distance * 10**6 + r.neighbour_id) for r in sorted(whole, key=lambda r: r["rank"]) if r.query_id == q] == near


def test_no_rows_no_neighbours(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert binary_topk.nearest(df, F.col("vec_id") % 100 == 0).collect() == []


def archived(rows):
    """What the archive says of each page, by the rule."""
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    pay = {k: (h or "").encode() for k, _, h in rows}
    largest = {}
    for k, p in pay.items():
        largest[p] = max(largest.get(p, k), k)
    return sorted(
        (k, len(p), digest(p), "response" if largest[p] == k else "revisit", None if largest[p] == k else largest[p])
        for k, p in pay.items()
    )


def test_archives_name_the_largest_of_equal_payloads(spark):
    rnd = random.Random(3)
    rows = [(i, f"http://h/{i}", rnd.choice(["<p>a</p>", "<p>b</p>", "", None, f"<p>{i}</p>"])) for i in range(80)]
    rows += [(100, "http://h/" + "u" * 70_000, "<p>long url</p>"), (101, None, "x" * 3_000_000), (102, "http://h/2", "x" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = warc.read_archive(warc.write_archive(df)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect())) == archived(rows)


def test_deep_pages_keep_their_text():
    for n in (300, 5_000):
        page = "<body><article>" + "<div>" * n + "deep <b>text</b><nav>menu</nav><p>more</p>" + "</div>" * n + "<p>after</p></article></body>"
        assert html_text.main_text(page) == "deep text\nmore\nafter"
        tree = html_text.skeleton(html_text.parse(page))
        assert html_text.loads(html_text.dumps(html_text.merge(tree, html_text.skeleton(html_text.parse(page))))).count == 2

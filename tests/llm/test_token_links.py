import hashlib
import json
import random
from collections import Counter, defaultdict

import public_tokenizers
from pyspark.sql import functions as F

from ledgerloom.llm import token_links

TEXTS = [
    None, "", " ", "a", "Hello, world! Hello", "naïve café 漢字 🙂", "two  spaces and\ttabs\nand lines", " leading", "trailing ",
    "<|endoftext|> and <s> </s> <unk> <0x41>", "▁ a block ▁", "ﬁ ligature and   wide", "unbelievably tokenization-free 123456 don't",
]


def brute(texts):
    """Tokens with their byte ranges, all pairs compared."""
    import sentencepiece
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    lib.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    names = {i: t for t, i in json.load(open(path))["model"]["vocab"].items()}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = []
    for t in texts:
        if not t:
            docs.append(None)
            continue
        a, b = lib.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)
        a_bytes = [bytes(back[c] for c in names[i]) for i in a]
        b_bytes = [bytes([int(p[3:-1], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(sp.id_to_piece, b))]
        whole = (" " + t).encode()
        docs.append((a, a_bytes, b, b_bytes) if b"".join(a_bytes) == whole == b"".join(b_bytes) else None)
    links, out = [], []
    for d in docs:
        if d is None:
            links.append([])
            out.append([0, 0, 0, 0, ""])
            continue
        spans = []
        for ids, parts in ((d[0], d[1]), (d[2], d[3])):
            at, mine = 0, []
            for i, p in zip(ids, parts):
                mine.append((at, at + len(p), i))
                at += len(p)
            spans.append(mine)
        links.append([(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]])
        cuts = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups, low = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(x[2]) for x in side if low < x[1] <= c) for side in spans))
            low = c
        out.append([len(d[0]), len(d[2]), len(cuts), len(links[-1]), hashlib.sha256(";".join(groups).encode()).hexdigest()])
    n = Counter(p for x in links for p in set(x))
    most = defaultdict(int)
    for (a, _), c in n.items():
        most[a] = max(most[a], c)
    return [(*o[:4], sum(n[p] == most[p[0]] for p in x), sum(n[p] for p in x), o[4]) for o, x in zip(out, links)]


def found(spark, texts, parts=3):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    for name in ("key", "uid", "links", "a_ids", "b_ends", "pair", "n"):
        df = df.withColumn(name, F.lit("x"))
    return [tuple(r)[1:] for r in sorted(token_links.align(df).collect())]


def test_equals_brute_force(spark):
    rnd = random.Random(4)
    words = ["the", "token", "ization", "über", "漢", "12", "-", "x" * 30, "don't", "Ωmega", "a,b", "🙂"]
    texts = TEXTS + [" ".join(rnd.choices(words, k=rnd.randint(1, 60))) for _ in range(80)] + ["the same"] * 40
    assert found(spark, texts) == brute(texts)


def test_frequent_and_rare_pairs_agree(spark):
    texts = ["alpha beta " * (i % 5) + f"own{i}" for i in range(30)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    paths = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    made = token_links.aligned(token_links.tokenised(rows, *paths)).withColumnRenamed("key", "uid").select("uid", "links")
    want = {(i, r[4], r[5]) for i, r in enumerate(brute(texts))}
    for frequent in (1, 5, 100, 10**9):
        assert {tuple(r) for r in token_links.with_counts(made, frequent).collect()} == want


def test_a_long_text(spark):
    text = "".join(f"word{i % 977} naïve-{i} " for i in range(60_000))
    (got,) = found(spark, [text], 1)
    n_a, n_b, groups, links = got[:4]
    assert links == n_a + n_b - groups and n_a > 300_000 and got[4] == links and got[5] == links


def test_repeated_and_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a c"), (2, None)], "doc_id long, text string")
    got = sorted(token_links.align(df).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert [r["doc_id"] for r in got] == [1, 1, 2, None]
    want = brute(["a b", "a b", None, "a c"])
    assert [tuple(r)[1:] for r in got] == want
    assert token_links.align(df.limit(0)).count() == 0
    assert [tuple(r)[1:] for r in token_links.align(df.filter("doc_id = 2")).collect()] == [(0, 0, 0, 0, 0, 0, "")]


def test_nothing_is_sorted_and_no_text_made_inside_of_lambdas(spark):
    # which cost more than tokenising: Spark works with boxed numbers and single texts there
    rows = spark.createDataFrame([(1, "alpha beta"), (2, "unbelievably tokenization-free"), (3, "")], "doc_id long, text string")
    paths = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    tokens = token_links.tokenised(rows, *paths)
    made = token_links.aligned(tokens)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" not in plan and "concat(" not in plan and "split(" not in plan
    got = {r["key"]: r for r in tokens.collect()}
    for r in made.collect():
        t = got[r["key"]]
        assert len(t["a_links"]) == len(t["b_links"]) == len(r["links"]) == r["n_a"] + r["n_b"] - r["n_groups"]
        assert r["groups"].count("|") == r["n_groups"] and len(t["runs"]) == max(0, r["n_a"] + r["n_b"] + 2 * r["n_groups"] - 1)

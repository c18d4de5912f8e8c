import random

from pyspark.sql import functions as F

from ledgerloom.operators import chunk, evaluate

STATUTE = """Preamble that is dropped.
CHAPTER I
PRELIMINARY
1. Short title, extent. - (1) This Act may be called the Act.
CHAPTER V   INPUT TAX  CREDIT
16. Eligibility and conditions. - (1) Every	registered   person.

(2) Notwithstanding anything.
CHAPTER V INPUT TAX CREDIT
[Section 17. Apportionment of credit. — Where goods are used.
10A. Empty. -
CHAPTER VI TAX INVOICE
Rule 31. Tax invoice. – A person shall issue.
"""


def test_provisions(spark):
    df = spark.createDataFrame([("Act", STATUTE), ("none", None), ("empty", "")], "name string, text string")
    got = chunk.provisions(df, "name", "text").orderBy("position").collect()
    assert [(r.section_number, r.section_title, r.chapter) for r in got] == [
        ("1", "Short title, extent", "Chapter I: PRELIMINARY"),
        ("16", "Eligibility and conditions", "Chapter V: INPUT TAX  CREDIT"),
        ("17", "Apportionment of credit", "Chapter V: INPUT TAX CREDIT"),
        ("10A", "Empty", "Chapter V: INPUT TAX CREDIT"),
        ("31", "Tax invoice", "Chapter VI: TAX INVOICE"),
    ]
    assert got[1].text.startswith("Eligibility and conditions. (1) Every registered person.\n\n(2) Notwith")
    assert all(r.part is None for r in got)


def pieces_of(spark, texts, size, lap):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.select(chunk.pack(F.col("t"), size, lap)).collect()]


def test_packing_by_hand(spark):
    three = "aaaa\n\nbbbb\n \ncccc"
    assert pieces_of(spark, [three, "", "short"], 10, 0) == [["aaaa\n\nbbbb", "cccc"], [""], ["short"]]
    assert pieces_of(spark, [three], 10, 2) == [["aaaa\n\nbbbb", "bb\n\ncccc"]]
    assert [len(p) for p in pieces_of(spark, ["x" * 25], 10, 4)[0]] == [10, 10, 10, 7, 1]


def test_packing_holds_its_promises(spark):
    rnd = random.Random(1)
    texts = ["\n\n".join(rnd.choice("pqr") * rnd.randint(1, 60) for _ in range(rnd.randint(1, 20))) for _ in range(40)]
    for text, got in zip(texts, pieces_of(spark, texts, 100, 0), strict=True):
        assert all(len(p) <= 100 for p in got) and "\n\n".join(got) == text
    for text, got in zip(texts, pieces_of(spark, texts, 100, 30), strict=True):
        assert all(len(p) <= 100 for p in got)
        assert all(b.startswith(a[-30:] + "\n\n") for a, b in zip(got, got[1:]))
        assert "\n\n".join([got[0]] + [b[len(a[-30:]) + 2 :] for a, b in zip(got, got[1:])]) == text
    long = ["y" * rnd.randint(90, 900) for _ in range(20)]
    for text, got in zip(long, pieces_of(spark, long, 100, None), strict=True):
        assert all(len(p) <= 100 for p in got) and got[0] + "".join(b[20:] for b in got[1:]) == text


def test_headers_are_found_from_left_to_right(spark):
    texts = [
        "1. Alpha. -\n  2. Beta. - b\n3. Gamma. - c",
        "CHAPTER I ONE\n1. A b. - x\rCHAPTER II TWO\n2. C d. - y\uffff2. E. - z\n",
        "7. Zeta. -\n\n\n8. Eta. - h",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    got = [(r.source_document, r.section_number, r.text) for r in chunk.provisions(df, "n", "t").orderBy("source_document", "position").collect()]
    assert got == [
        (0, "1", "Alpha. 2. Beta. - b"), (0, "3", "Gamma. c"), (1, "1", "A b. x\rCHAPTER II TWO"), (1, "2", "C d. y2. E. - z"),
        (2, "8", "Eta. h"),  # 7 takes up the lines between and is empty
    ]


def test_evaluation(spark):
    truth = spark.createDataFrame([("1", "EX-01"), ("2", "EX-02"), ("3", None), ("4", None)], "case_id string, code string")
    found = spark.createDataFrame([("1", "EX-01"), ("3", "EX-02"), ("9", "EX-01")], "case_id string, code string")
    got = {r.code: r for r in evaluate.by_code(truth, found).collect()}
    assert (got["EX-01"].tp, got["EX-01"].fp, got["EX-01"].f1) == (1, 0, 1.0)
    assert (got["EX-02"].tp, got["EX-02"].fp, got["EX-02"].fn, got["EX-02"].precision) == (0, 1, 1, 0.0)
    assert got["EX-03"].precision != got["EX-03"].precision and len(got) == 12
    cleans = evaluate.clean(truth, found)
    assert tuple(cleans.first()) == (2, 1)
    assert not evaluate.gate(evaluate.by_code(truth, found), cleans, 0)
    right = truth.filter("code IS NOT NULL")
    assert evaluate.gate(evaluate.by_code(truth, right), evaluate.clean(truth, right), 0)
    assert not evaluate.gate(evaluate.by_code(truth, right), evaluate.clean(truth, right), 1)


def test_case_ids(spark):
    rows = [("SYN00012", "SYN00099"), ("BILL", "xSYN00007/"), (None, None), ("BILL", "SYN12")]
    df = spark.createDataFrame(rows, "b string, g string")
    assert [r[0] for r in df.select(evaluate.case_id(F.col("b"), F.col("g"))).collect()] == ["00012", "00007", None, None]

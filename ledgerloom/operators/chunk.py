"""Numbered provisions of statutes as retrieval chunks, split at headers and packed by paragraph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_CHARS = 6000
OVERLAP = 500

# fixed values: the shapes of chapter and provision headers
CHAPTER = r"(?m)^[ \t]*CHAPTER\s+([IVXLCDM]+)\s+(.+?)\s*$"
SECTION = r"[ \t]*\[?(?:Rule|Section)?\s*(\d{1,3}[A-Z]{0,2})\.\s+([A-Z][^.]*?)\.\s*[-–—]\s*"
#: Stands before a header while a text is split; it is no character, and taken out of texts that hold it.
MARK = "\uffff"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")


def squeeze(x: Column) -> Column:
    """Runs of blanks and tabs as one blank, none at the ends."""
    return strip(F.regexp_replace(x, r"[ \t]+", " "))


def pack(x: Column, size: int = MAX_CHARS, overlap: int | None = None) -> Column:
    """Pieces of ``x``: paragraphs packed up to ``size`` with an overlap, longer ones cut in windows."""
    lap = min(OVERLAP, size // 5) if overlap is None else overlap
    gap = F.lit("\n\n")

    def add(acc, paragraph):
        joined = F.when(acc["now"] != "", F.concat(acc["now"], gap, paragraph)).otherwise(paragraph)
        full = (F.length(joined) > size) & (acc["now"] != "")
        tail = F.substring(acc["now"], -lap, lap) if lap else F.lit("")
        after = F.concat(tail, gap, paragraph) if lap else paragraph
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]).alias("done"),
            F.when(full, after).otherwise(joined).alias("now"),
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    packed = F.aggregate(
        F.split(x, r"\n\s*\n"),
        start,
        add,
        lambda acc: F.when(acc["now"] != "", F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]),
    )
    step = max(1, size - lap)

    def windows(piece):
        starts = F.sequence(F.lit(0), F.greatest(F.length(piece) - 1, F.lit(0)), F.lit(step))
        cut = F.transform(starts, lambda s: F.substring(piece, s + 1, F.lit(size)))
        return F.when(F.length(piece) <= size, F.array(piece)).otherwise(cut)

    return F.when(F.length(x) <= size, F.array(x)).otherwise(F.flatten(F.transform(packed, windows)))


def provisions(df: DataFrame, key: str, text: str, size: int = MAX_CHARS) -> DataFrame:
    """(source_document, chapter, section_number, section_title, text, part, position) of every provision.

    Headers are found from left to right, each behind the end of the one before;
    what a header takes up, with the white space behind it, holds no other. Text before the first header is dropped, and so is a provision without a
    body. The chapter is that of the last heading above the header. Null text
    has no provisions.
    """
    # a mark before every header, put there by one scan: each piece but the first begins with one
    marked = F.regexp_replace(F.translate(F.col(text), MARK, ""), f"(?dm)^{SECTION}", f"{MARK}$0")
    pieces = df.select(F.col(key).alias("source_document"), F.posexplode(F.split(marked, MARK)).alias("position", "piece"))
    headings = F.expr("regexp_extract_all(piece, r'" + CHAPTER + "', 0)")
    last = F.get(headings, F.size(headings) - 1)
    chapter = F.when(
        F.size(headings) > 0,
        F.concat(F.lit("Chapter "), F.regexp_extract(last, CHAPTER, 1), F.lit(": "), strip(F.regexp_extract(last, CHAPTER, 2))),
    )
    above = Window.partitionBy("source_document").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    own = f"^{SECTION}"
    s = pieces.withColumn("heading", chapter).withColumn("chapter", F.last("heading", ignorenulls=True).over(above))
    s = s.filter(F.col("piece").rlike(own)).withColumns(
        {
            "section_number": F.regexp_extract("piece", own, 1),
            "section_title": strip(F.regexp_extract("piece", own, 2)),
            "body": strip(F.regexp_replace("piece", own, "")),
        }
    )
    s = s.filter("body <> ''").withColumn("whole", squeeze(F.concat("section_title", F.lit(". "), "body")))
    s = s.withColumn("pieces", pack(F.col("whole"), size))
    long = F.length("whole") > size
    s = s.select("*", F.posexplode("pieces").alias("i", "chunk"))
    return s.select(
        "source_document",
        "chapter",
        "section_number",
        "section_title",
        F.col("chunk").alias("text"),
        F.when(long, F.col("i") + 1).alias("part"),
        "position",
    )


def citation(source: Column, number: Column, title: Column) -> Column:
    return F.concat(source, F.lit(", Section "), number, F.lit(" ("), title, F.lit(")"))

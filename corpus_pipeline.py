"""The corpus pipeline: five stages over ``documents``, each on all its predecessor kept."""

from ledgerloom.llm import byte_bpe, chosen_path, quality_rules, source_mix, suffix_dedup
from ledgerloom.llm.common import dropped, scratch, written


def keep_quality(spark, docs, sf_dir):
    """Documents the quality rules keep. A null text has no words and goes; ids are not looked at,
    repeated rows are judged alike, other columns stay as they are."""
    return quality_rules.filter_documents(docs)


def one_of_each_group(spark, docs, sf_dir):
    """One document of each group of near duplicates, that with the least id, and of equal rows one.
    Rows without an id or without a word stay; rows of one id are judged each by its own text."""
    return chosen_path.first_of_class(docs)


def drop_repeats(spark, docs, sf_dir):
    """Documents without the long passages that documents with smaller ids have; no row goes.
    A null text stays null, a text that loses all its bytes is empty."""
    return suffix_dedup.dedup_documents(docs)


def mix_sources(spark, docs, sf_dir):
    """Documents as often as the mix takes them: not at all, once or twice. Null sources are a source."""
    return source_mix.mix_documents(docs)


def encode(spark, docs, sf_dir):
    """Documents with token_ids, n_tokens and decoded_sha256, which replace columns of these names.
    A null or empty text has no ids."""
    return byte_bpe.encoded(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("ngram_jaccard_join", one_of_each_group),
    ("suffix_array_dedup", drop_repeats),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    """The encoded documents. Each stage's output is written whole; its working tables and its input go then."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch() as made:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
            made.remove(docs)
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

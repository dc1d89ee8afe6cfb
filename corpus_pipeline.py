"""A corpus from documents to token ids: toxicity, near duplicates, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the
columns of docs. Nulls in any column, empty and very long texts, repeated rows, empty tables and further columns are
handled as the operators' docstrings say: rows without id or words are never near duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import op1_mixing, op5_ngram_join, op7_byte_bpe, op9_toxicity
from docloom.llm.common import Scratch, prepare, table

#: Near duplicates share words by five, and four fifths of them.
WORDS, NUM, DEN = 5, 80, 100


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5."""
    prepare(spark)
    labels = table(spark, sf_dir, "labels")
    return op9_toxicity.without_toxic(docs, op9_toxicity.fit(docs.select("doc_id", "text"), labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group that links connect."""
    prepare(spark)
    return op5_ngram_join.one_of_each(docs, WORDS, NUM, DEN)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: each row as often as it is taken (never, once or twice), shard by shard, shuffled."""
    prepare(spark)
    key = F.xxhash64("doc_id", "text")
    return op1_mixing.shuffled(op1_mixing.mix(docs, op1_mixing.word_count("text"), key), key).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens, and whether the ids decode to the text's bytes."""
    import public_tokenizers

    prepare(spark)
    docs = docs.select("doc_id", "source", "text")
    out = op7_byte_bpe.coded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "source", "ids", "n_tokens", "exact")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("byte_bpe", byte_bpe)]
#: Hashes of the mixture and the library's merges aren't expressible in SQL; tests/llm/test_pipeline.py goes by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, spent = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), []
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.drop(*spent)
        spent = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)

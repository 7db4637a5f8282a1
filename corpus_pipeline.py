"""A corpus from documents to packed sequences: quality, exact copies, near copies, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; :func:`run` writes every stage's
result as Parquet in the folder that the cluster shares and reads it again for the next. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import exact_dedup, jaccard_join, mixing, packing, quality
from tallyloom.llm.queries import vocabulary
from tallyloom.llm.shared import forget_since, scratch_mark, table, written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is above their language's threshold go.

    Texts that are null, empty or without tokens go; null ids and languages are judged (by the threshold of all languages).
    Very long texts are judged whole, ties with the threshold and all rows that repeat a kept one stay. An empty table stays
    empty; columns of any other name pass through.
    """
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays.

    Null texts equal empty ones; a null id is below all others; of rows that tie, any one stays. Very long texts are compared
    whole. An empty table stays empty; columns of any other name pass through.
    """
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near copies link, directly or over others, the one with the smallest id stays.

    Texts without words link to nothing; a null id is above all others; rows with the same id and text stay or go together.
    Very long texts are compared by all their shingles. An empty table stays empty; columns of any other name pass through.
    """
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for, at most three times.

    Null is a source of its own, null texts have no words; of rows that tie at the boundary as many stay as come nearest to
    the target. Very long texts count whole. An empty table stays empty; columns of any other name pass through.
    """
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens.

    A null text is empty and so one token long; null ids are passed on; repeated rows are packed each; only texts longer than
    a sequence are cut. An empty table gives an empty one; other columns are not read.
    """
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", classify),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The tokenizer of the last stage is beyond SQL; tests/llm/test_pipeline.py compares every stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's scratch tables and its input go once its result is written."""
    docs, mark = table(spark, sf_dir, "documents"), scratch_mark()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
        forget_since(mark)
    return STAGES[-1][1](spark, docs, sf_dir)

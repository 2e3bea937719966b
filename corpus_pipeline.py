"""A training-data pipeline over `documents`: each stage reads what the one before it wrote and works on all of it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import bpe, common, decontaminate, exact, near, toxicity
from loomline.llm.queries import TOKENIZER, vocabulary

#: SQL has no language models, SimHash or tokenizers: the stages are tested against brute force.
ORACLE_SQL = None


def lean(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that gets its rows in small batches: its workers share an executor with what earlier stages left to the JVM.
    The setting stays with the session, since a stage's result is computed after it returns."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@lean
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go. Learned from the labelled rows outside the held-out fifth."""
    model, beta = toxicity.fit(docs, common.table(spark, sf_dir, "labels"), common.fold("doc_id", 5) != 0)
    return toxicity.score(docs, model, beta).where("predicted = 0").select(*docs.columns)


@lean
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space one document stays."""
    return exact.deduplicated(docs)


@lean
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, by SimHash with shingles of five words and a similarity of 0.8 or more, the document
    with the smallest doc_id stays."""
    return near.representatives(docs, words=5, similarity=0.8)


@lean
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    columns = docs.columns
    return decontaminate.contaminate(docs, common.table(spark, sf_dir, "benchmark")).where("not contaminated").select(*columns)


@lean
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents with their token ids, and digests of the ids and of what they decode to."""
    return bpe.encode(docs, vocabulary(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each result written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs, name)
    return docs

"""From raw documents to packed sequences: the stages of a training corpus, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedtide.llm.common import documents, store
from feedtide.llm.jaccard import one_per_component
from feedtide.llm.mixing import mixed_documents
from feedtide.llm.packing import pack
from feedtide.llm.substrings import remove_passages, repeated_passages
from feedtide.llm.toxicity import score, train

REJECT_FROM = 0.7  # toxicity score


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below REJECT_FROM."""
    model = train(docs, _labels(spark, sf_dir))
    scored = score(docs, model, names=("_toxicity", "_toxic_spans"))  # a documents table may have a score of its own
    return scored.filter(F.col("_toxicity") < REJECT_FROM).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    return one_per_component(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words and more that another document keeps."""
    return remove_passages(docs, repeated_passages(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target and their key say."""
    return mixed_documents(docs, _labels(spark, sf_dir))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences."""
    return pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near copies", without_near_copies),
    ("repeated passages", without_repeated_passages),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # token ids, a fitted model and seeded keys are not expressible; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""From documents to token ids: five stages, each over all that the one before has kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wireloom.llm import bpe, decontaminate, jaccard, suffix_dedup, toxicity
from wireloom.llm.common import prepare
from wireloom.llm.folds import in_fold
from wireloom.session import store

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier scores below one half; it learns from the labels outside the held-out fold."""
    labels = prepare(spark).read.parquet(f"{folder}/labels.parquet").filter(~in_fold("doc_id", 0))
    return toxicity.drop_toxic(docs, toxicity.learn(docs, labels))


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without the passages that earlier documents hold."""
    return suffix_dedup.drop_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.drop_contaminated(docs, prepare(spark).read.parquet(f"{folder}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Each document with its token ids."""
    prepare(spark)
    return bpe.encode(docs, BYTE_BPE, keep=docs.columns).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", keep_one_of_similar),
    ("suffix-array dedup", drop_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]

#: SQL can't express these stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the last stage; what each of the others keeps is written and read again."""
    docs = prepare(spark).read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, folder), name.replace(" ", "-")).table
    return STAGES[-1][1](spark, docs, folder)

"""The corpus pipeline: five stages over `documents`, each by one operator of ndspark.llm.

Toxic documents go, then those of low quality, then all but one of each group of near duplicates;
secrets in what stays are masked, and the result is packed into sequences. A stage judges and
trains on its own input only. Every stage but the last returns the columns that it was given.

Null texts count as empty and stay, as do rows whose id is null; of rows repeated with one id and text
one stays. An empty table passes through all stages. Without labels of both kinds a classifier rejects nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ndspark.llm import neardup, packing, quality, secrets, toxicity
from ndspark.llm.common import shared_folder, table

TOXIC, GOOD = 0.3, 0.5


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", F.lit(False))
    return toxicity.score(docs, model, into="__score").where(F.col("__score") < TOXIC).drop("__score")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", F.lit(False))
    return quality.score(docs, model, into="__score").where(F.col("__score") >= GOOD).drop("__score")


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.without_copies(docs, shingle=5, percent=80)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return packing.pack(packing.pieces(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("toxicity", toxic), ("quality", good), ("near_duplicates", single), ("secrets", masked), ("packing", packed)]

#: Classifiers, signatures and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each one's rows are written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs

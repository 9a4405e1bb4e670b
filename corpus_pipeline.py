"""A corpus pipeline of five stages over `documents`: each works on all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orofold.llm import common, exact, langid, minhash, packing, pii

#: Texts whose language is told with less certainty are rejected, beside those without any letter.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language; what has no letters, or no likely language, goes."""
    model = langid.train(docs.where(langid.remainder(4) != 2).select("text", "lang"))
    told = langid.identified(docs, model)
    return told.where((F.col(langid.TOLD)["lang_pred"] != "und") & (F.col(langid.TOLD)["score"] >= LEAST_SCORE)).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    rows = common.numbered(docs)
    stays = exact.exact_dedup(rows).where("kept").select(F.col("rid").alias(common.RID))
    return rows.join(stays, common.RID, "left_semi").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    rows = common.numbered(docs)
    stays = minhash.near_dedup(rows, k=5, percent=80).where("kept").select(F.col("rid").alias(common.RID))
    return rows.join(stays, common.RID, "left_semi").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("personal_data", personal_data), ("packed", packed)]
#: SQL has no classifier, sketch or tokeniser. tests/llm tests the operators by themselves; run() and the stages (k = 5, LEAST_SCORE,
#: the rereading between them) aren't held against anything.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, top = common.table(spark, sf_dir, "documents"), f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(at := f"{top}/{k}-{name}")
        docs = spark.read.parquet(at)
    return docs

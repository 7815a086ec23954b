"""The corpus pipeline: quality, toxicity, near-duplicates, mixing, encoding."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.llm import bpe, mixing, neardup, quality_model, toxicity
from tessella.llm.common import fold, table, use_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null, empty and wordless texts score 0 and go; rows with equal texts share their
    fate, whatever their ids, null ones too; an empty table gives an empty one. All columns stay, whatever their names."""
    return quality_model.keep_good(docs, quality_model.fit(docs.select("doc_id", "text")))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. The model learns from the labels outside the held-out fold, as op1 does; without labels of both
    kinds every score is the prior. Null and empty texts score as the intercept does; rows with equal texts share their fate; an empty
    table gives an empty one. All columns stay, whatever their names."""
    labels = table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 4) != 2)
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of its least id. Rows with a null text or a null id stay; of rows with the same
    id and text one stays; an empty table gives an empty one. All columns stay, whatever their names."""
    return neardup.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that sources, languages and topics have their target shares of tokens. Null sources and languages are
    categories of their own; texts without tokens are drawn like others of their cell; rows with one id and cell share their fate; an
    empty table gives an empty one. All columns stay, whatever their names."""
    return mixing.keep_drawn(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of each document's tokens, and digests of their ids and of what they decode to. Null and empty texts have no tokens; each
    row has one, repeated rows and null ids too; an empty table gives an empty one."""
    return bpe.digests(bpe.tokenize(docs, bpe.tokenizer_file()))


STAGES = [("quality_model", quality), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("mixture", mixture), ("encoding", encoded)]
#: SQL can't express the learned stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over the documents, each written as Parquet and read again as the next one's input."""
    root = f"{use_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{i}-{name}")
        docs = spark.read.parquet(f"{root}/{i}-{name}")
    return docs

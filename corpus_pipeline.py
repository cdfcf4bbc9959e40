"""A training-data pipeline: five stages from `documents` to token ids."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import bpe, line_dedup, mixing, ngram_jaccard, quality_classifier
from keystrata.session import checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; the model learns from labelled ones in ``docs``."""
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.score(docs, model).where(F.col("score") >= quality_classifier.THRESHOLD).select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; n_chars follows.  No document goes, even if nothing is left of it."""
    out = line_dedup.apply_line_dedup(docs)
    return out.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast("long")).select(*docs.columns)


def _marked(docs: DataFrame) -> DataFrame:
    """(row, id, mark): every row as a struct, its id and the hash of its text."""
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(every, F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the n-gram Jaccard join the document with the smallest id stays.

    Documents without an id come after all others; what shares an id is told apart by the hashes of
    the texts, in their order.  Rows that repeat both id and text are one document.
    """
    rows = ngram_jaccard.linked(docs).select("c", F.struct(F.col("doc_id").isNull(), "doc_id", "tag").alias("at"))
    least = rows.where("c is not null").groupBy("c").agg(F.min("at").alias("at"))
    alone = rows.where("c is null").select("at").distinct()
    stays = least.select("at").unionByName(alone).select(F.col("at.doc_id").alias("stays_id"), F.col("at.tag").alias("stays_mark"))
    return _marked(docs).join(stays, F.col("id").eqNullSafe(F.col("stays_id")) & (F.col("mark") == F.col("stays_mark")), "left_semi").select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes as often as epochs reach it: not at all, once or twice, whole each time."""
    each = F.when(F.col("taken") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0)
    named = mixing.mix(docs.withColumn("text", F.coalesce("text", F.lit(""))))
    plan = named.groupBy(F.col("doc_id").alias("plan_id"), F.col("tag").alias("plan_mark")).agg(F.ceil(F.sum(each) / F.count("*")).cast("int").alias("times"))
    both = _marked(docs).join(plan.where("times > 0"), F.col("id").eqNullSafe(F.col("plan_id")) & (F.col("mark") == F.col("plan_mark")))
    return both.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("row.*")


#: Matches in a row on the way to the encoder's workers: a quarter of its own, since the heaps of executors are full by then.
TOKEN_ROW = 32


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids) of every row."""
    coded = bpe.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN, row_pieces=TOKEN_ROW)
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]

#: The classifier and the components can't be written in SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{name}")
            docs = spark.read.parquet(f"{base}/{name}")
    return docs

"""A corpus pipeline of five stages over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import decontaminate, near_dedup, sentencepiece, substring_dedup, toxicity
from cadenza.llm.common import forget, read, rested, small, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; rows with a null text stay."""
    rested(spark)
    model = toxicity.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, model, keep_text=True).where("predicted = 0").select(*COLUMNS)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near duplicates; of rows with equal id and text, one.  Different texts of one id stay."""
    rested(spark)
    docs = docs.select(*COLUMNS)
    judged = near_dedup.near_duplicates(docs.select("doc_id", "text"))
    gone = stored(judged.where("not kept").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    out = docs.join(F.broadcast(gone) if small(gone) else gone, F.col("doc_id") == F.col("gone"), "left_anti")
    twice = stored(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("twice")).count().where("count > 1").select("twice"), "twice")
    if twice.isEmpty():
        return out.select(*COLUMNS)
    side = F.broadcast(twice) if small(twice) else twice
    once = out.join(side, F.col("doc_id") == F.col("twice"), "left_anti")
    again = out.join(side, F.col("doc_id") == F.col("twice"), "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(again).select(*COLUMNS)


def passages_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages cut from all but the smallest document that has them; ``n_chars`` follows the text."""
    rested(spark)
    docs = docs.select(*COLUMNS)
    found = substring_dedup.repeated_passages(docs.select("doc_id", "text"))
    cut = substring_dedup.without_passages(docs, found)
    return cut.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated."""
    rested(spark)
    judged = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"), keep_text=True)
    return judged.where("not contaminated").select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, encoded: counts, digest of the ids, and whether decoding gives the text back."""
    rested(spark)
    return sentencepiece.round_trips(docs.select("doc_id", "text"), sentencepiece.production_model())


STAGES = [
    ("toxicity", toxic_out),
    ("near_dedup", near_duplicates_out),
    ("substring_dedup", passages_out),
    ("decontamination", benchmark_out),
    ("sentencepiece", encoded),
]

#: No stage but the decontamination can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written to the shared folder before the next reads it, and deleted when that is written."""
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            forget(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)

"""From documents to packed training sequences: the stages a corpus goes through, each by one operator.

Every stage takes all that the stage before it kept, as Parquet written to the shared scratch folder, and but for the last
returns documents in the columns of `documents`; further columns are not carried on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm import mixing, ngram_join, packing, quality, secrets
from siltworks.llm.common import table
from siltworks.plans.scratch import scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
QUALITY_THRESHOLD = 0.7
SEQUENCE = 1024


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; nothing goes where no label could be learned from.

    Rows that share a doc_id stay if the best of them does; rows without an id stay."""
    own = docs.select(*COLUMNS)
    scored, model = quality.classify(own, table(spark, sf_dir, "labels"))
    if not model.fitted:
        return own
    rejected = scored.groupBy("doc_id").agg(F.max("score").alias("_score")).where(F.col("_score") < QUALITY_THRESHOLD).select("doc_id")
    return own.join(rejected, "doc_id", "left_anti").select(*COLUMNS)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest doc_id.

    Of equal texts under one doc_id one row stays.  Of different texts under one id each leaves or stays by itself, and near
    copies under one id stay.  Rows without an id only leave for an equal text without an id."""
    own = docs.select(*COLUMNS)
    leaving = ngram_join.near_copies(own).where("doc_id <> component_id").select("doc_id", F.col("text_hash").alias("_text")).distinct()
    kept = own.withColumn("_text", F.xxhash64("text")).join(leaving, ["doc_id", "_text"], "left_anti")
    return kept.withColumn("_text", F.sha2("text", 256)).dropDuplicates(["doc_id", "_text"]).select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; n_chars follows the text."""
    found = secrets.scan(docs.select(*COLUMNS))
    text = secrets.masked("text", "secrets")
    return found.withColumns({"text": text, "n_chars": F.when(F.size("secrets") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))}).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each copy, none for what it leaves out."""
    sized = docs.select(*COLUMNS).withColumns({"_size": mixing.word_count(F.col("text")), "_sources": F.array("source")})
    mixed = mixing.mix(sized, "_size", "_sources")
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece of a document with its place in a sequence and its ids."""
    pieces = packing.pack(packing.encode_texts(docs.select(*COLUMNS), "doc_id", "text"), tokens=SEQUENCE)
    return pieces.select(F.col("key").alias("doc_id"), "start", "length", "doc_tokens", "sequence_id", "offset", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("secret scans", secrets_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

# Boosted trees, seeded selections and bin packing are not SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

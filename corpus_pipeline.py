"""A corpus pipeline: five stages over ``documents``, each one written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratus.llm import crf_quality, line_dedup, near_dup, packing, secret_scan
from stratus.llm.common import documents, row_key, saved


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line labels reject go; the others stay as they are.

    Null and empty texts have too few words and go. Rows that share an id are judged each by its own text. An empty table gives an
    empty one, columns of any name stay.
    """
    model = crf_quality.fit(docs, crf_quality.labels_of(spark, sf_dir))
    return crf_quality.kept_documents(docs, model)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that another line before them is equal or near to go; ``n_chars`` follows the text.

    Null texts stay null, empty ones empty; of rows that share an id each loses its own lines. An empty table gives an empty one.
    """
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the smallest doc_id, of rows that share it the smallest hash of the text, of equal
    rows any one. Rows without an id are judged like all others, after those with one. Texts without a word (null ones too) are in no group and stay, all of them."""
    tie = F.xxhash64(F.col("text").cast("string"))
    boxed = docs.select(F.struct(*docs.columns).alias("row"), row_key().alias("key"), tie.alias("tie"))
    judged = saved(near_dup.near_duplicates(boxed.select("key", "row.text"), id_col="key", more=("tie",)), "judged")
    first = judged.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct("doc_id", "tie")).alias("first")).select("first.*")
    kept = first.unionByName(judged.where("n_shingles = 0").select("doc_id", "tie").distinct()).withColumnRenamed("doc_id", "key")
    stay = boxed.join(kept, ["key", "tie"], "left_semi")
    # equal rows are one document; few keys have any, and only their rows are dealt out again
    several = judged.where("n_shingles > 0").groupBy(F.col("doc_id").alias("key"), "tie").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    once = stay.join(several, ["key", "tie"], "left_anti")
    again = stay.join(several, ["key", "tie"], "left_semi").groupBy("key", "tie").agg(F.first("row").alias("row"))
    return once.select("row.*").unionByName(again.select("row.*"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; ``n_chars`` follows the text. Null stays null; no row goes, repeated rows are masked alike. An empty table gives an empty one."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and place of every document that is left, one row each also for rows that share an id; null and empty texts are the end token alone. An empty table gives an empty one."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_deduplication),
    ("MinHash near-dedup", near_deduplication),
    ("secret scans", secrets),
    ("packing", packing_stage),
]
#: Viterbi decoding, signatures and components are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

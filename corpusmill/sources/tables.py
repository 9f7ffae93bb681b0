"""The synthetic tables as inputs of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions that documents take in turn by id; the last is unknown on purpose.
SUFFIXES = ("py", "java", "html", "md", "json", "c", "js", "zzz")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, suffix: str | None = None, header: bool = False) -> DataFrame:
    """documents with paths by id, stars from labels and an ordinal; header: every second text becomes a run of comments."""
    quality = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    ext = F.lit(suffix) if suffix else F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("doc_id") % len(SUFFIXES) + 1).cast("int"))
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n# ")), F.lit("\nx = 1\n"))).otherwise(F.col("text")) if header else F.col("text")
    return read(spark, sf_dir, "documents").join(quality, "doc_id", "left").select(
        text.alias("content"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), F.coalesce("q", F.lit(0)).cast("long").alias("stars"),
        F.col("doc_id").cast("double").alias("commit_time"), "source", F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").alias("ord"),
    )


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select(F.col("html").alias("content"), F.regexp_replace("url", "[?#].*$", "").alias("path"), F.col("page_id").cast("string").alias("doc_id"))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("long").alias("label"))
    return read(spark, sf_dir, "documents").join(labels, "doc_id").select(F.col("text").alias("content"), "label")


def metadata(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(rows, blobs) of an ingestion: some rows oversize, without a blob id, unknown to the blob table, or empty."""
    docs, i = read(spark, sf_dir, "documents"), F.col("doc_id")
    rows = docs.select(
        F.when(i % 11 != 3, F.concat(F.lit("b"), i.cast("string"))).alias("blob_id"), F.concat("source", F.lit("/"), i.cast("string"), F.lit(".py")).alias("path"), F.col("source").alias("repo_name"),
        F.when(i % 13 == 5, 9_000_000).otherwise(F.octet_length("text")).cast("long").alias("length_bytes"), (i % 100).alias("star_events_count"), F.lit("utf-8").alias("src_encoding"),
        F.when(i % 3 == 0, F.lit("")).otherwise(F.lit("2023-05-06T07:08:09Z")).alias("revision_date"), (F.lit(1_600_000_000) + i).cast("string").alias("visit_date"),
    )
    blobs = docs.filter(i % 17 != 4).select(F.concat(F.lit("b"), i.cast("string")).alias("blob_id"), F.when(i % 19 == 6, F.lit("")).otherwise(F.col("text")).alias("content"))
    return rows, blobs

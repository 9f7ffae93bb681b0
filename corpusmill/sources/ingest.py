"""Ingestion: metadata rows joined to a blob table, with gates and counters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.prefix import running_total
from corpusmill.functions.textfn import first_nonempty
from corpusmill.sources.languages import category

#: Fields that may hold a row's time, in order of preference (fixed values).
TIME_FIELDS = ("gha_updated_at", "gha_created_at", "revision_date", "committer_date", "visit_date")
MAX_BYTES = 8 * 1024 * 1024


def parse_time(*fields: Column) -> Column:
    """Epoch seconds of the first field that is a number other than 0 or an ISO time (UTC where it names no zone); else 0."""
    tries = []
    for f in fields:
        text = F.nullif(f.cast("string"), F.lit(""))
        as_number = text.try_cast("double")
        tries.append(F.nullif(as_number, F.lit(0.0)))
        tries.append(F.when(as_number.isNull(), F.unix_micros(F.try_to_timestamp(text)) / F.lit(1e6)))
    return F.coalesce(*tries, F.lit(0.0))


def write_partitioned(rows: DataFrame, path: str, language: str = "language") -> None:
    """Metadata rows as Parquet, one folder a language; no shuffle, so a task writes a file for each language it holds."""
    rows.write.mode("overwrite").partitionBy(language).parquet(path)


def read_language(spark: SparkSession, path: str, *names: str, language: str = "language") -> DataFrame:
    """The rows of the named languages (all without a name): the folders of others are never listed as input."""
    rows = spark.read.parquet(path)
    return rows.filter(F.col(language).isin(*names)) if names else rows


def decode_blobs(blobs: DataFrame) -> DataFrame:
    """(blob_id, src_encoding, raw: binary) -> (blob_id, content): gzip is unpacked, bytes that the encoding lacks are replaced, an unknown encoding is read as UTF-8."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip

        for p in parts:
            texts = []
            for raw, name in zip(p["raw"], p["src_encoding"], strict=True):
                try:
                    raw = gzip.decompress(raw) if raw is not None and raw[:2] == b"\x1f\x8b" else raw
                    texts.append(None if raw is None else bytes(raw).decode(name or "utf-8", "replace"))
                except LookupError:
                    texts.append(bytes(raw).decode("utf-8", "replace"))
                except (OSError, EOFError):
                    texts.append(None)
            yield pd.DataFrame({"blob_id": p["blob_id"], "content": texts})

    return blobs.select("blob_id", "src_encoding", "raw").mapInPandas(run, "blob_id string, content string")


def ingest_status(rows: DataFrame, blobs: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """rows (blob_id, length_bytes, ...) with content and status: skip_too_large, skip_no_blob, skip_fetch_error, skip_empty or yielded.

    The size gate stands before the join, so that the contents of oversize rows are never fetched. blobs is (blob_id, content), one row
    a blob; a null content there is a fetch error.
    """
    large = F.coalesce(F.col("length_bytes"), F.lit(0)) > max_bytes
    named = F.coalesce(F.col("blob_id"), F.lit("")) != ""
    keyed = rows.withColumn("_blob", F.when(~large & named, F.col("blob_id")))
    df = keyed.join(blobs.select(F.col("blob_id").alias("_blob"), "content", F.lit(True).alias("_found")), "_blob", "left")
    status = F.when(large, "skip_too_large").when(~named, "skip_no_blob").when(F.col("content").isNull(), "skip_fetch_error").when(F.col("content") == "", "skip_empty").otherwise("yielded")
    return df.withColumn("status", status).drop("_blob", "_found")


def limited(judged: DataFrame, limit: int, order: str, language: str = "language") -> DataFrame:
    """The rows of each language, by `order` (a long that tells rows apart), up to the one that is the limit-th to be yielded.

    A running sum says how many are yielded before a row, so that no language meets in one task.
    """
    flags = judged.select(language, order, (F.col("status") == "yielded").cast("long").alias("_got"))
    return judged.join(running_total(flags, "_got", order, by=language, into="_before").filter(F.col("_before") < limit).select(order), order, "left_semi")


def stats(judged: DataFrame) -> DataFrame:
    """counters, and all rows as 'seen'."""
    return counters(judged).unionByName(judged.agg(F.count(F.lit(1)).alias("n")).select(F.lit("seen").alias("status"), "n"))


def counters(judged: DataFrame) -> DataFrame:
    return judged.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def to_documents(judged: DataFrame, language: Column, source: str = "the-stack-v2", times: tuple[str, ...] = TIME_FIELDS) -> DataFrame:
    """Documents of the rows that got through, with what the metadata knows of them."""
    has = lambda c: F.col(c) if c in judged.columns else F.lit(None)
    return judged.filter("status = 'yielded'").select(
        "content", first_nonempty(has("path").cast("string")).alias("path"), language.alias("language"), category(language).alias("category"),
        first_nonempty(has("repo_name").cast("string")).alias("repo_name"), F.coalesce(has("star_events_count").cast("long"), F.lit(0)).alias("stars"),
        parse_time(*(F.col(c) for c in times if c in judged.columns)).alias("commit_time"), F.lit(source).alias("source"), F.col("blob_id").cast("string").alias("doc_id"),
        F.struct(has("src_encoding").cast("string").alias("src_encoding"), has("length_bytes").cast("long").alias("length_bytes")).alias("meta"),
    )

"""The stages that need one document at a time, on a stream, and incremental exact deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.config import AdmitConfig, RedactConfig
from corpusmill.operators.admit import admit
from corpusmill.operators.exact_dedup import content_hash
from corpusmill.operators.redact import transform_documents
from corpusmill.operators.signals import FilterConfig, annotate, keep_unfired
from corpusmill.sources.jsonl import DEFAULTS, DOCUMENT_DDL


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """JSON Lines files as they arrive."""
    df = spark.readStream.schema(DOCUMENT_DDL).json(folder)
    return df.select(*(F.coalesce(c, F.lit(DEFAULTS[c])).alias(c) if c in DEFAULTS else F.col(c) for c in df.columns))


def clean(stream: DataFrame, admit_cfg: AdmitConfig = AdmitConfig(), redact: RedactConfig = RedactConfig(), rules: FilterConfig = FilterConfig()) -> DataFrame:
    """Admission, redaction, signals and rules: the batch operators, unchanged, since none of them keeps state."""
    return keep_unfired(annotate(transform_documents(admit(stream, admit_cfg), redact), rules))


def first_seen(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """One document of each content within the watermark: the first that arrives, not the best, as a stream cannot take rows back."""
    return stream.withColumn("_hash", content_hash(F.col("content"))).withWatermark(time, delay).dropDuplicatesWithinWatermark(["_hash"]).drop("_hash")


def keep_best(stream: DataFrame, keep_by: tuple[str, ...] = ("stars", "commit_time")) -> DataFrame:
    """(_hash, best) of each content seen so far: the row with the greatest keep_by columns, then the greatest path. A running maximum, in update
    mode, so that a better copy that comes later takes the place of an earlier one in a sink that is keyed by _hash."""
    rank = F.struct(*(F.col(c) for c in keep_by), F.struct(*(F.col(c) for c in ("path", "doc_id", "content", "source"))).alias("row"))
    return stream.withColumn("_hash", content_hash(F.col("content"))).groupBy("_hash").agg(F.max(rank).alias("best"))


def write(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Admission: normalise texts, gate by size, resolve language and category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.config import AdmitConfig
from corpusmill.sources.languages import category, detect_language


def normalize(c: Column) -> Column:
    r"""Without a leading byte-order mark, and with \n for \r\n and \r."""
    return F.regexp_replace(F.regexp_replace(c, r"^\x{FEFF}", ""), r"\r\n?", "\n")


def admit(docs: DataFrame, cfg: AdmitConfig = AdmitConfig()) -> DataFrame:
    """Documents that pass the gates, with language, category and a doc_id (the content's hash where it is empty).

    Documents of only white space pass; a null content does not.
    """
    text = normalize(F.col("content")) if cfg.normalize_newlines else F.col("content")
    known = F.coalesce(F.nullif(F.col("language"), F.lit("")), detect_language(F.col("path"))) if "language" in docs.columns else detect_language(F.col("path"))
    df = docs.withColumn("content", text).filter((F.length("content") >= cfg.min_content_chars) & (F.octet_length("content") <= cfg.max_file_bytes))
    df = df.withColumn("language", known if cfg.require_known_language else F.coalesce(known, F.lit("Unknown"))).filter(F.col("language").isNotNull())
    own = F.nullif(F.col("category"), F.lit("")) if "category" in df.columns else F.lit(None).cast("string")
    df = df.withColumn("category", F.coalesce(own, category(F.col("language"))))
    return df.withColumn("doc_id", F.coalesce(F.nullif(F.col("doc_id").cast("string"), F.lit("")), F.sha2("content", 256)))

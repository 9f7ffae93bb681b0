"""Exact deduplication by content hash, keeping the best document of each group."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.config import ExactDedupConfig


def content_hash(c: Column, algorithm: str = "sha256") -> Column:
    """The hex digest of a text by any algorithm that hashlib knows; md5 and the SHA family stay in the JVM."""
    if algorithm in ("md5", "sha1"):
        return F.call_function(algorithm, c)
    if algorithm in ("sha224", "sha256", "sha384", "sha512"):
        return F.sha2(c, int(algorithm[3:]))
    if algorithm not in hashlib.algorithms_available or algorithm.startswith("shake"):
        raise ValueError(f"no such hash: {algorithm}")

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else hashlib.new(algorithm, t.encode()).hexdigest())

    return digest(c)


def keep_best(docs: DataFrame, group: str, keep_by: tuple[str, ...], order: str) -> DataFrame:
    """The row of each group with the greatest keep_by columns; of ties, the first by `order`.

    The best key of a group is a max, combined before its shuffle; rows are then joined to it, so that a group of any
    size is spread over tasks and texts are never buffered per group. `order` tells rows apart.
    """
    key = F.struct(*(F.col(c) for c in keep_by), (-F.col(order)).alias("_first"))
    best = docs.groupBy(group).agg(F.max(key).alias("_best"))
    best = best.withColumnRenamed(group, "_group")
    return docs.join(best, (F.col(group) == F.col("_group")) & key.eqNullSafe(F.col("_best")), "left_semi")


def exact_dedup(docs: DataFrame, cfg: ExactDedupConfig = ExactDedupConfig(), order: str = "ord") -> DataFrame:
    """One document of each content. `order` is the input's ordinal column."""
    return keep_best(docs.withColumn("_hash", content_hash(F.col("content"), cfg.hash_algorithm)), "_hash", cfg.keep_by, order).drop("_hash")

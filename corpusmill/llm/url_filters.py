"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes and confirmed by full digests.

Plan: each distinct shape of the rules (labels in the host, characters in the path) gives at most one expression a URL. Suffixes of a
host are one row a label, and meet the shapes of so many labels in a table of shapes; so a URL expands to as many rows as the rules have
shapes that fit it, with no cap on labels or depth, and the plan is the same for five rules and for millions. The expressions meet the rules
on the first hex digits of their SHA-256; the full digest confirms, and the precedence (longest rule, then longest host, then
block before allow) is a max that is combined before the shuffle. Spark broadcasts shapes and rules while their size is below
its own threshold and shuffles both sides beyond it; a rule's key is unique, so AQE can split a hot host's rows. Each distinct
host and path is judged once; URLs without either are not judged at all.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import ascii_lower

_PARTS = r"://([^/?#]*)([^?#]*)"
#: Hex digits of a digest that the join compares first.
PREFIX = 8


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, _PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path, verdict) as a table."""
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule (the rule that decided, else null) and verdict ('allow' or 'block').

    A null URL, or one without '://', has an empty host and path and takes the default, as does any URL that no rule
    fits. Repeated rows stay repeated; an empty table stays empty, and without rules all take the default. Rules with a null part are
    ignored; of equal rules, 'block' wins. URLs may be of any length. Columns of pages that have one of the four names are replaced.
    """
    rules = rules.dropna(subset=["host", "path", "verdict"])
    keyed = rules.select(
        F.concat("host", "path").alias("rule"), F.length("host").alias("host_len"), F.col("verdict").alias("says"),
        _digest(ascii_lower(F.col("host")), F.col("path")).alias("digest"),
    ).withColumn("prefix", F.left("digest", F.lit(PREFIX)))
    shapes = rules.select(F.size(F.split("host", r"\.")).alias("_labels"), F.length("path").alias("_length")).distinct()
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parsed = pages.withColumns({"_url_host": host_of(F.col(url)), "_url_path": path_of(F.col(url))})
    host, path = F.col("_url_host"), F.col("_url_path")
    each = parsed.filter((host != "") | (path != "")).select(host, path).distinct()
    each = each.select(host, path, F.explode(F.sequence(F.lit(1), F.size(F.split(host, r"\.")))).alias("_labels")).join(shapes, "_labels").filter(F.length(path) >= F.col("_length"))
    # substring_index takes a negative column for a suffix of so many labels.
    full = _digest(F.call_function("substring_index", host, F.lit("."), -F.col("_labels")), F.left(path, F.col("_length")))
    exploded = each.select(host, path, full.alias("full")).withColumn("prefix", F.left("full", F.lit(PREFIX)))
    rank = F.struct(F.length("rule").alias("len"), "host_len", (F.col("says") == "block").alias("block"), "rule", "says")
    best = exploded.join(keyed, "prefix").filter("full = digest").groupBy("_url_host", "_url_path").agg(F.max(rank).alias("_url_best"))
    return parsed.join(best, ["_url_host", "_url_path"], "left").select(
        *kept, host.alias("host"), path.alias("path"), F.col("_url_best.rule").alias("rule"), F.coalesce("_url_best.says", F.lit(default)).alias("verdict")
    )

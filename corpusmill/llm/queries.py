"""The registered queries of the ten operators, opN_<name>, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import chat_quotes, fingerprints, jaccard_join, line_dedup, mixing, packing, quality_rules, suffix_dedup, toxicity, url_filters
from corpusmill.llm.common import table, written
from corpusmill.llm.oracles import ORACLES

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.judge(pages, url_filters.rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


def op5_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's conversations hold no quotes, so its turns are first written as mail threads write them."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = chat_quotes.conversations(written(chat_quotes.quoting(turns)))
    return done.select("conv_id", "turn", "role", "parent_turn", "root_turn", "depth", F.array_join("path", "/").alias("path"), "n_quoted", "formatted")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    return done.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("kept_md5"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    judged = quality_rules.judge(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~toxicity.held_out("doc_id")))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

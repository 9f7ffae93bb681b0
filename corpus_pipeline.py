"""The corpus pipeline: five stages over documents, each written as Parquet and reread as the next one's input.

toxicity drops the documents that the fitted model rejects; line_dedup takes recurring template lines out and drops the
documents that it leaves without a word; near_dup keeps the document of least doc_id of each group of linked ones; mixing
repeats, cuts and leaves out documents by their sources' targets; packing returns pieces of sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.llm import jaccard_join, line_dedup, mixing, packing, toxicity
from corpusmill.llm.common import WORD, table, written

#: Near copies share 0.8 or more of their shingles of five words; op10's own figures are those of its query alone.
NEAR_WORDS, NEAR_NUM, NEAR_DEN = 5, 80, 100


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below the threshold; labels come from the rows that are not held out."""
    labels = table(spark, sf_dir, "labels").filter(~toxicity.held_out("doc_id"))
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    return toxicity.score(docs, model).filter("predicted = 0").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring template lines. A document that had words and keeps none goes; one without words stays."""
    done = line_dedup.dedup(docs)
    done = done.filter((F.col("n_dropped") == 0) | F.col("text").rlike(WORD))
    return done.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each linked group: the least doc_id, and of rows with that id the least text hash, once.

    Documents without words are linked with nothing and all stay.
    """
    members, found, *_ = jaccard_join.join(docs.select("doc_id", "text"), width=NEAR_WORDS, num=NEAR_NUM, den=NEAR_DEN)
    groups = jaccard_join.groups(members, found)
    # A table of the texts that stay, one row a group: no text is shuffled but to meet its own hash.
    best = groups.filter("n_shingles > 0").groupBy("group").agg(F.min(F.struct(F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).alias("id"), "node")).alias("b"))
    best = best.select("b.id", "b.node").withColumn("_keep", F.lit(True))
    rows = docs.withColumns({"node": F.xxhash64(F.coalesce("text", F.lit(""))), "id": F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)), "_words": F.coalesce(F.col("text").rlike(WORD), F.lit(False))})
    rows = rows.join(best, ["id", "node"], "left").filter("_keep or not _words")
    # Rows repeated whole, doc_id and text alike, stay once too.
    turn = F.row_number().over(W.partitionBy("id", "node").orderBy(F.lit(0)))
    return rows.withColumn("_turn", turn).filter("_turn = 1 or not _words").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.expand(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dup", drop_near_copies), ("mixing", mix), ("packing", pack)]
#: Neither the model's scores nor packing can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage before it is a scratch table."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs

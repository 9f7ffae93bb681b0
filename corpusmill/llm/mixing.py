"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

The water level is found in closed form: in ascending order of cap by weight, a source is clamped while its cap is below
what the weights would give it once all before it are clamped. Each source then takes every document whole as often as
the target allows; what is left goes to a seeded order of its documents, and the document in which it runs out gives a
fractional repetition. The running sum in that order is two sums: over 4096 hash ranges of a source (a small table) and
inside one range, so a source with a third of all rows never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.llm.common import WORD, word_count, written

WEIGHTS, MAX_EPOCHS, SEED = (5, 2, 1), 3, 17


def water_fill(sizes: DataFrame, max_epochs: int = MAX_EPOCHS, total: int | None = None) -> DataFrame:
    """sizes (source, source_size, weight; one row a source) with target (double): min(cap, level * weight), summing to
    total (default: all sizes) or to all caps if they are less. Sources of size 0 get 0; an empty table stays empty."""
    every = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source")).rowsBetween(W.unboundedPreceding, -1)
    s = sizes.withColumns({
        "_cap": F.col("source_size") * max_epochs,
        "_t": F.lit(total).cast("long") if total is not None else F.sum("source_size").over(every),
        "_w": F.sum("weight").over(every),
    })
    s = s.withColumns({"_cap_before": F.coalesce(F.sum("_cap").over(before), F.lit(0)), "_w_before": F.coalesce(F.sum("weight").over(before), F.lit(0))})
    s = s.withColumn("_clamped", F.expr("cast(_cap as decimal(38,0)) * (_w - _w_before) <= cast(_t - _cap_before as decimal(38,0)) * weight"))
    clamped = lambda c: F.coalesce(F.sum(F.when(F.col("_clamped"), F.col(c))).over(every), F.lit(0))
    s = s.withColumns({"_left": F.col("_t") - clamped("_cap"), "_w_left": F.col("_w") - clamped("weight")})
    target = F.when(F.col("_clamped"), F.col("_cap").cast("double")).otherwise(F.col("_left").cast("double") / F.col("_w_left") * F.col("weight"))
    return s.withColumn("target", target).select(*sizes.columns, "target")


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, source, size (words), source_size, target (its source's), taken (words, repeats counted), and the columns named in extra.

    Sources take the weights in turn, by code point, null last. A null text has size 0 and is never taken. Documents of
    one hash are ordered by doc_id and size; rows that are alike in all three are interchangeable. taken sums to the
    rounded target in each source and is at most max_epochs times a document's size.
    """
    rows = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))), 1, 16).alias("_h"), *extra))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    sources = water_fill(sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long")), max_epochs)
    sources = sources.select("source", "source_size", "target", F.round("target").cast("long").alias("_goal"))
    part = F.left("_h", F.lit(3))
    parts = rows.groupBy("source", part.alias("_part")).agg(F.sum("size").alias("_size"))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_size").over(W.partitionBy("source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    parts = parts.join(sources.withColumnRenamed("source", "_src"), F.col("source").eqNullSafe(F.col("_src"))).select("_src", F.col("_part").alias("_p"), "_before", "source_size", "target", "_goal")
    rows = rows.withColumn("_part", part).join(parts, F.col("source").eqNullSafe(F.col("_src")) & (F.col("_part") == F.col("_p")))
    inside = F.coalesce(F.sum("size").over(W.partitionBy("source", "_part").orderBy("_h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"_at": F.col("_before") + inside, "_n": F.greatest("source_size", F.lit(1))})
    more = F.greatest(F.lit(0), F.least(F.col("size"), F.expr("_goal % _n") - F.col("_at")))
    return rows.select("doc_id", "source", *extra, "size", "source_size", "target", (F.expr("_goal div _n") * F.col("size") + more).alias("taken"))


def expand(docs: DataFrame, **options) -> DataFrame:
    """The mixture as rows of documents: each document as often as it is taken whole, and its first words for a fraction.

    Rows are joined to their plan by a hash of doc_id, source and text. Rows equal in all three share what they take alike, and the first of
    them one word more each until none is left over. Columns other than text and n_chars stay as they are, whatever their names; a null or
    blank text is never taken; an empty table stays empty. Texts may be of any length.
    """
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("source", F.lit("")), F.coalesce("text", F.lit("")))
    keyed = docs.withColumn("_key", key)
    planned = plan(keyed, extra=("_key",), **options).groupBy("_key").agg(F.max("size").alias("_size"), F.sum("taken").alias("_all"), F.count(F.lit(1)).alias("_rows"))
    rows = keyed.join(planned.filter("_all > 0"), "_key")
    turn = F.row_number().over(W.partitionBy("_key").orderBy(F.lit(0)))  # the join has dealt and sorted rows by key
    rows = rows.withColumn("_mine", F.expr("_all div _rows") + F.when(turn <= F.expr("_all % _rows"), 1).otherwise(0)).filter("_mine > 0")
    copies = F.expr("(_mine + _size - 1) div _size")
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    words = F.expr("least(_mine - (_copy - 1) * _size, _size)")
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), 0), 1, words.cast("int")), "")
    text = F.when(words == F.col("_size"), F.col("text")).otherwise(head)
    rows = rows.withColumn("text", text)
    return (rows.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else rows).select(*docs.columns)

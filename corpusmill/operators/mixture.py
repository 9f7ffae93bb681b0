"""Keyword corpus, token-budget mixture and quota composition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.config import AnnealingConfig
from corpusmill.functions.prefix import running_total
from corpusmill.functions.textfn import estimate_tokens, u01
from corpusmill.operators import synth
from corpusmill.sources.scratch import written


def sample_algorithmic(docs: DataFrame, cfg: AnnealingConfig = AnnealingConfig()) -> DataFrame:
    """Copies of the documents that hold enough keywords, tagged 'algorithmic', with keyword_hits."""
    text = F.lower(F.concat("path", F.lit("\n"), "content"))
    hits = sum((text.contains(k.lower()).cast("long") for k in cfg.keywords), F.lit(0).cast("long"))
    return docs.withColumn("keyword_hits", hits).filter(F.col("keyword_hits") >= cfg.min_keyword_hits).withColumn("source", F.lit("algorithmic"))


def targets(spark, budget: int, shares: dict[str, float]) -> DataFrame:
    """(source, target): round-half-even of each share of the budget."""
    total = sum(shares.values())
    return spark.createDataFrame([(s, x / total, round(budget * (x / total))) for s, x in shares.items()], "source string, share double, target long")


def mixture(docs: DataFrame, budget: int, cfg: AnnealingConfig = AnnealingConfig(), order: str = "ord") -> DataFrame:
    """Documents (source, content) by `order`, of each source until its share of the token budget is met: the last one may overshoot.

    tokens is on the result; sources without a share are left out.
    """
    shares = targets(docs.sparkSession, budget, cfg.shares).select("source", "target")
    counted = written(docs.select(order, "source", estimate_tokens(F.col("content")).alias("tokens")).join(F.broadcast(shares), "source"))
    before = running_total(counted, "tokens", order, by="source")
    taken = before.join(F.broadcast(shares), "source").filter("before < target").select(F.col(order), "tokens")
    return docs.join(taken, order).select(*docs.columns, "tokens")


def build_annealing(docs: DataFrame, seeds: DataFrame, budget: int, teacher: DataFrame, results: DataFrame | None, cfg: AnnealingConfig = AnnealingConfig()) -> DataFrame:
    """The mixture of cleaned documents, those with algorithmic keywords, validated snippets and textbook passages.

    docs (ord, path, content) feed the first two; seeds (ord, content) and a teacher the others. Columns: source, path, content, key, tokens.
    """
    own = docs.select("ord", "path", "content").withColumn("source", F.lit("refinecode"))
    parts = (own, sample_algorithmic(own, cfg), synth.snippets(seeds, teacher, results), synth.textbooks(seeds, teacher, cfg))
    pool = None
    for i, part in enumerate(parts):
        part = part.select("source", "path", "content", (F.col("ord") * len(parts) + i).alias("key"))
        pool = part if pool is None else pool.unionByName(part)
    return mixture(pool, budget, cfg, order="key")


def shuffled(df: DataFrame, seed: int, id: str = "doc_id") -> DataFrame:
    """A seeded order of rows, the same in every run."""
    return df.orderBy(u01(F.col(id), seed), id)


def mixture_report(mixed: DataFrame, budget: int, cfg: AnnealingConfig = AnnealingConfig()) -> DataFrame:
    """(source, docs, tokens, target_share, actual_share) for every source of the mixture; sources without documents count 0."""
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"))
    total = got.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all")).first()["all"]
    rows = targets(mixed.sparkSession, budget, cfg.shares).join(got, "source", "left")
    tokens = F.coalesce("tokens", F.lit(0))
    return rows.select("source", F.coalesce("docs", F.lit(0)).alias("docs"), tokens.alias("tokens"), F.col("share").alias("target_share"), (tokens / F.lit(float(max(total, 1)))).alias("actual_share"))


def compose(examples: DataFrame, quotas: dict[str, int], stage: int, seed: int = 42, id: str = "id") -> DataFrame:
    """Up to its quota of each source's examples, drawn by a seeded hash, tagged with the stage."""
    table = examples.sparkSession.createDataFrame(list(quotas.items()), "source string, quota long")
    most = max(quotas.values(), default=0)
    drawn = examples.withColumn("_rn", F.row_number().over(W.partitionBy("source").orderBy(u01(F.col(id), seed), id))).filter(F.col("_rn") <= most)  # pruned to the top rows before the shuffle
    return drawn.join(table, "source").filter("_rn <= quota").drop("_rn", "quota").withColumn("stage", F.lit(stage))


def compose_two_stage(examples: DataFrame, stage1: dict[str, int], stage2: dict[str, int], seed: int = 42, id: str = "id") -> DataFrame:
    return compose(examples, stage1, 1, seed, id).unionByName(compose(examples, stage2, 2, seed, id))


def compose_report(composed: DataFrame, stage1: dict[str, int], stage2: dict[str, int]) -> DataFrame:
    """(stage, source, target, actual), 0 for sources without examples."""
    rows = [(1, s, n) for s, n in stage1.items()] + [(2, s, n) for s, n in stage2.items()]
    table = composed.sparkSession.createDataFrame(rows, "stage int, source string, target long")
    got = composed.groupBy("stage", "source").agg(F.count(F.lit(1)).alias("actual"))
    return table.join(got, ["stage", "source"], "left").select("stage", "source", "target", F.coalesce("actual", F.lit(0)).alias("actual"))

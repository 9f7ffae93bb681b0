"""Recall of code-related web pages: a file-name rule, and naive Bayes over distinct words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.config import RecallConfig

#: Words that are in the vocabulary whatever the seeds (fixed values).
CODE_HINTS = """def class function return import from public static void const var let print println console for while
if else try except catch throw async await npm pip install git commit traceback error exception stack compile runtime
argument parameter method variable array list dict struct pointer null none true false code""".split()


def words(c: Column) -> Column:
    """Distinct lower-cased identifiers of two or more characters."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z_][A-Za-z0-9_]+"), 0), F.lower))


def by_filename(path: Column, cfg: RecallConfig = RecallConfig()) -> Column:
    name = F.lower(F.regexp_extract(path, "[^/]*$", 0))
    stem = F.regexp_replace(name, r"^(\.*[^.].*)\.[^.]*$", "$1")
    return name.contains(cfg.filename_substring) | stem.isin(*cfg.filename_stems)


def train(seed: DataFrame) -> DataFrame:
    """(token, weight, bias) from seed (content, label): smoothed document frequencies; the bias is on every row."""
    totals = seed.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("pos"), F.coalesce(F.sum(1 - F.col("label")), F.lit(0)).alias("neg"))
    counts = seed.select("label", F.explode(words(F.col("content"))).alias("token")).groupBy("token").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    hints = seed.sparkSession.createDataFrame([(w,) for w in CODE_HINTS], "token string").select("token", F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"))
    counts = counts.unionByName(hints).groupBy("token").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    n = totals.first()  # two numbers
    rate = lambda k, m: F.log((F.col(k) + 1) / F.lit(float(m + 2)))
    return counts.select("token", (rate("p", n.pos) - rate("q", n.neg)).alias("weight")).withColumn("bias", F.log(F.lit((n.pos + 1) / (n.neg + 1))))


def score(docs: DataFrame, weights: DataFrame, id: str = "doc_id") -> DataFrame:
    """docs with code_prob: the sigmoid of the bias and the weights of the distinct words; rows need unique ids."""
    bias = F.lit(weights.agg(F.max("bias")).first()[0] or 0.0)
    hits = docs.select(id, F.explode(words(F.col("content"))).alias("token")).join(weights.select("token", "weight"), "token")
    sums = hits.groupBy(id).agg(F.sum("weight").alias("_s"))
    return docs.join(sums, id, "left").withColumn("code_prob", 1 / (1 + F.exp(-(bias + F.coalesce("_s", F.lit(0.0)))))).drop("_s")


def recall(docs: DataFrame, weights: DataFrame, cfg: RecallConfig = RecallConfig(), id: str = "doc_id") -> DataFrame:
    """Documents that the file name or the classifier recalls; code_prob (4 decimals) only for the latter. Pages that the name recalls are not scored."""
    named = docs.filter(by_filename(F.col("path"), cfg)).withColumn("code_prob", F.lit(None).cast("double"))
    rest = score(docs.filter(~F.coalesce(by_filename(F.col("path"), cfg), F.lit(False))), weights, id)
    return named.unionByName(rest.filter(F.col("code_prob") >= cfg.threshold).withColumn("code_prob", F.round("code_prob", 4)))

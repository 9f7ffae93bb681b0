"""JSON Lines (optionally gzipped, by suffix) with fixed schemas: unknown keys are left out, missing ones take defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.textfn import first_nonempty

DOCUMENT_DDL = (
    "content string, path string, language string, category string, repo_name string, stars long, commit_time double, source string, doc_id string, "
    "filtered_by array<string>, meta string"
)
EXAMPLE_DDL = "instruction string, response string, source string, language string, stage int, meta string"
DEFAULTS = {"path": "", "language": "", "category": "", "repo_name": "", "stars": 0, "commit_time": 0.0, "source": "github", "doc_id": ""}


def read_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """Documents of all files; a malformed line, or one without content, stops the read."""
    df = spark.read.schema(DOCUMENT_DDL).option("mode", "FAILFAST").json(list(paths))
    df = df.select(*(F.coalesce(c, F.lit(DEFAULTS[c])).alias(c) if c in DEFAULTS else F.col(c) for c in df.columns))
    return df.withColumn("content", F.when(F.col("content").isNull(), F.raise_error(F.lit("a document has no content"))).otherwise(F.col("content")))


def read_examples(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema(EXAMPLE_DDL).option("mode", "FAILFAST").json(list(paths))


def read_labelled(spark: SparkSession, *paths: str) -> DataFrame:
    """(content, path, label) rows; a missing label is 0."""
    return spark.read.schema("content string, path string, label int").json(list(paths)).select("content", "path", F.coalesce("label", F.lit(0)).alias("label"))


def read_texts(spark: SparkSession, *paths: str, field: str = "content") -> DataFrame:
    """One text a record: the named field, else 'text'; records with neither, or with an empty one, are left out."""
    texts = spark.read.schema(f"{field} string" + ("" if field == "text" else ", text string")).json(list(paths)).select(first_nonempty(F.col(field), F.col("text")).alias("text"))
    return texts.filter("text <> ''")


def write(df: DataFrame, path: str, gzip: bool = False) -> int:
    """Write JSON Lines with all keys; returns the number of rows, counted in the same job."""
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("ignoreNullFields", "false")
    (out.option("compression", "gzip") if gzip else out).json(path)
    return seen.get["n"]


def wrap_examples(rows: DataFrame, source: str, language: str = "") -> DataFrame:
    """Instruction rows from any of the usual column names; rows with an empty side are left out."""
    pick = lambda *names: first_nonempty(*(F.col(n) for n in names if n in rows.columns))
    made = rows.select(pick("instruction", "prompt", "input").alias("instruction"), pick("response", "output", "completion").alias("response"), F.lit(source).alias("source"), F.lit(language).alias("language"))
    return made.filter("instruction <> '' and response <> ''")

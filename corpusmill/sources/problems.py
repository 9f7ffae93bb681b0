"""Readers of evaluation problems, with the aliases that such files use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.textfn import first_nonempty


def load_completion(spark: SparkSession, *paths: str) -> DataFrame:
    """(task_id, prompt, entry_point, test, canonical_solution); the last may be missing."""
    df = spark.read.schema("task_id string, prompt string, entry_point string, test string, canonical_solution string").json(list(paths))
    return df.withColumn("canonical_solution", F.coalesce("canonical_solution", F.lit("")))


def load_function(spark: SparkSession, *paths: str) -> DataFrame:
    """(task_id, text, test_list, test_setup_code, code); task_id may be called id, and text prompt."""
    df = spark.read.schema("task_id string, id string, text string, prompt string, test_list array<string>, test_setup_code string, code string").json(list(paths))
    return df.select(
        first_nonempty(F.col("task_id"), F.col("id")).alias("task_id"), first_nonempty(F.col("text"), F.col("prompt")).alias("text"), F.coalesce("test_list", F.array().cast("array<string>")).alias("test_list"),
        F.coalesce("test_setup_code", F.lit("")).alias("test_setup_code"), F.coalesce("code", F.lit("")).alias("code"),
    )


def sample_completion(spark: SparkSession) -> DataFrame:
    """Three small problems with solutions, in the columns of load_completion, for runs without a file."""
    rows = [
        ("sample/0", "def double(n):\n    \"\"\"Twice n.\"\"\"\n", "double", "def check(f):\n    assert f(4) == 8\n    assert f(-1) == -2\n", "    return 2 * n\n"),
        ("sample/1", "def vowels(word):\n    \"\"\"How many vowels word has.\"\"\"\n", "vowels", "def check(f):\n    assert f('aerie') == 4\n    assert f('') == 0\n", "    return sum(c in 'aeiou' for c in word)\n"),
        ("sample/2", "def ends(items):\n    \"\"\"The first and the last item.\"\"\"\n", "ends", "def check(f):\n    assert f([3, 5, 7]) == (3, 7)\n    assert f('x') == ('x', 'x')\n", "    return items[0], items[-1]\n"),
    ]
    return spark.createDataFrame(rows, "task_id string, prompt string, entry_point string, test string, canonical_solution string")


def sample_function(spark: SparkSession) -> DataFrame:
    """Three small problems with solutions, in the columns of load_function."""
    rows = [
        ("0", "Write a function `area` that gives the area of a rectangle.", ["assert area(2, 3) == 6", "assert area(0, 9) == 0"], "", "def area(a, b):\n    return a * b\n"),
        ("1", "Write a function `longest` that gives the longest of some words.", ["assert longest(['a', 'abc', 'ab']) == 'abc'"], "", "def longest(words):\n    return max(words, key=len)\n"),
        ("2", "Write a function `whole_root` that rounds a square root down.", ["assert whole_root(17) == 4", "assert whole_root(16) == math.isqrt(16)"], "import math", "def whole_root(n):\n    return math.isqrt(n)\n"),
    ]
    return spark.createDataFrame(rows, "task_id string, text string, test_list array<string>, test_setup_code string, code string")

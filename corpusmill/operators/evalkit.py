"""Program assembly and pass@k."""

from __future__ import annotations

import os
import subprocess
import sys
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.textfn import code_blocks, strip

#: What ends a completion (fixed values).
STOPS = ("\nclass ", "\ndef ", "\n#", "\nif __name__", "\nprint(", "\n@", "\n```", "\nassert ", "\nimport ", "\nfrom ")


def truncate_at_stops(text: Column, stops: tuple[str, ...] = STOPS) -> Column:
    first = F.least(*(F.nullif(F.instr(text, F.lit(s)), F.lit(0)) for s in stops), F.length(text) + 1)
    return F.left(text, first - 1)


def completion(prompt: Column, generation: Column) -> Column:
    """A generation without the prompt it may echo, cut where the next top-level thing begins."""
    return truncate_at_stops(F.when(F.startswith(generation, prompt), F.substring(generation, F.length(prompt) + 1, F.length(generation))).otherwise(generation))


def last_block(generation: Column) -> Column:
    return F.coalesce(F.try_element_at(code_blocks(generation), F.lit(-1)), strip(generation))


def completion_program(prompt: Column, entry_point: Column, test: Column, generation: Column) -> Column:
    full = F.get(F.filter(code_blocks(generation), lambda b: F.contains(b, F.concat(F.lit("def "), entry_point))), 0)
    body = F.coalesce(full, F.concat(prompt, completion(prompt, generation)))
    return F.concat(body, F.lit("\n\n"), test, F.lit("\n\ncheck("), entry_point, F.lit(")\n"))


def function_program(setup: Column, tests: Column, generation: Column) -> Column:
    return F.concat(F.concat_ws("\n", F.nullif(setup, F.lit("")), last_block(generation), F.array_join(tests, "\n")), F.lit("\n"))


def function_prompt(text: Column, tests: Column) -> Column:
    return F.concat(F.lit('"""'), text, F.lit('"""\n# Your code must pass these tests:\n'), F.array_join(tests, "\n"), F.lit("\n"))


def run_programs(programs: DataFrame, timeout_s: float = 10.0, allow: bool = False) -> DataFrame:
    """programs (program, ...) with passed, timed_out and returncode. Generated code runs in a subprocess that is no sandbox, so it has to be allowed.

    A null program does not pass. Each runs in a folder of its own, which goes with it.
    """
    if not allow:
        raise PermissionError("running generated code has to be allowed")
    kept = programs.columns

    def one(text) -> tuple[bool, bool, int | None]:
        if text is None:
            return False, False, None
        with tempfile.TemporaryDirectory() as folder:
            try:
                done = subprocess.run([sys.executable, "-I", "-c", text], cwd=folder, env={"PATH": os.environ.get("PATH", "")}, capture_output=True, timeout=timeout_s, check=False)
            except subprocess.TimeoutExpired:
                return False, True, None
        return done.returncode == 0, False, done.returncode

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = [one(x) for x in p["program"]]
            yield p.assign(passed=[x[0] for x in out], timed_out=[x[1] for x in out], returncode=pd.array([x[2] for x in out], "Int32"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in programs.select(*kept).schema)
    return programs.mapInPandas(run, schema + ", passed boolean, timed_out boolean, returncode int")


def oracle_generations(problems: DataFrame, solutions: DataFrame, key: str = "prompt") -> DataFrame:
    """problems with generation from solutions (prompt, solution): '' where there is none."""
    return problems.join(solutions.select(F.col("prompt").alias(key), "solution").dropDuplicates([key]), key, "left").withColumn("generation", F.coalesce("solution", F.lit(""))).drop("solution")


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """The unbiased estimate: 0 for k below 1, 1 if fewer than k samples fail."""
    product = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda a, i: a * (1 - k / i))
    return F.when(k <= 0, 0.0).when(n - c < k, 1.0).when(c <= 0, 0.0).otherwise(1 - product)


def pass_counts(results: DataFrame) -> DataFrame:
    """(task_id, n, c): samples, and those that passed."""
    return results.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("c"))


def aggregate_pass_at_k(counts: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(k, pass_at_k, n_problems, n_solved): means over problems; 0 for no problems."""
    spark = counts.sparkSession
    each = counts.select("n", "c", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    got = each.groupBy("k").agg(F.avg(pass_at_k(F.col("n"), F.col("c"), F.col("k").cast("long"))).alias("p"), F.count(F.lit(1)).alias("n_problems"), F.count_if(F.col("c") > 0).alias("n_solved"))
    table = spark.createDataFrame([(k,) for k in ks], "k int")
    return table.join(got, "k", "left").select("k", F.coalesce("p", F.lit(0.0)).alias("pass_at_k"), F.coalesce("n_problems", F.lit(0)).alias("n_problems"), F.coalesce("n_solved", F.lit(0)).alias("n_solved"))


def first_problems(problems: DataFrame, limit: int | None, order: str = "task_id") -> DataFrame:
    return problems if limit is None else problems.orderBy(order).limit(limit)


def evaluate(problems: DataFrame, generations: DataFrame, program: Column, ks: tuple[int, ...] = (1,), limit: int | None = None, timeout_s: float = 10.0, allow: bool = False) -> tuple[DataFrame, DataFrame]:
    """(counts per problem, pass@k by k) of problems (task_id, ...) with generations (task_id, generation), a row a sample.

    program makes the text that is run out of both. Problems without a generation have no samples, and do not count.
    """
    samples = first_problems(problems, limit).join(generations, "task_id").withColumn("program", program)
    counts = pass_counts(run_programs(samples.select("task_id", "program"), timeout_s, allow))
    return counts, aggregate_pass_at_k(counts, ks).orderBy("k")


def report_lines(scores: DataFrame) -> list[str]:
    """One line a k, in order, and how many problems have a sample that passes: scores are as few as ks."""
    rows = scores.orderBy("k").collect()
    return [f"pass@{r.k}: {r.pass_at_k:.3f}" for r in rows] + [f"solved: {r.n_solved} of {r.n_problems}" for r in rows[:1]]

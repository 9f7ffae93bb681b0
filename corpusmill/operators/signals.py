"""Quality signals of a document, and the declarative rules over them."""

from __future__ import annotations

import ast
import operator
import warnings
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.textfn import WS, whitespace_tokens

# Patterns (fixed values).
PLACEHOLDER = r"(?i)(your code here|you code here|todo|fixme|xxx|implement me|not implemented)"
QUOTED = r""""[^"]*"|'[^']*'"""
HEX = r"\b0[xX][0-9a-fA-F]+\b|\b[0-9a-fA-F]{8,}\b"
DIGITS = r"\p{Nd}²³¹⁰⁴-⁹₀-₉"
SIGNALS = (
    "fraction_alphabetic", "fraction_numeric", "fraction_whitespace", "num_lines", "mean_line_length", "max_line_length", "hex_char_ratio", "long_string_line_ratio",
    "long_string_word_char_ratio", "placeholder_line_ratio", "assert_line_ratio", "python_func_line_ratio", "python_import_line_ratio", "python_ast_parseable",
)


@dataclass(frozen=True)
class Rule:
    """A rule fires if `signal op threshold` holds on a document in its scope; a null signal never fires."""

    name: str
    signal: str
    op: str
    threshold: float | bool
    categories: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()

    def fires(self) -> Column:
        ops = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "==": operator.eq, "!=": operator.ne}
        hit = ops[self.op](F.col(self.signal), F.lit(self.threshold))
        if self.categories:
            hit &= F.col("category").isin(*self.categories)
        if self.languages:
            hit &= F.col("language").isin(*self.languages)
        return F.coalesce(hit, F.lit(False))


TEXTS, FILES, CODE, PYTHON = ("text",), ("code", "data"), ("code",), ("Python",)
#: Rules in the order in which they are reported (fixed values).
RULES = (
    Rule("nl_low_alpha", "fraction_alphabetic", "<", 0.25, TEXTS),
    Rule("nl_high_numeric", "fraction_numeric", ">", 0.50, TEXTS),
    Rule("nl_too_few_lines", "num_lines", "<", 3, TEXTS),
    Rule("nl_long_mean_line", "mean_line_length", ">", 200, TEXTS),
    Rule("nl_long_max_line", "max_line_length", ">", 2000, TEXTS),
    Rule("code_long_string_lines", "long_string_line_ratio", ">", 0.20, FILES),
    Rule("code_long_string_chars", "long_string_word_char_ratio", ">", 0.40, FILES),
    Rule("code_high_hex", "hex_char_ratio", ">", 0.40, FILES),
    Rule("code_placeholder_lines", "placeholder_line_ratio", ">", 0.01, FILES),
    Rule("code_assert_lines", "assert_line_ratio", ">", 0.40, FILES),
    Rule("code_too_few_lines", "num_lines", "<", 3, FILES),
    Rule("code_long_mean_line", "mean_line_length", ">", 100, FILES),
    Rule("code_long_max_line", "max_line_length", ">", 1000, FILES),
    Rule("code_low_alpha", "fraction_alphabetic", "<", 0.25, CODE),
    Rule("py_func_ratio", "python_func_line_ratio", ">", 0.20, (), PYTHON),
    Rule("py_import_ratio", "python_import_line_ratio", ">", 0.30, (), PYTHON),
    Rule("py_not_parseable", "python_ast_parseable", "==", False, (), PYTHON),
)


@dataclass(frozen=True)
class FilterConfig:
    """Words of a string, and characters of a word, from which on they are long (fixed values); the rules."""

    long_string_words: int = 12
    long_word_chars: int = 20
    rules: tuple[Rule, ...] = RULES


@F.pandas_udf(T.BooleanType())
def parseable(texts: pd.Series) -> pd.Series:
    """Whether Python parses a text; null for a null text."""

    def one(text):
        if text is None:
            return None
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
        except (SyntaxError, ValueError, MemoryError, RecursionError):
            return False
        return True

    return texts.map(one).astype(object)


# The optimizer must neither repeat the parser nor move it into the filters above it.
parseable = parseable.asNondeterministic()


def compute_signals(docs: DataFrame, cfg: FilterConfig = FilterConfig()) -> DataFrame:
    """docs with the 14 signals; the last three are null unless the language is Python."""
    lines = F.col("_lines")
    n = F.size(lines).cast("double")
    total = F.aggregate(F.transform(lines, F.length), F.lit(0).cast("long"), lambda a, x: a + x)
    size = F.greatest(F.length("content"), F.lit(1)).cast("double")
    share = lambda pattern: (F.length("content") - F.length(F.regexp_replace("content", pattern, ""))).cast("double") / size
    of_lines = lambda test: F.size(F.filter(lines, test)).cast("double") / n
    quoted = lambda x: F.regexp_extract_all(x, F.lit(QUOTED), 0)
    inner = lambda q: whitespace_tokens(F.substring(q, F.lit(2), F.length(q) - 2))
    long_chars = F.aggregate(
        F.flatten(F.transform(lines, lambda x: F.flatten(F.transform(quoted(x), inner)))), F.lit(0).cast("long"), lambda a, w: a + F.when(F.length(w) > cfg.long_word_chars, F.length(w)).otherwise(0)
    )
    python = F.col("language") == "Python"
    return docs.withColumn("_lines", F.split("content", "\n", -1)).withColumns({
        "fraction_alphabetic": share(r"\p{L}"),
        "fraction_numeric": share(f"[{DIGITS}]"),
        "fraction_whitespace": share(f"[{WS}]"),
        "num_lines": n,
        "mean_line_length": total.cast("double") / n,
        "max_line_length": F.array_max(F.transform(lines, F.length)).cast("double"),
        "hex_char_ratio": F.length(F.array_join(F.regexp_extract_all("content", F.lit(HEX), 0), "")).cast("double") / size,
        "long_string_line_ratio": of_lines(lambda x: F.exists(quoted(x), lambda q: F.size(inner(q)) > cfg.long_string_words)),
        "long_string_word_char_ratio": long_chars.cast("double") / F.greatest(total, F.lit(1)).cast("double"),
        "placeholder_line_ratio": of_lines(lambda x: x.rlike(PLACEHOLDER)),
        "assert_line_ratio": of_lines(lambda x: x.contains("assert")),
        "python_func_line_ratio": F.when(python, of_lines(lambda x: x.rlike(f"^[{WS}]*(async )?def "))),
        "python_import_line_ratio": F.when(python, of_lines(lambda x: x.rlike(f"^[{WS}]*(import |from )"))),
        "python_ast_parseable": parseable(F.when(python, F.col("content"))),
    }).drop("_lines")


def annotate(docs: DataFrame, cfg: FilterConfig = FilterConfig(), rules: list[Rule] | None = None) -> DataFrame:
    """docs with signals and filtered_by: the names of the rules that fire, in the rules' order."""
    rules = cfg.rules if rules is None else rules
    fired = F.array(*(F.when(r.fires(), F.lit(r.name)) for r in rules)) if rules else F.array().cast("array<string>")
    return compute_signals(docs, cfg).withColumn("filtered_by", F.filter(fired, lambda x: x.isNotNull()))


def keep_unfired(annotated: DataFrame) -> DataFrame:
    return annotated.filter(F.size("filtered_by") == 0)


def rule_hits(annotated: DataFrame) -> DataFrame:
    """(rule, n) of every rule that fired; a document counts under each of its rules."""
    # Rows with the same rules are counted first, and the outer form keeps a filter from computing every signal a second time.
    alike = annotated.groupBy("filtered_by").agg(F.count(F.lit(1)).alias("n"))
    return alike.select(F.explode_outer("filtered_by").alias("rule"), "n").groupBy("rule").agg(F.sum("n").alias("n")).filter("rule is not null")

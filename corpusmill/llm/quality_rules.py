"""Quality rules with risk-controlled thresholds.

Each rule is a score of a document that is high for bad ones, with a fixed grid of cutoffs. On the labelled holdout, good
documents that a cutoff would reject are counted per stratum; exact binomial tails decide. In a stratum the cutoffs of a
rule are tested from the mildest on until one fails (a fixed sequence, which needs no correction of its own); over rules
and strata the error is divided (Bonferroni), and the allowed rate is divided over the rules, so that with confidence
1 - DELTA no stratum loses more than ALPHA of its good documents. A stratum with too few labels rejects nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import written

ALPHA, DELTA = 0.02, 0.05
MIN_WORDS, MAX_REPEAT = 20, 0.30
#: Rules: the score, a SQL expression over the features, and its cutoffs, mildest first. A document is rejected at or above its cutoff.
RULES = {
    "symbols": ("n_symbols / n_words", (2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "repeats": ("n_repeat_words / n_words", (0.28, 0.26, 0.24, 0.22, 0.2, 0.18, 0.16, 0.14, 0.12, 0.1, 0.08)),
    "word_length": ("word_chars / n_words", (40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0, 11.0, 10.0)),
}
#: Thresholds of up to so many strata are broadcast; more are joined by shuffle.
BROADCAST_STRATA = 4096
SPACE, SYMBOLS, N = " \t\n\r\x0b\x0c", "#*$%&|<>", 8
FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_blank = re.compile(r"[\x20\x09-\x0D]*\Z")
_odd = np.random.default_rng(8).integers(1, 2**63, N, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def repeat_words(words: list, n: int = N) -> int:
    """Words covered by windows of n words that are found twice or more, the first included."""
    m = len(words) - n + 1
    if m < 2:
        return 0
    number: dict = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    if len(number) == len(words):
        return 0
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    key = np.zeros(m, np.uint64)
    for j in range(n):
        key += mixed[j : j + m] * _odd[j % N]
    ordered = np.sort(key)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0  # unlike hashes: unlike windows
    _, of, times = np.unique(np.lib.stride_tricks.sliding_window_view(ids, n), axis=0, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[of.ravel()] > 1)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + n, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = text.encode().split()  # bytes split on the six white-space characters alone
    lines = [x for x in text.split("\n") if not _blank.match(x)]
    return len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeat_words(words)


def features(docs: DataFrame) -> DataFrame:
    """docs with the features of each whole text as longs; a null text has none of anything. Columns of these names are replaced."""
    kept = [c for c in docs.columns if c != "text" and c not in FEATURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.array([measure(x.as_py()) for x in b.column("text")], np.int64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(values[:, k]) for k in range(len(FEATURES)))], names=[*kept, *FEATURES])

    fields = docs.select(*kept).schema
    for c in FEATURES:
        fields = fields.add(c, "long")
    return docs.select(*kept, "text").mapInArrow(run, fields)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed down from k until terms no longer count; above the mean, 1 less the sum up from k + 1.

    Terms fall from the first on either way, so where the first is too small for a float the sum is nothing.
    """
    if k >= n:
        return 1.0
    up = k > n * p
    k += up
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total = 0.0
    while 0 <= k <= n and term > total * 1e-17:
        total += term
        term *= (n - k) * p / ((k + 1) * (1 - p)) if up else k * (1 - p) / ((n - k + 1) * p)
        k += 1 if up else -1
    return max(1.0 - total, 0.0) if up else min(total, 1.0)


def choose(rejected: list[int], n: int, alpha: float, delta: float) -> int:
    """Cutoffs that hold, of a sequence with so many good documents rejected each: the index of the last, or -1."""
    last = -1
    for k in rejected:
        if binomial_tail(k, n, alpha) > delta:
            break
        last += 1
    return last


def thresholds(scored: DataFrame, alpha: float = ALPHA, delta: float = DELTA, rules: dict = RULES) -> DataFrame:
    """(stratum, one nullable cutoff a rule) from the good documents of the labelled holdout: scored (stratum, feature columns)."""
    step = lambda e, cuts: sum((F.when(F.expr(e) >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    hist = scored.select("stratum", F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), step(*rule).alias("step")) for name, rule in rules.items()))).alias("x"))
    hist = written(hist.groupBy("stratum", "x.rule", "x.step").agg(F.count(F.lit(1)).alias("n")))
    strata = max(1, hist.select("stratum").distinct().count())

    def of(t: pd.DataFrame) -> pd.DataFrame:
        row = {"stratum": t["stratum"].iloc[0]}
        for name, (_, cuts) in rules.items():
            mine = t[t["rule"] == name]
            counts = [int(mine.loc[mine["step"] > i, "n"].sum()) for i in range(len(cuts))]
            last = choose(counts, int(mine["n"].sum()), alpha / len(rules), delta / (len(rules) * strata))
            row[f"cut_{name}"] = cuts[last] if last >= 0 else None
        return pd.DataFrame([row]).astype({f"cut_{name}": float for name in rules})

    return hist.groupBy("stratum").applyInPandas(of, "stratum string, " + ", ".join(f"cut_{name} double" for name in rules))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA, rules: dict = RULES) -> DataFrame:
    """docs' doc_id with its features, base_failed and kept.

    base_failed: fewer than MIN_WORDS words, or over 30% of them in repeated windows. kept: not base_failed, and below
    every cutoff of its stratum. labels (doc_id, quality) of null or other than 1 count as not good; a doc_id labelled
    twice counts once, as good if any label says so. A null stratum is one of its own. Documents that fail the base rules
    take no part in the bounds, which are about what the cutoffs reject beyond them.
    """
    rows = written(features(docs.select("doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("\0null")).alias("stratum"), "text")))
    rows = rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > round(100 * MAX_REPEAT) * F.col("n_words")))
    good = labels.filter("quality = 1").select("doc_id").distinct()
    cuts = thresholds(rows.filter("not base_failed").join(good, "doc_id", "left_semi"), alpha, delta, rules)
    cuts = written(cuts)
    rows = rows.join(F.broadcast(cuts) if cuts.count() <= BROADCAST_STRATA else cuts, "stratum", "left")
    over = F.lit(False)
    for name, (score, _) in rules.items():
        over |= F.coalesce(F.when(~F.col("base_failed"), F.expr(score)) >= F.col(f"cut_{name}"), F.lit(False))
    return rows.select("doc_id", *FEATURES, "base_failed", (~F.col("base_failed") & ~over).alias("kept"))

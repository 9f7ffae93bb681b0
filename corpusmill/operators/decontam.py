"""Decontamination against benchmark texts: entry points and shared word n-grams."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.textfn import WORDCHARS, let, ngrams, normalized_words
from corpusmill.sources.scratch import written

#: Alternatives of one pattern; of longer lists, what is one word goes through a join on words.
PATTERN_NAMES = 500
#: Banned grams whose hashes are sent to all tasks, 8 bytes each; more are joined by shuffle.
BROADCAST_GRAMS = 2_000_000


def banned_ngrams(reference: DataFrame, n: int = 10) -> DataFrame:
    """(gram) of the reference's texts, each once."""
    return reference.select(F.explode(ngrams(normalized_words(F.col("text")), n)).alias("gram")).distinct()


def has_entry_point(text: Column, names: list[str]) -> Column:
    if not names:
        return F.lit(False)
    return text.rlike(f"(?<![{WORDCHARS}])(?:" + "|".join(re.escape(x) for x in names) + f")(?![{WORDCHARS}])")


def decontaminate(examples: DataFrame, reference: DataFrame, entry_points: list[str], n: int = 10, id: str = "id", text: str = "text") -> DataFrame:
    """examples with reason: 'entry_point', else 'ngram', else null for clean ones. Rows need unique ids.

    Only rows without an entry point are cut into n-grams, as 64-bit hashes; texts of grams are compared only where a hash is banned.
    Entry points that are one word are joined as words when they are many: between boundaries that is the same match as the pattern's.
    """
    df = examples
    words = [x for x in entry_points if re.fullmatch(r"\w+", x)] if len(entry_points) > PATTERN_NAMES else []
    marked = df.withColumn("_entry", F.coalesce(has_entry_point(F.col(text), sorted(set(entry_points) - set(words))), F.lit(False)))
    if words:
        names = df.sparkSession.createDataFrame([(x,) for x in words], "word string").distinct()
        named = df.select(id, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(f"[{WORDCHARS}]+"), 0))).alias("word")).join(names, "word").select(id).distinct()
        marked = marked.join(named.withColumn("_named", F.lit(True)), id, "left").withColumn("_entry", F.col("_entry") | F.coalesce("_named", F.lit(False))).drop("_named")
    banned = written(banned_ngrams(reference, n))
    hashes = banned.select(_hash_of(F.split("gram", " ", -1)).alias("h")).distinct()
    hashes = F.broadcast(hashes) if banned.count() <= BROADCAST_GRAMS else hashes
    rest = marked.filter("not _entry")
    near = rest.select(id, F.explode(gram_hashes(normalized_words(F.col(text)), n)).alias("h")).join(hashes, "h", "left_semi").select(id).distinct()
    grams = rest.join(near, id, "left_semi").select(id, F.explode(ngrams(normalized_words(F.col(text)), n)).alias("gram"))
    hit = grams.join(banned, "gram", "left_semi").select(id).distinct().withColumn("_gram", F.lit(True))
    reason = F.when(F.col("_entry"), "entry_point").when(F.col("_gram"), "ngram")
    return marked.join(hit, id, "left").withColumn("reason", reason).drop("_entry", "_gram")


def _hash_of(words: Column) -> Column:
    return F.xxhash64(words)


def gram_hashes(words: Column, n: int) -> Column:
    """Hashes of the n-grams of an array of words, without putting a gram together."""
    starts = lambda w: F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
    return let(words, lambda w: F.transform(starts(w), lambda i: _hash_of(F.slice(w, i, F.lit(n)))))


def clean(judged: DataFrame) -> DataFrame:
    return judged.filter("reason is null").drop("reason")


def report(judged: DataFrame) -> DataFrame:
    """(reason, n), 'kept' for clean rows."""
    return judged.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))

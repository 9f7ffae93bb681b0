r"""Line dedup by a log-template tree, in Spark expressions alone.

A line is its words, those with a digit masked as <*>. The tree has fixed depth: the number of words, then the LEADING
first words; what shares that path is a leaf. Inside a leaf an unmasked word is constant at its place if lines of MIN_DOCS
documents have it there, all else is a variable field; lines with the same constants are one template. A template
whose constants make up SHARE of its words and that MIN_DOCS documents have is dropped from all but the first of them (the least doc_id),
so that what recurs is kept once. Lines of LONG words or more, SHARE of them unmasked, are templates of their own too and need LONG_DOCS
documents only: a long passage does not recur by chance.

A document is a distinct (doc_id, text), so repeated rows count once, and it counts once for a leaf, a word at its place or a template
however many of its lines are there. Sums over lines bound such a count from above and the commonest line from below; only where MIN_DOCS
lies between are documents told apart. Lines of leaves that too few documents reach are left out by their leading words and their number
of words alone; the others are masked whole, written once and combined before they are shuffled, so a line that a third of all documents
have is one row a task. Only leaves that MIN_DOCS documents reach can hold a template, so only their lines are taken apart into words; a leaf
of fewer documents can hold passages, which are whole lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import written

LEADING, MIN_DOCS, SHARE = 3, 5, 0.7
#: Words of a line that is a passage, and documents that it takes to drop it from all but the first.
LONG, LONG_DOCS = 50, 2
MASK = "<*>"
#: The id that rows without a doc_id count as.
NO_ID = (1 << 63) - 1
#: Leaves that are sent to all tasks, a hash and a flag each; more are joined by shuffle.
BROADCAST_LEAVES = 500_000


def _spaced(text: Column) -> Column:
    r"""One string a \n-split line, its words divided by single spaces; the ends may still hold one."""
    odd = F.lit(False)
    for gap in ("  ", "\t", "\r", "\x0b", "\x0c"):  # plain searches, many times cheaper than a pattern over every text
        odd |= text.contains(F.lit(gap))
    plain = F.when(odd, F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(text)
    return F.split(plain, "\n", -1)


def _masked(words: Column) -> Column:
    return F.when(words.rlike("[0-9]"), F.regexp_replace(words, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", MASK)).otherwise(words)


def masked_lines(text: Column) -> Column:
    r"""One string a \n-split line: its words, masked, joined by single spaces ('' for a blank line)."""
    return F.transform(_spaced(text), lambda x: _masked(F.trim(x)))


def _words(line: Column) -> Column:
    """Bytes are known without a walk through the characters, and a space is one."""
    return (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1).cast("int")


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _key() -> Column:
    return F.xxhash64(_id(), F.coalesce("text", F.lit("")))


def _lines(docs: DataFrame, leading: int) -> DataFrame:
    """(_key, id, line, n, leaf) of the lines of every row, not masked; masking leaves the number of words and their order as they are."""
    rows = docs.select(_key().alias("_key"), _id().alias("id"), F.explode(F.array_distinct(_spaced(F.col("text")))).alias("line"))
    rows = rows.select("_key", "id", F.trim("line").alias("line")).filter("line <> ''").withColumn("n", _words(F.col("line")))
    return rows.withColumn("leaf", F.xxhash64("n", _masked(F.substring_index("line", " ", leading))))


def _places(docs: DataFrame, leading: int, min_docs: int, long: int, long_docs: int) -> tuple[DataFrame, DataFrame]:
    """(_key, id, leaf, n, line_id, plain, tree) of every masked line of every document, each once, in the leaves that enough documents reach.

    tree: min_docs documents reach the leaf; plain: unmasked words of a line of `long` words or more. And (line_id, line) of the lines in trees.
    """
    lines = _lines(docs, leading)
    leaves = lines.select("leaf", "n", "_key").distinct().groupBy("leaf").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("_docs"))
    need = F.when(F.col("n") >= long, min(long_docs, min_docs)).otherwise(min_docs)
    leaves = written(leaves.filter(F.col("_docs") >= need).select("leaf", (F.col("_docs") >= min_docs).alias("tree")))
    # Whole lines are wanted for these leaves alone: sent to all tasks while few, joined by shuffle beyond.
    side = F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves
    lines = lines.join(side, "leaf").select("_key", "id", "leaf", "n", "tree", _masked(F.col("line")).alias("line"))
    plain = F.when(F.col("n") >= long, F.size(F.array_remove(F.split("line", " "), MASK)))
    lines = written(lines.select("_key", "id", "leaf", "n", F.xxhash64("line").alias("line_id"), plain.alias("plain"), "tree", F.when(F.col("tree"), F.col("line")).alias("line")))
    return written(lines.drop("line").distinct()), lines.filter("tree").select("line_id", "line").distinct()


def _enough(rows: DataFrame, keys: list[str], places: DataFrame, need: int, *more: Column) -> DataFrame:
    """keys, and the aggregates `more`, of the groups of rows (leaf, line_id, docs, ...) whose lines stand in `need` documents or more."""
    found = written(rows.groupBy(*keys).agg(F.sum("docs").alias("_most"), F.max("docs").alias("_least"), *more).filter(F.col("_most") >= need))
    unsure = found.filter(F.col("_least") < need).select(*keys)
    of = rows.join(unsure, keys, "left_semi").select(*dict.fromkeys([*keys, "leaf", "line_id"]))
    exact = of.join(places.select("leaf", "line_id", "_key"), ["leaf", "line_id"]).select(*keys, "_key").distinct()
    exact = exact.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= need).select(*keys)
    return found.filter(F.col("_least") >= need).unionByName(found.join(exact, keys, "left_semi")).drop("_most", "_least")


def templates(docs: DataFrame, leading: int = LEADING, min_docs: int = MIN_DOCS, share: float = SHARE, long: int = LONG, long_docs: int = LONG_DOCS, places: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(leaf, line_id, owner) of every masked line that is dropped, each once, with the id of the document that keeps its template.

    docs (doc_id, text): null and blank texts have no lines.
    """
    inside, lines = places or _places(docs, leading, min_docs, long, long_docs)
    counts = written(inside.groupBy("leaf", "line_id", "n", "plain", "tree").agg(F.count(F.lit(1)).alias("docs"), F.min("id").alias("owner")))
    inside = inside.filter("tree")
    found = counts.filter("tree").select("leaf", "line_id", "n", "docs", "owner")
    rows = written(found.join(lines, "line_id").select("leaf", "line_id", "docs", "line"))
    at = F.posexplode(F.transform(F.split("line", " "), lambda w: F.when(w != MASK, F.xxhash64(w)))).alias("at", "word")
    words = rows.select("leaf", "line_id", "docs", at).filter("word is not null")
    stable = _enough(words, ["leaf", "at", "word"], inside, min_docs)
    shape = words.join(stable, ["leaf", "at", "word"]).groupBy("leaf", "line_id").agg(F.count(F.lit(1)).alias("constant"), F.bit_xor(F.xxhash64("at", "word")).alias("template"))
    shape = written(found.join(shape, ["leaf", "line_id"]).filter(F.col("constant") * 1000 >= F.col("n") * round(share * 1000)))
    recurring = _enough(shape, ["leaf", "constant", "template"], inside, min_docs, F.min("owner").alias("first"))
    gone = shape.join(recurring, ["leaf", "constant", "template"]).select("leaf", "line_id", F.col("first").alias("owner"))
    passages = counts.filter((F.col("n") >= long) & (F.col("docs") >= long_docs) & (F.col("plain") * 1000 >= F.col("n") * round(share * 1000)))
    return gone.unionByName(passages.select("leaf", "line_id", "owner")).groupBy("leaf", "line_id").agg(F.min("owner").alias("owner"))


def dedup(docs: DataFrame, leading: int = LEADING, min_docs: int = MIN_DOCS, share: float = SHARE, long: int = LONG, long_docs: int = LONG_DOCS) -> DataFrame:
    """docs with n_lines, n_dropped and the text that stays (columns of the first two names are replaced, all others stay).

    Blank lines stay. A null text stays null with no lines; an empty one has one blank line. Rows of one doc_id and text get the same
    treatment; rows of one doc_id keep alike, and rows without a doc_id count as the last id. An empty table stays empty. Texts may be of
    any length: the lines of one are exploded as rows.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    places = _places(docs, leading, min_docs, long, long_docs)
    hits = places[0].join(templates(docs, leading, min_docs, share, long, long_docs, places), ["leaf", "line_id"]).filter("id <> owner")
    hits = hits.groupBy("_key").agg(F.collect_set("line_id").alias("_drop"))  # at most the lines of one document
    lines = F.split("text", "\n", -1)
    marked = F.transform(masked_lines(F.col("text")), lambda x: F.array_contains("_drop", F.xxhash64(x)) & (x != ""))

    def outcome(gone: Column) -> Column:
        left = F.array_join(F.filter(lines, lambda x, i: ~F.get(gone, i)), "\n")
        return F.struct(left.alias("text"), F.size(F.filter(gone, lambda g: g)).cast("long").alias("n"))

    made = F.when(F.col("_drop").isNotNull(), F.element_at(F.transform(F.array(marked), outcome), 1))
    # Exploding one value keeps the optimizer from repeating it in every column and filter that reads it.
    rows = docs.withColumn("_key", _key()).join(hits, "_key", "left").withColumn("_made", F.explode(F.array(made)))
    return rows.select(
        *(F.coalesce("_made.text", "text").alias("text") if c == "text" else F.col(c) for c in kept),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce("_made.n", F.lit(0)).cast("long").alias("n_dropped"),
    )

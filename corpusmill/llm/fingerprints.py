"""Document fingerprints: Order MinHash over occurrence-numbered k-mers, in Spark expressions alone.

A text is a sequence of symbols (words, cut after SYMBOL characters, so that scripts without spaces have symbols too); a k-mer is
K symbols in a row, numbered by its occurrence in the text. One hash orders all k-mers on a circle, and BINS equal arcs of it stand for as
many hash functions: the L k-mers that come first from an arc's start on, in text order, make one tuple hash. Arcs that hold fewer
than L go on into the next, so every tuple has an order to tell, however short the text. Two texts agree in a part as far as the same
k-mers are found in the same order, which moves with edit distance.

All is array work on primitive longs within a row: two sorts of packed (hash, position) longs and linear scans. Numbers of occurrences
come from run starts of the sorted array, without a search. No row leaves its task until the next document is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions.prefix import running_total
from corpusmill.llm.common import written

K, L, BINS, SYMBOL = 3, 2, 64, 16
#: A packed long: POS bits of position (of so many symbols, a text of 2 GB at most) below the hash.
POS = 30
#: Bytes of texts that follow each other in one bucket, and buckets at most (beyond them, buckets grow): FAN by FAN.
BUCKET, FAN = 8_000_000, 64


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fingerprint(text: Column, k: int = K, n_least: int = L, bins: int = BINS) -> Column:
    """The signature of a whole text as array<int>: a tuple hash for each of `bins` parts.

    Null and blank texts have an empty one; a text with fewer than k symbols has one k-mer, all of it, alone in every part. Equal texts
    have equal signatures. Texts may be of any length; positions wrap beyond 2^30 symbols.
    """
    low = (1 << POS) - 1
    top = 1 << (63 - POS)
    symbols = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]{1,%d}" % SYMBOL), 0)

    def of_symbols(s: Column) -> Column:
        count = F.size(s)
        last = F.greatest(count - k, F.lit(0))
        whole = F.transform(F.when(count > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")), lambda i: F.xxhash64(*(F.get(s, i + j) for j in range(k))))
        return _let(whole, of_kmers)

    def of_kmers(kmers: Column) -> Column:
        packed = F.sort_array(F.transform(kmers, lambda h, i: F.shiftleft(F.pmod(h, F.lit(top)), POS).bitwiseOR(i.cast("long").bitwiseAND(F.lit(low)))))
        return _let(packed, lambda p: numbered(kmers, p))

    def numbered(kmers: Column, p: Column) -> Column:
        same = lambda i: (i > 0) & (F.shiftright(F.get(p, i), POS) == F.shiftright(F.get(p, i - 1), POS))
        index = F.transform(p, lambda x, i: i)
        starts, rest = F.filter(index, lambda i: ~same(i)), F.filter(index, same)
        # The d-th k-mer that is not its run's first stands at i in run i - d, so it is occurrence i - starts[i - d - 1] of its k-mer.
        again = lambda st: F.transform(rest, lambda i, d: draw(F.get(p, i), (i - F.get(st, i - d - 1)).cast("long")))
        draw = lambda x, n: F.shiftleft(F.pmod(F.xxhash64(F.shiftright(x, POS), n), F.lit(top)), POS).bitwiseOR(x.bitwiseAND(F.lit(low)))
        first = lambda st: F.transform(st, lambda i: draw(F.get(p, i), F.lit(0).cast("long")))
        return _let(F.sort_array(_let(starts, lambda st: F.concat(first(st), again(st)))), lambda o: chosen(kmers, o))

    part = lambda x: F.floor(F.shiftright(x, POS) / F.lit(top / bins)).cast("int")

    def chosen(kmers: Column, o: Column) -> Column:
        least = F.filter(o, lambda x, i: (i < n_least) | (part(F.get(o, F.greatest(i - n_least, F.lit(0)))) != part(x)))
        return _let(least, lambda c: F.when(F.size(c) > 0, F.flatten(F.concat(F.transform(c, lambda x, i: entry(kmers, c, x, i)), F.array(rest(kmers, c))))).otherwise(F.array().cast("array<int>")))

    def tuple_hash(kmers: Column, c: Column, i: Column) -> Column:
        # From the i-th on around the circle; a text of fewer than n_least k-mers has what it has.
        around = F.transform(F.sequence(F.lit(0), F.least(F.lit(n_least), F.size(c)) - 1), lambda d: F.get(c, (i + d) % F.size(c)).bitwiseAND(F.lit(low)))
        h = F.xxhash64(F.transform(F.sort_array(around), lambda at: F.get(kmers, at.cast("int"))))
        return (h.bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)).cast("int")

    def entry(kmers: Column, c: Column, x: Column, i: Column) -> Column:
        """The first k-mer of its part serves that part and the empty ones before it."""
        before = F.when(i == 0, F.lit(-1)).otherwise(part(F.get(c, F.greatest(i - 1, F.lit(0)))))
        return F.when(before != part(x), F.array_repeat(tuple_hash(kmers, c, i), part(x) - before)).otherwise(F.array().cast("array<int>"))

    def rest(kmers: Column, c: Column) -> Column:
        return F.array_repeat(tuple_hash(kmers, c, F.lit(0)), F.lit(bins - 1) - part(F.element_at(c, -1)))

    return _let(symbols, of_symbols)


def likeness(a: Column, b: Column, bins: int = BINS) -> Column:
    """The share of parts in which two signatures agree; 1 for two empty ones, 0 if one is."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: F.coalesce(e, F.lit(False)))) / F.lit(bins)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(same)


def as_text(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda h: F.lower(F.lpad(F.hex(h.cast("long") + F.lit(1 << 31)), 8, "0"))), " ")


def with_next(docs: DataFrame, columns: tuple[str, ...], order: tuple[str, str], size: Column, derive=lambda df: df) -> DataFrame:
    """derive(docs) with next_<column>: the values of the next row by order, two columns of longs (null first); the last row is followed by
    the first. What is costly to compute belongs in derive: it runs once a row, after rows are dealt.

    Rows are dealt to buckets of BUCKET bytes (size) each: running sums over the keys alone say where buckets begin, so neither a clustered
    id space nor long texts fill one task. Each bucket also gets a copy of the row that follows it, and one window runs per bucket.
    """
    spark, key = docs.sparkSession, F.struct(*order)
    sums = written(running_total(docs.select(*order, size.cast("long").alias("_bytes")), "_bytes", order))
    total = sums.agg(F.sum(F.col("_bytes") + 1)).first()[0]
    if not total:
        return derive(docs).select("*", *(F.col(c).alias(f"next_{c}") for c in columns))
    width = max(BUCKET, -(-total // (FAN * FAN)))
    # At most FAN * FAN keys, which are where buckets begin.
    cuts = [tuple(r.k) for r in sums.groupBy(F.expr(f"before div {width}L")).agg(F.min(key).alias("k")).select("k").collect()]
    cuts = sorted(set(cuts), key=lambda k: [(x is not None, x or 0) for x in k])
    long = lambda x: "cast(null as bigint)" if x is None else f"cast('{x}' as bigint)"
    literal = lambda own: "array(" + ", ".join(f"named_struct({', '.join(f'{c!r}, {long(x)}' for c, x in zip(order, k, strict=True))})" for k in own) + ")"
    rows = [cuts[i : i + FAN] for i in range(0, len(cuts), FAN)]
    outer = F.size(F.filter(F.expr(literal([r[0] for r in rows])), lambda c: c <= key)) - 1
    fine = F.get(F.expr("array(" + ", ".join(map(literal, rows)) + ")"), F.col("_outer"))
    dealt = docs.withColumn("_outer", outer).withColumn("_bucket", F.col("_outer") * FAN + F.size(F.filter(fine, lambda c: c <= key)) - 1).drop("_outer")
    n = F.lit(len(cuts))
    ends = spark.range(1).select(F.posexplode(F.expr(literal(cuts))).alias("_own", "_cut"))
    ends = ends.select("_own", F.pmod(F.col("_own") - 1, n).alias("_before"), F.col("_cut")[order[0]].alias("_k0"), F.col("_cut")[order[1]].alias("_k1"))
    tails = dealt.join(F.broadcast(ends), (F.col("_bucket") == F.col("_own")) & F.col(order[0]).eqNullSafe(F.col("_k0")) & F.col(order[1]).eqNullSafe(F.col("_k1")))
    tails = tails.dropDuplicates(["_own"]).withColumn("_bucket", F.col("_before")).drop("_own", "_before", "_k0", "_k1")
    every = derive(dealt.withColumn("_tail", F.lit(False)).unionByName(tails.withColumn("_tail", F.lit(True))))
    w = W.partitionBy("_bucket").orderBy("_tail", *(F.col(c).asc_nulls_first() for c in order))
    after = F.lead(F.struct(*columns)).over(w)
    return every.withColumn("_next", after).filter("not _tail").drop("_bucket", "_tail").select("*", *(F.col(f"_next.{c}").alias(f"next_{c}") for c in columns)).drop("_next")


def compare(docs: DataFrame) -> DataFrame:
    """Each document (doc_id, text) with its fingerprint, that of its edited text, and likenesses.

    The edited text: the last floor(n_chars / 2) code points give way to the first as many (or all) of the next document by doc_id. A null
    text counts as empty, a null doc_id comes first, rows of one doc_id follow each other by text hash; the only row follows itself, and
    an empty table stays empty. Other columns, whatever their names, are not looked at. Texts may be of any length.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_hash", F.xxhash64("text"))
    rows = with_next(rows, ("text", "signature"), ("doc_id", "_hash"), F.octet_length("text"), lambda df: df.withColumn("signature", fingerprint(F.col("text"))))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.left("text", n - half), F.left("next_text", half)))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "signature", "next_signature", fingerprint(F.col("edited")).alias("edited_signature"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("signature")).alias("fingerprint"), as_text(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"), likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )

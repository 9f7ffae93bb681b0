"""N-gram Jaccard join with PartEnum signatures.

Sizes fall into windows wide enough that any two sets as alike as the threshold share one; inside a window the threshold
is a bound k on the symmetric difference. The hash domain is cut into (k + 1) / 2 groups of PIECES pieces: some group
holds at most one of k differences, so some choice of all its pieces but one is the same in both sets. Each such choice is
a signature, and pairs as alike as the threshold always share one.

Copies of a text are one node. Signatures seen at two nodes or more link their nodes to the least of them (a star, never
all pairs); the connected components of those links are blocks of candidates. Inside a block, exact intersections are
counted from postings: every pair is tested once, each node's links are summed, and of the links themselves a spanning forest
leaves the task, so a family of n near copies costs n rows. A block above BLOCK nodes or ELEMENTS shingles is dealt to pairs
of its parts, so that no task gets more than about twice as much and no pair goes untested.

Below a similarity of 0.9 the pieces hold so few shingles that unlike texts share signatures and most of a corpus is one
block. There the signatures are prefixes instead: with the shingles of all texts in one order, the rarest first, sets of a
and b elements that share i have a common element among their first a - i + 1 and b - i + 1. Shingles that no second text
has take up places there and are no signatures, so most texts have none left. Counts come from 32 bits and the part of each
shingle, packed by chunks of texts; a collision there puts a shingle later in the order of every text and loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusmill.llm.common import written
from corpusmill.operators.components import components

WIDTH, NUMERATOR, DENOMINATOR = 3, 90, 100
PIECES, BLOCK, ELEMENTS, BROADCAST_NODES = 3, 1024, 2_000_000, 1_000_000
#: Texts of a chunk at most, and shingles after which it ends; rows of a chunk name their texts in 16 bits.
CHUNK, CHUNK_SHINGLES = 2000, 200_000
POSTINGS = 500_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class _Words(dict):
    """64-bit hashes of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hash_of = _Words()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: `width` words in a row after lower-casing A-Z, or all words if there are fewer; empty without words."""
    words = (text or "").encode().lower().split()  # on bytes both are about ASCII alone, with the six white-space characters
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(_hash_of.__getitem__, words)), np.uint64)
    n = min(width, len(h))
    key = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        key = _mixed(key * _MIX[0] + h[j : len(h) - n + 1 + j])
    return np.unique(key)


def windows(n: int, num: int = NUMERATOR, den: int = DENOMINATOR) -> list[tuple[int, int]]:
    """(window, k) of each size window that a set of n elements belongs to. Window j starts at g^j, where g = (den / num)^2,
    and ends at g^j * g * den / num: it holds every pair whose smaller set has a size from g^j to g^(j+1)."""
    g = (den / num) ** 2
    j = int(np.floor(np.log(n) / np.log(g) + 1e-9)) if den > num else 0
    if den == num:
        return [(n, 0)]
    found = []
    while j >= 0 and n <= (end := g ** (j + 1) * den / num * (1 + 1e-9)):
        found.append((j, int(2 * int(end) * (den - num) // (den + num))))
        j -= 1
    return found


def signatures(s: np.ndarray, num: int = NUMERATOR, den: int = DENOMINATOR) -> np.ndarray:
    """The PartEnum signatures of a sorted set of hashes, as signed 64-bit numbers."""
    out = []
    if len(s):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(s + _MIX[0]))))
    for j, k in windows(len(s), num, den) if len(s) else []:
        groups = (k + 2) // 2
        pieces = PIECES * groups if k else 1
        cuts = np.searchsorted(s, (np.arange(1, pieces, dtype=object) * 2**64 // pieces).astype(np.uint64)) if pieces > 1 else np.zeros(0, np.int64)
        at = np.concatenate(([0], cuts, [len(s)]))
        own = (total[at[1:]] - total[at[:-1]]).reshape(groups if k else 1, -1)  # sums wrap
        seed = np.uint64(j * 2**40 % 2**64) + np.arange(own.size, dtype=np.uint64).reshape(own.shape)
        rest = own.sum(1, keepdims=True, dtype=np.uint64) - own if k else own
        out.append(_mixed(_mixed(rest + _MIX[1]) + seed * _MIX[0]).ravel())
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.zeros(0, np.int64)


def _profile(width: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x, width) for x in b.column("text").to_pylist()]
            keys = [signatures(s, num, den) for s in sets]
            for lo in range(0, len(sets), 2000):
                part = keys[lo : lo + 2000]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in part]))).astype(np.int32)
                arrays = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(part) if part else np.zeros(0, np.int64)))
                rows = b.slice(lo, 2000)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("node"), pa.array([len(s) for s in sets[lo : lo + 2000]], pa.int64()), arrays], names=["doc_id", "node", "n_shingles", "keys"])

    return run


def _chunked(width: int, parts: int, member: pa.StructType):
    """Of each chunk of texts, their members in part -1, and of each part its shingles: 32 bits of each and the place of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32

        def packed(rows: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
            sizes = np.array([len(x) for x in sets])
            every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
            part = ((every >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            found, start = np.unique(part[order], return_index=True)
            ends = np.append(start, len(every))[1:]
            low, owner = every[order].astype(np.uint32), owner[order]
            of = pa.StructArray.from_arrays([rows.column("doc_id"), rows.column("node"), pa.array(sizes, pa.int64())], fields=list(member))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(found) + 1, chunk)), pa.array(np.append(-1, found), pa.int64()),
                    pa.array([None, *(low[a:b].tobytes() for a, b in zip(start, ends))], pa.binary()), pa.array([None, *(owner[a:b].tobytes() for a, b in zip(start, ends))], pa.binary()),
                    pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(of)], pa.int32()), of), pa.nulls(len(found), pa.list_(of.type))]),
                ],
                names=["chunk", "part", "low", "owner", "members"],
            )

        for b in batches:
            lo, sets, n = 0, [], 0
            for i, x in enumerate(b.column("text")):
                sets.append(shingles(x.as_py(), width))
                n += len(sets[-1])
                if len(sets) == CHUNK or n >= CHUNK_SHINGLES or i + 1 == b.num_rows:
                    yield packed(b.slice(lo, len(sets)), sets)
                    lo, sets, n, chunk = i + 1, [], 0, chunk + 1

    return run


def _by_first(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each run of one value in the first column."""
    key, rows = None, []
    for b in batches:
        for r in (x for lo in range(0, b.num_rows, 64) for x in b.slice(lo, 64).to_pylist()):
            now = next(iter(r.values()))
            if rows and now != key:
                yield key, rows
                rows = []
            key = now
            rows.append(r)
    if rows:
        yield key, rows


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part, the shingles found more than once, with how often (255 stands for more)."""
    for part, rows in _by_first(batches):
        low = [np.frombuffer(r["low"], np.uint32) for r in rows]
        _, at, times = np.unique(np.concatenate(low), return_inverse=True, return_counts=True)
        times, out, end = np.minimum(times, 255).astype(np.uint8)[at], [], 0
        for r, x in zip(rows, low):
            mine, end = times[end : end + len(x)], end + len(x)
            if (more := mine > 1).any():
                out.append((r["chunk"], part, x[more].tobytes(), np.frombuffer(r["owner"], np.uint16)[more].tobytes(), mine[more].tobytes()))
        if out:
            chunk, of, *values = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(of, pa.int64()), *(pa.array(x, pa.binary()) for x in values)], names=["chunk", "part", "low", "owner", "times"])


def prefixes(owner: np.ndarray, key: np.ndarray, times: np.ndarray, sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Places of the shared shingles (owner, key, times) that are in their text's prefix; sizes has the shingles of each text, those shared with none too."""
    shared, need = np.bincount(owner, minlength=len(sizes)), -(-sizes * num // den)
    order = np.lexsort((key, times, owner))
    rank = np.arange(len(order)) - (np.cumsum(shared) - shared)[owner[order]]
    return order[rank < (shared - need + 1)[owner[order]]]


def _prefixes(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (head, *rows) in _by_first(batches):
            if not rows:
                continue
            node, sizes = (np.array([m[c] for m in head["members"]], np.int64) for c in ("node", "n_shingles"))
            owner, times = (np.concatenate([np.frombuffer(r[c], kind) for r in rows]) for c, kind in (("owner", np.uint16), ("times", np.uint8)))
            key = np.concatenate([np.frombuffer(r["low"], np.uint32) + (np.int64(r["part"]) << 32) for r in rows])
            at = prefixes(owner.astype(np.int64), key, times, sizes, num, den)
            yield pa.RecordBatch.from_arrays([pa.array(node[owner[at]]), pa.array(key[at])], names=["node", "key"])

    return run


def _rare_first(rows: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """members and keyed (node, key) of rows (doc_id, node, text), by prefixes of shingles in the order of their counts."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    kinds = rows.select("doc_id", "node").schema.add("n_shingles", "long")
    member = pa.struct([(f.name, to_arrow_type(f.dataType)) for f in kinds])
    out = T.StructType().add("chunk", "long").add("part", "long").add("low", "binary").add("owner", "binary").add("members", T.ArrayType(kinds))
    chunks = written(rows.mapInArrow(_chunked(width, 4 * n, member), out))
    heads = chunks.filter("part = -1")
    parts = chunks.filter("part >= 0").select("part", "chunk", "low", "owner").repartition(n, "part").sortWithinPartitions("part", "chunk")
    parts = parts.mapInArrow(_shared, "chunk long, part long, low binary, owner binary, times binary")
    both = heads.select("chunk", "part", "low", "owner", F.lit(None).cast("binary").alias("times"), "members").unionByName(parts, allowMissingColumns=True)
    keyed = both.repartition(n, "chunk").sortWithinPartitions("chunk", "part").mapInArrow(_prefixes(num, den), "node long, key long")
    return heads.select(F.inline("members")), written(keyed)


def links(sets: list[np.ndarray], left: np.ndarray, num: int, den: int, copies: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A spanning forest of the pairs of sets with num * union <= den * intersection, and for each set the copies (1 each if not given)
    of all it is paired with. left marks the one side of a pair of parts: pairs within a side are then left to other calls; if it is all
    alike, every pair counts."""
    m, size = len(sets), np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    kind = np.int32 if len(every) < 2**31 else np.int64  # a block is what a task holds: short numbers, and nothing longer than it is needed
    order = np.argsort(every, kind="stable")
    every = every[order]
    new = np.concatenate(([True], every[1:] != every[:-1]))
    del every
    word = np.empty(len(order), kind)
    word[order] = np.cumsum(new, dtype=kind) - 1
    posted = np.repeat(np.arange(m, dtype=kind), size)[order]
    del order
    start = np.flatnonzero(new).astype(kind)
    count = np.diff(np.append(start, kind(len(new))))
    parent = list(range(m))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    across = left.any() and not left.all()
    ends, found, degree = np.concatenate(([0], np.cumsum(size))), [], np.zeros(m, np.int64)
    copies = np.ones(m, np.int64) if copies is None else copies
    for i in range(m):
        mine = word[ends[i] : ends[i + 1]]
        mine = mine[count[mine] > 1]
        until = np.cumsum(count[mine])
        if not len(mine):
            continue
        inter, lo = np.zeros(m, np.int64), 0
        while lo < len(mine):  # postings of long sets in large blocks, so many at a time
            hi = max(lo + 1, int(np.searchsorted(until, (until[lo - 1] if lo else 0) + POSTINGS, "right")))
            n = count[mine[lo:hi]]
            at = np.repeat(start[mine[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            inter += np.bincount(posted[at], minlength=m)
            lo = hi
        ok = den * inter >= num * (size[i] + size - inter)
        ok[: i + 1] = False
        if across:
            ok &= left != left[i]
        others = np.flatnonzero(ok)
        degree[i] += copies[others].sum()
        degree[others] += copies[i]
        for j in others:
            a, b = root(i), root(int(j))
            if a != b:
                parent[a] = b
                found.append((i, int(j)))
    return found, degree


def _verify(num: int, den: int):
    """Blocks, in order -> (u, v, null), the links of a spanning forest, and (u, null, links), the copies that a node is linked with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets, sides, copies = None, [], [], [], []
        out: tuple[list, list, list] = ([], [], [])

        def close() -> None:
            found, degree = links(sets, np.array(sides), num, den, np.array(copies)) if len(sets) > 1 else ([], np.zeros(0, np.int64))
            for i, j in found:
                for col, x in zip(out, (nodes[i], nodes[j], None), strict=True):
                    col.append(x)
            for i in np.flatnonzero(degree):
                for col, x in zip(out, (nodes[i], None, int(degree[i])), strict=True):
                    col.append(x)

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["u", "v", "n"])
            for c in out:
                c.clear()
            return batch

        for b in batches:
            blocks, ids, values, side, times = (b.column(c) for c in ("block", "node", "elements", "side", "copies"))
            for i in range(b.num_rows):
                if (now := blocks[i].as_py()) != key:
                    close()
                    key, nodes, sets, sides, copies = now, [], [], [], []
                nodes.append(ids[i].as_py())
                sets.append(values[i].values.to_numpy(zero_copy_only=False).view(np.uint64))
                sides.append(side[i].as_py())
                copies.append(times[i].as_py())
            if len(out[0]) > 10_000:
                yield flush()
        close()
        yield flush()

    return run


def _elements(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                rows = b.slice(lo, 500)
                sets = [shingles(x, width).view(np.int64) for x in rows.column("text").to_pylist()]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([rows.column("node"), rows.column("of"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["node", "of", "elements"])

    return run


def join(docs: DataFrame, width: int = WIDTH, num: int = NUMERATOR, den: int = DENOMINATOR) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, links, degrees) of docs (doc_id, text; other columns, whatever their names, are not looked at).

    members: one row a document, doc_id, node (the hash of its text; equal texts are one node), n_shingles.
    links: (u, v), pairs of nodes with den * intersection >= num * union that span each component of all such pairs. degrees: (node,
    others), how many documents of other nodes a node is linked with, if any; every pair is counted. Texts without words (null,
    empty, blank) have no shingles and link with nothing; repeated rows are members each; an empty table gives three.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("node"), text.alias("text"))
    if 10 * num < 9 * den:
        members, keyed = _rare_first(rows, width, num, den)
    else:
        profile = written(rows.mapInArrow(_profile(width, num, den), rows.select("doc_id", "node").schema.add("n_shingles", "long").add("keys", T.ArrayType(T.LongType()))))
        members = profile.select("doc_id", "node", "n_shingles")
        keyed = profile.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least <> most").select("key", "least")
    stars = keyed.join(shared, "key").filter("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v")).distinct()
    blocks = written(components(stars))
    nodes = members.groupBy("node").agg(F.max("n_shingles").alias("size"), F.count(F.lit(1)).alias("copies"))
    blocks = written(blocks.join(nodes, "node"))
    sizes = blocks.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("elements"))
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("elements") / ELEMENTS)).cast("int")
    # The texts of candidates: their nodes are sent to all tasks while few (28 bytes each), joined by shuffle beyond.
    wanted = written(blocks.join(sizes, "component").select("node", F.struct("component", parts.alias("parts"), "copies").alias("of")))
    sets = rows.select("node", "text").join(F.broadcast(wanted) if wanted.count() <= BROADCAST_NODES else wanted, "node").dropDuplicates(["node"]).select("node", "of", "text")
    elements = sets.mapInArrow(_elements(width), sets.select("node", "of").schema.add("elements", T.ArrayType(T.LongType())))
    own = F.pmod(F.xxhash64(F.lit(1), "node"), F.col("of.parts")).cast("int")
    # Part a meets part b in block (a, b); a block of one part is (0, 0). Within a part all pairs are tested in (a, a).
    dealt = elements.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of.parts") - 1)))
    dealt = dealt.select(F.xxhash64("of.component", F.least("own", "other"), F.greatest("own", "other")).alias("block"), "node", "elements", (F.col("own") > F.col("other")).alias("side"), "of.copies")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    found = dealt.repartition(n, "block").sortWithinPartitions("block", "node").mapInArrow(_verify(num, den), "u long, v long, n long")
    found = written(found.hint("rebalance"))  # few rows of many tasks: files by size, not one a task
    degrees = found.filter("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("others"))
    return members, found.filter("v is not null").select("u", "v"), degrees


def groups(members: DataFrame, found: DataFrame) -> DataFrame:
    """members with group: the least node that links reach, for each document."""
    return members.join(components(found).toDF("node", "_of"), "node", "left").select("*", F.coalesce("_of", "node").alias("group")).drop("_of")


def linked(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of each document: the least doc_id that links reach, itself included (null if none has
    one), and the number of other documents that it is linked with itself, copies of its text included."""
    members, found, degrees = join(docs, **options)
    rows = groups(members, found)
    # What a node has is one row a node, joined to documents by node, which a large group of copies does not make wider.
    nodes = rows.groupBy("node", "group").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("size"))
    least = nodes.filter("size > 0").groupBy("group").agg(F.min("least").alias("_least"))
    facts = nodes.join(least, "group").join(degrees, "node", "left").select("node", "_least", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("_links"))
    rows = members.join(facts, "node", "left")
    worded = F.col("n_shingles") > 0
    return rows.select("doc_id", "n_shingles", F.when(worded, F.col("_least")).otherwise(F.col("doc_id")).alias("component_id"), F.when(worded, F.col("_links")).otherwise(0).cast("long").alias("n_links"))

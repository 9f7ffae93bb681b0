"""Suffix-array dedup: the common-prefix interval tree of an enhanced suffix array, over blocks that a cluster can share out.

Every window of LEAST bytes is named by the least hash of its SEED-byte strings, so equal windows bear one name wherever they are.
Runs of windows of one name are items (368 bytes at most). Only items whose name is found twice are cut out, once a task for equal
ones, and dealt by name: equal windows meet in one block, and a block holds distinct items only, with how often each is there.

dedup wants what repeats cover, which items tell by themselves. In a block, suffixes of at least LEAST bytes whose first LEAST bytes recur
with unlike left neighbours are sorted into a suffix array with the common prefixes of neighbours. A stack scan over it visits the
common-prefix interval tree; every interval whose left extensions differ is a repeat group inside its items. An item that is there
more than once is a group of its own. A block of over BLOCK bytes is settled window by window, spread over the cluster.

repeats wants the groups themselves, whole: of any length, with all occurrences. Blocks give the places where a group may start: windows that
recur with unlike left neighbours, one class of equal windows each. A class is then followed to the right in rounds, each with twice the bytes
of the one before: its stretches are sorted into a suffix array, the stack scan outputs the intervals that are left-diverse and
end inside, and members that agree all along go on as a class of their own. A class of over CLASS bytes is split without meeting in one task:
a minimum finds what all its members share, which is a group if it is left-diverse, and the next byte deals them to its children.
The groups are the same whichever way a class goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import written

LEAST, SEED = 200, 32
#: Bytes of distinct items that one block may hold; bytes that a task sorts at once.
BLOCK, CHUNK = 2_000_000, 1_000_000
#: Bytes of a class's stretches that one task may sort.
CLASS = 16_000_000
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_PLACE = np.uint64(2**24 - 1)


def named_windows(raw: bytes, least: int = LEAST, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, start, bytes, seeds) of the items of a text: runs of at most least - seed + 1 windows of one name.

    A window's name is the hash of its least seed string, the first of equal ones; seeds counts the places of such strings in a
    run, as windows of one item can only be equal if it has several.
    """
    if len(raw) < least:
        return (np.zeros(0, np.int64),) * 4
    h = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
    k, power = 1, np.full(1, _A)
    while k < seed:
        h = h[:-k] * power + h[k:]
        power, k = power * power, 2 * k
    h = (h ^ (h >> np.uint64(29))) * _B
    h ^= h >> np.uint64(32)
    span = least - seed + 1
    count = len(h) - span + 1
    # Hashes with their places in the low bits: the least of a window then also says where it is.
    placed = (h & ~_PLACE) | (np.arange(len(h), dtype=np.uint64) & _PLACE)
    grid = np.concatenate((placed, np.full(-len(h) % span, 2**64 - 1, np.uint64))).reshape(-1, span)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    least_of = np.minimum(behind[:count], ahead[span - 1 : span - 1 + count])
    moves = np.concatenate(([True], least_of[1:] != least_of[:-1]))
    jump = np.flatnonzero(moves)
    place = jump + ((least_of[jump] - jump.astype(np.uint64)) & _PLACE).astype(np.int64)
    value = h[place]
    new = np.concatenate(([True], value[1:] != value[:-1]))
    first = jump[new]
    runs = np.diff(np.append(first, count))
    if (long := runs > span).any():  # a periodic text: its runs are cut
        cuts = np.concatenate([np.arange(s, s + n, span) for s, n in zip(first[long], runs[long], strict=True)])
        first = np.unique(np.concatenate((first, cuts)))
        runs = np.diff(np.append(first, count))
    steps = np.cumsum(moves)
    at = np.searchsorted(jump, first, side="right") - 1
    return value[at].view(np.int64), first, runs + least - 1, steps[first + runs - 1] - steps[first] + 1


def _common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b, at least `known` if they agree so far."""
    if a[:known] != b[:known]:
        known = 0
    lo, hi = known, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _interval_tree(suffixes: list[bytes], before: list[int], least: int) -> Iterator[tuple[int, list[int]]]:
    """(length, suffixes) of the left-diverse intervals of a common-prefix interval tree, by a stack scan over the suffix
    array of `suffixes`; before: their left neighbours."""
    array = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    prefix = [0, *(_common(suffixes[a], suffixes[b], least) for a, b in zip(array, array[1:], strict=False)), 0]
    breaks = [0]  # how often the left neighbour changes, up to each place
    for a, b in zip(array, array[1:], strict=False):
        breaks.append(breaks[-1] + (before[a] != before[b]))
    stack: list[tuple[int, int]] = []  # (common prefix, first place) of the open intervals
    for i in range(1, len(array) + 1):
        lcp, low = prefix[i], i - 1
        while stack and stack[-1][0] > lcp:
            length, low = stack.pop()
            if breaks[i - 1] > breaks[low]:
                yield length, array[low:i]
        if lcp >= least and (not stack or stack[-1][0] < lcp):
            stack.append((lcp, low))


def repeat_groups(items: list[bytes], times: list[int], least: int = LEAST) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places) of every maximal repeat group of distinct items: at least `least` bytes long, with all its occurrences, as
    places in the items put end to end. times: how often each item is there; an item's start counts as unlike any other left neighbour.

    Suffixes that share their first `least` bytes stand together in the suffix array, so it is built class by class of those.
    """
    sizes = np.array([len(x) for x in items])
    text = np.frombuffer(b"".join(items), np.uint8)
    ends = np.cumsum(sizes)
    begin = ends - sizes
    for i, n in enumerate(times):
        if n > 1 and sizes[i] >= least:
            yield int(sizes[i]), begin[i : i + 1]
    counts = np.maximum(sizes - least + 1, 0)
    if counts.sum() < 2:
        return
    at = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    key = window_hashes(text, least)[at]
    order = np.argsort(key)
    ordered = key[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    size = np.diff(np.append(first, len(ordered)))
    place = at[order]
    starts = np.zeros(len(text), bool)
    starts[begin[sizes > 0]] = True
    left = np.where(starts[place], -1, text[place - 1].astype(np.int64))
    unlike = (np.minimum.reduceat(left, first) != np.maximum.reduceat(left, first)) | (np.minimum.reduceat(left, first) < 0)
    owner = np.searchsorted(ends, place, side="right")
    for a, n in zip(*(x[(size > 1) & unlike].tolist() for x in (first, size)), strict=True):
        own = place[a : a + n]
        suffixes = [items[i][p:] for i, p in zip(owner[a : a + n].tolist(), (own - begin[owner[a : a + n]]).tolist(), strict=True)]
        before = [x if x >= 0 else -1 - k for k, x in enumerate(left[a : a + n].tolist())]
        if n == 2:  # one interval, left-diverse as the class is
            if (length := _common(suffixes[0], suffixes[1], least)) >= least:
                yield length, own
            continue
        for length, members in _interval_tree(suffixes, before, least):
            yield length, own[members]


def window_hashes(text: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all strings of `width` bytes: those of its powers of two, put together."""
    h, k, power, out, done = text.astype(np.uint64) + np.uint64(1), 1, np.full(1, _A), None, 0
    total = len(text) - width + 1
    while k <= width:
        if width & k:  # the next k bytes after the `done` ones
            part = h[done : done + total]
            out = part if out is None else (out ^ (out >> np.uint64(31))) * _B + part
            done += k
        h = h[:-k] * power + h[k:] if 2 * k <= width else h
        power, k = power * power, 2 * k
    return out


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _name(least: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for node, text in zip(b.column("node").to_pylist(), b.column("text").to_pylist(), strict=True):
                name, start, size, seeds = named_windows(text.encode(), least, seed)
                out.append((name, np.full(len(name), node, np.int64), start, size, seeds))
            cols = [np.concatenate([x[k] for x in out]) for k in range(5)] if out else [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), *(pa.array(c.astype(np.int32)) for c in cols[2:])], names=["name", "node", "start", "size", "seeds"])

    return run


_CUT = "node long, start int, item binary, name long, bytes binary, times long"


def _cut(led: bool):
    """Occurrences (node, start, item), each once a task and node, and items (item, name, bytes, times), each once a flush.

    led: the bytes of an item begin with how many bytes stand before it (0 or 1), and those bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _cut_out(batches, led)

    return run


def _cut_out(batches: Iterator[pa.RecordBatch], led: bool) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.int64())
    names = [x.split()[0] for x in _CUT.split(", ")]
    items: dict[bytes, list] = {}
    held = 0

    def flush() -> pa.RecordBatch:
        n = len(items)
        cols = ([None] * n, [None] * n, list(items), [x[0] for x in items.values()], [x[1] for x in items.values()], [x[2] for x in items.values()])
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
        items.clear()
        return batch

    nodes: dict[int, list[bytes]] = {}
    for b in batches:
        rows: tuple[list, list, list] = ([], [], [])
        for node, text, wanted in zip(b.column("node").to_pylist(), b.column("text").to_pylist(), b.column("wanted"), strict=True):
            if node in nodes:
                for item in nodes[node]:
                    if item in items:
                        items[item][2] += 1
                continue
            raw, own = text.encode(), []
            s = wanted.values
            for start, size, name in zip(s.field(0).to_pylist(), s.field(1).to_pylist(), s.field(2).to_pylist(), strict=True):
                piece = (bytes([start > 0]) + raw[max(start - 1, 0) : start + size]) if led else raw[start : start + size]
                item = hashlib.blake2b(piece, digest_size=16).digest()
                if (known := items.get(item)) is None:
                    items[item] = [name, piece, 1]
                    held += size
                else:
                    known[2] += 1
                own.append(item)
                for col, value in zip(rows, (node, start, item), strict=True):
                    col.append(value)
            nodes[node] = own
            held += 200 + 50 * len(own)  # what stays of a text until the next flush
        n = len(rows[0])
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((*rows, [None] * n, [None] * n, [None] * n), kinds, strict=True)], names=names)
        if held > 64_000_000:
            # The texts seen so far are whole: copies of them that follow are counted as new ones.
            held = 0
            nodes.clear()
            yield flush()
    yield flush()


def _blocks(chunk: int, close):
    """Items in order of name -> what `close` makes of the distinct items (bytes, times) of whole names, `chunk` bytes or more at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: dict[bytes, list] = {}
        held, last = 0, None
        for b in batches:
            for item, name, piece, times in zip(*(b.column(c).to_pylist() for c in ("item", "name", "bytes", "times")), strict=True):
                if name != last and held > chunk:
                    yield close(items)
                    items.clear()
                    held = 0
                last = name
                if (known := items.get(item)) is None:
                    items[item] = [piece, times]
                    held += len(piece)
                else:
                    known[1] += times
        yield close(items)

    return run


def _covered(least: int):
    """(item, offset, length) of the spans of each item that repeat groups cover."""

    def close(items: dict[bytes, list]) -> pa.RecordBatch:
        keys, pieces = list(items), [x[0] for x in items.values()]
        out: tuple = ([], [], [])
        if keys:
            ends = np.cumsum([len(x) for x in pieces])
            begin = ends - [len(x) for x in pieces]
            depth = np.zeros(int(ends[-1]) + 1, np.int64)
            for length, places in repeat_groups(pieces, [x[1] for x in items.values()], least):
                depth[places] += 1
                depth[places + length] -= 1
            on = np.cumsum(depth[:-1]) > 0
            edge = np.zeros(len(on), bool)
            edge[begin] = True  # runs end with their item
            opens = np.flatnonzero(on & (edge | ~np.concatenate(([False], on[:-1]))))
            closes = np.flatnonzero(on & np.concatenate((edge[1:] | ~on[1:], [True]))) + 1
            of = np.searchsorted(ends, opens, side="right")
            out = ([keys[i] for i in of], (opens - begin[of]).tolist(), (closes - opens).tolist())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.binary(), pa.int32(), pa.int32()), strict=True)], names=["item", "offset", "length"])

    return close


_START = "item binary, offset int, before int, class long"


def _starting(least: int, whole: bool = True):
    """(item, offset, before, class) of the windows that recur with unlike left neighbours: the byte before each, -1 where the text begins.

    whole: the items are all that have their names. If not, every window comes, with times."""

    def close(items: dict[bytes, list]) -> pa.RecordBatch:
        bodies, leads = [x[0][1:] for x in items.values()], np.array([x[0][0] for x in items.values()], np.int64)
        times, sizes = np.array([x[1] for x in items.values()], np.int64), np.array([len(x) for x in bodies], np.int64)
        ends = np.cumsum(sizes)
        begin = ends - sizes
        counts = np.maximum(sizes - leads - least + 1, 0)
        at = np.repeat(begin + leads - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        text = np.frombuffer(b"".join(bodies), np.uint8)
        key = window_hashes(text, least)[at] if len(at) else np.zeros(0, np.uint64)
        of = np.repeat(np.arange(len(bodies)), counts)
        left = np.where(at == begin[of], -1, text[at - 1].astype(np.int64)) if len(at) else at
        if whole and len(at):
            order = np.argsort(key)
            first = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
            low, high, many = np.minimum.reduceat(left[order], first), np.maximum.reduceat(left[order], first), np.add.reduceat(times[of][order], first)
            own = np.repeat((many > 1) & ((low < 0) | (low < high)), np.diff(np.append(first, len(order))))
            at, key, of, left = (x[order[own]] for x in (at, key, of, left))
        keys = np.array(list(items), object)
        columns = [pa.array(keys[of] if len(of) else [], pa.binary()), pa.array((at - begin[of] - leads[of]) if len(of) else [], pa.int32()), pa.array(left, pa.int32()), pa.array(key.view(np.int64))]
        columns += [] if whole else [pa.array(times[of] if len(of) else [], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["item", "offset", "before", "class", "times"][: len(columns)])

    return close


def _windows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, piece, times in zip(*(b.column(c).to_pylist() for c in ("item", "bytes", "times")), strict=True):
                n = len(piece) - least + 1
                digests = [hashlib.blake2b(piece[i : i + least], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([item] * n, pa.binary()), pa.array(range(n), pa.int32()), pa.array(digests, pa.binary()), pa.array([times] * n, pa.int64())], names=["item", "offset", "window", "times"])

    return run


def _items(docs: DataFrame, least: int, seed: int, block: int, led: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """docs keyed by node (hash of the text), occurrences (node, start, item), the items of blocks, by name, and those of large blocks, if any."""
    spark = docs.sparkSession
    keyed = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("node", F.xxhash64("text"))
    rows = keyed.select("node", "text")
    named = written(rows.mapInArrow(_name(least, seed), "name long, node long, start int, size int, seeds int"), gather=True)
    twice = named.groupBy("name").agg(F.sum("seeds").alias("n")).filter("n > 1").select("name")
    wanted = named.join(twice, "name").groupBy("node").agg(F.collect_set(F.struct("start", "size", "name")).alias("wanted"))  # bounded by the length of a text
    cut = written(rows.join(wanted, "node").select("node", "text", "wanted").mapInArrow(_cut(led), _CUT))
    occurrences = cut.filter("node is not null").select("node", "start", "item").distinct()
    items = cut.filter("bytes is not null").select("item", "name", "bytes", "times")
    large = written(items.groupBy("name").agg(F.sum(F.octet_length("bytes")).alias("n")).filter(F.col("n") > block).select("name"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    some = not large.isEmpty()
    usual = (items.join(large, "name", "left_anti") if some else items).repartition(n, "name").sortWithinPartitions("name")
    # Of large blocks, each item once; their windows are then combined before they are shuffled.
    spread = items.join(large, "name", "left_semi").groupBy("item").agg(F.lit(0).cast("long").alias("name"), F.max("bytes").alias("bytes"), F.sum("times").alias("times")) if some else None
    return keyed, occurrences, usual, spread


def _found(docs: DataFrame, least: int, seed: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs keyed by node, occurrences, and (item, offset, length) of what repeat groups cover of items."""
    keyed, occurrences, usual, spread = _items(docs, least, seed, block, False)
    found = usual.mapInArrow(_blocks(CHUNK, _covered(least)), "item binary, offset int, length int")
    if spread is not None:  # exactly, by 128-bit digests of windows
        each = written(spread.mapInArrow(_windows(least), "item binary, offset int, window binary, times long"))
        again = each.groupBy("window").agg(F.sum("times").alias("n")).filter("n > 1").select("window")
        found = found.unionByName(each.join(again, "window").select("item", "offset", F.lit(least).alias("length")))
    return keyed, occurrences, found


def _starts(docs: DataFrame, least: int, seed: int, block: int) -> tuple[DataFrame, DataFrame]:
    """docs keyed by node, and (class, node, start, before) of the places where a group may start."""
    keyed, occurrences, usual, spread = _items(docs, least, seed, block, True)
    found = usual.mapInArrow(_blocks(CHUNK, _starting(least)), _START)
    if spread is not None:
        each = written(spread.mapInArrow(_blocks(CHUNK, _starting(least, False)), _START + ", times long"))
        unlike = each.groupBy("class").agg(F.sum("times").alias("n"), F.min("before").alias("low"), F.max("before").alias("high")).filter("n > 1 and (low < 0 or low < high)")
        found = found.unionByName(each.drop("times").join(unlike.select("class"), "class", "left_semi"))
    return keyed, found.join(occurrences, "item").select("class", "node", (F.col("start") + F.col("offset")).alias("start"), "before")


_MEMBER = "class long, node long, start int, before int, copies long, depth int"
_STRETCH = _MEMBER + ", stretch binary"
_OUT = _MEMBER + ", length int, least long"


def _stretches(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _MEMBER.split(", ")]
        for b in batches:
            for text, own in zip(b.column("text"), b.column("own"), strict=True):
                raw, s = text.as_py().encode(), own.values
                at = (s.field("start").to_numpy().astype(np.int64) + s.field("depth").to_numpy()).tolist()
                yield pa.RecordBatch.from_arrays([*(s.field(c) for c in names), pa.array([raw[i : i + span] for i in at], pa.binary())], names=[*names, "stretch"])

    return run


def _hashes(node: list[int], start: list[int]) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(f"{a}:{b}".encode(), digest_size=8).digest(), "little", signed=True) for a, b in zip(node, start, strict=True)]


def _follow(span: int, least: int):
    """Classes, in order -> (member, length, least): the members of each group that ends in its stretch (least: of its members' hashes, which names
    it), and with a null length those that agree all along, of their new class and depth."""
    names = [x.split()[0] for x in _STRETCH.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple = tuple([] for _ in kinds)

        def put(member: tuple, cls: int, depth: int, length: int | None, name: int | None) -> None:
            for col, x in zip(out, (cls, *member[1:5], depth, length, name), strict=True):
                col.append(x)

        def close(rows: list[tuple]) -> None:
            if not rows:
                return
            cls, depth = rows[0][0], rows[0][5]
            rows = sorted((m for r in rows for m in [r] * min(r[4], 2)), key=lambda r: r[6])  # a copied text is there twice
            text, before = [r[6] for r in rows], [r[3] if r[3] >= 0 else -1 - i for i, r in enumerate(rows)]
            hashes = _hashes([r[1] for r in rows], [r[2] for r in rows])
            prefix = [-1, *(_common(a, b, 0) for a, b in zip(text, text[1:], strict=False)), -1]
            breaks = [0]
            for a, b in zip(before, before[1:], strict=False):
                breaks.append(breaks[-1] + (a != b))
            stack: list[tuple[int, int]] = []
            for i in range(1, len(rows) + 1):
                lcp, low = prefix[i], i - 1
                while stack and stack[-1][0] > lcp:
                    length, low = stack.pop()
                    if breaks[i - 1] == breaks[low]:
                        continue
                    members = dict(zip(hashes[low:i], rows[low:i], strict=True))
                    if length < span:
                        for m in members.values():
                            put(m, cls, depth, depth + length, min(members))
                    else:
                        new = int.from_bytes(hashlib.blake2b(text[low], digest_size=8, key=cls.to_bytes(8, "little", signed=True)).digest(), "little", signed=True)
                        for m in members.values():
                            put(m, new, depth + span, None, None)
                if lcp >= max(0, least - depth) and (not stack or stack[-1][0] < lcp):
                    stack.append((lcp, low))

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[*names[:6], "length", "least"])
            for c in out:
                c.clear()
            return batch

        rows: list[tuple] = []
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                if rows and rows[-1][0] != r[0]:
                    close(rows)
                    rows = []
                    if len(out[0]) > 100_000:
                        yield flush()
                rows.append(r)
        close(rows)
        yield flush()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each stretch has in common with its class's least one, and the hash of its member."""
    for b in batches:
        n = [_common(x, y, 0) for x, y in zip(b.column("stretch").to_pylist(), b.column("one").to_pylist(), strict=True)]
        own = _hashes(b.column("node").to_pylist(), b.column("start").to_pylist())
        yield pa.RecordBatch.from_arrays([*(b.column(x.split()[0]) for x in _STRETCH.split(", ")), pa.array(n, pa.int32()), pa.array(own, pa.int64())], names=[*(x.split()[0] for x in _STRETCH.split(", ")), "same", "hash"])


def _split(rows: DataFrame, span: int, least: int) -> DataFrame:
    """_follow for classes that no task can hold: one node of the interval tree a round, by aggregates and joins alone."""
    one = rows.groupBy("class").agg(F.min("stretch").alias("one"))
    each = written(rows.join(one, "class").mapInArrow(_shared, _STRETCH + ", same int, hash long"))
    node = each.groupBy("class").agg(F.min("same").alias("all"), F.sum("copies").alias("_n"), F.min("before").alias("low"), F.max("before").alias("high"), F.min("hash").alias("_hash"))
    each = each.join(node.filter("_n > 1 and (low < 0 or low < high)"), "class")
    here = each.filter((F.col("all") < span) & (F.col("depth") + F.col("all") >= least))
    here = here.select("class", "node", "start", "before", "copies", "depth", (F.col("depth") + F.col("all")).cast("int").alias("length"), F.col("_hash").alias("least"))
    on = F.when(F.col("all") == span, F.col("class")).otherwise(F.xxhash64("class", "all", F.substring("stretch", F.col("all") + 1, F.lit(1))))
    more = each.filter((F.col("all") == span) | (F.octet_length("stretch") > F.col("all")))
    more = more.select(on.alias("class"), "node", "start", "before", "copies", (F.col("depth") + F.col("all") + F.when(F.col("all") == span, 0).otherwise(1)).cast("int").alias("depth"))
    return here.unionByName(more.withColumns({"length": F.lit(None).cast("int"), "least": F.lit(None).cast("long")}))


def repeats(docs: DataFrame, least: int = LEAST, seed: int = SEED, block: int = BLOCK, klass: int = CLASS) -> DataFrame:
    """(grp, length, doc_id, node, start): all occurrences of every maximal repeat group of docs (doc_id, text), as bytes of UTF-8.

    A group is a string of `least` bytes or more that is there more than once and cannot be longer either way without losing an
    occurrence; ends of texts count as unlike anything. node is the hash of the text (xxhash64); copies of a text have one node and are
    occurrences each. Null and empty texts have none, other columns are not looked at, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    keyed, members = _starts(docs.select("doc_id", "text"), least, seed, block)
    copies = keyed.groupBy("node").agg(F.count(F.lit(1)).alias("copies"))
    members = members.join(copies, "node").select("class", "node", "start", "before", "copies", F.lit(0).alias("depth"))
    span, found, n = 2 * least, None, max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = keyed.select("node", "text").dropDuplicates(["node"])
    while True:
        alive = members.groupBy("class").agg(F.sum("copies").alias("n"), F.min("before").alias("low"), F.max("before").alias("high")).filter("n > 1 and (low < 0 or low < high)")
        own = members.join(alive.select("class"), "class", "left_semi").groupBy("node").agg(F.collect_list(F.struct("class", "node", "start", "before", "copies", "depth")).alias("own"))  # of one text
        rows = written(texts.join(own, "node").select("text", "own").mapInArrow(_stretches(span), _STRETCH))
        if rows.isEmpty():
            break
        large = written(rows.groupBy("class").agg(F.sum(F.octet_length("stretch") + 100).alias("n")).filter(F.col("n") > klass).select("class"))
        some = not large.isEmpty()
        usual = (rows.join(large, "class", "left_anti") if some else rows).repartition(n, "class").sortWithinPartitions("class")
        done = usual.mapInArrow(_follow(span, least), _OUT)
        done = written(done.unionByName(_split(rows.join(large, "class", "left_semi"), span, least)) if some else done)
        groups = done.filter("length is not null").select(F.xxhash64("least", "length").alias("grp"), "length", "node", "start")
        found = groups if found is None else found.unionByName(groups)
        members, span = done.filter("length is null").select("class", "node", "start", "before", "copies", "depth"), 2 * span
    found = rows.select(F.col("class").alias("grp"), F.col("depth").alias("length"), "node", "start") if found is None else found
    return found.join(keyed.select("doc_id", "node"), "node").select("grp", "length", "doc_id", "node", "start")


def _remove(kept_columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, spans = [], []
            for text, own in zip(b.column("text").to_pylist(), b.column("_spans").to_pylist(), strict=True):
                raw, at, parts = text.encode(), 0, []
                merged = _merge([(x["at"], x["at"] + x["length"]) for x in own or ()])
                for a, z in merged:
                    parts.append(raw[at:a])
                    at = z
                parts.append(raw[at:])
                kept.append(b"".join(parts))
                spans.append([{"start": a, "length": z - a} for a, z in merged])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept_columns), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))], names=[*kept_columns, "kept", "removed"])

    return run


def dedup(docs: DataFrame, least: int = LEAST, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """docs with kept (binary: the bytes of the text that no repeat covers, in order) and removed (array of start and length of maximal runs).

    A byte goes if a string of `least` bytes over it also starts elsewhere, in any text or the same one; overlaps
    count, and strings are judged on the input. Null texts count as empty and come back so; repeated rows are copies of each
    other. Columns named kept or removed are replaced.
    """
    keyed, occurrences, found = _found(docs, least, seed, block)
    spans = found.join(occurrences, "item").select("node", F.struct((F.col("start") + F.col("offset")).cast("long").alias("at"), F.col("length").cast("long").alias("length")).alias("s"))
    spans = spans.groupBy("node").agg(F.collect_set("s").alias("_spans"))  # bounded by the length of a text
    kept = [c for c in docs.columns if c not in ("kept", "removed")]
    rows = keyed.join(spans, "node", "left").select(*kept, "_spans")
    span = T.ArrayType(T.StructType().add("start", T.LongType()).add("length", T.LongType()))
    return rows.mapInArrow(_remove(kept), rows.select(*kept).schema.add("kept", T.BinaryType()).add("removed", span))

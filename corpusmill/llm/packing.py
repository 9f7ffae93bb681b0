"""Best-fit packing: partitions best-fit locally, nearly full bins leave, underfull bins merge up a tree as items.

Level 0 tokenizes a partition and packs its pieces best-fit decreasing. Bins with at most SLACK free tokens are final. The rest go up a
tree, FAN_IN groups to one, for a new best-fit round, until one group is left. An underfull bin goes up opened, as the pieces it holds:
two pieces of 424 in one bin could never meet one of 600 each. Pieces of one length are alike, so a group goes up as its histogram: how
many pieces it has of each length, LENGTH numbers at most, however many they are. A round says which runs of a child's pieces
go where, and pieces follow their runs. So nothing is given up on for want of memory, and no task of the tree holds pieces. Every
level is a written table of numbers: a lost executor costs no tokenizing again.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import written

LENGTH, EOS, VOCABULARY = 1024, 2, "byte_bpe_50k.json"
SLACK, FAN_IN = 4, 8
#: Runs of a round that are sent to all tasks, 70 bytes each; more are joined by shuffle.
BROADCAST_RUNS = 200_000
#: The split pattern of the byte-level vocabulary (a fixed value of the public tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PIECE = "doc_id {id}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, grp long, rank long, done boolean"
_RUN = "child long, size long, first long, n long, up long, rank_up long, instance long, at long, done boolean"
_encoders: dict[str, object] = {}


def encoder(vocabulary: str):
    """text -> ids, for the vocabulary file of the tokenizers library named or found at that path.

    The same merges by tiktoken's faster code; its ids are held against the tokenizers library in the tests.
    """
    if vocabulary not in _encoders:
        import json

        import public_tokenizers
        import tiktoken

        with open(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary), encoding="utf-8") as f:
            spec = json.load(f)
        # The byte alphabet of byte-level BPE: printable Latin-1 bytes stand for themselves, the others follow from U+0100.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        bpe = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        _encoders[vocabulary] = lambda t: bpe.encode(t, allowed_special="all") if any(s in t for s in special) else bpe.encode_ordinary(t)
    return _encoders[vocabulary]


def best_fit(sizes: list[int], length: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing: (bin, offset) of each item and the fill of each bin."""
    free: dict[int, list[int]] = defaultdict(list)  # bins by free tokens
    mask, fills, bins, offsets = 0, [], [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        n = sizes[i]
        if fit := mask >> n:
            room = n + (fit & -fit).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            b, room = len(fills), length
            fills.append(0)
        bins[i], offsets[i], fills[b] = b, fills[b], fills[b] + n
        free[room - n].append(b)
        mask |= 1 << (room - n)
    return bins, offsets, fills


def best_fit_runs(counts: dict[int, list[tuple[int, int]]], length: int) -> tuple[list[tuple[int, int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Best-fit decreasing over a histogram: counts[size] has (child, number) of its alike items.

    Returns runs (child, size, first, n, instance, offset): n items of a child, from its first-th of that size on, at `offset` of as many
    bins from `instance` on; and ranges (instance, n, fill) of bins that are alike, which part all instances.
    """
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # ranges (instance, n) of bins by free tokens
    runs, total = [], 0
    for size in sorted(counts, reverse=True):
        queue = [[child, 0, n] for child, n in counts[size]][::-1]

        def take(k: int, instance: int, offset: int, size: int = size, queue: list = queue) -> None:
            while k:
                child, first, n = queue[-1]
                m = min(k, n)
                runs.append((child, size, first, m, instance, offset))
                k, instance = k - m, instance + m
                queue[-1][1:] = first + m, n - m
                if n == m:
                    queue.pop()

        left = sum(n for _, n in counts[size])
        while left:
            room = min((r for r, own in open_.items() if own and r >= size), default=None)
            if room is None:
                per = length // size  # an item opens a bin, and those like it fill it up
                k, more = divmod(left, per)
                for bins, each in ((k, per), (1, more)):
                    if bins and each:
                        for j in range(each):
                            take(bins, total, j * size)
                        open_[length - each * size].append((total, bins))
                        total += bins
                break
            at, n = open_[room].pop()
            m = min(n, left)
            take(m, at, length - room)
            open_[room - size].append((at, m))
            if m < n:
                open_[room].append((at + m, n - m))
            left -= m
    return runs, sorted((at, n, length - room) for room, own in open_.items() for at, n in own)


def _local(length: int, eos: int, vocabulary: str, slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(vocabulary), TaskContext.get().partitionId()
        ids, where, starts, sizes, crcs, kind = [], array("i"), array("q"), array("q"), array("q"), pa.int64()
        for batch in batches:
            kind = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = array("I", encode(text or "") + [eos]).tobytes()
                n = len(raw) // 4
                at = [0, *range(n % length or length, n, length), n] if n > length else [0, n]
                for k in range(len(at) - 1):
                    ids.append(doc_id)
                    where.append(k)
                    starts.append(at[k])
                    sizes.append(at[k + 1] - at[k])
                    crcs.append(zlib.crc32(raw[4 * at[k] : 4 * at[k + 1]]))
        if len(sizes):
            bins, offsets, fills = (np.array(x, np.int64) for x in best_fit(list(sizes), length))
            done, long = (fills >= length - slack)[bins], np.array(sizes, np.int64)
            rank = np.zeros(len(long), np.int64)  # among the pieces of one length that go up
            up = np.flatnonzero(~done)
            order = up[np.argsort(long[up], kind="stable")]
            rank[order] = np.arange(len(order)) - np.searchsorted(long[order], long[order])
            out = [pa.array(ids, kind), pa.array(where, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, sizes, crcs, (part << 32) + bins, offsets))]
            out += [pa.array(np.full(len(long), part), pa.int64()), pa.array(rank), pa.array(done)]
            yield from pa.table(out, names=[x.split()[0] for x in _PIECE.split(", ")]).to_batches(100_000)

    return run


def _round(length: int, slack: int, last: bool):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        counts: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for child, size, n in sorted(zip(*(table[c].to_pylist() for c in ("grp", "length", "n")), strict=True)):
            counts[size].append((child, n))
        runs, alike = best_fit_runs(counts, length)
        at, n, fill = (np.array(x, np.int64) for x in zip(*alike))
        done, rank, rows = np.ones(len(at), bool) if last else fill >= length - slack, defaultdict(int), []
        for child, size, first, many, instance, offset in runs:  # cut where bins stop being alike
            i = int(np.searchsorted(at, instance, "right")) - 1
            while many:
                m = min(many, int(at[i] + n[i]) - instance)
                rows.append((child, size, first, m, key[0].as_py(), rank[size], instance, offset, bool(done[i])))
                rank[size] += 0 if done[i] else m
                first, many, instance, i = first + m, many - m, instance + m, i + 1
        kinds = {"long": pa.int64(), "boolean": pa.bool_()}
        fields = [x.split() for x in _RUN.split(", ")]
        return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields, strict=True)], names=[name for name, _ in fields])

    return run


def pack(docs: DataFrame, length: int = LENGTH, eos: int = EOS, vocabulary: str = VOCABULARY, slack: int = SLACK, fan_in: int = FAN_IN) -> DataFrame:
    """One row a piece of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and the end id; a null or empty text is the end id alone, and a null doc_id stays null. Documents over `length`
    ids are cut into pieces of that length, the first of which may be shorter; others stay whole. Texts may be of any length; repeated
    rows are packed each. An empty table gives no rows. Other columns, whatever their names, are not looked at.
    """
    names = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    pieces = written(docs.select("doc_id", "text").mapInArrow(_local(length, eos, vocabulary, slack), _PIECE.format(id=dict(docs.dtypes)["doc_id"])))
    level, groups, out, left = 0, (pieces.agg(F.max("grp")).first()[0] or 0) + 1, pieces.filter("done").select(*names), pieces.filter("not done")
    while True:
        level, last, groups = level + 1, groups <= fan_in, -(-groups // fan_in)
        alike = left.groupBy("grp", "length").agg(F.count(F.lit(1)).alias("n"))
        runs = written(alike.groupBy(F.expr(f"grp div {fan_in}").alias("up")).applyInArrow(_round(length, slack, last), _RUN))
        side = F.broadcast(runs) if runs.count() <= BROADCAST_RUNS else runs
        mine = (F.col("grp") == F.col("child")) & (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
        along = F.col("rank") - F.col("first")
        sequence = F.lit(level << 57) + F.shiftleft(F.col("up"), 38) + F.col("instance") + along
        here = left.drop("sequence_id", "offset", "done").join(side, mine)
        here = here.select(*names[:5], sequence.alias("sequence_id"), F.col("at").alias("offset"), F.col("up").alias("grp"), (F.col("rank_up") + along).alias("rank"), "done")
        if last:
            return out.unionByName(here.select(*names))
        here = written(here)
        out, left = out.unionByName(here.filter("done").select(*names)), here.filter("not done")

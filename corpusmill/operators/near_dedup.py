"""Near deduplication: MinHash signatures, banded buckets, connected components, the best document of each.

Signature arithmetic is (a * h + b) mod (2^31 - 1) over 32-bit MD5 prefixes of word n-grams: the same numbers in every engine. Buckets
link their documents to the least id as a star; texts without words share one bucket, as do equal short texts.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.config import LIGHT, NearDedupConfig
from corpusmill.operators.components import components
from corpusmill.operators.exact_dedup import keep_best
from corpusmill.sources.scratch import written

PRIME = 2**31 - 1


def coefficients(n: int, seed: int) -> tuple[list[int], list[int]]:
    rng = random.Random(seed)
    return [rng.randrange(1, PRIME) for _ in range(n)], [rng.randrange(PRIME) for _ in range(n)]


def shingle_hashes(text: str, n: int) -> list[int]:
    """Distinct 32-bit hashes of word n-grams; a shorter text is one gram, a blank one has none."""
    words = text.split()
    if not words:
        return []
    grams = {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}
    return [int(hashlib.md5(g.encode()).hexdigest()[:8], 16) for g in grams]


def signatures(docs: DataFrame, cfg: NearDedupConfig = LIGHT, id: str = "ord") -> DataFrame:
    """(id, signature: array<long>); a text without words has an empty one."""
    a, b = (np.array(x, np.int64)[:, None] for x in coefficients(cfg.num_perm, cfg.seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                h = np.array(shingle_hashes(text.as_py() or "", cfg.ngram), np.int64) % PRIME
                if not len(h):
                    out.append([])
                    continue
                least = np.full(cfg.num_perm, PRIME, np.int64)
                for lo in range(0, len(h), 4096):  # permutations times so many shingles at a time
                    least = np.minimum(least, ((a * h[lo : lo + 4096] + b) % PRIME).min(1))
                out.append(least)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=[id, "signature"])

    return docs.select(id, "content").mapInArrow(run, docs.select(id).schema.add("signature", T.ArrayType(T.LongType())))


def buckets(signed: DataFrame, cfg: NearDedupConfig = LIGHT, id: str = "ord") -> DataFrame:
    """(id, band, key): one row a band; all texts without words share band -1."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(cfg.bands - 1)), lambda i: F.struct(i.alias("band"), F.md5(F.array_join(F.slice("signature", i * cfg.rows + 1, cfg.rows), ",")).alias("key")))
    blank = F.array(F.struct(F.lit(-1).alias("band"), F.lit("").alias("key")))
    return signed.select(id, F.explode(F.when(F.size("signature") == 0, blank).otherwise(bands)).alias("x")).select(id, "x.band", "x.key")


def clusters(docs: DataFrame, cfg: NearDedupConfig = LIGHT, id: str = "ord") -> DataFrame:
    """(id, cluster) of every document: the least id that shared buckets reach."""
    rows = written(buckets(signatures(docs, cfg, id), cfg, id))
    least = rows.groupBy("band", "key").agg(F.min(id).alias("least"), F.max(id).alias("most")).filter("least <> most").drop("most")
    edges = rows.join(least, ["band", "key"]).select(F.col(id).alias("u"), F.col("least").alias("v")).filter("u <> v").distinct()
    found = components(edges)
    return docs.select(id).join(found.withColumnRenamed("node", id), id, "left").select(id, F.coalesce("component", id).alias("cluster"))


def near_dedup(docs: DataFrame, cfg: NearDedupConfig = LIGHT, order: str = "ord") -> DataFrame:
    """One document of each cluster: the greatest keep_by columns, then the first by `order` (a long that tells rows apart)."""
    return keep_best(docs.join(clusters(docs, cfg, order), order), "cluster", cfg.keep_by, order).drop("cluster")

"""Training sequences: byte packing of documents, and response-only masks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.prefix import running_total
from corpusmill.operators.chat import SYSTEM

SEPARATOR = b"\n"


def pack_segments(docs: DataFrame, seq_len: int, order: str = "ord") -> DataFrame:
    """(block, order, block_start, doc_start, length): which bytes of which document fill which block.

    Documents are UTF-8 bytes and one separator byte each, end to end by `order`; the last, partial block is left out. Offsets come
    from sums in two steps, so no task reads the whole corpus.
    """
    df = docs.select(order, (F.octet_length("content") + 1).cast("long").alias("n"))
    df = running_total(df, "n", order, into="at")
    total = df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    full = total // seq_len
    df = df.withColumn("block", F.explode(F.sequence(F.expr(f"at div {seq_len}"), F.expr(f"(at + n - 1) div {seq_len}")))).filter(F.col("block") < full)
    start = F.greatest(F.col("at"), F.col("block") * seq_len)
    end = F.least(F.col("at") + F.col("n"), (F.col("block") + 1) * seq_len)
    return df.select("block", order, (start - F.col("block") * seq_len).alias("block_start"), (start - F.col("at")).alias("doc_start"), (end - start).alias("length"))


def pack_blocks(docs: DataFrame, seq_len: int, order: str = "ord") -> DataFrame:
    """(block, ids: array<int>) of exactly seq_len byte ids."""
    parts = pack_segments(docs, seq_len, order).join(docs.select(order, "content"), order)
    raw = F.concat(F.encode("content", "UTF-8"), F.lit(bytearray(SEPARATOR)))
    parts = parts.select("block", F.struct("block_start", F.hex(F.substring(raw, (F.col("doc_start") + 1).cast("int"), F.col("length").cast("int"))).alias("hex")).alias("p"))
    joined = parts.groupBy("block").agg(F.array_sort(F.collect_list("p")).alias("p"))  # a block is seq_len bytes
    return joined.select("block", byte_ids(F.unhex(F.array_join(F.transform("p", lambda x: x["hex"]), ""))).alias("ids"))


def byte_ids(raw):
    """A binary column as array<int>: Latin-1 gives each byte the character of its number."""
    return F.transform(F.regexp_extract_all(F.decode(raw, "ISO-8859-1"), F.lit("(?s)."), 0), lambda c: F.ascii(c))


def decode_ids(ids):
    """Byte ids back to text, invalid bytes replaced."""
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.lpad(F.hex(i), 2, "0")), "")), "UTF-8")


def batches(blocks: DataFrame, batch_size: int) -> DataFrame:
    """blocks with batch; a partial last batch is left out."""
    full = blocks.count() // batch_size
    return blocks.withColumn("batch", F.expr(f"block div {batch_size}")).filter(F.col("batch") < full)


def sft_examples(examples: DataFrame, seq_len: int, system: str = SYSTEM, pad_id: int = 0) -> DataFrame:
    """examples with ids and mask of seq_len: prompt, response, padding; the mask is 1 on the response. Texts are not stripped; a prompt over seq_len leaves a mask of zeros."""
    prompt = F.encode(F.concat(F.lit(f"<|system|>\n{system}\n<|user|>\n"), F.coalesce("instruction", F.lit("")), F.lit("\n<|assistant|>\n")), "UTF-8")
    response = F.encode(F.concat(F.coalesce("response", F.lit("")), F.lit("\n<|end|>")), "UTF-8")
    p = F.least(F.octet_length(prompt), F.lit(seq_len))
    n = F.least(F.octet_length(prompt) + F.octet_length(response), F.lit(seq_len))
    ids = F.concat(F.slice(byte_ids(F.concat(prompt, response)), 1, seq_len), F.array_repeat(F.lit(pad_id), F.lit(seq_len) - n))
    mask = F.concat(F.array_repeat(F.lit(0.0), p), F.array_repeat(F.lit(1.0), n - p), F.array_repeat(F.lit(0.0), F.lit(seq_len) - n))
    return examples.withColumn("ids", ids).withColumn("mask", mask.cast("array<float>"))


def bpe_encode(docs: DataFrame, vocabulary: str, text: str = "content") -> DataFrame:
    """docs with ids by a tokenizers vocabulary file (a path that executors can open)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        for b in rows:
            out = [x.ids for x in tokenizer.encode_batch_fast([t or "" for t in b.column(text).to_pylist()], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int32()))], names=[*b.schema.names, "ids"])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType(docs.schema.fields).add("ids", T.ArrayType(T.IntegerType())))

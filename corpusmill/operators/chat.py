"""Dialogues and instruction examples: pairing, gates, chat text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions.textfn import code_blocks, estimate_tokens, first_nonempty, strip

SYSTEM = "You are a helpful programming assistant."
#: Signs of code in a dialogue (fixed value).
CODE_HINT = r"(?i)```|def |class |import |function |const |public |#include|console\.|print\("


def dialogue_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, instruction, response): each user turn that the assistant answers next."""
    w = W.partitionBy("conv_id").orderBy("turn")
    df = turns.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("_role"), F.lead("text").over(w).alias("response"))
    return df.filter("role = 'user' and _role = 'assistant'").select("conv_id", "turn", F.col("text").alias("instruction"), "response")


def build_realuser(pairs: DataFrame, responses: DataFrame | None = None, min_chars: int = 40, hint: str = CODE_HINT) -> DataFrame:
    """Code-related pairs, stripped, with source, language (Python where there is none) and regenerated.

    An answer shorter than min_chars gives way to the first block of its replacement in responses (instruction, response); where there is
    none it stays, unless it is empty.
    """
    df = pairs.withColumns({"instruction": strip(first_nonempty(F.col("instruction"))), "response": strip(first_nonempty(F.col("response")))})
    df = df.filter((F.col("instruction") != "") & (F.col("instruction").rlike(hint) | F.col("response").rlike(hint)))
    new = F.lit(None).cast("string")
    if responses is not None:
        df = df.join(responses.groupBy("instruction").agg(F.min("response").alias("_new")), "instruction", "left")
        new = F.get(code_blocks(F.col("_new")), 0)
    df = df.withColumn("_block", F.when(F.length("response") < min_chars, new))
    language = F.coalesce(F.col("language"), F.lit("Python")) if "language" in pairs.columns else F.lit("Python")
    df = df.withColumns({"response": F.coalesce("_block", "response"), "regenerated": F.col("_block").isNotNull(), "source": F.lit("realuser_instruct"), "language": language})
    return df.filter("response <> ''").drop("_new", "_block")


def chat_text(instruction: Column, response: Column, system: str = SYSTEM) -> Column:
    return F.concat(F.lit(f"<|system|>\n{system}\n<|user|>\n"), strip(instruction), F.lit("\n<|assistant|>\n"), strip(response), F.lit("\n<|end|>"))


def format_dataset(examples: DataFrame, system: str = SYSTEM, counter=estimate_tokens) -> DataFrame:
    """examples with text and tokens; counter is any Column -> Column function."""
    return examples.withColumn("text", chat_text(F.col("instruction"), F.col("response"), system)).withColumn("tokens", counter(F.col("text")))


def example_text(df: DataFrame) -> Column:
    return F.concat(first_nonempty(F.col("instruction")), F.lit("\n"), first_nonempty(F.col("response")))

r"""Chat formatting by quotation linking, in Spark expressions alone.

A line's quote level is its number of leading '>'. The passages of a message are its lines, its blocks (lines of one level in a row, up to a
blank one) and the whole of each level, normalised (lower case, white space collapsed, so that wrapping does not matter) and hashed. A
quoted passage is joined to its original: the first message of the conversation that says it itself, at level 0. A message's parent is
the earlier message that its lowest matching level quotes most of; its root, depth and path of ancestors follow by pointer doubling.
Sorted by path a conversation is in reply order, every reply below what it answers, so that no conversation, however long, has to meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import written

_MARK = r"^[\x20\x09]*(?:>[\x20\x09]*)+"
#: A line that only says who wrote what is quoted below it.
_ATTRIBUTION = r"(?i)^.{0,200}\b(?:wrote|writes|schrieb|escribió|a écrit)\s*:\s*$"


def quoted_lines(text: Column) -> Column:
    r"""array<struct<level: int, body: string>>, one a \n-split line; attribution lines right above a deeper quote have level -1."""
    marked = lambda s: F.struct(F.length(F.regexp_replace(F.regexp_extract(s, _MARK, 0), "[^>]", "")).alias("level"), F.regexp_replace(s, _MARK, "").alias("body"))
    lines = F.transform(F.split(text, "\n", -1), lambda s: F.when(F.contains(s, F.lit(">")), marked(s)).otherwise(F.struct(F.lit(0).alias("level"), s.alias("body"))))

    def attributed(x: Column, i: Column, every: Column) -> Column:
        below = F.get(every, i + 1)
        return F.when(below.isNotNull() & (below["level"] > x["level"]) & x["body"].rlike(_ATTRIBUTION), F.struct(F.lit(-1).alias("level"), x["body"].alias("body"))).otherwise(x)

    return F.element_at(F.transform(F.array(lines), lambda every: F.transform(every, lambda x, i: attributed(x, i, every))), 1)


def normalised(s: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(s, r"[\x20\x09-\x0D]+", " ")))


def _passages(lines: Column) -> Column:
    """array<struct<level, passage>> of every line, block and whole level, blank ones left out, each once."""
    plain = F.transform(lines, lambda x: F.struct(x["level"].alias("level"), normalised(x["body"]).alias("passage")))

    def longer(lines: Column) -> Column:
        """The blocks and the whole of each level of several lines: put together from normalised lines, they are normalised but for their ends."""
        said = F.filter(lines, lambda x: (x["level"] >= 0) & (x["passage"] != ""))
        levels = F.filter(F.array_distinct(F.transform(said, lambda x: x["level"])), lambda n: F.size(F.filter(said, lambda x: x["level"] == n)) > 1)
        whole = F.transform(levels, lambda n: F.struct(n.alias("level"), F.array_join(F.transform(F.filter(said, lambda x: x["level"] == n), lambda x: x["passage"]), " ").alias("passage")))
        # What is not of a level, or blank, becomes a sign of its own, at which the level is cut.
        cut = lambda n: F.split(F.array_join(F.transform(lines, lambda x: F.when((x["level"] == n) & (x["passage"] != ""), x["passage"]).otherwise(F.lit("\x01"))), " "), "\x01")
        blocks = F.flatten(F.transform(levels, lambda n: F.transform(cut(n), lambda x: F.struct(n.alias("level"), F.trim(x).alias("passage")))))
        return F.concat(lines, blocks, whole)

    # An array of one lets the lines be worked out once.
    every = F.element_at(F.transform(F.array(plain), longer), 1)
    return F.array_distinct(F.filter(every, lambda x: (x["level"] >= 0) & (x["passage"] != "")))


def own_text(lines: Column) -> Column:
    """A message without its quotes: the lines of level 0, blank ones at either end left out."""
    own = F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    return F.regexp_replace(own, r"^(?:[\x20\x09\x0B-\x0D]*\n)+|(?:\n[\x20\x09\x0B-\x0D]*)+$", "")


def link(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, matched) of the messages that quote an earlier one of their conversation.

    messages (conv_id, turn, text). Rows of one conv_id and turn are one message; null keys link with nothing.
    """
    rows = messages.dropna(subset=["conv_id", "turn"]).select("conv_id", "turn", F.explode(_passages(quoted_lines(F.coalesce("text", F.lit(""))))).alias("p"))
    rows = rows.select("conv_id", "turn", "p.level", F.unhex(F.sha2("p.passage", 256)).alias("hash"), F.length("p.passage").alias("size"))
    quotes = rows.filter("level > 0").distinct()
    originals = rows.filter("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("parent_turn"))  # one row a passage: its first author
    hits = quotes.join(originals, ["conv_id", "hash"]).filter("parent_turn < turn")
    hits = hits.groupBy("conv_id", "turn", "level", "parent_turn").agg(F.sum("size").alias("size"))
    best = hits.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("near"), "size", "parent_turn")).alias("b"))
    return best.select("conv_id", "turn", "b.parent_turn", F.col("b.size").alias("matched"))


def thread(links: DataFrame) -> DataFrame:
    """links with root_turn, depth and path (the turns from the root to the message), by pointer doubling: as many rounds as the logarithm of
    the deepest reply. A path is as long as its message is deep."""
    up = written(links.select("conv_id", "turn", "parent_turn", F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth"), F.array("parent_turn", "turn").alias("path")))
    while True:
        above = up.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("_root"), F.col("depth").alias("_more"), F.col("path").alias("_path"))
        joined = up.join(above, ["conv_id", "root_turn"], "left")
        if joined.filter("_root is not null").isEmpty():
            return up
        path = F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("_path", F.slice("path", 2, F.size("path"))))
        up = written(joined.select("conv_id", "turn", "parent_turn", F.coalesce("_root", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"), path.alias("path")))


def conversations(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) with parent_turn (null: no quote links it), root_turn, depth, path, n_quoted (lines), clean_text
    and formatted (role tag and clean text). Sorted by conv_id and path they are the conversations in reply order: a message, then each of
    its replies by turn, with all that answers it.

    A null text has no quotes and an empty clean text; a null role is 'unknown'; a message with a null conv_id or turn links with nothing;
    repeated rows stay. Columns of these names are replaced, all others stay. Empty tables stay empty. Texts may be of any length:
    passages are as many as lines, blocks and levels, and travel as hashes.
    """
    new = ("parent_turn", "root_turn", "depth", "path", "n_quoted", "clean_text", "formatted")
    kept = [c for c in messages.columns if c not in new]
    threads = thread(link(messages)).select(*(F.col(c).alias(f"_quote_{c}") for c in ("conv_id", "turn", "parent_turn", "root_turn", "depth", "path")))
    lines = quoted_lines(F.coalesce("text", F.lit("")))
    rows = messages.select(*kept, lines.alias("_quote_lines"))
    clean = own_text(F.col("_quote_lines"))
    # What the lines tell is settled before the join, which then moves no lines and, where none asks for it, no text.
    rows = rows.select(
        *kept, F.size(F.filter("_quote_lines", lambda x: x["level"] != 0)).cast("long").alias("n_quoted"), clean.alias("clean_text"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), clean).alias("formatted"),
    )
    rows = rows.join(threads, (F.col("conv_id") == F.col("_quote_conv_id")) & (F.col("turn") == F.col("_quote_turn")), "left")
    return rows.select(
        *kept, F.col("_quote_parent_turn").alias("parent_turn"), F.coalesce("_quote_root_turn", "turn").alias("root_turn"), F.coalesce("_quote_depth", F.lit(0)).cast("long").alias("depth"),
        F.coalesce("_quote_path", F.array("turn")).alias("path"), "n_quoted", "clean_text", "formatted",
    )


def quoting(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) as mail threads write them, for conversations that hold no quotes of their own.

    Of four turns in a row, the second quotes the first, the third the second (and, one level deeper, the first), the fourth the
    second, each under an attribution line. Texts are joined by conversation and turn, so that no conversation meets in one task.
    """
    step = F.pmod(F.col("turn"), F.lit(4))
    mark = lambda c, sign: F.concat(F.lit(sign), F.replace(c, F.lit("\n"), F.lit(f"\n{sign}")), F.lit("\n"))
    # Each text goes to the turns that quote it, so that one exchange brings a turn all it needs.
    to = lambda on, side: F.struct((F.col("turn") + on).alias("to"), F.lit(side).alias("side"))
    turns = F.when(step == 0, F.array(to(1, "near"), to(2, "far"))).when(step == 1, F.array(to(1, "near"), to(2, "near")))
    said = messages.dropna(subset=["conv_id", "turn", "text"]).select(F.col("conv_id").alias("_conv"), F.col("text").alias("_said"), F.explode(turns).alias("_t"))
    side = lambda name: F.min(F.when(F.col("_t.side") == name, F.col("_said"))).alias(f"_said_{name}")
    said = said.groupBy("_conv", F.col("_t.to").alias("_to")).agg(side("near"), side("far"))
    rows = messages.join(said, (F.col("conv_id") == F.col("_conv")) & (F.col("turn") == F.col("_to")), "left")
    far = F.coalesce(mark(F.col("_said_far"), ">> "), F.lit(""))
    text = F.when(F.col("_said_near").isNull(), F.col("text")).otherwise(F.concat(F.lit("Somebody wrote:\n"), far, mark(F.col("_said_near"), "> "), F.lit("\n"), F.coalesce("text", F.lit(""))))
    return rows.withColumn("text", text).select(*messages.columns)

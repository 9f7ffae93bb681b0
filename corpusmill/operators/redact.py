"""Redaction of private data and removal of licence headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.config import RedactConfig
from corpusmill.functions.textfn import let

# Patterns (fixed values), in the order in which they apply.
PRIVATE_KEY = r"(?s)-----BEGIN (?:RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY-----.*?-----END (?:RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY-----"
SECRET = r"""(?i)\b(password|passwd|pwd|secret|api[_-]?key|access[_-]?token|auth[_-]?token|token)\b(\s*[:=]\s*)(?:(")[^"]+"|(')[^']+'|(["'])[^\s,;]*|[^\s,;]+)"""
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
IPV4 = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
IPV6 = r"\b(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4}\b"
MARKER = r"(?i)copyright|\(c\)|©|licen[sc]e|licensed under|SPDX-License-Identifier|all rights reserved|permission is hereby granted|redistribution and use"
LINE_COMMENTS = ("#", "//", "--", ";", "%")
BLOCK_COMMENTS = (("/*", "*/"), ("<!--", "-->"), ('"""', '"""'), ("'''", "'''"))


def redact_pii(docs: DataFrame, cfg: RedactConfig = RedactConfig()) -> DataFrame:
    """docs with redacted content and the counts email, ip, secret and private_key (longs)."""
    safe = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    steps = [("private_key", PRIVATE_KEY, safe(cfg.key)), ("secret", SECRET, f"$1$2$3$4$5{safe(cfg.password)}$3$4$5"), ("email", EMAIL, safe(cfg.email)), ("ip", IPV4, safe(cfg.ip)), ("_ip6", IPV6, safe(cfg.ip))]
    df = docs
    for name, pattern, new in steps:
        # Counted before it is replaced; what a step inserts is not counted by the next.
        df = df.withColumn(name, F.regexp_count("content", F.lit(pattern)).cast("long")).withColumn("content", F.regexp_replace("content", pattern, new))
    return df.withColumn("ip", F.col("ip") + F.col("_ip6")).drop("_ip6")


def strip_header(content: Column) -> Column:
    """The text without its leading comment block, if that bears a licence marker; a shebang line stays.

    Line comments are tried first, by prefix in fixed order; the first prefix that the first line has decides. Then
    block comments: an unclosed one gives way to the next style, a closed one without a marker leaves the text as it is.
    """
    lines = F.split(content, "\n", -1)
    lstrip = lambda c: F.regexp_replace(c, r"^[\s\x0B\x1C-\x1F\x85\p{Z}]+", "")
    blank = lambda c: lstrip(c) == ""

    def after(line_array: Column) -> Column:
        start = F.when(F.get(line_array, 0).startswith("#!"), 1).otherwise(0)
        body = F.slice(line_array, start + 1, F.size(line_array))
        skipped = F.coalesce(F.array_position(F.transform(body, lambda x: blank(x)), False), F.lit(0)).cast("int")
        found = F.when(skipped > 0, F.slice(body, F.greatest(skipped, F.lit(1)), F.size(line_array))).otherwise(F.array().cast("array<string>"))
        return let(found, lambda rest: decide(rest, start, line_array))

    def decide(rest: Column, start: Column, line_array: Column) -> Column:
        head = F.when(start == 1, F.concat(F.get(line_array, 0), F.lit("\n"))).otherwise("")
        result = F.lit(None).cast("string")
        for opening, closing in reversed(BLOCK_COMMENTS):
            result = block(rest, head, opening, closing, result)
        for prefix in reversed(LINE_COMMENTS):
            result = F.when(lstrip(F.get(rest, 0)).startswith(prefix), run(rest, head, prefix)).otherwise(result)
        return F.coalesce(F.when(F.size(rest) > 0, result), content)

    def run(rest: Column, head: Column, prefix: str) -> Column:
        end = F.array_position(F.transform(rest, lambda x: blank(x) | lstrip(x).startswith(prefix)), False).cast("int")
        return let(F.when(end > 0, end - 1).otherwise(F.size(rest)), lambda taken: cut_run(rest, head, taken))

    def cut_run(rest: Column, head: Column, taken: Column) -> Column:
        text = F.array_join(F.slice(rest, 1, taken), "\n")
        left = F.array_join(F.slice(rest, taken + 1, F.size(rest)), "\n")
        return F.when(text.rlike(MARKER), F.regexp_replace(F.concat(head, left), r"^\n+", "")).otherwise(F.lit(None).cast("string"))

    def block(rest: Column, head: Column, opening: str, closing: str, otherwise: Column) -> Column:
        text = F.array_join(rest, "\n")
        at = F.locate(closing, text, len(opening) + 1)
        opened = lstrip(F.get(rest, 0)).startswith(opening)
        inside = F.left(text, at + len(closing) - 1)
        left = F.substring(text, at + len(closing), F.length(text))
        cut = F.when(inside.rlike(MARKER), F.regexp_replace(F.concat(head, left), r"^\n+", "")).otherwise(content)
        return F.when(opened & (at > 0), cut).otherwise(otherwise)

    return let(lines, after)


def remove_headers(docs: DataFrame) -> DataFrame:
    """docs with stripped content and header_removed."""
    return docs.withColumn("_new", strip_header(F.col("content"))).withColumn("header_removed", F.col("_new") != F.col("content")).withColumn("content", F.col("_new")).drop("_new")


def transform_documents(docs: DataFrame, cfg: RedactConfig = RedactConfig()) -> DataFrame:
    df = redact_pii(docs, cfg) if cfg.enabled else docs
    return remove_headers(df) if cfg.headers else df

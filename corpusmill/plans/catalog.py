"""The registered queries of the library's operators; their DuckDB SQL is in oracles.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.config import LIGHT, AnnealingConfig, DownsampleConfig, NearDedupConfig, RedactConfig
from corpusmill.functions.textfn import code_blocks, estimate_tokens, strip
from corpusmill.operators import admit as adm
from corpusmill.operators import chat, decontam, evalkit, mixture, near_dedup, recall, redact, sampling, signals, synth, training
from corpusmill.operators.exact_dedup import exact_dedup as dedup
from corpusmill.plans.oracles import ORACLES
from corpusmill.plans.pipeline import PipelineConfig, run_pipeline
from corpusmill.sources import ingest, languages, tables

#: Words of the corpus that stand for entry points, keywords and hints, none of which it has of its own.
ENTRY_POINTS = ["stupid", "idiot", "achlichau"]
KEYWORDS = ("ation", "keit", "eux", "ción")
HINT = "(?i)tion|ing"
BUDGET, SEQ_LEN = 200_000, 2048
#: Few permutations, so that SQL can follow; LIGHT is the production setting.
SMALL = NearDedupConfig(num_perm=16, bands=8, rows=2)
SIXTEENTHS = {"src0": 8, "src1": 4, "src2": 2, "src3": 2}
QUOTAS = ({"src0": 20, "src1": 5, "none": 7}, {"src2": 11, "src3": 1_000_000})


def _admitted(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return adm.admit(tables.documents(spark, sf_dir, **options))


def admit_documents(spark, sf_dir):
    return _admitted(spark, sf_dir).select("doc_id", "path", "language", "category", F.octet_length("content").cast("long").alias("n_bytes"))


def language_category_counts(spark, sf_dir):
    return _admitted(spark, sf_dir).groupBy("language", "category").agg(F.count(F.lit(1)).alias("n"))


def exact_dedup(spark, sf_dir):
    return dedup(tables.documents(spark, sf_dir)).select("doc_id", "stars", "commit_time")


def quality_signals(spark, sf_dir):
    return signals.compute_signals(_admitted(spark, sf_dir)).select("doc_id", *(c for c in signals.SIGNALS if c != "python_ast_parseable"))


def _annotated(spark, sf_dir, **options):
    return signals.annotate(_admitted(spark, sf_dir, **options))


def rule_annotate(spark, sf_dir):
    return _annotated(spark, sf_dir, suffix="txt").select("doc_id", F.array_join("filtered_by", ",").alias("filtered_by"))


def rule_hits(spark, sf_dir):
    return signals.rule_hits(_annotated(spark, sf_dir, suffix="txt"))


def filtered_docs(spark, sf_dir):
    return signals.keep_unfired(_annotated(spark, sf_dir, suffix="txt")).select("doc_id")


def code_rules(spark, sf_dir):
    """With Python's parser, so that rows are all that SQL could check."""
    return _annotated(spark, sf_dir).select("doc_id", "language", "python_ast_parseable", F.array_join("filtered_by", ",").alias("filtered_by"))


def pii_redact(spark, sf_dir):
    return redact.redact_pii(tables.documents(spark, sf_dir)).select("doc_id", F.md5("content").alias("content_md5"), "email", "ip", "secret", "private_key")


def header_strip(spark, sf_dir):
    return redact.remove_headers(tables.documents(spark, sf_dir, header=True)).select("doc_id", "header_removed", F.md5("content").alias("content_md5"))


def transform_documents(spark, sf_dir):
    return redact.transform_documents(tables.documents(spark, sf_dir, header=True), RedactConfig()).select("doc_id", "header_removed", "email", F.length("content").cast("long").alias("n_chars"))


def minhash_signature(spark, sf_dir):
    return near_dedup.signatures(tables.documents(spark, sf_dir), SMALL).select("ord", F.array_join("signature", ",").alias("signature"))


def lsh_buckets(spark, sf_dir):
    signed = near_dedup.signatures(tables.documents(spark, sf_dir), SMALL)
    return near_dedup.buckets(signed, SMALL).groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("least")).filter("n > 1")


def near_dup_components(spark, sf_dir):
    return near_dedup.clusters(tables.documents(spark, sf_dir), SMALL)


def near_dedup_small(spark, sf_dir):
    return near_dedup.near_dedup(tables.documents(spark, sf_dir), SMALL).select("doc_id", "stars")


def near_dedup_light(spark, sf_dir):
    return near_dedup.near_dedup(tables.documents(spark, sf_dir), LIGHT).select("doc_id", "stars")


def near_dedup_full(spark, sf_dir):
    """2048 permutations in 16 bands of 128 rows, too slow for SQL."""
    return near_dedup.near_dedup(tables.documents(spark, sf_dir), NearDedupConfig()).select("doc_id", "stars")


def downsample_languages(spark, sf_dir):
    return sampling.downsample(_admitted(spark, sf_dir), DownsampleConfig()).select("doc_id", "language")


def pipeline_stage_counts(spark, sf_dir):
    """Text documents and no near deduplication, so that SQL can follow every stage."""
    return run_pipeline(tables.documents(spark, sf_dir, suffix="txt"), PipelineConfig(near=None, redact=RedactConfig(enabled=False, headers=False))).stage_counts


def cleaned_documents(spark, sf_dir):
    return run_pipeline(tables.documents(spark, sf_dir)).documents.select("doc_id", "language", "stars")


def flagship(spark, sf_dir):
    return run_pipeline(tables.documents(spark, sf_dir, suffix="txt")).stage_counts


def nb_weights(spark, sf_dir):
    w = recall.train(tables.seeds(spark, sf_dir))
    return w.select("token", F.round("weight", 6).alias("weight"), F.round("bias", 6).alias("bias"))


def web_recall(spark, sf_dir):
    pages = tables.web_pages(spark, sf_dir)
    return recall.recall(pages, recall.train(tables.seeds(spark, sf_dir))).select("doc_id", "path", F.round("code_prob", 3).alias("code_prob"))


def _judged(spark, sf_dir):
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.decontaminate(docs, tables.read(spark, sf_dir, "benchmark"), ENTRY_POINTS, id="doc_id")


def banned_ngrams(spark, sf_dir):
    return decontam.banned_ngrams(tables.read(spark, sf_dir, "benchmark"))


def decontaminate(spark, sf_dir):
    return _judged(spark, sf_dir).select("doc_id", "reason")


def decontam_report(spark, sf_dir):
    return decontam.report(_judged(spark, sf_dir))


def algorithmic_sample(spark, sf_dir):
    found = mixture.sample_algorithmic(tables.documents(spark, sf_dir), AnnealingConfig(keywords=KEYWORDS, min_keyword_hits=2))
    return found.select("doc_id", "source", "keyword_hits")


def _mixed(spark, sf_dir):
    return mixture.mixture(tables.documents(spark, sf_dir), BUDGET, AnnealingConfig(shares=SIXTEENTHS))


def budget_mixture(spark, sf_dir):
    return _mixed(spark, sf_dir).select("doc_id", "source", "tokens")


def mixture_report(spark, sf_dir):
    r = mixture.mixture_report(_mixed(spark, sf_dir), BUDGET, AnnealingConfig(shares=SIXTEENTHS))
    return r.select("source", "docs", "tokens", "target_share", F.round("actual_share", 9).alias("actual_share"))


def _composed(spark, sf_dir):
    return mixture.compose_two_stage(tables.read(spark, sf_dir, "documents").select("doc_id", "source"), *QUOTAS, id="doc_id")


def compose_quota(spark, sf_dir):
    return _composed(spark, sf_dir).select("doc_id", "source", "stage")


def compose_report(spark, sf_dir):
    return mixture.compose_report(_composed(spark, sf_dir), *QUOTAS)


def _pairs(spark, sf_dir):
    return chat.dialogue_pairs(tables.read(spark, sf_dir, "conversations"))


def dialogue_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


def realuser_filter(spark, sf_dir):
    """Short answers of every second conversation have a replacement."""
    pairs = _pairs(spark, sf_dir)
    new = pairs.filter("conv_id % 2 = 0").select(strip(F.col("instruction")).alias("instruction"), F.lit("Try:\n```python\ndef f(): pass\n```\n").alias("response"))
    odd = chat.build_realuser(pairs.filter("conv_id % 2 = 1"), hint=HINT)
    made = odd.unionByName(chat.build_realuser(pairs.filter("conv_id % 2 = 0"), new, hint=HINT))
    return made.select("conv_id", "turn", "response", "regenerated", "source", "language")


def chat_format(spark, sf_dir):
    return chat.format_dataset(_pairs(spark, sf_dir)).select("conv_id", "turn", "text", "tokens")


def token_estimate(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents").select("doc_id", estimate_tokens(F.col("text")).alias("tokens"))


def pack_segments(spark, sf_dir):
    return training.pack_segments(tables.documents(spark, sf_dir), SEQ_LEN)


def pack_blocks(spark, sf_dir):
    blocks = training.pack_blocks(tables.documents(spark, sf_dir), SEQ_LEN)
    return blocks.select("block", F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"), F.size("ids").cast("long").alias("n"))


def sft_mask(spark, sf_dir):
    made = training.sft_examples(_pairs(spark, sf_dir), 256)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return made.select("conv_id", "turn", F.size("ids").cast("long").alias("n"), total("ids").alias("id_sum"), total("mask").alias("n_response"))


def _ingested(spark, sf_dir):
    return ingest.ingest_status(*tables.metadata(spark, sf_dir))


def ingest_gates(spark, sf_dir):
    return ingest.counters(_ingested(spark, sf_dir))


def ingest_limited(spark, sf_dir):
    """Twenty documents of each source, in the order of ids, which stand in their paths."""
    judged = _ingested(spark, sf_dir).withColumn("ord", F.regexp_extract("path", r"(\d+)\.py$", 1).cast("long"))
    return ingest.stats(ingest.limited(judged, 20, "ord", "repo_name"))


def educational_examples(spark, sf_dir):
    """Seeds that parse, with a scripted teacher; code is not run."""
    docs = tables.read(spark, sf_dir, "documents")
    seeds = docs.select(F.col("doc_id").alias("ord"), F.format_string("def f%d(x):\n    # %s\n    return x\n", "doc_id", F.md5("text")).alias("content"))
    answers = seeds.select(synth.answer_prompt(F.col("content"), F.lit("Python")).alias("p")).withColumn("a", synth.scripted_answer(F.col("p")))
    tests = seeds.withColumn("p", synth.answer_prompt(F.col("content"), F.lit("Python"))).withColumn("s", F.get(code_blocks(synth.scripted_answer(F.col("p"))), 0))
    tests = tests.select(synth.tests_prompt(F.col("content"), F.col("s"), F.lit("Python")).alias("p")).withColumn("a", synth.scripted_answer(F.col("p")))
    teacher = answers.unionByName(tests).select(synth.prompt_key(F.col("p")).alias("prompt_key"), F.col("a").alias("response"))
    return synth.educational(seeds, teacher, None).select("ord", "instruction", "seed_quality")


def ingest_documents(spark, sf_dir):
    docs = ingest.to_documents(_ingested(spark, sf_dir), F.lit("Python"))
    return docs.select("doc_id", "path", "repo_name", "stars", "commit_time", "category")


def _counts(spark, sf_dir):
    pages = tables.read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("task_id"), (F.col("page_id") % 7 + 3).alias("n"))
    return pages.withColumn("c", F.pmod(F.col("task_id").cast("long") * 5, F.col("n") + 1))


def pass_at_k(spark, sf_dir):
    each = _counts(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(5))))
    return each.select("task_id", "k", F.round(evalkit.pass_at_k(F.col("n"), F.col("c"), F.col("k").cast("long")), 9).alias("p"))


def pass_at_k_mean(spark, sf_dir):
    r = evalkit.aggregate_pass_at_k(_counts(spark, sf_dir), (1, 2, 5))
    return r.select("k", F.round("pass_at_k", 9).alias("pass_at_k"), "n_problems", "n_solved")


def _fenced():
    return F.concat(F.lit("Say:\n```python\n"), F.col("text"), F.lit("\n```\nand\n```\n"), F.col("lang"), F.lit("\n```"))


def extract_code_blocks(spark, sf_dir):
    docs = tables.read(spark, sf_dir, "documents").withColumn("b", code_blocks(F.when(F.col("doc_id") % 2 == 0, _fenced()).otherwise(F.col("text"))))
    return docs.select("doc_id", F.size("b").cast("long").alias("n"), F.md5(F.get("b", 0)).alias("first_md5"), F.md5(F.element_at("b", -1)).alias("last_md5"))


def completion_truncate(spark, sf_dir):
    text = F.concat(F.col("source"), F.col("text"), F.when(F.col("doc_id") % 3 == 0, F.lit("\nprint(1)\nclass A")).otherwise(F.lit("")))
    return tables.read(spark, sf_dir, "documents").select("doc_id", F.md5(evalkit.completion(F.col("source"), text)).alias("text_md5"))


def build_programs(spark, sf_dir):
    docs = tables.read(spark, sf_dir, "documents")
    program = evalkit.completion_program(F.col("source"), F.col("lang"), F.lit("def check(f): pass"), F.col("text"))
    other = evalkit.function_program(F.when(F.col("doc_id") % 2 == 0, "import math").otherwise(""), F.array(F.lit("assert a"), F.lit("assert b")), F.col("text"))
    return docs.select("doc_id", F.md5(program).alias("completion_md5"), F.md5(other).alias("function_md5"))


def clean_seeds(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents").select("doc_id", F.md5(synth.clean_seed(F.col("text"))).alias("text_md5"))


def seed_scores(spark, sf_dir):
    return tables.documents(spark, sf_dir).select("doc_id", synth.seed_score("content").alias("score"))


def teacher_misses(spark, sf_dir):
    """Half of the prompts are answered already."""
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    prompt = synth.educational_prompt(F.col("text"))
    known = docs.filter("doc_id % 2 = 0").select(synth.prompt_key(prompt).alias("prompt_key"), F.lit("x").alias("response"))
    return synth.missing(docs, prompt, known).select(F.length("prompt").cast("long").alias("n_chars"), F.md5("prompt").alias("prompt_md5"))


def textbook_passages(spark, sf_dir):
    """Each second document has a passage."""
    docs = tables.documents(spark, sf_dir).select("ord", "content")
    answers = docs.filter("ord % 2 = 0").select(synth.prompt_key(synth.educational_prompt(F.col("content"))).alias("prompt_key"), F.concat(F.lit(" About "), F.md5("content")).alias("response"))
    return synth.textbooks(docs, answers).select("path", "content", "source", "from_snippet_chars")


_NOT_QUERIES = {"flagship"}


def queries() -> dict:
    return {k: v for k, v in globals().items() if callable(v) and not k.startswith("_") and getattr(v, "__module__", "") == __name__ and k not in (*_NOT_QUERIES, "queries", "oracle_sql")}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

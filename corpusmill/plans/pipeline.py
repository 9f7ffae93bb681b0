"""The cleaning pipeline: admit, exact and near deduplication, redaction, rules, down-sampling."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.config import LIGHT, AdmitConfig, DownsampleConfig, ExactDedupConfig, NearDedupConfig, RedactConfig
from corpusmill.operators.admit import admit
from corpusmill.operators.exact_dedup import exact_dedup
from corpusmill.operators.near_dedup import near_dedup
from corpusmill.operators.redact import transform_documents
from corpusmill.operators.sampling import downsample
from corpusmill.operators.signals import FilterConfig, annotate, keep_unfired, rule_hits
from corpusmill.sources.scratch import written


@dataclass(frozen=True)
class PipelineConfig:
    admit: AdmitConfig = field(default_factory=AdmitConfig)
    exact: ExactDedupConfig = field(default_factory=ExactDedupConfig)
    near: NearDedupConfig | None = LIGHT
    redact: RedactConfig = field(default_factory=RedactConfig)
    rules: FilterConfig = field(default_factory=FilterConfig)
    downsample: DownsampleConfig = field(default_factory=DownsampleConfig)


@dataclass
class PipelineResult:
    documents: DataFrame
    stage_counts: DataFrame
    rule_hits: DataFrame

    def summary(self) -> list[str]:
        """One line a stage, in order, then one a rule, the most frequent first: rows are as few as stages and rules."""
        stages = [f"{r.stage}: {r.n}" for r in self.stage_counts.orderBy("stage").collect()]
        return stages + [f"{r.rule}: {r.n}" for r in self.rule_hits.orderBy(F.desc("n"), "rule").collect()]


def run_pipeline(docs: DataFrame, cfg: PipelineConfig = PipelineConfig()) -> PipelineResult:
    """docs (content, path, stars, commit_time, source, doc_id, ord) through all stages, with rows after each and hits of each rule.

    Three tables are written: the admitted documents, those left after deduplication, and the annotated ones; every count reads
    one of them.
    """
    admitted = written(admit(docs, cfg.admit))
    exact = exact_dedup(admitted, cfg.exact)
    near = near_dedup(exact, cfg.near) if cfg.near else exact
    near = written(near)
    annotated = written(annotate(transform_documents(near, cfg.redact), cfg.rules))
    kept = keep_unfired(annotated)
    final = downsample(kept, cfg.downsample)
    stages = (("0_input", docs), ("1_preprocess", admitted), ("2_exact_dedup", exact), ("3_fuzzy_dedup", near), ("4_transform", annotated), ("5_filter", kept), ("6_downsample", final))
    counts = None
    for name, df in stages:
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n")
        counts = row if counts is None else counts.unionByName(row)
    return PipelineResult(final, counts, rule_hits(annotated))

"""Down-sampling of over-represented languages, by a keyed hash: the same rows in any partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.config import DownsampleConfig
from corpusmill.functions.textfn import u01


def downsample(docs: DataFrame, cfg: DownsampleConfig = DownsampleConfig()) -> DataFrame:
    """Documents of a listed language stay with its fraction; all others stay."""
    keep = F.lit(1.0)
    for language, fraction in cfg.keep.items():
        keep = F.when(F.col("language") == language, F.lit(fraction)).otherwise(keep)
    return docs.filter(u01(F.col("doc_id"), cfg.seed) < keep)

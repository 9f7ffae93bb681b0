"""Running sums that never bring a whole group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.sources.scratch import written


def running_total(df: DataFrame, value: str, order: str | tuple[str, ...], by: str | None = None, into: str = "before") -> DataFrame:
    """(by, order, value, into): `into` is the sum of `value` over the rows before each one by `order` (unique), within `by` if given.

    Rows are sorted by ranges that Spark samples, so neither a clustered order nor a group of most rows fills one task; the sum before a row
    is that of the ranges before (a small table, a row a range and group) and that inside its own range. Only the columns named are
    moved: join them to wider rows by `order`. Nulls in `value` count as 0; nulls in `order` come first. An empty table stays empty.
    """
    order, groups = ((order,) if isinstance(order, str) else tuple(order)), ([by] if by else [])
    rows = df.select(*groups, *order, F.coalesce(F.col(value), F.lit(0)).alias(value)).orderBy(*groups, *order)
    rows = written(rows.withColumn("_range", F.spark_partition_id()))
    sums = rows.groupBy(*groups, "_range").agg(F.sum(value).alias("_sum"))
    ahead = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    sums = sums.select(*(F.col(g).alias(f"_{g}") for g in groups), F.col("_range").alias("_of"), F.coalesce(F.sum("_sum").over(ahead.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    same = F.col("_range") == F.col("_of")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"_{g}"))
    inside = F.coalesce(F.sum(value).over(W.partitionBy(*groups, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sums, same).withColumn(into, F.col("_base") + inside).select(*groups, *order, value, into)

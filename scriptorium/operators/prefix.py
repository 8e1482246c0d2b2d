"""Running sums over ordered groups that don't need a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_sum(rows: DataFrame, by: list[str], bucket: Column, order: list, value: Column, name: str, total: str | None = None) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the group up to and with each row, and (``total``) over all.

    ``bucket`` must rise with the order. Sums are taken in each (group, bucket) apart and shifted by those of
    the buckets before, so a group that holds most of the rows is spread over its buckets."""
    rows = rows.withColumn("_b", bucket).withColumn("_v", value)
    parts = rows.groupBy(*by, "_b").agg(F.sum("_v").alias("_s"))
    whole = W.partitionBy(*by)
    parts = parts.withColumn("_before", F.sum("_s").over(whole.orderBy("_b")) - F.col("_s")).withColumn("_total", F.sum("_s").over(whole))
    keys = [*by, "_b"]
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]
    joined = rows.alias("r").join(parts.alias("p"), same).select("r.*", "p._before", "p._total")
    own = F.sum("_v").over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    out = joined.withColumn(name, own + F.col("_before"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_b", "_v", "_before", "_total")

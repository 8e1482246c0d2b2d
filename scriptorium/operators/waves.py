"""Judging until enough has passed: waves of calls, each as large as the records still wanted need.

A wave takes the next records of every group that isn't full, as many as the pass rate so far makes necessary, and is
written with its answers before the next one is sized. A run that is cut off goes on behind the last whole wave and asks
nothing twice.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from . import curate
from .prefix import running_sum

Judge = Callable[[DataFrame], DataFrame]


def wave_size(wanted: int, checked: int, passed: int, left: int) -> int:
    """How many of the ``left`` records a group sends next: those that it needs at the rate of the ``checked`` ones; as
    many again as so far, if none passed; at first what it wants at least."""
    if wanted <= passed or not left:
        return 0
    need = wanted - passed
    size = need if not checked else math.ceil(need * checked / passed) if passed else 2 * max(need, checked)
    return min(size, left)


def _whole(spark: SparkSession, path: str) -> bool:
    return files.exists(spark, f"{path}/_SUCCESS")


def judged(records: DataFrame, wanted: Column, judge: Judge, folder: str, known: Column | None = None, by: str = "scene", order: str = "ord", width: int = 65_536) -> DataFrame:
    """The records that were looked at, with response and qc_reason (null: passed), in the order of each group
    until ``wanted`` have passed or none is left.

    ``judge`` gets records and adds response (null: the call failed); ``known`` is a reason to turn a record down
    without a call. Answers are read by ``curate.verdict``. ``folder`` is the log, in a file system that driver and
    executors share: the numbered records and a table for each wave. Records without a group are left out; the driver
    gets a row for each group and wave."""
    spark, place = records.sparkSession, f"{folder}/records"
    if not _whole(spark, place):
        bucket = F.floor(F.col(order) / width)
        rows = records.where(F.col(by).isNotNull()).withColumn("_known", known if known is not None else F.lit(None).cast("string")).withColumn("_wanted", wanted.cast("long"))
        rows = running_sum(rows, [by], bucket, [order], F.lit(1), "_place")
        # in this order a wave reads little else than its own rows
        rows.sortWithinPartitions(by, "_place").write.mode("overwrite").parquet(place)
    rows = spark.read.parquet(place)
    groups = {r[by]: (r.wanted, r.n) for r in rows.groupBy(by).agg(F.max("_wanted").alias("wanted"), F.count(F.lit(1)).alias("n")).collect()}
    done = dict.fromkeys(groups, (0, 0))
    kind, schema, names = rows.schema[by].dataType.simpleString(), None, []
    while True:
        path = f"{folder}/wave-{len(names):05d}"
        if not _whole(spark, path):
            ask = [(g, done[g][0], done[g][0] + n) for g, (want, all_) in sorted(groups.items()) if (n := wave_size(want, *done[g], all_ - done[g][0]))]
            if not ask:
                break
            plan = spark.createDataFrame(ask, f"{by} {kind}, _from long, _to long")
            near = F.col("_place").between(min(a for _, a, _ in ask) + 1, max(b for _, _, b in ask))  # reaches the scan
            part = rows.where(near & F.col(by).isin([g for g, _, _ in ask])).join(F.broadcast(plan), by).where("_place > _from AND _place <= _to").drop("_from", "_to")
            asked = judge(part.where("_known IS NULL"))
            free = part.where("_known IS NOT NULL").withColumn("response", F.lit(None).cast("string"))
            both = asked.select(*part.columns, "response").unionByName(free)
            said = curate.verdict(F.col("response"))
            why = F.coalesce("_known", F.when(F.col("response").isNull(), "QC call failed"), F.when(~said["passed"], said["reason"]))
            both.withColumn("qc_reason", why).write.mode("overwrite").parquet(path)
        names.append(path)
        wave = spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
        schema = wave.schema
        for r in wave.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("qc_reason").isNull()).alias("passed")).collect():
            done[r[by]] = (done[r[by]][0] + r.n, done[r[by]][1] + r.passed)
    found = spark.read.schema(schema).parquet(*names) if names else rows.limit(0).withColumn("response", F.lit(None).cast("string")).withColumn("qc_reason", F.lit(None).cast("string"))
    return found.select(*records.columns, "response", "qc_reason")

"""Sources and sinks: JSON lines, rubric documents, partitioned folders, caches and sinks."""

from __future__ import annotations

import json
import uuid
import warnings
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def children(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder, sorted; none if it is missing. Any Hadoop file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in system.listStatus(p)) if system.exists(p) else []


def shared_system(path: str):
    """(file system, path in it) of a qualified path, for use in tasks."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if path.startswith("file:") else fs.FileSystem.from_uri(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, a missing file has no rows, a malformed line fails."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def check_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows, violations): the rows of lines that hold an object, and (file, line, value) of those that don't; line counts
    from 1. Lines end as in ``spark.read.text``; blank ones count but are skipped.

    Files are read in the ranges that Spark deals to its tasks. Only violations get a number: their place in their range,
    and behind the lines of the ranges before, which a first pass has counted (a row for each range)."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("at"), "value")
    full = lines.where(F.trim(F.regexp_replace("value", "\\s", "")) != "")
    text = schema if isinstance(schema, str) else schema.simpleString()[7:-1].replace(":", " ")
    parsed = full.select("file", "range", "at", "value", F.from_json("value", text).alias("r"), F.try_parse_json("value").isNull().alias("bad"))
    wrong = F.col("bad") | ~F.startswith(F.ltrim("value"), F.lit("{"))
    ranges = lines.groupBy("file", "range").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("range")) - F.col("n")
    ranges = ranges.select("file", "range", "first", before.alias("before"))
    faults = parsed.where(wrong).join(ranges, ["file", "range"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")
    return parsed.where(~wrong).select("r.*"), faults


def read_rubric(spark: SparkSession, path: str, item: str) -> DataFrame:
    """The items of one JSON document, each of the given schema."""
    doc = spark.read.schema(f"items array<struct<{item}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return doc.select(F.explode(F.when(F.assert_true(F.col("items").isNotNull(), F.lit("no items array")).isNull(), F.col("items"))).alias("i")).select("i.*")


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_array(df: DataFrame, path: str) -> None:
    """One JSON array, in one text file, in the rows' order. Rows are made and written by one task, which holds a row at
    a time; for exports that a trainer reads whole, otherwise ``write_jsonl``."""
    spark = df.sparkSession
    lines = df.select(F.to_json(F.struct(*df.columns)).alias("value")).coalesce(1)

    def run(batches):
        held = None  # the last row so far, which gets a comma only if another follows
        for b in batches:
            out = []
            for x in b.column("value").to_pylist():
                if held is not None:
                    out.append(held + ",")
                held = x if held is not None else "[" + x
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array([(held or "[") + "]"])], names=["value"])

    hadoop = spark._jvm.org.apache.hadoop.fs
    target, folder = hadoop.Path(path), hadoop.Path(path + ".parts")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    lines.mapInArrow(run, "value string").write.mode("overwrite").text(folder.toString())
    part = next(s.getPath() for s in system.listStatus(folder) if s.getPath().getName().startswith("part-"))
    _replace(spark, part, target)
    system.delete(folder, True)


def _replace(spark: SparkSession, source, target) -> None:
    """Rename over what is there, in one step of the file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(source), context.makeQualified(target), options)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Give a file another name, in a folder that is made if it is missing; what is there goes, in one step."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    to = hadoop.Path(target)
    to.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(to.getParent())
    _replace(spark, hadoop.Path(source), to)


def read_scenes(spark: SparkSession, folder: str, schema: str, pattern: str = "*.jsonl") -> DataFrame:
    """All files of a folder, with scene, the file's stem."""
    if not children(spark, folder):
        return spark.createDataFrame([], f"{schema}, scene string")
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{folder}/{pattern}")
    return rows.withColumn("scene", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1))


def scenes_with(spark: SparkSession, folder: str, stage: str) -> list[str]:
    """Scene folders that hold a stage's file."""
    return [s for s in children(spark, folder) if stage in children(spark, f"{folder}/{s}")]


def preferred(spark: SparkSession, folder: str, wanted: str = "auto") -> str | None:
    """asr_sim.jsonl before clean.jsonl, or the one asked for, if it is there."""
    names = {"asr": ["asr_sim.jsonl"], "clean": ["clean.jsonl"]}.get(wanted, ["asr_sim.jsonl", "clean.jsonl"])
    return next((f"{folder}/{n}" for n in names if exists(spark, f"{folder}/{n}")), None)


def read_many(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Rows of all files that exist, with a warning for each that doesn't; an error if none does."""
    found = [p for p in paths if exists(spark, p)]
    for p in paths:
        if p not in found:
            warnings.warn(f"{p} is missing and skipped", stacklevel=2)
    if not found:
        raise FileNotFoundError(f"none of {paths}")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(found)


def write_split(df: DataFrame, flag: Column, kept: str, rejected: str) -> None:
    """Two outputs of rows evaluated once: those with the flag, and the rest if there are any."""
    held = df.withColumn("_kept", F.coalesce(flag, F.lit(False))).persist()
    try:
        write_jsonl(held.where("_kept").drop("_kept"), kept)
        if not (rest := held.where("NOT _kept").drop("_kept")).isEmpty():
            write_jsonl(rest, rejected)
    finally:
        held.unpersist()


def with_order(df: DataFrame) -> DataFrame:
    """Adds ord, the place of each row by file and position. Assign it once, and write it."""
    return df.withColumn("ord", F.monotonically_increasing_id())


def content_key(*fields: Column) -> Column:
    """The cache key of a record: SHA-256 of its fields, a line each; missing ones are empty."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(c.cast("string"), F.lit("")) for c in fields]), 256)


def cached(rows: DataFrame, cache: DataFrame, fields: list[str], compute: Callable[[DataFrame], DataFrame], path: str) -> tuple[DataFrame, DataFrame]:
    """(rows with value, new cache rows): values by content key, computed only for keys that the cache (key, value)
    lacks. ``compute`` gets one row (key and fields) a key and returns key and value; what it returns is written to
    ``path`` first, a shared folder, so it is called once, however often the rows are read."""
    keyed = rows.withColumn("key", content_key(*map(F.col, fields)))
    new = compute(keyed.select("key", *fields).dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")).select("key", "value")
    new.write.mode("overwrite").parquet(path)
    new = rows.sparkSession.read.schema(new.schema).parquet(path)
    return keyed.join(cache.select("key", "value").unionByName(new), "key", "left"), new


def read_json(spark: SparkSession, path: str):
    """The value of one small document; None if it is missing."""
    return json.loads(spark.read.text(path, wholetext=True).first().value) if exists(spark, path) else None


def write_json(spark: SparkSession, value, path: str) -> None:
    """A small document, replaced at once: whoever reads meanwhile gets the old or the new one."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, temp = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(temp, True)
    out.write(bytearray((json.dumps(value, ensure_ascii=False, indent=2) + "\n").encode()))
    out.close()
    _replace(spark, temp, target)

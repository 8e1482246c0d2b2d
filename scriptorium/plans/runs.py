"""Queries of sources, sinks, streams and model plug-ins: they write files of the tables' rows and read them again."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import curate, models
from ..sources import admin, audio, files
from ..streaming import live, speech
from .catalog import place, query, table
from .records import _MARKS
from .registry import _STRIP


@query("SELECT doc_id, text, lang AS scene FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, '+' || text, lang FROM documents WHERE doc_id % 2 = 1")
def scene_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as a file for each scene, in two ways, appended to, and read by scene."""
    at, docs = place(spark, "scenes"), table(spark, sf_dir, "documents")
    files.write_jsonl(docs.where("doc_id % 2 = 0").select("doc_id", "text", "lang"), f"{at}/all")
    files.write_jsonl(docs.where("doc_id % 2 = 1").select("doc_id", F.concat(F.lit("+"), "text").alias("text"), "lang"), f"{at}/all", append=True)
    rows = files.read_jsonl(spark, f"{at}/all", "doc_id long, text string, lang string")
    rows.write.partitionBy("lang").json(f"{at}/by")
    parts = [files.read_jsonl(spark, f"{at}/by/{name}", "doc_id long, text string").withColumn("scene", F.lit(name.partition("=")[2])) for name in files.children(spark, f"{at}/by") if "=" in name]
    out = files.read_jsonl(spark, f"{at}/missing.jsonl", "doc_id long, text string, scene string")
    for part in parts:
        out = out.unionByName(part)
    return out


@query("""SELECT 'good' AS kind, doc_id AS number FROM documents WHERE doc_id % 10 <> 3 UNION ALL SELECT 'bad', 2 * row_number() OVER (ORDER BY doc_id) FROM documents WHERE doc_id % 10 = 3""")
def strict_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a file: objects, and, on every second line of another, what is no object, with its number."""
    at, docs = place(spark, "lines"), table(spark, sf_dir, "documents")
    docs.where("doc_id % 10 <> 3").select(F.to_json(F.struct("doc_id")).alias("value")).write.text(f"{at}/good")
    docs.where("doc_id % 10 = 3").repartition(1).select(F.concat(F.lit("\n"), F.lit("[1]")).alias("value")).write.text(f"{at}/bad")
    good, none = files.check_jsonl(spark, f"{at}/good", "doc_id long")
    empty, bad = files.check_jsonl(spark, f"{at}/bad", "doc_id long")
    rows = good.unionByName(empty).select(F.lit("good").alias("kind"), F.col("doc_id").alias("number"))
    return rows.unionByName(bad.unionByName(none).select(F.lit("bad").alias("kind"), F.col("line").cast("long").alias("number")))


@query("SELECT item_id, text, item_id % 3 AS score FROM benchmark")
def rubric_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rubric of one JSON document, written as an array and wrapped."""
    at = place(spark, "rubric")
    rows = table(spark, sf_dir, "benchmark").select("item_id", "text", F.array(F.struct((F.col("item_id") % 3).alias("score"))).alias("qa"))
    files.write_array(rows, f"{at}/items.json")
    files.write_json(spark, {"items": files.read_json(spark, f"{at}/items.json")}, f"{at}/rubric.json")
    files.write_json(spark, files.read_json(spark, f"{at}/rubric.json"), f"{at}/rubric.json")  # replaced at once
    found = files.read_rubric(spark, f"{at}/rubric.json", "item_id: bigint, text: string, qa: array<struct<score: bigint>>")
    return found.select("item_id", "text", F.element_at("qa", 1)["score"].alias("score"))


@query("SELECT doc_id, quality = 1 AS kept FROM labels")
def split_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, labels = place(spark, "split"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    files.write_split(labels, F.col("quality") == 1, f"{at}/kept", f"{at}/rejects")
    parts = [files.read_many(spark, [f"{at}/{n}", f"{at}/nowhere"], "doc_id long, quality int").withColumn("kept", F.lit(n == "kept")) for n in ("kept", "rejects") if files.exists(spark, f"{at}/{n}")]
    return parts[0].unionByName(parts[-1]).select("doc_id", "kept").distinct()


@query("SELECT event_id, event_type FROM events")
def repeated_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches, one of them sent twice."""
    at, rows = place(spark, "appends"), table(spark, sf_dir, "events").select("event_id", "event_type")
    for k in (0, 1, 1, 2):
        admin.append_batch(rows.where(F.col("event_id") % 3 == k), at, k)
    return spark.read.schema("event_id long, event_type string, batch int").json(at).select("event_id", "event_type")


@query("SELECT doc_id, 'clean.jsonl' AS name FROM documents UNION ALL SELECT doc_id, 'seeds' FROM documents WHERE doc_id % 3 = 0")
def reset_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of what a reset leaves of a run's folder: clean records and seeds, not simulated and final ones."""
    at, docs = place(spark, "run"), table(spark, sf_dir, "documents").select("doc_id")
    for name in ("clean.jsonl", "asr_sim.jsonl", "final/train.jsonl"):
        files.write_jsonl(docs, f"{at}/{name}")
    files.write_jsonl(docs.where("doc_id % 3 = 0"), f"{at}/seeds/pool.jsonl")
    if len(admin.reset(spark, at, dry_run=True)) != 2 or len(files.children(spark, at)) != 4:
        raise AssertionError("a dry run deletes nothing")
    admin.reset(spark, at)
    left = {"clean.jsonl": "clean.jsonl", "seeds": "seeds/pool.jsonl", "asr_sim.jsonl": "asr_sim.jsonl", "final": "final/train.jsonl"}
    out = spark.createDataFrame([], "doc_id long, name string")
    for name in files.children(spark, at):
        out = out.unionByName(files.read_jsonl(spark, f"{at}/{left[name]}", "doc_id long").withColumn("name", F.lit(name)))
    return out


def _wave(seconds: list[float], rate: int) -> bytes:
    data = b"".join(struct.pack("<h", round(32767 * x)) for x in seconds)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", len(data))
    return head + data


@query("""WITH v AS (SELECT vec_id, len(embedding) AS n FROM embeddings) SELECT vec_id, ceil(n * 16000 / 8000 / 512.0)::BIGINT + 31 AS windows FROM v""")
def wave_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as waves of 8 kHz, written, read and cut to windows of 16 kHz."""
    at = place(spark, "waves")

    def run(batches):
        system, base = files.shared_system(at)
        system.create_dir(base)
        for b in batches:
            for k, x in zip(b.column("vec_id").to_pylist(), b.column("embedding").to_pylist()):
                with system.open_output_stream(f"{base}/{k}.wav") as f:
                    f.write(_wave([max(-1.0, min(1.0, v)) for v in x], 8000))
            yield pa.RecordBatch.from_arrays([b.column("vec_id")], names=["vec_id"])

    table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(run, "vec_id long").count()
    name = F.regexp_extract("session", r"(\d+)\.wav$", 1).cast("long")
    return audio.read_wav(spark, at).groupBy(name.alias("vec_id")).agg(F.count(F.lit(1)).alias("windows"))


# --- streams ---

_SPEECH = """w AS (SELECT user_id, event_id, value > 10 AS loud, row_number() OVER o - 1 AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id)),
f AS (SELECT *, coalesce(lag(loud) OVER (PARTITION BY user_id ORDER BY event_id), false) AS was FROM w),
g AS (SELECT *, sum((loud AND NOT was)::INT) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS segment FROM f)"""


@query(f"""WITH {_SPEECH}
SELECT user_id, event_id, segment::BIGINT AS segment, 'open' AS action, greatest(0, place - 22) AS first, place - 1 AS last FROM g WHERE loud AND NOT was UNION ALL
SELECT user_id, event_id, segment, 'feed', place, place FROM g WHERE loud OR was UNION ALL
SELECT user_id, event_id, segment, 'flush', place + 1, place + 31 FROM g WHERE (was AND NOT loud) OR (loud AND place = n - 1)""")
def speech_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a recogniser gets of each user's windows."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("last_id"))
    rows = table(spark, sf_dir, "events").join(last, "user_id").select("user_id", F.col("event_id").alias("seq"), (F.col("value") > 10).alias("in_speech"), (F.col("event_id") == F.col("last_id")).alias("end"))
    return speech.fold(rows, live.segments(), live.SEGMENT, "user_id").withColumnRenamed("seq", "event_id")


@query("""WITH a AS (SELECT event_id, user_id, value > 10 AS loud FROM events),
b AS (SELECT *, sum(CASE WHEN prev = loud THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS turn FROM (SELECT *, lag(loud) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM a)),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id, turn ORDER BY event_id) AS run FROM b),
d AS (SELECT *, CASE WHEN run >= 2 THEN loud END AS event FROM c)
SELECT event_id, user_id, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), false) AS in_speech FROM d""")
def model_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity by a plugged-in model, here one that returns a window's only value."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.array("value").alias("window"), F.lit(1.0).alias("duration"))
    machine = live.model_vad(lambda: lambda window: window[0], 10, 2.0, 2.0)
    return speech.fold(rows, machine, speech.VAD, "user_id").select(F.col("seq").alias("event_id"), "user_id", "in_speech")


@query("SELECT event_id, event_type FROM events")
def resumed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over a folder that grows between them, each in micro-batches of one file."""
    at, rows = place(spark, "stream"), table(spark, sf_dir, "events").select("event_id", "event_type")
    source = lambda: live.read_new(spark, f"{at}/in", "event_id long, event_type string", files=1)
    for k in (0, 1):
        files.write_jsonl(rows.where(F.col("event_id") % 2 == k).repartition(2), f"{at}/in", append=True)
        live.run_available(source(), f"{at}/out", f"{at}/state")
    live.run_available(source(), f"{at}/out", f"{at}/state")  # nothing new, nothing written
    return spark.read.schema("event_id long, event_type string").json(f"{at}/out")


# --- plug-ins ---


@query(r"SELECT conv_id, turn, regexp_replace('Fix: ' || text, '^[\s\x0b\x1c-\x1f]+|[\s\x0b\x1c-\x1f]+$', '', 'g') AS clean_text FROM conversations")
def local_refiner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model in the worker, here one that answers with its prompt between markers."""
    load = models.local_refiner(lambda: lambda prompt, most: f"<|im_start|>assistant\n{prompt}<|im_end|>", "Fix: {text}")
    return models.refine_batches(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", load).select("conv_id", "turn", "clean_text")


@query(f"""SELECT doc_id AS id, CASE WHEN length(text) % 4 = 0 THEN {_MARKS.format('text')} ELSE {_STRIP.format("CASE WHEN lang = 'en' THEN 'English' ELSE 'Chinese' END || ' heard ' || text")} END AS input, length(text) % 4 = 0 AS fell_back FROM documents WHERE coalesce(text, '') <> ''""")
def speech_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts spoken and heard again by a stand-in that fails for those whose length is a multiple of four."""

    def speak(text: str, language: str) -> bytes:
        if len(text) % 4 == 0:
            raise ValueError("no voice")
        return f"{language} heard {text}".encode()

    scene = F.when(F.col("lang") == "en", "english_daily").otherwise("meeting")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), scene.alias("scene"), F.col("text").alias("oral_text"), F.lit("clean").alias("clean_text"))
    call = models.speech_round_trip(speak, lambda sound, language: sound.decode(), settings=("stub",), attempts=1)
    return curate.simulate(rows, "tts_asr", call=call).select("id", "input", F.col("meta.asr_fallback_text_sim").alias("fell_back"))


@query("""SELECT source AS scene, 'words' AS category, lower(lang) AS seed FROM documents GROUP BY ALL UNION ALL SELECT source, 'words', 'new ' || source FROM documents GROUP BY source""")
def seed_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round of seeds: a stand-in answers with one seed that is known and one that is new."""
    docs = table(spark, sf_dir, "documents")
    pool = docs.select(F.col("source").alias("scene"), F.lit("words").alias("category"), F.crc32("lang").alias("pos"), F.lower("lang").alias("seed")).distinct()
    asked = docs.select(F.col("source").alias("scene"), F.lit("words").alias("category"), F.col("source").alias("prompt")).distinct()
    answer = lambda prompt: f'Here: {{"words": ["EN", {{"term": "new {prompt}"}}]}}'
    known = pool.where("seed = 'en'").select("scene").distinct()
    return models.seed_round(pool, asked.join(known, "scene", "left_semi"), answer).select("scene", "category", "seed").unionByName(
        models.seed_round(pool.limit(0), asked.join(known, "scene", "left_anti"), lambda p: f'["new {p}"]').select("scene", "category", "seed")
    ).unionByName(pool.join(known, "scene", "left_anti").select("scene", "category", "seed"))

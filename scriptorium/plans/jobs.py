"""Queries of whole jobs: judging in waves, generation steps, spread sessions, sources by ranges, versioned results, typed streams, summaries."""

from __future__ import annotations

import json
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keywords as K
from ..functions import records as R
from ..functions import text as T
from ..operators import curate, dedup, evaluate, finalize, generators, models, prompts, waves
from ..sources import audio, files, results
from ..streaming import live, speech, stateful
from .catalog import SQL, place, query, table
from .registry import _PAIRS, _REFINED, _RUNS, _STRIP, _WINDOWS, _ascii, _pairs


# --- judging until enough has passed ---


@query("""
WITH r AS (SELECT doc_id, source AS scene, CASE WHEN coalesce(text, '') = '' THEN 'input or refined_text is empty' WHEN length(text) % 3 = 0 THEN 'bad ' || length(text) WHEN length(text) % 7 = 0 THEN 'QC call failed' END AS why FROM documents WHERE source IS NOT NULL),
s AS (SELECT *, sum((why IS NULL)::INT) OVER (PARTITION BY scene ORDER BY doc_id) AS c FROM r)
SELECT doc_id, scene, why IS NULL AS kept, why AS qc_reason FROM s WHERE CASE WHEN why IS NULL THEN c <= 9 ELSE c < 9 END""")
def judged_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents judged by a stand-in, wave by wave, until nine of each source have passed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("scene"), "text")
    size = F.length("text")
    answer = F.when(size % 3 == 0, F.concat(F.lit('{"pass": false, "reason": "bad '), size.cast("string"), F.lit('"}'))).when(size % 7 != 0, '{"pass": true}')
    empty = curate.precheck(F.col("text"), F.col("text"))
    known = F.when(F.startswith(empty, F.lit("input or")), empty)
    found = waves.judged(docs, F.lit(9), lambda rows: rows.withColumn("response", answer), place(spark, "waves"), known, order="doc_id")
    return curate.first_passing(found, F.col("qc_reason").isNull(), F.lit(9), "scene", "doc_id").select("doc_id", "scene", "kept", "qc_reason")


# --- keywords through simulation and assembly ---

_FIELDS = ("review_targets", "domain_keywords", "error_keywords", "keyword_list")


@query("""
WITH d AS (SELECT doc_id, text, list_distinct(regexp_extract_all(text, '[A-Za-z]{7,}')) AS w FROM documents WHERE coalesce(text, '') <> ''),
p AS (SELECT doc_id, unnest(w) AS word FROM d)
SELECT d.doc_id, CASE WHEN len(w) = 0 AND doc_id % 5 < 4 THEN 1 ELSE len(w) END::BIGINT AS n,
CASE WHEN len(w) = 0 AND doc_id % 5 < 4 THEN 'Unused99' ELSE coalesce((SELECT string_agg(word, ',' ORDER BY word) FROM p WHERE p.doc_id = d.doc_id), '') END AS words FROM d""")
def carried_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long words of each text, in one of five fields, after simulation and assembly; a field that comes later has other words."""
    docs = table(spark, sf_dir, "documents").where(F.coalesce("text", F.lit("")) != "")
    words, k = F.regexp_extract_all("text", F.lit("[A-Za-z]{7,}"), F.lit(0)), F.col("doc_id") % 5
    none, other = F.array().cast("array<string>"), F.array(F.lit("Unused99"))
    # the fields in the order in which they count; that of the row's number has the words, those before are empty
    order = ("output", "keyword_list", "review_targets", "domain_keywords", "error_keywords")
    held = {f: F.when(k == i, words).when(k < i, other).otherwise(none) for i, f in enumerate(order)}
    rows = docs.select(
        F.col("doc_id").alias("id"), F.col("source").alias("scene"), F.col("text").alias("oral_text"), F.col("text").alias("clean_text"), F.struct(held["output"].alias("keyword_list")).alias("output"), *[held[f].alias(f) for f in order[1:]],
    )
    out = curate.assemble(curate.simulate(rows))
    found = F.col("output.keyword_list")
    return out.select(F.col("id").alias("doc_id"), F.size(found).cast("long").alias("n"), F.array_join(F.array_sort(found), ",").alias("words"))


@query("""
WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]{7,}') AS w FROM documents)
SELECT doc_id FROM d WHERE doc_id % 4 <> 1 AND (doc_id % 4 <> 2 OR len(w) = 0 OR text IS NULL)""")
def traceable_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose keywords pass: their own words do, common ones and, in some, those of no text don't."""
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 4
    words = F.coalesce(F.regexp_extract_all("text", F.lit("[A-Za-z]{7,}"), F.lit(0)), F.array().cast("array<string>"))
    held = F.when(k == 1, F.concat(words, F.array(F.lit("the")))).when((k == 2) & (F.size(words) > 0), F.array(F.lit("ЖЩЖЩЖЩ"))).otherwise(words)
    rows = docs.select("doc_id", F.col("text").alias("input"), F.lit("").alias("oral_text"), F.struct(F.col("text").alias("refined_text"), held.alias("keyword_list")).alias("output"))
    return K.traceable(rows).select("doc_id")


# --- generation ---


@query(rf"""
WITH t AS (SELECT conv_id, turn, role, text, CASE WHEN conv_id % 2 = 0 THEN 'english_daily' ELSE 'meeting' END AS scene FROM conversations WHERE length(text) >= 4)
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text ELSE {_STRIP.format("CASE WHEN conv_id % 2 = 0 THEN 'Tidy: ' ELSE '整理：' END || text")} END AS clean_text, turn % 3 <> 0 AS asked FROM t WHERE turn % 3 = 0 OR turn % 5 <> 4""")
def clean_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean targets of turns by a stand-in that answers with its prompt in JSON, plain, wrapped or listed, and fails for some."""
    at = place(spark, "prompts")
    files.write_json(spark, {"system_prompts": {"en": "Tidy:", "zh": "整理："}, "user_template": {"en": "{oral_text}", "zh": "{oral_text}"}}, f"{at}/clean.json")

    def answer(prompt: str) -> str:
        system, _, user = prompt.partition("\n\n")
        body = {"clean_text": f"{system} {user}" if system == "Tidy:" else system + user, "domain_keywords": [], "itn_types": ["date"]}
        n = len(user) % 4
        return ("Done: " if n == 3 else "") + json.dumps([body] if n == 0 else {"data": [body, {}]} if n == 1 else body, ensure_ascii=False)

    scene = F.when(F.col("conv_id") % 2 == 0, "english_daily").otherwise("meeting")
    rows = table(spark, sf_dir, "conversations").where("turn % 3 = 0 OR turn % 5 <> 4").select(
        F.struct("conv_id", "turn").alias("id"), scene.alias("scene"), F.col("text").alias("oral_text"), F.when(F.col("turn") % 3 == 0, F.array(F.lit("Clean"))).otherwise(F.array(F.lit("um"))).alias("speech_phenomena"),
    )
    out = generators.clean_records(rows, prompts.prompt_document(spark, f"{at}/clean.json"), answer, attempts=1)
    return out.select("id.conv_id", "id.turn", "clean_text", (F.size("itn_types") > 0).alias("asked"))


@query("""SELECT item_id AS sample_id, 'q' || i AS question_id, CASE WHEN item_id % 5 <> 0 THEN (length(text) + i) % 3 END AS option_index,
CASE item_id % 20 WHEN 0 THEN 'no JSON object' WHEN 5 THEN 'no answers array' WHEN 10 THEN 'no answer to [''q1'']' WHEN 15 THEN 'option 7 of question ''q0''' END AS error
FROM benchmark, range(2) r(i) WHERE item_id % 5 <> 0 OR i = 0""")
def judge_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's answers as texts, in prose or a code fence, with the sample's text beside them; a fifth of them don't fit."""
    k, n = F.col("item_id") % 20, F.length("text")
    one = lambda i, o: F.struct(F.lit(f"q{i}").alias("id"), o.cast("int").alias("option_index"), F.col("text").alias("note"))
    both = F.to_json(F.struct(F.array(one(0, n % 3), one(1, (n + 1) % 3)).alias("answers")))
    said = F.when(k == 0, "none").when(k == 5, F.to_json(F.struct(F.col("text").alias("answers")))).when(k == 10, F.to_json(F.struct(F.array(one(0, n % 3)).alias("answers"))))
    said = said.when(k == 15, F.to_json(F.struct(F.array(one(0, F.lit(7))).alias("answers")))).when(k % 2 == 0, F.concat(F.lit("```json\n"), both, F.lit("\n```"))).otherwise(F.concat(F.lit("So: "), both, F.lit(".")))
    questions = F.array(*[F.struct(F.lit(f"q{i}").alias("id"), F.array(*map(F.lit, "abc")).alias("options")) for i in range(2)])
    found = models.answers_of(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("sample_id"), said.alias("response"), questions.alias("questions")))
    return found.select("sample_id", F.coalesce("question_id", F.lit("q0")).alias("question_id"), F.col("option_index").cast("long").alias("option_index"), "error")


# --- sessions ---


@query(_RUNS.replace("PARTITION BY user_id ORDER BY event_id", "ORDER BY event_id").replace("PARTITION BY user_id, turn ORDER", "PARTITION BY turn ORDER").join(("WITH ", " SELECT event_id, in_speech FROM v")))
def one_hot_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The activity of all events as one session, spread over ranges of its windows."""
    rows = table(spark, sf_dir, "events").select("event_id", F.lit("all").alias("session"), "value")
    return speech.activity(rows, F.col("value") > 10, "session", "event_id", 2, 2, width=4096).select("event_id", "in_speech")


_SETTLED = _WINDOWS.replace("t AS c FROM", "t AS c, row_number() OVER o AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM")


@query(f"""WITH {_SETTLED}
SELECT conv_id, turn AS seq, start_index, {_REFINED} AS refined, CASE WHEN i > 3 THEN lag(c, 3) OVER (PARTITION BY conv_id ORDER BY turn) END AS settled FROM w
UNION ALL SELECT conv_id, turn + 1, n, '', {_REFINED} FROM w WHERE i = n""")
def settled_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a stream of chunks with typed state; sessions end by a timer, when the watermark has passed their silence."""
    at, time = place(spark, "settled"), F.timestamp_seconds(F.col("turn") * 60 + 1_000_000)
    rows = table(spark, sf_dir, "conversations").where(~T.blank(F.col("text"))).select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "text", time.alias("at"))
    # two halves of each session, in order, and a row of another one, much later, that moves the watermark
    late = spark.createDataFrame([(-1, 0, "late")], "session long, seq long, text string").withColumn("at", F.timestamp_seconds(F.lit(10**9)))
    for part in (rows.where("seq < 3"), rows.where("seq >= 3"), late):
        files.write_jsonl(part, f"{at}/in", append=True)
        source = live.read_new(spark, f"{at}/in", "session long, seq long, text string, at timestamp").withWatermark("at", "1 second")
        chunks = stateful.stateful(source, stateful.settling(), stateful.SETTLE_STATE, stateful.SETTLED, flush={"end": True}, idle=1_800_000, time="at")
        live.run_available(chunks, f"{at}/out", f"{at}/state")
    out = files.read_jsonl(spark, f"{at}/out", f"session long, seq long, {stateful.SETTLED}").where("session >= 0")
    return out.select(F.col("session").alias("conv_id"), "seq", "start_index", F.col("refined_text").alias("refined"), F.try_element_at("settled", F.lit(1)).alias("settled"))


# --- sources ---


@query("""SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 3 * row_number() OVER (ORDER BY doc_id) - 1 END AS line FROM documents""")
def numbered_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of one file of several ranges: each document's, between blank ones, whole or, of every tenth, as an array."""
    at, docs = place(spark, "lines"), table(spark, sf_dir, "documents")
    good = F.to_json(F.struct("doc_id", "text"))
    line = F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("["), good, F.lit("]"))).otherwise(good)
    docs.select("doc_id", F.concat(F.lit("\n"), line, F.lit("\n")).alias("value")).coalesce(1).sortWithinPartitions("doc_id").select("value").write.text(at)
    rows, wrong = files.check_jsonl(spark, at, "doc_id long, text string")
    held = F.get_json_object("value", "$[0].doc_id").cast("long")
    return rows.select("doc_id", F.lit(None).cast("long").alias("line")).unionByName(wrong.select(held.alias("doc_id"), F.col("line").cast("long").alias("line")))


def _wave(x: list[float], width: int, rate: int = 16_000) -> bytes:
    """A PCM file of samples from -1 to 1."""
    top = 2 ** (8 * width - 1) - 1
    ints = [round(top * v) for v in x]
    data = b"".join((i + 128).to_bytes(1, "little") if width == 1 else i.to_bytes(width, "little", signed=True) for i in ints)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, rate, width * rate, width, 8 * width, b"data", len(data))
    return head + data


@query("""WITH v AS (SELECT vec_id, [greatest(-1, least(1, x::DOUBLE)) FOR x IN embedding] AS x, [127, 32767, 8388607, 2147483647][vec_id % 4 + 1] AS top, [128, 32768, 8388608, 2147483648][vec_id % 4 + 1] AS scale FROM embeddings)
SELECT vec_id, i - 1 AS place, round(round_even(x[i] * top, 0) / scale, 4) + 0.0::DOUBLE AS sample FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM v)""")
def wave_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as waves of 8, 16, 24 or 32 bits, read back by ranges of 500 windows."""
    at = place(spark, "waves")

    def run(batches):
        system, base = files.shared_system(at)
        system.create_dir(base)
        for b in batches:
            for k, x in zip(b.column("vec_id").to_pylist(), b.column("embedding").to_pylist()):
                with system.open_output_stream(f"{base}/{k}.wav") as f:
                    f.write(_wave([max(-1.0, min(1.0, v)) for v in x], k % 4 + 1))
            yield pa.RecordBatch.from_arrays([b.column("vec_id")], names=["vec_id"])

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").withColumn("n", F.size("embedding"))
    sizes = rows.select("vec_id", "n")
    rows.select("vec_id", "embedding").mapInArrow(run, "vec_id long").count()
    name = F.regexp_extract("session", r"(\d+)\.wav$", 1).cast("long")
    # windows of nothing but padding go before they become rows of samples
    found = audio.read_wav(spark, at, windows_a_task=500).withColumn("vec_id", name).join(sizes, "vec_id").where(F.col("seq") * audio.WINDOW < F.col("n"))
    found = found.select("vec_id", "n", "seq", F.posexplode("window").alias("i", "x")).withColumn("place", F.col("seq") * audio.WINDOW + F.col("i")).where("place < n")
    return found.select("vec_id", "place", (F.round(F.col("x").cast("double"), 4) + 0.0).alias("sample"))


# --- versioned results ---


@query("SELECT event_id, event_type, CASE WHEN event_id % 3 = 1 THEN 'again' ELSE 'first' END AS sent FROM events")
def versioned_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches, one of them sent twice, then compacted; an old version is still as it was."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    store = results.ResultStore(spark, place(spark, "results"), "event_id long, event_type string, sent string")
    for k, sent in ((0, "first"), (1, "first"), (1, "again"), (2, "first")):
        store.commit(rows.where(F.col("event_id") % 3 == k).withColumn("sent", F.lit(sent)), batch=k)
    before = store.read(2)
    store.compact(4)
    if store.read(2).count() != before.count() or store.version != 5:
        raise AssertionError("an old version has changed")
    store.vacuum()
    return store.read()


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL")
def latest_kept_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type, after seven batches in an order of their own."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    store = results.LatestStore(spark, place(spark, "latest"), rows.schema, ["user_id", "event_type"], "event_id", buckets=16)
    for k in (3, 0, 6, 1, 5, 2, 4):
        store.merge(rows.where(F.pmod(F.xxhash64("event_id"), F.lit(7)) == k))
    return store.read()


@query(SQL["near_dedup_greedy"])
def dedup_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay, when four batches come one after the other and meet what has been retained before."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    cuts = docs.agg(F.percentile_approx("id", F.array(F.lit(0.1), F.lit(0.4), F.lit(0.7))).alias("q")).first().q
    held = dedup.Retained(spark, place(spark, "retained"))
    kept = [held.add(docs.where(part), k) for k, part in enumerate((F.col("id") <= cuts[0], F.col("id").between(cuts[0] + 1, cuts[1]), F.col("id").between(cuts[1] + 1, cuts[2]), F.col("id") > cuts[2]))]
    return kept[0].unionByName(kept[1]).unionByName(kept[2]).unionByName(kept[3]).select(F.col("id").alias("doc_id"))


# --- summaries ---

_SUMMARY = rf"""{_PAIRS}, q AS (SELECT conv_id || ':' || turn AS sample_id, CASE WHEN conv_id % 3 = 0 THEN 'filter' ELSE 'content' END AS category, CASE WHEN conv_id % 2 = 0 THEN 'meeting' ELSE 'daily_chat' END AS scene,
length(refined) % 3 AS score, conv_id % 7 <> 0 AS good, conv_id % 11 = 0 AS gone, conv_id % 13 <> 0 AS done, length(refined)::DOUBLE AS latency, conv_id % 5 <> 0 AS timed,
trim(regexp_replace(regexp_replace(lower(regexp_replace(source, '[^ -~]', '', 'g')), '[\p{{P}}\p{{S}}\p{{Z}}]', ' ', 'g'), ' +', ' ', 'g')) AS r,
trim(regexp_replace(regexp_replace(lower(regexp_replace(refined, '[^ -~]', '', 'g')), '[\p{{P}}\p{{S}}\p{{Z}}]', ' ', 'g'), ' +', ' ', 'g')) AS h FROM pairs),
k AS (SELECT *, 2 AS best FROM q WHERE done AND good),
m AS (SELECT sum(levenshtein(replace(r, ' ', ''), replace(h, ' ', ''))) AS e, sum(length(replace(r, ' ', ''))) AS u FROM q),
g AS (SELECT 'overall' AS part, '' AS value, score, best FROM k UNION ALL SELECT 'by_category', category, score, best FROM k UNION ALL SELECT 'by_scene', scene, score, best FROM k),
o AS (SELECT part, value, count(*) AS n, sum(score) AS s, sum(best) AS b FROM g GROUP BY ALL)"""


@query(f"""WITH {_SUMMARY}
SELECT part, value, field, number::DOUBLE AS number FROM (
SELECT part, value, unnest(['question_count', 'score', 'max_score', 'normalized_score']) AS field, unnest([n, s, b, greatest(0, least(1, s / b::DOUBLE))]) AS number FROM o UNION ALL
SELECT 'run', '', unnest(['total_sample_count', 'completed_sample_count', 'failed_question_count', 'asr_retry_exhausted_sample_count', 'asr_retry_exhausted_question_count', 'input_asr_sample_count', 'out_of_benchmark_asr_sample_count']),
 unnest([(SELECT count(*) FROM q), (SELECT count(*) FROM q WHERE done AND good), (SELECT count(*) FROM q WHERE done AND NOT good), (SELECT count(*) FROM q WHERE done AND gone), (SELECT count(*) FROM q WHERE done AND gone),
 (SELECT count(*) FROM conversations), (SELECT count(*) FROM conversations) - (SELECT count(*) FROM q)]) UNION ALL
SELECT 'asr_metrics', '', unnest(['sample_count', 'latency_sample_count', 'missing_latency_sample_count', 'average_latency_ms', 'cer', 'cer_errors', 'cer_reference_units']),
 unnest([(SELECT count(*) FROM q), (SELECT count(*) FROM q WHERE timed), (SELECT count(*) FROM q WHERE NOT timed), (SELECT round(avg(latency), 6) FROM q WHERE timed), (SELECT e / u::DOUBLE FROM m), (SELECT e FROM m), (SELECT u FROM m)]))""")
def summary_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of a run over all pairs of turns, written as a document and read again: its numbers as rows."""
    pairs, k, n = _pairs(spark, sf_dir), F.col("conv_id"), F.length("refined")
    name = F.concat_ws(":", k.cast("string"), F.col("turn").cast("string")).alias("sample_id")
    sign = lambda c: R.signature(text=c)
    samples = pairs.select(name, F.lit("q0").alias("question_id"), sign(F.col("refined")).alias("signature"))
    old = F.when(k % 13 == 0, sign(F.col("source"))).otherwise(sign(F.col("refined")))
    given = pairs.select(
        name, F.lit("q0").alias("question_id"), old.alias("evaluation_signature"), F.when(k % 3 == 0, "filter").otherwise("content").alias("category"), F.when(k % 2 == 0, "meeting").otherwise("daily_chat").alias("scene"),
        (n % 3).alias("score"), F.lit(2).alias("max_score"), F.when(k % 7 == 0, "failed").otherwise("success").alias("status"), F.when(k % 11 == 0, True).alias("asr_retry_exhausted"), F.lit(1).alias("ord"),
    )
    before = given.withColumn("score", F.lit(-1)).withColumn("ord", F.lit(0))  # judged again since
    measured = pairs.select(T.text_metrics(_ascii(F.col("source")), _ascii(F.col("refined")), ascii_only=True).alias("m"), F.when(k % 5 != 0, n.cast("double")).alias("latency_ms"))
    found = evaluate.summary_document(samples, given.unionByName(before), measured, {"model": "judge"}, table(spark, sf_dir, "conversations").count())
    at = f"{place(spark, 'summary')}/summary.json"
    files.write_json(spark, found, at)
    read = files.read_json(spark, at)
    wanted = {"asr_metrics": ("sample_count", "latency_sample_count", "missing_latency_sample_count", "average_latency_ms", "cer", "cer_errors", "cer_reference_units")}
    groups = [(part, value, read[part][value]) for part in ("by_category", "by_scene") for value in read[part]] + [(part, "", read[part]) for part in ("run", "overall", "asr_metrics")]
    rows = [(part, value, f, round(float(x), 6) if f == "average_latency_ms" else float(x)) for part, value, fields in groups for f, x in fields.items() if f in wanted.get(part, fields)]
    return spark.createDataFrame(rows, "part string, value string, field string, number double")


@query("""
WITH d AS (SELECT doc_id, source AS scene, CASE lang WHEN 'en' THEN 'en' WHEN 'de' THEN NULL ELSE lang END AS language, trim(text) AS t FROM documents),
r AS (SELECT *, CASE WHEN coalesce(t, '') = '' THEN 'skipped_empty' WHEN length(t) < 2 OR length(t) < 10 THEN 'skipped_short' END AS why FROM d)
SELECT kind, value, count(*) AS n FROM (SELECT 'scene' AS kind, coalesce(scene, 'unknown') AS value FROM r WHERE why IS NULL UNION ALL SELECT 'language', coalesce(language, 'unknown') FROM r WHERE why IS NULL
UNION ALL SELECT 'is_fragment', CASE WHEN doc_id % 3 = 0 THEN 'True' ELSE 'False' END FROM r WHERE why IS NULL UNION ALL SELECT 'total', '' FROM r WHERE why IS NULL UNION ALL SELECT 'skipped', why FROM r WHERE why IS NOT NULL) GROUP BY ALL""")
def counted_while_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the final rows of all documents, counted by the job that writes them."""
    docs = table(spark, sf_dir, "documents")
    language = F.when(F.col("lang") != "de", F.col("lang"))
    rows = docs.select(
        F.col("text").alias("input"), F.struct(F.col("text").alias("refined_text")).alias("output"), F.struct(F.col("source").alias("scene"), language.alias("language"), (F.col("doc_id") % 3 == 0).alias("is_fragment")).alias("meta"),
    )
    why = curate.skip_reason(F.col("input"), F.col("output.refined_text"), F.col("meta.scene"))
    found, skipped = finalize.write_final(rows, place(spark, "final"), 1000, reason=why)
    counts = [("total", "", found["distribution"]["total"])] + [(k, v, n) for k in ("scene", "language", "is_fragment") for v, n in found["distribution"][k].items()]
    return spark.createDataFrame(counts + [("skipped", k, n) for k, n in skipped.items() if n], "kind string, value string, n long")


@query(rf"""SELECT conv_id, turn, {_STRIP.format("regexp_replace(replace(replace(replace(lower(text), 'the of', '2'), 'the', '1'), 'of', '3'), '[\\p{P}\\p{S}\\p{Z}]+', ' ', 'g')")} AS form FROM conversations WHERE regexp_matches(text, '^[ -~]*$')""")
def phrase_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric forms with phrases, the longest at each place first, of the turns in ASCII."""
    phrases = {"the of": "2", "the": "1", "of": "3", "f the": "unused"}
    rows = table(spark, sf_dir, "conversations").where(F.col("text").rlike("^[ -~]*$"))
    return rows.select("conv_id", "turn", T.metric_form(F.lower("text"), {}, phrases=phrases).alias("form"))

"""Whole jobs: judging in waves, generation, spread sessions, ranges of files, versioned results, typed streams, summaries."""

import json
import random
import struct
import wave

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import curate, evaluate, finalize, generators, models, prompts, rubric, waves
from scriptorium.sources import admin, audio, files, results
from scriptorium.streaming import live, speech, stateful

# --- judging until enough has passed ---


def records(spark, n=900):
    rng = random.Random(8)
    rate = {"a": 0.9, "b": 0.3, "c": 0.02}
    rows = [(i, s, rng.random() < rate[s], rng.random() < 0.1) for i in range(n) for s in [rng.choice("abc")]]
    return rows, spark.createDataFrame(rows, "ord long, scene string, good boolean, bare boolean").withColumn("target", F.lit(20))


def test_waves_ask_little_more_than_needed(spark, tmp_path):
    rows, df = records(spark)
    asked = spark.sparkContext.accumulator(0)

    def judge(part):
        def run(frames):
            for pdf in frames:
                asked.add(len(pdf))
                yield pdf.assign(response=["true" if x else None if k % 2 else "false" for k, x in zip(pdf.ord, pdf.good)])

        return part.mapInPandas(run, "scene string, ord long, good boolean, bare boolean, target int, _known string, _wanted long, _place long, response string")

    known = F.when(F.col("bare"), "bare")
    out = waves.judged(df, F.col("target"), judge, str(tmp_path / "log"), known)
    first = curate.first_passing(out, F.col("qc_reason").isNull(), F.lit(20)).select("ord", "kept")
    every = df.withColumn("why", F.when(F.col("bare"), "bare").when(~F.col("good"), "no"))
    want = curate.first_passing(every, F.col("why").isNull(), F.lit(20)).select("ord", "kept")
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, want.collect()))
    assert {r.qc_reason for r in out.select("qc_reason").distinct().collect()} == {None, "bare", "false", "QC call failed"}
    # replay of the waves' sizes: what was asked is what they say, and a wave beyond the target at most
    for s in "abc":
        mine = [(g and not b, b) for _, x, g, b in rows if x == s]
        checked = passed = spent = last = 0
        while size := waves.wave_size(20, checked, passed, len(mine) - checked):
            part, checked, last = mine[checked : checked + size], checked + size, checked
            passed, spent = passed + sum(g for g, _ in part), spent + sum(not b for _, b in part)
        assert out.where(F.col("scene") == s).count() == checked
        assert sum(g for g, _ in mine[:last]) < 20  # before the last wave the target was not reached
        spent_all = spent if s == "a" else spent_all + spent
    assert asked.value == spent_all < 0.95 * len(rows)


def test_waves_go_on_where_they_died(spark, tmp_path):
    rows, df = records(spark)
    log, calls = str(tmp_path / "log"), []

    def judge(part, fail=None):
        calls.append(1)
        if fail is not None and len(calls) > fail:
            raise RuntimeError("cut off")
        return part.withColumn("response", F.when(F.col("good"), "true").otherwise("false"))

    with pytest.raises(RuntimeError):
        waves.judged(df, F.col("target"), lambda p: judge(p, 2), log)
    waves_there = [x for x in files.children(spark, log) if x.startswith("wave-")]
    assert len(waves_there) == 2
    # a wave that was cut off while writing is no wave
    (tmp_path / "log" / "wave-00002").mkdir()
    before = {x: (tmp_path / "log" / x / "_SUCCESS").stat().st_mtime_ns for x in waves_there}
    out = waves.judged(df, F.col("target"), judge, log)
    assert before == {x: (tmp_path / "log" / x / "_SUCCESS").stat().st_mtime_ns for x in waves_there}
    whole = waves.judged(df, F.col("target"), judge, str(tmp_path / "other"))
    assert sorted(r.ord for r in out.collect()) == sorted(r.ord for r in whole.collect())
    none = waves.judged(df.limit(0), F.col("target"), judge, str(tmp_path / "none"))
    assert none.count() == 0 and none.columns == out.columns


def test_finalize_with_a_judge_equals_answers(spark, tmp_path):
    rows = [(i, "meeting" if i % 2 else "navigation", i, f"said number {i} as {i * i}" if i % 9 else "", (f"number {i}",), ("zh",)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, scene string, ord long, input string, output struct<refined_text:string>, meta struct<language:string>")
    answer = F.when(F.col("id") % 3 == 0, '{"pass": false, "reason": "r"}').otherwise('{"pass": true}')
    a = finalize.finalize(df, 300, answer)
    b = finalize.finalize(df, 300, judge=lambda part: part.withColumn("response", answer), log=str(tmp_path / "log"))
    for x, y in zip(a, b):
        assert sorted(r.id for r in x.collect()) == sorted(r.id for r in y.collect())
    assert {r.qc_reason for r in b[1].collect()} == {"r", "input or refined_text is empty"}


def test_counts_of_the_writing_job(spark, tmp_path):
    rows = [(f"text {i}", (f"refined {i}" if i % 7 else "",), ("meeting" if i % 2 else None, "zh" if i % 3 else "en", i % 5 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "input string, output struct<refined_text:string>, meta struct<scene:string,language:string,is_fragment:boolean>")
    why = curate.skip_reason(F.col("input"), F.col("output.refined_text"), F.coalesce("meta.scene", F.lit("")))
    doc, skipped = finalize.write_final(df, str(tmp_path / "train"), 100, reason=why)
    kept = df.where(why.isNull())
    assert doc == finalize.statistics(finalize.final_rows(kept), 100)
    assert skipped == {"skipped_empty": 9, "skipped_short": df.where(why == "skipped_short").count()}
    assert spark.read.json(str(tmp_path / "train")).count() == kept.count()
    odd = df.withColumn("meta", F.struct(F.lit("elsewhere").alias("scene"), F.lit("fr").alias("language"), F.lit(None).cast("boolean").alias("is_fragment")))
    assert finalize.write_final(odd, str(tmp_path / "odd"), 100)[0] == finalize.statistics(finalize.final_rows(odd), 100)


# --- keywords and generation ---


def test_keywords_by_the_first_field_that_has_any(spark):
    base = {"id": 1, "scene": "meeting", "oral_text": "Kafka and Redis and GPT4 in Spark", "clean_text": "Kafka, Redis, GPT4 in Spark."}
    for k, field in enumerate(("keyword_list", "review_targets", "domain_keywords", "error_keywords")):
        words = {f: ([] if i < k else ["Kafka"] if i == k else ["Redis"]) for i, f in enumerate(("keyword_list", "review_targets", "domain_keywords", "error_keywords"))}
        kinds = ", ".join(f"{f} array<string>" for f in words)
        df = spark.createDataFrame([(*base.values(), *words.values())], f"id long, scene string, oral_text string, clean_text string, {kinds}")
        assert curate.assemble(curate.simulate(df)).first().output.keyword_list == ["Kafka"], field
        over = df.withColumn("output", F.struct(F.array(F.lit("GPT4")).alias("keyword_list")))
        assert curate.assemble(over, from_simulation=False).first().output.keyword_list == ["GPT4"]
    odd = df.drop("keyword_list").withColumn("keyword_list", F.lit("text")).withColumn("output", F.lit("text"))
    assert curate.assemble(odd, from_simulation=False).first().output.keyword_list == ["Kafka"]


def test_oral_prompts_and_records(spark):
    items = spark.createDataFrame([(i, s, ["a", "b"]) for i in range(60) for s in ("explanation", "english_tech", "elsewhere")], "id long, scene string, seeds array<string>")
    rows = prompts.oral_prompts(items, "{scene}|{context}|{language}|{correction}|{oral_level}|{additional}|{seeds}", contexts={"english_tech": "a talk"}).collect()
    seen = set()
    for r in rows:
        scene, context, language, correction, level, additional, seeds = r.prompt.split("|")
        assert context == {"english_tech": "a talk"}.get(scene, prompts.ANY_CONTEXT) and seeds == '["a", "b"]' and language == ("English" if scene == "english_tech" else "Chinese")
        if r.speech_phenomena == ["clean"]:
            assert correction == level == prompts.CONTROL_TEXTS["passthrough"] and additional == "None"
            continue
        assert (correction, level) == tuple(prompts.CONTROL_TEXTS[x] for x in r.speech_phenomena[:2])
        assert (additional == prompts.CONTROL_TEXTS["explanation"]) == (scene == "explanation") == (r.speech_phenomena[2:] == ["explanation"])
        seen |= {*r.speech_phenomena[:2]}
    assert seen == {f"correction:{x}" for x in curate.CORRECTIONS} | {f"oral:{x}" for x in curate.LEVELS}
    asked = prompts.oral_prompts(items.where("scene = 'explanation'"), "{scene}")
    answers = ['{"oral_text": " um so "}', '{"oral_text": "um"}', "none", '{"oral_text": "um so", "selected_seeds": ["b"], "speech_phenomena": ["x", 1]}']

    def call(prompt, n=[0]):
        n[0] += 1
        return answers[n[0] % 4]

    made = generators.oral_records(asked.coalesce(1), call, workers=1).collect()
    assert 20 <= len(made) <= 40 and {r.oral_text for r in made} == {"um so"}
    assert all(r.speech_phenomena == ["clean"] or r.speech_phenomena == ["x", "1"] and r.selected_seeds == ["b"] or r.selected_seeds == ["a", "b"] for r in made)


def test_clean_records_and_meaning(spark):
    rows = [(1, "meeting", "say Kafka now", ["um"]), (2, "english_daily", "say Redis now", ["PassThrough"]), (3, "meeting", "abc", ["um"]), (4, "english_daily", "fails here", None), (5, "meeting", None, None), (6, "meeting", "no answer", ["x"])]
    df = spark.createDataFrame(rows, "id long, scene string, oral_text string, speech_phenomena array<string>")
    document = {"system_prompts": {"zh": "Z"}, "user_template": {"zh": "{oral_text}", "en": "E {oral_text}"}}
    assert prompts.prompt_of(document, "en") == {"system": "Z", "user": "E {oral_text}"} and prompts.prompt_of(document, "fr") == {"system": "Z", "user": "{oral_text}"}

    def call(prompt):
        if "fails" in prompt:
            raise ValueError
        return "no" if "no answer" in prompt else json.dumps({"clean_text": prompt, "domain_keywords": ["Kafka", "the"], "itn_types": ["date"]})

    got = {r.id: r for r in generators.clean_records(df, document, call, attempts=1).collect()}
    assert sorted(got) == [1, 2] and got[1].clean_text == "Z\n\nsay Kafka now" and got[1].keyword_list == got[1].domain_keywords == ["Kafka"] and got[1].itn_types == ["date"]
    assert got[2].clean_text == "say Redis now" and got[2].keyword_list == []
    said = ['{"consistent": false, "reason": " lost "}', '{"consistent": true}', "unreadable", "{}", "[false]"]
    judged = generators.consistent(spark.createDataFrame(list(enumerate(said)), "i int, t string"), F.col("t"), lambda t: t).orderBy("i").collect()
    assert [(r.consistent, r.reason) for r in judged] == [(False, "lost"), (True, ""), (True, ""), (True, ""), (True, "")]


def test_judge_texts(spark):
    q = [{"id": "a", "options": [1, 2]}, {"id": "b", "options": [1, 2, 3]}]
    good = '{"answers": [{"id": "b", "option_index": 2}, {"id": "a", "option_index": 0}]}'
    for text in (good, f"```json\n{good}\n```", f"Well {good} so", f"```\n{good}\n```"):
        assert models.read_answers(text, q) == [("a", 0), ("b", 2)]
    wrong = ["", "none", "{", '{"answers": {}}', '{"answers": ["a"]}', '{"answers": [{"id": "a", "option_index": true}]}', '{"answers": [{"id": 1, "option_index": 0}]}', good.replace("2}", "3}"), good.replace('"b"', '"a"'), "[1]"]
    for text in wrong:
        with pytest.raises(models.JudgeError):
            models.read_answers(text, q)
    questions = F.array(*[F.struct(F.lit(x["id"]).alias("id"), F.array(*map(F.lit, x["options"])).alias("options")) for x in q])
    rows = spark.createDataFrame([(1, good), (2, None), (3, "x")], "k int, response string").withColumn("questions", questions)
    got = sorted((r.k, r.question_id or "", r.option_index, r.error) for r in models.answers_of(rows).collect())
    assert got == [(1, "a", 0, None), (1, "b", 2, None), (2, "", None, "no JSON object"), (3, "", None, "no JSON object")]


def test_pending_refuses_repeated_inputs(spark):
    done = spark.createDataFrame([(1,)], "id long")
    assert [r.id for r in evaluate.pending(spark.range(4), done, "id", "id", 2).collect()] == [0, 2]
    with pytest.raises(Exception, match="duplicate id"):
        evaluate.pending(spark.range(3).union(spark.range(1)), done, "id", "id").collect()


def test_summary_of_an_empty_run(spark):
    samples = spark.createDataFrame([], "sample_id string, question_id string, signature string")
    found = spark.createDataFrame([], "sample_id string, question_id string, evaluation_signature string, category string, scene string, score int, max_score int, status string, asr_retry_exhausted boolean, ord int")
    measured = spark.createDataFrame([], f"m struct<{','.join(f'{k}_{x}:int' for k in ('wer', 'cer', 'mer') for x in ('errors', 'units'))}>, latency_ms double")
    doc = evaluate.summary_document(samples, found, measured, {"model": "m"}, 3)
    assert doc["run"]["total_sample_count"] == 0 and doc["run"]["out_of_benchmark_asr_sample_count"] == 3 and doc["by_category"] == {} and doc["asr_metrics"]["cer"] == 0.0
    assert doc["overall"] == {"question_count": 0, "score": 0, "max_score": 0, "normalized_score": 0.0} and json.dumps(doc)


# --- sessions ---


def test_spread_activity_equals_the_machine(spark):
    rng = random.Random(6)
    rows, at = [], 0
    for session, n in (("hot", 3000), ("b", 40), ("c", 1), (None, 50)):
        while n > 0:
            run, loud = rng.choice([1, 1, 2, 3, 40, 130]), rng.choice([True, False, False, None])
            for _ in range(min(run, n)):
                at += rng.choice([1, 1, 1, 30])
                rows.append((session, at, loud))
            n -= run
    df = spark.createDataFrame(rows, "session string, seq long, loud boolean")
    for on, off in ((2, 2), (7, 16), (1, 1)):
        whole = speech.activity(df, F.col("loud"), "session", "seq", on, off)
        spread = speech.activity(df, F.col("loud"), "session", "seq", on, off, width=64)
        assert spread.columns == whole.columns
        got = {r.seq: r.in_speech for r in spread.collect()}
        assert got == {r.seq: r.in_speech for r in whole.collect()}
        machine = speech.energy_vad(0.5, off, on)
        for session in ("hot", "b", "c"):
            state = {}
            for s, seq, loud in rows:
                if s == session:
                    assert got[seq] == machine(state, {"rms": 1.0 if loud else 0.0, "duration": 1.0})[0]["in_speech"]


def test_a_hot_session_is_many_tasks(spark):
    rows = spark.range(20_000).withColumn("session", F.lit("one"))
    out = speech.activity(rows, F.col("id") % 7 < 3, "session", "id", 2, 2, width=256).withColumn("task", F.spark_partition_id())
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = out.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.count_if("in_speech").alias("on")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r.n for r in tasks) == 20_000 and sum(r.on for r in tasks) > 5_000 and max(r.n for r in tasks) <= 2_000


# --- sources ---


def test_violations_of_a_file_of_many_ranges(spark, tmp_path):
    rng = random.Random(9)
    for name in "ab":
        lines = [rng.choice(['{"a": 1}', "", "  ", "[1]", "{", '{"a": "' + "x" * rng.randint(0, 300) + '"}', "null"]) for _ in range(2000)]
        (tmp_path / f"{name}.jsonl").write_text(rng.choice(["\n", "\r\n"]).join(lines) + ("\n" if name == "a" else ""))
    want, good = [], 0
    for name in "ab":
        for i, line in enumerate((tmp_path / f"{name}.jsonl").read_text().splitlines(), 1):
            ok = line.startswith("{") and line != "{"
            good += ok
            want += [(name, i, line)] if line.strip() and not ok else []
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        rows, wrong = files.check_jsonl(spark, str(tmp_path), "a string")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        assert rows.count() == good
        assert sorted((r.file[-7], r.line, r.value) for r in wrong.collect()) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def plain_windows(path):
    """All windows of a file, from the standard library's reader."""
    with wave.open(str(path)) as w:
        n, rate, channels, raw = w.getsampwidth(), w.getframerate(), w.getnchannels(), w.readframes(w.getnframes())
    ints = [int.from_bytes(raw[i : i + n], "little", signed=n > 1) - (128 if n == 1 else 0) for i in range(0, len(raw), n)]
    x = (np.array(ints, np.float32) / np.float32(2 ** (8 * n - 1))).reshape(-1, channels).mean(1)
    if rate != 16_000 and len(x):
        m = max(1, round(len(x) * 16_000 / rate))
        x = np.interp(np.linspace(0, len(x) - 1, m), np.arange(len(x)), x)
    x = np.concatenate((np.pad(x, (0, -len(x) % 512)), np.zeros(31 * 512)))
    return x.astype(np.float32).reshape(-1, 512)


def test_ranges_of_waves_of_all_widths(spark, tmp_path):
    rng = random.Random(1)
    for k, (width, rate, channels, n) in enumerate([(1, 16_000, 1, 3000), (2, 16_000, 2, 5000), (3, 16_000, 1, 4096), (4, 16_000, 1, 700), (2, 8_000, 1, 2500), (3, 44_100, 2, 9000), (2, 16_000, 1, 0), (2, 22_050, 1, 1)]):
        with wave.open(str(tmp_path / f"{k}.wav"), "wb") as w:
            w.setnchannels(channels), w.setsampwidth(width), w.setframerate(rate)
            w.writeframes(rng.randbytes(n * channels * width))
    with open(tmp_path / "odd.wav", "wb") as f:  # a chunk before the samples, the extensible form, an odd size
        fmt = struct.pack("<HHIIHHHHIH14s", 0xFFFE, 1, 16_000, 32_000, 2, 16, 22, 16, 4, 1, bytes(14))
        f.write(b"RIFF" + struct.pack("<I", 0) + b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", 4) + struct.pack("<hh", 16384, -16384))
    for size in (3, 100_000):
        got: dict = {}
        rows = audio.read_wav(spark, str(tmp_path), windows_a_task=size)
        for r in rows.orderBy("session", "seq").collect():
            got.setdefault(r.session.rpartition("/")[2], []).append((r.seq, r.window))
        for k in range(8):
            want = plain_windows(tmp_path / f"{k}.wav")
            assert [s for s, _ in got[f"{k}.wav"]] == list(range(len(want)))
            assert np.abs(np.array([w for _, w in got[f"{k}.wav"]], np.float32) - want).max() < 1e-6, k
        assert [w for _, w in got["odd.wav"]][0][:3] == [0.5, -0.5, 0.0]
    assert audio.read_wav(spark, str(tmp_path), 3).rdd.getNumPartitions() > 20
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.wav").write_bytes(b"RIFFxxxxWAVEfmt ")
    with pytest.raises(Exception, match="x.wav: "):
        audio.read_wav(spark, str(tmp_path / "bad")).count()
    (tmp_path / "none").mkdir()
    assert audio.read_wav(spark, str(tmp_path / "none")).count() == 0


def test_a_growing_recording_resumes(spark, tmp_path):
    data = random.Random(4).randbytes(2 * 512 * 40 + 300)
    rec = tmp_path / "in" / "r.wav"
    rec.parent.mkdir()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 0, b"WAVE", b"fmt ", 16, 1, 1, 16_000, 32_000, 2, 16, b"data", 0)
    counts = []

    def listen():
        stream = audio.stream_wav(spark, str(rec.parent), most=1_000).select("session", "seq", "window")
        counts.append(live.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state")))

    rec.write_bytes(head[:20])  # the head is not complete yet
    listen()
    rec.write_bytes(head + data[: 2 * 512 * 10 + 7])
    listen()
    with rec.open("ab") as f:
        f.write(data[2 * 512 * 10 + 7 :])
    listen()
    (tmp_path / "in" / "r.wav.ended").write_text("")
    listen()
    listen()
    assert counts == [0, 10, 30, 1 + 31, 0]
    rec.write_bytes(head[:4] + struct.pack("<I", 36 + len(data)) + head[8:40] + struct.pack("<I", len(data)) + data)
    got = spark.read.schema("session string, seq long, window array<float>").json(str(tmp_path / "out")).orderBy("seq").collect()
    want = plain_windows(rec)
    assert [r.seq for r in got] == list(range(len(want))) and np.abs(np.array([r.window for r in got], np.float32) - want).max() < 1e-6


def test_values_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def compute(rows):
        def run(frames):
            for pdf in frames:
                made.add(len(pdf))
                yield pd.DataFrame({"key": pdf.key, "value": "v" + pdf.t})

        return rows.mapInPandas(run, "key string, value string")

    rows = spark.range(30).withColumn("t", (F.col("id") % 4).cast("string"))
    found, new = files.cached(rows, spark.createDataFrame([], "key string, value string"), ["t"], compute, str(tmp_path / "new"))
    assert found.count() == 30 and new.count() == 4 and found.where("value = 'v3'").count() == 7 and made.value == 4
    spoken = models.speech_round_trip(lambda t, x: t.encode() if "7" not in t else 1 / 0, lambda s, x: s.decode(), attempts=1, new=str(tmp_path / "heard"))
    texts = spark.range(10).select(F.col("id"), F.lit("meeting").alias("scene"), F.col("id").cast("string").alias("oral_text"), F.lit("c").alias("clean_text"))
    assert spoken(texts).where("said IS NULL").count() == 1
    cache = spark.read.parquet(str(tmp_path / "heard"))
    assert cache.count() == 10 and models.speech_round_trip(None, None, cache, attempts=1, new=str(tmp_path / "more"))(texts).where("said IS NULL").count() == 1
    assert spark.read.parquet(str(tmp_path / "more")).count() == 1  # what failed is tried again


# --- versioned results ---


class Killed(Exception):
    pass


def test_a_commit_that_dies_changes_nothing(spark, tmp_path):
    schema = "id long, v string"
    rows = lambda a, b, v: spark.range(a, b).withColumn("v", F.lit(v))
    for step in ("data", "manifest", "pointer", "done"):
        at = str(tmp_path / step)
        store = results.ResultStore(spark, at, schema)
        store.commit(rows(0, 5, "x"), batch="a")

        def die(name, step=step):
            if name == step:
                raise Killed

        with pytest.raises(Killed):
            results.ResultStore(spark, at, schema, die).commit(rows(5, 9, "y"), batch="b")
        assert store.read().count() == (9 if step == "done" else 5)
        store.commit(rows(5, 9, "y"), batch="b")  # sent again
        assert sorted(map(tuple, store.read().collect())) == [(i, "x") for i in range(5)] + [(i, "y") for i in range(5, 9)]
        with pytest.raises(Killed):
            results.ResultStore(spark, at, schema, die).compact()
        assert store.read().count() == 9
        store.vacuum()
        assert store.read().count() == 9 and len(files.children(spark, at)) <= 4


def test_versions_and_batches(spark, tmp_path):
    store = results.ResultStore(spark, str(tmp_path / "s"), "id long")
    assert store.version == 0 and store.read().count() == 0
    for n in (3, 4):
        store.commit(spark.range(n), batch="same")
    store.commit(spark.range(10))
    assert store.version == 3 and [store.read(v).count() for v in (0, 1, 2, 3)] == [0, 3, 4, 14]
    store.compact(1)
    assert store.read().count() == 14 and store.read(1).count() == 3
    store.vacuum(keep=2)
    assert store.read(3).count() == 14
    with pytest.raises(ValueError):
        store.read(1)


def test_latest_rows_kept_up(spark, tmp_path):
    rng = random.Random(12)
    schema = "k long, q string, v double, ord long"
    store = results.LatestStore(spark, str(tmp_path / "s"), schema, ["k", "q"], "ord", buckets=8)
    ords = list(range(300))
    rng.shuffle(ords)
    history = []
    for i in range(5):
        batch = [(rng.choice([*range(20), None]), rng.choice("ab"), rng.random(), ords.pop()) for _ in range(rng.choice([1, 30, 60]))]
        history += batch
        before = {x: p for x, p in store._manifest()["parts"].items()}
        store.merge(spark.createDataFrame(batch, schema))
        touched = {x for x, p in store._manifest()["parts"].items() if before.get(x) != p}
        assert len(touched) <= len({(k, q) for k, q, _, _ in batch if k is not None})
        want = evaluate.latest(spark.createDataFrame(history, schema), ["k", "q"], "ord")
        assert sorted(map(tuple, store.read().collect())) == sorted(map(tuple, want.collect()))
    assert store.merge(spark.createDataFrame([], schema)) == 5


def test_an_append_that_died_is_set_right(spark, tmp_path):
    at = tmp_path / "out"
    admin.append_batch(spark.range(3), str(at), 7)
    (at / "batch=7").rename(at / "_old-7")  # died between the two renames
    assert admin.recover(spark, str(at)) == ["7"] and spark.read.json(str(at / "batch=7")).count() == 3
    (at / "batch=7").rename(at / "_old-7")
    admin.append_batch(spark.range(5), str(at), 7)
    assert spark.read.json(str(at / "batch=7")).count() == 5 and not (at / "_old-7").exists()
    assert admin.recover(spark, str(tmp_path / "none")) == []


# --- typed streams ---


def run_parts(spark, tmp_path, parts, schema, make, out_schema):
    for part in parts:
        files.write_jsonl(part.coalesce(1), str(tmp_path / "in"), append=True)
        stream = live.read_new(spark, str(tmp_path / "in"), schema).withWatermark("at", "1 second")
        live.run_available(make(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    return spark.read.schema(out_schema).json(str(tmp_path / "out"))


def test_segments_with_a_timer_equal_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(s, i, rng.random() < 0.5) for s in range(3) for i in range(30)]
    df = spark.createDataFrame(rows, "session long, seq long, in_speech boolean").withColumn("end", F.lit(False)).withColumn("at", F.timestamp_seconds(F.col("seq") + 1000))
    last = df.groupBy("session").agg(F.max("seq").alias("seq"))
    # the end of input is a row of silence, at the place behind
    ended = df.unionByName(last.select("session", (F.col("seq") + 1).alias("seq"), F.lit(False).alias("in_speech"), F.lit(True).alias("end"), F.lit(None).cast("timestamp").alias("at")))
    want = sorted(map(tuple, speech.fold(ended.drop("at"), live.segments(3, 4), live.SEGMENT).collect()))
    late = df.where("session = 0 AND seq = 0").withColumn("session", F.lit(-1).cast("long")).withColumn("in_speech", F.lit(False)).withColumn("at", F.timestamp_seconds(F.lit(10**9)))
    flush = {"in_speech": False, "end": True}
    make = lambda s: stateful.stateful(s, live.segments(3, 4), stateful.SEGMENT_STATE, live.SEGMENT, flush=flush, idle=60_000, time="at")
    got = run_parts(spark, tmp_path, [df.where("seq < 11"), df.where("seq >= 11"), late], "session long, seq long, in_speech boolean, end boolean, at timestamp", make, f"session long, seq long, {live.SEGMENT}")
    assert sorted(map(tuple, got.collect())) == want


def test_chunks_flushed_by_silence_equal_batch(spark, tmp_path):
    rows = [(s, i, " ".join(f"w{k}." if k % 4 == 3 else f"w{k}" for k in range(i + 1))) for s in range(2) for i in range(10)]
    df = spark.createDataFrame(rows, "session long, seq long, hypothesis string").withColumn("vad_boundary", F.lit(False)).withColumn("at", F.timestamp_seconds(F.col("seq") + 1000))
    late = spark.createDataFrame([(-1, 0, "")], "session long, seq long, hypothesis string").withColumn("vad_boundary", F.lit(False)).withColumn("at", F.timestamp_seconds(F.lit(10**9)))
    machine = jobs_closing(speech.chunker(80))
    end = df.where("seq = 9").withColumn("seq", F.lit(10).cast("long")).withColumn("vad_boundary", F.lit(True))
    want = sorted(map(tuple, speech.fold(df.unionByName(end).drop("at"), machine, speech.CHUNK).collect()))
    make = lambda s: stateful.stateful(s, machine, f"{stateful.CHUNK_STATE}, last string", speech.CHUNK, flush={"hypothesis": None, "vad_boundary": True}, idle=5_000, time="at")
    got = run_parts(spark, tmp_path, [df.where("seq < 4"), df.where("seq >= 4"), late], "session long, seq long, hypothesis string, vad_boundary boolean, at timestamp", make, f"session long, seq long, {speech.CHUNK}")
    assert sorted(map(tuple, got.collect())) == want and want[-1][3] == "w8 w9"


def jobs_closing(machine):
    """A chunker whose boundary without a text closes the last hypothesis."""

    def step(state, row):
        text = row["hypothesis"] if row["hypothesis"] is not None else state.get("last")
        state["last"] = text
        return machine(state, {**row, "hypothesis": text})

    return step


def test_settled_chunks_are_bounded_and_whole(spark):
    step, state, whole, told = stateful.settling(str.strip, 3), {}, {}, []
    full = speech.sliding(str.strip, 3)
    for i in range(50):
        out = step(state, {"text": f"chunk {i}"})[0]
        told += out["settled"]
        want = full(whole, {"text": f"chunk {i}"})[0]
        assert (out["start_index"], out["refined_text"]) == (want["start_index"], want["refined_text"])
        assert speech.join_chunks([*told, out["refined_text"]]) == want["transcript"]
        assert len(state["window"]) <= 3 and set(state) == {"window", "first"}
    assert step(state, {"text": "", "end": True}) == [{"start_index": 50, "refined_text": "", "settled": ["chunk 47 chunk 48 chunk 49"]}] and step(state, {"end": True}) == []
    with pytest.raises(ValueError):
        step(state, {"text": " "})


def test_a_clock_timer_flushes_a_silent_session(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "session long, seq long, text string")
    files.write_jsonl(rows.coalesce(1), str(tmp_path / "in"))
    stream = live.read_new(spark, str(tmp_path / "in"), "session long, seq long, text string")
    out = stateful.stateful(stream, stateful.settling(), stateful.SETTLE_STATE, stateful.SETTLED, flush={"end": True}, idle=1_500, ttl=600_000)
    query = out.writeStream.format("json").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start(str(tmp_path / "out"))
    try:
        for _ in range(60):
            query.awaitTermination(1)
            got = spark.read.schema(f"session long, seq long, {stateful.SETTLED}").json(str(tmp_path / "out")).orderBy("seq").collect() if (tmp_path / "out" / "_spark_metadata").exists() else []
            if len(got) == 3:
                break
    finally:
        query.stop()
    assert [(r.seq, r.start_index, r.settled) for r in got] == [(0, 0, []), (1, 0, []), (2, 2, ["a b"])]


def test_rubrics_are_read_whole_or_not_at_all(spark):
    question = {"id": "q", "category": "content", "question": "?", "evidence": "e", "options": [{"text": "a", "score": 1}, "b（-2）"]}
    sample = {"source_record_id": "s", "audio": "a", "scene": "x", "oral": "o", "clean": "c", "qa": [question]}
    assert rubric.read_sample(json.dumps(sample))[1][0]["options"] == [("a", 1), ("b", -2)]
    assert rubric.read_options(" 很好 （ 2 ） , 一般(1)，c, d ( 0 )") == [("很好", 2), ("一般", 1), ("c, d", 0)]
    for options in ("", "a", "a(1) b", [], None, ["a"], [{"text": " ", "score": 1}], [{"text": "a", "score": "1"}], [5], {"text": "a"}):
        with pytest.raises(rubric.RubricError):
            rubric.read_options(options)
    faults = [sample | {"qa": []}, sample | {"oral": " "}, sample | {"qa": [question, question]}, sample | {"qa": [question | {"category": "x"}]}, sample | {"qa": ["q"]}, sample | {"source_record_id": 5}, [sample], "x"]
    rows = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate([sample, *faults])] + [(99, None), (98, "{")], "i int, value string")
    got = {r.i: (r.sample_id, r.question_id, r.violation) for r in rubric.questions(rows).collect()}
    assert got.pop(0) == ("s", "q", None) and len(got) == 10 and all(a is None and b is None and c for a, b, c in got.values())
    assert prompts.listed({"system_prompts": {"zh": "a", "_note": "b", "en": "c"}}) == ["zh", "en"]
    good, bad = evaluate.parted(spark.createDataFrame([(1, "a"), (2, " "), (3, None)], "i int, t string"), t=F.col("t"))
    assert [r.i for r in good.collect()] == [1] and sorted((r.i, r.violations) for r in bad.collect()) == [(2, ["t"]), (3, ["t"])]


def test_padding_goes_before_samples_become_rows(spark):
    """Windows behind a wave's end are dropped as windows: the join with the lengths is below the explode."""
    from scriptorium.plans.jobs import wave_samples

    plan = wave_samples(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("Generate") < plan.index("Join")

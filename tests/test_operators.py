import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import curate, dedup, evaluate, finalize, models, prompts
from scriptorium.streaming import live, speech


def grams(t):
    t = t.strip()
    return {t[i : i + 3] for i in range(len(t) - 2)} if len(t) >= 3 else {t}


def test_near_dedup_equals_sequential_pass(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abc ") for _ in range(30)) for _ in range(12)]
    texts = ["", "", "  ", " "] + [b[: rng.randint(24, 30)] + rng.choice(["", "x", "yz"]) for b in base for _ in range(5)]
    kept = []
    for i, t in enumerate(texts):
        if not t or not any(texts[k] and len(grams(t) & grams(texts[k])) / len(grams(t) | grams(texts[k])) >= 0.75 for k in kept):
            kept.append(i)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    for n in (1, 5):
        assert sorted(r.id for r in dedup.near_dedup(rows.repartition(n), "id", "t").collect()) == kept


def test_batches_meet_what_is_retained(spark, tmp_path):
    rng = random.Random(13)
    base = ["".join(rng.choice("abc ") for _ in range(30)) for _ in range(12)]
    texts = ["", None, "  "] + [rng.choice(base)[: rng.randint(23, 30)] + rng.choice(["", "x", "yz"]) for _ in range(90)] + ["", " "]
    kept = []
    for i, t in enumerate(texts):
        if not t or not any(texts[k] and len(grams(t) & grams(texts[k])) / len(grams(t) | grams(texts[k])) >= 0.75 for k in kept):
            kept.append(i)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    held, got = dedup.Retained(spark, str(tmp_path / "r")), []
    for k, (a, b) in enumerate(((0, 5), (5, 6), (6, 40), (40, 60), (60, 60), (60, len(texts)))):
        part = rows.where(F.col("id").between(a, b - 1))
        if k == 3:  # a batch that dies before its commit is sent again

            def die(name):
                if name == "pointer":
                    raise RuntimeError

            with pytest.raises(RuntimeError):
                dedup.Retained(spark, str(tmp_path / "r"), step=die).add(part, k)
        found = sorted(r.id for r in held.add(part, k).collect())
        assert found == sorted(r.id for r in held.add(part, k).collect())
        got += found
    assert sorted(got) == kept


def test_greedy_on_a_path(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert [r.id for r in dedup.greedy(edges).collect()] == [2]
    assert dedup.greedy(edges.limit(0)).count() == 0


def test_split_sizes(spark):
    for n, want in ((4, 0), (5, 1), (6, 1), (7, 1), (20, 3)):
        rows = spark.range(n)
        assert curate.split(rows, F.col("id"), [F.lit("s")]).where("part = 'val'").count() == want
    assert curate.split(spark.range(6), F.col("id"), []).where("part = 'val'").count() == 0


def test_first_passing(spark):
    rows = spark.createDataFrame([("a", i, i % 2 == 1) for i in range(10)], "scene string, ord long, ok boolean")
    got = sorted((r.ord, r.kept) for r in curate.first_passing(rows, F.col("ok"), F.lit(2), width=3).collect())
    assert got == [(0, False), (1, True), (2, False), (3, True)]


def test_precheck_and_verdict(spark):
    cases = [("x" * 10, "y" * 41, "abnormal expansion: input=10 refined=41"), ("x" * 10, "y" * 40, None), ("x" * 100, "y" * 150, None), ("", "y", "input or refined_text is empty"), ("ab", "ab", "input is too short to contain substantive content: 'ab'"), ("'\n", "ab", "input is too short to contain substantive content: \"'\\n\"")]
    rows = spark.createDataFrame([(a, b) for a, b, _ in cases], "a string, b string")
    assert [r.x for r in rows.select(curate.precheck(F.col("a"), F.col("b")).alias("x")).collect()] == [c[2] for c in cases]
    said = ['{"pass": false}', "{}", "True.", "false", "maybe", '{"pass": "false"}', '{"pass": false, "detail": {"pass": true}}', None]
    rows = spark.createDataFrame([(s,) for s in said], "s string")
    got = [tuple(r.x) for r in rows.select(curate.verdict(F.col("s")).alias("x")).collect()]
    assert [ok for ok, _ in got] == [False, True, True, False, False, True, False, False]
    assert got[4][1] == got[7][1] == "unparseable QC response"


def test_assemble(spark):
    schema = "id long, scene string, language string, input string, oral_text string, clean_text string, refined_text string, keyword_list array<string>, meta struct<language:string,is_fragment:boolean,asr_mode:string,note:int>"
    rows = spark.createDataFrame([(1, "english_x", None, "an input", None, "clean text", "", ["GPT"], ("fr", True, "mine", 3)), (2, "s", None, "", "o", "c", "r", None, None)], schema)
    a, b = curate.assemble(rows).orderBy("id").collect()
    assert (a.reason, a.output.refined_text, a.oral_text, a.meta.language, a.meta.scene) == (None, "clean text", "an input", "fr", "english_x")
    assert (a.meta.is_fragment, a.meta.asr_mode, a.meta.note, a.meta.speech_phenomena, a.meta.keyword_mode) == (True, "mine", 3, [], "review_targets")
    assert b.reason == "skipped_empty" and b.meta.is_fragment is False
    a, b = curate.assemble(rows.withColumn("oral_text", F.lit("an oral text")), from_simulation=False).orderBy("id").collect()
    assert (a.input, a.meta.asr_mode, a.meta.is_fragment, b.meta.asr_mode, b.meta.language) == ("an oral text", "mine", True, "clean_fallback", "zh")


def test_simulate_modes(spark):
    rows = spark.createDataFrame([(i, "s", f"oral ({i})", f"clean {i}", ["clean"] if i == 0 else []) for i in range(40)] + [(99, "s", "", "x", [])], "id long, scene string, oral_text string, clean_text string, speech_phenomena array<string>")
    plain = {r.id: r for r in curate.simulate(rows).collect()}
    assert len(plain) == 40 and plain[0].input == "clean 0" and plain[1].input == "oral 1" and not plain[1].meta.is_fragment
    fails = lambda x: x.withColumn("said", F.when(F.col("id") > 9, F.lit("heard"))).withColumn("wanted", F.lit(None).cast("string"))
    spoken = {r.id: r for r in curate.simulate(rows, "tts_asr", call=fails).collect()}
    assert (spoken[5].input, spoken[5].meta.asr_fallback_text_sim, spoken[20].input, spoken[20].meta.asr_fallback_text_sim) == ("oral 5", True, "heard", False)
    with pytest.raises(Exception, match="tts_asr failed"):
        curate.simulate(rows, "tts_asr", call=fails, fallback=False).collect()
    told = {r.id: r for r in curate.simulate(rows, "llm_sim", call=lambda x: x.withColumn("said", F.lit("said")).withColumn("wanted", F.lit("wanted"))).collect()}
    drawn = {k for k, r in told.items() if r.meta.is_fragment}
    assert 0 < len(drawn) < 30 and all((told[k].input, told[k].clean_text) == (("said", "wanted") if k in drawn else (f"oral ({k})", f"clean {k}")) for k in range(1, 40))
    with pytest.raises(ValueError):
        curate.simulate(rows, "llm_sim")


def test_distribution_marks(spark):
    rows = spark.createDataFrame([("a", "zh", True), ("a", None, None), (None, "en", False)], "s string, l string, f boolean")
    got = {(r.kind, r.value): r.n for r in curate.distribution(rows, F.col("s"), F.col("l"), F.col("f")).collect()}
    assert got == {("total", ""): 3, ("scene", "a"): 2, ("scene", "unknown"): 1, ("language", "zh"): 1, ("language", "en"): 1, ("language", "unknown"): 1, ("is_fragment", "True"): 1, ("is_fragment", "False"): 2}


def test_first_n(spark):
    rows = spark.createDataFrame([("ab"[i % 2], i) for i in range(40)], "scene string, ord long")
    got = sorted(r.ord for r in curate.first_n(rows, F.lit(5), width=4).collect())
    assert got == list(range(10))


def test_judging(spark):
    options = [("bad", -1), ("good", 2)]
    schema = "sample_id string, audio string, scene string, question_id string, category string, question string, evidence string, oral string, clean string, output string, options array<struct<text:string,score:int>>, asr_error string"
    asked = spark.createDataFrame([(s, "a", "sc", q, "content", "q?", 'e"', "o", "c", None if s == "y" else "out", options, "gone" if s == "y" else None) for s in "xyz" for q in ("1", "2")], schema)
    said = spark.createDataFrame([("x", "1", 1), ("x", "2", 0), ("y", "1", 1), ("y", "2", 1), ("z", "1", 0)], "sample_id string, question_id string, option_index int")
    rows = sorted(evaluate.judge_rows(asked, said, "m", "m@1").collect(), key=lambda r: (r.sample_id, r.question_id))
    assert [(r.sample_id, r.question_id, r.selected_option, r.score, r.max_score, r.status) for r in rows] == [("x", "1", "good", 2, 2, "success"), ("x", "2", "bad", -1, 2, "success"), ("y", "1", "good", 2, 2, "success"), ("y", "2", "good", 2, 2, "success")]
    value = {"oral": "o", "clean": "c", "output": "", "question": "q?", "evidence": 'e"', "category": "content", "options": [{"text": t, "score": n} for t, n in options]}
    digest = lambda v: hashlib.sha256(json.dumps(v, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
    assert (rows[2].content_signature, rows[2].evaluation_signature) == (digest(value), digest({"judge_model": "m@1", **value}))
    assert rows[2].asr_retry_exhausted and rows[2].asr_error == "gone" and rows[0].asr_retry_exhausted is None
    # resume: results count while their signature is current
    questions = asked.select("sample_id", "question_id", F.when(F.col("sample_id") == "y", "new").otherwise("old").alias("signature"))
    results = spark.createDataFrame([("x", "1", "failed", "old", 1), ("x", "1", "success", "old", 2), ("x", "2", "success", "old", 3), ("y", "1", "success", "old", 4), ("y", "2", "success", "new", 5), ("z", "1", "failed", "old", 6)], "sample_id string, question_id string, status string, signature string, ord long")
    assert [r.sample_id for r in evaluate.finished(evaluate.with_results(questions, results)).collect()] == ["x"]


def test_scores(spark):
    rows = spark.createDataFrame([("a", "filter", "s", "success", 1, None, None), ("b", "content", "s", "success", -2, 2, True), ("c", "content", "t", "failed", 2, 2, True), ("c", "format", "t", "success", None, 2, True)], "sample_id string, category string, scene string, status string, score int, max_score int, asr_retry_exhausted boolean")
    got = [tuple(r) for r in evaluate.summary(rows).collect()]
    assert got == [("overall", "", 2, -1, 4, 0.0), ("category", "content", 1, -2, 2, 0.0), ("category", "filter", 1, 1, 2, 0.5), ("scene", "s", 2, -1, 4, 0.0)]
    assert tuple(evaluate.run_counts(rows).first()) == (1, 3, 2)
    assert [tuple(r) for r in evaluate.summary(rows.limit(0)).collect()] == [("overall", "", 0, 0, 0, 0.0)]
    m = "m struct<wer_errors:int,wer_units:int,cer_errors:int,cer_units:int,mer_errors:int,mer_units:int>"
    rates = evaluate.error_rates(spark.createDataFrame([((1, 2, 1, 4, 0, 0), None), ((1, 2, 0, 4, 3, 0), None)], f"{m}, latency_ms double")).first()
    assert (rates.wer, rates.cer, rates.mer, rates.mer_errors, rates.mean_latency_ms, rates.missing_latency) == (0.5, 0.125, 0.0, 3, 0.0, 2)


def test_finalize(spark):
    text = lambda s, i: f"{hashlib.md5(f'{s}{i}'.encode()).hexdigest()} {s}"
    rows = [(i, s, i, text(s, i - i % 2 if i == 9 else i), (f"refined {i}",), (s, "zh", None)) for s in ("vibe_coding", "odd") for i in range(30)]  # 9 copies 8
    df = spark.createDataFrame(rows, "id long, scene string, ord long, input string, output struct<refined_text:string>, meta struct<scene:string,language:string,is_fragment:boolean>")
    df = df.withColumn("ord", F.col("ord") + F.when(F.col("scene") == "odd", 100).otherwise(0))
    kept, rejected = finalize.finalize(df, 100, F.when(F.col("id") % 2 == 0, '{"pass": true}').otherwise('{"pass": 0, "reason": "odd"}'))
    assert {s: sorted(r.id for r in kept.collect() if r.scene == s) for s in ("vibe_coding", "odd")} == {"vibe_coding": list(range(0, 24, 2)), "odd": [0, 2, 4, 6, 8]}
    assert {(r.scene, r.qc_reason) for r in rejected.collect()} == {("vibe_coding", "odd"), ("odd", "odd")} and rejected.where("scene = 'odd'").count() == 4
    final = finalize.final_rows(kept)
    assert final.columns == ["input", "output", "meta"]
    doc = finalize.statistics(final, 100)
    assert (doc["total_samples"], doc["coverage"], doc["distribution"]["is_fragment"]) == (17, 0.17, {"False": 17})
    assert any(w.startswith("vibe_coding: target=12.00%, actual=70.59%") for w in doc["warnings"])
    c = finalize.coverage(df, kept, 100).first()
    assert (c.before, c.after, c.coverage) == (60, 17, 0.17)
    assert finalize.finalize(df, 100)[0].count() == 12 - 1 + 5  # the first of each scene, less one copy


def test_seed_helpers(spark):
    rows = [("s", "b", 50, "x" * 30), ("s", "b", 51, "y"), ("s", "b", 52, '{"artist": "' + "z" * 30 + '"}'), *[("s", "a", 10 + i, f"w{i}") for i in range(9)], ("s", "c", 70, None)]
    seeds = spark.createDataFrame(rows, "scene string, category string, ord long, seed string")
    assert curate.exclusion_hint(seeds).first().hint == "a: w0, w1, w2, w3, w4...\nb: " + "x" * 20 + ", y, " + "z" * 30 + "..."
    assert curate.exclusion_hint(seeds, most=1).first().hint == "a: w0, w1, w2, w3, w4..."
    words = spark.range(1).select(curate.seed_list(F.array(*[F.lit(f"w{i % 40}") for i in range(80)]), F.col("id")).alias("x")).first().x
    assert len(set(words.split(", "))) == 30
    assert [(r.have, r.rounds) for r in curate.seed_rounds(seeds.select("scene").limit(3), 1000, 200).collect()] == [(3, 5)]


def test_prompts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(prompts.render("a {x} {{y}} {x}{z}", x=F.lit("{z}"), z=F.lit(None))) == "a {z} {y} {z}None"
    with pytest.raises(KeyError):
        prompts.render("{no}")
    q = F.array(F.struct(F.lit("1").alias("id"), F.lit("content").alias("category"), F.lit('q"').alias("question"), F.lit("e").alias("evidence"), F.array(F.struct(F.lit("a").alias("text"), F.lit(2).alias("score"))).alias("options")))
    want = {"oral": "o\n", "clean": "中", "output": "x", "qa": [{"id": "1", "category": "content", "question": 'q"', "evidence": "e", "options": [{"option_index": 0, "text": "a"}]}]}
    assert one(prompts.judge_prompt(F.lit("o\n"), F.lit("中"), F.lit("x"), q)) == json.dumps(want, ensure_ascii=False)


def test_seed_blocks(spark):
    seeds = spark.createDataFrame([("s", f"w{i}") for i in range(12)], "scene string, seed string")
    got = curate.seed_blocks(seeds, 5).collect()
    assert sorted(r.block for r in got) == [0, 1, 2, 3, 4] and all(len(set(r.seeds)) == 5 for r in got)


def test_latest_and_match(spark):
    rows = spark.createDataFrame([("a", 1, True, None), ("a", 2, False, "x"), ("b", 3, False, "input_error: y"), (None, 4, True, None)], "k string, ord long, ok boolean, error string")
    assert [r.k for r in evaluate.completed(rows, "k", "ord").collect()] == ["b"]
    questions = spark.createDataFrame([("s", "q1", [("a", 1), ("b", 2)]), ("s", "q2", [("a", 1)])], "sample_id string, question_id string, options array<struct<text:string,score:int>>")
    answers = spark.createDataFrame([("s", "q1", 2), ("s", "q3", 0)], "sample_id string, question_id string, option_index int")
    assert sorted((r.question_id, r.reason) for r in evaluate.answer_errors(questions, answers).collect()) == [("q1", "range"), ("q2", "missing"), ("q3", "unknown")]


def test_chunker_cases():
    step = speech.chunker(80)
    s = {}
    assert [x["text"] for x in step(s, {"hypothesis": "Hi there. How", "vad_boundary": False})] == ["Hi there."]
    assert [x["text"] for x in step(s, {"hypothesis": "Hi there. How are", "vad_boundary": True})] == ["How are"]
    assert [x["text"] for x in speech.chunker(80)({}, {"hypothesis": "pi is 3.14", "vad_boundary": True})] == ["pi is 3.", "14"]
    assert [x["text"] for x in speech.chunker(5)({}, {"hypothesis": "abcdefgh", "vad_boundary": False})] == ["abcde"]
    assert [x["text"] for x in speech.chunker(5)({}, {"hypothesis": "ab,cdefg", "vad_boundary": False})] == ["ab,"]
    s = {}
    step(s, {"hypothesis": "A. b", "vad_boundary": False})
    assert speech.chunker(80, "report")(s, {"hypothesis": "X. b", "vad_boundary": False})[0]["error"] == "revised"


def test_vad_and_sliding():
    step, s = speech.energy_vad(), {}
    got = [step(s, {"rms": 0.1 if i < 7 else 0.0, "duration": 0.032})[0] for i in range(23)]
    assert [i for i, g in enumerate(got) if g["in_speech"]] == list(range(6, 22)) and got[-1]["segment"] == 1
    step, s = speech.sliding(), {}
    out = [step(s, {"text": c})[0] for c in "abcd"]
    assert [o["start_index"] for o in out] == [0, 0, 0, 1] and out[-1]["transcript"] == "a b c d"


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{k}", i, f"Word {i}. more {k}", i % 3 == 2) for k in range(3) for i in range(6)], "session string, seq long, hypothesis string, vad_boundary boolean")
    rows = rows.withColumn("hypothesis", F.when(F.col("seq") % 3 == 0, F.col("hypothesis")).otherwise(F.concat(F.lit("Word "), (F.col("seq") - F.col("seq") % 3).cast("string"), F.lit(". more and"))))
    machine = speech.chunker(80, "report")
    want = sorted(map(tuple, speech.fold(rows, machine, speech.CHUNK).collect()), key=str)
    rows.repartition(1).sortWithinPartitions("seq").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = speech.fold_stream(stream, machine, speech.CHUNK).writeStream.format("memory").queryName("chunks").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("chunks").collect()), key=str) == want


def test_models(spark):
    rows = spark.createDataFrame([(1, " a "), (2, None)], "id long, t string")
    got = {r.id: r for r in models.refine_batches(rows, "t", models.identity).collect()}
    assert got[1].clean_text == "a" and got[1].ok and got[2].error.startswith("input_error:")
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError
        return "x"

    assert models.retried(flaky, 3, lambda k: 0)() == "x" and len(calls) == 3


def test_judge_retries_and_all_or_nothing(spark):
    q = "array<struct<id:string,question:string,options:array<struct<text:string,score:int>>>>"
    options = [("a", 0), ("b", 1)]
    rows = spark.createDataFrame([("s", "good", [("1", "?", options), ("2", "?", options)]), ("t", "bad", [("1", "?", options)])], f"sample_id string, output string, questions {q}")

    def ask(text, questions):
        return [(x["id"], 1 if text == "good" else True) for x in questions]

    got = sorted(map(tuple, models.judge(rows, ask, wait=lambda k: 0).collect()), key=str)
    assert got[:2] == [("s", "1", 1, None), ("s", "2", 1, None)] and len(got) == 3 and got[2][:3] == ("t", None, None) and "JudgeError" in got[2][3]
    for wrong in ([], [("1", 0), ("1", 0)], [("9", 0)], [("1", 2)], [("1", -1)], [("1", True)]):
        with pytest.raises(models.JudgeError):
            models.checked_answers(wrong, [{"id": "1", "options": options}])


def test_segments_open_feed_flush():
    step, state = live.segments(preroll=2, tail=3), {}
    speech_ = [False, False, False, True, True, False, False, True]
    got = [[(x["segment"], x["action"], x["first"], x["last"]) for x in step(state, {"in_speech": s, "end": i == 7})] for i, s in enumerate(speech_)]
    assert got[3] == [(0, "open", 1, 2), (0, "feed", 3, 3)] and got[5] == [(0, "feed", 5, 5), (0, "flush", 6, 8)] and got[6] == []
    assert got[7] == [(1, "open", 5, 6), (1, "feed", 7, 7), (1, "flush", 8, 10)]


def test_refined_chunks():
    step, state = live.refined_chunks(80, 2), {}
    assert step(state, {"hypothesis": "One. tw", "vad_boundary": False})[-1]["transcript"] == "One."
    out = step(state, {"hypothesis": "One. two. three", "vad_boundary": True})
    assert [x["start_index"] for x in out] == [0, 1] and out[-1]["transcript"] == "One. two. three"


def test_tone_is_a_stream(spark):
    assert live.tone(spark).isStreaming


def test_local_refiner_strips_markers():
    refine = models.local_refiner(models.echo, "<|im_start|>assistant\n{text}</s>")()
    assert refine([" hi ", "{text}"]) == ["hi", "{text}"]


def test_similar_sets_are_compared_without_a_shuffle_of_pairs(spark, tmp_path):
    """Grams with and without a bit of their own, folded maps of many widths: the pairs of plain sets; no pair is shuffled with its sets."""
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh 日本") for _ in range(k)) for k in (5, 40, 200, 700, 2000)]
    texts = list(dict.fromkeys(b[: len(b) - rng.randint(0, len(b) // 3)] + rng.choice("xyz") for b in base for _ in range(12)))
    rows = spark.createDataFrame([(i, "", t) for i, t in enumerate(texts)], "id long, digest string, text string")
    want = {(i, j) for j in range(len(texts)) for i in range(j) if len(grams(texts[i]) & grams(texts[j])) / len(grams(texts[i]) | grams(texts[j])) >= 0.75}
    for order in ([], dedup.gram_order(rows)[:100]):
        sets = dedup.gram_sets(rows, order)
        at = str(tmp_path / str(len(order)))
        sets.write.parquet(at)
        sets = spark.read.schema(sets.schema).parquet(at)
        found = dedup.similar_to(sets, dedup._files(sets), 0.75, len(order), True)
        assert {(r.a, r.b) for r in found.collect()} == want and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_near_copies_give_few_pairs(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    base = "".join(rng.choice(letters) for _ in range(80))
    texts = [base[:k] + letters[i % 26] + base[k:] for i, k in enumerate(rng.randint(0, 80) for _ in range(60))]
    texts = list(dict.fromkeys(texts + ["".join(rng.choice("ab ") for _ in range(rng.randint(5, 12))).strip() for _ in range(60)]))
    near = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.75
    for most in (1, 3):
        monkeypatch.setattr(dedup, "MOST", most)
        rows = spark.createDataFrame([(i, str(i), t) for i, t in enumerate(texts)], "id long, digest string, text string")
        sets = dedup.gram_sets(rows, dedup.gram_order(rows))
        sets.write.parquet(str(tmp_path / f"sets{most}"))
        sets = spark.read.parquet(str(tmp_path / f"sets{most}"))
        pairs = sorted((r.b, r.a) for r in dedup.similar_to(sets, dedup._files(sets), 0.75, dedup.RANKED, True).collect())
        assert pairs == [(j, i) for j, b in enumerate(texts) for i in [i for i in range(j) if near(texts[i], b)][: most + 1]]
        kept = []
        for i, t in enumerate(texts):
            if not any(near(texts[k], t) for k in kept):
                kept.append(i)
        held = dedup.Retained(spark, str(tmp_path / f"r{most}"))
        assert sorted(r.id for r in held.add(rows.select("id", "text"), 0).collect()) == kept
        assert sorted(p.name for p in (tmp_path / f"r{most}").iterdir() if not p.name.startswith(".")) == ["order.json", "retained"]
    # keys of another kind, of different lengths
    named = spark.createDataFrame([(f"{'x' * (i % 3)}{i}", t) for i, t in enumerate(texts)], "id string, t string")
    by, kept = {f"{'x' * (i % 3)}{i}": t for i, t in enumerate(texts)}, []
    for i in sorted(by):
        if not any(near(by[k], by[i]) for k in kept):
            kept.append(i)
    assert sorted(r.id for r in dedup.near_dedup(named, "id", "t").collect()) == kept

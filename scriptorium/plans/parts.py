"""Queries of single steps: folders of scenes, contracts and violations, signatures, retries, limits, retracted hypotheses, rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions import text as T
from ..operators import curate, evaluate, generators, models, rubric
from ..sources import admin, files
from ..streaming import speech
from .catalog import place, query, table
from .registry import _STRIP, _ascii, _pairs
from .registry import _PAIRS as PAIRS

# --- folders of scenes ---


@query("SELECT lang AS scene, doc_id, CASE WHEN lang IN ('en', 'fr') THEN 'asr_sim' ELSE 'clean' END AS stage FROM documents WHERE lang IS NOT NULL")
def preferred_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each language, all with clean records, some with simulated ones, which are preferred."""
    at, docs = place(spark, "raw"), table(spark, sf_dir, "documents").where("lang IS NOT NULL").select("doc_id", "lang")
    for scene in sorted(r.lang for r in docs.select("lang").distinct().collect()):
        own = docs.where(F.col("lang") == scene).select("doc_id")
        for stage in ("asr_sim", "clean") if scene in ("en", "fr") else ("clean",):
            files.write_jsonl(own.withColumn("stage", F.lit(stage)), f"{at}/{scene}/{stage}.jsonl")
    out = spark.createDataFrame([], "scene string, doc_id long, stage string")
    for scene in files.scenes_with(spark, at, "clean.jsonl"):
        found = files.read_jsonl(spark, files.preferred(spark, f"{at}/{scene}"), "doc_id long, stage string")
        out = out.unionByName(found.withColumn("scene", F.lit(scene)))
    return out


@query("SELECT doc_id, text, 'part-' || lang AS scene FROM documents WHERE lang IS NOT NULL")
def scenes_of_a_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files of a folder, a file a language, with the file's stem as scene."""
    at, docs = place(spark, "scenes"), table(spark, sf_dir, "documents").where("lang IS NOT NULL").select("doc_id", "text", "lang")
    for name in sorted(r.lang for r in docs.select("lang").distinct().collect()):
        files.write_jsonl(docs.where(F.col("lang") == name).select("doc_id", "text").coalesce(1), f"{at}-parts/{name}")
        part = next(x for x in files.children(spark, f"{at}-parts/{name}") if x.startswith("part-"))
        files.rename(spark, f"{at}-parts/{name}/{part}", f"{at}/part-{name}.jsonl")
    return files.read_scenes(spark, at, "doc_id long, text string")


# --- contracts ---


@query(rf"""SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'role' WHEN turn % 4 = 1 THEN 'role,text' ELSE 'text' END AS fields FROM conversations WHERE turn % 4 < 3""")
def input_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose role or text is missing or blank."""
    k = F.col("turn") % 4
    rows = table(spark, sf_dir, "conversations").withColumn("role", F.when(k == 0, None).when(k == 1, " \t").otherwise(F.col("role"))).withColumn("text", F.when((k == 1) | (k == 2), "\n").otherwise(F.col("text")))
    return evaluate.violations(rows, role=F.col("role"), text=F.col("text")).select("conv_id", "turn", F.array_join("violations", ",").alias("fields"))


@query("""SELECT item_id::VARCHAR AS sample_id, 'q0' AS id, CASE item_id % 4 WHEN 0 THEN 'duplicate id' WHEN 1 THEN 'category' ELSE 'options' END AS reason FROM benchmark WHERE item_id % 4 < 3""")
def rubric_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of all items: one is there twice, one has an unknown category, one no options, one is right."""
    k = F.col("item_id") % 4
    options = F.when(k == 2, F.array().cast("array<string>")).otherwise(F.array("text"))
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("sample_id"), F.lit("q0").alias("id"), F.when(k == 1, F.col("text")).otherwise("content").alias("category"), options.alias("options"), k.alias("k"))
    return evaluate.question_violations(rows.drop("k").unionByName(rows.where("k = 0").drop("k")))


@query("""SELECT item_id, CASE WHEN item_id % 8 < 4 THEN 'q' || i END AS question_id, CASE WHEN item_id % 8 < 4 THEN text END AS question,
CASE item_id % 8 WHEN 0 THEN 'good=2;bad=-1' WHEN 1 THEN '很好=2;一般=1' WHEN 2 THEN 'a, b=1' WHEN 3 THEN 'x=3;y=0' END AS options,
CASE item_id % 8 WHEN 4 THEN 'no evidence' WHEN 5 THEN 'a question twice' WHEN 6 THEN 'options that can''t be read' WHEN 7 THEN 'unknown category other' END AS violation
FROM benchmark, range(2) r(i) WHERE item_id % 8 < 4 OR i = 0""")
def rubric_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rubrics whose questions are the items' texts, with options in four forms; half of the samples have a fault."""
    k = F.col("item_id") % 8
    pair = lambda text, score: F.struct(F.lit(text).alias("text"), F.lit(score).alias("score"))
    forms = F.when(k == 0, F.to_json(F.array(pair("good", 2), pair("bad", -1)))).when(k == 1, R.json_text(F.lit("很好（2），一般(1)"))).when(k == 2, F.lit('["a, b(1)"]'))
    forms = forms.when(k == 6, R.json_text(F.lit("x(1) rest"))).otherwise(F.lit('["x (3)", {"text": "y", "score": 0}]'))

    def one(i: int):
        name = F.when((k == 5) | F.lit(i == 0), "q0").otherwise(f"q{i}")
        fields = [("id", R.json_text(name)), ("category", R.json_text(F.when(k == 7, "other").otherwise("content"))), ("question", R.json_text(F.col("text"))), ("evidence", R.json_text(F.when(k == 4, " ").otherwise("e"))), ("options", forms)]
        return F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{n}": '), c) for n, c in fields]), F.lit("}"))

    head = F.concat(F.lit('{"source_record_id": "'), F.col("item_id").cast("string"), F.lit('", "audio": "a", "scene": "s", "oral": "o", "clean": "c", "qa": ['))
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.concat(head, one(0), F.lit(", "), one(1), F.lit("]}")).alias("value"))
    shown = F.array_join(F.transform("options", lambda o: F.concat(o["text"], F.lit("="), o["score"].cast("string"))), ";")
    return rubric.questions(rows).select("item_id", "question_id", "question", shown.alias("options"), "violation")


@query("SELECT (SELECT count(*) FROM conversations WHERE turn % 4 = 3) AS valid, (SELECT count(*) FROM conversations WHERE turn % 4 <> 3) AS invalid, count(*) AS ready, count(*) FILTER (turn % 2 = 0) AS failed, (SELECT count(*) FROM conversations) - count(*) AS outside FROM conversations WHERE turn % 3 <> 0")
def dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a dry run tells: turns with and without what they need, and samples that are ready, failed or outside."""
    k, name = F.col("turn"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    rows = table(spark, sf_dir, "conversations").withColumn("role", F.when(k % 4 == 0, None).otherwise(F.col("role"))).withColumn("text", F.when((k % 4 == 1) | (k % 4 == 2), "\n").otherwise(F.col("text")))
    good, bad = evaluate.parted(rows, role=F.col("role"), text=F.col("text"))
    outputs = table(spark, sf_dir, "conversations").select(name.alias("k"), F.when(k % 2 != 0, F.col("text")).alias("text"), F.lit("no audio").alias("error"))
    sheet = table(spark, sf_dir, "conversations").select(name.alias("k"), F.when(k % 3 == 0, "failed").otherwise("success").alias("status"), F.array(F.lit(1)).alias("qa"))
    ready = rubric.readiness(evaluate.match(outputs, sheet, "k"), outputs)
    parts = good.agg(F.count(F.lit(1)).alias("valid")).join(bad.agg(F.count(F.lit(1)).alias("invalid")))
    return parts.join(ready)


@query(f"""SELECT doc_id, {_STRIP.format("text")} <> '' AS ok, CASE WHEN coalesce({_STRIP.format("text")}, '') = '' THEN 'input_error: blank text' WHEN length(text) % 5 = 0 THEN 'ValueError: a refiner must return one text for each input' END AS error,
CASE WHEN coalesce({_STRIP.format("text")}, '') = '' OR length(text) % 5 = 0 THEN NULL ELSE {_STRIP.format("text")} END AS clean_text FROM documents""".replace(" <> '' AS ok", " <> '' AND length(text) % 5 <> 0 AS ok"))
def refiner_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A refiner that answers some texts with nothing at all: its row gets the error, others go on."""
    load = lambda: lambda texts: [] if len(texts[0]) % 5 == 0 else [t.strip() for t in texts]
    rows = models.refine_batches(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", load, size=1)
    return rows.select("doc_id", F.when(F.col("text").isNull(), None).otherwise(F.col("ok")).alias("ok"), "error", "clean_text")


# --- results ---


@query("""WITH l AS (SELECT user_id, max(event_id) AS e FROM events WHERE user_id IS NOT NULL GROUP BY user_id) SELECT user_id FROM l WHERE e % 3 IN (0, 1)""")
def completed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose last result is ok, or an error of their input."""
    k = F.col("event_id") % 3
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (k == 0).alias("ok"), F.when(k == 1, "input_error: blank").when(k == 2, "timeout").alias("error"))
    return evaluate.completed(rows, "user_id", "event_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) ORDER BY doc_id LIMIT 50")
def first_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty documents that are not done."""
    return evaluate.pending(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "doc_id", 50).select("doc_id")


@query("""SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'model-' || item_id ELSE 'model-' || item_id || '@' ||
left(sha256('{"api_url": "http://host/v1", "model": "model-' || item_id || '", "system_prompt": ' || to_json(text)::VARCHAR || ', "temperature": 0.5}'), 16) END AS identity FROM benchmark""")
def judge_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge for each item, whose prompt is the item's text; some have the usual settings."""
    k = F.col("item_id")
    model = F.concat(F.lit("model-"), k.cast("string"))
    return table(spark, sf_dir, "benchmark").select("item_id", R.judge_identity(model, F.lit("http://host/v1"), F.col("text"), F.lit("0.5"), k % 3 == 0).alias("identity"))


@query(r"""SELECT conv_id, turn, text AS raw_text, CASE WHEN turn % 2 = 0 THEN turn + 0.5 END::DOUBLE AS stt, CASE WHEN turn % 3 <> 0 THEN 2.0 END::DOUBLE AS llm, CASE WHEN turn % 2 = 0 AND turn % 3 <> 0 THEN turn + 2.5 END::DOUBLE AS total FROM conversations""")
def inference_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The output of each turn, with latencies that are no numbers or negative left out."""
    k = F.col("turn")
    stt, llm = F.when(k % 2 == 0, k + 0.5).otherwise(float("nan")), F.when(k % 3 != 0, 2.0).otherwise(-1.0)
    out = R.result_output(F.col("text"), F.lit(None).cast("string"), F.lit(True), F.lit(None).cast("string"), stt, llm)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", out.alias("o")).select(
        "conv_id", "turn", "o.raw_text", F.col("o.stt_latency_ms").alias("stt"), F.col("o.llm_latency_ms").alias("llm"), F.col("o.total_latency_ms").alias("total"),
    )


_NORMAL = r"trim(regexp_replace(regexp_replace(lower(regexp_replace({0}, '[^ -~]', '', 'g')), '[\p{{P}}\p{{S}}\p{{Z}}]', ' ', 'g'), ' +', ' ', 'g'))"


@query(rf"""WITH {PAIRS}, n AS (SELECT conv_id, turn, {_NORMAL.format("CASE WHEN turn % 3 = 0 THEN '' ELSE source END")} AS r, {_NORMAL.format("CASE WHEN turn % 2 = 0 THEN '' ELSE refined END")} AS h FROM pairs),
c AS (SELECT *, replace(r, ' ', '') AS a, replace(h, ' ', '') AS b FROM n)
SELECT conv_id, turn, round(CASE WHEN length(a) > 0 THEN levenshtein(a, b) / length(a)::DOUBLE WHEN length(b) = 0 THEN 0.0 ELSE 1.0 END, 9) AS rate FROM c""")
def sample_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The character error rate of each pair; without a reference 0 or 1."""
    k = F.col("turn")
    source, refined = F.when(k % 3 == 0, "").otherwise(_ascii(F.col("source"))), F.when(k % 2 == 0, "").otherwise(_ascii(F.col("refined")))
    rows = _pairs(spark, sf_dir).select("conv_id", "turn", T.text_metrics(source, refined, ascii_only=True).alias("m"))
    return rows.select("conv_id", "turn", F.round(T.sample_rate(F.col("m.cer_errors"), F.col("m.cer_units")), 9).alias("rate"))


@query(r"""WITH t AS (SELECT conv_id, turn, lower(regexp_replace(text, '[^ -~]', ' ', 'g')) || ' 中文' || turn || '字' AS t FROM conversations)
SELECT conv_id, turn, len(regexp_extract_all(t, '[㐀-䶿一-鿿]|[a-z0-9]+')) AS n, len(regexp_extract_all(t, '[㐀-䶿一-鿿]+|[a-z0-9]+')) AS words FROM t""")
def token_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many mixed tokens and words a turn has, with Han characters behind its text."""
    text = F.concat(F.lower(F.regexp_replace("text", "[^ -~]", " ")), F.lit(" 中文"), F.col("turn").cast("string"), F.lit("字"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(T.mixed_tokens(text)).cast("long").alias("n"), F.size(T.word_tokens(text)).cast("long").alias("words"))


# --- seeds and streams ---


@query("""WITH s AS (SELECT lang AS scene, source AS seed FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL),
n AS (SELECT scene, count(*) // 5 AS per FROM s GROUP BY scene HAVING count(*) >= 5), c AS (SELECT scene, per, unnest(range(CAST(ceil(12 / per::DOUBLE) AS BIGINT))) AS cycle FROM n),
r AS (SELECT c.scene, per, cycle, seed, row_number() OVER (PARTITION BY c.scene, cycle ORDER BY md5('42:' || cycle || ':' || seed), seed) - 1 AS i FROM c JOIN s USING (scene))
SELECT scene, cycle * per + i // 5 AS block, string_agg(seed, ',' ORDER BY seed) AS seeds FROM r WHERE i // 5 < per AND cycle * per + i // 5 < 12 GROUP BY ALL""")
def seed_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve blocks of five sources for each language, drawn without replacement, shuffled anew in each cycle."""
    seeds = table(spark, sf_dir, "documents").where("lang IS NOT NULL AND source IS NOT NULL").select(F.col("lang").alias("scene"), F.col("source").alias("seed")).distinct()
    return curate.seed_blocks(seeds, 12).select("scene", F.col("block").cast("long").alias("block"), F.array_join("seeds", ",").alias("seeds"))


@query(rf"""WITH s AS (SELECT conv_id, turn, {_STRIP.format("text")} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE length(text) >= 4)
SELECT conv_id, 2 * turn + 1 AS seq, 'revised' AS error FROM s""")
def retracted_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a hypothesis whose first sentence is emitted, and then another that takes it back: reported, and skipped."""
    rows = table(spark, sf_dir, "conversations").where("length(text) >= 4")
    said = rows.select("conv_id", (F.col("turn") * 3).alias("seq"), F.concat(F.lit("Yes. "), T.strip(F.col("text"))).alias("hypothesis"), F.lit(False).alias("vad_boundary"))
    back = rows.select("conv_id", (F.col("turn") * 3 + 1).alias("seq"), F.concat(F.lit("No. "), F.col("text")).alias("hypothesis"), F.lit(False).alias("vad_boundary"))
    end = rows.select("conv_id", (F.col("turn") * 3 + 2).alias("seq"), F.concat(F.lit("Yes. "), T.strip(F.col("text"))).alias("hypothesis"), F.lit(True).alias("vad_boundary"))
    out = speech.fold(said.unionByName(back).unionByName(end), speech.chunker(80, "report"), speech.CHUNK, "conv_id")
    return out.where("error IS NOT NULL").select("conv_id", (2 * F.floor(F.col("seq") / 3) + 1).cast("long").alias("seq"), "error")


@query("SELECT item_id, 'K' || item_id AS name, trim(replace(text, chr(10), ' '), ' ') AS value FROM benchmark")
def environment_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An environment file with a setting for each item, quoted, between comments, some of them set before."""
    at = place(spark, "env")
    value = F.translate(F.replace("text", F.lit("\n"), F.lit(" ")), "'\"", "")
    lines = table(spark, sf_dir, "benchmark").select(F.concat(F.when(F.col("item_id") % 2 == 0, "export K").otherwise("K"), F.col("item_id").cast("string"), F.lit(" = '"), value, F.lit("'")).alias("value"))
    lines.unionByName(spark.createDataFrame([("# K1=none",), ("not a setting",)], "value string")).coalesce(1).write.text(f"{at}/lines")
    part = next(x for x in files.children(spark, f"{at}/lines") if x.startswith("part-"))
    env = {"OWN": "stays"}
    new = admin.load_env(spark, f"{at}/lines/{part}", env)
    rows = [(int(k[1:]), k, v) for k, v in new.items()]
    return spark.createDataFrame(rows, "item_id long, name string, value string")


@query("""SELECT doc_id, left(replace('HTTP 401 key ' || source || ': ' || text, source, '[REDACTED]'), 500) AS told FROM documents WHERE source <> ''""")
def redacted_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors that hold the whole text and, as a key, its source, which must not be told."""
    rows = table(spark, sf_dir, "documents").where("source <> ''")
    return rows.select("doc_id", T.redact(F.concat(F.lit("HTTP 401 key "), "source", F.lit(": "), "text"), F.col("source")).alias("told"))


@query("""SELECT doc_id, CASE WHEN text IS NOT NULL THEN '{"t": ' || to_json(text)::VARCHAR || '}' END AS body FROM documents""")
def braced_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object in an answer that has it in a fence, in prose or alone."""
    body = F.concat(F.lit('{"t": '), R.json_text(F.col("text")), F.lit("}"))
    k = F.col("doc_id") % 3
    said = F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here: "), body, F.lit(" - done."))).otherwise(body)
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text").isNotNull(), R.braced(said)).alias("body"))


@query(rf"""WITH t AS (SELECT conv_id, turn, {_STRIP.format("text")} AS t FROM conversations)
SELECT conv_id, turn, t AS oral_text, CASE WHEN turn % 3 = 1 THEN 'seed a' ELSE 'seed a,seed b' END AS seeds, CASE WHEN turn % 5 = 0 THEN 'clean' WHEN turn % 3 = 1 THEN 'told' ELSE 'sampled' END AS phenomena FROM t WHERE turn % 3 < 2 AND length(t) >= 4""")
def oral_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oral records by a stand-in that answers with the turn's text, with all fields, with the text alone, or with nothing of use."""
    k = F.col("turn")
    seeds = F.array(F.lit("seed a"), F.lit("seed b"))
    head = F.concat(F.lit('{"oral_text": '), R.json_text(F.concat(F.lit(" "), "text", F.lit("\n"))))
    told = F.when(k % 3 == 0, F.concat(head, F.lit("}"))).when(k % 3 == 1, F.concat(F.lit("Sure: "), head, F.lit(', "speech_phenomena": ["told"], "selected_seeds": ["seed a"]}'))).otherwise("no object")
    rows = table(spark, sf_dir, "conversations").select(
        F.struct("conv_id", "turn").alias("id"), F.lit("meeting").alias("scene"), seeds.alias("seeds"), told.alias("prompt"), F.when(k % 5 == 0, F.array(F.lit("clean"))).otherwise(F.array(F.lit("sampled"))).alias("speech_phenomena"),
    )
    out = generators.oral_records(rows, lambda prompt: prompt, attempts=1)
    return out.select("id.conv_id", "id.turn", "oral_text", F.array_join("selected_seeds", ",").alias("seeds"), F.array_join("speech_phenomena", ",").alias("phenomena"))

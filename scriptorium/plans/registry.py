"""All queries over the driver's tables, with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import keywords as K
from ..functions import records as R
from ..functions import text as T
from ..operators import curate, dedup, evaluate, models
from ..sources import files
from ..streaming import speech
from .catalog import QUERIES, SQL, place, query, table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import jobs, parts, records, runs  # noqa: F401 - their queries join the catalogue

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that pass the length rules, by language and length bucket."""
    docs = table(spark, sf_dir, "documents").where(F.length("text") >= 10)
    return docs.groupBy("lang", T.length_bucket(F.col("text")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


#: White space stripped at both ends, and runs of it as one space, for DuckDB.
_STRIP = r"regexp_replace({0}, '^[\s\x0b\x1c-\x1f]+|[\s\x0b\x1c-\x1f]+$', '', 'g')"
_SQUEEZE = "trim(regexp_replace({0}, '[\\s\\x0b\\x1c-\\x1f]+', ' ', 'g'))"
_BUCKET = "CASE WHEN length(text) <= 20 THEN 'short' WHEN length(text) <= 50 THEN 'medium' WHEN length(text) <= 100 THEN 'long' ELSE 'very_long' END"


@query("""
WITH r AS (SELECT source AS scene, lang AS language, CASE doc_id % 3 WHEN 0 THEN 'True' ELSE 'False' END AS mark FROM documents)
SELECT kind, value, count(*) AS n FROM (
  SELECT 'total' AS kind, '' AS value FROM r UNION ALL SELECT 'scene', coalesce(scene, 'unknown') FROM r UNION ALL
  SELECT 'language', coalesce(language, 'unknown') FROM r UNION ALL SELECT 'is_fragment', mark FROM r) GROUP BY kind, value""")
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.when(F.col("doc_id") % 3 == 0, True).when(F.col("doc_id") % 3 == 1, False)
    return curate.distribution(table(spark, sf_dir, "documents"), F.col("source"), F.col("lang"), mark)


@query(f"""
SELECT lang, bucket, count(*) AS n FROM (SELECT lang, {_BUCKET} AS bucket FROM documents) GROUP BY lang, bucket""")
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang", T.length_bucket(F.col("text")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT source AS scene, CASE WHEN coalesce(t, '') = '' THEN 'skipped_empty' WHEN length(t) < 2 OR length(t) < 10 THEN 'skipped_short' ELSE 'kept' END AS reason, count(*) AS n
FROM (SELECT source, trim(text) AS t FROM documents) GROUP BY ALL""")
def assembly_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    reason = F.coalesce(curate.skip_reason(F.col("text"), F.col("text"), F.col("source")), F.lit("kept"))
    return docs.groupBy(F.col("source").alias("scene"), reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_PAIRS = """pairs AS (SELECT u.conv_id, u.turn, u.text AS source, a.text AS refined FROM conversations u JOIN conversations a
ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = rows.withColumn("next_role", F.lead("role").over(w)).withColumn("refined", F.lead("text").over(w))
    return rows.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("source"), "refined")


@query(f"""
WITH {_PAIRS} SELECT reason, count(*) AS n FROM (SELECT CASE WHEN coalesce(source, '') = '' OR coalesce(refined, '') = '' THEN 'input or refined_text is empty'
WHEN length(refined) > length(source) * 1.8 AND length(refined) - length(source) > 30 THEN 'abnormal expansion: input=' || length(source) || ' refined=' || length(refined) WHEN length(trim(source)) <= 2 THEN 'input is too short to contain substantive content: ''' || source || '''' ELSE 'pass' END AS reason FROM pairs) GROUP BY reason""")
def quality_prechecks(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.coalesce(curate.precheck(F.col("source"), F.col("refined")), F.lit("pass"))
    return _pairs(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_JUDGED = "judged AS (SELECT d.doc_id, d.source AS scene, coalesce(l.quality, 0) = 1 AS passed FROM documents d LEFT JOIN labels l USING (doc_id))"


@query(f"""
WITH {_JUDGED} SELECT doc_id, scene FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY doc_id) AS n FROM judged) WHERE n <= 7""")
def first_n_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("scene"))
    return curate.first_n(docs, F.lit(7), "scene", "doc_id")


@query(f"""
WITH {_JUDGED}, s AS (SELECT *, sum(passed::int) OVER (PARTITION BY scene ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS c FROM judged)
SELECT doc_id, scene, passed AS kept FROM s WHERE CASE WHEN passed THEN c <= 5 ELSE c < 5 END""")
def first_n_passing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = docs.join(labels, "doc_id", "left").select("doc_id", F.col("source").alias("scene"), "quality")
    return curate.first_passing(rows, F.coalesce(F.col("quality") == 1, F.lit(False)), F.lit(5), "scene", "doc_id").select("doc_id", "scene", "kept")


@query("""
WITH t(scene, target) AS (VALUES ('en', 0.4::DOUBLE), ('fr', 0.15), ('de', 0.15), ('es', 0.2), ('zh', 0.1)), c AS (SELECT lang AS scene, count(*) AS n FROM documents GROUP BY 1)
SELECT scene, target, coalesce(n, 0) / (SELECT count(*) FROM documents)::DOUBLE AS actual FROM t LEFT JOIN c USING (scene) WHERE abs(coalesce(n, 0) / (SELECT count(*) FROM documents)::DOUBLE - target) > 0.05""")
def scene_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("scene")).agg(F.count(F.lit(1)).alias("n"))
    return curate.drift(counts, {"en": 0.4, "fr": 0.15, "de": 0.15, "es": 0.2, "zh": 0.1})


@query(f"""
WITH r AS (SELECT doc_id, lang, {_BUCKET} AS bucket, row_number() OVER (PARTITION BY lang, {_BUCKET} ORDER BY md5('42:' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY lang, {_BUCKET}) AS n FROM documents)
SELECT doc_id, CASE WHEN k <= (CASE WHEN n >= 5 AND floor(n * 0.15::DOUBLE) = 0 THEN 1 ELSE floor(n * 0.15::DOUBLE) END) THEN 'val' ELSE 'train' END AS part FROM r""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return curate.split(docs, F.col("doc_id"), curate.strata(F.col("lang"), F.col("text"))).select("doc_id", "part")


@query("""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS k, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN k <= floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'train' END AS part FROM r""")
def plain_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.split(table(spark, sf_dir, "documents"), F.col("doc_id"), []).select("doc_id", "part")


@query("""
SELECT doc_id FROM documents WHERE ('0x' || md5('42:' || doc_id)[1:8])::BIGINT < floor(0.2::DOUBLE * 4294967296)""")
def sampled_fifth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(curate.draw(F.col("doc_id"), 0.2)).select("doc_id")


@query("""
SELECT conv_id, turn, trim(regexp_replace(translate(text, '“”‘’「」『』（）【】《》〈〉—…：；、·―()[]{}"''', repeat(' ', 32)), '[\\s\\x0b\\x1c-\\x1f]+', ' ', 'g')) AS input FROM conversations""")
def recognition_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.simulate_recognition(F.col("text")).alias("input"))


_ASCII = "lower(regexp_replace({0}, '[^ -~]', '', 'g'))"


def _ascii(c: Column) -> Column:
    return F.regexp_replace(c, "[^ -~]", "")


@query(f"""
WITH {_PAIRS}, n AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace({_ASCII.format("source")}, '[\\p{{P}}\\p{{S}}\\p{{Z}}]', ' ', 'g'), ' +', ' ', 'g')) AS r,
trim(regexp_replace(regexp_replace({_ASCII.format("refined")}, '[\\p{{P}}\\p{{S}}\\p{{Z}}]', ' ', 'g'), ' +', ' ', 'g')) AS h FROM pairs)
SELECT conv_id, turn, levenshtein(replace(r, ' ', ''), replace(h, ' ', '')) AS cer_errors, length(replace(r, ' ', '')) AS cer_units, len(regexp_extract_all(r, '[a-z0-9]+')) AS wer_units FROM n""")
def character_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = T.text_metrics(_ascii(F.col("source")), _ascii(F.col("refined")), ascii_only=True)
    return _pairs(spark, sf_dir).select("conv_id", "turn", m.alias("m")).select("conv_id", "turn", F.col("m.cer_errors").cast("long").alias("cer_errors"), F.col("m.cer_units").cast("long").alias("cer_units"), F.col("m.wer_units").cast("long").alias("wer_units"))


@query()
def corpus_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir).select(T.text_metrics(F.col("source"), F.col("refined")).alias("m"), F.length("refined").cast("double").alias("latency_ms"))
    return evaluate.error_rates(pairs)


@query("""
WITH c AS (SELECT min(doc_id) AS doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents WHERE text <> '' GROUP BY 2),
g AS MATERIALIZED (SELECT doc_id, list_distinct([t[i:i+2] FOR i IN range(1, greatest(2, length(t) - 1))]) AS g FROM c)
SELECT doc_id, len(g)::BIGINT AS n_grams FROM g""")
def gram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("text") != "")
    first = docs.groupBy(T.strip(F.col("text")).alias("t")).agg(F.min("doc_id").alias("doc_id"))
    return first.select("doc_id", F.size(T.char_ngrams(F.col("t"))).cast("long").alias("n_grams"))


@query("""
WITH RECURSIVE c AS MATERIALIZED (SELECT min(doc_id) AS id, t FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents) WHERE t <> '' GROUP BY t),
g AS MATERIALIZED (SELECT id, unnest(list_distinct([t[i:i+2] FOR i IN range(1, greatest(2, length(t) - 1))])) AS x FROM c),
n AS MATERIALIZED (SELECT id, count(*) AS n FROM g GROUP BY id),
f AS MATERIALIZED (SELECT x, count(*) AS df FROM g GROUP BY x),
p AS MATERIALIZED (SELECT g.id, g.x, n.n, row_number() OVER (PARTITION BY g.id ORDER BY f.df, g.x) AS k FROM g JOIN n USING (id) JOIN f USING (x)),
q AS MATERIALIZED (SELECT * FROM p WHERE k <= n - ceil(0.75 * n) + 1),
cand AS MATERIALIZED (SELECT DISTINCT a.id AS a, b.id AS b FROM q a JOIN q b ON a.x = b.x AND a.id < b.id AND least(a.n, b.n) >= 0.75 * greatest(a.n, b.n)),
e AS MATERIALIZED (SELECT a, b FROM (SELECT cand.a, cand.b, count(*) AS i, any_value(na.n) + any_value(nb.n) AS s FROM cand JOIN g ga ON ga.id = cand.a JOIN g gb ON gb.id = cand.b AND gb.x = ga.x JOIN n na ON na.id = cand.a JOIN n nb ON nb.id = cand.b GROUP BY ALL) WHERE i / (s - i)::DOUBLE >= 0.75),
o AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS r, (SELECT list(a) FROM e WHERE e.b = c.id) AS before FROM c),
walk(r, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT o.r, CASE WHEN len(list_intersect(coalesce(o.before, []), walk.kept)) > 0 THEN walk.kept ELSE list_append(walk.kept, o.id) END FROM walk JOIN o ON o.r = walk.r + 1)
SELECT unnest(kept) AS doc_id FROM (SELECT kept FROM walk ORDER BY r DESC LIMIT 1) UNION ALL SELECT doc_id FROM documents WHERE coalesce(text, '') = ''""")
def near_dedup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_dedup(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def exact_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_of(table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id")


@query(f"""
WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS seed, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
k AS (SELECT *, lower({_SQUEEZE.format("seed")}) AS key FROM l)
SELECT doc_id, i::BIGINT AS line, seed FROM (SELECT *, row_number() OVER (PARTITION BY lang, key ORDER BY doc_id, i) AS n FROM k WHERE key <> '') WHERE n = 1""")
def seed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all texts, by language, as seeds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("scene"), F.lit("c").alias("category"), F.posexplode(F.split("text", "\n")).alias("i", "seed"))
    seeds = docs.withColumn("line", (F.col("i") + 1).cast("long")).withColumn("pos", F.struct("doc_id", "i"))
    return dedup.dedup_seeds(seeds).select("doc_id", "line", "seed")


@query("""
WITH r AS (SELECT doc_id AS k, lang FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0)
SELECT k, CASE WHEN quality = 1 THEN 'text ' || k ELSE '' END AS output, CASE WHEN quality = 1 THEN NULL ELSE 'failed ' || k END AS asr_error, lang
FROM (SELECT doc_id AS k, coalesce(quality, 0) AS quality FROM labels) JOIN r USING (k)""")
def match_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of the labelled documents, some failed, with rubrics, some failed or without questions."""
    k = F.col("doc_id")
    rubric = table(spark, sf_dir, "documents").select(k.alias("k"), "lang", F.when(k % 5 == 0, "failed").otherwise("success").alias("status"), F.when(k % 7 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1))).alias("qa"))
    text = F.when(F.col("quality") == 1, F.concat(F.lit("text "), k.cast("string")))
    out = table(spark, sf_dir, "labels").select(k.alias("k"), text.alias("text"), F.concat(F.lit("failed "), k.cast("string")).alias("error"))
    return evaluate.match(out, rubric, "k").select("k", "output", "asr_error", "lang")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def pending_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "labels").select("doc_id")
    return evaluate.pending(table(spark, sf_dir, "documents"), done, "doc_id", "doc_id").select("doc_id")


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL")
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", F.col("event_id").alias("ord"))
    return evaluate.latest(rows, ["user_id", "event_type"], "ord").select("user_id", "event_type", "event_id", "value")


_RESULTS = """q AS (SELECT DISTINCT user_id AS sample_id, event_type AS question_id FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL),
l AS (SELECT user_id AS sample_id, event_type AS question_id, arg_max(value, event_id) AS value, max(event_id) AS ord FROM events GROUP BY ALL),
m AS (SELECT sample_id, question_id, CASE WHEN ord % 10 <> 0 AND value > 2 THEN 'success' WHEN ord % 10 <> 0 THEN 'failed' END AS status FROM q LEFT JOIN l USING (sample_id, question_id))"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions of users, with their last events as results; one in ten has an old signature."""
    events = table(spark, sf_dir, "events").where("user_id IS NOT NULL AND event_type IS NOT NULL")
    now = R.signature(sample=F.col("user_id").cast("string"), question=F.col("event_type"))
    questions = events.select(F.col("user_id").alias("sample_id"), F.col("event_type").alias("question_id"), now.alias("signature")).distinct()
    old = F.when(F.col("event_id") % 10 == 0, F.sha2(now, 256)).otherwise(now)
    results = events.select(F.col("user_id").alias("sample_id"), F.col("event_type").alias("question_id"), F.when(F.col("value") > 2, "success").otherwise("failed").alias("status"), old.alias("signature"), F.col("event_id").alias("ord"))
    return evaluate.with_results(questions, results)


@query(f"WITH {_RESULTS} SELECT sample_id, question_id, status FROM m")
def current_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select("sample_id", "question_id", "status")


@query(f"WITH {_RESULTS} SELECT sample_id FROM m GROUP BY sample_id HAVING bool_and(coalesce(status = 'success', false))")
def completed_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.finished(_results(spark, sf_dir))


_SCORED = """r AS (SELECT l.doc_id AS sample_id, CASE WHEN l.doc_id % 11 = 0 THEN NULL WHEN d.lang = 'en' THEN 'filter' ELSE 'content' END AS category, d.source AS scene,
CASE WHEN l.doc_id % 13 = 0 THEN NULL ELSE l.quality END AS score, l.toxic = 1 AS gone, CASE WHEN l.doc_id % 7 = 0 THEN 'failed' ELSE 'success' END AS status,
CASE WHEN l.doc_id % 2 = 0 THEN 3 END AS max_score FROM labels l JOIN documents d USING (doc_id)),
g AS (SELECT *, coalesce(max_score, CASE category WHEN 'filter' THEN 2 ELSE 1 END) AS best FROM r WHERE status = 'success' AND score IS NOT NULL AND category IS NOT NULL AND scene IS NOT NULL),
k AS (SELECT 'overall' AS kind, '' AS value, score, best FROM g UNION ALL SELECT 'category', category, score, best FROM g UNION ALL SELECT 'scene', scene, score, best FROM g)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, k = table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), F.col("doc_id")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        k.alias("sample_id"), F.when(k % 11 == 0, None).when(F.col("lang") == "en", "filter").otherwise("content").alias("category"), F.col("source").alias("scene"),
        F.when(k % 13 != 0, F.col("quality")).alias("score"), F.when(k % 2 == 0, 3).alias("max_score"), (F.col("toxic") == 1).alias("asr_retry_exhausted"), F.when(k % 7 == 0, "failed").otherwise("success").alias("status"),
    )


@query(f"""WITH {_SCORED} SELECT kind, value, count(*) AS n, sum(score)::BIGINT AS score, sum(best)::BIGINT AS max_score,
CASE WHEN sum(best) = 0 THEN 0.0::DOUBLE ELSE greatest(0, least(1, sum(score)::DOUBLE / sum(best)))::DOUBLE END AS normalized FROM k GROUP BY kind, value""")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summary(_scored(spark, sf_dir))


@query(f"""WITH {_SCORED} SELECT count(*) FILTER (status <> 'success') AS failed_questions, count(*) FILTER (gone) AS exhausted_questions, count(DISTINCT sample_id) FILTER (gone) AS exhausted_samples FROM r""")
def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.run_counts(_scored(spark, sf_dir))


@query("""SELECT doc_id, sha256('{"lang": ' || coalesce(to_json(lang)::VARCHAR, 'null') || ', "source": ' || coalesce(to_json(source)::VARCHAR, 'null') || ', "text": ' || coalesce(to_json(text)::VARCHAR, 'null') || '}') AS key FROM documents""")
def content_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", R.signature(lang=F.col("lang"), text=F.col("text"), source=F.col("source")).alias("key"))


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.k') AS k FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", *R.json_fields(F.col("props"), "page", "k"))


@query(f"""WITH {_PAIRS} SELECT conv_id, turn, pos, who, what FROM (SELECT conv_id, turn, unnest([0, 1]) AS pos, unnest(['human', 'gpt']) AS who, unnest([source, refined]) AS what FROM pairs WHERE source <> '' AND refined <> '')""")
def share_gpt_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).select("conv_id", "turn", curate.share_gpt(F.col("source"), F.col("refined")).alias("c")).where("c IS NOT NULL")
    return rows.select("conv_id", "turn", F.posexplode("c").alias("pos", "x")).select("conv_id", "turn", "pos", F.col("x.from").alias("who"), F.col("x.value").alias("what"))


_RUNS = """a AS (SELECT event_id, user_id, value > 10 AS loud FROM events),
b AS (SELECT *, sum(CASE WHEN prev = loud THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS turn FROM (SELECT *, lag(loud) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM a)),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id, turn ORDER BY event_id) AS run FROM b),
d AS (SELECT *, CASE WHEN loud AND run >= 2 THEN true WHEN NOT loud AND run >= 2 THEN false END AS event FROM c),
v AS (SELECT event_id, user_id, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), false) AS in_speech FROM d)"""


def _activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return speech.activity(rows, F.col("value") > 10, "user_id", "event_id", 2, 2).select("event_id", "user_id", "in_speech")


@query(f"WITH {_RUNS} SELECT * FROM v")
def vad_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _activity(spark, sf_dir)


@query(f"WITH {_RUNS} SELECT * FROM v")
def vad_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same states from the stateful machine that also runs as a stream."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.col("value").alias("rms"), F.lit(1.0).alias("duration"))
    return speech.fold(rows, speech.energy_vad(10, 2.0, 2.0), speech.VAD, "user_id").select(F.col("seq").alias("event_id"), "user_id", "in_speech")


@query(f"""WITH {_RUNS}, w AS (SELECT *, lag(in_speech, 1, false) OVER (PARTITION BY user_id ORDER BY event_id) AS was, list(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 22 PRECEDING AND 1 PRECEDING) AS p FROM v)
SELECT event_id, user_id, coalesce(len(p), 0)::BIGINT AS n, coalesce(p[1], -1) AS first_id FROM w WHERE in_speech AND NOT was""")
def preroll_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = speech.preroll(_activity(spark, sf_dir), "user_id", "event_id")
    return rows.select("event_id", "user_id", F.size("preroll").cast("long").alias("n"), F.coalesce(F.try_element_at("preroll", F.lit(1)), F.lit(-1)).alias("first_id"))


_STRIPPED = _STRIP.format("text")
_GAP = "CASE WHEN ascii(right({0}, 1)) < 128 AND ascii({1}) < 128 THEN ' ' ELSE '' END"
_WINDOWS = f"""s AS (SELECT conv_id, turn, {_STRIPPED} AS t FROM conversations),
w AS (SELECT conv_id, turn, greatest(0, row_number() OVER o - 3) AS start_index, lag(t, 2) OVER o AS a, lag(t) OVER o AS b, t AS c FROM s WHERE t <> '' WINDOW o AS (PARTITION BY conv_id ORDER BY turn))"""
_REFINED = f"coalesce(a || {_GAP.format('a', 'b')}, '') || coalesce(b || {_GAP.format('b', 'c')}, '') || c"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where(~T.blank(F.col("text"))).select("conv_id", "turn", "text")


@query(f"WITH {_WINDOWS} SELECT conv_id, turn, start_index, {_REFINED} AS refined FROM w")
def sliding_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech.windows(_chunks(spark, sf_dir), "text", "conv_id", "turn").select("conv_id", "turn", "start_index", T.join_chunks(F.col("window")).alias("refined"))


@query(f"WITH {_WINDOWS} SELECT conv_id, turn, start_index, {_REFINED} AS refined FROM w")
def sliding_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chunks(spark, sf_dir).withColumnRenamed("turn", "seq")
    return speech.fold(rows, speech.sliding(), speech.REFINED, "conv_id").select("conv_id", F.col("seq").alias("turn"), "start_index", F.col("refined_text").alias("refined"))


@query(f"""WITH {_WINDOWS} SELECT x.conv_id, x.turn, count(y.c) AS n, coalesce(string_agg(y.c, chr(10) ORDER BY y.turn), '') AS texts
FROM w x LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM w) y ON y.conv_id = x.conv_id AND y.i <= x.start_index GROUP BY ALL""")
def committed_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has left the window by each turn."""
    rows = speech.windows(_chunks(spark, sf_dir), "text", "conv_id", "turn", committed=True)
    texts = F.array_join(F.transform("committed", T.strip), "\n")
    return rows.select("conv_id", "turn", F.size("committed").cast("long").alias("n"), texts.alias("texts"))


@query(rf"""
WITH RECURSIVE walk AS (SELECT conv_id, turn, 0 AS k, {_STRIPPED} AS rest, NULL::VARCHAR AS piece FROM conversations UNION ALL
SELECT conv_id, turn, k + 1, substr(rest, n + 1), substr(rest, 1, n) FROM (SELECT *, CASE WHEN f BETWEEN 1 AND 80 THEN f
  WHEN length(rest) > 80 THEN coalesce(nullif(length(regexp_extract(left(rest, 80), '(?s)^.*[,;:!?，。！？；：、]\s*')), 0), 80) ELSE length(rest) END AS n
  FROM (SELECT *, length(regexp_extract(rest, '^[^.!?。！？]*[.!?。！？]\s*')) AS f FROM walk WHERE rest <> '') x) y),
p AS (SELECT conv_id, turn, k, {_STRIP.format("piece")} AS text FROM walk WHERE piece IS NOT NULL)
SELECT conv_id, turn AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS index, text, NULL AS error FROM p WHERE text <> ''""")
def stable_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), F.col("text").alias("hypothesis"), F.lit(True).alias("vad_boundary"))
    return speech.fold(rows, speech.chunker(), speech.CHUNK, "conv_id")


@query("""
SELECT doc_id, w AS word, w IN ('the', 'a', 'an', 'and', 'or', 'to', 'of', 'in', 'on', 'for', 'is', 'are', 'was', 'were', 'we', 'you', 'they', 'this', 'that', 'need', 'should', 'maybe') OR length(w) = 1 AND NOT regexp_matches(w, '[一-鿿A-Za-z0-9]') AS common
FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[\\p{L}\\p{N}]+'))) AS w FROM documents) WHERE w <> ''""")
def keyword_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = K.dedupe(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(words).alias("word")).withColumn("common", K.is_common(F.col("word")))


@query(f"""WITH {_PAIRS}, k AS (SELECT conv_id, turn, source, refined, unnest(list_distinct(regexp_extract_all(refined, '[A-Za-z]{{4,}}'))) AS word FROM pairs)
SELECT conv_id, turn, word FROM k WHERE NOT contains(source, word) AND NOT (length(word) - 1 <= len(list_filter(string_split(word, ''), lambda c: contains(source, c))))""")
def keywords_without_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.explode(K.dedupe(F.regexp_extract_all("refined", F.lit("[A-Za-z]{4,}"), F.lit(0))))
    rows = _pairs(spark, sf_dir).select("conv_id", "turn", "source", words.alias("word"))
    return rows.where(~K.has_evidence(F.col("word"), F.col("source"), F.lit(""))).select("conv_id", "turn", "word")


@query("SELECT page_id, CASE WHEN ends_with(b, '/chat/completions') THEN b ELSE b || '/chat/completions' END AS url FROM (SELECT page_id, rtrim(url, '/') AS b FROM pages)")
def endpoint_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.endpoint_url(F.col("url")).alias("url"))


@query("SELECT vec_id, round(sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding]) / len(embedding)) + 1e-9, 6) AS rms FROM embeddings")
def window_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(speech.rms(F.col("embedding")), 6).alias("rms"))


@query("""SELECT item_id AS sample_id, 'q' || i AS question_id, (length(text) + i) % (2 + i) AS option_index FROM benchmark, range(3) r(i) WHERE item_id % 5 <> 0
UNION ALL SELECT item_id, NULL, NULL FROM benchmark WHERE item_id % 5 = 0""")
def judge_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three questions a sample; a fifth of the samples get an answer that doesn't fit and so fail as a whole."""
    option = lambda o: F.struct(F.concat(F.lit("option "), o.cast("string")).alias("text"), o.alias("score"))
    questions = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(F.concat(F.lit("q"), i.cast("string")).alias("id"), F.concat(F.col("item_id").cast("string"), F.lit("?")).alias("question"), F.transform(F.sequence(F.lit(0), i + 1), option).alias("options")))

    def ask(text: str, questions: list) -> list[tuple[str, int]]:
        wrong = int(questions[0]["question"][:-1]) % 5 == 0
        return [(q["id"], 99 if wrong and i else (len(text) + i) % len(q["options"])) for i, q in enumerate(questions)]

    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("sample_id"), F.col("text").alias("output"), questions.alias("questions"))
    return models.judge(rows, ask, wait=lambda k: 0.0).select("sample_id", "question_id", F.col("option_index").cast("long").alias("option_index"))


@query(f"SELECT doc_id, {_STRIP.format('text')} <> '' AS ok, nullif({_STRIP.format('text')}, '') AS clean_text FROM documents")
def refine_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models.refine_batches(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", models.identity)
    return rows.select("doc_id", "ok", "clean_text")


@query("""
WITH t AS (SELECT conv_id, turn, text || CASE turn % 4 WHEN 0 THEN ' 三月' WHEN 1 THEN ' 百分之五' WHEN 2 THEN ' 丁年' ELSE '' END AS t FROM conversations)
SELECT conv_id, turn, regexp_matches(t, '[一-三四五六七八九十百千万亿]+[年月日号]') AS dates, regexp_matches(t, '百分之[零一二三四五六七八九十百千万]+') AS shares FROM t
WHERE regexp_matches(t, '[一-三四五六七八九十百千万亿]+[年月日号]|百分之[零一二三四五六七八九十百千万]+')""")
def spoken_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn") % 4
    text = F.concat("text", F.when(turn == 0, " 三月").when(turn == 1, " 百分之五").when(turn == 2, " 丁年").otherwise(""))
    found = table(spark, sf_dir, "conversations").withColumn("p", K.spoken_numbers(text)).where(F.size("p") > 0)
    return found.select("conv_id", "turn", *[F.array_contains("p", p).alias(n) for n, p in zip(("dates", "shares"), K.SPOKEN_NUMBERS)])


@query("SELECT conv_id, turn, sha256('text' || chr(10) || coalesce(role, '') || chr(10) || coalesce(text, '')) AS key FROM conversations")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", files.content_key(F.lit("text"), F.col("role"), F.col("text")).alias("key"))


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY sha256('x' || chr(10) || coalesce(text, '')) ORDER BY conv_id, turn) AS n, length(text) AS size FROM conversations)
SELECT conv_id, turn, CASE WHEN size % 2 = 0 THEN 'held ' ELSE 'made ' END || size AS value FROM t""")
def cached_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by content: half of them are in the cache, the others are made once for each text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lit("x").alias("kind"))
    size = F.length("text")
    cache = rows.where(size % 2 == 0).select(files.content_key(F.col("kind"), F.col("text")).alias("key"), F.concat(F.lit("held "), size.cast("string")).alias("value")).distinct()
    found, _ = files.cached(rows, cache, ["kind", "text"], lambda new: new.withColumn("value", F.concat(F.lit("made "), size.cast("string"))), place(spark, "cache"))
    return found.select("conv_id", "turn", "value")


@query("""SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) AND isfinite(value) AND value >= 0 THEN value END AS latency FROM events""")
def json_latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latencies in JSON: numbers, negative ones, texts and booleans."""
    k, value = F.col("event_id") % 5, F.col("value")
    as_json = lambda c: F.to_json(F.struct(c.alias("ms")))
    doc = F.when(k <= 1, as_json(value)).when(k == 2, as_json(-1 - F.abs(value))).when(k == 3, as_json(value.cast("string"))).otherwise(as_json(F.lit(True)))
    return table(spark, sf_dir, "events").select("event_id", R.latency_at(doc, "$.ms").alias("latency"))


@query("SELECT event_id, CASE WHEN isfinite(value) AND value >= 0 THEN value END AS latency FROM events")
def valid_latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", R.valid_latency(F.col("value")).alias("latency"))

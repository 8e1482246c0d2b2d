"""Queries of record functions and operators: fields, keywords, options, JSON, assembly, simulation and verdicts.

Where the tables lack a case (Han text, options, answers of a judge), cases are dealt to their rows by number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keywords as K
from ..functions import records as R
from ..functions import text as T
from ..operators import curate, dedup, evaluate, finalize, prompts
from .catalog import query, table


def _dealt(rows: DataFrame, key: str, cases: list[str]) -> DataFrame:
    """Adds case, the text that falls to a row by its number, and kind, the case's number."""
    kind = F.pmod(F.col(key), F.lit(len(cases)))
    return rows.withColumn("kind", kind).withColumn("case", F.element_at(F.array(*map(F.lit, cases)), kind.cast("int") + 1))


def _values(pairs: dict[int, str | None]) -> str:
    """VALUES (kind, what a case gives)."""
    quoted = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join(f"({k}, {quoted(x)})" for k, x in pairs.items()) + ") v(kind, want)"


_STRIPPED = r"regexp_replace(text, '^[\s\x0b\x1c-\x1f]+|[\s\x0b\x1c-\x1f]+$', '', 'g')"
_HAN = ["中 文 ， 好 abc , ", "a ", "价 格 ： 3 元 ; ok ? ", "（ 中 ） x ) ", "plain, text . ", "你 好 world 你 好 "]
_HAN_WANT = {0: "中文，好 abc, ", 1: "a ", 2: "价格： 3 元; ok? ", 3: "（中） x) ", 4: "plain, text. ", 5: "你好 world 你好 "}


@query(rf"SELECT conv_id, turn, want || regexp_replace(text, '[\s]+([,.!?;:%)\]}}])', '\1', 'g') AS text FROM conversations JOIN {_values(_HAN_WANT)} ON v.kind = conv_id % 6".replace("\\\\", "\\"))
def han_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn behind a text with spaces between Han characters and marks."""
    rows = _dealt(table(spark, sf_dir, "conversations"), "conv_id", _HAN)
    return rows.select("conv_id", "turn", T.normalize_cjk(F.concat("case", "text")).alias("text"))


_AROUND = [("<|im_start|>assistant\n", "<|im_end|>"), ("Assistant: ", ""), ("assistant：", " </s>"), ("  ", "  "), ("<|im_start|>assistant\nassistant ", "<|im_end|>\n")]


@query(f"SELECT conv_id, turn, {_STRIPPED} AS text FROM conversations")
def chat_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn between the markers of a chat model, of one kind or another."""
    rows = _dealt(_dealt(table(spark, sf_dir, "conversations"), "conv_id", [b for _, b in _AROUND]).withColumnRenamed("case", "after"), "conv_id", [a for a, _ in _AROUND])
    return rows.select("conv_id", "turn", T.clean_response(F.concat("case", "text", "after")).alias("text"))


_OPTIONS = ["(1)", " （2） ，一般（1）,差（-1）", "(1) rest", "", " ( 3 )", "(0)，b(1)"]
_OPTIONS_WANT = {0: "=1", 1: "=2;一般=1;差=-1", 2: None, 3: None, 4: "=3", 5: "=0;b=1"}


@query(f"SELECT item_id, CASE WHEN NOT contains({_STRIPPED}, chr(10)) THEN {_STRIPPED} || want END AS options FROM benchmark JOIN {_values(_OPTIONS_WANT)} ON v.kind = item_id % 6")
def option_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options whose first text is the item's."""
    rows = _dealt(table(spark, sf_dir, "benchmark"), "item_id", _OPTIONS)
    shown = F.transform(T.parse_options(F.concat("text", "case")), lambda o: F.concat(o["text"], F.lit("="), o["score"].cast("string")))
    return rows.select("item_id", F.array_join(shown, ";").alias("options"))


_JSON = [("", ""), ("```json\n", "\n```"), ("x [1] y ", ""), ("see ", " then prose"), ("just ", " prose"), ("[1, 2", "")]


@query("""SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE '{"a": 2, "text": ' || to_json(text)::VARCHAR || '}' END AS found FROM documents""")
def json_in_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON of an answer that holds the whole text, alone, in a fence or in prose."""
    rows = _dealt(_dealt(table(spark, sf_dir, "documents"), "doc_id", [b for _, b in _JSON]).withColumnRenamed("case", "after"), "doc_id", [a for a, _ in _JSON])
    body = F.when(F.col("text").isNotNull(), F.concat(F.lit('{"text": '), R.json_text(F.col("text")), F.lit(', "a": 2}')))
    return rows.select("doc_id", R.find_json(F.concat("case", body, "after")).alias("found"))


_VERDICTS = ['{"pass": true, ', '{"pass": false, "detail": {"pass": true}, ', "{", '{"pass": "false", ', '{"pass": 0, ', '{"pass": null, ', '{"pass": 1, ', '{"pass": "", ', '{"pass": [], ']
_VERDICT_SAID = {0: "true ", 1: "false ", 2: "true ", 3: "true ", 4: "false ", 5: "false ", 6: "true ", 7: "false ", 8: "false "}
_PLAIN = ["True.", " false, as it adds", "maybe", "[true]", '{"pass": true, "reason": cut']
_PLAIN_SAID = {9: "true ", 10: "false ", 11: None, 12: None, 13: "true "}


@query(f"""SELECT doc_id, CASE WHEN doc_id % 14 < 9 THEN want || coalesce(text, '') WHEN want IS NULL THEN 'false unparseable QC response' ELSE want || left({{1}}, 100) END AS verdict
FROM (SELECT doc_id, text, want, plain || coalesce(text, '') AS said FROM documents JOIN {_values(_VERDICT_SAID | _PLAIN_SAID)} ON v.kind = doc_id % 14 LEFT JOIN {_values(dict(enumerate(_PLAIN, 9))).replace("v(kind, want)", "p(number, plain)")} ON p.number = doc_id % 14)""".replace("{1}", "said"))
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with the whole text as their reason, or behind what they say."""
    own = F.coalesce("text", F.lit(""))
    rows = _dealt(table(spark, sf_dir, "documents"), "doc_id", [*_VERDICTS, *_PLAIN])
    said = F.when(F.col("kind") < len(_VERDICTS), F.concat("case", F.lit('"reason": '), R.json_text(own), F.lit("}"))).otherwise(F.concat("case", own))
    rows = rows.withColumn("v", curate.verdict(said))
    return rows.select("doc_id", F.concat_ws(" ", F.col("v.passed").cast("string"), F.col("v.reason")).alias("verdict"))


@query("""
WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+'))) AS word FROM documents)
SELECT doc_id, word, regexp_matches(word, '[A-Za-z][A-Za-z0-9_+#.\\-]+|[0-9]|[A-Za-z]#|>=|<=|!=|==|->|::|[+\\-*/]=|%d') OR length(word) >= 2 AND regexp_matches(word, '[一-鿿]') AS shaped FROM w""")
def keyword_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of all texts have the shape of a keyword."""
    words = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[^ \t\n\x0b\f\r]+"), F.lit(0))))
    rows = table(spark, sf_dir, "documents").select("doc_id", words.alias("word"))
    return rows.select("doc_id", "word", K.has_shape(F.col("word")).alias("shaped"))


@query("""
WITH d AS (SELECT doc_id, doc_id % 4 AS k, text, regexp_extract(text, '[A-Za-z]{6,}') AS w FROM documents)
SELECT doc_id, k NOT IN (1, 2) AS accepted, CASE k WHEN 0 THEN 'no keywords' WHEN 1 THEN 'common terms' WHEN 2 THEN 'no evidence' ELSE CASE WHEN w = '' THEN 'no keywords' ELSE 'passed' END END AS reason,
CASE k WHEN 1 THEN 'the' WHEN 2 THEN 'ЖЩЖЩ' ELSE '' END AS words FROM d WHERE coalesce(text, '') <> ''""")
def keyword_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of each text: none, one too common, one without evidence, and one of the text itself."""
    docs = table(spark, sf_dir, "documents").where(F.coalesce("text", F.lit("")) != "")
    none, kind, own = F.array().cast("array<string>"), F.col("doc_id") % 4, F.regexp_extract("text", "[A-Za-z]{6,}", 0)
    words = F.when(kind == 0, none).when(kind == 1, F.array(own, F.lit("the"))).when(kind == 2, F.array(own, F.lit("ЖЩЖЩ"))).otherwise(F.array(F.concat(F.lit(" "), own), own))
    found = K.check(words, F.col("text"), F.lit(""), F.col("text"))
    return docs.withColumn("c", found).select("doc_id", "c.accepted", "c.reason", F.array_join("c.words", ",").alias("words"))


@query("""
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 7.0 WHEN 1 THEN 8.0 WHEN 2 THEN 9.0 WHEN 3 THEN 3.0 WHEN 4 THEN 4.0 END::DOUBLE AS latency,
CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN trim(props) END AS text, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN event_type ELSE 'ASR output is empty or unsuccessful' END AS error FROM events""")
def recognition_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of recognition records by their precedence: each kind of record has the field that should count, and
    later ones."""
    k, k3 = F.col("event_id") % 6, F.col("event_id") % 3
    at = lambda *kinds: lambda x: F.when(k.isin(*kinds), F.lit(x).cast("double"))
    output = F.struct(
        F.when(k3 == 0, F.concat(F.lit(" "), "event_type", F.lit("\n"))).otherwise("unused").alias("clean_text"), (k3 == 0).alias("ok"), F.when(k3 == 0, F.col("props")).alias("error"),
        at(0)(7).alias("total_latency_ms"), at(0, 1, 2, 3)(1).alias("stt_latency_ms"), F.when(k == 4, -1.0).otherwise(2.0).alias("llm_latency_ms"),
    )
    plain = F.when(k == 5, float("nan")).otherwise(4.0)
    return table(spark, sf_dir, "events").select(
        "event_id", R.latency(output, at(0, 1)(8), at(0, 1, 2)(9), plain).alias("latency"),
        R.recognized_text(output, F.when(k3 == 1, F.col("props")).otherwise(" "), F.lit("ok")).alias("text"), R.recognition_error(output, F.when(k3 == 1, F.col("event_type")).otherwise(" ")).alias("error"),
    )


@query("""SELECT event_id, json_extract_string(props, '$.page') AS page, CASE WHEN event_id % 2 = 0 THEN event_type END AS inner_text FROM events""")
def dotted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = R.json_text(F.col("event_type"))
    doc = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"a": {"b": '), own, F.lit("}}"))).otherwise(F.concat(F.lit('{"a": ['), own, F.lit("]}")))
    return table(spark, sf_dir, "events").select("event_id", R.text_at(F.col("props"), "page").alias("page"), R.text_at(doc, "a", "b").alias("inner_text"))


# --- assembly and simulation ---

_LANG = "CASE WHEN doc_id % 4 = 0 THEN 'xx' WHEN doc_id % 4 = 1 THEN 'yy' WHEN lang = 'en' THEN 'en' ELSE 'zh' END"
_SCENE = "CASE WHEN lang = 'en' THEN 'english_' || source ELSE source END"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with every kind of field present or missing."""
    k = F.col("doc_id")
    scene = F.when(F.col("lang") == "en", F.concat(F.lit("english_"), "source")).otherwise(F.col("source"))
    meta = F.when(k % 3 != 2, F.struct(
        F.when(k % 4 == 1, "yy").alias("language"), F.when(k % 3 == 0, True).alias("is_fragment"), F.when(k % 3 == 0, "own_mode").alias("asr_mode"), F.when(k % 6 == 0, "own_words").alias("keyword_mode"),
        F.when(k % 3 == 0, F.array(F.lit("meta"))).alias("speech_phenomena"), F.lit("extra").alias("note"),
    ))
    return table(spark, sf_dir, "documents").select(
        k.alias("id"), scene.alias("scene"), F.when(k % 4 == 0, "xx").alias("language"), F.when(k % 9 != 8, F.col("text")).alias("input"), F.when(k % 2 == 0, F.concat(F.lit("+"), "text")).alias("oral_text"), F.col("text").alias("clean_text"),
        F.when(k % 5 == 0, F.lit("short")).alias("refined_text"), F.array(F.lit("the"), F.lit("Zebra99")).alias("keyword_list"),
        F.when(k % 2 == 0, F.array(F.when(k % 10 == 0, "clean").otherwise("um"))).alias("speech_phenomena"), F.when(k % 2 == 0, F.array(F.lit("date"))).alias("itn_types"), meta.alias("meta"),
    )


def _shown(rows: DataFrame) -> DataFrame:
    lists = lambda c: F.array_join(c, ",")
    return rows.select(
        "id", "scene", "input", "oral_text", F.col("output.refined_text").alias("refined_text"), lists(F.col("output.keyword_list")).alias("words"), F.col("meta.language").alias("language"),
        lists(F.col("meta.speech_phenomena")).alias("phenomena"), lists(F.col("meta.itn_types")).alias("itn"), F.col("meta.is_fragment").alias("is_fragment"), F.col("meta.asr_mode").alias("asr_mode"),
        F.col("meta.keyword_mode").alias("keyword_mode"), F.col("meta.note").alias("note"), *[c for c in ("reason",) if c in rows.columns],
    )


_TRIM = r"length(regexp_replace({0}, '^[\s\x0b\x1c-\x1f]+|[\s\x0b\x1c-\x1f]+$', '', 'g'))"
_REASON = f"""CASE WHEN input = '' OR refined_text = '' THEN 'skipped_empty' WHEN {_TRIM.format("input")} < 2 OR {_TRIM.format("refined_text")} < CASE WHEN scene LIKE 'english!_%' ESCAPE '!' THEN 6 ELSE 10 END THEN 'skipped_short' END AS reason"""


@query(f"""
WITH r AS (SELECT doc_id AS id, {_SCENE} AS scene, CASE WHEN doc_id % 9 <> 8 THEN coalesce(text, '') ELSE '' END AS input, CASE WHEN doc_id % 2 = 0 AND text IS NOT NULL THEN '+' || text WHEN doc_id % 9 <> 8 THEN coalesce(text, '') ELSE '' END AS oral_text,
CASE WHEN doc_id % 5 = 0 THEN 'short' ELSE coalesce(text, '') END AS refined_text, 'Zebra99' AS words, CASE WHEN doc_id % 4 = 1 AND doc_id % 3 <> 2 THEN 'yy' WHEN doc_id % 4 = 0 THEN 'xx' WHEN lang = 'en' THEN 'en' ELSE 'zh' END AS language,
CASE WHEN doc_id % 3 = 0 THEN 'meta' ELSE '' END AS phenomena, '' AS itn, doc_id % 3 = 0 AS is_fragment, CASE WHEN doc_id % 3 = 0 THEN 'own_mode' END AS asr_mode, CASE WHEN doc_id % 6 = 0 THEN 'own_words' ELSE 'review_targets' END AS keyword_mode,
CASE WHEN doc_id % 3 <> 2 THEN 'extra' END AS note FROM documents) SELECT *, {_REASON} FROM r""")
def assembled_simulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(curate.assemble(_records(spark, sf_dir)))


@query(f"""
WITH r AS (SELECT doc_id AS id, {_SCENE} AS scene, CASE WHEN doc_id % 2 = 0 THEN coalesce('+' || text, '') ELSE '' END AS input, CASE WHEN doc_id % 2 = 0 THEN coalesce('+' || text, '') ELSE '' END AS oral_text, coalesce(text, '') AS refined_text, 'Zebra99' AS words,
CASE WHEN doc_id % 4 = 0 THEN 'xx' WHEN doc_id % 4 = 1 AND doc_id % 3 <> 2 THEN 'yy' WHEN lang = 'en' THEN 'en' ELSE 'zh' END AS language,
CASE WHEN doc_id % 10 = 0 THEN 'clean' WHEN doc_id % 2 = 0 THEN 'um' ELSE '' END AS phenomena, CASE WHEN doc_id % 2 = 0 THEN 'date' ELSE '' END AS itn, doc_id % 3 = 0 AS is_fragment,
CASE WHEN doc_id % 3 = 0 THEN 'own_mode' ELSE 'clean_fallback' END AS asr_mode, CASE WHEN doc_id % 6 = 0 THEN 'own_words' ELSE 'review_targets' END AS keyword_mode, CASE WHEN doc_id % 3 <> 2 THEN 'extra' END AS note FROM documents) SELECT *, {_REASON} FROM r""")
def assembled_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(curate.assemble(_records(spark, sf_dir), from_simulation=False))


_MARKS = "trim(regexp_replace(translate({0}, '“”‘’「」『』（）【】《》〈〉—…：；、·―()[]{{}}\"''', repeat(' ', 32)), '[\\s\\x0b\\x1c-\\x1f]+', ' ', 'g'))"


_PLUS = "('+' || text)"


def _simulated(mode: str) -> str:
    drawn = "('0x' || md5('42:' || doc_id)[1:8])::BIGINT < floor(0.2::DOUBLE * 4294967296)"
    source = {
        "text_sim": _MARKS.format(_PLUS),
        "llm_sim": f"CASE WHEN {drawn} THEN 'said ' || doc_id ELSE '+' || text END",
        "tts_asr": f"CASE WHEN doc_id % 3 = 0 THEN {_MARKS.format(_PLUS)} ELSE 'said ' || doc_id END",
    }[mode]
    wanted = f"CASE WHEN doc_id % 10 <> 0 AND {drawn} THEN 'wanted ' || doc_id ELSE text END" if mode == "llm_sim" else "text"
    return f"""
SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN text ELSE {source} END AS input, {wanted} AS clean_text, {f'doc_id % 10 <> 0 AND {drawn}' if mode == 'llm_sim' else 'false'} AS is_fragment, '{mode}' AS asr_mode,
CASE WHEN doc_id % 4 = 0 THEN 'xx' WHEN lang = 'en' THEN 'en' ELSE 'zh' END AS language, {"'voice'" if mode == 'tts_asr' else 'NULL'} AS tts_provider, {f"doc_id % 10 <> 0 AND doc_id % 3 = 0" if mode == 'tts_asr' else 'false'} AS fell_back, doc_id % 10 = 0 AS passthrough
FROM documents WHERE doc_id % 2 = 0 AND coalesce(text, '') <> ''"""


def _simulate(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    number = F.col("id").cast("string")

    def call(rows: DataFrame) -> DataFrame:
        said = F.concat(F.lit("said "), number)
        if mode == "llm_sim":
            return rows.withColumn("said", said).withColumn("wanted", F.concat(F.lit("wanted "), number))
        return rows.withColumn("said", F.when(F.col("id") % 3 != 0, said)).withColumn("wanted", F.lit(None).cast("string"))

    rows = curate.simulate(_records(spark, sf_dir), mode, call=call, tts="voice")
    return rows.select(
        "id", "input", "clean_text", "meta.is_fragment", "meta.asr_mode", "meta.language", "meta.tts_provider", F.col("meta.asr_fallback_text_sim").alias("fell_back"), "meta.passthrough",
    )


@query(_simulated("text_sim"))
def simulated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _simulate(spark, sf_dir, "text_sim")


@query(_simulated("llm_sim"))
def simulated_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _simulate(spark, sf_dir, "llm_sim")


@query(_simulated("tts_asr"))
def simulated_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _simulate(spark, sf_dir, "tts_asr")


@query("SELECT event_id AS ord, CASE WHEN event_id % 3 = 0 THEN -event_id ELSE row_number() OVER (ORDER BY event_id) END AS id FROM events")
def running_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return curate.numbered(table(spark, sf_dir, "events").select(k.alias("ord"), F.when(k % 3 == 0, -k).alias("id"))).select("ord", "id")


_TRADITIONAL = ["漢語繁體中國 ", "頭髮 發現！", "ABC ﬁ ", "后来 "]
_TRADITIONAL_WANT = {0: "汉语繁体中国 ", 1: "头发 发现 ", 2: "abc fi ", 3: "后来 "}


@query(rf"SELECT conv_id, turn, trim(want || trim(regexp_replace(lower(replace(text, 'ß', 'ss')), '[\p{{P}}\p{{S}}\p{{Z}}\s]+', ' ', 'g'))) AS form FROM conversations JOIN {_values(_TRADITIONAL_WANT)} ON v.kind = conv_id % 4")
def metric_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn behind traditional characters, marks and compatibility forms."""
    rows = _dealt(table(spark, sf_dir, "conversations"), "conv_id", _TRADITIONAL)
    return rows.select("conv_id", "turn", T.metric_form(F.concat("case", "text")).alias("form"))


# --- judging ---


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two questions for each benchmark item, a row each."""
    k, i = F.col("item_id"), F.col("i")
    options = F.array(F.struct(F.lit("bad").alias("text"), F.lit(-1).alias("score")), F.struct(F.lit('so "so"').alias("text"), F.lit(1).alias("score")), F.struct(F.lit("好").alias("text"), (i + 1).cast("int").alias("score")))
    rows = table(spark, sf_dir, "benchmark").withColumn("i", F.explode(F.array(F.lit(0), F.lit(1))))
    return rows.select(
        k.cast("string").alias("sample_id"), F.concat(k.cast("string"), F.lit(".wav")).alias("audio"), F.when(k % 2 == 0, "meeting").otherwise("daily_chat").alias("scene"), F.concat(F.lit("q"), i.cast("string")).alias("question_id"),
        F.when(i == 0, "content").otherwise("filter").alias("category"), F.concat(F.lit("is it right?\n"), i.cast("string")).alias("question"), F.lit("line\\path").alias("evidence"), F.col("text").alias("oral"), F.concat(F.lit("+"), "text").alias("clean"),
        F.when(k % 3 != 0, F.col("text")).alias("output"), options.alias("options"), F.when(k % 3 == 0, "no audio").alias("asr_error"),
    )


def answers(rows: DataFrame) -> DataFrame:
    """An answer to each question; every seventh sample lacks one."""
    n = F.col("sample_id").cast("int")
    return rows.where((n % 7 != 0) | (F.col("question_id") == "q0")).select("sample_id", "question_id", (n % 3).alias("option_index"))


_JUDGED = r"""j AS (SELECT item_id::VARCHAR AS sample_id, i, 'q' || i AS question_id, CASE i WHEN 0 THEN 'content' ELSE 'filter' END AS category, item_id % 3 AS o, text,
CASE WHEN item_id % 3 <> 0 THEN text ELSE '' END AS output, item_id FROM benchmark, range(2) r(i) WHERE item_id % 7 <> 0),
s AS (SELECT *, '"options": [{"score": -1, "text": "bad"}, {"score": 1, "text": "so \"so\""}, {"score": ' || (i + 1) || ', "text": "好"}], "oral": ' || to_json(text)::VARCHAR || ', "output": ' || to_json(output)::VARCHAR || ', "question": "is it right?\n' || i || '"}' AS tail,
'{"category": "' || category || '", "clean": ' || to_json('+' || text)::VARCHAR || ', "evidence": "line\\path", ' AS head FROM j)"""


@query(f"""WITH {_JUDGED} SELECT sample_id, CASE WHEN item_id % 2 = 0 THEN 'meeting' ELSE 'daily_chat' END AS scene, question_id, category, output, 'judge' AS judge_model, sha256(head || tail) AS content_signature,
sha256(head || '"judge_model": "judge@1", ' || tail) AS evaluation_signature, 'success' AS status, o AS selected_option_index, ['bad', 'so "so"', '好'][o + 1] AS selected_option, [-1, 1, i + 1][o + 1] AS score,
greatest(1, i + 1) AS max_score, CASE WHEN item_id % 3 = 0 THEN true END AS asr_retry_exhausted, CASE WHEN item_id % 3 = 0 THEN 'no audio' END AS asr_error FROM s""")
def judge_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir)
    rows = evaluate.judge_rows(asked, answers(asked), "judge", "judge@1")
    numbers = {c: F.col(c).cast("long").alias(c) for c in ("selected_option_index", "score", "max_score")}
    keep = ["sample_id", "scene", "question_id", "category", "output", "judge_model", "content_signature", "evaluation_signature", "status", "selected_option_index", "selected_option", "score", "max_score", "asr_retry_exhausted", "asr_error"]
    return rows.select(*[numbers.get(c, F.col(c)) for c in keep])


@query("SELECT CASE WHEN item_id % 7 = 0 THEN 'missing' ELSE 'range' END AS reason, item_id::VARCHAR AS sample_id, CASE WHEN item_id % 7 = 0 THEN 'q1' ELSE q END AS question_id FROM benchmark, (VALUES ('q0'), ('q1')) v(q) WHERE item_id % 7 = 0 AND q = 'q0' OR item_id % 7 <> 0 AND item_id % 5 = 0")
def answer_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir)
    n = F.col("sample_id").cast("int")
    given = answers(asked).withColumn("option_index", F.when((n % 7 != 0) & (n % 5 == 0), 3).otherwise(F.col("option_index")))
    return evaluate.answer_errors(asked, given)


@query("""SELECT (SELECT count(*) FROM documents) AS outputs, count(*) AS matched, (SELECT count(*) FROM documents) - count(*) AS outside FROM labels JOIN documents USING (doc_id) WHERE quality = 1""")
def out_of_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.col("text"), F.lit(None).cast("string").alias("error"))
    rubric = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("k"), F.when(F.col("quality") == 1, "success").otherwise("failed").alias("status"), F.array(F.lit(1)).alias("qa"))
    return evaluate.outside(docs, evaluate.match(docs, rubric, "k"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def allowed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.allowed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id").select("doc_id")


_QUESTION_JSON = r"""'{"id": "q0", "category": "content", "question": "is it right?\n0", "evidence": "line\\path", "options": [{"option_index": 0, "text": "bad"}, {"option_index": 1, "text": "so \"so\""}, {"option_index": 2, "text": "好"}]}'"""


@query(f"""SELECT item_id::VARCHAR AS sample_id, '{{"oral": ' || to_json(text)::VARCHAR || ', "clean": ' || to_json('+' || text)::VARCHAR || ', "output": ' || coalesce(to_json(CASE WHEN item_id % 3 <> 0 THEN text END)::VARCHAR, 'null')
|| ', "qa": [' || {_QUESTION_JSON} || ']}}' AS prompt FROM benchmark""")
def judge_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = questions(spark, sf_dir).where("question_id = 'q0'")
    asked = F.array(F.struct(F.col("question_id").alias("id"), "category", "question", "evidence", "options"))
    return rows.select("sample_id", prompts.judge_prompt(F.col("oral"), F.col("clean"), F.col("output"), asked).alias("prompt"))


# --- finalisation ---


def _digits(salt: str, key: str) -> str:
    return f"('0x' || md5('{salt}:' || {key})[1:8])::BIGINT"


@query(f"""
WITH c AS (SELECT doc_id, text, lang, {_digits('42', 'doc_id')} < floor(0.08::DOUBLE * 4294967296) AS clean, ['none', 'single', 'rollback', 'multiple'][{_digits('c42', 'doc_id')} % 4 + 1] AS fix, ['low', 'moderate', 'high'][{_digits('l42', 'doc_id')} % 3 + 1] AS level,
CASE lang WHEN 'en' THEN 'english_daily' WHEN 'de' THEN 'explanation' ELSE 'meeting' END AS scene FROM documents)
SELECT doc_id AS id, 'Scene ' || scene || ' {{in}} ' || CASE lang WHEN 'en' THEN 'English' ELSE 'Chinese' END || ', ' || CASE scene WHEN 'meeting' THEN 'at work' ELSE 'a realistic voice interaction' END || ': ["a \\"b\\"", ' || coalesce(to_json(text)::VARCHAR, 'null') || '] ' || CASE WHEN clean THEN 'P' ELSE 'C ' || fix END || '/' || CASE WHEN clean THEN 'P' ELSE 'L ' || level END
|| '/' || CASE WHEN NOT clean AND scene = 'explanation' THEN 'X' ELSE 'None' END AS prompt,
CASE WHEN clean THEN 'clean' ELSE 'correction:' || fix || ',oral:' || level || CASE WHEN scene = 'explanation' THEN ',explanation' ELSE '' END END AS phenomena FROM c""")
def oral_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scene = F.when(F.col("lang") == "en", "english_daily").when(F.col("lang") == "de", "explanation").otherwise("meeting")
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), scene.alias("scene"), F.array(F.lit('a "b"'), F.col("text")).alias("seeds"))
    texts = {"passthrough": "P", "explanation": "X"} | {f"correction:{x}": f"C {x}" for x in curate.CORRECTIONS} | {f"oral:{x}": f"L {x}" for x in curate.LEVELS}
    rows = prompts.oral_prompts(items, "Scene {scene} {{in}} {language}, {context}: {seeds} {correction}/{oral_level}/{additional}", contexts={"meeting": "at work"}, texts=texts)
    return rows.select("id", "prompt", F.array_join("speech_phenomena", ",").alias("phenomena"))


@query("""SELECT source AS scene, greatest(1, floor(1000 * 0.05::DOUBLE))::BIGINT AS target FROM documents GROUP BY source
UNION ALL SELECT * FROM (VALUES ('vibe_coding', 120), ('english_daily', 80), ('navigation', 30)) v""")
def scene_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = table(spark, sf_dir, "documents").select(F.col("source").alias("scene")).distinct().unionByName(spark.createDataFrame([("vibe_coding",), ("english_daily",), ("navigation",)], "scene string"))
    return curate.quotas(scenes, 1000).select("scene", F.col("target").cast("long").alias("target"))


@query("""WITH d AS (SELECT count(*) AS before, (SELECT count(*) FROM (SELECT DISTINCT text FROM documents)) AS after FROM documents) SELECT before, after, (before - after) / before::DOUBLE * 100 AS removed_percent, after / 5000::DOUBLE AS coverage FROM d""")
def dedup_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return finalize.coverage(docs, docs.select("text").distinct(), 5000)


@query("SELECT doc_id AS id, text AS input, '+' || text AS refined, lang AS language FROM documents")
def final_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        F.col("text").alias("input"), F.lit("gone").alias("oral_text"), F.struct(F.concat(F.lit("+"), "text").alias("refined_text")).alias("output"), F.struct(F.col("lang").alias("language"), F.col("doc_id").alias("id")).alias("meta"),
    )
    final = finalize.final_rows(rows)
    return final.select(F.col("meta.id").alias("id"), "input", F.col("output.refined_text").alias("refined"), "meta.language")


@query("""
WITH r AS (SELECT doc_id, source AS scene, text, CASE WHEN coalesce(text, '') = '' THEN 'input or refined_text is empty' WHEN doc_id % 3 = 0 THEN 'unparseable QC response' WHEN doc_id % 3 = 1 THEN NULL ELSE 'bad' END AS qc FROM documents),
p AS (SELECT *, sum((qc IS NULL)::INT) OVER (PARTITION BY scene ORDER BY doc_id) AS c FROM r) SELECT doc_id, qc AS qc_reason FROM p WHERE qc IS NOT NULL AND c < 3""")
def quality_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the curation run turns down before each scene has its three records."""
    kind = F.col("id") % 3
    response = F.when(kind == 0, "perhaps").when(kind == 1, '{"pass": true}').otherwise('{"pass": false, "reason": "bad"}')
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("scene"), F.col("doc_id").alias("ord"), F.concat(F.lit("input: "), "text").alias("input"), F.struct(F.col("text").alias("refined_text")).alias("output"), F.lit(None).cast("struct<scene:string>").alias("meta"),
    )
    _, rejected = finalize.finalize(rows, 60, response)
    return rejected.select(F.col("id").alias("doc_id"), "qc_reason")


@query("""SELECT source AS scene, count(DISTINCT lang) AS have, greatest(0, ceil((6 - count(DISTINCT lang)) / 2.0))::BIGINT AS rounds FROM documents GROUP BY source""")
def seed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = table(spark, sf_dir, "documents").select(F.col("source").alias("scene"), F.col("lang").alias("seed")).distinct()
    return curate.seed_rounds(pool, 6, 2).select("scene", "have", F.col("rounds").cast("long").alias("rounds"))


@query(r"""WITH k AS (SELECT doc_id, source, lower(trim(regexp_replace(text, '[\s\x0b\x1c-\x1f]+', ' ', 'g'))) AS key FROM documents)
SELECT source AS scene, min(doc_id) AS first_id FROM k WHERE key <> '' GROUP BY source, key""")
def structured_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as seeds: plain, or in an object, under its first naming field or under a later one behind values that don't count."""
    k, own = F.col("doc_id") % 4, R.json_text(F.col("text"))
    held = F.when(k == 1, F.concat(F.lit('{"name": '), own, F.lit("}"))).when(k == 2, F.concat(F.lit('{"name": "", "keyword": 0, "title": '), own, F.lit(', "phrase": "unused"}')))
    held = held.when(k == 3, F.concat(F.lit('{"other": 1, "term": null, "value": '), own, F.lit("}"))).otherwise(F.col("text"))
    seeds = table(spark, sf_dir, "documents").where("coalesce(text, '') <> ''").select(F.col("source").alias("scene"), F.lit("c").alias("category"), F.col("doc_id").alias("pos"), held.alias("seed"))
    return dedup.dedup_seeds(seeds, structured=True).select("scene", F.col("pos").alias("first_id"))


@query("""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z]{5,}'))) AS w FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5('42:' || doc_id || ':' || w), w) AS n FROM w)
SELECT d.doc_id, coalesce(string_agg(w, ', ' ORDER BY n) FILTER (n <= 30), 'Use appropriate scene-specific content.') AS seeds FROM documents d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id""")
def seed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.coalesce(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), F.lit(0)), F.array().cast("array<string>"))
    return table(spark, sf_dir, "documents").select("doc_id", curate.seed_list(words, F.col("doc_id")).alias("seeds"))


@query("""WITH w AS (SELECT source AS scene, lang AS category, min(doc_id) AS first_id, list(left(text, 20) ORDER BY doc_id)[1:5] AS w FROM documents WHERE text IS NOT NULL GROUP BY ALL)
SELECT scene, string_agg(category || ': ' || array_to_string(w, ', ') || '...', chr(10) ORDER BY first_id) AS hint FROM w WHERE category IS NOT NULL GROUP BY scene""")
def exclusion_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("scene"), F.col("lang").alias("category"), F.col("doc_id").alias("ord"), F.col("text").alias("seed"))
    return curate.exclusion_hint(docs)


def _similar(a: Column, b: Column) -> Column:
    return finalize.is_duplicate(a, F.array(b))


@query("""WITH p AS (SELECT item_id, text AS a, left(text, length(text) - item_id % 90) AS b FROM benchmark), g AS (SELECT *, list_distinct([a[i:i+2] FOR i IN range(1, length(a) - 1)]) AS ga, list_distinct([b[i:i+2] FOR i IN range(1, length(b) - 1)]) AS gb FROM p WHERE length(b) > 2)
SELECT item_id, len(list_intersect(ga, gb)) / (len(ga) + len(gb) - len(list_intersect(ga, gb)))::DOUBLE >= 0.75 AS similar FROM g""")
def pairwise_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    shorter = F.expr("left(text, length(text) - cast(item_id % 90 as int))")
    rows = table(spark, sf_dir, "benchmark").withColumn("b", shorter).where("length(b) > 2")
    return rows.select("item_id", _similar(F.col("text"), F.col("b")).alias("similar"))

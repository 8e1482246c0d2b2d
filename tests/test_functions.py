"""Expected values are derived by hand; each case is one row."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import keywords as K
from scriptorium.functions import records as R
from scriptorium.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_recognition_text(spark):
    for strength, want in (("light", "a b ：c"), ("medium", "a b c"), ("heavy", "a b c"), ("odd", "a b c")):
        assert one(spark, T.simulate_recognition(F.lit("a（b）：c"), strength)) == want


def test_tokens_and_distance(spark):
    assert one(spark, T.word_tokens(F.lit("中文ab 中1"))) == ["中文", "ab", "中", "1"]
    assert one(spark, T.mixed_tokens(F.lit("中文ab 中1"))) == ["中", "文", "ab", "中", "1"]
    a, b = F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.array(F.lit("x"), F.lit("z"))
    assert one(spark, T.token_distance(a, b)) == 1
    assert one(spark, T.token_distance(F.array().cast("array<string>"), b)) == 2
    assert tuple(one(spark, T.text_metrics(F.lit("漢語 Abc"), F.lit("汉语，abd"))))[:6] == (1, 2, 1, 5, 1, 3)
    m = one(spark, T.text_metrics(F.lit(""), F.lit("a")))
    assert (m.wer_errors, m.wer_units) == (1, 0)
    assert one(spark, T.sample_rate(F.lit(1), F.lit(0))) == 1.0 and one(spark, T.sample_rate(F.lit(0), F.lit(0))) == 0.0
    assert one(spark, T.metric_form(F.lit("Straße，ＡＢ!"))) == "strasse ab"


def test_cjk_and_joins(spark):
    assert one(spark, T.normalize_cjk(F.lit("中 文 ， 好 abc , x"))) == "中文，好 abc, x"
    assert one(spark, T.join_chunks(F.array(*map(F.lit, ("ab", "cd", " ", "中", "ef"))))) == "ab cd中ef"
    assert one(spark, T.clean_response(F.lit("<|im_start|>assistant\nhi<|im_end|>"))) == "hi"


def test_buckets_and_grams(spark):
    for n, want in ((20, "short"), (21, "medium"), (50, "medium"), (51, "long"), (100, "long"), (101, "very_long")):
        assert one(spark, T.length_bucket(F.lit("a" * n))) == want
    assert one(spark, T.char_ngrams(F.lit("ab"))) == ["ab"]
    assert sorted(one(spark, T.char_ngrams(F.lit(" abcd ")))) == ["abc", "bcd"]
    assert one(spark, T.char_ngrams(F.lit("   "))) == [""]


def test_options(spark):
    assert tuple(one(spark, T.parse_option(F.lit("很好（2）")))) == ("很好", 2)
    assert tuple(one(spark, T.parse_option(F.lit("bad(-1)")))) == ("bad", -1)
    assert one(spark, T.parse_option(F.lit("x"))) is None
    assert [tuple(o) for o in one(spark, T.parse_options(F.lit("a(1)，b(0)")))] == [("a", 1), ("b", 0)]
    assert one(spark, T.parse_options(F.lit("a(1) rest"))) is None


def test_keywords(spark):
    assert [one(spark, K.is_common(F.lit(w))) for w in ("the", "The", "，", "中")] == [True, False, True, False]
    assert one(spark, K.has_evidence(F.lit("GPT4"), F.lit("G P T"), F.lit("")))
    assert not one(spark, K.has_evidence(F.lit("GPT4"), F.lit("G P"), F.lit("")))
    assert one(spark, K.has_shape(F.lit("C++"))) and one(spark, K.has_shape(F.lit("3%"))) and not one(spark, K.has_shape(F.lit("a")))
    assert one(spark, K.dedupe(F.array(F.lit(" a"), F.lit("b"), F.lit("a"), F.lit(None), F.lit(" ")))) == ["a", "b"]
    assert one(spark, K.check(F.array(F.lit("the")), F.lit("x"), F.lit(""), F.lit("y"))).reason == "common terms"
    assert len(one(spark, K.spoken_numbers(F.lit("三十号 百分之五")))) == 2


def test_records(spark):
    for value, want in ((-1.0, None), (float("nan"), None), (float("inf"), None), (5.0, 5.0)):
        assert one(spark, R.valid_latency(F.lit(value))) == want
    assert one(spark, R.find_json(F.lit('said: {"a": [1]} ok'))) == "[1]"  # the last list goes before the last object
    assert one(spark, R.find_json(F.lit("none"))) is None
    assert one(spark, R.find_json(F.lit('x [1] y {"a":1}'))) == '{"a": 1}' and one(spark, R.find_json(F.lit('{"a":1} and [2] so'))) == "[2]"
    for c in (F.lit(True), F.lit("5"), F.lit(None).cast("double")):
        assert one(spark, R.valid_latency(c)) is None
    assert one(spark, R.valid_latency(F.lit(5))) == 5.0 and one(spark, R.valid_latency(F.lit(1.5).cast("decimal(4,2)"))) == 1.5
    for doc, want in (('{"t": 5}', 5.0), ('{"t": "5"}', None), ('{"t": true}', None), ('{"t": -1}', None), ("{", None), ('{"t": 1.25}', 1.25)):
        assert one(spark, R.latency_at(F.lit(doc), "$.t")) == want
    odd = 'a"b\\c\n\x01\x1f/é'
    assert one(spark, R.json_text(F.lit(odd))) == json.dumps(odd, ensure_ascii=False) and one(spark, R.json_text(F.lit(None).cast("string"))) == "null"
    assert one(spark, R.signature(b=F.lit(odd), a=F.lit(None).cast("string"))) == hashlib.sha256(json.dumps({"a": None, "b": odd}, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
    settings = json.dumps({"api_url": "u", "model": "m", "system_prompt": "p", "temperature": 0.5}, sort_keys=True)
    same = R.judge_identity(F.lit("m"), F.lit("u"), F.lit("p"), F.lit("0.5"), F.lit(False))
    assert one(spark, same) == "m@" + hashlib.sha256(settings.encode()).hexdigest()[:16]
    assert [one(spark, T.service_language(F.lit(x))) for x in (" ZH ", "eng", "fr")] == ["Chinese", "English", "fr"]
    assert one(spark, R.flatten_seeds(F.lit('{"a": ["x", {"term": "y", "z": "w"}], "b": "x"}'))) == ["x", "y"]
    clean = lambda text: tuple(one(spark, R.clean_result(F.lit(text))))
    body = {"clean_text": " hello world ", "domain_keywords": ["a", 1], "itn_types": "none"}
    for wrapped in (body, [body], {"data": [body, {}]}, {"results": "x", "items": [body]}):
        assert clean(json.dumps(wrapped)) == ("hello world", ["a", "1"], [])
    for wrong in ("none", "[]", '{"data": []}', '{"clean_text": "abc"}', '{"clean_text": 5}', '["hello world"]', None):
        assert clean(wrong) == (None, None, None)
    oral = tuple(one(spark, R.oral_result(F.lit('So: {"oral_text": "um hello", "speech_phenomena": "x", "selected_seeds": ["s"]}'))))
    assert oral == ("um hello", ["s"], None)
    keys = {'{"name": "0", "title": "Dog"}': "0", '{"name": 0.0, "title": "Dog"}': "dog", '{"name": "false"}': "false", '{"name": false, "text": "T"}': "t", '{"name": [], "value": 7}': "7", "x  Y": "x y", '{"name": null, "term": "Cat"}': "cat"}
    for seed, want in keys.items():
        assert one(spark, R.structured_seed_key(F.lit(seed))) == want, seed
    assert one(spark, T.redact(F.lit("key sk-1 " + "x" * 600), F.lit("sk-1"))) == "key [REDACTED] " + "x" * 485
    assert one(spark, T.redact(F.lit("plain"), F.lit(""))) == "plain" and one(spark, T.redact(F.lit("plain"), F.lit(None).cast("string"))) == "plain"


def test_phrases_before_characters(spark):
    rng, chars = random.Random(2), {"a": "1", "b": "2"}
    phrases = {"ab": "X", "abc": "Y", "bcd": "Z", "ca": "W", "dd": ""}
    texts = ["".join(rng.choice("abcde") for _ in range(rng.randint(0, 30))) for _ in range(300)]

    def plain(t):
        out, at = "", 0
        while at < len(t):
            k = max((p for p in phrases if t.startswith(p, at)), key=len, default=None)
            out, at = (out + phrases[k], at + len(k)) if k else (out + chars.get(t[at], t[at]), at + 1)
        return out

    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(T.longest_match(F.col("t"), phrases, chars)).collect()] == [plain(t) for t in texts]
    same = rows.select(T.longest_match(F.col("t"), {}, chars).alias("a"), F.translate("t", "ab", "12").alias("b")).collect()
    assert all(r.a == r.b for r in same)
    assert one(spark, T.longest_match(F.lit(None).cast("string"), phrases)) is None
    with pytest.raises(ValueError):
        T.longest_match(F.lit("x"), {"": "y"})
    # a character whose reading hangs on its neighbours
    assert one(spark, T.metric_form(F.lit("頭髮，乾隆"), phrases={"乾隆": "乾隆"})) == "头发 乾隆"

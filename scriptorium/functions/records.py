"""Fields of nested records: precedence, validity, signatures and JSON found in free text."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .text import blank, seed_key, strip

NO_OUTPUT = "ASR output is empty or unsuccessful"


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def valid_latency(c: Column) -> Column:
    """A finite, non-negative number; else null. Booleans and texts are no numbers, whatever they say."""
    x = c.try_cast("double")
    number = F.typeof(c).isin(*_NUMBERS) | F.startswith(F.typeof(c), F.lit("decimal"))
    return F.when(number & ~F.isnan(x) & (x >= 0) & (x < float("inf")), x)


def _field(doc: Column, path: str) -> tuple[Column, Column]:
    """(the value at a path of a JSON text as variant, its type; null if there is none)."""
    value = F.try_variant_get(F.try_parse_json(doc), path, "variant")
    return value, F.schema_of_variant(value)


def latency_at(doc: Column, path: str) -> Column:
    """``valid_latency`` of a field of a JSON text."""
    value, kind = _field(doc, path)
    x = F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(value, "$", "double"))
    return F.when((x >= 0) & (x < float("inf")), x)


def text_at(doc: Column, *path: str) -> Column:
    """The text at a dotted path of a JSON text; null if there is none, or a step is no object."""
    value, kind = _field(doc, "$." + ".".join(path))
    return F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))


def json_fields(doc: Column, *names: str) -> list[Column]:
    """Top-level fields of a JSON text as texts."""
    return [F.get_json_object(doc, f"$.{n}").alias(n) for n in names]


def latency(output: Column, total: Column, formal: Column, plain: Column) -> Column:
    """output.total_latency_ms, then the record's own fields, then stt + llm if both are valid."""
    both = valid_latency(output["stt_latency_ms"]) + valid_latency(output["llm_latency_ms"])
    return F.coalesce(valid_latency(output["total_latency_ms"]), valid_latency(total), valid_latency(formal), both, valid_latency(plain))


def recognized_text(output: Column, formal_text: Column, formal_status: Column, field: Column | None = None) -> Column:
    """The named field, or output.clean_text if ok, or the legacy text if its status is ok; blank texts are null."""
    full = lambda c: F.when(~blank(c), strip(c))
    if field is not None:
        return full(field)
    return F.coalesce(F.when(output["ok"] == F.lit(True), full(output["clean_text"])), F.when(formal_status == "ok", full(formal_text)))


def recognition_error(output: Column, formal: Column) -> Column:
    return F.coalesce(output["error"], F.when(~blank(formal), formal), F.lit(NO_OUTPUT))


def result_output(raw: Column, clean: Column, ok: Column, error: Column, stt: Column, llm: Column) -> Column:
    """The output struct of an inference result; the total is null unless the stt latency is valid."""
    return F.struct(
        raw.alias("raw_text"), clean.alias("clean_text"), ok.alias("ok"), error.alias("error"), valid_latency(stt).alias("stt_latency_ms"),
        valid_latency(llm).alias("llm_latency_ms"), (valid_latency(stt) + valid_latency(llm)).alias("total_latency_ms"),
    )


#: Control characters as JSON texts have them, in the form that most writers use.
_CONTROL = {i: f"\\u{i:04x}" for i in range(32)} | {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}


def json_text(c: Column) -> Column:
    """A text as a JSON string, other than ASCII unescaped; null as null."""
    plain = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    full = reduce(lambda t, kv: F.replace(t, F.lit(chr(kv[0])), F.lit(kv[1])), _CONTROL.items(), plain)
    return F.coalesce(F.concat(F.lit('"'), F.when(c.rlike(r"[\x00-\x1f]"), full).otherwise(plain), F.lit('"')), F.lit("null"))


def json_object(**fields: Column) -> Column:
    """An object of JSON values with sorted keys and blanks after colons and commas."""
    parts = [F.concat(F.lit(f'"{k}": '), fields[k]) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def signature(**fields: Column) -> Column:
    """SHA-256 of text fields as a JSON object with sorted keys."""
    return F.sha2(json_object(**{k: json_text(c) for k, c in fields.items()}), 256)


def question_signature(judge: Column | None = None, *, oral, clean, output, question, evidence, category, options) -> Column:
    """SHA-256 of what a judgement hangs on, as sorted JSON: of its content, or with the judge's identity. ``options`` is
    an array of (text, score); a missing output counts as empty."""
    listed = F.transform(options, lambda o: json_object(text=json_text(o["text"]), score=F.coalesce(o["score"].cast("string"), F.lit("null"))))
    texts = {"oral": oral, "clean": clean, "output": F.coalesce(output, F.lit("")), "question": question, "evidence": evidence, "category": category}
    if judge is not None:
        texts["judge_model"] = judge
    fields = {k: json_text(c) for k, c in texts.items()}
    return F.sha2(json_object(options=F.concat(F.lit("["), F.array_join(listed, ", "), F.lit("]")), **fields), 256)


def judge_identity(model: Column, url: Column, prompt: Column, temperature: Column, is_default: Column) -> Column:
    """The model's name, and unless all settings are the usual ones a digest of them. ``temperature``: as JSON text."""
    settings = json_object(api_url=json_text(url), model=json_text(model), system_prompt=json_text(prompt), temperature=temperature)
    return F.when(is_default, model).otherwise(F.concat(model, F.lit("@"), F.left(F.sha2(settings, 256), F.lit(16))))


def best_score(options: Column) -> Column:
    return F.array_max(F.transform(options, lambda o: o["score"]))


def braced(c: Column) -> Column:
    """What stands from the first { to the last }, code fences aside; empty if nothing."""
    return F.regexp_extract(F.regexp_replace(c, r"(?m)^\s*```(?:json)?\s*|\s*```\s*$", ""), r"(?s)\{.*\}", 0)


def _bracketed(text: str, opening: str, closing: str) -> str | None:
    """What the last closing bracket closes."""
    end, depth = text.rfind(closing), 0
    for at in range(end, -1, -1):
        depth += (text[at] == closing) - (text[at] == opening)
        if text[at] == opening and depth == 0:
            return text[at : end + 1]
    return None


def _readings(text: str):
    """What may be the JSON value of a response: all of it, each tail that a bracket opens, the last list, the last object."""
    yield text
    yield from (text[i:] for i, c in enumerate(text) if c in "[{")
    yield from filter(None, (_bracketed(text, "[", "]"), _bracketed(text, "{", "}")))


def _find(text: str | None) -> str | None:
    body = (text or "").strip()
    if body.startswith("```"):
        body = body.partition("\n")[2] if "\n" in body else body[3:]
        body = (body.rpartition("```")[0] if "```" in body else body).strip()
    for reading in _readings(body):
        try:
            return json.dumps(json.loads(reading), ensure_ascii=False, sort_keys=True)
        except (ValueError, RecursionError):
            continue
    return None


@F.pandas_udf(StringType())
def find_json(s: pd.Series) -> pd.Series:
    """The JSON value of a model's answer, in canonical form: the whole text (without a code fence), else what stands
    from the first bracket on that is JSON to the end, else the last list, else the last object; null if none."""
    return s.map(_find)


#: The fields of a structured seed that name it, the first one first.
NAMES = ("name", "keyword", "term", "text", "value", "title", "entity", "phrase")


def filled(value: Column) -> Column:
    """Whether a JSON value (a variant) counts as one: not null, false, zero or empty."""
    plain, kind = F.to_json(value), F.schema_of_variant(value)
    zero = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & (F.try_variant_get(value, "$", "double") == 0)
    return F.coalesce(~((kind == "VOID") | plain.isin("false", '""', "[]", "{}") | zero), F.lit(False))


def structured_seed_key(c: Column) -> Column:
    """``seed_key`` of seeds that may be JSON objects: of the first naming field that has a value (see ``filled``), else of the whole object
    with sorted keys."""
    doc = F.try_parse_json(c)
    fields = [F.when(filled(F.try_variant_get(doc, f"$.{k}", "variant")), F.get_json_object(c, f"$.{k}")) for k in NAMES]
    is_object = F.coalesce(F.startswith(F.schema_of_variant(doc), F.lit("OBJECT")), F.lit(False))
    return seed_key(F.when(is_object, F.coalesce(*fields, find_json(c))).otherwise(c))


def _leaves(value) -> list[str]:
    if isinstance(value, list):
        return [x for v in value for x in _leaves(v)]
    if isinstance(value, dict):
        named = next((str(value[k]) for k in ("term", "name", "keyword", "entity") if value.get(k)), None)
        return [named] if named else [x for v in value.values() for x in _leaves(v)]
    return [str(value)] if value not in (None, "") else []


@F.pandas_udf(ArrayType(StringType()))
def flatten_seeds(s: pd.Series) -> pd.Series:
    """All texts of nested seed JSON; an object counts by its term, name, keyword or entity."""
    return s.map(lambda x: [] if x is None else list(dict.fromkeys(_leaves(json.loads(x)))))


#: Fields that may wrap the results of a generation.
WRAPPERS = ("data", "results", "sentences", "items", "instructions")


def _texts(value) -> list[str] | None:
    return [x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in value] if isinstance(value, list) else None


def _result(text: str | None, wrapped: bool) -> dict | None:
    """The object that an answer holds; of a list, and (``wrapped``) of a list in a wrapper, the first one."""
    found = _find(text)
    value = json.loads(found) if found is not None else None
    if wrapped and isinstance(value, dict):
        value = next((value[k] for k in WRAPPERS if isinstance(value.get(k), list)), value)
    if wrapped and isinstance(value, list):
        value = value[0] if value else None
    return value if isinstance(value, dict) else None


def _long_enough(value, least: int) -> str | None:
    return value.strip() if isinstance(value, str) and len(value.strip()) >= least else None


def _fields(text: str, *lists: str) -> StructType:
    return StructType([StructField(text, StringType()), *[StructField(x, ArrayType(StringType())) for x in lists]])


@F.pandas_udf(_fields("clean_text", "domain_keywords", "itn_types"))
def clean_result(s: pd.Series) -> pd.DataFrame:
    """clean_text, domain_keywords and itn_types of a clean generation's answer, a JSON object, the first of a list or of
    a wrapped list. All null without one, or if its text has under four characters; missing lists are empty."""
    out = []
    for x in s:
        value = _result(x, True)
        text = _long_enough(value.get("clean_text"), 4) if value else None
        out.append((text, *((_texts(value.get(k)) or [] for k in ("domain_keywords", "itn_types")) if text else (None, None))))
    return pd.DataFrame(out, columns=["clean_text", "domain_keywords", "itn_types"])


@F.pandas_udf(_fields("oral_text", "selected_seeds", "speech_phenomena"))
def oral_result(s: pd.Series) -> pd.DataFrame:
    """oral_text, selected_seeds and speech_phenomena of an oral generation's answer, a JSON object. All null without one, or
    if its text has under four characters; lists that are missing, or no lists, are null."""
    out = []
    for x in s:
        value = _result(x, False)
        text = _long_enough(value.get("oral_text"), 4) if value else None
        out.append((text, *(_texts(value.get(k)) if text else None for k in ("selected_seeds", "speech_phenomena"))))
    return pd.DataFrame(out, columns=["oral_text", "selected_seeds", "speech_phenomena"])

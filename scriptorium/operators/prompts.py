"""Prompts as Column expressions: templates, questions for a judge, scenes and their languages."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import json_text
from ..sources.files import read_json
from .curate import DEFAULT_SHARE, SCENES, controls

_FIELD = re.compile(r"\{\{|\}\}|\{(\w+)\}")


def render(template: str, **fields: Column) -> Column:
    """The template with each ``{name}`` replaced by the field's text; ``{{`` and ``}}`` stand for braces. A missing
    field is an error; a null one is written None. What a field holds is never read as a template."""
    parts, at = [], 0
    for m in _FIELD.finditer(template):
        parts.append(F.lit(template[at : m.start()]))
        if m[1] and m[1] not in fields:
            raise KeyError(m[1])
        parts.append(F.coalesce(fields[m[1]].cast("string"), F.lit("None")) if m[1] else F.lit(m[0][0]))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def texts_json(words: Column) -> Column:
    """An array of texts as JSON."""
    return F.concat(F.lit("["), F.array_join(F.transform(words, json_text), ", "), F.lit("]"))


def judge_prompt(oral: Column, clean: Column, output: Column, questions: Column) -> Column:
    """What a judge is asked about one sample: its texts, and its questions with numbered options."""
    option = lambda o, i: F.concat(F.lit('{"option_index": '), i.cast("string"), F.lit(', "text": '), json_text(o["text"]), F.lit("}"))
    listed = lambda q: F.concat(F.lit("["), F.array_join(F.transform(q["options"], option), ", "), F.lit("]"))
    pair = lambda name, c: F.concat(F.lit(f'"{name}": '), c)

    def one(q: Column) -> Column:
        texts = [pair(k, json_text(q[k])) for k in ("id", "category", "question", "evidence")]
        return F.concat(F.lit("{"), F.concat_ws(", ", *texts, pair("options", listed(q))), F.lit("}"))

    asked = F.concat(F.lit("["), F.array_join(F.transform(questions, one), ", "), F.lit("]"))
    return F.concat(F.lit("{"), F.concat_ws(", ", pair("oral", json_text(oral)), pair("clean", json_text(clean)), pair("output", json_text(output)), pair("qa", asked)), F.lit("}"))


#: The languages of prompts, by a scene's setting.
SPOKEN = {"en": "English", "zh-en-mix": "Chinese with natural English technical terms when needed", "zh": "Chinese"}


def scene_table(spark: SparkSession, settings: dict[str, dict] | None = None, contexts: dict[str, str] | None = None) -> DataFrame:
    """scene, share, language (of texts), spoken (the language's name in a prompt) and context of the known scenes and of those in
    ``settings``, which may set language, zh, en or zh-en-mix, by scene; without it, a scene's name tells. ``contexts``: the situation
    that a prompt tells, by scene."""
    rows, settings, contexts = [], settings or {}, contexts or {}
    for scene in sorted({*SCENES, *settings, *contexts}):
        english = scene.startswith("english_")
        own = settings.get(scene, {}).get("language", "en" if english else "zh")
        rows.append((scene, SCENES.get(scene, DEFAULT_SHARE), "en" if english else "zh", SPOKEN.get(own, SPOKEN["zh"]), contexts.get(scene)))
    return spark.createDataFrame(rows, "scene string, share double, language string, spoken string, context string")


#: What a prompt says of each control, unless the caller has texts of its own.
CONTROL_TEXTS = {
    "correction:none": "The speaker corrects nothing and means one thing throughout.",
    "correction:single": "The speaker says A and corrects it to B, once; B is meant.",
    "correction:rollback": "The speaker says A, changes to B and goes back to A; A is meant.",
    "correction:multiple": "The speaker says A, then B and later C; C is meant.",
    "oral:low": "Fluent speech, with one mild filler or repetition at most.",
    "oral:moderate": "Spontaneous speech, with some fillers, pauses and repeated words.",
    "oral:high": "Very colloquial, understandable speech, with many fillers, broken starts, stutters and repeated words.",
    "explanation": "One rare or ambiguous name is spelled or explained aloud, so that its spelling is clear.",
    "passthrough": "Clean written text: no correction, no filler, no repetition, no spoken numbers.",
}
#: What a prompt says without an additional control, and of a scene without a context.
NO_CONTROL, ANY_CONTEXT = "None", "a realistic voice interaction"


def oral_prompts(items: DataFrame, template: str, settings: dict[str, dict] | None = None, seed: int = 42, contexts: dict[str, str] | None = None, texts: dict[str, str] | None = None) -> DataFrame:
    """Adds prompt and speech_phenomena to (id, scene, seeds): the texts of seeded controls, and the scene's language and context, go into
    the template's fields scene, context, language, seeds, correction, oral_level and additional. ``texts`` has the control texts
    under the keys of ``CONTROL_TEXTS``."""
    told = CONTROL_TEXTS | (texts or {})
    named = F.create_map(*[F.lit(x) for pair in told.items() for x in pair])
    scenes = scene_table(items.sparkSession, settings, contexts).select("scene", F.col("spoken").alias("_spoken"), F.col("context").alias("_context"))
    rows = items.join(F.broadcast(scenes), "scene", "left").withColumn("_c", controls(F.col("id"), F.col("scene"), seed))
    clean, c = F.col("_c.correction") == "passthrough", F.col("_c")
    kinds = F.array(F.concat(F.lit("correction:"), c["correction"]), F.concat(F.lit("oral:"), c["level"]))
    said = F.when(clean, F.array(F.lit("clean"))).when(c["explain"], F.concat(kinds, F.array(F.lit("explanation")))).otherwise(kinds)
    text = lambda prefix, field: F.element_at(named, F.when(clean, "passthrough").otherwise(F.concat(F.lit(prefix), c[field])))
    fields = {
        "scene": F.col("scene"), "context": F.coalesce("_context", F.lit(ANY_CONTEXT)), "language": F.coalesce("_spoken", F.lit(SPOKEN["zh"])), "seeds": texts_json(F.col("seeds")),
        "correction": text("correction:", "correction"), "oral_level": text("oral:", "level"), "additional": F.when(c["explain"], told["explanation"]).otherwise(NO_CONTROL),
    }
    return rows.withColumn("prompt", render(template, **fields)).withColumn("speech_phenomena", said).drop("_c", "_spoken", "_context")


# --- prompt documents ---


def prompt_document(spark: SparkSession, path: str) -> dict:
    """A document of prompts: ``system_prompts`` and ``user_template``, texts by language or scene."""
    found = read_json(spark, path)
    if not isinstance(found, dict):
        raise FileNotFoundError(f"no prompt document at {path}")
    return found


def prompt_of(document: dict, key: str, fallback: str = "zh") -> dict[str, str]:
    """The system text and user template for a language or scene; those of the fallback where it has none."""
    pick = lambda name: document.get(name, {}).get(key, document.get(name, {}).get(fallback, ""))
    return {"system": pick("system_prompts"), "user": pick("user_template")}


def listed(document: dict, part: str = "system_prompts") -> list[str]:
    """The scenes or languages that a part of a document has prompts for; names that begin with ``_`` are notes."""
    return [k for k in document.get(part, {}) if not k.startswith("_")]


def by_language(document: dict, language: Column, fallback: str = "zh", **fields: Column) -> Column:
    """A struct (system, user) of each row's prompt, by the language of the row; the template's fields are filled in."""
    names = sorted({*document.get("system_prompts", {}), *document.get("user_template", {})})
    made = {n: prompt_of(document, n, fallback) for n in [*names, fallback]}
    one = lambda p: F.struct(F.lit(p["system"]).alias("system"), render(p["user"], **fields).alias("user"))
    return reduce(lambda rest, n: F.when(language == n, one(made[n])).otherwise(rest), names, one(made[fallback]))

"""Generation steps around a model call: oral texts from seeds, clean targets from oral texts, and checks of meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keywords as K
from ..functions.records import clean_result, find_json, oral_result
from ..functions.text import strip
from . import models, prompts
from .curate import passthrough

Call = Callable[[str], str]


def _asked(rows: DataFrame, prompt: Column, call: Call, attempts: int, workers: int) -> DataFrame:
    return models.generate(rows.withColumn("_prompt", prompt), "_prompt", call, workers, attempts).drop("_prompt")


def oral_records(items: DataFrame, call: Call, attempts: int = 3, workers: int = 8) -> DataFrame:
    """(id, oral_text, selected_seeds, speech_phenomena, scene) of (id, scene, seeds, prompt, speech_phenomena), see
    ``prompts.oral_prompts``. Calls that fail or answer without a text of at least four characters leave their item out; missing
    seeds are the candidates, missing phenomena the sampled ones; a clean item stays clean, whatever is answered."""
    answered = _asked(items, F.col("prompt"), call, attempts, workers).withColumn("_r", oral_result(F.col("response")))
    clean = passthrough(F.col("speech_phenomena"), exact=True)
    said = F.when(clean, F.array(F.lit("clean"))).otherwise(F.coalesce("_r.speech_phenomena", "speech_phenomena"))
    return answered.where("_r.oral_text IS NOT NULL").select("id", F.col("_r.oral_text").alias("oral_text"), F.coalesce("_r.selected_seeds", "seeds").alias("selected_seeds"), said.alias("speech_phenomena"), "scene")


def clean_records(items: DataFrame, document: dict, call: Call, attempts: int = 3, workers: int = 8) -> DataFrame:
    """The items (id, scene, oral_text, speech_phenomena and others) with clean_text, domain_keywords, keyword_list and itn_types.
    Passthrough items are their own target, without a call. Items with a text of under four characters, whose call failed, or whose answer
    holds no target are left out; keywords are those worth a review. ``document``: see ``prompts.prompt_document``; its templates
    have the field oral_text."""
    none = F.array().cast("array<string>")
    rows = items.where(F.length(F.coalesce("oral_text", F.lit(""))) >= 4).withColumn("_pass", F.coalesce(passthrough(F.col("speech_phenomena")), F.lit(False)))
    same = rows.where("_pass").drop("_pass").withColumn("clean_text", F.col("oral_text"))
    same = same.withColumn("domain_keywords", none).withColumn("keyword_list", none).withColumn("itn_types", none)
    language = F.when(F.startswith("scene", F.lit("english_")), "en").otherwise("zh")
    asked = prompts.by_language(document, language, oral_text=F.col("oral_text"))
    made = _asked(rows.where("NOT _pass").drop("_pass"), F.concat_ws("\n\n", asked["system"], asked["user"]), call, attempts, workers)
    made = made.withColumn("_r", clean_result(F.col("response"))).where("_r.clean_text IS NOT NULL")
    words = K.review_targets(F.col("_r.domain_keywords"), F.col("oral_text"), F.col("_r.clean_text"))
    made = made.withColumn("clean_text", F.col("_r.clean_text")).withColumn("domain_keywords", words).withColumn("keyword_list", words).withColumn("itn_types", F.col("_r.itn_types"))
    return same.unionByName(made.select(*same.columns))


def consistent(rows: DataFrame, prompt: Column, call: Call, attempts: int = 3, workers: int = 8) -> DataFrame:
    """The rows with consistent and reason, as a model says in a JSON object; what can't be read, or failed, counts as
    consistent."""
    answered = _asked(rows, prompt, call, attempts, workers)
    found = find_json(F.col("response"))
    doc = F.try_parse_json(found)
    is_object = F.coalesce(F.startswith(F.schema_of_variant(doc), F.lit("OBJECT")), F.lit(False))
    said = F.coalesce(F.get_json_object(found, "$.consistent"), F.lit("true"))
    reason = F.coalesce(F.when(is_object, strip(F.get_json_object(found, "$.reason"))), F.lit(""))
    return answered.withColumn("consistent", ~is_object | (said != "false")).withColumn("reason", reason).drop("response", "error")

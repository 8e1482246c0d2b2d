"""Rubrics: samples with questions and scored options, read from JSON texts and checked as a whole."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .evaluate import CATEGORIES

# An option ``text（score）``, with half- or full-width brackets, and the commas between options.
_OPTION = r"(.+?)\s*[（(]\s*(-?\d+)\s*[）)]"
_ALONE = re.compile(rf"\s*{_OPTION}\s*")
_LISTED = re.compile(rf"(?:^|[，,])\s*{_OPTION}(?=\s*[，,]|\s*$)")
#: The texts that a sample and a question must have.
SAMPLE_TEXTS, QUESTION_TEXTS = ("audio", "scene", "oral", "clean"), ("question", "evidence")


class RubricError(ValueError):
    """A sample that can't be judged, and why."""


def _text(value, field: str) -> str:
    found = value.get(field)
    if not isinstance(found, str) or not found.strip():
        raise RubricError(f"no {field}")
    return found


def _option(value) -> tuple[str, int]:
    if isinstance(value, str):
        if m := _ALONE.fullmatch(value):
            return m[1], int(m[2])
        raise RubricError("an option without a score")
    if not isinstance(value, dict) or not isinstance(value.get("score"), int):
        raise RubricError("an option without a score")
    return _text(value, "text"), int(value["score"])


def read_options(value) -> list[tuple[str, int]]:
    """(text, score) of options, which are objects or texts in a list, or one text with commas between them."""
    if isinstance(value, str):
        if _LISTED.sub("", value).strip(" ，,"):
            raise RubricError("options that can't be read")
        return [(text, int(score)) for text, score in _LISTED.findall(value)] or _none()
    return [_option(x) for x in value] if isinstance(value, list) and value else _none()


def _none():
    raise RubricError("no options")


def read_sample(text: str) -> tuple[dict[str, str], list[dict]]:
    """(texts of the sample, its questions) of a JSON object; ``RubricError`` if anything is missing, unknown or there twice."""
    try:
        record = json.loads(text)
    except (TypeError, ValueError) as e:
        raise RubricError("no JSON") from e
    if not isinstance(record, dict):
        raise RubricError("no object")
    sample = {"sample_id": _text(record, "source_record_id")} | {k: _text(record, k) for k in SAMPLE_TEXTS}
    asked = record.get("qa")
    if not isinstance(asked, list) or not asked:
        raise RubricError("no questions")
    questions = []
    for q in asked:
        if not isinstance(q, dict):
            raise RubricError("a question that is no object")
        category = _text(q, "category")
        if category not in CATEGORIES:
            raise RubricError(f"unknown category {category}")
        questions.append({"question_id": _text(q, "id"), "category": category, **{k: _text(q, k) for k in QUESTION_TEXTS}, "options": read_options(q.get("options"))})
    if len({q["question_id"] for q in questions}) < len(questions):
        raise RubricError("a question twice")
    return sample, questions


_TEXTS = ("sample_id", *SAMPLE_TEXTS, "question_id", "category", *QUESTION_TEXTS)
_OPTIONS = ArrayType(StructType([StructField("text", StringType()), StructField("score", IntegerType())]))


@udtf(returnType=StructType([*[StructField(k, StringType()) for k in _TEXTS], StructField("options", _OPTIONS), StructField("violation", StringType())]))
class RubricQuestions:
    """A table function of a sample's JSON text: a row for each question; or one with the violation alone."""

    def eval(self, text):
        try:
            sample, questions = read_sample(text)
        except RubricError as e:
            yield (*[None] * len(_TEXTS), None, str(e))
            return
        for q in questions:
            yield (*[(sample | q)[k] for k in _TEXTS], q["options"], None)


def questions(records: DataFrame, text: str = "value") -> DataFrame:
    """The rows (with a sample's JSON in ``text``) joined laterally with their questions: sample_id, audio, scene, oral, clean,
    question_id, category, question, evidence, options (text, score) and violation, which tells why a sample has none. A sample counts as a
    whole or not at all."""
    spark, view = records.sparkSession, f"rubric_{uuid.uuid4().hex}"
    spark.udtf.register("rubric_questions", RubricQuestions)
    records.createOrReplaceTempView(view)
    try:
        return spark.sql(f"SELECT r.*, q.* FROM {view} r, LATERAL rubric_questions(r.`{text}`) q")
    finally:
        spark.catalog.dropTempView(view)


def readiness(matched: DataFrame, outputs: DataFrame) -> DataFrame:
    """One row for a dry run: samples that can be judged, those of them whose recognition failed, and outputs outside of the benchmark.
    ``matched``: see ``evaluate.match``."""
    found = matched.agg(F.count(F.lit(1)).alias("ready"), F.count_if(F.col("asr_error").isNotNull()).alias("failed"))
    total = outputs.agg(F.count(F.lit(1)).alias("n"))
    return found.join(total).select("ready", "failed", (F.col("n") - F.col("ready")).alias("outside"))

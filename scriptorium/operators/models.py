"""Model calls: a small plug-in surface with deterministic stand-ins, so that every operator runs without a service."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

Refiner = Callable[[list[str]], list[str]]


def identity() -> Refiner:
    return lambda texts: [t.strip() for t in texts]


def retried(call: Callable, attempts: int = 3, wait: Callable[[int], float] = lambda k: 2.0**k) -> Callable:
    """The call, repeated after errors with growing pauses; the last error is raised."""

    def run(*args):
        for k in range(attempts):
            try:
                return call(*args)
            except Exception:
                if k == attempts - 1:
                    raise
                time.sleep(wait(k))

    return run


def refine_udf(load: Callable[[], Refiner]):
    """A text function; the refiner is loaded once a worker."""

    @pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        refine = load()
        for s in batches:
            yield pd.Series(_checked(refine, s.fillna("").tolist()))

    return run


def _checked(refine: Refiner, texts: list[str]) -> list[str]:
    out = refine(texts)
    if len(out) != len(texts) or not all(isinstance(x, str) for x in out):
        raise ValueError("a refiner must return one text for each input")
    return [x.strip() for x in out]


def refine_batches(rows: DataFrame, text: str, load: Callable[[], Refiner], size: int = 8, clock: Callable[[], float] = time.perf_counter) -> DataFrame:
    """Adds clean_text, ok, error and llm_latency_ms (that of the whole batch). Blank inputs get an input_error row;
    a failed batch gets its error, and other batches go on."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refine = load()
        for pdf in frames:
            pdf = pdf.assign(clean_text=None, ok=False, error=None, llm_latency_ms=float("nan"))
            blank = pdf[text].isna() | (pdf[text].fillna("").str.strip() == "")
            pdf.loc[blank, "error"] = "input_error: blank text"
            todo = pdf.index[~blank]
            for i in range(0, len(todo), size):
                part, began = todo[i : i + size], clock()
                try:
                    pdf.loc[part, "clean_text"] = _checked(refine, pdf.loc[part, text].tolist())
                    pdf.loc[part, "ok"] = True
                except Exception as e:  # noqa: BLE001 - reported with the rows
                    pdf.loc[part, "error"] = f"{type(e).__name__}: {e}"
                pdf.loc[part, "llm_latency_ms"] = (clock() - began) * 1000
            yield pdf

    return rows.mapInPandas(run, f"{kinds}, clean_text string, ok boolean, error string, llm_latency_ms double")


def generate(rows: DataFrame, prompt: str, call: Callable[[str], str], workers: int = 8, attempts: int = 3) -> DataFrame:
    """Adds response and error, with a bounded pool of calls a task. Calls must be safe to repeat."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def one(text: str) -> tuple[str | None, str | None]:
        try:
            return retried(call, attempts)(text), None
        except Exception as e:  # noqa: BLE001
            return None, f"{type(e).__name__}: {e}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for pdf in frames:
                found = list(pool.map(one, pdf[prompt].tolist()))
                yield pdf.assign(response=[x for x, _ in found], error=[y for _, y in found])

    return rows.mapInPandas(run, f"{kinds}, response string, error string")


class JudgeError(ValueError):
    """An answer that doesn't fit its questions."""


def checked_answers(answers: list[tuple[str, int]], questions: list) -> list[tuple[str, int]]:
    """The answers (question id, option index), in the order of the questions, if each question has just one, in range."""
    sizes, found = {q["id"]: len(q["options"]) for q in questions}, {}
    for name, index in answers:
        if not isinstance(name, str) or name not in sizes or name in found:
            raise JudgeError(f"{'repeated' if name in found else 'unknown'} question {name!r}")
        if isinstance(index, bool) or not isinstance(index, int) or not 0 <= index < sizes[name]:
            raise JudgeError(f"option {index!r} of question {name!r}")
        found[name] = index
    if missing := [q for q in sizes if q not in found]:
        raise JudgeError(f"no answer to {missing}")
    return [(q, found[q]) for q in sizes]


def read_answers(text: str, questions: list) -> list[tuple[str, int]]:
    """The checked answers of a judge's text: a JSON object, in a code fence or in prose, with a list ``answers`` of objects
    with id and option_index. Raises ``JudgeError`` if it has none or they don't fit the questions."""
    body = text.strip()
    if body.startswith("```") and body.endswith("```"):
        body = "\n".join(body.splitlines()[1:-1]).strip()
    first, last = body.find("{"), body.rfind("}")
    if first < 0 or last <= first:
        raise JudgeError("no JSON object")
    try:
        found = json.loads(body[first : last + 1])
    except ValueError as e:
        raise JudgeError(f"no valid JSON: {e}") from e
    answers = found.get("answers") if isinstance(found, dict) else None
    if not isinstance(answers, list):
        raise JudgeError("no answers array")
    if not all(isinstance(a, dict) for a in answers):
        raise JudgeError("an answer is no object")
    return checked_answers([(a.get("id"), a.get("option_index")) for a in answers], questions)


@udtf(returnType=StructType([StructField("question_id", StringType()), StructField("option_index", IntegerType()), StructField("error", StringType())]))
class JudgeAnswers:
    """A table function of a judge's text and its questions (id, options): a row for each question, in their order; or one with the error alone."""

    def eval(self, text, questions):
        try:
            for name, index in read_answers(text or "", [q.asDict() for q in questions or []]):
                yield name, index, None
        except JudgeError as e:
            yield None, None, str(e)


def answers_of(rows: DataFrame, text: str = "response", questions: str = "questions") -> DataFrame:
    """The rows with question_id, option_index and error: a lateral join with ``JudgeAnswers``."""
    spark, view = rows.sparkSession, f"judged_{uuid.uuid4().hex}"
    spark.udtf.register("judge_answers", JudgeAnswers)
    rows.createOrReplaceTempView(view)
    try:
        return spark.sql(f"SELECT r.*, a.* FROM {view} r, LATERAL judge_answers(r.`{text}`, r.`{questions}`) a")
    finally:
        spark.catalog.dropTempView(view)


def judge(samples: DataFrame, ask: Callable[[str, list], list[tuple[str, int]]], attempts: int = 3, workers: int = 4, wait: Callable[[int], float] = lambda k: 2.0 ** (k - 1)) -> DataFrame:
    """(sample_id, question_id, option_index, error): a row for each question of (sample_id, output, questions). ``ask``
    gets a sample's output and questions and returns (question id, option index) pairs; answers that don't fit are asked
    for again. A sample that fails in all attempts has one row, with its error; others go on."""
    asked = retried(lambda text, questions: checked_answers(ask(text, questions), questions), attempts, wait)

    def one(x) -> list[tuple]:
        sample, text, questions = x
        try:
            return [(sample, q, i, None) for q, i in asked(text or "", list(questions))]
        except Exception as e:  # noqa: BLE001 - reported with the sample
            return [(sample, None, None, f"{type(e).__name__}: {e}")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for pdf in frames:
                out = [r for rows in pool.map(one, zip(pdf.sample_id, pdf.output, pdf.questions)) for r in rows]
                yield pd.DataFrame(out, columns=["sample_id", "question_id", "option_index", "error"], dtype=object)

    return samples.select("sample_id", "output", "questions").mapInPandas(run, f"sample_id {samples.schema['sample_id'].dataType.simpleString()}, question_id string, option_index int, error string")


# --- plug-ins: each takes a callable, and has a stand-in that needs no service ---


def local_refiner(load: Callable[[], Callable[[str, int], str]], template: str = "{text}", max_tokens: int = 512) -> Callable[[], Refiner]:
    """A refiner that runs a model in the worker, for ``refine_udf`` or ``refine_batches``. ``load`` gives a function of
    (prompt, max_tokens) to the answer; the stand-in ``echo`` answers with the prompt."""
    from .markers import plain_answer

    def made() -> Refiner:
        model = load()
        return lambda texts: [plain_answer(model(template.replace("{text}", t), max_tokens)) for t in texts]

    return made


def echo() -> Callable[[str, int], str]:
    return lambda prompt, max_tokens: prompt


def speech_round_trip(speak: Callable[[str, str], bytes], hear: Callable[[bytes, str], str], cache: DataFrame | None = None, settings: tuple[str, ...] = (), attempts: int = 3, new: str | None = None):
    """A ``call`` for ``curate.simulate``: texts are spoken and recognised again. ``cache`` (key, value) holds what was
    heard before, under the digest of settings, language and text; only new texts are spoken, each once, and written to ``new`` (a
    path in a shared folder, by default one below it), which a later run may take for its cache. Failures give a null and
    are not cached."""
    from ..functions.text import service_language
    from ..sources.files import cached
    from ..sources.shared import folder

    def one(text: str, language: str) -> str | None:
        try:
            return retried(lambda: hear(speak(text, language), language), attempts)().strip() or None
        except Exception:  # noqa: BLE001 - the caller falls back or fails
            return None

    def compute(rows: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                yield pd.DataFrame({"key": pdf.key, "value": [one(t, x) for t, x in zip(pdf.oral_text, pdf.spoken)]})

        return rows.select("key", "oral_text", "spoken").mapInPandas(run, "key string, value string")

    def call(rows: DataFrame) -> DataFrame:
        spark = rows.sparkSession
        known = (cache if cache is not None else spark.createDataFrame([], "key string, value string")).where("value IS NOT NULL")
        language = F.when(F.startswith("scene", F.lit("english_")), "en").otherwise("zh")
        if "language" in rows.columns:
            language = F.coalesce("language", language)
        named = rows.withColumn("spoken", service_language(language)).withColumn("settings", F.lit("\n".join(settings)))
        heard, _ = cached(named, known, ["settings", "spoken", "oral_text"], compute, new or f"{folder(spark)}/heard-{uuid.uuid4().hex}")
        return heard.withColumn("said", F.col("value")).withColumn("wanted", F.lit(None).cast("string")).drop("spoken", "settings", "key", "value")

    return call


def seed_round(pool: DataFrame, categories: DataFrame, ask: Callable[[str], str], prompt: str = "prompt", attempts: int = 3) -> DataFrame:
    """One round of new seeds: ``categories`` (scene, category and the prompt, with what to leave out) are sent to ``ask``,
    whose JSON answers are flattened and merged behind the pool (scene, category, pos, seed). Failed calls add nothing."""
    from ..functions.records import find_json, flatten_seeds
    from .dedup import merge_seeds

    answers = generate(categories, prompt, ask, attempts=attempts)
    found = answers.select("scene", "category", F.posexplode(flatten_seeds(find_json(F.col("response")))).alias("pos", "seed"))
    return merge_seeds(pool.select("scene", "category", "pos", "seed"), found.withColumn("pos", F.col("pos").cast(pool.schema["pos"].dataType)))

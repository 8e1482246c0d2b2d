"""Matching outputs with rubrics, incremental judging and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import best_score, question_signature
from ..functions.text import blank

#: The status of results that need no further judging.
FINAL = ("success",)
CATEGORIES = ("content", "format", "filter", "rephrase")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unique(rows: DataFrame, key: str) -> DataFrame:
    """The same rows; evaluation fails if a key repeats."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    checked = n.where(F.assert_true(F.col("_n") == 1, F.concat(F.lit(f"duplicate {key}: "), F.col(key).cast("string"))).isNull()).drop("_n")
    return rows.join(checked, key, "left_semi")


def eligible(rubric: DataFrame) -> DataFrame:
    return rubric.where((F.col("status") == "success") & (F.size("qa") > 0))


def match(outputs: DataFrame, rubric: DataFrame, key: str = "source_record_id") -> DataFrame:
    """Inner join of outputs (text, latency_ms, error) with the eligible rubric. A missing text counts as empty and
    stays in the denominator; its error is kept."""
    failed = F.col("text").isNull()
    joined = unique(outputs, key).join(unique(eligible(rubric), key), key)
    return joined.withColumn("asr_error", F.when(failed, F.col("error"))).withColumn("output", F.coalesce("text", F.lit(""))).drop("text", "error")


def violations(rows: DataFrame, **required: Column) -> DataFrame:
    """Rows with the names of required text columns that are missing or blank."""
    bad = F.filter(F.array(*[F.when(blank(c), F.lit(k)) for k, c in sorted(required.items())]), lambda x: x.isNotNull())
    return rows.withColumn("violations", bad).where(F.size("violations") > 0)


def parted(rows: DataFrame, **required: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, invalid rows with violations) by required text columns; every row is in one of them."""
    bad = violations(rows, **required)
    ok = ~F.greatest(*[blank(c) for c in required.values()], F.lit(False))
    return rows.where(ok), bad


def question_violations(questions: DataFrame) -> DataFrame:
    """Questions (sample_id, id, category, options) with an unknown category, no options, or a repeated id."""
    n = questions.groupBy("sample_id", "id").agg(F.count(F.lit(1)).alias("n"), F.first("category").alias("category"), F.min(F.size("options")).alias("options"))
    reason = F.when(F.col("n") > 1, "duplicate id").when(~F.col("category").isin(*CATEGORIES), "category").when(F.coalesce("options", F.lit(0)) <= 0, "options")
    return n.select("sample_id", "id", reason.alias("reason")).where("reason IS NOT NULL")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order``; rows with a null key are left out. Aggregates before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    kept = rows.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    return kept.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def completed(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Keys whose last result is ok, or an error of the input."""
    return latest(rows, [key], order).where((F.col("ok") == F.lit(True)) | F.startswith(F.col("error"), F.lit("input_error:"))).select(key)


def pending(rows: DataFrame, done: DataFrame, key: str, order: str, limit: int | None = None) -> DataFrame:
    """The rows that are not done, in their order the first ``limit``; evaluation fails if a key repeats among all rows."""
    out = unique(rows, key).join(done, key, "left_anti")
    return out.orderBy(order).limit(limit) if limit else out


def with_results(questions: DataFrame, results: DataFrame, order: str = "ord") -> DataFrame:
    """Each question with its latest result, if that has the question's current signature."""
    last = latest(results, ["sample_id", "question_id"], order).withColumnRenamed("signature", "_signature")
    q, r = questions.alias("q"), last.alias("r")
    on = (F.col("q.sample_id") == F.col("r.sample_id")) & (F.col("q.question_id") == F.col("r.question_id")) & (F.col("q.signature") == F.col("r._signature"))
    return q.join(r, on, "left").select("q.*", *[F.col(f"r.{c}") for c in last.columns if c not in ("sample_id", "question_id", "_signature") and c not in questions.columns])


def finished(matched: DataFrame) -> DataFrame:
    """Samples all of whose questions have a final result. ``matched``: a row for each question with the status of its
    current result (see ``with_results``), null without one. Failed questions are judged again."""
    done = F.coalesce(F.col("status").isin(*FINAL), F.lit(False))
    return matched.groupBy("sample_id").agg(F.every(done).alias("all_done")).where("all_done").select("sample_id")


def chosen(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Score and best score of each answered question, by the answer's position among the options."""
    return questions.join(answers, ["sample_id", "question_id"]).withColumn("score", F.try_element_at("options", F.col("option_index") + 1)["score"]).withColumn("max_score", F.array_max(F.transform("options", lambda o: o["score"])))


def answer_errors(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(sample_id, question_id, reason): unknown or repeated ids, positions out of range, missing answers."""
    a = answers.groupBy("sample_id", "question_id").agg(F.count(F.lit(1)).alias("n"), F.first("option_index").alias("option_index"))
    j = questions.select("sample_id", "question_id", F.size("options").alias("size")).join(a, ["sample_id", "question_id"], "full")
    reason = F.when(F.col("size").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").when(F.col("option_index").isNull() | (F.col("option_index") < 0) | (F.col("option_index") >= F.col("size")), "range")
    return j.select("sample_id", "question_id", reason.alias("reason")).where("reason IS NOT NULL")


def judge_rows(questions: DataFrame, answers: DataFrame, model: str, identity: str) -> DataFrame:
    """Result rows of judged questions: what was asked, the chosen option, its score, signatures and time.

    ``questions``: a row for each question, with sample_id, audio, scene, question_id, category, question, evidence,
    oral, clean, output, options (text, score) and asr_error. Samples with a missing, repeated or impossible answer
    have no rows at all, so no partial result is ever stored."""
    wrong = answer_errors(questions, answers).select("sample_id").distinct()
    rows = questions.join(wrong, "sample_id", "left_anti").join(answers, ["sample_id", "question_id"])
    option, gone = F.element_at("options", F.col("option_index") + 1), F.col("asr_error").isNotNull()
    parts = {k: F.col(k) for k in ("oral", "clean", "output", "question", "evidence", "category", "options")}
    return rows.select(
        "sample_id", "audio", "scene", "question_id", "category", "question", "evidence", "oral", "clean", F.coalesce("output", F.lit("")).alias("output"),
        F.lit(model).alias("judge_model"), question_signature(**parts).alias("content_signature"), question_signature(F.lit(identity), **parts).alias("evaluation_signature"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("evaluated_at"), F.lit("success").alias("status"),
        F.col("option_index").alias("selected_option_index"), option["text"].alias("selected_option"), option["score"].alias("score"), best_score(F.col("options")).alias("max_score"),
        F.when(gone, True).alias("asr_retry_exhausted"), F.col("asr_error"),
    )


def outside(outputs: DataFrame, matched: DataFrame) -> DataFrame:
    """One row with the number of outputs, of matched ones, and of those outside of the benchmark (no rubric, or none
    that can be judged)."""
    a, b = outputs.agg(F.count(F.lit(1)).alias("outputs")), matched.agg(F.count(F.lit(1)).alias("matched"))
    return a.join(b).withColumn("outside", F.col("outputs") - F.col("matched"))


def allowed(samples: DataFrame, ids: DataFrame | None, key: str = "sample_id") -> DataFrame:
    """The samples on the list; all without a list."""
    return samples if ids is None else samples.join(ids.select(key).distinct(), key, "left_semi")


def _scores(rows: DataFrame, *by: str) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), total("score").alias("score"), total("best").alias("max_score"))
    share = F.coalesce(F.try_divide(F.col("score"), F.col("max_score")), F.lit(0.0))
    return out.withColumn("normalized", F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def summary(rows: DataFrame) -> DataFrame:
    """Scores overall (always a row), by category and by scene, in this order and sorted: kind, value, n, score, max_score
    and normalized. Only successful rows with a score, category and scene count; a missing max_score is 2 for filter
    and rephrase, else 1."""
    best = F.coalesce(F.col("max_score"), F.when(F.col("category").isin("filter", "rephrase"), 2).otherwise(1))
    scored = rows.where((F.col("status") == "success") & F.col("score").isNotNull() & F.col("category").isNotNull() & F.col("scene").isNotNull()).select("category", "scene", "score", best.alias("best"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("category", "scene")])
    groups = _scores(scored.select("score", "best", F.explode(kinds).alias("k")).select("score", "best", "k.*"), "kind", "value")
    overall = _scores(scored).select(F.lit("overall").alias("kind"), F.lit("").alias("value"), "n", "score", "max_score", "normalized")
    order = F.when(F.col("kind") == "overall", 0).when(F.col("kind") == "category", 1).otherwise(2)
    return overall.unionByName(groups).orderBy(order, "value")


def run_counts(rows: DataFrame) -> DataFrame:
    """One row: failed questions, and questions and samples whose recognition was given up, whatever their status."""
    gone = F.coalesce("asr_retry_exhausted", F.lit(False))
    failed = ~F.coalesce(F.col("status") == "success", F.lit(False))
    return rows.agg(F.count_if(failed).alias("failed_questions"), F.count_if(gone).alias("exhausted_questions"), F.count_distinct(F.when(gone, F.col("sample_id"))).alias("exhausted_samples"))


def error_rates(measured: DataFrame, *by: str) -> DataFrame:
    """Corpus rates of a struct column m, errors over reference units (0 without units), with both; and the mean of the
    latencies that are known (0 without any) and the number of those that are not. Of repeated samples, take the last
    first (``latest``)."""
    total = lambda c: F.coalesce(F.sum(f"m.{c}"), F.lit(0)).cast("long")
    found = measured.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[total(f"{k}_{x}").alias(f"{k}_{x}") for k in ("wer", "cer", "mer") for x in ("errors", "units")],
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("mean_latency_ms"), F.count_if(F.col("latency_ms").isNull()).alias("missing_latency"),
    )
    for k in ("wer", "cer", "mer"):
        found = found.withColumn(k, F.coalesce(F.try_divide(F.col(f"{k}_errors"), F.col(f"{k}_units")), F.lit(0.0)))
    return found


def summary_document(samples: DataFrame, results: DataFrame, measured: DataFrame, config: dict, outputs: int | None = None) -> dict:
    """The summary of a run: run, overall, by_category, by_scene, asr_metrics and config.

    ``samples``: a row for each question of each matched sample, with sample_id, question_id and signature; ``results``: result rows
    with the columns of ``judge_rows`` and ord, the last of each question with the question's signature counts; ``measured``: a row
    for each matched sample, with m (``text_metrics``) and latency_ms; ``outputs``: how many outputs there were, with or without a rubric.
    The driver gets a row for each category and scene."""
    held = with_results(samples, results.withColumnRenamed("evaluation_signature", "signature")).persist()
    try:
        asked = held.agg(F.count_distinct("sample_id").alias("n")).first().n
        done, current = finished(held).count(), held.where(F.col("status").isNotNull())
        counts, scores = run_counts(current).first(), summary(current).collect()
        rates = error_rates(measured).first()
    finally:
        held.unpersist()
    score = lambda r: {"question_count": r.n, "score": r.score, "max_score": r.max_score, "normalized_score": r.normalized}
    by = lambda kind: {r.value: score(r) for r in scores if r.kind == kind}
    rates = rates.asDict() if rates else {}
    n = rates.get("n", 0)
    units = {x: y for k in ("wer", "cer", "mer") for x, y in ((k, rates.get(k, 0.0)), (f"{k}_errors", rates.get(f"{k}_errors", 0)), (f"{k}_reference_units", rates.get(f"{k}_units", 0)))}
    run = {
        "total_sample_count": asked, "completed_sample_count": done, "failed_question_count": counts.failed_questions, "asr_retry_exhausted_sample_count": counts.exhausted_samples,
        "asr_retry_exhausted_question_count": counts.exhausted_questions,
    }
    if outputs is not None:
        run |= {"input_asr_sample_count": outputs, "out_of_benchmark_asr_sample_count": outputs - asked}
    asr = {
        "sample_count": n, "text_metric_sample_count": n, "latency_sample_count": n - rates.get("missing_latency", 0), "missing_latency_sample_count": rates.get("missing_latency", 0),
        "average_latency_ms": rates.get("mean_latency_ms", 0.0), **units,
    }
    return {"run": run, "overall": score(next(r for r in scores if r.kind == "overall")), "by_category": by("category"), "by_scene": by("scene"), "asr_metrics": asr, "config": config}

"""The last steps of a training set: final rows, coverage, statistics, and the whole curation run as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import char_ngrams, jaccard
from ..sources.files import write_jsonl
from . import curate, dedup, waves

#: The reasons of ``curate.skip_reason``.
SKIPPED = ("skipped_empty", "skipped_short")


def final_rows(rows: DataFrame) -> DataFrame:
    """What a training set holds of a record: input, output and meta."""
    return rows.select("input", "output", "meta")


def is_duplicate(text: Column, retained: Column, threshold: float = 0.75, n: int = 3) -> Column:
    """Whether a text is similar to one of an array of retained texts. For a few; ``dedup.near_dedup`` is for tables."""
    own = char_ngrams(text, n)
    return F.exists(retained, lambda x: jaccard(own, char_ngrams(x, n)) >= threshold)


def coverage(before: DataFrame, after: DataFrame, wanted: int) -> DataFrame:
    """One row: rows before and after a step, the percentage removed (0 of none), and the share of the wanted number."""
    a, b = before.agg(F.count(F.lit(1)).alias("before")), after.agg(F.count(F.lit(1)).alias("after"))
    gone = F.when(F.col("before") > 0, (F.col("before") - F.col("after")) / F.col("before") * 100).otherwise(0.0)
    return a.join(b).withColumn("removed_percent", gone).withColumn("coverage", F.col("after") / F.lit(wanted) if wanted else F.lit(0.0))


def _document(found: dict, wanted: int, threshold: float, target: dict[str, float]) -> dict:
    total = found["total"]
    shares = {s: found["scene"].get(s, 0) / total for s in target} if total else {}
    warnings = [f"{s}: target={target[s]:.2%}, actual={x:.2%} (dev={abs(x - target[s]):.2%})" for s, x in shares.items() if abs(x - target[s]) > 0.05]
    return {"total_samples": total, "target_samples": wanted, "coverage": total / wanted if wanted else 0, "dedup_threshold": threshold, "distribution": found, "warnings": warnings}


def _counted(rows: DataFrame) -> dict:
    found: dict = {"total": 0, "scene": {}, "language": {}, "is_fragment": {}}
    for r in sorted(curate.distribution(rows, *(F.col(f"meta.{k}") for k in ("scene", "language", "is_fragment"))).collect()):
        if r.kind == "total":
            found["total"] = r.n
        else:
            found[r.kind][r.value] = r.n
    return found


def statistics(rows: DataFrame, wanted: int, threshold: float = 0.75, target: dict[str, float] = curate.SCENES) -> dict:
    """The statistics document of a final set (rows with meta): numbers, coverage, distribution and warnings of drift.
    The driver gets a row for each scene and language."""
    return _document(_counted(rows), wanted, threshold, target)


#: Languages that a set may have; others cost ``write_final`` a second pass, over what it wrote.
LANGUAGES = ("zh", "en")


def write_final(rows: DataFrame, path: str, wanted: int, threshold: float = 0.75, target: dict[str, float] = curate.SCENES, reason: Column | None = None) -> tuple[dict, dict[str, int]]:
    """Writes the final rows of ``rows`` without a ``reason`` to be left out as JSON lines, and returns (the document of ``statistics``, rows by
    reason): all counted as the rows pass, in the job that writes. Reasons are those of ``curate.skip_reason``."""
    why = reason if reason is not None else F.lit(None).cast("string")
    own = {k: F.coalesce(F.col(f"meta.{k}"), F.lit("unknown")) for k in ("scene", "language")}
    known = {"scene": [*target, "unknown"], "language": [*LANGUAGES, "unknown"]}
    kept, seen = F.col("_why").isNull(), Observation()
    counts = {("total", ""): kept, ("is_fragment", "True"): kept & F.coalesce("meta.is_fragment", F.lit(False)), **{("skip", x): F.col("_why") == x for x in SKIPPED}}
    for k, names in known.items():
        counts |= {(k, x): kept & (own[k] == x) for x in names} | {(k, None): kept & ~own[k].isin(names)}
    named = {f"c{i}": key for i, key in enumerate(counts)}
    watched = rows.withColumn("_why", why).observe(seen, *[F.count_if(c).alias(f"c{i}") for i, c in enumerate(counts.values())])
    write_jsonl(final_rows(watched.where("_why IS NULL")), path)
    got = {named[c]: n for c, n in seen.get.items()}
    found: dict = {"total": got["total", ""], "scene": {}, "language": {}, "is_fragment": {}}
    for (kind, value), n in sorted(got.items(), key=lambda x: (x[0][0], x[0][1] or "")):
        if kind in known and value is not None and n:
            found[kind][value] = n
    marks = {"False": got["total", ""] - got["is_fragment", "True"], "True": got["is_fragment", "True"]}
    found["is_fragment"] = {k: n for k, n in marks.items() if n}
    if got["scene", None] or got["language", None]:  # names that no counter was made for
        found = _counted(rows.sparkSession.read.schema(rows.select("meta").schema).json(path))
    return _document(found, wanted, threshold, target), {x: got["skip", x] for x in SKIPPED}


def finalize(
    records: DataFrame, wanted: int, response: Column | None = None, threshold: float = 0.75, target: dict[str, float] = curate.SCENES, judge: waves.Judge | None = None, log: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) of assembled records (id, scene, ord, input, output, meta): each scene gives its quota of the
    first records, with ``response`` (answers that are there already) or ``judge`` (see ``waves.judged``; asked until
    the quota is full, with its log in the folder ``log``) of the first that pass; the kept ones of all scenes lose
    their near copies. rejected has qc_reason and holds what was turned down before a scene's quota was full."""
    rows = records.join(curate.quotas(records.select("scene").distinct(), wanted, target).select("scene", "target"), "scene")
    why = curate.precheck(F.col("input"), F.col("output.refined_text"))
    if judge is not None:
        rows = waves.judged(rows, F.col("target"), judge, log, why).drop("response")
    elif response is None:
        taken = curate.first_n(rows, F.col("target"), "scene", "ord")
        return dedup.near_dedup(taken.drop("target"), "ord", "input", threshold), taken.limit(0)
    else:
        said = curate.verdict(response)
        rows = rows.withColumn("qc_reason", F.coalesce(why, F.when(response.isNull(), "QC call failed"), F.when(~said["passed"], said["reason"])))
    rows = curate.first_passing(rows, F.col("qc_reason").isNull(), F.col("target"), "scene", "ord").drop("target")
    kept = rows.where("kept").drop("kept", "qc_reason")
    return dedup.near_dedup(kept, "ord", "input", threshold), rows.where("NOT kept").drop("kept")

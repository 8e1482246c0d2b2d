"""Stateful speech-text operators: activity segments, stable chunks of growing hypotheses, sliding refinement.

Each is a small machine with a JSON state. The same machine runs in batch (``fold``: one group, sorted by seq)
and as a stream (``fold_stream``: state kept by Spark for each session, rows of a micro-batch sorted by seq).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Machine = Callable[[dict, dict], list[dict]]

# Marks that end a sentence, and marks at which an overlong text may be cut.
_END = re.compile(r"[.!?。！？]\s*")
_CUT = re.compile(r"[,;:!?，。！？；：、]\s*")


def chunker(max_chars: int = 80, on_revision: str = "fail") -> Machine:
    """Rows (hypothesis, vad_boundary) to chunks (index, text, error).

    A chunk ends with the first sentence if that is short enough; a longer text is cut after its last mark
    within the limit, or at the limit. A boundary emits the rest and starts a new hypothesis. A hypothesis
    that takes back emitted text fails, or (``on_revision="report"``) gives an error row and is skipped."""
    if max_chars < 1:
        raise ValueError("max_chars must be at least 1")

    def cut(rest: str, boundary: bool) -> int:
        end = _END.search(rest)
        if end and end.end() <= max_chars:
            return end.end()
        if len(rest) > max_chars:
            marks = [m.end() for m in _CUT.finditer(rest[:max_chars])]
            return marks[-1] if marks else max_chars
        return len(rest) if boundary else 0

    def step(state: dict, row: dict) -> list[dict]:
        text, given = (row["hypothesis"] or "").strip(), state.get("given", "")
        if not text.startswith(given):
            if on_revision == "fail":
                raise ValueError(f"the hypothesis takes back text already emitted: {given[-40:]!r}")
            return [{"index": None, "text": None, "error": "revised"}]
        out, at, boundary = [], len(given), bool(row["vad_boundary"])
        while at < len(text) and (size := cut(text[at:], boundary)):
            piece = text[at : at + size].strip()
            at += size
            if piece:
                n = state["next"] = state.get("next", 0) + 1
                out.append({"index": n - 1, "text": piece, "error": None})
        state["given"] = "" if boundary else text[:at]
        return out

    return step


CHUNK = "index long, text string, error string"


def join_chunks(chunks: list[str]) -> str:
    out = ""
    for c in filter(None, map(str.strip, chunks)):
        out += (" " if out and out[-1].isascii() and c[0].isascii() else "") + c
    return out


def sliding(refine: Callable[[str], str] = str.strip, size: int = 3) -> Machine:
    """Rows (text) to updates (start_index, refined_text, transcript). The last ``size`` chunks are refined
    together; a chunk that leaves the window is refined once more alone, and then stays."""
    if size < 1:
        raise ValueError("size must be at least 1")

    def refined(text: str) -> str:
        out = refine(text)
        if not isinstance(out, str):
            raise ValueError("a refiner must return text")
        return out.strip()

    def step(state: dict, row: dict) -> list[dict]:
        text = (row["text"] or "").strip()
        if not text:
            raise ValueError("a chunk must not be empty")
        window, done = [*state.get("window", []), text], state.get("done", [])
        while len(window) > size:
            done = [*done, refined(window.pop(0))]
        active = refined(join_chunks(window))
        state.update(window=window, done=done)
        return [{"start_index": len(done), "refined_text": active, "transcript": join_chunks([*done, active])}]

    return step


REFINED = "start_index long, refined_text string, transcript string"


def energy_vad(threshold: float = 0.02, min_silence: float = 0.5, min_speech: float = 0.2) -> Machine:
    """Rows (rms, duration) to rows (in_speech, segment) with hysteresis; segment counts ended segments."""

    def step(state: dict, row: dict) -> list[dict]:
        loud = row["rms"] > threshold
        state["run"] = (state.get("run", 0.0) if state.get("loud") == loud else 0.0) + row["duration"]
        state["loud"] = loud
        if loud and state["run"] >= min_speech:
            state["on"] = True
        if not loud and state.get("on") and state["run"] >= min_silence:
            state["on"], state["ended"] = False, state.get("ended", 0) + 1
        return [{"in_speech": state.get("on", False), "segment": state.get("ended", 0)}]

    return step


VAD = "in_speech boolean, segment long"


def _run(machine: Machine, state: dict, rows: pd.DataFrame, key: str, fields: list[str]) -> pd.DataFrame:
    out = []
    for row in rows.sort_values("seq", kind="stable").to_dict("records"):
        out += [{key: row[key], "seq": row["seq"], **x} for x in machine(state, row)]
    return pd.DataFrame(out, columns=[key, "seq", *fields]).astype(object).where(lambda d: d.notna(), None)


def _fields(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def fold(rows: DataFrame, machine: Machine, schema: str, key: str = "session") -> DataFrame:
    """Batch: the machine over each session's rows in the order of seq."""
    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandas(lambda pdf: _run(machine, {}, pdf, key, _fields(schema)), f"{key} {kind}, seq long, {schema}")


def fold_stream(rows: DataFrame, machine: Machine, schema: str, key: str = "session") -> DataFrame:
    """Stream: the same, with the state of each session kept between micro-batches. Sessions must send their rows
    in the order of seq across micro-batches; an end of input is sent as a row with a boundary."""
    kind = rows.schema[key].dataType.simpleString()

    def update(_, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else {}
        pdf = pd.concat(list(frames))
        yield _run(machine, state, pdf, key, _fields(schema))
        held.update((json.dumps(state),))

    return rows.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, seq long, {schema}", "state string", "append", GroupStateTimeout.NoTimeout)


# --- batch forms in DataFrame functions alone ---


def rms(window: Column) -> Column:
    return F.sqrt(F.aggregate(window, F.lit(0.0), lambda s, x: s + x.cast("double") * x) / F.size(window)) + 1e-9


def activity(rows: DataFrame, loud: Column, key: str, order: str, on_after: int, off_after: int, width: int | None = None) -> DataFrame:
    """Adds in_speech: switched on by ``on_after`` loud rows in a run, off by ``off_after`` quiet ones; null is quiet.

    A session is worked off by one task, or, with ``width``, by one for each range of ``width`` of an integer order (see
    ``_spread``)."""
    rows = rows.withColumn("_loud", F.coalesce(loud, F.lit(False)))
    if width:
        return _spread(rows, key, order, on_after, off_after, width).drop("_loud")
    w = W.partitionBy(key).orderBy(order)
    rows = rows.withColumn("_turn", F.sum(F.when(F.lag("_loud").over(w) == F.col("_loud"), 0).otherwise(1)).over(w))
    run = F.row_number().over(W.partitionBy(key, "_turn").orderBy(order))
    rows = rows.withColumn("_event", _switch(run, on_after, off_after))
    return rows.withColumn("in_speech", F.coalesce(F.last("_event", ignorenulls=True).over(w), F.lit(False))).drop("_loud", "_turn", "_event")


def _switch(run: Column, on_after: int, off_after: int) -> Column:
    return F.when(F.col("_loud") & (run >= on_after), True).when(~F.col("_loud") & (run >= off_after), False)


def _spread(rows: DataFrame, key: str, order: str, on_after: int, off_after: int, width: int) -> DataFrame:
    """``activity`` of sessions cut into chunks: a parallel prefix over what a chunk does to the state.

    The state is how long the last run is and what was switched last. A chunk maps it by its last run, whether it is one
    run as a whole (then the length grows), and its last switch; the maps of a session's chunks, a row each, are composed
    in order, and every chunk starts from the state that reaches it."""
    here, chunk = W.partitionBy(key, "_b"), [key, "_b"]
    rows = rows.withColumn("_b", F.floor(F.col(order) / width))
    o = here.orderBy(order)
    rows = rows.withColumn("_turn", F.sum(F.when(F.lag("_loud").over(o) == F.col("_loud"), 0).otherwise(1)).over(o))
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy(key, "_b", "_turn").orderBy(order)).cast("long"))
    all_ = W.partitionBy(key).orderBy("_b")
    maps = rows.groupBy(*chunk).agg(F.max_by(F.struct("_loud", "_n"), order).alias("_last"), F.max("_turn").alias("_turns"))
    maps = maps.withColumn("_was", F.lag("_last._loud").over(all_))
    # a chunk of one run that goes on adds to the run before; any other one begins anew
    maps = maps.withColumn("_from", F.sum(F.when((F.col("_turns") == 1) & (F.col("_was") == F.col("_last._loud")), 0).otherwise(1)).over(all_))
    maps = maps.withColumn("_run", F.sum("_last._n").over(W.partitionBy(key, "_from").orderBy("_b")))
    maps = maps.select(*chunk, "_was", F.coalesce(F.lag("_run").over(all_), F.lit(0)).alias("_carry"))
    rows = _with(rows, maps, chunk, ["_was", "_carry"])
    run = F.col("_n") + F.when((F.col("_turn") == 1) & (F.col("_loud") == F.col("_was")), F.col("_carry")).otherwise(0)
    rows = rows.withColumn("_event", _switch(run, on_after, off_after)).drop("_was", "_carry")
    last = rows.groupBy(*chunk).agg(F.max_by("_event", F.when(F.col("_event").isNotNull(), F.col(order))).alias("_last"))
    last = last.select(*chunk, F.last("_last", ignorenulls=True).over(all_.rowsBetween(W.unboundedPreceding, -1)).alias("_on"))
    rows = _with(rows, last, chunk, ["_on"])
    own = F.last("_event", ignorenulls=True).over(o)
    return rows.withColumn("in_speech", F.coalesce(own, "_on", F.lit(False))).drop("_b", "_turn", "_n", "_event", "_on")


def _with(rows: DataFrame, more: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """The rows with columns of the row of ``more`` that has their keys, null keys too."""
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
    return rows.alias("r").join(more.alias("m"), on, "left").select("r.*", *[F.col(f"m.{n}") for n in names])


def preroll(rows: DataFrame, key: str, order: str, size: int = 22) -> DataFrame:
    """Rows where speech begins, with the ``order`` values of up to ``size`` rows before."""
    w = W.partitionBy(key).orderBy(order)
    before = F.collect_list(order).over(w.rowsBetween(-size, -1))
    rows = rows.withColumn("_was", F.coalesce(F.lag("in_speech").over(w), F.lit(False))).withColumn("preroll", before)
    return rows.where(F.col("in_speech") & ~F.col("_was")).drop("_was")


def windows(rows: DataFrame, text: str, key: str, order: str, size: int = 3, committed: bool = False) -> DataFrame:
    """Adds the sliding window's start and texts, and (``committed``) the texts before it, whose length grows with the
    session, so they are only for short ones."""
    w = W.partitionBy(key).orderBy(order)
    place = F.row_number().over(w)
    out = rows.withColumn("start_index", F.greatest(F.lit(0), place - size).cast("long")).withColumn("window", F.collect_list(text).over(w.rowsBetween(-(size - 1), 0)))
    return out.withColumn("committed", F.collect_list(text).over(w.rowsBetween(W.unboundedPreceding, -size))) if committed else out

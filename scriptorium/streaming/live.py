"""Live speech: activity by energy or a model, segments with preroll and tail, resumable and bounded micro-batches."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from .speech import Machine, chunker, energy_vad, sliding

RATE, WINDOW = 16_000, 512


def model_vad(load: Callable[[], Callable[[list[float]], float]], threshold: float = 0.5, min_silence: float = 0.5, min_speech: float = 0.2) -> Machine:
    """Activity by a model that gives the probability of speech of a window, with the hysteresis of ``energy_vad``. Rows:
    window, duration. The model is loaded once a worker; a stand-in is ``lambda: energy``."""
    held: dict = {}
    machine = energy_vad(threshold, min_silence, min_speech)

    def step(state: dict, row: dict) -> list[dict]:
        if "model" not in held:
            held["model"] = load()
        return machine(state, {"rms": held["model"](list(row["window"])), "duration": row["duration"]})

    return step


def energy(window: list[float]) -> float:
    """The root mean square of a window."""
    return (sum(float(x) * float(x) for x in window) / max(1, len(window))) ** 0.5 + 1e-9


def segments(preroll: int = 22, tail: int = 31) -> Machine:
    """Rows (in_speech, end) of a session's windows to rows (segment, action, first, last), which say what a recogniser
    gets: ``open`` with the first and last place of the windows before the onset, ``feed`` for each window in speech,
    and ``flush``, after ``tail`` windows of silence of its own, when speech or the input (``end``) ends. Places count
    the session's windows from 0; the window in which speech is found ended is fed before the flush."""

    def step(state: dict, row: dict) -> list[dict]:
        at, out = state.get("at", 0), []
        tell = lambda action, a, b: out.append({"segment": state.get("segment", 0), "action": action, "first": a, "last": b})
        speech, end = bool(row["in_speech"]), bool(row.get("end"))
        if speech and not state.get("on"):
            state["on"] = True
            tell("open", max(0, at - preroll), at - 1)
        if state.get("on"):
            tell("feed", at, at)
            if not speech or end:
                tell("flush", at + 1, at + tail)
                state["on"], state["segment"] = False, state.get("segment", 0) + 1
        state["at"] = at + 1
        return out

    return step


SEGMENT = "segment long, action string, first long, last long"


def refined_chunks(max_chars: int = 80, size: int = 3, refine: Callable[[str], str] = str.strip) -> Machine:
    """Hypotheses to refined windows: each stable chunk goes at once through sliding refinement. Rows: hypothesis,
    vad_boundary; out: start_index, refined_text, transcript."""
    cut, slide = chunker(max_chars), sliding(refine, size)

    def step(state: dict, row: dict) -> list[dict]:
        chunks = cut(state.setdefault("chunks", {}), row)
        return [x for c in chunks for x in slide(state.setdefault("window", {}), {"text": c["text"]})]

    return step


# --- resume and micro-batches ---


def read_new(spark: SparkSession, folder: str, schema: str, files: int = 16, format: str = "json") -> DataFrame:
    """A stream of the files that appear in a folder, at most ``files`` a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(format).load(folder)


class _Counter(StreamingQueryListener):
    """Adds up the rows of all micro-batches of the queries of one name."""

    def __init__(self, name: str):
        self.name, self.rows, self.over = name, 0, threading.Event()
        self.run = None

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.run = event.runId

    def onQueryProgress(self, event) -> None:
        if event.progress.name == self.name:
            self.rows += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId == self.run:
            self.over.set()


def run_available(stream: DataFrame, sink: str, checkpoint: str, format: str = "json", mode: str = "append") -> int:
    """Work off all that has come since the last call with this checkpoint, and stop; rows reach the sink exactly once,
    also if a call was cut off. Returns how many rows came in, over all micro-batches."""
    counter = _Counter(uuid.uuid4().hex)
    manager = stream.sparkSession.streams
    manager.addListener(counter)
    try:
        query = stream.writeStream.queryName(counter.name).format(format).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(sink)
        query.awaitTermination()
        counter.over.wait(60)  # events come in order, the end after the last batch
        return counter.rows
    finally:
        manager.removeListener(counter)


def tone(spark: SparkSession, rows_per_second: int = 31, hertz: float = 440.0) -> DataFrame:
    """An endless stream of windows (session, seq, window), as a microphone would send them: a tone, paced by the clock."""
    at = F.sequence(F.lit(0), F.lit(WINDOW - 1))
    sample = lambda i: F.sin((F.col("value") * WINDOW + i) * (2 * 3.141592653589793 * hertz / RATE)).cast("float")
    rows = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return rows.select(F.lit("tone").alias("session"), F.col("value").alias("seq"), F.transform(at, sample).alias("window"))

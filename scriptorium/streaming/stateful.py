"""The machines of ``speech`` and ``live`` as streams with typed state, timers and a time to live.

Scalars of a machine's state are one typed value, each list of it is a list state. A session that stays silent is
flushed by a timer, as if a row had come that ends the input, and its state goes; so does state past its time to live.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .speech import Machine, _fields, join_chunks

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The states of the machines, as typed fields.
CHUNK_STATE = "given string, next long"
SEGMENT_STATE = "at long, on boolean, segment long"
SETTLE_STATE = "window array<string>, first long"


def settling(refine: Callable[[str], str] = str.strip, size: int = 3) -> Machine:
    """Rows (text) to updates (start_index, refined_text, settled): as ``speech.sliding``, but with only the refined chunks that left
    the window with this row, so neither state nor rows grow with the session. All that has settled so far, and
    the refined text, are the transcript. A row with ``end`` and no text settles what is left."""
    if size < 1:
        raise ValueError("size must be at least 1")

    def refined(text: str) -> str:
        out = refine(text)
        if not isinstance(out, str):
            raise ValueError("a refiner must return text")
        return out.strip()

    def step(state: dict, row: dict) -> list[dict]:
        text, window, first, settled = (row.get("text") or "").strip(), list(state.get("window") or []), state.get("first") or 0, []
        if row.get("end") and not text:
            state.update(window=[], first=first + len(window))
            return [{"start_index": first + len(window), "refined_text": "", "settled": [refined(join_chunks(window))]}] if window else []
        if not text:
            raise ValueError("a chunk must not be empty")
        window.append(text)
        while len(window) > size:
            settled.append(refined(window.pop(0)))
            first += 1
        state.update(window=window, first=first)
        return [{"start_index": first, "refined_text": refined(join_chunks(window)), "settled": settled}]

    return step


SETTLED = "start_index long, refined_text string, settled array<string>"


class MachineProcessor(StatefulProcessor):
    """Runs a machine over each session. ``state``: its typed fields; ``flush``: the row that a timer gives the machine after
    ``idle`` milliseconds without rows, None for no timer."""

    def __init__(self, machine: Machine, state: StructType, key: str, out: list[str], flush: dict | None, idle: int, ttl: int | None, time: str | None):
        self.machine, self.key, self.out, self.flush, self.idle, self.ttl, self.time = machine, key, out, flush, idle, ttl, time
        self.lists = [f for f in state.fields if isinstance(f.dataType, ArrayType)]
        # the last place is kept, so that a flush has one of its own
        self.scalars = StructType([f for f in state.fields if not isinstance(f.dataType, ArrayType)] + [StructField("_seq", LongType())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("machine", self.scalars, self.ttl)
        self.held = {f.name: handle.getListState(f.name, StructType([StructField("item", f.dataType.elementType)]), self.ttl) for f in self.lists}

    def _load(self) -> dict:
        state = dict(zip(self.scalars.names, self.value.get())) if self.value.exists() else {}
        state = {k: v for k, v in state.items() if v is not None}
        return state | {name: [x[0] for x in held.get()] for name, held in self.held.items() if held.exists()}

    def _store(self, state: dict) -> None:
        self.value.update(tuple(state.get(n) for n in self.scalars.names))
        for name, held in self.held.items():
            if state.get(name):
                held.put([(x,) for x in state[name]])
            else:
                held.clear()

    def _run(self, key: tuple, state: dict, rows: list[dict]) -> pd.DataFrame:
        out = []
        for row in rows:
            state["_seq"] = int(row["seq"])
            out += [{self.key: key[0], "seq": row["seq"], **x} for x in self.machine(state, row)]
        return pd.DataFrame(out, columns=[self.key, "seq", *self.out]).astype(object).where(lambda d: d.notna(), None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self._load()
        pdf = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out = self._run(key, state, pdf.drop(columns=[self.time] if self.time else []).to_dict("records"))
        self._store(state)
        if self.flush is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            now = int(pdf[self.time].max().timestamp() * 1000) if self.time else timerValues.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(now + self.idle)
        yield out

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._load()
        out = self._run(key, state, [self.flush | {"seq": state.get("_seq", -1) + 1}])
        self.value.clear()
        for held in self.held.values():
            held.clear()
        yield out

    def close(self) -> None:
        pass


def stateful(rows: DataFrame, machine: Machine, state: str, schema: str, key: str = "session", flush: dict | None = None, idle: int = 30_000, ttl: int | None = None, time: str | None = None) -> DataFrame:
    """Stream: the machine over each session's rows (``seq`` and what the machine reads), which come in the order of seq across
    micro-batches; (key, seq) and the columns of ``schema``. ``state``: the machine's typed fields.

    ``flush``: a row for the machine when a session has been silent for ``idle`` milliseconds, of the clock, or of the
    event times in the column ``time``, which needs a watermark; after it the session begins anew. ``ttl`` (with the clock alone): milliseconds
    after which untouched state goes without a flush."""
    spark, empty = rows.sparkSession, "a timer needs an idle time of at least a millisecond"
    if flush is not None and idle < 1:
        raise ValueError(empty)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # the only one with timers and typed state
    kinds = spark.createDataFrame([], state).schema
    kind = rows.schema[key].dataType.simpleString()
    processor = MachineProcessor(machine, kinds, key, _fields(schema), flush, idle, ttl, time)
    mode = "EventTime" if time else "ProcessingTime" if flush is not None or ttl else "None"
    return rows.groupBy(key).transformWithStateInPandas(processor, f"{key} {kind}, seq long, {schema}", "append", mode)

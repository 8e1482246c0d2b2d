"""Audio as data sources: windows of WAV files, read by ranges, and of recordings that still grow, read as a stream.

Samples are mono floats of 16 kHz in windows of 512. Files are opened by pyarrow, so their paths may be of any file system
that it knows; a task holds the windows of a range, never a file.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .files import shared_system

RATE, WINDOW = 16_000, 512
#: Windows of silence after the end of an input, about a second.
TAIL = round(RATE / WINDOW)
SCHEMA = "session string, seq long, window array<float>"


class Wave(NamedTuple):
    """Where the samples of a PCM file are: byte of the first frame, frames, rate, channels and bytes a sample."""

    at: int
    frames: int
    rate: int
    channels: int
    width: int


def head(f, size: int) -> Wave:
    """Reads the chunks of a RIFF file up to its samples. ValueError if it is no PCM of 8, 16, 24 or 32 bits. A recording that is still
    written may say less, or nothing, of its length: then the file's size counts."""
    f.seek(0)
    start = f.read(12)
    if len(start) < 12 or start[:4] != b"RIFF" or start[8:] != b"WAVE":
        raise ValueError("no RIFF WAVE file")
    at, form = 12, None
    while at + 8 <= size:
        f.seek(at)
        name, n = struct.unpack("<4sI", f.read(8))
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", f.read(16))
            if kind == 0xFFFE:  # the extensible form, with the kind in its subformat
                kind = struct.unpack("<H", f.read(10)[8:])[0]
            if kind != 1 or bits not in (8, 16, 24, 32) or not channels or not rate:
                raise ValueError(f"no PCM of 8 to 32 bits: kind {kind}, {bits} bits")
            form = rate, channels, bits // 8
        elif name == b"data":
            if form is None:
                raise ValueError("samples before their format")
            n = size - at - 8 if n in (0, 0xFFFFFFFF) else min(n, size - at - 8)
            return Wave(at + 8, n // (form[1] * form[2]), *form)
        at += 8 + n + n % 2
    raise ValueError("no samples")


def samples(f, w: Wave, first: int, last: int) -> np.ndarray:
    """Frames first to last (exclusive) as the mean of their channels, from -1 to 1."""
    f.seek(w.at + first * w.channels * w.width)
    raw = np.frombuffer(f.read((last - first) * w.channels * w.width), np.uint8)
    raw = raw[: len(raw) - len(raw) % (w.channels * w.width)]
    if w.width == 1:
        x = (raw.astype(np.float32) - 128) / 128.0
    elif w.width == 3:  # shifted into the upper bytes of 32 bits
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = raw.reshape(-1, 3)
        x = wide.reshape(-1).view("<i4").astype(np.float32) / 2147483648.0
    else:
        x = raw.view(f"<i{w.width}").astype(np.float32) / (32768.0 if w.width == 2 else 2147483648.0)
    return x.reshape(-1, w.channels).mean(1)


def length(w: Wave) -> int:
    """Samples after resampling."""
    return w.frames if w.rate == RATE or not w.frames else max(1, round(w.frames * RATE / w.rate))


def resampled(f, w: Wave, first: int, last: int) -> np.ndarray:
    """Samples first to last (exclusive) of 16 kHz: interpolated between the frames around each, at places that hang on the whole
    file, so ranges give what the whole would."""
    if w.rate == RATE:
        return samples(f, w, first, last)
    n = length(w)
    at = np.arange(first, last) * ((w.frames - 1) / (n - 1) if n > 1 else 0.0)
    low, high = int(at[0]), min(w.frames, int(at[-1]) + 2)
    return np.interp(at, np.arange(low, high), samples(f, w, low, high))


def windows(f, w: Wave, first: int, last: int) -> np.ndarray:
    """Windows first to last (exclusive); the samples' last one is padded, those behind are silent."""
    n = length(w)
    a, b = min(first * WINDOW, n), min(last * WINDOW, n)
    out = np.zeros((last - first) * WINDOW, np.float32)
    if a < b:
        out[: b - a] = resampled(f, w, a, b)
    return out.reshape(-1, WINDOW)


class Ranges(InputPartition):
    """Ranges of windows of files: (path, wave, first, last)."""

    def __init__(self, parts: list[tuple]):
        self.parts = parts


def _read(part: Ranges) -> Iterator[pa.RecordBatch]:
    """The windows of the ranges, 256 at a time."""
    for name, wave, first, last in part.parts:
        system, path = shared_system(name)
        with system.open_input_file(path) as f:
            for at in range(first, last, 256):
                x = windows(f, Wave(*wave), at, min(at + 256, last))
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, WINDOW), pa.int32()), pa.array(x.reshape(-1), pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(x)), pa.array(range(at, at + len(x)), pa.int64()), rows], ["session", "seq", "window"])


def _dealt(spans: list[tuple], size: int) -> list[Ranges]:
    """Tasks of at most ``size`` windows: long files are cut, short ones put together."""
    out, held, room = [], [], size
    for path, wave, first, last in spans:
        while first < last:
            n = min(room, last - first)
            held.append((path, tuple(wave), first, first + n))
            first, room = first + n, room - n
            if not room:
                out.append(Ranges(held))
                held, room = [], size
    return [*out, Ranges(held)] if held or not out else out


def _found(folder: str) -> list[tuple[str, int]]:
    """(path, bytes) of the WAV files of a folder, or of the one file, sorted."""
    from pyarrow import fs

    system, base = shared_system(folder)
    at = system.get_file_info(base)
    known = [at] if at.type == fs.FileType.File else system.get_file_info(fs.FileSelector(base, allow_not_found=True))
    scheme = folder[: len(folder) - len(base)] if folder.endswith(base) else "file:"
    return sorted((f"{scheme}{x.path}", x.size) for x in known if x.type == fs.FileType.File and x.path.endswith(".wav"))


class WaveSource(DataSource):
    """``format("wave")``: options path (a folder or file, qualified), range (windows a task, 16,384) and, for streams, most
    (windows a micro-batch of each file, 65,536) and ended (a suffix; a file is at its end when one of its name with this
    suffix is beside it)."""

    @classmethod
    def name(cls) -> str:
        return "wave"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def _opened(path: str, size: int) -> Wave:
    system, at = shared_system(path)
    with system.open_input_file(at) as f:
        try:
            return head(f, size)
        except (ValueError, struct.error) as e:  # the latter: cut within a chunk
            raise ValueError(f"{path}: {e}") from e


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("range", 16_384))

    def partitions(self) -> list[Ranges]:
        spans = []
        for path, size in _found(self.path):
            w = _opened(path, size)
            spans.append((path, w, 0, -(-length(w) // WINDOW) + TAIL))
        return _dealt(spans, self.size)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return _read(partition)


class _Stream(DataSourceStreamReader):
    """Offsets are the windows of each file that have been read. While a file grows only whole windows count; when it has ended, the
    rest, padded, and the silence behind."""

    def __init__(self, options: dict):
        self.path, self.size, self.most, self.ended = options["path"], int(options.get("range", 16_384)), int(options.get("most", 65_536)), options.get("ended", ".ended")
        self.read_to: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        now = dict(self.read_to)
        for path, size in _found(self.path):
            system, at = shared_system(path)
            try:
                w = _opened(path, size)
            except ValueError:  # its head is not written yet
                continue
            over = system.get_file_info(at + self.ended).is_file
            # a resampled recording's windows hang on its length, so it counts when it has ended
            whole = -(-length(w) // WINDOW) + TAIL if over else length(w) // WINDOW if w.rate == RATE else 0
            now[path] = max(now.get(path, 0), min(whole, now.get(path, 0) + self.most))
        self.read_to = now
        return {"files": json.dumps(now, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        was, now = json.loads(start["files"]), json.loads(end["files"])
        self.read_to = {k: max(v, self.read_to.get(k, 0)) for k, v in now.items()}
        spans = []
        for path, last in sorted(now.items()):
            if was.get(path, 0) < last:
                system, at = shared_system(path)
                spans.append((path, _opened(path, system.get_file_info(at).size), was.get(path, 0), last))
        return _dealt(spans, self.size)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return _read(partition)

    def commit(self, end: dict) -> None:
        self.read_to |= json.loads(end["files"])


def _qualified(spark: SparkSession, path: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def read_wav(spark: SparkSession, path: str, windows_a_task: int = 16_384) -> DataFrame:
    """Windows (session, seq, window) of all WAV files of a folder: mono, 16 kHz; the last one padded, then a second of silence."""
    spark.dataSource.register(WaveSource)
    return spark.read.format("wave").option("path", _qualified(spark, path)).option("range", windows_a_task).load()


def stream_wav(spark: SparkSession, path: str, most: int = 65_536) -> DataFrame:
    """The same as a stream, of recordings that still grow: a restart goes on behind the last window that was read."""
    spark.dataSource.register(WaveSource)
    return spark.readStream.format("wave").option("path", _qualified(spark, path)).option("most", most).load()

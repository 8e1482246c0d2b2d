"""WARC archives compressed with Zstandard: one frame a record, with a dictionary in a leading skippable frame.

Archives are files ``part-*.warc.zst`` of bounded size in a folder. Writing sorts its rows, so a task that
runs again writes the same files again; each appears under its name only when complete.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import tidy
from .store import written

#: Fixed values of the format: the magic number of the dictionary's skippable frame and of a Zstandard frame and dictionary.
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records after which a new archive begins; a reader holds one archive, compressed, at a time.
ROLL = 256 << 20


def dictionary(samples: list[bytes], size: int = 32_768) -> bytes:
    """A trained dictionary; of too few samples, their plain content."""
    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[:size] or b"WARC/1.1\r\nWARC-Type: response\r\n"


def _kind(data: bytes) -> int:
    full = len(data) > 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY
    return zstandard.DICT_TYPE_FULLDICT if full else zstandard.DICT_TYPE_RAWCONTENT


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response with its payload, or a revisit whose HTTP header tells the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    urn = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": urn(page_id),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": "".join(c for c in url or "about:blank" if c not in "\r\n"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": "sha1:" + sha1(block),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": urn(refers_to)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


class Archive:
    """Writes one archive, frame by frame, to ``out``, by default to memory (``data``)."""

    def __init__(self, words: bytes, out=None):
        self._out = io.BytesIO() if out is None else out
        self.size, self.stored = 0, 0
        self._zstd = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words, _kind(words)), write_checksum=True, write_content_size=True)
        self._write(struct.pack("<II", SKIPPABLE, len(words)) + words)

    def _write(self, data: bytes) -> None:
        self._out.write(data)
        self.stored += len(data)

    def add(self, data: bytes) -> None:
        self._write(self._zstd.compress(data))
        self.size += len(data)

    @property
    def data(self) -> bytes:
        return self._out.getvalue()


def frames(data: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive. The dictionary, if there is one, is in the leading skippable frame,
    plain or itself compressed. A cut or damaged frame raises ValueError."""
    at, words = 0, None
    if len(data) >= 8 and struct.unpack("<I", data[:4])[0] == SKIPPABLE:
        size = struct.unpack("<I", data[4:8])[0]
        words = data[8 : 8 + size]
        if len(words) < size:
            raise ValueError("the dictionary is cut")
        if words[:4] == struct.pack("<I", FRAME):
            words = zstandard.ZstdDecompressor().decompress(words)
        at = 8 + size
    held = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words, _kind(words))) if words else zstandard.ZstdDecompressor()
    view = memoryview(data)
    while at < len(data):
        magic = struct.unpack("<I", view[at : at + 4])[0] if len(data) - at >= 8 else 0
        if magic & 0xFFFFFFF0 == 0x184D2A50:  # another skippable frame
            at += 8 + struct.unpack("<I", view[at + 4 : at + 8])[0]
            continue
        if magic != FRAME:
            raise ValueError(f"no frame at byte {at}")
        try:
            end = _end(view, at)
            one = held.decompressobj()
            out = one.decompress(view[at:end])
        except (zstandard.ZstdError, struct.error) as e:
            raise ValueError(f"frame at byte {at}: {e}") from e
        if end > len(data) or not one.eof:
            raise ValueError(f"the frame at byte {at} is cut")
        at = end
        yield out


def _end(view: memoryview, at: int) -> int:
    """Where the frame at ``at`` ends, from the headers of its blocks alone, so that a record is given to the decompressor
    without what follows it."""
    end = at + zstandard.frame_header_size(view[at : at + 18])
    last = False
    while not last:
        low, high = struct.unpack("<HB", view[end : end + 3])
        head = low | high << 16
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        end += 3 + (1 if kind == 1 else size)  # a block of type 1 is one byte, repeated
    return end + 4 * (view[at + 4] >> 2 & 1)  # a checksum


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a record; ValueError if a header is missing or malformed, or a length or digest is wrong."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name:
            raise ValueError(f"malformed header line {line[:80]!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name}")
    if not fields["content-length"].isdecimal():
        raise ValueError("content-length is no number")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"content-length is {size}, the record has {len(rest) - 4} bytes")
    block = rest[:size]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != "sha1:" + sha1(block):
        raise ValueError("the block's digest differs")
    return fields, block


def page(fields: dict[str, str], block: bytes) -> dict:
    """What a response or revisit record tells of its page; ValueError if payload, length and digest disagree."""
    http, sep, payload = block.partition(b"\r\n\r\n")
    values = dict(x.split(": ", 1) for x in http.decode("latin-1").split("\r\n")[1:])
    if not sep or not values.get("Content-Length", "").isdecimal():
        raise ValueError("no HTTP header with a length")
    size, kind = int(values["Content-Length"]), fields["warc-type"]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or sha1(payload) != digest):
        raise ValueError("the payload's length or digest differs")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields or "warc-profile" not in fields):
        raise ValueError("a revisit has a payload, or no profile or reference")
    number = lambda urn: int(x) if (x := urn.removeprefix("<urn:page:").removesuffix(">")) else None
    return {
        "page_id": number(fields["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": number(fields["warc-refers-to"]) if kind == "revisit" else None, "url": fields.get("warc-target-uri"), "payload": payload if kind == "response" else None,
    }


class _File:
    """An archive in a folder that executors and driver share, local or of any file system pyarrow knows. It has its
    name only when it is complete."""

    def __init__(self, folder: str, name: str, words: bytes):
        from pyarrow import fs

        if folder.startswith("file:"):
            self.system, base = fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
        else:
            self.system, base = fs.FileSystem.from_uri(folder)
        self.system.create_dir(base)
        self.name, self.path, self.temp, self.records = name, f"{base}/{name}", f"{base}/.{name}-{uuid.uuid4().hex}", 0
        self.out = self.system.open_output_stream(self.temp)
        self.archive = Archive(words, self.out)

    def add(self, data: bytes) -> None:
        self.archive.add(data)
        self.records += 1

    def done(self) -> pa.RecordBatch:
        self.out.close()
        self.system.move(self.temp, self.path)
        return pa.RecordBatch.from_pydict({"archive": [self.name], "records": pa.array([self.records], pa.int64()), "bytes": pa.array([self.archive.stored], pa.int64())})


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme that Spark takes it to have, so that executors write where Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def write(pages: DataFrame, folder: str, words: bytes, least_revisit_bytes: int = 0) -> DataFrame:
    """Write a record for each row (page_id, url, html) into archives in ``folder``; returns the manifest
    (archive, records, bytes), whose evaluation does the writing.

    Of rows with one payload of at least ``least_revisit_bytes``, that with the largest page_id is the response
    and the others are revisits of it; rows that share that page_id are all responses. A null html is empty;
    a null page_id counts as smaller than any. Repeated rows are records of their own; other columns are not read."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("size", F.octet_length("html"))
    top = rows.where(F.col("size") >= least_revisit_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    joined = rows.join(top, ["digest", "size"], "left")
    joined = joined.withColumn("revisit", F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")))

    folder = qualified(pages.sparkSession, folder)

    def run(batches):
        task, n, held = TaskContext.get().partitionId(), 0, None
        for b in batches:
            for i, h, u, top_, again, d in zip(*(b.column(c).to_pylist() for c in ("page_id", "html", "url", "top", "revisit", "digest"))):
                if held is None:
                    held, n = _File(folder, f"part-{task:06d}-{n:05d}.warc.zst", words), n + 1
                held.add(record(i, u, h.encode(), base64.b32encode(bytes.fromhex(d)).decode(), top_, again))
                if held.archive.size >= ROLL:
                    yield held.done()
                    held = None
        if held:
            yield held.done()

    return joined.select("page_id", "html", "url", "top", "revisit", "digest").sortWithinPartitions("page_id", "url", "html").mapInArrow(tidy(run), "archive string, records long, bytes long")


def read(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) of all archives of a
    folder. Anything malformed, cut or of wrong length or digest raises, with the archive's name."""

    def run(batches):
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content")):
                rows = []
                try:
                    for f in frames(data.as_py()):
                        fields, block = parse(f)
                        if fields["warc-type"] in ("response", "revisit"):
                            rows.append(page(fields, block))
                except ValueError as e:
                    raise ValueError(f"{path}: {e}") from e
                kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string(), "payload": pa.binary()}
                if not payload:
                    del kinds["payload"]
                for i in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows[i : i + 500]], t) for k, t in kinds.items()})

    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    return found.mapInArrow(tidy(run), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * payload)


def sample_words(pages: DataFrame, most: int = 300, max_chars: int = 16_384) -> bytes:
    """A dictionary from the ``most`` different payloads with the smallest hashes, cut to ``max_chars`` characters."""
    rows = pages.where(F.col("html").isNotNull()).select(F.left(F.col("html").cast("string"), F.lit(max_chars)).alias("t")).withColumn("h", F.xxhash64("t"))
    kinds = rows.agg(F.approx_count_distinct("h")).first()[0]
    picked = rows.where(F.pmod("h", F.lit(1_000_000)) < min(1.0, 4 * most / max(1, kinds)) * 1e6).distinct().orderBy("h", "t").limit(most).collect()
    return dictionary(sorted(record(0, "http://example.com/", r.t.encode(), "A" * 32, None, False) for r in picked))


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Write all ``pages`` to archives in ``folder`` and read them back, without the payloads."""
    written(write(pages, folder, sample_words(pages)), "manifest")
    return read(pages.sparkSession, folder, payload=False)

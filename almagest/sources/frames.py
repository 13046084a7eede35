"""The framed log format and its Spark data source.

A frame: the sync bytes AA 44 12, one version byte (1), the payload's length as 4 little-endian bytes, the payload, and its CRC-32 as 4
little-endian bytes. The payload is JSON: {"name": ..., "header": {...}, "body": {...}}. Receivers' own binary layouts need a native decoder that
is not part of this package; a ``Decoder`` for them takes the place of ``JsonDecoder``.

The source is splittable: a file is cut into equal slices, and a slice owns the frames that start in it. Bytes that are no frame are skipped;
a frame whose payload cannot be decoded becomes a row without body, with its payload. A decoder is taken by name (``decoders``), so others plug in.

Abbreviated ASCII messages, two lines that begin with ``<`` (name and header fields, then body fields), are found by ``ascii_messages``.
"""

from __future__ import annotations

import itertools
import json
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SYNC = b"\xaa\x44\x12"
HEAD = 8
#: A frame's first four bytes and its payload's length; its check sum.
STARTED, HEADER, CHECK = SYNC + b"\x01", struct.Struct("<4sI"), struct.Struct("<I")
SCHEMA = "offset long, log string, header string, body string, payload binary"
#: What a pass that decodes nothing tells of each slice.
COUNTS = "start long, n long"
#: Rows of a batch; small slices share a task, as many as leave ``TASKS`` tasks but at most ``TASK_BYTES`` of the file.
BATCH_ROWS, TASKS, TASK_BYTES = 5000, 64, 16 << 20
UNKNOWN_LOG = "UnknownMessage"


class Decoder(Protocol):
    """Bytes of one frame's payload to (name, header JSON, body JSON)."""

    def decode(self, payload: bytes) -> tuple[str, str, str]: ...


#: ``json.dumps`` of what holds no cycle, which is not looked for.
dumped = json.JSONEncoder(check_circular=False).encode


class JsonDecoder:
    def decode(self, payload: bytes) -> tuple[str, str, str]:
        found = json.loads(payload)
        return str(found["name"]), dumped(found.get("header", {})), dumped(found.get("body", {}))


def frame(name: str, header: dict, body: dict) -> bytes:
    return raw_frame(dumped({"name": name, "header": header, "body": body}).encode())


def raw_frame(payload: bytes) -> bytes:
    return SYNC + b"\x01" + struct.pack("<I", len(payload)) + payload + struct.pack("<I", zlib.crc32(payload))


#: Decoders by the name that the option ``decoder`` gives; a cluster's workers must be able to import what is registered here.
decoders: dict[str, Callable[[], Decoder]] = {"json": JsonDecoder}


class Boundaries:
    """Splits a file: slice i holds the frames that start in its bytes. Another splitter may snap to its own marks."""

    def slices(self, size: int, wanted: int) -> list[tuple[int, int]]:
        step = max(1, -(-size // max(1, wanted)))
        return [(a, min(size, a + step)) for a in range(0, size, step)]


class Frames:
    """The whole frames that start in start..end-1 of a file, resynchronised after garbage; iterates (offset, payload).

    Afterwards ``safe`` is how far the file has been dealt with: before a frame that it holds only in part, behind everything else.
    """

    def __init__(self, f: pa.NativeFile, start: int, end: int, chunk: int = 1 << 16) -> None:
        self.file, self.start, self.end, self.chunk = f, start, end, chunk
        self.size = f.size()
        self.base, self.buf = start, b""
        self.safe = start

    def _have(self, upto: int) -> None:
        need = min(upto, self.size) - (self.base + len(self.buf))
        if need > 0:
            self.file.seek(self.base + len(self.buf))
            self.buf += self.file.read(max(need, min(self.chunk, self.size - self.base - len(self.buf))))

    def _bytes(self, at: int, n: int) -> bytes:
        self._have(at + n)
        return self.buf[at - self.base : at - self.base + n]

    def _next_sync(self, at: int) -> int:
        """Where the next sync bytes begin, or as much of them as the file still has; the file's end if nowhere."""
        while at < self.end:
            self._have(at + self.chunk)
            found = self.buf.find(SYNC, at - self.base)
            if found >= 0:
                return self.base + found
            known = self.base + len(self.buf)
            if known >= self.size:
                return next((k for k in range(max(at, known - len(SYNC) + 1), known) if SYNC.startswith(self.buf[k - self.base :])), self.size)
            at = max(at, known - len(SYNC) + 1)
            self.buf, self.base = self.buf[at - self.base :], at
        return at

    def _dropped(self, at: int) -> int:
        """``at``; what is before it leaves the buffer once it is a chunk."""
        if at - self.base > self.chunk:
            self.buf, self.base = self.buf[at - self.base :], at
        return at

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        at, partial = self.start, None
        while True:
            buf, here, held = self.buf, at - self.base, len(self.buf)
            while here + HEAD <= held and self.base + here < self.end:  # whole frames that are in the buffer, one behind the other
                sync, length = HEADER.unpack_from(buf, here)
                past = here + HEAD + length + 4
                if sync != STARTED or past > held:
                    break
                payload = buf[here + HEAD : past - 4]
                if CHECK.unpack_from(buf, past - 4)[0] != zlib.crc32(payload):
                    break
                partial = None
                yield self.base + here, payload
                here = past
            at = self._next_sync(self._dropped(self.base + here))
            if at >= self.end:
                break
            head = self._bytes(at, HEAD)
            length = struct.unpack("<I", head[4:])[0] if len(head) == HEAD and head[3] == 1 else -1
            past = at + HEAD + length + 4
            if len(head) < HEAD or (length >= 0 and past > self.size):
                partial = at if partial is None else partial
            elif length >= 0:
                payload, check = self._bytes(at + HEAD, length), self._bytes(past - 4, 4)
                if struct.unpack("<I", check)[0] == zlib.crc32(payload):
                    partial = None
                    yield at, payload
                    at = self._dropped(past)
                    continue
            at += 1
        self.safe = max(at, self.end) if partial is None else partial


def frames(f: pa.NativeFile, start: int, end: int, decoder: Decoder, chunk: int = 1 << 16) -> Iterator[tuple]:
    """Rows of the frames that start in start..end-1."""
    for at, payload in Frames(f, start, end, chunk):
        try:
            yield at, *decoder.decode(payload), None
        except (ValueError, KeyError, TypeError):
            yield at, UNKNOWN_LOG, None, None, payload


class Slice(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        super().__init__((start, end))
        self.start, self.end = start, end


class Slices(InputPartition):
    """Slices that one task reads one by one; ``firsts``: the number of each one's first message, if that is known."""

    def __init__(self, slices: list[tuple[int, int]], firsts: list[int] | None = None) -> None:
        super().__init__((slices, firsts))
        self.slices, self.firsts = slices, firsts


def batches(rows: Iterator[tuple], kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as columns, which Spark takes without looking at each value."""
    while some := list(itertools.islice(rows, BATCH_ROWS)):
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), kind, strict=True)], schema=kind)


ARROW = pa.schema([("offset", pa.int64()), ("log", pa.string()), ("header", pa.string()), ("body", pa.string()), ("payload", pa.binary())])
ARROW_COUNTS = pa.schema([("start", pa.int64()), ("n", pa.int64())])


def _opened(path: str) -> pa.NativeFile:
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(at)


class FrameReader(DataSourceReader):
    def __init__(self, options: dict, decoder: Decoder, splitter: Boundaries) -> None:
        self.path, self.decoder, self.splitter = options["path"], decoder, splitter
        self.slice_bytes = int(options.get("slicebytes", 64 << 20))

        self.size, self.only = options.get("size"), options.get("only")
        self.firsts = dict(json.loads(options["firsts"])) if "firsts" in options else None

    def partitions(self) -> list[Slices]:
        if self.size is None:
            with _opened(self.path) as f:
                self.size = f.size()
        size = int(self.size)
        cut = self.splitter.slices(size, -(-size // self.slice_bytes))
        many = max(1, min(-(-len(cut) // TASKS), TASK_BYTES // max(1, self.slice_bytes)))
        shared = [cut[k : k + many] for k in range(0, len(cut), many)]
        return [Slices(s, [self.firsts[a] for a, _ in s] if self.firsts is not None else None) for s in shared]

    def _rows(self, f: pa.NativeFile, part: Slices) -> Iterator[tuple]:
        for k, (a, z) in enumerate(part.slices):
            if self.only == "counts":
                yield a, sum(1 for _ in Frames(f, a, z))
            elif part.firsts is None:
                yield from frames(f, a, z, self.decoder)
            else:
                yield from ((part.firsts[k] + n, *row[1:]) for n, row in enumerate(frames(f, a, z, self.decoder)))

    def read(self, part: Slices) -> Iterator[pa.RecordBatch]:
        with _opened(self.path) as f:
            yield from batches(self._rows(f, part), self.kind())

    def kind(self) -> pa.Schema:
        if self.only == "counts":
            return ARROW_COUNTS
        return ARROW if self.firsts is None else ARROW.set(0, pa.field("sequence_id", pa.int64()))


class FrameStreamReader(DataSourceStreamReader):
    """What has been appended to the file since the last batch, whole frames only, in slices that the executors decode.

    The driver looks for the last whole frame of a batch (at most ``maxbytespertrigger`` bytes) without decoding any; bytes that are no frame are passed over.
    """

    def __init__(self, options: dict, decoder: Decoder, splitter: Boundaries) -> None:
        self.path, self.decoder, self.splitter = options["path"], decoder, splitter
        self.most = int(options.get("maxbytespertrigger", 16 << 20))
        self.slice_bytes = int(options.get("slicebytes", 4 << 20))
        self.reached = 0

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        with _opened(self.path) as f:
            found = Frames(f, self.reached, min(f.size(), self.reached + self.most))
            for _ in found:
                pass
        self.reached = max(self.reached, found.safe)
        return {"at": self.reached}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        self.reached = max(self.reached, end["at"])  # after a restart the checkpoint knows more than this reader
        size = end["at"] - start["at"]
        return [Slice(start["at"] + a, start["at"] + z) for a, z in self.splitter.slices(size, -(-size // self.slice_bytes))]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        with _opened(self.path) as f:
            yield from batches(frames(f, part.start, part.end, self.decoder), ARROW)

    def commit(self, end: dict) -> None:
        self.reached = max(self.reached, end["at"])


class FramedLog(DataSource):
    """``spark.read.format("framedlog").load(path)``; options: path, decoder (a registered name), slicebytes, maxbytespertrigger.

    ``only`` = counts: the number of frames that start in each slice. With these, ``firsts`` (a list of each slice's start and the number of its first message, with
    the file's ``size`` then) puts sequence_id in the place of offset.
    """

    splitter = Boundaries()

    @classmethod
    def name(cls) -> str:
        return "framedlog"

    def schema(self) -> str:
        if self.options.get("only") == "counts":
            return COUNTS
        return SCHEMA.replace("offset", "sequence_id", 1) if "firsts" in self.options else SCHEMA

    def _decoder(self) -> Decoder:
        return decoders[self.options.get("decoder", "json")]()

    def reader(self, schema: object) -> FrameReader:
        return FrameReader(dict(self.options), self._decoder(), self.splitter)

    def streamReader(self, schema: object) -> FrameStreamReader:
        return FrameStreamReader(dict(self.options), self._decoder(), self.splitter)


#: Fixed value: a name and its header fields on a line, body fields on the next, which is indented.
ASCII_MESSAGE = r"(?s)<([A-Z][A-Z0-9]+) ([^\r\n]+)\r\n<[ ]+([^\r\n]+)\r\n"


def ascii_messages(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal (from 0, in order of the file), log, header and body (lists of fields) of every abbreviated ASCII message; other bytes are passed over.

    A file is one row here, so files are the unit of work: this is for rebuilt logs, not for recordings of any size.
    """
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.decode("content", "ISO-8859-1").alias("text"))
    found = raw.select("file", F.posexplode(F.regexp_extract_all("text", F.lit(ASCII_MESSAGE), F.lit(0))).alias("ordinal", "m"))
    part = lambda k: F.regexp_extract("m", ASCII_MESSAGE, k)
    fields = lambda c: F.regexp_extract_all(c, F.lit(r'"[^"]*"|[^ ]+'), F.lit(0))
    return found.select("file", "ordinal", part(1).alias("log"), fields(part(2)).alias("header"), fields(part(3)).alias("body"))


def ascii_frame(name: str, header: Sequence[object], body: Sequence[object]) -> bytes:
    return f"<{name} {' '.join(map(str, header))}\r\n<     {' '.join(map(str, body))}\r\n".encode("latin-1")

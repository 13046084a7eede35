"""Rebuilds a log file from a recording, in arrival order."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almagest.errors import RebuildError
from almagest.operators.shred import PARENT
from almagest.plans.catalog import Files, Recording
from almagest.sources.frames import frame, raw_frame

#: The header fields that a message is made with; others are derived when it is encoded.
HEADER_FIELDS = ("message_type", "port_address", "sequence", "idle_time", "time_status", "week", "milliseconds", "receiver_status", "receiver_sw_version")
RAW = "_raw"


#: Messages in a task of a rebuild, at the mean density of the ids.
MESSAGES = 20_000


def _plain(kind: pa.DataType) -> Callable[[object], object]:
    """What makes JSON values of a type's values: records without ids and nulls, a single row of ``key_0..`` as a list."""
    if pa.types.is_struct(kind):
        parts = [(f.name, _plain(f.type)) for f in kind if f.name not in ("sequence_id", PARENT)]
        return lambda v: None if v is None else with_raw({k: x(v[k]) for k, x in parts if v[k] is not None})
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        one = _plain(kind.value_type)

        def rows_of(v: list | None) -> object:
            rows = None if v is None else [one(x) for x in v]
            keyed = rows and len(rows) == 1 and isinstance(rows[0], dict) and rows[0] and all(k.startswith("key_") for k in rows[0])
            return list(rows[0].values()) if keyed else rows

        return rows_of
    return lambda v: v


def with_raw(fields: dict) -> dict:
    """A field that is kept as a name beside its number gets the number back."""
    return {k: fields.get(k + RAW, v) for k, v in fields.items() if not (k.endswith(RAW) and k.removesuffix(RAW) in fields)}


def header_of(fields: dict, allowed: tuple[str, ...] | None = None) -> dict:
    """The header's fields; whole numbers but for milliseconds, and other values as they are. ``allowed`` names the only ones to keep."""
    out = {}
    for k, v in fields.items():
        name = k.removeprefix("header_")
        if name != k and (allowed is None or name in allowed):
            whole = isinstance(v, float) and v.is_integer() and name != "milliseconds"
            out[name] = int(v) if whole else float(v) if name == "milliseconds" else v
    return out


FRAMES = "sequence_id long, side int, frame binary"


def framed(rows: DataFrame, side: int, log: str, allowed: tuple[str, ...] | None) -> DataFrame:
    """``rows``: sequence_id, entry. The frame of each."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            entry = b.column("entry")
            plain = _plain(entry.type)
            found = []
            for what in entry.to_pylist(maps_as_pydicts="strict"):
                fields = plain(what)
                found.append(frame(log, header_of(fields, allowed), {k: v for k, v in fields.items() if not k.startswith("header_") and k not in ("log", "ordinal")}))
            yield pa.record_batch([b.column("sequence_id"), pa.array([side] * len(found), pa.int32()), pa.array(found, pa.binary())], names=["sequence_id", "side", "frame"])

    return rows.select("sequence_id", "entry").mapInArrow(make, FRAMES)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The frames of rows in order, a batch's in one value; an index row (side 0) comes before its frame. ``lost``: the first message without its frame."""
    at, owed, lost = None, 0, None
    for b in batches:
        for place, side in zip(b.column("sequence_id").to_pylist(), b.column("side").to_pylist(), strict=True):
            if place != at:
                lost = at if owed and lost is None else lost
                at, owed = place, 0
            owed += 1 if side == 0 else -1
        found = b.column("frame").drop_null()
        yield pa.record_batch([pa.array([b"".join(found.to_pylist())], pa.binary()), pa.array([len(found)], pa.int64()), pa.array([lost], pa.int64())], names=["piece", "n", "lost"])
    yield pa.record_batch([pa.array([b""], pa.binary()), pa.array([0], pa.int64()), pa.array([at if owed and lost is None else lost], pa.int64())], names=["piece", "n", "lost"])


def rebuild(rec: Recording, out: str, header_fields: tuple[str, ...] | None = None) -> int:
    """Writes one frame for each index row and returns their number; unknown payloads are copied, a null payload is empty.

    ``out`` may be in any store; ``header_fields`` (such as ``HEADER_FIELDS``) restricts headers to what an encoder takes.

    The executors make the frames and bring them in order, dealt by ranges of the ids; the driver puts the pieces behind each other and holds one range at a time.
    """
    index = rec.whole_index.select("sequence_id")
    about = index.agg(F.count(F.lit(1)).alias("n"), F.min("sequence_id").alias("least"), F.max("sequence_id").alias("most")).first()
    sides = [framed(rec.placed(name), k, name, header_fields) for k, name in enumerate(rec.tables, 1)]
    if rec.unknown is not None:
        raw = F.udf(lambda p: raw_frame(bytes(p or b"")), "binary")
        sides.append(rec.unknown.select("sequence_id", F.lit(len(sides) + 1).alias("side"), raw("payload").alias("frame")))
    parts = max(1, math.ceil(about.n / MESSAGES))
    least, most = (about.least, about.most) if about.n else (0, 0)
    width = max(1, math.ceil((most - least + 1) / parts))
    rows = reduce(DataFrame.unionByName, [index.select("sequence_id", F.lit(0).alias("side"), F.lit(None).cast("binary").alias("frame")), *sides])
    dealt = rows.repartitionById(parts, F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor((F.col("sequence_id") - least) / width))).cast("int"))
    pieces = dealt.sortWithinPartitions("sequence_id", "side").mapInArrow(_joined, "piece binary, n long, lost long").persist(StorageLevel.DISK_ONLY)
    far = "://" in out
    try:
        told = pieces.agg(F.sum("n").alias("n"), F.min("lost").alias("lost")).first()
        if told.lost is not None:
            raise RebuildError(f"message {told.lost} has neither a row nor a payload, or more than one")
        with tempfile.NamedTemporaryFile("wb") if far else open(out, "wb") as f:
            for row in pieces.filter("n > 0").select("piece").toLocalIterator(prefetchPartitions=True):
                f.write(row.piece)
            if far:
                f.flush()
                Files(rec.whole_index.sparkSession, out).put(f.name, out)
        return told.n
    finally:
        pieces.unpersist()

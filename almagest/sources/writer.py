"""Writes a recording: index, a tree of tables for each log, unknown payloads, and the metadata last, as the mark of a finished recording."""

from __future__ import annotations

import hashlib
import itertools
import json
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almagest.errors import RecordingExistsError, WriteError
from almagest.operators.joins import running_ordinal
from almagest.operators.shred import Shredded, enum_columns, expanded, shred
from almagest.plans.catalog import METADATA, UNKNOWN, Files, shared_folder
from almagest.progress import Progress, Tracker
from almagest.sources.frames import SCHEMA, FramedLog, _opened, frame, raw_frame

#: Field to the names of its numbers.
Enums = dict[str, dict[int, str]]

VERSIONS = {"schema_version": "1", "writer_version": "1.0.0"}


#: Bytes of decoded text for one file; Parquet files come out at about a quarter of it.
FILE_BYTES = 512 << 20


def write_options(rows: int, size: int) -> dict[str, str]:
    """Files of about one size: as many rows as ``FILE_BYTES`` hold at the table's mean."""
    return {"compression": "zstd", "maxRecordsPerFile": str(max(10_000, FILE_BYTES * rows // max(1, size)))}


def json_schema(df: DataFrame, col: str) -> T.StructType:
    """The schema that holds every row's JSON object: the union over all rows, numbers widened."""
    return schema_of(df.agg(F.schema_of_variant_agg(F.try_parse_json(F.col(col))).alias("s")).first()[0])


def column_kinds() -> list[Column]:
    """Aggregates header and body: what ``schema_of`` takes, over the messages that have a body."""
    return [F.schema_of_variant_agg(F.when(F.col("body").isNotNull(), F.try_parse_json(F.col(c)))).alias(c) for c in ("header", "body")]


def schema_of(found: str | None) -> T.StructType:
    """What ``schema_of_variant_agg`` says, as a schema of columns."""
    if not found or not found.startswith("OBJECT<"):
        return T.StructType([])
    return _widened(T.StructType.fromDDL(f"x {found.replace('OBJECT<', 'STRUCT<')}")[0].dataType)


def _widened(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _widened(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_widened(kind.elementType))
    if isinstance(kind, (T.DecimalType, T.FloatType)):
        return T.DoubleType()
    if isinstance(kind, T.IntegralType):
        return T.LongType()
    return T.StringType() if isinstance(kind, (T.NullType, T.VariantType)) else kind


def header_columns(col: str, kind: T.StructType) -> list[Column]:
    """header_* columns; milliseconds are always doubles."""
    return [c.cast("double").alias("header_milliseconds") if f.name == "milliseconds" else c for f, c in zip(kind, expanded(F.col(col), kind, "header_"), strict=True)]


def decoded(messages: DataFrame, log: str, enums: Enums | None = None, kinds: tuple[T.StructType, T.StructType] | None = None) -> DataFrame:
    """sequence_id, header_* and body columns of one log; ``enums``: field to the names of its numbers, which become a name and a ``_raw`` column;
    ``kinds``: the schemas of header and body, if they are known, else a pass finds each.
    """
    rows = messages.filter((F.col("log") == log) & F.col("body").isNotNull())
    head, body = kinds or (json_schema(rows, "header"), json_schema(rows, "body"))
    out = rows.select("sequence_id", F.from_json("header", head).alias("h") if len(head) else F.lit(None).alias("h"), F.from_json("body", body).alias("b") if len(body) else F.lit(None).alias("b"))
    columns = [c for f in body for c in (enum_columns(F.col("b")[f.name], f.name, enums[f.name]) if enums and f.name in enums else [F.col("b")[f.name].alias(f.name)])]
    return out.select("sequence_id", *header_columns("h", head), *columns)


def _write_tree(tree: Shredded, at: str, name: str, options: dict, mode: str) -> None:
    tree.table.write.options(**options).mode(mode).parquet(f"{at}/{name}/{name}.parquet")
    for child, below in tree.children.items():
        _write_tree(below, f"{at}/{name}", child, options, mode)


def refuse_existing(files: Files, out: str, overwrite: bool) -> None:
    if files.exists(f"{out}/{METADATA}") and not overwrite:
        raise RecordingExistsError(f"{out} holds a recording; overwrite it explicitly")


def write_recording(messages: DataFrame, out: str, overwrite: bool = False, metadata: dict | None = None, tracker: Tracker | None = None, enums: dict[str, Enums] | None = None) -> str:
    """``messages``: sequence_id, log, header (JSON), body (JSON), payload. Returns the recording's folder, in any store that Spark writes to.

    The source is decoded once, into a staging table with a folder for each log, from which the tables are made; the metadata is written last.
    """
    spark, out = messages.sparkSession, str(out).rstrip("/")
    files, name, staging = Files(spark, out), out.rsplit("/", 1)[-1], f"{out}/_staging"
    refuse_existing(files, out, overwrite)
    files.delete(f"{out}/{METADATA}")
    tell = tracker.emit if tracker else lambda *_, **__: None
    tell(Progress("decode", 0, 1), force=True)
    try:
        messages.write.option("compression", "zstd").mode("overwrite").partitionBy("log").parquet(staging)
        staged = spark.read.schema(messages.schema).parquet(staging)
        size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
        facts = staged.groupBy("log").agg(F.count(F.lit(1)).alias("n"), F.count("body").alias("bodies"), F.sum(size("header") + size("body")).alias("bytes"), *column_kinds()).orderBy("log").collect()  # a row for each log type
        known = [r for r in facts if r.bodies]
        for n, r in enumerate(known):
            _write_tree(shred(decoded(staged, r.log, (enums or {}).get(r.log), (schema_of(r.header), schema_of(r.body)))), out, r.log, write_options(r.bodies, r.bytes), "overwrite")
            tell(Progress(r.log, n + 1, len(known)), force=n + 1 == len(known))
        total = sum(r.n for r in facts)
        plain = write_options(total, 16 * total)
        staged.select("sequence_id", "log").write.options(**plain).mode("overwrite").parquet(f"{out}/{name}.parquet")
        staged.filter(F.col("body").isNull()).select("sequence_id", "payload").write.options(**plain).mode("overwrite").parquet(f"{out}/{UNKNOWN}")
    except Exception as e:
        raise WriteError(f"writing {out} failed: {e}") from e
    finally:
        files.delete(staging)
    files.write_text(f"{out}/{METADATA}", json.dumps({**(metadata or {}), "total_message_count": total, **VERSIONS}, indent=2))
    return out


def read_messages(spark: SparkSession, path: str, slice_bytes: int = 64 << 20) -> DataFrame:
    """A framed log as messages, numbered in file order: a pass that decodes nothing counts the frames of each slice, so no message is shuffled to be numbered."""
    spark.dataSource.register(FramedLog)
    with _opened(path) as f:
        options = {"slicebytes": str(min(slice_bytes, 1 << 62)), "size": str(f.size())}
    counts = spark.read.format("framedlog").options(**options, only="counts").load(path).collect()  # a row for each slice
    counts.sort(key=lambda r: r.start)  # sorted by Spark, the file would be read twice
    ends = itertools.accumulate((r.n for r in counts), initial=0)
    firsts = json.dumps([[r.start, first] for r, first in zip(counts, ends, strict=False)])
    return spark.read.format("framedlog").options(**options, firsts=firsts).load(path)


def numbered(rows: DataFrame, first: int = 0) -> DataFrame:
    """Messages from frames, numbered in the order of their offsets from ``first`` on."""
    out = running_ordinal(rows, ["offset"], "offset", "sequence_id", width=16 << 20)
    return out.select((F.col("sequence_id") + first).alias("sequence_id"), "log", "header", "body", "payload")


def convert(spark: SparkSession, source: str | Path, out: str, overwrite: bool = False, archive: bool = False, slice_bytes: int = 64 << 20, **more: object) -> str:
    """One file to one recording, with the file's fingerprint in the metadata."""
    if not isinstance(source, (str, Path)):
        raise TypeError("convert takes a file; RecordingWriter takes records")
    refuse_existing(Files(spark, str(out)), str(out).rstrip("/"), overwrite)  # before the file is read
    size, sha256 = source_mark(str(source))
    write_recording(read_messages(spark, str(source), slice_bytes), out, overwrite, {"source_filename": str(source).rsplit("/", 1)[-1], "file_size": size, "sha256": sha256}, **more)
    return archived(out) if archive else out


def source_mark(path: str) -> tuple[int, str]:
    """Size and SHA-256 of a file in any store, a piece at a time."""
    digest = hashlib.sha256()
    with _opened(path) as f:
        while piece := f.read(1 << 20):
            digest.update(piece)
        return f.size(), digest.hexdigest()


Record = tuple[str, dict, dict] | bytes


class RecordingWriter:
    """Writes a recording from a file, from records, or from any iterable of them; as a context manager it finishes on a clean exit only.

    A record is (name, header, body), or bytes that nothing could decode. Records are kept in framed files of ``AT_ONCE`` records in the shared folder until
    the recording is written, so the driver holds no more of them at a time.
    """

    AT_ONCE = 50_000

    def __init__(self, spark: SparkSession, out: str, overwrite: bool = False, archive: bool = False, parallel: bool | None = None, progress: Callable[[Progress], None] | None = None, enums: dict[str, Enums] | None = None) -> None:
        self.spark, self.out, self.overwrite, self.archive = spark, str(out), overwrite, archive
        self.slice_bytes = (1 << 62) if parallel is False else (64 << 20)
        self.more = {"tracker": Tracker(progress) if progress else None, "enums": enums}
        self.parts, self._held, self._records = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}", [], 0

    def write_to_db(self, source: str | Path | Iterable[Record]) -> str:
        """What ``source`` names or yields, as one recording."""
        if isinstance(source, (str, Path)):
            return convert(self.spark, source, self.out, self.overwrite, self.archive, self.slice_bytes, **self.more)
        self.consume(source)
        return self.finish()

    def write(self, record: Record) -> None:
        self._held.append(raw_frame(record) if isinstance(record, bytes) else frame(*record))
        self._records += 1
        if len(self._held) >= self.AT_ONCE:
            self._flush()

    def consume(self, records: Iterable[Record]) -> int:
        before = self._records
        for r in records:
            self.write(r)
        return self._records - before

    def _flush(self) -> None:
        if self._held:
            with tempfile.NamedTemporaryFile() as f:
                f.write(b"".join(self._held))
                f.flush()
                Files(self.spark, self.parts).put(f.name, f"{self.parts}/{self._records - len(self._held):012d}")
            self._held = []

    def finish(self) -> str:
        self._flush()
        self.spark.dataSource.register(FramedLog)
        frames_of = lambda n: self.spark.read.format("framedlog").load(f"{self.parts}/{n}").withColumn("offset", F.col("offset") + int(n) * (1 << 31))
        names = Files(self.spark, self.parts).names(self.parts)
        rows = reduce(DataFrame.unionByName, map(frames_of, names)) if names else self.spark.createDataFrame([], SCHEMA)
        try:
            out = write_recording(numbered(rows), self.out, self.overwrite, **self.more)
        finally:
            self.discard()
        return archived(out) if self.archive else out

    def discard(self) -> None:
        Files(self.spark, self.parts).delete(self.parts)

    def __enter__(self) -> RecordingWriter:
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        if kind is None:
            self.finish()
        else:
            self.discard()


def archived(folder: str) -> str:
    """The folder as a sibling archive, entries sorted, with the folder's name in front."""
    root = Path(folder)
    with zipfile.ZipFile(f"{folder}.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(p for p in root.rglob("*") if p.is_file() and not p.name.endswith(".crc")):
            z.write(path, f"{root.name}/{path.relative_to(root)}")
    return f"{folder}.zip"

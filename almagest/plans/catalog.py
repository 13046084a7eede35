"""A recording: an index of messages, a tree of log tables and, perhaps, payloads that nothing could decode."""

from __future__ import annotations

import dataclasses
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from almagest.errors import FieldNotFoundError, InvalidRecordingError
from almagest.operators.joins import with_log_ordinal, with_table_ordinal
from almagest.operators.shred import Shredded, shred
from almagest.plans.table import LogTable, Namespace, clean, database_order, database_positions

METADATA, UNKNOWN = "_metadata.json", "unknown_data.parquet"
#: Suffixes of archived recordings; ``Recording.open`` takes others.
ARCHIVES = (".zip",)
#: The folder of a streamed batch inside a table.
BATCH = "batch"


@dataclasses.dataclass(frozen=True)
class SchemaNames:
    """What a recording calls its id and time columns, where that differs from this package's names."""

    sequence: str = "sequence_id"
    parent: str = "parent_id"
    week: str = "header_week"
    milliseconds: str = "header_milliseconds"

    def renamed(self, df: DataFrame) -> DataFrame:
        ours = SchemaNames()
        names = {getattr(self, f.name): getattr(ours, f.name) for f in dataclasses.fields(self)}
        return df.withColumnsRenamed({a: b for a, b in names.items() if a != b and a in df.columns})


def shared_folder(spark: SparkSession) -> str:
    """Where executors and driver both read and write: the folder that the cluster names, else the warehouse."""
    where = (spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    return "file:///" + where.removeprefix("file:").lstrip("/") if where.startswith("file:") else where


class Files:
    """Folder listing through Hadoop's file systems, so a recording may be in any store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = path.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _path(self, path: str) -> object:
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def folders(self, path: str) -> list[str]:
        found = self._fs.listStatus(self._path(path))
        return sorted(s.getPath().getName() for s in found if s.isDirectory() and not s.getPath().getName().endswith(".parquet"))

    def text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, local: str, path: str) -> None:
        self._fs.copyFromLocalFile(self._path(f"file://{local}"), self._path(path))

    def fetch(self, path: str, local: str) -> None:
        self._fs.copyToLocalFile(False, self._path(path), self._path(f"file://{local}"), True)

    def write_text(self, path: str, text: str) -> None:
        with tempfile.NamedTemporaryFile("w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            self._fs.mkdirs(self._path(path).getParent())
            self._fs.copyFromLocalFile(False, True, self._path(f"file://{f.name}"), self._path(path))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path))) if self.exists(path) else []


def unpacked(spark: SparkSession, archive: str) -> str:
    """The archive's recording in a folder that executors see: the shared folder if one is set."""
    local = tempfile.mkdtemp(prefix="recording-")
    with zipfile.ZipFile(archive) as z:
        z.extractall(local)
    inside = [d for d, below, names in os.walk(local) if METADATA in names or {f"{Path(d).name}.parquet", "log_table.parquet"} & {*names, *below}]
    if not inside:
        raise InvalidRecordingError(f"{archive} holds no recording")
    found = min(inside, key=len)
    shared = shared_folder(spark)
    there = f"{shared}/recording-{uuid.uuid4().hex}/{Path(found).name}"
    Files(spark, shared).put(found, there)
    return there


def stream(name: str | None, rows: DataFrame, value: str) -> Iterator[tuple[int, str | None, object]]:
    """(id, name, value) in order of the ids, a partition at a time."""
    for r in rows.orderBy("sequence_id").toLocalIterator():
        yield r["sequence_id"], name, r[value]


def scanned(spark: SparkSession, path: str) -> DataFrame:
    """A table's rows; of a streamed one all batches, whose columns are merged."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    return df.drop(BATCH)


def from_tree(name: str, tree: Shredded, children: dict[str, LogTable]) -> LogTable:
    return LogTable(name, clean(tree.table), {**{k: from_tree(k, t, {}) for k, t in tree.children.items()}, **children})


@dataclasses.dataclass(frozen=True)
class Recording:
    index: DataFrame
    tables: dict[str, LogTable]
    unknown: DataFrame | None = None
    whole_index: DataFrame | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str, logs: Sequence[str] | None = None, names: SchemaNames = SchemaNames(), archives: Sequence[str] = ARCHIVES) -> Recording:
        """Lazy: only footers are read. ``logs`` restricts the tables and pushes the names down to the index scan.

        ``names`` tells how the recording calls its columns; ``archives`` are the suffixes of files that hold a recording. Streamed recordings open alike:
        nested columns of a table become its child tables.
        """
        path = str(path)
        if path.endswith(tuple(archives)):
            path = unpacked(spark, path)
        files = Files(spark, path)
        name = files.root.rsplit("/", 1)[-1]
        place = next((p for p in (f"{path}/{name}.parquet", f"{path}/log_table.parquet") if files.exists(p)), None)
        if place is None:
            raise InvalidRecordingError(f"{path} has no index table")
        index = names.renamed(scanned(spark, place))
        if logs is not None:
            index = index.filter(F.col("log").isin(list(logs)))
        tables = {d: t for d in files.folders(path) if (logs is None or d in logs) and (t := cls._table(spark, files, path, d, names))}
        unknown = names.renamed(scanned(spark, f"{path}/{UNKNOWN}")) if files.exists(f"{path}/{UNKNOWN}") else None
        return cls(index, tables, unknown, index)

    @classmethod
    def _table(cls, spark: SparkSession, files: Files, above: str, name: str, names: SchemaNames) -> LogTable | None:
        here = f"{above}/{name}"
        if not files.exists(f"{here}/{name}.parquet"):
            return None
        children = {d: t for d in files.folders(here) if (t := cls._table(spark, files, here, d, names))}
        rows = names.renamed(scanned(spark, f"{here}/{name}.parquet"))
        return from_tree(name, shred(rows), children)

    @property
    def subtables(self) -> Namespace:
        return Namespace(self.tables)

    def __len__(self) -> int:
        return self.index.count()

    def __repr__(self) -> str:
        return "\n".join([f"recording: {len(self)} messages", *(t.tree(1) for t in self.tables.values())])

    def filter_by_log(self, name: str) -> Recording:
        if "log" not in self.index.columns or self.index.filter(F.col("log") == name).isEmpty():
            raise FieldNotFoundError(f"no log {name!r}")
        return dataclasses.replace(self, index=self.index.filter(F.col("log") == name))

    def reset_filters(self) -> Recording:
        return dataclasses.replace(self, index=self.whole_index, tables={k: t.reset_filters() for k, t in self.tables.items()})

    def sort_by_time(self) -> Recording:
        ordered = database_order(self.index, {k: t.base for k, t in self.tables.items()})
        return dataclasses.replace(self, index=ordered.select(*self.index.columns))

    def positions(self) -> DataFrame:
        """The index with ``pos``, the place of each message in the order of time; messages without a log row come last."""
        return database_positions(self.index, {k: t.base for k, t in self.tables.items()})

    def placed(self, log: str) -> DataFrame:
        """The index rows of a log with its entries, joined by ordinal."""
        entries = self.tables[log].entries()
        first = entries.groupBy("sequence_id").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in entries.columns if c != "sequence_id"])).alias("e")).select("sequence_id", "e.*")  # of rows with one id always the same one
        rows = with_table_ordinal(first, log)
        rows = rows.select(F.col("ordinal").alias("at"), F.struct("*").alias("entry"))
        ours = with_log_ordinal(self.whole_index, self.unknown).filter(F.col("log") == log)
        return ours.join(rows, F.col("ordinal") == F.col("at")).select("sequence_id", "log", "entry")

    def __iter__(self) -> Iterator[tuple[str, Row]]:
        """(log, entry) in arrival order: each log is streamed, and the streams are merged on the driver by id."""
        import heapq

        shown = self.index.select("sequence_id")
        streams = [stream(name, self.placed(name).join(shown, "sequence_id", "left_semi"), "entry") for name in self.tables]
        for _, name, entry in heapq.merge(*streams, key=lambda x: x[0]):
            yield name, entry

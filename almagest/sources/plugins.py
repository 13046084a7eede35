"""A seam for other file formats: a splitter cuts a file into slices, a processor turns each slice into rows on the executors, a merger takes the rows, in the order of the slices.

``run`` is one Spark job for each merge; nothing is collected unless the merger does so. A processor that fails raises ``SliceError`` on the driver with the number and byte range of its
slice. Splitters run on the driver; processors are sent to the executors and must be picklable (functions and objects of importable modules, or closures over plain values).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any, Protocol

import pandas as pd
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almagest.errors import SliceError, WriteError
from almagest.sources.frames import SYNC, Boundaries, _opened


class Splitter(Protocol):
    """Byte ranges of a file, end to end."""

    def slices(self, size: int, wanted: int) -> list[tuple[int, int]]: ...


class Processor(Protocol):
    """Rows, as dicts or tuples in the order of the schema, of a slice's bytes; ``start`` is where they begin in the file."""

    def process(self, data: bytes, start: int) -> Iterable[Any]: ...


Merger = Callable[[DataFrame], Any]


class Snapping:
    """Splits a file evenly and moves each cut to the next mark, so that no record is cut. Marks are looked for in windows, a few bytes for each slice."""

    WINDOW = 1 << 16

    def __init__(self, path: str, mark: bytes, behind: bool) -> None:
        self.path, self.mark, self.behind = path, mark, behind

    def _snap(self, f: pa.NativeFile, at: int, size: int) -> int:
        while at < size:
            f.seek(at)
            data = f.read(self.WINDOW + len(self.mark))
            found = data.find(self.mark)
            if found >= 0:
                return at + found + (len(self.mark) if self.behind else 0)
            at += self.WINDOW
        return size

    def slices(self, size: int, wanted: int) -> list[tuple[int, int]]:
        even = Boundaries().slices(size, wanted)
        with _opened(self.path) as f:
            cuts = sorted({0, size, *(self._snap(f, max(0, a - (len(self.mark) if self.behind else 0)), size) for a, _ in even[1:])})
        return [(a, z) for a, z in zip(cuts[:-1], cuts[1:], strict=True) if a < z]


def lines(path: str) -> Snapping:
    """Cuts behind line ends."""
    return Snapping(path, b"\n", behind=True)


def sync_marks(path: str, mark: bytes = SYNC) -> Snapping:
    """Cuts before sync bytes."""
    return Snapping(path, mark, behind=False)


class JsonLines:
    """A processor: one JSON object on each line."""

    def process(self, data: bytes, start: int) -> Iterable[dict]:
        return [json.loads(x) for x in data.splitlines() if x.strip()]


def to_csv(out: str) -> Merger:
    """A merger that writes CSV files with a header."""
    return lambda rows: rows.drop("slice").write.option("header", True).mode("overwrite").csv(out)


def to_json(out: str) -> Merger:
    return lambda rows: rows.drop("slice").write.mode("overwrite").json(out)


_FAILED = re.compile(r"<slice (\d+) (\d+) (\d+)>(.*?)</slice>", re.DOTALL)


def run(spark: SparkSession, path: str, schema: str | T.StructType, processor: Processor, splitter: Splitter | None = None, merge: Merger | None = None, wanted: int | None = None, slice_bytes: int = 16 << 20) -> Any:
    """Splits, processes and merges; without a merger the rows, with ``slice``, the number of the slice that each came from."""
    with _opened(path) as f:
        size = f.size()
    cut = (splitter or Boundaries()).slices(size, wanted or max(1, -(-size // slice_bytes)))
    if any(a != z for (_, z), (a, _) in zip(cut[:-1], cut[1:], strict=True)):
        raise ValueError("slices must lie end to end")
    names = (schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)).fieldNames()
    kind = T.StructType([T.StructField("slice", T.IntegerType()), *(schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema))])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for no, start, end in zip(pdf["no"], pdf["start"], pdf["end"], strict=True):
                try:
                    with _opened(path) as f:
                        f.seek(int(start))
                        rows = [r if isinstance(r, dict) else dict(zip(names, r, strict=True)) for r in processor.process(f.read(int(end - start)), int(start))]
                except Exception as e:
                    raise RuntimeError(f"<slice {no} {start} {end}>{type(e).__name__}: {e}</slice>") from e
                yield pd.DataFrame(rows, columns=names, dtype=object).assign(slice=int(no))[["slice", *names]]

    slices = spark.createDataFrame([(n, a, z) for n, (a, z) in enumerate(cut)], "no int, start long, end long")
    rows = slices.repartitionByRange(max(1, len(cut)), "no").mapInPandas(work, kind) if cut else spark.createDataFrame([], kind)
    return merged(rows, merge) if merge else rows


def merged(rows: DataFrame, merge: Merger) -> Any:
    """What the merger makes of the rows, in the order of the slices; its own errors become ``WriteError``, a slice's ``SliceError``."""
    try:
        return merge(rows.sortWithinPartitions("slice"))
    except PySparkException as e:
        raise slice_error(e) or WriteError(f"merging failed: {e}") from e
    except Exception as e:
        raise WriteError(f"merging failed: {e}") from e


def slice_error(e: Exception) -> SliceError | None:
    """The slice that made a job fail, if one did."""
    found = _FAILED.search(str(e))
    return SliceError(found[4], int(found[1]), (int(found[2]), int(found[3]))) if found else None


def counted(rows: DataFrame) -> DataFrame:
    """Rows of each slice, such as a progress report needs them."""
    return rows.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))

"""Log tables as immutable, lazy views: every filter returns a new table whose children follow by semi-joins."""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almagest.errors import FieldNotFoundError
from almagest.functions.aggregates import aggregated, described, operation
from almagest.functions.gpstime import GpsTime
from almagest.operators.joins import Key, positions
from almagest.operators.shred import PARENT, SEQUENCE, assemble

WEEK, MS = "header_week", "header_milliseconds"
COMPARATORS: dict[str, Callable[[Column, object], Column]] = {
    "==": lambda c, v: c == v,
    "!=": lambda c, v: ~c.eqNullSafe(F.lit(v)),  # keeps nulls
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
}


def compared(col: Column, comparator: str, value: object) -> Column:
    try:
        return COMPARATORS[comparator](col, value)
    except KeyError:
        raise ValueError(f"unknown comparator {comparator!r}") from None


def folding(op: Callable) -> Callable:
    """``op`` (of a pandas Series of doubles, missing ones NaN) over a column of arrays, a batch of parents at a time."""

    @F.pandas_udf("double")
    def fold(xs: pd.Series) -> pd.Series:
        return pd.Series([float(op(pd.Series(x, dtype="float64"))) for x in xs])

    return fold


def from_time(when: GpsTime | dt.datetime) -> Column:
    t = GpsTime.of(when)
    return (F.col(WEEK) > t.week) | ((F.col(WEEK) == t.week) & (F.col(MS) >= t.milliseconds))


def until_time(when: GpsTime | dt.datetime) -> Column:
    t = GpsTime.of(when)
    return (F.col(WEEK) < t.week) | ((F.col(WEEK) == t.week) & (F.col(MS) <= t.milliseconds))


class Namespace:
    """Children by attribute or by name."""

    def __init__(self, items: dict[str, LogTable]) -> None:
        self._items = items

    def __getattr__(self, name: str) -> LogTable:
        try:
            return self._items[name]
        except KeyError:
            raise AttributeError(name) from None

    def __getitem__(self, name: str) -> LogTable:
        return self._items[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._items)

    def __len__(self) -> int:
        return len(self._items)

    def __contains__(self, name: str) -> bool:
        return name in self._items


class FieldHandle:
    """A column of a table's current rows and its summaries: ``handle.mean``, ``handle.grouped_mean`` and so on."""

    def __init__(self, table: LogTable, name: str) -> None:
        self.table, self.name = table, name

    def __getattr__(self, what: str) -> object:
        grouped = what.startswith("grouped_")
        op = what.removeprefix("grouped_")
        if what.startswith("_") or op not in ("mean", "median", "min", "max", "sum", "std", "rms"):
            raise AttributeError(what)
        return self.table.summary(self.name, op, group=grouped)

    @property
    def column(self) -> DataFrame:
        return self.table.current.select(F.col(f"`{self.name}`"))

    def __repr__(self) -> str:
        return self.column._show_string(20, True, False)


@dataclasses.dataclass(frozen=True)
class LogTable:
    """``base``: all rows; ``current``: those of this view; ``within``: the restriction that a reset keeps (a parent's rows); ``order``: that of its rows."""

    name: str
    base: DataFrame
    children: dict[str, LogTable] = dataclasses.field(default_factory=dict)
    current: DataFrame | None = None
    within: DataFrame | None = None
    order: tuple[Key, ...] = (Key(SEQUENCE),)

    def __post_init__(self) -> None:
        if self.current is None:
            object.__setattr__(self, "current", self.base)

    # Shape

    @property
    def subtables(self) -> Namespace:
        return Namespace(self.children)

    @property
    def fields(self) -> list[str]:
        return [c for c in self.base.columns if c != SEQUENCE]

    def get_columns(self) -> list[str]:
        return [*self.base.columns, *(c for child in self.children.values() for c in child.get_columns())]

    def __len__(self) -> int:
        return self.current.count()

    def __getattr__(self, name: str) -> FieldHandle:
        if not name.startswith("_") and "base" in self.__dict__ and name in self.__dict__["base"].columns:
            return FieldHandle(self, name)
        raise AttributeError(name)

    def tree(self, depth: int = 0) -> str:
        line = f"{'  ' * depth}{self.name}: {len(self)} entries, {len(self.fields)} fields"
        return "\n".join([line, *(c.tree(depth + 1) for c in self.children.values())])

    def __repr__(self) -> str:
        return self.tree()

    # Views

    def _view(self, current: DataFrame, within: DataFrame | None = None, kept_order: bool = True) -> LogTable:
        ids = current.select(F.col(SEQUENCE).alias("_id"))
        children = {k: c._inside(ids) for k, c in self.children.items()}
        return LogTable(self.name, self.base, children, current, self.within if within is None else within, self.order if kept_order else (Key(SEQUENCE),))

    def _inside(self, ids: DataFrame) -> LogTable:
        rows = self.base.join(ids, self.base[PARENT] == ids["_id"], "left_semi")
        return self._view(rows, rows, False)

    def reset_filters(self) -> LogTable:
        start = self.base if self.within is None else self.within
        return self._view(start, kept_order=False)

    def apply_filter_mask(self, mask: Column) -> LogTable:
        return self._view(self.current.filter(mask))

    def _need(self, field: str) -> None:
        if field in self.base.columns:
            return
        holder = next((name for name, c in self.children.items() if field in c.get_columns()), None)
        raise FieldNotFoundError(f"{self.name} has no field {field!r}" + (f"; its child table {holder!r} has" if holder else ""))

    def filter_entries(self, field: str, comparator: str, value: object, subtable: str | Sequence[str] | None = None, op: str | Callable | None = None, use_current: bool = False) -> LogTable:
        """Rows whose own field compares, or that have a child row (at the path ``subtable``) that does.

        With ``op`` the parent's child values are aggregated first, over all child rows unless ``use_current``.
        """
        if subtable is None:
            self._need(field)
            return self._view(self.current.filter(compared(F.col(f"`{field}`"), comparator, value)))
        path = [subtable] if isinstance(subtable, str) else list(subtable)
        ids = self._matching(path, field, comparator, value, op, use_current)
        return self._view(self.current.join(ids, self.current[SEQUENCE] == ids["_id"], "left_semi"))

    def _matching(self, path: list[str], field: str, comparator: str, value: object, op: str | Callable | None, use_current: bool) -> DataFrame:
        """Ids of this table's rows below which the predicate holds."""
        if path[0] not in self.children:
            raise FieldNotFoundError(f"{self.name} has no child table {path[0]!r}")
        child = self.children[path[0]]
        if len(path) > 1:
            below = child._matching(path[1:], field, comparator, value, op, use_current)
            return child.current.join(below, child.current[SEQUENCE] == below["_id"], "left_semi").select(F.col(PARENT).alias("_id")).distinct()
        child._need(field)
        if op is None:
            return child.current.filter(compared(F.col(f"`{field}`"), comparator, value)).select(F.col(PARENT).alias("_id")).distinct()
        rows = child.current if use_current else child.base
        if callable(op):
            number = F.coalesce(F.col(f"`{field}`").cast("double"), F.lit(float("nan")))
            fold = rows.groupBy(PARENT).agg(F.collect_list(number).alias("x")).select(PARENT, folding(op)("x").alias("value"))
        else:
            fold = aggregated(rows, field, op, PARENT)
        return fold.filter(compared(F.col("value"), comparator, value)).select(F.col(PARENT).alias("_id"))

    def filter_mean(self, field: str, comparator: str, value: object, subtable: str | Sequence[str]) -> LogTable:
        return self.filter_entries(field, comparator, value, subtable, "mean")

    # Time

    def _need_time(self) -> None:
        if not {WEEK, MS} <= set(self.base.columns):
            raise FieldNotFoundError(f"{self.name} has no time columns")

    def filter_start_time(self, start: GpsTime | dt.datetime) -> LogTable:
        self._need_time()
        return self._view(self.current.filter(from_time(start)))

    def filter_end_time(self, end: GpsTime | dt.datetime) -> LogTable:
        self._need_time()
        return self._view(self.current.filter(until_time(end)))

    def filter_time_range(self, start: GpsTime | dt.datetime, end: GpsTime | dt.datetime) -> LogTable:
        return self.filter_start_time(start).filter_end_time(end)

    @property
    def time_range(self) -> tuple[GpsTime, GpsTime] | None:
        self._need_time()
        a, z = self.current.filter(F.col(WEEK).isNotNull()).agg(F.min(F.struct(WEEK, MS)), F.max(F.struct(WEEK, MS))).first()
        return None if a is None else (GpsTime(a[0], a[1] / 1000), GpsTime(z[0], z[1] / 1000))

    # Order

    def _sorted(self, *keys: Key) -> LogTable:
        order = (*keys, Key(SEQUENCE))
        return dataclasses.replace(self, current=self.current.orderBy(*[k.column for k in order]), order=order)

    def sort_by(self, field: str, ascending: bool = True) -> LogTable:
        self._need(field)
        return self._sorted(Key(field, ascending))

    def sort_by_time(self, ascending: bool = True) -> LogTable:
        self._need_time()
        return self._sorted(Key(WEEK, ascending), Key(MS, ascending))

    def positions(self) -> DataFrame:
        """The current rows with ``pos``, the place of each in this table's order."""
        return positions(self.current, self.order)

    # Summaries

    def _holder(self, field: str) -> LogTable:
        if field in self.base.columns:
            return self
        for child in self.children.values():
            try:
                return child._holder(field)
            except FieldNotFoundError:
                continue
        raise FieldNotFoundError(f"{self.name} has no field {field!r}")

    def summary(self, field: str, op: str, group: bool = False) -> object:
        """One value over the current rows, or with ``group`` a frame of parent_id and value."""
        operation(op)
        holder = self._holder(field)
        if not group:
            return aggregated(holder.current, field, op).first()[0]
        if PARENT not in holder.base.columns:
            raise FieldNotFoundError(f"{holder.name} has no parent to group by")
        return aggregated(holder.current, field, op, PARENT)

    def get_field_stats(self, field: str, use_current: bool = False) -> Row:
        self._need(field)
        return described(self.current if use_current else self.base, field).first()

    # Records

    def _assembly(self) -> tuple[DataFrame, dict]:
        return self.current, {k: c._assembly() for k, c in self.children.items()}

    def entries(self) -> DataFrame:
        """The current rows, each child's rows as an array of structs."""
        return assemble(*self._assembly())

    def __iter__(self) -> Iterator[Row]:
        return self.entries().orderBy(SEQUENCE).toLocalIterator()

    def record_class(self) -> type:
        return dataclasses.make_dataclass(self.name, [*self.base.columns, *((k, object, None) for k in self.children)])


for _op in ("mean", "median", "min", "max", "sum", "std", "rms"):
    setattr(LogTable, f"get_{_op}", lambda self, field, group=False, _op=_op: self.summary(field, _op, group))


def clean(df: DataFrame) -> DataFrame:
    """NaN becomes NULL, and unsigned 64-bit columns that Spark reads as decimals become bigint."""
    out = []
    for f in df.schema:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            col = F.when(~F.isnan(col), col).cast(f.dataType)
        elif isinstance(f.dataType, T.DecimalType) and f.dataType.scale == 0:
            col = col.cast("long")
        out.append(col.alias(f.name))
    return df.select(*out)


DATABASE_ORDER = (Key(WEEK), Key(MS), Key(SEQUENCE))


def database_order(index: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """The index with the time columns of each message's log row, in the order of time, unmatched ones last."""
    parts = [t.select("sequence_id", WEEK, MS) for t in tables.values() if {WEEK, MS} <= set(t.columns)]
    if not parts:
        raise FieldNotFoundError("no log has time columns")
    times = reduce(DataFrame.unionByName, parts)
    return index.join(times, "sequence_id", "left").orderBy(*[k.column for k in DATABASE_ORDER])


def database_positions(index: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """The same with ``pos``, the place of each message."""
    return positions(database_order(index, tables), DATABASE_ORDER)

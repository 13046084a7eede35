"""Joins that the built-in operators lack: nearest in time, k-th occurrence, and index to log rows by ordinal."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: How many tolerances wide the pieces of time are that ``nearest`` joins by themselves.
SPAN = 64


def nearest(left: DataFrame, right: DataFrame, on: str, by: Sequence[str], value_cols: Sequence[str], tolerance: float | None = None) -> DataFrame:
    """``left`` with the values of the right row nearest in ``on`` among equal ``by``; null where none is within the tolerance.

    The earlier row wins a tie, and of rows with one time the last by values. One exchange: both sides are unioned and two windows carry
    the rows before and after along, so the keys' rows are never multiplied. With a tolerance the windows are cut by time too, each as wide as ``SPAN`` tolerances;
    right rows near a cut belong to both sides of it. So a key that holds many rows is dealt over its time, and only a join without tolerance
    keeps all rows of a key together.
    """
    by = list(by)
    out_by = by
    if tolerance is not None:
        width = tolerance * SPAN if tolerance > 0 else 1.0
        span = lambda t: F.floor(t / width).cast("long")
        time = F.col(on).cast("double")
        left = left.withColumn("_span", span(time))
        right = right.withColumn("_span", F.explode(F.array_distinct(F.array(span(time - tolerance), span(time), span(time + tolerance)))))
        by = [*by, "_span"]
    extra = [c for c in left.columns if c not in (on, *by)]
    a = left.select(*by, F.col(on).cast("double").alias("_t"), F.lit(1).alias("_side"), F.struct(on, *extra).alias("_left"), F.lit(None).alias("_r"))
    b = right.select(*by, F.col(on).cast("double").alias("_t"), F.lit(0).alias("_side"), F.lit(None).alias("_left"), F.struct(F.col(on).cast("double").alias("t"), *value_cols).alias("_r"))
    rows = a.select(*by, "_t", "_side", "_left", F.lit(None).cast(b.schema["_r"].dataType).alias("_r")).unionByName(b.select(*by, "_t", "_side", F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), "_r"))
    before = Window.partitionBy(*by).orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*by).orderBy(F.col("_t").desc(), F.col("_side"), F.col("_r").asc()).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_b", F.last("_r", ignorenulls=True).over(before)).withColumn("_f", F.last("_r", ignorenulls=True).over(after)).filter("_side = 1")
    back, ahead = F.col("_t") - F.col("_b.t"), F.col("_f.t") - F.col("_t")
    chosen = F.when(back.isNotNull() & (ahead.isNull() | (back <= ahead)), F.col("_b")).otherwise(F.col("_f"))
    if tolerance is not None:
        chosen = F.when(F.abs(chosen["t"] - F.col("_t")) <= tolerance, chosen)
    found = found.withColumn("_c", chosen)
    return found.select(F.col(f"_left.{on}").alias(on), *out_by, *[F.col(f"_left.{c}").alias(c) for c in extra], *[F.col("_c")[c].alias(c) for c in value_cols])


def kth_occurrence(left: DataFrame, right: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str] = ()) -> DataFrame:
    """Left join of the k-th left row of a key with the k-th right row; null keys are equal. Columns ``l`` and ``r`` are the rows as structs.

    ``order`` is a whole number; a key's rows are numbered by ranges of it, so that a key that holds many rows is dealt among tasks. Where rows of a key share
    it, the columns ``ties``, which must be equal on both sides, decide; without them it is open which of those rows meet.
    """
    a = running_ordinal(left.select(F.struct("*").alias("l"), F.col(order).alias("_order"), *[F.col(k).alias(f"lk_{k}") for k in keys]), ["_order", *[F.col("l")[c] for c in ties]], "_order", "k", by=[f"lk_{k}" for k in keys])
    b = running_ordinal(right.select(F.struct("*").alias("r"), F.col(order).alias("_order"), *[F.col(k).alias(f"rk_{k}") for k in keys]), ["_order", *[F.col("r")[c] for c in ties]], "_order", "rk", by=[f"rk_{k}" for k in keys])
    same = F.col("k") == F.col("rk")
    for key in keys:
        same &= F.col(f"lk_{key}").eqNullSafe(F.col(f"rk_{key}"))
    return a.drop("_order").join(b.drop("_order"), same, "left").select("l", "r", (F.col("k") + 1).alias("k"))


def with_log_ordinal(index: DataFrame, unknown: DataFrame | None = None) -> DataFrame:
    """The index without unknown payloads, with ``ordinal``: the place of each message among those of its log."""
    known = index if unknown is None else index.join(unknown.select("sequence_id"), "sequence_id", "left_anti")
    return running_ordinal(known, ["sequence_id"], "sequence_id", by=["log"])


def with_table_ordinal(table: DataFrame, log: str) -> DataFrame:
    """A log table with its name and the ordinal of its rows, which index and table share whatever their ids mean; no window over the whole table."""
    return running_ordinal(table, ["sequence_id"], "sequence_id").withColumn("log", F.lit(log))


def running_ordinal(df: DataFrame, order: Sequence[str | Column], bucket: str, name: str = "ordinal", width: int = 1 << 16, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with the place of each row in the order given (among those of equal ``by``), without one window over all rows.

    ``bucket`` is a whole number that does not fall along the order; rows are numbered inside ranges of it, and the ranges' counts give their offsets.
    """
    part = df.withColumn("_part", F.floor(F.col(bucket) / width))
    keys = [*by, "_part"]
    counts = part.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    numbered = part.withColumn("_inside", inside).join(offsets, same)
    return numbered.withColumn(name, (F.col("_inside") + F.col("_offset")).cast("long")).drop("_part", "_inside", "_offset", *[f"_of_{k}" for k in keys])


@dataclass(frozen=True)
class Key:
    """A sort key: nulls are last in either direction."""

    name: str
    ascending: bool = True

    @property
    def column(self) -> Column:
        col = F.col(f"`{self.name}`")
        return col.asc_nulls_last() if self.ascending else col.desc_nulls_last()


def positions(df: DataFrame, order: Sequence[Key], name: str = "pos", ranges: int = 200) -> DataFrame:
    """``df`` with the place (from 1) of each row in the order given, without a window over all rows.

    A first key of numbers is cut into at most ``ranges`` ranges by a bounded sketch of its values (the bounds decide only how evenly rows are dealt); rows are
    numbered inside their range, and the ranges' counts give the offsets. A hot value's rows share a range, as they share a place but for the later keys.
    """
    first = order[0]
    value = F.col(f"`{first.name}`").cast("double")
    found = df.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0]
    bounds = sorted(set(found or []))
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < value)) if bounds else F.lit(0)
    place = F.when(value.isNull(), len(bounds) + 1).otherwise(place if first.ascending else len(bounds) - place)
    rows = running_ordinal(df.withColumn("_range", place.cast("long")), [k.column for k in order], "_range", name, width=1)
    return rows.withColumn(name, F.col(name) + 1).drop("_range")

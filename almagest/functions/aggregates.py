"""Summary operations, whole and by parent; NaN has become NULL at the scan, so both engines skip the same values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATIONS: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "median": F.median,
    "min": F.min,
    "max": F.max,
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "std": F.stddev_samp,
    "rms": lambda c: F.sqrt(F.avg(c.cast("double") * c.cast("double"))),
}


def operation(name: str) -> Callable[[Column], Column]:
    try:
        return OPERATIONS[name]
    except KeyError:
        raise ValueError(f"unknown operation {name!r}; there are {', '.join(OPERATIONS)}") from None


def aggregated(df: DataFrame, field: str, name: str, by: str | None = None) -> DataFrame:
    value = operation(name)(F.col(f"`{field}`")).alias("value")
    return df.agg(value) if by is None else df.groupBy(by).agg(value)


def described(df: DataFrame, field: str) -> DataFrame:
    """One row: count, mean, std, min, quartiles and max; of strings: count, unique, top, freq."""
    col = F.col(f"`{field}`")
    if isinstance(df.schema[field].dataType, T.StringType):
        counts = df.filter(col.isNotNull()).groupBy(col.alias("v")).count()
        return counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("count"), F.count("v").alias("unique"), F.max_by("v", F.struct("count", "v")).alias("top"), F.max("count").alias("freq"))
    value = col.cast("double")
    return df.agg(F.count(col).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.percentile(value, 0.25).alias("p25"), F.percentile(value, 0.5).alias("p50"), F.percentile(value, 0.75).alias("p75"), F.max(value).alias("max"))

"""Nested messages to a tree of linked tables, and back.

A struct becomes a child table with one row, an array of structs one row for each element, an array of scalars one row with ``key_0..``; scalars
stay. A child without children numbers its rows inside each parent; one with children numbers them through the whole table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almagest.operators.joins import running_ordinal

SEQUENCE, PARENT = "sequence_id", "parent_id"


@dataclass
class Shredded:
    table: DataFrame
    children: dict[str, Shredded] = field(default_factory=dict)


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StructType, T.ArrayType))


def shred(df: DataFrame, id_col: str = SEQUENCE) -> Shredded:
    """``df``: one row per message; its id becomes the table's ``sequence_id``. Column order is kept."""
    return _shred(df.withColumnRenamed(id_col, SEQUENCE), None)


def _shred(df: DataFrame, parent: str | None) -> Shredded:
    ids = [SEQUENCE] + ([PARENT] if parent else [])
    scalars = [f.name for f in df.schema if f.name not in ids and not _nested(f.dataType)]
    out = Shredded(df.select(*ids, *[F.col(f"`{c}`") for c in scalars]))
    for f in df.schema:
        if _nested(f.dataType):
            child = _child(df, f)
            if child is not None:
                out.children[f.name] = child
    return out


def _child(df: DataFrame, f: T.StructField) -> Shredded | None:
    col = F.col(f"`{f.name}`")
    if isinstance(f.dataType, T.StructType):
        rows = df.filter(col.isNotNull()).select(F.col(SEQUENCE).alias(PARENT), F.lit(0).cast("long").alias(SEQUENCE), col.alias("e"))
        element = f.dataType
    elif isinstance(f.dataType.elementType, T.StructType):
        rows = df.select(F.col(SEQUENCE).alias(PARENT), F.posexplode(col).alias("p", "e")).select(PARENT, F.col("p").cast("long").alias(SEQUENCE), "e")
        element = f.dataType.elementType
    else:
        width = df.agg(F.max(F.size(col))).first()[0] or 0
        if width <= 0:
            return None
        keys = [F.get(col, F.lit(i)).alias(f"key_{i}") for i in range(width)]
        return Shredded(df.filter(F.size(col) > 0).select(F.lit(0).cast("long").alias(SEQUENCE), F.col(SEQUENCE).alias(PARENT), *keys))
    rows = rows.select(SEQUENCE, PARENT, *[F.col("e")[c.name].alias(c.name) for c in element])
    if any(_nested(c.dataType) for c in element):
        rows = running_ordinal(rows, [PARENT, SEQUENCE], PARENT, "_id").withColumn(SEQUENCE, F.col("_id")).drop("_id")
    return _shred(rows, PARENT)


def with_offsets(table: DataFrame, sequence: int, parent: int, leaf: bool) -> DataFrame:
    """Ids of a later slice: a leaf's own ids stay, as they restart inside each parent."""
    out = table if leaf else table.withColumn(SEQUENCE, F.col(SEQUENCE) + sequence)
    return out.withColumn(PARENT, F.col(PARENT) + parent) if PARENT in table.columns else out


def assemble(table: DataFrame, children: dict[str, object]) -> DataFrame:
    """``table`` with each child's rows as an array of structs in order (null without rows); ``children``: name to (table, children)."""
    out = table
    for name, child in children.items():
        rows, below = (child.table, child.children) if isinstance(child, Shredded) else child
        nested = assemble(rows, below)
        fields = [c for c in nested.columns if c != PARENT]
        lists = nested.groupBy(F.col(PARENT).alias("_of")).agg(F.array_sort(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in fields]))).alias(name))
        out = out.join(lists, out[SEQUENCE] == lists["_of"], "left").drop("_of")
    return out


def expanded(value: Column, kind: T.StructType, prefix: str) -> list[Column]:
    """A struct's fields as columns with a prefix."""
    return [value[f.name].alias(f"{prefix}{f.name}") for f in kind]


def enum_columns(value: Column, name: str, names: dict[int, str]) -> list[Column]:
    """Name and raw number of an enumeration."""
    from almagest.functions.codes import named

    return [named(value, names).alias(name), value.cast("long").alias(f"{name}_raw")]


def union_promoted(frames: list[DataFrame]) -> DataFrame:
    """Union by name; missing columns are null, whole numbers widen to double where a slice has doubles, other conflicts become text."""
    kinds: dict[str, T.DataType] = {}
    for f in (f for df in frames for f in df.schema):
        old = kinds.setdefault(f.name, f.dataType)
        if old != f.dataType:
            numbers = isinstance(old, T.NumericType) and isinstance(f.dataType, T.NumericType)
            whole = isinstance(old, T.IntegralType) and isinstance(f.dataType, T.IntegralType)
            kinds[f.name] = f.dataType if isinstance(old, T.NullType) else old if isinstance(f.dataType, T.NullType) else T.LongType() if whole else T.DoubleType() if numbers else T.StringType()
    cast = [df.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in df.columns]) for df in frames]
    out = cast[0]
    for df in cast[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out

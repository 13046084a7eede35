"""Is a rebuilt log the same as the original? Joins by k-th occurrence, a field diff and roll-ups; and source fingerprints."""

from __future__ import annotations

import hashlib
import json
import os
import zipfile
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almagest.functions.rounding import difference_category, expected_rounding, explanation, is_close, relative_error
from almagest.operators.joins import kth_occurrence, running_ordinal

KEYS = ["log", "week", "milliseconds"]


def field_differences(original: DataFrame, rebuilt: DataFrame, tolerance: float = 1e-9, logs: list[str] | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """pos, log, matched, field, original, rebuilt, error, differs: a row for each field of each original message.

    Both sides: pos, log, week, milliseconds and ``body``, a map of field to text. Numbers compare within the relative tolerance. Where ``pos`` is not unique, the
    columns ``ties`` of both sides tell which message is which.
    """
    if logs is not None:
        original, rebuilt = (df.filter(F.col("log").isin(logs)) for df in (original, rebuilt))
    pairs = kth_occurrence(original, rebuilt, KEYS, "pos", ties)
    rows = pairs.select(F.col("l.pos").alias("pos"), F.col("l.log").alias("log"), F.col("r").isNotNull().alias("matched"), F.explode_outer("l.body").alias("field", "original"), F.col("r.body").alias("_body"))
    rows = rows.withColumn("rebuilt", F.element_at("_body", F.col("field"))).drop("_body")
    a, b = F.col("original").try_cast("double"), F.col("rebuilt").try_cast("double")
    whole = F.rlike("original", F.lit(r"^[+-]?\d+$")) & F.rlike("rebuilt", F.lit(r"^[+-]?\d+$"))
    differs = F.col("matched") & F.col("field").isNotNull() & ~_same_value(F.col("original"), F.col("rebuilt"), tolerance)
    return rows.withColumn("differs", differs).withColumn("error", F.when(differs & a.isNotNull() & b.isNotNull() & ~whole, relative_error(a, b)))


def categorised(differences: DataFrame) -> DataFrame:
    """The differences with their category and what it says."""
    found = differences.filter("differs").withColumn("category", difference_category(F.col("original"), F.col("rebuilt"), F.col("error")))
    return found.withColumn("explanation", explanation(F.col("category"), F.col("error")))


def status(diffs: Column, matched: Column) -> Column:
    return F.when(diffs > 0, "MISMATCH").when(matched == 0, "NOT_VERIFIED").otherwise("VERIFIED")


def by_log(differences: DataFrame, expected_ascii: bool = False) -> DataFrame:
    """log, messages, matched, diffs, status; with ``expected_ascii`` a mismatch that rounding explains entirely counts as verified."""
    per_message = differences.groupBy("log", "pos").agg(F.max("matched").alias("matched"), F.sum(F.col("differs").cast("int")).alias("diffs"))
    out = per_message.groupBy("log").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.col("matched").cast("int")).alias("matched"), F.sum("diffs").alias("diffs"))
    out = out.withColumn("status", status(F.col("diffs"), F.col("matched")))
    if expected_ascii:
        fine = categorised(differences).groupBy("log").agg(F.min(expected_rounding(F.col("category"))).alias("fine"))
        out = out.join(fine, "log", "left").withColumn("status", F.when((F.col("status") == "MISMATCH") & F.col("fine"), "VERIFIED").otherwise(F.col("status"))).drop("fine")
    return out


def overall(per_log: DataFrame) -> DataFrame:
    one = lambda cond, value: F.coalesce(F.sum(F.when(cond, value)), F.lit(0))
    return per_log.agg(F.coalesce(F.sum("messages"), F.lit(0)).alias("messages"), one(F.col("status") == "VERIFIED", 1).alias("verified_types"), one(F.col("status") == "NOT_VERIFIED", F.col("messages")).alias("messages_not_verified"), one(F.col("status") == "MISMATCH", 1).alias("mismatched_types"))


#: Widths of a message definition's field types; only the first two are compared as numbers.
WIDTHS = {"FLOAT": 4, "DOUBLE": 8, "BOOL": 4, "CHAR": 1, "UCHAR": 1, "SHORT": 2, "USHORT": 2, "INT": 4, "UINT": 4, "LONG": 4, "ULONG": 4, "LONGLONG": 8, "ULONGLONG": 8}
PAYLOAD = T.ArrayType(T.StructType([T.StructField("field", T.StringType()), T.StructField("original", T.DoubleType()), T.StructField("rebuilt", T.DoubleType()), T.StructField("error", T.DoubleType())]))


def float_offsets(definition: Sequence[tuple[str, str, int]]) -> list[tuple[int, int]]:
    """(offset, width) of the numbers with decimals among a message's fields (name, type, how many); a field of several is compared by its first."""
    widths = [WIDTHS[kind] * many for _, kind, many in definition]
    starts = np.concatenate(([0], np.cumsum(widths)))[:-1]
    return [(int(a), WIDTHS[kind]) for a, (_, kind, _) in zip(starts, definition, strict=True) if kind in ("FLOAT", "DOUBLE")]


def payload_pair(a: bytes, b: bytes, floats: Sequence[tuple[int, int]], tolerance: float) -> list[tuple]:
    """(field, original, rebuilt, relative error) of what differs: the length, else numbers beyond the tolerance, else single bytes."""
    if len(a) != len(b):
        return [("_payload_length", float(len(a)), float(len(b)), None)]
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    different = x != y
    found = []
    for at, width in floats:
        if different[at : at + width].any():
            p, q = (float(v[at : at + width].view(f"<f{width}")[0]) for v in (x, y))
            error = abs(p - q) / max(abs(p), 1e-300)
            if not error <= tolerance:
                found.append((at, (f"_float_offset_{at}", p, q, error)))
        different[at : at + width] = False
    found += [(int(k), (f"_byte_{k}", float(x[k]), float(y[k]), None)) for k in np.flatnonzero(different)]
    return [d for _, d in sorted(found, key=lambda d: d[0])]


def payload_differences(original: DataFrame, rebuilt: DataFrame, definitions: dict[str, Sequence[tuple[str, str, int]]] | None = None, tolerance: float = 1e-9) -> DataFrame:
    """pos, log, status of each original payload: same, different or unmatched; ``found``: what differs, numbers within the tolerance aside.

    ``definitions`` has the fields of each log; payloads of other logs are compared byte by byte. Where one side has no payload (it could not be encoded) and both
    have a body, the fields are compared instead. ``first_byte`` is the first differing byte.
    """
    floats = {log: float_offsets(d) for log, d in (definitions or {}).items()}

    @F.pandas_udf(PAYLOAD)
    def compared(log: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        rows = [None if x is None or y is None or x == y else payload_pair(x, y, floats.get(n, ()), tolerance) for n, x, y in zip(log, a, b, strict=True)]
        names = [f.name for f in PAYLOAD.elementType]
        return pd.Series([None if r is None else [dict(zip(names, d, strict=True)) for d in r] for r in rows], dtype=object)

    pairs = kth_occurrence(original, rebuilt, KEYS, "pos")
    rows = pairs.select(F.col("l.pos").alias("pos"), F.col("l.log").alias("log"), F.col("r").isNotNull().alias("matched"), F.col("l.payload").alias("a"), F.col("r.payload").alias("b"), *([F.col("l.body").alias("x"), F.col("r.body").alias("y")] if "body" in original.columns and "body" in rebuilt.columns else [F.lit(None).cast("map<string,string>").alias(c) for c in "xy"]))
    rows = rows.withColumn("found", F.coalesce(compared("log", "a", "b"), F.array().cast(PAYLOAD)))
    encoded = F.col("a").isNotNull() & F.col("b").isNotNull()
    wrong = F.filter(F.map_keys("x"), lambda k: ~_same_value(F.element_at("x", k), F.element_at("y", k), tolerance))
    of_fields = F.transform(wrong, lambda k: F.struct(k.alias("field"), F.element_at("x", k).try_cast("double").alias("original"), F.element_at("y", k).try_cast("double").alias("rebuilt"), F.lit(None).cast("double").alias("error")))
    rows = rows.withColumn("found", F.when(encoded | ~F.col("matched"), F.col("found")).otherwise(F.coalesce(of_fields, F.array().cast(PAYLOAD))))
    number = F.regexp_extract(F.get(F.col("found"), F.lit(0))["field"], r"^_(?:byte|float_offset)_([0-9]+)$", 1)
    return rows.select("pos", "log", F.when(~F.col("matched"), "unmatched").when(F.size("found") == 0, "same").otherwise("different").alias("status"), F.when(F.col("matched") & (F.size("found") > 0) & (number != ""), number.try_cast("int")).alias("first_byte"), F.when(F.col("matched"), F.col("found")).alias("found"))


def _same_value(a: Column, b: Column, tolerance: float) -> Column:
    """Texts of fields: numbers with decimals within the tolerance, whole numbers and other texts exactly, nulls equal."""
    x, y = a.try_cast("double"), b.try_cast("double")
    whole = F.rlike(a, F.lit(r"^[+-]?\d+$")) & F.rlike(b, F.lit(r"^[+-]?\d+$"))
    return F.coalesce(F.when(x.isNotNull() & y.isNotNull() & ~whole, is_close(x, y, tolerance)).otherwise(a.eqNullSafe(b)), F.lit(False))


def stored_differences(stored: DataFrame | None, rebuilt: DataFrame, log: str, tolerance: float = 1e-9) -> DataFrame:
    """One row (log, messages, diffs, status, reason): a stored table held against decoded messages (pos, body as map), the k-th row against the k-th message.

    A field kept as name and number is compared by its number; ids and header columns are not compared. No table: NOT_VERIFIED; other counts: MISMATCH.
    """
    spark = rebuilt.sparkSession
    out = "log string, messages long, diffs long, status string, reason string"
    if stored is None:
        return spark.createDataFrame([(log, 0, 0, "NOT_VERIFIED", "no table")], out)
    ours = [c for c in stored.columns if c not in ("sequence_id", "parent_id") and not c.startswith("header_") and not c.endswith("_raw")]
    pick = [F.lit(c) if half == 0 else F.col(f"`{c}_raw`" if f"{c}_raw" in stored.columns else f"`{c}`").cast("string") for c in ours for half in (0, 1)]
    a = stored.select("sequence_id", (F.create_map(*pick) if pick else F.lit(None).cast("map<string,string>")).alias("body"))
    a = running_ordinal(a, ["sequence_id"], "sequence_id", "k")
    b = running_ordinal(rebuilt.select("pos", F.col("body").alias("theirs")), ["pos"], "pos", "rk")
    n, m = a.count(), b.count()
    if n != m:
        return spark.createDataFrame([(log, n, 0, "MISMATCH", f"{n} rows stored, {m} messages")], out)
    pairs = a.join(b, F.col("k") == F.col("rk"))
    wrong = F.filter(F.map_keys("body"), lambda c: ~_same_value(F.element_at("body", c), F.element_at("theirs", c), tolerance))
    total = pairs.agg(F.coalesce(F.sum(F.size(wrong)), F.lit(0)).alias("diffs"))
    state = F.when(F.col("diffs") > 0, "MISMATCH").otherwise("VERIFIED")
    return total.select(F.lit(log).alias("log"), F.lit(n).cast("long").alias("messages"), F.col("diffs").cast("long").alias("diffs"), state.alias("status"), F.when(F.col("diffs") > 0, F.concat(F.col("diffs").cast("string"), F.lit(" differing fields"))).alias("reason"))


def category_counts(differences: DataFrame) -> DataFrame:
    """log, category, n: how many differences of each kind a log has."""
    return categorised(differences).groupBy("log", "category").agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class SourceCheck:
    valid: bool
    reason: str | None = None
    detail: str | None = None


def file_sha256(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while piece := f.read(1 << 20):
            h.update(piece)
    return h.hexdigest()


def fingerprint(path: str, archives: tuple[str, ...] = (".zip",)) -> tuple[int, str | None] | str:
    """(size, sha256) from a recording's metadata, or of a file, whose digest is left to ``file_sha256`` (None); else the reason why there is none."""
    p = Path(path)
    if p.suffix.lower() in archives:
        with zipfile.ZipFile(p) as z:
            name = next((n for n in z.namelist() if n.rsplit("/", 1)[-1] == "_metadata.json"), None)
            found = json.loads(z.read(name)) if name else None
    elif p.is_dir():
        meta = p / "_metadata.json"
        found = json.loads(meta.read_text()) if meta.exists() else None
    else:
        return os.path.getsize(p), None
    if found is None:
        return "metadata_missing"
    if not {"file_size", "sha256"} <= found.keys():
        return "metadata_incomplete"
    return found["file_size"], found["sha256"]


def same_source(first: str, second: str, archives: tuple[str, ...] = (".zip",)) -> SourceCheck:
    """Do two files or recordings (folders, or files with a suffix of ``archives``) come from one source? Sizes first, then digests, in any case of letters; a file is read only if it comes to that."""
    marks = []
    for label, path in (("first argument", first), ("second argument", second)):
        mark = fingerprint(path, archives)
        if isinstance(mark, str):
            return SourceCheck(False, mark, label)
        marks.append(mark)
    (size_a, sha_a), (size_b, sha_b) = marks
    if size_a != size_b:
        return SourceCheck(False, "file_size_mismatch", f"{size_a} and {size_b}")
    sha_a, sha_b = (file_sha256(path) if sha is None else sha for path, sha in ((first, sha_a), (second, sha_b)))
    if sha_a.lower() != sha_b.lower():
        return SourceCheck(False, "sha256_mismatch", f"{sha_a} and {sha_b}")
    return SourceCheck(True)

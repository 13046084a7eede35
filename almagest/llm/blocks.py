"""Ordered document blocks, and exchanges of packed keys between them.

The corpus is dealt once, by range of id, into blocks of a few MB.  A block is the unit of vectorised work.
Blocks never see each other: each sends its distinct keys, packed, to the owners of key slices (over hubs, if there are
many); an owner answers every block about the keys that this block sent.  A key therefore reaches its owner at most once
for each block, however many rows hold it.

All of it is one lazy plan.  The dealt documents are used by several passes, and Spark reuses that exchange;
a lost executor's part is computed again from the tables, as every pass is deterministic.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LAST = 2**63 - 1
PACKED = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("slice", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("data", T.BinaryType())])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where none is set, as in tests."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = "file://" + os.path.join(tempfile.gettempdir(), "almagest-shared")
    return where.rstrip("/")


#: Names a row where ids may be null or repeat.
ROW = "_row"


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """The rows with a number of their own, written so that it stays the same however often they are read."""
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), name)


_passing: list[str] | None = None


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that ``written`` makes inside are deleted at the end, but for those that the caller takes off the list of their paths."""
    global _passing
    before, _passing = _passing, []
    made = _passing
    try:
        yield made
    finally:
        _passing = before
        for path in made:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _passing is not None:
        _passing.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Arrays of fewer bytes are not compressed.
SMALL, RAW = 256, 128


def pack(values: np.ndarray) -> bytes:
    """Smallest unsigned type that holds the values, bytes grouped by significance, compressed."""
    top = int(values.max()) if len(values) else 0
    kind = next(t for t in ("u1", "u2", "u4", "u8") if top < 1 << (8 * int(t[1])))
    width = int(kind[1])
    raw = values.astype("<" + kind).view(np.uint8).reshape(-1, width).T.tobytes()
    small = len(raw) < SMALL
    return len(values).to_bytes(8, "little") + bytes([width | RAW * small]) + (raw if small else pa.compress(raw, codec="zstd", asbytes=True))


def unpack(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), data[8] & ~RAW
    raw = data[9:] if data[8] & RAW else pa.decompress(data[9:], decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.frombuffer(raw, dtype=np.uint8).reshape(width, n).T.copy().view(f"<u{width}").reshape(-1)


def pack_many(*arrays: np.ndarray) -> bytes:
    parts = [pack(a) for a in arrays]
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unpack_many(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(unpack(data[at + 8 : at + 8 + n]))
        at += 8 + n
    return out


class WholeIds:
    """Whole numbers in the order of the ids, for operators that order documents; ids that are whole numbers stand for themselves.

    Other ids (strings, say) are numbered in their order by a written table of the distinct ones; ``named`` puts the ids back.
    """

    def __init__(self, docs: DataFrame, id_col: str) -> None:
        self.id_col, self.names = id_col, None
        self.docs = docs
        if isinstance(docs.schema[id_col].dataType, T.IntegralType):
            return
        ids = docs.select(F.col(f"`{id_col}`").alias("_name")).filter("_name is not null").distinct().orderBy("_name")
        self.names = written(ids.withColumn("_number", F.monotonically_increasing_id()), "ids")
        given = docs.withColumnRenamed(id_col, "_given")
        self.docs = given.join(self.names, given["_given"] == self.names["_name"], "left").drop("_given", "_name").withColumnRenamed("_number", id_col)

    def named(self, out: DataFrame, *columns: str) -> DataFrame:
        """``out`` with the ids in place of the numbers in ``columns``."""
        if self.names is None:
            return out
        for c in columns:
            names = self.names.select(F.col("_name").alias("_its"), F.col("_number").alias("_of"))
            out = out.join(names, out[c] == names["_of"], "left").select(*[F.col("_its").alias(c) if x == c else F.col(f"`{x}`") for x in out.columns])
        return out


#: Most ranges of ids whose bounds the driver holds; beyond that many blocks each range is cut evenly by id.
MOST_BOUNDS = 1024
#: Rows read for each bound. The bounds decide only how evenly blocks are filled, never a result.
ROWS_A_BOUND = 50


def even_bounds(ids: np.ndarray, sizes: np.ndarray, parts: int) -> np.ndarray:
    """Ids that cut the rows into ``parts`` of about the same number of rows and bytes."""
    if not len(ids):
        return np.zeros(0, dtype=np.int64)
    order = np.argsort(ids, kind="stable")
    weight = np.cumsum(1 + sizes[order] / max(1.0, sizes.mean()))
    at = np.searchsorted(weight, weight[-1] * np.arange(1, parts) / parts)
    return np.unique(ids[order][np.minimum(at, len(ids) - 1)])


def block_numbers(ids: np.ndarray, cuts: np.ndarray, low: int, high: int, fine: int) -> np.ndarray:
    """The block of each id: its range between the cuts, and the range's ``fine`` equal parts; grows with the id."""
    part = np.searchsorted(cuts, ids, side="left")
    if fine == 1:
        return part
    edges = np.concatenate(([low], cuts, [high])).astype(np.float64)
    wide = np.maximum(edges[part + 1] - edges[part], 1)
    inside = np.clip(np.floor((ids.astype(np.float64) - edges[part]) * fine / wide), 0, fine - 1)
    return part * fine + inside.astype(np.int64)


class Blocks:
    """``docs`` as blocks: ranges of ids with about the same number of rows and bytes, so a smaller id is in the same block or an earlier one.

    ``frame`` has the columns block and data: a block's rows from one task, as a compressed Arrow stream with ord (the id, null ids
    last), text, and what is carried, as strings.  Packed rows keep the exchange small and spare the JVM the sorting of long texts.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 2 << 20, least: int = 24, carry: Sequence[str] = ()) -> None:
        id_type = docs.schema[id_col].dataType
        rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("ord"), F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{c}`").cast("string").alias(f"carry{i}") for i, c in enumerate(carry)])
        n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        self.id_type, self.rows, self.bytes = id_type, n, total
        wanted = int(max(1, min(n, max(least, -(-total // block_bytes)))))
        parts = min(wanted, MOST_BOUNDS)
        fine = -(-wanted // parts)
        cuts, low, high = np.zeros(0, dtype=np.int64), 0, 0
        if wanted > 1:
            share = rows.select("ord", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).sample(min(1.0, ROWS_A_BOUND * parts / n), seed=7)
            found = share.toPandas()
            cuts = even_bounds(found["ord"].to_numpy(np.int64), found["size"].to_numpy(np.float64), parts)
            real = found["ord"].to_numpy(np.int64)
            real = real[real < LAST]
            low, high = (int(real.min()), int(real.max())) if len(real) else (0, 0)
        self.count = (len(cuts) + 1) * fine

        def deal(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            for batch in batches:
                block = block_numbers(batch.column("ord").to_numpy(), cuts, low, high, fine)
                if np.any(block[1:] < block[:-1]):
                    order = np.argsort(block, kind="stable")
                    block, batch = block[order], batch.take(pa.array(order))
                head = np.flatnonzero(np.diff(block, prepend=-1))
                for a, z in zip(head, [*head[1:], len(block)], strict=True):
                    out = pa.BufferOutputStream()
                    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                        writer.write_batch(batch.slice(a, z - a))
                    yield pa.RecordBatch.from_arrays([pa.array([block[a]], pa.int32()), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["block", "data"])

        self.frame = rows.mapInArrow(deal, "block int, data binary")

    def each(self, fn: Callable[[int, pd.DataFrame], pd.DataFrame], schema: T.StructType) -> DataFrame:
        """``fn(block, rows)`` over every block, its rows (ord, text as bytes or None, what is carried) in order of id and text."""

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            return fn(int(key[0]), rows_of(pdf))

        return self.frame.groupBy("block").applyInPandas(run, schema)

    def answered(self, answers: DataFrame, fn: Callable[[int, pd.DataFrame, dict], pd.DataFrame], schema: T.StructType) -> DataFrame:
        """``fn(block, rows, answers)`` over every block and what the owners sent back to it, by kind and slice."""

        def run(key: tuple, pdf: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
            got = {(int(k), int(s)): d for k, s, d in zip(replies["kind"], replies["slice"], replies["data"], strict=True)}
            return fn(int(key[0]), rows_of(pdf), got)

        return self.frame.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, schema)


def rows_of(pdf: pd.DataFrame) -> pd.DataFrame:
    table = pa.concat_tables([pa.ipc.open_stream(d).read_all() for d in pdf["data"]])
    order = np.argsort(table["ord"].to_numpy(), kind="stable")
    text = table["text"].cast(pa.binary()).to_pylist()
    every = table["ord"].to_numpy()
    ids = every[order]
    if np.any(ids[1:] == ids[:-1]):  # rows with one id go by text, nulls first
        order = np.array(sorted(order, key=lambda i: (every[i], text[i] is not None, text[i] or b"")))
    rest = {c: pd.Series(table[c].to_pylist(), dtype=object).iloc[order].reset_index(drop=True) for c in table.column_names if c not in ("ord", "text")}
    return pd.DataFrame({"ord": ids, "text": pd.Series([text[i] for i in order], dtype=object)} | rest)


def texts_of(pdf: pd.DataFrame) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [t or b"" for t in pdf["text"]]


def packed(rows: Iterable[tuple[int, int, int, bytes]]) -> pd.DataFrame:
    return pd.DataFrame(list(rows), columns=["block", "slice", "kind", "data"]).astype({"block": "int32", "slice": "int32", "kind": "int32"})


#: Most key slices that a block, or a hub, sends a row to.
FAN = 4096
KEY, OWN = 0, 1
#: A row of a hub has the keys of several blocks; its kind is this much greater, and runs (block, slice, how many) stand before its columns.
MANY = 16


class Slices:
    """How many key slices there are, and by how many they are divided at each step on the way from blocks to owners."""

    def __init__(self, n: int) -> None:
        self.n, self.fan = n, FAN

    @property
    def levels(self) -> int:
        n = 1
        while self.fan**n < self.n:
            n += 1
        return n


def slices_for(n_keys: int, n_blocks: int) -> Slices:
    """As many owners as share the keys at about a million each, so that rows stay large and an owner's memory small."""
    return Slices(max(1, min(n_blocks, 8), n_keys >> 20))


class Deal:
    """How a block's keys go to the owners of ``slices``: ``order`` lists them row by row, and inside a row slice by slice, each slice in the order given.

    There is a row for each slice, or for each rest of the slices by their fan if there are more. A key's slice is its rest by their number, unless it is given.
    """

    def __init__(self, slices: Slices, hi: np.ndarray, given: np.ndarray | None = None) -> None:
        self.single, self.n = slices.levels == 1, min(slices.n, slices.fan)
        fine = (hi % np.uint64(slices.n)).astype(np.int64) if given is None else given
        if self.single:
            row = fine.astype(np.uint16)  # at most the fan: 16 bits sort in linear time
            self.order = np.argsort(row, kind="stable")
        else:
            row = fine % slices.fan
            self.order = np.lexsort((fine, row))
        self.fine = fine[self.order]
        self.cuts = np.searchsorted(row[self.order], np.arange(self.n + 1))

    def rows(self, block: int, columns: list[np.ndarray], kind: int = KEY) -> Iterable[tuple[int, int, int, bytes]]:
        for s in range(self.n):
            a, z = self.cuts[s], self.cuts[s + 1]
            if a < z:
                own = self.order[a:z]
                if self.single:
                    yield block, s, kind, pack_many(*(c[own] for c in columns))
                else:
                    head = np.flatnonzero(np.diff(self.fine[a:z], prepend=-1))
                    yield block, s, kind + MANY, pack_many(np.full(len(head), block), self.fine[a:z][head], np.diff(np.append(head, z - a)), *(c[own] for c in columns))

    def places(self, ascending: np.ndarray) -> np.ndarray:
        """Ascending positions of the keys, dealt; as gaps inside each row where it is one slice."""
        dealt = ascending[self.order].astype(np.int64)
        if not self.single:
            return dealt
        out = np.diff(dealt, prepend=0)
        heads = self.cuts[:-1][self.cuts[:-1] < self.cuts[1:]]
        out[heads] = dealt[heads]
        return out


def placed(places: np.ndarray, sizes: Iterable[int], slices: Slices) -> np.ndarray:
    """The dealt positions again; ``sizes``: how many each row got."""
    return ungap(places, sizes) if slices.levels == 1 else places.astype(np.int64)


def ungap(gaps: np.ndarray, sizes: Iterable[int]) -> np.ndarray:
    total = np.cumsum(gaps.astype(np.int64))
    sizes = np.fromiter(sizes, dtype=np.int64)
    before = np.concatenate(([0], total))[np.cumsum(sizes) - sizes]
    return total - np.repeat(before, sizes)


def answers_in_order(got: dict, kind: int) -> list[bytes]:
    return [got[k] for k in sorted(got) if k[0] == kind]


def gathered(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[np.ndarray], np.ndarray, np.ndarray]:
    """An owner's keys: the rows, their columns end to end, each element's block, and the rows' cuts."""
    rows = pdf[pdf["kind"] != OWN]
    parts = [unpack_many(d) for d in rows["data"]]
    runs = [p[:3] if k >= MANY else None for p, k in zip(parts, rows["kind"], strict=True)]
    parts = [p if r is None else p[3:] for p, r in zip(parts, runs, strict=True)]
    sizes = np.array([len(p[0]) for p in parts], dtype=np.int64)
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    block = [np.full(n, b) if r is None else np.repeat(r[0], r[2].astype(np.int64)) for r, b, n in zip(runs, rows["block"], sizes, strict=True)]
    return rows.assign(runs=runs), columns, np.concatenate(block).astype(np.int64), np.concatenate(([0], np.cumsum(sizes)))


def replies(rows: pd.DataFrame, answer: np.ndarray, cuts: np.ndarray) -> Iterable[tuple[int, int, int, bytes]]:
    """The answers for the rows that ``gathered`` gave, an element for each key."""
    for b, s, k, runs, a, z in zip(rows["block"], rows["slice"], rows["kind"], rows["runs"], cuts[:-1], cuts[1:], strict=True):
        yield b, s, k, pack(answer[a:z]) if runs is None else pack_many(*runs, answer[a:z])


def _split(pdf: pd.DataFrame, row_of: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], plain: bool) -> pd.DataFrame:
    """A hub: deals the keys of its rows anew, to the rows (unit, slice) that ``row_of`` gives for (block, slice); what is no key passes."""
    keys = pdf[pdf["kind"] != OWN]
    rest = pdf[pdf["kind"] == OWN]
    out = list(zip(rest["block"], rest["slice"], rest["kind"], rest["data"], strict=True))
    if len(keys):
        parts = [unpack_many(d) for d in keys["data"]]
        runs = [np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(3)]
        block, fine = (np.repeat(r, runs[2]) for r in runs[:2])
        columns = [np.concatenate(c) for c in zip(*(p[3:] for p in parts), strict=True)]
        unit, row = row_of(block, fine)
        order = np.lexsort((fine, block, row, unit))
        block, fine, unit, row = block[order], fine[order], unit[order], row[order]
        fresh = lambda *c: np.flatnonzero(np.any([np.diff(x, prepend=-1) != 0 for x in c], axis=0))
        head = fresh(unit, row)
        for a, z in zip(head, np.append(head[1:], len(order)), strict=True):
            own = [c[order[a:z]] for c in columns]
            run = fresh(block[a:z], fine[a:z])
            kind = KEY if plain else KEY + MANY
            data = pack_many(*own) if plain and len(own) > 1 else pack(own[0]) if plain else pack_many(block[a:z][run], fine[a:z][run], np.diff(np.append(run, z - a)), *own)
            out.append((int(unit[a]), int(row[a]), kind, data))
    return packed(out)


def owned(parts: DataFrame, owner: Callable[[pd.DataFrame], pd.DataFrame], slices: Slices) -> DataFrame:
    """What the owners of the key slices answer to the blocks' rows.

    Up to ``FAN`` slices each block sends a row to each owner. More are reached over hubs: a hub has the rows of up to ``FAN`` blocks (at the next level: hubs) for the slices with one
    rest, merges them and divides the slices by ``FAN`` again; answers go back the same way. So the number of rows at each level grows with the input, not with its square.
    """
    fan, own = slices.fan, F.col("kind") == OWN

    def forward(level: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
        return lambda pdf: _split(pdf, lambda block, fine: (block // fan**level, fine % fan ** (level + 1)), plain=False)

    def backward(level: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
        return lambda pdf: _split(pdf, lambda block, fine: (block // fan ** (level - 1), fine % fan**level), plain=level == 1)

    # States go along by their blocks' numbers; other rows are named by the unit of their level.
    for level in range(1, slices.levels):
        unit = F.when(own, F.col("block")).otherwise(F.col("block") * fan ** (level - 1))
        parts = parts.withColumn("unit", F.floor(unit / fan**level)).groupBy("unit", "slice").applyInPandas(forward(level), PACKED)
    parts = parts.groupBy("slice").applyInPandas(lambda pdf: owner(pdf), PACKED)  # a method would count as taking the key too
    for level in range(slices.levels - 1, 0, -1):
        unit = F.when(own, F.floor(F.col("block") / fan**level)).otherwise(F.col("block"))
        parts = parts.withColumn("unit", unit).withColumn("row", F.col("slice") % fan**level).groupBy("unit", "row").applyInPandas(backward(level), PACKED)
    return parts


class Sketch:
    """A count-min sketch in parts: each block's part lists its nonzero counters, the owners add the parts up.

    ``depth`` rows of ``2**bits`` counters; counters saturate at 255.  An estimate is never below the true number of
    occurrences, so whatever repeats is kept.  Width follows the number of keys, so the share of false alarms
    does not depend on the size of the corpus.
    """

    def __init__(self, n_keys: int, n_blocks: int, depth: int = 2, load: float = 0.5) -> None:
        self.depth = depth
        self.bits = max(10, int(np.ceil(np.log2(max(1.0, n_keys / load)))))
        self.slice_bits = min(self.bits, int(np.ceil(np.log2(slices_for(n_keys, n_blocks).n))))
        self.slices = Slices(depth << self.slice_bits)
        self.low_bits = self.bits - self.slice_bits

    def _buckets(self, keys: np.ndarray, row: int) -> np.ndarray:
        turn = keys if row == 0 else (keys * np.uint64(0x9E3779B97F4A7C15)) ^ (keys >> np.uint64(29))
        return (turn * np.uint64((0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)[row % 3])) >> np.uint64(64 - self.bits)

    def _slices(self, buckets: np.ndarray, row: int) -> np.ndarray:
        return (buckets >> np.uint64(self.low_bits)).astype(np.int64) | row << self.slice_bits

    def part(self, block: int, keys: np.ndarray) -> Iterable[tuple[int, int, int, bytes]]:
        """The block's counters: of each slice the gaps between their places, and what they count."""
        slices, gaps, counts = [], [], []
        for row in range(self.depth):
            ordered = np.sort(self._buckets(keys, row))
            new = np.flatnonzero(np.diff(ordered, prepend=ordered[:1] + np.uint64(1))) if len(ordered) else np.zeros(0, dtype=np.int64)
            mine = ordered[new]
            slices.append(self._slices(mine, row))
            low = (mine & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)
            gap, head = np.diff(low, prepend=0), np.flatnonzero(np.diff(slices[-1], prepend=-1))
            gap[head] = low[head]
            gaps.append(gap)
            counts.append(np.minimum(np.diff(new, append=len(ordered)), 255))
        slices, gaps, counts = (np.concatenate(x) for x in (slices, gaps, counts))
        yield from Deal(self.slices, slices, slices).rows(block, [gaps, counts])

    def owner(self, pdf: pd.DataFrame) -> pd.DataFrame:
        """Adds up one slice; answers with the merged counters of each block's own list."""
        rows, (gaps, counts), _, cuts = gathered(pdf)
        sizes = [n for runs, a, z in zip(rows["runs"], cuts[:-1], cuts[1:], strict=True) for n in ([z - a] if runs is None else runs[2].tolist())]
        at = ungap(gaps, sizes)
        total = np.minimum(np.bincount(at, weights=counts, minlength=1 << self.low_bits), 255).astype(np.uint8)
        return packed(replies(rows, total[at], cuts))

    def estimates(self, keys: np.ndarray, got: dict) -> np.ndarray:
        """Merged count of each key, in the order given, from the owners' answers to this block."""
        out = np.full(len(keys), 255, dtype=np.uint8)
        if not len(keys):
            return out
        orders, places, slices = [], [], []
        n = 0
        for row in range(self.depth):
            buckets = self._buckets(keys, row)
            orders.append(np.argsort(buckets))
            ordered = buckets[orders[-1]]
            new = np.diff(ordered, prepend=ordered[:1] + np.uint64(1)) != 0
            places.append(np.cumsum(new) - 1 + n)
            n = int(places[-1][-1]) + 1
            slices.append(self._slices(ordered[new], row))
        slices = np.concatenate(slices)
        merged = np.empty(len(slices), dtype=np.uint8)
        merged[Deal(self.slices, slices, slices).order] = np.concatenate([unpack(d) for d in answers_in_order(got, KEY)])
        for order, place in zip(orders, places, strict=True):
            out[order] = np.minimum(out[order], merged[place])
        return out

    def exchange(self, blocks: Blocks, keys_of: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
        """The owners' answers for all blocks; ``keys_of`` gives a block's keys."""
        parts = blocks.each(lambda block, pdf: packed(self.part(block, keys_of(pdf))), PACKED)
        return owned(parts, self.owner, self.slices)


def distinct(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first of each distinct (hi, lo), and for every element the number of its distinct pair."""
    if not len(hi):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    order = np.argsort(hi)
    h, low = hi[order], lo[order]
    if np.any((h[1:] == h[:-1]) & (low[1:] != low[:-1])):
        order = np.lexsort((lo, hi))
        h, low = hi[order], lo[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (low[1:] != low[:-1])
    number = np.empty(len(h), dtype=np.int64)
    number[order] = np.cumsum(fresh) - 1
    return np.minimum.reduceat(order, np.flatnonzero(fresh)), number

"""Benchmark decontamination by template canonicalisation.

Text becomes a list of tokens; numbers, names and units become typed placeholders and the other words are lower-cased, which gives
templates that do not change with a question's parameters.  Windows of consecutive template tokens are joined by hash with the benchmark's.
For each meeting the slots are held against each other: the values must map one to one between document and item.

A window says something only if enough of its tokens are plain words.  An item without such a window (fewer than ten tokens, or mostly numbers and names)
is looked for whole: it is joined by its first tokens, lower-cased, and all its tokens must be the same, values too, but for the case of letters.

All on DataFrame functions.  The benchmark's windows are broadcast if their counted bytes are within ``broadcast_bytes``; otherwise the join is shuffled.

Defined cases: a null or empty text has no windows and is clean; an item without tokens marks nothing; a null item id marks documents but is in no list of
items; each document is judged by itself, whatever its id (null, repeated, of any type); rows that repeat id and text are judged alike; an empty benchmark leaves
all documents clean; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that stand for units of measure and currency.
UNITS = "mm cm m km in ft yd mi mg g kg lb oz ml l s sec min h hr hours hour minutes minute seconds second days day weeks week months month years year percent dollars dollar euros euro cents cent usd eur gbp degrees degree miles mile meters meter metres metre kilometers kilometres grams gram kilograms pounds liters litres".split()
TOKEN = r"[0-9]+(?:[.,][0-9]+)*|\p{L}[\p{L}\p{M}]*"
NAME = r"^\p{Lu}\p{Ll}+$"
SIZE = 10
PLAIN = 6
BROADCAST_BYTES = 64 << 20


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def slot(token: Column) -> Column:
    """The type of a slot's token; null for a plain word."""
    number = (token >= "0") & (token < ":")
    small = (token >= "a") & (token < "{")  # such a token is no name; spares the expression
    return F.when(number, F.lit("<number>")).when(F.lower(token).isin(UNITS), F.lit("<unit>")).when(~small & F.rlike(token, F.lit(NAME)), F.lit("<name>"))


def template(token: Column) -> Column:
    return F.coalesce(slot(token), F.lower(token))


def window_hashes(hashed: Column) -> Column:
    """Hash of every run of ten of an array's values, from runs of two, four and eight."""
    join = lambda left, right, gap: F.zip_with(left, F.slice(right, gap + 1, F.greatest(F.size(right) - gap, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    held = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    tens = lambda two: held(join(two, two, 2), lambda four: join(join(four, four, 4), two, 8))
    return F.slice(held(join(hashed, hashed, 1), tens), 1, F.greatest(F.size(hashed) - SIZE + 1, F.lit(0)))


def run_hashes(hashed: Column, size: int) -> Column:
    """Hash of every run of ``size`` of an array's values."""
    if size == SIZE:
        return window_hashes(hashed)
    return F.when(F.size(hashed) >= size, F.transform(F.sequence(F.lit(1), F.size(hashed) - size + 1), lambda i: F.xxhash64(F.slice(hashed, i, size)))).otherwise(F.array().cast("array<bigint>"))


def token_hashes(token: Column, whole: bool = False) -> Column:
    """Of template tokens, or for items that are looked for whole of the lower-cased ones."""
    return F.transform(token, lambda t: F.xxhash64(F.lower(t) if whole else template(t)))


def wanted(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    """item, whole, size, window, theirs: the hash of the first ``size`` tokens and the tokens to hold against; ``whole`` where values must be the same."""
    own = benchmark.select(F.col(f"`{item_col}`").alias("item"), tokens(F.col(f"`{item_text_col}`").cast("string")).alias("token")).withColumn("n", F.size("token")).filter("n > 0")
    plain = lambda ts: F.size(F.filter(ts, lambda t: slot(t).isNull())) >= PLAIN
    tens = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.col("n") - SIZE + 1, F.lit(1))), lambda i: F.slice("token", i, SIZE)), lambda w: (F.size(w) == SIZE) & plain(w))
    listed = own.withColumn("tens", tens).withColumn("whole", F.size("tens") == 0).withColumn("theirs", F.explode(F.when(F.col("whole"), F.array("token")).otherwise(F.col("tens"))))
    size = F.least(F.size("theirs"), F.lit(SIZE))
    head = F.slice("theirs", 1, SIZE)
    first = F.when(~F.col("whole"), F.get(window_hashes(token_hashes(head)), F.lit(0)))
    for k in range(1, SIZE + 1):
        first = F.when(F.col("whole") & (size == k), F.get(run_hashes(token_hashes(head, True), k), F.lit(0))).otherwise(first)
    return listed.select("item", "whole", size.alias("size"), first.alias("window"), "theirs").distinct()


#: 128 bits of id and text, which tell documents apart whatever their ids are.
KEYS = ["_k1", "_k2"]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    of, text = F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")
    return [F.xxhash64(of, text).alias(KEYS[0]), F.xxhash64(text, F.lit(1), of).alias(KEYS[1])]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each distinct document that meets the benchmark: its keys, n_windows (consistent windows) and item_ids (ascending)."""
    rows = docs.select(*keyed(docs, id_col, text_col), F.col(f"`{text_col}`").cast("string").alias("text"))
    asked = wanted(benchmark, item_col, item_text_col)
    facts = asked.agg(F.coalesce(F.sum(F.octet_length(F.array_join("theirs", " ")) + 200), F.lit(0)).alias("bytes"), F.collect_set(F.when(F.col("whole"), F.col("size"))).alias("sizes")).first()  # ten sizes at most
    near = F.broadcast if facts["bytes"] <= broadcast_bytes else lambda x: x

    key = ["whole", "size", "window"]
    windows = None
    for whole, size in [(False, SIZE), *((True, k) for k in sorted(facts["sizes"]))]:
        hashed = rows.select(*KEYS, token_hashes(tokens(F.col("text")), whole).alias("h"))
        some = hashed.select(*KEYS, F.lit(whole).alias("whole"), F.lit(size).alias("size"), F.posexplode(run_hashes(F.col("h"), size)).alias("at", "window"))
        windows = some if windows is None else windows.union(some)
    met = windows.join(near(asked.select(*key).distinct()), key, "left_semi")
    per_doc = met.groupBy(*KEYS).agg(F.collect_set(F.struct("at", *key)).alias("met"))
    mine = rows.join(per_doc, KEYS).select(*KEYS, tokens(F.col("text")).alias("token"), F.explode("met").alias("w")).select(*KEYS, "token", "w.*")
    both = mine.join(near(asked), key).withColumn("ours", F.slice("token", F.col("at") + 1, F.size("theirs")))
    pairs = F.filter(F.zip_with("ours", "theirs", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: slot(p["a"]).isNotNull())
    both = both.withColumn("pairs", F.array_distinct(pairs))
    apart = lambda side: F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p[side])))
    alike = lambda form: F.forall(F.zip_with("ours", "theirs", lambda a, b: F.coalesce(form(a) == form(b), F.lit(False))), lambda x: x)
    consistent = F.when(F.col("whole"), alike(F.lower)).otherwise(alike(template) & apart("a") & apart("b"))
    return both.filter(consistent).groupBy(*KEYS).agg(F.count_distinct("at").alias("n_windows"), F.array_sort(F.collect_set("item")).alias("item_ids"))


def judged(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: object) -> DataFrame:
    """One row per document: id, contaminated, n_windows and item_ids."""
    found = contamination(docs, benchmark, id_col, text_col, **more)
    ids = docs.select(F.col(f"`{id_col}`").alias("doc"), *keyed(docs, id_col, text_col))
    none = F.array().cast(found.schema["item_ids"].dataType)
    return ids.join(found, KEYS, "left").select(F.col("doc").alias(id_col), F.col("n_windows").isNotNull().alias("contaminated"), F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"), F.coalesce("item_ids", none).alias("item_ids"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: object) -> DataFrame:
    """The rows of ``docs`` that meet no benchmark item."""
    found = contamination(docs, benchmark, id_col, text_col, **more).select(*[F.col(k).alias(f"{k}m") for k in KEYS])
    rows = docs.select("*", *keyed(docs, id_col, text_col))
    return rows.join(found, (rows[KEYS[0]] == found[f"{KEYS[0]}m"]) & (rows[KEYS[1]] == found[f"{KEYS[1]}m"]), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

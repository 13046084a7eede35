"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, derived from its code point.  A vector for an n-gram binds (multiplies) its letters'
vectors, each permuted (rotated) by its place; a text's vector bundles (adds) its n-grams.  Prototypes bundle the labelled texts
of a language, each scaled to length 1; a text gets the language whose prototype has the greatest cosine with its vector.

Letters are lower-cased; every run of other characters counts as one boundary symbol.  Sums are whole numbers in float32, exact up to
2**24 n-grams; longer texts are summed in parts in float64, so a result never depends on how rows are batched.  Memory is bounded by ``CHUNK`` symbols and the
vectors of ``UNLIKE`` unlike n-grams.

Training reads a bounded sample: at most ``max_training_rows`` labelled rows, those with the least hash of the id.

Defined cases: ``und`` with score 0 where the text is null or has no letter, and where no label could be learned; ties go to the
first label in order; rows with null labels are predicted, never learned from; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSION = 512
GRAM = 3
CHUNK = 1 << 20
UNLIKE = 1 << 14
UNKNOWN = "und"
AT_ONCE = 2000


@functools.cache
def _letters() -> np.ndarray:
    """Code point to lower-cased code point; 0 for what is no letter."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@functools.lru_cache(maxsize=1 << 15)
def letter_vector(code: int, dimension: int) -> np.ndarray:
    bits = np.random.Generator(np.random.PCG64([code, 77])).integers(0, 2, dimension)
    return (2 * bits - 1).astype(np.float32)


def gram_vectors(codes: np.ndarray, dimension: int) -> np.ndarray:
    """One row for each n-gram, given as a row of code points."""
    letters, place = np.unique(codes, return_inverse=True)
    base = np.stack([letter_vector(int(c), dimension) for c in letters])
    place = place.reshape(codes.shape)
    out = np.ones((len(codes), dimension), dtype=np.float32)
    for k in range(codes.shape[1]):
        out *= np.roll(base, codes.shape[1] - 1 - k, axis=1)[place[:, k]]
    return out


def text_vectors(texts: list[str | None], dimension: int = DIMENSION, gram: int = GRAM) -> np.ndarray:
    """float64 array: the bundle of every text; zeros without letters."""
    return counted_vectors(texts, dimension, gram)[0]


def symbols(text: str, gram: int, chunk: int | None = None) -> Iterator[np.ndarray]:
    """The text's symbols, letters and boundaries (0), in parts that overlap by ``gram - 1``: every n-gram is in exactly one part.

    Each run of other characters is one boundary, and one is put in front and behind, wherever the parts are cut.
    """
    chunk = chunk or CHUNK
    held = np.zeros(1, dtype=np.uint32)  # the boundary in front
    for a in range(0, len(text), chunk):
        letter = _letters()[np.frombuffer(text[a : a + chunk].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        if a + chunk >= len(text):
            letter = np.append(letter, np.uint32(0))
        keep = letter > 0
        keep[1:] |= letter[:-1] > 0
        keep[:1] |= held[-1] > 0
        part = np.concatenate((held, letter[keep]))
        yield part
        held = part[max(0, len(part) - gram + 1) :]


def counted_vectors(texts: list[str | None], dimension: int = DIMENSION, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The bundle of every text and the number of n-grams in it."""
    out, sizes = np.zeros((len(texts), dimension)), np.zeros(len(texts), dtype=np.int64)
    group: list[tuple[int, np.ndarray]] = []
    held = 0
    for i, text in enumerate(texts):
        for part in symbols(text or "", gram):
            if held and held + len(part) > CHUNK:
                _bundle(group, out, sizes, gram)
                group, held = [], 0
            group.append((i, part))
            held += len(part)
    _bundle(group, out, sizes, gram)
    return out, sizes


def _bundle(group: list[tuple[int, np.ndarray]], out: np.ndarray, sizes: np.ndarray, gram: int) -> None:
    """Adds the n-grams of parts of texts; the vectors of ``UNLIKE`` unlike n-grams are in memory at a time, however many there are."""
    letter = np.concatenate([part for _, part in group]) if group else np.zeros(0, dtype=np.uint32)
    owner = np.repeat(np.arange(len(group)), [len(part) for _, part in group])
    alphabet, small = np.unique(letter, return_inverse=True)
    k = len(alphabet)
    n = len(small) - gram + 1
    if n <= 0 or not alphabet[-1]:
        return
    code = np.zeros(n, dtype=np.int64)
    for j in range(gram):
        code = code * k + small[j : j + n]
    whole = owner[:n] == owner[gram - 1 :]
    code, part = code[whole], owner[:n][whole]
    of = np.array([i for i, _ in group])
    text = np.unique(of)  # parts of one text next to each other are one
    part = np.searchsorted(text, of)[part]
    sizes[text] += np.bincount(part, minlength=len(text))
    if k**gram <= 1 << 24:
        seen = np.flatnonzero(np.bincount(code, minlength=k**gram))
        number = np.zeros(k**gram, dtype=np.int32)
        number[seen] = np.arange(len(seen))
        code = number[code]
    else:
        seen, code = np.unique(code, return_inverse=True)
    total = np.zeros((len(text), out.shape[1]))
    for a in range(0, len(seen), UNLIKE):
        some = seen[a : a + UNLIKE]
        vectors = gram_vectors(np.stack([alphabet[some // k ** (gram - 1 - j) % k] for j in range(gram)], axis=1), out.shape[1])
        mine = slice(None) if len(some) == len(seen) else np.flatnonzero((code >= a) & (code < a + len(some)))
        row, column = part[mine], code[mine] - a
        step = max(1, (1 << 20) // len(some))
        cuts = np.searchsorted(row, np.arange(0, len(text) + step, step))
        for b, (y, w) in zip(range(0, len(text), step), zip(cuts[:-1], cuts[1:], strict=True), strict=False):
            rows = min(step, len(text) - b)
            counts = np.bincount((row[y:w] - b) * len(some) + column[y:w], minlength=rows * len(some)).reshape(rows, len(some))
            total[b : b + rows] += counts.astype(np.float32) @ vectors
    out[text] += total


def unit(vectors: np.ndarray) -> np.ndarray:
    length = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", max_training_rows: int = 4000, dimension: int = DIMENSION) -> tuple[list[str], np.ndarray]:
    """Labels in order and their prototypes, from at most ``max_training_rows`` rows."""
    rows = labelled.filter(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    rank = F.xxhash64(F.col(f"`{id_col}`"))
    last = rows.select(rank.alias("rank")).orderBy("rank").limit(max_training_rows).agg(F.max("rank")).first()[0]
    if last is None:
        return [], np.zeros((0, dimension))
    sample = rows.filter(rank <= last).select(F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors = unit(text_vectors(pdf["text"].tolist(), dimension))
            sums = pd.DataFrame({"label": pdf["label"], "at": range(len(pdf))}).groupby("label")["at"].apply(list)
            yield pd.DataFrame({"label": sums.index, "total": [vectors[at].sum(axis=0).tolist() for at in sums]})

    # Rows that repeat an id can exceed the limit by their number only; the sums have one row for each label and dimension.
    parts = sample.mapInPandas(bundle, "label string, total array<double>")
    sums = parts.select("label", F.posexplode("total").alias("at", "x")).groupBy("label", "at").agg(F.round(F.sum("x"), 6).alias("x")).collect()
    labels = sorted({r.label for r in sums})
    out = np.zeros((len(labels), dimension))
    for r in sums:
        out[labels.index(r.label), r.at] = r.x
    return labels, unit(out)


def predict(docs: DataFrame, labels: list[str], prototypes: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """One row per document: its id (or the columns to keep, of any names and types, in front), lang_pred, score (the cosine, 0 where it is negative) and n_unlike, the number of
    equally frequent unlike n-grams whose bundle would be as long as the text's: repeats add nothing to it."""
    keep = [id_col] if keep is None else list(keep)
    types = [docs.schema[c].dataType for c in keep]
    schema = T.StructType([*[T.StructField(f"keep{i}", t) for i, t in enumerate(types)], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_unlike", T.DoubleType())])
    dimension = prototypes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(a, AT_ONCE)
                vectors, sizes = counted_vectors(part.column(0).to_pylist(), dimension)
                squares = (vectors * vectors).sum(axis=1)
                unlike = np.divide(sizes.astype(float) ** 2 * dimension, squares, out=np.zeros(len(sizes)), where=squares > 0)
                known = vectors.any(axis=1) & bool(labels)
                cosine = unit(vectors) @ prototypes.T if labels else np.zeros((len(sizes), 1))
                best = cosine.argmax(axis=1)
                score = np.where(known, np.clip(cosine[np.arange(len(sizes)), best], 0, 1), 0.0)
                names = [labels[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(names, pa.string()), pa.array(np.round(score, 9)), pa.array(np.round(unlike, 6))], schema.names)

    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{c}`").alias(f"keep{i}") for i, c in enumerate(keep)])
    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score", "n_unlike")


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Rows kept from training: crc32 of the id as text is divisible by ``folds``."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % folds == 0

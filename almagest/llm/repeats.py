"""Substring dedup: words covered by a word window that also starts earlier in the corpus are removed.

Method: a count-min prefilter.  Every block of documents sends its part of one count-min sketch of window
fingerprints; the owners of the sketch's slices merge the parts and answer with estimates that are never too low.  In a
second pass only windows estimated to repeat are grouped exactly, by 128-bit fingerprint and by the block that has the
earliest one, so no repeat is lost.

Defined cases: a null or blank text has no words and keeps the empty text; a text shorter than one window loses nothing;
rows with the same id count as separate documents in order of their text; a null id comes after all others; ids may be of any type
that has an order; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almagest.llm.blocks import KEY, LAST, OWN, PACKED, Blocks, Deal, Sketch, WholeIds, answers_in_order, distinct, gathered, owned, pack_many, packed, placed, replies, slices_for, texts_of, unpack, unpack_many
from almagest.llm.hashing import Words, whole_windows, windows

RESULT = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])


def _starts_and_keys(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each window that stays inside a document starts, and its first fingerprint lane."""
    inside = np.flatnonzero(whole_windows(words.first, words.count, size, len(words.start)))
    return inside, windows(words.hashes(0), size, 0)[inside] if len(inside) else np.zeros(0, dtype=np.uint64)


def earlier_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Owner of one key slice: for each key of each block, does a block before it hold the key too?"""
    own = pdf[pdf["kind"] == OWN]
    out = list(zip(own["block"], own["slice"], own["kind"], own["data"], strict=True))
    if len(own) < len(pdf):
        rows, (hi, lo), block, cuts = gathered(pdf)
        order = np.lexsort((block, lo, hi))
        h, low, b = hi[order], lo[order], block[order]
        fresh = np.ones(len(h), dtype=bool)
        fresh[1:] = (h[1:] != h[:-1]) | (low[1:] != low[:-1])
        later = np.empty(len(h), dtype=bool)
        later[order] = b > b[fresh][np.cumsum(fresh) - 1]
        out += replies(rows, later, cuts)
    return packed(out)


def kept_words(words: Words, gone: np.ndarray) -> list[str]:
    """Each text's words that are not ``gone``, joined by one space."""
    stay = ~gone
    change = np.zeros(len(words.buf) + 2, dtype=np.int8)
    np.add.at(change, words.start[stay], 1)
    np.add.at(change, words.end[stay] + 1, -1)  # each word is followed by a separator byte, which becomes the space
    mask = np.cumsum(change[: len(words.buf)], dtype=np.int8) > 0
    buf = words.buf.copy()
    buf[words.end[stay]] = 32
    out, upto = buf[mask].tobytes(), np.concatenate(([0], np.cumsum(mask)))
    return [out[upto[a] : max(upto[a], upto[z + 1] - 1)].decode("utf-8", "replace") for a, z in zip(words.text_start, words.text_end, strict=True)]


def remove_repeated_windows(docs: DataFrame, size: int = 20, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 2 << 20) -> DataFrame:
    """One row per document: its id, n_words, n_removed and ``kept`` (the words left, joined by one space).

    A window is ``size`` consecutive words of one document.  Each word covered by a window whose word sequence also
    starts earlier (smaller id, or same document, earlier start) goes; windows are judged on the input.
    """
    ids = WholeIds(docs, id_col)
    blocks = Blocks(ids.docs, id_col, text_col, block_bytes)
    sketch = Sketch(max(1, blocks.bytes // 6), blocks.count)
    slices = slices_for(blocks.bytes // 6, blocks.count)

    def second(block: int, pdf: pd.DataFrame, got: dict) -> pd.DataFrame:
        words = Words(texts_of(pdf))
        starts, hi = _starts_and_keys(words, size)
        again = sketch.estimates(hi, got) >= 2
        starts, hi = starts[again], hi[again]
        lo = windows(words.hashes(1), size, 1)[starts] if len(starts) else hi
        first, _ = distinct(hi, lo)
        first = np.sort(first)
        repeated = np.ones(len(starts), dtype=bool)
        repeated[first] = False
        deal = Deal(slices, hi[first])
        state = pack_many(deal.places(starts[first]), np.diff(starts[repeated], prepend=0))
        return packed([*deal.rows(block, [hi[first], lo[first]], KEY), (block, block % slices.n, OWN, state)])

    def third(block: int, pdf: pd.DataFrame, got: dict) -> pd.DataFrame:
        words = Words(texts_of(pdf))
        (state,) = answers_in_order(got, OWN)
        firsts, repeated = unpack_many(state)
        later = [unpack(d).astype(bool) for d in answers_in_order(got, KEY)]
        gone = np.cumsum(repeated.astype(np.int64))
        if later:
            gone = np.concatenate((gone, placed(firsts, map(len, later), slices)[np.concatenate(later)]))
        cover = np.zeros(len(words.start) + 1, dtype=np.int64)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + size, -1)
        removed = np.cumsum(cover[:-1]) > 0
        sums = np.concatenate(([0], np.cumsum(removed)))
        return pd.DataFrame({"id": pdf["ord"], "n_words": words.count, "n_removed": sums[words.first + words.count] - sums[words.first], "kept": kept_words(words, removed)})

    answers = sketch.exchange(blocks, lambda pdf: _starts_and_keys(Words(texts_of(pdf)), size)[1])
    answers = owned(blocks.answered(answers, second, PACKED), earlier_block, slices)
    out = blocks.answered(answers, third, RESULT)
    out = out.select(F.when(F.col("id") != LAST, F.col("id")).cast(blocks.id_type).alias(id_col), "n_words", "n_removed", "kept")
    return ids.named(out, id_col)

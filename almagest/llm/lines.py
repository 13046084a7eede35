"""Line dedup: a line goes if an earlier line of the corpus is the same or nearly so: one word edit apart, if that is a fifth of the longer line or less.

Method: a deletion-neighbourhood join.  A line emits its own key and, within the edit bound, the key of each variant with one word
left out.  Lines that share a key meet, and the edit distance is verified from what each entry says about its line: a whole line that equals the variant of
a line one word longer is one deletion away; two variants are one substitution away if the same place is left out of equally long lines; other
meetings are farther apart (or meet again under another key) and do not count.  The earliest line stays.  Keys have 128 bits.

Before that, exact copies are settled by the whole line's key; a copy emits no variants, since its first copy does.  Of lines of ``HALVES_FROM`` words or
more only those emit whose first or last half (all words but one, halved) is also that of a different line: one edit leaves one of the halves
as it is, so no pair is lost.

A line is what ``\n`` separates; its words are ``[^\x20\x09-\x0D]+``; order is document id, then line number.  Blank lines stay (lines of fewer than
``exact_words`` = 1 words).  ``near_words`` = 5 is the fewest words of the longer of two lines that may be a word apart: similarity 0.8.  Lines are judged
on the input: a line also goes if the earlier line goes.

Defined cases: a null text stays null and has no lines; an empty text has one blank line; rows with the same id, copies of one row too, count as separate
documents in order of their text; null ids come last; ids may be of any type that has an order; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almagest.llm.blocks import KEY, LAST, OWN, PACKED, Blocks, Deal, WholeIds, answers_in_order, distinct, gathered, owned, pack_many, packed, replies, slices_for, texts_of, unpack, unpack_many
from almagest.llm.hashing import COEFFICIENTS, Words, mix

RESULT = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("text", T.StringType())])
WHOLE, VARIANT, HALF = 0, 1, 2
#: Lines with fewer words are no rarer for their halves, and emit their few variants at once.
HALVES_FROM = 8
_U = np.uint64


class Lines:
    """The lines of a block of texts; ``first``/``count`` are words of each line."""

    def __init__(self, texts: list[bytes]) -> None:
        self.words = Words(texts)
        self.breaks = np.flatnonzero(self.words.buf == 10)
        self.first = np.searchsorted(self.words.start, np.concatenate(([0], self.breaks[:-1] + 1)) if len(self.breaks) else self.breaks)
        self.count = np.diff(np.append(self.first, len(self.words.start)))
        self.text_first = np.searchsorted(self.breaks, self.words.text_start)
        self.text_count = np.searchsorted(self.breaks, self.words.text_end) - self.text_first + 1


class Keys:
    """Fingerprints of lines and of their parts, from prefix sums over the words' fingerprints."""

    def __init__(self, lines: Lines, lane: int) -> None:
        self.lines, self.lane = lines, lane
        value = lines.words.hashes(lane)
        ratio = int(COEFFICIENTS[lane, 4000]) | 3
        top = int(lines.count.max()) + 2 if len(lines.count) else 2
        scale, self.unscale = np.full(top, ratio, dtype=_U), np.full(top, pow(ratio, -1, 2**64), dtype=_U)
        scale[0] = self.unscale[0] = 1
        scale, self.unscale = np.cumprod(scale, dtype=_U), np.cumprod(self.unscale, dtype=_U)
        place = np.arange(len(value)) - np.repeat(lines.first, lines.count)
        self.sums = np.concatenate((np.zeros(1, dtype=_U), np.cumsum(value * scale[place], dtype=_U)))

    def _salt(self, n: np.ndarray, k: int) -> np.ndarray:
        return n.astype(_U) * COEFFICIENTS[self.lane, k]

    def whole(self, which: np.ndarray) -> np.ndarray:
        first, n = self.lines.first[which], self.lines.count[which]
        return mix(self.sums[first + n] - self.sums[first] + self._salt(n, 4001))

    def halves(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lines and keys of their first and last ``h`` words, for h as it is for lines of this length and of one word less."""
        first, n = self.lines.first[which], self.lines.count[which]
        line, key = [], []
        for h in ((n - 1) // 2, np.maximum(n - 2, 0) // 2):
            line += [which, which]
            key.append(mix(self.sums[first + h] - self.sums[first] + self._salt(h, 4004)))
            key.append(mix((self.sums[first + n] - self.sums[first + n - h]) * self.unscale[n - h] + self._salt(h, 4005)))
        return np.concatenate(line), np.concatenate(key)

    def variants(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Line, place of the word that is left out, and key of the rest, for every word."""
        n = self.lines.count[which]
        line = np.repeat(which, n)
        word = np.arange(len(line)) - np.repeat(np.cumsum(n) - n - self.lines.first[which], n)
        n, start = self.lines.count[line], self.lines.first[line]
        rest = mix((self.sums[word] - self.sums[start]) + (self.sums[start + n] - self.sums[word + 1]) * self.unscale[1] + self._salt(n - 1, 4001))
        return line, word - start, rest


def nearest_before(number: np.ndarray, tag: np.ndarray, place: np.ndarray, n: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of each entry: is there one before it (by ``order``) with its key whose line is verified to be one word edit away?

    ``number`` is the key; a whole line has ``n`` words, a variant is a line of ``n`` words without that at ``place``.
    """
    never = np.iinfo(np.int64).max
    least = np.full((2, int(number.max()) + 1 if len(number) else 0), never)
    longer = np.zeros(least.shape[1], dtype=np.int64)  # words of the lines whose variants have this key
    for t in (WHOLE, VARIANT):
        np.minimum.at(least[t], number[tag == t], order[tag == t])
    longer[number[tag == VARIANT]] = n[tag == VARIANT]
    whole = np.zeros_like(longer)
    whole[number[tag == WHOLE]] = n[tag == WHOLE]
    deletion = whole[number] + 1 == longer[number]
    out = deletion & (np.where(tag == WHOLE, least[VARIANT][number], least[WHOLE][number]) < order)
    v = np.flatnonzero(tag == VARIANT)
    first, alike = distinct(number[v].astype(_U), place[v].astype(_U) << _U(32) | n[v].astype(_U))
    earliest = np.full(len(first), never)
    np.minimum.at(earliest, alike, order[v])
    out[v] |= earliest[alike] < order[v]
    return out


def copies_and_halves(pdf: pd.DataFrame) -> pd.DataFrame:
    """Owner: has a line an exact copy in an earlier block (WHOLE); do different lines share a half (HALF)?"""
    own = pdf[pdf["kind"] == OWN]
    out = list(zip(own["block"], own["slice"], own["kind"], own["data"], strict=True))
    if len(own) < len(pdf):
        rows, (hi, lo, tag), block, cuts = gathered(pdf)
        answer = np.zeros(len(hi), dtype=bool)
        whole, half = np.flatnonzero(tag == WHOLE), np.flatnonzero(tag == HALF)
        first, number = distinct(hi[whole], lo[whole])
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, number, block[whole])
        answer[whole] = block[whole] > least[number]
        if len(half):
            order = half[np.argsort(hi[half])]
            head = np.flatnonzero(np.diff(hi[order], prepend=hi[order[:1]] + _U(1)))
            several = np.minimum.reduceat(lo[order], head) != np.maximum.reduceat(lo[order], head)
            answer[order] = np.repeat(several, np.diff(np.append(head, len(order))))
        out += replies(rows, answer, cuts)
    return packed(out)


def meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """Owner of one key slice: which entries have a line within the bound in an earlier block?"""
    own = pdf[pdf["kind"] == OWN]
    out = list(zip(own["block"], own["slice"], own["kind"], own["data"], strict=True))
    if len(own) < len(pdf):
        rows, (hi, lo, tag, place, n), block, cuts = gathered(pdf)
        goes = nearest_before(distinct(hi, lo)[1], tag, place, n, block)
        out += replies(rows, goes, cuts)
    return packed(out)


def remove_repeated_lines(docs: DataFrame, exact_words: int = 1, near_words: int = 5, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 2 << 20, carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: its id, n_lines, n_removed, ``kept_text`` (the lines that stay) and the columns to carry."""
    ids = WholeIds(docs, id_col)
    blocks = Blocks(ids.docs, id_col, text_col, block_bytes, carry=carry)
    halves_from = max(HALVES_FROM, near_words)
    result = T.StructType([*RESULT.fields, *[T.StructField(f"carry{i}", T.StringType()) for i in range(len(carry))]])
    slices = slices_for(blocks.bytes // 16, blocks.count)

    def first(block: int, pdf: pd.DataFrame) -> pd.DataFrame:
        lines = Lines(texts_of(pdf))
        lanes = [Keys(lines, lane) for lane in (0, 1)]
        counted = np.flatnonzero(lines.count >= exact_words)
        hi, lo = (k.whole(counted) for k in lanes)
        one, _ = distinct(hi, lo)
        one = np.sort(one)
        copy = np.ones(len(counted), dtype=bool)
        copy[one] = False
        which, hi, lo = counted[one], hi[one], lo[one]
        near = np.flatnonzero(lines.count[which] >= halves_from - 1)  # the shorter of two lines has one word less
        half_line, half = lanes[0].halves(which[near])
        hi, lo = np.concatenate((hi, half)), np.concatenate((lo, np.tile(hi[near], 4)))
        tag = np.repeat([WHOLE, HALF], [len(which), len(half)])
        line = np.concatenate((which, half_line))
        deal = Deal(slices, hi)
        state = pack_many(np.diff(counted[copy], prepend=0), line[deal.order], tag[deal.order])
        return packed([*deal.rows(block, [hi, lo, tag], KEY), (block, block % slices.n, OWN, state)])

    def answers_of(got: dict) -> tuple[np.ndarray, list[np.ndarray]]:
        (state,) = answers_in_order(got, OWN)
        answers = [unpack(d) for d in answers_in_order(got, KEY)]
        return np.concatenate(answers).astype(bool) if answers else np.zeros(0, dtype=bool), [a.astype(np.int64) for a in unpack_many(state)]

    def second(block: int, pdf: pd.DataFrame, got: dict) -> pd.DataFrame:
        yes, (copies, line, tag) = answers_of(got)
        gone = np.concatenate((np.cumsum(copies), line[yes & (tag == WHOLE)]))
        lines = Lines(texts_of(pdf))
        n = lines.count[line]
        emit = np.where(n < halves_from, (tag == WHOLE) & (n >= near_words - 1), (tag == HALF) & yes)
        which = np.setdiff1d(line[emit], gone)
        lanes = [Keys(lines, lane) for lane in (0, 1)]
        variants = [k.variants(which[lines.count[which] >= near_words]) for k in lanes]
        of, place, _ = variants[0]
        hi, lo = (np.concatenate((k.whole(which), v[2])) for k, v in zip(lanes, variants, strict=True))
        line, place = np.concatenate((which, of)), np.concatenate((np.zeros(len(which), dtype=np.int64), place))
        tag, n = np.repeat([WHOLE, VARIANT], [len(which), len(of)]), lines.count[line]

        number = distinct(hi, lo)[1]
        gone = np.unique(np.concatenate((gone, line[nearest_before(number, tag, place, n, line)])))

        # One entry for each key, tag and place asks for all lines that have it; a key tells the line's length.
        keep, entry = distinct((number * 2 + tag).astype(_U), place.astype(_U))
        extra = np.ones(len(line), dtype=bool)
        extra[keep] = False
        deal = Deal(slices, hi[keep])
        where = np.empty(len(keep), dtype=np.int64)
        where[deal.order] = np.arange(len(keep))
        state = pack_many(np.diff(gone, prepend=0), line[keep][deal.order], where[entry[extra]], line[extra])
        return packed([*deal.rows(block, [hi[keep], lo[keep], tag[keep], place[keep], n[keep]], KEY), (block, block % slices.n, OWN, state)])

    def third(block: int, pdf: pd.DataFrame, got: dict) -> pd.DataFrame:
        lines = Lines(texts_of(pdf))
        goes, (local, line, entry, extra) = answers_of(got)
        gone = np.zeros(len(lines.breaks), dtype=bool)
        gone[np.cumsum(local)] = True
        gone[line[goes]] = True
        gone[extra[goes[entry]]] = True
        buf = lines.words.buf
        stay = np.repeat(~gone, np.diff(lines.breaks, prepend=-1))
        left, upto = buf[stay].tobytes(), np.concatenate(([0], np.cumsum(stay)))
        text = [None if t is None else left[upto[a] : max(upto[a], upto[z + 1] - 1)].decode("utf-8", "replace") for t, a, z in zip(pdf["text"], lines.words.text_start, lines.words.text_end, strict=True)]
        sums = np.concatenate(([0], np.cumsum(gone)))
        real = pdf["text"].notna().to_numpy()
        return pd.DataFrame({"id": pdf["ord"], "n_lines": lines.text_count * real, "n_removed": (sums[lines.text_first + lines.text_count] - sums[lines.text_first]) * real, "text": text} | {c: pdf[c] for c in pdf.columns if c.startswith("carry")})

    answers = owned(blocks.each(first, PACKED), copies_and_halves, slices)
    answers = owned(blocks.answered(answers, second, PACKED), meet, slices)
    out = blocks.answered(answers, third, result)
    out = out.select(F.when(F.col("id") != LAST, F.col("id")).cast(blocks.id_type).alias(id_col), "n_lines", "n_removed", F.col("text").alias("kept_text"), *[F.col(f"carry{i}").cast(docs.schema[c].dataType).alias(c) for i, c in enumerate(carry)])
    return ids.named(out, id_col)

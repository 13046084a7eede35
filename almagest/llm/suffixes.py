"""Suffix-array dedup: bytes covered by a 400-byte string that starts anywhere else in the corpus are removed.

Method.  Text is cut into phrases at content-defined anchors: the anchor of a window start is the position with the least fingerprint among the
next ``SPREAD`` positions, so equal windows have their anchors at the same offset.  A phrase runs to the next anchor and as far beyond it as that
anchor depends on, so no phrase is the beginning of another and the order of phrases gives the order of texts.  Each block of documents
builds the suffix array of its phrases with the linear grouping construction (``suffix_array``): Lyndon-prefix groups are processed in
descending order through previous-smaller pointers, then each group's order is emitted, with no recursive renaming.

What repeats inside a block is read off neighbours in that array.  First, neighbouring suffixes with the same next ``length - SPREAD + 1``
bytes (the core, which every window of that anchor contains) form a class.  Then, for each distance of a window's start before its anchor, the
suffixes with the same bytes over that distance are taken in the array's order, and neighbours with a common prefix as long as the rest of the
window hold one window twice.  Between blocks, classes meet at the owner of their fingerprint, each once for each block: an owner only tells whether another
block holds the class too.  Cores that are alone in the corpus are dropped; where all suffixes of a core also have the same full context, all their windows
repeat; only the rest, at the ends of repeated passages, is settled window by window, with 128-bit fingerprints between blocks.

Defined cases: null and empty texts, and texts shorter than the length, lose nothing; matches never cross documents; rows with
the same id, copies of one row too, count as separate documents; a null id comes last; ids may be of any type that has an order; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almagest.llm.blocks import KEY, LAST, OWN, PACKED, Blocks, Deal, WholeIds, answers_in_order, gathered, owned, pack_many, packed, replies, slices_for, texts_of, unpack, unpack_many
from almagest.llm.hashing import RangeHash, joined, mix

SPREAD, GRAM = 128, 8
ALONE, SAME, MIXED = 0, 1, 2
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
RESULT = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", SPAN), T.StructField("kept", T.BinaryType())])


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Starts of all suffixes of ``symbols`` (whole numbers from 0 on) in order; a proper prefix sorts first.

    Every step is linear in the symbols and their greatest value: groups come from counting, members stay in the order of their places because
    previous-smaller pointers of one group never fall, and pointers are dealt to buckets by how often they were hit.  A group is named by
    the first place it takes in the final order, so comparing names compares groups.
    """
    ranks = np.append(np.asarray(symbols, dtype=np.int64) + 1, 0)  # a least symbol ends the text
    n = len(ranks)
    sizes = np.bincount(ranks)
    heads = np.cumsum(sizes) - sizes
    group: list[int] = heads[ranks].tolist()
    members: dict[int, list[int]] = {}
    for i, g in enumerate(group):
        members.setdefault(g, []).append(i)
    size = {g: len(m) for g, m in members.items()}
    ends_at = {g + s: g for g, s in size.items()}
    before = [-1] * n

    end = n
    while end:
        name = ends_at[end]
        hits: dict[int, int] = {}
        for i in members.pop(name):
            if group[i] != name:  # has moved on to a later group
                continue
            j = i - 1
            while j >= 0 and group[j] >= name:
                j = before[j]
            before[i] = j
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        if hits:
            buckets: list[dict[int, list[int]] | None] = [None] * (max(hits.values()) + 1)
            for j, times in hits.items():
                if buckets[times] is None:
                    buckets[times] = {}
                buckets[times].setdefault(group[j], []).append(j)
            for bucket in reversed(buckets):
                for old, moved in (bucket or {}).items():
                    rest = size[old] - len(moved)
                    if not rest:
                        continue
                    new = old + rest  # right behind what stays of the old group
                    ends_at[old + size[old]], ends_at[new] = new, old
                    size[old], size[new], members[new] = rest, len(moved), moved
                    for j in moved:
                        group[j] = new
        end = name

    order = [-1] * n
    order[0] = n - 1
    place = list(range(n))
    done = bytearray(n)
    done[n - 1] = 1
    for i in range(n):
        j = order[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            order[place[g]] = j
            place[g] += 1
            done[j] = 1
            j = before[j]
    return order[1:]


def least_positions(buf: np.ndarray, spread: int, gram: int, chunk: int = 1 << 17) -> np.ndarray:
    """For each i: the first position in i..i+spread-1 with the least fingerprint of its next ``gram`` bytes."""
    out = np.empty(max(0, len(buf) - spread + 1), dtype=np.int64)
    padded = np.concatenate((buf, np.zeros(gram, dtype=np.uint8)))
    for a in range(0, len(out), chunk):
        n = min(chunk, len(out) - a) + spread - 1
        value = np.zeros(n, dtype=np.uint64)
        for j in range(gram):
            value |= padded[a + j : a + j + n].astype(np.uint64) << np.uint64(8 * j)
        least = mix(value) & np.uint64(0xFFFFFFFF00000000) | np.arange(n, dtype=np.uint64)
        step = 1
        while step < spread:
            more = min(step, spread - step)
            least = np.minimum(least[:-more], least[more:])
            step += more
        out[a : a + len(least)] = (least & np.uint64(0xFFFFFFFF)).astype(np.int64) + a
    return out


class Anchors:
    """The anchors of a block: ``at``, ascending; windows ``low[k]..high[k]`` have the anchor ``at[k]`` (none where ``low > high``); ``phrase_end``."""

    def __init__(self, texts: list[bytes], length: int) -> None:
        self.buf, self.start, self.end = joined(texts)
        gram = min(GRAM, length)
        self.spread = min(SPREAD, length - gram + 1)
        look = self.spread - 1 + gram  # what decides which position is the anchor of a window start; never more than the length
        least = least_positions(self.buf, self.spread, gram)
        inside = np.zeros(len(least) + 1, dtype=np.int32)
        fits = self.end - self.start >= look
        np.add.at(inside, self.start[fits], 1)
        np.add.at(inside, self.end[fits] - look + 1, -1)
        begins = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        at = least[begins]
        head = np.flatnonzero(np.diff(at, prepend=-1))
        self.at, self.low = at[head], begins[head]
        last = begins[np.append(head[1:], len(begins))[: len(head)] - 1] if len(head) else head
        self.doc = np.searchsorted(self.start, self.at, side="right") - 1
        self.high = np.minimum(last, self.end[self.doc] - length)
        same = np.append(self.doc[1:] == self.doc[:-1], False)[: len(head)]
        self.phrase_end = np.where(same, np.minimum(np.append(self.at[1:], 0)[: len(head)] + look, self.end[self.doc]), self.end[self.doc])

    def in_order(self) -> np.ndarray:
        """The anchors that have windows, as the suffix array of the phrases orders them."""
        raw = self.buf.tobytes()
        phrases = [raw[a:z] for a, z in zip(self.at.tolist(), self.phrase_end.tolist(), strict=True)]
        number = {p: i + 1 for i, p in enumerate(sorted(set(phrases)))}
        if not number:
            return np.zeros(0, dtype=np.int64)
        symbols = np.zeros(len(phrases) + int(self.doc[-1]) + 1, dtype=np.int64)  # 0 ends a document
        place = np.arange(len(phrases)) + self.doc
        symbols[place] = [number[p] for p in phrases]
        back = np.full(len(symbols), -1)
        back[place] = np.arange(len(phrases))
        order = back[np.array(suffix_array(symbols), dtype=np.int64)]
        order = order[order >= 0]
        return order[self.low[order] <= self.high[order]]


def fresh(*columns: np.ndarray) -> np.ndarray:
    """Where an element differs from its neighbour before in any column."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def reduced(fn: np.ufunc, values: np.ndarray, head: np.ndarray) -> np.ndarray:
    return fn.reduceat(values, head) if len(head) else values


def held_by(number: np.ndarray, block: np.ndarray, many: np.ndarray, n: int) -> np.ndarray:
    """Of each class: how many blocks hold it, one more if a block says that it holds it more than once. A block counts once, whatever it lists."""
    order = np.lexsort((block, number))
    new = fresh(number[order], block[order])
    return np.bincount(number[order][new], minlength=n) + (np.bincount(number, weights=many, minlength=n) > 0)


def core_owner(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of each core: is it alone, always in the same context, or in several?"""
    own = pdf[pdf["kind"] == OWN]
    out = list(zip(own["block"], own["slice"], own["kind"], own["data"], strict=True))
    if len(own) < len(pdf):
        rows, (core, context, flags), block, cuts = gathered(pdf)
        order = np.argsort(core)
        new = fresh(core[order])
        head = np.flatnonzero(new)
        number = np.empty(len(core), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        count = held_by(number, block, flags & 1, len(head))
        around = context[order]
        mixed = (np.maximum.reduceat(flags[order], head) >= 2) | (np.minimum.reduceat(around, head) != np.maximum.reduceat(around, head))
        answer = np.where(count < 2, ALONE, np.where(mixed, MIXED, SAME))[number].astype(np.uint8)
        out += replies(rows, answer, cuts)
    return packed(out)


def window_owner(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of each window fingerprint: does it occur at two places or more?"""
    own = pdf[pdf["kind"] == OWN]
    out = list(zip(own["block"], own["slice"], own["kind"], own["data"], strict=True))
    if len(own) < len(pdf):
        rows, (hi, lo, many), block, cuts = gathered(pdf)
        order = np.lexsort((lo, hi))
        new = fresh(hi[order], lo[order])
        number = np.empty(len(hi), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        again = (held_by(number, block, many, int(new.sum())) >= 2)[number]
        out += replies(rows, again, cuts)
    return packed(out)


def remove_repeated_bytes(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 2 << 20) -> DataFrame:
    """One row per document: its id, n_bytes, n_removed, ``spans`` (maximal removed byte runs, end exclusive) and ``kept``.

    A byte goes if a ``length``-byte string that covers it also starts anywhere else, in the same document or another; strings
    are judged on the input.  ``kept`` is binary, since a cut may fall inside a character.
    """
    ids = WholeIds(docs, id_col)
    blocks = Blocks(ids.docs, id_col, text_col, block_bytes)
    slices = slices_for(blocks.bytes // 16, blocks.count)

    def first(block: int, pdf: pd.DataFrame) -> pd.DataFrame:
        x = Anchors(texts_of(pdf), length)
        order = x.in_order()
        at, low, high = x.at[order], x.low[order], x.high[order]
        hashes = RangeHash(x.buf, 0)
        core = hashes.of(at, at + length - x.spread + 1)
        around = mix(hashes.of(low, high + length) + (at - low).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        head = np.flatnonzero(fresh(core))
        size = np.diff(np.append(head, len(core)))
        least, most = (reduced(f, around, head) for f in (np.minimum, np.maximum))
        flags = (size > 1) + 2 * (least != most)
        deal = Deal(slices, core[head])
        dealt = np.empty(len(head), dtype=np.int64)
        dealt[deal.order] = np.arange(len(head))
        # In the order of the text: where windows begin, how many, how far on the anchor is, its class, and its place in the array.
        by_place = np.argsort(low)
        state = pack_many(np.diff(low[by_place], prepend=0), (high - low)[by_place], (at - low)[by_place], np.repeat(dealt, size)[by_place], by_place)
        return packed([*deal.rows(block, [core[head], least, flags], KEY), (block, block % slices.n, OWN, state)])

    def answered(got: dict) -> tuple[np.ndarray, list[np.ndarray]]:
        (state,) = answers_in_order(got, OWN)
        answers = [unpack(d) for d in answers_in_order(got, KEY)]
        return np.concatenate(answers) if answers else np.zeros(0, dtype=np.uint8), [a.astype(np.int64) for a in unpack_many(state)]

    def second(block: int, pdf: pd.DataFrame, got: dict) -> pd.DataFrame:
        code, (low, width, ahead, number, rank) = answered(got)
        low = np.cumsum(low)
        of = code[number]
        mixed = np.flatnonzero(of == MIXED)
        mixed = mixed[np.argsort(rank[mixed])]
        at, nearest, farthest = low[mixed] + ahead[mixed], ahead[mixed] - width[mixed], ahead[mixed]
        hi, lo, many, starts, classes = [], [], [], [], []
        n = 0
        if len(mixed):
            buf, _, _ = joined(texts_of(pdf))
            lanes = [RangeHash(buf, lane) for lane in (0, 1)]
            for back in range(int(nearest.min()), int(farthest.max()) + 1):
                some = at[(nearest <= back) & (back <= farthest)]
                if not len(some):
                    continue
                left = lanes[0].of(some - back, some)
                order = np.argsort(left, kind="stable")  # the array's order among equal bytes before the anchor
                some, left = some[order], left[order]
                new = fresh(left, lanes[0].of(some, some + length - back))  # no common prefix of that length with the neighbour
                head = np.flatnonzero(new)
                hi.append(lanes[0].of(some[head] - back, some[head] - back + length))
                lo.append(lanes[1].of(some[head] - back, some[head] - back + length))
                many.append(np.diff(np.append(head, len(some))) > 1)
                starts.append((some - back).astype(np.uint32))
                classes.append((np.cumsum(new) - 1 + n).astype(np.uint32))
                n += len(head)
        hi, lo, many, starts, classes = (np.concatenate(c) if c else np.zeros(0, dtype=k) for c, k in ((hi, np.uint64), (lo, np.uint64), (many, bool), (starts, np.uint32), (classes, np.uint32)))
        deal = Deal(slices, hi)
        dealt = np.empty(n, dtype=np.uint32)
        dealt[deal.order] = np.arange(n, dtype=np.uint32)
        order = np.argsort(starts)
        starts, classes = starts[order], dealt[classes[order]]
        state = pack_many(np.diff(low[of == SAME], prepend=0), width[of == SAME], np.diff(starts, prepend=starts[:1] * 0), classes)
        return packed([*deal.rows(block, [hi, lo, many], KEY), (block, block % slices.n, OWN, state)])

    def third(block: int, pdf: pd.DataFrame, got: dict) -> pd.DataFrame:
        again, (low, width, mixed, number) = answered(got)
        low, mixed = np.cumsum(low), np.cumsum(mixed)
        mixed = mixed[again[number] > 0] if len(mixed) else mixed
        buf, start, end = joined(texts_of(pdf))
        cover = np.zeros(len(buf) + 2, dtype=np.int32)
        for begin, stop in ((low, low + width + length), (mixed, mixed + length)):
            np.add.at(cover, begin, 1)
            np.add.at(cover, stop, -1)
        gone = np.cumsum(cover[:-1]) > 0
        edge = np.flatnonzero(np.diff(gone, prepend=False))
        run_start, run_end = edge[0::2], edge[1::2]
        stay = ~gone[: len(buf)]
        upto = np.concatenate(([0], np.cumsum(stay)))
        left = buf[stay].tobytes()
        a, z = np.searchsorted(run_start, start), np.searchsorted(run_start, end)
        spans = [[{"start": s - o, "end": e - o} for s, e in zip(run_start[i:j].tolist(), run_end[i:j].tolist(), strict=True)] for i, j, o in zip(a, z, start.tolist(), strict=True)]
        return pd.DataFrame({"id": pdf["ord"], "n_bytes": end - start, "n_removed": (end - start) - (upto[end] - upto[start]), "spans": spans, "kept": [left[i:j] for i, j in zip(upto[start], upto[end], strict=True)]})

    answers = owned(blocks.each(first, PACKED), core_owner, slices)
    answers = owned(blocks.answered(answers, second, PACKED), window_owner, slices)
    out = blocks.answered(answers, third, RESULT)
    out = out.select(F.when(F.col("id") != LAST, F.col("id")).cast(blocks.id_type).alias(id_col), "n_bytes", "n_removed", "spans", "kept")
    return ids.named(out, id_col)

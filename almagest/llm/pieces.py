"""SentencePiece encoding and decoding by a streaming Viterbi search.

The best segmentation of a text maximises the sum of its pieces' scores.  The search goes through the text once and keeps a window of the next
positions, as many as the longest piece has characters: of each its best score and the boundaries of its path.  Where the paths of all positions in the window
have a boundary in common, the ids up to the last such boundary are committed and forgotten.

No piece of most vocabularies reaches over the start of a word (a mark for a space begins one), so all paths meet there, and the search goes on from a
word's start as from a text's.  So it is run for many words at once, a character of each per step (``search``), and the ids of words met before are
looked up in a bounded memory of what it committed; words over ``LANE`` characters, and texts of vocabularies whose pieces reach over
marks, are streamed one at a time (``stream``).  Both give the same ids.

Spaces become U+2581 and one is put in front; a character without a piece, and U+2581 itself, is encoded as the byte pieces of its UTF-8, each scored below
every other piece.  Of segmentations with equal scores the one whose last piece is longest wins, recursively.  Decoding concatenates the pieces
and takes the first space off; it gives every text back exactly.

Defined cases: a null text has null ids and a null round trip, null ids a null text; an empty text has no ids; an empty table gives an empty result; other columns
are kept whatever their types, but a column of the input with the name of a result column gives way to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
#: Stands for a text's own U+2581 while spaces are U+2581; no text of a table holds a lone surrogate.
OWN_MARK = "\ud800"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: A run of marks and the characters up to the next mark: no piece that has marks only in front reaches over its end.
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: The boundaries of a word of so many characters fit into 64 bits.
LANE = 62


def _utf8(char: str) -> bytes:
    return (SPACE if char == OWN_MARK else char).encode("utf-8", "surrogatepass")


class Trie:
    """The pieces' characters as a table from (node, character) to node, looked up for many at once."""

    def __init__(self, pieces: dict[str, tuple[int, float]]) -> None:
        node: dict[str, int] = {"": 0}
        for p in pieces:
            for k in range(1, len(p) + 1):
                node.setdefault(p[:k], len(node))
        self.piece = np.full(len(node), -1, dtype=np.int32)
        self.score = np.full(len(node), -np.inf)
        for p, (i, s) in pieces.items():
            self.piece[node[p]], self.score[node[p]] = i, s
        self.bits = max(4, (8 * len(node)).bit_length())
        self.keys = np.full((1 << self.bits) + len(node), -1, dtype=np.int64)
        self.nodes = np.full(len(self.keys), -1, dtype=np.int32)
        for p, n in node.items():
            if p:
                key = node[p[:-1]] << 21 | ord(p[-1])
                slot = int(self._slots(np.array([key]))[0])
                while self.keys[slot] >= 0:
                    slot += 1
                self.keys[slot], self.nodes[slot] = key, n

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def next(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The node behind ``code``, -1 where no piece goes on like this."""
        keys = node.astype(np.int64) << 21 | code
        slot = self._slots(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.nodes[slot], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slot[open_] += 1
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.nodes[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class Pieces:
    """A vocabulary: text pieces with scores, byte pieces, and the search."""

    def __init__(self, pieces: list[str], scores: list[float], special: Iterable[int] = (0, 1, 2), remember: int = 150_000) -> None:
        special = set(special)
        self.of_byte = {int(m[1], 16): i for i, p in enumerate(pieces) if i not in special and (m := _BYTE.fullmatch(p))}
        bytes_ = set(self.of_byte.values())
        self.ids = {p: (i, s) for i, (p, s) in enumerate(zip(pieces, scores, strict=True)) if i not in special and i not in bytes_ and p}
        self.longest = max(map(len, self.ids), default=1)
        self.starts = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        self.fallback = min((s for _, s in self.ids.values()), default=0.0) - 10.0
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.raw = [b"" if i in special else bytes([int(_BYTE.fullmatch(p)[1], 16)]) if i in bytes_ else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.trie = Trie(self.ids)
        self.remember = remember
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _ids_of(self, part: str) -> list[int]:
        found = self.ids.get(part)
        return [found[0]] if found else [self.of_byte[b] for b in _utf8(part)]

    def stream(self, text: str) -> Iterator[int]:
        """Ids of the best segmentation of one text, committed as soon as they are certain."""
        base, score, path = 0, [0.0], [0]  # of the positions from base on: best score, and the boundaries of its path as bits
        for i in range(len(text)):
            at = i - base
            more = min(i + self.longest, len(text)) - base + 1 - len(score)
            score += [-np.inf] * more
            path += [0] * more
            here, mine = score[at], path[at]
            for n in range(1, min(self.longest, len(text) - i) + 1):
                part = text[i : i + n]
                if part not in self.starts:
                    break
                found = self.ids.get(part)
                if found is not None and here + found[1] > score[at + n]:
                    score[at + n], path[at + n] = here + found[1], mine | 1 << (at + n)
            if text[i] not in self.ids:
                total = here + self.fallback * len(_utf8(text[i]))
                if total > score[at + 1]:
                    score[at + 1], path[at + 1] = total, mine | 1 << (at + 1)
            common = -1
            for k in range(at + 1, len(score)):
                if path[k]:
                    common &= path[k]
            if common:
                done = common.bit_length() - 1
                first = 0
                for k in range(1, done + 1):
                    if common >> k & 1:
                        yield from self._ids_of(text[base + first : base + k])
                        first = k
                base += done
                score, path = score[done:], [p >> done & ~1 for p in path[done:]]

    def search(self, words: list[str]) -> list[bytes]:
        """The same for many words of at most ``LANE`` characters, a character of each per step; ids as 4 little-endian bytes each."""
        if not words:
            return []
        order = sorted(range(len(words)), key=lambda w: -len(words[w]))
        size = np.array([len(words[w]) for w in order])
        width, ring = int(size[0]), self.longest + 1
        codes = np.zeros((len(words), width + 1), dtype=np.int64)
        codes[np.repeat(np.arange(len(words)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.frombuffer("".join(words[w] for w in order).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        score, path = np.full((len(words), ring), -np.inf), np.zeros((len(words), ring), dtype=np.uint64)
        score[:, 0] = 0.0
        best = np.zeros(len(words), dtype=np.uint64)
        for i in range(width):
            lanes = np.arange(np.searchsorted(-size, -i, side="left"))  # words of more than i characters
            at, here, mine = i % ring, score[lanes, i % ring], path[lanes, i % ring]
            code = codes[lanes, i]
            node = self.trie.next(np.zeros(len(lanes), dtype=np.int64), code)
            bare = np.flatnonzero((node < 0) | (self.trie.piece[np.maximum(node, 0)] < 0))
            if len(bare):
                char = code[bare]
                nbytes = 1 + (char >= 0x80).astype(np.int64) + (char >= 0x800) + (char >= 0x10000)
                self._better(score, path, lanes[bare], (i + 1) % ring, here[bare] + self.fallback * nbytes, mine[bare] | np.uint64(1 << (i + 1)))
            for n in range(1, self.longest + 1):
                go = np.flatnonzero(node >= 0)
                lanes, here, mine, node = lanes[go], here[go], mine[go], node[go]
                if not len(lanes):
                    break
                whole = np.flatnonzero(self.trie.piece[node] >= 0)
                self._better(score, path, lanes[whole], (i + n) % ring, here[whole] + self.trie.score[node[whole]], mine[whole] | np.uint64(1 << (i + n)))
                if n < self.longest:
                    on = np.flatnonzero(size[lanes] > i + n)
                    lanes, here, mine, node = lanes[on], here[on], mine[on], node[on]
                    node = self.trie.next(node, codes[lanes, i + n])
            a, z = np.searchsorted(-size, -(i + 1), side="left"), np.searchsorted(-size, -(i + 1), side="right")
            best[a:z] = path[a:z, (i + 1) % ring]
            score[:, at] = -np.inf
        return self._read_off(order, size, codes, best)

    @staticmethod
    def _better(score: np.ndarray, path: np.ndarray, lanes: np.ndarray, at: int, total: np.ndarray, boundaries: np.ndarray) -> None:
        up = total > score[lanes, at]
        score[lanes[up], at], path[lanes[up], at] = total[up], boundaries[up]

    def _read_off(self, order: list[int], size: np.ndarray, codes: np.ndarray, best: np.ndarray) -> list[bytes]:
        """The ids between the boundaries of each word."""
        found_lane, found_at, found_id = [], [], []
        node, begun = np.zeros(len(order), dtype=np.int64), np.zeros(len(order), dtype=np.int64)
        for i in range(int(size[0])):
            m = int(np.searchsorted(-size, -i, side="left"))
            node[:m] = np.where(node[:m] >= 0, self.trie.next(np.maximum(node[:m], 0), codes[:m, i]), -1)
            ends = np.flatnonzero(best[:m] >> np.uint64(i + 1) & np.uint64(1))
            piece = np.where(node[ends] >= 0, self.trie.piece[np.maximum(node[ends], 0)], -1)
            found_lane.append(ends)
            found_at.append(begun[ends])
            found_id.append(np.where(piece >= 0, piece, -1 - codes[ends, i]))  # below 0: a character without a piece
            node[ends], begun[ends] = 0, i + 1
        lane, at, ids = (np.concatenate(x) for x in (found_lane, found_at, found_id))
        by = np.lexsort((at, lane))
        lane, ids = lane[by], ids[by].astype("<i4")
        cuts = (4 * np.searchsorted(lane, np.arange(len(order) + 1))).tolist()
        raw = ids.tobytes()
        out = [b""] * len(order)
        for w, a, z in zip(order, cuts[:-1], cuts[1:], strict=True):
            out[w] = raw[a:z]
        for k in np.unique(lane[ids < 0]).tolist():
            part = ids[cuts[k] // 4 : cuts[k + 1] // 4].tolist()
            out[order[k]] = np.array([y for x in part for y in ([x] if x >= 0 else [self.of_byte[b] for b in _utf8(chr(-1 - x))])], dtype="<i4").tobytes()
        return out

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        marked = [SPACE + t.replace(SPACE, OWN_MARK).replace(" ", SPACE) if t else "" for t in texts]
        if not self.by_word:
            return [np.fromiter(self.stream(t), dtype=np.int32) for t in marked]
        split = [_WORDS.findall(t) for t in marked]
        new: dict[str, bytes] = {}
        for words in split:
            for w in words:
                if w not in self._known and w not in new:
                    new[w] = self._older.get(w, b"")
        self._learn(new)
        known = self._known
        known.update(new)
        out = [np.frombuffer(b"".join(map(known.__getitem__, words)), dtype="<i4") for words in split]
        if len(known) > self.remember:  # the older half goes
            self._older, self._known = known, {}
        return out

    def _learn(self, new: dict[str, bytes]) -> None:
        unknown = [w for w, got in new.items() if not got]
        short = [w for w in unknown if len(w) <= LANE]
        for a in range(0, len(short), 50_000):
            part = short[a : a + 50_000]
            new.update(zip(part, self.search(part), strict=True))
        for w in unknown:
            if len(w) > LANE:
                new[w] = np.fromiter(self.stream(w), dtype="<i4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def load_pieces(path: str) -> tuple[list[str], list[float]]:
    """Pieces and scores of a model file, read on the driver; they are sent along with the tasks (their number is the vocabulary's)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    return [model.id_to_piece(i) for i in range(n)], [model.get_score(i) for i in range(n)]


_WORKER: dict[str, Pieces] = {}
AT_ONCE = 500


def _mapped(docs: DataFrame, path: str, column: str, new: list[T.StructField], fn) -> DataFrame:
    """``docs`` without the columns that ``new`` replaces, and the new ones: ``fn(model, values of the column)`` gives them as Arrow arrays."""
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(path))
    names = {f.name for f in new}
    kept = [f for f in docs.schema.fields if f.name not in names]
    place = {f.name: i for i, f in enumerate(kept)}
    # Kept columns go through under numbers, so that no name can clash.
    rows = docs.select(F.col(f"`{column}`").alias("given"), *[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)])
    schema = T.StructType([*[T.StructField(f"c{place[f.name]}", f.dataType, f.nullable) for f in kept], *[T.StructField(f"n{i}", f.dataType) for i, f in enumerate(new)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _WORKER:
            _WORKER[path] = Pieces(*shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(a, AT_ONCE)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *fn(_WORKER[path], part.column(0).to_pylist())], schema.names)

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(kept)], *[F.col(f"n{i}").alias(f.name) for i, f in enumerate(new)])


def encoded(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", round_trip_col: str = "round_trip") -> DataFrame:
    """``docs`` with the ids of each text, and whether decoding them gives the text again."""

    def run(model: Pieces, texts: list[str | None]) -> list[pa.Array]:
        real = [t for t in texts if t is not None]
        ids = model.encode_all(real)
        same = iter([model.decode(x.tolist()) == t for x, t in zip(ids, real, strict=True)])
        sizes = iter(map(len, ids))
        ends = np.cumsum([0, *(0 if t is None else next(sizes) for t in texts)])
        offsets = pa.array([None if k < len(texts) and texts[k] is None else int(e) for k, e in enumerate(ends)], pa.int32())
        values = pa.array(np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32), pa.int32())
        return [pa.ListArray.from_arrays(offsets, values), pa.array([None if t is None else next(same) for t in texts], pa.bool_())]

    return _mapped(docs, path, text_col, [T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(round_trip_col, T.BooleanType())], run)


def decoded(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``rows`` with the text of each row's ids; ids that the vocabulary lacks raise an error."""
    return _mapped(rows, path, ids_col, [T.StructField(text_col, T.StringType())], lambda model, ids: [pa.array([None if x is None else model.decode(x) for x in ids], pa.string())])

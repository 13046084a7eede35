import random

import pandas as pd
import pytest

from hypothesis import given, settings
from hypothesis import strategies as st

from almagest.llm import suffixes
from almagest.llm.suffixes import Anchors, remove_repeated_bytes, suffix_array


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array_is_the_sorted_order(s):
    assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute(docs, length):
    texts = {k: (t or "").encode() for k, t in docs}
    seen = {}
    for k, t in texts.items():
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], []).append((k, i))
    out = {}
    for k, t in texts.items():
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if len(seen[t[i : i + length]]) > 1:
                gone[i : i + length] = [True] * length
        spans, i = [], 0
        while i < len(t):
            if gone[i]:
                j = i
                while j < len(t) and gone[j]:
                    j += 1
                spans.append((i, j))
                i = j
            else:
                i += 1
        out[k] = (len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g))
    return out


def corpus(seed, length, n=40):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdé ", k=rnd.randint(1, 9)))
    passages = ["".join(word() for _ in range(rnd.randint(10, 80))) for _ in range(5)]
    docs = []
    for k in range(n):
        parts = []
        for _ in range(rnd.randint(0, 5)):
            p = rnd.choice(passages)
            a = rnd.randint(0, len(p) // 2)
            parts.append(p[a : a + rnd.randint(20, 400)] if rnd.random() < 0.6 else "".join(word() for _ in range(rnd.randint(0, 60))))
        docs.append((k, "".join(parts)))
    return [*docs, (100, None), (101, ""), (102, "a" * (length * 3)), (103, docs[0][1]), (104, "ab" * length), (105, "x" * (length - 1)), (106, "x" * (length - 1))]


def check(spark, length, seed, **kw):
    docs = corpus(seed, length)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in remove_repeated_bytes(df, length, **kw).collect()}
    assert got == brute(docs, length)


def test_against_brute_force(spark):
    check(spark, 150, 1, block_bytes=2000)


def test_short_length_than_spread(spark):
    check(spark, 30, 2, block_bytes=3000)


def test_empty_table(spark):
    assert remove_repeated_bytes(spark.createDataFrame([], "doc_id long, text string, slice string")).collect() == []


def test_production_length_repeated_rows_and_text_ids(spark):
    """400 bytes; rows that repeat an id, null ids, ids that are text."""
    docs = corpus(3, 400, 25)
    rows = [*docs, (3, docs[3][1]), (None, docs[5][1] + "z"), (None, docs[5][1] + "z")]
    numbered = [(k, t) for k, (_, t) in enumerate(rows)]
    want = sorted((str(rows[k][0]), *v) for k, v in brute(numbered, 400).items())
    for kind in ("long", "string"):
        df = spark.createDataFrame([(None if k is None else k if kind == "long" else f"{k}", t, 1) for k, t in rows], f"doc_id {kind}, text string, block int")
        got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in remove_repeated_bytes(df, block_bytes=4000).collect())
        assert got == want


def test_anchors_in_the_order_of_their_texts():
    docs = [t.encode() for _, t in corpus(4, 150) if t]
    x = Anchors(docs, 150)
    raw = bytes(x.buf)
    texts = [raw[x.at[k] : x.end[x.doc[k]]] for k in x.in_order()]
    assert len(texts) > 100 and texts == sorted(texts)


def test_the_result_rests_on_the_array(monkeypatch):
    """With any other order of the suffixes, repeats inside a block are missed."""
    passage = bytes(random.Random(5).choices(range(97, 123), k=900))
    texts = [b"one " + passage[:700] + b" x", b"two " + passage[100:] + b" y", passage]
    spans = lambda: in_one_block(texts, 150)
    want = [sum(e - s for s, e in v[2]) for v in brute([(k, t.decode()) for k, t in enumerate(texts)], 150).values()]
    assert spans() == want
    monkeypatch.setattr(suffixes, "suffix_array", lambda s: random.Random(1).sample(range(len(s)), len(s)))
    assert spans() != want


def in_one_block(texts, length):
    """Bytes removed from each text, all texts in one block: the operator's three passes without a cluster."""

    class Local:
        def __init__(self, rows):
            self.rows = rows

        def groupBy(self, *_):
            return self

        def applyInPandas(self, fn, _):
            return Local(pd.concat([fn(g) for _, g in self.rows.groupby("slice")]))

        def select(self, *_):
            return self

    pdf = pd.DataFrame({"ord": range(len(texts)), "text": pd.Series(texts, dtype=object)})

    class OneBlock:
        bytes, count, id_type = sum(map(len, texts)), 1, "long"

        def __init__(self, *_):
            pass

        def each(self, fn, _):
            return Local(fn(0, pdf))

        def answered(self, answers, fn, _):
            return Local(fn(0, pdf, {(k, s): d for k, s, d in zip(answers.rows["kind"], answers.rows["slice"], answers.rows["data"])}))

    class Ids:
        docs = None

        def __init__(self, *_):
            pass

        def named(self, out, *_):
            return out

    class Sql:
        def __getattr__(self, _):
            return lambda *a, **k: Sql()

        def __ne__(self, _):
            return True

    with pytest.MonkeyPatch.context() as m:
        m.setattr(suffixes, "Blocks", OneBlock)
        m.setattr(suffixes, "WholeIds", Ids)
        m.setattr(suffixes, "F", Sql())
        return remove_repeated_bytes(None, length).rows["n_removed"].tolist()

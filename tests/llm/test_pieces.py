import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql.functions import array, lit

from almagest.llm.pieces import LANE, SPACE, Pieces, decoded, encoded, load_pieces
from almagest.llm.queries import op9_sentencepiece

MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
BYTES = [f"<0x{b:02X}>" for b in range(256)]
TEXT = ["a", "b", "ab", "ba", "aab", "abab", SPACE, SPACE + "a", SPACE + "ab", SPACE + SPACE, "c", "abc", "bca"]
VOCABULARY = ["<unk>", "<s>", "</s>", *BYTES, *TEXT]
SCORES = [0.0] * 3 + [-100.0] * 256 + [-3.0, -3.5, -4.0, -4.2, -5.0, -7.0, -2.0, -4.5, -5.5, -3.0, -6.0, -9.5, -7.7]


def best(model, text):
    """Plain dynamic programming over the whole text."""
    score = [0.0] + [float("-inf")] * len(text)
    for k in range(1, len(text) + 1):
        for i in range(k):
            part = text[i:k]
            if part in model.ids:
                score[k] = max(score[k], score[i] + model.ids[part][1])
            elif k - i == 1:
                score[k] = max(score[k], score[i] + model.fallback * len(part.encode()))
    return score[-1]


def total(model, ids):
    of = {i: s for i, s in model.ids.values()}
    return sum(of.get(i, model.fallback) for i in ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc  é\n\x00€▁", max_size=200))
def test_best_score_and_exact_round_trip(text):
    model = Pieces(VOCABULARY, SCORES)
    ids = model.encode(text).tolist()
    assert model.decode(ids) == text
    if text and SPACE not in text:
        marked = SPACE + text.replace(" ", SPACE)
        assert total(model, ids) == pytest.approx(best(model, marked))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abcé€", min_size=1, max_size=LANE), min_size=1, max_size=20))
def test_many_words_at_once_and_one_at_a_time_give_the_same_ids(words):
    model = Pieces(VOCABULARY, SCORES)
    assert [list(np.frombuffer(x, dtype="<i4")) for x in model.search(words)] == [list(model.stream(w)) for w in words]
    for w in words:
        assert total(model, list(model.stream(w))) == pytest.approx(best(model, w))


def test_pieces_that_reach_over_marks():
    model = Pieces([*VOCABULARY, "a" + SPACE + "b"], [*SCORES, -1.0])
    for text in ("ca b", "a b a b", "é a bb", "x" * 100):
        ids = model.encode(text).tolist()
        assert model.decode(ids) == text and total(model, ids) == pytest.approx(best(model, SPACE + text.replace(" ", SPACE)))


def test_commits_before_the_end():
    """The window holds what the longest piece needs; whatever all paths agree on is gone from it."""
    model = Pieces(VOCABULARY, SCORES)
    ids = model.stream("c" * 1000)
    assert next(ids) == VOCABULARY.index("c")
    assert len(ids.gi_frame.f_locals["score"]) <= model.longest + 2
    assert len(list(ids)) == 999


def test_the_memory_of_words_changes_nothing():
    small, large = Pieces(VOCABULARY, SCORES, remember=3), Pieces(VOCABULARY, SCORES)
    texts = ["ab ba aab abab bca", "abc é ab", "c" * 200 + " ab ba", "", "ab ba aab abab bca abc"] * 3
    assert [x.tolist() for t in texts for x in small.encode_all([t])] == [x.tolist() for x in large.encode_all(texts)]


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary file here")
def test_table(spark, tmp_path):
    rows = [(1, "Hello  world\n é \U0001f600"), (2, ""), (3, None), (4, " x" * 2000), (5, "x" * 5000), (None, "a ▁b"), (1, "Hello  world\n é \U0001f600")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", lit("x")).withColumn("given", array(lit(1))).withColumn("c0", lit(b"y"))
    got = encoded(df, MODEL)
    assert got.columns == ["doc_id", "text", "given", "c0", "ids", "round_trip"]
    seen = sorted(got.collect(), key=lambda r: str(r.text))
    assert all((r.ids is None and r.round_trip is None) if r.text is None else r.round_trip for r in seen) and [len(r.ids) for r in seen if r.text == ""] == [0]
    assert sorted(str(r.text) for r in decoded(got.drop("text"), MODEL).collect()) == sorted(str(t) for _, t in rows)
    assert encoded(spark.createDataFrame([], "doc_id long, text string"), MODEL).collect() == []

    model = Pieces(*load_pieces(MODEL))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for r in op9_sentencepiece(spark, str(tmp_path)).collect():  # the query, against plain dynamic programming
        text = dict(rows)[r.doc_id]
        if r.doc_id in (1, 2):
            assert r.n_ids == len(r.ids) and total(model, r.ids) == pytest.approx(best(model, SPACE + text.replace(" ", SPACE)) if text else 0.0)

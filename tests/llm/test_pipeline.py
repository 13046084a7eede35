import os
import random
import re

import numpy as np
import pytest
from test_jaccard import brute as brute_classes
from test_language import plain_vector
from test_lines import brute as brute_lines

import corpus_pipeline
from almagest.llm import decontamination, language
from almagest.llm.queries import PIECE_MODEL


def words(n, seed):
    import random

    rnd = random.Random(seed)
    return " ".join("".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 8))) for _ in range(n))


@pytest.mark.skipif(not os.path.exists(PIECE_MODEL), reason="no vocabulary file here")
def test_stages_take_effect(spark, tmp_path):
    item = "This question asks how many apples are left over when all of the boys have taken their share"
    clean = [(k, words(40, k) + "\n" + words(40, 100 + k), "en", f"s{k}", 0) for k in range(6)]
    near = clean[1][1].split()
    near[5] = "changed"
    docs = [
        *clean,
        (10, clean[0][1], "en", "s", 0),  # an exact copy: all its lines go
        (11, " ".join(near), "en", None, 0),  # a near copy of 1 in one line
        (12, words(20, 50) + "\n" + item.replace("apples", "pears") + "\n" + item, "en", "s", 0),
        (13, "123 !!", "en", "s", 0),
        (14, None, None, "s", None),
        (15, clean[2][1].split("\n")[0] + "\n" + words(30, 77), None, "s", 0),  # loses its first line
    ]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5, 15}
    assert got[15].text == words(30, 77) and got[15].n_chars == len(got[15].text) and got[15].lang is None
    assert all(r.round_trip for r in got.values()) and got[0].text == clean[0][1] and got[3].source == "s3"


def language_by_hand(docs):
    """ids of the documents that the language stage keeps: plain sums of bound trigrams, cosines with the sums of the labelled texts."""
    d = language.DIMENSION
    real = lambda t: any(c.isalpha() for c in t or "")
    one = lambda v: v / np.sqrt((v * v).sum()) if v.any() else v
    vectors = {k: plain_vector(t, d) for k, t, *_ in docs if real(t)}
    names = sorted({lang for _, t, lang, *_ in docs if lang and t is not None})
    profile = np.array([one(sum(one(vectors[k]) for k, t, lang, *_ in docs if lang == x and k in vectors)) for x in names])
    kept = set()
    for k, v in vectors.items():
        text = dict((x[0], x[1]) for x in docs)[k]
        grams = len(re.sub(r"[^\W\d_]", "a", re.sub(r"[\W\d_]+", "\n", f"\n{text}\n"))) - 2
        unlike = grams**2 * d / (v * v).sum()
        if max(profile @ one(v)) >= corpus_pipeline.LEAST_COSINE * min(1.0, unlike / corpus_pipeline.FULL_GRAMS) ** 0.5:
            kept.add(k)
    return kept


def leaks_by_hand(text, items):
    """Does a text hold a window of ten template tokens of an item, slots one to one?"""
    tokens = lambda t: re.findall(r"[0-9]+(?:[.,][0-9]+)*|[^\W\d_]+", t)
    slot = lambda t: "<number>" if t[0].isdigit() else "<unit>" if t.lower() in decontamination.UNITS else "<name>" if t[0].isupper() and len(t) > 1 and t[1:].islower() else None
    mine = tokens(text)
    for item in items:
        theirs = tokens(item)
        for i in range(len(theirs) - 9):
            b = theirs[i : i + 10]
            if sum(slot(t) is None for t in b) < 6:
                continue
            for j in range(len(mine) - 9):
                a = mine[j : j + 10]
                if all((slot(x) or x.lower()) == (slot(y) or y.lower()) for x, y in zip(a, b)):
                    pairs = {(x, y) for x, y in zip(a, b) if slot(x)}
                    if len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs}):
                        return True
    return False


@pytest.mark.skipif(not os.path.exists(PIECE_MODEL), reason="no vocabulary file here")
def test_each_stage_against_brute_force(spark, tmp_path):
    """Columns with the names of results, and of types that no text can stand for, go through all stages."""
    rnd = random.Random(11)
    langs = {"en": "the of and that with from some other", "de": "der die und ist nicht für eine andere"}
    item = "Anna counts 12 apples in the old basket before Ben takes some of them away to the market"
    docs = []
    for k in range(70):
        lang = rnd.choice(sorted(langs))
        lines = [" ".join(rnd.choices(langs[lang].split() + [words(1, rnd.randrange(400)) for _ in range(8)], k=rnd.randint(1, 14))) for _ in range(rnd.randint(1, 6))]
        if docs and rnd.random() < 0.4:  # a near copy: one word changed in some lines of another
            lines = [x if rnd.random() < 0.5 else " ".join([*x.split()[:-1], words(1, 900 + k)]) for x in (rnd.choice(docs)[1] or "a").split("\n")]
        if rnd.random() < 0.1:
            lines.append(item.replace("Anna", "Cleo").replace("12", "37") if rnd.random() < 0.6 else item.replace("Anna", "Ben"))
        docs.append((k, "\n".join(lines), lang if rnd.random() < 0.7 else None, [0.5 * k], bytes([k]), "s", 0))
    docs += [(200, None, "en", None, None, None, None), (201, "", "de", [], b"", "", 0), (202, "12 !?", None, [], b"", "", 5), (203, "\n\n", None, [], b"", "", 2)]
    schema = "doc_id long, text string, lang string, ids array<double>, lang_pred binary, score string, n_removed long"
    now = spark.createDataFrame(docs, schema)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def run(name, df):
        out = dict(corpus_pipeline.STAGES)[name](spark, df, str(tmp_path))
        rows = sorted(out.collect(), key=lambda r: r.doc_id)
        return rows, spark.createDataFrame(rows, out.schema) if name != "tokens" else out

    rows, now = run("language", now)
    kept = language_by_hand(docs)
    assert {r.doc_id for r in rows} == kept and [tuple(r) for r in rows] == [x for x in docs if x[0] in kept]
    before = [(r.doc_id, r.text) for r in rows]
    rows, now = run("lines", now)
    want = {k: t for k, (_, n, t) in brute_lines(before, 1, 5).items() if n == 0 or re.search(r"[^\x20\x09-\x0D]", t)}
    assert {r.doc_id: r.text for r in rows} == want and all(r.score == "s" and r.lang_pred == bytes([r.doc_id]) and r.ids == [0.5 * r.doc_id] for r in rows)
    assert len(want) < len(before)
    before = [(r.doc_id, r.text) for r in rows]
    rows, now = run("near_duplicates", now)
    classes = brute_classes(before, 5, 80)
    assert {r.doc_id for r in rows} == {k for k, (n, top) in classes.items() if k == top}
    before = rows
    rows, now = run("decontamination", now)
    assert {r.doc_id for r in rows} == {r.doc_id for r in before if not leaks_by_hand(r.text, [item])} and len(rows) < len(before)
    tokens, _ = run("tokens", now)
    assert [r.text for r in tokens] == [r.text for r in rows] and all(r.round_trip for r in tokens) and all(isinstance(x, int) for r in tokens for x in r.ids)


@pytest.mark.skipif(not os.path.exists(PIECE_MODEL), reason="no vocabulary file here")
def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_rows_with_null_or_repeated_ids_are_told_apart(spark):
    near = words(60, 1).split()
    near[5] = "changed"
    item = "this question asks how many apples are left over when all of the boys have taken their share"
    docs = [(1, words(60, 1)), (None, " ".join(near)), (None, words(60, 2)), (7, " ".join(near[:-1])), (7, words(60, 3)), (None, words(60, 4)), (None, words(60, 4) + " end"), (9, None), (10, item), (None, item + " please"), (10, words(60, 5))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = corpus_pipeline.stage_near_duplicates(spark, df, "").collect()
    assert sorted(str(r.text) for r in got) == sorted(str(t) for k, (_, t) in enumerate(docs) if k not in (1, 3, 6, 9))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = corpus_pipeline.decontamination.without_contaminated(df, bench).collect()
    assert sorted(str(r.text) for r in clean) == sorted(str(t) for k, (_, t) in enumerate(docs) if k not in (8, 9))

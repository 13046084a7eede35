import random
import re

import pytest

from almagest.llm import jaccard
from almagest.llm.jaccard import near_duplicate_classes


def brute(docs, size, percent):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = {}
    for k, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    up = {k: k for k in sets}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * len(sets[a] | sets[b]):
                    x, y = sorted((top(a), top(b)))
                    up[y] = x
    return {k: (len(sets[k]), top(k)) for k in ids}


def corpus(seed, n):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["É", "A", "a"]
    base = [rnd.choices(vocab, k=rnd.randint(1, 40)) for _ in range(8)]
    docs = []
    for k in range(n):
        w = list(rnd.choice(base)) if rnd.random() < 0.8 else rnd.choices(vocab, k=rnd.randint(0, 30))
        for _ in range(rnd.choice([0, 0, 1, 1, 2])):
            if w:
                w[rnd.randrange(len(w))] = rnd.choice([*vocab, f"u{k}"])
        docs.append((k * 2 + 3, rnd.choice([" ", "\n", "  "]).join(w)))
    return [*docs, (1000, None), (1001, ""), (1002, " \t"), (1003, "W1 w2"), (1004, "w1  w2"), (1005, "w1")]


@pytest.mark.parametrize(("size", "percent", "group"), [(3, 90, 64), (2, 60, 3), (1, 75, 5)])
def test_against_brute_force(spark, monkeypatch, size, percent, group):
    monkeypatch.setattr(jaccard, "GROUP", group)
    docs = corpus(size, 120)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicate_classes(df, size, percent, block_bytes=2000).collect()}
    assert got == brute(docs, size, percent)


def test_closed_groups_send_no_members(spark):
    """The stored union of a group closes it to classes that share too little with all of it together."""
    rows = [(1, 10, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10], 1, 100), (2, 10, [1, 2, 3, 4, 5, 6, 7, 8, 9, 11], 2, 200), (3, 10, [1, 2, 21, 22, 23, 24, 25, 26, 27, 28], 3, 300), (4, 10, [3, 4, 31, 32, 33, 34, 35, 36, 37, 38], 4, 300)]
    grouped = spark.createDataFrame(rows, "cid long, n long, tokens array<long>, label long, grp long")
    asks = spark.createDataFrame([(1, 200), (1, 300)], "cid long, to long")
    pairs = jaccard.qualified(grouped, asks, 80)
    assert [tuple(r) for r in pairs.collect()] == [(1, 200)]
    asking, members = jaccard.opened_groups(grouped, pairs)
    assert [r.cid for r in members.collect()] == [2] and asking.count() == 1
    assert [tuple(r) for r in jaccard.links_in_groups(grouped, pairs, 80).collect()] == [(1, 2)]


def test_text_ids_and_one_id_with_several_texts(spark):
    rows = [("b", "a b c d e f g"), ("a", "A b c d e f g"), ("z", "u v w x y z u v"), ("z", "p q r s t p q r"), ("m", "p q r s t p q r"), ("n", "u v w x y z u v"), (None, None)]
    got = sorted((str(r.doc_id), r.component_id) for r in near_duplicate_classes(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    assert got == [("None", None), ("a", "a"), ("b", "a"), ("m", "m"), ("n", "n"), ("z", "m"), ("z", "n")]


def test_empty_table_null_ids_and_extra_columns(spark):
    assert near_duplicate_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(None, "a b c d e f", 1), (4, "a b c d e f", 2), (4, "a b c d e f", 2)], "doc_id int, text string, cid int")
    got = sorted((str(r.doc_id), r.component_id) for r in near_duplicate_classes(df).collect())
    assert got == [("4", 4), ("4", 4), ("None", 4)]


def test_intermediate_tables_are_deleted(spark):
    from pathlib import Path

    from almagest.llm.blocks import shared_dir

    where = Path(shared_dir(spark).removeprefix("file://"))
    listed = lambda: {p.name for p in where.iterdir()} if where.exists() else set()
    before = listed()
    docs = corpus(5, 60)
    out = near_duplicate_classes(spark.createDataFrame(docs, "doc_id long, text string"), 2, 60, block_bytes=2000)
    assert sorted(n.split("-")[0] for n in listed() - before) == ["classes", "labels", "shingles"]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute(docs, 2, 60)

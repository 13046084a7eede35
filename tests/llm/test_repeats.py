import random
import re

from almagest.llm import repeats
from almagest.llm.repeats import remove_repeated_windows


def brute(docs, size):
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in docs}
    seen, out = set(), {}
    for k in sorted(words):
        gone = set()
        for i in range(len(words[k]) - size + 1):
            w = tuple(words[k][i : i + size])
            if w in seen:
                gone.update(range(i, i + size))
            seen.add(w)
        out[k] = (len(words[k]), len(gone), " ".join(w for i, w in enumerate(words[k]) if i not in gone))
    return out


def corpus(seed=3, n=60):
    rnd = random.Random(seed)
    vocab = ["a", "b", "é", "of", "die", " x", "Die", "zu", " y"]
    passages = [" ".join(rnd.choices(vocab, k=rnd.randint(4, 30))) for _ in range(6)]
    docs = []
    for k in range(n):
        parts = [rnd.choice(passages) if rnd.random() < 0.5 else " ".join(rnd.choices(vocab, k=rnd.randint(0, 12))) for _ in range(rnd.randint(0, 4))]
        docs.append((k * 3, rnd.choice(["\n", " ", "\t \x0b"]).join(parts)))
    return [*docs, (500, None), (501, ""), (502, "  \n "), (503, "a " * 300), (504, docs[1][1])]


def run(spark, docs, size, **kw):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in remove_repeated_windows(df, size, **kw).collect()}


def test_against_brute_force(spark):
    docs = corpus()
    assert run(spark, docs, 5, block_bytes=500) == brute(docs, 5)


def test_empty_table(spark):
    assert run(spark, [], 5) == {}


def test_extra_columns_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d", 9), (1, "a b c d", 8), (None, "b c d", 7)], "doc_id int, text string, block int")
    got = sorted(((r.doc_id, r.n_removed) for r in remove_repeated_windows(df, 3).collect()), key=str)
    assert got == [(1, 0), (1, 4), (None, 3)]


def test_production_size_text_ids_and_very_long_texts(spark):
    """Windows of 20 words; ids that are text, in their order; one text of 60,000 words."""
    rnd = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(35))
    long = " ".join(rnd.choice(["a", "b", "c"]) for _ in range(30_000)) + " " + passage + " " + " ".join(f"w{i}" for i in range(30_000))
    docs = [(1, "one " + passage + " two"), (2, long), (3, passage[:60]), (4, "x " * 25), (5, None), (6, long[-500:])]
    want = brute(docs, 20)
    df = spark.createDataFrame([(f"d{k}", t) for k, t in docs], "doc_id string, text string")
    got = {int(r.doc_id[1:]): (r.n_words, r.n_removed, r.kept) for r in remove_repeated_windows(df, block_bytes=4000).collect()}
    assert got == want


def test_blocks_are_even_in_rows_and_bytes_and_keep_the_order(monkeypatch):
    import numpy as np

    from almagest.llm import blocks

    rnd = np.random.default_rng(1)
    ids = rnd.permutation(50_000).astype(np.int64) * 3
    sizes = np.where(rnd.random(50_000) < 0.01, 20_000, 200).astype(float)
    cuts = blocks.even_bounds(ids, sizes, 100)
    block = blocks.block_numbers(ids, cuts, int(ids.min()), int(ids.max()), 4)
    order = np.argsort(ids)
    assert np.all(np.diff(block[order]) >= 0) and block.max() < 400
    filled = np.bincount(block // 4, weights=sizes)
    assert len(cuts) == 99 and filled.max() < 2.2 * filled.mean()
    assert blocks.block_numbers(np.array([blocks.LAST]), cuts, 0, 10**6, 4)[0] == 399


def test_many_blocks_for_each_bound(spark, monkeypatch):
    """Where the driver holds fewer bounds than there are blocks, ranges are cut by id; nothing else changes."""
    from almagest.llm import blocks

    monkeypatch.setattr(blocks, "MOST_BOUNDS", 3)
    docs = corpus(8)
    assert run(spark, docs, 5, block_bytes=500) == brute(docs, 5)


def test_many_slices_are_reached_over_hubs(spark, monkeypatch):
    """Slices and blocks as at hundreds of GB, by a small fan: three levels of hubs change nothing in any operator's result."""
    import test_jaccard
    import test_lines
    import test_suffixes

    from almagest.llm import blocks, jaccard, lines, suffixes

    monkeypatch.setattr(blocks, "FAN", 3)
    assert [blocks.Slices(n).levels for n in (1, 3, 4, 9, 10, 28)] == [1, 1, 2, 2, 3, 4]
    many = lambda n_keys, n_blocks: blocks.Slices(20)
    for module in (blocks, lines, suffixes, repeats):
        monkeypatch.setattr(module, "slices_for", many)
    docs = corpus(8)
    assert run(spark, docs, 5, block_bytes=500) == brute(docs, 5)
    assert run(spark, [], 5) == {}
    test_suffixes.check(spark, 150, 6, block_bytes=2000)
    docs = test_lines.corpus(4)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in lines.remove_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"), block_bytes=400).collect()}
    assert got == test_lines.brute(docs, 1, 5)
    docs = test_jaccard.corpus(5, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicate_classes(spark.createDataFrame(docs, "doc_id long, text string"), 2, 60, block_bytes=2000).collect()}
    assert got == test_jaccard.brute(docs, 2, 60)

import random
import re

from almagest.llm.lines import remove_repeated_lines


def within_one(a, b):
    if a == b:
        return True
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(docs, exact, near):
    before, out = [], {}
    for k, t in docs:
        if t is None:
            out[k] = (0, 0, None)
            continue
        kept, lines = [], t.split("\n")
        for line in lines:
            w = re.findall(r"[^\x20\x09-\x0D]+", line)
            goes = len(w) >= exact and any(w == b or (max(len(w), len(b)) >= near and within_one(w, b)) for b in before)
            before.append(w)
            if not goes:
                kept.append(line)
        out[k] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def corpus(seed=1, n=70):
    rnd = random.Random(seed)
    vocab = list("abcdefgh") + ["é", "die"]
    base = [rnd.choices(vocab, k=rnd.randint(0, 9)) for _ in range(12)]

    def line():
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2])):
            i = rnd.randint(0, len(w))
            what = rnd.random()
            if what < 0.4:
                w.insert(i, rnd.choice(vocab))
            elif w and what < 0.7:
                w.pop(i - 1)
            elif w:
                w[i - 1] = rnd.choice(vocab)
        return rnd.choice([" ", "  ", "\t"]).join(w)

    docs = [(k, "\n".join(line() for _ in range(rnd.randint(0, 6)))) for k in range(n)]
    return [*docs, (200, None), (201, ""), (202, "\n\n"), (203, "a " * 500), (204, "a " * 501), (205, docs[3][1])]


def test_against_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for exact, near in ((2, 4), (1, 5), (1, 2), (1, 9)):
        got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in remove_repeated_lines(df, exact, near, block_bytes=400).collect()}
        assert got == brute(docs, exact, near)


def test_short_lines_repeated_rows_and_text_ids(spark):
    """Every line that is not blank is judged: copies of one word, and one word edit from five words on."""
    rows = [("a", "Les.\nfour words are here\nfive short words are here\n\n"), ("b", "Les.\nfour words were here\nfive short words are here now\n\nfive short words stay here"), ("b", "Les."), ("b", "Les."), (None, "And.\nfour words are here"), ("", "And.")]
    got = sorted((str(r.doc_id), r.kept_text) for r in remove_repeated_lines(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    assert got == sorted([("", "And."), ("a", rows[0][1]), ("b", ""), ("b", ""), ("b", "four words were here\n"), ("None", "")])


def test_empty_table_and_clashing_names(spark):
    assert remove_repeated_lines(spark.createDataFrame([], "doc_id long, text string, ord int")).collect() == []
    df = spark.createDataFrame([(None, "a b c d e", 1), (7, "a b c d e", 2)], "doc_id long, text string, block int")
    assert sorted((str(r.doc_id), r.n_removed) for r in remove_repeated_lines(df).collect()) == [("7", 0), ("None", 1)]


def test_pipeline_settles_exact_copies_of_every_line_that_is_not_blank(spark):
    import corpus_pipeline

    docs = [(1, "Les.\nAnd ornd.\n\nonly here"), (2, "Of, edti oner.\nLes.\n \nAnd  ornd.\nalso here"), (3, "Les."), (4, "Of, edti oner.\nAnd ornd"), (5, "\n"), *[(10 + k, t) for k, t in corpus(2)]]
    df = spark.createDataFrame([(k, t, 0) for k, t in docs], "doc_id long, text string, n_chars long")
    want = {k: t for k, (_, n, t) in brute(docs, 1, 5).items() if n == 0 or re.search(r"[^\x20\x09-\x0D]", t)}
    got = {r.doc_id: r.text for r in corpus_pipeline.stage_lines(spark, df, "").collect()}
    assert got == want and got[2] == "Of, edti oner.\n \nalso here" and got[4] == "And ornd" and 3 not in got and got[5] == "\n"

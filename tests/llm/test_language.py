import zlib

import numpy as np

from almagest.llm import language

WORDS = {"en": "the of and that with from", "de": "der die und ist nicht für", "fr": "le est dans être que très"}


def rows(n=90):
    rnd = np.random.default_rng(5)
    out = []
    for k in range(n):
        lang = sorted(WORDS)[k % 3]
        out.append((k, " ".join(rnd.choice(WORDS[lang].split(), 30)), lang))
    return [*out, (900, None, "en"), (901, "", "en"), (902, "123 !? \n", "de"), (903, "THE Of and", None)]


def test_vectors_do_not_depend_on_batches():
    texts = [t for _, t, _ in rows()]
    whole = language.text_vectors(texts)
    assert np.array_equal(whole, np.concatenate([language.text_vectors([t]) for t in texts]))


def plain_vector(text, dimension):
    """The sum of bound n-grams, one at a time, from the definition."""
    letters = [c.lower() if len(c.lower()) == 1 else c for c in text]
    line = "".join(c if c.isalpha() else "\n" for c in letters)
    codes = [0]
    for c in line + "\n":
        if c != "\n" or codes[-1]:
            codes.append(0 if c == "\n" else ord(c))
    v = {c: language.letter_vector(c, dimension) for c in set(codes)}
    return sum((np.roll(v[codes[i]], 2) * np.roll(v[codes[i + 1]], 1) * v[codes[i + 2]] for i in range(len(codes) - 2)), np.zeros(dimension))


def test_parts_of_long_texts_and_of_many_unlike_n_grams_add_up(monkeypatch):
    rnd = np.random.default_rng(3)
    texts = ["the und   être " * 60, "".join(map(chr, rnd.integers(0x4E00, 0x9000, 400))), "", "a", "12  34", "ab" + " " * 40 + "cd, É!" * 9, None]
    want = np.array([plain_vector(t or "", 64) if any(c.isalpha() for c in t or "") else np.zeros(64) for t in texts])
    for chunk, unlike in ((1 << 20, 1 << 14), (16, 7), (17, 64), (3, 1)):
        monkeypatch.setattr(language, "CHUNK", chunk)
        monkeypatch.setattr(language, "UNLIKE", unlike)
        assert np.array_equal(language.text_vectors(texts, 64), want)


def test_the_query_against_plain_arithmetic(spark, tmp_path):
    from almagest.llm.queries import op7_language_id

    data = [*rows(60), (None, "le est dans", None), (5, "der die und", "de"), (5, "der die und", "de")]
    spark.createDataFrame(data, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    d = language.DIMENSION
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 5 == 0
    real = lambda t: any(c.isalpha() for c in t or "")
    one = lambda v: v / np.sqrt((v * v).sum()) if v.any() else v
    learned = [(t, lang) for k, t, lang in data if lang is not None and t is not None and k is not None and not held(k)]
    names = sorted({lang for _, lang in learned})
    profile = np.array([one(np.round(sum(one(plain_vector(t, d)) for t, x in learned if x == lang and real(t)), 6)) for lang in names])
    want = []
    for k, t, _ in data:
        cosine = profile @ one(plain_vector(t, d)) if real(t) else None
        want.append((str(k), held(k), names[int(cosine.argmax())] if real(t) else "und", round(min(1.0, max(0.0, cosine.max())), 6) if real(t) else 0.0))
    got = [(str(r.doc_id), r.held_out, r.lang_pred, round(r.score, 6)) for r in op7_language_id(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_bundle_is_the_sum_of_bound_letters():
    got = language.text_vectors(["ab"], 64)[0]
    v = [language.letter_vector(c, 64) for c in (0, ord("a"), ord("b"), 0)]
    want = sum(np.roll(v[i], 2) * np.roll(v[i + 1], 1) * v[i + 2] for i in range(2))
    assert np.array_equal(got, want)


def test_held_out_accuracy_and_defined_cases(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string").withColumn("id", language.F.lit(1))
    labels, prototypes = language.learn(df.filter(~language.held_out()))
    assert labels == ["de", "en", "fr"]
    got = {r.doc_id: r for r in language.predict(df, labels, prototypes).collect()}
    for k, text, lang in rows():
        if k < 900 and zlib.crc32(str(k).encode()) % 5 == 0:
            assert got[k].lang_pred == lang
    assert {got[k].lang_pred for k in (900, 901, 902)} == {"und"} and got[900].score == 0
    assert got[903].lang_pred == "en" and 0 < got[903].score <= 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.learn(df)[0] == []
    assert language.predict(df, [], np.zeros((0, 8))).collect() == []


def test_kept_columns_of_any_name_and_type(spark):
    df = spark.createDataFrame([(1, "the of", [1.5], b"x", "y"), (None, None, None, None, None)], "doc_id long, text string, vectors array<double>, score binary, keep0 string")
    out = language.predict(df.withColumnRenamed("score", "raw"), ["en"], language.unit(language.text_vectors(["the of"])), keep=["doc_id", "text", "vectors", "raw", "keep0"]).collect()
    assert sorted((r.lang_pred, r.vectors, r.raw) for r in out) == [("en", [1.5], b"x"), ("und", None, None)]


def test_stage_rejects_long_noise_and_unlearned_scripts_and_keeps_short_texts(spark):
    import corpus_pipeline

    rnd = np.random.default_rng(7)
    clean = [(k, t, lang) for k, t, lang in rows() if k < 90]
    short = [(100 + k, " ".join(rnd.choice(WORDS[lang].split(), 3)), None) for k, lang in enumerate(sorted(WORDS) * 5)]
    alphabets = ["".join(map(chr, range(a, a + n))) for a, n in ((0x61, 26), (0x430, 32), (0x3B1, 25), (0x4E00, 900))]
    noise = []
    for k in range(80):
        letters = list(alphabets[k % 4])
        noise.append((1000 + k, " ".join("".join(rnd.choice(letters, rnd.integers(2, 9))) for _ in range(200 if k % 8 < 4 else 600)), None))
    repeated = [(200, " ".join(["the of"] * 400), None)]
    df = spark.createDataFrame([*clean, *short, *repeated, *noise], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.stage_language(spark, df, "").collect()}
    assert {k for k, _, _ in clean} <= kept and {k for k, _, _ in short} <= kept and 200 in kept
    assert not {k for k, _, _ in noise} & kept
    assert language.counted_vectors(["ab", None, "12", "the of"])[1].tolist() == [2, 0, 0, 6]


def test_ties_go_to_the_first_label(spark):
    same = language.unit(language.text_vectors(["the of"]))
    df = spark.createDataFrame([(1, "the of")], "doc_id long, text string")
    (r,) = language.predict(df, ["a", "b"], language.np.concatenate([same, same])).collect()
    assert r.lang_pred == "a" and r.score == 1.0

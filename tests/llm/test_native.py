import hashlib
import re

from almagest.llm import decontamination, urls
from almagest.llm.queries import URL_RULES, op1_url_filters, op4_secret_scans
from almagest.llm.secrets import BASE, scan, trigram_query


def test_trigram_queries():
    assert trigram_query("AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert trigram_query("[0-9a-f]{32,}") is None
    assert {frozenset({"sec", "ecr", "cre", "ret"}), frozenset({"tok", "oke", "ken"}), frozenset({"api", "pik", "ike", "key"})} <= set(trigram_query(BASE[0].pattern))
    assert trigram_query("abc(d|e)?f*ghi") == [frozenset({"abc", "ghi"})]
    assert trigram_query("ab|cdef") is None


TEXTS = {
    1: "x password = 'abcdefgh1' TOKEN:short Api-key apikey: \"A+/_.=-0123\" é token=12345678",
    2: "AKIAABCDEFGHIJKL akiaABCDEFGHIJKL AKIA123 \n" + "0123456789abcdef" * 2 + "Z" + "a" * 31,
    3: None,
    4: "",
    5: "token=secret = abcdefgh \U0001f600 secret=abcdefgh",
    6: "ſecret=abcdefgh -----BEGIN RSA PRIVATE KEY----- é",
    7: "passwd==abcdefgh passwd : : x" * 50,
}


def base_spans(text):
    patterns = [("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 0, 16), ("hex", "[0-9a-f]+", 0, 0, 32)]
    found = []
    for place, (kind, pattern, flags, group, least) in enumerate(patterns):
        if kind == "assign":
            pattern, flags = pattern.replace("(password", "((?i:password").replace("key)", "key))", 1), re.A
        found += [(m.start(), place, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "", flags) if len(m[group]) >= least]
    return ",".join(s for *_, s in sorted(found))


def test_secrets_against_brute_force(spark, tmp_path):
    spark.createDataFrame([*TEXTS.items(), (None, TEXTS[1])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op4_secret_scans(spark, str(tmp_path)).collect()}
    assert len(got) == 8 and got[None].base_sha256 == got[1].base_sha256
    for k, t in TEXTS.items():
        if k != 6:  # Python folds the long s to s, the rule does not
            assert got[k].base_sha256 == hashlib.sha256(base_spans(t).encode()).hexdigest(), k
    assert got[6].n_assign == 0 and "private_key:16:47" in got[6].spans


def test_many_matches_and_ids_of_any_type(spark):
    """Starts come from running sums, however many matches a text has."""
    for n in (1, 2, 3, 64, 65, 1000):
        text = "".join(f"{'x' * (k % 7)} token=abcdefg{k % 10} " for k in range(n))
        (r,) = scan(spark.createDataFrame([(f"id{n}", text)], "doc_id string, text string")).collect()
        want = [(m.start(), m.end()) for m in re.finditer("token=abcdefg[0-9]", text)]
        assert r.doc_id == f"id{n}" and [(s.start, s.end) for s in r.found if s.kind == "assign"] == want


def test_secrets_empty_table_and_clashing_names(spark):
    assert scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert len(scan(spark.createDataFrame([(1, "a", 2), (1, "token=12345678", 3)], "doc_id long, text string, kinds int")).collect()) == 2


def test_urls(spark, tmp_path):
    pages = [(1, "http://A.Example.com/en/77?x"), (2, "https://b.com/en/"), (3, "http://example.net/de/81"), (4, "http://x.net/de/8"), (5, "http://notcom/en/"), (6, None), (7, "no scheme"), (8, "http://bad.org?en/"), (9, "ftp://h#f"), (10, "http://com/en/x"), (11, "a://b://c/d")]
    bad = [(100 + i, f"http://spam.example.org/buy/{i}?ref=1") for i in range(20)]
    good = [(200 + i, f"http://fine.example.org/read/{i}") for i in range(30)]
    spark.createDataFrame(pages + bad + good + [(300, "http://spam.example.org/buy/900")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    labels = [(k, 0, 1) for k, _ in bad] + [(k, 1, 0) for k, _ in good]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in op1_url_filters(spark, str(tmp_path)).collect()}
    assert len(got) == 62
    assert got[1] == ("a.example.com", "/en/77", "example.com/en/7", "allow")
    assert got[2] == ("b.com", "/en/", "com/en/", "block")
    assert got[3] == ("example.net", "/de/81", "example.net/de/8", "block")
    assert got[4][2:] == ("net/de/", "allow") and got[10][2:] == ("com/en/", "block")
    assert got[5][2] is None and got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow")
    assert got[8][:2] == ("bad.org", "") and got[9][:2] == ("h", "") and got[11][:2] == ("b:", "//c/d")
    assert got[300][3] == got[100][3] == "block" and got[200][3] == "allow"


def test_urls_without_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/1"), (1, "http://a.com/en/1")], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.verdict for r in urls.judge(pages, labels, URL_RULES).collect()] == ["block", "block"]
    assert urls.judge(pages.limit(0), labels, URL_RULES).collect() == []


ITEM = "Anna walks 12 km from Bonn to the old harbour and back again before the rain starts, how long is it for Anna?"


def test_contamination(spark):
    bench = spark.createDataFrame([(7, ITEM), (8, "too short"), (9, None)], "item_id long, text string")
    docs = [
        (1, "intro text. " + ITEM + " outro"),
        (2, ITEM.replace("Anna", "Peter").replace("12", "3.5").replace("Bonn", "Rome").replace("km", "miles")),
        (3, "Maria walks 12 km from Bonn to the old harbour and back again before the rain ends"),
        (4, ITEM.replace("walks 12 km from Bonn", "ran far away out of a town")[:40]),
        (5, None),
        (6, ""),
        (None, ITEM),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", decontamination.F.lit(1))
    for most in (1_000_000, 0):
        got = {r.doc_id: r for r in decontamination.judged(df, bench, broadcast_bytes=most).collect()}
        assert {k for k, r in got.items() if r.contaminated} == {1, 2, 3, None} and got[1].item_ids == [7]
    assert {r.doc_id for r in decontamination.without_contaminated(df, bench).collect()} == {4, 5, 6}
    assert decontamination.judged(df.limit(0), bench).collect() == []
    assert not any(r.contaminated for r in decontamination.judged(df, bench.limit(0)).collect())


def test_items_without_a_window_are_looked_for_whole(spark):
    """Short items, items of numbers and names only, items without an id; documents with ids of any type, null or repeated."""
    bench = spark.createDataFrame([("s", "What is osmosis?"), ("n", "1 2 3 5 8 13 21 34 55 89 144 Bonn Rome"), (None, "name every noble gas"), ("e", " ?! ")], "item_id string, text string")
    docs = [("a", "well, what IS osmosis then"), ("a", "what is it? osmosis"), ("b", "so 1, 2, 3 5 8 13 21 34 55 89 144 bonn rome."), ("c", "1 2 3 5 8 13 21 34 55 89 144 Bonn Paris"), (None, "Name every noble gas now"), (None, "name every gas"), ("d", None), ("d", ""), ("a", "well, what IS osmosis then")]
    df = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id string, text string, item string")
    for most in (1 << 20, 0):
        got = sorted((str(r.doc_id), r.contaminated, r.n_windows, r.item_ids) for r in decontamination.judged(df, bench, broadcast_bytes=most).collect())
        hit = {0: ["s"], 2: ["n"], 4: [], 8: ["s"]}
        assert got == sorted((str(k), i in hit, int(i in hit), hit.get(i, [])) for i, (k, _) in enumerate(docs))
    assert sorted(str(r.text) for r in decontamination.without_contaminated(df, bench).collect()) == sorted(str(t) for i, (_, t) in enumerate(docs) if i not in (0, 2, 4, 8))


def test_slots_must_map_one_to_one(spark):
    item = "Anna gave Ben some bread while the others sat and Anna then thanked Ben twice"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, item.replace("Anna", "Cleo").replace("Ben", "Dirk")), (2, "Cleo gave Dirk some bread while the others sat and Dirk")], "doc_id long, text string")
    got = {r.doc_id: r.n_windows for r in decontamination.judged(docs, bench).collect()}
    assert got[1] == 6 and got[2] == 1


def test_rules_that_tie_and_very_long_urls(spark):
    """Of equally long rules the one with the longer host wins; a URL may be of any length, labels may repeat or be null."""
    rules = [("block", "b.com", "/xy"), ("allow", "a.b.com", "/x"[:0]), ("allow", "xa.b.com", "")]
    long = "http://xa.b.com/" + "x" * 200_000 + "?q#f"
    pages = spark.createDataFrame([(1, "http://xa.b.com/xyz"), (2, long), (2, long), (None, "http://q.b.com/xy"), (3, "http://h.org/" + "/".join(f"s{i}" for i in range(300)))], "page_id long, url string")
    labels = spark.createDataFrame([(2, 1, None), (2, None, 0), (None, 1, 1), (9, 0, 0)], "doc_id long, quality int, toxic int")
    got = sorted((str(r.page_id), r.rule, r.verdict) for r in urls.judge(pages, labels, rules).collect())
    assert got == sorted([("1", "xa.b.com", "allow"), ("2", "xa.b.com", "allow"), ("2", "xa.b.com", "allow"), ("None", "b.com/xy", "block"), ("3", None, "allow")])


def test_very_long_texts(spark):
    body = "word " * 100_000
    docs = spark.createDataFrame([(1, body + ITEM + " " + body), (2, body + "token=abcdefgh" + body)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert {r.doc_id: r.item_ids for r in decontamination.judged(docs, bench).collect()} == {1: [7], 2: []}
    assert {r.doc_id: [(s.kind, s.start) for s in r.found] for r in scan(docs).collect()} == {1: [], 2: [("assign", 500_000)]}

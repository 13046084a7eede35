import hashlib

from pyspark.sql import functions as F

from almagest.llm import media


def test_parse_keeps_order_positions_and_captions():
    html = '<h1>A&amp;B</h1><script>x<y</script><p>one<br>two</p><figure><img src="sha256:d1" alt="z"><figcaption>cap</figcaption></figure><img src="http://x"><img src="sha256:d2" alt="alt"> tail'
    got = [(e["pos"], e["kind"], e["text"] or e["digest"], e["caption"]) for e in media.parse_sequence(html)]
    assert got == [(0, "text", "A&B", None), (1, "text", "one", None), (2, "text", "two", None), (3, "media", "d1", "cap"), (4, "media", "d2", "alt"), (5, "text", " tail", None)]
    assert media.parse_sequence(None) == []


def test_resolving(spark):
    pages = spark.createDataFrame([(1, '<p>a</p><img src="sha256:x">b<img src="sha256:y">'), (2, None), (3, '<img src="sha256:x">')], "page_id long, html string")
    table = spark.createDataFrame([("x", b"1"), ("x", b"1"), ("q", b"2")], "digest string, payload binary")
    got = sorted((r.id, r.pos, r.digest, r.payload and bytes(r.payload)) for r in media.resolved(media.references(media.sequences(pages, "page_id", "html")), table).collect())
    assert got == [(1, 1, "x", b"1"), (1, 3, "y", None), (3, 0, "x", b"1")]


def test_payload_and_round_trip(spark):
    texts = [None, "", "é" * 96, "a" * 193, "a & <b> \r\n\x0b]]>&amp;"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("payload", media.payload(F.col("text")))
    for r in df.collect():
        raw = (r.text or "").encode()
        want = raw.ljust(192 * max(1, -(-len(raw) // 192)))
        assert bytes(r.payload) == want
        assert media.decode_image(media.encode_image(want)).tobytes() == want
    stored = {r.payload_sha256: r for r in media.stored_media(df).collect()}
    assert len(stored) == 4 and all(k == r.digest for k, r in stored.items())


def test_query_on_a_fixture(spark, tmp_path):
    import zlib

    from almagest.llm.queries import op5_media_columns

    rows = [(1, None), (2, ""), (3, "x & y <z>\n" * 50), (4, "x & y <z>\n" * 50), (5, " "), (None, "é")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op5_media_columns(spark, str(tmp_path)).collect()}
    assert len(got) == 6
    for k, t in rows:
        raw = (t or "").encode()
        full = raw.ljust(192 * max(1, -(-len(raw) // 192)))
        assert (got[k].n_bytes, got[k].payload_bytes, got[k].payload_sha256, got[k].tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        pgm = b"P5\n192 %d\n255\n" % (len(full) // 192) + full
        assert (got[k].media_bytes, got[k].media_sha256, got[k].feature) == (len(pgm), hashlib.sha256(pgm).hexdigest(), plain_feature(full))
        assert (got[k].pos, got[k].caption) == (int(bool((t or "").strip())), str(len(raw)))  # behind the text, if there is any
    assert got[3].feature == got[4].feature and got[1].media_sha256 == got[5].media_sha256


def plain_feature(samples):
    """Mean, deviation and which of 8 x 8 areas are lighter than the mean, sample by sample."""
    height = len(samples) // 192
    mean = sum(samples) / len(samples)
    deviation = max(0.0, sum(x * x for x in samples) / len(samples) - mean * mean) ** 0.5
    edges = [k * height // 8 for k in range(9)]
    bits = 0
    for band in range(8):
        a, z = edges[band], max(edges[band] + 1, edges[band + 1])
        light = sum(samples[192 * a : 192 * z]) / (192 * (z - a))
        for area in range(8):
            column = sum(samples[192 * y + x] for y in range(height) for x in range(24 * area, 24 * area + 24)) / (24 * height)
            bits = bits << 1 | (light + column > 2 * mean)
    return f"{mean:.4f}:{deviation:.4f}:{bits:016x}"


def test_empty_table_clashing_names_and_long_text(spark):
    from almagest.llm import media as m

    empty = spark.createDataFrame([], "page_id string, html string, digest string")
    assert m.sequences(empty, "page_id", "html").collect() == [] and m.stored_media(spark.createDataFrame([], "payload binary")).collect() == []
    long = "<p>" + "x " * 400_000 + '</p><img src="sha256:q" alt="c">'
    pages = spark.createDataFrame([("a", long, "d"), ("a", long, "d"), (None, None, None)], "id string, sequence string, digest string")
    refs = m.references(m.sequences(pages, "id", "sequence")).collect()
    assert [(r.id, r.pos, r.digest, r.caption) for r in refs] == [("a", 1, "q", "c")] * 2

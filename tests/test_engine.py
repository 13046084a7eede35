import datetime as dt
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from almagest.errors import FieldNotFoundError, InvalidRecordingError, RebuildError, RecordingExistsError
from almagest.functions.aggregates import described
from almagest.functions.gpstime import GpsTime, gps_milliseconds, gps_week
from almagest.functions.rounding import categories
from almagest.operators import views
from almagest.operators.joins import nearest, running_ordinal
from almagest.operators.shred import Shredded, assemble, shred, union_promoted, with_offsets
from almagest.operators.verify import by_log, field_differences, overall, payload_differences, same_source
from almagest.plans.catalog import Recording
from almagest.plans.table import LogTable, database_order
from almagest.progress import Progress, Tracker


@pytest.fixture(scope="module")
def mydb(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("rec") / "mydb"
    put = lambda rows, schema, path: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/{path}")
    put([(i, "BESTPOS" if i < 5 else "RANGE") for i in range(8)], "sequence_id long, log string", "mydb.parquet")
    put([(0, bytearray(b"\xff")), (1, bytearray(b"\xfe"))], "sequence_id long, payload binary", "unknown_data.parquet")
    put([(i, 2300, 100 * (i + 1), 51 + i / 10, -114 - i / 10, 1000.0 + i) for i in range(5)], "sequence_id long, header_week long, header_milliseconds long, lat double, lon double, hgt double", "BESTPOS/BESTPOS.parquet")
    put([(5 + i, 2300, ms, idle) for i, (ms, idle) in enumerate([(100, 70.0), (300, 80.0), (500, 90.0)])], "sequence_id long, header_week long, header_milliseconds long, idle double", "RANGE/RANGE.parquet")
    put([(i, 5 + i // 2, i + 1, 2e7 + i) for i in range(6)], "sequence_id long, parent_id long, sv_prn long, range double", "RANGE/obs/obs.parquet")
    return str(root)


@pytest.fixture
def rec(spark, mydb):
    return Recording.open(spark, mydb)


def ids(table):
    return [r.sequence_id for r in table.current.orderBy("sequence_id").collect()]


def test_open_and_filter_by_log(rec):
    assert len(rec) == 8 and len(rec.filter_by_log("RANGE")) == 3 and len(rec.filter_by_log("RANGE").reset_filters()) == 8
    with pytest.raises(FieldNotFoundError):
        rec.filter_by_log("RANGE").filter_by_log("BESTPOS")
    assert rec.unknown.count() == 2 and "payload" in rec.unknown.columns
    assert rec.subtables.RANGE.subtables.obs.fields == ["parent_id", "sv_prn", "range"]
    assert "obs: 6 entries" in repr(rec)


def test_logs_restrict_what_is_opened(spark, mydb):
    assert list(Recording.open(spark, mydb, ["BESTPOS"]).tables) == ["BESTPOS"] and len(Recording.open(spark, mydb, ["BESTPOS"])) == 5
    assert Recording.open(spark, mydb, ["NONE"]).tables == {}
    with pytest.raises(InvalidRecordingError):
        Recording.open(spark, mydb.rsplit("/", 1)[0])


def test_archive(spark, mydb, tmp_path):
    from pathlib import Path

    with zipfile.ZipFile(tmp_path / "other.pack", "w") as z:
        for p in Path(mydb).rglob("*"):
            z.write(p, f"mydb/{p.relative_to(mydb)}")
    assert len(Recording.open(spark, str(tmp_path / "other.pack"), archives=(".pack",)).tables["RANGE"]) == 3


def test_time(rec):
    pos = rec.tables["BESTPOS"]
    ms = lambda t: [r.header_milliseconds for r in t.current.orderBy("sequence_id").collect()]
    assert ms(pos.filter_end_time(GpsTime(2300, 0.3))) == [100, 200, 300]
    assert ms(pos.filter_start_time(GpsTime(2300, 0.3))) == [300, 400, 500]
    assert ms(pos.filter_time_range(GpsTime(2300, 0.2), GpsTime(2300, 0.4))) == [200, 300, 400]
    assert pos.time_range == (GpsTime(2300, 0.1), GpsTime(2300, 0.5))


def test_summaries(rec):
    pos = rec.tables["BESTPOS"]
    assert pos.get_mean("lat") == pytest.approx(51.2) and pos.lat.mean == pytest.approx(51.2)
    assert pos.get_std("hgt") == pytest.approx(1.5811388)
    assert pos.get_field_stats("hgt").p25 == 1001
    with pytest.raises(FieldNotFoundError):
        pos.get_mean("nothing")
    with pytest.raises(ValueError):
        pos.summary("lat", "mode")
    rng = rec.tables["RANGE"]
    grouped = {r.parent_id: r.value for r in rng.get_rms("sv_prn", group=True).collect()}
    assert grouped[5] == pytest.approx(math.sqrt((1 + 4) / 2))
    with pytest.raises(FieldNotFoundError):
        pos.get_mean("lat", group=True)


def test_filters_through_children(rec):
    rng = rec.tables["RANGE"]
    assert ids(rng.filter_entries("idle", "<", 85)) == [5, 6]
    hit = rng.filter_entries("sv_prn", "==", 1, "obs")
    assert ids(hit) == [5] and ids(hit.children["obs"]) == [0, 1]
    assert ids(hit.children["obs"].filter_entries("sv_prn", ">", 1)) == [1]
    assert ids(hit.children["obs"].filter_entries("sv_prn", ">", 1).reset_filters()) == [0, 1]
    assert ids(hit.reset_filters()) == [5, 6, 7]
    assert ids(rng.children["obs"].filter_entries("sv_prn", ">", 3)) == [3, 4, 5]
    assert ids(rng.filter_mean("sv_prn", ">", 2, "obs")) == [6, 7]
    assert ids(rng.filter_entries("sv_prn", ">=", 4, "obs", op=lambda x: x.max())) == [6, 7]
    with pytest.raises(FieldNotFoundError, match="obs"):
        rng.filter_entries("sv_prn", "==", 1)
    with pytest.raises(ValueError):
        rng.filter_entries("idle", "~", 1)


def test_not_equal_keeps_nulls(spark):
    t = LogTable("t", spark.createDataFrame([(0, 1.0), (1, None)], "sequence_id long, x double"))
    assert ids(t.filter_entries("x", "!=", 1.0)) == [1]


def test_entries_and_arrival_order(rec):
    rows = {r.sequence_id: r for r in rec.tables["RANGE"]}
    assert [o.sv_prn for o in rows[6].obs] == [3, 4]
    # Messages 0 and 1 are unknown payloads here, so BESTPOS has three index rows for five table rows.
    assert [name for name, _ in rec] == ["BESTPOS"] * 3 + ["RANGE"] * 3


def test_sorting(spark):
    a = spark.createDataFrame([(0, 2200, 500000), (2, 2200, 100000)], "sequence_id long, header_week long, header_milliseconds long")
    b = spark.createDataFrame([(1, 2200, 200000), (3, 2201, 50000)], a.schema)
    index = spark.createDataFrame([(0, "A"), (1, "B"), (2, "A"), (3, "B")], "sequence_id long, log string")
    assert [r.sequence_id for r in database_order(index, {"A": a, "B": b}).collect()] == [2, 1, 0, 3]
    t = LogTable("a", a.unionByName(b))
    assert [r.sequence_id for r in t.sort_by_time().current.collect()] == [2, 1, 0, 3]
    with pytest.raises(FieldNotFoundError):
        LogTable("x", index).sort_by_time()


def test_gps_time(spark):
    assert GpsTime.of(dt.datetime(1980, 1, 6)) == GpsTime(0, 0.0)
    when = dt.datetime(2024, 1, 1, 12, 0, 0, 250000)
    r = spark.createDataFrame([(when,)], "t timestamp_ntz").select(gps_week(F.col("t")).alias("w"), gps_milliseconds(F.col("t")).alias("ms")).first()
    assert GpsTime.of(when) == GpsTime(r.w, r.ms / 1000) and r.ms % 86400000 == (12 * 3600 + 18.25) * 1000


def test_nearest(spark):
    import random

    rnd = random.Random(4)
    left = [(rnd.randint(0, 50), rnd.randint(1, 3), i) for i in range(60)]
    right = [(float(rnd.randint(0, 50)), rnd.randint(1, 3), float(i)) for i in range(40)]
    got = nearest(spark.createDataFrame(left, "t long, k int, i int"), spark.createDataFrame(right, "t double, k int, v double"), "t", ["k"], ["v"], 4).collect()
    assert len(got) == 60
    for r in got:
        near = [(abs(t - r.t), t > r.t, -v) for t, k, v in right if k == r.k and abs(t - r.t) <= 4]
        want = min(near)[:2] if near else None
        assert (r.v is None) == (want is None)
        if want:
            assert r.v in [v for t, k, v in right if k == r.k and (abs(t - r.t), t > r.t) == want]


def test_shred_and_assemble(spark):
    rows = spark.sql("""SELECT * FROM VALUES (0L, 7, array(named_struct('s', 'L1', 'sub', array(named_struct('x', 1))), named_struct('s', 'L2', 'sub', array())), array(1, 2, 3), named_struct('p', 1)),
        (1L, NULL, array(), array(), NULL), (2L, 9, array(named_struct('s', 'L5', 'sub', array(named_struct('x', 2), named_struct('x', 3)))), array(4), named_struct('p', 2)) AS t(sequence_id, a, obs, vals, one)""")
    tree = shred(rows)
    assert tree.table.columns == ["sequence_id", "a"]
    obs = tree.children["obs"]
    assert [(r.sequence_id, r.parent_id, r.s) for r in obs.table.orderBy("sequence_id").collect()] == [(0, 0, "L1"), (1, 0, "L2"), (2, 2, "L5")]  # has a child: runs on
    assert [(r.sequence_id, r.parent_id, r.x) for r in obs.children["sub"].table.orderBy("parent_id", "sequence_id").collect()] == [(0, 0, 1), (0, 2, 2), (1, 2, 3)]  # a leaf: restarts
    assert [(r.parent_id, r.key_0, r.key_2) for r in tree.children["vals"].table.orderBy("parent_id").collect()] == [(0, 1, 3), (2, 4, None)]
    back = {r.sequence_id: r for r in assemble(tree.table, tree.children).collect()}
    assert [o.s for o in back[0].obs] == ["L1", "L2"] and back[1].obs is None and back[2].one[0].p == 2 and [x.x for x in back[2].obs[0].sub] == [2, 3]
    assert isinstance(obs, Shredded)


def test_offsets_union_and_ordinals(spark):
    t = spark.createDataFrame([(0, 0), (1, 0), (0, 1)], "sequence_id long, parent_id long")
    assert [tuple(r) for r in with_offsets(t, 5, 10, leaf=True).collect()] == [(0, 10), (1, 10), (0, 11)]
    assert [tuple(r) for r in with_offsets(t, 5, 10, leaf=False).collect()] == [(5, 10), (6, 10), (5, 11)]
    u = union_promoted([spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(1.5,)], "a double")])
    assert dict(u.dtypes) == {"a": "double", "b": "int"} and [tuple(r) for r in u.collect()] == [(1.0, 2), (1.5, None)]
    n = running_ordinal(spark.range(100).select((F.col("id") * 7).alias("k")), ["k"], "k", width=50)
    assert all(r.ordinal == r.k // 7 for r in n.collect())


def sides(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos long, log string, week long, milliseconds double, body map<string,string>")


def test_verification(spark):
    a = sides(spark, [("P", 1, 0.0, {"lat": "51.0", "n": "5"}), ("P", 1, 0.0, {"lat": "52.0", "n": "6"}), ("Q", None, None, {"x": "12345.678"}), ("Z", 1, 1.0, {"y": "1"})])
    b = sides(spark, [("P", 1, 0.0, {"lat": "51.00000000001", "n": "5"}), ("P", 1, 0.0, {"lat": "53.0", "n": "7"}), ("Q", None, None, {"x": "12300.0"})])
    found = field_differences(a, b)
    rows = {(r.log, r.pos, r.field): r for r in found.filter("differs").collect()}
    assert set(rows) == {("P", 1, "lat"), ("P", 1, "n"), ("Q", 2, "x")}
    assert rows["P", 1, "n"].error is None and rows["P", 1, "lat"].error == pytest.approx(1 / 52)
    assert {r.log: r.status for r in by_log(found).collect()} == {"P": "MISMATCH", "Q": "MISMATCH", "Z": "NOT_VERIFIED"}
    promoted = by_log(found, expected_ascii=True)
    assert {r.log: r.status for r in promoted.collect()} == {"P": "MISMATCH", "Q": "VERIFIED", "Z": "NOT_VERIFIED"}
    assert tuple(overall(promoted).first()) == (4, 1, 1, 1)
    pay = lambda rows: spark.createDataFrame(rows, "pos long, log string, week long, milliseconds double, payload binary")
    got = payload_differences(pay([(0, "P", 1, 0.0, bytearray(b"abc")), (1, "P", 1, 1.0, bytearray(b"abc")), (2, "P", 9, 1.0, bytearray(b""))]), pay([(0, "P", 1, 0.0, bytearray(b"abc")), (1, "P", 1, 1.0, bytearray(b"abx"))]))
    assert {r.pos: (r.status, r.first_byte) for r in got.collect()} == {0: ("same", None), 1: ("different", 2), 2: ("unmatched", None)}


def test_categories():
    import numpy as np

    a = np.array([12345.678, 1.0, 1.0, np.nan, 51.123456789, 0.0, 1.1, 3.3e-9])
    b = np.array([12300.0, 1.0 + 1e-9, 2.0, 1.0, 51.1235, 0.004, float(np.float32(1.1)), 3.0e-9])
    got = categories(a, b, np.abs(a - b) / np.maximum(np.abs(a), 1e-300))
    assert got.tolist() == ["ascii_rounding", "negligible", "large_error", "non_float", "ascii_rounding", "large_error", "negligible", "large_error"]


def test_views(spark):
    top = spark.createDataFrame([(0, 0.0), (1, 1000.0)], "sequence_id long, header_milliseconds double")
    obs = spark.createDataFrame([(0, 0, 1, 40.0, 1 << 16), (1, 0, 2, 38.0, 0), (2, 0, 3, 42.0, 0), (3, 1, 1, 41.0, 0), (4, 1, 2, 37.0, 0), (5, 1, 3, 43.0, 7 << 16)], "sequence_id long, parent_id long, sv_prn long, C_No double, c_status long")
    rec = Recording(spark.createDataFrame([(0, "RANGE")], "sequence_id long, log string"), {"RANGE": LogTable("RANGE", top, {"obs": LogTable("obs", obs)})})
    signal = views.signal(rec)
    assert {r.sv_prn: (r.mean_cn0, round(r.std_cn0, 4), r.band) for r in signal["satellites"].collect()} == {1: (40.5, 0.7071, "good"), 2: (37.5, 0.7071, "good"), 3: (42.5, 0.7071, "good")}
    assert {r.satellites for r in signal["epochs"].collect()} == {3}
    assert {r.system for r in views.tracking(rec)["by_system"].collect()} == {"GPS", "GLONASS", "Unknown(7)"}
    assert views.skyview(rec) is None and views.imu(rec) is None and "elevation" not in views.satellite_stats(rec)
    sky = spark.createDataFrame([("0", 3, 30.0, 90.0, 5), ("0", 3, 60.0, 180.0, 6), ("9", 12, 1.0, 0.0, 7)], "system_type string, prn long, elevation double, azimuth double, header_milliseconds long")
    rows = views.sky_track(sky).collect()
    assert [(r.radius, r.label, r.system) for r in rows] == [(60.0, "G03", "GPS"), (30.0, "G03", "GPS"), (89.0, "?12", "9")]
    sigma = views.position_sigma(spark.createDataFrame([(1, 0.01, 0.02, 0.03)], "header_milliseconds long, latitude_std_dev double, longitude_std_dev double, height_std_dev double"))
    assert sigma.first().sigma_3d == pytest.approx(0.0374166, abs=1e-6)


def test_describe_text(spark):
    r = described(spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "s string"), "s").first()
    assert tuple(r) == (3, 2, "b", 2)


def test_fingerprints(tmp_path):
    import hashlib
    import json

    data = b"\xaa\x44\x12" * 512
    (tmp_path / "x.gps").write_bytes(data)
    good = {"file_size": 1536, "sha256": hashlib.sha256(data).hexdigest().upper()}
    for name, meta in (("ok", good), ("size", {**good, "file_size": 1}), ("sha", {**good, "sha256": "0"}), ("part", {"file_size": 1})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "_metadata.json").write_text(json.dumps(meta))
    (tmp_path / "none").mkdir()
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("z/_metadata.json", json.dumps(good))
    check = lambda a, b: same_source(str(tmp_path / a), str(tmp_path / b))
    assert check("x.gps", "ok").valid and check("z.zip", "x.gps").valid
    assert [check("x.gps", n).reason for n in ("size", "sha", "part", "none")] == ["file_size_mismatch", "sha256_mismatch", "metadata_incomplete", "metadata_missing"]
    assert check("none", "ok").detail == "first argument"


def test_progress():
    now, seen = [0.0], []

    def broken(_):
        raise RuntimeError

    t = Tracker(seen.append, broken, clock=lambda: now[0])
    assert t.emit(Progress("read", 1, 4)) and not t.emit(Progress("read", 2, 4)) and t.emit(Progress("read", 4, 4), force=True)
    assert [p.percent for p in seen] == [25, 100] and Progress("x", 5, 0).fraction == 0


MESSAGES = [("BESTPOS", {"week": 2300, "milliseconds": 100.0 * i}, {"lat": 51.0 + i / 8, "n": i, "obs": [{"prn": i, "c": 1.5}, {"prn": i + 1, "c": 2.5}], "vals": [1, 2, 3]}) for i in range(40)] + [("TIME", {"week": 2300, "milliseconds": 5.0}, {"utc": "x"})]


@pytest.fixture(scope="module")
def logfile(tmp_path_factory):
    from almagest.sources.frames import frame, raw_frame

    path = tmp_path_factory.mktemp("log") / "a.log"
    parts = [frame(*m) for m in MESSAGES]
    parts.insert(3, b"garbage \xaa\x44\x12 more")
    parts.insert(7, raw_frame(b"not json"))
    path.write_bytes(b"".join(parts))
    return str(path)


def test_convert_rebuild_and_verify(spark, logfile, tmp_path):
    from almagest.report import verify
    from almagest.sources.rebuild import rebuild
    from almagest.sources.writer import archived, convert, read_messages

    for slice_bytes in (100, 1 << 20):
        rows = read_messages(spark, logfile, slice_bytes).orderBy("sequence_id").collect()
        assert [r.sequence_id for r in rows] == list(range(42)) and [r.sequence_id for r in rows if r.body is None] == [6]
    out = convert(spark, logfile, str(tmp_path / "rec"))
    with pytest.raises(RecordingExistsError):
        convert(spark, logfile, out)
    rec = Recording.open(spark, out)
    assert len(rec) == 42 and rec.unknown.count() == 1
    pos = rec.tables["BESTPOS"]
    assert len(pos) == 40 and len(pos.children["obs"]) == 80 and pos.children["vals"].base.columns == ["sequence_id", "parent_id", "key_0", "key_1", "key_2"]
    assert rebuild(rec, str(tmp_path / "b.log")) == 42
    found = verify(spark, out, logfile, "field")["field"]
    assert found.overall.mismatched_types == 0 and found.overall.messages == 41
    assert same_source(logfile, out).valid and zipfile.ZipFile(archived(out)).namelist()[0].startswith("rec/")
    with pytest.raises(TypeError):
        convert(spark, [1, 2], out)
    lost = Recording(rec.index, {"BESTPOS": pos}, rec.unknown, rec.whole_index)
    with pytest.raises(RebuildError):
        rebuild(lost, str(tmp_path / "c.log"))


def test_stream(spark, logfile, tmp_path):
    from almagest.sources.frames import FramedLog, frame
    from almagest.streaming.sink import RecordingStream

    spark.dataSource.register(FramedLog)
    sink = RecordingStream(spark, str(tmp_path / "live"))
    live = tmp_path / "live.log"
    whole = open(logfile, "rb").read() + b"x" * 5000
    live.write_bytes(whole[:2500])  # ends inside a frame
    stream = spark.readStream.format("framedlog").option("maxbytespertrigger", 2000).option("slicebytes", 500).load(str(live))
    q = sink.start(stream, str(tmp_path / "ck"), once=False)
    q.processAllAvailable()
    live.write_bytes(whole)
    q.processAllAvailable()
    q.stop()
    more = whole + frame("TIME", {"week": 2300, "milliseconds": 6.0}, {"utc": "y"})
    live.write_bytes(more)  # behind 5000 bytes of garbage, more than a batch reads, and after a restart
    q = sink.start(stream, str(tmp_path / "ck"), once=False)
    q.processAllAvailable()
    q.stop()
    sink.finish()
    rec = Recording.open(spark, str(tmp_path / "live"))
    assert sorted(r.sequence_id for r in rec.index.collect()) == list(range(43)) and rec.unknown.count() == 1
    assert len(rec.tables["BESTPOS"]) == 40 and len(rec.tables["BESTPOS"].children["obs"]) == 80 and len(rec.tables["TIME"]) == 2
    assert [r.lat for r in rec.tables["BESTPOS"].current.orderBy("sequence_id").collect()] == [m[2]["lat"] for m in MESSAGES[:40]]


def test_command_line(mydb, tmp_path, capsys, spark):
    from almagest.cli import main

    assert main([]) == 0 and main(["nothing"]) == 1
    assert main(["validate-source", mydb, mydb]) == 1 and "metadata_missing" in capsys.readouterr().out
    assert main(["plot", mydb, "--plot", "signal", "imu", "--out", str(tmp_path)]) in (0, 1)
    assert (tmp_path / "mydb.html").exists()
    with pytest.raises(SystemExit):
        main(["convert", "/no/such/file", "-o", "x"])


def test_writer_takes_records_and_finishes_on_a_clean_exit_only(spark, tmp_path):
    from almagest import RecordingWriter

    RecordingWriter.AT_ONCE, before = 10, RecordingWriter.AT_ONCE
    try:
        seen = []
        with RecordingWriter(spark, str(tmp_path / "a"), progress=seen.append, enums={"BESTPOS": {"n": {0: "zero", 1: "one"}}}) as w:
            assert w.consume(MESSAGES[:25]) == 25
            w.write(b"not json")
            w.write(MESSAGES[40])
        rec = Recording.open(spark, str(tmp_path / "a"))
        assert len(rec) == 27 and rec.unknown.count() == 1 and len(rec.tables["TIME"]) == 1 and seen[-1].fraction == 1
        rows = rec.tables["BESTPOS"].current.orderBy("sequence_id").collect()
        assert [(r.n, r.n_raw) for r in rows[:3]] == [("zero", 0), ("one", 1), ("2", 2)] and rows[0].header_milliseconds == 0.0
        with pytest.raises(RuntimeError), RecordingWriter(spark, str(tmp_path / "b")) as w:
            w.write(MESSAGES[0])
            raise RuntimeError
        assert not (tmp_path / "b").exists()
        with pytest.raises(RecordingExistsError):
            RecordingWriter(spark, str(tmp_path / "a")).write_to_db(MESSAGES[:2])
        assert len(Recording.open(spark, RecordingWriter(spark, str(tmp_path / "a"), overwrite=True).write_to_db([]))) == 0
    finally:
        RecordingWriter.AT_ONCE = before


def test_rebuilt_fields():
    from almagest.sources.rebuild import HEADER_FIELDS, header_of, with_raw

    assert with_raw({"a": "x", "a_raw": 3, "b_raw": 1}) == {"a": 3, "b_raw": 1}
    fields = {"header_week": 2300.0, "header_milliseconds": 5, "header_length": 7, "header_time_status": "FINE", "lat": 1.5}
    assert header_of(fields, HEADER_FIELDS) == {"week": 2300, "milliseconds": 5.0, "time_status": "FINE"} and header_of(fields)["length"] == 7


def test_schema_names(spark, tmp_path):
    from almagest import SchemaNames

    put = lambda rows, schema, at: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/r/{at}")
    put([(0, "A"), (1, "A")], "id long, log string", "r.parquet")
    put([(0, 2300, 1.0, 3.5), (1, 2300, 2.0, 4.5)], "id long, wk long, ms double, x double", "A/A.parquet")
    put([(0, 1, 9)], "id long, up long, y int", "A/kid/kid.parquet")
    rec = Recording.open(spark, f"{tmp_path}/r", names=SchemaNames("id", "up", "wk", "ms"))
    a = rec.tables["A"]
    assert ids(a.filter_entries("y", "==", 9, "kid")) == [1] and ids(a.filter_start_time(GpsTime(2300, 0.0015))) == [1] and a.x.max == 4.5


def test_positions(spark):
    rows = [(i, (i * 37 % 50) / 4 if i % 9 else None) for i in range(120)]
    t = LogTable("t", spark.createDataFrame(rows, "sequence_id long, x double"))
    for up in (True, False):
        want = sorted(rows, key=lambda r: (r[1] is None, (r[1] or 0) * (1 if up else -1), r[0]))
        got = {r.sequence_id: r.pos for r in t.sort_by("x", up).positions().collect()}
        assert [got[i] for i, _ in want] == list(range(1, 121))
    assert {r.pos for r in LogTable("t", t.base.limit(0)).positions().collect()} == set()


def test_payloads_with_floats_and_without_encoding(spark):
    import struct

    from almagest.operators.verify import float_offsets

    definition = [("n", "ULONG", 1), ("x", "FLOAT", 1), ("name", "CHAR", 4), ("d", "DOUBLE", 2)]
    assert float_offsets(definition) == [(4, 4), (12, 8)]
    pack = lambda n, x, d: struct.pack("<If4sdd", n, x, b"abcd", d, 1.0)
    one, other = [(0, pack(1, 1.5, 2.0)), (1, pack(1, 1.5, 2.0)), (2, pack(1, 1.5, 2.0)), (3, b"ab"), (4, None)], [(0, pack(1, 1.5, 2.0 + 1e-12)), (1, pack(2, 1.5, 2.5)), (2, pack(1, float("nan"), 2.0)), (3, b"a"), (4, b"x")]
    side = lambda rows, v: spark.createDataFrame([(p, "P", 1, float(p), {"f": v}, None if b is None else bytearray(b)) for p, b in rows], "pos long, log string, week long, milliseconds double, body map<string,string>, payload binary")
    got = {r.pos: (r.status, r.first_byte, [d.field for d in r.found]) for r in payload_differences(side(one, "1.5"), side(other, "1.6"), {"P": definition}).collect()}
    assert got == {0: ("same", None, []), 1: ("different", 0, ["_byte_0", "_float_offset_12"]), 2: ("different", 4, ["_float_offset_4"]), 3: ("different", None, ["_payload_length"]), 4: ("different", None, ["f"])}


def test_stored_tables_and_categories(spark, logfile, tmp_path):
    from almagest.operators.verify import category_counts, stored_differences
    from almagest.report import verify, verify_stored, write_report
    from almagest.sources.writer import convert

    stored = spark.createDataFrame([(3, 1.5, "one", 1, 9), (7, 2.5, "two", 2, 9)], "sequence_id long, x double, kind string, kind_raw long, header_week int")
    decoded = lambda *bodies: spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "pos long, body map<string,string>")
    row = lambda *b: tuple(stored_differences(stored, decoded(*b), "L").first())
    assert row({"x": "1.5", "kind": "1"}, {"x": "2.5", "kind": "2"}) == ("L", 2, 0, "VERIFIED", None)
    assert row({"x": "1.5", "kind": "1"}, {"x": "2.6", "kind": "3"}) == ("L", 2, 2, "MISMATCH", "2 differing fields")
    assert row({"x": "1.5"})[3:] == ("MISMATCH", "2 rows stored, 1 messages")
    assert stored_differences(None, decoded({"x": "1"}), "L").first().status == "NOT_VERIFIED"
    a = sides(spark, [("P", 1, 0.0, {"a": "12345.678", "b": "1.0", "c": "x", "d": "2.0"})])
    b = sides(spark, [("P", 1, 0.0, {"a": "12300.0", "b": "2.0", "c": "y", "d": "2.0"})])
    found = field_differences(a, b)
    assert {(r.category, r.n) for r in category_counts(found).collect()} == {("ascii_rounding", 1), ("large_error", 1), ("non_float", 1)}
    out = convert(spark, logfile, str(tmp_path / "rec"))
    done = verify(spark, out, logfile)
    assert done["field"].categories == [] and done["binary"].overall.mismatched_types == 0
    write_report(done["field"], str(tmp_path / "r.html"), "field")
    assert "VERIFIED" in (tmp_path / "r.html").read_text()
    assert {(r.log, r.status) for r in verify_stored(spark, out, logfile, ["TIME", "NONE"]).collect()} == {("TIME", "VERIFIED"), ("NONE", "NOT_VERIFIED")}


def test_abbreviated_ascii(spark, tmp_path):
    from almagest.sources.frames import ascii_frame, ascii_messages

    (tmp_path / "a.txt").write_bytes(b"#junk<\xff\r\n" + ascii_frame("BESTPOS", ["COM1", 2300, 5.0], ["SOL", '"a b"', 1.5]) + b"<TIME no body\r\n<X" + ascii_frame("TIME", ["COM1"], [1]))
    got = [(r.ordinal, r.log, r.header, r.body) for r in ascii_messages(spark, str(tmp_path / "a.txt")).collect()]
    assert got == [(0, "BESTPOS", ["COM1", "2300", "5.0"], ["SOL", '"a b"', "1.5"]), (1, "TIME", ["COM1"], ["1"])]


def test_plugins(spark, tmp_path):
    import json

    from almagest import SliceError, WriteError
    from almagest.sources.frames import Boundaries
    from almagest.sources.plugins import JsonLines, counted, lines, run, sync_marks, to_csv, to_json

    path = str(tmp_path / "a.jsonl")
    with open(path, "w") as f:
        f.writelines(json.dumps({"k": i, "s": "x" * (i % 13)}) + "\n" for i in range(500))
    rows = run(spark, path, "k long, s string", JsonLines(), lines(path), wanted=7)
    assert sorted(r.k for r in rows.collect()) == list(range(500)) and counted(rows).count() == 7
    run(spark, path, "k long, s string", JsonLines(), lines(path), to_csv(str(tmp_path / "csv")), wanted=3)
    run(spark, path, "k long, s string", JsonLines(), lines(path), to_json(str(tmp_path / "json")), wanted=3)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == spark.read.json(str(tmp_path / "json")).count() == 500
    with pytest.raises(SliceError) as e:  # cut in the middle of lines
        run(spark, path, "k long, s string", JsonLines(), Boundaries(), DataFrameCount, wanted=4)
    assert e.value.byte_range[1] > e.value.byte_range[0]
    with pytest.raises(WriteError):
        run(spark, path, "k long, s string", JsonLines(), lines(path), lambda rows: 1 / 0)
    (tmp_path / "b.bin").write_bytes(b"\xaa\x44\x12abc" * 50)
    assert all((a - 0) % 6 == 0 for a, _ in sync_marks(str(tmp_path / "b.bin")).slices(300, 7))
    (tmp_path / "empty").write_bytes(b"")
    assert run(spark, str(tmp_path / "empty"), "k long", JsonLines()).collect() == []


def DataFrameCount(rows):
    return rows.count()


def test_logging_banners_and_extensions(capsys):
    import io
    import logging

    from almagest import extensions
    from almagest.logs import WIDTH, Coloured, banner, setup

    out = io.StringIO()
    for _ in range(3):
        logger = setup(logging.INFO, out, colour=True)
    logger.warning("once")
    assert sum(isinstance(h.formatter, Coloured) for h in logger.handlers) == 1 and out.getvalue().count("once") == 1 and "\033[33m" in out.getvalue()
    text = banner("convert", input="/very/long" * 30, output="o")
    assert all(len(x) == WIDTH for x in text.splitlines()) and "..." in text
    assert not extensions.enable("no such extension") and extensions.as_gps_time(dt.datetime(1980, 1, 6)) == GpsTime(0, 0.0)
    entered = []

    class Span:
        def __init__(self, name):
            self.name = name

        def __enter__(self):
            entered.append(self.name)

        def __exit__(self, *_):
            return False

    extensions.enable("telemetry", Span)
    extensions.enable("gpstime", lambda x: GpsTime(x, 1.0))
    assert extensions.spanned(lambda: 3)() == 3 and len(entered) == 1 and extensions.as_gps_time(7) == GpsTime(7, 1.0)
    extensions.disable("telemetry"), extensions.disable("gpstime")


def test_command_line_converts_rebuilds_and_plots(spark, logfile, tmp_path, capsys):
    from almagest.cli import dashboard, main

    out = str(tmp_path / "rec")
    assert main(["convert", logfile, "-o", out, "--no-parallel"]) == 0 and main(["convert", logfile, "-o", out]) == 1
    assert main(["reconstruct", out, logfile, "--mode", "field", "--report", str(tmp_path / "r.html")]) == 0 and "VERIFIED" in (tmp_path / "r.html").read_text()
    assert main(["validate-source", logfile, out]) == 0 and "VALID" in capsys.readouterr().out
    rows = [(i, 2300, 1000.0 * i, 51.0 + i / 100, -114.0 - i / 100, 1.0) for i in range(300)]
    pos = spark.createDataFrame(rows, "sequence_id long, header_week long, header_milliseconds double, latitude double, longitude double, latitude_std_dev double")
    index = pos.select("sequence_id", F.lit("BESTPOS").alias("log"))
    page, failed = dashboard(Recording(index, {"BESTPOS": LogTable("BESTPOS", pos)}, None, index), ["position", "imu"], "a <title>", osm=True)
    assert "tile.openstreetmap.org" in page and '<a href="#position">' in page and "&lt;title&gt;" in page and list(failed) == ["imu"]
    assert main(["plot", out, "--plot", "imu", "--out", str(tmp_path), "--no-html"]) in (0, 1)


def test_messages_that_share_a_position_are_told_apart_by_their_ties(spark):
    """Two files' rows arrive in any order, so equal positions do not keep a pair together."""
    schema = "pos long, log string, week long, milliseconds double, line long, body map<string,string>"
    rows = [(n // 4, "A", None, 0.0, n % 4, {"x": str(n)}) for n in range(40)]
    a, b = spark.createDataFrame(rows, schema), spark.createDataFrame(rows[::-1], schema)
    assert field_differences(a, b, ties=["line"]).filter("differs or not matched").count() == 0


def test_lines_that_share_order_number_and_flag_verify_in_any_order(spark, tmp_path):
    """F19 to F26: the lineitem table in several files, whose rows reach the two sides in different orders."""
    import duckdb

    from almagest import registry

    lines = [(k // 12, k % 97, 1 + k % 2, 1.0 + k % 50, round(1000.0 + 37.13 * k, 2), "AR"[k % 4 // 2]) for k in range(2400)]
    schema = "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string"
    frame = spark.createDataFrame(lines, schema)
    frame.orderBy(F.rand(1)).repartition(7).write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    whole = registry.sides(spark, str(tmp_path))
    shuffled = [s.orderBy(F.rand(seed)).localCheckpoint() for seed, s in enumerate(whole)]
    real = registry.sides
    registry.sides = lambda *_: tuple(shuffled)
    try:
        for name in ("verify_fields", "verify_by_log", "verify_some_logs", "verify_promoted", "verify_overall", "verify_category_counts", "verify_explained", "verify_worst_first"):
            found = registry.QUERIES[name](spark, str(tmp_path))
            wanted = c.execute(f"SELECT {', '.join(found.columns)} FROM ({registry.ORACLES[name]})").fetchall()
            assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, wanted)), name
    finally:
        registry.sides = real


def test_lines_of_orders_beyond_exact_doubles_are_told_apart(spark, tmp_path):
    """F21 to F25: neighbouring order keys above 2^53 are one double, and lines of a lost order met those of the next."""
    import duckdb

    from almagest import registry

    lines = [(10**16 + k // 6, 7 * (k % 13) + k % 3, 1 + k % 6, 1.0 + k % 50, round(1000.0 + 37.13 * k, 2), "ANR"[k % 3]) for k in range(900)]
    schema = "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    for name in ("verify_overall", "verify_worst_first", "verify_by_log", "verify_fields", "verify_promoted", "verify_some_logs"):
        found = registry.QUERIES[name](spark, str(tmp_path))
        wanted = c.execute(f"SELECT {', '.join(found.columns)} FROM ({registry.ORACLES[name]})").fetchall()
        assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, wanted)), name


def test_suppliers_kept_as_doubles_are_compared_as_whole_numbers(spark, tmp_path):
    """beyond 1e9 neighbouring suppliers were equal within the tolerance where the table keeps its keys as doubles."""
    import duckdb

    from almagest import registry

    lines = [(1e9 + k // 6, 1e9 + 7 * (k % 13) + k % 7, 1 + k % 6, 1.0 + k % 50, round(1000.0 + 37.13 * k, 2), "ANR"[k % 3]) for k in range(900)]
    schema = "l_orderkey double, l_suppkey double, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    for name in ("verify_worst_first", "verify_by_log", "verify_fields"):
        found = registry.QUERIES[name](spark, str(tmp_path))
        wanted = c.execute(f"SELECT {', '.join(found.columns)} FROM ({registry.ORACLES[name]})").fetchall()
        assert any("supplier" in map(str, w) for w in wanted) or name == "verify_by_log"
        assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, wanted)), name


def test_rebuild_is_made_by_the_executors_range_by_range(spark, logfile, tmp_path, monkeypatch):
    import json

    from almagest.sources import rebuild as r
    from almagest.sources.frames import Frames, _opened
    from almagest.sources.writer import convert

    rec = Recording.open(spark, convert(spark, logfile, str(tmp_path / "rec")))
    on_driver, real = [], r.frame
    monkeypatch.setattr(r, "MESSAGES", 5)
    monkeypatch.setattr(r, "frame", lambda *a: (on_driver.append(1), real(*a))[1])
    assert r.rebuild(rec, str(tmp_path / "b.log")) == 42 and on_driver == []
    with _opened(str(tmp_path / "b.log")) as f:
        payloads = [p for _, p in Frames(f, 0, f.size())]
    assert payloads.pop(6) == b"not json" and [json.loads(p) for p in payloads] == [{"name": n, "header": h, "body": b} for n, h, b in MESSAGES]
    few = Recording(rec.index, rec.tables, rec.unknown.limit(0), rec.whole_index)
    with pytest.raises(RebuildError, match="message 6 "):
        r.rebuild(few, str(tmp_path / "c.log"))
    assert not (tmp_path / "c.log").exists()


def test_small_slices_share_tasks_and_no_message_is_shuffled_to_be_numbered(spark, logfile):
    from almagest.sources.writer import read_messages

    rows = read_messages(spark, logfile, 10)
    assert rows.rdd.getNumPartitions() <= 64 and "Exchange" not in rows._jdf.queryExecution().toString()
    assert [r.sequence_id for r in rows.collect()] == list(range(42))


def test_logs_that_agree_are_verified_without_a_pass_for_each_question(spark, logfile, tmp_path, monkeypatch):
    from almagest import report
    from almagest.sources.writer import convert

    def none(_):
        raise AssertionError

    monkeypatch.setattr(report, "categorised", none)
    found = report.verify(spark, convert(spark, logfile, str(tmp_path / "rec")), logfile)
    assert [(o.overall.messages, o.overall.verified_types, o.worst, o.categories) for o in (found["field"], found["binary"])] == [(41, 2, [], [])] * 2


def test_a_stream_reads_the_last_batch_end_only(spark, tmp_path):
    """The ends of all batches before were read for each batch."""
    import json

    from almagest.streaming.sink import RecordingStream

    (tmp_path / "s" / "_ends").mkdir(parents=True)
    (tmp_path / "s" / "_ends" / "9").write_text("never read")
    (tmp_path / "s" / "_ends" / "10").write_text("42")
    RecordingStream(spark, str(tmp_path / "s")).finish()
    assert json.loads((tmp_path / "s" / "_metadata.json").read_text())["total_message_count"] == 42


def test_nothing_is_read_that_decides_nothing(spark, logfile, tmp_path, monkeypatch):
    """an existing recording is refused, and one without a fingerprint told, before the log is read."""
    from almagest.operators import verify
    from almagest.sources import writer

    done, live = tmp_path / "done", tmp_path / "live"
    for folder, found in ((done, '{"file_size": 1, "sha256": "x"}'), (live, "{}")):
        folder.mkdir()
        (folder / "_metadata.json").write_text(found)

    def never(path):
        raise AssertionError(path)

    monkeypatch.setattr(writer, "source_mark", never)
    monkeypatch.setattr(verify, "file_sha256", never)
    with pytest.raises(RecordingExistsError):
        writer.convert(spark, logfile, str(done))
    assert verify.same_source(str(logfile), str(live)).reason == "metadata_incomplete"
    assert verify.same_source(str(logfile), str(done)).reason == "file_size_mismatch"


def test_a_batch_is_numbered_by_its_offsets_without_a_shuffle(spark):
    """partitions that do not overlap are numbered by their counts, in whatever order they come; others by their offsets."""
    from almagest.streaming.sink import PART_BITS, placed

    def rows(*parts):
        frame = spark.createDataFrame([(k, o) for k, part in enumerate(parts) for o in part], "part int, offset long").repartitionById(len(parts), "part")
        return frame.selectExpr("offset", "cast(offset as string) log", "'{}' header", "'{}' body", "cast(null as binary) payload")

    for parts, shuffled in (([(70, 50, 60), (), (5, 7), (90,)], False), ([(70, 5, 60), (50,), (7, 90)], True)):
        kept = rows(*parts).sortWithinPartitions("offset").withColumn("_at", F.monotonically_increasing_id()).localCheckpoint()
        counts = kept.groupBy(F.shiftright("_at", PART_BITS).alias("part")).agg(F.count("offset").alias("n"), F.min("offset").alias("least"), F.max("offset").alias("most")).collect()
        out = placed(kept, 100, counts)
        assert sorted((r.sequence_id, int(r.log)) for r in out.collect()) == list(enumerate((5, 7, 50, 60, 70, 90), 100))
        assert ("Exchange" in out._jdf.queryExecution().executedPlan().toString()) == shuffled

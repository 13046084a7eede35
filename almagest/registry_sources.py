"""Registered queries that go through files: a recording is written from the driver's tables, its log rebuilt, and that converted, opened, streamed and verified.

Events and orders become messages (an order holds its lines, a pair of numbers and an enumeration); every 20th event is a payload that nothing can decode.
"""

from __future__ import annotations

import atexit
import contextlib
import datetime as dt
import io
import itertools
import json
import re
import shutil
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.functions.gpstime import LEAP_DAYS, GpsTime
from almagest.operators.verify import same_source
from almagest.plans.catalog import METADATA, Files, Recording, shared_folder
from almagest.plans.table import LogTable
from almagest.progress import Progress, Tracker
from almagest.registry import EVENTS, event_log, query, table
from almagest.report import print_summary, verify, verify_stored, write_report
from almagest.sources.frames import UNKNOWN_LOG, FramedLog, ascii_messages
from almagest.sources.plugins import JsonLines, lines, run
from almagest.sources.rebuild import rebuild
from almagest.sources.writer import RecordingWriter, archived, convert, read_messages, write_recording
from almagest.streaming.sink import RecordingStream

STATES = {0: "NONE", 1: "FLOAT", 2: "FIXED"}
ENUMS = {"ORDER": {"state": STATES}}
_MADE: dict[tuple[str, str, str], str] = {}


def made(spark: SparkSession, d: str, what: str, make) -> str:
    """A path that ``make`` has filled, once for each application and input."""
    key = (spark.sparkContext.applicationId, d, what)
    if key not in _MADE:
        root = f"{shared_folder(spark).removeprefix('file://')}/registry-{uuid.uuid4().hex}"
        at = f"{root}/{what}"
        make(at)
        if root.startswith("/"):
            atexit.register(shutil.rmtree, root, ignore_errors=True)
        _MADE[key] = at
    return _MADE[key]


def messages(spark: SparkSession, d: str) -> DataFrame:
    e = event_log(spark, d)
    text = lambda **fields: F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    known = F.col("sequence_id") % 20 != 0
    events = e.select(
        (F.col("sequence_id") * 2).alias("sequence_id"), F.when(known, "EVENT").otherwise(UNKNOWN_LOG).alias("log"),
        F.when(known, text(week=F.col("header_week"), milliseconds=F.col("header_milliseconds"))).alias("header"),
        F.when(known, text(key=F.col("sequence_id"), value=F.col("value"), kind=F.col("log"))).alias("body"),
        F.when(~known, F.concat(F.lit("raw "), F.col("sequence_id").cast("string")).cast("binary")).alias("payload"),
    )
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_quantity"))).alias("ls"))
    o = table(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    held = F.transform(F.coalesce("ls", F.array().cast(li.schema["ls"].dataType)), lambda x: F.struct(x["l_suppkey"].alias("supplier"), x["l_quantity"].alias("quantity")))
    key = F.col("o_orderkey")
    orders = o.select(
        (key * 2 + 1).alias("sequence_id"), F.lit("ORDER").alias("log"), text(week=F.lit(2300), milliseconds=(key % 1000 * 1000).cast("double")).alias("header"),
        text(key=key, price=F.col("o_totalprice"), state=F.col("o_custkey") % 4, lines=held, pair=F.array(key % 7, key % 5)).alias("body"), F.lit(None).cast("binary").alias("payload"),
    )
    return events.unionByName(orders)


def log_file(spark: SparkSession, d: str) -> str:
    def make(at: str) -> None:
        first = at.rsplit("/", 1)[0] + "/first"
        write_recording(messages(spark, d), first, enums=ENUMS)
        rebuild(Recording.open(spark, first), at)

    return made(spark, d, "log.bin", make)


def recording(spark: SparkSession, d: str) -> str:
    return made(spark, d, "second", lambda at: convert(spark, log_file(spark, d), at, enums=ENUMS))


_MESSAGES = f"""(SELECT row_number() OVER (ORDER BY s) - 1 AS sequence_id, log, key FROM (
  SELECT 2 * sequence_id AS s, CASE WHEN sequence_id % 20 = 0 THEN '{UNKNOWN_LOG}' ELSE 'EVENT' END AS log, sequence_id AS key FROM {EVENTS}
  UNION ALL SELECT 2 * o_orderkey + 1, 'ORDER', o_orderkey FROM orders))"""
_STATE = "CASE o_custkey % 4 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in STATES.items()) + " ELSE CAST(o_custkey % 4 AS VARCHAR) END"


@query(f"SELECT sequence_id, log FROM {_MESSAGES}")
def src_index(spark, d):
    return Recording.open(spark, recording(spark, d)).index.select("sequence_id", "log")


@query(f"SELECT sequence_id, key, o_totalprice AS price, {_STATE} AS state, o_custkey % 4 AS state_raw, CAST(2300 AS BIGINT) AS header_week, CAST(o_orderkey % 1000 * 1000 AS DOUBLE) AS header_milliseconds FROM {_MESSAGES} JOIN orders ON key = o_orderkey WHERE log = 'ORDER'")
def src_table(spark, d):
    """Written, rebuilt and converted again: a table with header columns and an enumeration by name and number."""
    return Recording.open(spark, recording(spark, d)).tables["ORDER"].base.select("sequence_id", "key", "price", "state", "state_raw", "header_week", "header_milliseconds")


@query(f"SELECT m.sequence_id AS parent_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_quantity) - 1 AS BIGINT) AS sequence_id, l_suppkey AS supplier, l_quantity AS quantity FROM {_MESSAGES} m JOIN lineitem ON key = l_orderkey WHERE log = 'ORDER'")
def src_child_table(spark, d):
    return Recording.open(spark, recording(spark, d)).subtables.ORDER.subtables.lines.base.select("parent_id", "sequence_id", "supplier", "quantity")


@query(f"SELECT sequence_id AS parent_id, key % 7 AS key_0, key % 5 AS key_1 FROM {_MESSAGES} WHERE log = 'ORDER'")
def src_scalar_list(spark, d):
    return Recording.open(spark, recording(spark, d)).tables["ORDER"].children["pair"].base.select("parent_id", "key_0", "key_1")


@query(f"SELECT log, count(*) AS n, CASE WHEN log = 'EVENT' THEN 'EVENT' ELSE '' END AS tables FROM {_MESSAGES} WHERE log = 'EVENT' GROUP BY log")
def src_selected_logs(spark, d):
    rec = Recording.open(spark, recording(spark, d), logs=["EVENT"])
    return rec.index.groupBy("log").agg(F.count(F.lit(1)).alias("n")).withColumn("tables", F.lit(",".join(rec.tables)))


@query(f"SELECT sequence_id, 'raw ' || key AS payload FROM {_MESSAGES} WHERE log = '{UNKNOWN_LOG}'")
def src_unknown(spark, d):
    return Recording.open(spark, recording(spark, d)).unknown.select("sequence_id", F.col("payload").cast("string").alias("payload"))


@query(f"SELECT m.sequence_id, count(l_orderkey) AS n_lines, round(coalesce(sum(l_quantity), 0), 2) AS quantity FROM {_MESSAGES} m LEFT JOIN lineitem ON key = l_orderkey WHERE log = 'ORDER' GROUP BY m.sequence_id")
def src_entries(spark, d):
    """Nested records: each entry with its children's rows."""
    e = Recording.open(spark, recording(spark, d)).tables["ORDER"].entries()
    held = F.coalesce(F.transform("lines", lambda x: x["quantity"]), F.array().cast("array<double>"))
    return e.select("sequence_id", F.size(held).cast("long").alias("n_lines"), F.round(F.aggregate(held, F.lit(0.0), lambda a, x: a + x), 2).alias("quantity"))


@query(f"SELECT sequence_id, key FROM {_MESSAGES} WHERE log = 'EVENT'")
def src_placed(spark, d):
    """Index rows with their entries, joined by ordinal."""
    return Recording.open(spark, recording(spark, d)).placed("EVENT").select("sequence_id", F.col("entry.key").alias("key"))


@query(f"SELECT sequence_id, row_number() OVER (ORDER BY CASE log WHEN 'EVENT' THEN week WHEN 'ORDER' THEN 2300 END NULLS LAST, CASE log WHEN 'EVENT' THEN ms WHEN 'ORDER' THEN key % 1000 * 1000 END NULLS LAST, sequence_id) AS pos FROM {_MESSAGES} LEFT JOIN (SELECT sequence_id AS id, header_week AS week, header_milliseconds AS ms FROM {EVENTS}) ON id = key")
def sort_recording(spark, d):
    """All messages of a recording by time, those without a log row last."""
    return Recording.open(spark, recording(spark, d)).positions().select("sequence_id", "pos")


@query(f"SELECT sequence_id, log, log <> '{UNKNOWN_LOG}' AS decoded FROM {_MESSAGES}")
def src_frames(spark, d):
    """The rebuilt log, read in slices of 100 kB whose frames are owned by where they start."""
    return read_messages(spark, log_file(spark, d), 100_000).select("sequence_id", "log", F.col("body").isNotNull().alias("decoded"))


def streamed(spark: SparkSession, d: str) -> str:
    def make(at: str) -> None:
        spark.dataSource.register(FramedLog)
        sink = RecordingStream(spark, at)
        stream = spark.readStream.format("framedlog").option("maxbytespertrigger", 4 << 20).option("slicebytes", 1 << 20).load(log_file(spark, d))
        q = sink.start(stream, at + "-checkpoint", once=False)
        q.processAllAvailable()
        q.stop()
        sink.finish()

    return made(spark, d, "streamed", make)


@query(f"SELECT sequence_id, key, value, kind FROM {_MESSAGES} m JOIN (SELECT sequence_id AS id, value, log AS kind FROM {EVENTS}) ON id = key WHERE m.log = 'EVENT'")
def stream_table(spark, d):
    """The log streamed in batches into a recording, ids going on from batch to batch, and that opened."""
    return Recording.open(spark, streamed(spark, d)).tables["EVENT"].base.select("sequence_id", "key", "value", "kind")


@query(f"SELECT log, count(*) AS n FROM {_MESSAGES} GROUP BY log")
def stream_index(spark, d):
    return Recording.open(spark, streamed(spark, d)).index.groupBy("log").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT m.sequence_id AS parent_id, l_suppkey AS supplier, l_quantity AS quantity FROM {_MESSAGES} m JOIN lineitem ON key = l_orderkey WHERE log = 'ORDER'")
def stream_child_table(spark, d):
    return Recording.open(spark, streamed(spark, d)).tables["ORDER"].children["lines"].base.select("parent_id", "supplier", "quantity")


@query(f"SELECT 'streamed' AS recording, count(*) AS messages, false AS fingerprint, '1' AS schema_version FROM {_MESSAGES} UNION ALL SELECT 'converted', count(*), true, '1' FROM {_MESSAGES}")
def src_metadata(spark, d):
    """A streamed recording has no fingerprint of a source."""
    rows = []
    for name, at in (("streamed", streamed(spark, d)), ("converted", recording(spark, d))):
        found = json.loads(Files(spark, at).text(f"{at}/{METADATA}"))
        rows.append((name, found["total_message_count"], "sha256" in found, found["schema_version"]))
    return spark.createDataFrame(rows, "recording string, messages long, fingerprint boolean, schema_version string")


@query(f"SELECT log, count(*) AS n FROM {_MESSAGES} GROUP BY log")
def src_archive(spark, d):
    """An archived recording opens like its folder."""
    at = made(spark, d, "archived", lambda _: archived(recording(spark, d)))
    return Recording.open(spark, f"{recording(spark, d)}.zip" if at else "").index.groupBy("log").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES ('log and recording', true, NULL), ('recording and archive', true, NULL), ('recording and stream', false, 'metadata_incomplete')) AS t(what, valid, reason)")
def validate_sources(spark, d):
    src_archive(spark, d)
    second = recording(spark, d)
    pairs = {"log and recording": (log_file(spark, d), second), "recording and archive": (second, f"{second}.zip"), "recording and stream": (second, streamed(spark, d))}
    rows = [(what, (c := same_source(*p)).valid, c.reason) for what, p in pairs.items()]
    return spark.createDataFrame(rows, "what string, valid boolean, reason string")


@query(f"SELECT mode, log, count(*) AS messages, count(*) AS matched, CAST(0 AS BIGINT) AS diffs, 'VERIFIED' AS status FROM {_MESSAGES}, (VALUES ('field'), ('binary')) AS m(mode) WHERE log <> '{UNKNOWN_LOG}' GROUP BY mode, log")
def verify_recording(spark, d):
    """The recording rebuilt once more and held against the log that it came from, by fields and by bytes."""
    found = verify(spark, recording(spark, d), log_file(spark, d))
    rows = [(mode, r.log, r.messages, r.matched, r.diffs, r.status) for mode, one in found.items() for r in one.per_log]
    return spark.createDataFrame(rows, "mode string, log string, messages long, matched long, diffs long, status string")


@query(f"SELECT log, count(*) AS messages, CAST(0 AS BIGINT) AS diffs, 'VERIFIED' AS status FROM {_MESSAGES} WHERE log = 'EVENT' GROUP BY log UNION ALL SELECT 'NOTHING', 0, 0, 'NOT_VERIFIED'")
def verify_stored_tables(spark, d):
    return verify_stored(spark, recording(spark, d), log_file(spark, d), ["EVENT", "NOTHING"]).select("log", "messages", "diffs", "status")


@query(f"SELECT log, CAST(sequence_id AS VARCHAR) AS id, user_id AS user FROM {EVENTS}")
def src_ascii_messages(spark, d):
    """Two-line messages among other lines."""

    def make(at: str) -> None:
        e = event_log(spark, d).select(F.concat(F.lit("#other <\r\n<"), F.upper("log"), F.lit(" COM1 "), F.col("sequence_id").cast("string"), F.lit("\r\n<     "), F.col("user_id").cast("string"), F.lit(" x\r\n")).alias("value"))
        e.write.option("lineSep", "junk\n").text(at)

    found = ascii_messages(spark, made(spark, d, "ascii", make) + "/*.txt")
    return found.select(F.lower("log").alias("log"), F.col("header")[1].alias("id"), F.col("body")[0].cast("long").alias("user"))


@query("SELECT c_custkey AS key, c_acctbal AS balance FROM customer")
def snk_records(spark, d):
    """Records written one by one through the writer's facade, which finishes on a clean exit."""

    def make(at: str) -> None:
        with RecordingWriter(spark, at) as w:
            w.consume(("CUSTOMER", {"week": 1, "milliseconds": 0.0}, {"key": r.c_custkey, "balance": float(r.c_acctbal)}) for r in table(spark, d, "customer").select("c_custkey", "c_acctbal").toLocalIterator())

    return Recording.open(spark, made(spark, d, "records", make)).tables["CUSTOMER"].base.select("key", "balance")


@query("SELECT s_suppkey AS k, s_acctbal AS b FROM supplier")
def src_plugin(spark, d):
    """Another format through the plug-in seam: lines split behind their ends, JSON processed by slice."""

    def make(at: str) -> None:
        table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("b")).coalesce(1).write.json(at)

    folder = made(spark, d, "json", make)
    path = f"{folder}/{next(n for n in Files(spark, folder).names(folder) if n.endswith('.json'))}"
    return run(spark, path, "k long, b double", JsonLines(), lines(path), wanted=5).select("k", "b")


# What is told about recordings, on the driver


@query(f"""SELECT place, line FROM (SELECT 0 AS place, 'recording: ' || count(*) || ' messages' AS line FROM {_MESSAGES}
UNION ALL SELECT 1, '  EVENT: ' || count(*) || ' entries, 5 fields' FROM {_MESSAGES} WHERE log = 'EVENT'
UNION ALL SELECT 2, '  ORDER: ' || count(*) || ' entries, 6 fields' FROM orders
UNION ALL SELECT 3, '    lines: ' || count(*) || ' entries, 3 fields' FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT 4, '    pair: ' || count(*) || ' entries, 3 fields' FROM orders)""")
def src_tree(spark, d):
    """The tree of tables with the numbers of entries and fields."""
    return spark.createDataFrame(list(enumerate(repr(Recording.open(spark, recording(spark, d))).splitlines())), "place int, line string")


_LEAP = " + ".join(f"CAST(o_orderdate >= DATE '{day}' AS BIGINT)" for day in LEAP_DAYS)
_SINCE = f"(epoch(o_orderdate::TIMESTAMP) - epoch(TIMESTAMP '1980-01-06') + {_LEAP})"


@query(f"SELECT DISTINCT CAST(epoch(o_orderdate::TIMESTAMP) AS BIGINT) AS unix, CAST(floor({_SINCE} / 604800) AS BIGINT) AS week, CAST({_SINCE} % 604800 AS DOUBLE) AS seconds FROM orders")
def gpstime_of(spark, d):
    """Datetimes as weeks and seconds; a time of either kind is taken."""
    days = [r.day for r in table(spark, d, "orders").select(F.col("o_orderdate").cast("timestamp_ntz").alias("day")).distinct().collect()]  # a row for each day of the calendar
    times = [(int(day.replace(tzinfo=dt.timezone.utc).timestamp()), GpsTime.of(GpsTime.of(day))) for day in days]
    return spark.createDataFrame([(unix, t.week, float(t.seconds)) for unix, t in times], "unix long, week long, seconds double")


@query("SELECT * FROM (VALUES ('decode', 0.0::DOUBLE), ('A', 50.0), ('B', 100.0)) AS t(phase, percent)")
def snk_progress(spark, d):
    """What a caller hears of a writer's progress; one that fails is passed over."""
    seen = []

    def broken(_: Progress) -> None:
        raise RuntimeError

    rows = messages(spark, d).filter("log = 'EVENT'").withColumn("log", F.when(F.col("sequence_id") % 4 == 0, "A").otherwise("B"))
    write_recording(rows, f"{shared_folder(spark).removeprefix('file://')}/progress-{uuid.uuid4().hex}", tracker=Tracker(broken, lambda p: seen.append((p.phase, float(p.percent))), clock=itertools.count().__next__))
    return spark.createDataFrame(seen, "phase string, percent double")


@query("""SELECT * FROM (VALUES ('exists', 'RecordingExistsError'), ('no recording', 'InvalidRecordingError'), ('no log', 'FieldNotFoundError'), ('lost rows', 'RebuildError'), ('slice', 'SliceError'), ('sink', 'WriteError'), ('no file', 'TypeError')) AS t(what, error)""")
def errors_raised(spark, d):
    at = recording(spark, d)
    rec = Recording.open(spark, at)
    root = at.rsplit("/", 1)[0]
    folder = made(spark, d, "numbers", lambda p: spark.range(9).select(F.col("id").cast("string")).coalesce(1).write.text(p))
    path = f"{folder}/{next(n for n in Files(spark, folder).names(folder) if n.endswith('.txt'))}"
    tries = {
        "exists": lambda: convert(spark, log_file(spark, d), at),
        "no recording": lambda: Recording.open(spark, root),
        "no log": lambda: rec.filter_by_log("NOTHING"),
        "lost rows": lambda: rebuild(Recording(rec.index, {"EVENT": rec.tables["EVENT"]}, rec.unknown, rec.whole_index), f"{root}/lost.bin"),
        "slice": lambda: run(spark, path, "k long", JsonLines(), lines(path), lambda rows: rows.count()),
        "sink": lambda: run(spark, path, "k long", JsonLines(), lines(path), lambda rows: rows.nothing()),
        "no file": lambda: convert(spark, [1, 2], f"{root}/none"),
    }
    rows = []
    for what, act in tries.items():
        try:
            act()
        except Exception as e:
            rows.append((what, type(e).__name__))
    return spark.createDataFrame(rows, "what string, error string")


@query("""SELECT * FROM (VALUES ('usage', 0), ('unknown', 1), ('validate-source', 0), ('validate_source, other', 1), ('convert again', 1)) AS t(command, code)""")
def command_line(spark, d):
    """Exit codes."""
    from almagest.cli import main

    log = log_file(spark, d)
    with ThreadPoolExecutor() as pool:  # both are made of the log alone
        at, other = pool.map(lambda make: make(spark, d), (recording, streamed))
    runs = {"usage": [], "unknown": ["nothing"], "validate-source": ["validate-source", log, at], "validate_source, other": ["validate_source", log, other], "convert again": ["convert", log, "-o", at]}
    with contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
        codes = [(name, main(args)) for name, args in runs.items()]
    return spark.createDataFrame(codes, "command string, code int")


@query(f"SELECT log, 'VERIFIED' AS status, CAST(count(*) AS VARCHAR) AS messages FROM {_MESSAGES} WHERE log <> '{UNKNOWN_LOG}' GROUP BY log")
def report_page(spark, d):
    """The rows by log of the verification's page, read back from its HTML."""
    found = verify(spark, recording(spark, d), log_file(spark, d), "field")["field"]
    with tempfile.NamedTemporaryFile("r", suffix=".html") as f:
        write_report(found, f.name, "field")
        page = f.read()
    with contextlib.redirect_stdout(io.StringIO()) as console:
        print_summary(found, "field")
    table_of = page[page.index("By log") :].split("</details>")[0]
    rows = [re.sub("<[^>]*>", "|", x).strip("|") for x in re.findall(r"<tr><td>.*?</tr>", table_of)]
    cells = [[c for c in r.split("|") if c] for r in rows]
    told = [(c[0], c[4], c[1]) for c in cells if f"{c[0]}: {c[4]}, {c[2]} of {c[1]} matched" in console.getvalue()]
    return spark.createDataFrame(told, "log string, status string, messages string")


@query("SELECT * FROM (VALUES ('accuracy'), ('imu'), ('position')) AS t(tab)")
def dashboard_tabs(spark, d):
    """The tabs of a page of views; views that fail or lack their log have none."""
    from almagest.cli import dashboard

    c = table(spark, d, "customer").select(F.col("c_custkey").alias("sequence_id"), (F.col("c_custkey") * 10.0).alias("header_milliseconds"), F.lit(51.0).alias("latitude"), F.lit(-114.0).alias("longitude"), *[F.col("c_acctbal").alias(f"{n}_std_dev") for n in ("latitude", "longitude", "height")])
    imu = c.select("sequence_id", "header_milliseconds", F.col("latitude").alias("accel_x"))
    index = c.select("sequence_id", F.lit("BESTPOS").alias("log"))
    rec = Recording(index, {"BESTPOS": LogTable("BESTPOS", c), "RAWIMU": LogTable("RAWIMU", imu), "INSSTDEV": LogTable("INSSTDEV", imu)}, None, index)
    page, failed = dashboard(rec, ["position", "accuracy", "signal", "imu", "attitude_accuracy"], "views")
    return spark.createDataFrame([(t,) for t in re.findall(r'<section id="([^"]*)">', page) if t not in failed], "tab string")

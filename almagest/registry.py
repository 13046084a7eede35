"""Registered queries over the driver's tables and the SQL that each is held against.

Roles of the tables: events are an index (event_type is the log) and a log table with GPS time; orders and lineitem are parent and child
(supplier as satellite, quantity as signal); customer, orders and lineitem are three levels.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.functions import codes
from almagest.functions.aggregates import OPERATIONS, aggregated, described
from almagest.functions.gpstime import LEAP_DAYS, GpsTime, gps_milliseconds, gps_week
from almagest.functions.rounding import relative_error
from almagest.operators import views
from almagest.operators.joins import Key, kth_occurrence, nearest, positions, running_ordinal, with_log_ordinal
from almagest.operators.shred import assemble, shred, union_promoted, with_offsets
from almagest.operators import verify as v
from almagest.plans.catalog import Recording
from almagest.plans.table import LogTable, compared, database_positions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str, name: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name or fn.__name__] = fn
        ORACLES[name or fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parents(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("sequence_id"), F.col("o_custkey").alias("parent_id"), (F.col("o_orderkey") % 1000 * 1000.0).alias("header_milliseconds"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))


def children(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.monotonically_increasing_id().alias("sequence_id"), F.col("l_orderkey").alias("parent_id"), F.col("l_suppkey").alias("sv_prn"), F.col("l_quantity").alias("C_No"), F.col("l_discount").alias("sd_psr"), F.col("l_tax").alias("sd_adr"), (F.col("l_linenumber").cast("long") * 65536).alias("c_status"))


def order_table(spark: SparkSession, d: str) -> LogTable:
    return LogTable("orders", parents(spark, d), {"obs": LogTable("obs", children(spark, d))})


def customer_table(spark: SparkSession, d: str) -> LogTable:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("sequence_id"), F.col("c_acctbal").alias("balance"))
    return LogTable("customer", c, {"orders": order_table(spark, d)})


def event_log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("sequence_id"), F.col("event_type").alias("log"), "user_id", "value", gps_week(F.col("ts")).alias("header_week"), gps_milliseconds(F.col("ts")).alias("header_milliseconds"))


GPS_US = "(epoch_us(ts) - epoch_us(TIMESTAMP '1980-01-06') + 18000000)"
EVENTS = f"(SELECT event_id AS sequence_id, event_type AS log, user_id, value, CAST({GPS_US} // 604800000000 AS BIGINT) AS header_week, ({GPS_US} % 604800000000) / 1000.0 AS header_milliseconds FROM events)"
PARENTS = "(SELECT o_orderkey AS sequence_id, o_custkey AS parent_id, o_orderkey % 1000 * 1000.0::DOUBLE AS header_milliseconds, o_totalprice AS price FROM orders)"
OBS = "(SELECT l_orderkey AS parent_id, l_suppkey AS sv_prn, l_quantity AS C_No, l_discount AS sd_psr, l_tax AS sd_adr, CAST(l_linenumber AS BIGINT) * 65536 AS c_status FROM lineitem)"
JOINED = f"(SELECT o.*, p.header_milliseconds, p.header_milliseconds / 1000.0 AS time_s FROM {OBS} o JOIN {PARENTS} p ON o.parent_id = p.sequence_id)"
SYSTEM = "CASE (c_status >> 16) & 7 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in codes.CHANNEL_SYSTEMS.items()) + " ELSE 'Unknown(' || ((c_status >> 16) & 7) || ')' END"
SQL_OPS = {"mean": "avg({0})", "median": "median({0})", "min": "min({0})", "max": "max({0})", "sum": "coalesce(sum({0}), 0)", "std": "stddev_samp({0})", "rms": "sqrt(avg({0} * {0}))"}


def r(col: str, places: int = 6) -> object:
    return F.round(F.col(col).cast("double"), places).alias(col)


# Filters


@query("SELECT event_id AS sequence_id, event_type AS log FROM events WHERE event_type = 'click'")
def flt_by_log(spark, d):
    index = event_log(spark, d).select("sequence_id", "log")
    return Recording(index, {}, None, index).filter_by_log("click").index


for _name, _op, _sql in (("eq", "==", "= 5"), ("ne", "!=", "IS DISTINCT FROM 5"), ("lt", "<", "< 5"), ("le", "<=", "<= 5"), ("gt", ">", "> 5"), ("ge", ">=", ">= 5")):
    query(f"SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity {_sql}", f"flt_cmp_{_name}")(lambda spark, d, _op=_op: table(spark, d, "lineitem").select("l_orderkey", "l_quantity").filter(compared(F.col("l_quantity"), _op, 5)))


@query("SELECT o_orderkey AS sequence_id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 48)")
def flt_child_semi(spark, d):
    return order_table(spark, d).filter_entries("C_No", ">", 48, "obs").current.select("sequence_id")


@query("SELECT c_custkey AS sequence_id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49))")
def flt_child_path(spark, d):
    return customer_table(spark, d).filter_entries("C_No", ">", 49, ("orders", "obs")).current.select("sequence_id")


for _op in OPERATIONS:
    query(f"SELECT o_orderkey AS sequence_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING {SQL_OPS[_op].format('l_quantity')} > 20.25)", f"flt_child_having_{_op}")(
        lambda spark, d, _op=_op: order_table(spark, d).filter_entries("C_No", ">", 20.25, "obs", _op).current.select("sequence_id")
    )


@query("SELECT l_orderkey AS parent_id, l_quantity AS C_No FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_totalprice > 200000")
def flt_cascade_down(spark, d):
    return order_table(spark, d).filter_entries("price", ">", 200000).children["obs"].current.select("parent_id", "C_No")


_START, _END = GpsTime(2296, 100_000.0), GpsTime(2297, 300_000.5)
_FROM = f"(header_week > {_START.week} OR header_week = {_START.week} AND header_milliseconds >= {_START.milliseconds})"
_TO = f"(header_week < {_END.week} OR header_week = {_END.week} AND header_milliseconds <= {_END.milliseconds})"


def _times(spark: SparkSession, d: str) -> LogTable:
    return LogTable("events", event_log(spark, d))


query(f"SELECT sequence_id FROM {EVENTS} WHERE {_FROM}", "flt_time_start")(lambda spark, d: _times(spark, d).filter_start_time(_START).current.select("sequence_id"))
query(f"SELECT sequence_id FROM {EVENTS} WHERE {_TO}", "flt_time_end")(lambda spark, d: _times(spark, d).filter_end_time(_END).current.select("sequence_id"))
query(f"SELECT sequence_id FROM {EVENTS} WHERE {_FROM} AND {_TO}", "flt_time_range")(lambda spark, d: _times(spark, d).filter_time_range(_START, _END).current.select("sequence_id"))
query(f"SELECT header_milliseconds, sv_prn, max(C_No) AS C_No FROM {JOINED} WHERE sv_prn IN (1, 3, 7) GROUP BY 1, 2, c_status", "flt_prn_isin")(lambda spark, d: views.satellite_series(views.observations(parents(spark, d), children(spark, d)), [1, 3, 7]).select("header_milliseconds", "sv_prn", "C_No"))


@query("SELECT l_orderkey AS parent_id, l_quantity AS C_No FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_totalprice > 200000")
def flt_reset_child(spark, d):
    """A child's reset keeps its parent's restriction."""
    kids = order_table(spark, d).filter_entries("price", ">", 200000).children["obs"]
    return kids.filter_entries("C_No", ">", 30).reset_filters().current.select("parent_id", "C_No")


@query("SELECT o_orderkey AS sequence_id FROM orders")
def flt_reset(spark, d):
    return order_table(spark, d).filter_entries("price", ">", 200000).filter_entries("C_No", ">", 48, "obs").reset_filters().current.select("sequence_id")


@query("SELECT o_orderkey AS sequence_id FROM orders WHERE o_totalprice % 7 < 3 OR o_orderstatus = 'F'")
def flt_mask(spark, d):
    return order_table(spark, d).apply_filter_mask((F.col("price") % 7 < 3) | (F.col("status") == "F")).current.select("sequence_id")


@query("SELECT o_orderkey AS sequence_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 10 GROUP BY l_orderkey HAVING avg(l_quantity) > 40.25)")
def flt_having_current(spark, d):
    """With ``use_current`` an aggregate sees the child rows of the view only."""
    table = order_table(spark, d)
    kept = LogTable(table.name, table.base, {"obs": table.children["obs"].filter_entries("C_No", ">", 10)})
    return kept.filter_entries("C_No", ">", 40.25, "obs", "mean", use_current=True).current.select("sequence_id")


@query("SELECT o_orderkey AS sequence_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING max(l_quantity) - min(l_quantity) > 40)")
def flt_having_callable(spark, d):
    return order_table(spark, d).filter_entries("C_No", ">", 40, "obs", lambda x: x.max() - x.min()).current.select("sequence_id")


@query("SELECT what, replace(message, chr(34), chr(39)) AS message FROM (VALUES ('missing', 'orders has no field \"nothing\"'), ('in a child', 'orders has no field \"C_No\"; its child table \"obs\" has'), ('no time', 'orders has no time columns'), ('no child', 'orders has no child table \"kids\"')) AS t(what, message)")
def flt_missing_fields(spark, d):
    """What the errors of missing fields, times and children say."""
    from almagest.errors import FieldNotFoundError

    t = order_table(spark, d)
    tries = {"missing": lambda: t.filter_entries("nothing", ">", 1), "in a child": lambda: t.filter_entries("C_No", ">", 1), "no time": lambda: t.filter_start_time(_START), "no child": lambda: t.filter_entries("x", ">", 1, "kids")}
    found = []
    for what, act in tries.items():
        try:
            act()
        except FieldNotFoundError as e:
            found.append((what, e.args[0]))
    return spark.createDataFrame(found, "what string, message string")


# Aggregates

for _op in OPERATIONS:
    query(f"SELECT round(CAST({SQL_OPS[_op].format('l_extendedprice')} AS DOUBLE), 2) AS value FROM lineitem", f"agg_{_op}")(lambda spark, d, _op=_op: aggregated(table(spark, d, "lineitem"), "l_extendedprice", _op).select(r("value", 2)))
    query(f"SELECT l_orderkey AS parent_id, round(CAST({SQL_OPS[_op].format('l_quantity')} AS DOUBLE), 6) AS value FROM lineitem GROUP BY l_orderkey", f"agg_grouped_{_op}")(lambda spark, d, _op=_op: aggregated(children(spark, d), "C_No", _op, "parent_id").select("parent_id", r("value")))


@query("SELECT count(l_quantity) AS count, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS min, quantile_cont(l_quantity, 0.25) AS p25, quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.75) AS p75, max(l_quantity) AS max FROM lineitem")
def agg_describe(spark, d):
    return described(table(spark, d, "lineitem"), "l_quantity").select("count", r("mean"), r("std"), "min", "p25", "p50", "p75", "max")


@query("WITH c AS (SELECT event_type AS v, count(*) AS n FROM events GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS count, count(v) AS unique, arg_max(v, n) AS top, max(n) AS freq FROM c")
def agg_describe_text(spark, d):
    return described(table(spark, d, "events"), "event_type")


# Joins


@query(f"SELECT parent_id, sv_prn, C_No, header_milliseconds, time_s FROM {JOINED}")
def join_parent_child(spark, d):
    return views.observations(parents(spark, d), children(spark, d)).select("parent_id", "sv_prn", "C_No", "header_milliseconds", "time_s")


@query("SELECT c_custkey AS customer, o_orderkey AS o, l_quantity AS C_No FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey")
def join_chain3(spark, d):
    top = table(spark, d, "customer").select(F.col("c_custkey").alias("sequence_id"), F.col("c_custkey").cast("double").alias("header_milliseconds"))
    seen = parents(spark, d).select("sequence_id", "parent_id", F.col("price").alias("elevation"))
    ids = children(spark, d).select("sequence_id", "parent_id", F.col("parent_id").alias("o"), "C_No")
    return views.sky_positions(top, seen, ids).select(F.col("header_milliseconds").cast("long").alias("customer"), "o", "C_No")


_NEAR = f"""
WITH l AS (SELECT sequence_id, user_id, header_milliseconds + header_week * 604800000.0 AS t FROM {EVENTS} WHERE log = 'click'),
r AS (SELECT user_id, header_milliseconds + header_week * 604800000.0 AS t, value FROM {EVENTS} WHERE log = 'purchase'),
b AS (SELECT l.*, r.t AS bt, r.value AS bv FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t >= r.t),
f AS (SELECT l.sequence_id, r.t AS ft, r.value AS fv FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t <= r.t)
SELECT b.sequence_id, CASE WHEN bt IS NOT NULL AND (ft IS NULL OR t - bt <= ft - t) THEN CASE WHEN t - bt <= 3600000 THEN bv END WHEN ft - t <= 3600000 THEN fv END AS value FROM b JOIN f USING (sequence_id)"""


@query(_NEAR)
def join_asof_nearest(spark, d):
    e = event_log(spark, d).withColumn("t", F.col("header_milliseconds") + F.col("header_week") * 604800000.0)
    clicks = e.filter("log = 'click'").select("sequence_id", "user_id", "t")
    return nearest(clicks, e.filter("log = 'purchase'").select("user_id", "t", "value"), "t", ["user_id"], ["value"], 3_600_000).select("sequence_id", "value")


@query("""WITH e AS (SELECT event_id, event_type, CASE WHEN user_id % 5 > 0 THEN user_id END AS k FROM events),
a AS (SELECT event_id, k, row_number() OVER (PARTITION BY k ORDER BY event_id) AS n FROM e WHERE event_type = 'click'),
b AS (SELECT event_id, k, row_number() OVER (PARTITION BY k ORDER BY event_id) AS n FROM e WHERE event_type = 'purchase')
SELECT a.event_id AS pos, b.event_id AS other FROM a LEFT JOIN b ON a.k IS NOT DISTINCT FROM b.k AND a.n = b.n""")
def join_kth_occurrence(spark, d):
    """Null keys are equal."""
    e = event_log(spark, d).select(F.col("sequence_id").alias("pos"), F.when(F.col("user_id") % 5 > 0, F.col("user_id")).alias("key"), "log")
    return kth_occurrence(e.filter("log = 'click'"), e.filter("log = 'purchase'"), ["key"], "pos").select(F.col("l.pos").alias("pos"), F.col("r.pos").alias("other"))


@query("SELECT event_id AS sequence_id, event_type AS log, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS ordinal FROM events WHERE event_id % 10 <> 0")
def join_index_log(spark, d):
    e = event_log(spark, d)
    return with_log_ordinal(e.select("sequence_id", "log"), e.filter("sequence_id % 10 = 0")).select("sequence_id", "log", F.col("ordinal").cast("long").alias("ordinal"))


# Shredding and assembly


@query("SELECT o_orderkey AS sequence_id, (SELECT string_agg(l_quantity::BIGINT, ',' ORDER BY l_quantity) FROM lineitem WHERE l_orderkey = o_orderkey) AS quantities FROM orders")
def assemble_nested(spark, d):
    kids = children(spark, d).select(F.col("C_No").cast("long").alias("q"), "parent_id")
    out = assemble(parents(spark, d).select("sequence_id"), {"obs": (kids, {})})
    return out.select("sequence_id", F.when(F.col("obs").isNotNull(), F.array_join(F.transform("obs", lambda o: o["q"].cast("string")), ",")).alias("quantities"))


@query("SELECT vec_id AS parent_id, CAST(0 AS BIGINT) AS sequence_id, len(embedding) AS width, array_to_string(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT)), ',') AS keys FROM embeddings")
def shred_list_scalar(spark, d):
    """All elements, each in a column of its own."""
    tree = shred(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id").children["embedding"].table
    keys = [c for c in tree.columns if c.startswith("key_")]
    return tree.select("parent_id", "sequence_id", F.lit(len(keys)).cast("long").alias("width"), F.concat_ws(",", *[F.round(F.col(k).cast("double") * 1000000).cast("long") for k in keys]).alias("keys"))


@query("SELECT event_id AS parent_id, CAST(0 AS BIGINT) AS sequence_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def shred_struct(spark, d):
    e = table(spark, d, "events").select("event_id", F.from_json("props", "k bigint").alias("props"))
    return shred(e, "event_id").children["props"].table.select("parent_id", "sequence_id", "k")


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS ordinal FROM events")
def seq_ids_running(spark, d):
    return running_ordinal(table(spark, d, "events").select("event_id"), ["event_id"], "event_id", width=1000)


@query("SELECT event_id AS parent_id, CAST(p AS BIGINT) AS sequence_id, p * 10 AS x FROM events, unnest([0, 1, 2]) AS u(p) WHERE event_id % 3 <> 0")
def seq_ids_leaf(spark, d):
    kids = F.when(F.col("event_id") % 3 != 0, F.array(*[F.struct(F.lit(i * 10).alias("x")) for i in range(3)])).otherwise(F.array().cast("array<struct<x:int>>"))
    return shred(table(spark, d, "events").select("event_id", kids.alias("obs")), "event_id").children["obs"].table.select("parent_id", "sequence_id", "x")


@query("SELECT event_id + 5 AS sequence_id, user_id + 10 AS parent_id FROM events")
def merge_offsets(spark, d):
    return with_offsets(table(spark, d, "events").select(F.col("event_id").alias("sequence_id"), F.col("user_id").alias("parent_id")), 5, 10, leaf=False)


@query("SELECT event_id, CAST(user_id AS DOUBLE) AS v, NULL::VARCHAR AS w FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, value, event_type FROM events WHERE event_id % 2 = 1")
def union_promote(spark, d):
    e = table(spark, d, "events")
    return union_promoted([e.filter("event_id % 2 = 0").select("event_id", F.col("user_id").alias("v")), e.filter("event_id % 2 = 1").select("event_id", F.col("value").alias("v"), F.col("event_type").alias("w"))])


@query("SELECT DISTINCT user_id, event_type FROM events")
def distinct_pairs(spark, d):
    return table(spark, d, "events").select("user_id", "event_type").distinct()


# Order and time


for _name, _up, _sql in (("sort_by_field", True, "value NULLS LAST"), ("sort_by_field_desc", False, "value DESC NULLS LAST")):
    query(f"SELECT sequence_id, row_number() OVER (ORDER BY {_sql}, sequence_id) AS pos FROM {EVENTS}", _name)(lambda spark, d, _up=_up: _times(spark, d).sort_by("value", _up).positions().select("sequence_id", "pos"))
for _name, _up, _sql in (("sort_by_time", True, "header_week, header_milliseconds"), ("sort_by_time_desc", False, "header_week DESC, header_milliseconds DESC")):
    query(f"SELECT sequence_id, row_number() OVER (ORDER BY {_sql}, sequence_id) AS pos FROM {EVENTS} WHERE user_id % 3 = 0", _name)(lambda spark, d, _up=_up: _times(spark, d).apply_filter_mask(F.col("user_id") % 3 == 0).sort_by_time(_up).positions().select("sequence_id", "pos"))


@query(f"SELECT sequence_id, row_number() OVER (ORDER BY CASE WHEN log <> 'view' THEN header_week END NULLS LAST, CASE WHEN log <> 'view' THEN header_milliseconds END NULLS LAST, sequence_id) AS pos FROM {EVENTS}")
def sort_db_time(spark, d):
    """Messages without a log row (here views) come last."""
    e = event_log(spark, d)
    return database_positions(e.select("sequence_id", "log"), {"a": e.filter("log = 'click'"), "b": e.filter("log not in ('click', 'view')")}).select("sequence_id", "pos")


@query(f"SELECT log, first(header_week ORDER BY header_week, header_milliseconds) AS first_week, first(header_milliseconds ORDER BY header_week, header_milliseconds) AS first_ms, last(header_week ORDER BY header_week, header_milliseconds) AS last_week, last(header_milliseconds ORDER BY header_week, header_milliseconds) AS last_ms FROM {EVENTS} GROUP BY log")
def time_range(spark, d):
    e = event_log(spark, d)
    logs = [r.log for r in e.select("log").distinct().collect()]  # a row for each log type
    ends = {log: LogTable(log, e.filter(F.col("log") == log)).time_range for log in logs}
    return spark.createDataFrame([(log, a.week, float(a.milliseconds), z.week, float(z.milliseconds)) for log, (a, z) in ends.items()], "log string, first_week long, first_ms double, last_week long, last_ms double")


@query("SELECT l_orderkey AS parent_id, round(avg(l_quantity), 6) AS mean, round(median(l_quantity), 6) AS median, max(l_quantity) AS max FROM lineitem GROUP BY l_orderkey")
def agg_handles(spark, d):
    """Summaries by a table's field handles, found in its child table."""
    kids = order_table(spark, d).children["obs"]
    parts = [getattr(kids.C_No, f"grouped_{op}").withColumnRenamed("value", op) for op in ("mean", "median", "max")]
    return parts[0].join(parts[1], "parent_id").join(parts[2], "parent_id").select("parent_id", r("mean"), r("median"), "max")


@query("SELECT round(avg(l_quantity), 6) AS own, round(avg(l_tax), 6) AS deep, count(*) AS rows, 'balance,orders' AS fields, 'sequence_id,balance,sequence_id,parent_id,header_milliseconds,price,status,sequence_id,parent_id,sv_prn,C_No,sd_psr,sd_adr,c_status' AS columns, 'unknown operation' AS refused FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def agg_resolved(spark, d):
    """A field that a child's child holds is found from the top; columns of the whole subtree; an unknown operation is refused."""
    top = customer_table(spark, d)
    try:
        top.summary("C_No", "mode")
        refused = None
    except ValueError as e:
        refused = str(e)[:17]
    kids = top.children["orders"].children["obs"]
    return spark.createDataFrame([(round(top.get_mean("C_No"), 6), round(top.get_mean("sd_adr"), 6), len(kids), ",".join([*top.fields, *top.subtables]), ",".join(top.get_columns()), refused)], "own double, deep double, rows long, fields string, columns string, refused string")


@query(f"SELECT sequence_id, header_week, header_milliseconds FROM {EVENTS}")
def gpstime_convert(spark, d):
    return event_log(spark, d).select("sequence_id", "header_week", "header_milliseconds")


_LEAPS = " + ".join(f"CAST(o_orderdate >= DATE '{day}' AS BIGINT)" for day in LEAP_DAYS)


@query(f"SELECT o_orderkey, floor((epoch(o_orderdate::TIMESTAMP) - epoch(TIMESTAMP '1980-01-06') + {_LEAPS}) / 604800) AS week, ((epoch(o_orderdate::TIMESTAMP) - epoch(TIMESTAMP '1980-01-06') + {_LEAPS}) % 604800) * 1000.0 AS ms FROM orders")
def gpstime_leaps(spark, d):
    """Dates from 1992 on, before and after several leap seconds."""
    day = F.col("o_orderdate").cast("timestamp_ntz")
    return table(spark, d, "orders").select("o_orderkey", gps_week(day).cast("double").alias("week"), gps_milliseconds(day).alias("ms"))


# Views


@query(f"SELECT sv_prn, round(avg(C_No), 6) AS mean_cn0, round(stddev_samp(C_No), 6) AS std_cn0, CASE WHEN avg(C_No) < 20 THEN 'poor' WHEN avg(C_No) < 30 THEN 'warning' WHEN avg(C_No) <= 60 THEN 'good' ELSE 'suspicious' END AS band FROM {JOINED} GROUP BY sv_prn")
def view_signal_prn(spark, d):
    return views.signal_by_satellite(views.observations(parents(spark, d), children(spark, d))).select("sv_prn", r("mean_cn0"), r("std_cn0"), "band")


@query(f"SELECT time_s, count(DISTINCT sv_prn) AS satellites FROM {JOINED} GROUP BY time_s")
def view_signal_epoch(spark, d):
    return views.satellites_by_epoch(views.observations(parents(spark, d), children(spark, d)))


@query(f"SELECT time_s, count(DISTINCT sv_prn) AS satellites, count(*) AS signals FROM {JOINED} GROUP BY time_s")
def view_tracking_total(spark, d):
    return views.tracking_counts(views.observations(parents(spark, d), children(spark, d)), False)


@query(f"SELECT time_s, {SYSTEM} AS system, count(DISTINCT sv_prn) AS satellites, count(*) AS signals FROM {JOINED} GROUP BY 1, 2")
def view_tracking_const(spark, d):
    return views.tracking_counts(views.observations(parents(spark, d), children(spark, d)), True)


@query(f"SELECT header_milliseconds, sv_prn, CAST((c_status >> 16) & 7 AS INTEGER) AS sys_id, max(C_No) AS C_No, round(avg(sd_psr), 6) AS sd_psr, round(avg(sd_adr), 6) AS sd_adr FROM {JOINED} GROUP BY 1, 2, 3")
def view_satstats(spark, d):
    return views.satellite_series(views.observations(parents(spark, d), children(spark, d))).select("header_milliseconds", "sv_prn", "sys_id", "C_No", r("sd_psr"), r("sd_adr"))


_SKY = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in codes.SKY_SYSTEMS.items())
_LETTER = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in codes.SKY_PREFIXES.items())
_SKIES = f"""(SELECT CAST(c_custkey AS DOUBLE) * 1000 AS header_milliseconds, l_suppkey AS prn, CAST(l_linenumber % 9 AS VARCHAR) AS system_type, o_totalprice / 8000 AS elevation, o_orderkey % 360 AS azimuth,
  90 - o_totalprice / 8000 AS radius, round(radians(o_orderkey % 360), 9) AS theta, coalesce(CASE CAST(l_linenumber % 9 AS VARCHAR) {_SKY} END, CAST(l_linenumber % 9 AS VARCHAR)) AS system,
  coalesce(CASE CAST(l_linenumber % 9 AS VARCHAR) {_LETTER} END, '?') || substr(lpad(CAST(l_suppkey AS VARCHAR), 2, '0'), 1, 2) AS label
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def skies(spark: SparkSession, d: str) -> DataFrame:
    """Customers as epochs, orders as what is visible, lines as satellites."""
    top = table(spark, d, "customer").select(F.col("c_custkey").alias("sequence_id"), (F.col("c_custkey") * 1000.0).alias("header_milliseconds"))
    seen = table(spark, d, "orders").select(F.col("o_orderkey").alias("sequence_id"), F.col("o_custkey").alias("parent_id"), (F.col("o_totalprice") / 8000).alias("elevation"), (F.col("o_orderkey") % 360).cast("double").alias("azimuth"))
    ids = table(spark, d, "lineitem").select(F.monotonically_increasing_id().alias("sequence_id"), F.col("l_orderkey").alias("parent_id"), F.col("l_suppkey").alias("prn"), (F.col("l_linenumber") % 9).cast("string").alias("system_type"))
    return views.sky_track(views.sky_positions(top, seen, ids))


@query(f"SELECT header_milliseconds, prn, radius, theta, system, label FROM {_SKIES}")
def view_skyview(spark, d):
    return skies(spark, d).select("header_milliseconds", "prn", "radius", F.round("theta", 9).alias("theta"), "system", "label")


@query(f"SELECT system_type, prn, radius FROM (SELECT *, row_number() OVER (PARTITION BY system_type, prn ORDER BY elevation DESC, header_milliseconds) AS n FROM {_SKIES}) WHERE n = 1")
def view_sky_peaks(spark, d):
    return views.sky_peaks(skies(spark, d)).select("system_type", "prn", "radius")


@query(f"SELECT system_type, prn, header_milliseconds, elevation, row_number() OVER (PARTITION BY system_type, prn ORDER BY header_milliseconds, elevation, azimuth) AS step FROM {_SKIES}")
def view_sky_way(spark, d):
    return views.track_order(skies(spark, d)).select("system_type", "prn", "header_milliseconds", "elevation", "step")


@query(f"SELECT count(DISTINCT (system_type, prn)) AS satellites FROM {_SKIES}")
def view_sky_satellites(spark, d):
    return skies(spark, d).agg(F.count_distinct("system_type", "prn").alias("satellites"))


def stats_recording(spark: SparkSession, d: str) -> Recording:
    """RANGE from orders and lines; SATVIS2 from orders, one satellite for each line and 3 s later."""
    top = parents(spark, d).select("sequence_id", "header_milliseconds")
    seen = top.select((F.col("sequence_id") * 2).alias("sequence_id"), F.col("sequence_id").alias("parent_id"), (F.col("sequence_id") % 91).cast("double").alias("elevation"), F.lit(0.0).alias("azimuth"))
    ids = children(spark, d).select("sequence_id", (F.col("parent_id") * 2).alias("parent_id"), F.col("sv_prn").alias("prn"), F.lit("0").alias("system_type")).filter("prn % 2 = 0")
    sky = LogTable("SATVIS2", top.withColumn("header_milliseconds", F.col("header_milliseconds") + 3000), {"sat_vis_list": LogTable("sat_vis_list", seen, {"id": LogTable("id", ids)})})
    log = LogTable("RANGE", top, {"obs": LogTable("obs", children(spark, d))})
    index = top.select("sequence_id", F.lit("RANGE").alias("log"))
    return Recording(index, {"RANGE": log, "SATVIS2": sky}, None, index)


_ELEVATION = f"""WITH l AS (SELECT DISTINCT header_milliseconds AS t, sv_prn FROM {JOINED}),
r AS (SELECT header_milliseconds + 3000 AS t, sv_prn, max(CAST(parent_id % 91 AS DOUBLE)) AS elevation FROM {JOINED} WHERE sv_prn % 2 = 0 GROUP BY 1, 2),
b AS (SELECT l.*, r.t AS bt, r.elevation AS be FROM l ASOF LEFT JOIN r ON l.sv_prn = r.sv_prn AND l.t >= r.t),
f AS (SELECT l.t, l.sv_prn, r.t AS ft, r.elevation AS fe FROM l ASOF LEFT JOIN r ON l.sv_prn = r.sv_prn AND l.t <= r.t)
SELECT t AS header_milliseconds, sv_prn, CASE WHEN bt IS NOT NULL AND (ft IS NULL OR t - bt <= ft - t) THEN CASE WHEN t - bt <= 10000 THEN be END WHEN ft - t <= 10000 THEN fe END AS elevation FROM b JOIN f USING (t, sv_prn)"""


@query(_ELEVATION)
def view_satstats_elevation(spark, d):
    """Each satellite's elevation nearest in time, the earlier of two as near, the greatest of one time."""
    return views.satellite_stats(stats_recording(spark, d))["elevation"].select("header_milliseconds", "sv_prn", "elevation")


@query(f"SELECT round(avg(satellites), 6) AS satellites, round(avg(signals), 6) AS signals FROM (SELECT count(DISTINCT sv_prn) AS satellites, count(*) AS signals FROM {JOINED} GROUP BY time_s)")
def view_tracking_average(spark, d):
    return views.tracking(stats_recording(spark, d))["average"].select(r("satellites"), r("signals"))


@query(f"SELECT round(avg(satellites), 6) AS satellites FROM (SELECT count(DISTINCT sv_prn) AS satellites FROM {JOINED} GROUP BY time_s)")
def view_signal_average(spark, d):
    return views.signal(stats_recording(spark, d))["average"].select(r("satellites"))


def one_log(spark: SparkSession, name: str, rows: DataFrame) -> Recording:
    index = rows.select("sequence_id", F.lit(name).alias("log"))
    return Recording(index, {name: LogTable(name, rows)}, None, index)


@query("SELECT l_orderkey / 1000.0 AS time_s, l_quantity AS roll_std_dev, l_discount AS pitch_std_dev, l_tax AS azimuth_std_dev FROM lineitem")
def view_attitude_accuracy(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sequence_id"), F.col("l_orderkey").alias("header_milliseconds"), F.col("l_quantity").alias("roll_std_dev"), F.col("l_discount").alias("pitch_std_dev"), F.col("l_tax").alias("azimuth_std_dev"))
    return views.attitude_accuracy(one_log(spark, "INSSTDEV", li))["series"]


@query("SELECT CAST(l_orderkey AS DOUBLE) AS time_s, l_quantity AS accel_x, l_discount AS accel_y, l_tax AS gyro_z FROM lineitem")
def view_imu(spark, d):
    """The third of four logs, its seconds, and axes in either spelling."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sequence_id"), F.col("l_orderkey").cast("double").alias("gps_seconds"), F.col("l_quantity").alias("accel_x"), F.col("l_discount").alias("y_accel_output"), F.col("l_tax").alias("z_gyro_output"))
    return views.imu(one_log(spark, "RAWIMUS", li))["series"]


@query("SELECT l_orderkey / 1000.0 AS time_s, l_quantity AS accel_z FROM lineitem")
def view_imu_header_time(spark, d):
    """Header time where the log has no seconds of its own; other axes are lacking."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sequence_id"), F.col("l_orderkey").alias("header_milliseconds"), F.col("l_quantity").alias("accel_z"))
    return views.imu(one_log(spark, "RAWIMU", li))["series"]


_TYPE = " ".join(f"WHEN {k} THEN '{v}'" for k, v in codes.POSITION_TYPES.items())


@query(f"SELECT c_custkey, round((c_custkey % 360 - 180) * 20037508.34 / 180, 4) AS x, round(ln(tan((90 + (c_custkey % 170 - 85)) * pi() / 360)) / (pi() / 180) * 20037508.34 / 180, 4) + 0.0 AS y, coalesce(CASE c_nationkey {_TYPE} END, CAST(c_nationkey AS VARCHAR)) AS position_type_name FROM customer WHERE c_custkey % 170 - 85 <> 0 OR c_custkey % 360 - 180 <> 0")
def view_position(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 170 - 85).cast("double").alias("latitude"), (F.col("c_custkey") % 360 - 180).cast("double").alias("longitude"), F.col("c_custkey").alias("header_milliseconds"), F.col("c_nationkey").alias("position_type"))
    return views.position_track(c).select("c_custkey", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "position_type_name")


@query("SELECT l_orderkey, l_orderkey / 1000.0 AS time_s, l_quantity AS latitude_std_dev, l_discount AS longitude_std_dev, l_tax AS height_std_dev, round(sqrt(l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax), 6) AS sigma_3d FROM lineitem")
def view_pos_accuracy(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("header_milliseconds"), F.col("l_quantity").alias("latitude_std_dev"), F.col("l_discount").alias("longitude_std_dev"), F.col("l_tax").alias("height_std_dev"))
    return views.position_sigma(li).select(F.round(F.col("time_s") * 1000).cast("long").alias("l_orderkey"), "time_s", "latitude_std_dev", "longitude_std_dev", "height_std_dev", r("sigma_3d"))


@query("SELECT round(avg(l_quantity), 6) AS latitude_std_dev, round(avg(l_discount), 6) AS longitude_std_dev, round(avg(l_tax), 6) AS height_std_dev FROM lineitem")
def view_accuracy(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("header_milliseconds"), F.col("l_quantity").alias("latitude_std_dev"), F.col("l_discount").alias("longitude_std_dev"), F.col("l_tax").alias("height_std_dev"))
    return views.accuracy_series(li).agg(F.avg("latitude_std_dev").alias("latitude_std_dev"), F.avg("longitude_std_dev").alias("longitude_std_dev"), F.avg("height_std_dev").alias("height_std_dev")).select(r("latitude_std_dev"), r("longitude_std_dev"), r("height_std_dev"))


# Verification


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Lines as messages, and as a rebuilt log would have them: flag A off by half in some, R off by rounding, O's fields exact; orders divisible by 5 lost; some without a week.

    Lines of an order may share their number, so ``line`` says on both sides which line a message was. The time is the order key as a whole number: as a double
    it would bring orders beyond 2^53 together. So is the supplier in a body, whatever type the table keeps it in: the text of a double would be compared within the
    tolerance, and beyond 1e9 neighbouring suppliers are.
    """
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_returnflag").alias("log"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey")).alias("week"), F.col("l_orderkey").alias("milliseconds"), "l_quantity", "l_extendedprice", "l_suppkey", "l_linenumber", "l_orderkey", F.struct("l_suppkey", "l_extendedprice", "l_quantity").alias("line"))
    text = lambda c: c.cast("string")
    body = lambda price, supp: F.create_map(F.lit("quantity"), text(F.col("l_quantity")), F.lit("price"), text(price), F.lit("supplier"), text(supp))
    price = F.col("l_extendedprice")
    wrong = F.when((F.col("log") == "A") & (F.col("l_suppkey") % 7 == 0), price * 1.5).when((F.col("log") == "R") & (F.col("l_suppkey") % 7 == 1) & (price >= 1000), F.round(price, -2) + 0.0).otherwise(price * (1 + 1e-12))
    whole = F.col("l_suppkey").try_cast("decimal(38,0)")
    supplier = F.when((F.col("log") == "A") & (F.col("l_suppkey") % 7 == 2), whole + 1).otherwise(whole)
    keys = ["pos", "log", "week", "milliseconds", "line"]
    return li.select(*keys, body(price, whole).alias("body")), li.filter("l_orderkey % 5 <> 0").select(*keys, body(wrong, supplier).alias("body"))


def differences(spark: SparkSession, d: str, logs: list[str] | None = None) -> DataFrame:
    return v.field_differences(*sides(spark, d), logs=logs, ties=["line"])


#: Per message: matched, and which of its fields differ beyond 1e-9; keys repeat (no week), so the k-th of a key meets the k-th.
_SIDES = """(SELECT pos, log, matched, matched AND abs(price - other) > 1e-9 * greatest(abs(price), abs(other)) AS price_differs, matched AND log = 'A' AND supp % 7 = 2 AS supp_differs, price, other FROM (
  SELECT l_orderkey * 10 + l_linenumber AS pos, l_returnflag AS log, l_orderkey % 5 <> 0 AS matched, l_suppkey AS supp, l_extendedprice AS price,
    CASE WHEN l_returnflag = 'A' AND l_suppkey % 7 = 0 THEN l_extendedprice * 1.5 WHEN l_returnflag = 'R' AND l_suppkey % 7 = 1 AND l_extendedprice >= 1000 THEN round(l_extendedprice, -2) ELSE l_extendedprice END AS other FROM lineitem))"""


@query(f"SELECT pos, log, 'price' AS field FROM {_SIDES} WHERE price_differs UNION ALL SELECT pos, log, 'supplier' FROM {_SIDES} WHERE supp_differs")
def verify_fields(spark, d):
    return differences(spark, d).filter("differs").select("pos", "log", "field")


_BY_LOG = f"SELECT log, count(DISTINCT pos) AS messages, count(DISTINCT pos) FILTER (WHERE matched) AS matched, CAST(sum(CAST(price_differs AS INT) + CAST(supp_differs AS INT)) AS BIGINT) AS diffs FROM {_SIDES} GROUP BY log"


@query(f"SELECT *, CASE WHEN diffs > 0 THEN 'MISMATCH' WHEN matched = 0 THEN 'NOT_VERIFIED' ELSE 'VERIFIED' END AS status FROM ({_BY_LOG})")
def verify_by_log(spark, d):
    return v.by_log(differences(spark, d))


@query(f"SELECT *, CASE WHEN diffs > 0 THEN 'MISMATCH' WHEN matched = 0 THEN 'NOT_VERIFIED' ELSE 'VERIFIED' END AS status FROM ({_BY_LOG}) WHERE log IN ('N', 'R')")
def verify_some_logs(spark, d):
    return v.by_log(differences(spark, d, ["N", "R"]))


@query(f"SELECT log, CASE WHEN log = 'A' THEN 'MISMATCH' ELSE 'VERIFIED' END AS status FROM ({_BY_LOG})")
def verify_promoted(spark, d):
    """A log all of whose differences are roundings counts as verified: prices rounded to hundreds have two to five figures left."""
    return v.by_log(differences(spark, d), expected_ascii=True).select("log", "status")


@query(f"SELECT CAST(sum(messages) AS BIGINT) AS messages, count(*) FILTER (WHERE diffs = 0 AND matched > 0) AS verified_types, CAST(coalesce(sum(messages) FILTER (WHERE matched = 0), 0) AS BIGINT) AS messages_not_verified, count(*) FILTER (WHERE diffs > 0) AS mismatched_types FROM ({_BY_LOG})")
def verify_overall(spark, d):
    return v.overall(v.by_log(differences(spark, d)))


@query(f"SELECT log, CASE WHEN log = 'R' THEN 'ascii_rounding' ELSE 'large_error' END AS category, count(*) AS n FROM {_SIDES} WHERE price_differs GROUP BY log UNION ALL SELECT log, 'non_float', count(*) FROM {_SIDES} WHERE supp_differs GROUP BY log")
def verify_category_counts(spark, d):
    return v.category_counts(differences(spark, d))


@query(f"""SELECT DISTINCT category, CASE category WHEN 'non_float' THEN 'exact mismatch of a field that is no number with decimals' WHEN 'ascii_rounding' THEN 'the number was written with few decimals or figures: a limit of the text format, no loss of data' ELSE 'more than the text format explains; look into it (relative error 5.00e-01)' END AS explanation
FROM (SELECT CASE WHEN log = 'R' THEN 'ascii_rounding' ELSE 'large_error' END AS category FROM {_SIDES} WHERE price_differs UNION ALL SELECT 'non_float' FROM {_SIDES} WHERE supp_differs)""")
def verify_explained(spark, d):
    found = v.categorised(differences(spark, d))
    return found.select("category", F.when(F.col("category") == "ascii_rounding", F.regexp_replace("explanation", r" \(.*$", "")).otherwise(F.col("explanation")).alias("explanation")).distinct()


@query(f"SELECT pos, field, row_number() OVER (ORDER BY error DESC NULLS LAST, pos, field) AS place FROM (SELECT pos, 'price' AS field, round(abs(price - other) / price, 9) AS error FROM {_SIDES} WHERE price_differs UNION ALL SELECT pos, 'supplier', NULL FROM {_SIDES} WHERE supp_differs)")
def verify_worst_first(spark, d):
    """Differences by relative error, greatest first, fields that are no numbers last."""
    found = v.categorised(differences(spark, d)).withColumn("error", F.round("error", 9))
    return positions(found, [Key("error", False), Key("pos"), Key("field")], "place").select("pos", "field", "place")


_PAYLOADS = "(SELECT event_id AS pos, event_type AS log, CASE WHEN user_id % 4 = 0 THEN 'unmatched' WHEN user_id % 4 IN (1, 2) THEN 'different' ELSE 'same' END AS status, CASE WHEN user_id % 4 = 1 THEN len(event_type) + 1 END AS first_byte FROM events)"


@query(f"SELECT * FROM {_PAYLOADS}")
def verify_payloads(spark, d):
    """A changed byte, another length, the same, and none."""
    e = table(spark, d, "events").select(F.col("event_id").alias("pos"), F.col("event_type").alias("log"), F.lit(1).cast("long").alias("week"), F.col("event_id").cast("double").alias("milliseconds"), F.concat("event_type", F.lit(":"), F.lit("x"), F.col("user_id").cast("string")).alias("p"), "user_id")
    changed = F.when(F.col("user_id") % 4 == 1, F.replace("p", F.lit(":x"), F.lit(":y"))).when(F.col("user_id") % 4 == 2, F.concat("p", F.lit("!"))).otherwise(F.col("p"))
    keys = ["pos", "log", "week", "milliseconds"]
    found = v.payload_differences(e.select(*keys, F.col("p").cast("binary").alias("payload")), e.filter("user_id % 4 <> 0").select(*keys, changed.cast("binary").alias("payload")))
    return found.select("pos", "log", "status", F.col("first_byte").cast("long").alias("first_byte"))


@query("SELECT event_id AS pos, CASE WHEN user_id % 3 = 0 THEN 'same' ELSE 'different' END AS status, CASE user_id % 3 WHEN 1 THEN '_float_offset_4' WHEN 2 THEN '_byte_1' END AS field FROM events WHERE value IS NOT NULL")
def verify_payload_floats(spark, d):
    """Numbers at the offsets that the message's definition gives compare within the tolerance, other bytes exactly."""
    @F.pandas_udf("binary")
    def packed(n: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([struct.pack("<Id", int(a), b) for a, b in zip(n, x, strict=True)])

    e = table(spark, d, "events").filter("value is not null").select(F.col("event_id").alias("pos"), F.lit("P").alias("log"), F.lit(1).cast("long").alias("week"), F.col("event_id").cast("double").alias("milliseconds"), "user_id", "value")
    turn, keys = F.col("user_id") % 3, ["pos", "log", "week", "milliseconds"]
    other = packed(F.when(turn == 2, F.col("user_id").bitwiseXOR(F.lit(256))).otherwise(F.col("user_id")), F.when(turn == 1, F.col("value") + 1).otherwise(F.col("value") * (1 + 1e-12)))
    found = v.payload_differences(e.select(*keys, packed("user_id", "value").alias("payload")), e.select(*keys, other.alias("payload")), {"P": [("n", "ULONG", 1), ("x", "DOUBLE", 1)]})
    return found.select("pos", "status", F.get("found", F.lit(0))["field"].alias("field"))


@query("""SELECT 'L' AS log, count(*) AS messages, count(*) FILTER (WHERE o_custkey % 11 = 0) AS diffs, CASE WHEN count(*) FILTER (WHERE o_custkey % 11 = 0) > 0 THEN 'MISMATCH' ELSE 'VERIFIED' END AS status,
  count(*) FILTER (WHERE o_custkey % 11 = 0) || ' differing fields' AS reason FROM orders""")
def verify_stored(spark, d):
    """A stored table held against decoded messages, the k-th row against the k-th message; a name is compared by its number."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("sequence_id"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("state"), (F.col("o_custkey") % 11).alias("state_raw"))
    code = F.when(F.col("state_raw") == 0, F.lit(-1)).otherwise(F.col("state_raw"))
    rebuilt = o.select((F.col("sequence_id") * 3).alias("pos"), F.create_map(F.lit("price"), (F.col("price") * (1 + 1e-12)).cast("string"), F.lit("state"), code.cast("string")).alias("body"))
    return v.stored_differences(o, rebuilt, "L")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 4 = 0 THEN 'negligible' WHEN l_suppkey % 4 = 1 THEN 'large_error' WHEN l_suppkey % 4 = 2 THEN 'ascii_rounding' ELSE 'non_float' END AS category FROM lineitem")
def verify_diff_category(spark, d):
    from almagest.functions.rounding import difference_category

    a = F.col("l_extendedprice") + F.lit(0.123456)
    b = F.when(F.col("l_suppkey") % 4 == 0, a * (1 + 1e-9)).when(F.col("l_suppkey") % 4 == 1, a * 1.3333333).otherwise(F.format_string("%.4e", a).cast("double"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", a.alias("a"), b.alias("b"))
    error = F.when(F.col("l_suppkey") % 4 != 3, F.greatest(relative_error(F.col("a"), F.col("b")), F.when(F.col("l_suppkey") % 4 == 2, F.lit(2e-5)).otherwise(F.lit(0.0))))
    return li.select("l_orderkey", "l_linenumber", difference_category(F.col("a"), F.col("b"), error).alias("category"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def fingerprint_sha256(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


#: The queries over tables, as against those that go through files.
TABLE_QUERIES = tuple(QUERIES)

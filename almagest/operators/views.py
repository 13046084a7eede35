"""The nine analytic views as DataFrames; rendering is elsewhere. A view of a log that the recording lacks is None."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almagest.functions import codes
from almagest.operators.joins import nearest
from almagest.plans.catalog import Recording
from almagest.plans.table import LogTable

MERCATOR = 20037508.34
IMU_LOGS = ("RAWIMUSX", "RAWIMUX", "RAWIMUS", "RAWIMU")


def _table(rec: Recording, *path: str) -> DataFrame | None:
    tables: dict[str, LogTable] = rec.tables
    table = None
    for name in path:
        if name not in tables:
            return None
        table = tables[name]
        tables = table.children
    return table.current


def seconds(col: str = "header_milliseconds") -> Column:
    return (F.col(col) / 1000.0).alias("time_s")


def mercator_x(lon: Column) -> Column:
    return lon * MERCATOR / 180


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan((90 + lat) * F.lit(3.141592653589793) / 360)) / (F.lit(3.141592653589793) / 180) * MERCATOR / 180


def observations(top: DataFrame, obs: DataFrame) -> DataFrame:
    """Each observation with its epoch's time: an equi-join on the parent's id."""
    epoch = top.select(F.col("sequence_id").alias("_epoch"), "header_milliseconds")
    return obs.join(epoch, obs["parent_id"] == epoch["_epoch"]).drop("_epoch").withColumn("time_s", F.col("header_milliseconds") / 1000.0)


def position_track(df: DataFrame) -> DataFrame:
    fixes = df.filter((F.col("latitude") != 0) | (F.col("longitude") != 0))
    names = {"position_type": codes.POSITION_TYPES, "solution_status": codes.SOLUTION_STATUSES}
    decoded = [codes.named(F.col(c), n).alias(f"{c}_name") for c, n in names.items() if c in df.columns]
    return fixes.select("*", seconds(), mercator_x(F.col("longitude")).alias("x"), mercator_y(F.col("latitude")).alias("y"), *decoded)


def position(rec: Recording) -> dict[str, DataFrame] | None:
    df = _table(rec, "BESTPOS")
    return None if df is None else {"track": position_track(df)}


def accuracy_series(df: DataFrame) -> DataFrame:
    optional = [c for c in ("num_svs", "num_soln_svs", "diff_age", "solution_age") if c in df.columns]
    return df.select(seconds(), "latitude_std_dev", "longitude_std_dev", "height_std_dev", *optional)


def accuracy(rec: Recording) -> dict[str, DataFrame] | None:
    df = _table(rec, "BESTPOS")
    if df is None:
        return None
    series = accuracy_series(df)
    return {"series": series, "means": series.agg(*[F.avg(c).alias(c) for c in series.columns if c.endswith("std_dev")])}


def signal_by_satellite(joined: DataFrame, by: Sequence[str] = ("sv_prn",)) -> DataFrame:
    out = joined.groupBy(*by).agg(F.avg("C_No").alias("mean_cn0"), F.stddev_samp("C_No").alias("std_cn0"))
    return out.withColumn("band", codes.signal_band(F.col("mean_cn0")))


def satellites_by_epoch(joined: DataFrame) -> DataFrame:
    return joined.groupBy("time_s").agg(F.count_distinct("sv_prn").alias("satellites"))


def signal(rec: Recording, by_system: bool = False) -> dict[str, DataFrame] | None:
    """Satellites are told apart by number only, as receivers' plots do; ``by_system`` also by constellation."""
    top, obs = _table(rec, "RANGE"), _table(rec, "RANGE", "obs")
    if top is None or obs is None:
        return None
    joined = observations(top, obs)
    if by_system:
        joined = joined.withColumn("system", codes.system_name(F.col("c_status")))
    epochs = satellites_by_epoch(joined)
    return {"satellites": signal_by_satellite(joined, ("system", "sv_prn") if by_system else ("sv_prn",)), "epochs": epochs, "average": epochs.agg(F.avg("satellites").alias("satellites"))}


def tracking_counts(joined: DataFrame, by_system: bool) -> DataFrame:
    system = codes.system_name(F.col("c_status")) if "c_status" in joined.columns else F.lit("Unknown")
    keys = ["time_s", "system"] if by_system else ["time_s"]
    return joined.withColumn("system", system).groupBy(*keys).agg(F.count_distinct("sv_prn").alias("satellites"), F.count(F.lit(1)).alias("signals"))


def tracking(rec: Recording) -> dict[str, DataFrame] | None:
    top, obs = _table(rec, "RANGE"), _table(rec, "RANGE", "obs")
    if top is None or obs is None or "sv_prn" not in obs.columns:
        return None
    joined = observations(top, obs)
    total = tracking_counts(joined, False)
    return {"total": total, "by_system": tracking_counts(joined, True), "average": total.agg(F.avg("satellites").alias("satellites"), F.avg("signals").alias("signals"))}


def satellite_series(joined: DataFrame, prns: Sequence[int] | None = None) -> DataFrame:
    rows = joined if prns is None else joined.filter(F.col("sv_prn").isin(list(prns)))
    system = codes.system_id(F.col("c_status")) if "c_status" in joined.columns else F.lit(None).cast("int")
    rows = rows.withColumn("sys_id", system)
    optional = [F.avg(c).alias(c) for c in ("sd_psr", "sd_adr") if c in joined.columns]
    return rows.groupBy("header_milliseconds", "sv_prn", "sys_id").agg(F.max("C_No").alias("C_No"), *optional)


def sky_positions(top: DataFrame, seen: DataFrame, ids: DataFrame) -> DataFrame:
    """id, visibility and epoch rows joined by their parents' ids."""
    i = ids.select(F.col("parent_id").alias("_seen"), *[c for c in ids.columns if c not in ("sequence_id", "parent_id")])
    v = seen.select(F.col("sequence_id").alias("_v"), F.col("parent_id").alias("_top"), *[c for c in ("elevation", "azimuth") if c in seen.columns])
    t = top.select(F.col("sequence_id").alias("_t"), "header_milliseconds")
    return i.join(v, F.col("_seen") == F.col("_v")).join(t, F.col("_top") == F.col("_t")).drop("_seen", "_v", "_top", "_t")


def satellite_stats(rec: Recording, prns: Sequence[int] | None = None, tolerance_ms: float = 10_000) -> dict[str, DataFrame] | None:
    top, obs = _table(rec, "RANGE"), _table(rec, "RANGE", "obs")
    if top is None or obs is None:
        return None
    series = satellite_series(observations(top, obs), prns)
    out = {"series": series}
    sky = [_table(rec, "SATVIS2"), _table(rec, "SATVIS2", "sat_vis_list"), _table(rec, "SATVIS2", "sat_vis_list", "id")]
    if all(x is not None for x in sky):
        seen = sky_positions(*sky).select("header_milliseconds", F.col("prn").alias("sv_prn"), "elevation")
        times = series.select("header_milliseconds", "sv_prn").distinct()
        out["elevation"] = nearest(times, seen, "header_milliseconds", ["sv_prn"], ["elevation"], tolerance_ms).withColumn("time_s", F.col("header_milliseconds") / 1000.0)
    return out


def sky_track(df: DataFrame) -> DataFrame:
    prefix = codes.named(F.col("system_type"), codes.SKY_PREFIXES, F.lit("?"))
    system = codes.named(F.col("system_type"), codes.SKY_SYSTEMS)
    return df.select("*", (90 - F.col("elevation")).alias("radius"), F.radians("azimuth").alias("theta"), system.alias("system"), codes.satellite_label(prefix, F.col("prn")).alias("label"))


def track_order(track: DataFrame) -> DataFrame:
    """A sky track with ``step``, the place of each point on its satellite's way (from 1)."""
    way = Window.partitionBy("system_type", "prn").orderBy("header_milliseconds", "elevation", "azimuth")
    return track.withColumn("step", F.row_number().over(way).cast("long"))


def sky_peaks(track: DataFrame) -> DataFrame:
    """Where each satellite stands highest, the earliest point of equally high ones."""
    peaks = track.groupBy("system_type", "prn").agg(F.max_by(F.struct("radius", "theta", "label"), F.struct("elevation", -F.col("header_milliseconds"))).alias("peak"))
    return peaks.select("system_type", "prn", "peak.*")


def skyview(rec: Recording) -> dict[str, DataFrame] | None:
    parts = [_table(rec, "SATVIS2"), _table(rec, "SATVIS2", "sat_vis_list"), _table(rec, "SATVIS2", "sat_vis_list", "id")]
    if any(p is None for p in parts):
        return None
    track = track_order(sky_track(sky_positions(*parts)))
    return {"track": track, "peaks": sky_peaks(track), "satellites": track.agg(F.count_distinct("system_type", "prn").alias("satellites"))}


def position_sigma(df: DataFrame) -> DataFrame:
    parts = [F.col(f"{c}_std_dev") for c in ("latitude", "longitude", "height")]
    return df.select(seconds(), *[f"{c}_std_dev" for c in ("latitude", "longitude", "height")], F.sqrt(parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2]).alias("sigma_3d"))


def _inertial(rec: Recording, columns: Sequence[str]) -> DataFrame | None:
    df = _table(rec, "INSSTDEV")
    return df if df is not None and set(columns) <= set(df.columns) else None


def position_accuracy(rec: Recording) -> dict[str, DataFrame] | None:
    df = _inertial(rec, ("latitude_std_dev", "longitude_std_dev", "height_std_dev"))
    return None if df is None else {"series": position_sigma(df)}


def attitude_accuracy(rec: Recording) -> dict[str, DataFrame] | None:
    columns = ("roll_std_dev", "pitch_std_dev", "azimuth_std_dev")
    df = _inertial(rec, columns)
    return None if df is None else {"series": df.select(seconds(), *columns)}


def imu(rec: Recording) -> dict[str, DataFrame] | None:
    """The first raw inertial log there is; axes in either spelling."""
    for name in IMU_LOGS:
        df = _table(rec, name)
        if df is not None:
            time = F.col("gps_seconds").alias("time_s") if "gps_seconds" in df.columns else seconds()
            spelled = {f"{kind}_{axis}": s for kind in ("accel", "gyro") for axis in "xyz" for s in (f"{kind}_{axis}", f"{axis}_{kind}_output") if s in df.columns}
            return {"series": df.select(time, *[F.col(s).alias(k) for k, s in spelled.items()])}
    return None


VIEWS = {"position": position, "accuracy": accuracy, "signal": signal, "tracking": tracking, "satellite_stats": satellite_stats, "skyview": skyview, "position_accuracy": position_accuracy, "attitude_accuracy": attitude_accuracy, "imu": imu}

"""Command line: convert, plot, reconstruct, validate-source."""

from __future__ import annotations

import argparse
import html
import importlib
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.logs import banner, setup
from almagest.operators.verify import same_source
from almagest.operators.views import VIEWS
from almagest.plans.catalog import Recording

COMMANDS = ("convert", "plot", "reconstruct", "validate-source")
MOST_POINTS = 5000
MOST_ROWS = 200


def session() -> SparkSession:
    return SparkSession.builder.appName("almagest").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def points(df: DataFrame, x: str, y: str) -> list[tuple[float, float]]:
    """A drawing's points: at most ``MOST_POINTS`` buckets along x, each with its mean; what is drawn never grows with the data."""
    low, high = df.agg(F.min(x), F.max(x)).first()
    if low is None:
        return []
    width = max((high - low) / MOST_POINTS, 1e-12)
    buckets = df.groupBy(F.floor((F.col(x) - low) / width).alias("b")).agg(F.avg(x).alias("x"), F.avg(y).alias("y")).orderBy("b")
    return [(r.x, r.y) for r in buckets.collect() if r.y is not None]


def svg(series: dict[str, list[tuple[float, float]]], width: int = 900, height: int = 260) -> str:
    every = [p for s in series.values() for p in s]
    if not every:
        return "<p>no data</p>"
    (x0, x1), (y0, y1) = ((min(v), max(v)) for v in zip(*every, strict=True))
    place = lambda p: f"{(p[0] - x0) / ((x1 - x0) or 1) * width:.1f},{height - (p[1] - y0) / ((y1 - y0) or 1) * height:.1f}"
    lines = "".join(f'<polyline fill="none" stroke="hsl({i * 77 % 360},70%,40%)" points="{" ".join(map(place, s))}"><title>{html.escape(k)}</title></polyline>' for i, (k, s) in enumerate(series.items()) if s)
    return f'<svg viewBox="0 0 {width} {height}" width="{width}">{lines}</svg><p>{html.escape(", ".join(series))}: x {x0:g} to {x1:g}, y {y0:g} to {y1:g}</p>'


TABS = """<style>nav a{padding:.3em .8em;text-decoration:none}section{display:none}section:target,body:not(:has(section:target)) section:first-of-type{display:block}</style>"""
MAP = """<div id="map" style="height:420px"></div><link rel="stylesheet" href="https://unpkg.com/leaflet/dist/leaflet.css"><script src="https://unpkg.com/leaflet/dist/leaflet.js"></script>
<script>const way=%s;const m=L.map('map');L.tileLayer('https://tile.openstreetmap.org/{z}/{x}/{y}.png').addTo(m);const l=L.polyline(way).addTo(m);m.fitBounds(l.getBounds());</script>"""


def require(module: str) -> object:
    """An optional module, or an error that says what lacks it."""
    try:
        return importlib.import_module(module)
    except ImportError as e:
        raise RuntimeError(f"this needs {module}, which is not installed") from e


def timed(df: DataFrame) -> DataFrame:
    """A frame with a time axis, if it has any time."""
    return df.withColumn("time_s", F.col("header_milliseconds") / 1000.0) if "header_milliseconds" in df.columns and "time_s" not in df.columns else df


def drawn(key: str, df: DataFrame) -> str:
    """A frame over time as lines, each column with its own; another as its first rows in order, with a note of how many there are."""
    df = timed(df)
    numeric = [c for c, t in df.dtypes if t in ("double", "bigint", "int") and c not in ("time_s", "sequence_id", "parent_id", "header_week", "header_milliseconds")]
    if "time_s" in df.columns and numeric:
        return f"<h3>{key}</h3>" + "".join(svg({c: points(df, "time_s", c)}) for c in numeric)
    n = df.count()
    rows = df.orderBy(*df.columns).limit(MOST_ROWS).collect()
    note = f"<p>the first {MOST_ROWS} of {n} rows</p>" if n > MOST_ROWS else ""
    return f"<h3>{key}</h3>{note}<table>" + "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in [df.columns, *rows]) + "</table>"


def dashboard(rec: Recording, names: list[str], title: str, osm: bool = False) -> tuple[str, dict[str, str]]:
    """A page with a tab for each view, and the views that failed with their errors; ``osm`` draws the position on a map that the browser loads."""
    parts, failed = {}, {}
    for name in names:
        try:
            frames = VIEWS[name](rec)
            if frames is None:
                failed[name] = "the recording lacks its log"
                continue
            parts[name] = "".join(drawn(key, df) for key, df in frames.items())
            if osm and name == "position":
                way = list(zip((y for _, y in points(timed(frames["track"]), "time_s", "latitude")), (y for _, y in points(timed(frames["track"]), "time_s", "longitude")), strict=False))
                parts[name] += MAP % [list(p) for p in way]
        except Exception as e:  # one view's failure leaves the others
            failed[name] = f"{type(e).__name__}: {e}"
    tabs = "".join(f'<a href="#{n}">{n}</a>' for n in parts)
    body = "".join(f'<section id="{n}"><h2>{n}</h2>{x}</section>' for n, x in parts.items())
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title>{TABS}</head><body><h1>{html.escape(title)}</h1><nav>{tabs}</nav>{body}</body></html>", failed


def write_png(rec: Recording, name: str, target: Path) -> None:
    """A view's series over time as an image of 150 dpi; needs matplotlib."""
    require("matplotlib").use("Agg")
    plt = require("matplotlib.pyplot")
    frames = {k: timed(df) for k, df in (VIEWS[name](rec) or {}).items()}
    series = [(f"{k} {c}", points(df, "time_s", c)) for k, df in frames.items() if "time_s" in df.columns for c, t in df.dtypes if t == "double" and c not in ("time_s", "header_milliseconds")]
    figure, axes = plt.subplots(max(1, len(series)), squeeze=False, figsize=(9, 2.5 * max(1, len(series))))
    for axis, (label, line) in zip(axes[:, 0], series, strict=False):
        axis.plot(*zip(*line, strict=True) if line else ([], []))
        axis.set_title(label)
    figure.savefig(target, dpi=150)
    plt.close(figure)


def _convert(args: list[str]) -> int:
    p = argparse.ArgumentParser("convert")
    p.add_argument("input")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--parallel", action=argparse.BooleanOptionalAction, default=None, help="slices follow the file's size; --no-parallel reads one")
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--archive", "--zip", action="store_true", dest="archive")
    a = p.parse_args(args)
    if not Path(a.input).is_file():
        p.error(f"no such file: {a.input}")
    from almagest.errors import RecordingExistsError
    from almagest.sources.writer import convert

    print(banner("convert", input=a.input, output=a.output))
    try:
        print("wrote", convert(session(), a.input, a.output, a.overwrite, a.archive, **({"slice_bytes": 1 << 62} if a.parallel is False else {})))
    except RecordingExistsError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def _plot(args: list[str]) -> int:
    p = argparse.ArgumentParser("plot")
    p.add_argument("database")
    p.add_argument("--plot", nargs="+", choices=list(VIEWS), default=list(VIEWS))
    p.add_argument("--out", default=".")
    p.add_argument("--html", action=argparse.BooleanOptionalAction, default=True, help="one page with a tab for each view; --no-html writes a PNG for each")
    p.add_argument("--osm", action="store_true", help="draw the position on a map")
    a = p.parse_args(args)
    if not Path(a.database).is_dir():
        p.error(f"no such folder: {a.database}")
    print(banner("plot", database=a.database, views=", ".join(a.plot)))
    rec = Recording.open(session(), a.database)
    Path(a.out).mkdir(parents=True, exist_ok=True)
    target = Path(a.out) / f"{Path(a.database).name}.html"
    if a.html:
        page, failed = dashboard(rec, a.plot, Path(a.database).name, a.osm)
        target.write_text(page)
    else:
        target, failed = Path(a.out), {}
        for name in a.plot:
            try:
                write_png(rec, name, target / f"{name}.png")
            except Exception as e:  # one view's failure leaves the others
                failed[name] = f"{type(e).__name__}: {e}"
    for name, why in failed.items():
        print(f"{name}: {why}", file=sys.stderr)
    print("wrote", target)
    return int(len(failed) == len(a.plot))


def _reconstruct(args: list[str]) -> int:
    p = argparse.ArgumentParser("reconstruct")
    p.add_argument("database")
    p.add_argument("original")
    p.add_argument("--mode", choices=("field", "binary", "both"), default="both")
    p.add_argument("--output")
    p.add_argument("--report")
    p.add_argument("--no-report", action="store_true")
    p.add_argument("--float-tol", type=float, default=1e-9)
    p.add_argument("--use-expected-ascii-rounding", action="store_true")
    p.add_argument("--log-types", nargs="+")
    a = p.parse_args(args)
    from almagest.report import print_summary, verify, write_report

    print(banner("reconstruct", database=a.database, original=a.original))
    results = verify(session(), a.database, a.original, a.mode, a.output, a.float_tol, a.log_types, a.use_expected_ascii_rounding)
    for mode, found in results.items():
        print_summary(found, mode)
        if not a.no_report:
            write_report(found, a.report or f"{a.database.rstrip('/')}_{mode}.html", mode)
    return int(any(f.overall["mismatched_types"] for f in results.values()))


def _validate(args: list[str]) -> int:
    p = argparse.ArgumentParser("validate-source")
    p.add_argument("first")
    p.add_argument("second")
    a = p.parse_args(args)
    found = same_source(a.first, a.second)
    print("VALID" if found.valid else f"INVALID: {found.reason} ({found.detail})")
    return int(not found.valid)


def main(args: list[str] | None = None) -> int:
    args = sys.argv[1:] if args is None else args
    setup()
    if not args or args[0] in ("-h", "--help"):
        print("usage: almagest {" + ",".join(COMMANDS) + "} ...")
        return 0
    run = {"convert": _convert, "plot": _plot, "reconstruct": _reconstruct, "validate-source": _validate, "validate_source": _validate}.get(args[0])
    if run is None:
        print(f"unknown command {args[0]!r}", file=sys.stderr)
        return 1
    return run(args[1:])


if __name__ == "__main__":
    sys.exit(main())

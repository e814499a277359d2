"""Statistics of a change map and their rendering as CSV, HTML or, where matplotlib is there, images."""

from __future__ import annotations

import csv
import html
import io
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.functions import vectors as V
from gridlore.functions.quantiles import SMALL, quantiles

PERCENTILES = (5, 25, 50, 75, 95)
SECTIONS = ("distribution", "area", "series", "scatter")
THRESHOLDS = (0.1, 0.2, 0.3, 0.5)
BINS = 30
SCATTER_POINTS = 2000


def finite_values(values: DataFrame, column: str = "value") -> DataFrame:
    """The column `value` as double, finite rows only."""
    return values.select(V.finite_or_null(column).alias("value")).filter("value IS NOT NULL")


def summarise(values: DataFrame, column: str = "value") -> DataFrame:
    """One row: n, min, max, mean, median, std (of the population) and p5 to p95, linear between ranks."""
    good = finite_values(values, column)
    got = good.agg(F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    ranked = dict(zip(PERCENTILES, quantiles(good, "value", [p / 100 for p in PERCENTILES])))
    lit = lambda p: F.lit(ranked[p]).cast("double")
    return got.select("n", "min", "max", "mean", lit(50).alias("median"), "std", *(lit(p).alias(f"p{p}") for p in PERCENTILES))


def histogram(values: DataFrame, bins: int = BINS, column: str = "value") -> DataFrame:
    """bin (from 0), low, high and n of equal widths over the range, the last closed; a single value gets a width of 1 around it."""
    if bins < 1:
        raise ValueError("one bin or more")
    good = finite_values(values, column)
    ends = good.agg(F.min("value").alias("lo"), F.max("value").alias("hi")).first()
    if ends["lo"] is None:
        raise ValueError("no finite value")
    low, high = (ends["lo"] - 0.5, ends["hi"] + 0.5) if ends["lo"] == ends["hi"] else (ends["lo"], ends["hi"])
    step = (high - low) / bins
    place = F.least(F.floor((F.col("value") - F.lit(low)) / F.lit(high - low) * bins), F.lit(bins - 1)).cast("int")
    counted = good.groupBy(place.alias("bin")).count()
    every = values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", (F.lit(low) + F.col("bin") * step).alias("low"), F.when(F.col("bin") == bins - 1, F.lit(high)).otherwise(F.lit(low) + (F.col("bin") + 1) * step).alias("high"), F.coalesce("count", F.lit(0)).cast("long").alias("n"))


def area_fractions(values: DataFrame, thresholds: Sequence[float] = THRESHOLDS, pixel_area: float | None = None, column: str = "value") -> DataFrame:
    """threshold (ascending), n at or above it, fraction, hectares (NULL without a pixel area): one aggregation for all thresholds."""
    wanted = sorted(float(t) for t in thresholds)
    good = finite_values(values, column)
    counts = F.array(*(F.struct(F.lit(t).alias("threshold"), F.count_if(F.col("value") >= F.lit(t)).alias("n")) for t in wanted))
    rows = good.agg(F.count("value").alias("total"), counts.alias("c")).select("total", F.explode("c").alias("c")).select("total", "c.*")
    hectares = F.lit(None).cast("double") if pixel_area is None else F.col("n") * F.lit(float(pixel_area)) / 1e4
    return rows.select("threshold", "n", F.coalesce(F.try_divide("n", "total"), F.lit(0.0)).alias("fraction"), hectares.alias("hectares"))


def series_points(values: DataFrame, period: str = "period", column: str = "value") -> DataFrame:
    """period, mean, median and n of each period that has a value; periods are steps between years, so few."""
    good = values.select(F.col(period).alias("period"), V.finite_or_null(column).alias("value")).filter("value IS NOT NULL")
    table = good.groupBy("period").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    if (found := table.agg(F.max("n")).first()[0]) is None or found <= SMALL:
        return good.groupBy("period").agg(F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"), F.count("value").alias("n"))
    rows = [(r["period"], r["mean"], quantiles(good.filter(F.col("period").eqNullSafe(F.lit(r["period"]))), "value", [0.5])[0], r["n"]) for r in table.collect()]
    return values.sparkSession.createDataFrame(rows, good.schema["period"].dataType.simpleString().join(("period ", ", mean double, median double, n long")))


def pair_labels(years: Sequence[Any]) -> list[str]:
    """Names of the steps between neighbouring periods."""
    return [f"{a} -> {b}" if a not in (None, "") and b not in (None, "") else f"period {i + 1}" for i, (a, b) in enumerate(zip(years, years[1:]))]


def scatter_sample(x: DataFrame, y: DataFrame, keys: Sequence[str] = ("grid_id", "row", "col"), n: int = SCATTER_POINTS, seed: int = 42, x_column: str = "x", y_column: str = "y") -> DataFrame:
    """keys, x and y of n pixels finite in both, the same ones every time, in order of the keys."""
    joined = x.select(*keys, V.finite_or_null(x_column).alias("x")).join(y.select(*keys, V.finite_or_null(y_column).alias("y")), list(keys)).filter("x IS NOT NULL AND y IS NOT NULL")
    return joined.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n).orderBy(*keys)


def band_scatter(change: DataFrame, pixels: DataFrame, band: int, nodata: float | None = None, keys: Sequence[str] = ("grid_id", "row", "col"), n: int = SCATTER_POINTS, seed: int = 42) -> DataFrame | None:
    """Band value against change; none if the band does not exist or nothing is finite in both."""
    sizes = pixels.select(F.size("embedding").alias("n")).limit(1).collect()
    if not sizes or not 1 <= band <= sizes[0]["n"]:
        return None
    out = scatter_sample(pixels.select(*keys, V.band("embedding", band, nodata).alias("x")), change.select(*keys, F.col("value").alias("y")), keys, n, seed)
    return None if out.isEmpty() else out


def parse_thresholds(text: str | None) -> tuple[float, ...]:
    """Numbers between commas or semicolons; what is no number is passed over; none: the defaults."""
    out = []
    for token in (text or "").replace(";", ",").split(","):
        try:
            out.append(float(token))
        except ValueError:
            continue
    return tuple(out) or THRESHOLDS


@dataclass(frozen=True)
class Request:
    """What a report should hold; out-of-range choices fall back."""

    content: tuple[str, ...] = SECTIONS
    bins: int = BINS
    thresholds: tuple[float, ...] = THRESHOLDS
    scatter_band: int = 1

    @classmethod
    def parse(cls, content: Sequence[int] = (), bins: int = 0, thresholds: str | None = None, scatter_band: int = 1) -> Request:
        chosen = tuple(SECTIONS[i] for i in content if 0 <= i < len(SECTIONS)) or SECTIONS
        return cls(chosen, bins or BINS, parse_thresholds(thresholds), max(1, scatter_band))


@dataclass
class Report:
    """Small, collected tables: every one has a size that does not grow with the map."""

    title: str
    n_valid: int
    stats: dict[str, Any] | None = None
    histogram: list[dict[str, Any]] | None = None
    areas: list[dict[str, Any]] | None = None
    series: list[dict[str, Any]] | None = None
    scatter: list[dict[str, Any]] | None = None
    labels: tuple[str, str] = ("band", "change")
    notes: list[str] = field(default_factory=list)


def build(values: DataFrame, request: Request = Request(), title: str = "Change report", pixel_area: float | None = None, series: DataFrame | None = None, scatter: DataFrame | None = None, scatter_labels: tuple[str, str] = ("band", "change"), column: str = "value") -> Report:
    """The asked-for sections; a section without data leaves a note; no finite value is an error."""
    rows = lambda df: [r.asDict() for r in df.collect()]
    stats = rows(summarise(values, column))[0]
    if not stats["n"]:
        raise ValueError("no finite value")
    out = Report(title, stats["n"], labels=scatter_labels)
    if "distribution" in request.content:
        out.stats, out.histogram = stats, sorted(rows(histogram(values, request.bins, column)), key=lambda r: r["bin"])
    if "area" in request.content:
        out.areas = sorted(rows(area_fractions(values, request.thresholds, pixel_area, column)), key=lambda r: r["threshold"])
    if "series" in request.content:
        if series is None:
            out.notes.append("no series: it needs three periods or more")
        else:
            out.series = rows(series_points(series))
            out.series.sort(key=lambda r: str(r["period"]))
            if not out.series:
                out.notes.append("no period has a finite value")
    if "scatter" in request.content:
        if scatter is None:
            out.notes.append("no scatter: no embedding was given or nothing is finite in both")
        else:
            out.scatter = rows(scatter.select("x", "y"))
    return out


def change_report(pixels: DataFrame, change: DataFrame, metric: str = "cosine", request: Request = Request(), pixel_area: float | None = None, nodata: float | None = None, keys: Sequence[str] = ("grid_id", "row", "col"), title: str = "Change report") -> Report:
    """The report of a change map from the years behind it: steps between years, and the latest year's band against change."""
    from gridlore.operators.change import consecutive

    steps = points = None
    if "series" in request.content:
        steps = consecutive(pixels, metric, nodata, keys).select(F.concat_ws(" -> ", F.col("year_from").cast("string"), F.col("year_to").cast("string")).alias("period"), "value")
    if "scatter" in request.content:
        last = pixels.agg(F.max("year")).first()[0]
        points = band_scatter(change, pixels.filter(F.col("year") == last), request.scatter_band, nodata, keys)
    return build(change, request, title, pixel_area, steps, points, (f"band {request.scatter_band}", "change"))


# ------------------------------------------------------------------ rendering


def to_csv(report: Report) -> str:
    """Sections one after another, each with a comment line and a header."""
    out = io.StringIO()
    write = csv.writer(out, lineterminator="\n").writerow
    num = lambda x: "" if x is None else f"{x:.6g}"
    out.write(f"# {report.title}\n# valid pixels: {report.n_valid}\n")

    def section(name: str, header: Sequence[str], rows) -> None:
        out.write(f"\n# {name}\n")
        write(header)
        for row in rows:
            write(row)

    if report.stats is not None:
        section("statistics", ("statistic", "value"), ((k, v if k == "n" else num(v)) for k, v in report.stats.items()))
    if report.histogram is not None:
        section("histogram", ("low", "high", "pixels"), ((num(h["low"]), num(h["high"]), h["n"]) for h in report.histogram))
    if report.areas is not None:
        section("area by threshold", ("threshold", "pixels", "fraction", "hectares"), ((num(a["threshold"]), a["n"], num(a["fraction"]), "" if a["hectares"] is None else f"{a['hectares']:.4g}") for a in report.areas))
    if report.series is not None:
        section("series", ("period", "mean", "median", "pixels"), ((s["period"], num(s["mean"]), num(s["median"]), s["n"]) for s in report.series))
    if report.scatter is not None:
        section("scatter", report.labels, ((num(p["x"]), num(p["y"])) for p in report.scatter))
    return out.getvalue()


def _axes(points: Sequence[tuple[float, float]]) -> tuple:
    xs, ys = [p[0] for p in points] or [0.0], [p[1] for p in points] or [0.0]
    x0, x1, y0, y1 = min(xs), max(xs), min(0.0, *ys), max(ys)
    scale = lambda v, a, b, lo, hi: lo + (v - a) / ((b - a) or 1.0) * (hi - lo)
    return (lambda x: scale(x, x0, x1, 60, 620)), (lambda y: scale(y, y0, y1, 260, 20)), (x0, x1, y0, y1)


def _chart(marks: str, ends: tuple[float, float, float, float], x_label: str, y_label: str) -> str:
    x0, x1, y0, y1 = ends
    text = lambda x, y, s, a="middle": f'<text x="{x}" y="{y}" text-anchor="{a}" font-size="11">{html.escape(str(s))}</text>'
    frame = '<path d="M60 20V260H620" fill="none" stroke="#555"/>'
    ticks = text(60, 276, f"{x0:.3g}") + text(620, 276, f"{x1:.3g}") + text(54, 262, f"{y0:.3g}", "end") + text(54, 26, f"{y1:.3g}", "end")
    return f'<svg viewBox="0 0 640 300" role="img">{frame}{ticks}{text(340, 294, x_label)}{text(8, 14, y_label, "start")}{marks}</svg>'


def bar_chart(rows: Sequence[dict[str, Any]]) -> str:
    x, y, ends = _axes([(r["low"], r["n"]) for r in rows] + [(rows[-1]["high"], 0)])
    bars = "".join(f'<rect x="{x(r["low"]):.1f}" y="{y(r["n"]):.1f}" width="{max(x(r["high"]) - x(r["low"]) - 1, 0.5):.1f}" height="{260 - y(r["n"]):.1f}" fill="#3b6ea5"/>' for r in rows)
    return _chart(bars, ends, "value", "pixels")


def line_chart(rows: Sequence[dict[str, Any]]) -> str:
    points = [(float(i), r["mean"]) for i, r in enumerate(rows)]
    x, y, ends = _axes(points)
    path = "M" + "L".join(f"{x(a):.1f} {y(b):.1f}" for a, b in points)
    return _chart(f'<path d="{path}" fill="none" stroke="#a53b3b"/>', ends, " | ".join(str(r["period"]) for r in rows), "mean")


def scatter_chart(rows: Sequence[dict[str, Any]], names: tuple[str, str]) -> str:
    x, y, ends = _axes([(r["x"], r["y"]) for r in rows])
    dots = "".join(f'<circle cx="{x(r["x"]):.1f}" cy="{y(r["y"]):.1f}" r="2" fill="#3b6ea5" fill-opacity=".5"/>' for r in rows)
    return _chart(dots, ends, *names)


def to_html(report: Report) -> str:
    """One page that needs nothing else; every text in it is escaped."""
    cell = lambda v: html.escape("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v))

    def table(header: Sequence[str], rows) -> str:
        head = "".join(f"<th>{html.escape(h)}</th>" for h in header)
        return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in rows) + "</table>"

    parts = [f"<h1>{html.escape(report.title)}</h1><p>Valid pixels: {report.n_valid}</p>"]
    if report.stats is not None:
        parts.append("<h2>Distribution</h2>" + table(("statistic", "value"), report.stats.items()))
    if report.histogram:
        parts.append(bar_chart(report.histogram))
    if report.areas is not None:
        parts.append("<h2>Area by threshold</h2>" + table(("threshold", "pixels", "fraction", "hectares"), (r.values() for r in report.areas)))
    if report.series:
        parts.append("<h2>Series</h2>" + line_chart(report.series) + table(("period", "mean", "median", "pixels"), (r.values() for r in report.series)))
    if report.scatter:
        parts.append("<h2>Scatter</h2>" + scatter_chart(report.scatter, report.labels))
    parts += [f"<p>{html.escape(n)}</p>" for n in report.notes]
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(report.title)}</title><style>body{{font-family:sans-serif;max-width:50em;margin:2em auto}}td,th{{padding:.2em .8em;text-align:right}}svg{{width:100%}}</style></head><body>{"".join(parts)}</body></html>'


def to_image(report: Report, path: str) -> bool:
    """A PNG or PDF by the path's ending; False where matplotlib is missing."""
    try:
        from matplotlib.figure import Figure
    except ImportError:
        return False
    figure = Figure(figsize=(8, 9))
    wanted = [(n, x) for n, x in (("histogram", report.histogram), ("series", report.series), ("scatter", report.scatter)) if x]
    for i, (name, rows) in enumerate(wanted, 1):
        ax = figure.add_subplot(len(wanted), 1, i)
        if name == "histogram":
            ax.bar([r["low"] for r in rows], [r["n"] for r in rows], [r["high"] - r["low"] for r in rows], align="edge")
        elif name == "series":
            ax.plot([str(r["period"]) for r in rows], [r["mean"] for r in rows])
        else:
            ax.scatter([r["x"] for r in rows], [r["y"] for r in rows], s=4)
        ax.set_title(name)
    figure.savefig(path)
    return True


def write_all(report: Report, paths: dict[str, str]) -> tuple[dict[str, str], list[str]]:
    """Write the formats (csv, html, png, pdf) that are asked for; what fails is a warning, not the end. Returns what was written."""
    if not paths:
        raise ValueError("no output format")
    done, warnings = {}, []
    for kind, path in paths.items():
        try:
            if kind in {"png", "pdf"}:
                if not to_image(report, path):
                    warnings.append(f"{kind}: matplotlib is not installed")
                    continue
            else:
                text = {"csv": to_csv, "html": to_html}[kind](report)
                with open(path, "w", encoding="utf-8") as f:
                    f.write(text)
            done[kind] = path
        except (OSError, KeyError, ValueError) as e:
            warnings.append(f"{kind}: {e}")
    return done, warnings



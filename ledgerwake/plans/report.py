"""tearsheet(): one HTML page with inline SVG charts, no scripts. What reaches the driver has a bound for each chart: rows that its pixels show, bins, or quantiles at fixed ranks."""

from __future__ import annotations

from html import escape
from itertools import product
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.zones import wall_time, zone_of
from ..operators import curves
from ..operators.selection import quantiles
from ..sources.written import written
from .results import SimulationResult

_COLOURS = ("#2a6f97", "#c1666b", "#4f772d", "#8d6a9f")
_W, _H, _PAD = 760, 220, 46
N_BINS = 60


def _scale(values: list[float], low: float, high: float, span: tuple[float, float] | None = None):
    a, b = span or (min(values), max(values))
    return lambda v: low + (high - low) * ((v - a) / (b - a) if b > a else 0.5)


def _number(v: float) -> str:
    return f"{v:,.4g}"


def _frame(title: str, body: str, ys: list[float], left: str = "", right: str = "") -> str:
    head = f'<svg viewBox="0 0 {_W} {_H}" role="img" aria-label="{escape(title)}"><rect width="{_W}" height="{_H}" fill="#fff"/>'
    axis = f'<line x1="{_PAD}" y1="{_H - _PAD / 2}" x2="{_W - 8}" y2="{_H - _PAD / 2}" stroke="#999"/><line x1="{_PAD}" y1="8" x2="{_PAD}" y2="{_H - _PAD / 2}" stroke="#999"/>'
    labels = "".join(f'<text x="{_PAD - 4}" y="{y}" text-anchor="end">{_number(v)}</text>' for y, v in ((_H - _PAD / 2, min(ys)), (16, max(ys)))) if ys else ""
    ends = f'<text x="{_PAD}" y="{_H - 6}">{escape(left)}</text><text x="{_W - 8}" y="{_H - 6}" text-anchor="end">{escape(right)}</text>'
    return f"<section><h3>{escape(title)}</h3>{head}{axis}{body}{labels}{ends}</svg></section>"


def lines(title: str, xs: list, series: dict[str, list[float | None]], at: list[int] | None = None) -> str:
    """A line for each series; a gap where a value is missing. at: where the values stand, by default side by side."""
    at = list(range(len(xs))) if at is None else at
    known = [v for s in series.values() for v in s if v is not None]
    if not known:
        return _frame(title, "<text x='380' y='110'>No data</text>", [])
    x, y = _scale([], _PAD, _W - 8, (0, max([1, *at[-1:]]))), _scale(known, _H - _PAD / 2, 8)
    body = ""
    for (name, values), colour in zip(series.items(), _COLOURS):
        path, pen = "", "M"
        for k, v in zip(at, values):
            path, pen = (path, "M") if v is None else (f"{path}{pen}{x(k):.1f} {y(v):.1f}", "L")
        body += f'<path d="{path}" fill="none" stroke="{colour}" stroke-width="1.5"><title>{escape(name)}</title></path>'
    legend = "".join(f'<text x="{_PAD + 10 + 130 * k}" y="20" fill="{c}">{escape(n)}</text>' for k, (n, c) in enumerate(zip(series, _COLOURS))) if len(series) > 1 else ""
    return _frame(title, body + legend, known, str(xs[0])[:10] if xs else "", str(xs[-1])[:10] if xs else "")


def bars(title: str, names: list, series: dict[str, list[float | None]]) -> str:
    known = [0.0, *(v for s in series.values() for v in s if v is not None)]
    y, wide = _scale(known, _H - _PAD / 2, 8), (_W - _PAD - 8) / max(1, len(names))
    body = ""
    for j, ((name, values), colour) in enumerate(zip(series.items(), _COLOURS)):
        w = wide * 0.8 / len(series)
        for k, v in enumerate(values):
            if v is not None:
                top, base = sorted((y(v), y(0)))
                body += f'<rect x="{_PAD + k * wide + j * w:.1f}" y="{top:.1f}" width="{w:.1f}" height="{base - top:.1f}" fill="{colour}"><title>{escape(f"{names[k]} {name}: {_number(v)}")}</title></rect>'
    return _frame(title, body, known, str(names[0]) if names else "", str(names[-1]) if names else "")


def points(title: str, pairs: list[tuple[float, float]], fit: tuple[float, float] | None = None) -> str:
    """A scatter chart with the line of slope and intercept."""
    if len(pairs) < 3:
        return _frame(title, "<text x='380' y='110'>No data</text>", [])
    xs, ys = zip(*pairs)
    x, y = _scale(list(xs), _PAD, _W - 8), _scale(list(ys), _H - _PAD / 2, 8)
    body = "".join(f'<circle cx="{x(a):.1f}" cy="{y(b):.1f}" r="2.5" fill="{_COLOURS[0]}"/>' for a, b in pairs)
    if fit and None not in fit:
        a, b = min(xs), max(xs)
        body += f'<line x1="{x(a):.1f}" y1="{y(fit[0] * a + fit[1]):.1f}" x2="{x(b):.1f}" y2="{y(fit[0] * b + fit[1]):.1f}" stroke="{_COLOURS[1]}"/>'
    return _frame(title, body, list(ys), _number(min(xs)), _number(max(xs)))


def heat(title: str, down: list[str], across: list[str], cells: dict[tuple[str, str], float | None]) -> str:
    known = [v for v in cells.values() if v is not None]
    w, h = (_W - 120) / max(1, len(across)), (_H - 40) / max(1, len(down))
    shade = _scale(known or [0.0], 0, 1)
    body = ""
    for i, a in enumerate(down):
        body += f'<text x="4" y="{30 + h * (i + 0.6):.1f}">{escape(a)}</text>'
        for j, b in enumerate(across):
            v = cells.get((a, b))
            fill = "#eee" if v is None else f"rgb({int(255 - 190 * shade(v))},{int(240 - 90 * shade(v))},255)"
            body += f'<rect x="{110 + j * w:.1f}" y="{30 + i * h:.1f}" width="{w:.1f}" height="{h:.1f}" fill="{fill}"/><text x="{110 + (j + 0.5) * w:.1f}" y="{30 + (i + 0.6) * h:.1f}" text-anchor="middle">{"" if v is None else _number(v)}</text>'
    body += "".join(f'<text x="{110 + (j + 0.5) * w:.1f}" y="22" text-anchor="middle">{escape(b)}</text>' for j, b in enumerate(across))
    return f'<section><h3>{escape(title)}</h3><svg viewBox="0 0 {_W} {_H}">{body}</svg></section>'


def grid_chart(found, grid_index: int, title: str | None = None) -> str:
    grid = found.param_grids[grid_index]
    rows = found.for_grid(grid_index).orderBy("position").collect()
    if grid.is_1d():
        name, values = grid.params[0]
        order = sorted(range(len(values)), key=lambda k: values[k]) if all(isinstance(v, (int, float)) for v in values) else range(len(values))
        return lines(title or f"{found.objective_metric} vs {name}", [str(values[k]) for k in order], {found.objective_metric: [rows[k]["objective_value"] for k in order]})
    (a, down), (b, across) = grid.params
    names = [str(v) for v in down], [str(v) for v in across]
    return heat(title or f"{found.objective_metric}: {a} x {b}", *names, dict(zip(product(*names), (r["objective_value"] for r in rows))))


def histogram(series: DataFrame, column: str, bins: int = N_BINS) -> DataFrame:
    """(bin, low, high, count) of the column between its least and greatest value, bins of equal width; the greatest one falls in the last."""
    edges = series.agg(F.min(column).alias("a"), F.max(column).alias("b"))
    width = (F.col("b") - F.col("a")) / bins
    at = F.least(F.floor(F.try_divide(F.col(column) - F.col("a"), width)), F.lit(bins - 1))
    counted = series.filter(F.col(column).isNotNull()).join(edges).groupBy(F.coalesce(at, F.lit(0)).cast("int").alias("bin"), "a", "b").count()
    return counted.select("bin", (F.col("a") + F.col("bin") * width).alias("low"), (F.col("a") + (F.col("bin") + 1) * width).alias("high"), "count").orderBy("bin")


def reduced(series: DataFrame, names: list[str], pixels: int = _W) -> DataFrame:
    """The rows of which a chart so many pixels wide is drawn: for each column of pixels the first and the last one, and those of the least and the greatest value of each series. The line is the same, and what leaves Spark has a bound; all rows where there are no more than that."""
    last = series.agg(F.max("t_idx")).first()[0] or 0
    if last < 4 * pixels:
        return series
    own = [F.min("t_idx"), F.max("t_idx"), *(f("t_idx", n) for n in names for f in (F.min_by, F.max_by))]
    kept = series.groupBy(F.floor(F.col("t_idx") * pixels / (last + 1))).agg(F.array_distinct(F.array(*own)).alias("_t"))
    return series.join(F.broadcast(kept.select(F.explode("_t").alias("t_idx")).filter("t_idx is not null")), "t_idx")


def reduced_points(rows: DataFrame, x: str, y: str, pixels: int = _W) -> DataFrame:
    """(x, y) of one row for each pixel of a chart that has any, if there are more rows than pixels in its width."""
    size = rows.agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{c}_{f.__name__}") for c in {x, y} for f in (F.min, F.max))).first()
    own = rows.select(x, y)
    if size["n"] <= 4 * pixels:
        return own
    cell = lambda c, n: F.floor(F.try_divide(F.col(c) - size[f"{c}_min"], F.lit(float(size[f"{c}_max"] - size[f"{c}_min"]))) * n)
    return own.groupBy(cell(x, pixels), cell(y, _H)).agg(F.min(F.struct(x, y)).alias("p")).select("p.*")


def quantile_pairs(series: DataFrame, column: str, most: int = 200) -> list[tuple[float, float]]:
    """A normal distribution's quantiles and those of the column: of every value, or of so many ranks that lie evenly apart."""
    values = written(series.select("run_id", F.col(column)).filter(F.col(column).isNotNull()), "returns")
    n = values.count()
    ranks = sorted({round(k * (n - 1) / max(1, min(n, most) - 1)) for k in range(min(n, most))})
    found = {r["at"]: r["quantile"] for r in quantiles(values, ["run_id"], column, [k / max(1, n - 1) for k in ranks]).collect()} if n else {}
    return [(NormalDist().inv_cdf((rank + 0.5) / n), found[k]) for k, rank in enumerate(ranks)]


def _columns(df: DataFrame, *names: str, by: str = "t_idx") -> list[list]:
    rows = df.select(by, *names).orderBy(by).collect()
    return [[r[n] for r in rows] for n in names]


def _metric_table(result: SimulationResult) -> str:
    rows = "".join(
        f"<tr><td>{escape(r['category'])}</td><td>{escape(r['metric'])}</td><td>{escape(_shown(r))}</td><td>{escape(r['note'])}</td></tr>" for r in result.metrics.orderBy("ordinal").collect()
    )
    return f"<section><h3>Metrics</h3><table><tr><th>Category</th><th>Metric</th><th>Value</th><th>Note</th></tr>{rows}</table></section>"


def _shown(r) -> str:
    if r["value_double"] is not None:
        return _number(r["value_double"])
    return r["value_string"] or (str(r["value_ts"]) if r["value_ts"] is not None else "-")


def _series_charts(result: SimulationResult, smooth: int) -> list[str]:
    art, zone = result.artifacts, zone_of(result.panel)

    def chart(title: str, table: DataFrame, names: dict[str, str], factor: float = 1.0) -> str:
        rows = reduced(table, list(names.values())).withColumn("_shown", wall_time(F.col("ts"), zone))
        at, ts, *found = _columns(rows, "t_idx", "_shown", *names.values())
        return lines(title, ts, {n: [None if v is None else v * factor for v in column] for n, column in zip(names, found)}, at)

    table, own = art.table, {"Portfolio": "equity_pct"}
    if result.benchmark_equity is not None:
        table, own = table.join(art.benchmark_equity_pct.select("t_idx", "benchmark_equity_pct"), "t_idx", "left"), own | {"Benchmark": "benchmark_equity_pct"}
    window = max(2, smooth) if smooth > 0 else 30
    sharpe = art.rolling_sharpe(window, 6 if not smooth else min(max(2, window // 5), window))
    out = [chart("Equity Curve (Cumulative Return %)", table, own), chart("Drawdown (%)", art.table, {"Drawdown": "drawdown_pct"}), chart(f"Rolling Sharpe ({window} periods, annualized)", sharpe, {"Sharpe": "rolling_sharpe"})]
    bins = histogram(art.table, "returns_pct").collect()
    shape = art.table.agg(F.skewness("returns_pct").alias("s"), F.kurtosis("returns_pct").alias("k")).first()
    by_bin = {r["bin"]: r["count"] for r in bins}
    out.append(bars("Returns Distribution (Per-Period, %)", [_number(b["low"]) for b in bins], {f"count; skew {shape['s'] or 0:.2f}, kurtosis {shape['k'] or 0:.2f}": [by_bin[b["bin"]] for b in bins]}))
    out.append(points("Returns Q-Q Plot", quantile_pairs(art.table, "returns_pct")))

    def smoothed(title: str, *names: str, factor: float = 1.0) -> str:
        table = art.table
        for n in names:
            table = curves.smoothed(table, n, smooth)
        return chart(title, table, {n: n for n in names}, factor)

    return [
        *out, smoothed("Transaction Costs (% of Portfolio)", "transaction_costs", factor=100.0), smoothed("Active Positions (Count)", "n_positions"),
        smoothed("Net and Gross Exposure (% of Portfolio)", "net_exposure", "gross_exposure", factor=100.0), smoothed("Position Concentration (Herfindahl Index)", "concentration"),
    ]


def _signal_charts(result: SimulationResult) -> list[str]:
    sections = result.artifacts.signal
    table, out = sections.weight_forward, []
    for title, x in (("Signal Directionality vs Next-Period Return", "directionality"), ("Signal IC vs Next-Period Return", "ic")):
        known = table.filter(F.col(x).isNotNull() & F.col("forward_return_per_gross").isNotNull())
        fit = known.agg(F.regr_slope("forward_return_per_gross", x), F.regr_intercept("forward_return_per_gross", x)).first()
        pairs = reduced_points(known, x, "forward_return_per_gross").collect()
        out.append(points(title, [tuple(p) for p in pairs], tuple(fit)))
    lag, *means = _columns(sections.alpha_decay_next_return_by_type, "lag", "total_mean", "selection_mean", "directional_mean", by="lag")
    out.append(lines("Signal: Alpha Decay by Lag (Next-Period Return per Gross)", lag, dict(zip(("total", "selection", "directional"), means))))
    horizon, *means = _columns(sections.decay_horizons, "horizon", "ic_mean", "rank_ic_mean", "decile_spread_mean", by="horizon")
    out.append(lines("Signal: Multi-Horizon Decay", horizon, dict(zip(("IC", "rank IC", "decile spread"), means))))
    largest = sections.by_asset.orderBy(F.desc_nulls_last(F.abs("alpha_contribution_pct")), "asset_idx").limit(20).collect()
    out.append(bars("Signal: Per-Asset Breakdown (top 20)", [r["asset"] for r in largest], {"contribution %": [r["alpha_contribution_pct"] for r in largest]}))
    decile, mean, median, longs, shorts = _columns(sections._table(lambda: _deciles(result)), "decile", "mean", "median", "contrib_long", "contrib_short", by="decile")
    out.append(bars("Signal: Next-Period Return by Weight Decile (Mean/Median)", decile, {"mean": mean, "median": median}))
    out.append(bars("Signal: Next-Period Return Contribution by Weight Decile (Long/Short)", decile, {"long": longs, "short": shorts}))
    return out


def _deciles(result: SimulationResult) -> DataFrame:
    from ..operators.signal import decile_curves

    return decile_curves(result.panel)


def tearsheet(*, sim_result: SimulationResult | None = None, grid_results=None, output_path: str | None = None, smooth_periods: int = 0) -> str:
    """The page, which is also written to output_path. Of a result, or of the best one of a grid search, whose charts it then has too. smooth_periods smooths charts of series, and is the rolling Sharpe ratio's window."""
    result = sim_result or (grid_results.best.result if grid_results is not None and grid_results.best else None)
    if result is None:
        raise TypeError("a sim_result, or grid_results with a best one, is needed")
    parts = [_metric_table(result), *_series_charts(result, smooth_periods)]
    if result.config.compute_signal_diagnostics:
        parts += _signal_charts(result)
    if grid_results is not None:
        parts += ["<h2>Parameter Search</h2>", *(grid_chart(grid_results, k) for k in range(len(grid_results.param_grids)))]
    style = "body{font:14px sans-serif;max-width:820px;margin:auto}svg text{font:10px sans-serif;fill:#444}td,th{text-align:left;padding:2px 8px;border-bottom:1px solid #ddd}"
    page = f'<!doctype html><html><head><meta charset="utf-8"><title>Tearsheet</title><style>{style}</style></head><body><h1>Tearsheet</h1>{"".join(parts)}</body></html>'
    if output_path:
        with open(output_path, "w", encoding="utf-8") as f:
            f.write(page)
    return page

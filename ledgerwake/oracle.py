"""The SQL that gives the same rows as the queries: shared steps as common table expressions, of which a query takes those it needs."""

from __future__ import annotations

import re

INIT, LEAST, FEE, SLIP, RISK_FREE, COST = 1000.0, 10.0, 0.001, 0.0005, 0.01, 0.001
BENCHMARK = "Brand#11"
HORIZONS = [1, 3, 5, 10]
DECAY = 0.8
LEAST_PERIODS = 3
#: Added before rounding.
OFF_TIES = 3e-10
#: run, lookback, power
GRID = [("1-a", 1, 0.5), ("1-b", 1, 1.0), ("2-a", 3, 0.5), ("2-b", 3, 1.0), ("3-a", 6, 0.5), ("3-b", 6, 1.0)]
AF = 365 / 30
RF = (1 + RISK_FREE) ** (1 / AF) - 1

_PANEL_BY = "PARTITION BY run_id, asset_idx ORDER BY t_idx"
_SO_FAR = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def _tstat(x: str) -> str:
    return f"CASE WHEN min({x}) < max({x}) THEN avg({x}) / (stddev_samp({x}) / sqrt(count({x}))) END"


def _corr(x: str, y: str) -> str:
    return f"CASE WHEN min({x}) < max({x}) AND min({y}) < max({y}) THEN covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0) END"


def _cells(source: str, runs: str) -> dict[str, str]:
    """From prices to weights, for runs (run_id, lookback, power)."""
    across = "PARTITION BY run_id, t_idx"
    return {
        f"{source}_change": f"SELECT r.run_id, r.power, p.*, close / nullif(lag(close, r.lookback) OVER (PARTITION BY r.run_id, asset_idx ORDER BY t_idx), 0) - 1 AS change FROM priced p CROSS JOIN {runs} r",
        f"{source}_m": f"SELECT *, sign(change) * pow(abs(change), power) AS m FROM {source}_change",
        f"{source}_z": f"SELECT *, (m - avg(m) OVER ({across})) / nullif(stddev_samp(m) OVER ({across}), 0) AS z0 FROM {source}_m",
        f"{source}_c": f"SELECT *, CASE WHEN z0 IS NOT NULL THEN greatest(least(z0, 3.0), -3.0) END AS z FROM {source}_z",
        f"{source}_w": f"SELECT *, z / nullif(sum(abs(z)) OVER ({across}), 0) AS w0 FROM {source}_c",
        source: f"SELECT run_id, t_idx, ts, asset, asset_idx, lag(w0) OVER ({_PANEL_BY}) AS weight, close, exec, funding FROM {source}_w",
    }


def _replayed(prefix: str, panel: str, fee: float = FEE, slip: float = SLIP, least: float = LEAST) -> dict[str, str]:
    """The replay as a recursion over periods, with the units held as a list."""
    each = "range(1, n + 1)"
    return {
        f"{prefix}lists": f"""SELECT run_id, t_idx, ts, list(coalesce(weight, 0) ORDER BY asset_idx) AS w, list(exec IS NULL OR exec = 0 ORDER BY asset_idx) AS miss,
            list(ep ORDER BY asset_idx) AS ep, list(cp ORDER BY asset_idx) AS cp, list(CASE WHEN close IS NULL THEN 0.0 ELSE coalesce(funding, 0) END ORDER BY asset_idx) AS fr, list(asset_idx ORDER BY asset_idx) AS assets
            FROM (SELECT *, coalesce(last_value(nullif(exec, 0) IGNORE NULLS) OVER (own {_SO_FAR}), 0) AS ep, coalesce(last_value(close IGNORE NULLS) OVER (own {_SO_FAR}), 0) AS cp
                FROM {panel} WINDOW own AS ({_PANEL_BY})) GROUP BY run_id, t_idx, ts""".replace("OVER (own ROWS", f"OVER ({_PANEL_BY} ROWS").replace(f" WINDOW own AS ({_PANEL_BY})", ""),
        f"{prefix}rec": f"""SELECT run_id, -1::BIGINT AS t_idx, NULL::DOUBLE AS eb, {INIT}::DOUBLE AS cash, list_transform(w, lambda x: 0.0::DOUBLE) AS pos, list_transform(w, lambda x: 0.0::DOUBLE) AS d FROM {prefix}lists WHERE t_idx = 0
            UNION ALL
            SELECT run_id, t_idx, eb, cash - list_sum(d) - {fee} * list_sum(list_transform(d, lambda x: abs(x))) - list_sum(list_transform({each}, lambda i: fr[i] * pos2[i] * cp[i])), pos2, d
            FROM (SELECT *, list_transform({each}, lambda i: pos[i] + CASE WHEN d[i] = 0 THEN 0 WHEN d[i] > 0 THEN d[i] / (ep[i] * {1 + slip}) ELSE d[i] / (ep[i] * {1 - slip}) END) AS pos2
                FROM (SELECT *, list_transform({each}, lambda i: CASE WHEN w[i] <> 0 AND (miss[i] OR abs(w[i] * eb - pos[i] * ep[i]) < {least}) THEN 0.0 ELSE w[i] * eb - pos[i] * ep[i] END) AS d
                    FROM (SELECT p.*, len(p.w) AS n, r.pos, r.cash, r.cash + list_dot_product(r.pos, p.ep) AS eb FROM {prefix}rec r JOIN {prefix}lists p ON p.run_id = r.run_id AND p.t_idx = r.t_idx + 1)))""",
        f"{prefix}valued": f"""SELECT r.*, p.ts, p.assets, list_transform(range(1, len(d) + 1), lambda i: pos[i] * cp[i]) AS cn, list_sum(list_transform(range(1, len(d) + 1), lambda i: -fr[i] * pos[i] * cp[i])) AS funding,
            list_sum(list_transform(d, lambda x: greatest(x, 0.0))) AS buys, list_sum(list_transform(d, lambda x: greatest(-x, 0.0))) AS sells
            FROM {prefix}rec r JOIN {prefix}lists p USING (run_id, t_idx)""",
        f"{prefix}worth": f"SELECT *, cash + list_sum(cn) AS equity FROM {prefix}valued",
        f"{prefix}shared": f"SELECT *, list_transform(cn, lambda x: CASE WHEN equity = 0 THEN 0 ELSE x / equity END) AS share FROM {prefix}worth",
        f"{prefix}moved": f"SELECT *, lag(share) OVER (PARTITION BY run_id ORDER BY t_idx) AS before FROM {prefix}shared",
        f"{prefix}periods": f"""SELECT run_id, t_idx, ts, equity, cash, coalesce(equity / nullif(lag(equity) OVER (PARTITION BY run_id ORDER BY t_idx), 0) - 1, 0) AS ret,
            {fee} * (buys + sells) AS fees, funding, buys * {slip} / (1 + {slip}) + sells * {slip} / (1 - {slip}) AS slippage, CASE WHEN eb = 0 THEN 0 ELSE least(buys, sells) / abs(eb) END AS turnover,
            CASE WHEN before IS NULL THEN 0 ELSE 0.5 * list_sum(list_transform(range(1, len(share) + 1), lambda i: abs(share[i] - before[i]))) END AS weight_turnover,
            coalesce(list_sum(list_transform(cn, lambda x: abs(x))) / nullif(abs(equity), 0), 0) AS gross_exposure, coalesce(list_sum(cn) / nullif(abs(equity), 0), 0) AS net_exposure,
            len(list_filter(d, lambda x: x <> 0))::BIGINT AS order_count, buys + sells AS order_notional FROM {prefix}moved""",
    }


def _period_facts(prefix: str) -> dict[str, str]:
    return {
        f"{prefix}drawdowns": f"SELECT *, equity / nullif(peak, 0) - 1 AS drawdown FROM (SELECT *, max(equity) OVER (PARTITION BY run_id ORDER BY t_idx {_SO_FAR}) AS peak FROM {prefix}periods)",
        f"{prefix}sums": f"""SELECT run_id, min(ts) AS start_date, max(ts) AS end_date, min(ts) FILTER (order_count > 0) AS first_transaction, count(*) AS n, product(1 + ret) AS growth, stddev_samp(ret) * sqrt({AF}) AS volatility,
            min(drawdown) * 100 AS max_drawdown_pct, max_by(equity, t_idx) AS last, sum(funding) AS funding_earned, sum(fees) AS fees_paid, sum(slippage) AS slipped, avg(funding) AS funding_mean,
            avg(turnover) AS turnover_mean, avg(weight_turnover) AS weight_turnover_mean, sum(order_count)::BIGINT AS order_total, sum(order_notional) AS ordered,
            avg(gross_exposure) * 100 AS gross_mean_pct, max(gross_exposure) * 100 AS gross_max_pct, avg(net_exposure) * 100 AS net_mean_pct, max(abs(net_exposure)) * 100 AS net_max_pct,
            skewness(ret) AS skewness, kurtosis(ret) AS kurtosis, max(ret) AS best_return, min(ret) AS worst_return, count(*) FILTER (ret > 0) AS wins, count(*) FILTER (ret < 0) AS losses,
            sum(greatest(ret, 0)) AS gained, sum(least(ret, 0)) AS lost, stddev_samp(ret) FILTER (ret < 0) * sqrt({AF}) AS downside, quantile_cont(ret, 0.05) AS var_95, sqrt(avg((100 * drawdown) ** 2)) AS ulcer0
            FROM {prefix}drawdowns GROUP BY run_id""",
        f"{prefix}first_facts": f"SELECT *, CASE WHEN growth >= 0 THEN pow(growth, {AF} / n) - 1 END AS annual_return, last - {INIT} AS total_return FROM {prefix}sums",
        f"{prefix}period_facts": f"""SELECT *, CASE WHEN volatility > 0 THEN (annual_return - {RISK_FREE}) / volatility END AS sharpe, (last / {INIT} - 1) * 100 AS total_return_pct,
            funding_earned / nullif(total_return, 0) * 100 AS funding_pct_return, funding_earned / nullif(total_return, 0) * 100 AS funding_pct_pnl, turnover_mean * {AF} AS turnover_annual, weight_turnover_mean * {AF} AS weight_turnover_annual,
            coalesce(ordered / nullif(order_total, 0), 0) AS order_mean, annual_return / nullif(abs(max_drawdown_pct / 100), 0) AS calmar, wins / nullif(wins + losses, 0) AS hit_rate,
            gained / nullif(abs(lost), 0) AS profit_factor, gained / nullif(abs(lost), 0) AS omega, (fees_paid + slipped) / nullif(abs(total_return + fees_paid + slipped), 0) * 100 AS costs_pct_gross,
            CASE WHEN losses > 1 THEN downside ELSE 0.0 END AS downside_deviation, CASE WHEN losses > 1 AND downside > 0 THEN (annual_return - {RISK_FREE}) / downside END AS sortino,
            ulcer0 * sqrt({AF} / n) AS ulcer FROM {prefix}first_facts""",
    }


_GRID_VALUES = ", ".join(f"('{r}', {k}, {p})" for r, k, p in GRID)
FORWARD = f"SELECT *, lead(close) OVER ({_PANEL_BY}) / nullif(close, 0) - 1 AS forward FROM panel"
_XKEY = "PARTITION BY run_id, t_idx"


def _ranked(source: str, key: str) -> str:
    return f"""SELECT *, rank() OVER ({key} ORDER BY weight) + (count(*) OVER ({key}, weight) - 1) / 2 AS weight_rank, rank() OVER ({key} ORDER BY forward) + (count(*) OVER ({key}, forward) - 1) / 2 AS forward_rank,
        count(*) OVER ({key}) AS n, CASE WHEN count(*) OVER ({key}) >= 10 THEN (row_number() OVER ({key} ORDER BY weight, asset_idx) - 1) * 10 // count(*) OVER ({key}) END AS decile
        FROM {source} WHERE weight <> 0 AND forward IS NOT NULL"""


def _core() -> str:
    return f"{_corr('weight', 'forward')} AS ic, {_corr('weight_rank', 'forward_rank')} AS rank_ic, avg(forward) FILTER (decile = 9) - avg(forward) FILTER (decile = 0) AS top_bottom_spread"


def _side(name: str, ours: str, hits: str) -> str:
    own = f"sum(abs(weight)) FILTER ({ours})"
    return f"{own} AS {name}_gross_weight, coalesce(sum(abs(weight)) FILTER ({ours} AND {hits}), 0) / {own} AS {name}_hit_weighted, sum(weight * forward) FILTER ({ours}) / {own} AS {name}_forward_return_per_gross"


STEPS = {
    "sold": "SELECT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS ts, p_brand AS asset, sum(l_extendedprice) / nullif(sum(l_quantity), 0) AS close, (avg(l_discount) - 0.05) / 100 AS funding FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "months": "SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS t_idx FROM (SELECT DISTINCT ts FROM sold)",
    "brands": "SELECT asset, row_number() OVER (ORDER BY asset) - 1 AS asset_idx FROM (SELECT DISTINCT asset FROM sold)",
    "cells": "SELECT m.t_idx, m.ts, b.asset, b.asset_idx, s.close, s.funding FROM months m CROSS JOIN brands b LEFT JOIN sold s ON s.ts = m.ts AND s.asset = b.asset",
    "priced": "SELECT *, CASE WHEN t_idx = 0 THEN close ELSE lag(close) OVER (PARTITION BY asset_idx ORDER BY t_idx) END AS exec FROM cells",
    "one": "SELECT 'run' AS run_id, 3 AS lookback, 1.0 AS power",
    **_cells("panel", "one"),
    **_replayed("", "panel"),
    "positions": "SELECT run_id, t_idx, ts, equity, unnest(assets) AS asset_idx, unnest(pos) AS units, unnest(d) AS order_value, unnest(cn) AS close_value FROM worth",
    "exposures": "SELECT run_id, t_idx, " + ", ".join(
        f"coalesce(sum(greatest({x}, 0)) / nullif(max(equity), 0), 0) AS long_exposure{s}, coalesce(sum(least({x}, 0)) / nullif(max(equity), 0), 0) AS short_exposure{s}, coalesce(sum({x} * {x}) / nullif(sum(abs({x})) ** 2, 0), 0) AS concentration{s}" for x, s in (("units", ""), ("close_value", "_notional"))
    ) + " FROM positions GROUP BY run_id, t_idx",
    **_period_facts(""),
    "tail": "SELECT run_id, avg(ret) AS cvar_95 FROM periods JOIN sums USING (run_id) WHERE ret <= var_95 GROUP BY run_id",
    "under": "SELECT t_idx, coalesce(drawdown < 0, false) AS under, t_idx - row_number() OVER (PARTITION BY coalesce(drawdown < 0, false) ORDER BY t_idx) AS island FROM drawdowns",
    "duration": "SELECT coalesce(max(k), 0) AS drawdown_duration FROM (SELECT count(*) FILTER (under) AS k FROM under GROUP BY under, island)",
    "deepest": "SELECT t_idx AS trough, peak AS top, drawdown AS depth FROM drawdowns ORDER BY drawdown, t_idx LIMIT 1",
    "recovery": """SELECT trough, max(t_idx) FILTER (t_idx <= trough AND equity = top) AS peak_at, CASE WHEN depth >= 0 THEN 0 ELSE min(t_idx) FILTER (t_idx >= trough AND equity >= top) - max(t_idx) FILTER (t_idx <= trough AND equity = top) END AS time_to_recovery
        FROM drawdowns CROSS JOIN deepest GROUP BY trough, depth""",
    "sides": "SELECT asset_idx, t_idx, sign(units) AS side, t_idx - row_number() OVER (PARTITION BY asset_idx, sign(units) ORDER BY t_idx) AS island FROM positions",
    "holding": "SELECT avg(k) AS holding_period FROM (SELECT count(*) AS k FROM sides WHERE side <> 0 GROUP BY asset_idx, side, island)",
    "gaps": f"SELECT run_id, t_idx, ts, coalesce(last_value(close IGNORE NULLS) OVER (ORDER BY t_idx {_SO_FAR}), first_value(close IGNORE NULLS) OVER (ORDER BY t_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS price FROM panel WHERE asset = '{BENCHMARK}'",
    "bench": f"SELECT *, coalesce(price / nullif(lag(price) OVER (ORDER BY t_idx), 0) - 1, 0) AS benchmark_ret, {INIT} * price / nullif(first_value(price) OVER (ORDER BY t_idx), 0) AS benchmark_equity FROM gaps",
    "against": f"SELECT ret - {RF} AS y, benchmark_ret - {RF} AS x, ret - benchmark_ret AS active, ret, benchmark_ret FROM periods JOIN bench USING (t_idx)",
    "bench_facts": f"""SELECT *, (my - beta * mx) * {AF} AS alpha, CASE WHEN tracking_error > 0 THEN active_return_pct / 100 / tracking_error END AS information_ratio
        FROM (SELECT covar_samp(y, x) / nullif(var_samp(x), 0) AS beta, avg(y) AS my, avg(x) AS mx, (pow(product(1 + benchmark_ret), {AF} / count(*)) - 1) * 100 AS benchmark_return_pct, avg(active) * {AF} * 100 AS active_return_pct, stddev_samp(active) * sqrt({AF}) AS tracking_error, regr_r2(ret, benchmark_ret) AS r2 FROM against)""",
    "forward": FORWARD,
    "ranked": _ranked("forward", _XKEY),
    "measured": f"""SELECT run_id, t_idx, {_core()}, sum(abs(weight)) AS gross_weight, sum(weight) AS net_weight, sum(weight) / sum(abs(weight)) AS directionality,
        sum(weight * forward) AS forward_return, sum(weight * forward) / sum(abs(weight)) AS forward_return_per_gross,
        sum(weight) * avg(forward) AS forward_return_directional, sum(weight) * avg(forward) / sum(abs(weight)) AS forward_return_directional_per_gross,
        sum(weight * forward) - sum(weight) * avg(forward) AS forward_return_selection, (sum(weight * forward) - sum(weight) * avg(forward)) / sum(abs(weight)) AS forward_return_selection_per_gross,
        {_side('long', 'weight > 0', 'forward > 0')}, {_side('short', 'weight < 0', 'forward < 0')} FROM ranked WHERE n >= 2 GROUP BY run_id, t_idx""",
    "sections": "SELECT * FROM (SELECT DISTINCT run_id, t_idx, ts FROM panel) LEFT JOIN measured USING (run_id, t_idx)",
    "signal_facts": f"""SELECT avg(ic) AS ic_mean, {_tstat('ic')} AS ic_tstat, avg(rank_ic) AS rank_ic_mean, {_tstat('rank_ic')} AS rank_ic_tstat, avg(top_bottom_spread) AS spread_mean, {_tstat('top_bottom_spread')} AS spread_tstat,
        avg(long_hit_weighted) AS long_hit_mean, avg(short_hit_weighted) AS short_hit_mean, avg(forward_return_per_gross) AS per_gross_mean,
        avg(forward_return_selection_per_gross) AS selection_mean, {_tstat('forward_return_selection_per_gross')} AS selection_tstat, avg(gross_weight) AS gross_weight_mean, avg(directionality) AS directionality_mean,
        avg(ic * (1 - weight_turnover * {COST})) AS adjusted_ic_mean, avg(forward_return_per_gross - weight_turnover * {COST}) AS net_per_gross_mean FROM sections JOIN periods USING (run_id, t_idx)""",
    "facts": "SELECT * FROM period_facts CROSS JOIN tail CROSS JOIN duration CROSS JOIN recovery CROSS JOIN holding CROSS JOIN (SELECT max(abs(weight)) AS max_abs_weight FROM panel) CROSS JOIN bench_facts CROSS JOIN signal_facts",
    "many": f"SELECT * FROM (VALUES {_GRID_VALUES}) AS v(run_id, lookback, power)",
    **_cells("grid_panel", "many"),
    **_replayed("grid_", "grid_panel"),
    **_period_facts("grid_"),
    "folded": "SELECT *, CASE WHEN ts >= '1995-12-31' THEN year(ts + INTERVAL 1 DAY) - 1996 END AS fold FROM panel",
    "fold_panel": "SELECT 'fold-' || fold AS run_id, fold AS fold_index, t_idx - min(t_idx) OVER (PARTITION BY fold) AS t_idx, ts, asset, asset_idx, weight, close, exec, funding FROM folded WHERE fold IS NOT NULL",
    **_replayed("fold_", "fold_panel"),
    **_period_facts("fold_"),
    "lags": "SELECT CAST(range AS INTEGER) AS lag FROM range(0, 11) WHERE range <= (SELECT greatest(0, max(t_idx) - 1) FROM panel)",
    "lagged": "SELECT f.run_id, f.t_idx, f.forward, l.lag, p.weight FROM forward f CROSS JOIN lags l JOIN panel p ON p.asset_idx = f.asset_idx AND p.t_idx = f.t_idx - l.lag WHERE p.weight <> 0 AND f.forward IS NOT NULL",
    "lag_rows": "SELECT lag, t_idx, sum(weight * forward) / sum(abs(weight)) AS total, (sum(weight * forward) - sum(weight) * avg(forward)) / sum(abs(weight)) AS selection, sum(weight) * avg(forward) / sum(abs(weight)) AS directional FROM lagged GROUP BY lag, t_idx HAVING count(*) >= 2",
    "ahead": f"SELECT h.horizon, p.run_id, p.t_idx, p.asset_idx, p.weight, q.close / nullif(p.close, 0) - 1 AS forward FROM panel p CROSS JOIN (SELECT unnest({HORIZONS}) AS horizon) h JOIN panel q ON q.asset_idx = p.asset_idx AND q.t_idx = p.t_idx + h.horizon",
    "ahead_ranked": _ranked("ahead", "PARTITION BY horizon, t_idx"),
    "ahead_rows": f"SELECT horizon, t_idx, {_core()} FROM ahead_ranked WHERE n >= 2 GROUP BY horizon, t_idx",
}
_RECURSIVE = {"rec", "grid_rec", "fold_rec"}


def _needed(sql: str) -> list[str]:
    """The steps that the text names, and those that they name, in the order of STEPS."""
    found, todo = set(), [sql]
    while todo:
        words = set(re.findall(r"\b[a-z_]+\b", todo.pop()))
        new = (words & STEPS.keys()) - found
        found |= new
        todo += [STEPS[k] for k in new]
    return [k for k in STEPS if k in found]


def whole(keys: list[tuple[str, str]], numbers: list[str], sql: str) -> str:
    shown = [f"CAST({k} AS {t.upper().replace('INT', 'INTEGER').replace('BIGINTEGER', 'BIGINT')}) AS {k}" if t else k for k, t in keys]
    shown += [f"round(CAST({n} AS DOUBLE) + {OFF_TIES}, 6) + 0.0 AS {n}" for n in numbers]
    steps = ",\n".join(f"{k} AS ({STEPS[k]})" for k in _needed(sql))
    return (f"WITH RECURSIVE {steps}\n" if steps else "") + f"SELECT {', '.join(shown)} FROM ({sql})"


CARRIED = f"SELECT *, last_value(exec IGNORE NULLS) OVER ({_PANEL_BY} {_SO_FAR}) AS exec_carried, last_value(close IGNORE NULLS) OVER ({_PANEL_BY} {_SO_FAR}) AS close_carried FROM panel"
FRICTIONLESS = f"""
    SELECT t_idx, ts, {INIT} * coalesce(product(1 + coalesce(gain, 0) - paid) OVER (ORDER BY t_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) * (1 + inside - paid) AS equity
    FROM (SELECT t_idx, ts, sum(w * (next / ex - 1)) AS gain, sum(w * (cl / ex - 1)) AS inside, sum(f * w * cl / ex) AS paid
        FROM (SELECT *, lead(ex) OVER (PARTITION BY asset_idx ORDER BY t_idx) AS next
            FROM (SELECT t_idx, ts, asset_idx, coalesce(weight, 0) AS w, coalesce(funding, 0) AS f, coalesce(exec_carried, 1.0) AS ex, coalesce(close_carried, 1.0) AS cl FROM ({CARRIED}))) GROUP BY t_idx, ts)"""
ROLLING_SHARPE = f"SELECT *, CASE WHEN count(ret) OVER w >= 6 AND min(ret) OVER w < max(ret) OVER w THEN avg(ret - {RF}) OVER w / stddev_samp(ret - {RF}) OVER w * sqrt({AF}) END AS rolling_sharpe FROM periods WINDOW w AS (ORDER BY t_idx ROWS 29 PRECEDING)"
HISTOGRAM = """
    SELECT bin, a + bin * w AS low, a + (bin + 1) * w AS high, count(*) AS count
    FROM (SELECT a, w, least(floor((ret - a) / w), 19) AS bin FROM periods CROSS JOIN (SELECT min(ret) AS a, (max(ret) - min(ret)) / 20 AS w FROM periods)) GROUP BY bin, a, w"""
META = f"SELECT '30D' AS period_frequency, '{BENCHMARK}' AS benchmark_asset, start_date, end_date, first_transaction, {FEE} AS fee, {SLIP} AS slippage_rate, {INIT} AS init_cash, 365 AS trading_days_year, {RISK_FREE} AS risk_free_rate FROM sums"
DECILES = """
    SELECT d.decile, coalesce(c.count, 0) AS count, mean, median, std, contrib, contrib_long, contrib_short FROM (SELECT range AS decile FROM range(1, 11)) d LEFT JOIN (
        SELECT decile + 1 AS decile, avg(forward) AS mean, median(forward) AS median, stddev_samp(forward) AS std, count(*) AS count, sum(weight * forward) / count(*) AS contrib,
        coalesce(sum(weight * forward) FILTER (weight > 0), 0) / count(*) AS contrib_long, coalesce(sum(weight * forward) FILTER (weight < 0), 0) / count(*) AS contrib_short
        FROM ranked WHERE decile IS NOT NULL GROUP BY decile) c USING (decile)"""
ALPHA_DECAY = "SELECT * FROM lags LEFT JOIN (SELECT lag, " + ", ".join(f"avg({k}) AS {k}_mean, {_tstat(k)} AS {k}_tstat" for k in ("total", "selection", "directional")) + " FROM lag_rows GROUP BY lag) USING (lag)"
HORIZON_DECAY = f"SELECT * FROM (SELECT horizon FROM (SELECT unnest({HORIZONS}) AS horizon) WHERE horizon < (SELECT max(t_idx) + 1 FROM panel)) LEFT JOIN (SELECT horizon, " + ", ".join(f"avg({a}) AS {b}_mean, {_tstat(a)} AS {b}_tstat" for a, b in (("ic", "ic"), ("rank_ic", "rank_ic"), ("top_bottom_spread", "decile_spread"))) + " FROM ahead_rows GROUP BY horizon) USING (horizon)"
BY_ASSET = f"""
    SELECT *, alpha_contribution / nullif(sum(abs(alpha_contribution)) OVER (), 0) * 100 AS alpha_contribution_pct FROM (
        SELECT asset_idx, asset, coalesce(n, 0) AS n, ic_mean, hit_rate, avg_abs_weight, alpha_contribution FROM (SELECT DISTINCT asset_idx, asset FROM panel) LEFT JOIN (
            SELECT asset_idx, count(*) AS n, {_corr('weight', 'forward')} AS ic_mean, avg((sign(weight) = sign(forward))::INTEGER) AS hit_rate, avg(abs(weight)) AS avg_abs_weight, sum(weight * forward) AS alpha_contribution
            FROM forward WHERE weight <> 0 AND forward IS NOT NULL GROUP BY asset_idx HAVING count(*) >= 3) USING (asset_idx))"""
ROLLING_SIGNAL = "SELECT t_idx, ts, " + ", ".join(
    f"CASE WHEN count({a}) OVER w >= 8 THEN avg({a}) OVER w END AS {b}_mean, CASE WHEN count({a}) OVER w >= 8 AND min({a}) OVER w < max({a}) OVER w THEN avg({a}) OVER w / (stddev_samp({a}) OVER w / sqrt(count({a}) OVER w)) END AS {b}_tstat"
    for a, b in (("ic", "ic"), ("rank_ic", "rank_ic"), ("top_bottom_spread", "decile_spread"))
) + " FROM sections WINDOW w AS (ORDER BY t_idx ROWS 23 PRECEDING)"


def ewma(decay: float, least_periods: int) -> str:
    """The recursion mean = decay * mean before + (1 - decay) * change; a missing change leaves the mean, while what it is made of ages."""
    return f"""
    SELECT t_idx, ts, asset, asset_idx, CASE WHEN known >= {least_periods} THEN mean END AS ewma FROM (
        WITH RECURSIVE moved AS (
            SELECT t_idx, ts, asset, asset_idx, close / nullif(lag(close) OVER (PARTITION BY asset_idx ORDER BY t_idx), 0) - 1 AS c FROM panel
        ), smoothed AS (
            SELECT *, c AS mean, 1.0::DOUBLE AS aged, (c IS NOT NULL)::INTEGER AS known FROM moved WHERE t_idx = 0
            UNION ALL
            SELECT m.*, CASE WHEN m.c IS NULL THEN s.mean WHEN s.known = 0 THEN m.c ELSE (s.aged * {decay} * s.mean + (1 - {decay}) * m.c) / (s.aged * {decay} + 1 - {decay}) END,
                CASE WHEN m.c IS NULL THEN s.aged * {decay} ELSE 1.0 END::DOUBLE, s.known + (m.c IS NOT NULL)::INTEGER
            FROM smoothed s JOIN moved m ON m.asset_idx = s.asset_idx AND m.t_idx = s.t_idx + 1
        ) SELECT * FROM smoothed)"""


#: Of ewm(span=12).
SPAN_DECAY = 1 - 2 / (12 + 1)
GRID_SQL = "SELECT run_id, 0 AS grid_index, 'lookback x power' AS grid_name, row_number() OVER (ORDER BY run_id) - 1 AS position, lookback, power, sharpe AS objective_value FROM many LEFT JOIN grid_period_facts USING (run_id)"
FOLD_ROWS = "SELECT fold_index, min(ts) AS start_period, max(ts) AS end_period, max(t_idx) + 1 AS n_periods FROM fold_panel GROUP BY fold_index"
FOLD_FACTS = "SELECT CAST(substr(run_id, 6) AS INTEGER) AS fold_index, total_return_pct, sharpe, max_drawdown_pct, fees_paid FROM fold_period_facts"
FOLD_AGGREGATION = f"SELECT metric, count(v) AS count, median(v) AS median, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS std, min(v) AS min, max(v) AS max FROM (UNPIVOT (SELECT total_return_pct, sharpe, max_drawdown_pct, fees_paid FROM ({FOLD_FACTS})) ON COLUMNS(*) INTO NAME metric VALUE v) GROUP BY metric"


def tall(rows: list[tuple[int, str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT {k} AS ordinal, '{c}' AS category, '{n}' AS metric, CAST({col} AS DOUBLE) AS value_double FROM facts" for k, c, n, col in rows)


SEARCHED = f"""
    SELECT 0 AS grid_index, 'lookback x power' AS grid_name, position, CAST(lookback AS VARCHAR) AS param1_value, CAST(power AS VARCHAR) AS param2_value, NULL AS param_value, objective_value FROM ({GRID_SQL})
    UNION ALL
    SELECT 1, 'lookback', CASE run_id WHEN '2-b' THEN 0 ELSE 1 END, NULL, NULL, CAST(lookback AS VARCHAR), objective_value FROM ({GRID_SQL}) WHERE run_id IN ('1-b', '2-b')"""
_UNIT = "(CAST(('0x' || substr(md5('42:' || a.k || ':' || t.k || ':{}'), 1, 13)) AS BIGINT) + 1) / 4503599627370496.0"
#: 500 periods of 50 assets, whatever the tables hold.
SYNTHETIC = f"""
    SELECT CAST(t AS INTEGER) AS t_idx, 'ASSET_' || a AS asset, 100 * exp(sum(ln(1 + 0.0005 + 0.02 * z)) OVER (PARTITION BY a ORDER BY t)) AS close
    FROM (SELECT t.k AS t, a.k AS a, sqrt(-2 * ln({_UNIT.format(0)})) * cos(2 * pi() * {_UNIT.format(1)}) AS z FROM range(500) t(k), range(50) a(k))"""

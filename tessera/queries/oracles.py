"""DuckDB SQL for the panel queries, written from the operators' definitions, not from their Spark code."""

from __future__ import annotations

import re

from tessera.operators.features import BINARY, CONTINUOUS, SECTOR_MEANS, SECTOR_RELATIVE
from tessera.queries.proxy import CHANGES, GONE

ZERO = "cast(0 as double)"


def r6(x: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({x}, {digits}) + {ZERO} AS {name or x}"


def w(n: int, by: str = "PARTITION BY ticker") -> str:
    return f"({by} ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(agg: str, x: str, n: int, by: str = "PARTITION BY ticker") -> str:
    return f"CASE WHEN count({x}) OVER {w(n, by)} = {n} THEN {agg}({x}) OVER {w(n, by)} END"


def lag(x: str, k: int, by: str = "PARTITION BY ticker") -> str:
    return f"lag({x}, {k}) OVER ({by} ORDER BY date)"


RUN = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
T = "OVER (PARTITION BY ticker ORDER BY date)"
PRICES = ["open", "high", "low", "close", "adj_close"]
VALUES = ", ".join(f"(DATE '{d}', '{a}', '{b}', {k})" for k, (d, a, b) in enumerate(CHANGES))
HORIZON_ROWS = "(VALUES ('1d', 1), ('1w', 5), ('2w', 10), ('1m', 21), ('2m', 42)) h(horizon, horizon_days)"
D = {"revenue": "revenue", "net_income": "net_income", "operating_income": "operating_income"}


def _norm(c: str) -> str:
    return f"CASE WHEN replace({c}, '.', '-') IN ('', 'nan', 'None') THEN NULL ELSE replace({c}, '.', '-') END"


CTE: dict[str, str] = {
    "lines": "SELECT cast(l_shipdate AS date) AS date, n_name AS ticker, r_name AS sector, l_extendedprice AS p, l_quantity AS q, l_extendedprice / l_quantity AS u FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "prices": "SELECT date, ticker, min(sector) AS sector, (max(u) + min(u)) / 2 AS open, max(u) AS high, min(u) AS low, cast(sum(cast(p AS decimal(18,2))) AS double) / sum(q) AS close, cast(sum(cast(p AS decimal(18,2))) AS double) / sum(q) AS adj_close, sum(q) AS volume, 'trades' AS source FROM lines GROUP BY date, ticker",
    "cal": "SELECT DISTINCT cast(l_shipdate AS date) AS date FROM lineitem",
    "bench": "SELECT date, cast(sum(cast(p AS decimal(18,2))) AS double) / sum(q) AS adj_close FROM lines GROUP BY date",
    "vol": "SELECT date, 10 + 60 * (cast(sum(cast(p AS decimal(18,2))) AS double) / sum(q)) / max(u) AS adj_close FROM lines GROUP BY date",
    "rf": "SELECT date, CASE WHEN day(date) = 13 THEN NULL ELSE cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) / count(*) / 100000 END AS value FROM (SELECT cast(o_orderdate AS date) AS date, o_totalprice FROM orders) GROUP BY date",
    "grid": "SELECT t.ticker, c.date, p.* EXCLUDE (ticker, date), p.adj_close IS NOT NULL AS was_observed FROM (SELECT DISTINCT ticker FROM prices) t CROSS JOIN cal c LEFT JOIN prices p ON p.ticker = t.ticker AND p.date = c.date",
    "cleaned": "SELECT ticker, date, was_observed, "
    + ", ".join(f"last_value({c} IGNORE NULLS) OVER {w(6)} AS {c}" for c in [*PRICES, "volume"])
    + f", last_value(source IGNORE NULLS) {RUN} AS source FROM grid",
    "q0": f"SELECT ticker, date, was_observed, sum(was_observed::int) {RUN} AS isl, min(CASE WHEN was_observed THEN date END) {RUN} AS first_seen, max(CASE WHEN was_observed THEN date END) {RUN} AS last_seen, min(CASE WHEN was_observed THEN date END) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_seen FROM grid",
    "q1": "SELECT *, count(CASE WHEN NOT was_observed THEN 1 END) OVER (PARTITION BY ticker, isl ORDER BY date) AS missing_streak FROM q0",
    "quality": f"SELECT ticker, date, was_observed AS observed_price, cast(isl AS bigint) AS history_days, coalesce(date_diff('day', first_seen, date) + 1, 0) AS listing_age_days, coalesce(date_diff('day', next_seen, date) + 1, 0) AS compat_age_days, coalesce(cast(date_diff('day', last_seen, date) AS double), 'infinity'::double) AS stale_price_days, missing_streak, max(missing_streak) OVER {w(21)} AS max_missing_gap_21d FROM q1",
    "flags": "SELECT *, history_days < 252 AS insufficient_price_history, listing_age_days < 63 AS insufficient_post_listing_history, stale_price_days > 2 AS stale_price, max_missing_gap_21d > 5 AS missing_gap_fail FROM quality",
    "log": f"SELECT date, {_norm('a')} AS added, {_norm('b')} AS removed, seq FROM (VALUES {VALUES}) v(date, a, b, seq)",
    "touch": "SELECT ticker, change_date, arg_max(removal, ord) AS removal FROM (SELECT added AS ticker, date AS change_date, 2 * seq AS ord, false AS removal FROM log WHERE added IS NOT NULL UNION ALL SELECT removed, date, 2 * seq + 1, true FROM log WHERE removed IS NOT NULL) GROUP BY ticker, change_date",
    "listed": f"SELECT n_name AS ticker FROM nation WHERE n_name NOT IN ({', '.join(repr(x) for x in GONE)})",
    "everyone": "SELECT ticker FROM listed UNION SELECT ticker FROM touch",
    "tagged": "SELECT g.date, g.ticker, t.removal, g.ticker IN (SELECT ticker FROM listed) AS now FROM (SELECT c.date, e.ticker FROM cal c CROSS JOIN everyone e) g ASOF LEFT JOIN touch t ON g.ticker = t.ticker AND g.date <= t.change_date",
    "members": "SELECT date, ticker, true AS is_member, CASE WHEN date > (SELECT min(date) FROM log) THEN cast(0.9 AS double) ELSE cast(0.5 AS double) END AS membership_reliability FROM tagged WHERE coalesce(removal, now)",
    "meta": "SELECT n_name AS ticker, r_name AS sector, r_name || '-' || (n_nationkey % 3) AS industry FROM nation JOIN region ON n_regionkey = r_regionkey",
    "universe": f"SELECT m.*, coalesce(sector, 'Unknown') AS sector, coalesce(industry, 'Unknown') AS industry, membership_reliability >= 0.7 AS universe_reliable, min(date) OVER (PARTITION BY m.ticker) AS first_membership_date, row_number() OVER (PARTITION BY m.ticker ORDER BY date) AS membership_days FROM members m LEFT JOIN meta ON meta.ticker = m.ticker",
    "obq": "SELECT n_name AS ticker, n_nationkey, cast(o_orderdate AS date) AS date, date_trunc('quarter', cast(o_orderdate AS date))::date AS quarter, o_totalprice, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "earn": "SELECT ticker, max(date) AS earnings_date, cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) / count(*) / 10000 AS surprise_pct FROM obq WHERE o_orderpriority = '1-URGENT' GROUP BY ticker, quarter",
    "fil0": "SELECT ticker, n_nationkey, quarter, cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) AS revenue, count(*) AS n, last_day(quarter + INTERVAL 2 MONTH) AS period_end FROM obq GROUP BY ticker, n_nationkey, quarter",
    "filings": "SELECT ticker, cast(period_end + INTERVAL 45 DAY AS date) AS filed_at, period_end, CASE WHEN quarter(quarter) = 4 AND n_nationkey % 2 = 0 THEN '10-K' ELSE '10-Q' END AS form, revenue, revenue * 0.05::double + n * 100 AS net_income, revenue * 3 + n * 1000 AS total_assets, revenue * 1.2::double AS total_liabilities, revenue * 1.5::double + n * 777 AS stockholders_equity, revenue * 0.2::double AS cash_and_equivalents, revenue / 100 AS common_shares_outstanding, revenue * 0.15::double AS operating_income, revenue * 0.05::double AS depreciation_amortization FROM fil0",
    "ttm": "SELECT ticker, filed_at, period_end, form, total_assets, total_liabilities, stockholders_equity, cash_and_equivalents, common_shares_outstanding, "
    + ", ".join(f"coalesce(CASE WHEN count(CASE WHEN form = '10-Q' THEN {c} END) OVER f = 4 THEN sum(CASE WHEN form = '10-Q' THEN {c} END) OVER f END, CASE WHEN form = '10-K' THEN {c} END) AS {c}_ttm" for c in D)
    + ", sum(CASE WHEN form = '10-Q' THEN depreciation_amortization END) OVER f AS depreciation_ttm, CASE WHEN form = '10-Q' THEN revenue END / lag(CASE WHEN form = '10-Q' THEN revenue END, 4) OVER o - 1 AS revenue_growth_yoy, total_assets / lag(total_assets, 4) OVER o - 1 AS assets_growth_yoy FROM filings WINDOW f AS (PARTITION BY ticker ORDER BY filed_at, period_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), o AS (PARTITION BY ticker ORDER BY filed_at, period_end)",
    "macro": f"SELECT b.date, b.adj_close AS spx_close, {', '.join(f'b.adj_close / nullif(lag(b.adj_close, {k}) OVER (ORDER BY b.date), 0) - 1 AS spx_ret_{k}d' for k in (1, 5, 21, 63))}, CASE WHEN count(*) OVER (ORDER BY b.date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) = 200 AND b.adj_close > avg(b.adj_close) OVER (ORDER BY b.date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) THEN cast(1 AS double) ELSE {ZERO} END AS spx_above_200d, v.vix_close, v.vix_change_5d, r.risk_free_rate FROM bench b LEFT JOIN (SELECT date, adj_close AS vix_close, adj_close / lag(adj_close, 5) OVER (ORDER BY date) - 1 AS vix_change_5d FROM vol) v ON v.date = b.date LEFT JOIN (SELECT date, last_value(value / 100 IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS risk_free_rate FROM rf) r ON r.date = b.date",
    "base": f"SELECT c.* EXCLUDE (source), f.* EXCLUDE (ticker, date), u.membership_reliability, u.universe_reliable, u.sector, u.industry, m.* EXCLUDE (date), last_value(c.adj_close IGNORE NULLS) OVER (PARTITION BY c.ticker ORDER BY c.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS px FROM cleaned c LEFT JOIN flags f ON f.ticker = c.ticker AND f.date = c.date JOIN universe u ON u.ticker = c.ticker AND u.date = c.date LEFT JOIN macro m ON m.date = c.date",
    "rets": "SELECT *, " + ", ".join(f"px / nullif({lag('px', k)}, 0) - 1 AS ret_{k}d" for k in (1, 5, 21, 63, 126, 252)) + f", {lag('adj_close', 1)} AS prev, row_number() {T} AS rn, ln(1 + volume) AS lv, adj_close * volume AS dv FROM base",
    "sec0": "SELECT *, greatest(adj_close - prev, 0) AS gain, greatest(prev - adj_close, 0) AS loss, CASE WHEN adj_close IS NULL OR prev IS NULL THEN 0 ELSE 1 END AS has_diff, greatest(high - low, abs(high - prev), abs(low - prev)) AS tr FROM rets",
    "security": "SELECT *, ret_252d - ret_21d AS momentum_12_1, "
    + f"adj_close / ({roll('avg', 'adj_close', 20)}) - 1 AS dist_sma_20, adj_close / ({roll('avg', 'adj_close', 50)}) - 1 AS dist_sma_50, CASE WHEN sum(has_diff) OVER {w(14)} = 14 THEN avg(gain) OVER {w(14)} END AS up, CASE WHEN sum(has_diff) OVER {w(14)} = 14 THEN avg(loss) OVER {w(14)} END AS down, "
    + f"(ret_5d - ({roll('avg', 'ret_5d', 63)})) / nullif({roll('stddev_samp', 'ret_5d', 63)}, 0) AS ret_5d_z_63d, ({roll('stddev_samp', 'ret_1d', 21)}) * sqrt(252) AS realized_vol_21d, ({roll('stddev_samp', 'ret_1d', 63)}) * sqrt(252) AS realized_vol_63d, "
    + f"({roll('avg', 'tr', 14)}) / close AS atr_14_close, (high - low) / close AS intraday_range, ({roll('avg', 'volume', 5)}) / ({roll('avg', 'volume', 20)}) AS volume_ratio_5_20, ({roll('avg', 'volume', 5)}) / ({roll('avg', 'volume', 63)}) AS volume_ratio_5_63, {roll('avg', 'dv', 20)} AS dollar_volume_20d, "
    + f"CASE WHEN count(lv) OVER {w(21)} = 21 THEN regr_slope(lv, rn) OVER {w(21)} END AS volume_trend_21d, ret_5d - spx_ret_5d AS rel_strength_5d, ret_21d - spx_ret_21d AS rel_strength_21d, ret_63d - spx_ret_63d AS rel_strength_63d, "
    + f"CASE WHEN count(CASE WHEN ret_1d IS NOT NULL AND spx_ret_1d IS NOT NULL THEN 1 END) OVER {w(63)} = 63 THEN covar_samp(ret_1d, spx_ret_1d) OVER {w(63)} END / nullif({roll('var_samp', 'spx_ret_1d', 63)}, 0) AS beta_63d FROM sec0",
    "security2": "SELECT *, CASE WHEN down > 0 THEN 100 - 100 / (1 + up / down) WHEN up > 0 THEN cast(100 AS double) END AS rsi_14, realized_vol_21d / nullif(realized_vol_63d, 0) AS vol_ratio_21_63 FROM security",
    "smeans": "SELECT date, sector, avg(ret_1d) AS sector_mean_ret_1d, avg(ret_21d) AS sector_mean_ret_21d, avg(realized_vol_21d) AS sector_mean_vol_21d FROM security2 GROUP BY date, sector",
    "sectors": "SELECT s.*, m.* EXCLUDE (date, sector), ret_1d - sector_mean_ret_1d AS sector_rel_ret_1d, ret_21d - sector_mean_ret_21d AS sector_rel_ret_21d, realized_vol_21d - sector_mean_vol_21d AS sector_vol_gap_21d FROM security2 s LEFT JOIN smeans m USING (date, sector)",
    "reacted": "SELECT e.*, p.ret_1d AS post_earnings_reaction_1d FROM earn e ASOF LEFT JOIN (SELECT ticker, date, ret_1d FROM rets) p ON e.ticker = p.ticker AND e.earnings_date <= p.date",
    "events2": "SELECT s.*, cast(date_diff('day', s.date, n.earnings_date) AS double) AS days_to_next_earnings FROM sectors s ASOF LEFT JOIN earn n ON s.ticker = n.ticker AND s.date <= n.earnings_date",
    "events3": "SELECT s.*, cast(date_diff('day', l.earnings_date, s.date) AS double) AS days_since_last_earnings, l.surprise_pct AS last_earnings_surprise_pct, l.post_earnings_reaction_1d AS last_post_earnings_reaction_1d FROM events2 s ASOF LEFT JOIN reacted l ON s.ticker = l.ticker AND s.date >= l.earnings_date",
    "funds": "SELECT s.*, t.* EXCLUDE (ticker, form), adj_close * common_shares_outstanding AS market_cap, adj_close * common_shares_outstanding + total_liabilities - cash_and_equivalents AS enterprise_value, cast(date_diff('day', filed_at, date) AS double) AS fundamentals_age_days, coalesce(date_diff('day', filed_at, date) <= 183, false) AS fundamentals_fresh FROM events3 s ASOF LEFT JOIN ttm t ON s.ticker = t.ticker AND s.date >= t.filed_at",
    "ratios": "SELECT *, market_cap / nullif(net_income_ttm, 0) AS pe_ttm, market_cap / nullif(stockholders_equity, 0) AS pb_ratio, enterprise_value / nullif(operating_income_ttm + depreciation_ttm, 0) AS ev_ebitda, net_income_ttm / nullif(stockholders_equity, 0) AS roe, total_liabilities / nullif(stockholders_equity, 0) AS debt_to_equity FROM funds",
    "missing": "SELECT *, (" + " + ".join(f"({c} IS NULL)::int" for c in CONTINUOUS + BINARY + SECTOR_MEANS + SECTOR_RELATIVE) + ") / cast(55 AS double) AS missing_feature_ratio FROM ratios",
    "imputed": "SELECT date, ticker, sector, spx_above_200d, vix_close AS vix_close_raw, missing_feature_ratio, missing_feature_ratio > 0.2 AS feature_missing_fail, NOT fundamentals_fresh AS fundamentals_missing_fail, NOT universe_reliable AS universe_history_fail, insufficient_price_history, insufficient_post_listing_history, stale_price, missing_gap_fail, "
    + ", ".join(f"coalesce({c}, median({c}) OVER (PARTITION BY date)) AS {c}" for c in CONTINUOUS) + " FROM missing",
    "scored_features": "SELECT * EXCLUDE (" + ", ".join(CONTINUOUS) + "), " + ", ".join(f"CASE WHEN stddev_pop({c}) OVER (PARTITION BY date) > 1e-12 * abs(avg({c}) OVER (PARTITION BY date)) THEN ({c} - avg({c}) OVER (PARTITION BY date)) / stddev_pop({c}) OVER (PARTITION BY date) ELSE {ZERO} END AS {c}" for c in CONTINUOUS)
    + ", NOT (coalesce(insufficient_price_history, true) OR coalesce(insufficient_post_listing_history, true) OR coalesce(stale_price, true) OR coalesce(missing_gap_fail, true) OR feature_missing_fail OR fundamentals_missing_fail OR universe_history_fail) AS trainable FROM imputed",
    "lab0": f"SELECT ticker, date, last_value(adj_close IGNORE NULLS) {RUN} AS lp, row_number() {T} AS rn FROM cleaned",
    "lab1": f"SELECT a.date, a.ticker, h.horizon, h.horizon_days, b.date AS label_end_date, b.lp / nullif(a.lp, 0) - 1 AS forward_return, b.lp IS NULL AS label_truncated FROM lab0 a CROSS JOIN {HORIZON_ROWS} LEFT JOIN lab0 b ON b.ticker = a.ticker AND b.rn = a.rn + h.horizon_days",
    "lab2": "SELECT l.*, u.membership_reliability, u.universe_reliable, u.sector, u.industry FROM lab1 l JOIN universe u USING (date, ticker)",
    "lab3": "SELECT *, CASE WHEN forward_return IS NOT NULL THEN (rank() OVER v + (count(*) OVER (PARTITION BY date, horizon, forward_return) - 1) / cast(2 AS double)) / count(forward_return) OVER (PARTITION BY date, horizon) END AS target_rank, median(forward_return) OVER (PARTITION BY date, horizon) AS med FROM lab2 WINDOW v AS (PARTITION BY date, horizon ORDER BY forward_return NULLS LAST)",
    "labels3": "SELECT * EXCLUDE (med), CASE WHEN forward_return IS NOT NULL THEN med END AS daily_median_forward_return, forward_return - med AS forward_excess_return, CASE WHEN target_rank IS NOT NULL THEN cast(target_rank >= 0.8::double AS int) END AS target_class FROM lab3",
    "labelled": "SELECT l.*, EXISTS (SELECT 1 FROM earn e WHERE e.ticker = l.ticker AND e.earnings_date > l.date AND (l.label_end_date IS NULL OR e.earnings_date <= l.label_end_date)) AS earnings_in_window FROM labels3 l",
    # scores: fixed functions of the features, rounded so that both engines order them alike
    "scores": "SELECT r.date, r.ticker, l.horizon, CASE WHEN r.fundamentals_fresh THEN round(coalesce(r.ret_21d, 0) / (1 + l.horizon_days), 6) ELSE round(coalesce(r.momentum_12_1, 0) - l.horizon_days, 6) END AS score, r.vix_close AS vix_close_raw, r.spx_above_200d, r.insufficient_price_history, r.missing_gap_fail, r.stale_price, r.insufficient_post_listing_history, NOT r.fundamentals_fresh AS fundamentals_missing_fail, NOT r.universe_reliable AS universe_history_fail, l.target_rank, l.target_class, l.forward_return, l.forward_excess_return, l.daily_median_forward_return, l.label_end_date, l.label_truncated, r.sector FROM ratios r JOIN labels3 l ON l.date = r.date AND l.ticker = r.ticker",
    "regimes": "SELECT *, CASE WHEN vix_close_raw >= 35 THEN 'CLOSED' WHEN vix_close_raw >= 25 AND spx_above_200d < 1 THEN 'CAUTION' ELSE 'OPEN' END AS regime_state, "
    + "concat_ws('|', CASE WHEN coalesce(insufficient_price_history, true) THEN 'short_price_history' END, CASE WHEN coalesce(missing_gap_fail, true) THEN 'recent_missing_price_gap' END, CASE WHEN coalesce(stale_price, true) THEN 'stale_price' END, CASE WHEN coalesce(insufficient_post_listing_history, true) THEN 'post_listing_buffer' END, CASE WHEN fundamentals_missing_fail THEN 'stale_or_missing_fundamentals' END, CASE WHEN universe_history_fail THEN 'unreliable_universe_history' END) AS not_enough_data_reason FROM scores",
    "valid": "SELECT date, ticker, horizon, row_number() OVER (PARTITION BY date, horizon ORDER BY score DESC NULLS LAST, ticker) AS rank, count(*) OVER (PARTITION BY date, horizon) AS n, round((score - avg(score) OVER (PARTITION BY date, horizon)) / coalesce(nullif(stddev_pop(score) OVER (PARTITION BY date, horizon), 0), 1), 9) AS z FROM regimes WHERE not_enough_data_reason = ''",
    "decided": "SELECT r.*, v.rank, CASE WHEN v.z >= 2 THEN 'HIGH' WHEN v.z >= 1 THEN 'MEDIUM' WHEN v.z IS NOT NULL THEN 'LOW' END AS confidence, CASE WHEN v.rank IS NULL THEN 'NOT_ENOUGH_DATA' WHEN v.rank <= CASE regime_state WHEN 'CLOSED' THEN 0 WHEN 'CAUTION' THEN least(greatest(1, floor(v.n * 0.1::double)), 5) ELSE greatest(1, floor(v.n * 0.1::double)) END THEN 'BUY' ELSE 'NO_BUY' END AS decision FROM regimes r LEFT JOIN valid v USING (date, ticker, horizon)",
    "recs": "SELECT *, count(CASE WHEN decision = 'BUY' THEN 1 END) OVER (PARTITION BY date, ticker) AS buy_horizon_count, count(CASE WHEN decision = 'BUY' THEN 1 END) OVER (PARTITION BY date, ticker) >= 3 AS consensus_buy FROM decided",
    "nextret": f"SELECT date, ticker, lead(lp) {T} / nullif(lp, 0) - 1 AS next_day_return FROM lab0",
    "benchret": "SELECT date, lead(adj_close) OVER (ORDER BY date) / nullif(adj_close, 0) - 1 AS benchmark_return FROM bench",
    "weights": "SELECT horizon, date, ticker, cast(1 AS double) / count(*) OVER (PARTITION BY horizon, date) AS weight FROM recs WHERE decision = 'BUY'",
    "drift0": "SELECT k.*, coalesce(n.next_day_return, 0) AS day_return, k.weight * (1 + coalesce(n.next_day_return, 0)) AS grown FROM weights k LEFT JOIN nextret n USING (date, ticker)",
    "drift": "SELECT *, grown / total AS drifted_weight FROM (SELECT *, sum(grown) OVER (PARTITION BY horizon, date) AS total FROM drift0) WHERE total > 0",
    "days": "SELECT horizon, date, regime_state, lag(date) OVER (PARTITION BY horizon ORDER BY date) AS before FROM (SELECT horizon, date, max(regime_state) AS regime_state FROM recs GROUP BY horizon, date)",
    "turn": "SELECT d.horizon, d.date, sum(abs(coalesce(k.weight, 0) - coalesce(p.drifted_weight, 0))) AS turnover FROM days d JOIN (SELECT DISTINCT horizon, date, ticker FROM (SELECT horizon, date, ticker FROM weights UNION ALL SELECT d.horizon, d.date, p.ticker FROM days d JOIN drift p ON p.horizon = d.horizon AND p.date = d.before)) x ON x.horizon = d.horizon AND x.date = d.date LEFT JOIN weights k ON k.horizon = x.horizon AND k.date = x.date AND k.ticker = x.ticker LEFT JOIN drift p ON p.horizon = x.horizon AND p.date = d.before AND p.ticker = x.ticker GROUP BY d.horizon, d.date",
    "gross": "SELECT horizon, date, sum(weight * day_return) AS gross_return, count(*) AS buy_count FROM drift0 GROUP BY horizon, date",
    "daily0": "SELECT d.horizon, d.date, d.regime_state, coalesce(t.turnover, 0) AS turnover, coalesce(g.gross_return, 0) AS gross_return, coalesce(g.buy_count, 0) AS buy_count, coalesce(t.turnover, 0) * 10 / 10000 AS cost, b.benchmark_return FROM days d LEFT JOIN turn t USING (horizon, date) LEFT JOIN gross g USING (horizon, date) LEFT JOIN benchret b USING (date)",
    "daily1": "SELECT *, gross_return - cost AS net_return, gross_return - cost - coalesce(benchmark_return, 0) AS relative_return, product(1 + gross_return - cost) OVER h AS cumulative_return, product(1 + coalesce(benchmark_return, 0)) OVER h AS benchmark_cumulative_return FROM daily0 WINDOW h AS (PARTITION BY horizon ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "daily": "SELECT *, cumulative_return / max(cumulative_return) OVER (PARTITION BY horizon ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS drawdown FROM daily1",
    "preds": "SELECT * FROM scores WHERE target_rank IS NOT NULL AND NOT label_truncated",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY horizon, date ORDER BY score DESC NULLS LAST, ticker) AS i, row_number() OVER (PARTITION BY horizon, date ORDER BY target_rank DESC NULLS LAST, ticker) AS j, count(*) OVER (PARTITION BY horizon, date) AS n FROM preds",
    "bydate": "SELECT horizon, date, " + ", ".join(f"sum(CASE WHEN i <= {k} THEN (pow(2, target_rank) - 1) / log2(i + 1) END) / nullif(sum(CASE WHEN j <= {k} THEN (pow(2, target_rank) - 1) / log2(j + 1) END), 0) AS ndcg_at_{k}" for k in (10, 20))
    + ", avg(CASE WHEN i <= 10 THEN target_class END) AS precision_at_10, avg(CASE WHEN i <= greatest(1, floor(n * 0.1::double)) THEN (forward_return > daily_median_forward_return)::int END) AS hit_rate, avg(CASE WHEN i <= greatest(1, floor(n * 0.1::double)) THEN forward_excess_return END) AS mean_excess_return, count(*) AS n_rows FROM ranked GROUP BY horizon, date",
}


def sql(select: str) -> str:
    """select with the CTEs it needs, in order."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in CTE:
            if name not in need and re.search(rf"(?:FROM|JOIN|,)\s+\(?{name}\b", text):
                visit(CTE[name])
                if name not in need:
                    need.append(name)

    visit(select)
    return ("WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in need) + "\n" if need else "") + select

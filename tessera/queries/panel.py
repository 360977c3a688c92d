"""Panel queries by name, each with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.panel import imputed
from tessera.operators import backtest as bt
from tessera.operators import features as ft
from tessera.operators import filters as fl
from tessera.operators import labels as lb
from tessera.operators import metrics as mt
from tessera.operators import recommend as rc
from tessera.operators import universe as un
from tessera.operators.asof import asof_join, event_in_window
from tessera.operators.quality import PRICES, bounded_fill, calendar_reindex, quality_flags
from tessera.plans import stores
from tessera.queries import proxy as px
from tessera.queries.oracles import r6, sql
from tessera.sources import tables as src
from tessera.staging import in_scope, shared

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The regions, and the dates that the queries' splits and slices use.
SECTORS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
TRAIN_END, VAL_START, VAL_END, END = "1998-12-31", "1999-03-16", "1999-12-31", "2001-11-04"


def query(oracle: str | None = None, name: str | None = None):
    """Register a query under its function's name or another, with DuckDB SQL where SQL expresses it."""

    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = in_scope(f)
        if oracle:
            ORACLES[name or f.__name__] = sql(oracle)
        return f

    return add


def r(x: Column | str, name: str | None = None, digits: int = 6) -> Column:
    return (F.round(x, digits) + F.lit(0.0)).alias(name or x)


def rounded(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return df.select(*keys, *(r(n) for n in names))


def grid(s: SparkSession, d: str) -> DataFrame:
    return calendar_reindex(px.prices(s, d).drop("sector"), px.calendar(s, d))


@shared
def members(s: SparkSession, d: str) -> DataFrame:
    return un.membership_history(px.current(s, d), px.changes(s, d), px.calendar(s, d))


def universe(s: SparkSession, d: str) -> DataFrame:
    return un.daily_universe(members(s, d), px.metadata(s, d))


def macro(s: SparkSession, d: str) -> DataFrame:
    return ft.macro_frame(px.benchmark(s, d), px.volatility(s, d), px.risk_free(s, d))


def panel(s: SparkSession, d: str) -> DataFrame:
    return stores.base_panel(stores.clean_panel(px.prices(s, d), px.calendar(s, d)), universe(s, d), macro(s, d))


def security(s: SparkSession, d: str) -> DataFrame:
    return ft.security_features(panel(s, d))


def sectors(s: SparkSession, d: str) -> list[str]:
    return stores.sector_values(px.metadata(s, d))


def raw(s: SparkSession, d: str) -> DataFrame:
    return stores.raw_features(panel(s, d), px.earnings(s, d), px.filings(s, d), sectors(s, d))


def store(s: SparkSession, d: str) -> DataFrame:
    return stores.feature_store(panel(s, d), px.earnings(s, d), px.filings(s, d), sectors(s, d))


def labels(s: SparkSession, d: str) -> DataFrame:
    own = universe(s, d).select("date", "ticker", "membership_reliability", "universe_reliable", "sector", "industry")
    return lb.rank_targets(lb.forward_labels(bounded_fill(grid(s, d))).join(own, ["date", "ticker"]))


def scores(s: SparkSession, d: str) -> DataFrame:
    """Fixed functions of the features in place of a model's scores."""
    k = F.col("horizon_days")
    score = F.when(F.col("fundamentals_fresh"), F.round(F.coalesce("ret_21d", F.lit(0.0)) / (1 + k), 6)).otherwise(F.round(F.coalesce("momentum_12_1", F.lit(0.0)) - k, 6))
    own = raw(s, d).select("date", "ticker", "ret_21d", "momentum_12_1", "fundamentals_fresh", F.col("vix_close").alias("vix_close_raw"), "spx_above_200d", "insufficient_price_history", "missing_gap_fail", "stale_price", "insufficient_post_listing_history", (~F.col("fundamentals_fresh")).alias("fundamentals_missing_fail"), (~F.col("universe_reliable")).alias("universe_history_fail"))
    return own.join(labels(s, d).drop("industry", "membership_reliability", "universe_reliable"), ["date", "ticker"]).withColumn("score", score)


@shared
def recs(s: SparkSession, d: str) -> DataFrame:
    return rc.recommend(scores(s, d))


def predictions(s: SparkSession, d: str) -> DataFrame:
    return scores(s, d).where(F.col("target_rank").isNotNull() & ~F.col("label_truncated"))


@shared
def next_returns(s: SparkSession, d: str) -> DataFrame:
    return lb.next_day_returns(bounded_fill(grid(s, d)))


def daily(s: SparkSession, d: str) -> DataFrame:
    b = px.benchmark(s, d).withColumn("ticker", F.lit("benchmark"))
    return bt.backtest_daily(recs(s, d), next_returns(s, d), lb.next_day_returns(b).select("date", F.col("next_day_return").alias("benchmark_return")))


KEYS = ["date", "ticker"]


def _security_query(name: str, columns: list[str], scale: dict[str, float] | None = None) -> None:
    scale = scale or {}

    def f(s: SparkSession, d: str) -> DataFrame:
        return security(s, d).select(*KEYS, *(r(F.col(c) / scale.get(c, 1.0), c) for c in columns))

    query("SELECT date, ticker, " + ", ".join(r6(f"({c}) / cast({scale.get(c, 1.0)} AS double)", c) for c in columns) + " FROM security2", name)(f)


_security_query("returns", ["ret_1d", "ret_5d", "ret_21d", "ret_63d", "ret_126d", "ret_252d"])
_security_query("momentum", ["momentum_12_1"])
_security_query("sma_distance", ["dist_sma_20", "dist_sma_50"])
_security_query("rsi", ["rsi_14"])
_security_query("ret_zscore", ["ret_5d_z_63d"])
_security_query("realized_vol", ["realized_vol_21d", "realized_vol_63d", "vol_ratio_21_63"])
_security_query("atr", ["atr_14_close", "intraday_range"])
_security_query("volume_ratios", ["volume_ratio_5_20", "volume_ratio_5_63"])
_security_query("dollar_volume", ["dollar_volume_20d"], {"dollar_volume_20d": 1234567.0})
_security_query("volume_trend", ["volume_trend_21d"])
_security_query("rel_strength", ["rel_strength_5d", "rel_strength_21d", "rel_strength_63d"])
_security_query("beta", ["beta_63d"])


@query("SELECT date, ticker, " + ", ".join(PRICES) + ", volume FROM prices")
def scan_parquet(s, d):
    return px.prices(s, d).select(*KEYS, *PRICES, "volume")


@query(f"SELECT date, ticker, horizon, horizon_days, label_end_date, {r6('forward_return')}, label_truncated FROM lab1")
def forward_labels(s, d):
    return rounded_labels(lb.forward_labels(bounded_fill(grid(s, d))), ["forward_return"], ["horizon_days", "label_end_date"], ["label_truncated"])


def rounded_labels(df, names, before=(), after=()):
    return df.select(*KEYS, "horizon", *before, *(r(n) for n in names), *after)


@query(f"SELECT date, ticker, horizon, {r6('target_rank')} FROM labels3")
def target_rank(s, d):
    return rounded_labels(labels(s, d), ["target_rank"])


@query(f"SELECT date, ticker, horizon, {r6('daily_median_forward_return')}, {r6('forward_excess_return')} FROM labels3")
def excess_return(s, d):
    return rounded_labels(labels(s, d), ["daily_median_forward_return", "forward_excess_return"])


@query("SELECT date, ticker, horizon, target_class FROM labels3")
def target_class(s, d):
    return labels(s, d).select(*KEYS, "horizon", "target_class")


@query("SELECT date, ticker, horizon, earnings_in_window FROM labelled", "event_in_window")
def event_in_window_labels(s, d):
    return event_in_window(labels(s, d), px.earnings(s, d)).select(*KEYS, "horizon", "earnings_in_window")


@query("SELECT date, " + ", ".join(r6(c) for c in ["spx_close", "spx_ret_1d", "spx_ret_5d", "spx_ret_21d", "spx_ret_63d", "spx_above_200d", "vix_close", "vix_change_5d", "risk_free_rate"]) + " FROM macro")
def macro_frame(s, d):
    return rounded(macro(s, d), ["date"], ["spx_close", "spx_ret_1d", "spx_ret_5d", "spx_ret_21d", "spx_ret_63d", "spx_above_200d", "vix_close", "vix_change_5d", "risk_free_rate"])


@query(f"SELECT date, ticker, {r6('next_day_return')} FROM nextret")
def next_day_returns(s, d):
    return rounded(next_returns(s, d), KEYS, ["next_day_return"])


@query("SELECT date, ticker, was_observed, adj_close, volume FROM grid", "calendar_reindex")
def calendar_reindexed(s, d):
    return grid(s, d).select(*KEYS, "was_observed", "adj_close", "volume")


@query("SELECT date, ticker, was_observed, " + ", ".join(PRICES) + ", volume, source FROM cleaned")
def bounded_ffill(s, d):
    return bounded_fill(grid(s, d)).select(*KEYS, "was_observed", *PRICES, "volume", "source")


@query("SELECT date, ticker, stale_price_days FROM quality")
def stale_days(s, d):
    return quality_flags(grid(s, d)).select(*KEYS, "stale_price_days")


@query("SELECT date, ticker, missing_streak, max_missing_gap_21d FROM quality")
def missing_streak(s, d):
    return quality_flags(grid(s, d)).select(*KEYS, "missing_streak", "max_missing_gap_21d")


@query("SELECT date, ticker, history_days FROM quality")
def history_days(s, d):
    return quality_flags(grid(s, d)).select(*KEYS, "history_days")


@query("SELECT date, ticker, listing_age_days, compat_age_days FROM quality")
def listing_age(s, d):
    own = quality_flags(grid(s, d)).select(*KEYS, "listing_age_days")
    return own.join(quality_flags(grid(s, d), compat=True).select(*KEYS, F.col("listing_age_days").alias("compat_age_days")), KEYS)


@query("SELECT date, ticker, insufficient_price_history, insufficient_post_listing_history, stale_price, missing_gap_fail FROM flags", "quality_flags")
def quality_flag_set(s, d):
    return quality_flags(grid(s, d)).select(*KEYS, "insufficient_price_history", "insufficient_post_listing_history", "stale_price", "missing_gap_fail")


@query("SELECT b.date, b.ticker, e.earnings_date AS next_event FROM base b ASOF LEFT JOIN earn e ON b.ticker = e.ticker AND b.date <= e.earnings_date")
def asof_next_event(s, d):
    return asof_join(panel(s, d).select(*KEYS), px.earnings(s, d), "ticker", "date", "earnings_date", {"next_event": F.col("earnings_date")}, backward=False)


@query(f"SELECT date, ticker, days_since_last_earnings, last_earnings_surprise_pct, {r6('last_post_earnings_reaction_1d')} FROM events3")
def asof_prev_event(s, d):
    return ft.earnings_features(security(s, d), px.earnings(s, d)).select(*KEYS, "days_since_last_earnings", "last_earnings_surprise_pct", r("last_post_earnings_reaction_1d"))


@query(f"SELECT ticker, earnings_date, {r6('post_earnings_reaction_1d')} FROM reacted")
def post_event_reaction(s, d):
    return ft.post_event_reaction(px.earnings(s, d), security(s, d)).select("ticker", "earnings_date", r("post_earnings_reaction_1d"))


@query(f"SELECT date, ticker, filed_at, period_end, {r6('revenue_ttm / 1e6::double', 'revenue_ttm')} FROM funds")
def asof_fundamentals(s, d):
    return raw(s, d).select(*KEYS, "filed_at", "period_end", r(F.col("revenue_ttm") / 1e6, "revenue_ttm"))


TTM = ["revenue_ttm", "net_income_ttm", "operating_income_ttm", "depreciation_ttm"]


@query("SELECT ticker, filed_at, period_end, " + ", ".join(r6(f"{c} / 1e6::double", c) for c in TTM) + " FROM ttm")
def ttm_fundamentals(s, d):
    return ft.trailing_fundamentals(px.filings(s, d)).select("ticker", "filed_at", "period_end", *(r(F.col(c) / 1e6, c) for c in TTM))


@query(f"SELECT ticker, filed_at, {r6('revenue_growth_yoy')}, {r6('assets_growth_yoy')} FROM ttm")
def yoy_growth(s, d):
    return rounded(ft.trailing_fundamentals(px.filings(s, d)), ["ticker", "filed_at"], ["revenue_growth_yoy", "assets_growth_yoy"])


VALUATION = ["pe_ttm", "pb_ratio", "ev_ebitda", "roe", "debt_to_equity"]


@query("SELECT date, ticker, " + ", ".join(r6(c) for c in VALUATION) + " FROM ratios")
def valuation_ratios(s, d):
    return rounded(raw(s, d), KEYS, VALUATION)


@query("SELECT date, ticker, fundamentals_age_days, fundamentals_fresh FROM funds")
def fundamentals_fresh(s, d):
    return raw(s, d).select(*KEYS, "fundamentals_age_days", "fundamentals_fresh")


@query("SELECT date, sector, " + ", ".join(r6(c) for c in ft.SECTOR_MEANS) + " FROM smeans")
def sector_means(s, d):
    names = dict(zip(ft.SECTOR_MEANS, ("ret_1d", "ret_21d", "realized_vol_21d")))
    return rounded(security(s, d).groupBy("date", "sector").agg(*(F.avg(c).alias(n) for n, c in names.items())), ["date", "sector"], list(names))


@query("SELECT date, ticker, " + ", ".join(r6(c) for c in ft.SECTOR_RELATIVE) + " FROM sectors")
def sector_relative(s, d):
    return rounded(ft.sector_context(security(s, d)), KEYS, ft.SECTOR_RELATIVE)


@query("SELECT date, ticker, " + ", ".join(f"CASE WHEN sector = '{v}' THEN cast(1 AS double) ELSE cast(0 AS double) END AS \"sector_{v}\"" for v in SECTORS) + " FROM universe")
def one_hot(s, d):
    return ft.one_hot(universe(s, d), SECTORS).select(*KEYS, *(f"`sector_{v}`" for v in SECTORS))


@query(f"SELECT date, ticker, {r6('missing_feature_ratio')}, missing_feature_ratio > 0.2 AS feature_missing_fail FROM missing")
def missing_ratio(s, d):
    return store(s, d).select(*KEYS, r("missing_feature_ratio"), "feature_missing_fail")


FEW = ft.CONTINUOUS


@query("SELECT date, ticker, " + ", ".join(r6(c) for c in FEW) + " FROM imputed")
def xs_impute(s, d):
    return raw(s, d).select(*KEYS, *(imputed(F.col(c), "date").alias(c) for c in FEW)).select(*KEYS, *(r(c) for c in FEW))


@query("SELECT date, ticker, " + ", ".join(r6(c) for c in FEW) + " FROM scored_features")
def xs_zscore(s, d):
    return rounded(store(s, d), KEYS, FEW)


@query("SELECT date, ticker, trainable FROM scored_features")
def trainable(s, d):
    return store(s, d).select(*KEYS, "trainable")


SHOWN = ft.CONTINUOUS


@query("SELECT date, ticker, sector, trainable, " + r6("vix_close_raw") + ", " + r6("missing_feature_ratio") + ", spx_above_200d, " + ", ".join(r6(c, None, 5) for c in SHOWN) + " FROM scored_features")
def feature_store(s, d):
    return store(s, d).select(*KEYS, "sector", "trainable", r("vix_close_raw"), r("missing_feature_ratio"), "spx_above_200d", *(r(c, None, 5) for c in SHOWN))


@query("SELECT c.date, c.ticker, c.adj_close, f.history_days FROM cleaned c LEFT JOIN flags f ON f.date = c.date AND f.ticker = c.ticker")
def join_left(s, d):
    cleaned, quality = stores.clean(px.prices(s, d), px.calendar(s, d))
    return cleaned.join(quality, KEYS, "left").select(*KEYS, "adj_close", "history_days")


@query("SELECT date, ticker, sector, adj_close FROM base")
def join_inner(s, d):
    return panel(s, d).select(*KEYS, "sector", "adj_close")


@query(f"SELECT f.date, f.ticker, l.horizon, {r6('f.rsi_14', 'rsi_14')}, {r6('l.forward_return', 'forward_return')}, l.membership_reliability FROM scored_features f JOIN labels3 l ON l.date = f.date AND l.ticker = f.ticker")
def model_frame(s, d):
    frame = stores.model_frame(store(s, d), labels(s, d).drop("sector", "industry"))
    return frame.select(*KEYS, "horizon", r("rsi_14"), r("forward_return"), "membership_reliability")


@query("SELECT date, ticker, sector, industry, universe_reliable, first_membership_date FROM universe")
def universe_enrich(s, d):
    return universe(s, d).select(*KEYS, "sector", "industry", "universe_reliable", "first_membership_date")


@query("SELECT date, ticker, is_member, membership_reliability FROM members")
def membership_history(s, d):
    return members(s, d).drop("source")


@query("SELECT date, ticker, membership_days FROM universe")
def membership_days(s, d):
    return universe(s, d).select(*KEYS, "membership_days")


@query("SELECT DISTINCT ticker FROM prices WHERE coalesce(open, high, low, close, adj_close) IS NOT NULL")
def tickers_with_price_history(s, d):
    return fl.tickers_with_prices(px.prices(s, d))


@query(f"SELECT ticker FROM prices WHERE volume < 20 GROUP BY ticker HAVING max(date) >= DATE '{END}' - INTERVAL 120 DAY")
def recent_tickers(s, d):
    return fl.recent_tickers(px.prices(s, d).where("volume < 20"), END)


#: The same rule over all rows. Each ticker's dates are moved back by 14 days a letter of its name, so that some end too early at every size.
@query(f"SELECT ticker FROM prices GROUP BY ticker HAVING max(date) - INTERVAL 14 DAY * length(ticker) >= DATE '{END}' - INTERVAL 120 DAY")
def recent_tickers_all_rows(s, d):
    return fl.recent_tickers(px.prices(s, d).withColumn("date", F.date_sub("date", 14 * F.length("ticker"))), END)


@query("SELECT DISTINCT p.ticker FROM prices p JOIN listed l ON l.ticker = p.ticker")
def vendor_enrichment_tickers(s, d):
    return fl.listed_tickers(px.prices(s, d), px.current(s, d))


@query("SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.sector, b.sector, 'Unknown') AS sector, coalesce(a.industry, b.industry, 'Unknown') AS industry FROM (SELECT DISTINCT ticker, CASE WHEN ticker LIKE '%1%' THEN NULL ELSE sector END AS sector, NULL::varchar AS industry FROM prices) a FULL JOIN (SELECT * FROM meta WHERE sector <> 'EUROPE') b ON a.ticker = b.ticker")
def outer_coalesce(s, d):
    vendor = px.prices(s, d).select("ticker", F.when(~F.col("ticker").contains("1"), F.col("sector")).alias("sector"), F.lit(None).cast("string").alias("industry")).distinct()
    return un.merged_metadata(vendor, px.metadata(s, d).where("sector <> 'EUROPE'"))


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def dedupe_keep_last(s, d):
    return fl.keep_last(px.table(s, d, "events"), ["user_id", "event_type"], [F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("SELECT ticker, date, CASE WHEN date >= (SELECT max(date) FROM prices WHERE date < DATE '2000-01-01') - INTERVAL 10 DAY THEN close * 2 ELSE close END AS close FROM prices")
def incremental_upsert(s, d):
    old = px.prices(s, d).where("date < '2000-01-01'")
    fresh = px.prices(s, d).withColumn("close", F.col("close") * 2)
    out = src.incremental_upsert(old, fresh, overlap_days=10)
    return out.select("ticker", "date", "close")


@query("SELECT date, ticker, open, close, volume FROM (SELECT date, 'BBB' AS ticker, max(u) AS open, min(u) AS close, sum(q) AS volume FROM lines WHERE sector = 'ASIA' GROUP BY date UNION ALL SELECT date, 'AAA', max(CASE WHEN sector = 'AFRICA' THEN u END), NULL, sum(CASE WHEN sector = 'AFRICA' THEN q END) FROM lines WHERE sector IN ('AFRICA', 'ASIA') GROUP BY date) WHERE open IS NOT NULL OR close IS NOT NULL")
def panel_wide_to_long(s, d):
    l = px.lines(s, d).where("sector in ('AFRICA', 'ASIA')")  # noqa: E741
    a, b = F.col("sector") == "AFRICA", F.col("sector") == "ASIA"
    pick = lambda f, on, c, name: f(F.when(on, F.col(c))).alias(name)
    wide = l.groupBy("date").agg(pick(F.max, a, "u", "AAA|Open"), pick(F.sum, a, "q", "AAA|Volume"), pick(F.max, b, "u", "BBB|Open"), pick(F.min, b, "u", "BBB|Close"), pick(F.sum, b, "q", "BBB|Volume"))
    return src.wide_to_long(wide).select("date", "ticker", "open", "close", "volume")


@query("SELECT event_id, TRY_CAST(nullif(regexp_extract(props, '([0-9]+)', 1), '') AS double) AS value, TRY_CAST(event_type AS double) AS nothing FROM events")
def numeric_coerce(s, d):
    e = px.table(s, d, "events")
    return e.select("event_id", src.to_number(F.regexp_extract("props", "([0-9]+)", 1)).alias("value"), src.to_number(F.col("event_type")).alias("nothing"))


@query("SELECT ticker, filed_at, period_end, form, max(CASE WHEN metric = 'revenue' THEN v END) AS revenue, max(CASE WHEN metric = 'net_income' THEN v END) AS net_income FROM (SELECT ticker, filed_at, period_end, form, 'revenue' AS metric, round(revenue, 2) AS v FROM filings UNION ALL SELECT ticker, filed_at, period_end, form, 'net_income', round(net_income, 2) FROM filings WHERE form = '10-K') GROUP BY ALL")
def facts_pivot(s, d):
    f = px.filings(s, d)
    long = f.select("ticker", "filed_at", "period_end", "form", F.lit("revenue").alias("metric"), F.round("revenue", 2).alias("value"))
    long = long.unionByName(f.where("form = '10-K'").select("ticker", "filed_at", "period_end", "form", F.lit("net_income").alias("metric"), F.round("net_income", 2).alias("value")))
    return src.pivot_facts(long).select("ticker", "filed_at", "period_end", "form", "revenue", "net_income")


@query()
def xbrl_extract(s, d):
    facts = s.createDataFrame(src.SAMPLE_FACTS, "ticker string, body string")
    return src.company_facts(facts)


@query()
def feature_catalog(s, d):
    from tessera.plans.catalog import records

    return s.createDataFrame(records([f"sector_{v}" for v in SECTORS]), "name string, formula string, valid_at string, missing_handling string, horizon_sensitive array<string>")


@query("SELECT date, horizon, max(regime_state) AS regime_state FROM regimes GROUP BY date, horizon")
def regime(s, d):
    return recs(s, d).groupBy("date", "horizon").agg(F.max("regime_state").alias("regime_state"))


@query("SELECT date, ticker, horizon, not_enough_data_reason FROM regimes")
def ned_reason(s, d):
    return scores(s, d).select(*KEYS, "horizon", rc.not_enough_data_reason(["insufficient_price_history", "missing_gap_fail", "stale_price", "insufficient_post_listing_history", "fundamentals_missing_fail", "universe_history_fail"]).alias("not_enough_data_reason"))


@query(f"SELECT date, ticker, horizon, {r6('score')}, rank, decision, confidence, regime_state, buy_horizon_count, consensus_buy, not_enough_data_reason, sector FROM recs")
def recommendations(s, d):
    return recs(s, d).select(*KEYS, "horizon", r("score"), F.col("rank").cast("long").alias("rank"), "decision", "confidence", "regime_state", "buy_horizon_count", "consensus_buy", "not_enough_data_reason", "sector")


@query("SELECT date, ticker, horizon, confidence FROM recs WHERE confidence IS NOT NULL")
def confidence(s, d):
    return recs(s, d).where("confidence is not null").select(*KEYS, "horizon", "confidence")


@query("SELECT date, ticker, horizon, decision FROM recs")
def buy_decision(s, d):
    return recs(s, d).select(*KEYS, "horizon", "decision")


@query("SELECT DISTINCT date, ticker, buy_horizon_count, consensus_buy FROM recs")
def consensus(s, d):
    return recs(s, d).select(*KEYS, "buy_horizon_count", "consensus_buy").distinct()


@query("SELECT date, ticker, adj_close FROM base WHERE date = (SELECT max(date) FROM base)")
def latest_slice(s, d):
    return rc.latest_slice(panel(s, d)).select(*KEYS, "adj_close")


@query("SELECT f.date, f.ticker FROM scored_features f JOIN labels3 l USING (date, ticker) WHERE l.horizon = '1w' AND f.trainable AND l.target_rank IS NOT NULL AND l.target_class IS NOT NULL AND NOT l.label_truncated")
def eligible_rows(s, d):
    return fl.eligible(stores.model_frame(store(s, d), labels(s, d).drop("sector", "industry")), "1w").select(*KEYS)


@query(f"SELECT date, ticker, horizon, 'train' AS part FROM labels3 WHERE date <= DATE '{TRAIN_END}' AND label_end_date < DATE '{VAL_START}' UNION ALL SELECT date, ticker, horizon, 'val' FROM labels3 WHERE date BETWEEN DATE '{VAL_START}' AND DATE '{VAL_END}'")
def purged_split(s, d):
    parts = zip(("train", "val"), fl.purged_split(labels(s, d), TRAIN_END, VAL_START, VAL_END))
    train, val = (p.select(*KEYS, "horizon", F.lit(n).alias("part")) for n, p in parts)
    return train.unionByName(val)


@query(f"SELECT count(*) - 1 AS gap FROM generate_series(DATE '{TRAIN_END}', DATE '{VAL_START}', INTERVAL 1 DAY) t(x) WHERE isodow(x) < 6")
def embargo_gap(s, d):
    return fl.business_calendar(TRAIN_END, VAL_START, s.range(1)).agg((F.count("*") - 1).alias("gap"))


@query("SELECT date, count(*) AS size FROM labels3 GROUP BY date")
def group_sizes(s, d):
    return fl.group_sizes(labels(s, d))


@query(f"SELECT horizon, date, {r6('ndcg_at_10')} FROM bydate")
def ndcg(s, d):
    return mt.ndcg(predictions(s, d), 10, ("horizon", "date")).select("horizon", "date", r("ndcg_at_10"))


METRICS = ["ndcg_at_10", "ndcg_at_20", "precision_at_10", "hit_rate", "mean_excess_return"]


@query("SELECT horizon, " + ", ".join(r6(f"avg({c})", c) for c in METRICS) + ", cast(sum(n_rows) AS bigint) AS n_rows FROM bydate GROUP BY horizon")
def ranking_metrics(s, d):
    return mt.ranking_metrics(predictions(s, d), group=("horizon",)).select("horizon", *(r(c) for c in METRICS), F.col("rows").alias("n_rows"))


@query("SELECT horizon, 'fixed' AS model_name, " + ", ".join(r6(f"avg({c})", c) for c in METRICS) + ", cast(sum(n) AS bigint) AS n_rows FROM (SELECT horizon, year(date) AS y, " + ", ".join(f"avg({c}) AS {c}" for c in METRICS) + ", sum(n_rows) AS n FROM bydate GROUP BY horizon, y) GROUP BY horizon")
def validation_summary(s, d):
    by_split = mt.ranking_metrics(predictions(s, d).withColumn("split", F.year("date")), group=("horizon", "split")).withColumn("model_name", F.lit("fixed"))
    return mt.validation_summary(by_split).select("horizon", "model_name", *(r(c) for c in METRICS), F.col("rows").alias("n_rows"))


@query(f"SELECT horizon, CASE WHEN n > 1 THEN greatest(1, ceil((i - 1) * q::double / (n - 1))) ELSE 1 END::bigint AS score_bin, {r6('avg(score)', 'mean_score')}, {r6('avg(target_class)', 'positive_rate')}, count(*) AS count FROM (SELECT *, least(10, n) AS q FROM (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY score, date, ticker) AS i, count(*) OVER (PARTITION BY horizon) AS n FROM preds)) GROUP BY 1, 2")
def calibration(s, d):
    return mt.calibration(predictions(s, d), by=("horizon",)).select("horizon", "score_bin", r("mean_score"), r("positive_rate"), "count")


@query(f"SELECT {r6('sum(p) / sum(n)', 'positive_rate')}, {r6('stddev_pop(p / n)', 'positive_rate_std_by_date')}, cast(count(*) AS double) AS cross_sections FROM (SELECT date, sum(target_class)::double AS p, nullif(count(target_class), 0)::double AS n FROM labels3 WHERE horizon = '1w' GROUP BY date)")
def class_imbalance(s, d):
    return mt.class_imbalance(labels(s, d).where("horizon = '1w'")).select(r("positive_rate"), r("positive_rate_std_by_date"), "cross_sections")


DRIFT = ["ret_21d", "rsi_14", "spx_above_200d"]
_MELT = " UNION ALL ".join(f"SELECT '{c}' AS feature, date, round({c}, 6) + cast(0 AS double) AS x FROM ratios WHERE {c} IS NOT NULL" for c in DRIFT)


def drift_sql(melted: str, digits: int = 6) -> str:
    """SQL of feature_drift over rows (feature, date, x)."""
    return f"""SELECT f.feature, {r6('f.a', 'train_mean')}, {r6('f.b', 'val_mean')}, {r6('f.b - f.a', 'mean_shift')}, {r6('CASE WHEN len(e.edges) <= 2 THEN 0 ELSE p.psi END', 'psi', digits)} FROM
 (SELECT feature, avg(CASE WHEN date <= DATE '{TRAIN_END}' THEN x END) AS a, avg(CASE WHEN date > DATE '{TRAIN_END}' THEN x END) AS b FROM ({melted}) GROUP BY feature) f
 JOIN (SELECT feature, list_sort(list_distinct(list_transform(quantile_cont(x, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]), lambda v: round(v, 9)))) AS edges FROM ({melted}) WHERE date <= DATE '{TRAIN_END}' GROUP BY feature) e ON e.feature = f.feature
 LEFT JOIN (SELECT feature, sum((b - a) * ln(b / a)) AS psi FROM (SELECT feature, bin, greatest(a / sum(a) OVER (PARTITION BY feature), 1e-6) AS a, greatest(b / sum(b) OVER (PARTITION BY feature), 1e-6) AS b FROM
  (SELECT m.feature, greatest(1, len(list_filter(edges, lambda v: v < m.x))) AS bin, count(CASE WHEN date <= DATE '{TRAIN_END}' THEN 1 END)::double AS a, count(CASE WHEN date > DATE '{TRAIN_END}' THEN 1 END)::double AS b FROM ({melted}) m
   JOIN (SELECT feature, list_sort(list_distinct(list_transform(quantile_cont(x, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]), lambda v: round(v, 9)))) AS edges FROM ({melted}) WHERE date <= DATE '{TRAIN_END}' GROUP BY feature) e ON e.feature = m.feature WHERE m.x BETWEEN edges[1] AND edges[-1] GROUP BY 1, 2)) GROUP BY feature) p ON p.feature = f.feature"""


_PSI = drift_sql(_MELT)


def _drift(s, d):
    x = raw(s, d).select("date", *(r(c) for c in DRIFT))
    split = F.col("date") <= F.lit(TRAIN_END).cast("date")
    return mt.feature_drift(x.where(split), x.where(~split), DRIFT)


@query(_PSI)
def feature_drift(s, d):
    return _drift(s, d).select("feature", r("train_mean"), r("val_mean"), r("mean_shift"), r("psi"))


@query(f"SELECT feature, psi FROM ({_PSI})")
def psi(s, d):
    return _drift(s, d).select("feature", r("psi"))


@query(f"SELECT horizon, date, ticker, {r6('weight')} FROM weights")
def target_weights(s, d):
    return bt.target_weights(recs(s, d)).select("horizon", "date", "ticker", r("weight"))


@query(f"SELECT horizon, date, ticker, {r6('day_return')}, {r6('drifted_weight')} FROM drift")
def drifted_weights(s, d):
    return bt.drifted_weights(bt.target_weights(recs(s, d)), next_returns(s, d)).select("horizon", "date", "ticker", r("day_return"), r("drifted_weight"))


@query(f"SELECT d.horizon, d.date, {r6('coalesce(t.turnover, 0)', 'turnover')} FROM days d LEFT JOIN turn t USING (horizon, date)")
def turnover(s, d):
    return bt.turnover(recs(s, d), next_returns(s, d)).select("horizon", "date", r("turnover"))


DAILY = ["gross_return", "net_return", "turnover", "cost", "benchmark_return", "relative_return"]


@query("SELECT horizon, date, regime_state, buy_count, " + ", ".join(r6(c) for c in DAILY) + " FROM daily1")
def backtest_daily(s, d):
    return daily(s, d).select("horizon", "date", "regime_state", "buy_count", *(r(c) for c in DAILY))


def _log(c: str) -> Column:
    return r(F.log(F.when(F.col(c) > 0, F.col(c))), c)


def _log_sql(c: str) -> str:
    return r6(f"CASE WHEN {c} > 0 THEN ln({c}) END", c)


@query(f"SELECT horizon, date, {_log_sql('cumulative_return')}, {_log_sql('benchmark_cumulative_return')} FROM daily1")
def equity_curve(s, d):
    """Logarithms of the curves: they grow by orders of magnitude on this data."""
    return daily(s, d).select("horizon", "date", _log("cumulative_return"), _log("benchmark_cumulative_return"))


@query(f"SELECT horizon, date, {r6('drawdown')} FROM daily")
def drawdown(s, d):
    return daily(s, d).select("horizon", "date", r("drawdown"))


_SD = "stddev_pop(net_return)"


@query(
    f"SELECT x.horizon, days, {_log_sql('total')}, {_log_sql('benchmark_total')}, {r6('turnover_mean')}, {r6('max_drawdown')}, {r6('annualized_volatility')}, {r6('sharpe')}, {r6('precision_buy')}, {r6('hit_rate')}, {r6('average_forward_return_buy')} FROM "
    f"(SELECT horizon, count(*) AS days, arg_max(cumulative_return, date) AS total, arg_max(benchmark_cumulative_return, date) AS benchmark_total, avg(turnover) AS turnover_mean, min(drawdown) AS max_drawdown, {_SD} * sqrt(252) AS annualized_volatility, avg(net_return) / nullif({_SD}, 0) * sqrt(252) AS sharpe FROM daily GROUP BY horizon) x "
    "LEFT JOIN (SELECT horizon, avg(target_class) AS precision_buy, avg(coalesce(forward_return > daily_median_forward_return, false)::int) AS hit_rate, avg(forward_return) AS average_forward_return_buy FROM recs WHERE decision = 'BUY' GROUP BY horizon) b USING (horizon)"
)
def backtest_summary(s, d):
    own = recs(s, d)
    out = bt.backtest_summary(daily(s, d), own).withColumns({"total": F.col("total_return") + 1, "benchmark_total": F.col("benchmark_total_return") + 1})
    return out.select("horizon", "days", _log("total"), _log("benchmark_total"), *(r(c) for c in ["turnover_mean", "max_drawdown", "annualized_volatility", "sharpe", "precision_buy", "hit_rate", "average_forward_return_buy"]))


@query(f"SELECT horizon, regime_state, {r6('avg(net_return)', 'mean_net_return')}, {r6('avg(turnover)', 'mean_turnover')}, count(*) AS days FROM daily GROUP BY horizon, regime_state")
def backtest_by_regime(s, d):
    return bt.backtest_by_regime(daily(s, d)).select("horizon", "regime_state", r("mean_net_return"), r("mean_turnover"), "days")

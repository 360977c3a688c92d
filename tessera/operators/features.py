"""Point-in-time features of a panel: macro series, security windows, sector context, events and filings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.functions.panel import annualised, by_ticker, change, failing, imputed, padded, ratio, rolling, slope, zscore
from tessera.operators.asof import asof_join

RETURNS = (1, 5, 21, 63, 126, 252)


def market() -> WindowSpec:
    """One series for the whole market: a row a date, thousands in decades, so one partition orders it."""
    return Window.partitionBy("symbol").orderBy("date")


# The features in the order of the catalogue (name, formula, how gaps are filled, horizons).
CONTINUOUS = [
    "ret_1d", "ret_5d", "ret_21d", "ret_63d", "ret_126d", "ret_252d", "momentum_12_1", "dist_sma_20", "dist_sma_50", "rsi_14", "ret_5d_z_63d", "realized_vol_21d", "realized_vol_63d", "vol_ratio_21_63", "atr_14_close", "intraday_range",
    "volume_ratio_5_20", "volume_ratio_5_63", "dollar_volume_20d", "volume_trend_21d", "rel_strength_5d", "rel_strength_21d", "rel_strength_63d", "sector_rel_ret_1d", "sector_rel_ret_21d", "sector_vol_gap_21d", "beta_63d",
    "vix_close", "vix_change_5d", "spx_ret_21d", "days_to_next_earnings", "days_since_last_earnings", "last_earnings_surprise_pct", "last_post_earnings_reaction_1d",
    "pe_ttm", "pb_ratio", "ev_ebitda", "roe", "debt_to_equity", "revenue_growth_yoy", "assets_growth_yoy", "fundamentals_age_days", "risk_free_rate",
]
BINARY = ["spx_above_200d"]
SECTOR_MEANS = ["sector_mean_ret_1d", "sector_mean_ret_21d", "sector_mean_vol_21d"]
SECTOR_RELATIVE = ["sector_rel_ret_1d", "sector_rel_ret_21d", "sector_vol_gap_21d"]


def macro_frame(benchmark: DataFrame, volatility: DataFrame, risk_free: DataFrame) -> DataFrame:
    """A row for each benchmark date: its returns and trend, the volatility index and the risk-free rate.

    benchmark, volatility: date, adj_close; risk_free: date, value (text or number, in percent), carried forward
    over its own dates before it is joined.
    """
    whole = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = benchmark.select("date", F.col("adj_close").alias("spx_close"), F.lit(0).alias("symbol")).withColumn("_px", padded(F.col("spx_close"), whole))
    b = b.withColumns({f"spx_ret_{k}d": change(F.col("_px"), k, market()) for k in (1, 5, 21, 63)})
    trend = rolling(F.avg, F.col("spx_close"), n=200, over=market())
    b = b.withColumn("spx_above_200d", F.coalesce(F.col("spx_close") > trend, F.lit(False)).cast("double"))
    v = volatility.select("date", F.col("adj_close").alias("vix_close"), F.lit(0).alias("symbol")).withColumn("_px", padded(F.col("vix_close"), whole))
    v = v.select("date", "vix_close", change(F.col("_px"), 5, market()).alias("vix_change_5d"))
    r = risk_free.select("date", F.lit(0).alias("symbol"), (F.expr("try_cast(value as double)") / 100).alias("_r"))
    r = r.select("date", padded(F.col("_r"), whole).alias("risk_free_rate"))
    return b.drop("_px", "symbol").join(v, "date", "left").join(r, "date", "left")


def security_features(panel: DataFrame, pad: bool = True) -> DataFrame:
    """Windows over each ticker's rows in date order; panel has prices, volume and spx_ret_{1,5,21,63}d.

    pad: returns look across gaps, from the last known price, as the default of older pandas does.
    known_price, where panel has it, is the last known price of rows whose predecessors aren't there. All windows share one
    partitioning, so the panel is shuffled once.
    """
    px, vol = F.col("adj_close"), F.col("volume").cast("double")
    known = F.coalesce("adj_close", "known_price") if "known_price" in panel.columns else px
    out = panel.withColumns({"_px": padded(known) if pad else px, "_prev": F.lag(px, 1).over(by_ticker()), "_row": F.row_number().over(by_ticker())})
    out = out.withColumns({f"ret_{k}d": change(F.col("_px"), k) for k in RETURNS})
    diff = px - F.col("_prev")
    out = out.withColumns(
        {
            "momentum_12_1": F.col("ret_252d") - F.col("ret_21d"),
            "dist_sma_20": ratio(px, rolling(F.avg, px, n=20)) - 1, "dist_sma_50": ratio(px, rolling(F.avg, px, n=50)) - 1,
            "_gain": F.when(diff.isNotNull(), F.greatest(diff, F.lit(0.0))), "_loss": F.when(diff.isNotNull(), F.greatest(-diff, F.lit(0.0))),
            "_range": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_prev")), F.abs(F.col("low") - F.col("_prev"))),
            "intraday_range": ratio(F.col("high") - F.col("low"), F.col("close")),
            "ret_5d_z_63d": ratio(F.col("ret_5d") - rolling(F.avg, F.col("ret_5d"), n=63), rolling(F.stddev_samp, F.col("ret_5d"), n=63)),
            "realized_vol_21d": annualised(rolling(F.stddev_samp, F.col("ret_1d"), n=21)), "realized_vol_63d": annualised(rolling(F.stddev_samp, F.col("ret_1d"), n=63)),
            "_vol5": rolling(F.avg, vol, n=5), "_vol20": rolling(F.avg, vol, n=20), "_vol63": rolling(F.avg, vol, n=63),
            "dollar_volume_20d": rolling(F.avg, px * vol, n=20), "volume_trend_21d": slope(F.log1p(vol), 21, F.col("_row")),
            "beta_63d": ratio(rolling(F.covar_samp, F.col("ret_1d"), F.col("spx_ret_1d"), n=63), rolling(F.var_samp, F.col("spx_ret_1d"), n=63)),
        }
        | {f"rel_strength_{k}d": F.col(f"ret_{k}d") - F.col(f"spx_ret_{k}d") for k in (5, 21, 63)}
    )
    gain, loss = rolling(F.avg, F.col("_gain"), n=14), rolling(F.avg, F.col("_loss"), n=14)
    out = out.withColumns(
        {
            "_up": gain, "_down": loss, "atr_14_close": ratio(rolling(F.avg, F.col("_range"), n=14), F.col("close")),
            "vol_ratio_21_63": ratio(F.col("realized_vol_21d"), F.col("realized_vol_63d")),
            "volume_ratio_5_20": ratio(F.col("_vol5"), F.col("_vol20")), "volume_ratio_5_63": ratio(F.col("_vol5"), F.col("_vol63")),
        }
    )
    strength = F.when(F.col("_down") > 0, 100 - 100 / (1 + F.col("_up") / F.when(F.col("_down") > 0, F.col("_down")))).when(F.col("_up") > 0, 100.0)
    return out.withColumn("rsi_14", strength).drop("_px", "_prev", "_row", "_gain", "_loss", "_range", "_vol5", "_vol20", "_vol63", "_up", "_down")


def sector_context(features: DataFrame) -> DataFrame:
    """Means of the date's sector and what each row differs from them by; no join back."""
    w = Window.partitionBy("date", "sector")
    pairs = list(zip(SECTOR_MEANS, SECTOR_RELATIVE, ("ret_1d", "ret_21d", "realized_vol_21d")))
    known = F.col("sector").isNotNull()
    out = features.withColumns({mean: F.when(known, F.avg(x).over(w)) for mean, _, x in pairs})
    return out.withColumns({rel: F.col(x) - F.col(mean) for mean, rel, x in pairs})


def one_hot(df: DataFrame, values: list[str], column: str = "sector") -> DataFrame:
    """A column column_value of 1.0 or 0.0 for each of values."""
    return df.withColumns({f"{column}_{v}": F.when(F.col(column) == v, 1.0).otherwise(0.0) for v in values})


def earnings_features(features: DataFrame, earnings: DataFrame) -> DataFrame:
    """Days to the next and since the last event, its surprise and the return of its first price date.

    Of several events of a ticker on one day the last by surprise counts. An event's reaction is known from that price date on: it is looked up as of it.
    """
    events = earnings.select("ticker", F.to_date("earnings_date").alias("earnings_date"), "surprise_pct")
    events = events.groupBy("ticker", "earnings_date").agg(F.max("surprise_pct").alias("surprise_pct"))
    events = post_event_reaction(events, features)
    out = asof_join(features, events, "ticker", "date", "earnings_date", {"_next": F.col("earnings_date")}, backward=False)
    take = {"_last": F.col("earnings_date"), "last_earnings_surprise_pct": F.col("surprise_pct"), "last_post_earnings_reaction_1d": F.col("post_earnings_reaction_1d")}
    out = asof_join(out, events, "ticker", "date", "earnings_date", take)
    days = {"days_to_next_earnings": F.datediff("_next", "date").cast("double"), "days_since_last_earnings": F.datediff("date", "_last").cast("double")}
    return out.withColumns(days).drop("_next", "_last")


def post_event_reaction(events: DataFrame, returns: DataFrame, event_time: str = "earnings_date") -> DataFrame:
    """events with the one-day return of their ticker's first price date at or after them."""
    return asof_join(events, returns.select("ticker", "date", "ret_1d"), "ticker", event_time, "date", {"post_earnings_reaction_1d": F.col("ret_1d")}, backward=False)


def trailing_fundamentals(filings: DataFrame) -> DataFrame:
    """Sums over the last four filings and growth against the fourth before, by ticker in order of filing.

    Only 10-Q rows count as quarters, so a window that holds another form has no sum, unless the row is
    a 10-K: that takes its own annual figure. Depreciation sums what quarters there are.
    """
    w = Window.partitionBy("ticker").orderBy("filed_at", "period_end")
    quarter, annual = (F.coalesce(F.contains("form", F.lit(x)), F.lit(False)) for x in ("10-Q", "10-K"))
    quarterly = lambda c: F.when(quarter, F.col(c))
    total = lambda c, least: rolling(F.sum, quarterly(c), n=4, over=w, least=least)
    out = filings.withColumns({f"{c}_ttm": F.coalesce(total(c, 4), F.when(annual, F.col(c))) for c in ("revenue", "net_income", "operating_income")})
    out = out.withColumns(
        {
            "depreciation_ttm": total("depreciation_amortization", 1),
            "revenue_growth_yoy": ratio(quarterly("revenue"), F.lag(quarterly("revenue"), 4).over(w)) - 1,
            "assets_growth_yoy": ratio(F.col("total_assets"), F.lag("total_assets", 4).over(w)) - 1,
        }
    )
    out = out.withColumn("ebitda_ttm", F.col("operating_income_ttm") + F.col("depreciation_ttm"))
    return out.select("ticker", "filed_at", "period_end", *FUNDAMENTALS)


FUNDAMENTALS = [
    "revenue_ttm", "net_income_ttm", "operating_income_ttm", "depreciation_ttm", "ebitda_ttm", "revenue_growth_yoy", "assets_growth_yoy", "total_assets", "total_liabilities", "stockholders_equity", "cash_and_equivalents", "common_shares_outstanding",
]


def fundamental_features(features: DataFrame, filings: DataFrame, stale_after: int = 183) -> DataFrame:
    """The last filing at or before each date, the ratios it gives and whether it is fresh."""
    known = trailing_fundamentals(filings)
    take = {c: F.col(c) for c in ["filed_at", "period_end", *FUNDAMENTALS]}
    out = asof_join(features, known, "ticker", "date", "filed_at", take, tie=F.col("period_end"))
    c = F.col
    out = out.withColumn("market_cap", c("adj_close") * c("common_shares_outstanding"))
    out = out.withColumn("enterprise_value", c("market_cap") + c("total_liabilities") - c("cash_and_equivalents"))
    return out.withColumns(
        {
            "pe_ttm": ratio(c("market_cap"), c("net_income_ttm")), "pb_ratio": ratio(c("market_cap"), c("stockholders_equity")), "ev_ebitda": ratio(c("enterprise_value"), c("ebitda_ttm")),
            "roe": ratio(c("net_income_ttm"), c("stockholders_equity")), "debt_to_equity": ratio(c("total_liabilities"), c("stockholders_equity")),
            "fundamentals_age_days": F.datediff("date", "filed_at").cast("double"),
            "fundamentals_fresh": F.coalesce(F.datediff("date", "filed_at") <= stale_after, F.lit(False)),
        }
    )


def missing_ratio(columns: list[str]) -> Column:
    """Share of columns that are NULL in a row."""
    return sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0)) / F.lit(float(len(columns)))


def finalize_features(features: DataFrame, sectors: list[str], max_missing: float = 0.2, compat: bool = True) -> DataFrame:
    """Missing ratio, then medians for gaps and z-scores within each date, then the flags.

    compat: the missing ratio counts the sector columns as well: means (never imputed), relatives (a second time) and
    one-hots; else only the catalogue's and the one-hots. vix_close stays as it was in vix_close_raw, for the regime. The medians and the z-scores
    share the date's partitioning.
    """
    hot = [f"sector_{s}" for s in sectors]
    counted = CONTINUOUS + BINARY + hot + (SECTOR_MEANS + SECTOR_RELATIVE if compat else [])
    out = features.withColumns({"missing_feature_ratio": missing_ratio(counted), "vix_close_raw": F.col("vix_close")})
    out = out.withColumns(
        {
            "feature_missing_fail": F.col("missing_feature_ratio") > max_missing,
            "fundamentals_missing_fail": ~F.coalesce("fundamentals_fresh", F.lit(False)), "universe_history_fail": ~F.coalesce("universe_reliable", F.lit(False)),
        }
    )
    out = out.withColumns({c: imputed(F.col(c), "date") for c in CONTINUOUS})
    out = out.withColumns({c: zscore(F.col(c), "date") for c in CONTINUOUS} | {c: F.coalesce(c, F.lit(0.0)) for c in BINARY})
    return out.withColumn("trainable", trainable())


FLAGS = ["insufficient_price_history", "insufficient_post_listing_history", "stale_price", "missing_gap_fail", "feature_missing_fail", "fundamentals_missing_fail", "universe_history_fail"]


def trainable() -> Column:
    """No flag fails; an unknown flag fails."""
    out = F.lit(True)
    for c in FLAGS:
        out = out & ~failing(F.col(c))
    return out

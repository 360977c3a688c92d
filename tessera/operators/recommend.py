"""From scores to BUY, NO_BUY and NOT_ENOUGH_DATA."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Flags and the reasons they give, in the order in which reasons are listed.
REASONS = [
    ("insufficient_price_history", "short_price_history"),
    ("missing_gap_fail", "recent_missing_price_gap"),
    ("feature_missing_fail", "incomplete_feature_set"),
    ("stale_price", "stale_price"),
    ("insufficient_post_listing_history", "post_listing_buffer"),
    ("fundamentals_missing_fail", "stale_or_missing_fundamentals"),
    ("universe_history_fail", "unreliable_universe_history"),
]
REASONS_COLUMNS = [flag for flag, _ in REASONS]
OUTPUT = ["date", "ticker", "horizon", "model_name", "score", "rank", "decision", "confidence", "regime_state", "consensus_buy", "buy_horizon_count", "not_enough_data_reason", "target_class", "forward_return", "forward_excess_return", "daily_median_forward_return", "sector", "industry"]


def regime(volatility: Column, above: Column, closed: float = 35.0, caution: float = 25.0) -> Column:
    """CLOSED, CAUTION or OPEN; an unknown volatility is OPEN, an unknown trend no reason for caution."""
    return F.when(volatility >= closed, "CLOSED").when((volatility >= caution) & (above < 1), "CAUTION").otherwise("OPEN")


def not_enough_data_reason(columns: list[str]) -> Column:
    """Reasons of the flags that fail, joined by |; unknown flags fail, absent columns don't."""
    return F.concat_ws("|", *(F.when(F.coalesce(flag, F.lit(True)), F.lit(reason)) for flag, reason in REASONS if flag in columns))


def recommend(scored: DataFrame, buy_fraction: float = 0.10, min_buys: int = 1, caution_max: int = 5, closed: float = 35.0, caution: float = 25.0, consensus: int = 3) -> DataFrame:
    """Decisions for each (date, horizon): scored has ticker, score, vix_close_raw, spx_above_200d and the flags.

    Valid rows are ranked by score (ties by ticker); the first max(min_buys, a share) are bought, fewer under CAUTION, none
    when CLOSED. Confidence is the score's distance from the valid rows' mean. A model_name, where there is one, keeps models apart.
    """
    group = [c for c in ("date", "horizon", "model_name") if c in scored.columns]
    each = Window.partitionBy(*group)
    volatility, above = (F.max(c).over(each) for c in ("vix_close_raw", "spx_above_200d"))
    out = scored.withColumns({"regime_state": regime(volatility, above, closed, caution), "not_enough_data_reason": not_enough_data_reason(scored.columns)})
    valid = F.col("not_enough_data_reason") == ""
    out = out.withColumn("_valid", valid)
    ranked = Window.partitionBy(*group, "_valid").orderBy(F.col("score").desc_nulls_last(), "ticker")
    own = Window.partitionBy(*group, "_valid")
    out = out.withColumns({"_n": F.count("*").over(own), "rank": F.when(F.col("_valid"), F.row_number().over(ranked)), "_mean": F.avg("score").over(own), "_sd": F.stddev_pop("score").over(own)})
    # rounded: of two scores, each is one deviation from their mean, which floating point may miss by a hair
    z = F.round((F.col("score") - F.col("_mean")) / F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0), 9)
    most = F.greatest(F.lit(min_buys), F.floor(F.col("_n") * F.lit(buy_fraction)))
    most = F.when(F.col("regime_state") == "CLOSED", 0).when(F.col("regime_state") == "CAUTION", F.least(most, F.lit(caution_max))).otherwise(most)
    out = out.withColumns(
        {
            "confidence": F.when(F.col("_valid"), F.when(z >= 2, "HIGH").when(z >= 1, "MEDIUM").otherwise("LOW")),
            "decision": F.when(~F.col("_valid"), "NOT_ENOUGH_DATA").when(F.col("rank") <= most, "BUY").otherwise("NO_BUY"),
        }
    )
    over = Window.partitionBy(*[c for c in group if c != "horizon"], "ticker")
    out = out.withColumn("buy_horizon_count", F.count(F.when(F.col("decision") == "BUY", 1)).over(over))
    out = out.withColumn("consensus_buy", F.col("buy_horizon_count") >= consensus)
    return out.select(*(c for c in OUTPUT if c in out.columns))


def in_order(decided: DataFrame) -> DataFrame:
    """Recommendations by date, horizon, model and rank, unranked rows last by ticker."""
    keys = [c for c in ("date", "horizon", "model_name") if c in decided.columns]
    return decided.orderBy(*keys, F.col("rank").asc_nulls_last(), "ticker")


def per_horizon(frame: DataFrame, horizons: dict[str, int]) -> DataFrame:
    """Each row of frame once for every horizon."""
    rows = F.array(*(F.struct(F.lit(n).alias("horizon"), F.lit(k).alias("horizon_days")) for n, k in horizons.items()))
    return frame.withColumn("_h", F.explode(rows)).withColumns({"horizon": F.col("_h.horizon"), "horizon_days": F.col("_h.horizon_days")}).drop("_h")


def with_features(predictions: DataFrame, features: DataFrame) -> DataFrame:
    """predictions with their (date, ticker)'s features; NULLs where there are none."""
    return predictions.join(features, ["date", "ticker"], "left")


def latest_slice(features: DataFrame, start: str | None = None, end: str | None = None, latest_only: bool = False) -> DataFrame:
    """Rows within the bounds (inclusive), or of the last date where there are none or only that is wanted."""
    if latest_only or start is None and end is None:
        return features.join(features.agg(F.max("date").alias("date")), "date", "left_semi")
    bounds = F.lit(True)
    if start is not None:
        bounds = bounds & (F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        bounds = bounds & (F.col("date") <= F.lit(end).cast("date"))
    return features.where(bounds)

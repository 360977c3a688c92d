"""Calendar alignment of price panels, bounded fills and quality flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.panel import by_ticker, filled, last_rows, padded, running

PRICES = ["open", "high", "low", "close", "adj_close"]


def calendar_reindex(prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every ticker on every calendar date: rows off the calendar go, missing ones appear with NULLs.

    calendar: distinct dates, small beside the panel (one row a day); each ticker's dates are made by
    exploding one array of them, so tickers stay distributed.
    """
    days = calendar.agg(F.sort_array(F.collect_set("date")).alias("days"))
    grid = prices.select("ticker").distinct().join(F.broadcast(days)).select("ticker", F.explode("days").alias("date"))
    return grid.join(prices, ["ticker", "date"], "left").withColumn("was_observed", F.col("adj_close").isNotNull())


def bounded_fill(grid: DataFrame, limit: int = 5) -> DataFrame:
    """Prices and volume, each filled on its own for at most `limit` rows; source without limit."""
    columns = {c: filled(F.col(c), limit) for c in [*PRICES, "volume"] if c in grid.columns}
    if "source" in grid.columns:
        columns["source"] = padded(F.col("source"))
    return grid.withColumns(columns)


QUALITY = ["observed_price", "history_days", "listing_age_days", "stale_price_days", "missing_streak", "max_missing_gap_21d", "insufficient_price_history", "insufficient_post_listing_history", "stale_price", "missing_gap_fail"]


def with_quality(grid: DataFrame, limit: int = 5, min_history: int = 252, ipo_buffer: int = 63, stale_after: int = 2, compat: bool = False) -> DataFrame:
    """grid with history, age, staleness and gaps of each (date, ticker), and the four flags on them.

    listing_age_days counts days since the first observation; compat counts back from the next one instead.
    Its windows are those of bounded_fill, so both together take one shuffle.
    """
    seen, date = F.col("was_observed"), F.col("date")
    seen_on = F.when(seen, date)
    first = F.first(seen_on, ignorenulls=True).over(by_ticker().rowsBetween(0, Window.unboundedFollowing)) if compat else F.min(seen_on).over(running())
    out = grid.withColumns(
        {
            "observed_price": seen, "history_days": F.sum(seen.cast("long")).over(running()),
            "listing_age_days": F.coalesce(F.datediff(date, first).cast("long") + 1, F.lit(0)),
            "stale_price_days": F.coalesce(F.datediff(date, padded(seen_on)).cast("double"), F.lit(float("inf"))),
            "_missing": F.sum((~seen).cast("long")).over(running()),
        }
    )
    # missing rows since the last observed one: the running count less its value there
    at_seen = F.coalesce(padded(F.when(seen, F.col("_missing"))), F.lit(0))
    out = out.withColumn("missing_streak", F.col("_missing") - at_seen)
    out = out.withColumn("max_missing_gap_21d", F.max("missing_streak").over(last_rows(21)))
    return flagged(out.drop("_missing"), limit, min_history, ipo_buffer, stale_after)


def flagged(quality: DataFrame, limit: int, min_history: int, ipo_buffer: int, stale_after: int) -> DataFrame:
    """quality with its four flags."""
    return quality.withColumns(
        {
            "insufficient_price_history": F.col("history_days") < min_history,
            "insufficient_post_listing_history": F.col("listing_age_days") < ipo_buffer,
            "stale_price": F.col("stale_price_days") > stale_after,
            "missing_gap_fail": F.col("max_missing_gap_21d") > limit,
        }
    )


def quality_flags(grid: DataFrame, limit: int = 5, min_history: int = 252, ipo_buffer: int = 63, stale_after: int = 2, compat: bool = False) -> DataFrame:
    """What with_quality adds, by date and ticker."""
    return with_quality(grid, limit, min_history, ipo_buffer, stale_after, compat).select("date", "ticker", *QUALITY)

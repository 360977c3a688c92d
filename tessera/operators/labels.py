"""Forward-looking labels for several horizons in one pass over each ticker."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.panel import by_ticker, padded, ratio, share_rank
from tessera.operators.asof import event_in_window

# Horizons by name, in rows.
HORIZONS = {"1d": 1, "1w": 5, "2w": 10, "1m": 21, "2m": 42}


def forward_labels(prices: DataFrame, horizons: dict[str, int] | None = None) -> DataFrame:
    """(date, ticker, horizon): the return over the next rows, the date it ends, and whether the rows run out.

    Prices are carried forward without limit, so a ticker that stops trading has flat labels while the calendar goes on.
    """
    out = prices.select("date", "ticker", padded(F.col("adj_close")).alias("_px"))
    each = [
        F.struct(F.lit(n).alias("horizon"), F.lit(k).alias("horizon_days"), F.lead("date", k).over(by_ticker()).alias("label_end_date"), F.lead("_px", k).over(by_ticker()).alias("_future"))
        for n, k in (horizons or HORIZONS).items()
    ]
    out = out.withColumn("x", F.array(*each)).select("date", "ticker", "_px", F.explode("x").alias("x")).select("date", "ticker", "_px", "x.*")
    return out.select("date", "ticker", "horizon", "horizon_days", "label_end_date", (ratio(F.col("_future"), F.col("_px")) - 1).alias("forward_return"), F.col("_future").isNull().alias("label_truncated"))


def rank_targets(labels: DataFrame, positive: float = 0.8) -> DataFrame:
    """Rank, median and excess of forward returns within (date, horizon), and the class of the top ranks."""
    r, by = F.col("forward_return"), ("date", "horizon")
    out = labels.withColumns({"target_rank": share_rank(r, *by), "daily_median_forward_return": F.when(r.isNotNull(), F.median(r).over(Window.partitionBy(*by)))})
    return out.withColumns({"forward_excess_return": r - F.col("daily_median_forward_return"), "target_class": (F.col("target_rank") >= positive).cast("int")})


def label_store(prices: DataFrame, universe: DataFrame, earnings: DataFrame, horizons: dict[str, int] | None = None) -> DataFrame:
    """Labels of members: ranks are among the date's members, returns over all of a ticker's rows."""
    members = universe.where("is_member").select("date", "ticker", "membership_reliability", "universe_reliable")
    out = rank_targets(forward_labels(prices, horizons).join(members, ["date", "ticker"]))
    events = earnings.select("ticker", F.to_date("earnings_date").alias("earnings_date"))
    return event_in_window(out, events)


def next_day_returns(prices: DataFrame) -> DataFrame:
    """Each row's return to the ticker's next row, across gaps from the last known price."""
    out = prices.select("date", "ticker", padded(F.col("adj_close")).alias("_px"))
    return out.select("date", "ticker", (ratio(F.lead("_px", 1).over(by_ticker()), F.col("_px")) - 1).alias("next_day_return"))

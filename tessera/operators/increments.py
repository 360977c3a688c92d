"""New days only: what windows look back on is kept by ticker, so that an increment reads that and its own rows.

A tail is a table of the last rows of each ticker, however long ago they were: a ticker that left and came back
has its old rows. Each function gives what the same windows over the whole history give for the new rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.panel import by_ticker, filled, last_rows, padded, running
from tessera.operators.features import RETURNS, security_features
from tessera.operators.quality import PRICES, QUALITY, flagged

LOOK_BACK = max(RETURNS)  # the longest of the features' windows, in rows


def last_of_each(rows: DataFrame, n: int) -> DataFrame:
    """The last n rows of each ticker."""
    back = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("date").desc()))
    return rows.withColumn("_back", back).where(F.col("_back") <= n).drop("_back")


def _after(tail: DataFrame | None, fresh: DataFrame) -> DataFrame:
    new = fresh.withColumn("_new", F.lit(True))
    return new if tail is None else tail.withColumn("_new", F.lit(False)).unionByName(new, allowMissingColumns=True)


def security_tail(panel: DataFrame, tail: DataFrame | None = None) -> DataFrame:
    """What security_since needs of the rows up to now: the last LOOK_BACK rows of a ticker, each with the last known price.

    tail: the one before these rows, if any. Rows of panel must be later than the tail's of their ticker.
    """
    rows = _after(tail, panel.drop("known_price"))
    known = F.coalesce("adj_close", "known_price") if "known_price" in rows.columns else F.col("adj_close")
    return last_of_each(rows.withColumn("known_price", padded(known)).drop("_new"), LOOK_BACK)


def security_since(tail: DataFrame, fresh: DataFrame, pad: bool = True) -> DataFrame:
    """security_features of the fresh rows, from the tail and them: one shuffle of both by ticker."""
    return security_features(_after(tail, fresh), pad).where("_new").drop("_new", "known_price")


_KEPT = ["history_days", "first_seen", "last_seen", "missing_streak"]


def quality_tail(grid: DataFrame, limit: int = 5, tail: DataFrame | None = None) -> DataFrame:
    """What quality_since needs of the rows up to now: the last max(21, limit) rows of a ticker with their counters."""
    counted = _counted(_after(tail, grid))
    if "source" in grid.columns:
        counted = counted.withColumn("source", padded(F.col("source")))
    return last_of_each(counted.drop("_new"), max(21, limit))


def _counted(rows: DataFrame) -> DataFrame:
    """The counters of _KEPT on all rows: those of a tail's rows as they are, those of new rows carried on from them."""
    for c, kind in zip(_KEPT, ("long", "date", "date", "long")):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast(kind))
    whole, new, seen = Window.partitionBy("ticker"), F.col("_new"), F.col("was_observed")
    seen_on = F.when(seen, F.col("date"))
    before = F.coalesce(F.max("history_days").over(whole), F.lit(0))
    missing = F.coalesce(F.sum(F.when(new, (~seen).cast("long"))).over(running()), F.lit(0))
    last_streak = F.last(F.when(~new, F.col("missing_streak")), ignorenulls=True).over(by_ticker().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumns({"_before": before, "_missing": missing, "_streak": F.coalesce(last_streak, F.lit(0))})
    since = F.coalesce(padded(F.when(new & seen, F.col("_missing"))), -F.col("_streak"))
    rows = rows.withColumns(
        {
            "history_days": F.when(new, F.col("_before") + F.sum(F.when(new, seen.cast("long"))).over(running())).otherwise(F.col("history_days")),
            "first_seen": F.coalesce("first_seen", F.min(F.coalesce("first_seen", seen_on)).over(running())),
            "last_seen": padded(F.coalesce("last_seen", seen_on)),
            "missing_streak": F.when(new, F.col("_missing") - since).otherwise(F.col("missing_streak")),
        }
    )
    return rows.drop("_before", "_missing", "_streak")


def quality_since(tail: DataFrame, fresh: DataFrame, limit: int = 5, min_history: int = 252, ipo_buffer: int = 63, stale_after: int = 2) -> DataFrame:
    """Filled prices and quality of the fresh rows of a calendar grid, from the tail and them.

    Listing age counts from the first observation; counting back from the next one needs days that are yet to come.
    """
    rows = _counted(_after(tail, fresh))
    fills = {c: filled(F.col(c), limit) for c in [*PRICES, "volume"] if c in rows.columns}
    if "source" in rows.columns:
        fills["source"] = padded(F.col("source"))
    rows = rows.withColumns(fills).withColumns(
        {
            "observed_price": F.col("was_observed"), "max_missing_gap_21d": F.max("missing_streak").over(last_rows(21)),
            "listing_age_days": F.coalesce(F.datediff("date", "first_seen").cast("long") + 1, F.lit(0)),
            "stale_price_days": F.coalesce(F.datediff("date", "last_seen").cast("double"), F.lit(float("inf"))),
        }
    )
    return flagged(rows.where("_new"), limit, min_history, ipo_buffer, stale_after).select(*fresh.columns, *QUALITY)

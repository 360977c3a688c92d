"""Universe membership from a change log, and its enrichment with metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.panel import running
from tessera.operators.asof import asof_join


def normal_ticker(name: str):
    """Dots become dashes; empty strings and the words nan and None are NULL."""
    plain = F.replace(F.col(name).cast("string"), F.lit("."), F.lit("-"))
    return F.when(~plain.isin("", "nan", "None"), plain)


def membership_history(current: DataFrame, changes: DataFrame, dates: DataFrame, known: float = 0.9, before: float = 0.5, no_log: float = 0.25, source: str = "change_log") -> DataFrame:
    """Members on each date, from today's members and a log of (date, added_ticker, removed_ticker).

    A ticker is a member on d if the earliest change at or after d that touches it removes it, or if
    none does and it is a member today: on a change's own date the set before it holds. Of several
    changes of one day the log's last row counts, and in a row its removal. Reliability is `known` after the
    log's earliest date, `before` at or before it, `no_log` without a log. changes may have a column `seq`, its order within a day.
    """
    log = changes.withColumns({"added": normal_ticker("added_ticker"), "removed": normal_ticker("removed_ticker")})
    seq = F.col("seq").cast("long") if "seq" in changes.columns else F.lit(0).cast("long")
    touched = log.select(F.to_date("date").alias("change_date"), seq.alias("seq"), F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("added").alias("ticker")), F.struct(F.lit(1).alias("k"), F.col("removed").alias("ticker")))).alias("x"))
    touched = touched.select("change_date", "x.ticker", (F.col("seq") * 2 + F.col("x.k")).alias("order"), (F.col("x.k") == 1).alias("removal")).where("ticker is not null")
    now = current.select(normal_ticker("ticker").alias("ticker")).where("ticker is not null").distinct().withColumn("current", F.lit(True))
    tickers = touched.select("ticker").union(now.select("ticker")).distinct().join(now, "ticker", "left")
    days = dates.agg(F.sort_array(F.collect_set("date")).alias("days"))
    panel = tickers.join(F.broadcast(days)).select("ticker", "current", F.explode("days").alias("date"))
    found = asof_join(panel, touched, "ticker", "date", "change_date", {"removal": F.col("removal")}, backward=False, tie=F.col("order"))
    first = changes.agg(F.min(F.to_date("date")).alias("first"))
    found = found.where(F.coalesce("removal", "current", F.lit(False))).join(F.broadcast(first))
    reliability = F.when(F.col("first").isNull(), no_log).when(F.col("date") > F.col("first"), known).otherwise(before)
    return found.select("date", "ticker", F.lit(True).alias("is_member"), reliability.cast("double").alias("membership_reliability"), F.lit(source).alias("source"))


def daily_universe(membership: DataFrame, metadata: DataFrame, least_reliable: float = 0.7, order: str | None = None) -> DataFrame:
    """membership with sector and industry (the first of each ticker by `order`), reliability, first date and days so far."""
    w = Window.partitionBy("ticker").orderBy(*([order] if order else []), "sector", "industry")
    first = metadata.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("ticker", "sector", "industry")
    out = membership.join(first, "ticker", "left")
    return out.withColumns(
        {
            "sector": F.coalesce("sector", F.lit("Unknown")), "industry": F.coalesce("industry", F.lit("Unknown")),
            "universe_reliable": F.col("membership_reliability") >= least_reliable,
            "first_membership_date": F.min("date").over(Window.partitionBy("ticker")),
            "membership_days": F.count("*").over(running()),
        }
    )


def merged_metadata(vendor: DataFrame, listed: DataFrame) -> DataFrame:
    """Every ticker of either side, with the vendor's sector and industry, else the list's, else Unknown."""
    a = vendor.select("ticker", F.col("sector").alias("s1"), F.col("industry").alias("i1"))
    b = listed.select("ticker", F.col("sector").alias("s2"), F.col("industry").alias("i2"))
    unknown = F.lit("Unknown")
    return a.join(b, "ticker", "full").select("ticker", F.coalesce("s1", "s2", unknown).alias("sector"), F.coalesce("i1", "i2", unknown).alias("industry"))

"""Ticker filters, splits and deduplication."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.quality import PRICES


def tickers_with_prices(prices: DataFrame) -> DataFrame:
    """Distinct tickers that have any price at all."""
    present = F.coalesce(*(F.col(c) for c in PRICES if c in prices.columns)).isNotNull()
    return prices.where(present & F.col("ticker").isNotNull()).select("ticker").distinct()


def tickers_without_prices(listed: DataFrame, prices: DataFrame) -> DataFrame:
    """Distinct listed tickers that have no price at all."""
    return listed.select("ticker").where("ticker is not null").distinct().join(tickers_with_prices(prices), "ticker", "left_anti")


def recent_tickers(prices: DataFrame, end: Column | str, max_age: int = 120) -> DataFrame:
    """Tickers whose last row, priced or not, is at most max_age days before end."""
    limit = F.date_sub(F.to_date(F.lit(end)) if isinstance(end, str) else end, max_age)
    return prices.groupBy("ticker").agg(F.max("date").alias("last")).where(F.col("last") >= limit).select("ticker")


def listed_tickers(recent: DataFrame, listed: DataFrame) -> DataFrame:
    """Recent tickers that are listed today."""
    return recent.select("ticker").distinct().join(listed.select("ticker"), "ticker", "left_semi")


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the last in order, which must tell any two rows of a key apart."""
    w = Window.partitionBy(*keys).orderBy(*(c.desc_nulls_last() for c in order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def eligible(frame: DataFrame, horizon: str, validation: bool = True) -> DataFrame:
    """Rows a model may learn from: trainable, with targets, and in validation not cut off by the end of data."""
    out = frame.where((F.col("horizon") == horizon) & F.col("trainable") & F.col("target_rank").isNotNull() & F.col("target_class").isNotNull())
    return out.where(~F.col("label_truncated")) if validation else out


def purged_split(frame: DataFrame, train_end: str, val_start: str, val_end: str) -> tuple[DataFrame, DataFrame]:
    """Rows up to train_end whose labels end before validation starts, and validation's own."""
    d = lambda x: F.lit(x).cast("date")
    train = frame.where((F.col("date") <= d(train_end)) & (F.col("label_end_date") < d(val_start)))
    return train, frame.where(F.col("date").between(d(val_start), d(val_end)))


def business_days(start: str, end: str) -> int:
    """Weekdays from start to end, both counted."""
    a, b = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    return sum((a + dt.timedelta(k)).weekday() < 5 for k in range((b - a).days + 1))


def check_embargo(train_end: str, val_start: str, embargo: int) -> int:
    """Business days between the ends of a split; raises where they are fewer than the embargo."""
    gap = business_days(train_end, val_start) - 1
    if gap < embargo:
        raise ValueError(f"the split leaves {gap} business days, the embargo is {embargo}")
    return gap


def business_calendar(start: str, end: str, df: DataFrame) -> DataFrame:
    """Mondays to Fridays from start to end, on the session of df."""
    spark = df.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day"))).alias("date"))
    return days.where(F.weekday("date") < 5)


def group_sizes(frame: DataFrame) -> DataFrame:
    """Rows of each date, in order of date."""
    return frame.groupBy("date").agg(F.count("*").alias("size")).orderBy("date")

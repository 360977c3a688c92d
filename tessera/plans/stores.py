"""The stores of the pipeline as DataFrames: panel, features, labels, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import features as ft
from tessera.operators import labels as lb
from tessera.operators.quality import bounded_fill, calendar_reindex, quality_flags, with_quality


def clean(prices: DataFrame, calendar: DataFrame, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """Filled prices and quality flags on the calendar. prices must hold one row for each (date, ticker)."""
    grid = calendar_reindex(prices.drop("sector"), calendar)
    return bounded_fill(grid), quality_flags(grid, compat=compat)


def clean_panel(prices: DataFrame, calendar: DataFrame, compat: bool = False) -> DataFrame:
    """Filled prices and quality flags in one frame: the same windows, no join."""
    return bounded_fill(with_quality(calendar_reindex(prices.drop("sector"), calendar), compat=compat))


def base_panel(cleaned: DataFrame, universe: DataFrame, macro: DataFrame) -> DataFrame:
    """Members' rows, with their quality, and the date's macro row. Windows from here on count member rows."""
    members = universe.where("is_member").drop("source", "is_member")
    return cleaned.drop("source").join(members, ["date", "ticker"]).join(macro, "date", "left")


def feature_store(panel: DataFrame, earnings: DataFrame, filings: DataFrame, sectors: list[str], pad: bool = True, compat: bool = True) -> DataFrame:
    """All features of the panel, normalised within each date, with flags and `trainable`."""
    return ft.finalize_features(raw_features(panel, earnings, filings, sectors, pad), sectors, compat=compat)


def raw_features(panel: DataFrame, earnings: DataFrame, filings: DataFrame, sectors: list[str], pad: bool = True) -> DataFrame:
    """All features before gaps are filled and dates normalised."""
    out = ft.one_hot(ft.sector_context(ft.security_features(panel, pad)), sectors)
    return ft.fundamental_features(ft.earnings_features(out, earnings), filings)


def model_frame(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features and labels of each (date, ticker, horizon). What both have is taken from the labels."""
    return features.drop("membership_reliability", "universe_reliable").join(labels, ["date", "ticker"])


def sector_values(universe: DataFrame) -> list[str]:
    """Distinct sectors, sorted: a handful of names, one column each."""
    return [r[0] for r in universe.select("sector").distinct().orderBy("sector").collect() if r[0] is not None]


def label_store(cleaned: DataFrame, universe: DataFrame, earnings: DataFrame) -> DataFrame:
    return lb.label_store(cleaned, universe, earnings).withColumn("target_class", F.col("target_class").cast("int"))

"""Long-only daily backtest. Each day depends on the day before only, so it is a shifted join, not a loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.panel import annualised


def _group(df: DataFrame) -> list[str]:
    return [c for c in ("horizon", "model_name") if c in df.columns]


def target_weights(recommendations: DataFrame) -> DataFrame:
    """Equal weights of each day's BUY rows."""
    group = _group(recommendations)
    return recommendations.where("decision = 'BUY'").select(*group, "date", "ticker", (1.0 / F.count("*").over(Window.partitionBy(*group, "date"))).alias("weight"))


def drifted_weights(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """What each day's weights have become by the next: w (1 + r), scaled to 1; nothing where their sum isn't above 0."""
    group = _group(weights)
    grown = weights.join(returns, ["date", "ticker"], "left").withColumn("_r", F.coalesce("next_day_return", F.lit(0.0)))
    grown = grown.withColumn("_w", F.col("weight") * (1 + F.col("_r"))).withColumn("_all", F.sum("_w").over(Window.partitionBy(*group, "date")))
    return grown.where("_all > 0").select(*group, "date", "ticker", "weight", F.col("_r").alias("day_return"), (F.col("_w") / F.col("_all")).alias("drifted_weight"))


def turnover(recommendations: DataFrame, returns: DataFrame) -> DataFrame:
    """Turnover and gross return of every day that has recommendations, and its regime.

    A held row counts on its own day with its weight, and on the next day with what that has become:
    one row gives both entries, so weights are made once and nothing is joined to itself.
    """
    group = _group(recommendations)
    days = recommendations.groupBy(*group, "date").agg(F.max("regime_state").alias("regime_state"))
    days = days.withColumn("next", F.lead("date").over(Window.partitionBy(*group).orderBy("date")))
    day = Window.partitionBy(*group, "date")
    held = target_weights(recommendations).join(returns, ["date", "ticker"], "left").withColumn("_r", F.coalesce("next_day_return", F.lit(0.0)))
    held = held.withColumn("_all", F.sum(F.col("weight") * (1 + F.col("_r"))).over(day)).join(days.drop("regime_state"), [*group, "date"])
    entry = lambda date, w, p, g: F.struct(date.alias("day"), w.alias("w"), p.alias("p"), g.alias("g"))
    none, weight = F.lit(0.0), F.col("weight")
    later = F.when((F.col("_all") > 0) & F.col("next").isNotNull(), entry(F.col("next"), none, weight * (1 + F.col("_r")) / F.col("_all"), none))
    entries = F.filter(F.array(entry(F.col("date"), weight, none, weight * F.col("_r")), later), lambda x: x.isNotNull())
    each = held.select(*group, "ticker", F.explode(entries).alias("x")).select(*group, "ticker", F.col("x.day").alias("date"), "x.w", "x.p", "x.g")
    by_name = each.groupBy(*group, "date", "ticker").agg(*(F.sum(c).alias(c) for c in "wpg"))
    by_day = by_name.groupBy(*group, "date").agg(
        F.sum(F.abs(F.col("w") - F.col("p"))).alias("turnover"), F.sum("g").alias("gross_return"), F.count(F.when(F.col("w") > 0, 1)).alias("buy_count")
    )
    return days.drop("next").join(by_day, [*group, "date"], "left").fillna(0, ["turnover", "gross_return", "buy_count"])


def backtest_daily(recommendations: DataFrame, returns: DataFrame, benchmark: DataFrame, cost_bps: float = 10.0, capital: float = 1_000_000.0) -> DataFrame:
    """A row for each (horizon, day): returns, costs and the curves they make.

    returns: date, ticker, next_day_return; benchmark: date, benchmark_return, its own return to the next day.
    """
    group = _group(recommendations)
    out = turnover(recommendations, returns).join(benchmark, "date", "left")
    out = out.withColumn("cost", F.col("turnover") * cost_bps / 10_000).withColumn("net_return", F.col("gross_return") - F.col("cost"))
    so_far = Window.partitionBy(*group).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    other = F.coalesce("benchmark_return", F.lit(0.0))
    curves = {"cumulative_return": F.product(1 + F.col("net_return")).over(so_far), "benchmark_cumulative_return": F.product(1 + other).over(so_far), "relative_return": F.col("net_return") - other}
    out = out.withColumns(curves)
    return out.withColumns({"portfolio_value": capital * F.col("cumulative_return"), "drawdown": drawdown(F.col("cumulative_return"), so_far)})


def drawdown(curve: Column, so_far) -> Column:
    """Loss against the curve's own peak so far."""
    return curve / F.max(curve).over(so_far) - 1


def backtest_summary(daily: DataFrame, recommendations: DataFrame) -> DataFrame:
    """One row for each horizon: totals, turnover, risk, and how its BUY rows did."""
    group = _group(daily)
    last = lambda c: F.max_by(c, "date") - 1
    sd = F.stddev_pop("net_return")
    out = daily.groupBy(*group).agg(
        F.count("*").alias("days"), last("cumulative_return").alias("total_return"), last("benchmark_cumulative_return").alias("benchmark_total_return"),
        (F.max_by("cumulative_return", "date") - F.max_by("benchmark_cumulative_return", "date")).alias("benchmark_relative_return"),
        F.avg("turnover").alias("turnover_mean"), F.min("drawdown").alias("max_drawdown"), annualised(sd).alias("annualized_volatility"), annualised(F.when(sd > 0, F.avg("net_return") / sd)).alias("sharpe"),
    )
    buys = recommendations.where("decision = 'BUY'").groupBy(*group).agg(
        F.avg(F.col("target_class").cast("double")).alias("precision_buy"), F.avg(F.coalesce(F.col("forward_return") > F.col("daily_median_forward_return"), F.lit(False)).cast("double")).alias("hit_rate"), F.avg("forward_return").alias("average_forward_return_buy")
    )
    return out.join(buys, group, "left")


def backtest_by_regime(daily: DataFrame) -> DataFrame:
    return daily.groupBy(*_group(daily), "regime_state").agg(F.avg("net_return").alias("mean_net_return"), F.avg("turnover").alias("mean_turnover"), F.count("*").alias("days"))

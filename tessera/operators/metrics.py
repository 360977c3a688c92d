"""Ranking metrics, calibration, class balance and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.staging import staged


def ndcg(predictions: DataFrame, k: int, by: tuple[str, ...] = ("date",)) -> DataFrame:
    """NDCG at k of each group: gains 2^target_rank - 1, ties of score by ticker; NULL where the ideal is 0."""
    score = Window.partitionBy(*by).orderBy(F.col("score").desc_nulls_last(), "ticker")
    ideal = Window.partitionBy(*by).orderBy(F.col("target_rank").desc_nulls_last(), "ticker")
    out = predictions.withColumns({"_i": F.row_number().over(score), "_j": F.row_number().over(ideal), "_gain": F.pow(F.lit(2.0), "target_rank") - 1})
    at = lambda c: F.sum(F.when(F.col(c) <= k, F.col("_gain") / F.log2(F.col(c) + 1)))
    sums = out.groupBy(*by).agg(at("_i").alias("_dcg"), at("_j").alias("_best"))
    return sums.select(*by, F.when(F.col("_best") > 0, F.col("_dcg") / F.col("_best")).alias(f"ndcg_at_{k}"))


def ranking_by_date(predictions: DataFrame, buy_fraction: float = 0.10, by: tuple[str, ...] = ("date",)) -> DataFrame:
    """For each group: precision of the first ten, hit rate and mean excess return of the share that is bought."""
    w = Window.partitionBy(*by)
    out = predictions.withColumns({"_i": F.row_number().over(w.orderBy(F.col("score").desc_nulls_last(), "ticker")), "_n": F.count("*").over(w)})
    top, buy = F.col("_i") <= 10, F.col("_i") <= F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(buy_fraction)))
    hit = F.coalesce(F.col("forward_return") > F.col("daily_median_forward_return"), F.lit(False)).cast("double")
    return out.groupBy(*by).agg(
        F.avg(F.when(top, F.col("target_class").cast("double"))).alias("precision_at_10"), F.avg(F.when(buy, hit)).alias("hit_rate"), F.avg(F.when(buy, F.col("forward_excess_return"))).alias("mean_excess_return"), F.count("*").alias("rows")
    )


def ranking_metrics(predictions: DataFrame, buy_fraction: float = 0.10, group: tuple[str, ...] = ()) -> DataFrame:
    """Means over dates of all ranking metrics, for each of group."""
    by = (*group, "date")
    each = ranking_by_date(predictions, buy_fraction, by).join(ndcg(predictions, 10, by), list(by)).join(ndcg(predictions, 20, by), list(by))
    means = [F.avg(c).alias(c) for c in ("ndcg_at_10", "ndcg_at_20", "precision_at_10", "hit_rate", "mean_excess_return")]
    return each.groupBy(*group).agg(*means, F.sum("rows").alias("rows"))


def validation_summary(metrics: DataFrame) -> DataFrame:
    """Means over splits for each (horizon, model_name), and the rows they rest on."""
    names = [c for c in ("ndcg_at_10", "ndcg_at_20", "precision_at_10", "hit_rate", "mean_excess_return", "positive_rate", "noise_importance") if c in metrics.columns]
    return metrics.groupBy("horizon", "model_name").agg(*(F.avg(c).alias(c) for c in names), F.sum("rows").alias("rows"))


def calibration(predictions: DataFrame, bins: int = 10, by: tuple[str, ...] = (), pieces: int = 64) -> DataFrame:
    """Mean score and positive rate in bins of equal numbers of scores (ties in order of date and ticker).

    Ranks are exact, but no task orders all scores: scores are cut near their quantiles into `pieces`,
    ranked within them, and a piece's ranks begin after the counts of those before.
    """
    known = predictions.where("score is not null and target_class is not null").withColumn("_all", F.lit(0))
    keys = ["_all", *by]
    cuts = known.groupBy(*keys).agg(F.percentile_approx("score", F.array(*(F.lit(k / pieces) for k in range(1, pieces)))).alias("_cuts"))
    cut = known.join(cuts, keys).withColumn("_piece", F.size(F.filter("_cuts", lambda c: c < F.col("score")))).drop("_cuts")
    counts = cut.groupBy(*keys, "_piece").agg(F.count("*").alias("_here"))
    whole = Window.partitionBy(*keys)
    before = F.sum("_here").over(whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_here")
    counts = counts.withColumns({"_before": before, "_n": F.sum("_here").over(whole)}).drop("_here")
    within = F.row_number().over(Window.partitionBy(*keys, "_piece").orderBy("score", "date", "ticker"))
    ranked = cut.withColumn("_within", within).join(counts, [*keys, "_piece"]).withColumn("_r", F.col("_before") + F.col("_within"))
    q = F.least(F.lit(bins), F.col("_n"))
    place = F.when(F.col("_n") > 1, F.greatest(F.lit(1), F.ceil((F.col("_r") - 1) * q / (F.col("_n") - 1)))).otherwise(1)
    means = F.avg("score").alias("mean_score"), F.avg(F.col("target_class").cast("double")).alias("positive_rate"), F.count("*").alias("count")
    return ranked.groupBy(*by, place.cast("long").alias("score_bin")).agg(*means)


def class_imbalance(labels: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Positive rate, the population deviation of the dates' rates, and how many dates there are, for each of by."""
    by_date = labels.groupBy(*by, "date").agg(F.sum("target_class").alias("p"), F.count("target_class").alias("n"))
    rate = F.when(F.col("n") > 0, F.col("p") / F.when(F.col("n") > 0, F.col("n")))
    measures = (F.sum("p") / F.sum("n")).alias("positive_rate"), F.stddev_pop(rate).alias("positive_rate_std_by_date"), F.count("*").cast("double").alias("cross_sections")
    return by_date.groupBy(*by).agg(*measures)


def _bin(x: Column, edges: Column) -> Column:
    """Number of the right-closed bin that holds x, the lowest edge in the first; NULL outside."""
    below = F.size(F.filter(edges, lambda e: e < x))
    return F.when((x >= edges[0]) & (x <= F.element_at(edges, -1)), F.greatest(below, F.lit(1)))


def quantile_edges(values: DataFrame, probabilities: list[float], pieces: int = 64) -> DataFrame:
    """Exact quantiles of x for each feature, interpolated between neighbours: (feature, edges), a value for each probability.

    No task holds all of a feature: values are counted map-side, cut near their quantiles into `pieces`, and
    only the cumulative counts within a piece are ordered.
    """
    cuts = values.groupBy("feature").agg(F.percentile_approx("x", F.array(*(F.lit(k / pieces) for k in range(1, pieces)))).alias("cuts"))
    cut = values.join(cuts, "feature").withColumn("piece", F.size(F.filter("cuts", lambda c: c < F.col("x"))))
    counts = cut.groupBy("feature", "piece", "x").agg(F.count("*").alias("c"))
    inside = Window.partitionBy("feature", "piece").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("upto", F.sum("c").over(inside))
    sizes = counts.groupBy("feature", "piece").agg(F.sum("c").alias("here"))
    whole = Window.partitionBy("feature")
    start = F.sum("here").over(whole.orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("here")
    sizes = sizes.withColumns({"start": start, "n": F.sum("here").over(whole)})
    wanted = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("p")) for k, p in enumerate(probabilities)))).alias("w")
    at = sizes.select("feature", "piece", "start", "here", "n", wanted).select("*", ((F.col("n") - 1) * F.col("w.p")).alias("at"))
    ranks = at.select("feature", "piece", "start", "here", F.col("w.k").alias("k"), (F.col("at") - F.floor("at")).alias("part"), F.explode(F.array(F.struct(F.floor("at").alias("rank"), F.lit(0).alias("side")), F.struct(F.ceil("at").alias("rank"), F.lit(1).alias("side")))).alias("r"))
    ranks = ranks.where((F.col("r.rank") >= F.col("start")) & (F.col("r.rank") < F.col("start") + F.col("here"))).withColumn("offset", F.col("r.rank") - F.col("start"))
    found = counts.join(ranks, ["feature", "piece"]).where((F.col("offset") < F.col("upto")) & (F.col("offset") >= F.col("upto") - F.col("c")))
    pick = lambda side: F.max(F.when(F.col("r.side") == side, F.col("x")))
    points = found.groupBy("feature", "k").agg((pick(0) + (pick(1) - pick(0)) * F.max("part")).alias("edge"))
    return points.groupBy("feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "edge"))), lambda x: x["edge"]).alias("edges"))


def stability_index(counts: DataFrame, by: list[str]) -> DataFrame:
    """(*by, psi) from a row for each bin with counts a and b of two sides; a share of 0 counts as 1e-6."""
    w = Window.partitionBy(*by)
    share = lambda c: F.coalesce(F.col(c) / F.when(F.sum(c).over(w) > 0, F.sum(c).over(w)), F.lit(0.0))
    shares = counts.select(*by, *(F.when(share(c) > 0, share(c)).otherwise(1e-6).alias(c) for c in "ab"))
    return shares.groupBy(*by).agg(F.sum((F.col("b") - F.col("a")) * F.log(F.col("b") / F.col("a"))).alias("psi"))


def feature_drift(train: DataFrame, test: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """Means, their shift and the population stability index of each feature, largest index first.

    Bins are the distinct deciles of train; test values outside them are left out before shares are taken; a share of 0 counts as
    1e-6. Both sides are unpivoted and written once; means, edges and bins are read from that.
    """
    as_rows = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features))).alias("v")
    melt = lambda df, side: df.select(as_rows).select("v.*", F.lit(side).alias("side")).where("x is not null")
    values = staged(melt(train, "train").unionByName(melt(test, "val")))
    edges = quantile_edges(values.where("side = 'train'"), [k / bins for k in range(bins + 1)])
    edges = edges.select("feature", F.array_distinct(F.transform("edges", lambda e: F.round(e, 9))).alias("edges"))  # a row a feature
    mean = lambda side: F.avg(F.when(F.col("side") == side, F.col("x"))).alias(f"{side}_mean")
    means = values.groupBy("feature").agg(mean("train"), mean("val"))
    binned = values.join(edges, "feature").withColumn("bin", _bin(F.round("x", 9), F.col("edges"))).where("bin is not null")
    counts = binned.groupBy("feature", "bin").agg(F.count(F.when(F.col("side") == "train", 1)).alias("a"), F.count(F.when(F.col("side") == "val", 1)).alias("b"))
    index = stability_index(counts, ["feature"])
    out = means.join(edges.select("feature", F.size("edges").alias("_e")), "feature", "left").join(index, "feature", "left")
    known = F.col("train_mean").isNotNull() & F.col("val_mean").isNotNull()
    psi = F.when(known, F.when(F.col("_e") <= 2, 0.0).otherwise(F.col("psi")))
    out = out.select("feature", "train_mean", "val_mean", (F.col("val_mean") - F.col("train_mean")).alias("mean_shift"), psi.alias("psi"))
    return out.orderBy(F.col("psi").desc_nulls_last(), "feature")

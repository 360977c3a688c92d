"""Quantile sketches that merge: counts of values in buckets whose bounds grow by a constant factor.

A sketch is a table of rows: feature, the columns it was taken by, bucket, n and total. Sketches of days
are merged over any days by adding counts, so quantiles and stability indices of any two windows come
from the sketch, without reading the features again. Rows of a sketch number at most the buckets
that a feature's values reach, some 2,100 for each sign between 1e-9 and 1 at an accuracy of 0.005.
"""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.metrics import stability_index

ACCURACY = 0.005
SMALLEST = 1e-9  # values nearer to 0 count as 0


def _growth(accuracy: float) -> float:
    return math.log((1 + accuracy) / (1 - accuracy))


def bucket(x: Column, accuracy: float = ACCURACY) -> Column:
    """The bucket of a number: buckets are in the order of values, 0 holds those about 0."""
    steps = F.ceil(F.log(F.abs(x) / SMALLEST) / _growth(accuracy)).cast("int")
    return F.when(F.abs(x) <= SMALLEST, 0).when(x > 0, steps).otherwise(-steps)


def value(bucket: Column, accuracy: float = ACCURACY) -> Column:
    """A number within `accuracy` (relative) of all that are in the bucket."""
    upper = SMALLEST * F.exp(F.abs(bucket) * _growth(accuracy))
    return F.when(bucket == 0, 0.0).otherwise(F.signum(bucket.cast("double")) * upper * (1 - accuracy))


def unpivoted(df: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """A row (*by, feature, x) for each known value of each feature."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features))).alias("v")
    return df.select(*by, pairs).select(*by, "v.*").where("x is not null")


def sketch(values: DataFrame, by: list[str], accuracy: float = ACCURACY) -> DataFrame:
    """Counts and sums of x for each feature, `by` and bucket; NULL, NaN and infinite values are left out."""
    finite = values.where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))
    return finite.groupBy("feature", *by, bucket(F.col("x"), accuracy).alias("bucket")).agg(F.count("*").alias("n"), F.sum("x").alias("total"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches added up over the columns that `by` leaves out."""
    return sketches.groupBy("feature", *by, "bucket").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def _bucket_at(share: float, counts: str, upto: str, over) -> Column:
    """The bucket that holds the value with floor(share (n - 1)) values below it; the window has the sketch's buckets."""
    rank = F.floor(share * (F.sum(counts).over(over) - 1))
    return F.min(F.when(F.col(upto) > rank, F.col("bucket"))).over(over)


def _upto(counts: str, keys: list[str]) -> Column:
    return F.sum(counts).over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))


def sketch_quantiles(sketches: DataFrame, by: list[str], shares: list[float], accuracy: float = ACCURACY) -> DataFrame:
    """(feature, *by, quantiles): for each share a number within `accuracy` of the value at rank floor(share (n - 1))."""
    keys = ["feature", *by]
    counts = merged(sketches, by).withColumn("_upto", _upto("n", keys))
    whole = Window.partitionBy(*keys)
    found = counts.select(*keys, F.array(*(_bucket_at(p, "n", "_upto", whole) for p in shares)).alias("_at"))
    return found.groupBy(*keys).agg(F.first("_at").alias("_at")).select(*keys, F.transform("_at", lambda b: value(b, accuracy)).alias("quantiles"))


def windowed_psi(sketches: DataFrame, windows: list[tuple[str, date, date, date, date]], bins: int = 10) -> DataFrame:
    """Means and the population stability index of each feature between two windows of time, for each of `windows`.

    sketches: by `date`. windows: name, first and last day of the reference, first and last day of what is held against
    it; they may overlap. Bins are those of feature_drift, with edges rounded to buckets: an edge is within the sketch's
    accuracy of the reference's quantile, and values that share an edge's bucket fall on its left. Where a side has no values
    the index is NULL; a feature of at most two distinct edges gives 0. Only the sketch is read, once for all windows.
    """
    spans = F.array(*(F.struct(F.lit(n).alias("window"), *(F.lit(d).cast("date").alias(c) for c, d in zip("abcd", days))) for n, *days in windows))
    day = F.col("date")
    within = F.filter(spans, lambda w: day.between(w["a"], w["b"]) | day.between(w["c"], w["d"]))
    rows = sketches.select("feature", "bucket", "n", "total", "date", F.explode(within).alias("w"))
    keys, own, other = ["window", "feature"], day.between(F.col("w.a"), F.col("w.b")), day.between(F.col("w.c"), F.col("w.d"))
    side = lambda when, c, name: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).alias(name)
    counts = rows.groupBy("w.window", "feature", "bucket").agg(side(own, "n", "a"), side(other, "n", "b"), side(own, "total", "ta"), side(other, "total", "tb"))
    whole = Window.partitionBy(*keys)
    counts = counts.withColumn("_upto", _upto("a", keys))
    edges = F.array_distinct(F.array(*(_bucket_at(k / bins, "a", "_upto", whole) for k in range(bins + 1))))
    counts = counts.withColumn("_edges", F.when(F.sum("a").over(whole) > 0, edges))
    there = F.col("bucket").between(F.col("_edges")[0], F.element_at("_edges", -1))
    place = F.when(there, F.greatest(F.size(F.filter("_edges", lambda e: e < F.col("bucket"))), F.lit(1)))
    binned = counts.groupBy(*keys, place.alias("bin")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("ta").alias("ta"), F.sum("tb").alias("tb"), F.max(F.size("_edges")).alias("_e"))
    sums = binned.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("a", "b", "ta", "tb")), F.max("_e").alias("_e"))
    index = stability_index(binned.where("bin is not null"), keys)
    out = sums.join(index, keys, "left")
    mean = lambda t, n: F.col(t) / F.when(F.col(n) > 0, F.col(n))
    psi = F.when((F.col("a") > 0) & (F.col("b") > 0), F.when(F.col("_e") <= 2, 0.0).otherwise(F.col("psi")))
    return out.select(*keys, F.col("a").alias("reference_rows"), F.col("b").alias("window_rows"), mean("ta", "a").alias("reference_mean"), mean("tb", "b").alias("window_mean"), psi.alias("psi"))

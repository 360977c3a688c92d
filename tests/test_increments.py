"""Increments against full rebuilds, and indices from sketches against exact ones."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators.features import security_features
from tessera.operators.increments import LOOK_BACK, quality_since, quality_tail, security_since, security_tail
from tessera.operators.metrics import feature_drift
from tessera.operators.quality import bounded_fill, with_quality
from tessera.operators.sketches import ACCURACY, bucket, merged, sketch, sketch_quantiles, unpivoted, value, windowed_psi

DAY = dt.date(2020, 1, 1)


def prices(rng, ticker, days):
    """Rows of a ticker on the given days, a tenth of the prices unknown."""
    px = np.round(50 * np.exp(np.cumsum(rng.normal(0, 0.02, len(days)))), 2)
    gone = rng.random(len(days)) < 0.1
    rows = []
    for d, p, g in zip(days, px, gone):
        own = (None,) * 5 if g else (p, p * 1.02, p * 0.97, p * 1.01, p)
        rows.append((ticker, DAY + dt.timedelta(int(d)), *map(lambda x: None if x is None else float(x), own), None if g else float(rng.integers(100, 900))))
    return rows


def panel(spark):
    rng = np.random.default_rng(1)
    days = np.arange(700)
    rows = prices(rng, "stays", days) + prices(rng, "returns", np.r_[0:320, 600:700]) + prices(rng, "late", np.arange(640, 700)) + prices(rng, "gone", np.arange(0, 300))
    df = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, adj_close double, volume double")
    market = {f"spx_ret_{k}d": F.sin(F.datediff("date", F.lit(DAY)) / k) / 100 for k in (1, 5, 21, 63)}
    return df.withColumns(market).repartition(4)


def same(got, want):
    got, want = (x.toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)[sorted(want.columns)] for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-6, atol=1e-9)
    return len(got)


@pytest.mark.parametrize("pad", [True, False])
def test_security_increments_equal_a_rebuild(spark, tmp_path, pad):
    """Three increments, the last of which holds a ticker that came back and one that is new."""
    rows, cuts = panel(spark), [500, 560, 630, 700]
    whole = security_features(rows, pad)
    at = lambda k: F.lit(DAY + dt.timedelta(k))
    security_tail(rows.where(F.col("date") < at(cuts[0]))).write.parquet(f"{tmp_path}/0")
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        tail, fresh = spark.read.parquet(f"{tmp_path}/{k}"), rows.where((F.col("date") >= at(a)) & (F.col("date") < at(b)))
        assert same(security_since(tail, fresh, pad), whole.where((F.col("date") >= at(a)) & (F.col("date") < at(b)))) > 0
        security_tail(fresh, tail).write.parquet(f"{tmp_path}/{k + 1}")
        assert tail.groupBy("ticker").count().agg(F.max("count")).first()[0] <= LOOK_BACK
    assert same(security_since(tail.limit(0), rows, pad), whole) == rows.count()
    assert security_since(tail, rows.limit(0), pad).count() == 0


def test_quality_increments_equal_a_rebuild(spark, tmp_path):
    rng = np.random.default_rng(2)
    days = np.arange(400)
    rows = []
    for ticker, seen in (("often", 0.9), ("seldom", 0.05), ("never", 0.0), ("late", 0.9)):
        for row in prices(rng, ticker, days):
            known = rng.random() < seen and not (ticker == "late" and row[1] < DAY + dt.timedelta(330)) and row[6] is not None
            rows.append((*(row if known else row[:2] + (None,) * 6), "a" if known else None))
    grid = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, adj_close double, volume double, source string")
    grid = grid.withColumn("was_observed", F.col("adj_close").isNotNull())
    whole = bounded_fill(with_quality(grid))
    at = lambda k: F.lit(DAY + dt.timedelta(k))
    cuts = [100, 103, 340, 400]
    quality_tail(grid.where(F.col("date") < at(cuts[0]))).write.parquet(f"{tmp_path}/0")
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        tail, within = spark.read.parquet(f"{tmp_path}/{k}"), (F.col("date") >= at(a)) & (F.col("date") < at(b))
        assert same(quality_since(tail, grid.where(within)), whole.where(within)) == 4 * (b - a)
        quality_tail(grid.where(within), tail=tail).write.parquet(f"{tmp_path}/{k + 1}")
    assert quality_since(tail, grid.limit(0)).count() == 0


# --- sketches


def values(spark):
    rng = np.random.default_rng(3)
    rows = []
    for d in range(60):
        for _ in range(50):
            drift = d / 30
            rows.append((DAY + dt.timedelta(d), float(rng.normal(drift, 1)), float(np.exp(rng.normal(0, 3))), float(rng.integers(0, 2)), 7.0, None if d >= 30 else 1.5 * rng.random()))
    return spark.createDataFrame(rows, "date date, moves double, wide double, flag double, constant double, ends double")


FEATURES = ["moves", "wide", "flag", "constant", "ends"]


def test_buckets_are_ordered_and_near(spark):
    x = [-1e12, -3.5, -1.0, -1e-3, -1e-10, 0.0, 1e-10, 2e-9, 1e-3, 1.0, 1.00001, 3.5, 1e12]
    got = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "k int, x double").select("x", bucket(F.col("x")).alias("b")).select("*", value(F.col("b")).alias("v")).orderBy("x").collect()
    assert [r.b for r in got] == sorted(r.b for r in got) and {r.b for r in got if abs(r.x) <= 1e-9} == {0}
    assert all(abs(r.v - r.x) <= ACCURACY * abs(r.x) * (1 + 1e-9) for r in got if r.b)


def test_merged_sketch_equals_sketch_of_all(spark):
    long = unpivoted(values(spark), FEATURES, ["date"])
    days = sketch(long, ["date"])
    key = lambda df: sorted((r.feature, r.bucket, r.n, round(r.total, 6)) for r in df.collect())
    assert key(merged(days, [])) == key(sketch(long.drop("date"), []))
    shares = [0.0, 0.1, 0.5, 0.93, 1.0]
    frame = values(spark).toPandas()
    for r in sketch_quantiles(days, [], shares).collect():
        x = np.sort(frame[r.feature].dropna())
        want = [x[int(np.floor(p * (len(x) - 1)))] for p in shares]
        assert np.allclose(r.quantiles, want, rtol=ACCURACY * 1.001, atol=1e-9)


def test_index_of_windows_is_near_the_exact_one(spark):
    df = values(spark)
    at = lambda k: DAY + dt.timedelta(k)
    windows = [("halves", at(0), at(29), at(30), at(59)), ("overlap", at(0), at(39), at(20), at(59)), ("weeks", at(7), at(13), at(50), at(56)), ("none", at(0), at(9), at(90), at(99))]
    got = {(r.window, r.feature): r for r in windowed_psi(sketch(unpivoted(df, FEATURES, ["date"]), ["date"]), windows).collect()}
    assert set(got) == {(w[0], f) for w in windows for f in FEATURES}
    for name, a, b, c, d in windows[:3]:
        for r in feature_drift(df.where(F.col("date").between(a, b)), df.where(F.col("date").between(c, d)), FEATURES).collect():
            mine = got[name, r.feature]
            assert np.allclose([mine.reference_mean], [r.train_mean]) and (r.psi is None) == (mine.psi is None)
            if r.psi is not None:
                assert abs(mine.psi - r.psi) < 0.01 + 0.1 * r.psi, (name, r.feature, mine.psi, r.psi)
    assert got["halves", "moves"].psi > 0.5 and got["halves", "constant"].psi == got["halves", "flag"].psi == 0
    assert all(got["none", f].psi is None and got["none", f].window_rows == 0 for f in FEATURES) and got["halves", "ends"].psi is None


def test_sketch_of_odd_rows(spark):
    odd = spark.createDataFrame([(DAY, "f", x) for x in (None, float("nan"), float("inf"), -float("inf"), 1.0, 1.0)], "date date, feature string, x double")
    assert [(r.n, r.total) for r in sketch(odd, ["date"]).collect()] == [(2, 2.0)]
    assert windowed_psi(sketch(odd.limit(0), ["date"]), [("w", DAY, DAY, DAY, DAY)]).count() == 0

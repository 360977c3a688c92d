"""Running values and as-of joins in blocks, against numpy and loops."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.scan import block_cuts, running
from tessera.operators.asof import asof_join_sliced

DAY = dt.date(2020, 1, 1)


def unpartitioned(df):
    """Windows that put all rows of what they order in one task."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "SinglePartition" in line]


@pytest.mark.parametrize("blocks", [1, 4, 64])
def test_running_values_equal_numpy(spark, blocks):
    rng = np.random.default_rng(blocks)
    rows = [(g, DAY + dt.timedelta(int(d)), k, None if rng.random() < 0.2 else float(np.round(rng.uniform(0.9, 1.1), 3))) for k, (g, d) in enumerate(zip(rng.choice(["a", "a", "b", None], 600), rng.integers(0, 200, 600)))]
    df = spark.createDataFrame(rows, "g string, date date, k long, x double").repartition(5)
    kinds = ("sum", "count", "product", "max", "min", "last")
    got = running(df, ["g"], "date", {n: (n, F.col("x")) for n in kinds}, ("k",), blocks).toPandas()
    for g in ("a", "b", None):
        own = got[got.g.isna() if g is None else got.g == g].sort_values(["date", "k"])
        x = own.x.astype(float)
        want = {"sum": x.cumsum().ffill(), "count": x.notna().cumsum(), "product": x.cumprod().ffill(), "max": x.cummax().ffill(), "min": x.cummin().ffill(), "last": x.ffill()}
        for n in kinds:
            assert np.allclose(own[n].astype(float), want[n].astype(float), equal_nan=True), n


def test_one_series_is_spread_over_tasks(spark):
    df = spark.range(0, 2000, numPartitions=4).select(F.when(F.col("id") >= 0, "^GSPC").alias("symbol"), F.col("id").alias("at"), F.sin("id").alias("x"))
    out = running(df, ["symbol"], "at", {"total": ("sum", F.col("x"))}, blocks=16)
    assert not unpartitioned(out) and len(block_cuts(df, "at", 16)) == 15
    values = np.array([r.total for r in out.orderBy("at").collect()])
    assert np.allclose(values, np.cumsum(np.sin(np.arange(2000))))
    sizes = [r["count"] for r in out.select(F.size(F.filter(F.array(*map(F.lit, block_cuts(df, "at", 16))), lambda c: c < F.col("at"))).alias("b")).groupBy("b").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * min(sizes)
    assert running(df.limit(0), ["symbol"], "at", {"total": ("sum", F.col("x"))}).count() == 0
    assert [r.total for r in running(df.limit(3), [], "at", {"total": ("count", F.col("x"))}).orderBy("at").collect()] == [1, 2, 3]


@pytest.mark.parametrize("backward", [True, False])
@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("slices", [1, 7, 40])
def test_sliced_asof_equals_a_loop(spark, backward, inclusive, slices):
    rng = random.Random(slices)
    time = lambda k: None if k is None else DAY + dt.timedelta(k)
    left = [(k, rng.choice(["hot"] * 9 + ["b", None]), rng.choice([*range(300), None])) for k in range(400)]
    right = [(rng.choice(["hot"] * 9 + ["b"]), rng.choice([*range(0, 300, 9), None]), rng.choice([1, 2, None]), k) for k in range(60)]
    ldf = spark.createDataFrame([(k, t, time(d)) for k, t, d in left], "k int, ticker string, date date").repartition(3)
    rdf = spark.createDataFrame([(t, time(d), tie, v) for t, d, tie, v in right], "ticker string, event date, tie int, v int")
    # ties by (tie, v) are unique
    got = {r.k: (r.v, r.event) for r in asof_join_sliced(ldf, rdf, "ticker", "date", "event", {"v": F.col("v"), "event": F.col("event")}, backward, inclusive, F.struct("tie", "v"), slices).collect()}
    assert len(got) == len(left)
    for k, t, d in left:
        fits = [(e, (tie is not None, tie or 0, v), v) for t2, e, tie, v in right if t is not None and t == t2 and d is not None and e is not None and ((e < d if backward else e > d) or inclusive and e == d)]
        best = max(fits, key=lambda x: (x[0] if backward else -x[0], x[1])) if fits else None
        assert got[k] == ((best[2], time(best[0])) if best else (None, None)), (k, t, d)


def test_a_hot_key_is_spread(spark):
    left = spark.range(0, 5000, numPartitions=4).select(F.when(F.col("id") >= 0, "hot").alias("ticker"), F.timestamp_seconds(F.col("id") * 60).alias("at"), "id")
    right = left.where("id % 700 = 3").select("ticker", F.col("at").alias("seen"), F.col("id").alias("v"))
    out = asof_join_sliced(left, right, "ticker", "at", "seen", {"v": F.col("v")}, slices=16)
    want = [None if k < 3 else (k - 3) // 700 * 700 + 3 for k in range(5000)]
    assert [r.v for r in out.orderBy("id").collect()] == want and not unpartitioned(out)
    assert asof_join_sliced(left, right.limit(0), "ticker", "at", "seen", {"v": F.col("v")}).where("v is not null").count() == 0

"""LambdaRank trees against double loops and searches in numpy."""

import datetime as dt
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import staging
from tessera.config import settings
from tessera.operators import metrics as mt
from tessera.plans import models as md
from tessera.plans import rank_trees as rt


def gradient_loop(groups, top):
    """Every pair of every group in turn. groups: lists of (ticker, grade, score)."""
    out = {}
    for g, rows in groups.items():
        worth = [2 ** (grade / 100) - 1 for _, grade, _ in rows]
        order = sorted(range(len(rows)), key=lambda i: (-rows[i][2], rows[i][0]))
        place = {i: p for p, i in enumerate(order, 1)}
        discount = [1 / math.log2(place[i] + 1) if place[i] <= top else 0.0 for i in range(len(rows))]
        ideal = sum(w / math.log2(p + 1) for p, w in enumerate(sorted(worth, reverse=True)[:top], 1))
        pull, second = [0.0] * len(rows), [0.0] * len(rows)
        for i in range(len(rows)):
            for j in range(len(rows)):
                if rows[i][1] > rows[j][1] and min(place[i], place[j]) <= top:
                    change = (worth[i] - worth[j]) * abs(discount[i] - discount[j]) / ideal
                    p = 1 / (1 + math.exp(rows[i][2] - rows[j][2]))
                    pull[i] += change * p
                    pull[j] -= change * p
                    second[i] += change * p * (1 - p)
                    second[j] += change * p * (1 - p)
        out |= {(g, rows[i][0]): (pull[i], second[i]) for i in range(len(rows))}
    return out


@pytest.mark.parametrize("top, parts", [(3, 1), (3, 7), (30, 4)])
def test_lambdas_equal_a_double_loop(spark, top, parts):
    rng = np.random.default_rng(1)
    groups = {g: [(f"T{k:03}", int(rng.integers(0, 101)), float(np.round(rng.normal(), 1))) for k in range(n)] for g, n in enumerate([1, 2, 3, 25, 60])}
    groups[9] = [(f"T{k}", 0, 1.0) for k in range(5)]  # nothing to rank
    rows = spark.createDataFrame([(g, *r) for g, rows in groups.items() for r in rows], "date int, ticker string, grade int, score double").withColumn("id", F.monotonically_increasing_id())
    rows = rt.with_ideal(rows, ["date"], top).repartition(parts)
    got = {(r.date, r.ticker): (r.g, r.h) for r in rt.lambdas(rows, ["date"], top).collect()}
    want = gradient_loop(groups, top)
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)


def best_split(x, g, h, rows, features, bins, least):
    """(gain, feature, cut, missing_left) of a node by trying all of them."""
    worth = lambda at: g[at].sum() ** 2 / h[at].sum() if len(at) else 0.0
    best = None
    for f in features:
        for cut in range(1, bins + 1):
            for missing_left in (False, True):
                to_left = np.where(x[rows, f] == 0, missing_left, x[rows, f] <= cut)
                left, right = rows[to_left], rows[~to_left]
                if min(len(left), len(right)) < least or min(h[left].sum(), h[right].sum()) < rt.LEAST_HESSIAN:
                    continue
                gain = worth(left) + worth(right) - worth(rows)
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, cut, missing_left, left, right)
    return best


@pytest.mark.parametrize("leaves, depth", [(8, 0), (31, 3), (4, 6)])
def test_growth_equals_splitting_one_by_one(spark, leaves, depth):
    rng = np.random.default_rng(leaves)
    n, width, bins, least = 1000, 4, 9, 20
    x = rng.integers(0, bins + 1, (n, width)).astype(np.uint8)
    g, h = rng.normal(size=n) + (x[:, 1] > 4) - 2.0 * (x[:, 2] == 0), rng.uniform(0.1, 1, n)
    rows = spark.createDataFrame([(bytes(x[i].tolist()), float(g[i]), float(h[i])) for i in range(n)], rt.GRADIENTS).repartition(5)
    tree = rt.grow(rows, [0, 1, 2], width, bins + 1, leaves, depth, least)
    ends = {0: (np.arange(n), 0)}
    while len(ends) < leaves:
        found = [(best_split(x, g, h, at, [0, 1, 2], bins, least), k) for k, (at, d) in ends.items() if depth <= 0 or d < depth]
        found = [f for f in found if f[0]]
        if not found:
            break
        (_, f, cut, missing_left, left, right), k = max(found, key=lambda f: f[0][0])
        d = ends.pop(k)[1]
        ends |= {max(ends, default=0) + 1000 + k * 7: (left, d + 1), max(ends, default=0) + 2000 + k * 7: (right, d + 1)}
    leaf, want = tree.leaf(x), np.zeros(n)
    for at, _ in ends.values():
        want[at] = g[at].sum() / h[at].sum()
    assert len(set(leaf)) == len(ends) and np.allclose(np.array(tree.value)[leaf], want)


def planted(spark, dates=40, size=40, gaps=True, seed=4):
    """Dates whose ranks follow from a product of two columns that differ in level from date to date; the third is noise."""
    rng, rows = np.random.default_rng(seed), []
    for d in range(dates):
        a, b, c = rng.normal(size=(3, size))
        worth = a * np.where(b > 0, 1.0, -1.0) + 0.1 * rng.normal(size=size)
        rank = worth.argsort().argsort() / (size - 1)
        holes = rng.random(size) < 0.1 * gaps
        rows += [(dt.date(2020, 1, 1) + dt.timedelta(d), f"T{k:02}", None if holes[k] else float(a[k]), float(b[k]), float("nan") if k == 3 else float(c[k]), float(rank[k])) for k in range(size)]
    return spark.createDataFrame(rows, "date date, ticker string, a double, b double, c double, target_rank double")


def reached(model, frame):
    return mt.ndcg(md.score(model, frame, ["a", "b", "c"]), 10).agg(F.avg("ndcg_at_10")).first()[0]


def test_ranks_unseen_dates(spark):
    """An order that follows from two columns together: no column alone, nor noise, comes near."""
    train, later = planted(spark), planted(spark, seed=5)
    cfg = settings(**{"model.ranker.min_child_samples": 5, "model.ranker.max_depth": 3, "model.ranker.learning_rate": 0.5, "model.ranker.num_leaves": 8, "model.ranker.feature_fraction": 1.0}).model.ranker
    alone = [mt.ndcg(later.withColumn("score", F.col(c)), 10).agg(F.avg("ndcg_at_10")).first()[0] for c in ("a", "b", "c")]
    assert reached(md.ranker(train, ["a", "b", "c"], cfg, trees=8), later) > 0.9 > max(alone) + 0.1


def test_saved_alike_draws_and_importances(spark, tmp_path):
    train = planted(spark, 12, 20)
    cfg = settings(**{"model.ranker.min_child_samples": 5, "model.ranker.bagging_freq": 2}).model.ranker
    model = md.ranker(train, ["a", "b", "c"], cfg, trees=3)
    again = md.ranker(train.repartition(5), ["a", "b", "c"], cfg, trees=3)
    assert [(t.feature, t.cut) for t in model.trees] == [(t.feature, t.cut) for t in again.trees]
    md.save_model(model, f"{tmp_path}/m")
    loaded = md.load_model(f"{tmp_path}/m")
    assert [vars(t) for t in loaded.trees] == [vars(t) for t in model.trees] and loaded.edges == model.edges
    ranked = md.importances(model, ["a", "b", "c"])
    assert [v for _, v in ranked] == sorted((v for _, v in ranked), reverse=True) and np.isclose(sum(v for _, v in ranked), 1)


def test_stops_early(spark):
    train, other = planted(spark, 12, 20, gaps=False), planted(spark, 12, 20, gaps=False, seed=9)
    noise = other.withColumn("target_rank", F.rand(3))  # nothing to learn here
    model = rt.fit(train, ["a", "b", "c"], 12, least_rows=5, validation=noise, patience=2, cut=2)
    assert 1 <= len(model.trees) < 12


def test_no_table_stays(spark):
    base = f"{staging.staging_dir(spark)}/staged".removeprefix("file:")
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    rt.fit(planted(spark, 4, 12), ["a", "b", "c"], 3, least_rows=3, cut=2)
    assert set(os.listdir(base)) == before
    with pytest.raises(ValueError):
        with staging.scratch(spark):
            staging.staged(spark.range(3))
            raise ValueError
    assert set(os.listdir(base)) == before


def test_constant_columns_and_one_row_groups(spark):
    rows = planted(spark, 1, 3).withColumn("a", F.lit(None).cast("double")).withColumn("b", F.lit(1.0))
    model = rt.fit(rows, ["a", "b"], 2, least_rows=1)
    assert {r.prediction for r in model.transform(rows).collect()} == {0.0}

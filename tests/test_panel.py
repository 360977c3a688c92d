"""Panel operators on small tables, against pandas or hand-made results."""

import datetime as dt
import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions.panel import share_rank, zscore
from tessera.operators import backtest as bt
from tessera.operators import features as ft
from tessera.operators import filters as fl
from tessera.operators import labels as lb
from tessera.operators import metrics as mt
from tessera.operators import recommend as rc
from tessera.operators import universe as un
from tessera.operators.asof import asof_join, event_in_window
from tessera.operators.quality import bounded_fill, calendar_reindex, quality_flags
from tessera.sources import landing as ld
from tessera.sources import tables as src

D = dt.date


def days(n, start=D(2018, 1, 1)):
    return [x.date() for x in pd.bdate_range(start, periods=n)]


def prices(spark, rows):
    """rows: date, ticker, price or None."""
    full = [(d, t, *[p] * 5, 100.0 if p is not None else None, "s") for d, t, p in rows]
    return spark.createDataFrame(full, "date date, ticker string, open double, high double, low double, close double, adj_close double, volume double, source string")


def test_quality_gaps(spark):
    d = days(8)
    grid = calendar_reindex(prices(spark, [(d[k], "A", 10.0 + k) for k in (0, 1, 2, 6)] + [(D(2018, 1, 6), "A", 99.0)]), spark.createDataFrame([(x,) for x in d], "date date"))
    rows = quality_flags(grid).orderBy("date").collect()
    assert len(rows) == 8 and rows[-1].insufficient_price_history and rows[-1].max_missing_gap_21d == 3 and not rows[-1].missing_gap_fail
    assert [r.history_days for r in rows] == [1, 2, 3, 3, 3, 3, 4, 4] and [r.missing_streak for r in rows] == [0, 0, 0, 1, 2, 3, 0, 1]
    assert [r.listing_age_days for r in rows] == [(x - d[0]).days + 1 for x in d]
    compat = quality_flags(grid, compat=True).orderBy("date").collect()
    assert [r.listing_age_days for r in compat] == [1, 1, 1, (d[3] - d[6]).days + 1, (d[4] - d[6]).days + 1, (d[5] - d[6]).days + 1, 1, 0]
    filled = [r.adj_close for r in bounded_fill(grid, 2).orderBy("date").collect()]
    assert filled == [10.0, 11.0, 12.0, 12.0, 12.0, None, 16.0, 16.0]


def test_never_seen_is_infinitely_stale(spark):
    d = days(3)
    grid = calendar_reindex(prices(spark, [(d[2], "A", 1.0)]), spark.createDataFrame([(x,) for x in d], "date date"))
    assert [r.stale_price_days for r in quality_flags(grid).orderBy("date").collect()] == [math.inf, math.inf, 0.0]


def market(spark, d):
    return spark.createDataFrame([(x, *[0.0] * 4) for x in d], "date date, spx_ret_1d double, spx_ret_5d double, spx_ret_21d double, spx_ret_63d double")


def test_return_sees_only_the_past(spark):
    d = days(10)
    p = prices(spark, [(x, "A", 100.0 + k) for k, x in enumerate(d)]).join(market(spark, d), "date")
    got = ft.security_features(p).orderBy("date").collect()
    assert abs(got[5].ret_5d - (105 / 100 - 1)) < 1e-12 and got[4].ret_5d is None


def test_windows_match_pandas(spark):
    rng = np.random.default_rng(3)
    d, rows = days(330), []
    for t in "AB":
        px = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, len(d))))
        rows += [(x, t, float(px[k] * 1.0), float(px[k] * 1.01), float(px[k] * 0.98), float(px[k]), float(px[k]), float(1e6 + rng.integers(0, 1e5)), "s") for k, x in enumerate(d)]
    rows = [r if rng.random() > 0.02 else (*r[:2], None, None, None, None, None, r[7], r[8]) for r in rows]
    m = pd.DataFrame({"date": d, **{f"spx_ret_{k}d": rng.normal(0, 0.01, len(d)) for k in (1, 5, 21, 63)}})
    cols = "date date, ticker string, open double, high double, low double, close double, adj_close double, volume double, source string"
    sdf = spark.createDataFrame(rows, cols).join(spark.createDataFrame([tuple(x) for x in m.itertuples(index=False)], "date date, spx_ret_1d double, spx_ret_5d double, spx_ret_21d double, spx_ret_63d double"), "date")
    got = ft.security_features(sdf).toPandas().sort_values(["ticker", "date"]).set_index(["ticker", "date"])
    for t, own in pd.DataFrame([r[:8] for r in rows], columns=["date", "ticker", "open", "high", "low", "close", "px", "volume"]).groupby("ticker"):
        own = own.sort_values("date").astype({c: float for c in ("high", "low", "close", "px", "volume")}).merge(m, on="date")
        r1, r5 = (own.px.ffill().pct_change(k, fill_method=None) for k in (1, 5))
        spread = pd.concat([own.high - own.low, (own.high - own.px.shift()).abs(), (own.low - own.px.shift()).abs()], axis=1).max(axis=1)
        gain, loss = own.px.diff().clip(lower=0).rolling(14).mean(), (-own.px.diff()).clip(lower=0).rolling(14).mean()
        want = {
            "ret_1d": r1, "ret_5d": r5, "dist_sma_20": own.px / own.px.rolling(20).mean() - 1, "realized_vol_21d": r1.rolling(21).std() * math.sqrt(252), "ret_5d_z_63d": (r5 - r5.rolling(63).mean()) / r5.rolling(63).std(),
            "atr_14_close": spread.rolling(14).mean() / own.close, "rsi_14": 100 - 100 / (1 + gain / loss), "volume_ratio_5_63": own.volume.rolling(5).mean() / own.volume.rolling(63).mean(),
            "volume_trend_21d": np.log1p(own.volume).rolling(21).apply(lambda y: np.polyfit(np.arange(21), y, 1)[0], raw=True), "beta_63d": r1.rolling(63).cov(own.spx_ret_1d) / own.spx_ret_1d.rolling(63).var(),
        }
        for name, series in want.items():
            assert np.allclose(got.loc[t][name].astype(float).to_numpy(), series.to_numpy(), rtol=1e-8, atol=1e-10, equal_nan=True), name


def test_rsi_extremes(spark):
    d = days(16)
    rows = [(x, "UP", 100.0 + k) for k, x in enumerate(d)] + [(x, "FLAT", 5.0) for x in d]
    got = {r.ticker: r.rsi_14 for r in ft.security_features(prices(spark, rows).join(market(spark, d), "date")).where(F.col("date") == d[-1]).collect()}
    assert got == {"UP": 100.0, "FLAT": None}


def test_asof_against_brute_force(spark):
    rng = random.Random(4)
    left = [(k, rng.choice("AB"), D(2020, 1, 1) + dt.timedelta(rng.randint(0, 40))) for k in range(60)]
    right = [(rng.choice("ABC"), D(2020, 1, 1) + dt.timedelta(rng.randint(0, 40)), k) for k in range(40)] + [("A", None, 99)]
    l = spark.createDataFrame(left, "id long, ticker string, date date")  # noqa: E741
    r = spark.createDataFrame(right, "ticker string, at date, v long")
    for backward in (True, False):
        for inclusive in (True, False):
            got = {x.id: x.v for x in asof_join(l, r, "ticker", "date", "at", {"v": F.col("v")}, backward, inclusive, F.col("v")).collect()}
            for k, t, d in left:
                fits = [(a, v) for u, a, v in right if u == t and a and ((a < d if backward else a > d) or inclusive and a == d)]
                best = (max if backward else min)((a for a, _ in fits), default=None)
                assert got[k] == max((v for a, v in fits if a == best), default=None)


def test_filing_date_not_period_end(spark):
    f = [("A", D(2018, 2, 15), D(2017, 12, 31)), ("A", D(2018, 6, 15), D(2018, 3, 31))]
    names = ["revenue", "net_income", "total_assets", "total_liabilities", "stockholders_equity", "cash_and_equivalents", "common_shares_outstanding", "operating_income", "depreciation_amortization"]
    filings = spark.createDataFrame([(*x, "10-Q", *[1.0] * 9) for x in f], "ticker string, filed_at date, period_end date, form string, " + ", ".join(f"{n} double" for n in names))
    p = prices(spark, [(x, "A", 10.0) for x in (D(2018, 2, 1), D(2018, 3, 1), D(2018, 3, 20), D(2018, 6, 20))])
    got = ft.fundamental_features(p, filings).orderBy("date").collect()
    assert [r.filed_at for r in got] == [None, D(2018, 2, 15), D(2018, 2, 15), D(2018, 6, 15)]
    assert [r.fundamentals_fresh for r in got] == [False, True, True, True] and got[1].pb_ratio == 10.0 and got[1].pe_ttm is None


def test_ttm_and_annual_override(spark):
    forms = ["10-Q", "10-Q", "10-Q", "10-Q", "10-K", "10-Q/A"]
    rows = [("A", D(2018, 1, 1) + dt.timedelta(90 * k), D(2018, 1, 1), f, 1.0 + k, 2.0, 3.0, 4.0, 10.0 * (k + 1)) for k, f in enumerate(forms)]
    df = spark.createDataFrame(rows, "ticker string, filed_at date, period_end date, form string, revenue double, net_income double, operating_income double, depreciation_amortization double, total_assets double")
    df = df.withColumns({c: F.lit(1.0) for c in ("total_liabilities", "stockholders_equity", "cash_and_equivalents", "common_shares_outstanding")})
    got = ft.trailing_fundamentals(df).orderBy("filed_at").collect()
    assert [r.revenue_ttm for r in got] == [None, None, None, 10.0, 5.0, None]
    assert [r.depreciation_ttm for r in got] == [4.0, 8.0, 12.0, 16.0, 12.0, 12.0] and [r.assets_growth_yoy for r in got][4:] == [4.0, 2.0] and got[5].revenue_growth_yoy == 2.0


def test_events_in_window(spark):
    panel = spark.createDataFrame([("A", D(2020, 1, 1), D(2020, 1, 5)), ("A", D(2020, 1, 3), D(2020, 1, 4)), ("A", D(2020, 1, 1), None), ("A", D(2020, 1, 9), None), ("B", D(2020, 1, 1), None)], "ticker string, date date, label_end_date date")
    events = spark.createDataFrame([("A", D(2020, 1, 1)), ("A", D(2020, 1, 5)), ("A", D(2020, 1, 5))], "ticker string, earnings_date date")
    got = {(r.ticker, r.date, r.label_end_date): r.earnings_in_window for r in event_in_window(panel, events).collect()}
    assert list(got.values()).count(True) == 2 and got["A", D(2020, 1, 1), D(2020, 1, 5)] and got["A", D(2020, 1, 1), None]


def test_purge(spark):
    rows = [(D(2020, 1, 1), D(2020, 1, 9)), (D(2020, 1, 2), D(2020, 1, 10)), (D(2020, 1, 3), D(2020, 1, 11)), (D(2020, 1, 10), D(2020, 1, 20)), (D(2020, 1, 1), None)]
    train, val = fl.purged_split(spark.createDataFrame(rows, "date date, label_end_date date"), "2020-01-03", "2020-01-10", "2020-02-01")
    assert [r.date for r in train.collect()] == [D(2020, 1, 1)] and [r.date for r in val.collect()] == [D(2020, 1, 10)]
    assert fl.check_embargo("2020-01-03", "2020-01-10", 5) == 5
    with pytest.raises(ValueError):
        fl.check_embargo("2020-01-03", "2020-01-09", 5)


def test_ticker_filters(spark):
    p = prices(spark, [(D(2020, 1, 1), "AAA", 1.0), (D(2020, 1, 2), "AAA", None), (D(2020, 1, 1), "BBB", None)])
    p = p.unionByName(spark.createDataFrame([(D(2020, 1, 1), "CCC", None, None, None, 2.0, None, None, "s")], p.schema))
    assert sorted(r[0] for r in fl.tickers_with_prices(p).collect()) == ["AAA", "CCC"]
    last = prices(spark, [(D(2026, 4, 30), "AAA", 1.0), (D(2025, 12, 1), "BBB", 1.0), (D(2026, 1, 15), "CCC", 1.0)])
    assert sorted(r[0] for r in fl.recent_tickers(last, "2026-04-30").collect()) == ["AAA", "CCC"]
    t = lambda *x: spark.createDataFrame([(v,) for v in x], "ticker string")
    assert sorted(r[0] for r in fl.listed_tickers(t("AAA", "BBB", "CCC"), t("AAA", "CCC", "DDD")).collect()) == ["AAA", "CCC"]
    assert fl.listed_tickers(t("AAA"), t().limit(0)).count() == 0


def replay(current, log, dates):
    """Members by date, walking the log backwards: on a change's own date the set before it holds."""
    out, members = {}, set(current)
    for d in sorted(dates, reverse=True):
        for cd in sorted({c for c, _, _ in log if c >= d}, reverse=True):
            if cd in done_of(out):
                continue
            done_of(out).add(cd)
            for c, a, r in log:
                if c == cd:
                    if a:
                        members.discard(a)
                    if r:
                        members.add(r)
        out[d] = set(members)
    out.pop("done", None)
    return out


def done_of(out):
    return out.setdefault("done", set())


def test_membership_replay(spark):
    rng = random.Random(8)
    dates = days(40)
    for _ in range(4):
        log = sorted(((rng.choice(dates), rng.choice(["A", "B", "C.X", None]), rng.choice(["A", "D", "E", None])) for _ in range(6)), key=lambda x: x[0])
        plain = [(d, a and a.replace(".", "-"), r) for d, a, r in log]
        got = un.membership_history(spark.createDataFrame([("A",), ("C.X",), (None,), ("nan",)], "ticker string"), spark.createDataFrame([(*x, k) for k, x in enumerate(log)], "date date, added_ticker string, removed_ticker string, seq long"), spark.createDataFrame([(d,) for d in dates], "date date")).collect()
        want = replay({"A", "C-X"}, plain, dates)
        assert {(r.date, r.ticker) for r in got} == {(d, t) for d, m in want.items() for t in m}
        assert all(r.membership_reliability == (0.9 if r.date > log[0][0] else 0.5) for r in got)
    none = un.membership_history(spark.createDataFrame([("A",)], "ticker string"), spark.createDataFrame([], "date date, added_ticker string, removed_ticker string"), spark.createDataFrame([(d,) for d in dates], "date date")).collect()
    assert len(none) == 40 and {r.membership_reliability for r in none} == {0.25}


def test_ranks_and_scores(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"date": np.repeat([1, 2, 3], 20), "x": rng.integers(0, 6, 60).astype(float)})
    pdf.loc[rng.choice(40, 8, replace=False), "x"] = np.nan
    pdf.loc[40:, "x"] = 0.1
    pdf["id"] = range(60)
    df = spark.createDataFrame([(int(a), None if math.isnan(b) else b, int(c)) for a, b, c in pdf.itertuples(index=False)], "date int, x double, id long")
    got = df.withColumns({"rank": share_rank(F.col("x"), "date"), "z": zscore(F.col("x"), "date")}).toPandas().sort_values("id")
    assert np.allclose(got["rank"].astype(float), pdf.groupby("date").x.rank(pct=True), equal_nan=True)
    assert (got.z[40:] == 0).all()
    want = pdf.groupby("date").x.transform(lambda s: (s - s.mean()) / s.std(ddof=0))[:40]
    assert np.allclose(got.z[:40].astype(float), want, equal_nan=True)


def test_labels(spark):
    d = days(6)
    p = prices(spark, [(d[k], t, v) for t, vs in (("A", [1.0, 2.0, None, 4.0, 5.0, 6.0]), ("B", [3.0, 3.0, 3.0, None, None, None])) for k, v in enumerate(vs)])
    got = {(r.ticker, r.date): r for r in lb.forward_labels(p, {"2d": 2}).collect()}
    assert got["A", d[0]].forward_return == 1.0 and got["A", d[2]].forward_return == 1.5 and got["B", d[2]].forward_return == 0.0 and got["A", d[0]].label_end_date == d[2]
    assert got["A", d[4]].label_truncated and got["A", d[4]].forward_return is None and not got["A", d[3]].label_truncated


def test_reasons_and_regime(spark):
    flags = [f for f, _ in rc.REASONS]
    df = spark.createDataFrame([(1, *[False] * 7), (2, None, *[False] * 6), (3, *[True] * 7)], "id long, " + ", ".join(f"{f} boolean" for f in flags))
    got = {r.id: r.x for r in df.select("id", rc.not_enough_data_reason(df.columns).alias("x")).collect()}
    assert got == {1: "", 2: "short_price_history", 3: "|".join(r for _, r in rc.REASONS)}
    r = spark.createDataFrame([(36.0, 1.0), (30.0, 0.0), (30.0, 1.0), (30.0, None), (None, 0.0)], "v double, a double").select(rc.regime(F.col("v"), F.col("a")).alias("x")).collect()
    assert [x.x for x in r] == ["CLOSED", "CAUTION", "OPEN", "OPEN", "OPEN"]


def test_recommend(spark):
    rows = [(D(2020, 1, 1), h, f"T{k:02}", float(k), v, 0.0, k == 0) for h, v in (("1d", 10.0), ("1w", 30.0), ("2w", 40.0)) for k in range(70)]
    got = rc.recommend(spark.createDataFrame(rows, "date date, horizon string, ticker string, score double, vix_close_raw double, spx_above_200d double, stale_price boolean")).toPandas()
    buys = got[got.decision == "BUY"].groupby("horizon").ticker.apply(list).to_dict()
    assert sorted(buys["1d"]) == [f"T{k}" for k in range(64, 70)] and len(buys["1w"]) == 5 and "2w" not in buys
    assert set(got[got.ticker == "T00"].decision) == {"NOT_ENOUGH_DATA"} and got[(got.ticker == "T69")].consensus_buy.eq(False).all()
    assert got[(got.horizon == "1d") & (got.ticker == "T69")].iloc[0]["rank"] == 1


def test_two_day_backtest(spark):
    d = days(2)
    recs = spark.createDataFrame([(d[0], "1d", "AAA", "BUY", "OPEN"), (d[1], "1d", "BBB", "BUY", "OPEN")], "date date, horizon string, ticker string, decision string, regime_state string")
    returns = spark.createDataFrame([(d[0], "AAA", 0.01), (d[1], "BBB", 0.02)], "date date, ticker string, next_day_return double")
    got = bt.backtest_daily(recs, returns, spark.createDataFrame([(d[0], 0.0)], "date date, benchmark_return double")).orderBy("date").collect()
    assert [round(r.turnover, 12) for r in got] == [1.0, 2.0] and [round(r.cost, 12) for r in got] == [0.001, 0.002] and round(got[1].portfolio_value) == 1_027_162


def sequential(recs, returns, cost=0.001):
    """The backtest as a loop over days."""
    held, out = {}, []
    for d, day in recs:
        target = {t: 1 / len(day) for t in day}
        turn = sum(abs(target.get(t, 0) - held.get(t, 0)) for t in {*held, *target})
        gross = sum(x * returns.get((d, t), 0) for t, x in target.items())
        grown = {t: x * (1 + returns.get((d, t), 0)) for t, x in target.items()}
        total = sum(grown.values())
        held = {t: x / total for t, x in grown.items()} if total > 0 else {}
        out.append((d, turn, gross - turn * cost))
    return out


def test_backtest_is_the_loop(spark):
    rng = random.Random(3)
    d = days(40)
    recs = [(x, rng.sample("ABCDEF", rng.choice([0, 1, 2, 3]))) for x in d]
    returns = {(x, t): rng.choice([None, -1.0, rng.uniform(-0.1, 0.1)]) for x in d for t in "ABCDEF"}
    recs[7] = (d[7], ["A"])
    returns[d[7], "A"] = -1.0
    rows = [(x, "1d", t, "BUY" if t in day else "NO_BUY", "OPEN") for x, day in recs for t in "ABCDEF"]
    got = bt.backtest_daily(spark.createDataFrame(rows, "date date, horizon string, ticker string, decision string, regime_state string"), spark.createDataFrame([(*k, v) for k, v in returns.items()], "date date, ticker string, next_day_return double"), spark.createDataFrame([], "date date, benchmark_return double")).orderBy("date").collect()
    for r, (x, turn, net) in zip(got, sequential(recs, {k: v for k, v in returns.items() if v is not None})):
        assert r.date == x and abs(r.turnover - turn) < 1e-9 and abs(r.net_return - net) < 1e-9


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [(D(2020, 1, 1) + dt.timedelta(k), f"T{j:02}", float(rng.normal()), float((j + 1) / 25), int(j >= 20), float(rng.normal()), 0.0, float(rng.normal())) for k in range(5) for j in range(25)]
    df = spark.createDataFrame(rows, "date date, ticker string, score double, target_rank double, target_class int, forward_return double, daily_median_forward_return double, forward_excess_return double")
    got = mt.ranking_metrics(df).first()
    pdf, ndcg, precision = df.toPandas(), [], []
    for _, own in pdf.groupby("date"):
        own = own.sort_values("score", ascending=False)
        gain = lambda x: ((2 ** x[:10] - 1) / np.log2(np.arange(2, 12))).sum()
        ndcg.append(gain(own.target_rank.to_numpy()) / gain(np.sort(own.target_rank.to_numpy())[::-1]))
        precision.append(own.target_class[:10].mean())
    assert abs(got.ndcg_at_10 - np.mean(ndcg)) < 1e-12 and abs(got.precision_at_10 - np.mean(precision)) < 1e-12


def test_drift_against_pandas(spark):
    rng = np.random.default_rng(6)
    a, b = pd.DataFrame({"x": rng.normal(size=300), "c": 1.0}), pd.DataFrame({"x": rng.normal(0.4, 1.3, size=200), "c": 1.0})
    got = {r.feature: r for r in mt.feature_drift(spark.createDataFrame(a), spark.createDataFrame(b), ["x", "c"]).collect()}
    edges = np.unique(a.x.quantile(np.linspace(0, 1, 11)))
    p, q = (pd.cut(s, edges, include_lowest=True).value_counts(normalize=True).sort_index().replace(0, 1e-6) for s in (a.x, b.x))
    assert abs(got["x"].psi - float(((q - p) * np.log(q / p)).sum())) < 1e-6 and got["c"].psi == 0.0


def test_calibration_bins(spark):
    for n in (1, 3, 12, 40):
        df = spark.createDataFrame([(D(2020, 1, 1), f"T{k:03}", float(k), k % 2) for k in range(n)], "date date, ticker string, score double, target_class int")
        got = [r["count"] for r in mt.calibration(df).orderBy("score_bin").collect()]
        want = pd.qcut(pd.Series(np.arange(1, n + 1) / n), min(10, n), duplicates="drop").value_counts(sort=False).tolist() if n > 1 else [1]
        assert got == want


def test_incremental_upsert(spark):
    old = spark.createDataFrame([("A", D(2020, 1, k), float(k)) for k in range(1, 21)], "ticker string, date date, close double")
    new = spark.createDataFrame([("A", D(2020, 1, k), 100.0 + k) for k in range(1, 26)] + [("N", D(2020, 1, 2), 7.0)], "ticker string, date date, close double")
    got = {(r.ticker, r.date.day): r.close for r in src.incremental_upsert(old, new).collect()}
    assert got["A", 9] == 9.0 and got["A", 10] == 110.0 and got["A", 25] == 125.0 and ("N", 2) not in got
    assert src.incremental_upsert(old, new, by_ticker=True).where("ticker = 'N'").count() == 1


def test_company_facts(spark):
    rows = {(str(r.filed_at), r.form): r for r in src.company_facts(spark.createDataFrame(src.SAMPLE_FACTS, "ticker string, body string")).collect()}
    assert set(rows) == {("2018-05-15", "10-Q"), ("2018-02-15", "10-K")}
    assert rows["2018-05-15", "10-Q"].revenue == 3.0 and rows["2018-05-15", "10-Q"].common_shares_outstanding == 6.0 and rows["2018-02-15", "10-K"].total_assets == 7.0


def wanted_facts(bodies):
    """company_facts by loops: (ticker, filed, end, form, metric) to value."""
    out = {}
    for ticker, body in bodies:
        facts = json.loads(body).get("facts") or {}
        for metric, (taxonomy, concepts, unit) in src.METRICS.items():
            for concept in concepts:
                units = ((facts.get(taxonomy) or {}).get(concept) or {}).get("units") or {}
                name = unit if unit in units else next((u for u in units if unit in u), None)
                items = [i for i in units.get(name) or [] if i.get("form") in src.FORMS and i.get("filed") and i.get("end")]
                for i in items:
                    out[ticker, i["filed"], i["end"], i["form"], metric] = i.get("val")
                if items:
                    break
    return {k: v for k, v in out.items() if v is not None}


def test_company_facts_among_many_concepts(spark):
    """Thousands of other concepts, odd units, empty lists and missing parts beside the ones that are wanted."""
    rng = random.Random(5)
    pick = lambda *x: rng.choice(x)
    item = lambda: {"form": pick("10-Q", "10-K", "S-1", None), "filed": pick("2018-05-15", "2018-08-15", None), "end": pick("2018-03-31", "2018-06-30", None), "val": rng.randint(1, 99) / 4, "accn": "x", "fy": 2018}
    units = lambda unit: {u: [item() for _ in range(rng.randint(0, 4))] for u in rng.sample([unit, f"K{unit}", f"{unit}/x", "EUR"], rng.randint(0, 4))}
    bodies = []
    for k in range(60):
        facts = {"us-gaap": {f"Other{j}": {"label": "x", "units": units("USD")} for j in range(100)}, "dei": {}, "ifrs-full": {"Revenues": {"units": units("USD")}}, "srt": [1, "odd"]}
        for taxonomy, concepts, unit in src.METRICS.values():
            for concept in concepts:
                if rng.random() < 0.7:
                    facts[taxonomy][concept] = {"label": None, "units": units(unit)}
        bodies.append((f"T{k}", json.dumps({"cik": k, "entityName": "x", "facts": facts})))
    frame = src.company_facts(spark.createDataFrame([*bodies, ("none", None), ("bad", "{"), ("empty", "{}"), ("null", '{"facts": null}')], "ticker string, body string"))
    got = {(r.ticker, str(r.filed_at), str(r.period_end), r.form, m): r[m] for r in frame.collect() for m in src.METRICS if r[m] is not None}
    assert got == wanted_facts(bodies) and len(got) > 100
    assert "Other" not in src.facts_schema(src.METRICS) and src.facts_schema(src.METRICS).count("units") == sum(len(c) for _, c, _ in src.METRICS.values())


def test_change_log_headers():
    head = ld.flat_headers([("Effective Date", "Effective Date"), ("Added", "Ticker"), ("Added", "Security"), ("Removed", "Ticker"), ("Unnamed: 1", "Reason")])
    assert head == ["Effective Date", "Added Ticker", "Added Security", "Removed Ticker", "Reason"]
    assert ld.change_columns(head) == {"date": "Effective Date", "added_ticker": "Added Ticker", "removed_ticker": "Removed Ticker"} and ld.change_columns(["Date"]) is None
    page = "<table><tr><th>Symbol</th></tr><tr><td>A.B</td></tr></table><table><tr><th rowspan=2>Date</th><th colspan=2>Added</th><th>Removed</th></tr><tr><th>Ticker</th><th>Security</th><th>Ticker</th></tr><tr><td>2020</td><td>X</td><td>x</td><td></td></tr></table>"
    (names, rows), log = ld.index_tables(page)
    assert names == ["Symbol"] and rows == [["A.B"]] and log == (["Date", "Added Ticker", "Added Security", "Removed Ticker"], [["2020", "X", "x", ""]])


def test_request_headers(monkeypatch):
    monkeypatch.setenv("TESSERA_USER_AGENT", "me@x")
    assert ld.request_headers("h.org")["User-Agent"] == "me@x" and ld.request_headers("h.org")["Host"] == "h.org" and ld.json_request_headers()["Accept"] == "application/json"
    monkeypatch.delenv("TESSERA_USER_AGENT")
    monkeypatch.setenv("USER_AGENT", "other")
    assert ld.request_headers()["User-Agent"] == "other"

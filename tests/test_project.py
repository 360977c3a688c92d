"""Whole runs: the stages of a project, the stream, the connectors, and queries against their oracles."""

import datetime as dt
import math
import random
import subprocess
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from tessera.config import Section, load_config, settings
from tessera.plans import models as md
from tessera.plans.project import Project
from tessera.sources import landing as ld
from tessera.streaming import ingest as st

SF = "/root/testdata/sf0.001"


def test_config():
    cfg = load_config("configs/base.toml")
    assert cfg.horizons == settings().horizons and len(cfg.validation.splits) == 6 and cfg.path("raw", "x").endswith("/data/raw/x")


def test_unknown_setting(tmp_path):
    (tmp_path / "c.toml").write_text("[quality]\nno_such = 1\n")
    with pytest.raises(TypeError):
        load_config(str(tmp_path / "c.toml"))


def project(spark, tmp_path):
    """A panel of 380 business days and five tickers, already ingested."""
    dates = [d.date() for d in pd.bdate_range("2018-01-01", periods=380)]
    rng, tickers = np.random.default_rng(7), {"AAA": "Technology", "BBB": "Technology", "CCC": "Healthcare", "DDD": "Finance", "EEE": "Energy"}
    rows = []
    for k, t in enumerate(tickers):
        px = np.maximum(5, 40 + 15 * k + (0.05 + 0.01 * k) * np.arange(380) + np.cumsum(rng.normal(size=380)) * 0.05)
        rows += [(d, t, *(float(px[i] * f) for f in (0.995, 1.01, 0.99, 1, 1)), 1e6 + 1e5 * k + 5e4 * math.sin(i / 10), "x") for i, d in enumerate(dates)]
    cfg = settings(str(tmp_path), horizons={"1d": 1, "1w": 5}, **{"storage.buckets": 4})
    cfg.validation.splits, cfg.validation.embargo_days, cfg.validation.holdout_start = [Section(train_end="2019-03-29", val_start="2019-04-08", val_end="2019-06-12")], 5, "2019-09-01"
    cfg.features.random_noise_feature_count = 1
    cfg.quality.min_price_history_days, cfg.quality.max_missing_feature_ratio = 60, 0.5
    p = Project(spark, cfg, fitters={"baseline": lambda f, c: md.baseline(f, c), "ranker": lambda f, c: md.ranker(f, c, settings(**{"model.ranker.backend": "listwise", "model.ranker.min_child_samples": 5, "model.ranker.max_depth": 3}).model.ranker, trees=2)})
    put = lambda rows, schema, name: p.catalog.write(spark.createDataFrame(rows, schema), "raw", name)
    schema = "date date, ticker string, open double, high double, low double, close double, adj_close double, volume double, source string"
    put(rows, schema, "prices")
    put([(d, "^GSPC", *[2500 + 250 * i / 380 + 20 * math.sin(i / 20)] * 5, 0.0, "x") for i, d in enumerate(dates)], schema, "benchmark")
    put([(d, "^VIX", *[18 + 4 * math.sin(i / 15)] * 5, 0.0, "x") for i, d in enumerate(dates)], schema, "vix")
    put([(d, "2.0") for d in dates], "date date, value string", "risk_free")
    put([(d, t, True, 1.0, "x") for d in dates for t in tickers], "date date, ticker string, is_member boolean, membership_reliability double, source string", "membership")
    put([(t, s, s) for t, s in tickers.items()], "ticker string, sector string, industry string", "metadata")
    put([(t, dates[20 + 63 * j], 5.0 + j) for t in tickers for j in range(5)], "ticker string, earnings_date date, surprise_pct double", "earnings")
    names = ["revenue", "net_income", "total_assets", "total_liabilities", "stockholders_equity", "cash_and_equivalents", "common_shares_outstanding", "eps_diluted", "operating_income", "depreciation_amortization"]
    put([(t, dates[40 + 63 * j], dates[40 + 63 * j] - dt.timedelta(45), "10-Q", *[100.0 + 10 * j + k for k in range(10)]) for t in tickers for j in range(5)], "ticker string, filed_at date, period_end date, form string, " + ", ".join(f"{n} double" for n in names), "fundamentals")
    p.prepare()
    return p


def test_all_stages(spark, tmp_path):
    p = project(spark, tmp_path)
    p.features()
    p.labels()
    store = p._done("feature_store")
    assert store.count() == 1900 and store.where("trainable").count() > 500
    frame = p.model_frame()
    assert frame.count() == 3800 and not {"forward_return", "sector_mean_ret_1d"} & set(md.feature_columns(frame))
    p.validate()
    metrics = p.catalog.read("reports", "validation_metrics").collect()
    assert {(r.horizon, r.model_name) for r in metrics} == {(h, m) for h in ("1d", "1w") for m in ("baseline", "ranker")} and all(0 <= r.ndcg_at_10 <= 1 for r in metrics)
    assert all(r.train_rows > 0 and r.rows > 0 and 0 <= r.positive_rate <= 1 and r.cross_sections > 0 for r in metrics)
    made = {n: p.catalog.read("reports", f"validation_{n}") for n in ("predictions", "drift", "calibration", "importance")}
    assert "earnings_in_window" in made["predictions"].columns and made["drift"].where("feature = 'noise_0'").count() == 2
    assert made["calibration"].agg({"count": "sum"}).first()[0] == made["predictions"].count()
    assert made["importance"].where("place = 1").count() == 4 and made["importance"].where("feature = 'noise_0'").count() == 4
    assert len(p.train()) == 4
    recs = p.recommend().toPandas()
    assert set(recs.decision) <= {"BUY", "NO_BUY", "NOT_ENOUGH_DATA"} and len(recs) == 10 and recs.date.nunique() == 1
    out = p.backtest()
    assert {(r.horizon, r.model_name) for r in out["summary"].collect()} == {(h, m) for h in ("1d", "1w") for m in ("baseline", "ranker")}
    assert out["daily"].where("portfolio_value is null").count() == 0
    assert {x["name"] for x in p.catalog.read_report("feature_catalog")} >= {"rsi_14", "sector_Energy"}


def test_stream_keeps_the_last(spark, tmp_path):
    row = lambda d, c: (dt.date(2020, 1, d), "A", *[c] * 5, 1.0, "x")
    for k, rows in enumerate(([row(1, 1.0), row(2, 2.0)], [row(2, 3.0), row(3, 4.0)])):
        spark.createDataFrame(rows, ld.PRICE_SCHEMA).write.mode("append").parquet(f"{tmp_path}/landing")
        st.ingest(spark, f"{tmp_path}/landing", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert {r.date.day: r.close for r in st.current_prices(spark, f"{tmp_path}/out").collect()} == {1: 1.0, 2: 3.0, 3: 4.0}


def test_landing_connector(spark, tmp_path):
    spark.createDataFrame([(dt.date(2020, 1, k), 1.0 * k, None, 5.0) for k in (1, 2)], "date date, `A|Close` double, `B|Adj Close` double, `B|Volume` double").write.parquet(f"{tmp_path}/prices_wide")
    (tmp_path / "series").mkdir()
    (tmp_path / "series" / "RATE").write_text("DATE,RATE\n2020-01-01,1.5\n2020-01-02,.\n")
    c = ld.LandingConnector(spark, str(tmp_path))
    assert [(r.ticker, r.close) for r in c.prices(["A", "B"], "2020-01-01", "2020-01-31").orderBy("date").collect()] == [("A", 1.0), ("A", 2.0)]
    assert [r.value for r in c.series("RATE").orderBy("date").collect()] == [1.5, None]


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    return str(v)[:10] if hasattr(v, "year") else float(v) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else v


def rows_of(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", ["feature_store", "recommendations", "backtest_daily", "event_in_window", "membership_history", "quality_flags", "feature_drift", "calibration", "ranking_metrics", "panel_wide_to_long", "facts_pivot", "incremental_upsert", "price_connector", "earnings_connector", "universe_connector", "company_facts_extract", "json_report", "empty_events_and_filings", "turnover"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


def test_recency_reads_all_rows(spark, monkeypatch):
    from tessera.queries import panel

    seen = []
    keep = panel.fl.recent_tickers
    monkeypatch.setattr(panel.fl, "recent_tickers", lambda prices, end: seen.append(prices.count()) or keep(prices, end))
    got = {r.ticker for r in entry.queries()["recent_tickers_all_rows"](spark, SF).collect()}
    prices = panel.px.prices(spark, SF)
    assert seen == [prices.count()]
    assert set() < got < {r.ticker for r in prices.select("ticker").distinct().collect()}
    con = duckdb.connect()
    for t in ("lineitem", "supplier", "nation", "region", "orders", "customer", "part", "events"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert got == {r[0] for r in con.sql(entry.oracle_sql()["recent_tickers_all_rows"]).fetchall()}


def test_every_oracle_has_a_query_and_parses():
    con = duckdb.connect()
    for t in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for sql in entry.oracle_sql().values():
        con.sql(f"explain {sql}")


def test_imports_without_the_text_operators():
    code = "import sys; sys.modules['tessera.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert not [n for n in e.queries() if n.startswith(('op', 'pipeline'))]"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_quantile_edges_are_exact(spark):
    from tessera.operators.metrics import calibration, quantile_edges

    rng = np.random.default_rng(3)
    values = {"spread": rng.normal(size=5000), "tied": np.repeat([0.0, 1.0, 2.0], [3000, 10, 1]), "one": np.array([4.0]), "two": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(f, float(x)) for f, xs in values.items() for x in xs], "feature string, x double")
    probabilities = [k / 10 for k in range(11)]
    got = {r.feature: r.edges for r in quantile_edges(df, probabilities, pieces=8).collect()}
    assert all(np.allclose(got[f], np.quantile(xs, probabilities)) for f, xs in values.items()) and set(got) == set(values)
    rows = [(dt.date(2020, 1, 1), f"T{k:04}", float(k % 37), k % 2) for k in range(1000)]
    scored = spark.createDataFrame(rows, "date date, ticker string, score double, target_class int")
    bins = {r.score_bin: r["count"] for r in calibration(scored, pieces=8).collect()}
    assert bins == {k: 101 if k == 1 else 100 for k in range(1, 10)} | {10: 99} or sum(bins.values()) == 1000 and max(bins.values()) - min(bins.values()) <= 2


def test_listwise_ranker_orders_dates(spark):
    rng = np.random.default_rng(4)
    rows = []
    for d in range(30):
        x = rng.normal(size=20)
        order = (-x).argsort().argsort()
        rows += [(dt.date(2020, 1, 1) + dt.timedelta(d), f"T{k}", float(x[k]), float(rng.normal()), float(1 - order[k] / 19)) for k in range(20)]
    frame = spark.createDataFrame(rows, "date date, ticker string, a double, b double, target_rank double")
    cfg = settings(**{"model.ranker.backend": "listwise", "model.ranker.min_child_samples": 5, "model.ranker.max_depth": 3, "model.ranker.learning_rate": 0.5}).model.ranker
    model = md.ranker(frame, ["a", "b"], cfg, trees=4)
    assert md.importances(model, ["a", "b"])[0][0] == "a"
    scored = md.score(model, frame, ["a", "b"]).toPandas()
    assert scored.groupby("date")[["score", "target_rank"]].apply(lambda g: g.score.rank().corr(g.target_rank.rank())).mean() > 0.8


def test_settings_are_checked():
    assert settings(**{"backtest.slippage_bps": 7}).backtest.slippage_bps == 7.0
    assert settings(**{"model.ranker.num_leaves": 3}).model.ranker.num_leaves == 3
    assert not hasattr(settings(**{"features.normalization": "z"}).features, "normalization")
    for wrong in ({"quality.stale_price_days": "2"}, {"validation.splits": [{"train_end": "x"}]}, {"horizons.x": 1}):
        with pytest.raises(TypeError):
            settings(**wrong)


def test_empty_events_and_index_page(spark, tmp_path):
    page = "<table><tr><th>Symbol</th><th>GICS Sector</th></tr><tr><td>A.B</td><td>S</td></tr><tr><td></td><td>S</td></tr></table>"
    (tmp_path / "index").mkdir()
    (tmp_path / "index" / "a.html").write_text(page)
    c = ld.LandingConnector(spark, str(tmp_path))
    assert [(r.ticker, r.sector, r.industry) for r in c.listed().collect()] == [("A-B", "S", None)] and c.changes().count() == 0
    assert c.membership("2020-01-03", "2020-01-07").count() == 3


def test_log_file(tmp_path):
    import logging

    from tessera.__main__ import start_logging

    start_logging(f"{tmp_path}/logs/run.log")
    logging.getLogger("x").info("landed")
    assert "landed" in (tmp_path / "logs" / "run.log").read_text()

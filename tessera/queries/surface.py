"""Queries for what reads, writes and models around the panel: connectors, artifacts, settings, models.

Each lands or saves the driver's tables under the shared folder and reads them back by the operator it is named after.
"""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Settings, flat, load_config, settings
from tessera.operators import features as ft
from tessera.operators import filters as fl
from tessera.operators import recommend as rc
from tessera.operators import universe as un
from tessera.operators.asof import event_in_window
from tessera.operators.labels import HORIZONS
from tessera.operators.quality import PRICES
from tessera.plans import models as md
from tessera.plans import stores
from tessera.queries import panel as pn
from tessera.queries import proxy as px
from tessera.queries.oracles import r6
from tessera.queries.panel import KEYS, query, r
from tessera.sources import landing as ld
from tessera.sources import tables as src
from tessera.sources.storage import Catalog
from tessera.staging import shared, staged, staging_path

BASE = str(Path(__file__).resolve().parents[2] / "configs" / "base.toml")
TICKERS = [f"NATION_{k}" for k in range(25)]


def project(s: SparkSession) -> Settings:
    """Settings of a project in a folder of its own."""
    return settings(staging_path(s))


def text(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


# --- reading and writing


@query("SELECT date, ticker, " + ", ".join(PRICES) + ", volume FROM prices")
def parquet_sink(s, d):
    catalog = Catalog(s, project(s))
    catalog.write(px.prices(s, d).select(*KEYS, *PRICES, "volume"), "processed", "prices")
    return catalog.read("processed", "prices")


@query("SELECT 'prices' AS name, true AS before_is_missing, true AS after_exists, count(*) AS n_rows FROM prices")
def artifact_catalog(s, d):
    catalog = Catalog(s, project(s))
    before = not catalog.exists("raw", "prices")
    catalog.write(px.prices(s, d), "raw", "prices")
    after = catalog.exists("raw", "prices")
    return catalog.read("raw", "prices").agg(F.count("*").alias("n_rows")).select(F.lit("prices").alias("name"), F.lit(before).alias("before_is_missing"), F.lit(after).alias("after_exists"), "n_rows")


@query("SELECT sector, count(*) AS n_rows, min(date) AS first_date, NULL::varchar AS nothing FROM prices GROUP BY sector")
def json_report(s, d):
    """A report of counts by sector, written as JSON (dates as text) and read again."""
    catalog = Catalog(s, project(s))
    rows = px.prices(s, d).groupBy("sector").agg(F.count("*").alias("n"), F.min("date").alias("first")).collect()  # a row a sector
    catalog.report([{"sector": x.sector, "n_rows": x.n, "first_date": x.first, "nothing": None} for x in rows], "sectors")
    back = [(x["sector"], x["n_rows"], x["first_date"], x["nothing"]) for x in catalog.read_report("sectors")]
    return s.createDataFrame(back, "sector string, n_rows long, first_date string, nothing string").withColumn("first_date", F.to_date("first_date"))


_SETTINGS = [
    ("backtest.slippage_bps", "5.0"), ("data.end_date", '"2026-04-30"'), ("data.refresh", "false"), ("horizons", '{"1d": 1, "1w": 5, "2w": 10, "1m": 21, "2m": 42}'), ("model.ranker.n_estimators", "500"),
    ("paths.raw_dir", '"data/raw"'), ("quality.max_missing_feature_ratio", "0.2"), ("recommendation.buy_fraction", "0.1"), ("validation.embargo_days", "42"), ("validation.splits", "6"),
]


@query(f"SELECT * FROM (VALUES {', '.join(f'({text(k)}, {text(v)})' for k, v in _SETTINGS)}) t(setting, value)")
def project_settings(s, d):
    """Settings of the project file, those it leaves out from the defaults; of the splits their number."""
    found = vars(load_config(BASE))
    as_tree = lambda x: {k: as_tree(v) for k, v in vars(x).items()} if hasattr(x, "__dict__") else x
    values = flat({k: as_tree(v) for k, v in found.items() if k != "root"})
    values["validation.splits"] = len(values["validation.splits"])
    return s.createDataFrame([(k, json.dumps(values[k])) for k, _ in _SETTINGS], "setting string, value string")


@shared
def landed(s: SparkSession, d: str) -> DataFrame:
    """One row: the landing folder that holds all that the connectors read."""
    path = staging_path(s)
    p = px.prices(s, d)
    fields = {"open": "Open", "high": "High", "low": "Low", "close": "Close", "adj_close": "Adj Close", "volume": "Volume"}
    wide = p.groupBy("date").pivot("ticker", TICKERS).agg(*(F.first(c).alias(n) for c, n in fields.items()))
    wide.toDF("date", *(f"{t}|{n}" for t in TICKERS for n in fields.values())).write.parquet(f"{path}/prices_wide")
    px.metadata(s, d).where("sector <> 'EUROPE'").write.json(f"{path}/metadata")
    px.earnings(s, d).select("ticker", F.col("earnings_date").cast("timestamp").alias("earnings_date"), F.col("surprise_pct")).write.json(f"{path}/earnings")
    facts_of(px.filings(s, d)).write.json(f"{path}/facts")
    px.risk_free(s, d).write.option("header", True).csv(f"{path}/series/RATE")
    changes = [f"<tr><td>{date}</td><td>{a}</td><td>{b}</td></tr>" for date, a, b in px.CHANGES]
    listed = [f"<tr><td>{x.ticker}</td><td>{x.sector}</td><td>{x.industry}</td></tr>" for x in px.metadata(s, d).join(px.current(s, d), "ticker", "left_semi").collect()]  # the index: a few dozen
    page = "<table><tr><th>Symbol</th><th>GICS Sector</th><th>Sub-Industry</th></tr>" + "".join(listed) + "</table><table><tr><th rowspan=2>Effective Date</th><th>Added</th><th>Removed</th></tr><tr><th>Ticker</th><th>Ticker</th></tr>" + "".join(changes) + "</table>"
    s.createDataFrame([(page,)], "value string").coalesce(1).write.text(f"{path}/index")
    return s.createDataFrame([(path,)], "path string")


def connector(s: SparkSession, d: str) -> ld.LandingConnector:
    return ld.LandingConnector(s, landed(s, d).first()[0])


@query("SELECT date, ticker, " + ", ".join(PRICES) + ", volume FROM prices")
def price_connector(s, d):
    return connector(s, d).prices(TICKERS, "1990-01-01", "2030-01-01").select(*KEYS, *PRICES, "volume")


@query("SELECT date, ticker, volume FROM prices WHERE ticker IN ('NATION_3', 'NATION_17') AND date BETWEEN DATE '1996-02-01' AND DATE '1999-12-31'")
def symbol_filter(s, d):
    return connector(s, d).prices(["NATION_3", "NATION_17", "NO_SUCH"], "1996-02-01", "1999-12-31").select(*KEYS, "volume")


@query("SELECT t.ticker, m.sector, m.industry FROM (SELECT n_name AS ticker FROM nation UNION ALL SELECT 'NO_SUCH') t LEFT JOIN (SELECT * FROM meta WHERE sector <> 'EUROPE') m ON m.ticker = t.ticker")
def metadata_connector(s, d):
    return connector(s, d).metadata([*TICKERS, "NO_SUCH"]).select("ticker", "sector", "industry")


@query(f"SELECT ticker, earnings_date, {r6('surprise_pct')} FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY earnings_date DESC) AS i FROM earn) WHERE i <= 24")
def earnings_connector(s, d):
    return connector(s, d).earnings(TICKERS).select("ticker", "earnings_date", r("surprise_pct"))


@query(f"SELECT ticker, filed_at, period_end, form, {r6('revenue / 1e6::double', 'revenue')} FROM filings")
def fundamentals_connector(s, d):
    return connector(s, d).fundamentals(TICKERS).select("ticker", "filed_at", "period_end", "form", r(F.col("revenue") / 1e6, "revenue"))


@query("SELECT date, value FROM rf")
def series_connector(s, d):
    return connector(s, d).series("RATE").select("date", "value")


@query("SELECT date, added AS added_ticker, removed AS removed_ticker FROM log")
def index_change_log(s, d):
    """The change log of the index page: a second table with headers of two levels."""
    return connector(s, d).changes()


@query("SELECT m.ticker, m.sector, m.industry FROM meta m JOIN listed l ON l.ticker = m.ticker")
def index_constituents(s, d):
    return connector(s, d).listed()


_DAYS = "SELECT cast(x AS date) AS date FROM generate_series(DATE '1995-01-02', DATE '2001-12-31', INTERVAL 1 DAY) g(x) WHERE isodow(x) < 6"


@query(
    f"SELECT g.date, g.ticker, CASE WHEN g.date > (SELECT min(date) FROM log) THEN cast(0.9 AS double) ELSE cast(0.5 AS double) END AS membership_reliability "
    f"FROM (SELECT c.date, e.ticker FROM ({_DAYS}) c CROSS JOIN everyone e) g ASOF LEFT JOIN touch t ON g.ticker = t.ticker AND g.date <= t.change_date "
    "WHERE coalesce(t.removal, g.ticker IN (SELECT ticker FROM listed))"
)
def universe_connector(s, d):
    return connector(s, d).membership("1995-01-02", "2001-12-31").select(*KEYS, "membership_reliability")


@query("SELECT upper(t) AS ticker, lpad(cast(arg_max(cik, pos) AS varchar), 10, '0') AS cik FROM (SELECT lower(n_name) AS t, s_suppkey AS cik, s_suppkey AS pos FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY 1")
def ticker_id_map(s, d):
    rows = px.table(s, d, "supplier").join(px.table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return src.ticker_ids(rows.select(F.lower("n_name").alias("ticker"), F.col("s_suppkey").alias("cik"), F.col("s_suppkey").alias("pos")))


def facts_of(filings: DataFrame) -> DataFrame:
    """Company-facts bodies (ticker, body) of filings: every metric they have under its first concept."""
    item = lambda m: F.struct("form", F.col("filed_at").cast("string").alias("filed"), F.col("period_end").cast("string").alias("end"), F.col(m).alias("val"))
    have = [m for m in src.METRICS if m in filings.columns]
    lists = filings.groupBy("ticker").agg(*(F.collect_list(item(m)).alias(m) for m in have))  # a company's filings are a few hundred
    by_taxonomy = lambda tax: F.create_map(*(x for m in have if src.METRICS[m][0] == tax for x in (F.lit(src.METRICS[m][1][0]), F.struct(F.create_map(F.lit(src.METRICS[m][2]), F.col(m)).alias("units")))))
    facts = F.create_map(F.lit("us-gaap"), by_taxonomy("us-gaap"), F.lit("dei"), by_taxonomy("dei"))
    return lists.select("ticker", F.to_json(F.struct(facts.alias("facts"))).alias("body"))


_METRICS = [m for m in src.METRICS if m != "eps_diluted"]


@query("SELECT ticker, filed_at, period_end, form, " + ", ".join(r6(f"{m} / 1e6::double", m) for m in _METRICS) + ", NULL::double AS eps_diluted FROM filings")
def company_facts_extract(s, d):
    """Company facts of every filing, back from JSON bodies: all metrics, by unit and concept."""
    found = src.company_facts(facts_of(px.filings(s, d)))
    return found.select("ticker", "filed_at", "period_end", "form", *(r(F.col(m) / 1e6, m) for m in _METRICS), "eps_diluted")


_HEADERS = [("User-Agent", "me contact@example.org"), ("Accept", "application/json"), ("Accept-Encoding", "gzip, deflate"), ("Host", "data.example.org")]


@query(f"SELECT * FROM (VALUES {', '.join(f'({text(k)}, {text(v)})' for k, v in _HEADERS)}) t(name, value)")
def request_headers(s, d):
    old = os.environ.get("TESSERA_USER_AGENT")
    os.environ["TESSERA_USER_AGENT"] = _HEADERS[0][1]
    try:
        found = ld.json_request_headers("data.example.org")
    finally:
        os.environ.pop("TESSERA_USER_AGENT") if old is None else os.environ.update(TESSERA_USER_AGENT=old)
    return s.createDataFrame(list(found.items()), "name string, value string")


# --- filters, joins and sets


@query("SELECT (SELECT count(*) FROM (SELECT ticker FROM everyone UNION SELECT 'NO_SUCH' EXCEPT SELECT ticker FROM prices)) AS missing")
def tickers_without_prices(s, d):
    listed = members_ever(s, d).union(s.createDataFrame([("NO_SUCH",), ("NO_SUCH",), (None,)], "ticker string"))
    return fl.tickers_without_prices(listed, px.prices(s, d)).agg(F.count("*").alias("missing"))


def members_ever(s: SparkSession, d: str) -> DataFrame:
    log = px.changes(s, d)
    return px.current(s, d).union(log.select(un.normal_ticker("added_ticker"))).union(log.select(un.normal_ticker("removed_ticker")))


@query("SELECT DISTINCT sector FROM meta")
def distinct_sectors(s, d):
    return s.createDataFrame([(v,) for v in stores.sector_values(px.metadata(s, d))], "sector string")


_FEATURES = [*ft.CONTINUOUS, *ft.BINARY, *(f"sector_{v}" for v in pn.SECTORS)]


@query(f"SELECT * FROM (VALUES {', '.join(f'({k}, {text(c)})' for k, c in enumerate(_FEATURES, 1))}) t(place, feature)")
def inferred_features(s, d):
    """The columns of the model frame that models learn from, in order: no key, label or sector mean."""
    frame = stores.model_frame(pn.store(s, d), pn.labels(s, d).drop("sector", "industry"))
    return s.createDataFrame(list(enumerate(md.feature_columns(frame), 1)), "place int, feature string")


@query(f"SELECT b.date, b.ticker, h.horizon, h.horizon_days FROM base b CROSS JOIN (VALUES {', '.join(f'({text(n)}, {k})' for n, k in HORIZONS.items())}) h(horizon, horizon_days)")
def frame_by_horizon(s, d):
    return rc.per_horizon(pn.panel(s, d).select(*KEYS), HORIZONS)


@query(f"SELECT p.date, p.ticker, p.horizon, {r6('p.score', 'score')}, {r6('f.vix_close_raw', 'vix_close_raw')}, f.trainable FROM preds p LEFT JOIN scored_features f ON f.date = p.date AND f.ticker = p.ticker")
def predictions_with_features(s, d):
    predictions = pn.predictions(s, d).select(*KEYS, "horizon", "score")
    return rc.with_features(predictions, pn.store(s, d).select(*KEYS, "vix_close_raw", "trainable")).select(*KEYS, "horizon", r("score"), r("vix_close_raw"), "trainable")


@query("SELECT date, horizon, ticker, row_number() OVER (ORDER BY date, horizon, rank ASC NULLS LAST, ticker) AS place FROM recs")
def recommendation_order(s, d):
    """Recommendations in the order they are written in; places come from the sorted partitions' sizes."""
    ordered = staged(rc.in_order(pn.recs(s, d).select(*KEYS, "horizon", "rank")).withColumn("part", F.spark_partition_id()).withColumn("id", F.monotonically_increasing_id()))
    sizes = ordered.groupBy("part").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.sum("n").over(pn.Window.orderBy("part").rowsBetween(pn.Window.unboundedPreceding, -1))  # a row a partition
    sizes = sizes.select("part", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return ordered.join(sizes, "part").select("date", "horizon", "ticker", (F.col("before") + F.col("id") - F.col("first") + 1).alias("place"))


@query("SELECT date, ticker, adj_close FROM base WHERE date BETWEEN DATE '1997-03-01' AND DATE '1999-06-30'")
def bounded_slice(s, d):
    return rc.latest_slice(pn.panel(s, d), "1997-03-01", "1999-06-30").select(*KEYS, "adj_close")


@query("SELECT count(*) AS n_rows, 0 AS with_event, 0 AS with_filing, 0 AS fresh FROM base")
def empty_events_and_filings(s, d):
    """Features where neither events nor filings were landed: every row stays, none has either."""
    out = stores.raw_features(pn.panel(s, d), px.earnings(s, d).limit(0), px.filings(s, d).limit(0), pn.sectors(s, d))
    counted = lambda c: F.count(F.when(c, 1)).cast("int")
    event = F.col("days_to_next_earnings").isNotNull() | F.col("days_since_last_earnings").isNotNull()
    return out.agg(F.count("*").alias("n_rows"), counted(event).alias("with_event"), counted(F.col("filed_at").isNotNull()).alias("with_filing"), counted(F.col("fundamentals_fresh")).alias("fresh"))


@query("SELECT f.date, f.ticker, l.horizon FROM scored_features f JOIN labels3 l USING (date, ticker) WHERE f.trainable AND l.target_rank IS NOT NULL AND l.target_class IS NOT NULL AND NOT l.label_truncated")
def eligible_rows_all(s, d):
    frame = staged(stores.model_frame(pn.store(s, d), pn.labels(s, d).drop("sector", "industry")).select(*KEYS, "horizon", "trainable", "target_rank", "target_class", "label_truncated"))
    parts = [fl.eligible(frame, h) for h in HORIZONS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*KEYS, "horizon")


@query(f"SELECT horizon, {r6('sum(p) / sum(n)', 'positive_rate')}, {r6('stddev_pop(p / n)', 'positive_rate_std_by_date')}, cast(count(*) AS double) AS cross_sections FROM (SELECT horizon, date, sum(target_class)::double AS p, nullif(count(target_class), 0)::double AS n FROM labels3 GROUP BY horizon, date) GROUP BY horizon")
def class_imbalance_all(s, d):
    return pn.mt.class_imbalance(pn.labels(s, d), ("horizon",)).select("horizon", r("positive_rate"), r("positive_rate_std_by_date"), "cross_sections")


_WIDE = " UNION ALL ".join(f"SELECT date, '{v}' AS ticker, max(u) AS open, min(u) AS close, sum(q) AS volume FROM lines WHERE sector = '{v}' GROUP BY date" for v in pn.SECTORS)


@query(f"SELECT date, ticker, open, close, volume FROM ({_WIDE})")
def panel_wide_to_long_all(s, d):
    wide = px.lines(s, d).groupBy("date").pivot("sector", pn.SECTORS).agg(F.max("u").alias("Open"), F.min("u").alias("Close"), F.sum("q").alias("Volume"))
    named = [c.rsplit("_", 1) for c in wide.columns[1:]]
    return src.wide_to_long(wide.toDF("date", *("|".join(n) for n in named))).select("date", "ticker", "open", "close", "volume")


_LONG = " UNION ALL ".join(f"SELECT ticker, filed_at, period_end, form, '{m}' AS metric, {m} AS v FROM filings" for m in _METRICS)


@query("SELECT ticker, filed_at, period_end, form, " + ", ".join(f"max(CASE WHEN metric = '{m}' THEN v END) AS {m}" for m in _METRICS) + f" FROM ({_LONG}) GROUP BY ALL")
def facts_pivot_all(s, d):
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in _METRICS))).alias("x")
    long = px.filings(s, d).select("ticker", "filed_at", "period_end", "form", rows).select("ticker", "filed_at", "period_end", "form", "x.*")
    return src.pivot_facts(long).select("ticker", "filed_at", "period_end", "form", *_METRICS)


# --- models: fitted on the whole model frame, with few and shallow trees


def modelled(s: SparkSession, d: str) -> DataFrame:
    """The model frame of all horizons, with whether an event falls into the label's window."""
    return model_rows(s, d)


@shared
def model_rows(s: SparkSession, d: str) -> DataFrame:
    labels = event_in_window(pn.labels(s, d), px.earnings(s, d)).drop("sector", "industry")
    return stores.model_frame(pn.store(s, d), labels)


def small(cfg: Settings) -> dict:
    few = settings(**{"model.baseline.max_iter": 10, "model.ranker.max_depth": 3, "model.ranker.backend": "listwise"}).model
    return {"baseline": lambda f, c: md.baseline(f, c, few.baseline), "ranker": lambda f, c: md.ranker(f, c, few.ranker, trees=2)}


def validation(**changes) -> Settings:
    split = {"train_end": pn.TRAIN_END, "val_start": pn.VAL_START, "val_end": pn.VAL_END}
    return settings(**{"validation.splits": [split], "validation.holdout_start": "2000-01-01", "features.random_noise_feature_count": 1} | changes)


_FRAME = "SELECT f.date, l.horizon, l.label_end_date, l.label_truncated, l.target_class FROM scored_features f JOIN labels3 l USING (date, ticker) WHERE f.trainable AND l.target_rank IS NOT NULL AND l.target_class IS NOT NULL"
_IN_TRAIN = f"date <= DATE '{pn.TRAIN_END}' AND label_end_date < DATE '{pn.VAL_START}' AND NOT label_truncated"
_IN_VAL = f"date BETWEEN DATE '{pn.VAL_START}' AND DATE '{pn.VAL_END}' AND NOT label_truncated"


@query(
    f"SELECT horizon, 'split_1' AS split, m.model_name, t.train_rows, t.n_rows, {r6('t.positive_rate', 'positive_rate')}, t.n_rows AS predictions, t.n_rows AS calibrated, 50::bigint AS features, true AS measures_in_range FROM "
    f"(SELECT horizon, count(CASE WHEN {_IN_TRAIN} THEN 1 END) AS train_rows, count(CASE WHEN {_IN_VAL} THEN 1 END) AS n_rows, avg(CASE WHEN {_IN_VAL} THEN target_class END) AS positive_rate FROM ({_FRAME}) GROUP BY horizon) t "
    "CROSS JOIN (VALUES ('baseline'), ('ranker')) m(model_name) WHERE t.train_rows > 0 AND t.n_rows > 0"
)
def walk_forward(s, d):
    """What each fit of the walk-forward was fitted on and gave: rows, class balance, predictions, calibration and importances."""
    cfg = validation()
    out = md.walk_forward(modelled(s, d), cfg, small(cfg))
    count = lambda name, c, f: out[name].groupBy(*md.FIT).agg(f.alias(c))
    found = out["metrics"].join(count("predictions", "predictions", F.count("*")), md.FIT).join(count("calibration", "calibrated", F.sum("count")), md.FIT).join(count("importance", "features", F.count("*")), md.FIT)
    good = F.lit(True)
    for c in ("ndcg_at_10", "ndcg_at_20", "precision_at_10", "hit_rate"):
        good = good & F.col(c).between(0, 1)
    return found.select(*md.FIT, "train_rows", F.col("rows").alias("n_rows"), r("positive_rate"), "predictions", "calibrated", "features", good.alias("measures_in_range"))


@query(
    f"SELECT horizon, m.model_name, trained_rows, train_start, train_end, trained_rows AS scored, true AS same_after_loading, true AS importances_sorted FROM (SELECT horizon, count(*) AS trained_rows, min(date)::varchar AS train_start, max(date)::varchar AS train_end FROM ({_FRAME}) WHERE date < DATE '2000-01-01' GROUP BY horizon) "
    "CROSS JOIN (VALUES ('baseline'), ('ranker')) m(model_name)"
)
def final_models(s, d):
    """Final models: what they were trained on, whether saved and loaded ones score all rows alike, and their importances' order."""
    cfg, path, rows = validation(), staging_path(s), []
    frame = modelled(s, d)
    models = md.train_final(frame, cfg, small(cfg))
    md.save_models(models, path)
    for (horizon, name), (model, about) in models.items():
        columns = about["feature_columns"]
        own = md.training_rows(frame, cfg, horizon).select(*KEYS, *columns)
        one = md.score(model, own, columns)
        both = md.score(md.load_model(f"{path}/{horizon}_{name}"), one.withColumnRenamed("score", "_first"), columns)
        n, worst = both.where("score is not null").agg(F.count("*"), F.max(F.abs(F.col("score") - F.col("_first")))).first()
        sizes = [abs(v) for _, v in md.importances(model, columns)]
        rows.append((horizon, name, about["trained_rows"], about["train_start"], about["train_end"], n, worst == 0, sizes == sorted(sizes, reverse=True) and len(sizes) == len(columns)))
    return s.createDataFrame(rows, "horizon string, model_name string, trained_rows long, train_start string, train_end string, scored long, same_after_loading boolean, importances_sorted boolean")


@query("SELECT count(*) AS n_rows, 3 AS noise_columns, true AS same_when_made_again, true AS like_a_normal FROM base")
def noise_features(s, d):
    """Noise of every row of the panel: made twice alike, with a mean near 0 and a deviation near 1."""
    rows = pn.panel(s, d).select(*KEYS)
    noisy, names = md.with_noise(rows)
    again, _ = md.with_noise(noisy.select(*KEYS, *(F.col(n).alias(f"_{n}") for n in names)).repartition(3))
    same = [F.max(F.abs(F.col(n) - F.col(f"_{n}"))) == 0 for n in names]
    normal = [(F.abs(F.avg(n)) < 0.1) & (F.abs(F.stddev(n) - 1) < 0.1) for n in names]
    every = lambda conditions: conditions[0] & conditions[1] & conditions[2]
    return again.agg(F.count("*").alias("n_rows"), F.lit(len(names)).alias("noise_columns"), every(same).alias("same_when_made_again"), every(normal).alias("like_a_normal"))

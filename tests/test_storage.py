"""Snapshots by month, tables in buckets, stages that know what they were made from, and fits side by side."""

import datetime as dt
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from tessera.config import settings
from tessera.plans import models as md
from tessera.plans import stores
from tessera.session import side_by_side
from tessera.sources import snapshots as sn
from tessera.sources import tables as src
from tessera.sources.storage import Catalog
from test_project import project

SCHEMA = "date date, ticker string, close double"


def prices(spark, first, last, tickers=("A", "B"), shift=0.0):
    days = [first + dt.timedelta(k) for k in range((last - first).days + 1)]
    return spark.createDataFrame([(d, t, d.toordinal() % 100 + shift) for d in days for t in tickers], SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_upsert_writes_touched_months_only(spark, tmp_path):
    table = sn.SnapshotTable(spark, f"{tmp_path}/t")
    old = prices(spark, dt.date(2020, 1, 1), dt.date(2020, 6, 25))
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.upsert(old) == 1 and len(table.manifest()["months"]) == 6
    before = table.manifest()["months"]
    fresh = prices(spark, dt.date(2020, 6, 1), dt.date(2020, 7, 3), shift=0.5)
    assert table.upsert(fresh) == 2
    after = table.manifest()["months"]
    assert {m for m in after if after[m] != before.get(m)} == {"2020-06", "2020-07"}
    assert rows(table.read()) == rows(src.incremental_upsert(old, fresh)) and rows(table.read(1)) == rows(old)
    assert sum(m["rows"] for m in after.values()) == table.read().count() and after["2020-07"]["last"] == "2020-07-03"
    part = table.read(start="2020-02-10", end="2020-03-05")
    assert rows(part) == rows(table.read().where("date between '2020-02-10' and '2020-03-05'")) and {f.split("month=")[1][:7] for f in part.inputFiles()} == {"2020-02", "2020-03"}
    assert table.upsert(fresh.where("date < '2020-01-01'")) == 2 and table.versions() == [1, 2]  # nothing new


def test_upsert_by_ticker_and_new_columns(spark, tmp_path):
    table = sn.SnapshotTable(spark, f"{tmp_path}/t")
    old = prices(spark, dt.date(2020, 1, 1), dt.date(2020, 3, 10)).unionByName(prices(spark, dt.date(2020, 1, 1), dt.date(2020, 1, 20), ("gone",)))
    fresh = prices(spark, dt.date(2020, 1, 1), dt.date(2020, 3, 20), ("B", "new", "gone"), 0.5).withColumn("source", F.lit("x"))
    table.overwrite(old)
    table.upsert(fresh, by_ticker=True)
    assert rows(table.read().na.fill("")) == rows(src.incremental_upsert(old, fresh, by_ticker=True).select(*table.read().columns).na.fill(""))
    assert table.read().columns == ["date", "ticker", "close", "source"]


def test_a_killed_run_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    table = sn.SnapshotTable(spark, f"{tmp_path}/t")
    old = prices(spark, dt.date(2020, 1, 1), dt.date(2020, 2, 5))
    table.overwrite(old)
    monkeypatch.setattr(sn.SnapshotTable, "_publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        table.upsert(prices(spark, dt.date(2020, 2, 1), dt.date(2020, 2, 9), shift=1.0))
    monkeypatch.undo()
    assert rows(table.read()) == rows(old) and len(os.listdir(f"{tmp_path}/t/data")) == 2
    assert len(table.vacuum()) == 1 and rows(table.read()) == rows(old)
    for k in range(3):
        table.upsert(prices(spark, dt.date(2020, 2, 1), dt.date(2020, 2, 9 + k), shift=1.0 + k))
    table.vacuum(1)
    assert table.versions() == [4] and table.read().count() == 2 * (31 + 11)
    (tmp_path / "t/manifests/5.json").write_text("{}")
    with pytest.raises(RuntimeError):
        monkeypatch.setattr(sn.SnapshotTable, "versions", lambda self: [4])
        table._publish({}, old.schema, {})


def test_empty_snapshot(spark, tmp_path):
    table = sn.SnapshotTable(spark, f"{tmp_path}/t")
    none = prices(spark, dt.date(2020, 1, 1), dt.date(2020, 1, 2)).limit(0)
    assert table.overwrite(none) == 1 and table.read().count() == 0
    table.upsert(prices(spark, dt.date(2020, 1, 1), dt.date(2020, 1, 2)))
    assert table.read().count() == 4


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_stored_tables_join_without_a_shuffle(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cat = Catalog(spark, settings(str(tmp_path), **{"storage.buckets": 4}))
        features = prices(spark, dt.date(2020, 1, 1), dt.date(2020, 1, 20)).selectExpr("date", "ticker", "close as ret_1d", "1.0 as membership_reliability", "true as universe_reliable")
        labels = prices(spark, dt.date(2020, 1, 1), dt.date(2020, 1, 20)).selectExpr("*", "explode(array('1d', '1w')) as horizon")
        plain = rows(stores.model_frame(features, labels))
        for name, df in (("feature_store", features), ("label_store", labels)):
            cat.write(df, "processed", name, ("ticker", "date"))
        for c in (cat, Catalog(spark, cat.cfg)):
            joined = stores.model_frame(c.read("processed", "feature_store"), c.read("processed", "label_store"))
            assert exchanges(joined) == 0 and rows(joined) == plain
        for t in ("feature_store", "label_store"):  # another session knows no such tables: the layout beside them is enough
            spark.sql(f"DROP TABLE `{cat._table('processed', t)}`")
        joined = stores.model_frame(cat.read("processed", "feature_store"), cat.read("processed", "label_store"))
        assert exchanges(joined) == 0 and rows(joined) == plain
        cat.write(features.limit(1), "processed", "feature_store")  # and a plain table in its place
        assert cat.read("processed", "feature_store").count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stages_skip_what_is_unchanged(spark, tmp_path):
    p = project(spark, tmp_path)
    assert not p.prepare()  # made by project()
    assert p.labels() and not p.labels()
    p.cfg.horizons["2d"] = 2
    assert p.labels() and not p.labels()
    assert {r.horizon for r in p._done("label_store").select("horizon").distinct().collect()} >= {"2d"}
    p.cfg.quality.stale_price_days += 1
    assert p.prepare() and p.labels()  # cleaned prices were made anew
    earnings = p._raw("earnings").toPandas()
    p.catalog.write(spark.createDataFrame(earnings.iloc[:-1]), "raw", "earnings")
    assert not p.prepare() and p.labels() and not p.labels()
    os.remove(next(f.path for f in os.scandir(f"{p.catalog._where('processed', 'label_store')}") if f.name.endswith(".parquet")))
    assert p.labels()


def test_side_by_side(spark):
    held, most, lock = [0], [0], threading.Lock()

    def job(k):
        with lock:
            held[0] += 1
            most[0] = max(most[0], held[0])
        time.sleep(0.2)
        n = spark.range(k).count()
        with lock:
            held[0] -= 1
        return n

    assert side_by_side(spark, [lambda k=k: job(k) for k in range(8)], 3) == list(range(8)) and 2 <= most[0] <= 3
    ran = []
    with pytest.raises(ZeroDivisionError):
        side_by_side(spark, [lambda: 1 / 0, *(lambda k=k: (time.sleep(0.1), ran.append(k)) for k in range(50))], 2)
    assert len(ran) < 50


def test_walk_forward_side_by_side_equals_serial(spark, tmp_path):
    p = project(spark, tmp_path)
    p.features()
    p.labels()
    p.cfg.validation.splits = [type(p.cfg.validation.splits[0])(train_end=a, val_start=b, val_end=c) for a, b, c in (("2019-02-28", "2019-03-11", "2019-04-12"), ("2019-03-29", "2019-04-08", "2019-06-12"))]
    fitters, found = {"baseline": lambda f, c: md.baseline(f, c)}, []
    for at_once in (1, 4):
        p.cfg.validation.fits_at_once = at_once
        out = md.walk_forward(p.model_frame(), p.cfg, fitters)
        found.append({name: sorted(map(str, df.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes)).collect())) for name, df in out.items()})
    assert found[0] == found[1] and len(found[0]["metrics"]) == 4

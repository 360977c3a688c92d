"""The stages of a project: each reads artifacts, makes one plan and writes its result."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.operators import backtest as bt
from tessera.operators import features as ft
from tessera.operators import filters as fl
from tessera.operators import labels as lb
from tessera.operators import recommend as rc
from tessera.operators import universe as un
from tessera.plans import catalog as fc
from tessera.plans import models as md
from tessera.plans import stores
from tessera.sources.landing import LandingConnector
from tessera.sources.storage import Catalog
from tessera.staging import staged


class Project:
    def __init__(self, spark: SparkSession, cfg: Settings, connector: LandingConnector | None = None, fitters: dict | None = None) -> None:
        self.spark, self.cfg, self.catalog, self.connector, self.fitters = spark, cfg, Catalog(spark, cfg), connector, fitters

    def _raw(self, name: str) -> DataFrame:
        months = self.catalog.snapshots("raw", name)
        return months.read() if months.exists() else self.catalog.read("raw", name)

    def _keep(self, df: DataFrame, name: str) -> None:
        """Write a table of (ticker, date) rows in buckets of these, so that stages join such tables without shuffling them."""
        self.catalog.write(df, "processed", name, ("ticker", "date"))

    def _made(self, stage: str, raw: list[str], done: list[str], outputs: list[tuple[str, str]], settings: object, build) -> bool:
        return self.catalog.made(stage, [("raw", n) for n in raw] + [("processed", n) for n in done], outputs, settings, build)

    def _done(self, name: str) -> DataFrame:
        return self.catalog.read("processed", name)

    def ingest(self, listed: DataFrame) -> None:
        """Land prices, metadata, events and filings of today's constituents (ticker, sector, industry), then clean them."""
        c, d, cat = self.connector, self.cfg.data, self.catalog
        tickers = [r[0] for r in listed.select(un.normal_ticker("ticker")).distinct().orderBy(F.lit(1)).collect() if r[0]]  # the index has a few hundred
        for name, symbols in (("prices", tickers), ("benchmark", [d.benchmark_symbol]), ("vix", [d.vix_symbol])):
            fresh = fl.keep_last(c.prices(symbols, d.start_date, d.end_date), ["ticker", "date"], [F.col("source"), F.col("close")])
            months = cat.snapshots("raw", name)  # only months with new rows are written; readers switch over once they are whole
            if d.refresh:
                months.overwrite(fresh)
            else:
                months.upsert(fresh)
            months.vacuum(self.cfg.storage.snapshots_kept)
        prices = self._raw("prices")
        missing = fl.tickers_without_prices(listed.select(un.normal_ticker("ticker").alias("ticker")), prices).count()
        logging.getLogger(__name__).info("%d listed tickers have no prices", missing)
        recent = fl.recent_tickers(prices.join(fl.tickers_with_prices(prices), "ticker", "left_semi"), d.end_date)
        wanted = [r[0] for r in fl.listed_tickers(recent, listed).orderBy("ticker").collect()]
        cat.write(un.merged_metadata(c.metadata(wanted), listed), "raw", "metadata")
        cat.write(c.earnings(wanted), "raw", "earnings")
        cat.write(c.fundamentals(wanted), "raw", "fundamentals")
        cat.write(c.series(d.risk_free_series), "raw", "risk_free")
        days = fl.business_calendar(d.start_date, d.end_date, listed)
        cat.write(un.membership_history(listed, c.changes(), days), "raw", "membership")
        self.prepare()

    def prepare(self) -> bool:
        """Cleaned prices, quality flags and the daily universe from what was ingested, unless they are made from just that already."""
        q, raw = self.cfg.quality, ["prices", "benchmark", "membership", "metadata"]
        outputs = [("processed", n) for n in ("prices_cleaned", "price_quality", "daily_universe")]
        return self._made("prepare", raw, [], outputs, [q, self.cfg.universe], self._prepare)

    def _prepare(self) -> None:
        q = self.cfg.quality
        grid = stores.calendar_reindex(self._raw("prices"), self._raw("benchmark").select("date").distinct())
        self._keep(stores.bounded_fill(grid, q.max_forward_fill_days), "prices_cleaned")
        self._keep(stores.quality_flags(grid, q.max_forward_fill_days, q.min_price_history_days, q.ipo_buffer_days, q.stale_price_days), "price_quality")
        self._keep(un.daily_universe(self._raw("membership"), self._raw("metadata"), self.cfg.universe.membership_min_reliability), "daily_universe")

    def features(self) -> bool:
        raw, done = ["benchmark", "vix", "risk_free", "earnings", "fundamentals"], ["prices_cleaned", "price_quality", "daily_universe"]
        return self._made("features", raw, done, [("processed", "feature_store")], self.cfg.quality, self._features)

    def _features(self) -> None:
        q, universe = self.cfg.quality, self._done("daily_universe")
        macro = ft.macro_frame(self._raw("benchmark"), self._raw("vix"), self._raw("risk_free"))
        cleaned = self._done("prices_cleaned").join(self._done("price_quality"), ["date", "ticker"], "left")
        panel = stores.base_panel(cleaned, universe, macro)
        sectors = stores.sector_values(universe)
        raw = ft.one_hot(ft.sector_context(ft.security_features(panel)), sectors)
        raw = ft.fundamental_features(ft.earnings_features(raw, self._raw("earnings")), self._raw("fundamentals"), q.stale_fundamental_days)
        self._keep(ft.finalize_features(raw, sectors, q.max_missing_feature_ratio), "feature_store")
        names = ("name", "formula", "valid_at", "missing_handling", "horizon_sensitive")
        self.catalog.report([dict(zip(names, x)) for x in fc.records([f"sector_{s}" for s in sectors])], "feature_catalog")

    def labels(self) -> bool:
        done = ["prices_cleaned", "daily_universe"]
        build = lambda: self._keep(lb.label_store(self._done("prices_cleaned"), self._done("daily_universe"), self._raw("earnings"), self.cfg.horizons), "label_store")
        return self._made("labels", ["earnings"], done, [("processed", "label_store")], self.cfg.horizons, build)

    def model_frame(self) -> DataFrame:
        return stores.model_frame(self._done("feature_store"), self._done("label_store"))

    def validate(self) -> None:
        found = md.walk_forward(self.model_frame(), self.cfg, self.fitters)
        for name in ("predictions", "metrics", "summary", "drift", "calibration", "importance"):
            self.catalog.write(found[name], "reports", f"validation_{name}")

    def train(self) -> dict:
        models = md.train_final(self.model_frame(), self.cfg, self.fitters)
        md.save_models(models, self.cfg.path("models", "final"))
        return {k: about for k, (_, about) in models.items()}

    def recommend(self, start: str | None = None, end: str | None = None, latest_only: bool = False, model: str = "ranker") -> DataFrame:
        features = rc.latest_slice(self._done("feature_store"), start, end, latest_only)
        columns, scored = md.feature_columns(features), None
        frame = rc.per_horizon(features, self.cfg.horizons)
        for horizon in self.cfg.horizons:
            own = md.score(md.load_model(self.cfg.path("models", f"final/{horizon}_{model}")), frame.where(F.col("horizon") == horizon), columns)
            scored = own if scored is None else scored.unionByName(own)
        self.catalog.write(self._decide(scored), "reports", "recommendations")
        return self.catalog.read("reports", "recommendations")

    def _decide(self, scored: DataFrame) -> DataFrame:
        r = self.cfg.recommendation
        return rc.in_order(rc.recommend(scored, r.buy_fraction, r.min_buy_count, r.caution_max_buys, r.closed_vix, r.caution_vix))

    def backtest(self) -> dict[str, DataFrame]:
        """Backtest validation's predictions, each model on its own; where splits overlap the last one's scores count."""
        shown = [*rc.REASONS_COLUMNS, "vix_close_raw", "spx_above_200d", "sector", "industry"]
        features = self._done("feature_store").select("date", "ticker", *shown)
        predictions = md.last_model_scores(self.catalog.read("reports", "validation_predictions"))
        own = staged(self._decide(rc.with_features(predictions, features)))
        b, bench = self.cfg.backtest, lb.next_day_returns(self._raw("benchmark")).select("date", F.col("next_day_return").alias("benchmark_return"))
        daily = bt.backtest_daily(own, lb.next_day_returns(self._done("prices_cleaned")), bench, b.transaction_cost_bps + b.slippage_bps, b.initial_capital)
        self.catalog.write(daily, "reports", "backtest_daily")
        daily = self.catalog.read("reports", "backtest_daily")
        out = {"summary": bt.backtest_summary(daily, own), "by_regime": bt.backtest_by_regime(daily)}
        for name, df in out.items():
            self.catalog.write(df, "reports", f"backtest_{name}")
        return {"daily": daily} | out

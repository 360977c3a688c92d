"""Artifacts by name: how they are read and written, laid out, and told apart by what they were made from."""

from __future__ import annotations

import hashlib
import json
import logging
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tessera.config import Section, Settings
from tessera.sources.snapshots import SnapshotTable
from tessera.staging import delete


class Catalog:
    """Paths of artifacts in the areas of a project; tables are Parquet folders, reports JSON lines.

    A table may be kept in buckets by some columns, sorted within them: joins of two such tables by
    those columns shuffle neither. The layout lies beside the table, as does the fingerprint of what it was made from.
    """

    def __init__(self, spark: SparkSession, cfg: Settings) -> None:
        self.spark, self.cfg = spark, cfg

    def _where(self, area: str, name: str) -> str:
        return self.cfg.path(area, f"{name}.parquet")

    def _beside(self, area: str, name: str, what: str) -> str:
        return self.cfg.path(area, f"_{what}/{name}.json")

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _note(self, path: str, payload: Any) -> None:
        self.spark.createDataFrame([(json.dumps(payload),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    def _noted(self, path: str) -> Any:
        fs, where = self._fs(path)
        if not fs.exists(where):
            return None
        return json.loads("".join(r[0] for r in self.spark.read.option("wholetext", True).text(path).collect()))

    def read(self, area: str, name: str) -> DataFrame:
        layout = self._noted(self._beside(area, name, "layout"))
        if not layout:
            return self.spark.read.parquet(self._where(area, name))
        table = self._table(area, name)
        if not self.spark.catalog.tableExists(table):
            by, order = (", ".join(f"`{c}`" for c in layout[k]) for k in ("by", "order"))
            self.spark.sql(f"CREATE TABLE `{table}` ({layout['schema']}) USING parquet CLUSTERED BY ({by}) SORTED BY ({order}) INTO {layout['buckets']} BUCKETS LOCATION '{self._where(area, name)}'")
        return self.spark.table(table)

    def _table(self, area: str, name: str) -> str:
        return f"tessera_{hashlib.sha256(self._where(area, name).encode()).hexdigest()[:16]}"

    def write(self, df: DataFrame, area: str, name: str, by: tuple[str, ...] = (), buckets: int | None = None) -> None:
        """by: keep the table in buckets by these columns (storage.buckets of them), sorted by them within each."""
        beside = self._beside(area, name, "layout")
        self.spark.sql(f"DROP TABLE IF EXISTS `{self._table(area, name)}`")  # the entry; its files are external
        if not by:
            delete(self.spark, beside)
            df.write.mode("overwrite").parquet(self._where(area, name))
            return
        n = buckets or self.cfg.storage.buckets
        dealt = df.repartition(n, *by)  # as the buckets are, so that each is one file
        dealt.write.mode("overwrite").bucketBy(n, *by).sortBy(*by).format("parquet").option("path", self._where(area, name)).saveAsTable(self._table(area, name))
        schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
        self._note(beside, {"schema": schema, "by": list(by), "order": list(by), "buckets": n})

    def exists(self, area: str, name: str) -> bool:
        fs, where = self._fs(self._where(area, name))
        return fs.exists(where)

    def snapshots(self, area: str, name: str) -> SnapshotTable:
        return SnapshotTable(self.spark, self.cfg.path(area, f"{name}.months"))

    # --- what an artifact was made from

    def state(self, area: str, name: str) -> str | None:
        """What an artifact holds, as a digest of its files' names, sizes and times, or of a snapshot table's manifest; None if it isn't there."""
        months = self.snapshots(area, name)
        if months.exists():
            return hashlib.sha256(json.dumps(months.manifest(), sort_keys=True).encode()).hexdigest()
        if not self.exists(area, name):
            return None
        fs, where = self._fs(self._where(area, name))
        files, found = fs.listFiles(where, True), []
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().getName(), f.getLen(), f.getModificationTime()))
        return hashlib.sha256(json.dumps(sorted(found)).encode()).hexdigest()

    def fingerprint(self, stage: str, inputs: list[tuple[str, str]], settings: Any) -> str:
        """Of a stage's name, what its inputs hold (files, and with them schemas) and the settings it reads."""
        plain = json.dumps(settings, default=lambda x: vars(x) if isinstance(x, Section) else str(x), sort_keys=True)
        return hashlib.sha256(json.dumps([stage, [(f"{a}/{n}", self.state(a, n)) for a, n in inputs], plain]).encode()).hexdigest()

    def made(self, stage: str, inputs: list[tuple[str, str]], outputs: list[tuple[str, str]], settings: Any, build: Callable[[], None]) -> bool:
        """Run build unless all outputs were made by this stage from the same inputs and settings and are as they were left; whether it ran.

        What each output was made from is noted after build, so a run that ends half-way is repeated.
        """
        wanted = self.fingerprint(stage, inputs, settings)
        notes = {o: self._beside(*o, "version") for o in outputs}
        for o, path in notes.items():
            seen = self._noted(path)
            if not seen or seen != {"fingerprint": wanted, "state": self.state(*o)} or seen["state"] is None:
                break
        else:
            logging.getLogger(__name__).info("%s is as it was: nothing to do", stage)
            return False
        build()
        for o, path in notes.items():
            self._note(path, {"fingerprint": wanted, "state": self.state(*o)})
        return True

    # --- reports

    def report(self, payload: Any, name: str) -> None:
        """Write a small report as one JSON text; what JSON has no form for is written as text."""
        text = json.dumps(payload, indent=2, default=str)
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(self.cfg.path("reports", f"{name}.json"))

    def read_report(self, name: str) -> Any:
        rows = self.spark.read.option("wholetext", True).text(self.cfg.path("reports", f"{name}.json")).collect()
        return json.loads("".join(r[0] for r in rows))

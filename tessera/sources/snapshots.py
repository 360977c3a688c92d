"""A table of months with snapshots: an upsert writes the months it touches, and a manifest switches readers over at once.

Each version writes its months to a folder of its own and then a manifest that says where every month
lies. The manifest appears whole by a rename, so a run that is killed before leaves the table as it
was. Files of earlier versions stay until vacuum, for those who still read them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.tables import fresh_rows
from tessera.staging import delete


class SnapshotTable:
    """Rows with a date, kept by month. The manifest has for each month its folder, rows and last date."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("ticker", "date")) -> None:
        self.spark, self.path, self.keys = spark, path, keys
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        where = self._path(f"{self.path}/manifests")
        names = [f.getPath().getName() for f in self._fs.listStatus(where)] if self._fs.exists(where) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("_"))

    def manifest(self, version: int | None = None) -> dict:
        """months: month to folder, rows and last date; schema. Of the last version unless another is named."""
        if version is None:
            if not (all_ := self.versions()):
                raise FileNotFoundError(f"{self.path} has no version")
            version = all_[-1]
        lines = self.spark.read.option("wholetext", True).text(f"{self.path}/manifests/{version}.json").collect()
        return json.loads(lines[0][0])

    def exists(self) -> bool:
        return bool(self.versions())

    def read(self, version: int | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
        """The rows of a version; only the months from start to end (dates) are looked at."""
        about = self.manifest(version)
        folders = [m["folder"] for month, m in sorted(about["months"].items()) if (start is None or month >= start[:7]) and (end is None or month <= end[:7])]
        schema = about["schema"]
        rows = self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)
        for bound, keep in ((start, F.col("date") >= F.lit(start).cast("date")), (end, F.col("date") <= F.lit(end).cast("date"))):
            rows = rows.where(keep) if bound is not None else rows
        return rows

    def overwrite(self, rows: DataFrame) -> int:
        """A version of these rows alone."""
        return self._publish(self._written(rows), rows.schema, {})

    def upsert(self, fresh: DataFrame, overlap_days: int = 10, by_ticker: bool = False) -> int:
        """A version with fresh rows from overlap_days before the last date on (of each ticker, by_ticker) in place of those of equal keys.

        Only months that such rows fall into are read and written. Columns that the table lacks are added, NULL in older rows.
        """
        if not self.exists():
            return self.overwrite(fresh)
        about = self.manifest()
        old = self.read()
        if by_ticker:
            new = fresh_rows(fresh, overlap_days, old.groupBy("ticker").agg(F.max("date").alias("_last")), "ticker")
        else:
            last = max((m["last"] for m in about["months"].values()), default=None)  # from the manifest: no rows are read for it
            new = fresh.where(F.col("date") >= F.date_sub(F.lit(last).cast("date"), overlap_days)) if last else fresh
        touched = [r[0] for r in new.select(_month()).distinct().collect()]  # a few names
        kept = [about["months"][m]["folder"] for m in touched if m in about["months"]]
        if not touched:
            return self.versions()[-1]
        both = new.withColumn("_n", F.lit(1))
        if kept:
            stored = self.spark.read.schema(about["schema"]).parquet(*(f"{self.path}/{f}" for f in kept)).withColumn("_n", F.lit(0))
            both = stored.unionByName(both, allowMissingColumns=True)
        w = Window.partitionBy(*self.keys).orderBy(F.col("_n").desc())
        rows = both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_n", "_r")
        schema = old.limit(0).unionByName(fresh.limit(0), allowMissingColumns=True).schema
        return self._publish(self._written(rows), schema, about["months"])

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete all but the last `keep` versions, folders that none of those names, and what killed runs left. Not while one runs."""
        all_ = self.versions()
        used = {m["folder"].split("/")[1] for v in all_[-keep:] for m in self.manifest(v)["months"].values()}
        data = self._path(f"{self.path}/data")
        gone = [f.getPath().getName() for f in self._fs.listStatus(data)] if self._fs.exists(data) else []
        gone = [f"{self.path}/data/{name}" for name in gone if name not in used] + [f"{self.path}/manifests/{v}.json" for v in all_[:-keep]]
        for path in gone:
            delete(self.spark, path)
        return gone

    def _written(self, rows: DataFrame) -> dict[str, dict]:
        """Write rows by month to a new folder; months with their folder, rows and last date."""
        folder = f"data/{uuid.uuid4().hex}"
        dealt = rows.withColumn("month", _month()).repartitionByRange("month", *self.keys).sortWithinPartitions("month", *self.keys)
        dealt.write.partitionBy("month").parquet(f"{self.path}/{folder}")
        if not self._fs.exists(self._path(f"{self.path}/{folder}")) or rows.isEmpty():
            return {}
        found = self.spark.read.parquet(f"{self.path}/{folder}").select("date", F.col("month").cast("string").alias("month")).groupBy("month").agg(F.count("*").alias("n"), F.max("date").alias("last")).collect()  # a row a month
        return {r.month: {"folder": f"{folder}/month={r.month}", "rows": r.n, "last": str(r.last)} for r in found}

    def _publish(self, months: dict[str, dict], schema, before: dict[str, dict]) -> int:
        """Make the next version: earlier months but for those written anew. A version that another run has just made raises."""
        version = (self.versions() or [0])[-1] + 1
        body = json.dumps({"schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "months": before | months})
        aside, place = self._path(f"{self.path}/manifests/_{uuid.uuid4().hex}"), self._path(f"{self.path}/manifests/{version}.json")
        out = self._fs.create(aside, False)
        out.write(bytearray(body.encode()))
        out.close()
        if self._fs.exists(place) or not self._fs.rename(aside, place):
            delete(self.spark, aside.toString())
            raise RuntimeError(f"version {version} of {self.path} has been made by another run")
        return version


def _month():
    return F.date_format("date", "yyyy-MM").alias("month")

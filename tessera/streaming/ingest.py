"""Prices as a stream: an extension of the batch ingest, with the same keep-last rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.landing import PRICE_SCHEMA


def stream_prices(spark: SparkSession, landing: str) -> DataFrame:
    return spark.readStream.schema(PRICE_SCHEMA).parquet(landing)


def ingest(spark: SparkSession, landing: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append each batch of landed prices to `out`, by month, with its number; run on what is there and stop.

    Nothing is rewritten, so a batch that is run again only replaces its own files: current_prices reads the last row
    of each (ticker, date).
    """

    def append(batch: DataFrame, number: int) -> None:
        own = batch.withColumns({"batch": F.lit(number), "month": F.date_format("date", "yyyy-MM")})
        own.write.mode("overwrite").partitionBy("month").parquet(f"{out}/batch_{number:08d}")

    return stream_prices(spark, landing).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_prices(spark: SparkSession, out: str) -> DataFrame:
    """The last landed row of each (ticker, date)."""
    from tessera.operators.filters import keep_last

    rows = spark.read.option("recursiveFileLookup", True).schema(PRICE_SCHEMA + ", batch int").parquet(out)
    return keep_last(rows, ["ticker", "date"], [F.col("batch"), F.col("close")]).drop("batch")


def daily_bars(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Daily open, high, low, close and volume of a stream of (ts, ticker, price, size), late rows included up to `late`."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "ticker")
    return w.agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("size").alias("volume")).select(F.to_date("window.start").alias("date"), "ticker", "open", "high", "low", "close", "volume")

"""The driver's tables read as a panel: nations as tickers, regions as sectors, shipments as trades.

Money is summed as decimals, so that sums don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.staging import shared

# The change log (date, added, removed) and the tickers that aren't members today.
CHANGES = [
    ("1996-06-03", "NATION_3", "NATION_7"),
    ("1997-02-10", "NATION_12", ""),
    ("1998-09-21", "NATION_7", "NATION_20"),
    ("2000-01-17", "NATION.24", "NATION_5"),
    ("2000-01-17", "nan", "NATION_12"),
]
GONE = ["NATION_20", "NATION_5", "NATION_12"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def money(c: str) -> Column:
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def lines(spark: SparkSession, d: str) -> DataFrame:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("ticker"), F.col("r_name").alias("sector"))
    sellers = table(spark, d, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "ticker", "sector")
    trades = table(spark, d, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("p"), F.col("l_quantity").alias("q"))
    own = trades.join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
    return own.select("date", "ticker", "sector", "p", "q", (F.col("p") / F.col("q")).alias("u"))


@shared
def trades(spark: SparkSession, d: str) -> DataFrame:
    """A row for each (date, ticker): all that prices and the market's own series are made of, from one scan of the trades."""
    amounts = F.sum(F.col("p").cast("decimal(18,2)")).alias("amount"), F.sum("q").alias("volume")
    return lines(spark, d).groupBy("date", "ticker").agg(F.min("sector").alias("sector"), F.max("u").alias("high"), F.min("u").alias("low"), *amounts)


def prices(spark: SparkSession, d: str) -> DataFrame:
    out = trades(spark, d).withColumn("close", F.col("amount").cast("double") / F.col("volume"))
    return out.select("date", "ticker", "sector", ((F.col("high") + F.col("low")) / 2).alias("open"), "high", "low", "close", F.col("close").alias("adj_close"), "volume", F.lit("trades").alias("source"))


def benchmark(spark: SparkSession, d: str) -> DataFrame:
    return trades(spark, d).groupBy("date").agg((F.sum("amount").cast("double") / F.sum("volume")).alias("adj_close"))


def calendar(spark: SparkSession, d: str) -> DataFrame:
    return trades(spark, d).select("date").distinct()


def volatility(spark: SparkSession, d: str) -> DataFrame:
    price = F.sum("amount").cast("double") / F.sum("volume")
    return trades(spark, d).groupBy("date").agg((10 + 60 * price / F.max("high")).alias("adj_close"))


def risk_free(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"), "o_totalprice")
    value = money("o_totalprice") / F.count("*") / 100_000
    return o.groupBy("date").agg(F.when(F.dayofmonth("date") == 13, F.lit(".")).otherwise(value.cast("string")).alias("value"))


def orders_by_quarter(spark: SparkSession, d: str) -> DataFrame:
    places = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("ticker"))
    buyers = table(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "ticker", "n_nationkey")
    o = table(spark, d, "orders").select("o_custkey", "o_totalprice", "o_orderpriority", F.to_date("o_orderdate").alias("date"))
    return o.join(buyers, F.col("o_custkey") == F.col("c_custkey")).withColumn("quarter", F.trunc("date", "quarter"))


def earnings(spark: SparkSession, d: str) -> DataFrame:
    urgent = orders_by_quarter(spark, d).where("o_orderpriority = '1-URGENT'")
    return urgent.groupBy("ticker", "quarter").agg(F.max("date").alias("earnings_date"), (money("o_totalprice") / F.count("*") / 10_000).alias("surprise_pct")).drop("quarter")


def filings(spark: SparkSession, d: str) -> DataFrame:
    own = orders_by_quarter(spark, d).groupBy("ticker", "n_nationkey", "quarter").agg(money("o_totalprice").alias("revenue"), F.count("*").alias("n"))
    end, r = F.last_day(F.add_months("quarter", 2)), F.col("revenue")
    annual = (F.quarter("quarter") == 4) & (F.col("n_nationkey") % 2 == 0)
    return own.select(
        "ticker", F.date_add(end, 45).alias("filed_at"), end.alias("period_end"), F.when(annual, "10-K").otherwise("10-Q").alias("form"), "revenue", (r * 0.05 + F.col("n") * 100).alias("net_income"), (r * 3 + F.col("n") * 1000).alias("total_assets"),
        (r * 1.2).alias("total_liabilities"), (r * 1.5 + F.col("n") * 777).alias("stockholders_equity"), (r * 0.2).alias("cash_and_equivalents"), (r / 100).alias("common_shares_outstanding"), (r * 0.15).alias("operating_income"), (r * 0.05).alias("depreciation_amortization"),
    )


def changes(spark: SparkSession, d: str) -> DataFrame:
    rows = [(date, added, removed, k) for k, (date, added, removed) in enumerate(CHANGES)]
    return spark.createDataFrame(rows, "date string, added_ticker string, removed_ticker string, seq long").withColumn("date", F.to_date("date"))


def current(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_name").alias("ticker")).where(~F.col("ticker").isin(GONE))


def metadata(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.col("n_name").alias("ticker"), F.col("r_name").alias("sector"), F.concat_ws("-", "r_name", (F.col("n_nationkey") % 3).cast("string")).alias("industry"))

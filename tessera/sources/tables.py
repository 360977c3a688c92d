"""Reading landed vendor data as panels: wide tables, numbers in text, company facts, incremental merges."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PANEL = ["open", "high", "low", "close", "adj_close", "volume"]
# Public names of filing forms, and of concepts by metric with their units, first choice first.
FORMS = ["10-Q", "10-K", "10-Q/A", "10-K/A", "8-K"]
METRICS = {
    "revenue": ("us-gaap", ["Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet"], "USD"),
    "net_income": ("us-gaap", ["NetIncomeLoss"], "USD"),
    "total_assets": ("us-gaap", ["Assets"], "USD"),
    "total_liabilities": ("us-gaap", ["Liabilities"], "USD"),
    "stockholders_equity": ("us-gaap", ["StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest", "StockholdersEquity"], "USD"),
    "cash_and_equivalents": ("us-gaap", ["CashAndCashEquivalentsAtCarryingValue"], "USD"),
    "common_shares_outstanding": ("dei", ["EntityCommonStockSharesOutstanding"], "shares"),
    "eps_diluted": ("us-gaap", ["EarningsPerShareDiluted", "EarningsPerShareBasicAndDiluted"], "USD/shares"),
    "operating_income": ("us-gaap", ["OperatingIncomeLoss"], "USD"),
    "depreciation_amortization": ("us-gaap", ["DepreciationDepletionAndAmortization"], "USD"),
}
_ITEMS = "map<string, array<struct<form: string, filed: string, end: string, val: double>>>"


def facts_schema(metrics: dict[str, tuple[str, list[str], str]]) -> str:
    """The part of a company-facts body that metrics need, as a schema: the parser passes over all other concepts and keeps nothing of them."""
    concepts: dict[str, list[str]] = {}
    for taxonomy, names, _ in metrics.values():
        concepts.setdefault(taxonomy, []).extend(n for n in names if n not in concepts.get(taxonomy, []))
    each = lambda names: ", ".join(f"`{n}`: struct<units: {_ITEMS}>" for n in names)
    return "facts struct<" + ", ".join(f"`{t}`: struct<{each(names)}>" for t, names in concepts.items()) + ">"


def to_number(text: Column) -> Column:
    """The number a text spells, NULL where it spells none."""
    return text.try_cast("double")


def wide_to_long(wide: DataFrame, separator: str = "|") -> DataFrame:
    """One row for each date and symbol of a table with columns symbol|field; rows without any price go.

    Fields are named in any case, with spaces or underscores; a symbol that lacks one has NULL there. One pass, no join.
    """
    columns: dict[str, dict[str, str]] = {}
    for c in wide.columns:
        if separator in c:
            symbol, field = c.split(separator, 1)
            columns.setdefault(symbol, {})[field.strip().lower().replace(" ", "_")] = c
    rows = F.array(*(F.struct(F.lit(s).alias("ticker"), *((F.col(f"`{own[f]}`") if f in own else F.lit(None)).cast("double").alias(f) for f in PANEL)) for s, own in columns.items()))
    long = wide.select("date", F.explode(rows).alias("x")).select("date", "x.*")
    return long.where(F.coalesce(*PANEL[:5]).isNotNull())


def company_facts(bodies: DataFrame) -> DataFrame:
    """Filings from company-facts JSON (ticker, body): one row for each ticker, filing date, period end and form.

    For each metric the first of its concepts with any usable value is taken; of its units the exact one, else the
    first that contains it; of equal keys the last value. Values of other forms, or without a filing
    or period date, go. A body that isn't JSON has no facts. Bodies hold thousands of concepts: only the ones above are
    read from them.
    """
    parsed = bodies.select("ticker", F.from_json("body", facts_schema(METRICS)).alias("f"))
    wanted = F.array(
        *(
            F.struct(F.lit(m).alias("metric"), F.lit(rank).alias("rank"), F.lit(unit).alias("unit"), F.col(f"f.facts.`{tax}`.`{c}`.units").alias("units"))
            for m, (tax, concepts, unit) in METRICS.items()
            for rank, c in enumerate(concepts)
        )
    )
    each = parsed.select("ticker", F.explode(wanted).alias("w")).select("ticker", "w.*").where("units is not null")
    names = F.map_keys("units")
    unit = F.coalesce(F.get(F.filter(names, lambda u: u == F.col("unit")), F.lit(0)), F.get(F.filter(names, lambda u: F.contains(u, F.col("unit"))), F.lit(0)))
    items = each.withColumn("items", F.col("units")[unit]).select("ticker", "metric", "rank", F.posexplode("items").alias("pos", "i"))
    items = items.select("ticker", "metric", "rank", "pos", F.to_date("i.filed").alias("filed_at"), F.to_date("i.end").alias("period_end"), F.col("i.form").alias("form"), F.col("i.val").alias("value"))
    items = items.where(F.col("form").isin(FORMS) & F.col("filed_at").isNotNull() & F.col("period_end").isNotNull())
    first = items.withColumn("best", F.min("rank").over(Window.partitionBy("ticker", "metric"))).where("rank = best")
    return pivot_facts(first.groupBy("ticker", "metric", "filed_at", "period_end", "form").agg(F.max_by("value", "pos").alias("value")))


def pivot_facts(long: DataFrame) -> DataFrame:
    """A column for each metric, NULL where a filing lacks it; the metrics are known, so they aren't looked up first."""
    return long.groupBy("ticker", "filed_at", "period_end", "form").pivot("metric", list(METRICS)).agg(F.first("value"))


def fresh_rows(fresh: DataFrame, overlap_days: int, last: DataFrame, on: str | None) -> DataFrame:
    """Rows of fresh from overlap_days before `_last` (a row of last, for each `on` or one for all) on, and those without one."""
    joined = fresh.join(last, on, "left") if on else fresh.join(F.broadcast(last))  # one row
    return joined.where(F.col("_last").isNull() | (F.col("date") >= F.date_sub("_last", overlap_days))).drop("_last")


def incremental_upsert(stored: DataFrame, fresh: DataFrame, keys: tuple[str, ...] = ("ticker", "date"), overlap_days: int = 10, by_ticker: bool = False) -> DataFrame:
    """stored, with fresh rows from overlap_days before its last date on in place of its own.

    by_ticker: each ticker from its own last date, and new tickers whole; else all from the one last date.
    """
    last = (stored.groupBy("ticker") if by_ticker else stored).agg(F.max("date").alias("_last"))
    new = fresh_rows(fresh, overlap_days, last, "ticker" if by_ticker else None)
    both = stored.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col("_n").desc())
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_n", "_r")


def ticker_ids(rows: DataFrame) -> DataFrame:
    """Ticker (upper case) and ten-digit id from rows (pos, ticker, cik); of a ticker's rows the last counts."""
    return rows.groupBy(F.upper("ticker").alias("ticker")).agg(F.lpad(F.max_by("cik", "pos").cast("string"), 10, "0").alias("cik"))


def _item(form: str | None, filed: str | None, end: str, val: float) -> dict:
    return {"form": form, "filed": filed, "end": end, "val": val}


#: A small body for each case of company_facts.
SAMPLE_FACTS = [
    ("AAA", json.dumps({"facts": {"us-gaap": {"SalesRevenueNet": {"units": {"USD": [_item("10-Q", "2018-02-15", "2017-12-31", 1.0)]}}, "Revenues": {"units": {"EUR": [], "USD": [_item("10-Q", "2018-05-15", "2018-03-31", 2.0), _item("10-Q", "2018-05-15", "2018-03-31", 3.0), _item("S-1", "2018-06-15", "2018-03-31", 9.0)]}}, "Assets": {"units": {"KUSD": [_item("10-K", "2018-02-15", "2017-12-31", 7.0)]}}}, "dei": {"EntityCommonStockSharesOutstanding": {"units": {"shares": [_item("10-Q", None, "2018-03-31", 5.0), _item("10-Q", "2018-05-15", "2018-03-31", 6.0)]}}}}})),
    ("BBB", "not JSON"),
]

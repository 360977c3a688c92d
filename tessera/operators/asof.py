"""As-of joins and interval existence by a union and one ordered window: one shuffle, linear after its sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scan import block_cuts, block_of


def asof_join(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, take: dict[str, Column], backward: bool = True, inclusive: bool = True, tie: Column | None = None) -> DataFrame:
    """left with, for each row, what `take` gives of the nearest row of right at or before (or after) its time.

    take: new name to column of right. Of right rows with equal times the last by `tie` counts.
    inclusive: whether an equal time matches. Rows of right without a time match nothing; left rows stay, matched or not.
    """
    payload = F.struct(*(c.alias(n) for n, c in take.items()))
    tie = F.lit(0) if tie is None else tie
    first = 0 if inclusive else 2  # where a right row of the same time stands against the left row's 1
    r = right.where(F.col(right_time).isNotNull()).select(F.col(on).alias("_on"), F.col(right_time).cast("timestamp").alias("_time"), F.lit(first).alias("_side"), tie.alias("_tie"), payload.alias("_right"))
    # left's columns stay columns, so that those nobody asks for are never computed or shuffled
    l = left.select("*", F.col(on).alias("_on"), F.col(left_time).cast("timestamp").alias("_time"), F.lit(1).alias("_side"))  # noqa: E741
    both = l.unionByName(r, allowMissingColumns=True)
    time = F.col("_time").asc() if backward else F.col("_time").desc()
    w = Window.partitionBy("_on").orderBy(time, "_side", F.col("_tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("_match", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    return out.select(*left.columns, *(F.col(f"_match.{n}").alias(n) for n in take))


def asof_join_sliced(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, take: dict[str, Column], backward: bool = True, inclusive: bool = True, tie: Column | None = None, slices: int = 64) -> DataFrame:
    """What asof_join gives, with each key's rows dealt out by slices of time: a key that holds most rows is ordered by many tasks.

    Slices end near the quantiles of left's times. A row looks within its slice; where that has no match it takes what its key's
    earlier (backward: False: later) slices end in, a row for each key and slice. Left rows without a time match nothing.
    """
    payload, tie = F.struct(*(c.alias(n) for n, c in take.items())), F.lit(0) if tie is None else tie
    first = 0 if inclusive else 2
    r = right.where(F.col(right_time).isNotNull()).select(F.col(on).alias("_on"), F.col(right_time).cast("timestamp").alias("_time"), F.lit(first).alias("_side"), tie.alias("_tie"), payload.alias("_right"))
    l = left.select("*", F.col(on).alias("_on"), F.col(left_time).cast("timestamp").alias("_time"), F.lit(1).alias("_side"))  # noqa: E741
    cuts = block_cuts(l.select("_time"), "_time", slices)
    both = l.unionByName(r, allowMissingColumns=True)
    both = both.withColumn("_slice", F.when(F.col("_time").isNull(), -1).otherwise(block_of(both, "_time", cuts)))
    way = (lambda c: F.col(c).asc()) if backward else (lambda c: F.col(c).desc())
    w = Window.partitionBy("_on", "_slice").orderBy(way("_time"), "_side", F.col("_tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a slice's end: of its right rows the last in that order
    at = F.unix_micros("_time") if backward else -F.unix_micros("_time")
    ends = both.groupBy("_on", "_slice").agg(F.max_by("_right", F.when(F.col("_side") != 1, F.struct(at, "_tie"))).alias("_end"))
    carried = ends.select(F.col("_on").alias("_key"), F.col("_slice").alias("_part"), F.last("_end", ignorenulls=True).over(Window.partitionBy("_on").orderBy(way("_slice")).rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    found = both.withColumn("_match", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    found = found.join(carried, F.col("_on").eqNullSafe(F.col("_key")) & (F.col("_slice") == F.col("_part")), "left")
    match = F.when(F.col("_time").isNotNull(), F.coalesce("_match", "_carried"))
    return found.withColumn("_match", match).select(*left.columns, *(F.col(f"_match.{n}").alias(n) for n in take))


def event_in_window(panel: DataFrame, events: DataFrame, event_time: str = "earnings_date", start: str = "date", end: str = "label_end_date", out: str = "earnings_in_window") -> DataFrame:
    """panel with whether its ticker has an event in (start, end]; an unknown end is no limit."""
    found = asof_join(panel, events, "ticker", start, event_time, {"_next": F.col(event_time)}, backward=False, inclusive=False)
    after = F.col("_next").isNotNull() & (F.col(end).isNull() | (F.col("_next") <= F.col(end)))
    return found.withColumn(out, after).drop("_next")

"""Running values over an ordered frame, block by block: no task orders a whole group.

Rows are cut into blocks of the order's values, near its quantiles. Within a block a window runs; a
table of one row for each group and block gives what the blocks before it come to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How a value runs within a window or group, and how what came before is combined with it; NULL where nothing did.
_KINDS: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda before, own: F.coalesce(before + own, before, own)),
    "count": (F.count, lambda before, own: F.coalesce(before, F.lit(0)) + own),
    "product": (F.product, lambda before, own: F.coalesce(before * own, before, own)),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda before, own: F.coalesce(own, before)),
}


def block_cuts(df: DataFrame, order: str, blocks: int) -> list:
    """Up to blocks - 1 values of a date, time or number column near its quantiles, ascending: one pass, sketches are merged."""
    number = _as_number(df, order)
    found = df.agg(F.percentile_approx(number, F.array(*(F.lit(k / blocks) for k in range(1, blocks))), F.lit(100 * blocks))).first()[0] if blocks > 1 else None
    return sorted(set(found or []))


def _as_number(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    return F.unix_micros(F.col(name).cast("timestamp")) if kind.startswith(("date", "timestamp")) else F.col(name)


def block_of(df: DataFrame, order: str, cuts: list) -> Column:
    """The block of each row: how many cuts lie below its value. Equal values share one; NULL is in the first."""
    number = _as_number(df, order)
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < number)), F.lit(0)) if cuts else F.lit(0)


def running(df: DataFrame, by: list[str], order: str, values: dict[str, tuple[str, Column]], ties: tuple[str, ...] = (), blocks: int = 64, cuts: list | None = None) -> DataFrame:
    """df with running values of each group in the order of a date, time or number column, then `ties`.

    values: new name to (kind, column); kind is sum, count, product, max, min or last (the last known).
    Each covers all rows up to a row, itself included; NULLs are passed over. Rows that equal each other in order and
    ties run in any order. cuts may be given where they are known (see block_cuts).
    """
    cuts = block_cuts(df, order, blocks) if cuts is None else cuts
    keys = [*by, "_block"]
    dealt = df.withColumn("_block", block_of(df, order, cuts)).withColumns({f"_v_{n}": c for n, (_, c) in values.items()})
    own = Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_first(), *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = dealt.withColumns({n: _KINDS[kind][0](F.col(f"_v_{n}")).over(own) for n, (kind, _) in values.items()})

    # what each block comes to: its last row in order, so `last` needs the order and the others don't
    place = F.struct(F.col(order), *ties)
    known = lambda n: F.col(f"_v_{n}").isNotNull()
    whole = {n: F.max_by(F.col(f"_v_{n}"), F.when(known(n), place)) if kind == "last" else _KINDS[kind][0](F.col(f"_v_{n}")) for n, (kind, _) in values.items()}
    totals = dealt.groupBy(*keys).agg(*(c.alias(f"_t_{n}") for n, c in whole.items()))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    totals = totals.select(*keys, *((F.sum if kind == "count" else _KINDS[kind][0])(F.col(f"_t_{n}")).over(before).alias(f"_b_{n}") for n, (kind, _) in values.items()))
    matched = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by] + [F.col("l._block") == F.col("r._block")]
    condition = matched[0]
    for m in matched[1:]:
        condition = condition & m
    out = dealt.alias("l").join(totals.alias("r"), condition)
    return out.select(*(F.col(f"l.{c}") for c in df.columns if c not in values), *(_KINDS[kind][1](F.col(f"r._b_{n}"), F.col(f"l.{n}")).alias(n) for n, (kind, _) in values.items()))

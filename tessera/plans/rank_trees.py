"""Boosted histogram trees that rank the rows of each group: LambdaRank as Spark jobs.

Features are cut into bins once. For each tree the rows' lambdas follow from pairs with the first rows
of their group, and every round of growth sums gradients by (node, feature, bin) in tasks and one
grouping. The driver sees a row for each node, never rows of data.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import metrics as mt
from tessera.staging import scratch, staged

GRADIENTS = "x binary, g double, h double"
SUMS = "node int, feature int, bin int, g double, h double, n long"
#: Least sum of second derivatives on a side, and least gain of a split.
LEAST_HESSIAN, LEAST_GAIN = 1e-3, 1e-9


# --- lambdas


def relevance(rank: Column | str) -> Column:
    """A rank of 0 to 1 as a whole number of 0 to 100; unknown ranks are 0."""
    return F.least(F.greatest(F.round(100 * F.coalesce(rank, F.lit(0.0))), F.lit(0)), F.lit(100)).cast("int")


def gain(grade: Column | str) -> Column:
    """What a row of a relevance adds to a DCG, as ndcg has it for ranks."""
    return F.pow(F.lit(2.0), F.col(grade) / 100.0) - 1 if isinstance(grade, str) else F.pow(F.lit(2.0), grade / 100.0) - 1


def _first(rows: DataFrame, by: list[str], order: list[Column], top: int) -> DataFrame:
    """The first rows of each group with their place; tasks keep no more than `top` of a group before it is shuffled."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= top)


def with_ideal(rows: DataFrame, by: list[str], top: int) -> DataFrame:
    """rows with unit: one over the best DCG that the group's first `top` places can have, 0 where that is 0."""
    best = _first(rows.select(*by, "ticker", "grade"), by, [F.col("grade").desc(), F.col("ticker")], top)
    dcg = F.sum(gain("grade") / F.log2(F.col("place") + 1))
    ideal = best.groupBy(*by).agg(F.when(dcg > 0, 1 / dcg).otherwise(0.0).alias("unit"))
    return rows.join(ideal, by)


def _padded(values: str, size: int, filler: float | int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(filler), F.lit(size) - F.size(values)))


def _pairs(batch: pa.RecordBatch, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row and each first row of its group: what the row is pulled up by, the second derivative, and whether they are one row."""
    column = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
    wide = lambda name: batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, top)
    ids, their_ids = column("id"), wide("top_id")
    score, worth, their_score, their_worth = column("score")[:, None], column("worth")[:, None], wide("top_score"), wide("top_worth")
    same = ids[:, None] == their_ids
    at = same.argmax(1)
    discount = 1 / np.log2(np.arange(2, top + 2))
    own = np.where(same.any(1), discount[at], 0.0)[:, None]
    change = np.abs(worth - their_worth) * np.abs(own - discount) * column("unit")[:, None]
    change[(their_ids < 0) | same] = 0
    better = np.sign(worth - their_worth)
    with np.errstate(over="ignore"):
        wrong = 1 / (1 + np.exp(better * (score - their_score)))  # how much the pair's order is in doubt
    return better * change * wrong, change * wrong * (1 - wrong), same


def lambdas(rows: DataFrame, by: list[str], top: int = 30) -> DataFrame:
    """rows (by, id, ticker, grade, score, unit, ...) with g and h: the pull and the second derivative of each row.

    Pairs are those of which one is among the first `top` rows of the group by score (ties by ticker) and whose grades differ; a
    pair weighs what swapping it changes the NDCG at `top`. A first row's pairs with the rest of its group
    are added up where the others are, so a group may be spread over any number of tasks. id must be unique and not negative.
    """
    rows = rows.withColumn("worth", gain("grade"))
    first = _first(rows.select(*by, "id", "ticker", "score", "worth"), by, [F.col("score").desc(), F.col("ticker"), F.col("id")], top)
    found = first.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("place", "id", "score", "worth"))).alias("t"))  # `top` rows at most
    names = {"top_id": ("id", -1), "top_score": ("score", 0.0), "top_worth": ("worth", 0.0)}
    heads = found.select(*by, *(_padded(f"t.{c}", top, filler).alias(n) for n, (c, filler) in names.items()))
    sums = "place int, g double, h double"

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows that aren't first themselves: what the first rows of their group get from them, a row a place."""
        for batch in batches:
            g, h, same = _pairs(batch, top)
            rest = ~same.any(1)
            if not rest.any():
                continue
            keys = batch.select(by).to_pandas()[rest]
            # runs of one group: their rows come together more often than not
            edge = np.flatnonzero(np.r_[True, (keys.values[1:] != keys.values[:-1]).any(1)])
            both = [np.add.reduceat(m[rest], edge).ravel() for m in (-g, h)]
            out = pa.Table.from_pandas(keys.iloc[np.repeat(edge, top)], schema=pa.schema([batch.schema.field(c) for c in by]), preserve_index=False)
            place = np.tile(np.arange(1, top + 1, dtype=np.int32), len(edge))
            for name, values in (("place", place), ("g", both[0]), ("h", both[1])):
                out = out.append_column(name, pa.array(values))
            yield from out.to_batches()

    joined = rows.join(heads, by)
    needed = joined.select(*by, "id", "score", "worth", "unit", *names)
    kinds = ", ".join(f"{c} {t}" for c, t in rows.select(*by).dtypes)
    back = needed.mapInArrow(others, f"{kinds}, {sums}").groupBy(*by, "place").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    back = first.select(*by, "place", F.col("id").alias("own")).join(back, [*by, "place"]).select("own", F.col("g").alias("add_g"), F.col("h").alias("add_h"))
    kept = [c for c in rows.columns if c not in ("worth",)]
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*kept).dtypes) + ", own_g double, own_h double"

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, h, _ = _pairs(batch, top)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(g.sum(1)), pa.array(h.sum(1))], names=[*kept, "own_g", "own_h"])

    mine = joined.mapInArrow(own, schema).join(back, F.col("id") == F.col("own"), "left")
    total = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0.0))
    return mine.select(*kept, total("own_g", "add_g").alias("g"), total("own_h", "add_h").alias("h"))


# --- bins and trees


def bin_edges(frame: DataFrame, columns: list[str], bins: int = 63) -> list[list[float]]:
    """Upper edges of each column's bins, near its quantiles: one pass, sketches are merged. A column without values has none."""
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    at = F.array(*(F.lit(k / bins) for k in range(1, bins)))
    row = frame.agg(*(F.percentile_approx(known(c), at, F.lit(20 * bins)).alias(f"q{k}") for k, c in enumerate(columns))).first()
    return [sorted(set(found or [])) for found in row]


def binned(values: np.ndarray, edges: list[float]) -> np.ndarray:
    """0 for a missing value, else 1 + how many edges lie below it."""
    return np.where(np.isnan(values), 0, np.searchsorted(edges, values, "left") + 1).astype(np.uint8)


def with_bins(frame: DataFrame, columns: list[str], edges: list[list[float]], keep: list[str]) -> DataFrame:
    """keep, and x: a byte for each column's bin."""
    schema = ", ".join(f"`{c}` {t}" for c, t in frame.select(*keep).dtypes) + ", x binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [binned(batch.column(len(keep) + k).to_numpy(zero_copy_only=False).astype(float), e) for k, e in enumerate(edges)]
            rows = np.ascontiguousarray(np.stack(each, 1))
            packed = pa.array([r.tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], packed], names=[*keep, "x"])

    return frame.select(*keep, *(F.col(c).cast("double").alias(f"_c{k}") for k, c in enumerate(columns))).mapInArrow(run, schema)


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), np.uint8).reshape(-1, width)


@dataclass
class Tree:
    """Nodes in arrays; a leaf has feature -1. A row goes left if its bin is at most `cut`, or is missing where `missing_left`."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, cut: int, missing_left: bool, gain: float, values: tuple[float, float]) -> None:
        self.feature[node], self.cut[node], self.missing_left[node], self.gain[node] = feature, cut, missing_left, gain
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for v in values:
            for name, x in (("feature", -1), ("cut", 0), ("missing_left", False), ("left", 0), ("right", 0), ("value", v), ("gain", 0.0), ("depth", self.depth[node] + 1)):
                getattr(self, name).append(x)

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        """The node each row (its bins) ends in."""
        feature, cut, missing, left, right = (np.array(x) for x in (self.feature, self.cut, self.missing_left, self.left, self.right))
        node = np.zeros(len(bins), np.int64)
        for _ in range(max(self.depth)):
            at = np.flatnonzero(feature[node] >= 0)
            here = node[at]
            b = bins[at, feature[here]]
            node[at] = np.where(np.where(b == 0, missing[here], b <= cut[here]), left[here], right[here])
        return node

    def pruned(self, chosen: set[int]) -> Tree:
        """The tree with the chosen nodes' splits alone."""
        out, queue = Tree(), [(0, 0)]
        out.value[0] = self.value[0]
        while queue:
            old, new = queue.pop(0)
            if old in chosen:
                children = self.left[old], self.right[old]
                out.split(new, self.feature[old], self.cut[old], self.missing_left[old], self.gain[old], (self.value[children[0]], self.value[children[1]]))
                queue += [(children[0], out.left[new]), (children[1], out.right[new])]
        return out


def histograms(rows: DataFrame, tree: Tree, nodes: list[int], features: list[int], width: int, bins: int) -> DataFrame:
    """Sums of g, h and rows by (node, feature, bin), for some nodes of a tree: each task adds up its rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = np.full(len(tree.feature), -1)
        slot[nodes] = np.arange(len(nodes))
        size = (len(nodes), len(features), bins)
        g, h, n = (np.zeros(np.prod(size), t) for t in (float, float, np.int64))
        for batch in batches:
            x = _matrix(batch, width)
            at = slot[tree.leaf(x)]
            own = at >= 0
            key = ((at[own, None] * len(features) + np.arange(len(features))) * bins + x[own][:, features]).ravel()
            for sums, name in ((g, "g"), (h, "h")):
                sums += np.bincount(key, np.repeat(batch.column(name).to_numpy()[own], len(features)), len(sums))
            n += np.bincount(key, minlength=len(n))
        some = np.flatnonzero(n)
        node, feature, b = np.unravel_index(some, size)
        columns = (np.array(nodes)[node], np.array(features)[feature], b)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns), pa.array(g[some]), pa.array(h[some]), pa.array(n[some])], names=["node", "feature", "bin", "g", "h", "n"])

    parts = rows.select("x", "g", "h").mapInArrow(run, SUMS)
    return parts.groupBy("node", "feature", "bin").agg(*(F.sum(c).alias(c) for c in "ghn"))


def best_splits(sums: DataFrame, least_rows: int, l2: float = 0.0) -> DataFrame:
    """The best split of each node: node, feature, bin, missing_left, gain, and g, h, n of both sides.

    Bins up to `bin` go left; bin 0, what is missing, goes where the gain is larger. Both sides have at least
    least_rows rows. Equal gains: the first feature, then bin, then missing values on the right. Nodes that nothing splits have no row.
    """
    known = F.col("bin") > 0
    w = Window.partitionBy("node", "feature")
    up = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = sums
    for c in "ghn":
        part = lambda condition, c=c: F.when(condition, F.col(c)).otherwise(0)
        out = out.withColumns({f"all_{c}": F.sum(c).over(w), f"gone_{c}": F.sum(part(~known)).over(w), f"up_{c}": F.sum(part(known)).over(up)})
    worth = lambda g, h: F.when(h + l2 > 0, g * g / (h + l2)).otherwise(0.0)
    sides = []
    for missing_left in (False, True):
        left = {c: F.col(f"up_{c}") + (F.col(f"gone_{c}") if missing_left else F.lit(0)) for c in "ghn"}
        right = {c: F.col(f"all_{c}") - left[c] for c in "ghn"}
        fits = (left["n"] >= least_rows) & (right["n"] >= least_rows) & (left["h"] >= LEAST_HESSIAN) & (right["h"] >= LEAST_HESSIAN)
        value = worth(left["g"], left["h"]) + worth(right["g"], right["h"]) - worth(F.col("all_g"), F.col("all_h"))
        pick = F.struct(F.when(fits, value).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), F.lit(int(not missing_left)).alias("r"), *(left[c].alias(f"left_{c}") for c in "ghn"), *(right[c].alias(f"right_{c}") for c in "ghn"))
        sides.append(pick)
    best = out.where(known).select("node", F.explode(F.array(*sides)).alias("s")).where(F.col("s.gain") > LEAST_GAIN).groupBy("node").agg(F.max("s").alias("s"))
    names = [f"{side}_{c}" for side in ("left", "right") for c in "ghn"]
    return best.select("node", (-F.col("s.f")).alias("feature"), (-F.col("s.b")).alias("bin"), (F.col("s.r") == 0).alias("missing_left"), "s.gain", *(f"s.{n}" for n in names))


def grow(rows: DataFrame, features: list[int], width: int, bins: int, leaves: int, depth: int, least_rows: int, rate: float = 1.0, l2: float = 0.0) -> Tree:
    """A tree grown best first: the leaf whose split gains most is split next, until there are `leaves` of them.

    rows: x, g, h. Each round finds the splits of all nodes that the best-first order may need, so there are about as many
    rounds as levels and the result is that of splitting one by one. depth <= 0 is no limit.
    """
    tree, asked, known = Tree(), [0], {}
    while True:
        found = {r.node: r for r in best_splits(histograms(rows, tree, asked, features, width, bins), least_rows, l2).collect()}  # a row a node
        for node in asked:
            known[node] = found.get(node)
            if s := known[node]:
                tree.split(node, s.feature, s.bin, s.missing_left, s.gain, (rate * s.left_g / (s.left_h + l2), rate * s.right_g / (s.right_h + l2)))
        open_, chosen, asked = {0}, set(), []
        while len(open_) < leaves and (split := [n for n in open_ if known.get(n)]):
            node = max(split, key=lambda n: (known[n].gain, -n))
            chosen.add(node)
            open_ = open_ - {node} | {tree.left[node], tree.right[node]}
            for child, n in ((tree.left[node], known[node].left_n), (tree.right[node], known[node].right_n)):
                if child not in known and n >= 2 * least_rows and (depth <= 0 or tree.depth[child] < depth):
                    asked.append(child)
        if not asked:
            return tree.pruned(chosen)


class RankTrees:
    """Boosted trees over columns: transform adds prediction, to be compared within a group."""

    def __init__(self, columns: list[str], edges: list[list[float]], trees: list[Tree]) -> None:
        self.columns, self.edges, self.trees = columns, edges, trees

    def transform(self, frame: DataFrame) -> DataFrame:
        edges, trees = self.edges, self.trees

        @F.pandas_udf("double")
        def predicted(values: pd.DataFrame) -> pd.Series:
            bins = np.stack([binned(values.iloc[:, k].to_numpy(float, na_value=np.nan), e) for k, e in enumerate(edges)], 1)
            return pd.Series(sum((np.array(t.value)[t.leaf(bins)] for t in trees), np.zeros(len(values))))

        return frame.withColumn("prediction", predicted(F.struct(*(F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(self.columns)))))

    def importances(self) -> np.ndarray:
        """Each column's share of the gains of all splits."""
        out = np.zeros(len(self.columns))
        for t in self.trees:
            for f, x in zip(t.feature, t.gain):
                if f >= 0:
                    out[f] += x
        return out / (out.sum() or 1.0)

    def save(self, spark: SparkSession, path: str) -> None:
        """A JSON line for the bins and one for each tree, in order."""
        lines = [(-1, json.dumps({"columns": self.columns, "edges": self.edges})), *((k, json.dumps(vars(t))) for k, t in enumerate(self.trees))]
        spark.createDataFrame(lines, "place int, body string").coalesce(1).write.mode("overwrite").json(f"{path}/rank_trees")

    @staticmethod
    def load(spark: SparkSession, path: str) -> RankTrees:
        about, *trees = (json.loads(r.body) for r in spark.read.schema("place int, body string").json(f"{path}/rank_trees").orderBy("place").collect())
        return RankTrees(about["columns"], about["edges"], [Tree(**t) for t in trees])


def _scored(rows: DataFrame, trees: list[Tree], width: int) -> DataFrame:
    """rows with the trees' values added to score."""
    if not trees:
        return rows
    at = rows.columns.index("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, width)
            more = sum(np.array(t.value)[t.leaf(x)] for t in trees)
            yield batch.set_column(at, "score", pa.array(batch.column(at).to_numpy() + more))

    return rows.mapInArrow(run, rows.schema)


def fit(
    frame: DataFrame, columns: list[str], trees: int, by: tuple[str, ...] = ("date",), rate: float = 0.05, leaves: int = 31, depth: int = 6, least_rows: int = 20, feature_fraction: float = 1.0, row_fraction: float = 1.0, row_every: int = 1,
    top: int = 30, bins: int = 63, l2: float = 0.0, seed: int = 7, validation: DataFrame | None = None, patience: int = 0, cut: int = 10,
) -> RankTrees:
    """Fit trees that order each group's rows by target_rank. frame: by, ticker, target_rank and columns.

    A column's missing values (null or NaN) have a bin of their own. For each tree a share of the columns is drawn, and every row_every
    trees a share of the rows; draws follow from (by, ticker, seed), not from how rows are dealt. validation and patience:
    stop when the NDCG at 10 of those rows hasn't grown for `patience` trees, and keep the trees up to the best.
    Scores are written every `cut` trees, which bounds what a lost task repeats; tables made on the way are deleted at the end.
    """
    if not 1 < bins < 255:
        raise ValueError("bins must be 2 to 254, to fit a byte with one for what is missing")
    groups, width = list(by), len(columns)
    with scratch(frame.sparkSession):
        frame = frame.withColumn("grade", relevance("target_rank"))
        edges = bin_edges(frame, columns, bins)
        rows = with_bins(frame, columns, edges, [*groups, "ticker", "grade"]).withColumn("id", F.monotonically_increasing_id())
        rows = staged(rows)  # ids stay as they are from here on
        rows = staged(with_ideal(rows, groups, top).withColumn("score", F.lit(0.0)))
        held = staged(with_bins(validation, columns, edges, [*groups, "ticker", "target_rank"]).withColumn("score", F.lit(0.0))) if validation is not None and patience else None
        grown, best, since, base, mark = [], (-1.0, 0), [], rows, 0
        for k in range(trees):
            chance = F.pmod(F.xxhash64(*groups, "ticker", F.lit(seed + k // max(row_every, 1))), F.lit(1 << 30)) / float(1 << 30)
            draw = np.random.default_rng(seed + k).permutation(width)[: max(1, round(feature_fraction * width))]
            now = _scored(base, since, width).persist(StorageLevel.MEMORY_AND_DISK)
            pulls = lambdas(now, groups, top)
            pulls = (pulls.where(chance < row_fraction) if row_fraction < 1 else pulls).select("x", "g", "h").persist(StorageLevel.MEMORY_AND_DISK)
            tree = grow(pulls, sorted(draw.tolist()), width, bins + 1, leaves, depth, least_rows, rate, l2)
            if len(since) + 1 == cut:
                base, since = staged(_scored(now, [tree], width)), []
            else:
                since = [*since, tree]
            pulls.unpersist()
            now.unpersist()
            grown.append(tree)
            if held is not None:
                held_now = _scored(held, grown[mark:], width)
                if len(grown) - mark == cut:
                    held, mark = staged(held_now), len(grown)
                    held_now = held
                reached = mt.ndcg(held_now, 10, by).agg(F.avg("ndcg_at_10")).first()[0] or 0.0
                best = max(best, (reached, -len(grown)))
                if len(grown) + best[1] >= patience:
                    break
    return RankTrees(columns, edges, grown[: -best[1]] if held is not None else grown)

"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors with cosine of at least t lie within eps = sqrt(2 - 2t) of each other. Vectors are
sorted by the cells of a grid over their leading principal dimensions, whose side is a share of eps,
and cut into tiles of short intervals. Pairs of tiles are joined recursively, and tiles, then
intervals within them, whose boxes are farther apart than eps in the grid's dimensions are skipped with all that they hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, materialize


def usable(embedding: Column) -> Column:
    """Whether a vector can link: not null, without null or non-finite components, not zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def principal_axes(vectors: DataFrame, dims: int, most_values: int = 2_000_000, most_rows: int = 20_000) -> tuple[dict[int, np.ndarray], int]:
    """Leading principal directions of unit vectors by length, fitted on a bounded sample, and the greatest length.

    The sample, rows with the smallest hashes, holds at most most_rows vectors and about most_values
    components. Axes only order and prune: whatever they are, no pair is lost.
    """
    widest = vectors.agg(F.max(F.size("embedding"))).first()[0] or 1
    rows = vectors.orderBy(F.xxhash64("vec_id")).limit(max(1, min(most_rows, most_values // widest))).select("embedding").collect()
    by_length: dict[int, list] = {}
    for (x,) in rows:
        by_length.setdefault(len(x), []).append(x)
    axes = {}
    for length, found in by_length.items():
        x = np.array(found, float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        _, directions = np.linalg.eigh(np.cov(x.T).reshape(length, length) if len(x) > 1 else np.eye(length))
        axes[length] = directions[:, ::-1][:, :dims]
    return axes, widest


def grid_ordered(vectors: DataFrame, axes: dict[int, np.ndarray], dims: int, side: float) -> DataFrame:
    """vec_id, packed components, length, cells and projections (both dims long; shorter vectors are padded with 0).

    Components are packed as they come, four bytes of a float and eight of a double, which loses nothing.
    """
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    kind = "<f4" if single else "<f8"

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, packed, lengths, cells, places = batch.column(0).to_pylist(), [], [], [], []
            for x in batch.column(1).to_pylist():
                x = np.array(x, float)
                axis = axes.get(len(x), np.eye(len(x))[:, :dims])
                y = np.zeros(dims)
                y[: axis.shape[1]] = (x / np.linalg.norm(x)) @ axis
                packed.append(x.astype(kind).tobytes())
                lengths.append(len(x))
                cells.append(np.floor(y / side).astype(int).tolist())
                places.append(y.tolist())
            columns = [pa.array(ids, pa.int64()), pa.array(packed, pa.binary()), pa.array(lengths, pa.int32()), pa.array(cells, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "packed", "length", "cells", "place"])

    return vectors.select("vec_id", "embedding").mapInArrow(project, "vec_id long, packed binary, length int, cells array<int>, place array<double>")


TILE = "tile long, length int, ids binary, packed binary, lows binary, highs binary, low array<double>, high array<double>"


def tiles_of(ordered: DataFrame, rows: int, interval: int, dims: int) -> DataFrame:
    """Tiles of the grid order, about `rows` vectors of one length each, with the boxes of their intervals and their own."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        t = pa.Table.from_batches(found).to_pandas()
        for length, own in t.groupby("length", sort=True):
            cells, place = np.stack(own["cells"].to_list()), np.stack(own["place"].to_list())
            order = np.lexsort(np.concatenate([place, cells], axis=1)[:, ::-1].T)
            place, starts = place[order], np.arange(0, len(place), interval)
            lows, highs = np.minimum.reduceat(place, starts), np.maximum.reduceat(place, starts)
            packed = own["packed"].to_numpy()[order]
            columns = [TaskContext.get().partitionId(), length, own["vec_id"].to_numpy(np.int64)[order].tobytes(), b"".join(packed), lows.tobytes(), highs.tobytes(), lows.min(0).tolist(), highs.max(0).tolist()]
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4, *[pa.list_(pa.float64())] * 2]
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, kinds)], names=["tile", "length", "ids", "packed", "lows", "highs", "low", "high"])

    n = max(1, -(-ordered.count() // rows))
    order = ["length", *(F.col("cells")[k] for k in range(dims)), *(F.col("place")[k] for k in range(dims)), "vec_id"]
    return ordered.repartitionByRange(n, *order).mapInArrow(pack, TILE)


def gap(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """Square of the least distance between two boxes."""
    apart = F.zip_with(F.arrays_zip(low_a.alias("l"), high_a.alias("h")), F.arrays_zip(low_b.alias("l"), high_b.alias("h")), lambda a, b: F.greatest(a["l"] - b["h"], b["l"] - a["h"], F.lit(0.0)))
    return F.aggregate(apart, F.lit(0.0), lambda s, x: s + x * x)


def interval_pairs(boxes: DataFrame, dims: int, eps: float, fan: int) -> DataFrame:
    """Pairs (a, b), a <= b, of tiles whose boxes are within eps, found from the whole sequence downwards.

    boxes: tile, low, high. Each level joins the children of the pairs that are left, by their numbers.
    """

    def coarser(level: DataFrame) -> DataFrame:
        ends = [f(F.col(c)[k]).alias(f"{c}{k}") for c, f in (("low", F.min), ("high", F.max)) for k in range(dims)]
        up = level.groupBy(F.floor(F.col("tile") / fan).cast("long").alias("tile")).agg(*ends)
        return up.select("tile", *(F.array(*(f"{c}{k}" for k in range(dims))).alias(c) for c in ("low", "high")))

    levels, last = [boxes], boxes.agg(F.max("tile")).first()[0] or 0
    while last > 0:
        levels.append(coarser(levels[-1]))
        last //= fan
    pairs = levels[-1].select(F.col("tile").alias("a"), F.col("tile").alias("b"))
    for level in levels[-2::-1]:
        a, b = (level.select(F.col("tile").alias(x), F.col("low").alias(f"low_{x}"), F.col("high").alias(f"high_{x}")) for x in "ab")
        child = lambda x: F.explode(F.sequence(F.col(x) * fan, F.col(x) * fan + fan - 1))
        pairs = pairs.select(child("a").alias("a"), "b").select("a", child("b").alias("b")).where("a <= b")
        pairs = pairs.join(a, "a").join(b, "b").where(gap(F.col("low_a"), F.col("high_a"), F.col("low_b"), F.col("high_b")) <= eps * eps).select("a", "b")
    return pairs


def near_intervals(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray, eps: float) -> np.ndarray:
    """Which of the boxes (lows, highs) are within eps of the box (low, high)."""
    apart = np.maximum(0, np.maximum(low - highs, lows - high))
    return (apart**2).sum(1) <= eps * eps


def join_tiles(tiles: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]], same: bool, threshold: float, eps: float, interval: int):
    """Links between two tiles (or within one): ids, links of each, smallest linked id, and how many pairs of intervals there were and were skipped.

    tiles: (side, length, ids, unit vectors, lows, highs). An interval is joined with all those of the other
    side that are near it in one product of matrices, so memory is bounded; of the links only counts and labels are kept.
    """
    starts = np.cumsum([0] + [len(t[2]) for t in tiles])
    ids = np.concatenate([t[2] for t in tiles])
    links, label, pairs, skipped = np.zeros(len(ids), np.int64), np.arange(len(ids)), 0, 0
    for p, (side, length, _, x, lows, highs) in enumerate(tiles):
        for q, (side2, length2, _, y, lows2, highs2) in enumerate(tiles):
            if length != length2 or (side, side2) != (0, 1 - same) or same and q < p:
                continue
            for k in range(len(lows)):
                near = near_intervals(lows[k], highs[k], lows2, highs2, eps)
                if p == q:
                    near[:k] = False
                pairs, skipped = pairs + len(near) - k * (p == q), skipped + int((~near[k if p == q else 0 :]).sum())
                at = np.flatnonzero(np.repeat(near, interval)[: len(y)])
                if not at.size:
                    continue
                u, v = np.nonzero(x[k * interval : (k + 1) * interval] @ (y if at.size == len(y) else y[at]).T >= threshold)
                u, v = u + starts[p] + k * interval, at[v] + starts[q]
                other = (ids[u] != ids[v]) & ((u < v) if p == q else True)
                u, v = u[other], v[other]
                if u.size:
                    links += np.bincount(u, minlength=len(ids)) + np.bincount(v, minlength=len(ids))
                    label = _relabel(label, u, v)
    at = np.flatnonzero(links)
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    return ids[at], links[at], least[label[at]], pairs, skipped


def _relabel(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    while True:
        a, b = label[u], label[v]
        if (a == b).all():
            return label
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]


def similar_vectors(vectors: DataFrame, threshold: float = 0.95, dims: int = 8, rows: int = 8192, interval: int = 64, fan: int = 8, fineness: float = 0.5, most_mb: int = 64) -> DataFrame:
    """Links and connected components of vectors by cosine of at least threshold, in double precision.

    vectors: vec_id, embedding; other columns are ignored. One row per row: vec_id, n_links (vectors with another vec_id linked
    directly), component_id (smallest vec_id reachable), kept (vec_id = component_id). Vectors that are
    null, zero or hold null or non-finite components, and rows without a vec_id, link with nothing; so do
    vectors of different lengths with each other. Equal rows count as one vector; an empty table stays empty. Links are never
    listed: a group of n near copies gives n rows for each pair of tiles, not n squared.

    Cells have a side of fineness times eps. A tile is a task's worth of the order: `rows` vectors, fewer where they would take more than
    most_mb. Only tiles are dealt to tasks; within a pair of them, intervals are skipped by their own boxes.
    """
    found = tile_links(vectors, threshold, dims, rows, interval, fan, fineness, most_mb).where("vec_id is not null")
    n_links = found.groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    components = connected_components(found.select("vec_id", "least")).select(F.col("node").alias("vec_id"), "component")
    out = vectors.select(F.col("vec_id").cast("long")).join(n_links, "vec_id", "left").join(components, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def tile_links(vectors: DataFrame, threshold: float, dims: int, rows: int, interval: int, fan: int, fineness: float, most_mb: int) -> DataFrame:
    """vec_id, links and least linked id for each pair of tiles, and a row without vec_id that tells how many pairs of intervals it had and skipped."""
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9
    element = vectors.schema["embedding"].dataType.elementType.typeName()
    kind = "array<float>" if element == "float" else "array<double>"
    good = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind)).where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).dropDuplicates(["vec_id", "embedding"])
    axes, widest = principal_axes(good, dims)
    ordered = materialize(grid_ordered(good, axes, dims, eps * fineness))
    tiles = materialize(tiles_of(ordered, max(interval, min(rows, (most_mb << 20) // (8 * widest))), interval, dims))
    ends = [f(F.col(c)[k]).alias(f"{c}{k}") for c, f in (("low", F.min), ("high", F.max)) for k in range(dims)]
    boxes = tiles.groupBy("tile").agg(*ends).select("tile", *(F.array(*(f"{c}{k}" for k in range(dims))).alias(c) for c in ("low", "high")))
    pairs = interval_pairs(boxes, dims, eps, fan)
    sides = pairs.select("a", "b", F.explode(F.when(F.col("a") == F.col("b"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
    sides = sides.withColumn("tile", F.when(F.col("side") == 0, F.col("a")).otherwise(F.col("b")))
    packed_as = "<f4" if kind == "array<float>" else "<f8"

    def join(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        own = []
        for r in sorted(t.to_pylist(), key=lambda r: (r["side"], r["length"])):
            x = np.frombuffer(r["packed"], packed_as).reshape(-1, r["length"]).astype(float)
            boxes = (np.frombuffer(r[c]).reshape(-1, dims) for c in ("lows", "highs"))
            own.append((r["side"], r["length"], np.frombuffer(r["ids"], np.int64), x / np.linalg.norm(x, axis=1, keepdims=True), *boxes))
        ids, links, least, pairs, skipped = join_tiles(own, key[0].as_py() == key[1].as_py(), threshold, eps, interval)
        tell = [(int(i), int(n), int(m), None, None) for i, n, m in zip(ids, links, least)] + [(None, None, None, pairs, skipped)]
        return pa.table([pa.array(list(c), pa.int64()) for c in zip(*tell)], names=["vec_id", "links", "least", "pairs", "skipped"])

    found = sides.join(tiles.drop("low", "high"), "tile").groupBy("a", "b").applyInArrow(join, "vec_id long, links long, least long, pairs long, skipped long")
    return materialize(found)

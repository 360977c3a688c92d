"""Best-fit packing of tokenised documents after dominance reduction.

Sizes are whole numbers up to the capacity, so an instance is a histogram of at most `capacity`
counts. That histogram, not the documents, is what the driver reduces and packs; the plan it gives
back is a bounded list of slots, each saying where pieces of one size and a range of ranks go.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize
from tessera.llm.vocab import byte_encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part int, nth long"


def tokenize_pieces(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, capacity: int = 1024, keep_ids: bool = False) -> DataFrame:
    """Token ids of whole texts, each document closed by end_id and cut to the capacity.

    docs: doc_id, text (null: empty); other columns are ignored. A document of more than `capacity`
    tokens is cut so that only its first piece may be short. One row per piece: where it starts in
    its document, its length, the CRC-32 of its little-endian 32-bit ids, the ids where keep_ids is
    set (else null), and (part, nth): the task that made it and its number there among pieces of its length.
    Repeated rows are packed as often as they occur; an empty table gives no piece.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(vocabulary)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), end_id], "<u4").tobytes()
                n = len(ids) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
                    piece = ids[4 * lo : 4 * hi]
                    rows.append((doc_id, k, lo, hi - lo, zlib.crc32(piece), piece if keep_ids else None, part, int(seen[hi - lo])))
                    seen[hi - lo] += 1
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids", "part", "nth")
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(names))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def reduce_by_dominance(counts: np.ndarray) -> list[tuple[int, list[int]]]:
    """Fix the sets that dominate every other set with their first item; counts loses what is fixed.

    counts[s]: how many items have size s, capacity = len(counts) - 1. A set dominates another if the
    other can be parted into groups, each no larger than an item of the first of its own: then some
    optimal packing uses it. For an item of size s with room r beside it, let j be the largest item
    that fits in r:
    - nothing fits: the item alone;
    - j fills r, or two further items never fit: the item and j;
    - three never fit, and j is at least the best sum of two: the item and j;
    - three never fit, j with some b fills r, and no size lies between b and j: the item, j and b.
    Sets are returned as (how often, sizes).
    """
    capacity, fixed, changed = len(counts) - 1, [], True
    while changed:
        changed = False
        for s in range(capacity, 0, -1):
            while counts[s]:
                times, chosen = _dominating(counts, s, capacity - s)
                if not times:
                    break
                for x in chosen:
                    counts[x] -= times
                fixed.append((times, chosen))
                changed = True
    return fixed


def _dominating(counts: np.ndarray, s: int, room: int) -> tuple[int, list[int]]:
    counts[s] -= 1  # the item itself is not there to be put beside it
    try:
        here = np.flatnonzero(counts[: room + 1])
        if not here.size:
            return (int(counts[s]) + 1 if s > room else 1), [s]
        j = int(here[-1])
        pairs = (int(counts[s]) + 1) // 2 if j == s else min(int(counts[s]) + 1, int(counts[j]))
        low = np.repeat(here[:3], np.minimum(counts[here[:3]], 3))[:3]
        if j == room or low.size < 2 or low[0] + low[1] > room:
            return pairs, [s, j]
        if low.size > 2 and low.sum() <= room:
            return 0, []
        best, lo, hi = 0, 0, here.size - 1  # the best sum of two that fits
        while lo <= hi:
            total = int(here[lo] + here[hi])
            if total > room or lo == hi and counts[here[lo]] < 2:
                hi -= 1
            else:
                best, lo = max(best, total), lo + 1
        if j >= best:
            return pairs, [s, j]
        b = room - j
        if best == room and b > 0 and counts[b] > (b == j) and not counts[b + 1 : j].any():
            chosen = [s, j, b]
            return min((int(counts[x]) + (x == s)) // chosen.count(x) for x in chosen), chosen
        return 0, []
    finally:
        counts[s] += 1


def best_fit(counts: np.ndarray) -> list[tuple[int, list[int]]]:
    """Best-fit decreasing over counts: like items go to like bins in one step. Bins as (how often, sizes)."""
    capacity = len(counts) - 1
    open_bins: dict[int, list[tuple[int, list[int]]]] = {}
    for s in range(capacity, 0, -1):
        left = int(counts[s])
        for room in [r for r in sorted(open_bins) if r >= s]:
            groups, fill = open_bins.pop(room), room // s
            while groups and left:
                times, sizes = groups.pop()
                whole = min(times, left // fill)
                for n, k in ((whole, fill), (1 if whole < times and left - whole * fill else 0, min(fill, left - whole * fill))):
                    if n:
                        open_bins.setdefault(room - k * s, []).append((n, sizes + [s] * k))
                        left, times = left - n * k, times - n
                if times:
                    groups.append((times, sizes))
            if groups:
                open_bins.setdefault(room, []).extend(groups)
            if not left:
                break
        if left:
            fill = capacity // s
            for n, k in ((left // fill, fill), (1, left % fill)):
                if n and k:
                    open_bins.setdefault(capacity - k * s, []).append((n, [s] * k))
    return [g for groups in open_bins.values() for g in groups]


def slots_of(bins: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (size, first rank, times, first sequence, offset): the pieces of a size, by rank, in turn."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for times, sizes in bins:
        offset = 0
        for s in sizes:
            rows.append((s, rank.get(s, 0), times, sequence, offset))
            rank[s] = rank.get(s, 0) + times
            offset += s
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, capacity: int = 1024, keep_ids: bool = False) -> DataFrame:
    """Pack whole documents into few sequences of at most `capacity` tokens.

    Pieces as in tokenize_pieces, with sequence_id and offset: sequences are filled without a gap
    from 0. Pieces of one size are told apart by rank only, (task, number in the task), so a size
    that holds a third of all pieces is ranked from counts by task, never sorted in one.
    """
    pieces = materialize(tokenize_pieces(docs, vocabulary, end_id, capacity, keep_ids))
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # capacity rows at most
        counts[length] = n
    slots = slots_of(reduce_by_dominance(counts) + best_fit(counts))
    shared = pieces.sparkSession.sparkContext.broadcast(slots)  # grows with the capacity, not with the data

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, first, _, sequence, offset = shared.value.T
        wide = int(first.max(initial=0)) + 1
        keys = size.astype(object) * wide + first if (capacity + 1) * wide > 2**62 else size * wide + first
        for batch in batches:
            t = pa.Table.from_batches([batch])
            length, rank = (t[c].to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length * wide + np.minimum(rank, wide - 1), "right") - 1
            out = t.drop_columns(["rank"]).append_column("sequence_id", pa.array(sequence[at] + rank - first[at], pa.int64())).append_column("offset", pa.array(offset[at], pa.int64()))
            yield from out.to_batches()

    ranked = pieces.join(firsts, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", "ids", (F.col("first") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long")

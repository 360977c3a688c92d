"""Runs of repeated word sequences within a text, found by matching blocks of power-of-two length.

A run with period q that is long enough holds an aligned block of B words, B the largest power of two
up to q (8 for smaller periods), and q words later the same block again. So for each B the aligned
blocks are searched through the whole text by one automaton over word numbers, an occurrence B to
2B - 1 words after a block (1 to 15 for B = 8) is a seed, and seeds are extended both ways.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The shortest run, the times that its period must fit, and the words of the smallest block.
LEAST, TIMES, SMALLEST = 24, 3, 8
RUN = "struct<start: long, length: long, period: long>"
RUNS = f"doc_id long, n_runs long, runs array<{RUN}>, strongest {RUN}, collapsed string"
#: Multiplier of the rolling hash and seeds that are extended together.
STEP, TOGETHER = 0x9E3779B97F4A7C15, 1 << 20
#: The largest number that is searched for as it is.
RADIX = 1 << 12


def numbered(words: list[str]) -> np.ndarray:
    numbers: dict[str, int] = {}
    return np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)


def search(sequence: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where rows of keys lie in a sequence of whole numbers: ends of matches, in order, and the first equal row of each."""
    if max(sequence.max(initial=0), keys.max(initial=0)) > RADIX:  # two digits a number: a node's branches are looked through one by one
        ends, which = search(_digits(sequence), _digits(keys))
        return ends // 2, which
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for i, key in enumerate(map(tuple, keys.tolist())):
        if key not in automaton:
            automaton.add_word(key, i)
    automaton.make_automaton()
    found = np.array(list(automaton.iter(tuple(sequence.tolist()))), np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def _digits(numbers: np.ndarray) -> np.ndarray:
    half = RADIX // 2  # a first digit is never less, a second one always is
    return np.stack([numbers // half + half, numbers % half], -1).reshape(*numbers.shape[:-1], -1)


def occurrences(names: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """For each word, the number of the block of `size` words (from starts) that lies there, or -1.

    names: the words' numbers where size is SMALLEST, else what this gave for half the size: a block is
    then two names, and words half a block apart stand beside each other in what is searched.
    """
    out = np.full(len(names), -1, np.int64)
    if size == SMALLEST:
        ends, which = search(names, names[starts[:, None] + np.arange(size)])
        out[ends - size + 1] = which
        return out
    half = size // 2
    rows = -(-len(names) // half)
    laid = np.full((rows + 1) * half, -1, np.int64)
    laid[: len(names)] = names
    laid, at = laid.reshape(-1, half).T.ravel(), np.arange(len(laid)).reshape(-1, half).T.ravel()
    used = np.flatnonzero((laid >= 0) | np.r_[False, laid[:-1] >= 0])  # names, and a gap after each stretch of them
    ends, which = search(laid[used] + 1, names[starts[:, None] + np.array([0, half])] + 1)
    out[at[used[ends - 1]]] = which
    return out


def seeds_of_scale(block: np.ndarray, starts: np.ndarray, wanted: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds (place, distance) of the wanted blocks at starts, and whether each block at starts occurs anywhere else."""
    wide, places = len(block) + 2 * size, np.flatnonzero(block >= 0)
    places = np.sort(block[places] * wide + places)
    own = block[starts] * wide
    again = np.searchsorted(places, own + wide) - np.searchsorted(places, own) > 1
    starts, own = starts[wanted], own[wanted]
    near, far = (1, 2 * SMALLEST - 1) if size == SMALLEST else (size, 2 * size - 1)
    lo, hi = np.searchsorted(places, own + starts + near), np.searchsorted(places, own + starts + far, "right")
    n = hi - lo
    which = np.repeat(np.arange(len(starts)), n)
    at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + lo[which]
    return starts[which], places[at] - own[which] - starts[which], again


class Reach:
    """How far two places of a sequence agree, by prefix hashes: never too short; too far only where hashes collide."""

    def __init__(self, numbers: np.ndarray) -> None:
        n = len(numbers)
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(n, STEP, np.uint64)], dtype=np.uint64)
            mixed = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(29)
            back = np.cumprod(np.full(n, pow(STEP, -1, 1 << 64), np.uint64), dtype=np.uint64)
            self.prefix = np.r_[np.uint64(0), np.cumsum(mixed * back, dtype=np.uint64)] * self.powers  # of word i: mixed * STEP ** (end - i - 1)
        self.n = n

    def hashed(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.prefix[start + size] - self.prefix[start] * self.powers[size]

    def longest(self, most: np.ndarray, same) -> np.ndarray:
        """For each pair the largest size up to `most` for which same(size) holds, as it does for all smaller ones."""
        lo, step = np.zeros(len(most), np.int64), 1 << int(most.max(initial=0)).bit_length()
        while step:
            size = lo + step
            good = size <= most
            good &= same(np.where(good, size, 0))
            lo[good] += step
            step >>= 1
        return lo

    def stretch(self, at: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The stretch of words around each place that equal the word `apart` before them: start and length, the first period included."""
        there = at + apart
        ahead = self.longest(self.n - there, lambda k: self.hashed(at, k) == self.hashed(there, k))
        behind = self.longest(at, lambda k: self.hashed(at - k, k) == self.hashed(there - k, k))
        return at - behind, behind + ahead + apart


def _exact_stretch(numbers: np.ndarray, at: int, apart: int) -> tuple[int, int]:
    lo, hi, n = at, at + apart, len(numbers)
    while lo and numbers[lo - 1] == numbers[lo - 1 + apart]:
        lo -= 1
    while hi < n and numbers[hi] == numbers[hi - apart]:
        hi += 1
    return lo, hi - lo


def find_runs(words: list[str]) -> np.ndarray:
    """All runs of a text's words: rows (start, length, period) by start, then period."""
    numbers = numbered(words)
    n, found = len(numbers), np.zeros((0, 3), np.int64)
    if n < LEAST:
        return found
    reach, names, size = None, numbers, SMALLEST
    starts = np.arange(0, n - size + 1, size)
    deep = np.zeros(len(starts), bool)
    while len(starts) and (size == SMALLEST or TIMES * size <= n):
        names = occurrences(names, starts, size)
        place, apart, again = seeds_of_scale(names, starts, ~deep, size)
        for lo in range(0, len(place), TOGETHER):
            reach = reach or Reach(numbers)
            found = _merge(numbers, found, reach, place[lo : lo + TOGETHER], apart[lo : lo + TOGETHER])
        # a larger block that comes again has both halves come again
        have = np.zeros(n // size + 2, bool)
        have[starts[again] // size] = True
        size *= 2
        starts = np.arange(0, n - size + 1, size)
        starts = starts[have[2 * (starts // size)] & have[2 * (starts // size) + 1]]
        # one deep within a run of a smaller period seeds that run only
        runs, inside = found[(found[:, 2] <= size) & (found[:, 1] >= 3 * size)], np.zeros(n + 1, np.int64)
        np.add.at(inside, runs[:, 0], 1)
        np.add.at(inside, runs[:, 0] + runs[:, 1] - 3 * size + 1, -1)
        deep = np.cumsum(inside)[starts] > 0
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _merge(numbers: np.ndarray, found: np.ndarray, reach: Reach, place: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """found with the runs of some seeds: of stretches with one start and length, the smallest period counts."""
    start, length = reach.stretch(place, apart)
    long = length >= np.maximum(LEAST, TIMES * apart)
    rows, which = np.unique(np.c_[start, length, apart][long], axis=0, return_inverse=True)
    known = {(s, k): q for s, k, q in found.tolist()}
    for i, (s, k, q) in enumerate(rows.tolist()):
        if (s, k) in known and q % known[s, k] == 0:
            continue
        if np.array_equal(numbers[s : s + k - q], numbers[s + q : s + k]):
            known[s, k] = min(q, known.get((s, k), q))
            continue
        for at in place[long][which.ravel() == i].tolist():  # hashes collided
            s, k = _exact_stretch(numbers, at, q)
            if k >= max(LEAST, TIMES * q):
                known[s, k] = min(q, known.get((s, k), q))
    return np.array([(s, k, q) for (s, k), q in known.items()], np.int64).reshape(-1, 3)


def collapse(words: list[str], runs: np.ndarray) -> list[str]:
    """The words without those that some run holds after its first period."""
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return [w for w, k in zip(words, np.cumsum(edges).tolist()) if not k] if len(runs) else words


def strongest(runs: np.ndarray) -> list[int] | None:
    """The run with the greatest length over period, exactly; of equal ones the first, then that of the smallest period."""
    best = None
    for row in runs.tolist():  # by start, then period
        if best is None or row[1] * best[2] > best[1] * row[2]:
            best = row
    return best


def periodic_runs(docs: DataFrame) -> DataFrame:
    """The runs of every whole text: one row per row of docs.

    docs: doc_id, text; other columns are ignored, whatever their names. Words are what lies between
    spaces and U+0009 to U+000D. A run is a stretch of words with smallest period q, at least
    max(24, 3 q) long, that neither neighbour extends with that period. runs: (start, length, period)
    by start, then period; strongest: the run of the greatest length / period (ties: first, then
    smallest period), null without a run; collapsed: the words less those that a run holds after its
    first q, joined by one space. A null or empty text has no words, no runs and an empty collapsed
    text; a null doc_id stays null; repeated rows each give a row; an empty table gives none.
    A text of n words takes about n log n time, and memory for one scale's blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("runs", pa.list_(kind)), ("strongest", kind), ("collapsed", pa.string())])
        for batch in batches:
            rows: list[dict] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = WORD.findall(text)
                runs = find_runs(words)
                named = [dict(zip(names, x)) for x in runs.tolist()]
                best = strongest(runs)
                rows.append({"doc_id": doc_id, "n_runs": len(runs), "runs": named, "strongest": best and dict(zip(names, best)), "collapsed": " ".join(collapse(words, runs))})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    names = ("start", "length", "period")
    kind = pa.struct([(name, pa.int64()) for name in names])
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, RUNS)

"""Language identification by unigram pieces, summed over all segmentations of each word.

Each language has a probability for every piece of a fixed public vocabulary. A forward pass over a
word adds up the probabilities of all its segmentations; expectation-maximisation over the same
lattices learns the pieces' probabilities from labelled words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize
from tessera.llm.vocab import HashedPieces, byte_pieces

LETTERS = re.compile(r"[^\W\d_]+")  # letters, and numerals such as one half, superscript two or Roman four, which words_of cuts out
LONG = 64  # bytes from which a word's lattice is laid out by positions instead of with other words of its length


def words_of(text: str) -> list[str]:
    """Runs of letters, whole, in lower case.

    Only runs that hold a numeral are gone through by characters: a pattern that names the thousand numerals, most of them
    beyond the basic plane, tries them one by one on every letter of every text.
    """
    found = LETTERS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in ([run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]


@lru_cache(2)
def piece_table(path: str | None) -> HashedPieces:
    """The pieces that words in lower case can hold, in the vocabulary's order; every single byte is one."""
    keep = []
    for piece in sorted(byte_pieces(path), key=byte_pieces(path).get):
        text = piece.decode("utf-8", "ignore")
        if len(piece) == 1 or text == text.lower() and re.fullmatch(r" ?[^\W\d_]*", text):
            keep.append(piece)
    return HashedPieces(keep)


def spelled(word: str) -> bytes:
    return b" " + word.encode()


def stretches(word: bytes, path: str | None, size: int = 1 << 14) -> Iterator[tuple[int, np.ndarray]]:
    """Of a long word, in order: a position, and the numbers of the pieces that begin there and after it.

    The rows of the array are positions, up to `size` of them; column k has the piece of k + 1 bytes that begins there, or -1.
    """
    table, chars = piece_table(path), np.frombuffer(word, np.uint8).astype(np.uint64)
    for lo in range(0, len(chars), size):
        hi = min(lo + size, len(chars))
        numbers, h = np.full((hi - lo, table.longest), -1, np.int64), np.zeros(hi - lo, np.uint64)
        for k in range(table.longest):
            inside = max(0, min(hi, len(chars) - k) - lo)
            h[:inside] = table.extend(h[:inside], chars[lo + k : lo + k + inside])
            numbers[:inside, k] = table.find(h[:inside])
        yield lo, numbers


def long_forward(word: bytes, prob: np.ndarray, path: str | None, keep: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probability of a long word in each language, over all its segmentations.

    Sums of the positions within a piece's length are carried on, scaled by the largest. keep: also
    every position's scaled sum and the log of its scale, one row each.
    """
    longest, languages = piece_table(path).longest, prob.shape[1]
    ahead = np.zeros((longest + 1, languages))  # scaled sums of the positions from here on
    ahead[0] = 1
    shift = np.zeros(languages)
    sums, shifts = (np.zeros((len(word) + 1, languages) if keep else (0, languages)) for _ in range(2))
    for lo, numbers in stretches(word, path):
        for i, row in enumerate(numbers):
            if keep:
                sums[lo + i], shifts[lo + i] = ahead[0], shift
            k = np.flatnonzero(row >= 0)
            ahead[k + 1] += ahead[0] * prob[row[k]]
            ahead[:-1] = ahead[1:]
            ahead[-1] = 0
            if i % 16 == 15:
                top = ahead.max(0)
                ahead /= top
                shift = shift + np.log(top)
    if keep:
        sums[-1], shifts[-1] = ahead[0], shift
    return shift + np.log(ahead[0]), sums, shifts


def long_counts(word: bytes, weight: float, prob: np.ndarray, path: str | None) -> np.ndarray:
    """How often each piece is expected in a long word of one language (prob: one column)."""
    longest, n = piece_table(path).longest, len(word)
    whole, sums, shifts = long_forward(word, prob, path, keep=True)
    ahead, shift = np.zeros(longest + 1), 0.0  # scaled sums from the positions after this one to the end
    ahead[1] = 1
    total = np.zeros(len(prob))
    size = 1 << 14
    for lo in range((n - 1) // size * size, -1, -size):  # the last stretch first; a piece may reach beyond it
        _, numbers = next(stretches(word[lo : lo + size + longest], path, size))
        for i in range(len(numbers) - 1, -1, -1):
            row, at = numbers[i], lo + i
            k = np.flatnonzero(row >= 0)
            through = prob[row[k], 0] * ahead[k + 1]
            total[row[k]] += weight * through * sums[at, 0] * np.exp(shifts[at, 0] + shift - whole[0])
            ahead[1:] = np.append(through.sum(), ahead[1:-1])
            if at % 16 == 0:
                top = ahead.max()
                ahead /= top
                shift += np.log(top)
    return total


def lattices(words: list[str], path: str | None) -> Iterator[tuple[np.ndarray, int, dict[tuple[int, int], np.ndarray]]]:
    """For words of each length up to LONG bytes: their places in the list, the length, and arcs.

    arcs[i, j]: for each word the number of the piece that spells its bytes i to j, or -1. A word begins with a space.
    """
    table = piece_table(path)
    coded = [spelled(w) for w in words]
    sizes = np.array([len(w) for w in coded])
    for n in np.unique(sizes[sizes <= LONG]):
        at = np.flatnonzero(sizes == n)
        for at in np.array_split(at, -(-at.size * n // 100_000)):
            chars = np.frombuffer(b"".join(coded[i] for i in at), np.uint8).reshape(at.size, n).astype(np.uint64)
            arcs = {}
            for i in range(n):
                h = np.zeros(at.size, np.uint64)
                for j in range(i + 1, min(n, i + table.longest) + 1):
                    h = table.extend(h, chars[:, j - 1])
                    number = table.find(h)
                    if (number >= 0).any():
                        arcs[i, j] = number
            yield at, int(n), arcs


def forward(n: int, arcs: dict, prob: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Scaled sums over all segmentations of the first j bytes, (n + 1, words, languages), and the logs of their scales."""
    alpha = np.zeros((n + 1, size, prob.shape[1]))
    scale = np.zeros((n + 1, size, prob.shape[1]))
    alpha[0] = 1
    for j in range(1, n + 1):
        into = [(i, arcs[i, j]) for i in range(j) if (i, j) in arcs]
        top = np.max([scale[i] for i, _ in into], axis=0)
        for i, number in into:
            alpha[j] += alpha[i] * np.exp(scale[i] - top) * np.where((number >= 0)[:, None], prob[number], 0)
        scale[j] = top + np.log(alpha[j])
        alpha[j] = 1
    return alpha, scale


def word_scores(words: list[str], prob: np.ndarray, path: str | None) -> np.ndarray:
    """Log probability of each word in each language, over all its segmentations."""
    out = np.zeros((len(words), prob.shape[1]))
    for at, n, arcs in lattices(words, path):
        sums = [np.ones((at.size, prob.shape[1]))]
        shift = np.zeros((at.size, prob.shape[1]))
        for j in range(1, n + 1):
            now = np.zeros((at.size, prob.shape[1]))
            for i in range(j):
                if (i, j) in arcs:
                    now += sums[i] * prob[arcs[i, j]]
            sums.append(now)
            if j % 16 == 0:  # keep the sums within reach of a double
                top = now
                shift += np.log(top)
                sums = [x / top for x in sums]
        out[at] = shift + np.log(sums[n])
    for i, w in enumerate(map(spelled, words)):
        if len(w) > LONG:
            out[i] = long_forward(w, prob, path)[0]
    return out


def expected_counts(words: list[str], weights: np.ndarray, prob: np.ndarray, path: str | None) -> np.ndarray:
    """How often each piece is expected in the weighted words of one language (prob: one column)."""
    total = np.zeros(len(prob))
    for at, n, arcs in lattices(words, path):
        _, fore = forward(n, arcs, prob, at.size)
        back = np.full((n + 1, at.size), -np.inf)
        back[n] = 0
        whole = fore[n][:, 0]
        for i in range(n - 1, -1, -1):
            for j in range(i + 1, n + 1):
                if (i, j) in arcs:
                    number = arcs[i, j]
                    with np.errstate(divide="ignore"):
                        through = np.where(number >= 0, np.log(prob[number, 0]), -np.inf) + back[j]
                    share = np.exp(fore[i][:, 0] + through - whole) * weights[at]
                    total += np.bincount(number[number >= 0], share[number >= 0], len(total))
                    back[i] = np.logaddexp(back[i], through)
    for w, weight in zip(map(spelled, words), weights):
        if len(w) > LONG:
            total += long_counts(w, weight, prob, path)
    return total


def learn(train: DataFrame, per_language: int = 2000, rounds: int = 3, vocabulary: str | None = None) -> tuple[list[str], np.ndarray]:
    """Languages and the log-free piece probabilities (pieces + 1, languages), the last row zero for "no piece".

    train: text, lang; rows with a null in either, or without a letter, teach nothing. About per_language rows of each
    language are used, the same ones each time: those with the smallest hashes. Word counts and
    expected piece counts are summed by Spark; what the driver gets, pieces by languages, is bounded by the vocabulary.
    """
    train = train.where("text is not null and lang is not null").select("lang", "text", *[c for c in ("doc_id",) if c in train.columns])
    sizes = train.groupBy("lang").agg(F.count("*").alias("rows"))
    draw = F.pmod(F.xxhash64(F.lit(11), *[c for c in train.columns if c != "lang"]), F.lit(1 << 30)) / (1 << 30)
    chosen = train.join(F.broadcast(sizes), "lang").where(draw < per_language / F.col("rows")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.update((lang, w) for w in words_of(text))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(found.values(), pa.int64())], names=["lang", "word", "n"])

    counts = chosen.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = materialize(counts)
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    size = len(piece_table(vocabulary).hashes)
    prob = np.full((size + 1, len(languages)), 1 / size)
    prob[size] = 0
    for _ in range(rounds if languages else 0):
        shared = counts.sparkSession.sparkContext.broadcast(prob)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((size, len(languages)))
            for batch in batches:
                langs = np.array(batch.column(0).to_pylist(), object)
                words, weights = batch.column(1).to_pylist(), batch.column(2).to_numpy()
                for k, lang in enumerate(languages):
                    at = np.flatnonzero(langs == lang)
                    if at.size:
                        sums[:, k] += expected_counts([words[i] for i in at], weights[at].astype(float), shared.value[:, k : k + 1], vocabulary)[:size]
            piece, lang = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array(lang, pa.int64()), pa.array(sums[piece, lang])], names=["piece", "lang", "n"])

        found = counts.mapInArrow(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).collect()
        sums = np.full((size, len(languages)), 0.01)
        for piece, lang, n in found:
            sums[piece, lang] += n
        prob = np.vstack([sums / sums.sum(0), np.zeros((1, len(languages)))])
    return languages, prob


def predict(docs: DataFrame, languages: list[str], prob: np.ndarray, vocabulary: str | None = None, most_cached: int = 300_000) -> DataFrame:
    """docs with lang_pred and score, the posterior of that language under equal priors.

    A null text, one without a letter, or no learned language gives `und` and 0. Of languages with equal
    scores the first by name wins. Other columns stay, unless named like those added.
    """
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(prob)  # bounded by the vocabulary
    at = names.index("text")
    schema = docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)}).schema

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        table, prob = np.zeros((0, len(languages))), shared.value
        for batch in batches:
            preds, scores, column = [], [], batch.column(at)
            for lo in range(0, batch.num_rows, 256):  # a few texts' words at a time
                texts = [words_of(t) if t and languages else [] for t in column[lo : lo + 256].to_pylist()]
                if len(known) > most_cached:
                    known, table = {}, table[:0]
                fresh = [w for w in dict.fromkeys(w for t in texts for w in t) if w not in known]
                if fresh:
                    size = len(known) + len(fresh)
                    if size > len(table):
                        table = np.vstack([table[: len(known)], np.zeros((max(size, 2 * len(known)) - len(known), len(languages)))])
                    table[len(known) : size] = word_scores(fresh, prob, vocabulary)
                    known.update(zip(fresh, range(len(known), size)))
                for words in texts:
                    if not words:
                        preds.append("und")
                        scores.append(0.0)
                        continue
                    log = table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(0)
                    best = int(log.argmax())
                    preds.append(languages[best])
                    scores.append(float(1 / np.exp(log - log[best]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(label, schema)

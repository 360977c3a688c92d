"""N-best SentencePiece segmentation and decoding.

Pieces never run between characters that no piece has side by side, so a text is a chain of short links. In a
link, forward Viterbi scores are the exact heuristic of a backward A-star search over the piece
lattice; over the chain, only the n - 1 links that lose least by deviating can deviate in the n best.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.vocab import HashedPieces, sentencepiece_model

MARK = "▁"


class Lattice:
    """Pieces and scores of a model; characters that no piece spells fall back to their bytes."""

    def __init__(self, model) -> None:
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.pieces = {model.id_to_piece(i): i for i in plain}
        self.scores = {p: model.get_score(i) for p, i in self.pieces.items()}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.fallback = min(self.scores.values()) - 10
        spelled = {i: p.encode() for p, i in self.pieces.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        self.spelled = [spelled.get(i, b"") for i in range(size)]
        self.hashed = HashedPieces([list(map(ord, p)) for p in self.pieces])
        self.hashed_ids, self.hashed_scores = np.array([*self.pieces.values(), -1]), np.array([*map(self.scores.get, self.pieces), -np.inf])
        #: Score of a piece, None for what only begins pieces.
        self.begun = {p[:k]: None for p in self.pieces for k in range(1, len(p))} | self.scores
        #: Characters of longer pieces are numbered; joined tells which pairs are neighbours in one. Between others, every segmentation has a boundary.
        pairs = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        number = {c: k for k, c in enumerate(sorted(set("".join(pairs))), 1)}
        self.kinds = np.zeros(0x110000, np.int32)
        self.kinds[list(map(ord, number))] = list(number.values())
        self.joined = np.zeros((len(number) + 1,) * 2, bool)
        for a, b in pairs:
            self.joined[number[a], number[b]] = True

    def ids(self, piece: str) -> tuple[int, ...]:
        return (self.pieces[piece],) if piece in self.pieces else tuple(self.bytes[b] for b in piece.encode())

    def arcs(self, chunk: str) -> list[tuple[int, int, float]]:
        """(start, end, score) of every piece in chunk, by start."""
        n, begun, out = len(chunk), self.begun, []
        for i in range(n):
            if chunk[i] not in self.scores:
                out.append((i, i + 1, self.fallback))
            for j in range(i + 1, n + 1):
                s = begun.get(chunk[i:j], 1)
                if s is None:
                    continue
                if s == 1:  # no piece begins so: scores are 0 or below
                    break
                out.append((i, j, s))
        return out

    def viterbi(self, chunk: str) -> tuple[float, float, list[int]]:
        """Best score, what the second best loses against it (inf if there is none), and the best's boundaries."""
        n, low = len(chunk), -float("inf")
        if n == 1:
            return self.scores.get(chunk, self.fallback), float("inf"), [0, 1]
        arcs = self.arcs(chunk)
        fore, came = [low] * (n + 1), [0] * (n + 1)
        fore[0] = 0.0
        for i, j, s in arcs:
            total = fore[i] + s
            if total > fore[j]:
                fore[j], came[j] = total, i
        cuts, at = [n], n
        while at:
            at = came[at]
            cuts.append(at)
        cuts.reverse()
        best = [-1] * (n + 1)
        for i, j in zip(cuts, cuts[1:]):
            best[j] = i
        back, second = [low] * (n + 1), low
        back[n] = 0.0
        for i, j, s in reversed(arcs):
            after = s + back[j]
            if after > back[i]:
                back[i] = after
            if best[j] != i and fore[i] + after > second:
                second = fore[i] + after
        return fore[n], fore[n] - second, cuts

    def viterbi_alike(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For links of one length, rows of code points: best scores, losses of the second best, how many ids the best has, all ids."""
        m, n = codes.shape
        chars, low = codes.T.astype(np.uint64), -np.inf
        arcs: dict[tuple[int, int], np.ndarray] = {}
        for i in range(n):
            h = np.zeros(m, np.uint64)
            for j in range(i + 1, min(n, i + self.hashed.longest) + 1):
                h = self.hashed.extend(h, chars[j - 1])
                number = self.hashed.find(h)
                if j == i + 1 or (number >= 0).any():
                    arcs[i, j] = number
        scores = {at: self.hashed_scores[number] for at, number in arcs.items()}
        for i in range(n):
            scores[i, i + 1] = np.where(arcs[i, i + 1] < 0, self.fallback, scores[i, i + 1])
        fore, back = np.full((n + 1, m), low), np.full((n + 1, m), low)
        fore[0] = back[n] = 0
        came, piece = np.zeros((n + 1, m), np.int64), np.zeros((n + 1, m), np.int64)
        for (i, j), s in scores.items():
            total = fore[i] + s
            better = total > fore[j]
            fore[j] = np.where(better, total, fore[j])
            came[j] = np.where(better, i, came[j])
            piece[j] = np.where(better, arcs[i, j], piece[j])
        cut, every = np.zeros((n + 1, m), bool), np.arange(m)
        cut[n] = True
        for j in range(n, 0, -1):
            on = cut[j]
            cut[came[j][on], every[on]] = True
        second = np.full(m, low)
        for (i, j), s in reversed(scores.items()):
            after = s + back[j]
            back[i] = np.maximum(back[i], after)
            second = np.maximum(second, np.where(cut[j] & (came[j] == i), low, fore[i] + after))
        chosen, pieces = cut[1:].T, piece[1:].T
        counts, ids = chosen.sum(1), self.hashed_ids[pieces]
        if (odd := np.flatnonzero(((pieces < 0) & chosen).any(1))).size:  # characters that fall back to bytes
            spelled = [ids[k][chosen[k]] for k in range(m)]
            for k in odd:
                link = codes[k].astype("<u4").tobytes().decode("utf-32-le")
                spelled[k] = np.array(self.cut_ids(link, self.viterbi(link)[2]))
            return fore[n], fore[n] - second, np.array(list(map(len, spelled))), np.concatenate(spelled)
        return fore[n], fore[n] - second, counts, ids[chosen]

    def cut_ids(self, link: str, cuts: list[int]) -> list[int]:
        return [x for i, j in zip(cuts, cuts[1:]) for x in self.ids(link[i:j])]

    def nbest(self, chunk: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations as (score, boundaries), best first; ties by order of discovery."""
        fore: list[float] = [0.0] + [-float("inf")] * len(chunk)
        ending: list[list[tuple[int, float]]] = [[] for _ in fore]
        for i, j, s in self.arcs(chunk):
            fore[j] = max(fore[j], fore[i] + s)
            ending[j].append((i, s))
        agenda = [(-fore[-1], 0, len(chunk), 0.0, (len(chunk), None))]
        order, out = 1, []
        while agenda and len(out) < n:
            _, _, at, done, path = heapq.heappop(agenda)
            if at == 0:
                cuts = []
                while path:
                    cuts.append(path[0])
                    path = path[1]
                out.append((done, cuts))
                continue
            for i, s in ending[at]:
                heapq.heappush(agenda, (-(done + s + fore[i]), order, i, done + s, (i, path)))
                order += 1
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids spell, without the mark put before it."""
        text = b"".join(map(self.spelled.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


@lru_cache(2)
def lattice(path: str | None = None) -> Lattice:
    return Lattice(sentencepiece_model(path))


class Encoder:
    """N-best encoding of batches of texts; equal links of a batch are segmented once."""

    def __init__(self, n: int, path: str | None = None) -> None:
        self.n, self.lattice = n, lattice(path)
        self.alternatives = lru_cache(100_000)(lambda link: self._alternatives(link))

    def _alternatives(self, link: str) -> list[tuple[float, bytes]]:
        """What each of the n best segmentations of a link loses against the best, and its packed ids."""
        found = self.lattice.nbest(link, self.n)
        return [(found[0][0] - s, np.array(self.lattice.cut_ids(link, cuts), "<i4").tobytes()) for s, cuts in found]

    def encode_all(self, texts: list[str]) -> Iterator[list[tuple[float, bytes]]]:
        """(score, packed ids) of the n best segmentations of each whole text, best first."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        whole = "".join(marked)
        if not whole:
            yield from ([(0.0, b"")] for _ in texts)
            return
        codes = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        ends = np.cumsum(list(map(len, marked)))
        starts = np.ones(len(codes), bool)
        kind = self.lattice.kinds[codes]
        starts[1:] = ~self.lattice.joined[kind[:-1], kind[1:]]
        starts[ends[ends < len(codes)]] = True
        first = np.flatnonzero(starts)
        size = np.diff(np.append(first, len(codes)))
        number = np.zeros(len(first), np.int64)
        scores, losses, counts, ids = [], [], [], []
        known = 0
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            rows = codes[first[at][:, None] + np.arange(n)]
            h = np.zeros(len(at), np.uint64)
            for k in range(n):
                h = self.lattice.hashed.extend(h, rows[:, k])
            _, one, which = np.unique(h, return_index=True, return_inverse=True)
            number[at] = known + which
            known += len(one)
            if n > 64:
                links = [whole[f : f + n] for f in first[at[one]]]
                found = [self.lattice.viterbi(x) for x in links]
                spelled = [self.lattice.cut_ids(x, cuts) for x, (_, _, cuts) in zip(links, found)]
                parts = [f[0] for f in found], [f[1] for f in found], list(map(len, spelled)), list(chain.from_iterable(spelled))
            else:
                step = max(1, 400_000 // int(n))
                some = [self.lattice.viterbi_alike(rows[one[k : k + step]]) for k in range(0, len(one), step)]
                parts = tuple(np.concatenate(x) for x in zip(*some))
            for into, part in zip((scores, losses, counts, ids), parts):
                into.append(np.asarray(part))
        scores, losses, counts, ids = (np.concatenate(x) for x in (scores, losses, counts, ids))
        offset = np.cumsum(counts) - counts
        score, loss, count = scores[number], losses[number], counts[number]
        place = np.cumsum(count) - count
        packed = ids[np.repeat(offset[number] - place, count) + np.arange(count.sum())].astype("<i4").tobytes()
        bounds = [0, *np.searchsorted(first, ends).tolist()]
        for a, z in zip(bounds, bounds[1:]):
            if a == z:
                yield [(0.0, b"")]
                continue
            lo, hi = 4 * int(place[a]), 4 * int(place[z - 1] + count[z - 1])
            few = a + np.flatnonzero(np.isfinite(loss[a:z]))
            if few.size >= self.n:
                few = few[np.argsort(loss[few], kind="stable")[: self.n - 1]]
            choices: list[tuple[float, tuple]] = [(0.0, ())]  # loss, deviations in order
            for k in sorted(few.tolist()):
                options = self.alternatives(whole[first[k] : first[k] + size[k]])
                choices = heapq.nsmallest(self.n, [(x + lost, how + ((k, own),) if rank else how) for x, how in choices for rank, (lost, own) in enumerate(options)], key=lambda c: c[0])
            best, out = float(score[a:z].sum()), []
            for lost, how in choices:
                parts, at = [], lo
                for k, own in how:
                    parts += [packed[at : 4 * int(place[k])], own]
                    at = 4 * int(place[k] + count[k])
                out.append((best - lost, b"".join([*parts, packed[at:hi]])))
            yield out


def _in_runs(texts: list[str], most_chars: int = 2_000_000) -> Iterator[list[str]]:
    """texts in order, in lists of about most_chars characters."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= most_chars:
            yield run
            run, size = [], 0
    if run:
        yield run


RESULT = "doc_id long, n_pieces long, score double, ids_crc32 long, decoded boolean, nbest_scores array<double>, nbest_crc32 array<long>"


def nbest_encode(docs: DataFrame, n: int = 4, model: str | None = None, keep_ids: bool = False) -> DataFrame:
    """The n best segmentations of every whole text, and whether each decodes to the text again.

    docs: doc_id, text (null: empty); other columns are ignored. One row per row: pieces and score of
    the best, the CRC-32 of its little-endian 32-bit ids, `decoded` (all of the n best spell the text), and scores and
    CRC-32s of the n best in order; keep_ids adds nbest_ids, an array of arrays. An empty text has one
    segmentation, of no piece. Texts with fewer than n segmentations have fewer. Repeated rows are encoded alike.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(n, model)
        for batch in batches:
            rows = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            encoded = chain.from_iterable(map(encoder.encode_all, _in_runs(texts)))
            for doc_id, text, found in zip(batch.column(0).to_pylist(), texts, encoded):
                decoded = all(encoder.lattice.decode(np.frombuffer(ids, "<i4")) == text for _, ids in found)
                crcs = [zlib.crc32(ids) for _, ids in found]
                rows.append((doc_id, len(found[0][1]) // 4, found[0][0], crcs[0], decoded, [s for s, _ in found], crcs, [np.frombuffer(ids, "<i4").tolist() for _, ids in found] if keep_ids else None))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.bool_(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32()))]
            names = ["doc_id", "n_pieces", "score", "ids_crc32", "decoded", "nbest_scores", "nbest_crc32", "nbest_ids"][: 7 + keep_ids]
            columns = list(zip(*rows)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(columns[k], kinds[k]) for k in range(len(names))], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, RESULT + (", nbest_ids array<array<int>>" if keep_ids else ""))


def decode(encoded: DataFrame, ids: str = "ids", model: str | None = None) -> DataFrame:
    """encoded with `text`, what the ids in an array column spell; null ids give null, ids of no piece spell nothing."""
    encoded = encoded.drop("text")
    names, schema = encoded.columns, encoded.withColumn("text", F.lit("").cast("string")).schema
    schema["text"].nullable = True

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lattice(model)
        for batch in batches:
            texts = [None if x is None else known.decode(np.array(x, np.int64)) for x in batch.column(names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "text"])

    return encoded.mapInArrow(spell, schema)

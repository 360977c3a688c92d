"""Phrase collocations per language by counting phrases with suffix-sigma.

Every word begins a suffix of at most max_n words within its piece. Tasks add up equal suffixes
before they are shuffled by language and first word; a range of suffixes goes to a task, so that a
frequent first word spreads over several. Sorted reverse-lexicographically, all phrases with a common
beginning lie together and one stack a language counts them. Parts of phrases are joined to them afterwards.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

PIECE_END = re.compile(r"[.,;:!?\n-\r]")
#: Between words of a suffix: less than all that words hold (see escaped), so suffixes sort word by word.
GAP = "\0"
#: Distinct suffixes that a task adds up before it hands them on.
HELD = 300_000
#: Suffixes for each range, and documents, from which the ranges are found.
SAMPLE = 100
#: Parts of a language's candidates that are joined to its total, and ranked before the last ranking, apart.
GROUPS = 64


def escaped(text: str) -> str:
    """A text without U+0000: it and U+0001 become two characters each."""
    return text.replace("\1", "\1\2").replace(GAP, "\1\1") if GAP in text or "\1" in text else text


def plain(words: list[str]) -> str:
    """A phrase of escaped words, joined by spaces."""
    phrase = " ".join(words)
    return phrase.replace("\1\1", GAP).replace("\1\2", "\1") if "\1" in phrase else phrase


def suffixes(text: str, max_n: int) -> list[str]:
    """The suffixes of a text's pieces, cut to max_n words; A to Z are lower-cased, words part at spaces and tabs."""
    marked = PIECE_END.sub(" . ", escaped(text.encode().lower().decode()))  # a word can't hold the mark
    words = [w for w in marked.replace("\t", " ").split(" ") if w]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    marks = sizes == 1
    single = np.flatnonzero(marks)
    marks[single] = [words[i] == "." for i in single.tolist()]
    places = np.arange(len(words))
    stop = np.minimum.accumulate(np.where(marks, places, len(words))[::-1])[::-1]  # where a word's piece ends
    last = np.minimum(places + max_n, stop) - 1
    own = ~marks
    joined = GAP.join(words)
    return [joined[lo:hi] for lo, hi in zip((ends - sizes)[own].tolist(), ends[last[own]].tolist())]


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))


def range_cuts(docs: DataFrame, max_n: int, parts: int, seed: int = 7) -> list[tuple[str, str]]:
    """Up to parts - 1 (lang, suffix) that cut all suffixes into about equal ranges, from SAMPLE a range of some documents.

    They decide where a suffix is counted, not whether: a bad sample makes ranges uneven.
    """
    columns, wanted = _columns(docs), SAMPLE * parts
    share = min(1.0, wanted / max(columns.count(), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = random.Random(seed)
        for batch in batches:
            some = []
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(set(suffixes(text, max_n)))
                some += [(lang, x) for x in rng.sample(found, min(len(found), 1 + len(found) // 100))]
            yield pa.RecordBatch.from_pylist([{"lang": lang, "suffix": x} for lang, x in some], schema=pa.schema([("lang", pa.string()), ("suffix", pa.string())]))

    sampled = columns.sample(share, seed).mapInArrow(run, "lang string, suffix string")
    found = sorted({(r.lang, r.suffix) for r in sampled.orderBy(F.rand(seed)).limit(wanted).collect()})  # SAMPLE a range at most
    return [found[k * len(found) // parts] for k in range(1, parts)] if found else []


def counted_suffixes(docs: DataFrame, max_n: int, cuts: list[tuple[str, str]]) -> DataFrame:
    """(part, suffix, n): how often a task met a suffix, and the range it is in. A suffix ends in two gaps and its language, which sorts like words."""
    ranges: dict[str, list[str]] = {}
    for lang, suffix in cuts:
        ranges.setdefault(lang, []).append(suffix)
    langs = sorted(ranges)
    before = [0, *accumulate(len(ranges[x]) for x in langs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(suffixes(text, max_n))
                if sum(map(len, held.values())) > HELD:
                    yield from handed_on(held)
                    held = {}
        yield from handed_on(held)

    def handed_on(held: dict[str, Counter], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            own, first = ranges.get(lang, []), before[bisect_left(langs, lang)]
            words, times, tail = list(counts), list(counts.values()), pa.scalar(GAP + GAP + escaped(lang))
            for lo in range(0, len(words), rows):
                some = words[lo : lo + rows]
                part = pa.array([first + bisect_right(own, x) for x in some], pa.int32())
                tailed = pc.binary_join_element_wise(pa.array(some, pa.string()), tail, "")
                yield pa.RecordBatch.from_arrays([part, tailed, pa.array(times[lo : lo + rows], pa.int64())], names=["part", "suffix", "n"])

    return _columns(docs).mapInArrow(run, "part int, suffix string, n long")


class PhraseStack:
    """Counts all beginnings of a language's suffixes that come in order, a batch of them at a time.

    The stack holds the last suffix's words and how often its beginnings have come so far. Within a batch a beginning
    ends where the words in common with the next suffix are fewer than its own; what is still on the stack at the end of a batch
    goes on in the next one. A beginning that ends is whole, but for those of the first and the last suffix, which may go on in a
    neighbouring range: they are given out however rare.
    """

    def __init__(self, lang: str, least: int, max_n: int, out: list[tuple]) -> None:
        self.lang, self.least, self.max_n, self.out, self.total = lang, least, max_n, out, 0
        self.words: list[str] = []
        self.counts: list[int] = []
        self.edge = max_n  # so many words of the first suffix have been on the stack from the start

    def push(self, suffixes: pa.Array, times: np.ndarray) -> None:
        """Suffixes in order and how often each came; the last one's words stay on the stack."""
        listed = pc.split_pattern(suffixes, GAP)
        held = len(self.words)
        sizes = np.r_[held, pc.list_value_length(listed).to_numpy(zero_copy_only=False)] if held else pc.list_value_length(listed).to_numpy(zero_copy_only=False)
        times = np.r_[0, times] if held else times  # the stack comes first, as a suffix of its own
        words = pa.concat_arrays([pa.array(self.words, pa.string()), listed.flatten()])
        begins = np.cumsum(sizes) - sizes
        numbered = words.dictionary_encode()
        codes = np.full((len(sizes), self.max_n), -1, np.int64)
        codes[np.arange(self.max_n) < sizes[:, None]] = numbered.indices.to_numpy()
        same = (codes[1:] == codes[:-1]) & (codes[1:] >= 0)
        common = np.r_[0, np.logical_and.accumulate(same, 1).sum(1)]  # words in common with the suffix before
        names = lambda row, k: words.slice(begins[row], k).to_pylist()
        counts, edge = [], 0
        for k in range(1, self.max_n + 1):
            long = sizes >= k
            starts = np.flatnonzero(long & (common < k))
            if not len(starts):
                continue
            sums = np.add.reduceat(np.where(long, times, 0), starts)
            if held >= k:
                sums[0] += self.counts[k - 1]
            first = starts[0] == 0 and k <= self.edge
            goes_on = bool(long[-1])
            if goes_on:
                counts.append(int(sums[-1]))
                if first and len(starts) == 1:
                    edge = k
            ends = sums[:-1] if goes_on else sums
            told = np.flatnonzero(ends >= self.least)
            if first and len(ends) and ends[0] < self.least:
                told = np.r_[0, told]
            self.out += [(self.lang, plain(names(starts[i], k)), k, int(ends[i])) for i in told]
        self.words, self.counts, self.edge = names(len(sizes) - 1, int(sizes[-1])), counts, edge
        self.total += int(times.sum())

    def close(self) -> None:
        self.out += [(self.lang, plain(self.words[:k]), k, n) for k, n in enumerate(self.counts, 1)]
        self.out.append((self.lang, "", 0, self.total))


def frequent_phrases(docs: DataFrame, least: int = 100, max_n: int = 5) -> DataFrame:
    """(lang, phrase, words, f): every phrase of 1 to max_n words that occurs at least `least` times in its language.

    A phrase is its words joined by one space. Each language also has a row of no words: f is how many words it has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        stacks: dict[str, PhraseStack] = {}
        for batch in batches:
            both, times = pc.split_pattern(batch.column(0), GAP + GAP, max_splits=1, reverse=True).flatten(), batch.column(1).to_numpy()
            langs = both.take(pa.array(np.arange(1, len(both), 2))).dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                own = np.flatnonzero(langs.indices.to_numpy() == k)
                if lang not in stacks:
                    stacks[lang] = PhraseStack(plain([lang]), least, max_n, out)
                stacks[lang].push(both.take(pa.array(2 * own)), times[own])
            yield from flushed(out)
        for stack in stacks.values():
            stack.close()
        yield from flushed(out)

    def flushed(out: list[tuple]) -> Iterator[pa.RecordBatch]:
        if out:
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["lang", "phrase", "words", "f"])
            out.clear()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counted_suffixes(docs, max_n, range_cuts(docs, max_n, parts)).repartitionById(parts, "part")
    counted = dealt.select("suffix", "n").sortWithinPartitions(F.col("suffix").desc()).mapInArrow(run, "lang string, phrase string, words int, f long")
    return counted.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("words") == 0))


def phrase_collocations(docs: DataFrame, least: int = 100, max_n: int = 5, absorbed: int = 100, top: int = 2000) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score.

    docs: text, lang; other columns are ignored, whatever their names. A null text counts as an empty
    one, a null lang as `und`. Pieces end at . , ; : ! ? and U+000A to U+000D, words at spaces and tabs,
    A to Z are lower-cased. Candidates have 2 to max_n words and a >= least occurrences within pieces. A
    cut gives l and r, the occurrences of its two parts, and floor(1000 a n / (l r)) with n, the language's
    words; the lowest cut counts, of equal ones the first. A candidate goes if a longer one that holds it
    has at least `absorbed` hundredths of its occurrences. The first `top` by score, then a (both falling), then phrase
    stay. Repeated rows count as often as they occur; an empty table, or one without candidates, gives no row.
    """
    counts = materialize(frequent_phrases(docs, least, max_n))
    phrases, words = counts.where("words > 0").select("lang", "phrase", "f"), F.split("phrase", " ")
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    found = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))

    cuts = found.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    part = lambda start, size: F.array_join(F.slice(words, start, size), " ")
    cuts = cuts.select("*", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    heads, rests = (phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(f)) for name, f in (("head", "l"), ("rest", "r")))
    group = F.pmod(F.xxhash64("phrase"), F.lit(GROUPS)).cast("int")  # a language may have most rows: its total is dealt to GROUPS keys
    totals = totals.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))))
    cuts = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"]).withColumn("group", group).join(totals, ["lang", "group"])
    wide = lambda name: F.col(name).cast("decimal(19,0)").cast("decimal(38,0)")
    cuts = cuts.withColumn("score", F.call_function("div", (F.lit(1000).cast("decimal(38,0)") * wide("a") * wide("n")).cast("decimal(38,0)"), (wide("l") * wide("r")).cast("decimal(38,0)")))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("low")
    scored = cuts.groupBy("lang", "phrase", "words", "a", "n").agg(lowest).select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")

    inner = found.where("words > 2").select("lang", "words", F.col("a").alias("longer"), words.alias("w"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("lang", "longer", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("start"))
    inner = inner.select("lang", F.array_join(F.slice("w", F.col("start"), F.col("size")), " ").alias("phrase"), "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < absorbed * F.col("a")))

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    near = kept.withColumn("group", group).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "group").orderBy(*order))).where(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

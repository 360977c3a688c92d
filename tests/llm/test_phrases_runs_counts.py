"""Collocations, periodic runs and token counts against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import collocations, periodic, queries, token_counts, vocab

DOCS = "doc_id long, text string, lang string, source string, n long, n_tokens long, runs string, suffix string, phrase string, words int"


def documents(spark, rows):
    """rows: (doc_id, text, lang); with columns whose names clash with those the operators make."""
    return spark.createDataFrame([(i, t, la, "s", 7, 7, "x", "x", "x", 7) for i, t, la in rows], DOCS)


# --- token counts


def reference(name):
    path = vocab.vocabulary_path(name)
    if name.endswith(".model"):
        return lambda t: len(vocab.sentencepiece_model(path).encode(t))
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    return lambda t: len(whole.encode(t, add_special_tokens=False).ids)


PARTS = [
    "a", "the", "T", "'s", "'ll", "'", "12", "½", "é", "ß", "中文", "́", "\n", "\r\n", "\t", " ", "  ", " ", "   ", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "᠎", "​", "﻿",
    "<|endoftext|>", "<|endof", "!", "...", "▁", "▁▁", "🙂", "\x00", "<s>", "</s>", "<0x0A>", "ﬁ", "ⅷ",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"])
def test_stretches_add_up(name):
    cut, count = token_counts.counter(vocab.vocabulary_path(name))
    whole, rng = reference(name), random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 14)))
        assert sum(count(cut(text)) if text else []) == whole(text), repr(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, monkeypatch, name):
    rng = random.Random(2)
    texts = ["", None, " ", "one", "one", "x <|endoftext|> y", "a" * 200_000, " " * 300_000 + "b", "b c " * 100_000, *("".join(rng.choices(PARTS, k=300)) for _ in range(40))]
    df = documents(spark, [(k if k != 3 else None, t, "en") for k, t in enumerate(texts)]).coalesce(1)
    got = token_counts.token_counts(df, vocab.vocabulary_path(name), limit=3).collect()
    whole = reference(name)
    want = [(k if k != 3 else None, len((t or "").encode()), whole(t or ""), whole(t or "") > 3) for k, t in enumerate(texts)]
    assert [tuple(r) for r in got] == want
    assert token_counts.token_counts(df.limit(0)).count() == 0


def test_batches_are_balanced_by_bytes():
    ranges = list(token_counts.by_bytes([10, 20, 500, 5, 5, 90], 100))
    assert ranges == [(0, 2), (2, 3), (3, 6)] and list(token_counts.by_bytes([], 100)) == [] and list(token_counts.by_bytes([0, 0], 1)) == [(0, 2)]
    known = token_counts.Counts(lambda texts: [len(t) for t in texts])
    for k in range(3):
        known.learn({"x" * (k + 1), "y" * 100})
        known.forget_long({"x" * (k + 1), "y" * 100})
    assert known == {"x": 1, "xx": 2, "xxx": 3}


# --- periodic runs


def runs_by_period(words):
    """Every period in turn: stretches of words that equal the one a period before; of equal stretches the smallest period's."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if i > start and length >= max(24, 3 * q):
                found.setdefault((start, length), q)
            i += i == start
    return sorted((s, n, q) for (s, n), q in found.items())


def loops(rng):
    out = []
    for _ in range(rng.randint(1, 6)):
        if rng.random() < 0.3:
            out += rng.choices("abcdefghij", k=rng.randint(0, 40))
        else:
            unit = rng.choices(rng.choice(["a", "ab", "abcdefgh", "xyzw"]), k=rng.randint(1, rng.choice([3, 9, 20, 70])))
            out += (unit * 40)[: rng.randint(1, rng.choice([40, 300]))]
    return out


@pytest.mark.parametrize("how", ["plain", "digits", "small steps", "collisions"])
def test_runs_are_all_found(monkeypatch, how):
    if how == "digits":
        monkeypatch.setattr(periodic, "RADIX", 8)
    if how == "small steps":
        monkeypatch.setattr(periodic, "TOGETHER", 5)
    if how == "collisions":
        monkeypatch.setattr(periodic.Reach, "hashed", lambda self, start, size: np.zeros(len(start), np.uint64))
    rng = random.Random(how)
    for _ in range(80):
        words = loops(rng)
        assert [tuple(r) for r in periodic.find_runs(words).tolist()] == runs_by_period(words)
    assert periodic.find_runs([]).shape == (0, 3) and len(periodic.find_runs(["a"] * 23)) == 0
    assert periodic.find_runs(["a"] * 24).tolist() == [[0, 24, 1]]


def test_runs_of_long_texts():
    words = (["a"] * 120 + ["b"]) * 300
    assert len(periodic.find_runs(words)) == 301
    assert periodic.find_runs(["a"] * 60_000).tolist() == [[0, 60_000, 1]]
    unit = [str(k) for k in range(9000)]
    assert periodic.find_runs(["x", *unit * 3, "y"]).tolist() == [[1, 27_000, 9000]]
    assert len(periodic.find_runs([*unit * 2, *unit[:-1]])) == 0


def test_periodic_runs(spark, tmp_path):
    rng = random.Random(4)
    rows = [(1, "", "en"), (2, None, None), (2, None, None), (None, "a " * 30, "en"), *((k, " \n".join(loops(rng)), "en") for k in range(10, 90))]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    by_id = lambda r: (r[0] is None, r[0])
    got = sorted(queries.op11_periodic_runs(spark, str(tmp_path)).collect(), key=by_id)
    want, digest = [], lambda t: hashlib.sha256(t.encode()).hexdigest()
    for doc_id, text, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = runs_by_period(words)
        best = min(runs, key=lambda r: (-r[1] * 10**12 // r[2], r[0], r[2]), default=(None, None, None))
        dropped = {i for s, k, q in runs for i in range(s + q, s + k)}
        listed = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        want.append((doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], digest(listed), digest(kept)))
    assert [tuple(r) for r in got] == sorted(want, key=by_id)
    assert sum(r.n_runs > 0 for r in got) > 40 and any(zlib.crc32(str(k).encode()) % 10 == 0 for k in range(10, 90))


# --- collocations


def phrases_by_counting(rows, least, absorbed, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        kept = []
        for p, a in found.items():
            if not longer[p] or 100 * longer[p] < absorbed * a:
                score, _, left, right = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("held, least, absorbed, top", [(300_000, 5, 100, 2000), (7, 3, 60, 2000), (50, 4, 100, 20)])
def test_collocations(spark, monkeypatch, held, least, absorbed, top):
    monkeypatch.setattr(collocations, "HELD", held)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3 if held == 7 else 10_000)
    rng, vocabulary = random.Random(held), ["Ab", "c\x01", "\x00", "c", "\x01\x02", "é", "zz", "\x00\x01", "q\xa0r", "🙂", "-"]
    rows = [(k, "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\t", "  ", ". ", "\n"]) for _ in range(rng.randint(0, 80))), rng.choice(["en", "en", None, "d", "e\x00", "e\x01", ""])) for k in range(60)]
    rows += [(1, None, "en"), (2, "", None), (3, "hot hot hot " * 200, "en"), (None, ".,;", "x")] + [(4, "same copy of a text here", "en")] * 9
    got = collocations.phrase_collocations(documents(spark, rows).repartition(3), least, 5, absorbed, top).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    assert sorted(map(tuple, got)) == phrases_by_counting(rows, least, absorbed, top)
    assert collocations.phrase_collocations(documents(spark, rows).limit(0)).count() == 0


def test_stack_gives_whole_counts():
    """Batches of any size, ranges cut anywhere: sums of what the ranges give are the counts, and only the edges' are rare."""
    rng = random.Random(8)
    for _ in range(200):
        suffixes = sorted({"\0".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(30)}, reverse=True)
        times, cut, step = [rng.randint(1, 3) for _ in suffixes], rng.randint(0, len(suffixes)), rng.randint(1, 7)
        want, got = Counter(), Counter()
        for x, n in zip(suffixes, times):
            for k in range(len(x.split("\0")) + 1):
                want[" ".join(x.split("\0")[:k])] += n
        for lo, hi in ((0, cut), (cut, len(suffixes))):
            stack = collocations.PhraseStack("en", 4, 4, [])
            for at in range(lo, hi, step):
                stack.push(pa.array(suffixes[at : min(at + step, hi)]), np.array(times[at : min(at + step, hi)]))
            stack.close()
            assert len(stack.out) == len({p for _, p, _, _ in stack.out})
            for _, phrase, _, n in stack.out:
                got[phrase] += n
            inner = [n for _, p, k, n in stack.out if k and not any(f"{x} ".startswith(f"{p} ") for x in (suffixes[lo].replace("\0", " "), suffixes[hi - 1].replace("\0", " ")))]
            assert all(n >= 4 for n in inner)
        assert all(got[p] == n for p, n in want.items() if n >= 4) and all(got[p] <= want[p] for p in got)


def test_arithmetic_is_exact():
    """Products of counts pass 64 bits: the stack adds them up whole."""
    stack = collocations.PhraseStack("en", 100, 5, [])
    stack.push(pa.array(["b\0c"]), np.array([10**15]))
    stack.push(pa.array(["b", "a"]), np.array([5, 99]))
    stack.close()
    assert sorted(stack.out) == [("en", "", 0, 10**15 + 104), ("en", "a", 1, 99), ("en", "b", 1, 10**15 + 5), ("en", "b c", 2, 10**15)]


def test_large_counts_score_exactly(spark, monkeypatch):
    rows = [("en", "a", 1, 3 * 10**14 + 1), ("en", "b", 1, 2 * 10**14), ("en", "a b", 2, 10**14 + 7), ("en", "", 0, 7 * 10**14)]
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *_: spark.createDataFrame(rows, "lang string, phrase string, words int, f long"))
    (row,) = collocations.phrase_collocations(spark.range(1)).collect()
    assert row.score == 1000 * (10**14 + 7) * (7 * 10**14) // ((3 * 10**14 + 1) * 2 * 10**14)

"""Near duplicates, embeddings, quality and the pipeline against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import cotraining, ego_join, minhash
from tessera.llm.common import connected_components


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n))


class Sets:
    def __init__(self):
        self.of = {}

    def find(self, x):
        self.of.setdefault(x, x)
        while self.of[x] != x:
            x = self.of[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.of[b] = a


def test_components(spark):
    rng, sets = random.Random(1), Sets()
    edges = [(k, k + 1) for k in range(0, 60)] + [(500, 500 + k) for k in range(1, 80)] + [(rng.randint(1000, 1200), rng.randint(1000, 1200)) for _ in range(90)] + [(7, 7), (2000, 2000)]
    for a, b in edges:
        sets.join(a, b)
    df = spark.createDataFrame(edges + [(None, 3)], "a long, b long")
    assert {r.node: r.component for r in connected_components(df).collect()} == {x: sets.find(x) for x in sets.of}
    assert connected_components(df.limit(0)).count() == 0


def edited(text, share, seed):
    rng = random.Random(seed)
    return " ".join(w if rng.random() > share else "zz" + str(rng.randint(0, 9999)) for w in text.split())


def near_documents():
    rows = [(k, words(random.Random(k).randint(5, 80), k)) for k in range(60)]
    base = words(120, 777)
    rows += [(100 + k, edited(base, 0.01, k)) for k in range(40)] + [(200 + k, words(90, 888)) for k in range(25)]
    rows += [(300, ""), (301, None), (302, "two words"), (303, "two words"), (304, "a b c d e"), (305, words(15_000, 5)), (306, words(15_000, 5) + " tail"), (200, words(90, 888))]
    return rows


def brute_groups(rows, threshold=0.8, smoothing=3.0):
    bags = []
    for _, t in rows:
        w = (t or "").split()
        bags.append(Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter())
    df = Counter(s for b in bags for s in b)
    idf = {s: smoothing + math.log1p(len(rows) / n) / math.log1p(len(rows)) for s, n in df.items()}
    sets, first = Sets(), {}
    for (i, t), bag in zip(rows, bags):
        sets.join(i, first.setdefault(t or "", i))
    for x in range(len(rows)):
        for y in range(x):
            least = sum(min(n, bags[y][s]) * idf[s] for s, n in bags[x].items() if s in bags[y])
            total = sum(n * idf[s] for b in (bags[x], bags[y]) for s, n in b.items())
            if least and least >= threshold * (total - least):
                sets.join(rows[x][0], rows[y][0])
    return {i: sets.find(i) for i, _ in rows}


@pytest.mark.parametrize("block", [512, 10])
def test_near_duplicates(spark, block):
    rows = near_documents()
    df = spark.createDataFrame(rows + [(None, "two words")], "doc_id long, text string").withColumn("digest", F.lit("clash")).repartition(6)
    got = minhash.near_duplicates(df, block_texts=block).collect()
    want = brute_groups(rows)
    assert len(got) == len(rows) + 1
    named = [r for r in got if r.doc_id is not None]
    wrong = {r.doc_id for r in named if r.component_id != want[r.doc_id]}
    assert len(wrong) <= 1, wrong  # a pair just above the threshold is missed once in thousands
    assert len(set(want.values())) < len(want) - 40  # many groups to find
    assert all(r.kept == (r.doc_id == r.component_id) for r in named) and [r.component_id for r in got if r.doc_id is None] == [302]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_samples_estimate_similarity():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**63, 400).astype(np.uint64)
    w1, w2 = rng.random(400) + 0.5, rng.random(400) + 0.5
    got = minhash.sample(np.concatenate([h, h]), np.concatenate([w1, w2]), np.array([0, 400]), 2000)
    assert abs((got[0] == got[1]).mean() - np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()) < 0.04


def brute_links(ids, x, threshold=0.95):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= threshold) & (ids[:, None] != ids[None, :])
    sets = Sets()
    for a, b in zip(*np.nonzero(near)):
        sets.join(int(ids[a]), int(ids[b]))
    return {int(i): (int(n), sets.find(int(i))) for i, n in zip(ids, near.sum(1))}


def test_similar_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 16))
    x = np.concatenate([rng.normal(size=(250, 16)), np.repeat(centres, 40, 0) + rng.normal(size=(320, 16)) * 0.12]).astype(np.float32)
    ids = rng.permutation(len(x)).astype(np.int64)
    rows = [(int(i), [float(c) for c in v], 0) for i, v in zip(ids, x)]
    odd = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] + [1.0] * 15, 1), (9004, [float("inf")] * 16, 1), (9005, [None] + [1.0] * 15, 1), (9006, [1.0, 2.0], 1), (9007, [2.0, 4.0], 1), (9008, [], 1), (None, rows[0][1], 1), rows[0]]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("block", F.lit("clash"))
    got = ego_join.similar_vectors(df, rows=64, interval=16, fan=3).collect()
    want = brute_links(ids, x.astype(float)) | {k: (0, k) for k in (9001, 9002, 9003, 9004, 9005, 9008)} | {9006: (1, 9006), 9007: (1, 9006), None: (0, None)}
    assert len(got) == len(rows) + len(odd)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert ego_join.similar_vectors(df.limit(0)).count() == 0


def test_distant_intervals_are_skipped(spark):
    rng = np.random.default_rng(6)  # vectors spread over two dimensions: nearly all blocks are distant
    angle = rng.random(2000) * 2 * np.pi
    x = np.stack([np.cos(angle), np.sin(angle), *(rng.normal(size=(3, 2000)) * 0.01)], 1)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    pairs, skipped = ego_join.tile_links(df, 0.99, 4, 256, 16, 3, 0.5, 64).groupBy().sum("pairs", "skipped").first()
    assert skipped > 0.3 * pairs
    links = {r.vec_id: r.n_links for r in ego_join.similar_vectors(df, threshold=0.99, rows=256, interval=16, dims=4).collect()}
    assert links == {k: n for k, (n, _) in brute_links(np.arange(2000), x, 0.99).items()}


def test_distant_tiles_are_skipped(spark):
    boxes = spark.createDataFrame([(k, [float(k), 0.0], [k + 0.5, 1.0]) for k in range(20)], "tile long, low array<double>, high array<double>")
    got = {(r.a, r.b) for r in ego_join.interval_pairs(boxes, 2, 0.6, 3).collect()}
    assert got == {(a, b) for a in range(20) for b in range(a, min(a + 2, 20))}


def junk(k):
    return " ".join(w + random.Random(k + j).choice(["###", "$$$", "%%%"]) for j, w in enumerate(words(40, k).split()))


def quality_tables(spark, n=400):
    rng = random.Random(9)
    bad = [rng.random() < 0.3 for _ in range(n)]
    rows = [(k, junk(k) if bad[k] else words(60, k), "en", "bad" if bad[k] and k % 3 else "good", 300) for k in range(n)]
    docs = spark.createDataFrame(rows + [(9000, None, None, None, None), (9001, "", "en", "good", 0), (9002, words(20_000, 1), "en", "good", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, int(not bad[k]), 0) for k in range(n) if k % 4 == 0] + [(None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    return docs, labels, bad


def test_cotraining(spark):
    docs, labels, bad = quality_tables(spark)
    got = {r.doc_id: r for r in cotraining.classify(docs.withColumn("t_symbols", F.lit("clash")), labels).collect()}
    assert len(got) == len(bad) + 3 and all(0 <= r.score <= 1 for r in got.values())
    unseen = [k for k in range(len(bad)) if k % 4]
    assert sum(got[k].kept != (not bad[k]) for k in unseen) <= len(unseen) * 0.02
    for some in (labels.limit(0), labels.where("quality = 1")):
        assert all(r.kept for r in cotraining.classify(docs, some).collect())
    assert cotraining.classify(docs.limit(0), labels.limit(0)).count() == 0


def auc(pairs):
    good, bad = [m for m, y in pairs if y], [m for m, y in pairs if not y]
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


def test_exchange_helps(spark):
    """Few labels, a host that tells the class, and texts of many words: what the host knows teaches the text view the words."""
    rng = random.Random(11)
    vocabulary = {y: [words(1, 1000 * y + k) for k in range(150)] for y in (0, 1)}
    truth = {k: k % 2 for k in range(800)}
    rows = [(k, " ".join(rng.choices(vocabulary[y], k=4) + [words(1, 9000 + rng.randint(0, 500)) for _ in range(12)]), "en", f"host{y}", 100) for k, y in truth.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, truth[k]) for k in range(40)], "doc_id long, quality int")
    score = {}
    for rounds in (0, 2):
        model = cotraining.fit(docs, labels, rounds=rounds, sure=1.0)
        score[rounds] = auc([(r._t, truth[r.doc_id]) for r in model.margins(docs).where("doc_id >= 40").select("doc_id", "_t").collect()])
    assert score[2] > score[0] + 0.02 and score[2] > 0.9, score


def test_text_margin_is_the_vectors(spark):
    texts = ["", None, "one", words(50, 1), "A B !! ### | 12 ÉTÉ 字", "x " * 300, words(20_000, 4)]
    weights = np.random.default_rng(5).normal(size=cotraining.BUCKETS + len(cotraining.STYLE))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r._t for r in cotraining.with_text_margin(df, weights, 0.5).collect()}
    for k, t in enumerate(texts):
        v = cotraining.text_vector(t)
        assert np.isclose(got[k], 0.5 + v.values @ weights[v.indices])
    w = words(50, 1).split()
    buckets, n, _ = cotraining.text_parts(" ".join(w))
    assert n == 50 and len(buckets) == 50 + len(" ".join(w)) and len(set(buckets[-50:].tolist())) <= len(set(w))


def test_one_row_of_each_group(spark):
    t, near = words(80, 1), words(80, 1) + " end"
    rows = [(1, t, "a"), (1, t, "a"), (5, "a text of its own with more than five words", "b"), (5, t, "c"), (None, t, "d"), (None, t, "d"), (9, near, "e"), (None, "no id and no copy of it anywhere at all", "f"), (None, None, "g"), (2, "", "g"), (3, None, "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, best string").repartition(3)
    got = sorted((r.doc_id or -1, r.text or "", r.best) for r in minhash.one_of_each(df).collect())
    assert got == sorted([(1, t, "a"), (5, rows[2][1], "b"), (-1, rows[7][1], "f"), (2, "", "g")])
    assert minhash.one_of_each(df.limit(0)).count() == 0
    clashing = df.withColumns({c: F.concat(F.lit(c), F.coalesce("best", F.lit(""))) for c in ("_row", "_digest", "_own", "digest", "group", "component")})
    assert sorted((r.doc_id or -1, r._row, r._digest, r._own, r.digest, r.group, r.component) for r in minhash.one_of_each(clashing).collect()) == sorted((i, *(c + b for c in ("_row", "_digest", "_own", "digest", "group", "component"))) for i, _, b in got)


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_rows(spark, tmp_path, stage):
    """Nulls in any column, repeated rows and ids, empty texts, then an empty table."""
    name, f = corpus_pipeline.STAGES[stage]
    text = words(60, 1)
    rows = [(1, text, "en", "a", 9), (1, text, "en", "a", 9), (None, words(60, 2), None, None, None), (3, None, "en", "a", None), (4, "", None, "b", 0), (1, words(60, 3), "en", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = f(spark, docs, str(tmp_path)).collect()
    long_ones = {text, rows[2][1], rows[5][1]}
    if name == "packing":
        assert len(got) == len(rows)
    else:
        assert {r.text for r in got} >= long_ones and sum(r.text == text for r in got) == (1 if name == "near_dedup" else 2)
    assert f(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pipeline(spark, tmp_path):
    docs, labels, bad = quality_tables(spark, 200)
    copy = docs.where("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 5000)
    mail = docs.where("doc_id = 1").select(F.lit(7000).cast("long").alias("doc_id"), F.concat(F.lit("write to me@example.org "), "text").alias("text"), "lang", "source", "n_chars")
    docs = docs.unionByName(copy).unionByName(mail)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    now, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.materialize(stage(spark, now, str(tmp_path)))
        assert now.columns == corpus_pipeline.COLUMNS
        ids[name] = {r.doc_id for r in now.select("doc_id").collect()}
    good = {k for k in range(200) if not bad[k]}
    assert len(ids["quality_classifier"] & good) >= len(good) * 0.98 and len(ids["quality_classifier"] & {k for k in range(200) if bad[k]}) <= 2
    assert not any(5000 <= k < 5020 for k in ids["near_dedup"]) and ids["pii"] == ids["near_dedup"]
    texts = {r.doc_id: r.text for r in now.collect()}
    assert not any("@" in t for t in texts.values())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == ids["pii"]

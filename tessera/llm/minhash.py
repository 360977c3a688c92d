"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A shingle weighs its count in the text times a + ln(1 + N / df) / ln(1 + N), over all N documents;
the smoothing a keeps the weights of what many texts share within reach of those of rare shingles.
Samples of a text are banded; texts that share a band are verified by their weighted Jaccard
similarity, sum of lesser weights over sum of greater ones.

Shingles that one text alone has can match nothing: they only dilute. So document frequencies are
counted first, and only what at least two documents share goes on; the rest of a text takes part in
sampling as one element of their summed weight, which leaves every similarity as it is. A text
whose shared part is below the threshold can't link and drops out before it is sampled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, discard, materialize

ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
LOW = np.uint64((1 << 48) - 1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * ODD[3]
    h = (h ^ (h >> np.uint64(29))) * ODD[4]
    return h ^ (h >> np.uint64(32))


def shingles_of(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, count) of the shingles of `words` words of every text; shorter texts are one shingle."""
    digest = xxhash.xxh3_64_intdigest
    split = [t.encode().split() for t in texts]
    sizes = np.array([len(w) for w in split])
    hashed = np.array([digest(w) for ws in split for w in ws], np.uint64)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(hashed)) - starts[owner]
    # a word's window reaches to the end of the text where that is nearer
    sums = np.zeros(len(hashed), np.uint64)
    for k in range(words):
        reach = place + k < sizes[owner]
        sums[: len(hashed) - k][reach[: len(hashed) - k]] += (hashed[k:] * ODD[k % len(ODD)] + np.uint64(k // len(ODD)))[reach[: len(hashed) - k]]
    first = (place == 0) | (place + words <= sizes[owner])
    owner, h = owner[first], mix(sums[first])
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return owner[at], h[at], np.diff(np.append(at, len(h)))


class Idf:
    def __init__(self, documents: int, smoothing: float = 3.0) -> None:
        self.n, self.smoothing = max(1, documents), smoothing

    def __call__(self, df: np.ndarray) -> np.ndarray:
        return self.smoothing + np.log1p(self.n / np.asarray(df, float)) / np.log1p(self.n)


def sample(h: np.ndarray, weight: np.ndarray, starts: np.ndarray, samples: int) -> np.ndarray:
    """Consistent weighted samples, (texts, samples): one 64-bit number for the element and step drawn.

    h, weight: elements of all texts, text after text from starts. For each sample an element has
    r, c ~ Gamma(2, 1) and b ~ U(0, 1) from its hash alone; t = floor(ln w / r + b), and the element with
    the least ln c - r (t - b + 1) is drawn with its t.
    """
    ln = np.log(weight).astype(np.float32)
    n = len(starts)
    out = np.empty((n, samples), np.uint64)
    log16 = -np.log((np.arange(1 << 16, dtype=np.float32) + np.float32(0.5)) / np.float32(1 << 16))
    ends = np.append(starts[1:], len(h))
    for lo in range(0, n, 64):  # texts at a time: the arrays stay in cache
        hi = min(n, lo + 64)
        a, z = starts[lo], ends[hi - 1]
        own, own_ln, own_starts = h[a:z], ln[a:z], starts[lo:hi] - a
        owner = np.repeat(np.arange(hi - lo), np.diff(np.append(own_starts, z - a)))
        for k in range(samples):
            seed = np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
            x = (own ^ seed) * ODD[1]
            x = (x ^ (x >> np.uint64(31))) * ODD[2]
            x ^= x >> np.uint64(29)
            y = x * ODD[5]
            y ^= y >> np.uint64(32)
            u = x.view(np.uint16).reshape(-1, 4)
            r = log16[u[:, 0]] + log16[u[:, 1]]
            c = log16[u[:, 2]] + log16[u[:, 3]]
            b = (y & np.uint64(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
            t = np.floor(own_ln / r + b)
            key = np.log(c) - r * (t - b + 1)
            least = np.minimum.reduceat(key, own_starts)
            at = np.flatnonzero(key == least[owner])
            at = at[np.unique(owner[at], return_index=True)[1]]
            out[lo:hi, k] = mix(own[at] + t[at].astype(np.int64).astype(np.uint64) * ODD[6])
    return out


def bands_of(samples: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of `rows` samples."""
    keys = np.zeros((len(samples), samples.shape[1] // rows), np.uint64)
    for k in range(rows):
        keys = mix(keys + samples[:, k::rows][:, : keys.shape[1]] * ODD[k % len(ODD)])
    return keys


MANY = 65_535  # in place of a text's number: several texts of the chunk have the shingle, the chunk's own row lists them
LAYOUT = "chunk long, h binary, doc binary, times binary, tf binary, digests array<string>, totals array<long>"
KINDS = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())]
NAMES = ["chunk", "h", "doc", "times", "tf", "digests", "totals"]


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    return pa.table([pa.array(list(c), k) for c, k in zip(list(zip(*rows)) or [[]] * len(names), kinds)], names=names)


def _low(h: np.ndarray) -> bytes:
    """The last 48 bits of each hash; a part's number has the leading ones."""
    return (h & LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_low(packed: bytes) -> np.ndarray:
    h = np.zeros((len(packed) // 6, 8), np.uint8)
    h[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return h.view("<u8")[:, 0].astype(np.uint64)


def shingle_parts(texts: DataFrame, words: int, parts: int, most_shingles: int = 200_000) -> DataFrame:
    """The shingles of chunks of texts, dealt to `parts` (a power of two) by the leading bits of their hashes.

    texts: digest, text. A chunk holds what a task reads up to most_shingles; equal texts in it are
    one text with a count. A row has packed hashes, the numbers of the texts that have them, how many
    documents those are, and the shingles' counts. What several texts of a chunk have is sent once
    (MANY), so a shingle of every document sends one entry for each chunk, not for each document; the
    chunk's own row (part >= parts) lists the texts and their counts, beside the digests and total counts.
    """
    bits = parts.bit_length() - 1
    kept_bits = LOW | np.uint64((2**64 - 1) << (64 - bits) & (2**64 - 1)) if bits else LOW

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, task = 0, TaskContext.get().partitionId()
        seen: dict[str, int] = {}
        times: list[int] = []
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal number, size
            doc, h, tf = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.uint32))
            totals = np.bincount(doc, tf, len(times)).astype(np.int64)
            order = np.argsort(h)
            doc, h, tf = doc[order], h[order], tf[order]
            chunk, count = (task << 20) + number, np.array(times, np.uint32)
            starts = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
            runs = np.diff(np.append(starts, len(h)))
            many = runs > 1
            sent, sent_doc, sent_tf = h[starts], np.where(many, MANY, doc[starts]), np.where(many, 0, tf[starts])
            documents = np.add.reduceat(count[doc].astype(np.int64), starts) if len(h) else np.zeros(0, np.int64)
            edges = np.searchsorted(sent, np.arange(1, parts, dtype=np.uint64) << np.uint64(64 - bits)) if bits else []
            rows = []
            for p, (a, z) in enumerate(zip([0, *edges], [*edges, len(sent)])):
                if z > a:
                    rows.append((p, chunk, _low(sent[a:z]), sent_doc[a:z].astype("<u2").tobytes(), documents[a:z].astype("<u4").tobytes(), sent_tf[a:z].astype("<u4").tobytes(), None, None))
            own = np.repeat(many, runs)
            listed = ((sent[many] & kept_bits).astype("<u8").tobytes(), doc[own].astype("<u2").tobytes(), runs[many].astype("<u4").tobytes(), tf[own].astype("<u4").tobytes())
            rows.append((parts + (31 * task + number) % parts, chunk, *listed, list(seen), totals.tolist()))
            seen.clear(), times.clear(), found.clear()
            number, size = number + 1, 0
            for k in range(0, len(rows), 64):
                yield from _table(rows[k : k + 64], ["part", *NAMES], [pa.int32(), *KINDS]).to_batches()

        for batch in batches:
            digests, all_texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, batch.num_rows, 256):
                fresh = []
                for k, d in enumerate(digests[lo : lo + 256]):
                    if d in seen:
                        times[seen[d]] += 1
                    else:
                        seen[d] = len(times)
                        times.append(1)
                        fresh.append((seen[d], all_texts[lo + k].as_py()))
                if fresh:
                    doc, h, tf = shingles_of([t for _, t in fresh], words)
                    found.append((np.array([n for n, _ in fresh], np.int32)[doc], h, tf.astype(np.uint32)))
                    size += len(h)
                if size >= most_shingles or len(times) > 65_000:
                    yield from emit()
        if times:
            yield from emit()

    return texts.mapInArrow(deal, f"part int, {LAYOUT}")


def shared_shingles(dealt: DataFrame, parts: int) -> DataFrame:
    """Of each chunk's shingles those that two documents or more have; times is now their document frequency."""
    bits = parts.bit_length() - 1

    def count(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        part, rows = key[0].as_py(), t.to_pylist()
        if part >= parts:
            return t.select(NAMES)
        h = _from_low(b"".join(r["h"] for r in rows))
        doc, times, tf = (np.frombuffer(b"".join(r[c] for r in rows), k) for c, k in (("doc", "<u2"), ("times", "<u4"), ("tf", "<u4")))
        order = np.argsort(h, kind="stable")
        ranked = h[order]
        new = np.ones(len(h), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        df = np.empty(len(h), np.int64)
        df[order] = np.add.reduceat(times[order].astype(np.int64), np.flatnonzero(new))[np.cumsum(new) - 1]
        full, out, a = h | np.uint64(part << (64 - bits) if bits else 0), [], 0
        for r in rows:
            z = a + len(r["doc"]) // 2
            at = a + np.flatnonzero(df[a:z] > 1)
            a = z
            if at.size:
                out.append((r["chunk"], full[at].tobytes(), doc[at].tobytes(), np.minimum(df[at], 2**32 - 1).astype("<u4").tobytes(), tf[at].tobytes(), None, None))
        return _table(out, NAMES, KINDS)

    return dealt.groupBy("part").applyInArrow(count, LAYOUT)


def _expanded(h: np.ndarray, doc: np.ndarray, df: np.ndarray, tf: np.ndarray, own: np.ndarray, texts: np.ndarray, runs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entries of single texts as they are; each that stands for several (MANY) as one for each text that the chunk lists."""
    one, many = np.flatnonzero(doc != MANY), np.flatnonzero(doc == MANY)
    order = np.argsort(own)  # without the bits that were left out, they aren't in order
    at = order[np.searchsorted(own, h[many], sorter=order)]
    size, ends = runs[at].astype(np.int64), np.cumsum(runs.astype(np.int64))
    start = ends[at] - size
    place = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    repeated = np.repeat(many, size)
    return np.concatenate([h[one], h[repeated]]), np.concatenate([doc[one], texts[place]]), np.concatenate([df[one], df[repeated]]), np.concatenate([tf[one], counts[place]])


CANDIDATE = "digest string, total double, h binary, df binary, tf binary, bands array<long>"


def candidates(shared: DataFrame, idf: Idf, threshold: float, bands: int, rows: int) -> DataFrame:
    """Texts that could link, with their total weight, shared shingles and band keys."""
    names = ["digest", "total", "h", "df", "tf", "bands"]
    kinds = [pa.string(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]

    def draw(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        digests, totals, got, listed = [], [], [], None
        for r in t.to_pylist():
            columns = [np.frombuffer(r[c], k) for c, k in (("h", "<u8"), ("doc", "<u2"), ("times", "<u4"), ("tf", "<u4"))]
            if r["digests"] is not None:
                digests, totals, listed = r["digests"], r["totals"], columns
            else:
                got.append(columns)
        out: list[tuple] = []
        if got:
            h, doc, df, tf = (np.concatenate(x) for x in zip(*got))
            h, doc, df, tf = _expanded(h, doc, df, tf, *listed)
            order = np.lexsort((h, doc))
            h, doc, df, tf = h[order], doc[order].astype(int), df[order], tf[order]
            weight = tf * idf(df)
            own = np.bincount(doc, weight, len(digests))
            rest = (np.array(totals) - np.bincount(doc, tf, len(digests))) * idf(1)
            total = own + rest
            good = np.flatnonzero((own > 0) & (own >= threshold * total * (1 - 1e-9)))
            bounds = np.searchsorted(doc, np.arange(len(digests) + 1))
            if good.size:
                hashes, weights, starts = [], [], []
                at = 0
                for d in good:
                    a, z = bounds[d], bounds[d + 1]
                    starts.append(at)
                    hashes.append(h[a:z])
                    weights.append(weight[a:z])
                    at += z - a
                    if rest[d] > 0:  # what this text alone has, as one element
                        hashes.append(np.array([xxhash.xxh3_64_intdigest(digests[d])], np.uint64))
                        weights.append(rest[d : d + 1])
                        at += 1
                keys = bands_of(sample(np.concatenate(hashes), np.concatenate(weights), np.array(starts), bands * rows), rows).view(np.int64)
                for d, k in zip(good, keys):
                    a, z = bounds[d], bounds[d + 1]
                    out.append((digests[d], float(total[d]), h[a:z].tobytes(), df[a:z].tobytes(), tf[a:z].tobytes(), k.tolist()))
        return _table(out, names, kinds)

    return shared.groupBy("chunk").applyInArrow(draw, CANDIDATE)


def verified_links(rows: list[dict], across: bool, idf: Idf, threshold: float) -> list[tuple[str, str]]:
    """Links that join what isn't joined yet, among texts that share a band and are similar enough.

    rows: candidates with `side` and `cluster` (texts of one cluster are joined already); across: only
    pairs of the two sides count. Texts already joined aren't compared again, so a group of near copies
    takes about one comparison for each text.
    """
    rows = list({r["digest"]: r for r in sorted(rows, key=lambda r: (r["side"], r["digest"]))}.values())
    n = len(rows)
    side = np.array([r["side"] for r in rows])
    bands = np.array([r["bands"] for r in rows])
    total = np.array([r["total"] for r in rows])
    h, df, tf = (np.concatenate([np.frombuffer(r[c], k) for r in rows]) for c, k in (("h", "<u8"), ("df", "<u4"), ("tf", "<u4")))
    sizes = np.array([len(r["h"]) // 8 for r in rows])
    ends = np.cumsum(sizes)
    weight = tf * idf(df)
    _, number = np.unique(h, return_inverse=True)
    _, group = np.unique([r["cluster"] for r in rows], return_inverse=True)
    dense, out = np.zeros(number.max(initial=-1) + 1), []
    for i in range(n):
        if across and side[i]:
            break
        js = np.arange(i + 1, n)
        if across:
            js = js[side[js] == 1]
        js = js[(bands[js] == bands[i]).any(1)]
        js = js[np.minimum(total[js], total[i]) >= threshold * np.maximum(total[js], total[i]) * (1 - 1e-9)]
        js = js[group[js] != group[i]]
        if not js.size:
            continue
        own = slice(ends[i] - sizes[i], ends[i])
        dense[number[own]] = weight[own]
        offsets = np.cumsum(sizes[js]) - sizes[js]
        at = np.repeat(ends[js] - sizes[js] - offsets, sizes[js]) + np.arange(sizes[js].sum())
        least = np.add.reduceat(np.minimum(dense[number[at]], weight[at]), offsets)
        dense[number[own]] = 0
        for j in js[least >= threshold * (total[i] + total[js] - least)]:
            if group[j] != group[i]:
                out.append((rows[i]["digest"], rows[j]["digest"]))
                group[group == group[j]] = group[i]
    return out


def _verify(dealt: DataFrame, found: DataFrame, keys: list[str], across, idf: Idf, threshold: float) -> DataFrame:
    """Links (x, y) of each group of dealt texts: digest, side, cluster and keys. across: of a key, whether only sides are compared."""

    def verify(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        links = verified_links(t.to_pylist(), across(*(k.as_py() for k in key)), idf, threshold)
        return _table(links, ["x", "y"], [pa.string(), pa.string()])

    return dealt.join(found, "digest").groupBy(*keys).applyInArrow(verify, "x string, y string")


def _how_many(texts: str, shingles: str, block_texts: int, block_shingles: int):
    return F.ceil(F.greatest(F.col(texts) / block_texts, F.col(shingles) / block_shingles, F.lit(1))).cast("int")


def linked_texts(found: DataFrame, idf: Idf, threshold: float, block_texts: int, block_shingles: int) -> DataFrame:
    """The group (node, component: digests) of every candidate that is linked to another.

    First every text of a bucket is held against the bucket's first and last text, in blocks that hold
    one hub and some of its texts: that joins nearly all of a group of near copies at a cost in
    proportion to it. Buckets whose texts are then of one cluster are done. In what is left, pairs of
    different clusters are verified in blocks; the largest cluster of a component needs no pairs of its
    own, so only texts outside it are held against all.
    """
    spark = found.sparkSession
    keyed = found.select("digest", (F.length("h") / 8).cast("long").alias("shingles"), F.posexplode("bands").alias("band", "key"))
    ends = keyed.groupBy("band", "key").agg(F.min("digest").alias("first"), F.max("digest").alias("last")).where("first <> last")
    members = materialize(keyed.join(ends, ["band", "key"]).distinct())

    to_first = members.where("digest <> first").select("digest", "shingles", F.col("first").alias("hub"))
    to_last = members.where("digest <> last and digest <> first").select("digest", "shingles", F.col("last").alias("hub"))
    spokes = materialize(to_first.union(to_last).distinct())
    hubs = spokes.groupBy("hub").agg(F.count("*").alias("texts"), F.sum("shingles").alias("shingles"))
    hubs = hubs.select("hub", _how_many("texts", "shingles", block_texts, block_shingles).alias("blocks"))
    block = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    dealt = spokes.join(hubs, "hub").select("digest", "hub", block.alias("block"), F.lit(1).alias("side"))
    dealt = dealt.union(hubs.select(F.col("hub").alias("digest"), "hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), F.lit(0)))
    links = materialize(_verify(dealt.withColumn("cluster", F.col("digest")), found, ["hub", "block"], lambda *_: True, idf, threshold))
    discard(spark, spokes)
    clusters = materialize(connected_components(links))

    clustered = members.join(clusters.select(F.col("node").alias("digest"), F.col("component").alias("cluster")), "digest", "left")
    clustered = materialize(clustered.select("digest", "shingles", "band", "key", F.coalesce("cluster", "digest").alias("cluster")))
    open_ = clustered.groupBy("band", "key").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high"), F.min("digest").alias("first")).where("low <> high")
    rest = materialize(clustered.join(open_.select("band", "key", "first"), ["band", "key"]).select("digest", "shingles", "cluster", "first").distinct())
    discard(spark, members, clustered)
    if rest.isEmpty():
        return clusters
    near = materialize(connected_components(rest.select("digest", "first")))
    texts = rest.select("digest", "shingles", "cluster").distinct().join(near.select(F.col("node").alias("digest"), "component"), "digest")
    sized = texts.groupBy("component", "cluster").agg(F.count("*").alias("texts"), F.sum("shingles").alias("shingles"))
    large = sized.groupBy("component").agg(F.max(F.struct("texts", "shingles", "cluster")).alias("l"), F.sum("texts").alias("texts"), F.sum("shingles").alias("shingles"))
    many = lambda t, n: _how_many(t, n, block_texts, block_shingles)
    large = large.withColumns({"large": F.col("l.cluster"), "outside": F.col("texts") - F.col("l.texts"), "outside_shingles": F.col("shingles") - F.col("l.shingles"), "inside": F.col("l.texts"), "inside_shingles": F.col("l.shingles")})
    large = large.select("component", "large", many("outside", "outside_shingles").alias("s"), many("inside", "inside_shingles").alias("g"))
    # blocks 0 .. s-1 hold what is outside of the largest cluster, s .. s+g-1 the largest
    dealt = texts.join(large, "component").withColumn("inside", F.col("cluster") == F.col("large"))
    own = F.when(F.col("inside"), F.col("s") + F.pmod(F.xxhash64("digest"), F.col("g"))).otherwise(F.pmod(F.xxhash64("digest"), F.col("s"))).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("inside"), F.col("s")).otherwise(F.col("s") + F.col("g")).cast("int") - 1)))
    dealt = dealt.select("digest", "component", "cluster", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    more = materialize(_verify(dealt, found, ["component", "a", "b"], lambda _, a, b: a != b, idf, threshold))
    discard(spark, near)
    if more.isEmpty():
        return clusters
    # what joins clusters is a smaller graph than the links; texts that were in none are clusters of their own
    own = rest.select("digest", "cluster").distinct()
    between = more.join(own.toDF("x", "p"), "x").join(own.toDF("y", "q"), "y").select("p", "q").distinct()
    joined = connected_components(between).toDF("cluster", "merged")
    every = clusters.toDF("node", "cluster").union(between.select(F.explode(F.array("p", "q")).alias("node")).select("node", "node")).groupBy("node").agg(F.min("cluster").alias("cluster"))
    return every.join(joined, "cluster", "left").select("node", F.coalesce("merged", "cluster").alias("component"))


def _groups(docs: DataFrame, threshold: float, words: int, bands: int, rows: int, smoothing: float, block_texts: int, block_shingles: int, most_mb: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text's digest, digest of the row) of docs, and of every digest that is linked its (node, component)."""
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("digest", F.md5("text"))
    n, chars = docs.agg(F.count("*"), F.sum(F.length(F.col("text").cast("string")))).first()
    idf = Idf(n, smoothing)
    # a shingle takes 16 bytes and comes with about six characters of text
    parts = 1 << max(6, (int((chars or 0) / 6 * 16 / (most_mb << 20))).bit_length())
    found = candidates(shared_shingles(shingle_parts(texts.select("digest", "text"), words, parts), parts), idf, threshold, bands, rows)
    found = materialize(found)
    return texts.drop("text"), linked_texts(found, idf, threshold, block_texts, block_shingles)


OPTIONS = {"threshold": 0.8, "words": 5, "bands": 20, "rows": 5, "smoothing": 3.0, "block_texts": 128, "block_shingles": 1_000_000, "most_mb": 8}


def near_duplicates(docs: DataFrame, **options: float) -> DataFrame:
    """Classes of exact copies and groups of near copies among whole texts.

    docs: doc_id, text; other columns are ignored. One row per row: doc_id, class_id (smallest doc_id
    with the same text), component_id (smallest doc_id of the group that links of weighted Jaccard similarity >= threshold
    join), kept (doc_id = component_id; true where doc_id is null). Null texts are as empty ones, which are copies of each other;
    texts of fewer than `words` words are one shingle. Rows without doc_id belong to the group of their text.
    options override OPTIONS; most_mb is how much of the packed shingles one task counts at a time.

    Two texts of similarity s share a band with probability 1 - (1 - s^rows)^bands: 0.9996 at 0.8. All pairs that share
    one are verified unless links already join them, however large the group: it is dealt in blocks of
    at most block_texts texts or block_shingles shingles.
    """
    texts, groups = _groups(docs, **OPTIONS | options)
    classes = materialize(texts.groupBy("digest").agg(F.min("doc_id").alias("class_id")))
    merged = groups.withColumnRenamed("node", "digest").join(classes, "digest")
    merged = merged.join(merged.groupBy("component").agg(F.min("class_id").alias("component_id")), "component")
    labelled = materialize(classes.join(merged.select("digest", "component_id"), "digest", "left").withColumn("component_id", F.coalesce("component_id", "class_id")))
    out = texts.join(labelled, "digest").select("doc_id", "class_id", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, **options: float) -> DataFrame:
    """docs with one row of each group of exact and near copies, in all its columns.

    Groups are those of near_duplicates, but rows are told apart by what they hold, not by doc_id: ids
    may be null or shared by different texts. Of a group the row with the smallest doc_id stays, null
    ids last, then by digests of the text and of the row; of repeated rows one stays. An empty table stays empty.
    """
    _, groups = _groups(docs, **OPTIONS | options)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.xxhash64(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in docs.columns if c != "text"), F.col("text").isNull())
    # the caller's columns travel in a struct, so that no name of theirs meets one of these
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_own"), F.md5(text).alias("_digest"), row.alias("_row"))
    rank = F.struct(F.col("_own.doc_id").isNull().alias("none"), F.col("_own.doc_id").cast("long").alias("id"), F.col("_digest").alias("digest"), F.col("_row").alias("row"))
    best = materialize(marked.groupBy("_digest").agg(F.min(rank).alias("best")))
    best = best.join(groups.withColumnRenamed("node", "_digest"), "_digest", "left").groupBy(F.coalesce("component", "_digest").alias("group")).agg(F.min("best").alias("best"))
    stay = materialize(best.select(F.col("best.digest").alias("_digest"), F.col("best.row").alias("_row")))
    # repeated rows are put together map-side; the join is dealt by the same keys, so the texts are shuffled once
    return marked.dropDuplicates(["_digest", "_row"]).join(stay, ["_digest", "_row"], "left_semi").select("_own.*")

"""Document quality by co-training: a classifier of the text and one of its metadata teach each other.

The text view is a sparse logistic regression on hashed words and character trigrams, beside a few
measures of style. The metadata view knows only what a page's record says: language, host, path and
size. A text is measured as one array of code points, without a loop over its words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize
from tessera.llm.line_rules import let

BUCKETS, SCALE = 1 << 12, 3.0
STYLE = ["length", "symbols", "upper", "digits", "words", "few", "distinct", "repeats"]
STYLE_SCALE, STYLE_CENTRE = 5.0, np.array([0.5, 0, 0, 0, 1, 0, 0.8, 0])  # about what prose has
HASHED, SIZES = 32, 16
METADATA = ["lang", "source", "url", "n_chars"]
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_PUNCTUATION = set(".,;:'\"()?!-\u2019\u201c\u201d\u2026")
# Of the code points below 0x3000: white space, symbols, capitals, digits. Those above count as letters.
_CHARS = [chr(k) for k in range(0x3000)]
FLAGS = np.array([[c.isspace(), not c.isalnum() and not c.isspace() and c not in _PUNCTUATION, c.isupper(), c.isdigit()] for c in _CHARS]).T
POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]  # of a base and of its inverse modulo 2^64


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(POWERS[0]) < n:
        inverse = np.uint64(pow(int(ODD[1]), -1, 1 << 64))
        for k, base in enumerate((ODD[1], inverse)):
            steps = np.full(2 * n, base, np.uint64)
            steps[0] = 1
            POWERS[k] = np.multiply.accumulate(steps)
    return POWERS[0][:n], POWERS[1][:n]


def text_parts(text: str | None) -> tuple[np.ndarray, int, np.ndarray]:
    """Buckets of a text's words and of its character trigrams, how many words there are, and its style.

    STYLE is, of all words, the mean length and the shares with symbols, in capitals and with digits; then how many
    words there are, whether too few, and the shares of distinct ones and of those equal to the one before.
    """
    chars = np.frombuffer(f" {text or ''} ".encode("utf-32-le", "replace"), np.uint32)
    low = np.minimum(chars, 0x2FFF)
    space, symbols, upper, digits = FLAGS[:, low] & (chars < 0x3000)
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), 0, STYLE_SCALE * (np.array([0, 0, 0, 0, 0, 1, 0, 0]) - STYLE_CENTRE)
    wide = chars.astype(np.uint64) + np.uint64(1)
    trigrams = wide[:-2] * ODD[0] + wide[1:-1] * ODD[1] + wide[2:] * ODD[2]
    power, inverse = _powers(len(chars))
    sums = np.append(np.uint64(0), np.cumsum(wide * power))
    words = (sums[ends] - sums[starts]) * inverse[starts]
    buckets = np.concatenate([(trigrams ^ trigrams >> np.uint64(29)) * ODD[2] >> np.uint64(52), (words ^ words >> np.uint64(31)) * ODD[0] >> np.uint64(52)]).astype(np.int64)
    per_word = lambda mask: np.diff(np.append(0, np.cumsum(mask))[np.stack([starts, ends])], axis=0)[0]
    size, marks = ends - starts, per_word(symbols | (chars == ord("!")) | (chars == ord(".")))
    capitals = (per_word(upper) > 1) & (per_word(upper) + marks == size)
    style = [
        np.minimum(size, 30).mean() / 10, (per_word(symbols) > 0).mean(), capitals.mean(), (per_word(digits) > 0).mean(),
        math.log1p(n) / 5, float(n < 10), len(np.unique(words)) / n, (words[1:] == words[:-1]).sum() / n,
    ]
    return buckets, n, STYLE_SCALE * (np.array(style) - STYLE_CENTRE)


def text_vector(text: str | None) -> SparseVector:
    """The text view's features: buckets by their share of words, then STYLE. A null text is an empty one."""
    buckets, n, style = text_parts(text)
    counts = np.bincount(buckets, minlength=BUCKETS) * (SCALE / max(n, 1))
    found = np.flatnonzero(counts)
    return SparseVector(BUCKETS + len(STYLE), np.append(found, np.arange(BUCKETS, BUCKETS + len(STYLE))), np.append(counts[found], style))


def with_text_margin(docs: DataFrame, weights: np.ndarray, intercept: float, keep_text: bool = True) -> DataFrame:
    """docs with _t, the text view's margin of every whole text; without the text unless it is to be kept."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # bounded by the number of buckets
    names = docs.columns
    at, kept = names.index("text"), [(k, c) for k, c in enumerate(names) if keep_text or c != "text"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, own = shared.value[:BUCKETS] * SCALE, shared.value[BUCKETS:]
        for batch in batches:
            out = []
            for value in batch.column(at):
                buckets, n, style = text_parts(value.as_py())
                out.append(intercept + float(hashed[buckets].sum()) / max(n, 1) + float(style @ own))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k, _ in kept), pa.array(out, pa.float64())], names=[*(c for _, c in kept), "_t"])

    return docs.mapInArrow(measure, docs.select(*(c for _, c in kept), F.lit(0.0).alias("_t")).schema)


def metadata_features(docs: DataFrame) -> Column:
    """What a page's record shows without its text, as numbers: size, what is missing, language, parts of host and path. Missing columns count as null."""
    column = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    parts = F.split(F.lower(F.concat_ws("/", column("source"), column("url"))), r"[^\p{L}\p{N}]+")
    hashed = F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.pmod(F.xxhash64(x), F.lit(HASHED)))
    size = F.greatest(F.coalesce(column("n_chars").cast("double"), F.lit(0.0)), F.lit(0.0))
    step = F.least(F.floor(F.log2(size + 1)), F.lit(SIZES - 1))
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    numbers = lambda n, f: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), f)
    alone = F.array(F.log1p(size) / 5, flag(column("n_chars").isNull()), flag(column("lang").isNull()), flag(column("source").isNull()))
    language = F.pmod(F.xxhash64(column("lang")), F.lit(HASHED))
    return F.concat(
        alone, let(step, lambda x: numbers(SIZES, lambda k: flag(x == k))), let(language, lambda x: numbers(HASHED, lambda k: flag(x == k))),
        let(F.array_distinct(hashed), lambda h: numbers(HASHED, lambda k: flag(F.array_contains(h, k.cast("bigint"))))),
    )


def with_metadata(docs: DataFrame) -> DataFrame:
    """docs with _m: an array of the metadata view's features."""
    return docs.withColumn("_m", metadata_features(docs))


def _margin(weights: list[float], intercept: float) -> Column:
    """A linear margin of the array _m."""
    products = F.zip_with("_m", F.array(*map(F.lit, weights)), lambda x, w: x * w)
    return F.aggregate(products, F.lit(intercept), lambda total, x: total + x)


def _fit(rows: DataFrame, features: str, strength: float, steps: int) -> LogisticRegressionModel:
    rows = rows.coalesce(4)  # few enough to be added up in one step
    return LogisticRegression(featuresCol=features, labelCol="label", rawPredictionCol="_raw", regParam=strength, maxIter=steps, tol=1e-5, standardization=False).fit(rows)


def _weights(model: LogisticRegressionModel) -> tuple[np.ndarray, float]:
    return model.coefficients.toArray(), float(model.intercept)


def _platt(held: DataFrame, model: LogisticRegressionModel) -> tuple[float, float]:
    """Slope and shift that turn a model's margin into log odds, fitted on rows it hasn't seen."""
    if held.select("label").distinct().count() < 2:
        return 1.0, 0.0
    margins = model.transform(held).select("label", F.element_at(vector_to_array("_raw"), 2).alias("_t"))
    weights, shift = _weights(_fit(margins.withColumn("_z", array_to_vector(F.array("_t"))), "_z", 1e-2, 10))
    return float(weights[0]), shift


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(x, F.lit(500.0)), F.lit(-500.0))))


@dataclass
class CoTrained:
    """Weights of both views, the lines that calibrate them, and the logit of the share of good documents."""

    text: tuple[np.ndarray, float] | None
    metadata: tuple[list[float], float] | None
    lines: tuple[tuple[float, float], tuple[float, float]]
    prior: float

    def margins(self, docs: DataFrame, keep_text: bool = False) -> DataFrame:
        """docs with _t and _u, the margins of the text and the metadata view."""
        return with_text_margin(with_metadata(docs).withColumn("_u", _margin(*self.metadata)).drop("_m"), *self.text, keep_text)

    def score(self, docs: DataFrame, keep_text: bool = True) -> DataFrame:
        """docs with text_score, metadata_score and score, the probability of good quality from both views.

        Given the class, views are taken as independent: their log odds add up, the prior's once.
        """
        names = ("text_score", "metadata_score", "score")
        docs = docs.drop(*names, "_t", "_u", "_m")
        if not self.text:
            return docs.withColumns({c: sigmoid(F.lit(self.prior)) for c in names})
        (a, b), (c, d) = self.lines
        text, metadata = F.lit(a) * F.col("_t") + F.lit(b), F.lit(c) * F.col("_u") + F.lit(d)
        found = self.margins(docs, keep_text)
        return found.withColumns(dict(zip(names, (sigmoid(text), sigmoid(metadata), sigmoid(text + metadata - F.lit(self.prior)))))).drop("_t", "_u")


def _as_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), _key (digest of the text) and what metadata there is."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(F.lit(3), text).alias("_key"), *(c for c in METADATA if c in docs.columns))


def fit(docs: DataFrame, labels: DataFrame, rounds: int = 2, most_labelled: int = 20_000, per_round: int = 500, sure: float = 2.2, strength: float = 1e-4) -> CoTrained:
    """Fit both views on labelled documents, let them exchange confident labels, then calibrate them.

    docs: doc_id, text and any of METADATA. labels: doc_id, quality (0 or 1; others and nulls teach
    nothing, of several labels of a document the greatest counts). About most_labelled labelled rows
    are used, those with the smallest hashes; a fifth of them calibrates. In each round every unlabelled document is
    measured, and each view gives the other up to per_round texts of each class: those it is surest of,
    whose calibrated log odds differ from the prior by more than `sure`, a text once however many copies it has, and none that it
    gave before. So a view that tells nothing gives nothing.
    With labels of one class or none, every document gets that class's or the even probability.
    """
    docs, spark = _as_documents(docs), docs.sparkSession
    vector = F.udf(text_vector, VectorUDT())  # of bounded rows only: those that teach
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    draw = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    taken = known.where(draw < most_labelled / max(known.count(), 1)).withColumn("fold", F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(5)))
    labelled = with_metadata(docs.join(taken, "doc_id").repartition(16, "doc_id")).withColumn("_x", vector("text"))
    labelled = materialize(labelled.select("doc_id", "label", "fold", "_x", array_to_vector("_m").alias("_y")))
    counts = dict(labelled.where("fold > 0").groupBy("label").agg(F.count("*")).collect())
    if len(counts) < 2:
        return CoTrained(None, None, ((1.0, 0.0), (1.0, 0.0)), {(): 0.0, (0.0,): -5.0, (1.0,): 5.0}[tuple(counts)])
    prior = math.log(counts[1.0] / counts[0.0])

    start, held = labelled.where("fold > 0").select("label", "_x", "_y"), labelled.where("fold = 0").select("label", "_x", "_y")
    sets, given = [start, start], [None, None]
    for k in range(rounds + 1):
        views = _fit(sets[0], "_x", strength, 30), _fit(sets[1], "_y", strength, 15)
        (text, bias), (metadata, shift) = map(_weights, views)
        model = CoTrained((text, bias), (metadata.tolist(), shift), tuple(_platt(held, v) for v in views), prior)
        if k == rounds:
            break
        pool = materialize(model.margins(docs).select("doc_id", "_key", "_t", "_u").join(known.select("doc_id"), "doc_id", "left_anti").drop("doc_id"))
        for giver, margin in enumerate(("_t", "_u")):
            fresh = pool if given[giver] is None else pool.join(F.broadcast(given[giver]), "_key", "left_anti")  # at most 2 per_round keys a round
            slope, moved = model.lines[giver]
            evidence = F.lit(slope) * F.col(margin) + F.lit(moved - prior)
            each = fresh.groupBy("_key").agg(F.max(evidence).alias("high"), F.min(evidence).alias("low"))
            tie = F.xxhash64("_key")
            best = each.where(F.col("high") > sure).orderBy(F.col("high").desc(), tie).limit(per_round).select("_key", F.lit(1.0).alias("label"))
            worst = each.where(F.col("low") < -sure).orderBy(F.col("low"), tie).limit(per_round).select("_key", F.lit(0.0).alias("label"))
            chosen = materialize(best.union(worst).dropDuplicates(["_key"]))
            given[giver] = chosen.select("_key") if given[giver] is None else given[giver].union(chosen.select("_key"))
            texts = docs.join(F.broadcast(chosen), "_key").dropDuplicates(["_key"])  # 2 per_round rows at most
            more = with_metadata(texts.repartition(8, "_key")).select("label", vector("text").alias("_x"), array_to_vector("_m").alias("_y"))
            sets[1 - giver] = sets[1 - giver].unionByName(materialize(more))
        discard(spark, pool)
    return model


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, text_score, metadata_score, score and kept (score >= least) for every row of docs.

    Null text counts as empty, null metadata as such; repeated rows score alike; extra columns are ignored; an empty table stays empty.
    """
    own = docs.select("doc_id", "text", *(c for c in METADATA if c in docs.columns))
    scored = fit(docs, labels).score(own, keep_text=False)
    return scored.select("doc_id", "text_score", "metadata_score", "score", (F.col("score") >= least).alias("kept"))

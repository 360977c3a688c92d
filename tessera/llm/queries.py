"""The queries of this subpackage: each applies one operator, as set for production, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import collocations, cotraining, ego_join, html_text, language_id, line_rules, minhash, packing, periodic, pii, piece_nbest, token_counts, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both derivatives of every page's response, their fields and a digest of all."""
    made = warc.derive(warc.responses_from_pages(_table(spark, sf_dir, "pages")))
    named = lambda name: F.element_at("headers", F.lit(name))
    return made.select(
        "page_id", "warc_type", "record_id", "refers_to", named("WARC-Target-URI").alias("target_uri"), named("WARC-Concurrent-To").alias("concurrent_to"), named("WARC-Source-Payload-Digest").alias("source_payload_digest"),
        named("WARC-Block-Digest").alias("block_digest"), named("Content-Type").alias("content_type"), named("Content-Length").cast("long").alias("content_length"), F.sha2(warc.serialize(made), 256).alias("record_sha256"),
    )


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents")).drop("ids")


def op4_epsilon_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego_join.similar_vectors(_table(spark, sf_dir, "embeddings"))


def op5_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_rules.line_frequency_rules(_table(spark, sf_dir, "documents"), keep_text=False)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def op6_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_line_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the documents that are not held out; sees only the texts of those it labels."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    languages, prob = language_id.learn(docs.where(~held_out).select("doc_id", "text", "lang"))
    texts = docs.select("doc_id", held_out.alias("held_out"), "text")
    return language_id.predict(texts, languages, prob).select("doc_id", "held_out", "lang_pred", "score")


def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summarize(pii.find_pii(_table(spark, sf_dir, "documents")))


def op10_piece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_nbest.nbest_encode(_table(spark, sf_dir, "documents"))


def _with_loops(docs: DataFrame) -> DataFrame:
    """Of every tenth document (by the CRC-32 of its id) the words from a place on go round in a loop, as the contract of op11 says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, words = F.floor(h / 10), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size("words").cast("long")
    looped = docs.where(h % 10 == 0).select("doc_id", g.alias("g"), words.alias("words")).withColumn("a", F.when(n > 0, F.col("g") % n))
    looped = looped.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    made = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("words", at(i).cast("int")))
    looped = looped.select("doc_id", F.when(n > 0, F.array_join(made, " ")).alias("text"))
    return docs.where((h % 10 != 0) | F.col("doc_id").isNull()).select("doc_id", "text").union(looped)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, their digest and that of the collapsed text. A null doc_id isn't looped."""
    found = periodic.periodic_runs(_with_loops(_table(spark, sf_dir, "documents")))
    best = F.col("strongest")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return found.select(
        "doc_id", "n_runs", best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"), F.call_function("div", 1000 * best["length"], best["period"]).alias("exponent_milli"),
        digest(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"),
    )


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrase_collocations(_table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}

"""Quality rules: counts of one document, and lines that too many documents of a host share.

Only Spark SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_RUN, SPACES, materialize

WORD_CHAR = r"[^\x20\x09-\x0D]"


def let(value: Column, use) -> Column:
    """use(value) with value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.when(F.regexp_like(text, F.lit(WORD_CHAR)), F.split(F.btrim(text, F.lit(SPACES)), SPACE_RUN)).otherwise(F.array().cast("array<string>"))


def windows_of(words: Column, size: int) -> Column:
    """64-bit hashes of the windows of `size` words, in order; none in shorter texts."""

    def hashes(w: Column) -> Column:
        at = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0))), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size))))
        return F.when(F.size(w) >= size, at).otherwise(F.array().cast("array<bigint>"))

    return let(words, hashes)


def repeated_words(windows: Column, size: int) -> Column:
    """How many words lie in windows that occur twice or more."""

    def covered(at: Column) -> Column:  # sorted positions of repeated windows
        reach = F.transform(at, lambda p, i: F.least(F.coalesce(F.get(at, i + 1) - p, F.lit(size)), F.lit(size)))
        return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

    def repeats(s: Column) -> Column:  # (window, position), sorted
        same = lambda x, i: F.coalesce((F.get(s, i - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce((F.get(s, i + 1)["h"] == x["h"]), F.lit(False))
        return let(F.sort_array(F.transform(F.filter(s, same), lambda x: x["p"])), covered)

    def count(h: Column) -> Column:
        slow = let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), repeats)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(slow)

    return let(windows, count)


def count_columns(text: Column, window: int = 5) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(WORD_CHAR)))
    words = words_of(text)
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(windows_of(words, window), window).cast("long"),
    }


def normal_line(line: Column) -> Column:
    """What counts as the same line: lower case, white space runs as one space, digits alike."""
    return F.regexp_replace(F.lower(F.btrim(F.regexp_replace(line, SPACE_RUN, " "))), "[0-9]+", "0")


def spared_lines(hits: DataFrame, counts: DataFrame, hosts: DataFrame, min_documents: int, min_share: float, least_left: float) -> DataFrame:
    """Which document of a host keeps each frequent line that is copied content: (_host, line, _key).

    hits: _host, _key, line, times, words of frequent lines; counts: _host, _key, n_words, base_failed; hosts: _host, of.
    A document is depleted if only its frequent lines reject it. A line stays boilerplate where
    documents that aren't depleted are enough to make it frequent. Every other line of depleted
    documents goes to the one of them with most words in such lines, of those that have enough with
    them. So that one keeps all it has of them; a line it lacks may go to a copy that is still rejected.
    """
    key, lost = ["_host", "_key"], F.col("times") * F.col("words")
    removed = hits.groupBy(*key).agg(F.sum(lost).alias("lost"))
    state = removed.join(counts, key).withColumn("depleted", ~F.col("base_failed") & (F.col("n_words") - F.col("lost") < least_left * F.col("n_words")))
    hits = materialize(hits.join(state.drop("base_failed"), key))
    boilerplate = hits.where(~F.col("depleted")).groupBy("_host", "line").agg(F.count("*").alias("n")).where(F.col("n") > min_documents)
    boilerplate = boilerplate.join(hosts, "_host").where(F.col("n") > min_share * F.col("of")).select("_host", "line")
    copied = hits.where("depleted").join(boilerplate, ["_host", "line"], "left_anti")
    enough = F.col("n_words") - F.col("lost") + F.col("copied") >= least_left * F.col("n_words")
    holders = copied.groupBy(*key).agg(F.sum(lost).alias("copied"), F.first("n_words").alias("n_words"), F.first("lost").alias("lost")).where(enough).select(*key, "copied")
    owner = copied.select(*key, "line").join(holders, key).groupBy("_host", "line").agg(F.max(F.struct("copied", "_key")).alias("owner"))
    return owner.select("_host", "line", F.col("owner._key").alias("_key"))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def line_frequency_rules(
    docs: DataFrame, min_documents: int = 10, min_share: float = 0.01, least_left: float = 0.2, salts: int = 16,
    count_texts: bool = False, copies_once: bool = False, keep_text: bool = True,
) -> DataFrame:
    """docs with their counts, what lines go, and whether they stay.

    docs: doc_id, text, source (the host; null is a host of its own) and any other columns, which stay unless their names
    clash with those added. A line goes where more than min_documents documents of its host, and
    more than min_share of them, have it. A document is a doc_id, or where that is null a text; it
    counts once however often it holds a line. Added: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, n_removed_words, removed_lines (hashes of normalised lines), kept:
    not base_failed, and at least least_left of the words are left. Null text is as empty text.
    Repeated rows each get the same result; an empty table stays empty. A line that a third of all documents hold is counted
    map-side first, and its rows are dealt over `salts` keys when joined.
    count_texts: exact copies count as one document, so that copied documents aren't taken for boilerplate.
    copies_once: near copies differ as texts, so more than min_documents of them make their own
    content frequent and are all rejected. With it, lines that only such documents make frequent
    stay in one of them (spared_lines) and go from the others; it needs count_texts.
    keep_text: without it the text is left out and read once only.
    """
    added = [*COUNTS, "n_removed_words", "removed_lines", "kept", "_text", "_host", "_key", "_doc", "_lines"]
    docs = docs.drop(*(c for c in docs.columns if c in added))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.withColumns({"_host": F.xxhash64(F.col("source")), "_key": F.xxhash64(F.lit(7), text)})
    by_id = F.col("_key") if count_texts else F.when(F.col("doc_id").isNull(), F.col("_key")).otherwise(F.xxhash64(F.lit(8), F.col("doc_id")))
    filled = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(WORD_CHAR)))
    lines = F.transform(filled, lambda x: F.struct(F.xxhash64(normal_line(x)).alias("line"), F.size(words_of(x)).cast("int").alias("words")))
    seen = docs.withColumns(count_columns(text) | {"_doc": by_id, "_lines": lines}).drop("text")
    seen = seen.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    seen = materialize(seen)  # all that the rules need of a text, read once

    hosts = seen.groupBy("_host", "_doc").agg(F.lit(1).alias("one")).groupBy("_host").agg(F.count("*").alias("of"))
    holders = seen.select("_host", "_doc", F.explode("_lines.line").alias("line")).groupBy("_host", "line", "_doc").agg(F.lit(1).alias("one"))
    frequent = holders.groupBy("_host", "line").agg(F.count("*").alias("n")).where(F.col("n") > min_documents)
    frequent = frequent.join(hosts, "_host").where(F.col("n") > min_share * F.col("of")).select("_host", "line", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    texts = seen.select("_host", "_key", *COUNTS, "_lines").dropDuplicates(["_host", "_key"])
    in_text = texts.select("_host", "_key", F.explode("_lines").alias("x")).groupBy("_host", F.col("x.line").alias("line"), "_key").agg(F.count("*").alias("times"), F.max("x.words").alias("words"))
    hits = in_text.withColumn("salt", F.pmod(F.col("_key"), F.lit(salts)).cast("int")).join(frequent, ["_host", "line", "salt"]).drop("salt")
    if copies_once:
        hits = materialize(hits)
        counts = texts.select("_host", "_key", *COUNTS)
        hits = hits.join(spared_lines(hits, counts, hosts, min_documents, min_share, least_left), ["_host", "line", "_key"], "left_anti")
    gone = hits.groupBy("_host", "_key").agg(F.sum(F.col("times") * F.col("words")).alias("n_removed_words"), F.collect_set("line").alias("removed_lines"))

    if keep_text:  # the texts' one join is with rows that are short
        out = docs.join(materialize(texts.drop("_lines").join(gone, ["_host", "_key"], "left")), ["_host", "_key"])
    else:
        out = seen.drop("_lines", "_doc").join(gone, ["_host", "_key"], "left")
    out = out.withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long")).withColumn("removed_lines", F.coalesce("removed_lines", F.array().cast("array<bigint>")))
    left = F.col("n_words") - F.col("n_removed_words") >= least_left * F.col("n_words")
    return out.withColumn("kept", ~F.col("base_failed") & left).drop("_host", "_key")


def without_removed(text: Column, removed: Column) -> Column:
    """text without the lines whose hashes are in removed."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~(F.regexp_like(x, F.lit(WORD_CHAR)) & F.array_contains(removed, F.xxhash64(normal_line(x)))))
    return F.when(F.size(removed) > 0, F.array_join(kept, "\n")).otherwise(text)

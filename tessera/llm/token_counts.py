"""Token counts of whole texts by a public tokenizer's own library: encoded in batches, lengths alone returned.

A text is cut at safe boundaries, where the tokenizer never joins what lies on both sides, so that
the counts of the stretches add up to the text's. Stretches repeat from text to text: each task sends
those it hasn't met in a while to the library, in batches of about equal bytes, and adds up numbers.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.vocab import sentencepiece_model, vocabulary_path

COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Bytes of text that are taken together, and that go to the library in one call.
BATCH_BYTES = 1 << 20
#: Stretches whose counts a task keeps, and the longest that is kept, in characters.
KEPT, KEPT_CHARS = 1 << 19, 64

#: Byte-level: white space and what follows it. White space of other kinds right before a boundary belongs to the same run, so the stretch goes on.
_BYTE_LEVEL = re.compile(r"[ \t\n\r]*[^ \t\n\r]+(?:(?<=[^\S \t\n\r]|[\u180e\u200b\ufeff])[ \t\n\r]+[^ \t\n\r]+)*|[ \t\n\r]+")
#: Pieces: spaces and what follows them, spaces at the end with what is before. The sign for a space may stand in a text too.
_PIECES = re.compile(r" *[^ ]+(?:(?<=▁) +[^ ]+)*(?: +\Z)?| +")


def _whole(text: str) -> list[str]:
    return [text] if text else []


def _stretches(text: str) -> list[str]:
    return _BYTE_LEVEL.findall(text)


def _pieces(text: str) -> list[str]:
    """The library puts a space before what it is given: a stretch after the first hands over without its own."""
    found = _PIECES.findall(text)
    return found[:1] + [x[1:] for x in found[1:]]


def _plain_byte_level(whole: dict) -> bool:
    """Whether a tokenizer is byte-level over its usual pattern and changes, adds or strips nothing else."""
    before = whole.get("pre_tokenizer") or {}
    usual = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    simple = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and not re.search(r"\s", t["content"]) for t in whole["added_tokens"])
    return usual and whole.get("normalizer") is None and simple


@lru_cache(4)
def counter(path: str) -> tuple[Callable[[str], list[str]], Callable[[list[str]], list[int]]]:
    """For a vocabulary file: how to cut a text into stretches, and the library's token count of each stretch of a batch.

    .json is left to tokenizers and .model to sentencepiece, both without begin, end or added special
    tokens; strings of special tokens within a text count as the library takes them by default. Where
    the vocabulary isn't known to have safe boundaries, a text is one stretch.
    """
    if path.endswith(".model"):
        from sentencepiece import sentencepiece_model_pb2 as protocol

        model, form = sentencepiece_model(path), protocol.ModelProto()
        with open(path, "rb") as f:
            form.ParseFromString(f.read())
        spec = form.normalizer_spec
        plain = spec.name == "identity" and spec.add_dummy_prefix and not spec.remove_extra_whitespaces
        inner = any("▁" in p.piece.lstrip("▁") or " " in p.piece for p in form.pieces)
        return (_pieces if plain and not inner else _whole), lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    if not path.endswith(".json"):
        raise ValueError(f"no library is named for {path}")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    with open(path, encoding="utf-8") as f:
        cut = _stretches if _plain_byte_level(json.load(f)) else _whole
    return cut, lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def by_bytes(sizes: Iterable[int], most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours that hold about `most` bytes each; something larger is a range of its own."""
    first, held, at = 0, 0, -1
    for at, size in enumerate(sizes):
        if held and held + size > most:
            yield first, at
            first, held = at, 0
        held += size
    if at >= first:
        yield first, at + 1


class Counts(dict):
    """Stretch to token count. Forgets what it knows when it has grown to KEPT entries."""

    def __init__(self, count: Callable[[list[str]], list[int]]) -> None:
        self.count = count

    def learn(self, stretches: set[str]) -> None:
        if len(self) > KEPT:
            self.clear()
        fresh = [x for x in stretches if x not in self]
        for lo, hi in by_bytes(map(len, fresh)):
            self.update(zip(fresh[lo:hi], self.count(fresh[lo:hi])))

    def forget_long(self, stretches: set[str]) -> None:
        for x in stretches:
            if len(x) > KEPT_CHARS:
                del self[x]


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = 512) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    docs: doc_id, text; other columns are ignored, whatever their names. A null text counts as an empty
    one (0 bytes, 0 tokens), a null doc_id stays null, repeated rows each give a row, an empty table
    gives none. Texts are counted whole, however long: nothing is truncated or padded.
    vocabulary: a .json file for tokenizers or a .model file for sentencepiece; executors open it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, count = counter(vocabulary or vocabulary_path("byte_bpe_50k.json"))
        known = Counts(count)
        for batch in batches:
            n_bytes = pc.binary_length(batch.column(1)).to_pylist()
            n_tokens: list[int] = []
            for lo, hi in by_bytes(n_bytes):
                cuts = [cut(text) for text in batch.column(1).slice(lo, hi - lo).to_pylist()]
                met = set().union(*cuts)
                known.learn(met)
                n_tokens += [sum(map(known.__getitem__, stretches)) for stretches in cuts]
                known.forget_long(met)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, COUNTS)

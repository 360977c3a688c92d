"""Public vocabularies, opened once in each Python worker. Their files are parameters and stay where they are."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(4)
def byte_bpe(path: str | None = None):
    """The byte-level BPE in a file of ranks; its ids equal those of the same vocabulary's JSON form without its added tokens."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path or vocabulary_path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: A white-space run from which a text is left to tokenizers: tiktoken's pattern overflows its stack between 500,000 and 1,000,000 characters.
LONG_RUN = 100_000


@lru_cache(4)
def byte_encoder(path: str | None = None) -> Callable[[str], list[int]]:
    """The ids that tokenizers' encode(text, add_special_tokens=False) gives over the vocabulary's JSON form.

    path: the file of ranks; the JSON form lies beside it under the same name. tiktoken gives the same ids
    in less time, except where a text holds an added token's text (one id there) or a very long white-space run.
    """
    from tokenizers import Tokenizer

    ordinary = byte_bpe(path).encode_ordinary
    whole = Tokenizer.from_file(os.path.splitext(path or vocabulary_path("byte_bpe_50k.tiktoken"))[0] + ".json")
    added = [token.content for token in whole.get_added_tokens_decoder().values()]
    runs = re.compile(r"\s+")

    def encode(text: str) -> list[int]:
        if any(token in text for token in added) or len(text) >= LONG_RUN and any(m.end() - m.start() >= LONG_RUN for m in runs.finditer(text)):
            return whole.encode(text, add_special_tokens=False).ids
        return ordinary(text)

    return encode


@lru_cache(4)
def byte_pieces(path: str | None = None) -> dict[bytes, int]:
    """Piece to id of the byte-level vocabulary; every single byte is a piece."""
    with open(path or vocabulary_path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(4)
def sentencepiece_model(path: str | None = None):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path or vocabulary_path("piece_bpe_32k.model"))


class HashedPieces:
    """Looks up many pieces at once by rolling hashes of their characters (or bytes), in a two-way table."""

    STEP, BITS, MIXES = np.uint64(0x9E3779B97F4A7C15), 19, (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))

    def __init__(self, pieces: list) -> None:
        """pieces: sequences of whole numbers, as bytes or code points; find() gives places in this list."""
        self.longest = max(map(len, pieces))
        self.hashes = np.zeros(len(pieces), np.uint64)
        sizes = np.array([len(p) for p in pieces])
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            rows = np.array([list(pieces[i]) for i in at], np.uint64)
            for k in range(n):
                self.hashes[at] = self.extend(self.hashes[at], rows[:, k])
        self.tables = [np.full(1 << self.BITS, -1, np.int32) for _ in self.MIXES]
        for number, slots in enumerate(zip(*(x.tolist() for x in self._slots(self.hashes)))):
            free = next((k for k, slot in enumerate(slots) if self.tables[k][slot] < 0), None)
            if free is None:
                raise ValueError("the vocabulary doesn't fit the table")
            self.tables[free][slots[free]] = number

    def extend(self, h: np.ndarray, char: np.ndarray) -> np.ndarray:
        return h * self.STEP + char + np.uint64(1)

    def _slots(self, h: np.ndarray) -> list[np.ndarray]:
        x = h ^ (h >> np.uint64(32))
        return [((x * m) >> np.uint64(64 - self.BITS)).astype(np.int64) for m in self.MIXES]

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of the piece with each hash, or -1."""
        first, second = (table[slot] for table, slot in zip(self.tables, self._slots(h)))
        return np.where((first >= 0) & (self.hashes[first] == h), first, np.where((second >= 0) & (self.hashes[second] == h), second, -1))

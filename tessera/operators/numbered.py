"""Words of batches of texts as numbers: what a word stands for is worked out once, and the rest is arithmetic on arrays."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa

#: Bytes of texts, texts and words that are held at a time, and words kept between them.
TEXT_BYTES, TEXTS, WORDS, KEPT = 1 << 22, 1024, 1 << 18, 1 << 19


class Numbered(dict):
    """Words by number; entries(word) of word n are flat[starts[n]:starts[n + 1]]."""

    def __init__(self, pattern: bytes, entries: Callable[[bytes], list[int]]):
        super().__init__()
        self.pattern, self.entries, self.flat, self.starts = re.compile(pattern), entries, array("q"), array("q", [0])

    def __missing__(self, word: bytes) -> int:
        self.flat.extend(self.entries(word))
        self.starts.append(len(self.flat))
        self[word] = n = len(self)
        return n

    def words(self, text: bytes) -> Iterator[np.ndarray]:
        """The numbers of a text's words, WORDS at a time."""
        found = iter(self.pattern.findall(text)) if len(text) <= TEXT_BYTES else (m[0] for m in self.pattern.finditer(text))
        while len(some := np.fromiter(map(self.__getitem__, islice(found, WORDS)), np.int64)):
            yield some

    def expanded(self, texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places of texts, entries of their words in turn), those of about WORDS words at a time."""
        owners, held, size = [], [], 0
        for k, text in enumerate(texts):
            for some in self.words(text or b""):
                owners.append(np.full(len(some), k))
                held.append(some)
                size += len(some)
                if size >= WORDS:
                    yield self._entries(owners, held)
                    owners, held, size = [], [], 0
        if held:
            yield self._entries(owners, held)
        if len(self) > KEPT:
            self.clear()
            self.flat, self.starts = array("q"), array("q", [0])

    def _entries(self, owners: list[np.ndarray], held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        ids, flat, starts = np.concatenate(held), np.array(self.flat), np.array(self.starts)
        many = starts[ids + 1] - starts[ids]
        return np.repeat(np.concatenate(owners), many), flat[spread(starts[ids], many)]


def spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, as many as it has."""
    return np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)


def blocks(column: pa.Array, most: int = TEXTS) -> Iterator[tuple[int, list[bytes | None]]]:
    """A binary column in turn, at most so many values and about TEXT_BYTES at a time: the place of the first, and the values."""
    at = 0
    while at < len(column):
        some, held, first = [], 0, at
        while at < len(column) and held < TEXT_BYTES and len(some) < most:
            some.append(column[at].as_py())
            held += len(some[-1] or b"")
            at += 1
        yield first, some

"""Words of many texts at once, in arrays: where they are and a 64-bit hash of each."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

_FAR = 256
_WEIGHTS = np.random.default_rng(11).integers(1, 2**63, _FAR, np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def spread(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices flat[start : start + length], end to end."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass(frozen=True)
class Words:
    """Words of texts laid end to end: bytes raw[starts : starts + lengths]; those of text k are bounds[k] to bounds[k + 1]."""

    raw: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray

    def bytes(self, k: int) -> bytes:
        return self.raw[self.starts[k] : self.starts[k] + self.lengths[k]].tobytes()


def words_of(texts: list[str] | list[bytes], lower: bool = False, alnum: bool = False) -> Words:
    """Words without ASCII white space, or (alnum) of ASCII lower-case letters, digits and what is outside ASCII."""
    data = [t.encode() if isinstance(t, str) else t for t in texts]
    joined = b"\n".join([*data, b""])
    raw = np.frombuffer(joined.lower() if lower else joined, np.uint8)
    inside = _ALNUM[raw] if alnum else ~_BLANK[raw]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    sizes = np.fromiter(map(len, data), np.int64, len(data)) + 1
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    if not len(starts):
        return Words(raw, starts, starts, bounds, np.zeros(0, np.uint64))
    lengths = ends - starts
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, np.diff(starts, append=len(raw)))
    values = _WEIGHTS[np.minimum(place, _FAR - 1)] * (raw[starts[0] :].astype(np.uint64) + np.uint64(1))
    values[~inside[starts[0] :]] = 0
    hashes = np.add.reduceat(values, starts - starts[0]) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in np.flatnonzero(lengths >= _FAR):
        hashes[k] = xxhash.xxh64_intdigest(raw[starts[k] : ends[k]].tobytes())
    return Words(raw, starts, lengths, bounds, mixed(hashes))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and where its texts begin, and the last ends, in them, as they lie in memory; nulls are empty."""
    size = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    begins = np.frombuffer(offsets, size)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), begins


def texts_of(column: pa.Array, span: int) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a string column as bytes, about `span` of them at a time: the number of the first, and the texts.

    A longer text comes alone, whole. Only what is yielded is copied.
    """
    raw, begins = utf8(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(begins, begins[at] + span, "right")) - 1)
        yield at, [raw[a:b].tobytes() for a, b in zip(begins[at:end], begins[at + 1 : end + 1], strict=True)]
        at = end


def batches_of(texts: list[str], span: int):
    """Ranges of texts of about so many characters; a longer text is a range of its own."""
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= span):
            held += len(texts[end])
            end += 1
        yield at, end
        at = end

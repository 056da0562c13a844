"""Equal windows of many byte strings by blockwise suffix sorting with a difference cover.

The strings of a block lie end to end. The cover holds the positions whose remainder by PERIOD is in COVER: of any two
positions there is a distance under PERIOD at which both are followed by one of it. The suffixes at the cover are sorted
first (by doubling, from PERIOD bytes up) with the common prefixes of neighbours in that order.

Then the suffixes of one bucket after another are sorted, all buckets of a block side by side: three ways about a pivot, by
their first PERIOD bytes and, where those tie, by the ranks of the cover suffixes that follow both at the same distance. So
a comparison takes constant time however long the tie is, and what is held is the block and its cover.
"""

from __future__ import annotations

import numpy as np

#: A perfect difference set; every remainder is the difference of two of its members.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
_WORD = 8


def _distances() -> np.ndarray:
    """For remainders a and b the least distance at which both a and b reach the cover."""
    inside = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
    reach = np.stack([inside[k : k + PERIOD] for k in range(PERIOD)])  # by remainder and distance
    return (reach[:, None, :] & reach[None, :, :]).argmax(axis=2).astype(np.int8)


DISTANCE = _distances()


def words(flat: np.ndarray, room: int) -> np.ndarray:
    """The eight bytes from each position on as a number that sorts like them; zeros follow the end, `room` positions on."""
    padded = np.concatenate([flat, np.zeros(room + _WORD, np.uint8)])
    out = np.zeros(len(flat) + room, np.uint64)
    for k in range(_WORD):
        out = (out << np.uint64(8)) | padded[k : k + len(out)]
    return out


def equal_bytes(difference: np.ndarray) -> np.ndarray:
    """How many leading bytes two words share, from their exclusive or."""
    out = np.zeros(len(difference), np.int64)
    for k in range(_WORD):
        out += difference < np.uint64(1 << 8 * k)
    return out


class Cover:
    """Ranks of the suffixes at the cover's positions, told apart by `length` bytes, and what neighbours share."""

    def __init__(self, word: np.ndarray, size: int, length: int):
        self.length = length
        at = (np.arange(size // PERIOD + 1)[:, None] * PERIOD + np.array(COVER)).ravel()
        at = at[at < size]
        self.place = np.full(size + PERIOD, -1, np.int32)  # of a position, its number in the cover
        self.place[at] = np.arange(len(at))
        # the first PERIOD bytes: four words, the last of which overlaps
        keys = [word[at + k] for k in (0, _WORD, 2 * _WORD, PERIOD - _WORD)]
        rank = self.dense(np.lexsort(keys[::-1]), keys)
        reach = PERIOD
        while reach < length:  # positions PERIOD apart are in the cover together
            later = self.place[np.minimum(at + reach, size + PERIOD - 1)]
            pair = rank * np.int64(len(at) + 1) + np.where(later >= 0, rank[later] + 1, 0)
            rank = self.dense(np.argsort(pair, kind="stable"), [pair])
            reach *= 2
        order = np.argsort(rank, kind="stable")
        self.rank = np.empty(len(at), np.int32)
        self.rank[order] = np.arange(len(at))
        a, b = at[order[:-1]], at[order[1:]]
        shared = np.zeros(len(a), np.int64)
        open_ = np.arange(len(a))
        for k in range(0, length, _WORD):
            same = equal_bytes(word[a[open_] + k] ^ word[b[open_] + k])
            shared[open_] += same
            open_ = open_[same == _WORD]
        # least of each run of 2 ** level neighbours, for the least of any run in two looks
        self.least = [np.minimum(shared, length).astype(np.uint8)]
        while 2 ** len(self.least) <= len(shared):
            half = 2 ** (len(self.least) - 1)
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))

    @staticmethod
    def dense(order: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
        new = np.zeros(len(order), bool)
        for key in keys:
            sorted_ = key[order]
            new[1:] |= sorted_[1:] != sorted_[:-1]
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(new)
        return out

    def compared(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each pair of cover positions: the order of their first `length` bytes."""
        x, y = self.rank[self.place[a]], self.rank[self.place[b]]
        low, high = np.minimum(x, y), np.maximum(x, y)
        out = np.sign(x - y)
        apart = np.flatnonzero(out)
        low, count = low[apart], (high - low)[apart]
        level = np.frexp(count.astype(np.float64))[1] - 1
        shared = np.empty(len(apart), np.int64)
        for k in range(len(self.least)):
            mine = np.flatnonzero(level == k)
            if len(mine):
                row, first = self.least[k], low[mine]
                shared[mine] = np.minimum(row[first], row[first + count[mine] - (1 << k)])
        out[apart[shared >= length[apart]]] = 0
        return out


class Suffixes:
    """A block of bytes with its cover."""

    def __init__(self, flat: np.ndarray, length: int):
        self.length, self.word = length, words(flat, length + 4 * PERIOD)
        self.cover = Cover(self.word, len(flat), length)

    def repeats(self, at: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Whether each window equals an earlier one of its bucket.

        Windows are the `length` bytes at positions `at`, in order of age; equal windows must have one bucket.
        """
        word = self.word
        order = np.argsort(bucket, kind="stable")
        group = np.cumsum(np.diff(bucket[order], prepend=bucket[order[:1]]) != 0)
        out = np.zeros(len(at), bool)
        while len(order):
            starts = np.flatnonzero(np.diff(group, prepend=-1))
            sizes = np.diff(starts, append=len(order))
            if (sizes == 1).any():  # alone: equals nothing
                stay = np.repeat(sizes > 1, sizes)
                order, sizes = order[stay], sizes[sizes > 1]
                if not len(order):
                    break
                starts = np.cumsum(sizes) - sizes
            group = np.repeat(np.arange(len(sizes)), sizes)
            mine, pivot = at[order], np.repeat(at[order[starts + sizes // 2]], sizes)
            side = np.zeros(len(order), np.int8)
            open_ = np.arange(len(order))
            for k in (0, _WORD, 2 * _WORD, PERIOD - _WORD):
                x, y = word[mine[open_] + k], word[pivot[open_] + k]
                side[open_] = (x > y).astype(np.int8) - (x < y)
                open_ = open_[x == y]
            distance = DISTANCE[mine[open_] % PERIOD, pivot[open_] % PERIOD].astype(np.int64)
            side[open_] = self.cover.compared(mine[open_] + distance, pivot[open_] + distance, self.length - distance)
            same = np.flatnonzero(side == 0)  # each group's are in order of age: the first is the eldest
            out[order[same[np.diff(group[same], prepend=-1) == 0]]] = True
            rest = np.flatnonzero(side)
            label = 2 * group[rest] + (side[rest] > 0)
            sorted_ = np.argsort(label, kind="stable")
            order, group = order[rest[sorted_]], label[sorted_]
        return out

"""Maps of fixed size that mark the 64-bit hashes which occur often enough in a table.

They let a second pass over a large table drop, where it is read, nearly all hashes that meet no other: what is not marked
is rarer than asked for certain. A mark by chance only lets a hash through that an exact step then drops. A map's size is
bounded (MOST bits), so it may pass through the driver and be broadcast.

Counting goes by slots, SLOTS for each bit. Tasks don't send hashes: each sorts what it has read and sends, for each chunk of
slots, the distances between those taken (two bytes each) and the numbers of those taken more than once. A reducer adds
them up chunk by chunk; it holds one chunk, however many tasks there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, MOST, SLOTS = 1 << 20, 1 << 29, 64
#: Hashes that a task sorts at a time, and slots of a chunk while a map has fewer than CHUNKS of them.
HELD, CHUNK, CHUNKS = 1 << 20, 1 << 23, 1 << 10
_FAR = 0xFFFF


def bits_for(rows: DataFrame, a_byte: float = 0.25) -> int:
    """Bits of a map: so many for each byte of rows that the planner expects, a power of two between LEAST and MOST."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(MOST, max(LEAST, 1 << (int(size * a_byte) - 1).bit_length()))


def held(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash (uint64) is marked in the map's bytes; a hash's bit is its first digits."""
    bit = hashes >> np.uint64(64 - (8 * len(marks)).bit_length() + 1)
    return (marks[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def distances(sorted_values: np.ndarray) -> bytes:
    """Sorted distinct values below 2 ** 32 as two-byte steps; _FAR is a step that ends nowhere."""
    step = np.diff(sorted_values, prepend=0)
    far = step // _FAR
    out = np.full(len(step) + int(far.sum()), _FAR, np.uint16)
    out[np.cumsum(far + 1) - 1] = step % _FAR
    return out.tobytes()


def places(packed: bytes) -> np.ndarray:
    """The values of distances()."""
    step = np.frombuffer(packed, np.uint16)
    return np.cumsum(step, dtype=np.int64)[step != _FAR]


def counted(rows: DataFrame, hashes_of: Callable, bits: int, least: tuple[int, ...]) -> list[bytes]:
    """A map for each number in `least` (65,535 at most): of the hashes that occur so often or more.

    hashes_of turns an iterator of Arrow batches of rows into one of uint64 arrays; it runs on the executors.
    """
    digits = np.uint64(64 - (bits * SLOTS).bit_length() + 1)
    chunk = max(CHUNK, bits * SLOTS // CHUNKS)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed(parts: list[np.ndarray]) -> pa.RecordBatch:
            slots, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]) >> digits, return_counts=True)
            slots = slots.astype(np.int64)
            ends = np.searchsorted(slots, np.arange(0, bits * SLOTS + 1, chunk))
            rows = []
            for c in np.flatnonzero(np.diff(ends)):
                mine, often = slots[ends[c] : ends[c + 1]] - c * chunk, counts[ends[c] : ends[c + 1]]
                more = np.flatnonzero(often > 1)
                rows.append((int(c), distances(mine), distances(more), np.minimum(often[more], _FAR).astype(np.uint16).tobytes()))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["chunk", "taken", "more", "counts"])

        parts, size = [], 0
        for hashes in hashes_of(batches):
            for at in range(0, len(hashes), HELD):
                parts.append(hashes[at : at + HELD])
                size += len(parts[-1])
                if size >= HELD:
                    yield flushed(parts)
                    parts, size = [], 0
        if size:
            yield flushed(parts)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(0, np.uint16)

        def marked() -> pa.RecordBatch:
            maps = [np.packbits((total >= n).reshape(-1, SLOTS).any(axis=1), bitorder="little").tobytes() for n in least]
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), *(pa.array([m], pa.binary()) for m in maps)], names=["chunk", *names])

        for batch in batches:
            for c, taken, more, counts in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != now:
                    if now is not None:
                        yield marked()
                    now, total = c, np.zeros(chunk, np.uint16)
                at = places(taken)
                plus = np.ones(len(at), np.int64)
                plus[places(more)] = np.frombuffer(counts, np.uint16)
                total[at] = np.minimum(total[at] + plus, _FAR)
        if now is not None:
            yield marked()

    names = [f"map{k}" for k in range(len(least))]
    lists = rows.mapInArrow(sent, "chunk bigint, taken binary, more binary, counts binary")
    chunks = lists.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(added, "chunk bigint, " + ", ".join(f"{n} binary" for n in names))
    out = [bytearray(bits // 8) for _ in least]
    size = chunk // SLOTS // 8
    for row in chunks.collect():  # bits / 8 bytes for each map in all
        for k, name in enumerate(names):
            out[k][row["chunk"] * size : (row["chunk"] + 1) * size] = row[name]
    return [bytes(x) for x in out]


def column_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The hashes of a table with one column of them."""
    for batch in batches:
        yield batch.column(0).to_numpy().view(np.uint64)


def split_by(rows: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that may have their key in ids, rows that surely have not), without a shuffle of rows; nulls are of the first.

    The first part holds all rows with a key in ids and a few by chance: an exact join of it moves little.
    """
    [marked] = counted(ids.where(F.col(key).isNotNull()).select(F.xxhash64(key)), column_hashes, bits_for(ids, 4), (1,))
    marks = rows.sparkSession.sparkContext.broadcast(marked)
    hashed = rows.select(F.when(F.col(key).isNotNull(), F.xxhash64(key)).alias("hash of key"), *(rows[c] for c in rows.columns))

    def picked(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = np.frombuffer(marks.value, np.uint8)
            for batch in batches:
                column = batch.column(0)
                there = held(known, column.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)) | column.is_null().to_numpy(zero_copy_only=False)
                out = batch.filter(pa.array(there == wanted))
                yield pa.RecordBatch.from_arrays(out.columns[1:], names=out.schema.names[1:])

        return hashed.mapInArrow(run, rows.schema)

    return picked(True), picked(False)

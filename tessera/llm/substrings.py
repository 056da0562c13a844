"""Exact-substring dedup: bytes covered by a LENGTH-byte string that also starts earlier are removed.

Blockwise suffix sorting with a difference cover (covers.py), spread over a cluster:

1. Suffixes are dealt to buckets. A window of LENGTH bytes belongs to the bucket of its least GRAM-byte hash (the last of
   equals): equal windows have one bucket and one distance to that gram, whatever text they stand in. Windows whose bucket
   no other window shares equal nothing; a map of fixed size of the hashes that occur twice or more tells most of them
   where the text is read, and only the rest are sent, as one piece of bytes for each gram.
2. A task gets whole buckets and works on blocks of them, bounded in bytes. Pieces that are the same bytes are told apart by
   age at once. The windows of what is left are sorted bucket by bucket; ties longer than the cover's period are resolved by
   the ranks of the cover's suffixes. Every window but the eldest of equals is a copy.
3. A bucket that may hold more than Limits.hot pieces is split: its windows go by a 128-bit hash of all their bytes instead, of
   which each task sends only the eldest it has seen; the others are copies already. So no key holds more rows than there
   are tasks, and a block holds Limits.block bytes and one bucket at most.
4. The copies' ranges go to their texts. Texts without any are finished where they are read.

Marks by chance send a bucket of one piece or take a bucket by the other way: the maps change costs only, never the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import mixed, spread, texts_of
from .bitmap import bits_for, counted, held
from .common import table, written
from .covers import Suffixes

LENGTH, GRAM = 100, 24
_LOW = np.uint64(0xFFFFFF)
NO_ID = -(2**63)
#: Rows between tasks: a piece (lead: the bytes before its gram), the eldest window of a hash (more: its other half), or the
#: range of a copy (more: its end).
WINDOW, RANGE = -1, -2
SENT = "bucket bigint, lead int, more bigint, id bigint, text_key bigint, first bigint, piece binary"


@dataclass(frozen=True)
class Limits:
    """Bytes of text hashed at a time (under 2 ** 24); bytes of pieces sorted at a time; pieces of a bucket that is not split
    (under 65,535); windows that are sorted at a time, and that a task holds of split buckets before it sends the eldest. They
    bound memory, not results."""

    span: int = 1 << 19
    block: int = 1 << 19
    hot: int = 65_534
    held: int = 1 << 18


class Grams:
    """The windows of some texts by their least grams: windows that start from first to last have theirs at `at`."""

    def __init__(self, texts: list[bytes]):
        self.raw = raw = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begins = np.cumsum(sizes) - sizes
        none = np.zeros(0, np.int64)
        self.owner = self.first = self.last = self.at = none
        self.hash = self.every = none.astype(np.uint64)
        if len(raw) < LENGTH:
            return
        n = len(raw) - GRAM + 1
        words = np.zeros(len(raw) - 7, np.uint64)
        for k in range(8):
            words |= raw[k : len(raw) - 7 + k].astype(np.uint64) << np.uint64(8 * k)
        hashes = words[:n] * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
        hashes = (hashes + words[8 : n + 8]) * np.uint64(0xBF58476D1CE4E5B9)
        hashes ^= hashes >> np.uint64(31)
        hashes = mixed(hashes + words[16 : n + 16])
        low = (hashes & ~_LOW) | (_LOW - np.arange(n, dtype=np.uint64))
        width, reach = LENGTH - GRAM + 1, 1
        while 2 * reach <= width:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        rest = width - reach
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        ends = np.repeat(self.begins + sizes, sizes)
        starts = np.flatnonzero(np.arange(len(low)) + LENGTH <= ends[: len(low)])
        if not len(starts):
            return
        at = (_LOW - (low[starts] & _LOW)).astype(np.int64)
        owner = np.searchsorted(self.begins, starts, "right") - 1
        new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
        stop = np.append(new[1:], len(starts)) - 1
        # least hashes are small numbers: mixed again, their first digits are as good as the others
        self.every, self.owner, self.hash, self.first, self.last, self.at = hashes, owner[new], mixed(hashes[at[new]] + np.uint64(GRAM)), starts[new], starts[stop], at[new]

    def window_hashes(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for each window, from the grams that cover it."""
        a = b = np.zeros(len(starts), np.uint64)
        for k in (*range(0, LENGTH - GRAM, GRAM), LENGTH - GRAM):
            h = self.every[starts + k]
            a, b = mixed(a + h + np.uint64(k + 1)), mixed((b ^ h) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k))
        return a, b


def text_key(data: bytes) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(data)).view(np.int64))


def parts_of(column: pa.Array, span: int) -> Iterator[tuple[list[int], list[int], list[bytes], list[bytes]]]:
    """(rows, offsets, parts, whole texts) to work on together; a text over span goes in parts that overlap by LENGTH - 1, so
    that each window is in exactly one part."""
    for at, texts in texts_of(column, span):
        if len(texts) == 1 and len(texts[0]) > span:
            for k in range(0, max(len(texts[0]) - LENGTH + 1, 1), span):
                yield [at], [k], [texts[0][k : k + span + LENGTH - 1]], texts
        else:
            yield list(range(at, at + len(texts))), [0] * len(texts), texts, texts


def gram_hashes(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for _, _, parts, _ in parts_of(batch.column(0), span):
            yield Grams(parts).hash


def identified(docs: DataFrame) -> DataFrame:
    """(id, text): doc_id as a number, a null as the least."""
    if not isinstance(docs.schema["doc_id"].dataType, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        raise TypeError("doc_id must be of an integer type: its order says which text is earlier")
    return docs.select(own_id(F.col("doc_id")).alias("id"), "text")


def own_id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("bigint"), F.lit(NO_ID))


class Eldest:
    """The eldest window of each hash that a task has seen of split buckets, and the ranges of the others."""

    def __init__(self, held: int):
        self.held = held
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Columns: two hashes, id, text_key, start."""
        for a in range(0, len(columns[0]), self.held):
            self.parts.append(tuple(c[a : a + self.held] for c in columns))
            self.size += len(self.parts[-1][0])
            if self.size >= self.held:
                yield from self.settled(self.held // 2)

    def settled(self, most: int) -> Iterator[pa.RecordBatch]:
        """The ranges of copies; the eldest too if there are more than `most`."""
        if not self.size:
            return
        a, b, ids, keys, starts = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((starts, keys, ids, b, a))
        a, b, ids, keys, starts = (x[order] for x in (a, b, ids, keys, starts))
        eldest = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        copy = ~eldest
        same = np.append(False, (ids[1:] == ids[:-1]) & (keys[1:] == keys[:-1]) & (starts[1:] == starts[:-1]))
        yield ranges_of(ids, keys, starts, copy & ~same)  # a repeated row is not earlier than itself
        a, b, ids, keys, starts = (x[eldest] for x in (a, b, ids, keys, starts))
        if len(a) > most:
            yield sent_batch(a.view(np.int64), np.full(len(a), WINDOW), b.view(np.int64), ids, keys, starts)
            self.parts, self.size = [], 0
        else:
            self.parts, self.size = [(a, b, ids, keys, starts)], len(a)


def merged(ids: np.ndarray, keys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows' starts to (ids, keys, first byte, end) of runs of neighbours in one text."""
    order = np.lexsort((starts, keys, ids))
    ids, keys, starts = ids[order], keys[order], starts[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]) | (starts[1:] > starts[:-1] + 1)
    at = np.flatnonzero(new)
    return ids[at], keys[at], starts[at], starts[np.append(at[1:], len(ids)) - 1] + LENGTH if len(at) else starts[:0]


def ranges_of(ids: np.ndarray, keys: np.ndarray, starts: np.ndarray, copy: np.ndarray) -> pa.RecordBatch:
    ids, keys, first, end = merged(ids[copy], keys[copy], starts[copy])
    return sent_batch(mixed(keys.view(np.uint64)).view(np.int64), np.full(len(ids), RANGE), end, ids, keys, first)


def sent_batch(bucket, lead, more, ids, keys, first, piece: pa.Array | None = None) -> pa.RecordBatch:
    piece = pa.nulls(len(bucket), pa.binary()) if piece is None else piece
    return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(lead.astype(np.int32)), *map(pa.array, (more, ids, keys, first)), piece], names=[x.split()[0] for x in SENT.split(", ")])


def binaries(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(spread(raw, starts, sizes))])


def sent(docs: DataFrame, repeated: bytes, hot: bytes, limits: Limits) -> DataFrame:
    """Rows SENT of (id, text): pieces of buckets, the eldest windows of split buckets, and ranges that are copies already."""
    shipped = docs.sparkSession.sparkContext.broadcast((repeated, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, split = (np.frombuffer(x, np.uint8) for x in shipped.value)
        eldest = Eldest(limits.held)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for rows, offsets, parts, texts in parts_of(batch.column(1), limits.span):
                g = Grams(parts)
                keep = np.flatnonzero(held(known, g.hash))
                if not len(keep):
                    continue
                own = g.owner[keep]
                keys = np.array([text_key(t) for t in texts], np.int64)[own] if len(texts) > 1 else np.full(len(keep), text_key(texts[0]))
                base = np.array(offsets)[own] - g.begins[own]
                whose, hash_, first, last, at = ids[rows][own], g.hash[keep], g.first[keep], g.last[keep], g.at[keep]
                many = held(split, hash_)
                if many.any():
                    count = (last - first + 1)[many]
                    ends = np.cumsum(count)
                    starts = np.repeat(first[many] - (ends - count), count) + np.arange(ends[-1])
                    spans = [np.repeat(x[many], count) for x in (whose, keys, base)]
                    yield from eldest.add(*g.window_hashes(starts), spans[0], spans[1], starts + spans[2])
                few = np.flatnonzero(~many)
                for a in range(0, len(few), 1 << 13):
                    k = few[a : a + (1 << 13)]
                    data = binaries(g.raw, first[k], last[k] - first[k] + LENGTH)
                    yield sent_batch(hash_[k].view(np.int64), at[k] - first[k], np.zeros(len(k), np.int64), whose[k], keys[k], first[k] + base[k], data)
        yield from eldest.settled(-1)

    return docs.mapInArrow(run, SENT)


def copied_pieces(h: np.ndarray, ids: np.ndarray, keys: np.ndarray, first: np.ndarray, lead: np.ndarray, piece: pa.Array, held: int) -> Iterator[pa.RecordBatch]:
    """The ranges of the windows of pieces that are copies; whole buckets."""
    order = np.lexsort((first, keys, ids))
    same = np.append(False, (np.diff(ids[order]) == 0) & (np.diff(keys[order]) == 0) & (np.diff(first[order]) == 0))
    order = order[~same]  # repeated rows are one text
    h, ids, keys, first, lead = (x[order] for x in (h, ids, keys, first, lead))
    offsets = np.frombuffer(piece.buffers()[1], np.int32)[piece.offset : piece.offset + len(piece) + 1].astype(np.int64)
    starts, sizes = offsets[:-1][order], np.diff(offsets)[order]
    flat = spread(np.frombuffer(piece.buffers()[2], np.uint8), starts, sizes)
    at = np.cumsum(sizes) - sizes
    # equal pieces: all but the eldest are copies as a whole
    place = np.arange(len(flat)) - np.repeat(at, sizes)
    digest = np.add.reduceat((flat.astype(np.uint64) + np.uint64(1)) * mixed(place.astype(np.uint64) + np.uint64(7)), at)
    digest = mixed(digest + sizes.astype(np.uint64)) + mixed(h + lead.astype(np.uint64))
    _, eldest = np.unique(digest, return_index=True)
    whole = np.ones(len(h), bool)
    whole[eldest] = False
    ends = first + sizes
    yield sent_batch(ids[whole], np.full(whole.sum(), RANGE), ends[whole], ids[whole], keys[whole], first[whole])
    left = np.flatnonzero(~whole)
    _, bucket, count = np.unique(h[left], return_inverse=True, return_counts=True)
    left, bucket = left[count[bucket] > 1], bucket[count[bucket] > 1]  # a bucket of one piece has no equal windows
    if not len(left):
        return
    flat = spread(flat, at[left], sizes[left])
    n = sizes[left] - LENGTH + 1
    begin, before = np.cumsum(sizes[left]) - sizes[left], lead[left]
    suffixes = Suffixes(flat, LENGTH)
    # windows at different distances to the gram differ: many are sorted a range of distances at a time
    step = max(1, held * (LENGTH - GRAM + 1) // int(n.sum()))
    for low in range(0, LENGTH - GRAM + 1, step):
        first_window = np.maximum(0, before - (low + step - 1))
        count = np.maximum(0, np.minimum(n, before - low + 1) - first_window)
        own = np.repeat(np.arange(len(left)), count)
        windows = np.arange(len(own)) - np.repeat(np.cumsum(count) - count - first_window, count)  # places in their pieces
        copy = suffixes.repeats(begin[own] + windows, bucket[own] * np.int64(LENGTH) + before[own] - windows)
        yield ranges_of(ids[left][own], keys[left][own], first[left][own] + windows, copy)


def copied_ranges(rows: DataFrame, limits: Limits) -> DataFrame:
    """Rows SENT to (id, text_key, start, stop): byte ranges that are copies of something earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        size = 0

        def solved(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = rows.combine_chunks()
            kind = np.minimum(rows["lead"].to_numpy(), 0)
            for which in (0, WINDOW, RANGE):
                mine = rows if (kind == which).all() else rows.filter(pa.array(kind == which))
                if not mine.num_rows:
                    continue
                column = lambda name: mine[name].to_numpy()  # noqa: B023, E731
                if which == 0:
                    out = copied_pieces(column("bucket").view(np.uint64), column("id"), column("text_key"), column("first"), column("lead").astype(np.int64), mine["piece"].combine_chunks(), limits.held)
                elif which == WINDOW:
                    eldest = Eldest(mine.num_rows)
                    eldest.parts, eldest.size = [(column("bucket").view(np.uint64), column("more").view(np.uint64), column("id"), column("text_key"), column("first"))], mine.num_rows
                    out = eldest.settled(mine.num_rows)
                else:
                    out = mine.to_batches()
                for x in out:
                    yield pa.RecordBatch.from_arrays([x.column(k) for k in (3, 4, 5, 2)], names=["id", "text_key", "start", "stop"])

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                parts.append(part)
                size += part.num_rows * 40 + int(np.diff(np.frombuffer(part.column(6).buffers()[1], np.int32)[part.column(6).offset :][[0, part.num_rows]])[0])
                if size >= limits.block:
                    rows = pa.Table.from_batches(parts)
                    bucket = rows["bucket"].to_numpy()
                    cut = int(np.searchsorted(bucket, bucket[-1], "left"))  # the last bucket may go on
                    if cut:
                        yield from solved(rows.slice(0, cut))
                        parts = rows.slice(cut).to_batches()
                        size = sum(p.num_rows * 100 for p in parts)
        if parts:
            yield from solved(pa.Table.from_batches(parts))

    dealt = rows.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "id bigint, text_key bigint, start bigint, stop bigint")


def without_ranges(text: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[int, int, int, str, bytes]:
    """(n_bytes, n_removed, n_spans, digest of the rest, the rest)."""
    order = np.argsort(starts, kind="stable")
    starts, furthest = starts[order], np.maximum.accumulate(stops[order])
    new = np.append(True, starts[1:] > furthest[:-1]) if len(starts) else np.zeros(0, bool)
    first, last = starts[new], furthest[np.append(np.flatnonzero(new)[1:], len(starts)) - 1] if len(starts) else starts
    kept = b"".join([text[a:b] for a, b in zip([0, *last], [*first, len(text)], strict=True)])
    return len(text), len(text) - len(kept), len(first), hashlib.sha256(kept).hexdigest(), kept


def dedup(docs: DataFrame, keep_bytes: bool = True, bits: int | None = None, limits: Limits = Limits()) -> DataFrame:
    """Rows (doc_id, text) to (doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]), a row for each row.

    Earlier means a smaller doc_id (an integer; null is smallest), then, for rows with one id and different texts, a smaller
    digest of the text, then an earlier start; matches never cross texts. Rows with one id and one text are one text: nothing of
    it is earlier than itself, and each row gets the same result. A null text counts as empty. Texts under LENGTH bytes stay
    whole; so does an empty table. Other columns are ignored. `bits` is the size of the maps, by default from the size of docs.
    """
    texts = identified(docs)
    bits = bits or bits_for(docs)
    repeated, hot = counted(texts.select("text"), lambda b: gram_hashes(b, limits.span), bits, (2, limits.hot + 1))
    ranges = copied_ranges(sent(texts, repeated, hot, limits), limits).groupBy("id", "text_key").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    ranges = written(ranges, "copied")
    row_hash = lambda ids, keys: mixed(ids.view(np.uint64) * np.uint64(3) + mixed(keys.view(np.uint64)))

    def row_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield row_hash(batch.column(0).to_numpy(), batch.column(1).to_numpy())

    [touched] = counted(ranges.select("id", "text_key"), row_hashes, bits, (1,))
    shipped = docs.sparkSession.sparkContext.broadcast(touched)
    kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()][: 1 + keep_bytes]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 1 + len(kinds)]
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_bytes
    nothing = np.zeros(0, np.int64)

    def finished(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=names)

    def read(touched_only: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            marks = np.frombuffer(shipped.value, np.uint8)
            for batch in batches:
                for at, some in texts_of(batch.column(1), 4 * limits.span):
                    ids = batch.column(0).slice(at, len(some))
                    keys = np.array([text_key(t) for t in some], np.int64)
                    there = held(marks, row_hash(ids.to_numpy(), keys)) == touched_only
                    chosen, which = ids.filter(pa.array(there)), np.flatnonzero(there)
                    if touched_only:
                        yield pa.RecordBatch.from_arrays([chosen, pa.array([some[k] for k in which], pa.binary()), pa.array(keys[which])], names=["id", "data", "text_key"])
                    else:
                        yield finished(chosen, [without_ranges(some[k], nothing, nothing) for k in which])

        return run

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in texts_of(batch.column(1), 4 * limits.span):
                out = []
                for k, text in enumerate(some, at):
                    spans = [c[k].values.to_numpy() if c[k].is_valid else nothing for c in batch.columns[2:]]
                    out.append(without_ranges(text, *spans))
                yield finished(batch.column(0).slice(at, len(some)), out)

    whole = texts.mapInArrow(read(False), schema)
    marked = texts.mapInArrow(read(True), "id bigint, data binary, text_key bigint")
    joined = marked.join(ranges, ["id", "text_key"], "left").select("id", "data", "starts", "stops").mapInArrow(cut, schema)
    id_type = docs.schema["doc_id"].dataType
    return whole.unionByName(joined).withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).cast(id_type))


def op7_substrings(spark, sf_dir: str) -> DataFrame:
    """dedup() of all documents."""
    return dedup(table(spark, sf_dir, "documents"), keep_bytes=False)

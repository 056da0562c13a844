"""N-gram Jaccard join by PartEnum signatures.

A text's set holds the hashes of its word shingles; equal sets are one node. Sets are taken in bands of sizes [L, R] that
overlap, so that any two sets similar enough lie in one band together; there they differ in at most k = 2R(1 - s)/(1 + s)
elements. A band cuts the feature domain into n partitions and each of these into SUBS smaller ones; its signatures are
all subsets of SUBS - 1 parts of each partition. Two sets that differ in at most k elements have the same content under at
least g = 2n - k of them (SUBS n - (SUBS - 1) k if n > k): a first difference in a partition spoils all its subsets but one, a
second that one. As g is known, each set leaves out its g - 1 least telling signatures (fewest elements first, an order that
content alone decides): the most telling one that both agree on is kept by both. Those are the empty and tiny ones, which
unrelated sets share.

Only signatures that two sets may share leave the scan (a map of fixed size, bitmap.py). Nodes that share one are candidates.
First each signature's smallest node is compared with the others, its text sent once for so many of them. Then, for what that
has not connected, the nodes of different components under one signature are held against each other by sketches, a few bytes
each: in one group where a signature has few, else in blocks against blocks. A sketch never rules out a pair that links; the
pairs left are compared like the first. No pair under a signature that could still connect two components stays undecided.

Similar sets are in one component, so links are counted there: block against block, each pair of a component's nodes once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import mixed, texts_of, words_of
from .bitmap import bits_for, column_hashes, counted, held
from .common import table, written
from .graph import components

SUBS = 3
#: Bits of a sketch, a power of two.
SKETCH = 1024


@dataclass(frozen=True)
class Limits:
    """Bytes of text hashed at a time; nodes of a block that is compared by sketches; members of a star that one task compares;
    sets, and shingles in all, of a block whose links are counted (a single set may have more); columns of a product of
    blocks. They bound memory, not results."""

    span: int = 1 << 19
    block: int = 256
    star: int = 1024
    sets: int = 2048
    shingles: int = 1 << 20
    columns: int = 1 << 11


def bands(top: int, percent: int) -> list[tuple[int, int]]:
    """Bands [L, R] up to the size top; sizes a <= b with 100 a >= percent b always share one."""
    out, low = [], 1
    while low <= top:
        high = max(low * 150 // percent, -(-low * 100 // percent))
        out.append((low, high))
        low = percent * high // 100 + 1
    return out


def partitions(high: int, percent: int) -> tuple[int, int]:
    """(n, g): a band's partitions, and how many signatures similar sets have in common at least; (0, 0) if only equal sets are."""
    k = 2 * high * (100 - percent) // (100 + percent)
    if not k:
        return 0, 0
    n = k // 2 + 1 + k // 10
    return n, 2 * n - k if k >= n else SUBS * n - (SUBS - 1) * k


def shingle_sets(texts: list[str] | list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than a shingle are one, no words none."""
    words = words_of(texts, lower=True)
    count = max(len(words.hashes) - size + 1, 0)
    grams = np.zeros(count, np.uint64)
    for k in range(size):
        grams = mixed(grams + words.hashes[k : count + k] + np.uint64(k + 1))
    out = []
    for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        else:
            whole = np.zeros(min(b - a, 1), np.uint64)
            for k in range(b - a):
                whole = mixed(whole + words.hashes[a + k] + np.uint64(k + 1))
            out.append(whole)
    return out


def signatures(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The signatures of a set in all its bands."""
    size, out = len(shingles), [np.zeros(0, np.uint64)]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(shingles))])
    high_half = shingles >> np.uint64(32)
    for number, (low, high) in enumerate(bands(size, percent)):
        n, g = partitions(high, percent)
        if not (low <= size <= high and n):
            continue
        # parts are ranges of the domain, in the order of the sorted set
        edges = (np.arange(SUBS * n + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(SUBS * n)
        ends = np.searchsorted(high_half, edges)
        ends[-1] = size
        held_ = np.diff(ends).reshape(n, SUBS)
        content = (sums[ends[1:]] - sums[ends[:-1]]).reshape(n, SUBS)
        held_ = (held_.sum(axis=1)[:, None] - held_).ravel()  # a subset: the partition without one part
        content = (content.sum(axis=1, dtype=np.uint64)[:, None] - content).ravel()
        tags = np.arange(SUBS * n, dtype=np.uint64) + np.uint64(number << 40)
        content = mixed(mixed(content + held_.astype(np.uint64)) + tags)
        out.append(content[np.lexsort((content, held_))[g - 1 :]])
    return np.concatenate(out)


def key_of(shingles: np.ndarray) -> int | None:
    """A 64-bit digest of a set, none for the empty set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64)) if len(shingles) else None


def described(docs: DataFrame, size: int, span: int) -> DataFrame:
    """Rows (doc_id, digest, n_shingles, key); digest tells texts of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in texts_of(batch.column(2), span):
                sets = shingle_sets(texts, size)
                columns = [*(batch.column(k).slice(at, len(sets)) for k in (0, 1)), pa.array(map(len, sets), pa.int64()), pa.array(map(key_of, sets), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "n_shingles", "key"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", digest(), "text").mapInArrow(run, f"doc_id {id_type}, digest bigint, n_shingles bigint, key bigint")


def digest() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest")


def hashed_id() -> Column:
    """A hash of doc_id, null for a null."""
    return F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).alias("h")


def marked_texts(batches: Iterator[pa.RecordBatch], marks: bytes, size: int, span: int) -> Iterator[tuple[list[bytes], list[np.ndarray]]]:
    """Texts and sets of rows (h, text) whose h is marked or null."""
    known = np.frombuffer(marks, np.uint8)
    for batch in batches:
        there = held(known, batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)) | batch.column(0).is_null().to_numpy(zero_copy_only=False)
        for _, texts in texts_of(batch.column(1).filter(pa.array(there)), span):
            yield texts, shingle_sets(texts, size)


def marked_sets(batches: Iterator[pa.RecordBatch], marks: bytes, size: int, span: int) -> Iterator[list[np.ndarray]]:
    """The sets of marked_texts(), each set once, without the empty one."""
    seen: set[int] = set()
    for _, sets in marked_texts(batches, marks, size, span):
        yield [s for s in sets if (key := key_of(s)) is not None and key not in seen and not seen.add(key)]


def shared_signatures(rows: DataFrame, marks, size: int, percent: int, bits: int, span: int) -> DataFrame:
    """Rows (signature, node (key, n)) without most signatures that only one set has; sets are signed twice, nothing is stored.

    rows: (h, text), of which those marked in `marks` (a broadcast map) count.
    """

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for sets in marked_sets(batches, marks.value, size, span):
            yield np.concatenate([np.zeros(0, np.uint64), *(signatures(s, percent) for s in sets)])

    [repeated] = counted(rows, signed, bits, (2,))
    shipped = rows.sparkSession.sparkContext.broadcast(repeated)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(shipped.value, np.uint8)
        for sets in marked_sets(batches, marks.value, size, span):
            lists = [(s, found[held(known, found)]) for s in sets if len(found := signatures(s, percent))]
            lists = [(s, found) for s, found in lists if len(found)]
            if not lists:
                continue
            counts = np.array([len(found) for _, found in lists])
            columns = [np.concatenate([found for _, found in lists]).view(np.int64), np.repeat(np.array([key_of(s) for s, _ in lists], np.int64), counts), np.repeat(np.array([len(s) for s, _ in lists]), counts)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["signature", "key", "n"])

    return rows.mapInArrow(run, "signature bigint, key bigint, n bigint").distinct()


def packed(text: bytes) -> bytes:
    """A text for shipping: its size and its compressed bytes; a third of what its shingles' hashes take."""
    return len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def texts_of_sets(rows: DataFrame, marks, size: int, span: int) -> DataFrame:
    """Rows (h, text), of which those marked count, to (key, packed): one text of each set; a set may come from several tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for texts, sets in marked_texts(batches, marks.value, size, span):
            fresh = [(key, t) for t, s in zip(texts, sets, strict=True) if (key := key_of(s)) is not None and key not in seen and not seen.add(key)]
            sketches = {key_of(s): sketch(s) for s in sets if len(s)}
            columns = [pa.array([k for k, _ in fresh], pa.int64()), pa.array([packed(t) for _, t in fresh], pa.binary()), pa.array([sketches[k] for k, _ in fresh], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "packed", "sketch"])

    return rows.mapInArrow(run, "key bigint, packed binary, sketch binary")


def sketch(shingles: np.ndarray) -> bytes:
    """SKETCH bits: whether an odd number of shingles falls on each. Two sketches differ in no more bits than the sets in elements."""
    return np.packbits(np.bincount((shingles >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64), minlength=SKETCH) & 1).tobytes()


def shared_counts(qs: list[np.ndarray], ts: list[np.ndarray], columns: int) -> np.ndarray:
    """The size of the intersection of each of qs with each of ts, as products of 0/1 blocks over some columns at a time.

    Columns that one set alone holds are left out, so where qs are ts a set's count with itself may be too small.
    """
    values = np.concatenate(qs)
    known, often = np.unique(values, return_counts=True)
    known = known[often > 1] if qs is ts else np.intersect1d(known, np.concatenate(ts))
    if not len(known):
        return np.zeros((len(qs), len(ts)), np.int64)
    everywhere = known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values
    own_q, own_t = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (qs, ts))
    theirs = np.concatenate(ts)
    at = np.searchsorted(known, theirs)
    at[at == len(known)] = 0
    hit = known[at] == theirs
    own_t, at_t = own_t[hit], at[hit]
    if len(qs) == 1:
        return np.bincount(own_t, minlength=len(ts))[None, :]
    own_q, at_q, out = own_q[everywhere], np.searchsorted(known, values[everywhere]), np.zeros((len(qs), len(ts)), np.float32)
    for low in range(0, len(known), columns):
        blocks = []
        for at, own, rows in ((at_q, own_q, len(qs)), (at_t, own_t, len(ts))):
            mine = (at >= low) & (at < low + columns)
            block = np.zeros((rows, min(columns, len(known) - low)), np.float32)
            block[own[mine], at[mine] - low] = 1
            blocks.append(block)
        out += blocks[0] @ blocks[1].T
    return out.astype(np.int64)


def linked(qs: list[np.ndarray], ts: list[np.ndarray], percent: int, columns: int) -> np.ndarray:
    """Whether each of qs is similar enough to each of ts; a set is to itself."""
    shared = shared_counts(qs, ts, columns)
    a, b = (np.array([len(s) for s in x]) for x in (qs, ts))
    out = 100 * shared >= percent * (a[:, None] + b[None, :] - shared)
    if qs is ts:
        np.fill_diagonal(out, True)
    return out


def star_links(sets: list[np.ndarray], keys: np.ndarray, side: np.ndarray, percent: int, columns: int) -> list[np.ndarray]:
    """Columns a, b: the sets of side 1 that are similar to that of side 0."""
    [head], others = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(others):
        return [np.zeros(0, np.int64)] * 2
    found = others[linked([sets[head]], [sets[k] for k in others], percent, columns)[0]]
    return [np.full(len(found), keys[head]), keys[found]]


def near_pairs(rows: pa.Table, percent: int) -> list[np.ndarray]:
    """Columns a, b, n: pairs of different roots, between sides 0 and 1 or inside side 2, that sizes and sketches don't rule out.

    Similar sets of a and b elements differ in (a + b)(1 - s) / (1 + s) at most; sketches can't differ in more.
    """
    keys, roots, side, n = (rows[c].to_numpy() for c in ("key", "root", "side", "n"))
    bits = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint64).reshape(len(keys), -1)
    qs, ts = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    out = [np.zeros((3, 0), np.int64)]
    for at in range(0, len(qs), 64):
        q = qs[at : at + 64]
        apart = np.bitwise_count(bits[q][:, None, :] ^ bits[ts][None, :, :]).sum(axis=2, dtype=np.int64)
        a, b = n[q][:, None], n[ts][None, :]
        may = (apart * (100 + percent) <= (a + b) * (100 - percent)) & (np.minimum(a, b) * 100 >= np.maximum(a, b) * percent) & (roots[q][:, None] != roots[ts][None, :])
        x, y = np.nonzero(may)
        x, y = q[x], ts[y]
        out.append(np.stack([np.minimum(keys[x], keys[y]), np.maximum(keys[x], keys[y]), np.where(keys[x] > keys[y], n[x], n[y])]))
    return list(np.unique(np.concatenate(out, axis=1), axis=1))


def group_counts(sets: list[np.ndarray], keys: np.ndarray, side: np.ndarray, percent: int, columns: int) -> list[np.ndarray]:
    """Columns key, links: the similar sets of each set on the other side, or in the group where all are side 2."""
    links = np.zeros(len(sets), np.int64)
    if (side == 2).all():
        links += linked(sets, sets, percent, columns).sum(axis=1) - 1  # not with itself
    elif (side == 0).any() and (side == 1).any():
        qs, ts = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found = linked([sets[k] for k in qs], [sets[k] for k in ts], percent, columns)
        links[qs] += found.sum(axis=1)
        links[ts] += found.sum(axis=0)
    return [keys, links]


def grouped(rows: DataFrame, by: list[str], work: Callable, schema: str) -> DataFrame:
    """work() on the rows of each value of `by` (numbers), as an Arrow table; it returns columns of schema. Groups are bounded."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            table_ = pa.Table.from_batches(parts)
            out = work(table_.filter(pa.array(~repeated(table_["key"].to_numpy(), table_["side"].to_numpy()))))
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=names)

        last = None
        for batch in batches:
            marks = np.stack([batch.column(k).to_numpy() for k in range(len(by))], axis=1)
            edges = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *edges], [*edges, len(marks)], strict=True):
                if a == b:
                    continue
                if last is not None and (marks[a] != last).any():
                    yield from done()
                    parts = []
                last = marks[a]
                parts.append(batch.slice(a, b - a))
        if parts:
            yield from done()

    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def compared(groups: DataFrame, by: list[str], texts: DataFrame, work: Callable, schema: str, size: int, percent: int, limits: Limits) -> DataFrame:
    """work() on each group of rows (by, key, side): its sets, keys and sides."""

    def run(rows: pa.Table) -> list[np.ndarray]:
        sets: list[np.ndarray] = []
        some: list[bytes] = []
        held_ = 0
        for chunk in rows["packed"].chunks:
            for x in chunk:
                some.append(unpacked(x.as_py()))
                held_ += len(some[-1])
                if held_ >= limits.span:
                    sets, some, held_ = sets + shingle_sets(some, size), [], 0
        sets += shingle_sets(some, size) if some else []
        return work(sets, rows["key"].to_numpy(), rows["side"].to_numpy(), percent, limits.columns)

    rows = groups.join(texts.select("key", "packed"), "key").select(*by, "key", "side", "packed")
    return grouped(rows, by, run, schema)


def repeated(keys: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Which rows repeat a key and side: a set that several tasks have read."""
    out = np.ones(len(keys), bool)
    out[np.unique(np.stack([keys, side.astype(np.int64)]), axis=1, return_index=True)[1]] = False
    return out


def component_table(docs: DataFrame, nodes: DataFrame, size: int, percent: int, bits: int, count_links: bool, limits: Limits) -> DataFrame:
    """(key, root, links) of nodes that are linked with another."""
    spark, span = docs.sparkSession, limits.span
    texts = docs.select(hashed_id(), "text")
    chosen = lambda ids: spark.sparkContext.broadcast(counted(ids.where("h is not null"), column_hashes, bits_for(ids, 4), (1,))[0])
    one_each = nodes.select(F.col("doc").alias("doc_id")).select(hashed_id())
    signed = written(shared_signatures(texts, chosen(written(one_each, "one-each")), size, percent, bits, span), "signed")
    node = F.struct("key", "n")
    pivots = signed.groupBy("signature").agg(F.min(node).alias("pivot"), F.max("key").alias("last")).where("pivot.key != last").select("signature", "pivot")
    members = written(signed.join(pivots, "signature").select("signature", "key", "n", F.col("pivot.key").alias("pivot"), F.col("pivot.n").alias("pivot_n")), "members")
    candidates = written(members.select("key").distinct(), "candidates")
    wanted = nodes.join(candidates, "key", "left_semi").select(F.col("doc").alias("doc_id")).select(hashed_id())
    sets = written(texts_of_sets(texts, chosen(written(wanted, "wanted")), size, span).join(candidates, "key", "left_semi"), "sets")

    dealt = lambda parts: F.pmod(F.xxhash64("key"), F.col(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    side = lambda n: F.lit(n).alias("side")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (pivot, key, n of key) that link, as (a, b): a pivot's text is sent once for so many others."""
        blocks = F.greatest(F.ceil(F.count("*") / limits.star), F.ceil(F.sum("n") / limits.shingles)).cast("int")
        parts = written(pairs.groupBy("pivot").agg(blocks.alias("parts")), "parts")
        others = pairs.join(parts, "pivot").select("pivot", dealt("parts").alias("part"), "key", side(1))
        heads = parts.select("pivot", each("parts").alias("part"), F.col("pivot").alias("key"), side(0))
        return written(compared(others.unionByName(heads), ["pivot", "part"], sets, star_links, "a bigint, b bigint", size, percent, limits), "links")

    def near(groups: DataFrame, by: list[str]) -> DataFrame:
        """Pairs of rows (by, key, root, side) of a group that sketches don't rule out."""
        rows = groups.join(sketches, "key").select(*by, "key", "root", "side", "n", "sketch")
        return grouped(rows, by, lambda t: near_pairs(t, percent), "pivot bigint, key bigint, n bigint").distinct()

    # stars: each signature's smallest node against the others
    apart = F.least("n", "pivot_n") * 100 >= F.greatest("n", "pivot_n") * percent
    stars = written(members.where(F.col("key") != F.col("pivot")).where(apart).select("pivot", "key", "n").distinct(), "stars")
    links = verified(stars)
    found = written(components(links), "roots")
    # signatures under which two components still meet, beside what the pivot has been compared with
    rooted = members.select("signature", "key").join(found.withColumnRenamed("node", "key"), "key", "left").select("signature", "key", F.coalesce("root", "key").alias("root"))
    counts = rooted.groupBy("signature", "root").agg(F.count("*").alias("c")).groupBy("signature")
    counts = counts.agg(F.sum("c").alias("m"), F.count("*").alias("roots"), F.max_by("root", "c").alias("main"), F.max("c").alias("mains"))
    open_ = written(rooted.join(counts.where("roots > 1 and m > 2"), "signature"), "open")
    sketches = sets.select("key", "sketch").join(nodes.select("key", "n"), "key")
    small = F.col("m") <= limits.block
    # few nodes: one group for all signatures that have the same ones
    lists = open_.where(small).groupBy("signature").agg(F.array_sort(F.collect_list(F.struct("key", "root"))).alias("nodes")).select("nodes").distinct()
    few = lists.select(F.xxhash64("nodes").alias("list"), F.explode("nodes").alias("x")).select("list", "x.key", "x.root", side(2))
    # many: all but the largest component's nodes are held against all
    most = lambda count: F.greatest(F.lit(1), F.ceil(F.col(count) / limits.block)).cast("int")
    many = open_.where(~small).withColumn("rest", F.col("m") - F.col("mains")).withColumn("ts", most("m")).withColumn("qs", most("rest"))
    asked = many.where("root != main").select("signature", dealt("qs").alias("q"), each("ts").alias("t"), "key", "root", side(0))
    held_against = many.select("signature", each("qs").alias("q"), dealt("ts").alias("t"), "key", "root", side(1))
    pairs = near(few, ["list"]).unionByName(near(asked.unionByName(held_against), ["signature", "q", "t"]))
    more = verified(written(pairs.distinct(), "near"))
    forest = found.select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = written(components(forest.unionByName(more)), "roots").select(F.col("node").alias("key"), "root")
    if not count_links:
        return roots.withColumn("links", F.lit(None).cast("bigint"))
    blocks = F.greatest(F.ceil(F.count("*") / limits.sets), F.ceil(F.sum("n") / limits.shingles)).cast("int")
    sized = roots.join(nodes.select("key", "n"), "key").groupBy("root").agg(F.count("*").alias("m"), blocks.alias("parts"))
    inside = roots.join(sized, "root")
    larger = inside.where("m > 2").select("root", "key", dealt("parts").alias("part"), each("parts").alias("other"))
    larger = larger.select("root", F.least("part", "other").alias("q"), F.greatest("part", "other").alias("t"), "key", F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 0).otherwise(1).alias("side"))
    # a block's rows alone under (q, q) are side 2; under (q, t) there are sides 0 and 1
    counted_links = compared(larger.withColumnRenamed("root", "component"), ["component", "q", "t"], sets, group_counts, "key bigint, links bigint", size, percent, limits)
    degrees = counted_links.groupBy("key").agg(F.sum("links").alias("links"))
    degrees = degrees.unionByName(inside.where("m = 2").select("key", F.lit(1).cast("bigint").alias("links")))
    return roots.join(degrees, "key")


def similar_rows(docs: DataFrame, size: int = 5, percent: int = 80, count_links: bool = True, bits: int | None = None, limits: Limits = Limits()) -> DataFrame:
    """Rows (doc_id, text) to (doc_id, digest, n_shingles, key, root, component_id, n_links), a row for each row; see
    similar_groups(). key and root are of the set and of its component, null without words."""
    rows = written(described(docs.select("doc_id", "text"), size, limits.span), "described")
    nodes = written(rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n")), "nodes")
    linked_nodes = component_table(docs.select("doc_id", "text"), nodes, size, percent, bits or bits_for(docs), count_links, limits)
    placed = nodes.join(linked_nodes, "key", "left").select("key", "doc", F.coalesce("root", "key").alias("root"), "links")
    smallest = placed.groupBy("root").agg(F.min("doc").alias("smallest"))
    placed = placed.join(smallest, "root").select("key", "root", "smallest", "links")
    n_links = F.coalesce("links", F.lit(0)) if count_links else F.lit(None)
    return rows.join(placed, "key", "left").select("doc_id", "digest", "n_shingles", "key", "root", F.coalesce("smallest", "doc_id").alias("component_id"), n_links.cast("bigint").alias("n_links"))


def similar_groups(docs: DataFrame, size: int = 5, percent: int = 80, count_links: bool = True, bits: int | None = None, limits: Limits = Limits()) -> DataFrame:
    """Rows (doc_id, text) to (doc_id, n_shingles, component_id, n_links), a row for each row.

    Two texts link when 100 * |intersection| >= percent * |union| of their sets of shingles of `size` words (lower case,
    A-Z alone). component_id is the smallest doc_id reachable by links, itself included; n_links counts all different sets
    that a text's set links with (null unless count_links); equal sets are one node. Null and empty texts have no shingles and
    are linked with nothing; an empty table gives no rows. Repeated rows stay and are copies of each other, as are rows of one
    id with different texts only if the texts link; null ids never name a component unless it has no other. Other columns
    are ignored. Sets are told apart by 64-bit digests. `bits` is the size of the map, by default from the size of docs.
    """
    return similar_rows(docs, size, percent, count_links, bits, limits).select("doc_id", "n_shingles", "component_id", "n_links")


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80, bits: int | None = None, limits: Limits = Limits()) -> DataFrame:
    """docs with one row of each group that links connect: that with the smallest doc_id (nulls last), then the smallest digest
    of its text; of rows that are alike in both any one. Rows without words stay. All columns stay as they are."""
    rows = written(similar_rows(docs, size, percent, False, bits, limits).where("key is not null"), "grouped")
    rank = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "digest")
    first = rows.groupBy("root").agg(F.min(rank).alias("first"), F.count("*").alias("c")).where("c > 1")
    chosen = written(first.select("first.doc_id", "first.digest").distinct(), "chosen")
    grouped = rows.join(first.select("root"), "root", "left_semi")
    touched = written(grouped.select("doc_id", "digest").distinct(), "touched")
    names = {"doc_id": "id of group", "digest": "digest of group"}
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    pair = lambda a, b: F.xxhash64(F.coalesce(F.xxhash64(a), F.lit(0)), b)
    ids = touched.select(pair("doc_id", "digest").alias("h"))
    marks = docs.sparkSession.sparkContext.broadcast(counted(ids, column_hashes, bits_for(touched, 4), (1,))[0])
    hashed = docs.select(pair("doc_id", own).alias("hash of row"), *(docs[c] for c in docs.columns))

    def picked(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = np.frombuffer(marks.value, np.uint8)
            for batch in batches:
                out = batch.filter(pa.array(held(known, batch.column(0).to_numpy().view(np.uint64)) == wanted))
                yield pa.RecordBatch.from_arrays(out.columns[1:], names=out.schema.names[1:])

        return hashed.mapInArrow(run, docs.schema)

    may, stay = picked(True).withColumn("digest of text", own), picked(False)
    same = lambda t: may["doc_id"].eqNullSafe(t[names["doc_id"]]) & (may["digest of text"] == t[names["digest"]])
    groups, firsts = (t.withColumnsRenamed(names) for t in (touched, chosen))
    untouched = may.join(groups, same(groups), "left_anti").drop("digest of text")
    kept = may.join(firsts, same(firsts), "left_semi").dropDuplicates(["doc_id", "digest of text"]).drop("digest of text")
    return stay.unionByName(untouched).unionByName(kept)


def op6_jaccard(spark, sf_dir: str) -> DataFrame:
    """similar_groups() of all documents by shingles of three words at 90 percent."""
    return similar_groups(table(spark, sf_dir, "documents"), size=3, percent=90).select("doc_id", "n_shingles", "component_id", "n_links")

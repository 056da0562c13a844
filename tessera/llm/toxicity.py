"""Toxicity: a linear classifier on character n-grams whose counts are scaled by naive Bayes log-count ratios.

Letters are lower-cased, everything else is one blank; n-grams of 3 to 6 characters over that, blanks included, are
hashed to FEATURES slots. The log-count ratio of a slot is that of the shares of toxic and of other training texts
that hold it. Slots with a strong ratio stay; their value in a text is ratio * log(1 + count), and a logistic
regression with an L2 term is fitted to them. Text alone makes a score.

Training reads a bounded sample of labelled rows (``max_rows``, the rows with the smallest hashes of their ids); the
document frequencies are summed by Spark, the few selected values of each training text come to the driver. Scoring
streams over all texts with one table of weights (FEATURES entries) on each worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import texts_of
from .common import table, written

BITS = 22
FEATURES = 1 << BITS
SIZES = (3, 4, 5, 6)
#: Characters that are hashed at a time; a longer text goes in pieces.
SPAN = 1 << 18
_FOLD: list[np.ndarray] = []


@dataclass(frozen=True)
class Model:
    """Weights of the selected slots: score = sigmoid(bias + sum(weights[slot] * log(1 + count)))."""

    slots: np.ndarray
    weights: np.ndarray
    bias: float

    def lookup(self) -> np.ndarray:
        """For each slot its place in weights, counted from 1; 0 for the rest."""
        out = np.zeros(FEATURES, np.int32)
        out[self.slots] = np.arange(1, len(self.slots) + 1, dtype=np.int32)
        return out


def fold() -> np.ndarray:
    """The lower-case letter of each code point, a blank for what is no letter."""
    if not _FOLD:
        letters = [c if (c := chr(k)).isalpha() else " " for k in range(0x110000)]
        _FOLD.append(np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in letters], np.uint32))
    return _FOLD[0]


def hits(texts: list[str], wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text number, slot or place in wanted, count) of all n-grams, in order; wanted: a Model.lookup().

    A text's n-grams are those of the text by itself, with a blank at both ends: short texts are worked on side by side, a
    longer one piece after piece, each after the last characters of the one before.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    some, owners, held = [], [], 0

    def counted(chars: np.ndarray, owner: np.ndarray, seen: int = 0) -> None:
        """Counts the n-grams inside one text that end after the first `seen` characters."""
        chars = chars.astype(np.uint64)
        rolled, keys = chars.copy(), [np.zeros(0, np.int64)]
        for n in range(2, SIZES[-1] + 1):
            if len(chars) < n:
                break
            rolled = rolled[:-1] * np.uint64(0x100000001B3) + chars[n - 1 :]
            if n in SIZES:
                slot = ((rolled + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
                mine = owner[n - 1 :] == owner[: len(rolled)]
                mine[: max(seen - n + 1, 0)] = False
                place = slot.astype(np.int64) if wanted is None else wanted[slot]
                at = np.flatnonzero(mine if wanted is None else mine & (place > 0))
                keys.append(owner[at].astype(np.int64) << 32 | place[at])
        found.append(np.unique(np.concatenate(keys), return_counts=True))

    def letters(text: str) -> np.ndarray:
        return fold()[np.frombuffer(text.encode("utf-32-le"), "<u4")]

    def flushed() -> None:
        nonlocal some, owners, held
        if some:
            chars = letters(" " + "  ".join(some) + " ")
            owner = np.repeat(np.array(owners), [len(t) + 2 for t in some])
            stay = np.append(True, (chars[1:] != 32) | (chars[:-1] != 32) | (owner[1:] != owner[:-1]))
            counted(chars[stay], owner[stay])
        some, owners, held = [], [], 0

    def in_pieces(text: str, number: int) -> None:
        before = np.array([32], np.uint32)
        for k in range(0, len(text) + 1, SPAN):
            piece = letters(text[k : k + SPAN] + (" " if k + SPAN > len(text) else ""))
            stay = (piece != 32) | (np.concatenate([before[-1:], piece[:-1]]) != 32)
            chars = np.concatenate([before, piece[stay]])
            counted(chars, np.full(len(chars), number), len(before))
            before = chars[1 - SIZES[-1] :]

    for number, text in enumerate(texts):
        if len(text) > SPAN:
            flushed()
            in_pieces(text, number)
            continue
        if held + len(text) > SPAN:
            flushed()
        some.append(text)
        owners.append(number)
        held += len(text) + 2
    flushed()
    if not found:
        return (np.zeros(0, np.int64),) * 3
    keys, counts = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(found) > 1:  # a text in pieces has a slot in several
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
    return keys >> 32, keys & 0xFFFFFFFF, counts


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 12000, least_texts: int = 4, least_ratio: float = 2.0, l2: float = 1e-4, steps: int = 150) -> Model:
    """Trains on docs (doc_id, text) and labels (doc_id, toxic).

    max_rows bounds the sample; slots in fewer than least_texts sampled texts, or with a log-count ratio under
    least_ratio either way, are left out. Null labels and ids are ignored, of several labels of an id the largest
    holds. Without a text of each class there is nothing to learn: the score is then the share of toxic texts, or 0.
    """
    clean = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = clean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id")
    # of several texts of an id that with the least hash: the sample has max_rows rows at most; it is written once and read thrice
    sample = written(sample.agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").cast("int").alias("toxic")).select("text", "toxic"), "sample")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, texts in ((b, at, texts) for b in batches for at, texts in texts_of(b.column(0), SPAN)):
            toxic = batch.column(1).slice(at, len(texts)).to_numpy()
            owner, slot, _ = hits([t.decode() for t in texts], None)
            slots, place = np.unique(slot, return_inverse=True)
            with_toxic = np.bincount(place, toxic[owner] > 0, len(slots)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (slots, with_toxic, np.bincount(place, minlength=len(slots)) - with_toxic)], names=["slot", "toxic", "other"])

    n_toxic, n_other = (x or 0 for x in sample.agg(F.sum((F.col("toxic") > 0).cast("long")), F.sum((F.col("toxic") <= 0).cast("long"))).first())
    if not n_toxic or not n_other:
        share = n_toxic / max(n_toxic + n_other, 1)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))) if 0 < share < 1 else 50.0 * (2 * share - 1))
    ratio = F.log((F.col("toxic") + 1) / F.lit(n_toxic + 2.0)) - F.log((F.col("other") + 1) / F.lit(n_other + 2.0))
    strong = (
        sample.mapInArrow(frequencies, "slot bigint, toxic bigint, other bigint")
        .groupBy("slot")
        .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        .where(F.col("toxic") + F.col("other") >= least_texts)
        .select("slot", ratio.alias("ratio"))
        .where(F.abs("ratio") >= least_ratio)
        .toPandas()
        .sort_values("slot")
    )
    slots, ratios = strong["slot"].to_numpy(np.int64), strong["ratio"].to_numpy(float)
    shipped = docs.sparkSession.sparkContext.broadcast(Model(slots, ratios, 0.0))

    def selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shipped.value.lookup()
        for batch in batches:
            owner, place, count = hits([x or "" for x in batch.column(0).to_pylist()], wanted)
            cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x.astype(np.int32))) for x in (place, count)]
            yield pa.RecordBatch.from_arrays([batch.column(1), *lists], names=["toxic", "places", "counts"])

    rows = sample.mapInArrow(selected, "toxic int, places array<int>, counts array<int>").toPandas()
    y = (rows["toxic"].to_numpy() > 0).astype(float)
    lengths = rows["places"].map(len).to_numpy()
    own = np.repeat(np.arange(len(y)), lengths)
    flat = lambda name: np.concatenate([np.zeros(0, np.int64), *rows[name]]).astype(np.int64)
    place, values = flat("places") - 1, np.log1p(flat("counts"))
    order = np.lexsort((values, place, own))  # the order of rows from Spark must not matter
    place, values, own = place[order], values[order], own[order]
    values = values * ratios[place]
    w, b, m, v = np.zeros(len(slots)), 0.0, np.zeros(len(slots) + 1), np.zeros(len(slots) + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(own, values * w[place], len(y)) + b, -30, 30)))
        g = (p - y) / len(y)
        g = np.append(np.bincount(place, values * g[own], len(slots)) + l2 * w, g.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(slots, w * ratios, float(b))


def score(docs: DataFrame, model: Model, carry: list[str] | None = None, name: str = "score") -> DataFrame:
    """Rows (doc_id, text) to (doc_id, score), or to the columns `carry` and the score, a double from 0 to 1.

    A null text counts as empty and scores by the bias alone, as does any text without selected n-grams. Repeated rows
    each get their score; other columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    carry = ["doc_id"] if carry is None else carry

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        wanted, weights = model.lookup(), np.append(0.0, model.weights)
        for batch in batches:
            owner, place, count = hits([x or "" for x in batch.column(0).to_pylist()], wanted)
            total = np.bincount(owner, weights[place] * np.log1p(count), batch.num_rows) + model.bias
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))], names=[*carry, name])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(F.col("text").alias("text to score"), *(docs[c] for c in carry)).mapInArrow(run, f"{schema}, `{name}` double")


def held_out(doc_id):
    """Whether a document's label is kept for testing: crc32 of the id as text, mod 3, is 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def op1_toxicity(spark, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    """score() of every whole text of documents, by a model fitted to the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

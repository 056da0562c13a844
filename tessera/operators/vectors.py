"""The vector tier: exact cosine for tables of queries, a hashing encoder, and what still lacks a vector."""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CAMEL_RUNS, IDENTIFIER
from .numbered import Numbered, blocks

DIGITS = 6


#: Bytes of query vectors that are broadcast at a time.
BLOCK_BYTES = 1 << 25


def nearest(vectors: DataFrame, queries: DataFrame, depth: int, keep: Column | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, key, cosine, rank): the `depth` nearest vectors of each query (query_id, embedding), equal ones by key.

    keep filters vectors first. The queries are held against all rows in blocks: BLOCK_BYTES of them at a time are broadcast, each
    batch of vectors is multiplied with the block and keeps its own best, and these are merged, so no pairs are written down.
    Vectors of length zero, and nulls, are left out. Cosines are ranked after rounding.
    """
    rows = (vectors if keep is None else vectors.where(keep)).select(key, F.col(vector).alias("v")).where("v is not null")
    asked = queries.select("query_id", F.col("embedding").alias("q")).where("q is not null")
    n, dims = asked.agg(F.count("*"), F.max(F.size("q"))).first()
    blocks = max(1, -(-8 * n * (dims or 0) // BLOCK_BYTES))
    types = {"q": asked.schema["query_id"].dataType, "k": vectors.schema[key].dataType}
    schema = f"query_id {types['q'].simpleString()}, `{key}` {types['k'].simpleString()}, cosine double"

    def best(block: int) -> DataFrame:
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        shipped = vectors.sparkSession.sparkContext.broadcast(mine.toArrow())  # BLOCK_BYTES at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = shipped.value["query_id"].combine_chunks()
            right = matrix(shipped.value["q"].combine_chunks())
            norms = np.sqrt((right * right).sum(axis=1))
            whole = np.flatnonzero(norms > 0)
            for batch in batches:
                left = matrix(batch.column(1))
                size = np.sqrt((left * left).sum(axis=1))
                real = np.flatnonzero(size > 0)
                if not len(real) or not len(whole):
                    continue
                keys = batch.column(0).take(pa.array(real))
                by_key = np.empty(len(real), np.int64)  # places in the order of keys, to break ties
                by_key[pc.sort_indices(keys).to_numpy()] = np.arange(len(real))
                for at in range(0, len(whole), 256):
                    some = whole[at : at + 256]
                    values = np.round((right[some] @ left[real].T) / (norms[some][:, None] * size[real]), DIGITS)
                    order = np.lexsort((np.broadcast_to(by_key, values.shape), -values), axis=1)[:, :depth]
                    out = [names.take(pa.array(np.repeat(some, order.shape[1]))), keys.take(pa.array(order.ravel())), pa.array(np.take_along_axis(values, order, axis=1).ravel())]
                    yield pa.RecordBatch.from_arrays(out, names=["query_id", key, "cosine"])

        return rows.mapInArrow(run, schema)

    found = best(0)
    for block in range(1, blocks):
        found = found.unionByName(best(block))
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth)


def matrix(lists: pa.Array) -> np.ndarray:
    """A column of equally long lists as rows of doubles."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


_PART = re.compile(CAMEL_RUNS.encode())


class Slots(Numbered):
    """Identifiers as functions.text splits them, on UTF-8: the slots of a word and of its parts."""

    def __init__(self, dims: int):
        super().__init__(IDENTIFIER.encode(), self.slots)
        self.dims = dims

    def slots(self, word: bytes) -> list[int]:
        low = word.lower()
        cut = [x for x in low.split(b"_") if x] if b"_" in word else [x.lower() for x in _PART.findall(word)]
        digests = [xxhash.xxh64_intdigest(token, 42) for token in ([low, *cut] if len(cut) > 1 else [low])]
        return [(x - (x >> 63 << 64)) % (2 * self.dims) for x in digests]

    def counts(self, texts: list[bytes | None]) -> np.ndarray:
        """A row of signed counts for each text."""
        out = np.zeros(len(texts) * 2 * self.dims)
        for owner, slot in self.expanded(texts):
            out += np.bincount(owner * 2 * self.dims + slot, minlength=len(out))
        pairs = out.reshape(len(texts), self.dims, 2)
        return pairs[:, :, 0] - pairs[:, :, 1]


def hashed_vector(text: Column, dims: int = 64) -> Column:
    """A unit vector of signed hashed token counts; the zero vector for a text without tokens."""

    @F.arrow_udf("array<float>")
    def encoded(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        slots = Slots(dims)
        for column in texts:
            done = []
            for _, some in blocks(column):
                counts = slots.counts(some)
                norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
                rows = np.divide(counts, norm, out=np.zeros_like(counts), where=norm > 0).astype(np.float32)
                edges = pa.array(np.arange(len(some) + 1) * dims, pa.int32(), mask=np.array([*(x is None for x in some), False]))
                done.append(pa.ListArray.from_arrays(edges, pa.array(rows.ravel())))
            yield pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.float32()))

    return encoded(text.cast("binary"))


#: Texts in a request to an encoder behind HTTP, seconds it may take, and times it is asked.
REQUEST, PATIENCE, TRIES = 64, 60, 3


def asked_over_http(texts: list[str], settings) -> list[list[float]]:
    """Vectors of texts from settings.embed_endpoint: {"input": [...]} is answered by {"data": [{"index", "embedding"}, ...]}."""
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {settings.embed_api_key}"} if settings.embed_api_key else {})
    for left in reversed(range(TRIES)):
        try:
            request = urllib.request.Request(settings.embed_endpoint, json.dumps({"input": texts}).encode(), headers)
            with urllib.request.urlopen(request, timeout=PATIENCE) as reply:
                rows = json.load(reply)["data"]
            break
        except OSError:
            if not left:
                raise
    out = [r["embedding"] for r in sorted(rows, key=lambda r: r["index"])]
    if len(out) != len(texts) or any(len(v) != settings.embed_dims for v in out):
        raise ValueError(f"the encoder answered {len(out)} vectors to {len(texts)} texts, or not {settings.embed_dims} dimensions")
    return out


def encode(rows: DataFrame, settings, key: str = "chunk_id", prefix: str | None = None) -> DataFrame:
    """(key, embedding) of rows with text, or no rows where the backend is none; prefix: by default that of documents."""
    text = F.concat(F.lit(settings.embed_doc_prefix if prefix is None else prefix), F.col("text"))
    if settings.embed_backend != "http":
        out = rows.select(key, hashed_vector(text, settings.embed_dims).alias("embedding"))
        return out.limit(0) if settings.embed_backend == "none" else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, REQUEST):
                some = batch.slice(at, REQUEST)
                found = asked_over_http([x or "" for x in some.column(1).to_pylist()], settings)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(found, pa.list_(pa.float32()))], names=[key, "embedding"])

    return rows.select(key, text.alias("text")).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, embedding array<float>")


def missing(items: DataFrame, vectors: DataFrame, key: str = "chunk_id", vector_key: str | None = None) -> DataFrame:
    """Items without a vector."""
    return items.join(vectors.select(F.col(vector_key or key).alias(key)), key, "left_anti")

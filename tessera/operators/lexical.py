"""The keyword tier: postings and BM25 for a table of queries at once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BETWEEN_TOKENS, tokenize_query
from .numbered import spread

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Scores are ranked after rounding, so that the order of sums does not decide ties.
DIGITS = 6


def tokens(text):
    """Runs of INDEX_TOKEN; a split between them takes a sixth of the time of extracting them."""
    return F.array_remove(F.split(F.lower(text), BETWEEN_TOKENS), "")


def postings(corpus: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf, dl): term frequencies and lengths in tokens; one shuffle at most, by key and term."""
    sized = corpus.select(key, tokens(F.col(text)).alias("terms")).select(key, F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    return sized.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, weight) of queries (query_id, query); a term that repeats weighs as often."""
    words = queries.select("query_id", F.explode(tokenize_query(F.col("query"))).alias("word"))
    return words.select("query_id", F.explode(tokens(F.col("word"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("weight"))


def bm25(corpus: DataFrame, queries: DataFrame, keep=None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, key, bm25): every row that holds any term of a query; negative, the lower the better.

    keep filters rows before scoring; document counts and lengths are those of the whole corpus. Only tokens that some
    query asks for leave the scan.
    """
    wanted = query_terms(queries)
    asked = wanted.select("term").distinct()
    columns = [key, "dl", "term"] + (["kept"] if keep is not None else [])
    sized = corpus.select(key, tokens(F.col(text)).alias("terms"), *([keep.alias("kept")] if keep is not None else []))
    total = sized.select(F.size("terms").alias("dl")).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    hits = sized.select(*(c for c in columns if c not in ("dl", "term")), F.size("terms").alias("dl"), F.explode("terms").alias("term")).join(asked, "term")
    tf = hits.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"), *([F.first("kept").alias("kept")] if keep is not None else []))
    return scored(tf, wanted, total, key, "kept" if keep is not None else None)


def scored(tf: DataFrame, wanted: DataFrame, total: DataFrame, key: str, kept: str | None = None) -> DataFrame:
    """(query_id, key, bm25) of postings (key, term, tf, dl) of the asked terms; total is one row (n_docs, avgdl).

    Document frequencies are those of all postings; those where the column `kept` is false get no score.
    """
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    tf = tf.where(kept).drop(kept) if kept is not None else tf
    # one row of totals joins every posting: its size is one
    joined = tf.join(df, "term").join(wanted, "term").crossJoin(F.broadcast(total))
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    part = idf * F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return joined.groupBy("query_id", key).agg(F.round(-F.sum(part), DIGITS).alias("bm25"))


#: Terms of queries that are broadcast at a time, scores that are added up at a time, and hits held before the best are chosen.
BLOCK_TERMS, CELLS, HELD = 1 << 20, 1 << 18, 1 << 18
#: Bytes of texts and texts that are split at a time.
TEXT_BYTES, TEXTS = 1 << 22, 1024
#: ASCII that no token holds as blanks; a token by its letters, for what is not ASCII. Both follow INDEX_TOKEN.
_BLANKED = np.array([x if x >= 128 or chr(x).isalnum() else 32 for x in range(256)], np.uint8)
_TOKEN = re.compile(r"[^\W_]+")


class Asked:
    """Queries and their terms, by place: the queries that ask for term t are query[starts[t]:starts[t + 1]], with weights alike."""

    def __init__(self, wanted: DataFrame):
        rows = wanted.toArrow()
        ids, terms = (rows[c].combine_chunks().dictionary_encode() for c in ("query_id", "term"))
        if ids.indices.null_count:  # a query without an id is one like any other
            ids = rows["query_id"].combine_chunks().dictionary_encode("encode")
        place, self.ids = terms.indices.to_numpy(), ids.dictionary
        order = np.argsort(place, kind="stable")
        self.terms = terms.dictionary
        self.query, self.weight = ids.indices.to_numpy()[order], rows["weight"].to_numpy()[order].astype(np.float64)
        self.starts = np.searchsorted(place[order], np.arange(len(self.terms) + 1))

    def tokens(self, data: np.ndarray, edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place of the text, place of the term or -1) of the tokens of blanked texts between edges."""
        for at, bounds in pieces(data, edges):
            buffers = [None, pa.py_buffer((bounds - bounds[0]).astype(np.int32)), pa.py_buffer(data[bounds[0] : bounds[-1]])]
            lists = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), len(bounds) - 1, buffers))
            runs, owner = lists.flatten(), np.repeat(at, lists.value_lengths().to_numpy())
            full = pc.greater(pc.binary_length(runs), 0)
            runs, owner = runs.filter(full), owner[full.to_numpy(zero_copy_only=False)]
            term = pc.fill_null(pc.index_in(runs, value_set=self.terms), -1).to_numpy().astype(np.int64)
            odd = np.flatnonzero(~pc.string_is_ascii(runs).to_numpy(zero_copy_only=False))
            if len(odd):
                coded = runs.take(pa.array(odd)).dictionary_encode()
                found = [_TOKEN.findall(x.decode(errors="replace")) for x in coded.dictionary.cast(pa.binary()).to_pylist()]
                flat = pc.fill_null(pc.index_in(pa.array([t for x in found for t in x], pa.string()), value_set=self.terms), -1).to_numpy().astype(np.int64)
                many = np.array([len(x) for x in found])
                place, plain = coded.indices.to_numpy(), np.delete(np.arange(len(owner)), odd)
                owner = np.concatenate([owner[plain], np.repeat(owner[odd], many[place])])
                term = np.concatenate([term[plain], flat[spread((np.cumsum(many) - many)[place], many[place])]])
            yield owner, term

    def postings(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(dl, and for each text and asked term in it: text, term, tf)."""
        sizes, found = np.zeros(len(edges) - 1, np.int64), [np.zeros(0, np.int64)]
        for owner, term in self.tokens(data, edges):
            sizes += np.bincount(owner, minlength=len(sizes))
            found.append((owner * len(self.terms) + term)[term >= 0])
        pairs, tf = np.unique(np.concatenate(found), return_counts=True)
        return sizes, *np.divmod(pairs, max(1, len(self.terms))), tf

    def scores(self, owner: np.ndarray, term: np.ndarray, part: np.ndarray, n: int) -> np.ndarray:
        """n rows of the sums of the parts of a query's terms, a column a query."""
        out = np.zeros(n * len(self.ids))
        many = self.starts[term + 1] - self.starts[term]
        cuts = np.searchsorted(np.cumsum(many), np.arange(0, many.sum() + CELLS, CELLS), "right")
        for a, b in zip(cuts, [*cuts[1:], len(term)], strict=True):
            at = spread(self.starts[term[a:b]], many[a:b])
            cells = np.repeat(owner[a:b] * len(self.ids), many[a:b]) + self.query[at]
            out += np.bincount(cells, np.repeat(part[a:b], many[a:b]) * self.weight[at], len(out))
        return out.reshape(n, -1)


def blanked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, blanks for what parts ASCII tokens, and where in them its values begin, and the last ends; nulls are empty."""
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    size = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    edges = np.frombuffer(offsets, size)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return _BLANKED[np.frombuffer(data, np.uint8)[edges[0] : edges[-1]]], edges - edges[0]


def blocks(edges: np.ndarray, most: int = TEXTS) -> Iterator[tuple[int, int]]:
    """Ranges of texts, at most so many and of about TEXT_BYTES; a longer text comes alone."""
    at = 0
    while at < len(edges) - 1:
        end = min(at + most, len(edges) - 1, max(at + 1, int(np.searchsorted(edges, edges[at] + TEXT_BYTES, "right")) - 1))
        yield at, end
        at = end


def pieces(data: np.ndarray, edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of texts, edges): all texts at once, or one long text in pieces of about TEXT_BYTES, cut at blanks."""
    first, last = edges[0], edges[-1]
    if len(edges) > 2 or last - first <= TEXT_BYTES:
        yield np.arange(len(edges) - 1), edges
        return
    blanks = first + np.flatnonzero(data[first:last] == 32)
    cuts = np.searchsorted(blanks, np.arange(first + TEXT_BYTES, last, TEXT_BYTES))
    cuts = np.unique(np.concatenate([[first], blanks[cuts[cuts < len(blanks)]], [last]]))
    for k in range(len(cuts) - 1):
        yield np.zeros(1, np.int64), cuts[k : k + 2]


class Best:
    """The best hits of each query so far, equal scores by key."""

    def __init__(self, depth: int, n: int):
        self.depth, self.least, self.held, self.size = depth, np.full(n, np.inf), [], 0

    def add(self, query: np.ndarray, keys: pa.Array, score: np.ndarray) -> None:
        self.held.append(pa.table({"query": query, "score": score, "key": keys}))
        self.size += len(query)
        if self.size > max(HELD, 4 * self.depth * len(self.least)):
            self.chosen()

    def chosen(self) -> pa.Table:
        rows = pa.concat_tables(self.held)
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("query", "score", "key")], null_placement="at_start"))
        query = rows["query"].to_numpy()
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        last = rank == self.depth - 1
        self.least[query[last]] = rows["score"].to_numpy()[last]
        rows = rows.filter(pa.array(rank < self.depth))
        self.held, self.size = [rows], len(rows)
        return rows


def bm25_top(corpus: DataFrame, queries: DataFrame, depth: int, keep=None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """top(bm25(...)): (query_id, key, bm25, rank), the `depth` best rows of each query.

    Two scans of the texts, and no posting or score is dealt out: the first counts rows, lengths and the rows that hold each asked
    term, the second scores each row for every query in turn and keeps the best of its task. Terms of queries are broadcast in blocks.
    """
    if not corpus.groupBy(key).count().where("count > 1").isEmpty():  # rows with one key are one document
        return top(bm25(corpus, queries, keep, key, text), "bm25", depth, key)
    rows = corpus.select(F.lower(F.col(text)).cast("binary").alias("text"), F.col(key).alias("key"), (F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))).alias("kept"))
    wanted = query_terms(queries)
    n_blocks = max(1, -(-wanted.count() // BLOCK_TERMS))
    found = None
    for block in range(n_blocks):
        mine = wanted if n_blocks == 1 else wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == block)
        some = _best_of_block(rows, Asked(mine), depth, wanted.schema["query_id"].dataType.simpleString(), corpus.schema[key].dataType.simpleString())
        found = some if found is None else found.unionByName(some)
    return top(found.withColumnRenamed("key", key), "bm25", depth, key)


def _best_of_block(rows: DataFrame, asked: Asked, depth: int, id_type: str, key_type: str) -> DataFrame:
    context = rows.sparkSession.sparkContext
    shipped = context.broadcast(asked)  # BLOCK_TERMS at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shipped.value
        df, total = np.zeros(len(asked.terms), np.int64), np.zeros(3, np.int64)
        for batch in batches:
            data, edges = blanked(batch.column(0))
            total += (batch.num_rows, batch.num_rows - batch.column(0).null_count, 0)
            for a, b in blocks(edges):
                sizes, _, term, _ = asked.postings(data, edges[a : b + 1])
                df += np.bincount(term, minlength=len(df))
                total[2] += sizes.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-3, len(df))), pa.array(np.concatenate([total, df]))], names=["term", "n"])

    counted = rows.select("text").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    held = dict(zip(counted["term"].to_pylist(), counted["n"].to_pylist(), strict=True))
    n_docs, sized, tokens_ = (held.get(k, 0) for k in (-3, -2, -1))
    df = np.array([held.get(k, 0) for k in range(len(asked.terms))], np.float64)
    totals = context.broadcast((np.maximum(np.log((n_docs - df + 0.5) / (df + 0.5)), LEAST_IDF), (tokens_ / sized if sized else 0.0) or 1.0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, (idf, avgdl) = shipped.value, totals.value
        best = Best(depth, len(asked.ids))
        for batch in batches:
            data, edges = blanked(batch.column(0))
            kept = np.array(batch.column(2).to_numpy(zero_copy_only=False), bool)
            for a, b in blocks(edges, max(1, CELLS // max(1, len(asked.ids)))):
                sizes, owner, term, tf = asked.postings(data, edges[a : b + 1])
                part = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[owner] / avgdl))
                sums = asked.scores(owner, term, part, b - a)
                shown = 0.0 - np.round(sums, DIGITS)
                place, query = np.nonzero((sums > 0) & kept[a:b, None] & (shown <= best.least))
                best.add(query, batch.column(1).take(pa.array(a + place)), shown[place, query])
        if best.held:
            out = best.chosen()
            columns = [asked.ids.take(out["query"].combine_chunks()), out["key"].combine_chunks(), out["score"].combine_chunks()]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "key", "bm25"])

    return rows.mapInArrow(score, f"query_id {id_type}, key {key_type}, bm25 double")


def by_term(rows: DataFrame) -> DataFrame:
    """Postings laid out for storage: ranges of terms in order, so that a scan for a few terms skips the other files and row groups."""
    return rows.repartitionByRange("term").sortWithinPartitions("term")


def bm25_stored(stored: DataFrame, total: DataFrame, queries: DataFrame, pool: DataFrame, key: str = "doc_id") -> DataFrame:
    """bm25() over stored postings (key, term, tf, dl): no text is read; rows whose key is not in pool get no score."""
    wanted = query_terms(queries)
    asked = wanted.select("term").distinct()
    hits = stored.select(key, "term", "tf", "dl").join(asked, "term")
    mine = pool.select(F.col(key).alias("pool key")).distinct()
    hits = hits.join(mine, hits[key] == mine["pool key"], "left").withColumn("kept", F.col("pool key").isNotNull()).drop("pool key")
    return scored(hits, wanted, total, key, "kept")


def top(scores: DataFrame, score: str, depth: int, key: str = "doc_id", ascending: bool = True) -> DataFrame:
    """The best rows of each query with their rank from 1; equal scores by key."""
    order = Window.partitionBy("query_id").orderBy(F.col(score).asc() if ascending else F.col(score).desc(), key)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth)

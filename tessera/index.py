"""The index of a directory: Parquet snapshots, refresh by differences, navigation and ranked search.

A refresh writes a new snapshot beside the old one and then its row in `meta`; readers take the newest row, so an
interrupted refresh is never seen, and a reader of the snapshot before is not disturbed; older ones are removed. Only
files whose modification time or size differ are read.
"""

from __future__ import annotations

import hashlib
import os
import re
import time
import uuid
import warnings
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import lexical, matches_globs, opening_line
from .operators import chunking, extract, fusion, lexical as words, maintenance, navigation, rerank, vectors
from .settings import Settings, normalise_content, require_indexed
from .sources.corpus import listing, read

FILE_COLUMNS = ["path", "lang", "content_type", "size", "mtime_ns", "generated"]
HOME = "TESSERA_HOME"


def home() -> Path:
    """The folder of all indexes and of the user's settings: $TESSERA_HOME, or .tessera in the home directory."""
    return Path(os.environ.get(HOME) or Path.home() / ".tessera").expanduser()


def location(root: str | Path, settings: Settings) -> Path:
    """Where the index of a directory lies: settings.data_dir (under the root if relative), else under home() by name and digest of the root.

    On a cluster this must be a folder that the driver and all executors share.
    """
    base = Path(root).expanduser().resolve()
    if settings.data_dir:
        return base / Path(settings.data_dir).expanduser()
    name = re.sub(r"[^\w-]", "-", base.name) or "root"
    return home() / "index" / f"{name}-{hashlib.blake2b(str(base).encode(), digest_size=4).hexdigest()}"


@dataclass(frozen=True)
class RefreshReport:
    added: int
    changed: int
    deleted: int
    elapsed_s: float


class Index:
    """Opens, refreshes and asks the index of one directory; usable as a context manager."""

    def __init__(self, spark: SparkSession, root: str, data: str, settings: Settings):
        self.spark, self.root, self.data, self.settings, self._scanned = spark, root, data.rstrip("/"), settings, 0.0

    @classmethod
    def open(cls, spark: SparkSession, root: str, settings: Settings | None = None, data: str | None = None) -> Index:
        settings = settings or Settings()
        return cls(spark, root, data or str(location(root, settings)), settings)

    def __enter__(self) -> Index:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """Nothing is held open."""

    def identity(self) -> dict[str, str]:
        """What shapes an index: settings and the revision of the extractor."""
        return {**self.settings.identity(), "extractor": extract.revision()}

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.data}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _meta(self) -> dict | None:
        path, system = self._path("meta")
        if not system.exists(path):
            return None
        row = self.spark.read.option("mergeSchema", True).parquet(f"{self.data}/meta").orderBy(F.desc("version"), F.desc("built")).first()
        return row.asDict() if row else None

    def _table(self, name: str, folder: str | None = None) -> DataFrame:
        if folder is None:
            meta = self._meta()
            if meta is None:
                self.refresh()
                meta = self._meta()
            folder = meta["folder"]
        return self.spark.read.parquet(f"{self.data}/{folder}/{name}")

    def stale(self) -> bool:
        """Whether there is no index, or one built under settings or an extractor that shape it differently."""
        meta = self._meta()
        return meta is None or any(meta.get(k) != v for k, v in {**self.identity(), "folder": meta.get("folder") or ""}.items())

    def refresh(self, force: bool = False) -> RefreshReport:
        """Brings the index up to date; force, or another identity, builds it anew. Chunks that lack a vector get one at any refresh."""
        start, meta = time.time(), self._meta()
        old = None if force or self.stale() else meta["folder"]
        seen = listing(self.spark, self.root, self.settings)
        known = seen.withColumn("generated", F.lit(False)).limit(0) if old is None else self._table("files", old)
        changes = maintenance.diff(seen.select("path", "size", "mtime_ns"), known, "path", ["size", "mtime_ns"]).cache()
        counts = {}
        if not changes.isEmpty() or meta is None or old is None or self._unembedded(old):
            version = (meta["version"] if meta else 0) + 1
            folder = f"v{version}-{uuid.uuid4().hex[:8]}"
            self._write(folder, old, seen.join(changes.where("change <> 'deleted'").select("path"), "path"), changes.select("path"))
            # generated files are kept in mind, so that they are not read again, but they are no part of the index
            before, after = (t.where(~F.col("generated")).select("path") for t in (known, self._table("files", folder)))
            mine = changes.join(before.unionByName(after).distinct(), "path", "left_semi")
            counts = {r["change"]: r["count"] for r in mine.groupBy("change").count().collect()}
            row = [(version, time.time(), folder, *self.identity().values())]
            self.spark.createDataFrame(row, "version int, built double, folder string, " + ", ".join(f"{k} string" for k in self.identity())).write.mode("append").parquet(f"{self.data}/meta")
            self._remove_before(version - 1)
        changes.unpersist()
        self._scanned = time.time()
        return RefreshReport(counts.get("added", 0), counts.get("changed", 0), counts.get("deleted", 0), time.time() - start)

    def _unembedded(self, folder: str) -> bool:
        return self.settings.embed_backend != "none" and not vectors.missing(self._table("chunks", folder).select("chunk_id"), self._table("vectors", folder)).isEmpty()

    def _remove_before(self, version: int) -> None:
        """Removes the snapshots of versions older than the one given."""
        for row in self.spark.read.option("mergeSchema", True).parquet(f"{self.data}/meta").where(F.col("version") < version).select("folder").collect():  # a row a refresh
            path, system = self._path(row["folder"] or "none")
            if system.exists(path):
                system.delete(path, True)

    def _write(self, folder: str, old: str | None, touched: DataFrame, gone: DataFrame) -> None:
        """Writes a snapshot: the rows of the old one outside the paths that are gone or touched, and those of touched files."""
        whole = lambda name: f"{self.data}/{folder}/{name}"
        kept = lambda name: self._table(name, old).join(gone, "path", "left_anti")
        texts = read(touched, self.root).cache()
        for name, rows in self._derived(texts.where(~F.col("generated"))).items():
            rows = texts.select(*FILE_COLUMNS) if name == "files" else rows
            rows = rows if old is None else kept(name).unionByName(rows)
            (words.by_term(rows) if name == "postings" else rows).write.parquet(whole(name))
        texts.unpersist()
        chunks = self._table("chunks", folder)
        ready = self.spark.createDataFrame([], "chunk_id long, embedding array<float>, path string") if old is None else kept("vectors")
        lacking = vectors.missing(chunks.select("chunk_id", "path", "text"), ready)
        fresh = vectors.encode(lacking, self.settings).join(lacking.select("chunk_id", "path"), "chunk_id")
        try:
            ready.unionByName(fresh).write.parquet(whole("vectors"))
        except Exception as problem:  # noqa: BLE001  an encoder out of reach leaves an index without the new vectors; the next refresh asks again
            if self.settings.embed_backend != "http":
                raise
            warnings.warn(f"no vectors for new chunks: {problem}"[:300], stacklevel=2)
            ready.write.mode("overwrite").parquet(whole("vectors"))

    def _derived(self, files: DataFrame) -> dict[str, DataFrame]:
        """files, symbols, chunks and postings of some files."""
        s = self.settings
        symbols = extract.extract(files).withColumn("symbol_id", F.xxhash64("path", "name", "tag", "kind", "start_line"))
        symbols = navigation.with_enclosing(symbols)
        defs = navigation.first_of(symbols.where("tag = 'def'"), ["path", "start_line"], ["end_line", "name"])
        named = chunking.definition_chunks(defs, files, s.max_chunk_lines, "path")
        windows = chunking.line_windows(files, s.window_chars, "path")
        chunks = chunking.hybrid(named, windows, "path") if s.coverage == "hybrid" else named
        owner = defs.select("path", "name", "start_line", "symbol_id", "signature")
        chunks = chunks.join(owner, ["path", "name", "start_line"], "left").join(files.select("path", "lang", "content_type"), "path")
        chunks = chunks.withColumn("chunk_id", F.xxhash64("path", "name", "start_line")).withColumn("lexical", lexical(F.col("path"), F.col("text"), s))
        chunks = chunks.withColumn("tokens", F.size(words.tokens(F.col("lexical"))))
        postings = words.postings(chunks, "chunk_id", "lexical").join(chunks.select("chunk_id", "path"), "chunk_id")
        return {"files": files, "symbols": symbols, "chunks": chunks, "postings": postings}

    def _maybe_refresh(self) -> None:
        if self.settings.refresh_mode == "auto" and time.time() - self._scanned >= self.settings.rescan_after_seconds:
            self.refresh()

    def definitions(self, name: str, lang=None) -> DataFrame:
        self._maybe_refresh()
        return navigation.named(self._table("symbols"), name, "def", lang)

    def references(self, name: str, lang=None) -> DataFrame:
        self._maybe_refresh()
        return navigation.named(self._table("symbols"), name, "ref", lang)

    def symbols(self, pattern=None, *, tag=None, lang=None, content=None, include=None, exclude=None, limit: int | None = None) -> DataFrame:
        self._maybe_refresh()
        out = navigation.symbol_filter(self._table("symbols"), pattern, tag, lang, normalise_content(content, self.settings), include, exclude).orderBy("path", "start_line", "name")
        return out.limit(limit) if limit is not None else out

    def symbol_counts(self, by: str, pattern=None, *, tag=None, lang=None, content=None, include=None, exclude=None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(counts, totals): totals has one row with the groups and rows matched, whatever the limit."""
        rows = navigation.symbol_filter(self._table("symbols"), pattern, tag, lang, normalise_content(content, self.settings), include, exclude)
        return navigation.symbol_counts(rows, by, limit), navigation.symbol_totals(rows, navigation.DIMENSIONS[by])

    def status(self) -> DataFrame:
        """(what, n) for files, chunks, symbols and the bytes of the files."""
        files = self._table("files").where(~F.col("generated"))
        return navigation.status(files, self._table("chunks"), self._table("symbols")).unionByName(navigation.total_bytes(files))

    def languages(self, limit: int | None = None) -> DataFrame:
        """(value, n): languages by their number of files."""
        return navigation.top_values(self._table("files").where(~F.col("generated")), "lang", limit)

    def search(self, queries: str | DataFrame, k: int = 10, *, content=None, lang=None, include=None, exclude=None) -> DataFrame:
        """(query_id, rank, score, path, start_line, end_line, name, signature, text, tiers) of one query or a table of them."""
        require_indexed(content, self.settings)
        self._maybe_refresh()
        if isinstance(queries, str):
            queries = self.spark.range(1).select(F.col("id").cast("int").alias("query_id"), F.lit(queries).alias("query"))
        s, chunks = self.settings, self._table("chunks")
        keep = matches_globs(F.col("path"), include, exclude) & F.col("content_type").isin(*normalise_content(content, s))
        keep = keep & F.col("lang").isin(*([lang] if isinstance(lang, str) else lang)) if lang else keep
        pool = chunks.where(keep)
        exact = navigation.exact_chunks(self._table("symbols"), pool, queries).withColumn("raw", F.lit(1.0))
        total = chunks.agg(F.count("*").alias("n_docs"), F.avg("tokens").alias("avgdl"))
        hits = words.top(words.bm25_stored(self._table("postings"), total, queries, pool, "chunk_id"), "bm25", s.candidate_depth, "chunk_id")
        lists = fusion.ranked("exact", exact.withColumn("place", F.struct("path", "line")), "raw", "chunk_id", preserve="place").unionByName(fusion.ranked("lexical", hits, "bm25", "chunk_id", lower_is_better=True))
        if s.embed_backend != "none" and self._meta()["vectors"] != s.identity()["vectors"]:
            warnings.warn("the vectors of this index are of another encoder: the vector tier is left out until a refresh", stacklevel=2)
        elif s.embed_backend != "none":
            asked = vectors.encode(queries.withColumnRenamed("query", "text"), s, "query_id", s.embed_query_prefix)
            mine = self._table("vectors").join(pool.select("chunk_id"), "chunk_id")
            near = vectors.nearest(mine, asked, s.candidate_depth, None, "chunk_id")
            lists = lists.unionByName(fusion.ranked("vector", near, "cosine", "chunk_id"))
        fused = fusion.merge(lists, queries, s, "chunk_id").join(queries, "query_id").join(pool.select("chunk_id", "path", "text"), "chunk_id").withColumnRenamed("fused", "score")
        if s.rerank:
            explicit = normalise_content(content, s)
            best = rerank.rerank(fused, s, k, pool, penalise=not content or explicit == ("code",), key="chunk_id")
        else:
            best = words.top(fused, "score", k, "chunk_id", ascending=False)
        rows = pool.select("chunk_id", "start_line", "end_line", "name", F.coalesce("signature", opening_line(F.col("text"))).alias("signature"))
        return best.join(rows, "chunk_id").join(fusion.evidence(lists, "chunk_id"), ["query_id", "chunk_id"], "left").select("query_id", "rank", "score", "path", "start_line", "end_line", "name", "signature", "text", "tiers").orderBy("query_id", "rank")

"""Query catalogue of the retrieval engine: name to callable (spark, sf_dir) -> DataFrame, name to oracle SQL.

Queries run over whole tables. What has no SQL (parsing, encoders, greedy folds, streams) is tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as fc
from ..functions import text as ft
from ..operators import chunking, evaluation, extract, fusion, lexical, maintenance, navigation, rerank, vectors
from ..settings import MIN_CHUNK_CHARS, Settings
from ..sources import corpus as sources

S = Settings()
QUERIES: dict = {}
ORACLES: dict = {}
WORDS = "worthless clown idiot ththtion reatheon"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(column, name: str):
    return F.col(column).cast("bigint").alias(name) if isinstance(column, str) else column.cast("bigint").alias(name)


# ---- pieces of SQL that several oracles share ----
_SUFFIXES = "[" + ", ".join(f"'{s}'" for s in sources.DOCUMENT_SUFFIXES) + "]"
CORPUS = f"""corpus0 AS (SELECT doc_id, source, text, source || '/' || lang || '/doc_' || doc_id || ({_SUFFIXES})[CAST(doc_id % 8 AS INT) + 1] AS path FROM documents),
corpus AS (SELECT *, CASE regexp_extract(lower(path), '\\.([a-z0-9]+)$', 1) WHEN 'md' THEN 'markdown' WHEN 'py' THEN 'python' WHEN 'go' THEN 'go'
  WHEN 'swift' THEN 'swift' WHEN 'ts' THEN 'typescript' WHEN 'json' THEN 'json' WHEN 'csv' THEN 'csv' END AS lang FROM corpus0),
files AS (SELECT *, CASE WHEN lang = 'markdown' THEN 'docs' WHEN lang = 'json' THEN 'config' WHEN lang = 'csv' THEN 'data'
  WHEN regexp_matches(path, '{fc.test_patterns(S.test_markers)[0]}') OR regexp_matches(path, '{fc.test_patterns(S.test_markers)[1]}') THEN 'tests' ELSE 'code' END AS content_type FROM corpus)"""
HUMANISE = "array_to_string(regexp_extract_all(regexp_replace(translate({0}, '/.', '  '), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z][a-z]+|[A-Z]+|[a-z]+|[0-9]+'), ' ')"
LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS n FROM documents)"
SYMBOLS = f"""{CORPUS}, {LINES},
symbols AS (SELECT l.doc_id * 100000 + l.n AS symbol_id, regexp_extract(line, '{ft.IDENTIFIER}') AS name, CASE WHEN l.n % 3 = 1 THEN 'def' ELSE 'ref' END AS tag,
  f.path, l.n AS start_line, l.n + 2 AS end_line, f.lang, f.content_type FROM lines l JOIN files f USING (doc_id) WHERE regexp_extract(line, '{ft.IDENTIFIER}') <> '')"""
_STOPS = ", ".join(f"'{w}'" for w in ft.QUERY_STOP_WORDS)
TOKENS = f"""tokens AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(text), '{ft.INDEX_TOKEN}') AS terms FROM documents),
totals AS (SELECT count(*) AS n_docs, avg(len(terms)) AS avgdl FROM tokens),
postings AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM tokens) GROUP BY doc_id, term)"""
ASKED = f"""asked AS (SELECT query_id, lower(w) AS term, count(*) AS weight FROM (SELECT query_id, unnest(regexp_extract_all(query, '{ft.IDENTIFIER}')) AS w FROM queries)
  WHERE length(w) > 2 AND lower(w) NOT IN ({_STOPS}) GROUP BY query_id, lower(w))"""
BM25 = """df AS (SELECT term, count(*) AS df FROM postings WHERE term IN (SELECT term FROM asked) GROUP BY term),
scores AS MATERIALIZED (SELECT query_id, doc_id, round(-sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS bm25
  FROM asked JOIN df USING (term) JOIN postings USING (term) CROSS JOIN totals {where} GROUP BY query_id, doc_id)"""
BENCHMARK = "queries AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
ONE_QUERY = f"queries AS (SELECT 0 AS query_id, '{WORDS}' AS query)"
TOP = "SELECT query_id, doc_id, bm25, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25, doc_id) AS rank FROM scores) WHERE rank <= {0}"
COSINE = """pairs AS MATERIALIZED (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS cosine
  FROM embeddings v, (SELECT * FROM embeddings WHERE {0}) q {1})"""
LISTS = f"""{BENCHMARK}, {TOKENS}, {ASKED}, {BM25.format(where="")}, {COSINE.format("vec_id IN (SELECT item_id FROM benchmark)", "")},
lists AS MATERIALIZED (SELECT query_id, 'lexical' AS tier, doc_id, rank, bm25 AS raw FROM ({TOP.format(30)})
  UNION ALL SELECT query_id, 'vector', doc_id, rank, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, doc_id) AS rank FROM pairs) WHERE rank <= 30)"""
FUSED = """shaped AS (SELECT query_id, CASE WHEN len(regexp_extract_all(query, '[A-Za-z_][A-Za-z0-9_]*')) >= 4 THEN 0.5 ELSE 0.3 END AS alpha FROM queries),
rrf AS MATERIALIZED (SELECT query_id, doc_id, round(sum((CASE tier WHEN 'vector' THEN alpha ELSE 1 - alpha END) / (60 + rank)), 9) AS fused FROM lists JOIN shaped USING (query_id) GROUP BY query_id, doc_id)"""
MINMAX = "normed AS MATERIALIZED (SELECT query_id, doc_id, round(CASE WHEN hi = lo THEN 1.0 ELSE (fused - lo) / (hi - lo) END, 6) AS fused FROM (SELECT *, min(fused) OVER (PARTITION BY query_id) AS lo, max(fused) OVER (PARTITION BY query_id) AS hi FROM {0}))"
PENALTY = f"""(CASE WHEN regexp_matches({{0}}, '{fc.TEST_FILES}') OR regexp_matches({{0}}, '{fc.TEST_DIRS}') THEN CAST(0.3 AS DOUBLE) ELSE 1 END
  * CASE WHEN regexp_extract({{0}}, '[^/]*$') IN ('__init__.py', 'package-info.java') THEN CAST(0.5 AS DOUBLE) ELSE 1 END * CASE WHEN regexp_matches({{0}}, '{fc.COMPAT_DIRS}') THEN CAST(0.3 AS DOUBLE) ELSE 1 END
  * CASE WHEN regexp_matches({{0}}, '{fc.EXAMPLE_DIRS}') THEN CAST(0.3 AS DOUBLE) ELSE 1 END * CASE WHEN regexp_matches({{0}}, '{fc.TYPE_FILES}') THEN CAST(0.7 AS DOUBLE) ELSE 1 END)"""


# ---- scans, filters, derived columns ----
@query(f"WITH {CORPUS} SELECT doc_id, path, length(text) AS n_chars FROM files WHERE octet_length(encode(text)) <= 2000 AND length(text) BETWEEN 60 AND 20000 AND content_type <> 'data'")
def scan_filter_size(spark, d):
    files = sources.documents(spark, d).where((F.octet_length("text") <= 2000) & F.length("text").between(60, 20000) & ~F.col("content_type").isin(*S.index_excluded))
    return files.select("doc_id", "path", long(F.length("text"), "n_chars"))


@query(f"WITH {CORPUS} SELECT doc_id, path, lang, content_type FROM files")
def classify_files(spark, d):
    return sources.documents(spark, d).select("doc_id", "path", "lang", "content_type")


@query("""WITH probed AS (SELECT page_id, octet_length(encode(html)) AS size, string_split(replace(replace(html, '</p>', chr(10)), '<li>', chr(10)), chr(10)) AS l FROM pages),
sized AS (SELECT page_id, size, list_sort(list_transform(l[1:len(l) - 1], lambda x: octet_length(encode(x)))) AS s FROM probed WHERE octet_length(encode(array_to_string(l, chr(10)))) <= 65536)
SELECT page_id, size >= 16384 AND (len(s) < 3 OR coalesce(s[len(s) // 2 + 1], 0) > 1000) AS generated FROM sized""")
def generated_probe(spark, d):
    html = F.regexp_replace("html", "</p>|<li>", "\n")
    rows = table(spark, d, "pages").select("page_id", F.octet_length("html").alias("size"), html.alias("html"))
    return rows.select("page_id", fc.is_generated(F.col("html"), F.col("size")).alias("generated"))


@query(f"WITH {CORPUS} SELECT path, {HUMANISE.format('path')} AS words FROM files UNION ALL SELECT url, {HUMANISE.format('url')} FROM pages")
def humanise_paths(spark, d):
    both = sources.documents(spark, d).select("path").unionAll(table(spark, d, "pages").select("url"))
    return both.select("path", ft.humanise(F.col("path")).alias("words"))


@query(f"""WITH {CORPUS}, words AS (SELECT doc_id, unnest(regexp_extract_all(regexp_extract(path, '[^/]*$'), '{ft.IDENTIFIER}')) AS w FROM files),
cut AS (SELECT doc_id, w, CASE WHEN contains(w, '_') THEN list_filter(string_split(lower(w), '_'), lambda p: p <> '')
  ELSE list_transform(regexp_extract_all(regexp_replace(w, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda p: lower(p)) END AS p FROM words)
SELECT doc_id, w AS identifier, array_to_string(CASE WHEN len(p) >= 2 THEN list_concat([lower(w)], p) ELSE [lower(w)] END, ' ') AS parts FROM cut""")
def split_identifiers(spark, d):
    words = sources.documents(spark, d).select("doc_id", F.explode(ft.found(ft.file_name(F.col("path")), ft.IDENTIFIER)).alias("identifier"))
    return words.select("doc_id", "identifier", F.array_join(ft.split_identifier(F.col("identifier")), " ").alias("parts"))


@query(f"""WITH {CORPUS} SELECT doc_id, sha256(text || ' ' || stem || ' ' || stem || ' ' || array_to_string(list_filter(string_split(path, '/')[greatest(1, len(string_split(path, '/')) - 3):len(string_split(path, '/')) - 1], lambda x: x <> ''), ' ')) AS rendered
FROM (SELECT *, regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\\.[^.]*$', '\\1') AS stem FROM files)""")
def lexical_enriched(spark, d):
    return sources.documents(spark, d).select("doc_id", F.sha2(ft.enriched(F.col("path"), F.col("text")), 256).alias("rendered"))


@query(f"""WITH {CORPUS}, named AS (SELECT doc_id, path, list_filter(list_transform(regexp_extract_all(text, '{ft.LONG_IDENTIFIER}'), lambda w: {HUMANISE.format('w')}), lambda w: w <> '') AS w FROM files),
firsts AS (SELECT doc_id, w, min(i) AS i FROM (SELECT doc_id, unnest(w) AS w, unnest(generate_series(1, len(w))) AS i FROM named) GROUP BY doc_id, w),
capped AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS words FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM firsts) WHERE k <= 25 GROUP BY doc_id)
SELECT n.doc_id, {HUMANISE.format('n.path')} || ' :: window' || coalesce(' :: ' || words, '') AS distilled FROM named n LEFT JOIN capped USING (doc_id)""")
def distil_text(spark, d):
    return sources.documents(spark, d).select("doc_id", ft.distilled(F.col("path"), F.lit("window"), F.lit(""), F.col("text")).alias("distilled"))


@query(f"""WITH asked AS (SELECT text AS query FROM benchmark UNION ALL SELECT unnest(['HandlerStack', 'pkg::Widget', '_private', 'how does parseConfig work', 'a.b.c', 'lower', 'snake_case', 'the XMLHttpRequest api']))
SELECT query, regexp_matches(trim(query), '{ft.SYMBOL_QUERY}') AS is_symbol, len(regexp_extract_all(query, '{ft.IDENTIFIER}')) >= 4 AS is_prose,
  array_to_string(list_sort(list_distinct(regexp_extract_all(query, '{ft.EMBEDDED_SYMBOL}'))), ' ') AS embedded,
  array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(query, '{ft.IDENTIFIER}'), lambda w: length(w) > 2), lambda w: lower(w)), lambda w: w NOT IN ({", ".join(f"'{w}'" for w in ft.STEM_STOP_WORDS)})))), ' ') AS stems,
  CASE WHEN contains(query, '::') THEN string_split(query, '::')[-1] WHEN contains(query, '.') THEN string_split(query, '.')[-1] ELSE query END AS bare FROM asked""")
def query_shape(spark, d):
    own = ["HandlerStack", "pkg::Widget", "_private", "how does parseConfig work", "a.b.c", "lower", "snake_case", "the XMLHttpRequest api"]
    asked = table(spark, d, "benchmark").select(F.col("text").alias("query")).unionAll(spark.range(1).select(F.explode(F.array(*map(F.lit, own)))))
    q = F.col("query")
    joined = lambda words: F.array_join(F.array_sort(words), " ")
    return asked.select(
        "query", ft.is_symbol_query(q).alias("is_symbol"), ft.looks_like_prose(q, 4).alias("is_prose"), joined(ft.embedded_symbols(q)).alias("embedded"), joined(ft.stem_keywords(q)).alias("stems"), ft.unqualified(q).alias("bare")
    )


@query(f"WITH {CORPUS} SELECT doc_id, path FROM files WHERE (path GLOB 'src1*/en/*' OR path GLOB '*_test.go') AND NOT path GLOB '*[13579].md' AND lang IN ('markdown', 'go', 'python') AND content_type IN ('docs', 'tests')")
def glob_include_exclude(spark, d):
    rows = sources.documents(spark, d).where(ft.matches_globs(F.col("path"), ["src1*/en/*", "*_test.go"], ["*[13579].md"]))
    return rows.where(F.col("lang").isin("markdown", "go", "python") & F.col("content_type").isin("docs", "tests")).select("doc_id", "path")


# ---- chunks ----
@query(f"""WITH RECURSIVE pieces AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
cut AS (SELECT doc_id, CASE WHEN p[-1] = '' THEN list_transform(p[:-2], lambda x: x || chr(10)) ELSE list_concat(list_transform(p[:-2], lambda x: x || chr(10)), [p[-1]]) END AS lines FROM pieces),
sized AS (SELECT doc_id, lines, list_transform(lines, lambda x: strlen(x)) AS sizes, list_transform(lines, lambda x: ends_with(x, chr(10))) AS ended FROM cut),
walk AS (SELECT doc_id, 0 AS n, 1 AS first, CAST(0 AS BIGINT) AS held, false AS closed, len(lines) AS total FROM sized
  UNION ALL SELECT w.doc_id, w.n + 1, CASE WHEN w.closed THEN w.n + 1 ELSE w.first END, CASE WHEN w.closed THEN 0 ELSE w.held END + s.sizes[w.n + 1],
    CASE WHEN w.closed THEN 0 ELSE w.held END + s.sizes[w.n + 1] >= {S.window_chars} AND s.ended[w.n + 1], w.total FROM walk w JOIN sized s USING (doc_id) WHERE w.n < w.total),
spans AS (SELECT doc_id, first AS a, n AS b FROM walk WHERE n > 0 AND (closed OR n = total)),
texts AS (SELECT doc_id, a, b, array_to_string(lines[a:b], '') AS text FROM spans JOIN sized USING (doc_id))
SELECT doc_id, CAST(a AS BIGINT) AS start_line, CAST(b AS BIGINT) AS end_line, sha256(text) AS digest FROM texts
WHERE length(regexp_replace(text, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g')) >= {MIN_CHUNK_CHARS}""")
def line_windows(spark, d):
    out = chunking.line_windows(sources.documents(spark, d), S.window_chars)
    return out.select("doc_id", long("start_line", "start_line"), long("end_line", "end_line"), F.sha2("text", 256).alias("digest"))


@query()
def oversize_split(spark, d):
    return chunking.bounded(table(spark, d, "documents").select("doc_id", "text"), 500).select("doc_id", long("piece", "piece"), long(F.octet_length("text"), "n_bytes"))


@query(f"""WITH {LINES}, totals AS (SELECT doc_id, max(n) AS total FROM lines GROUP BY doc_id)
SELECT doc_id, line AS name, n AS start_line, coalesce(lead(n) OVER (PARTITION BY doc_id ORDER BY n), total + 1) - 1 AS end_line FROM lines JOIN totals USING (doc_id) WHERE n % 20 = 1""")
def md_sections(spark, d):
    out = chunking.sections(table(spark, d, "documents"), F.col("n") % 20 == 1)
    return out.select("doc_id", "name", long("start_line", "start_line"), long("end_line", "end_line"))


@query(f"""WITH {LINES}, sized AS (SELECT doc_id, max(n) AS total FROM lines GROUP BY doc_id),
defs AS (SELECT doc_id, n AS a, least(n + 3, total) AS b FROM lines JOIN sized USING (doc_id) WHERE n % 7 = 1),
wins AS (SELECT doc_id, n AS a, least(n + 4, total) AS b FROM lines JOIN sized USING (doc_id) WHERE n % 5 = 1),
kept AS (SELECT w.doc_id, w.a, w.b FROM wins w WHERE 2 * (SELECT count(*) FROM range(w.a, w.b + 1) r(x) WHERE NOT EXISTS (SELECT 1 FROM defs e WHERE e.doc_id = w.doc_id AND x BETWEEN e.a AND e.b)) >= w.b - w.a + 1)
SELECT doc_id, 'd' AS kind, a AS start_line, b AS end_line FROM defs UNION ALL SELECT doc_id, '' , a, b FROM kept""")
def hybrid_overlap(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "text"), F.size(F.split("text", "\n", -1)).alias("total"))
    lines = lines.withColumn("n", F.col("k") + 1)
    span = lambda size: (F.col("n").alias("start_line"), F.least(F.col("n") + size, F.col("total")).alias("end_line"))
    defs = lines.where("n % 7 = 1").select("doc_id", F.lit("d").alias("name"), *span(3), "text")
    out = chunking.hybrid(defs, lines.where("n % 5 = 1").select("doc_id", *span(4), "text"))
    return out.select("doc_id", F.col("name").alias("kind"), long("start_line", "start_line"), long("end_line", "end_line"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def first_wins_dedupe(spark, d):
    out = navigation.first_of(table(spark, d, "documents").withColumn("content_hash", chunking.content_hash(F.col("text"))), ["content_hash"], ["doc_id"])
    return out.select("doc_id", "content_hash")


# ---- symbols ----
def line_symbols(spark, d) -> DataFrame:
    """The first identifier of every line as a symbol: every third a definition of three lines, the others references."""
    files = sources.documents(spark, d)
    lines = files.select("doc_id", "path", "lang", "content_type", F.posexplode(F.split("text", "\n", -1)).alias("k", "line")).withColumn("n", F.col("k") + 1)
    name = F.regexp_extract("line", ft.IDENTIFIER, 0)
    return lines.select(
        (F.col("doc_id") * 100000 + F.col("n")).alias("symbol_id"), name.alias("name"), F.when(F.col("n") % 3 == 1, "def").otherwise("ref").alias("tag"),
        "path", F.col("n").alias("start_line"), (F.col("n") + 2).alias("end_line"), "lang", "content_type", "doc_id",
    ).where("name <> ''")


@query(f"WITH {SYMBOLS} SELECT path, start_line, end_line, lang, content_type FROM symbols WHERE name = 'The' AND tag = 'def' AND lang IN ('python', 'go')")
def symbols_nav(spark, d):
    out = navigation.named(line_symbols(spark, d), "The", "def", ["python", "go"])
    return out.select("path", long("start_line", "start_line"), long("end_line", "end_line"), "lang", "content_type")


@query(f"WITH {SYMBOLS} SELECT symbol_id, name, path, start_line FROM symbols WHERE name GLOB 'Th*' AND tag = 'ref' AND content_type IN ('docs', 'code') AND NOT path GLOB '*/fr/*'")
def symbols_enumerate(spark, d):
    out = navigation.symbol_filter(line_symbols(spark, d), "Th*", "ref", content=["docs", "code"], exclude=["*/fr/*"])
    return out.select("symbol_id", "name", "path", long("start_line", "start_line"))


def _counts(by: str):
    column, limit = navigation.DIMENSIONS[by], 25 if by in ("name", "file") else None

    @query(f"WITH {SYMBOLS} SELECT {column} AS key, count(*) AS count FROM symbols GROUP BY {column} ORDER BY count DESC, key" + (f" LIMIT {limit}" if limit else ""), f"symbol_counts_{by}")
    def counts(spark, d):
        return navigation.symbol_counts(line_symbols(spark, d), by, limit)


for _by in navigation.DIMENSIONS:
    _counts(_by)


@query(f"WITH {SYMBOLS} SELECT count(DISTINCT name) AS groups, count(*) AS total FROM symbols")
def symbol_totals(spark, d):
    return navigation.symbol_totals(line_symbols(spark, d), "name")


@query(f"""WITH {SYMBOLS}, refs AS (SELECT * FROM symbols WHERE tag = 'ref'), defs AS (SELECT * FROM symbols WHERE tag = 'def'),
held AS (SELECT r.symbol_id, arg_min(e.symbol_id, (e.end_line - e.start_line) * 1000000000000 + e.symbol_id) AS enclosing FROM refs r JOIN defs e ON r.path = e.path AND r.start_line BETWEEN e.start_line AND e.end_line GROUP BY r.symbol_id)
SELECT r.symbol_id, h.enclosing FROM refs r LEFT JOIN held h USING (symbol_id)""")
def enclosing_interval(spark, d):
    symbols = line_symbols(spark, d)
    out = navigation.innermost(symbols.where("tag = 'ref'"), symbols.where("tag = 'def'"), "path", "start_line", "start_line", "end_line", "symbol_id", "symbol_id")
    return out.select("symbol_id", "enclosing")


@query(f"""WITH {SYMBOLS}, chunks AS (SELECT doc_id * 1000 + (n - 1) // 5 AS chunk_id, f.path, n AS a, n + 4 AS b, CASE WHEN (n - 1) // 5 % 2 = 0 THEN doc_id * 100000 + n END AS own FROM lines JOIN files f USING (doc_id) WHERE n % 5 = 1)
SELECT c.chunk_id, min(c.path) AS path, min(c.a) AS line FROM symbols s JOIN chunks c ON s.path = c.path AND (c.own = s.symbol_id OR c.own IS NULL AND s.start_line BETWEEN c.a AND c.b)
WHERE s.tag = 'def' AND s.name = 'The' GROUP BY c.chunk_id""")
def exact_tier_theta(spark, d):
    lines = sources.documents(spark, d).select("doc_id", "path", F.posexplode(F.split("text", "\n", -1)).alias("k", "line")).where("k % 5 = 0")
    own = F.when(F.floor(F.col("k") / 5) % 2 == 0, F.col("doc_id") * 100000 + F.col("k") + 1)
    chunks = lines.select((F.col("doc_id") * 1000 + F.floor(F.col("k") / 5)).alias("chunk_id"), "path", (F.col("k") + 1).alias("start_line"), (F.col("k") + 5).alias("end_line"), own.alias("symbol_id"))
    asked = spark.createDataFrame([(0, "The")], "query_id int, query string")
    return navigation.exact_chunks(line_symbols(spark, d), chunks, asked).select("chunk_id", "path", long("line", "line"))


@query(f"WITH {SYMBOLS} SELECT 'files' AS what, (SELECT count(*) FROM files) AS n UNION ALL SELECT 'chunks', (SELECT count(*) FROM conversations) UNION ALL SELECT 'symbols', (SELECT count(*) FROM symbols)")
def status_counts(spark, d):
    return navigation.status(sources.documents(spark, d), sources.conversations(spark, d), line_symbols(spark, d))


@query(f"WITH {CORPUS} SELECT lang AS value, count(*) AS n FROM files GROUP BY lang ORDER BY n DESC, value LIMIT 5")
def top_languages(spark, d):
    return navigation.top_values(sources.documents(spark, d), "lang", 5)


@query(f"WITH {CORPUS} SELECT content_type AS value, count(*) AS n FROM files GROUP BY content_type")
def by_content(spark, d):
    return navigation.top_values(sources.documents(spark, d), "content_type")


# ---- tiers ----
def one_query(spark) -> DataFrame:
    return spark.range(1).select(F.col("id").cast("int").alias("query_id"), F.lit(WORDS).alias("query"))


def benchmark_queries(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def ranks(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.col("rank").cast("bigint"))


@query(f"WITH {ONE_QUERY}, {TOKENS}, {ASKED}, {BM25.format(where='')} {TOP.format(10)}")
def bm25_topk(spark, d):
    return ranks(lexical.bm25_top(table(spark, d, "documents"), one_query(spark), 10))


@query(f"WITH {ONE_QUERY}, {CORPUS}, {TOKENS}, {ASKED}, {BM25.format(where=chr(10) + 'WHERE doc_id IN (SELECT doc_id FROM files WHERE content_type = ' + chr(39) + 'docs' + chr(39) + ')')} {TOP.format(10)}")
def bm25_filtered(spark, d):
    docs = sources.documents(spark, d)
    return ranks(lexical.bm25_top(docs, one_query(spark), 10, F.col("content_type") == "docs"))


@query(f"WITH {BENCHMARK}, {TOKENS}, {ASKED}, {BM25.format(where='')} {TOP.format(30)}")
def bm25_batch(spark, d):
    return ranks(lexical.bm25_top(table(spark, d, "documents"), benchmark_queries(spark, d), S.candidate_depth))


def vector_queries(spark, d, keep) -> DataFrame:
    return table(spark, d, "embeddings").where(keep).select(F.col("vec_id").alias("query_id"), "embedding")


NEAREST = "SELECT query_id, doc_id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, doc_id) AS rank FROM pairs) WHERE rank <= {0}"


def nearest(spark, d, queries, k, keep=None) -> DataFrame:
    return ranks(vectors.nearest(table(spark, d, "embeddings"), queries, k, keep).withColumnRenamed("vec_id", "doc_id"))


@query(f"WITH {COSINE.format('vec_id = 0', '')} {NEAREST.format(10)}")
def vector_topk(spark, d):
    return nearest(spark, d, vector_queries(spark, d, F.col("vec_id") == 0), 10)


@query(f"WITH {COSINE.format('vec_id = 0', 'WHERE v.label = 1')} {NEAREST.format(10)}")
def vector_filtered(spark, d):
    return nearest(spark, d, vector_queries(spark, d, F.col("vec_id") == 0), 10, F.col("label") == 1)


@query(f"WITH {COSINE.format('vec_id % 20 = 0', '')} {NEAREST.format(5)}")
def vector_batch(spark, d):
    return nearest(spark, d, vector_queries(spark, d, F.col("vec_id") % 20 == 0), 5)


@query()
def embed_hash(spark, d):
    return vectors.encode(sources.documents(spark, d), S, "doc_id")


# ---- fusion and reranking ----
def tier_lists(spark, d) -> DataFrame:
    queries = benchmark_queries(spark, d)
    words = lexical.bm25_top(table(spark, d, "documents"), queries, S.candidate_depth)
    asked = table(spark, d, "embeddings").join(queries.select(F.col("query_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), "embedding")
    near = vectors.nearest(table(spark, d, "embeddings"), asked, S.candidate_depth).withColumnRenamed("vec_id", "doc_id")
    return fusion.ranked("lexical", words, "bm25", lower_is_better=True).unionByName(fusion.ranked("vector", near, "cosine"))


@query(f"WITH {LISTS} SELECT query_id, doc_id, round(sum(CAST(1 AS DOUBLE) / (60 + rank)), 9) AS fused FROM lists GROUP BY query_id, doc_id")
def rrf_fusion(spark, d):
    lists = fusion.weighted(tier_lists(spark, d), benchmark_queries(spark, d), Settings(adaptive_alpha=False))
    return fusion.reciprocal_ranks(lists)


@query(f"WITH {LISTS}, {FUSED} SELECT * FROM rrf")
def rrf_weighted(spark, d):
    return fusion.reciprocal_ranks(fusion.weighted(tier_lists(spark, d), benchmark_queries(spark, d), S))


@query(f"WITH {LISTS}, {FUSED}, {MINMAX.format('rrf')} SELECT * FROM normed")
def minmax_norm(spark, d):
    return fusion.merge(tier_lists(spark, d), benchmark_queries(spark, d), S)


@query(f"""WITH {LISTS}, firsts AS (SELECT query_id, doc_id, CASE tier WHEN 'lexical' THEN -raw ELSE raw END AS fused FROM lists l
  WHERE tier = (SELECT min(m.tier) FROM lists m WHERE m.query_id = l.query_id)), {MINMAX.format('firsts')} SELECT * FROM normed""")
def ranker_none(spark, d):
    return fusion.merge(tier_lists(spark, d), benchmark_queries(spark, d), Settings(ranker="none"))


@query(f"WITH {LISTS} SELECT query_id, doc_id, max(raw) FILTER (tier = 'lexical') AS bm25, max(raw) FILTER (tier = 'vector') AS cosine FROM lists GROUP BY query_id, doc_id")
def evidence_map(spark, d):
    return fusion.evidence(tier_lists(spark, d)).select("query_id", "doc_id", F.try_element_at("tiers", F.lit("bm25")).alias("bm25"), F.try_element_at("tiers", F.lit("cosine")).alias("cosine"))


CANDIDATES = f"""{CORPUS}, {LISTS}, {FUSED}, {MINMAX.format('rrf')},
cands AS MATERIALIZED (SELECT n.query_id, q.query, n.doc_id, source AS path, text, fused AS score FROM normed n JOIN queries q USING (query_id) JOIN corpus0 USING (doc_id))"""
COHERENT = """coherent AS (SELECT query_id, query, doc_id, path, text, round(score + CASE WHEN best = 1 AND top > 0 AND most > 0 THEN top * 0.2 * file_sum / most ELSE 0 END, 6) AS score FROM (
  SELECT *, max(score) OVER (PARTITION BY query_id) AS top, max(file_sum) OVER (PARTITION BY query_id) AS most FROM (
    SELECT *, sum(score) OVER (PARTITION BY query_id, path) AS file_sum, row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC, doc_id) AS best FROM cands)))"""


#: Candidates (three numbers each) that are broadcast to the scan of the texts; more of them are joined by key.
BROADCAST_CANDIDATES = 1 << 20


def candidates(spark, d, path: str = "source") -> DataFrame:
    """Fused candidates of the benchmark queries with text; a document's file is its source, or its own path."""
    queries = benchmark_queries(spark, d)
    fused = fusion.merge(tier_lists(spark, d), queries, S)
    if 2 * S.candidate_depth * queries.count() <= BROADCAST_CANDIDATES:  # else the texts of all documents are dealt out for a few
        fused = F.broadcast(fused)
    rows = sources.documents(spark, d).select("doc_id", F.col(path).alias("path"), "text")
    return rows.join(fused, "doc_id").join(queries, "query_id").select("query_id", "query", "doc_id", "path", "text", F.col("fused").alias("score"))


@query(f"WITH {CANDIDATES}, {COHERENT} SELECT query_id, doc_id, score FROM coherent")
def coherence_boost(spark, d):
    return rerank.coherence(candidates(spark, d), S).select("query_id", "doc_id", "score")


@query(f"""WITH {CANDIDATES} SELECT query_id, doc_id, round(score * pow(0.5, in_file + CASE WHEN length(text) > 0 THEN same ELSE 0 END), 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC, doc_id) - 1 AS in_file, row_number() OVER (PARTITION BY query_id, text ORDER BY score DESC, doc_id) - 1 AS same FROM cands)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score * pow(0.5, in_file + CASE WHEN length(text) > 0 THEN same ELSE 0 END), 6) DESC, doc_id) <= 10""")
def saturation_topk(spark, d):
    return rerank.saturated(candidates(spark, d), S, 10).select("query_id", "doc_id", "score")


@query(f"WITH {CORPUS} SELECT path, round({PENALTY.format('path')}, 6) AS penalty FROM files")
def path_penalty(spark, d):
    return sources.documents(spark, d).select("path", F.round(fc.path_penalty(F.col("path")), 6).alias("penalty"))


def _single(spark, d, text: str) -> DataFrame:
    """Every document as a candidate of one query, scored by its id."""
    rows = sources.documents(spark, d)
    return rows.select(F.lit(0).alias("query_id"), F.lit(text).alias("query"), "doc_id", "path", "text", (1 / (1 + F.col("doc_id") % 7)).alias("score"))


_POOL = f"{CORPUS}, pool AS (SELECT doc_id, path, text, 1.0 / (1 + doc_id % 7) AS score, regexp_replace(lower(regexp_extract(path, '[^/]*$')), '(.)\\.[^.]*$', '\\1') AS stem FROM files)"


def _defined(name: str) -> str:
    words = "|".join(rerank.DEFINITION_WORDS)
    return f"regexp_matches(text, '(?m)(?:^|\\s)(?:{words})\\s+(?:[A-Za-z_][A-Za-z0-9_]*(?:\\.|::))*{name}(?:\\s|[<({{:\\[;]|$)')"


@query(f"WITH {_POOL} SELECT doc_id, round(score + CASE WHEN {_defined('The')} THEN 3.0 ELSE 0 END, 6) AS score FROM pool")
def definition_boost(spark, d):
    rows = _single(spark, d, "The").withColumn("text", F.concat(F.lit("def "), F.col("text")))
    return rerank.query_boosts(rows, S).select("doc_id", "score")


ORACLES["definition_boost"] = ORACLES["definition_boost"].replace("SELECT doc_id, path, text,", "SELECT doc_id, path, 'def ' || text AS text,")


@query(f"WITH {_POOL} SELECT doc_id, round(score + CASE WHEN {_defined('parseThat')} THEN 1.5 ELSE 0 END, 6) AS score FROM (SELECT doc_id, score, CASE WHEN doc_id % 5 = 0 THEN 'function parseThat(' || text ELSE text END AS text FROM pool)")
def embedded_boost(spark, d):
    rows = _single(spark, d, "where is parseThat used").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("function parseThat("), F.col("text"))).otherwise(F.col("text")))
    return rerank.query_boosts(rows, S).select("doc_id", "score")


@query(f"""WITH {_POOL}, parted AS (SELECT doc_id, score, stem, string_split(path, '/') AS segments FROM pool),
named AS (SELECT doc_id, score, list_concat([stem, segments[-2]], CASE WHEN len(a) >= 2 THEN a ELSE [] END, CASE WHEN len(b) >= 2 THEN b ELSE [] END) AS p
  FROM (SELECT *, list_filter(string_split(stem, '_'), lambda p: p <> '') AS a, list_filter(string_split(segments[-2], '_'), lambda p: p <> '') AS b FROM parted)),
matched AS (SELECT doc_id, score, len(list_filter(['document', 'tests', 'initial'], lambda w: len(list_filter(p, lambda x: x = w OR (length(x) >= 3 AND starts_with(w, x)) OR (length(w) >= 3 AND starts_with(x, w)))) > 0)) / 3.0 AS ratio FROM named)
SELECT doc_id, round(score + CASE WHEN ratio >= 0.1 THEN ratio ELSE 0 END, 6) AS score FROM matched""")
def stem_boost(spark, d):
    return rerank.query_boosts(_single(spark, d, "document tests initial"), S).select("doc_id", "score")


@query(f"""WITH {_POOL} SELECT doc_id, CAST(3.0 * CASE WHEN stem = 'doc_7' THEN 1.5 ELSE 1 END AS DOUBLE) AS score FROM pool WHERE contains(path, 'doc_7') AND doc_id % 2 = 1 AND doc_id >= 5""")
def non_candidate_inject(spark, d):
    rows = sources.documents(spark, d).withColumn("text", F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("class doc_7:\n"), F.col("text"))).otherwise(F.col("text")))
    few = rows.where("doc_id < 5").select(F.lit(0).alias("query_id"), F.lit("doc_7").alias("query"), "doc_id", "path", "text", F.lit(1.0).alias("score"))
    return rerank.injected(few, rows, S).select("doc_id", "score")


@query(f"""WITH {CORPUS}, {LISTS}, {FUSED}, {MINMAX.format('rrf')},
cands AS MATERIALIZED (SELECT n.query_id, q.query, n.doc_id, f.path, text, fused AS score FROM normed n JOIN queries q USING (query_id) JOIN files f USING (doc_id)), {COHERENT},
topped AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top, regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\\.[^.]*$', '\\1') AS stem, string_split(path, '/')[-2] AS parent,
  list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(query, '{ft.IDENTIFIER}'), lambda w: length(w) > 2), lambda w: lower(w)), lambda w: w NOT IN ({", ".join(f"'{w}'" for w in ft.STEM_STOP_WORDS)}))) AS words FROM coherent),
sided AS (SELECT *, list_transform([stem, parent], lambda s: CASE WHEN contains(s, '_') THEN list_filter(string_split(lower(s), '_'), lambda p: p <> '')
  ELSE list_transform(regexp_extract_all(s, '[A-Z]+|[A-Z]?[a-z]+|[0-9]+'), lambda p: lower(p)) END) AS cut FROM topped),
parted AS (SELECT *, list_concat([lower(stem), lower(parent)], CASE WHEN len(cut[1]) >= 2 THEN cut[1] ELSE [] END, CASE WHEN len(cut[2]) >= 2 THEN cut[2] ELSE [] END) AS p FROM sided),
boosted AS (SELECT query_id, doc_id, path, text, round(score + CASE WHEN top > 0 AND len(words) > 0 AND n >= 0.1 * len(words) THEN top * n / len(words) ELSE 0 END, 6) AS score FROM (
  SELECT *, len(list_filter(words, lambda w: len(list_filter(p, lambda x: x = w OR (length(x) >= 3 AND starts_with(w, x)) OR (length(w) >= 3 AND starts_with(x, w)))) > 0)) AS n FROM parted)),
weighed AS (SELECT query_id, doc_id, path, text, round(score * {PENALTY.format('path')}, 6) AS score FROM boosted),
faded AS (SELECT query_id, doc_id, round(score * pow(0.5, in_file + CASE WHEN length(text) > 0 THEN same ELSE 0 END), 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC, doc_id) - 1 AS in_file, row_number() OVER (PARTITION BY query_id, text ORDER BY score DESC, doc_id) - 1 AS same FROM weighed)),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM faded QUALIFY rank <= 10)
SELECT query_id, doc_id, rank, round(score / CASE max(score) OVER (PARTITION BY query_id) WHEN 0 THEN 1.0 ELSE max(score) OVER (PARTITION BY query_id) END, 6) AS score FROM best""")
def hybrid_search(spark, d):
    """Lexical and vector tiers of every benchmark question, fused, boosted, penalised and saturated to ten hits."""
    hits = rerank.rerank(candidates(spark, d, "path"), S, 10, sources.documents(spark, d))
    return hits.select("query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), "score")


# ---- maintenance ----
@query("""WITH now AS (SELECT doc_id, length(text) AS size FROM documents WHERE doc_id % 10 <> 3), before AS (SELECT doc_id, length(text) + CASE WHEN doc_id % 10 = 7 THEN 1 ELSE 0 END AS size FROM documents WHERE doc_id % 10 <> 5)
SELECT coalesce(n.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'deleted' ELSE 'changed' END AS change
FROM now n FULL JOIN before b ON n.doc_id = b.doc_id WHERE b.doc_id IS NULL OR n.doc_id IS NULL OR n.size <> b.size""")
def refresh_diff(spark, d):
    sized = table(spark, d, "documents").select("doc_id", F.length("text").alias("size"))
    before = sized.where("doc_id % 10 <> 5").select("doc_id", (F.col("size") + F.when(F.col("doc_id") % 10 == 7, 1).otherwise(0)).alias("size"))
    return maintenance.diff(sized.where("doc_id % 10 <> 3"), before, "doc_id", ["size"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_vectors(spark, d):
    return vectors.missing(table(spark, d, "documents").select("doc_id"), table(spark, d, "embeddings"), "doc_id", "vec_id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders")
def upsert_merge(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return maintenance.upsert(orders, orders.where("o_orderkey % 4 = 0").withColumn("o_orderstatus", F.lit("X")), ["o_orderkey"])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cascade_delete(spark, d):
    gone = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return maintenance.cascade(table(spark, d, "lineitem"), gone, "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber", "l_quantity")


# ---- evaluation ----


@query(f"""WITH {BENCHMARK}, {TOKENS}, {ASKED}, {BM25.format(where='')}, ranking AS ({TOP.format(10)}), rel AS (SELECT doc_id, quality AS rel FROM labels),
ideal AS (SELECT sum(rel / log2(k + 1)) AS idcg FROM (SELECT rel, row_number() OVER (ORDER BY rel DESC, doc_id) AS k FROM rel) WHERE k <= 10),
got AS (SELECT query_id, sum(rel / log2(rank + 1)) AS dcg, max(CASE WHEN rel > 0 THEN 1 ELSE 0 END) AS hit FROM ranking JOIN rel USING (doc_id) GROUP BY query_id)
SELECT q.query_id, round(coalesce(dcg, 0.0) / idcg, 6) AS ndcg, coalesce(hit, 0) AS hit FROM queries q CROSS JOIN ideal LEFT JOIN got USING (query_id) WHERE idcg > 0""")
def ndcg_eval(spark, d):
    queries = benchmark_queries(spark, d)
    ranking = lexical.bm25_top(table(spark, d, "documents"), queries, 10)
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").alias("rel"))
    return evaluation.ndcg(ranking, labels, 10, queries=queries)


@query("""WITH found AS (SELECT DISTINCT lang, doc_id FROM documents WHERE contains(text, 'idiot') OR contains(text, 'clown')), truth AS (SELECT DISTINCT lang, doc_id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1),
counts AS (SELECT lang, (SELECT count(*) FROM found f WHERE f.lang = l.lang) AS nf, (SELECT count(*) FROM truth t WHERE t.lang = l.lang) AS nt, (SELECT count(*) FROM found f JOIN truth t USING (lang, doc_id) WHERE f.lang = l.lang) AS nb
  FROM (SELECT lang FROM found UNION SELECT lang FROM truth) l), pr AS (SELECT lang, CASE WHEN nf > 0 THEN nb / nf ELSE 0.0 END AS p, CASE WHEN nt > 0 THEN nb / nt ELSE 0.0 END AS r FROM counts)
SELECT lang, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM pr""")
def precision_recall(spark, d):
    docs = table(spark, d, "documents")
    truth = docs.join(table(spark, d, "labels").where("toxic = 1"), "doc_id")
    return evaluation.precision_recall(docs.where(F.contains("text", F.lit("idiot")) | F.contains("text", F.lit("clown"))), truth, ["doc_id"], "lang")


@query(f"""WITH {SYMBOLS}, targets AS (SELECT path AS whole, regexp_extract(path, '[^/]*/[^/]*$') AS tail, 2 AS a, 4 AS b FROM files)
SELECT s.symbol_id, t.tail FROM symbols s JOIN targets t ON (s.path = t.tail OR ends_with(s.path, '/' || t.tail)) AND s.start_line <= t.b AND s.end_line >= t.a WHERE s.tag = 'def'""")
def span_overlap(spark, d):
    targets = sources.documents(spark, d).select(F.regexp_extract("path", "[^/]*/[^/]*$", 0).alias("tail"), F.lit(2).alias("a"), F.lit(4).alias("b"))
    symbols = line_symbols(spark, d).where("tag = 'def'")
    # any target's tail is a result path's last two segments: an equality for the join, the rest is residual
    here = F.regexp_extract(symbols["path"], "[^/]*/[^/]*$", 0) == targets["tail"]
    at = evaluation.covers(symbols["path"], F.col("start_line"), F.col("end_line"), targets["tail"], F.col("a"), F.col("b"))
    return symbols.join(targets, here & at).select("symbol_id", "tail")


# ---- extraction ----
SAMPLE = '''"""Sample."""
LIMIT = 10


class Store(Base):
    """Keeps rows."""

    def put(self, row: "Row") -> int:
        return self.backend.write(Codec.encode(row))


def outer(n: int):
    def inner():
        return helper(n)

    return inner() + LIMIT


outer(3)
'''


@query()
def extract_python(spark, d):
    """Symbols of every document as its path's language has them, and of a Python sample."""
    sample = spark.range(1).select(F.lit("pkg/sample.py").alias("path"), F.lit("python").alias("lang"), F.lit("code").alias("content_type"), F.lit(SAMPLE).alias("text"))
    return extract.extract(sources.documents(spark, d).select("path", "lang", "content_type", "text").unionByName(sample))


@query(
    "WITH languages(lang, defined, referred) AS (VALUES " + ", ".join(f"('{lang}', '{a}', '{b}')" for lang, (a, b) in extract.CAPABILITIES.items()) + """)
SELECT lang, defined <> '' AS definitions, referred AS reference_kinds, regexp_matches(referred, '\\b(call|send|method)\\b') AS calls FROM languages"""
)
def capabilities(spark, d):
    return extract.capability_table(spark).withColumn("reference_kinds", F.array_join("reference_kinds", " "))

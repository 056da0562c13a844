"""Benchmark decontamination by winnowing, in DataFrame functions.

Of each text every run of g consecutive words gives its minimal k-gram hash as a fingerprint (k is half of g, rounded up), so a
span of g words that two texts share gives both the same fingerprint. Fingerprints of the training texts are joined to those
of the windows of the test items; each hit is extended to the few words around it, whose windows are joined by their words
to the items' windows: a joined window is a match, and every shared window is found. Items shorter than GUARANTEE are a
window of their own length; lengths with the same k share the fingerprints of the least of them. All lengths are found in
one scan, and the texts themselves are never shuffled.

A fingerprint is a number that holds the first bits of the hash and the gram's place, so the least of a run names both.

Only distinct fingerprints and windows are joined, so a passage in many items or a word that repeats makes no pairs of
positions. The items' fingerprints are counted first: up to BROADCAST of them are broadcast, beyond that both sides are
shuffled (the words around each fingerprint then travel with it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_WORD, ascii_lower, bound, table, written

GUARANTEE = 10
#: Bits of a fingerprint for the place (texts are under 2 ** 28 words, by Spark's bound on a value), and their mask.
PLACE_BITS = 28
PLACE = (1 << PLACE_BITS) - 1
#: Fingerprints of items (16 bytes each) that may be broadcast.
BROADCAST = 1 << 20


def words(text: Column) -> Column:
    # a split between words takes a sixth of the time of extracting them; it leaves an empty string at an edge without a word
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NO_WORD), "")


def gram_size(guarantee: int) -> int:
    return (guarantee + 1) // 2


def indexes(size: Column) -> Column:
    """0 to size - 1; an empty array for no or negative size."""
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))


def fingerprints(hashes: Column, g: int) -> Column:
    """The distinct fingerprints of runs of g words, from the array of word hashes: the hash's first bits, then the place."""
    k = gram_size(g)
    width = g - k + 1
    gram = lambda i: F.get(hashes, i) if k == 1 else F.xxhash64(*[F.get(hashes, i + j) for j in range(k)])
    placed = F.transform(indexes(F.size(hashes) - (k - 1)), lambda i: gram(i).bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("bigint")))
    least = lambda all_: F.transform(indexes(F.size(all_) - (width - 1)), lambda i: F.least(*[F.get(all_, i + j) for j in range(width)]))
    return F.array_distinct(placed if width == 1 else bound(placed, least))


def value(fingerprint: Column) -> Column:
    return F.shiftright(fingerprint, PLACE_BITS)


def windows(items: DataFrame, guarantee: int = GUARANTEE) -> DataFrame:
    """Rows (item_id, size, window): each distinct window of an item, its words joined by blanks."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(guarantee))
    cut = F.transform(indexes(F.size("w") - size + 1), lambda i: F.array_join(F.slice(F.col("w"), i + 1, size), " "))
    return w.select("item_id", size.alias("size"), F.explode(cut).alias("window")).distinct()


def matches(docs: DataFrame, items: DataFrame, guarantee: int = GUARANTEE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, at, size, window) of every place where a window of an item stands in a text, and the windows."""
    item_windows = written(windows(items, guarantee), "item-windows")
    distinct = written(item_windows.select("size", "window").distinct(), "item-distinct")
    sizes = sorted(r["size"] for r in item_windows.select("size").distinct().collect())  # at most `guarantee` values
    classes = {k: [s for s in sizes if gram_size(s) == k] for k in {gram_size(s) for s in sizes}}
    if not classes:
        none = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), F.lit(0).alias("at"), F.lit(0).alias("size"), F.lit("").alias("window"))
        return none.limit(0), item_windows
    hashes = F.transform("w", lambda w: F.xxhash64(w))
    values = None
    for k, group in classes.items():
        mine = distinct.where(F.col("size").isin(group)).select(F.slice(F.split("window", " "), 1, min(group)).alias("w")).select(hashes.alias("hashes"))
        own = mine.select(F.lit(k).alias("k"), F.explode(fingerprints(F.col("hashes"), min(group))).alias("f")).select("k", value(F.col("f")).alias("value"))
        values = own if values is None else values.unionByName(own)
    values = written(values.distinct(), "item-values")
    few = values.count() <= BROADCAST
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), words(F.col("text")).alias("w"))
    found = keyed.select("doc_id", "text_key", "w", hashes.alias("hashes"))

    def tagged(k: int, group: list[int]) -> Column:
        return F.transform(fingerprints(F.col("hashes"), min(group)), lambda f: F.struct(F.lit(k).alias("k"), f.alias("f")))

    every = F.concat(*[tagged(k, group) for k, group in classes.items()])
    found = found.select("doc_id", "text_key", "w", F.inline(every))
    place = F.col("f").bitwiseAND(F.lit(PLACE)).cast("int")
    chosen = lambda of: F.coalesce(*[F.when(F.col("k") == k, F.lit(of(k, group))) for k, group in classes.items()])
    first = F.greatest(place - chosen(lambda k, group: min(group) - k), F.lit(0))
    context = F.slice("w", first + 1, place - first + chosen(lambda _, group: max(group)))
    around = lambda rows: rows.select("doc_id", "text_key", "k", "value", first.alias("first"), F.array_join(context, " ").alias("context"))
    found = found.withColumn("value", value(F.col("f")))
    hits = around(found.join(F.broadcast(values), ["k", "value"])) if few else around(found).join(values, ["k", "value"])
    near = hits.select("doc_id", "text_key", "first", F.split("context", " ").alias("c"), F.explode(chosen_sizes(classes)).alias("size"))
    cut = F.transform(indexes(F.size("c") - F.col("size") + 1), lambda i: F.struct((F.col("first") + i).alias("at"), F.array_join(F.slice(F.col("c"), i + 1, F.col("size")), " ").alias("window")))
    places = near.select("doc_id", "text_key", "size", F.inline(cut))
    return places.join(distinct, ["size", "window"]).select("doc_id", "text_key", "at", "size", "window").distinct(), item_windows


def chosen_sizes(classes: dict[int, list[int]]) -> Column:
    """The lengths of windows of the class k."""
    return F.coalesce(*[F.when(F.col("k") == k, F.array(*map(F.lit, group))) for k, group in classes.items()])


def contamination(docs: DataFrame, items: DataFrame, guarantee: int = GUARANTEE) -> DataFrame:
    """A row for each row of docs: doc_id, text_key, n_words, n_hit, item_ids (sorted as strings).

    n_hit counts the words inside a matched window. A null text has no words; items without words and null items match
    nothing; a null doc_id is an id; rows with one id and one text get the same result each. Without items nothing is hit.
    Other columns are ignored.
    """
    found, item_windows = matches(docs, items, guarantee)
    found = written(found, "matched")
    # words covered by windows in order of start: each adds what lies beyond the furthest end so far
    furthest = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda s, x: F.struct(F.greatest(s["end"], x["at"] + x["size"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["at"] + x["size"] - F.greatest(s["end"], x["at"]))).alias("n")),
    )
    hit = found.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("at", "size"))).alias("spans")).select("doc_id", "text_key", furthest["n"].alias("n_hit"))
    pairs = found.select("doc_id", "text_key", "size", "window").distinct().join(item_windows, ["size", "window"]).select("doc_id", "text_key", "item_id").distinct()
    listed = pairs.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("item_ids"))
    sides = hit.alias("a").join(listed.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_key") == F.col("b.text_key")))
    sides = written(sides.select(F.col("a.doc_id").alias("d"), F.col("a.text_key").alias("k"), "n_hit", "item_ids"), "contaminated")
    n_words = F.size(words(F.col("text"))).cast("bigint")
    every = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), n_words.alias("n_words"))
    return every.join(sides, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left").select(
        "doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids")
    )


def uncontaminated(docs: DataFrame, items: DataFrame, guarantee: int = GUARANTEE) -> DataFrame:
    """docs without the rows that share a window with an item; all columns and repeated rows stay as they are.

    Rows without words, and all rows if there are no items, stay. A row is told by its doc_id (a null is an id) and its text.
    """
    found = written(matches(docs, items, guarantee)[0].select("doc_id", "text_key").distinct(), "contaminated")
    hit = found.select(F.col("doc_id").alias("id of hit"), F.col("text_key").alias("text of hit"))
    same = docs["doc_id"].eqNullSafe(hit["id of hit"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == hit["text of hit"])
    return docs.join(hit, same, "left_anti")


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """contamination() of all documents against all benchmark items."""
    out = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP5_SQL = r"""
WITH items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
  FROM items, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(i) WHERE len(w) > 0
), texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), sizes AS (SELECT DISTINCT size FROM item_windows), windows AS (SELECT DISTINCT size, win FROM item_windows),
places AS (
  SELECT doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win
  FROM texts, sizes, unnest(range(1, greatest(len(w) - size + 2, 1))) AS u(i)
), found AS (SELECT p.doc_id, p.size, p.i, p.win FROM places p JOIN windows USING (size, win)),
hit AS (
  SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS x FROM found) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT f.doc_id, CAST(iw.item_id AS VARCHAR) AS id FROM found f JOIN item_windows iw USING (size, win)) GROUP BY doc_id
)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts t LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

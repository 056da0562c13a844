"""Secret scans in DataFrame functions: fixed patterns, and windows of high Shannon entropy in candidate strings.

Candidates are runs of credential characters outside the spans of the fixed patterns. A window of WINDOW characters slides over
each; the counts of its characters, packed into a few integers, change by one character that enters and one that leaves,
and with them the sum of c * log2(c). The entropy log2(W) - sum / W is held against the bound of the candidate's character
class (hexadecimal, letters and digits in one case, or all). Allow-listed candidates (identifiers, paths, repeats, words
without digits) are suppressed.

All steps take time in proportion to the text: offsets come from one split of the text by the pattern, whose pieces and
matches alternate, so starts are running sums of their lengths; parts of a text are cut out of pieces of it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, part, pieces, running, table

WINDOW = 20
#: Patterns of the base kinds, in the order in which kinds are listed, with least sizes.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS, ACCESS_SIZE = r"AKIA[A-Z0-9]+", 18
HEX, HEX_SIZE = r"[0-9a-f]+", 16
ASSIGN_SIZE = 12
KINDS = ("assign", "access", "hex", "entropy")
#: Characters of candidates, and the least entropy in bits of a window by class: hexadecimal, one case, all. Of random keys
#: of the least length, 20 characters, over 97 percent reach the bound of their class (tests/llm/test_secrets.py).
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW
BOUNDS = {"hex": 2.9, "one_case": 3.4, "all": 3.68}
#: Allow-list: candidates that match are no secrets.
ALLOWED = (
    r"^[^0-9]*$",  # no digit: words, paths, identifiers
    r"^[0-9_=+/-]+$",  # numbers and dates
    r"^[a-z]+[-_/][a-z][a-z/_-]*[-_/][a-z0-9]+$",  # slugs and paths
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # UUIDs
    r"^(.)\1+$",
    r"(?i)example|sample|placeholder|changeme|your[-_]",
)
SPAN = "struct<kind:int,start:bigint,stop:bigint,text:string>"
#: Characters of a candidate whose windows are counted together; counts of five bits, twelve in an integer.
CHUNK, BITS, PER = 4096, 5, 12
FIRST, LAST = ord("+"), ord("z")


def none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def places(text: Column, pattern: str, kind: int) -> Column:
    """Spans of all leftmost, non-overlapping matches, which must not be empty."""
    size = lambda x: F.length(x).cast("bigint")
    cut = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.transform(F.split(text, pattern, -1), size).alias("gaps"))

    def spans(v: Column) -> Column:
        gaps = F.slice(v["gaps"], F.lit(1), F.size(v["found"]))
        before = running(F.zip_with(gaps, v["found"], lambda g, m: g + size(m)), lambda a, b: a + b, F.lit(0).cast("bigint"))
        starts = F.zip_with(gaps, before, lambda g, b: g + b)
        return F.zip_with(starts, v["found"], lambda at, m: F.struct(F.lit(kind).alias("kind"), at.alias("start"), (at + size(m)).alias("stop"), m.alias("text"))).cast(f"array<{SPAN}>")

    return F.when(F.regexp_like(text, F.lit(pattern)), bound(cut, spans)).otherwise(none())


def class_bound(text: Column) -> Column:
    return (
        F.when(text.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$"), BOUNDS["hex"])
        .when(text.rlike(r"^(?:[0-9a-z+/_=-]+|[0-9A-Z+/_=-]+)$"), BOUNDS["one_case"])
        .otherwise(BOUNDS["all"])
    )


def top_entropy(text: Column, window: int = WINDOW) -> Column:
    """The highest entropy of a window, in bits, by counts that change by the entering and the leaving character."""
    overlapping = F.regexp_extract_all(text, F.lit(r"(?=([^\n]{1,%d}))[^\n]{1,%d}" % (CHUNK + window - 1, CHUNK)), F.lit(1))
    longest = F.array_max(F.transform(overlapping, lambda x: window_entropy(x, window)))
    return F.when(F.length(text) > CHUNK, longest).otherwise(window_entropy(text, window))


def window_entropy(text: Column, window: int) -> Column:
    """The highest entropy of a window of a text of some thousand characters."""
    gain = [0.0] + [c * math.log2(c) - ((c - 1) * math.log2(c - 1) if c > 1 else 0.0) for c in range(1, window + 1)]
    gains = F.array(*map(F.lit, gain))  # what the sum of c * log2(c) gains where a count becomes c
    codes = F.transform(F.split(text, ""), lambda x: F.ascii(x) - FIRST)
    place = lambda c, name: (F.floor(c / PER).cast("int").alias(f"{name}_word"), (F.pmod(c, F.lit(PER)) * BITS).alias(f"{name}_shift"))
    moves = bound(
        codes,
        lambda all_: F.zip_with(
            all_,
            F.slice(F.concat(F.array_repeat(F.lit(None).cast("int"), window), all_), F.lit(1), F.size(all_)),
            lambda enters, leaves: F.struct(*place(enters, "in"), *place(leaves, "out"), F.coalesce((enters == leaves).cast("int"), F.lit(0)).alias("same")),
        ),
    )
    counted = lambda counts, word, shift: F.coalesce(F.call_function("shiftright", F.get(counts, word), shift).bitwiseAND(F.lit(31)).cast("int"), F.lit(0))
    unit = lambda shift: F.call_function("shiftleft", F.lit(1).cast("bigint"), shift)

    def step(s: Column, x: Column) -> Column:
        lost = counted(s["counts"], x["out_word"], x["out_shift"])
        has = counted(s["counts"], x["in_word"], x["in_shift"]) - x["same"] + 1
        total = s["total"] - F.get(gains, lost) + F.get(gains, has)
        counts = F.transform(
            s["counts"], lambda c, i: c + F.when(i == x["in_word"], unit(x["in_shift"])).otherwise(F.lit(0).cast("bigint")) - F.when(i == x["out_word"], unit(x["out_shift"])).otherwise(F.lit(0).cast("bigint"))
        )
        low = F.when(s["n"] >= window - 1, F.least(s["low"], total)).otherwise(s["low"])
        return F.struct(counts.alias("counts"), total.alias("total"), low.alias("low"), (s["n"] + 1).alias("n"))

    zero = F.struct(F.array_repeat(F.lit(0).cast("bigint"), (LAST - FIRST) // PER + 1).alias("counts"), F.lit(0.0).alias("total"), F.lit(1e9).alias("low"), F.lit(0).alias("n"))
    return F.aggregate(moves, zero, step, lambda s: F.log2(F.lit(float(window))) - s["low"] / window)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns by start, then kind."""
    size = lambda s: s["stop"] - s["start"]
    assign = F.filter(places(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 2)) >= ASSIGN_SIZE)
    # a run too short fails however it is cut, so the least size can stand in the pattern
    access = places(text, r"AKIA[A-Z0-9]{%d,}" % (ACCESS_SIZE - 4), 1)
    hexes = places(text, r"[0-9a-f]{%d,}" % HEX_SIZE, 2)
    return ordered(F.concat(assign, F.filter(access, lambda s: size(s) >= ACCESS_SIZE), F.filter(hexes, lambda s: size(s) >= HEX_SIZE)))


def ordered(spans: Column) -> Column:
    """By start, then kind."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), s["text"].alias("text"))))
    return F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["text"].alias("text")))


def gaps(spans: Column, size: Column) -> Column:
    """(start, stop) of what lies between spans ordered by start, the last up to size; empty ones too."""
    ends = bound(F.transform(spans, lambda s: s["stop"]), lambda e: F.concat(running(e, F.greatest, F.lit(0).cast("bigint")), F.array(F.coalesce(F.array_max(e), F.lit(0).cast("bigint")))))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(size.cast("bigint")))
    return F.zip_with(ends, starts, lambda a, b: F.struct(a.alias("start"), F.greatest(a, b).alias("stop")))


def candidates(text: Column, base: Column) -> Column:
    """Runs of credential characters outside the base spans."""

    def outside(cut: Column) -> Column:
        free = F.filter(gaps(base, F.length(text)), lambda g: g["stop"] - g["start"] >= WINDOW)
        found = lambda g: F.transform(
            places(part(cut, g["start"], g["stop"]), CANDIDATE, 3),
            lambda s: F.struct(s["kind"].alias("kind"), (s["start"] + g["start"]).alias("start"), (s["stop"] + g["start"]).alias("stop"), s["text"].alias("text")),
        )
        return F.flatten(F.transform(free, found))

    inside = F.when(F.size(base) > 0, bound(pieces(text), outside)).otherwise(places(text, CANDIDATE, 3))
    return F.when(F.regexp_like(text, F.lit(CANDIDATE)), inside).otherwise(none())


def suspicious(candidate: Column) -> Column:
    """Whether a candidate string is on no allow-list and has a window of high entropy for its class."""
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | candidate.rlike(pattern)
    return F.when(allowed, F.lit(False)).otherwise(top_entropy(candidate) >= class_bound(candidate))


def scan(docs: DataFrame) -> DataFrame:
    """Adds base_spans and entropy_spans (arrays of kind, start, stop, text; code points, stop exclusive) to rows with a text.

    Spans are in order of start, then kind; entropy spans overlap no base span. A null text counts as empty and has none;
    repeated rows stay; an empty table stays empty. The result holds all columns of docs; those of the two names are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("base_spans", base_spans(text))
    return out.withColumn("entropy_spans", F.filter(candidates(text, F.col("base_spans")), lambda c: suspicious(c["text"])))


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of scan() in text replaced by a mark, spans that overlap by one; rows without spans, null texts
    and other columns stay as they are. Repeated rows stay; an empty table stays empty."""
    clashing = {c: f"kept {c}" for c in docs.columns if c in ("base_spans", "entropy_spans")}
    out = scan(docs.withColumnsRenamed(clashing)).withColumn("base_spans", ordered(F.concat("base_spans", "entropy_spans")))
    between = lambda cut: F.transform(gaps(F.col("base_spans"), F.length("text")), lambda g: F.struct(g["start"].alias("start"), part(cut, g["start"], g["stop"]).alias("text")))

    def joined(cut: Column) -> Column:
        # spans that touch or overlap leave an empty gap between them: one mark stands for those that overlap
        apart = lambda p, i: (i == 0) | (F.get("base_spans", i)["start"] >= p["start"]) | (F.get("base_spans", i).isNull())
        shown = bound(between(cut), lambda ps: F.filter(F.transform(ps, lambda p, i: F.when(apart(p, i), p["text"])), lambda x: x.isNotNull()))
        return F.array_join(shown, mark)

    out = out.withColumn("text", F.when(F.size("base_spans") > 0, bound(pieces(F.col("text")), joined)).otherwise(F.col("text"))).drop("base_spans", "entropy_spans")
    return out.withColumnsRenamed({v: k for k, v in clashing.items()}).select(*docs.columns)


def listed(spans: Column) -> Column:
    """kind:start:stop of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    """scan() of every whole text of documents: counts by kind, a digest of the base spans, and all spans."""
    scanned = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("bigint")
    return scanned.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"),
        listed(ordered(F.concat("base_spans", "entropy_spans"))).alias("spans"),
    )

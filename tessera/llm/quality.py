"""Quality rules by tokeniser fertility, beside plain counts.

Each word (a run without white space) is encoded as it stands after a blank, with a public byte-level vocabulary:
its tokens give characters per token and the entropy of a text's tokens. A public piece vocabulary with byte fallback
gives the share of bytes that it has no piece for. Bands per language, or per script where the language is unknown,
reject texts whose figures lie outside. Distinct words are encoded once for as long as a worker's table holds them.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import Words, batches_of, spread, words_of
from .common import table

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\r\x0b\x0c"
#: Words that a worker's table holds before it starts anew; characters of texts that are worked on at a time.
TABLE_WORDS, SPAN = 1_000_000, 1 << 22


@dataclass(frozen=True)
class Band:
    """Accepted figures: characters (words and a blank each) per token from low to high, at most `fallback` of the bytes, tokens' entropy from `bits`.

    A short text cannot reach many bits, so the bound is `share` of the logarithm of its tokens where that is less.
    """

    low: float
    high: float = 8.0
    fallback: float = 0.05
    bits: float = 5.3
    share: float = 0.8


#: Bands by language; then by script: (first code point, last, band), the first that holds most letters.
LANGUAGES = {"en": Band(2.35), "de": Band(2.1), "fr": Band(2.0), "es": Band(1.9)}
SCRIPTS = {
    "latin": (0x41, 0x24F, Band(1.6)),
    "greek": (0x370, 0x3FF, Band(0.4, fallback=0.9)),
    "cyrillic": (0x400, 0x52F, Band(0.4, fallback=0.9)),
    "hebrew": (0x590, 0x5FF, Band(0.3, fallback=1.0)),
    "arabic": (0x600, 0x6FF, Band(0.3, fallback=1.0)),
    "indic": (0x900, 0xDFF, Band(0.2, fallback=1.0)),
    "cjk": (0x3040, 0xD7A3, Band(0.2, fallback=1.0)),
}
OTHER = Band(0.2, fallback=1.0)


def band(lang: str | None, text: str) -> Band:
    if lang in LANGUAGES:
        return LANGUAGES[lang]
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    held = {name: int(((points >= a) & (points <= b)).sum()) for name, (a, b, _) in SCRIPTS.items()}
    held["latin"] -= int(((points > 0x5A) & (points < 0x61) | (points > 0x7A) & (points < 0xC0)).sum())
    name = max(held, key=held.get)
    return SCRIPTS[name][2] if held[name] else OTHER


class Fertility:
    """Tokens of words under both vocabularies."""

    def __init__(self, ranks: bytes, pieces: bytes, pattern: str):
        import sentencepiece
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        is_byte = [k for k in range(self.pieces.get_piece_size()) if self.pieces.is_byte(k)]
        self.bytes = frozenset(is_byte)
        every = self.pieces.encode("".join(map(chr, range(0x21, 0x7F))))
        self.ascii_whole = not self.bytes.intersection(every)  # then words of printable ASCII never fall back
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # hashes of the known words, sorted, and their numbers
        self.numbers = np.zeros(0, np.int64)
        self.tokens = np.zeros(1 << 16, np.int32)
        self.at = np.zeros(1, np.int64)  # of each word, the first of its tokens; then the end
        self.fallback = np.zeros(0, np.int64)

    def numbered(self, words: Words) -> np.ndarray:
        """The numbers of the words; unknown ones are encoded first."""
        keys, first, back = np.unique(words.hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > TABLE_WORDS:
            self.reset()
        place = np.searchsorted(self.keys, keys)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == keys[known]
        new = np.flatnonzero(~known)
        numbers = np.empty(len(keys), np.int64)
        numbers[known] = self.numbers[place[known]]
        numbers[new] = len(self.fallback) + np.arange(len(new))
        self.learn([words.bytes(first[k]).decode() for k in new])
        self.keys, self.numbers = np.insert(self.keys, place[new], keys[new]), np.insert(self.numbers, place[new], numbers[new])
        return numbers[back]

    def learn(self, words: list[str]) -> None:
        if not words:
            return
        ids = [self.encode(" " + w) for w in words]
        ends = self.at[-1] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        if ends[-1] > len(self.tokens):
            self.tokens = np.resize(self.tokens, int(2 * ends[-1]))
        self.tokens[self.at[-1] : ends[-1]] = [i for x in ids for i in x]
        self.at = np.append(self.at, ends)
        lost = np.zeros(len(words), np.int64)
        odd = [k for k, w in enumerate(words) if not (self.ascii_whole and w.isascii() and w.isprintable())]
        for k, got in zip(odd, self.pieces.encode([words[k] for k in odd], num_threads=1) if odd else (), strict=True):
            lost[k] = sum(i in self.bytes for i in got)
        self.fallback = np.append(self.fallback, lost)


_LOADED: dict[str, Fertility] = {}


def loaded(ranks: bytes, pieces: bytes, pattern: str) -> Fertility:
    """One table of words for each pair of vocabularies and Python worker."""
    key = hashlib.sha256(ranks + pieces + pattern.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Fertility(ranks, pieces, pattern)
    return _LOADED[key]


def repeated(numbers: np.ndarray, window: int = 3) -> int:
    """Words inside windows of so many words that occur twice or more."""
    n = len(numbers) - window + 1
    if n < 2:
        return 0
    keys, range_ = numbers[:n], int(numbers.max()) + 1
    for k in range(1, window):
        if int(keys.max()) >= 2**62 // range_:
            keys = np.unique(keys, return_inverse=True)[1].astype(np.int64)
        keys = keys * range_ + numbers[k : n + k]
    _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
    twice = counts[back] > 1
    inside = np.zeros(len(numbers), bool)
    for k in range(window):
        inside[k : n + k] |= twice
    return int(inside.sum())


def figures(text: str, numbers: np.ndarray, known: Fertility) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars_per_token, fallback_share, token_entropy, n_tokens."""
    word_chars = len(text) - sum(map(text.count, BLANKS))
    lines = Counter(text.split("\n"))
    duplicates = sum(c - 1 for line, c in lines.items() if c > 1 and line.strip(BLANKS))
    plain = (len(numbers), word_chars, sum(map(text.count, SYMBOLS)), duplicates)
    if not len(numbers):
        return *plain, 0, 0.0, 0.0, 0.0, 0
    words, back, counts = np.unique(numbers, return_inverse=True, return_counts=True)
    sizes = known.at[words + 1] - known.at[words]
    tokens = spread(known.tokens, known.at[words], sizes)
    _, which = np.unique(tokens, return_inverse=True)
    share = np.bincount(which, np.repeat(counts, sizes))
    n_tokens = int((sizes * counts).sum())
    share = share / n_tokens
    n_bytes = len(text.encode()) - (len(text) - word_chars)
    return *plain, repeated(back.astype(np.int64)), (word_chars + len(numbers)) / n_tokens, float((known.fallback[words] * counts).sum() / n_bytes), float(abs(-(share * np.log2(share)).sum())), n_tokens


def judge(docs: DataFrame, ranks_path: str, pieces_path: str, pattern: str, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """Rows (doc_id, text, lang) to their counts, fertility figures, base_failed and kept, a row for each row.

    base_failed: fewer than least_words words, or over most_repeated percent of the words repeat in 3-word windows.
    kept: not base_failed and inside the Band of the language, or of the text's script if lang is null or unknown.
    A null text counts as empty: no words, base_failed, figures 0. Repeated rows stay; other columns are ignored.
    The vocabulary files (fixed sizes) are read by the driver and broadcast.
    """
    with open(ranks_path, "rb") as a, open(pieces_path, "rb") as b:
        shipped = docs.sparkSession.sparkContext.broadcast((a.read(), b.read(), pattern))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_per_token", "fallback_share", "token_entropy"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = loaded(*shipped.value)
        for batch in batches:
            texts, langs, out = [x or "" for x in batch.column(1).to_pylist()], batch.column(2).to_pylist(), []
            for at, end in batches_of(texts, SPAN):
                words = words_of(texts[at:end])
                numbers = known.numbered(words)
                for k, (text, lang) in enumerate(zip(texts[at:end], langs[at:end], strict=True)):
                    *plain, repeats, chars, lost, bits, tokens = figures(text, numbers[words.bounds[k] : words.bounds[k + 1]], known)
                    failed = plain[0] < least_words or 100 * repeats > most_repeated * plain[0]
                    b = None if failed else band(lang, text)
                    kept = not failed and b.low <= chars <= b.high and lost <= b.fallback and bits >= min(b.bits, b.share * np.log2(max(tokens, 2)))
                    out.append((*plain, repeats, failed, bool(kept), chars, lost, bits))
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names[1:]]
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    kinds = ["bigint"] * 5 + ["boolean"] * 2 + ["double"] * 3
    return docs.select("doc_id", "text", "lang").mapInArrow(run, f"doc_id {id_type}, " + ", ".join(f"{n} {k}" for n, k in zip(names[1:], kinds, strict=True)))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """judge() of every whole text of documents, with the public vocabularies."""
    import public_tokenizers as public

    return judge(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.tiktoken"), public.path("piece_bpe_32k.model"), public.PATTERN)

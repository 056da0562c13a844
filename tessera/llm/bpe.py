"""Byte-level BPE as a bounded-lookahead streaming transducer, and its inverse as a byte-to-text machine.

Encoding. Text arrives in slices. A pre-token (the vocabulary's splitting pattern) is closed once the pattern
can no longer change its end. Inside a pre-token, merges run over a buffer; a token is emitted once it ends at
least ``lookahead`` bytes before the end of the buffer. ``lookahead`` follows from the merge list alone: unseen
bytes can change whether a merge (u, v) happens only through its right operand; the change then reaches the
token at its left only through a merge of lower priority whose right operand starts where u starts. The longest
chain of such merges, each counted with the bytes of its left operand, and one token more bound how far unseen text reaches to
the left. What follows an emitted boundary is encoded alone, as no merge crosses it. Memory is constant: one slice or block
and one buffer of twice the lookahead; digests and the check by decoding take each part as it comes.

Short pre-tokens that are closed need no lookahead: those of a block (many short texts, or a slice of a long one)
are split by character classes and merged side by side in arrays, each distinct pre-token once. Pre-tokens are told
apart there by 64-bit hashes; the round trip through the decoder finds a collision, and such a text is encoded
again by the stream.

Decoding. Ids become bytes by table; an incremental UTF-8 machine holds at most three bytes between slices and
puts U+FFFD for each maximal invalid part.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import spread

#: The splitting pattern of byte-level BPE vocabularies of this family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a slice of the stream, and of a block at most; bytes of a pre-token that is merged in arrays.
SLICE, BLOCK, SHORT = 1 << 16, 1 << 19, 48
LETTER, NUMBER, SPACE, OTHER, SEAM = range(5)
NEVER = np.int32(2**31 - 1)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in for each byte in vocabulary files: itself if printable, else from U+0100 upward."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def character_classes() -> np.ndarray:
    """The pattern's class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    table[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return table


class Transducer:
    """Encoder and decoder of one vocabulary; holds no state between texts."""

    def __init__(self, vocabulary: str):
        import regex

        spec = json.loads(vocabulary)
        stand_in = byte_alphabet()
        raw = lambda token: bytes(stand_in[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = raw(token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = [0] * 256
        for token, i in vocab.items():
            if len(b := self.bytes_of[i]) == 1:
                self.byte_id[b[0]] = i
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            u, v = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((vocab[u], vocab[v]), (rank, vocab[u + v]))
        self.longest = max(map(len, self.bytes_of))
        self.lookahead = self.chain() + self.longest
        self.pattern = regex.compile(PATTERN)
        self.splitter = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.classes = character_classes()
        self.byte_ids = np.array(self.byte_id, np.int32)
        self.weights = np.random.default_rng(7).integers(1, 2**63, SHORT + 1, np.uint64) | np.uint64(1)
        self.made = np.array([made for _, made in sorted(self.merges.values())], np.int32)
        self.slots, self.slot_rank, self.probes = self.slotted()

    def slotted(self) -> tuple[np.ndarray, np.ndarray, int]:
        """An open-addressing table from pairs of ids to ranks, for lookups in arrays."""
        bits = max(10, len(self.merges).bit_length() + 4)
        keys, ranks, probes = np.full((1 << bits) + 64, -1, np.int64), np.full((1 << bits) + 64, NEVER, np.int32), 1
        self.shift = np.uint64(64 - bits)
        order = sorted(self.merges.items(), key=lambda x: x[1][0])
        pairs = np.array([u << 32 | v for (u, v), _ in order], np.int64)
        for rank, (key, slot) in enumerate(zip(pairs.tolist(), self.slot_of(pairs).tolist(), strict=True)):
            k = 0
            while keys[slot + k] >= 0:
                k += 1
            keys[slot + k], ranks[slot + k], probes = key, rank, max(probes, k + 1)
        return keys, ranks, probes

    def slot_of(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks_of(self, pairs: np.ndarray) -> np.ndarray:
        slot = self.slot_of(pairs)
        out = np.where(self.slots[slot] == pairs, self.slot_rank[slot], NEVER)
        for k in range(1, self.probes):
            out = np.where(self.slots[slot + k] == pairs, self.slot_rank[slot + k], out)
        return out

    def merged_together(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """merged() of many short sequences, laid end to end, side by side; their ids and lengths after it."""
        if not len(lengths):
            return ids, lengths
        done_ids, done_lengths, done_numbers = [], [], []
        numbers = np.arange(len(lengths))
        while len(lengths):
            starts = np.cumsum(lengths) - lengths
            pairs = np.full(len(ids), -1, np.int64)
            pairs[:-1] = ids[:-1].astype(np.int64) << 32 | ids[1:]
            pairs[starts[1:] - 1] = -1
            ranks = self.ranks_of(pairs)
            ranks[pairs < 0] = NEVER
            best = np.minimum.reduceat(ranks, starts)
            live = best != NEVER
            if not live.all():
                done = np.repeat(~live, lengths)
                done_ids.append(ids[done])
                done_lengths.append(lengths[~live])
                done_numbers.append(numbers[~live])
                ids, ranks = ids[~done], ranks[~done]
                lengths, numbers, best = lengths[live], numbers[live], best[live]
                if not len(lengths):
                    break
            owner = np.repeat(np.arange(len(lengths)), lengths)
            hits = np.flatnonzero(ranks == best[owner])
            hits = hits[np.flatnonzero(np.diff(owner[hits], prepend=-1))]  # the leftmost of each sequence
            ids[hits] = self.made[best]
            ids = np.delete(ids, hits + 1)
            lengths = lengths - 1
        numbers, lengths, ids = (np.concatenate(x) for x in (done_numbers, done_lengths, done_ids))
        order = np.argsort(numbers)
        starts = (np.cumsum(lengths) - lengths)[order]
        return spread(ids, starts, lengths[order]), lengths[order]

    def encode_block(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of texts without special tokens, each a whole text or cut where a pre-token ends."""
        text = "\0".join(pieces)
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begins = np.cumsum(size + 1) - size - 1
        seams = begins[1:] - 1
        n = len(points)
        if not n:
            return [b""] * len(pieces)
        kind = self.classes[points]
        kind[seams] = SEAM
        start = np.empty(n + 1, bool)
        start[0] = start[n] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:n])
        start[seams], start[seams + 1] = True, True
        # the last character of white space before a word is apart from the rest; a blank belongs to the word
        words = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != SEAM)) + 1
        start[words - 1] = True
        start[words] = points[words - 1] != 0x20
        quotes = np.flatnonzero((points == 0x27) & start[:n])
        padded = np.concatenate([points, np.zeros(2, np.uint32)])
        one, two = padded[quotes + 1], padded[np.minimum(quotes + 2, n + 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ~short & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        start[quotes[short | long] + 1] = False
        start[quotes[short] + 2] = True
        start[quotes[long] + 3] = True
        at = np.flatnonzero(start)
        at, ends = at[:-1], at[1:]
        real = kind[at] != SEAM
        at, ends = at[real], ends[real]
        if not len(at):
            return [b""] * len(pieces)
        raw = np.frombuffer(text.encode(), np.uint8)
        if len(raw) != n:
            offset = np.zeros(n + 1, np.int64)
            np.cumsum(1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000), out=offset[1:])
            byte_at, byte_end = offset[at], offset[ends]
        else:
            byte_at, byte_end = at, ends
        length = byte_end - byte_at
        far = length > SHORT
        inside = np.arange(len(raw)) - np.repeat(byte_at, np.diff(byte_at, append=len(raw)))  # starts at the first token
        hashes = self.weights[np.minimum(inside, SHORT)] * (raw.astype(np.uint64) + np.uint64(1))
        ends_early = np.repeat(byte_end, np.diff(byte_at, append=len(raw)))
        hashes[np.arange(len(raw)) >= ends_early] = 0  # seams
        keys = np.add.reduceat(hashes, byte_at) ^ (length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        keys[far] = np.arange(far.sum(), dtype=np.uint64)  # long ones go through the stream
        _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        near = ~far[first]
        counts = np.zeros(len(first), np.int64)
        short_ids, counts[near] = self.merged_together(self.byte_ids[spread(raw, byte_at[first[near]], length[first[near]])], length[first[near]])
        chunks = [short_ids]
        where = np.zeros(len(first), np.int64)
        where[near] = np.cumsum(counts[near]) - counts[near]
        total = len(short_ids)
        for k in np.flatnonzero(~near):
            token = raw[byte_at[first[k]] : byte_end[first[k]]].tobytes()
            rest = [i for ids in self.streamed(token[j : j + SLICE] for j in range(0, len(token), SLICE)) for i in ids]
            chunks.append(np.array(rest, np.int32))
            where[k], counts[k] = total, len(rest)
            total += len(rest)
        flat = np.concatenate(chunks)
        counts = counts[inverse]
        out = spread(flat, where[inverse], counts).astype("<u4")
        bounds = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(at, np.append(begins, n + 1))]
        return [out[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def chain(self) -> int:
        """The most bytes that a chain of merges spans through which unseen text can act to the left (see the module's text)."""
        starts: dict[int, set[int]] = {}  # token -> tokens its derivations start with
        longest_by_left: dict[int, int] = {}
        longest = 1
        for (u, v), (_, made) in sorted(self.merges.items(), key=lambda x: x[1][0]):
            reach = len(self.bytes_of[u]) + max((longest_by_left.get(x, 0) for x in (v, *starts.get(v, ()))), default=0)
            longest = max(longest, reach)
            longest_by_left[u] = max(longest_by_left.get(u, 0), reach)
            starts.setdefault(made, set()).update({u}, starts.get(u, ()))
        return longest

    def merged(self, ids: list[int]) -> list[int]:
        """Applies the merges in order of rank, leftmost first, to the end."""
        merges, n = self.merges, len(ids)
        if n < 2:
            return ids
        if n <= 24:
            ids = list(ids)
            while len(ids) > 1:
                found = [(m[0], k, m[1]) for k, pair in enumerate(zip(ids, ids[1:], strict=False)) if (m := merges.get(pair))]
                if not found:
                    break
                _, k, made = min(found)
                ids[k : k + 2] = [made]
            return ids
        ids, left, right = list(ids), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(m[0], k, m[1], ids[k], ids[k + 1]) for k in range(n - 1) if (m := merges.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, made, u, v = heapq.heappop(heap)
            r = right[k]
            if ids[k] != u or r >= n or ids[r] != v:
                continue
            ids[k], ids[r] = made, -1
            right[k] = right[r]
            if right[k] < n:
                left[right[k]] = k
                if m := merges.get((made, ids[right[k]])):
                    heapq.heappush(heap, (m[0], k, m[1], made, ids[right[k]]))
            if left[k] >= 0 and (m := merges.get((ids[left[k]], made))):
                heapq.heappush(heap, (m[0], left[k], m[1], ids[left[k]], made))
        return [x for x in ids if x >= 0]

    def streamed(self, parts: Iterable[bytes]) -> Iterator[list[int]]:
        """Encodes one pre-token that arrives in parts; emits ids once stable."""
        buffer = b""
        for part in parts:
            buffer += part
            while len(buffer) >= 2 * self.lookahead:
                end, stable, ids = len(buffer) - self.lookahead, 0, []
                for i in self.merged([self.byte_id[b] for b in buffer]):
                    if stable + len(self.bytes_of[i]) > end:
                        break
                    stable += len(self.bytes_of[i])
                    ids.append(i)
                if not ids:
                    break
                buffer = buffer[stable:]
                yield ids
        yield self.merged([self.byte_id[b] for b in buffer])

    def packed(self, token: str) -> bytes:
        """Ids of one closed pre-token as little-endian 32-bit integers."""
        data = token.encode()
        return b"".join(pack(ids) for ids in self.streamed(data[k : k + SLICE] for k in range(0, len(data), SLICE)))

    def encode_plain(self, slices: Iterable[str]) -> Iterator[bytes]:
        """Packed ids of a text without special tokens that arrives in slices."""
        carry = ""
        for piece in slices:
            carry += piece
            if len(carry) > 2 * SLICE:  # a pre-token longer than a slice: its run goes on as a stream
                for out in self.long_run(carry):
                    if isinstance(out, str):
                        carry = out
                    else:
                        yield out
                continue
            tokens = self.pattern.findall(carry)
            keep = 0  # what more text could still change: the matches over the last four characters and the one before
            while tokens and keep < 4:
                keep += len(tokens.pop())
            if tokens:
                keep += len(tokens.pop())
            yield b"".join([self.packed(t) for t in tokens])
            carry = carry[len(carry) - keep :]
        yield b"".join([self.packed(t) for t in self.pattern.findall(carry)])

    def long_run(self, carry: str) -> Iterator[bytes | str]:
        """Takes the closed pre-tokens off a long carry; yields packed ids and last the rest.

        If the first pre-token is itself longer than a slice, all of it but the end is of one class, so it is
        encoded as a stream up to a stable boundary; the rest follows as text that starts inside that class.
        """
        head = self.pattern.match(carry)
        if head.end() < len(carry) - 4:
            yield self.packed(head.group())
            yield carry[head.end() :]
            return
        run = head.group().encode()
        end, stable, ids = len(run) - max(self.lookahead, 16), 0, []
        for i in self.merged([self.byte_id[b] for b in run]):
            if stable + len(self.bytes_of[i]) > end:
                break
            stable += len(self.bytes_of[i])
            ids.append(i)
        text_cut = len(run[:stable].decode(errors="ignore"))
        while ids and len(carry[:text_cut].encode()) != stable:  # back to a boundary of characters
            stable -= len(self.bytes_of[ids.pop()])
            text_cut = len(run[:stable].decode(errors="ignore"))
        yield pack(ids)
        yield carry[text_cut:]

    def encode(self, text: str) -> Iterator[bytes]:
        """Packed ids of a whole text by the stream alone; strings of special tokens give their ids."""
        for piece, special in self.parted(text):
            if special:
                yield pack([self.special[piece]])
            else:
                yield from self.encode_plain(piece[k : k + SLICE] for k in range(0, len(piece), SLICE))

    def parted(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text between strings of special tokens, and those."""
        at = 0
        for found in self.splitter.finditer(text) if self.splitter else ():
            if found.start() > at:
                yield text[at : found.start()], False
            yield found.group(), True
            at = found.end()
        if at < len(text):
            yield text[at:] if at else text, False

    def cut(self, text: str) -> Iterator[str]:
        """Slices of at most BLOCK characters, each cut before white space after a word, where a pre-token ends."""
        at = 0
        while len(text) - at > BLOCK:
            kind = self.classes[np.frombuffer(text[at : at + BLOCK].encode("utf-32-le"), "<u4")]
            ends = np.flatnonzero((kind[:-1] != SPACE) & (kind[1:] == SPACE))
            if not len(ends):
                break
            yield text[at : at + int(ends[-1]) + 1]
            at += int(ends[-1]) + 1
        yield text[at:]

    def encode_many(self, texts: Iterable[str]) -> Iterator[Iterable[bytes]]:
        """Packed ids of each text in parts: short texts together in blocks, a long one part by part as it is asked for."""
        short: list[str] = []
        held = 0
        for text in texts:
            if len(text) > BLOCK or held + len(text) > BLOCK:
                yield from self.encode_short(short)
                short, held = [], 0
            if len(text) > BLOCK:
                yield self.encode_long(text)
            else:
                short.append(text)
                held += len(text)
        yield from self.encode_short(short)

    def encode_short(self, texts: list[str]) -> list[list[bytes]]:
        """Packed ids of each of some texts of a block in all."""
        pieces, owners, parts = [], [], []
        for text in texts:
            mine: list[list[bytes]] = []
            for piece, special in self.parted(text):
                mine.append([pack([self.special[piece]])] if special else [b""])
                if not special:
                    pieces.append(piece)
                    owners.append(mine[-1])
            parts.append(mine)
        for owner, ids in zip(owners, self.encode_block(pieces) if pieces else (), strict=True):
            owner[0] = ids
        return [[x[0] for x in each] for each in parts]

    def encode_long(self, text: str) -> Iterator[bytes]:
        """Packed ids of a text over a block: closed pre-tokens a block at a time, one unbroken run as a stream."""
        for piece, special in self.parted(text):
            if special:
                yield pack([self.special[piece]])
                continue
            for block in self.cut(piece):
                if len(block) > BLOCK:
                    yield from self.encode_plain(block[k : k + SLICE] for k in range(0, len(block), SLICE))
                else:
                    yield from self.encode_block([block])

    def decode(self, packed: Iterable[bytes]) -> Iterator[str]:
        """Text of packed ids, slice by slice."""
        machine, bytes_of = codecs.getincrementaldecoder("utf-8")("replace"), self.bytes_of
        for part in packed:
            yield machine.decode(b"".join([bytes_of[i] for i in memoryview(part).cast("I")]))
        yield machine.decode(b"", final=True)


def pack(ids: list[int]) -> bytes:
    return b"".join([i.to_bytes(4, "little") for i in ids])


_LOADED: dict[str, Transducer] = {}


def loaded(vocabulary: str) -> Transducer:
    """One transducer for each vocabulary and Python worker."""
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Transducer(vocabulary)
    return _LOADED[key]


def encode_documents(docs: DataFrame, vocabulary_path: str, keep_ids: bool = True, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_tokens, ids_sha256, decoded_sha256, and ids (binary, uint32 little-endian) if kept.

    A null text counts as empty: no tokens, the digests of nothing. Repeated rows and ids give a row each; other columns
    of docs are ignored whatever their names. The vocabulary file (fixed size) is read by the driver and broadcast.
    """
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as file:
        shipped = spark.sparkContext.broadcast(file.read())
    id_type = docs.schema[id_column].dataType.simpleString()

    def digested(machine: Transducer, text: str, parts: Iterable[bytes]) -> tuple[int, str, str, bytes] | None:
        """(n_tokens, digests of ids and of their text, ids), or None if that text is another; holds a part at a time."""
        sha, read, kept, n, at = hashlib.sha256(), hashlib.sha256(), [], 0, 0

        def seen() -> Iterator[bytes]:
            nonlocal n
            for part in parts:
                n += len(part) >> 2
                sha.update(part)
                if keep_ids:
                    kept.append(part)
                yield part

        for back in machine.decode(seen()):
            if not text.startswith(back, at):
                return None
            at += len(back)
            read.update(back.encode())
        return (n, sha.hexdigest(), read.hexdigest(), b"".join(kept)) if at == len(text) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = loaded(shipped.value)
        for batch in batches:
            counts, digests, decoded, kept = [], [], [], []
            texts = [x.as_py() or "" for x in batch.column(1)]
            for text, parts in zip(texts, machine.encode_many(texts), strict=True):
                # None is a collision of hashes
                n, sha, read, ids = digested(machine, text, parts) or digested(machine, text, machine.encode(text))
                counts.append(n)
                digests.append(sha)
                decoded.append(read)
                kept.append(ids)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    out = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_column)


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    """The contract's digests of every whole text of documents, from encode_documents()."""
    import public_tokenizers

    from .common import table

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)

"""Byte-level BPE as a streaming transducer.

``Transducer`` reads the bytes of one pre-token in pieces of any size and hands out token ids as soon as no
later byte can change them.  How many bytes have to be seen beyond a token is a constant of the merge list: a
merge (a, b) can only be prevented from the right by an earlier merge (c, d) whose left part c ends the part b,
so the longest chain of falling ranks, each link adding the length of its right part, bounds the influence.
Ordinary words are shorter than the window and pass in one step; a run of a million letters is encoded in the
memory of one window.

Texts are read in slices that end where a pre-token certainly ends, so a very long text is never held as a list of
words.  The short words of many slices that were not met before are merged together, as the rows of a matrix that loses a
column with each merge.

Defined results: null text is treated as empty (no ids, empty decoded text); equal texts give equal ids; ids
outside the vocabulary decode to nothing; bytes that are not UTF-8 decode to U+FFFD, one for each maximal
ill-formed part; other columns pass through, except an existing column with the output's name, which is replaced.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import json
import re
import struct
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import without

#: Words whose ids a worker remembers, in two generations: when the younger one is full, it becomes the older one.
MEMO_WORDS = 400_000
#: Characters of a word that is remembered, at most, and widths in bytes to which such words are filled up.
SHORT, WIDTHS = 64, (6, 9, 13, 20, 48, 256)
#: Characters of a slice of text, on average, and words that are looked up together.
SLICE, WORDS = 1 << 16, 1 << 18
#: Rows that a task hands back at once.
ROWS = 256
#: The split pattern of byte-level BPE with ``use_regex``.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class Model:
    """Vocabulary and merges of a tokenizer file, in bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        raw = lambda s: bytes(to_byte[c] for c in s)
        vocab = {raw(k): v for k, v in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {v: k for k, v in vocab.items()} | {v: k.encode() for k, v in self.special.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        pairs = [(raw(a), raw(b)) for a, b in merges]
        #: (left id, right id) -> (rank, merged id)
        self.ranks = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.of_byte = [vocab.get(bytes([b])) for b in range(256)]
        self.lookahead = sufficient_lookahead(pairs)
        self.longest = max(map(len, vocab))
        self.split = regex.compile(PATTERN)
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None


def sufficient_lookahead(pairs: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a token that decide whether it stays, for merges in rank order."""
    made: dict[bytes, tuple[bytes, bytes]] = {}
    reach: dict[bytes, int] = {}  # by the left part of the merges so far
    most = 0
    for left, right in pairs:
        far, part = 0, right
        while True:
            far = max(far, reach.get(part, 0))
            if part not in made:
                break
            part = made[part][1]
        far += len(right)
        reach[left] = max(reach.get(left, 0), far)
        most = max(most, far)
        made.setdefault(left + right, (left, right))
    return most


def merge_short(parts: list[int], ranks: dict) -> list[int]:
    """Apply the merges to a few symbols, lowest rank first, then leftmost."""
    while len(parts) > 1:
        best, at = None, -1
        left = parts[0]
        for i in range(1, len(parts)):
            right = parts[i]
            found = ranks.get((left, right))
            if found is not None and (best is None or found[0] < best[0]):
                best, at = found, i
            left = right
        if best is None:
            break
        parts[at - 1 : at + 1] = [best[1]]
    return parts


def merge_long(parts: list[int], ranks: dict) -> list[int]:
    """The same for many symbols, with a heap over a linked list."""
    n = len(parts)
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(found[0], i, parts[i], parts[i + 1]) for i in range(n - 1) if (found := ranks.get((parts[i], parts[i + 1])))]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = following[i]
        if parts[i] != a or j >= n or parts[j] != b:
            continue
        parts[i], parts[j] = ranks[a, b][1], -1
        following[i] = k = following[j]
        if k < n:
            before[k] = i
            if found := ranks.get((parts[i], parts[k])):
                heapq.heappush(heap, (found[0], i, parts[i], parts[k]))
        if (h := before[i]) >= 0 and (found := ranks.get((parts[h], parts[i]))):
            heapq.heappush(heap, (found[0], h, parts[h], parts[i]))
    return [p for p in parts if p >= 0]


class Transducer:
    """Bytes of one pre-token in, ids out once they are stable."""

    def __init__(self, model: Model):
        self.model = model
        self.window = 4 * (model.lookahead + model.longest)
        self.held = b""

    def _ids(self, data: bytes) -> list[int]:
        symbols = [self.model.of_byte[b] for b in data]
        return (merge_short if len(symbols) <= 32 else merge_long)(symbols, self.model.ranks)

    def feed(self, data: bytes) -> Iterator[int]:
        """Ids that no later byte can change; at most a window of bytes stays behind."""
        view = memoryview(data)
        while len(view):
            room = self.window - len(self.held)
            self.held += bytes(view[:room])
            view = view[room:]
            if len(self.held) < self.window:
                return
            done = 0
            for token in self._ids(self.held):
                end = done + len(self.model.bytes_of[token])
                if end + self.model.lookahead > len(self.held):
                    break
                done = end
                yield token
            self.held = self.held[done:]

    def finish(self) -> list[int]:
        held, self.held = self.held, b""
        return self._ids(held) if held else []


def merge_many(words: np.ndarray, keys: np.ndarray, ranks: np.ndarray, made: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for many words, given as rows of symbols filled up with -1: (places, rows of ids) of those that are done.

    keys: left << 32 | right in order, with the rank of that merge and the id it makes.
    """
    none = len(keys)

    def ranked(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place in ``keys`` by rank, ``none`` where the two do not merge."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(keys, key), none - 1)
        return np.where(keys[at] == key, ranks[at], none)

    by_rank = np.empty(none + 1, np.int64)
    by_rank[ranks] = made
    places, symbols = np.arange(len(words)), words
    rank = ranked(symbols[:, :-1], symbols[:, 1:])
    while symbols.shape[1] > 1:
        best = rank.argmin(axis=1)
        row = np.arange(len(best))
        found = rank[row, best]
        done = found == none
        if done.any():
            yield places[done], symbols[done]
            places, symbols, rank, best, found = places[~done], symbols[~done], rank[~done], best[~done], found[~done]
            row = np.arange(len(best))
        if not len(places):
            return
        width = symbols.shape[1]
        column = np.arange(width - 1)
        symbols[row, best] = by_rank[found]
        symbols = np.take_along_axis(symbols, column + (column > best[:, None]), 1)
        rank = np.take_along_axis(rank, column[:-1] + (column[:-1] >= best[:, None]), 1)
        inner = best > 0
        rank[row[inner], best[inner] - 1] = ranked(symbols[row[inner], best[inner] - 1], symbols[row[inner], best[inner]])
        inner = best < width - 2
        rank[row[inner], best[inner]] = ranked(symbols[row[inner], best[inner]], symbols[row[inner], best[inner] + 1])
    yield places, symbols


@functools.cache
def fast_split() -> re.Pattern:
    """The split pattern for texts within the basic plane, its classes written out as they are defined for ``PATTERN``."""
    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))

    def members(name: str) -> str:
        points = np.array([ord(c) for c in regex.findall(name, plane)])
        ends = np.flatnonzero(np.diff(points, append=-1) != 1)
        return "".join(f"\\u{points[i]:04x}-\\u{points[j]:04x}" for i, j in zip([0, *ends[:-1] + 1], ends, strict=True))

    letter, number, space = members(r"\p{L}"), members(r"\p{N}"), members(r"\s")
    return re.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]").replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]"))


OUTSIDE = re.compile("[\ud800-\udfff\U00010000-\U0010ffff]")
#: Before such a space a pre-token ends, whatever surrounds it.
CERTAIN = regex.compile(r"\S(?= \S)")


class Encoder:
    """Texts to ids (little-endian unsigned 32-bit): pre-tokens by the pattern, each through the merges; short words are remembered."""

    def __init__(self, model: Model):
        self.model, self.transducer = model, Transducer(model)
        pairs = sorted((a << 32 | b, rank, made) for (a, b), (rank, made) in model.ranks.items())
        order = {r: i for i, r in enumerate(sorted(p[1] for p in pairs))}
        self.keys, self.ranks, self.made = np.array([p[0] for p in pairs]), np.array([order[p[1]] for p in pairs]), np.array([p[2] for p in pairs])
        self.of_byte = np.array(model.of_byte, np.int64)
        self.special = {s: packed([i]) for s, i in model.special.items()}
        self.memo: dict[str, bytes] = dict(self.special)
        self.older: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        """Ids of one pre-token of any length, through the transducer."""
        out, data = array("I"), word.encode("utf-8", "surrogatepass")
        out.extend(self.transducer.feed(data))
        out.extend(self.transducer.finish())
        return out.tobytes()

    def learn(self, words: set[str]) -> None:
        """Remember the ids of all short ones."""
        new = [w for w in words.difference(self.memo) if len(w) <= SHORT]
        if len(self.memo) + len(new) > MEMO_WORDS // 2:
            self.memo, self.older = dict(self.special), self.memo
            new = [w for w in words if len(w) <= SHORT and w not in self.special]
        unknown = []
        for w in new:
            if (ids := self.older.get(w)) is not None:
                self.memo[w] = ids
            else:
                unknown.append(w)
        data = [w.encode("utf-8", "surrogatepass") for w in unknown]
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        below = 0
        for width in WIDTHS:
            at = np.flatnonzero((lengths > below) & (lengths <= width))
            below = width
            if not len(at):
                continue
            symbols = self.of_byte[np.frombuffer(b"".join([data[i].ljust(width) for i in at]), np.uint8)].reshape(-1, width)
            symbols[np.arange(width) >= lengths[at, None]] = -1
            for places, rows in merge_many(symbols, self.keys, self.ranks, self.made):
                size, ids = 4 * rows.shape[1], rows.astype("<u4").tobytes()
                ends = 4 * (rows >= 0).sum(axis=1)
                for i, (place, end) in enumerate(zip(at[places].tolist(), ends.tolist(), strict=True)):
                    self.memo[unknown[place]] = ids[i * size : i * size + end]

    def words(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens of slices of a text, special tokens among them."""
        at = 0
        if self.model.split_special and any(s in text for s in self.model.special):
            for m in self.model.split_special.finditer(text):
                yield from self.slices(text[at : m.start()])
                yield [m[0]]
                at = m.end()
        yield from self.slices(text[at:] if at else text)

    def slices(self, text: str) -> Iterator[list[str]]:
        split, at = self.model.split if OUTSIDE.search(text) else fast_split(), 0
        while len(text) - at > SLICE:
            certain = CERTAIN.search(text, at + SLICE, at + 2 * SLICE)
            if not certain:  # hardly a text: one pre-token at a time
                part: list[str] = []
                for m in split.finditer(text, at):
                    part.append(m[0])
                    if len(part) == SLICE:
                        yield part
                        part = []
                yield part
                return
            yield split.findall(text, at, certain.end())
            at = certain.end()
        yield split.findall(text, at)

    def encode_all(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of all texts; the words of many slices are learned together."""
        out: list[bytearray] = []
        waiting: list[tuple[int, list[str]]] = []
        held = 0

        def put() -> None:
            self.learn(set().union(*(words for _, words in waiting)))
            memo = self.memo
            for i, words in waiting:
                try:
                    out[i] += b"".join(map(memo.__getitem__, words))
                except KeyError:  # some words are too long to be remembered
                    for w in words:
                        out[i] += memo[w] if w in memo else self.word(w)
            waiting.clear()

        for text in texts:
            out.append(bytearray())
            for words in self.words(text):
                waiting.append((len(out) - 1, words))
                held += len(words)
                if held >= WORDS:
                    put()
                    held = 0
        put()
        return [bytes(ids) for ids in out]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Decoder:
    """Ids to text: bytes of each id through an incremental UTF-8 machine, a slice of ids at a time."""

    SLICE = 65_536

    def __init__(self, model: Model):
        size = max(model.bytes_of) + 1
        self.table = [model.bytes_of.get(i, b"") for i in range(size)]

    def pieces(self, ids: array) -> Iterator[str]:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        table, size = self.table, len(self.table)
        for i in range(0, len(ids), self.SLICE):
            part = ids[i : i + self.SLICE]
            yield machine.decode(b"".join([table[t] for t in part] if max(part) < size else [table[t] for t in part if t < size]))
        yield machine.decode(b"", True)

    def decode(self, data: bytes) -> str:
        ids = array("I")
        ids.frombytes(data)
        return "".join(self.pieces(ids))


_loaded: dict[tuple[str, type], object] = {}


def on_worker(path: str, kind: type):
    """One encoder or decoder for each Python worker and file."""
    if (path, kind) not in _loaded:
        _loaded[path, kind] = kind(Model(path))
    return _loaded[path, kind]


def slices(batch: pd.Series) -> Iterator[pd.Series]:
    """A batch in parts, so that results do not wait for each other in memory."""
    for i in range(0, len(batch), ROWS):
        yield batch.iloc[i : i + ROWS]


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col``: the ids of the whole text as little-endian unsigned 32-bit integers (binary)."""

    @F.pandas_udf("binary")
    def ids_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = on_worker(tokenizer_path, Encoder)
        for batch in texts:
            for part in slices(batch):
                yield pd.Series(encoder.encode_all(part), dtype=object)

    return without(docs, ids_col).withColumn(ids_col, ids_of(F.coalesce(docs[text_col], F.lit(""))))


def decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with ``text_col``: the text of the ids in ``ids_col``, special tokens included; null ids give an empty text."""

    @F.pandas_udf("string")
    def text_of(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = on_worker(tokenizer_path, Decoder)
        for batch in ids:
            for part in slices(batch):
                yield pd.Series([decoder.decode(b) for b in part], dtype=object)

    return without(df, text_col).withColumn(text_col, text_of(F.coalesce(df[ids_col], F.lit(b""))))


def round_trip(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``decode(encode(docs))`` with the texts going to Python once."""

    @F.pandas_udf("ids binary, decoded string")
    def both(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder, decoder = on_worker(tokenizer_path, Encoder), on_worker(tokenizer_path, Decoder)
        for batch in texts:
            for part in slices(batch):
                ids = encoder.encode_all(part)
                yield pd.DataFrame({"ids": ids, "decoded": [decoder.decode(b) for b in ids]})

    out = without(docs, ids_col, decoded_col, "_coded").withColumn("_coded", both(F.coalesce(docs[text_col], F.lit(""))))
    return out.withColumns({ids_col: F.col("_coded.ids"), decoded_col: F.col("_coded.decoded")}).drop("_coded")

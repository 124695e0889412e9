"""Packing of token sequences with minimum bin slack.

Each document becomes ids and an end id.  Whole windows are cut from its start; the remainders wait in a pool.
For each window the longest waiting remainder is fixed and a bitset of reachable sums over the multiset of the
other lengths picks the filling closest to the capacity; the counts are found by backtracking.  What still lacks
is cut from another remainder, and at the end of a partition the last windows are cut at powers of two, which
need no padding.  A partition is packed on its own as a stream, so nothing is shuffled, the pool is bounded and a
lost task is simply run again.

Defined results: null text counts as empty (only the end id); equal rows are packed each on its own; ids and
texts of any column other than the two named are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Remainders that wait at once in a task; packing starts when they are reached.
POOL = 4096
#: A run of so many characters is very long.
RUN = 1024
SPACES = re.compile(rf"\s{{{RUN}}}")

SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


def has_long_run(text: str) -> bool:
    return len(text) > RUN and (max(map(len, text.split()), default=0) > RUN or SPACES.search(text) is not None)


class Tokenizer:
    """Ids as the tokenizers library gives them.

    Texts of Latin-1 characters go through the other library's reader of the same vocabulary, which is three times
    as fast; there the two agree on every character class.  All others go through the tokenizers library itself, and so
    do texts with a very long run of white space or of other characters, for which the other is not made.
    """

    def __init__(self, path: str, ranks_path: str | None):
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.fast = None
        if ranks_path:
            import base64

            import tiktoken

            from .bpe import PATTERN

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
            self.fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and not has_long_run(text):
            try:
                text.encode("latin-1")
                return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), dtype=np.uint32)
            except UnicodeEncodeError:
                pass
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def best_filling(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length fill ``capacity`` best: subset sums as bits of one integer, then backtracking."""
    reach, steps, full = 1, [], 1 << capacity
    mask = 2 * full - 1
    for length in sorted(counts, reverse=True):
        for _ in range(min(counts[length], capacity // length)):
            steps.append((length, reach))
            reach |= (reach << length) & mask
            if reach & full:
                break
        if reach & full:
            break
    left, taken = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        if not before >> left & 1:
            taken[length] = taken.get(length, 0) + 1
            left -= length
    return taken


class Packer:
    """Pieces (document, start, ids) in, sequences of pieces out."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.pool: dict[int, list[tuple]] = {}
        self.waiting = 0

    def add(self, piece: tuple) -> None:
        self.pool.setdefault(len(piece[2]), []).append(piece)
        self.waiting += 1

    def take(self, length: int) -> tuple:
        stack = self.pool[length]
        piece = stack.pop()
        if not stack:
            del self.pool[length]
        self.waiting -= 1
        return piece

    def cut(self, room: int) -> tuple | None:
        """The first ``room`` ids of a remainder longer than that; the rest waits on."""
        longer = [n for n in self.pool if n > room]
        if not longer:
            return None
        doc, start, ids = self.take(min(longer))
        self.add((doc, start + room, ids[room:]))
        return doc, start, ids[:room]

    def window(self) -> list[tuple]:
        first = self.take(max(self.pool))
        pieces, room = [first], self.capacity - len(first[2])
        for length, n in (best_filling({k: len(v) for k, v in self.pool.items() if k <= room}, room) if room else {}).items():
            pieces += [self.take(length) for _ in range(n)]
            room -= n * length
        if room and (piece := self.cut(room)):
            pieces.append(piece)
        return pieces

    def down_to(self, waiting: int) -> Iterator[list[tuple]]:
        while self.waiting > waiting:
            yield self.window()


def at_powers_of_two(pieces: list[tuple], capacity: int) -> Iterator[list[tuple]]:
    """A window that is not full, cut into sequences whose lengths are powers of two."""
    total = sum(len(p[2]) for p in pieces)
    if total == capacity:
        yield pieces
        return
    rest = list(reversed(pieces))
    for size in (1 << b for b in reversed(range(total.bit_length())) if total >> b & 1):
        sequence = []
        while size:
            doc, start, ids = rest.pop()
            if len(ids) > size:
                rest.append((doc, start + size, ids[size:]))
                ids = ids[:size]
            sequence.append((doc, start, ids))
            size -= len(ids)
        yield sequence


def token_count(text: Column, tokenizer_path: str, ranks_path: str | None = None) -> Column:
    """Tokens of the whole text; none for a null one."""

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = Tokenizer(tokenizer_path, ranks_path)
        for batch in texts:
            yield pd.Series([len(tokenizer.ids(t)) for t in batch], dtype="int64")

    return count(F.coalesce(text, F.lit("")))


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, sequence_tokens.

    ``sequence_id`` holds the partition in its upper bits and a count in the lower 33.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, packer = Tokenizer(tokenizer_path, ranks_path), Packer(capacity)
        sequence = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def put(pieces: list[tuple]) -> None:
            nonlocal sequence
            total, offset = sum(len(p[2]) for p in pieces), 0
            for (doc, n), start, ids in pieces:
                rows.append((doc, start, len(ids), ids.astype("<u4").tobytes(), n, sequence, offset, total))
                offset += len(ids)
            sequence += 1

        def flush() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_tokens"])
            rows.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch["id"], batch["text"], strict=True):
                ids = np.append(tokenizer.ids(text), np.uint32(end_id))
                whole = len(ids) // capacity * capacity
                for start in range(0, whole, capacity):
                    put([((doc, len(ids)), start, ids[start : start + capacity])])
                if len(ids) > whole:
                    packer.add(((doc, len(ids)), whole, ids[whole:].copy()))
                if packer.waiting >= POOL:
                    for pieces in packer.down_to(POOL // 2):
                        put(pieces)
                if len(rows) >= 2048:
                    yield flush()
        for window in packer.down_to(0):
            for pieces in at_powers_of_two(window, capacity):
                put(pieces)
        yield flush()

    kind = docs.schema[id_col].dataType.simpleString()
    # As text, ids with nulls among them stay exact on their way through pandas.
    narrow = docs.select(docs[id_col].cast("string").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    packed = narrow.mapInPandas(run, f"id string, {SCHEMA}")
    return packed.select(F.col("id").cast(kind).alias(id_col), *[c for c in packed.columns if c != "id"])

"""Alignment of two tokenizers over the same bytes.

Tokens and bytes form an incidence matrix for each tokenizer, in compressed rows built by hand: row i of A holds the
bytes of token i.  The row products of A and the transpose of B (Gustavson: each entry of a row of A takes a row of the
transpose, equal columns are summed) say which tokens overlap and by how many bytes; with rows of the last bytes alone they
say which end together; with rows of the groups between common ends, which share a group.

Counts of linked id pairs are gathered from all rows.  Two tokens that end together are suffixes of each other, so the two
vocabularies bound the number of pairs whatever the corpus; where that bound is small, the counts are looked up in a broadcast
array, and otherwise by a shuffle.

Defined results: a text that is null or empty, or whose tokens do not join to a space and the text in either
tokenizer (such as one with U+2581), has no tokens, groups or links; special tokens' strings are plain text; repeated rows
are aligned and counted each on its own; an empty table gives no rows; columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, Model
from .common import Tables
from .packing import Tokenizer, has_long_run

#: Entries of A multiplied at once, texts handed back at once, and pairs that are broadcast at most.
ENTRIES, ROWS, PAIRS = 1 << 18, 256, 1 << 21
#: What an aligned row can hold: ids and ends as little-endian unsigned 32-bit numbers, links as places of tokens.
COLUMNS = {
    "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long",
    "a_ids": "binary", "a_ends": "binary", "b_ids": "binary", "b_ends": "binary", "groups": "string", "groups_sha256": "string",
    "link_a": "array<int>", "link_b": "array<int>", "shared": "array<int>", "pairs": "array<long>", "pair_links": "array<long>",
}


class Rows(NamedTuple):
    """A sparse matrix of ones: the columns of row i are columns[starts[i]:starts[i + 1]]."""

    starts: np.ndarray
    columns: np.ndarray


def all_bytes(ends: np.ndarray) -> Rows:
    return Rows(np.append(0, ends), np.arange(ends[-1] if len(ends) else 0))


def last_bytes(ends: np.ndarray) -> Rows:
    return Rows(np.arange(len(ends) + 1), ends - 1)


def group_of(ends: np.ndarray, borders: np.ndarray) -> Rows:
    """The group of each token, which ends at the first border that is not before the token's end."""
    return Rows(np.arange(len(ends) + 1), np.searchsorted(borders, ends))


def transpose(matrix: Rows, width: int) -> Rows:
    owners = np.repeat(np.arange(len(matrix.starts) - 1), np.diff(matrix.starts))
    starts = np.append(0, np.cumsum(np.bincount(matrix.columns, minlength=width)))
    in_order = not (matrix.columns[1:] < matrix.columns[:-1]).any()
    return Rows(starts, owners if in_order else owners[np.argsort(matrix.columns, kind="stable")])


def run_lengths(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each occurs; products of rows in byte order come sorted already."""
    if len(keys) and (keys[1:] < keys[:-1]).any():
        keys = np.sort(keys)
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[starts], np.diff(np.append(starts, len(keys)))


def multiply(a: Rows, b: Rows, entries: int = ENTRIES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Gustavson's product of two matrices: (row, column, sum) of its entries, a block of rows of ``a`` at a time."""
    first, n = 0, len(a.starts) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(a.starts, a.starts[first] + entries, side="right")) - 1)
        inner = a.columns[a.starts[first] : a.starts[last]]
        sizes = b.starts[inner + 1] - b.starts[inner]
        rows = np.repeat(np.repeat(np.arange(first, last), np.diff(a.starts[first : last + 1])), sizes)
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        columns = b.columns[np.repeat(b.starts[inner], sizes) + within]
        keys, sums = run_lengths(rows.astype(np.int64) << 32 | columns)
        yield keys >> 32, keys & 0xFFFFFFFF, sums
        first = last


def links(a_ends: np.ndarray, b_ends: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of linked tokens and what they share: bytes ("overlap"), a last byte ("ends") or a group ("groups")."""
    width = int(a_ends[-1]) if len(a_ends) else 0
    if kind == "groups":
        borders = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a, b, width = group_of(a_ends, borders), group_of(b_ends, borders), len(borders)
    else:
        of = {"overlap": all_bytes, "ends": last_bytes}[kind]
        a, b = of(a_ends), of(b_ends)
    blocks = list(multiply(a, transpose(b, width)))
    if not blocks:
        return (np.zeros(0, dtype=np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*blocks, strict=True))


def is_latin(text: str) -> bool:
    return text.isascii() or max(text) < "\u0100"


class PlainTokenizer(Tokenizer):
    """The strings of special tokens are text like any other."""

    def __init__(self, path: str, ranks_path: str | None):
        super().__init__(path, ranks_path)
        self.library.encode_special_tokens = True
        if ranks_path:
            import tiktoken

            self.fast = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=self.fast._mergeable_ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and is_latin(text) and not has_long_run(text):
            return np.array(self.fast.encode_ordinary(text), dtype=np.int64)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.int64)


class TokenBytes:
    """The bytes of all tokens in one array."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array(list(map(len, tokens)), dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.all = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def spell(self, ids: np.ndarray, want: np.ndarray) -> bool:
        """Whether the tokens join to these bytes."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if (ends[-1] if len(ends) else 0) != len(want):
            return False
        return bool((self.all[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(len(want))] == want).all())


class Vocabularies:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, byte_path: str, ranks_path: str | None, piece_path: str):
        import sentencepiece

        self.a = PlainTokenizer(byte_path, ranks_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.a_bytes, self.b_bytes = TokenBytes(vocabulary_a(byte_path)), TokenBytes(vocabulary_b(piece_path))
        self.a_sizes, self.b_sizes = self.a_bytes.sizes, self.b_bytes.sizes
        digits = [np.array([str(i) for i in range(max(len(self.a_sizes), len(self.b_sizes)))], dtype=object) + after for after in (",", "|", ";")]
        self.written = np.concatenate(digits)

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a space and the text by A, of the text by B; none where they do not join to the same bytes."""
        a, b = self.a.ids(" " + text), np.array(self.b.encode(text, num_threads=1), dtype=np.int64)
        want = np.frombuffer(b" " + text.encode(), dtype=np.uint8)
        return (a, b) if self.a_bytes.spell(a, want) and self.b_bytes.spell(b, want) else (a[:0], b[:0])

    def groups(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, borders: np.ndarray) -> str:
        """`a1,a2|b1;a3|b2,b3`: the ids of each group in order."""
        place = np.concatenate([2 * np.searchsorted(borders, a_ends), 2 * np.searchsorted(borders, b_ends) + 1])
        order = np.argsort(place, kind="stable")
        place, ids = place[order], np.concatenate([a, b])[order]
        step = np.append(place[1:], place[-1:] + 1) - place  # 0: the same side of a group, else the next side
        after = np.where(step == 0, 0, np.where(place % 2 == 0, 1, 2))
        return "".join(self.written[ids + after * (len(self.written) // 3)].tolist())[:-1]


def vocabulary_a(byte_path: str) -> list[bytes]:
    found = Model(byte_path).bytes_of
    return [found.get(i, b"") for i in range(max(found) + 1)]


def vocabulary_b(piece_path: str) -> list[bytes]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_path)
    pieces = ((model.id_to_piece(i), model.is_byte(i)) for i in range(model.get_piece_size()))
    return [bytes([int(p[3:5], 16)]) if is_byte else p.replace("▁", " ").encode() for p, is_byte in pieces]


def possible_pairs(a: list[bytes], b: list[bytes]) -> int:
    """How many id pairs can end together in any corpus: those where one token's bytes end the other's."""
    total = 0
    for one, other, least in ((a, b, 0), (b, a, 1)):  # equal bytes count once
        ids: dict[bytes, int] = {}
        for token in other:
            ids[token] = ids.get(token, 0) + 1
        total += sum(ids.get(token[at:], 0) for token in one for at in range(least, len(token)))
    return total


def align(docs: DataFrame, byte_path: str, ranks_path: str | None, piece_path: str, kind: str = "ends", columns: tuple[str, ...] = tuple(COLUMNS), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a text: ``id_col``, ``row`` (a number of its own) and the wanted ones of COLUMNS.

    ``kind`` says what links two tokens. ``pairs`` are the distinct linked id pairs, A's id in the upper 32 bits, and
    ``pair_links`` how many links hold each.
    """

    def of(vocabularies: Vocabularies, text: str) -> dict:
        a, b = vocabularies.tokens(text) if text else (np.zeros(0, dtype=np.int64),) * 2
        a_ends, b_ends = vocabularies.a_sizes[a].cumsum(), vocabularies.b_sizes[b].cumsum()
        borders = np.intersect1d(a_ends, b_ends, assume_unique=True)
        link_a, link_b, shared = links(a_ends, b_ends, kind)
        pairs, pair_links = np.unique(a[link_a] << 32 | b[link_b], return_counts=True)
        raw = lambda x: x.astype("<u4").tobytes()
        found = {"n_a": len(a), "n_b": len(b), "n_groups": len(borders), "n_links": len(link_a), "link_a": link_a, "link_b": link_b, "shared": shared, "pairs": pairs, "pair_links": pair_links}
        found |= {"a_ids": raw(a), "a_ends": raw(a_ends), "b_ids": raw(b), "b_ends": raw(b_ends)}
        groups = vocabularies.groups(a, b, a_ends, b_ends, borders) if len(a) and {"groups", "groups_sha256"} & set(columns) else ""
        return found | {"groups": groups, "groups_sha256": hashlib.sha256(groups.encode()).hexdigest() if groups else ""}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabularies, row = Vocabularies(byte_path, ranks_path, piece_path), TaskContext.get().partitionId() << 33
        for whole in batches:
            for start in range(0, len(whole), ROWS):
                batch = whole.iloc[start : start + ROWS]
                found = pd.DataFrame([of(vocabularies, t) for t in batch["text"]])
                yield pd.DataFrame({"id": batch["id"].to_numpy(), "row": np.arange(row, row + len(batch)), **{c: found[c] for c in columns}})
                row += len(batch)

    type_of = docs.schema[id_col].dataType.simpleString()
    # As text, ids with nulls among them stay exact on their way through pandas.
    narrow = docs.select(docs[id_col].cast("string").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    aligned = narrow.mapInPandas(run, ", ".join(["id string", "row long", *[f"{c} {COLUMNS[c]}" for c in columns]]))
    return aligned.select(F.col("id").cast(type_of).alias(id_col), *[c for c in aligned.columns if c != "id"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): links that hold an id pair in all rows, and whether no pair of its B id has more."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "pair_links")).alias("p")).select("p.pairs", "p.pair_links")
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("pair_links").alias("count"))
    b = F.expr("pair & 4294967295")
    highest = counts.groupBy(b.alias("b")).agg(F.max("count").alias("highest"))
    return counts.withColumn("b", b).join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def with_counts(aligned: DataFrame, bound: int | None, most: int = PAIRS) -> DataFrame:
    """Add ``count_sum`` and ``n_best`` over a row's links and drop the pairs.

    ``aligned`` is read more than once: write it first. ``bound`` is a proven number of distinct pairs, None where there is none.
    """
    counts = pair_counts(aligned)
    kept = [c for c in aligned.columns if c not in ("pairs", "pair_links")]
    if bound is None or bound > most:
        each = aligned.select("row", F.explode(F.arrays_zip("pairs", "pair_links")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.pair_links").alias("links"))
        sums = each.join(counts, "pair").groupBy("row").agg(F.sum(F.col("links") * F.col("count")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"))
        return aligned.select(*kept).join(sums, "row", "left").fillna(0, ["count_sum", "n_best"])
    found = counts.toPandas().sort_values("pair")
    table = aligned.sparkSession.sparkContext.broadcast((found["pair"].to_numpy(dtype=np.int64), found["count"].to_numpy(dtype=np.int64), found["best"].to_numpy(dtype=bool)))

    @F.pandas_udf("count_sum long, n_best long")
    def look_up(pairs: pd.Series, pair_links: pd.Series) -> pd.DataFrame:
        ids, count, best = table.value
        sums = []
        for pair, n in zip(pairs, pair_links, strict=True):
            at = np.searchsorted(ids, pair)
            sums.append((int((count[at] * n).sum()), int(n[best[at]].sum())) if len(pair) else (0, 0))
        return pd.DataFrame(sums, columns=["count_sum", "n_best"], dtype="int64")

    return aligned.select(*kept, look_up("pairs", "pair_links").alias("sums")).select(*kept, "sums.*")


def align_and_count(docs: DataFrame, byte_path: str, ranks_path: str | None, piece_path: str, kind: str = "ends", columns: tuple[str, ...] = ("n_a", "n_b", "n_groups", "n_links"), most: int = PAIRS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``align`` with the counts of all rows: the wanted columns, count_sum and n_best."""
    aligned = align(docs, byte_path, ranks_path, piece_path, kind, (*columns, "pairs", "pair_links"), id_col, text_col)
    bound = possible_pairs(vocabulary_a(byte_path), vocabulary_b(piece_path)) if kind == "ends" else None
    return with_counts(Tables(docs.sparkSession, "alignment").write(aligned, "aligned"), bound, most)

"""Hard negatives for contrastive training, by a secondary sort.

Scores are integer inner products, so they are exact and ties are real.  Rows lie in blocks of bounded size by a hash of
their id; the anchors stream past every block.  A block hands on only what can be among the first rows of a window: in the
first pass the best rows of an anchor's label, in the second, when the positives are known, the first rows below each
of them.  What is handed on is packed into keys (anchor, descending score, positive before negative, id), dealt by anchor
and sorted inside partitions by the shuffle; an iterator opens a window at each positive and emits the negatives
that follow, holding nothing of an anchor but its open windows.

Defined results: a row takes part if its id, label and vector are not null and every component is finite; rows of one id
count as one, that with the smallest label and vector; vectors of different length do not meet; of equal scores the
smaller id comes first; an anchor without positives has no rows; a component or score beyond 64 bits counts as the nearest
of 64 bits; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables

#: Rows of a block on average, at most, and scores that a task holds at once.
BLOCK, CELLS = 32_768, 1 << 22
SCORED = "anchor long, score long, id long"
KEY = struct.Struct(">QQBQ")
SIGN, LONG = 1 << 63, np.iinfo(np.int64)


def taking_part(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, vector) of the rows that take part; components are floor(scale * x)."""
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(F.lit(float(scale)) * x))
    found = df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & fine)
    return found.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), whole.alias("vector"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices, at most 64 bits."""
    most = np.abs(a.astype(float)).max(initial=0) * np.abs(b.astype(float)).max(initial=0) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), LONG.min, LONG.max).astype(np.int64)


class Block:
    """Rows of one block, by length of vector and label, in ascending order of id."""

    def __init__(self, rows: list[tuple]):
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by_length: dict[int, list[tuple]] = {}
        last = None
        for row in rows:  # sorted by id, label and vector: the first of an id is the one that counts
            if row[0] != last:
                by_length.setdefault(len(row[2]), []).append(row)
            last = row[0]
        for length, group in by_length.items():
            vectors = np.array([r[2] for r in group], dtype=np.int64).reshape(len(group), length)
            self.of[length] = np.array([r[0] for r in group], dtype=np.int64), np.array([r[1] for r in group], dtype=object), vectors


def best(ids: np.ndarray, scores: np.ndarray, own: int, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores, of equal ones those with the smaller ids; ``own`` is left out."""
    if len(scores) > most + 1:
        places = np.flatnonzero(scores >= np.partition(scores, len(scores) - most - 1)[len(scores) - most - 1])
    else:
        places = np.arange(len(scores))
    places = places[ids[places] != own]
    return places[np.argsort(-scores[places], kind="stable")][:most]


def first_in_windows(scores: np.ndarray, positives: np.ndarray, most: int, low: int, high: int) -> np.ndarray:
    """Places of the first ``most`` scores of each window low * positive <= high * score <= high * positive."""
    least = min(-(-low * int(p) // high) for p in positives)
    places = np.flatnonzero((scores <= positives.max()) & (scores >= max(least, LONG.min)))
    places = places[np.argsort(-scores[places], kind="stable")]
    falling, taken = -scores[places], set()
    for p in positives:
        start = np.searchsorted(falling, -p)
        taken.update(x for x in places[start : start + most] if low * int(p) <= high * int(scores[x]))
    return np.array(sorted(taken), dtype=np.int64)


def past_blocks(rows: DataFrame, anchors: DataFrame, blocks: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """Stream the anchors past every block: (anchor, score, id) of what a block hands on.

    Anchors without a list of positive scores look for positives, those with one for negatives.
    """
    known = F.col("positives") if "positives" in anchors.columns else F.lit(None).cast("array<long>")
    own = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.lit(0).alias("kind"), "id", "label", "vector", F.lit(None).cast("array<long>").alias("positives"))
    sent = anchors.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(1).alias("kind"), "id", "label", "vector", known.alias("positives"))
    dealt = own.unionByName(sent).repartition(blocks, "block").sortWithinPartitions("block", "kind", "id", "label", "vector")

    def handed_on(block: Block, group: pd.DataFrame) -> Iterator[pd.DataFrame]:
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        for (length, label), same in group.groupby([group["vector"].map(len), "label"], sort=False):
            if length not in block.of:
                continue
            ids, labels, vectors = block.of[length]
            search = same["positives"].iloc[0] is None
            there = np.flatnonzero((labels == label) == search)
            if not len(there):
                continue
            ids, vectors = ids[there], vectors[there]
            step = max(1, CELLS // len(there))
            for at in range(0, len(same), step):
                part = same.iloc[at : at + step]
                scores = products(np.array(part["vector"].tolist(), dtype=np.int64).reshape(len(part), length), vectors)
                for own_id, known_scores, line in zip(part["id"], part["positives"], scores, strict=True):
                    places = best(ids, line, own_id, positives) if search else first_in_windows(line, np.asarray(known_scores), negatives, low, high)
                    if len(places):
                        found.append((own_id, line[places], ids[places]))
        if found:
            yield pd.DataFrame({"anchor": np.repeat([f[0] for f in found], [len(f[1]) for f in found]), "score": np.concatenate([f[1] for f in found]), "id": np.concatenate([f[2] for f in found])})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, waiting, block = None, [], None
        for batch in batches:
            for (number, kind), part in batch.groupby(["block", "kind"]):
                if number != at:
                    at, waiting, block = number, [], None
                if kind == 0:
                    waiting += zip(part["id"], part["label"], part["vector"], strict=True)
                    continue
                if block is None:
                    block, waiting = Block(waiting), []
                yield from handed_on(block, part)

    return dealt.mapInPandas(run, SCORED)


def pack(anchor: int, score: int, negative: int, row: int) -> bytes:
    """A key whose bytes sort by anchor, descending score, positives first, id."""
    return KEY.pack(anchor + SIGN, SIGN - 1 - score, negative, row + SIGN)


def unpack(key: bytes) -> tuple[int, int, int, int]:
    anchor, score, negative, row = KEY.unpack(key)
    return anchor - SIGN, SIGN - 1 - score, negative, row - SIGN


def first_positives(keys: Iterable[tuple[bytes, None]], most: int) -> Iterator[tuple]:
    """The first rows of each anchor, from sorted keys."""
    last, given = None, 0
    for key, _ in keys:
        anchor, score, _, row = unpack(key)
        given = 0 if anchor != last else given
        last = anchor
        if given < most:
            given += 1
            yield anchor, score, row


def windows(keys: Iterable[tuple[bytes, None]], most: int, low: int, high: int) -> Iterator[tuple]:
    """Open a window at each positive and emit the negatives that fall into it, from sorted keys."""
    last, opened = None, []
    for key, _ in keys:
        anchor, score, negative, row = unpack(key)
        if anchor != last:
            last, opened = anchor, []
        if not negative:
            opened.append([row, score, 0])
            continue
        for window in opened:
            if window[2] < most and low * window[1] <= high * score:
                window[2] += 1
                yield anchor, window[0], window[2], row, window[1], score


def mine(df: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, block_rows: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``anchors`` holds."""
    spark, tables = df.sparkSession, Tables(df.sparkSession, "negatives")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = taking_part(df, id_col, vector_col, label_col, scale)
    blocks = max(2 * spark.sparkContext.defaultParallelism, -(-rows.count() // block_rows))
    least = taking_part(df.where(anchors), id_col, vector_col, label_col, scale).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("least"))
    chosen = least.select("id", "least.label", "least.vector")

    def sorted_keys(scored: DataFrame):
        keys = scored.rdd.map(lambda r: (pack(*r), None))
        return keys.repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:8]))

    near = past_blocks(rows, chosen, blocks, positives, negatives, low, high).select("anchor", "score", F.lit(0), "id")
    found = sorted_keys(near).mapPartitions(lambda keys: first_positives(keys, positives))
    found = tables.write(spark.createDataFrame(found, SCORED), "positives")
    scores = found.groupBy(F.col("anchor").alias("id")).agg(F.collect_list("score").alias("positives"))
    below = past_blocks(rows, chosen.join(scores, "id"), blocks, positives, negatives, low, high)
    both = found.select("anchor", "score", F.lit(0).alias("negative"), "id").unionAll(below.select("anchor", "score", F.lit(1).alias("negative"), "id"))
    mined = sorted_keys(both).mapPartitions(lambda keys: windows(keys, negatives, low, high))
    return spark.createDataFrame(mined, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")

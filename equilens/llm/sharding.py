"""Sharding as vector bin packing: bytes, tokens and rows are balanced jointly.

Copies of one text form a group that stays together, unless it has more than ``split_rows`` rows and is larger than a
whole shard, so that no placing could balance it; then it is split into quarters of a shard by row number hash (which rows of such a group go where is the only thing that depends on how the input is
partitioned).  Tokens are counted by the caller; without a count they are not balanced.  Groups go to the shard whose residual capacity has the largest dot product with their
demand, both relative to capacity, largest group first.  Heavy groups, whose number the totals bound, are placed
first by one task; all others are dealt into blocks of bounded size, and each block places its own against an
equal share of what the heavy ones left.  Slots are numbered in buckets with offsets, so no task sees a shard.

Defined results: null text counts as no bytes, no tokens and a group of its own; a null count of tokens as none; ties go to the shard first in a
rotation that depends on the block; repeated rows each get a slot; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables

#: Groups that a block places, on average.
BLOCK_GROUPS = 8192
#: A group is heavy beyond this part of a shard's capacity; there are at most 3 x shards x HEAVY_PART of them.
HEAVY_PART = 512
#: A group that no shard can hold is split into pieces of this part of a shard's capacity, if it has more than so many rows.
SPLIT_PART, SPLIT_ROWS = 4, 256
#: Rows of a bucket in which slots are numbered, on average.
BUCKET_ROWS = 65_536
DEMAND = ("bytes", "tokens", "n")


def greedy(demand: np.ndarray, residual: np.ndarray, capacity: np.ndarray, first: int) -> np.ndarray:
    """Shards of the groups. demand: groups x 3; residual: shards x 3, what is left; capacity: what a shard holds."""
    shards = len(residual)
    scale = np.maximum(capacity, 1e-9)
    left, need = np.roll(residual / scale, -first, axis=0), demand / scale
    placed = np.empty(len(demand), np.int64)
    for i in np.argsort(-need.max(axis=1), kind="stable"):
        best = int(np.argmax(left @ need[i]))
        left[best] -= need[i]
        placed[i] = (best + first) % shards
    return placed


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, split_rows: int | None = SPLIT_ROWS) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, size, tokens, text_crc32, shard, slot.

    Groups of up to ``split_rows`` equal texts are never split, whatever the table's size; None splits none.
    """
    tables, text = Tables(docs.sparkSession, "shard"), docs[text_col]
    rows = docs.select(
        docs[id_col].alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("bytes"),
        F.coalesce(F.lit(0) if tokens is None else tokens, F.lit(0)).cast("long").alias("tokens"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5(text.cast("binary")), F.lit("")).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("order", F.xxhash64(F.col("id").cast("string"), "key"))
    rows = tables.write(rows, "rows")
    total = rows.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens")).first()
    capacity = np.array([total[k] or 0 for k in DEMAND], float) / shards
    sums = [F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")]

    share = F.greatest(*[F.col(k) * (SPLIT_PART / max(c, 1.0)) for k, c in zip(DEMAND, capacity, strict=True)])
    # Each takes more than 1 / shards of some total, so there are at most 3 x shards.
    too_large = (share > SPLIT_PART) & (F.col("n") > split_rows) if split_rows is not None else F.lit(False)
    large = rows.groupBy("key").agg(*sums).where(too_large).select("key", F.ceil(share).alias("parts"))
    rows = rows.join(F.broadcast(large), "key", "left").withColumn("part", F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1)))).drop("parts")

    groups = tables.write(rows.groupBy("key", "part").agg(*sums), "groups")
    is_heavy = F.greatest(*[F.col(k) * (HEAVY_PART / max(c, 1.0)) for k, c in zip(DEMAND, capacity, strict=True)]) > 1

    def place_heavy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "part"])
        residual = np.tile(capacity, (shards, 1))
        return pdf[["key", "part", *DEMAND]].assign(shard=greedy(pdf[list(DEMAND)].to_numpy(float), residual, capacity, 0))

    heavy = groups.where(is_heavy).withColumn("block", F.lit(0)).groupBy("block").applyInPandas(place_heavy, "key string, part long, bytes long, tokens long, n long, shard long")
    heavy = tables.write(heavy, "heavy")
    residual = np.tile(capacity, (shards, 1))
    for r in heavy.groupBy("shard").agg(*[F.sum(k).alias(k) for k in DEMAND]).collect():
        residual[r["shard"]] -= [r[k] for k in DEMAND]

    light = groups.where(~is_heavy)
    blocks = max(1, -(-light.count() // BLOCK_GROUPS))

    def place_light(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "part"])
        own = pdf[list(DEMAND)].to_numpy(float)
        share = residual.clip(0)
        share = share * (own.sum(axis=0) / np.maximum(share.sum(axis=0), 1e-9))
        return pdf[["key", "part"]].assign(shard=greedy(own, share, share.mean(axis=0), int(pdf["block"].iloc[0]) % shards))

    light = light.withColumn("block", F.pmod(F.xxhash64("key", "part"), F.lit(blocks))).groupBy("block").applyInPandas(place_light, "key string, part long, shard long")
    # Rows of heavy groups look up their place in what is bounded by the totals, and do not meet in one task.
    few = F.broadcast(heavy.select("key", "part", "shard"))
    places = rows.join(few, ["key", "part"]).unionByName(rows.join(few.select("key", "part"), ["key", "part"], "left_anti").join(light, ["key", "part"]).select(*rows.columns, "shard"), allowMissingColumns=True)
    buckets = max(1, -(-(total["n"] or 0) // BUCKET_ROWS))
    placed = places.withColumn("bucket", F.pmod(F.xxhash64("order", F.lit(1)), F.lit(buckets)))
    placed = tables.write(placed.select("id", "bytes", "tokens", "text_crc32", "row", "order", F.col("shard").cast("int"), "bucket"), "placed")
    tables.drop("rows", "groups", "heavy")

    counts = placed.groupBy("shard", "bucket").count()
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("count")).drop("count")
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("order", "id", "text_crc32", "row")) - 1
    out = placed.withColumn("number", number).join(before, ["shard", "bucket"])
    return out.select(F.col("id").alias(id_col), F.col("bytes").alias("size"), "tokens", "text_crc32", "shard", (F.col("before") + F.col("number")).cast("long").alias("slot"))

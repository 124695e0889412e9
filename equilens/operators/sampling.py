"""Pools, caps, weights, permutations and resampling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import before_buckets, bucket_bits, hash_number, hash_rank, numbered


def balanced_pool(patients: DataFrame, patient: str, condition: str, attributes: list[str], limit: int, seed: int = 1337) -> DataFrame:
    """(patient, stratum, turn) of at most ``limit`` patients, round-robin over condition x attribute strata in hash order.

    Patients without one of the attributes are left out; one without a condition is "unconditioned". Strata take turns in
    the order of their names as text.
    """
    known = patients.where(" and ".join(f"`{a}` is not null" for a in attributes)).dropDuplicates([patient])
    stratum = F.concat_ws("|", F.coalesce(F.col(condition).cast("string"), F.lit("unconditioned")), *[F.col(a).cast("string") for a in attributes])
    queued = numbered(known.select(patient, stratum.alias("stratum")), ["stratum"], hash_rank(seed, F.col(patient)), patient, "turn")
    # No stratum gives more than ``limit`` patients, so what is sorted is bounded by the limit and the number of strata.
    return queued.where(F.col("turn") < max(0, limit)).orderBy("turn", "stratum").limit(max(0, limit))


def pool_receipt(patients: DataFrame, pool: DataFrame, patient: str, condition: str, attributes: list[str]) -> DataFrame:
    """(stratum, candidates, selected)."""
    known = patients.where(" and ".join(f"`{a}` is not null" for a in attributes)).dropDuplicates([patient])
    stratum = F.concat_ws("|", F.coalesce(F.col(condition).cast("string"), F.lit("unconditioned")), *[F.col(a).cast("string") for a in attributes])
    candidates = known.groupBy(stratum.alias("stratum")).agg(F.count("*").alias("candidates"))
    return candidates.join(pool.groupBy("stratum").agg(F.count("*").alias("selected")), "stratum", "left").fillna(0, ["selected"])


def first_slides(slides: DataFrame, pool: DataFrame, patient: str, slide: str, limit: int) -> DataFrame:
    """At most ``limit`` slides of selected patients: the first of each first, then the others in patient order.

    pool: (patient, patient_pos).
    """
    mine = slides.join(pool, patient).withColumn("r", F.row_number().over(Window.partitionBy(patient).orderBy(slide)))
    return mine.orderBy(F.col("r") > 1, "patient_pos", "r").limit(limit)


def cap_per(df: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each key; 0 keeps all."""
    if k == 0:
        return df
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def cap_slides(slides: DataFrame, order: str, k: int, zero_keeps_all: bool) -> DataFrame:
    """The first ``k`` slides; whether 0 means all or none is the caller's convention."""
    return slides if k == 0 and zero_keeps_all else slides.orderBy(order).limit(max(0, k))


def permuted(df: DataFrame, key: str, attribute: str, seed: int = 42) -> DataFrame:
    """(key, attribute) with the attribute's values dealt out anew, marginals kept.

    Rows are numbered twice, by hash of the key and by hash under the seed, each inside hash buckets with offsets.
    """
    known = df.where(F.col(attribute).isNotNull()).select(key, attribute)
    to = numbered(known.withColumn("_g", F.lit(0)), ["_g"], hash_rank("key", F.col(key)), key, "_at")
    of = numbered(known.withColumn("_g", F.lit(0)), ["_g"], hash_rank(seed, F.lit(attribute), F.col(key)), key, "_at")
    return to.select(key, "_at").join(of.select("_at", attribute), "_at").drop("_at")


def global_index(rows: DataFrame, shard: str, order: list[str], out: str = "tile_index") -> DataFrame:
    """``rows`` numbered through all shards in the order of their names: shard offset + place in shard."""
    sizes = rows.groupBy(shard).agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy(shard)) - F.col("_n")).drop("_n")  # a row for each shard
    inside = F.row_number().over(Window.partitionBy(shard).orderBy(*order)) - 1
    return rows.withColumn("_inside", inside).join(offsets, shard).withColumn(out, F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def class_weights(df: DataFrame, label: str, classes: list, absent: float) -> DataFrame:
    """(class, weight): inverse frequency, mean 1 over the classes present; ``absent`` for the others."""
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"))
    mean = counts.agg(F.avg(1 / F.col("n")).alias("mean"))
    known = counts.crossJoin(F.broadcast(mean)).select("class", (1 / F.col("n") / F.col("mean")).alias("weight"))
    kind = df.schema[label].dataType.simpleString()
    every = df.sparkSession.createDataFrame([(c,) for c in classes], f"class {kind}")
    return every.join(known, "class", "left").fillna(absent, ["weight"])


#: Classes whose counts are broadcast at most; more of them are joined by a shuffle.
BROADCAST_CLASSES = 1_000_000


def tile_weights(tiles: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """``tiles`` with 1 / n of the class, the mean of those where the class is unknown, scaled to mean 1."""
    counts = tiles.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_n"))
    # The mean over known tiles of 1 / n is classes / known tiles; that over all tiles is then the same number.
    mean = counts.agg(F.coalesce(F.count("*") / F.sum("_n"), F.lit(1.0)).alias("_mean"))
    # Dealt by class, all tiles would go to as few tasks as there are classes.
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_CLASSES else counts
    return tiles.join(counts, label, "left").crossJoin(F.broadcast(mean)).withColumn(out, F.coalesce(1 / F.col("_n"), F.col("_mean")) / F.col("_mean")).drop("_n", "_mean")


#: Rows of a bucket of weights, about, and bits of a row's weight below the sum of all.
BUCKET_ROWS, WEIGHT_BITS = 64, 50


def resampled(df: DataFrame, key: str, weight: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows with replacement, each draw of a row with its share of the weights.

    Rows lie on a line in the order of their hashes, each as long as its weight; draws are hashed points on it.  A point
    finds its bucket by cells of equal length, and its row by comparing it with the few of the bucket; places of
    buckets are summed up in two levels, so nothing is sorted as a whole.  Weights are whole numbers of 50 bits together: a
    smaller share is never drawn. Rows with a null key or weight, or one not above 0, are not drawn; without any, none are.
    """
    df = df.where((F.col(weight) > 0) & F.col(key).isNotNull())
    found = df.agg(F.sum(weight).alias("total"), F.count("*").alias("rows")).first()
    bits = bucket_bits(found["rows"], BUCKET_ROWS)
    scale = 2.0 ** (WEIGHT_BITS - math.ceil(math.log2(found["total"]))) if found["rows"] else 1.0
    number = hash_number(seed, F.lit("draw"), F.col(key))
    items = df.withColumns({"_w": F.round(F.col(weight) * scale).cast("long"), "_bucket": F.shiftright(number, 52 - bits)}).where("_w > 0")

    sums = items.groupBy("_bucket").agg(F.sum("_w").alias("_sum"))
    buckets = before_buckets(sums, [], "_sum", bits, "_low", ["_sum"])
    total = items.agg(F.coalesce(F.sum("_w"), F.lit(0)).alias("t")).first()["t"]  # without hashes or buckets
    width = max(1, total >> bits)
    cell = lambda x: F.expr(f"({x}) div {width}")
    cells = buckets.select("_bucket", "_low", "_sum", F.explode(F.sequence(cell("_low"), cell("_low + _sum - 1"))).alias("_cell"))
    points = df.sparkSession.range(n if total else 0).select((hash_number(seed, F.lit("point"), F.col("id")) % max(1, total)).alias("_at"))
    placed = points.withColumn("_cell", cell("_at")).join(cells, "_cell").where("_at >= _low and _at < _low + _sum").select("_bucket", (F.col("_at") - F.col("_low")).alias("_at"))
    order = Window.partitionBy("_bucket").orderBy("_rank", key)
    # Hashes to order by are longer than the rows, so they are made where these have gone and do not go with them.
    dealt = items.repartition("_bucket").withColumn("_rank", hash_rank(seed, F.lit("draw"), F.col(key)))
    ends = dealt.withColumn("_end", F.sum("_w").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    drawn = placed.join(ends, "_bucket").where("_at < _end and _at >= _end - _w")
    return drawn.select(*df.columns)

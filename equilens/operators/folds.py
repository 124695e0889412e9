"""Deterministic splits and folds: they depend on seed and id alone, never on order or partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_rank(seed: int | str, *parts: Column) -> Column:
    """sha256 of "seed:part:..." in hexadecimal, to order by."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"), 256)


def hash_number(seed: int | str, *parts: Column) -> Column:
    """52 bits of the same hash as a whole number."""
    return F.conv(F.substring(hash_rank(seed, *parts), 1, 13), 16, 10).cast("long")


def split_fraction(seed: int | str, patient: Column) -> Column:
    """0 up to 1."""
    return hash_number(seed, patient) / F.lit(float(1 << 52))


def train_validation(df: DataFrame, patient: str, val_fraction: float, seed: int = 42) -> DataFrame:
    """``df`` with ``is_train``."""
    return df.withColumn("is_train", split_fraction(seed, F.col(patient)) >= val_fraction)


#: Rows of a bucket of hashes, about.
BUCKET_ROWS = 4096


def bucket_bits(rows: int, bucket_rows: int) -> int:
    """Bits of a hash that cut so many rows into buckets of about ``bucket_rows``."""
    return max(0, rows // bucket_rows).bit_length()


def before_buckets(sums: DataFrame, keys: list[str], amount: str, bits: int, out: str, also: list[str] | None = None) -> DataFrame:
    """(keys, _bucket, also, out): what lies in the buckets before, inside ``keys``; summed up in two levels, each of the root of the buckets."""
    sums = sums.withColumn("_upper", F.shiftright("_bucket", bits // 2))
    over = lambda by, order: F.sum(amount).over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(order)) - F.col(amount)
    uppers = sums.groupBy(*keys, "_upper").agg(F.sum(amount).alias(amount)).withColumn("_lower", over(keys, "_upper")).drop(amount)
    inside = sums.withColumn("_inside", over([*keys, "_upper"], "_bucket"))
    return inside.join(uppers, [*keys, "_upper"]).select(*keys, "_bucket", *(also or []), (F.col("_lower") + F.col("_inside")).alias(out))


def numbered(df: DataFrame, keys: list[str], rank: Column, tie: str, out: str = "position") -> DataFrame:
    """``df`` with 0-based positions by (rank, tie) inside ``keys``, without a window over a whole stratum.

    rank: hexadecimal digits of a hash. Its first bits make buckets, the more the more rows there are, so a bucket has about
    BUCKET_ROWS rows at any size; positions inside a bucket are offset by the rows of the buckets before it.
    """
    bits = bucket_bits(df.count(), BUCKET_ROWS)
    bucket = F.shiftright(F.conv(F.substring(rank, 1, 13), 16, 10).cast("long"), 52 - bits)
    df = df.withColumns({"_rank": rank, "_bucket": bucket})
    before = before_buckets(df.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n")), keys, "_n", bits, "_before")
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy("_rank", tie)) - 1
    return df.withColumn("_inside", inside).join(before, [*keys, "_bucket"]).withColumn(out, F.col("_before") + F.col("_inside")).drop("_rank", "_bucket", "_inside", "_before")


def stratified_folds(patients: DataFrame, patient: str, label: str, race: str, task: str, n_splits: int = 5, seed: int = 42) -> DataFrame:
    """``patients`` with a label, with ``fold``.

    Of each label, every race with at least n_splits patients is a stratum and all others together are one; a stratum
    is dealt round-robin in hash order from a hashed offset.
    """
    known = patients.where(F.col(label).isNotNull()).withColumn("_race", F.coalesce(F.nullif(F.col(race), F.lit("")), F.lit("__missing__")))
    sizes = known.groupBy(label, "_race").agg((F.count("*") >= n_splits).alias("_dense"))
    strata = known.join(sizes, [label, "_race"]).withColumn("_stratum", F.when(F.col("_dense"), F.col("_race")).otherwise("__sparse__"))
    dealt = numbered(strata, [label, "_stratum"], hash_rank(seed, F.lit(task), F.col(patient)), patient)
    offset = hash_number(seed, F.lit(task), F.col(label), F.col("_stratum")) % n_splits
    return dealt.withColumn("fold", ((F.col("position") + offset) % n_splits).cast("int")).drop("_race", "_dense", "_stratum", "position")


def too_small(patients: DataFrame, label: str, n_splits: int = 5) -> DataFrame:
    """Classes with fewer patients than folds; the folds of such a task are not to be used."""
    return patients.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).where(F.col("n") < n_splits)


def k_folds(df: DataFrame, patient: str, label: str, k: int = 5, seed: int = 42, inside: list[str] | None = None) -> DataFrame:
    """``df`` with ``fold``: stratified by label; ``inside`` other keys, k falls to the minority class's count, 2 at least."""
    keys = inside or []
    counts = df.groupBy(*keys, label).agg(F.count("*").alias("_n"))
    least = counts.groupBy(*keys).agg(F.greatest(F.lit(2), F.least(F.lit(k), F.min("_n"))).alias("_k"))
    dealt = numbered(df, [*keys, label], hash_rank(seed, F.col(patient)), patient)
    dealt = dealt.join(least, keys) if keys else dealt.crossJoin(F.broadcast(least))
    return dealt.withColumn("fold", (F.col("position") % F.col("_k")).cast("int")).drop("position", "_k")

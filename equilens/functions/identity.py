"""Patient and slide identities, and digests of id sets and payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns of patient barcodes.
STEM = r"^(TCGA-\w\w-\w{4})"
STRICT = r"^(TCGA-[A-Za-z0-9]{2}-[A-Za-z0-9]{4})"


def patient_of_path(path: Column) -> Column:
    """First three parts of the first folder."""
    return F.substring_index(F.substring_index(path, "/", 1), "-", 3)


def patient_of_slide(path: Column) -> Column:
    """First three parts of the base name, null for fewer."""
    base = F.substring_index(path, "/", -1)
    return F.when(F.size(F.split(base, "-")) >= 3, F.substring_index(base, "-", 3))


def patient_of_file(stem: Column, case_id: Column, slide_path: Column) -> Column:
    """From the file name, else the case id, else the slide, else the stem."""
    return F.coalesce(F.nullif(F.regexp_extract(stem, STEM, 1), F.lit("")), case_id, patient_of_slide(slide_path), stem)


def strict_patient(text: Column, fail: bool = False) -> Column:
    """The barcode that starts the text; null, or an error, for anything else."""
    found = F.nullif(F.regexp_extract(text, STRICT, 1), F.lit(""))
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no patient barcode: "), F.coalesce(text, F.lit("null"))))) if fail else found


def compact_id(*parts: Column) -> Column:
    """63 bits (X6)."""
    return F.xxhash64(*parts).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def site_code(patient: Column) -> Column:
    """Second part of the id of a patient with the program's prefix."""
    parts = F.split(patient, "-")
    return F.when((F.get(parts, F.lit(0)) == "TCGA") & (F.size(parts) >= 2), F.get(parts, F.lit(1)))


def bucketed_digest(df: DataFrame, line: Column, order: Column, bucket: Column, by: list[str] | None = None) -> DataFrame:
    """(by, n, sha256): the rows' lines in order, digested by bucket, then the buckets' digests in order; for sets of any size.

    Buckets are the caller's and have to be of bounded size; an empty set has no row where there are groups.
    """
    keys = by or []
    lines = df.select(*keys, bucket.alias("_bucket"), F.struct(order.alias("o"), line.alias("l")).alias("_line"))
    joined = lambda rows: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda s: s["l"]), "\n").cast("binary"), 256)
    parts = lines.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"), joined("_line").alias("_digest"))
    of_buckets = F.struct(F.col("_bucket").alias("o"), F.col("_digest").alias("l"))
    return parts.groupBy(*keys).agg(F.sum("_n").alias("n"), joined(of_buckets).alias("sha256"))


def id_set_digest(df: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """(by, n, sha256) of the distinct ids, whatever their order, in 4,096 buckets by the digest of the id."""
    ids = df.select(*(by or []), F.col(key).cast("string").alias("_id")).where("_id is not null").distinct()
    return bucketed_digest(ids, F.col("_id"), F.col("_id"), F.substring(F.sha2(F.col("_id").cast("binary"), 256), 1, 3), by)


def payload_digest(df: DataFrame, order: str, key: str, payload: str, per: str, rows: int = 4096) -> DataFrame:
    """(per, n, sha256) over place, id, length and payload digest of every row in order, by ranges of ``rows`` places."""
    line = F.concat_ws("\t", F.col(order).cast("string"), F.col(key), F.length(payload).cast("string"), F.sha2(payload, 256))
    return bucketed_digest(df, line, F.col(order), F.floor(F.col(order) / rows), [per])


def last_wins(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One row per key, that with the largest ordinal."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ordinal)))).where("_r = 1").drop("_r")

"""Order MinHash fingerprints with Spark expressions only.

A text's tokens (runs of at most 16 characters that are not white space) give k-mers of K tokens, each numbered by
its occurrence in the text.  One hash of (k-mer, occurrence) both deals the k-mers to BINS bins and orders them
there; of each bin the L smallest are kept, put back into text order, and their tuple is hashed.  Two texts agree in
a bin if they share those k-mers in that order, so likeness falls with rearrangement as well as with replacement.

k-mer hash (36 bits) and position (27 bits) share one long, so that sorting works on plain numbers.

Defined results: null text counts as empty; an empty text, or one of white space, has an empty fingerprint; a text
with fewer than K tokens has its whole sequence as one k-mer; equal texts have equal fingerprints; two empty
fingerprints have likeness 1, an empty and another 0; existing columns with the outputs' names are replaced, all
others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import without

K, L, BIN_BITS = 3, 2, 6
HASH_BITS, PLACE_BITS = 36, 27
HASH, PLACE = (1 << HASH_BITS) - 1, (1 << PLACE_BITS) - 1
#: Documents of a bucket in which neighbours are found, on average, and the most buckets.
BUCKET_ROWS, MOST_BUCKETS = 2048, 10_000


def packed(of: Column, place: Column) -> Column:
    return F.shiftleft(of.bitwiseAND(F.lit(HASH)), PLACE_BITS).bitwiseOR(place.cast("long"))


def hash_of(x: Column) -> Column:
    return F.shiftright(x, PLACE_BITS)


def starts(array: str, key=hash_of) -> Column:
    """Indexes at which a new run of equal keys begins; an empty array for an empty one."""
    a = F.col(array)
    runs = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (key(F.get(a, i - 1)) != key(F.get(a, i))))
    return F.when(F.size(a) > 0, runs).otherwise(F.array().cast("array<int>"))


def fingerprint(df: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with ``out``: array of long, one for each bin in use, the bin above the lower 32 bits."""
    text = F.coalesce(df[text_col], F.lit(""))
    a = F.col("_a")
    short = F.when(F.size(a) > 0, F.array(packed(F.xxhash64(a), F.lit(0)))).otherwise(F.array().cast("array<bigint>"))
    heads = F.slice(a, 1, F.greatest(F.size(a) - (K - 1), F.lit(0)))
    kmers = F.transform(heads, lambda w, i: packed(F.xxhash64(w, *[F.get(a, i + j) for j in range(1, K)]), i))
    numbered = lambda x, n: packed(F.xxhash64(hash_of(x), n.cast("int")), x.bitwiseAND(F.lit(PLACE)))
    bin_of = lambda x: F.shiftright(x, HASH_BITS + PLACE_BITS - BIN_BITS)
    # No column is defined anew under a name in use: a lambda beside it would see the new one.
    b, c, again, runs, kept, bins = F.col("_b"), F.col("_c"), F.col("_again"), F.col("_runs"), F.col("_kept"), F.col("_bins")

    def later(start: Column, j: Column) -> Column:
        """Second and further occurrences of one k-mer."""
        end = F.coalesce(F.get(runs, j + 1), F.size(again))
        return F.transform(F.slice(again, start + 1, end - start), lambda x, n: numbered(x, n + 1))

    def of_bin(start: Column, j: Column) -> Column:
        end = F.coalesce(F.get(bins, j + 1), F.size(kept))
        in_order = F.sort_array(F.transform(F.slice(kept, start + 1, end - start), lambda x: F.shiftleft(x.bitwiseAND(F.lit(PLACE)), HASH_BITS).bitwiseOR(hash_of(x))))
        tuple_hash = F.xxhash64(F.transform(in_order, lambda x: x.bitwiseAND(F.lit(HASH))))
        return F.shiftleft(bin_of(F.get(kept, start)), 32).bitwiseOR(tuple_hash.bitwiseAND(F.lit(0xFFFFFFFF)))

    df = without(df, out)
    df = df.withColumn("_a", F.regexp_extract_all(text, F.lit(r"\S{1,16}"), F.lit(0)))
    df = df.withColumn("_b", F.sort_array(F.when(F.size(a) >= K, kmers).otherwise(short))).drop("_a")
    df = df.withColumns({"_again": F.filter(b, lambda x, i: hash_of(F.get(b, i - 1)) == hash_of(x)), "_first": F.filter(b, lambda x, i: (i == 0) | (hash_of(F.get(b, i - 1)) != hash_of(x)))})
    df = df.withColumn("_runs", starts("_again"))
    df = df.withColumn("_c", F.sort_array(F.concat(F.transform("_first", lambda x: numbered(x, F.lit(0))), F.flatten(F.transform(runs, later)))))
    df = df.withColumn("_kept", F.filter(c, lambda x, i: (i < L) | (bin_of(F.get(c, i - L)) != bin_of(x)))).drop("_b", "_first", "_again", "_runs", "_c")
    df = df.withColumn("_bins", starts("_kept", key=bin_of))
    return df.withColumn(out, F.transform(bins, of_bin)).drop("_kept", "_bins")


def as_text(fingerprint_col: Column) -> Column:
    """Ten hexadecimal digits for each bin in use."""
    return F.array_join(F.transform(fingerprint_col, lambda v: F.lpad(F.lower(F.hex(v)), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Bins that agree, as a part of the bins that either uses."""
    used = lambda x: F.transform(x, lambda v: F.shiftright(v, 32))
    either = F.size(F.array_union(used(a), used(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def bucket_of(docs: DataFrame, id_col: str) -> Column:
    """Buckets of about BUCKET_ROWS rows each, ascending with the id, which has to be a number; a null id is in the first."""
    rows = docs.count()
    buckets = min(MOST_BUCKETS, -(-rows // BUCKET_ROWS))
    if buckets < 2:
        return F.lit(0)
    at = [i / buckets for i in range(1, buckets)]
    found = docs.agg(F.percentile_approx(id_col, at, 20 * buckets).alias("at")).first()["at"]
    bounds = sorted(set(found or []))
    if not bounds:
        return F.lit(0)
    wide = max(1, round(len(bounds) ** 0.5))
    table = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    up_to = lambda values: F.size(F.filter(values, lambda x: x <= F.col(id_col)))
    row = up_to(F.array(*[F.lit(t[0]) for t in table]))
    literal = F.array(*[F.array(*[F.lit(x) for x in t]) for t in table])
    return F.when(row == 0, 0).otherwise((row - 1) * wide + up_to(F.get(literal, row - 1)))


def with_ends(docs: DataFrame, id_col: str) -> DataFrame:
    """``docs`` and, marked by ``_end``, a copy of the first row of every bucket in the bucket before it; the last bucket gets that of the first.

    So the row that follows another by (id, text hash) is found inside a bucket. Expects columns ``_order`` (text hash)
    and ``_bucket``.
    """
    spark = docs.sparkSession
    firsts = docs.groupBy("_bucket").agg(F.min(F.struct(F.col(id_col).alias("id"), "_order")).alias("first")).orderBy("_bucket").collect()  # MOST_BUCKETS rows at most
    moved = [(firsts[i - 1]["_bucket"], f["_bucket"], f["first"]["id"], f["first"]["_order"]) for i, f in enumerate(firsts)]
    kind = docs.schema[id_col].dataType.simpleString()
    table = F.broadcast(spark.createDataFrame(moved, f"_to int, _from int, _id {kind}, _key long"))
    ends = docs.join(table, docs[id_col].eqNullSafe(table["_id"]) & (docs["_order"] == table["_key"]) & (docs["_bucket"] == table["_from"])).dropDuplicates(["_to"])
    ends = ends.withColumn("_bucket", F.col("_to")).drop("_to", "_from", "_id", "_key")
    return docs.withColumn("_end", F.lit(0)).unionByName(ends.withColumn("_end", F.lit(1)))


def with_next(docs: DataFrame, id_col: str, carried: list[str]) -> DataFrame:
    """What ``with_ends`` gives, without the copies and with next_<column> of the row that follows."""
    order = Window.partitionBy("_bucket").orderBy("_end", F.col(id_col).asc_nulls_first(), "_order")
    return docs.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried}).where("_end = 0").drop("_end")


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text with its edited text (second half from the next document): ``id_col``, n_chars, edited, fingerprints, likenesses."""
    base = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    base = base.withColumns({"_order": F.xxhash64("text"), "_bucket": bucket_of(base, "id").cast("int")})
    pairs = with_next(fingerprint(with_ends(base, "id"), "text", "own"), "id", ["text", "own"])
    half = (F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - half), F.substring("next_text", F.lit(1), half))
    out = fingerprint(pairs.select("id", F.char_length("text").cast("long").alias("n_chars"), edited.alias("edited"), "own", "next_own"), "edited", "other")
    return out.select(
        F.col("id").alias(id_col), "n_chars", "edited",
        F.col("own").alias("fingerprint"), F.col("other").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )

"""Batch embedding by a caller's model, and an incremental store of embeddings keyed by content."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import bucketed_digest

#: Takes a list of payloads, returns an array of vectors, or None in place of one that failed.
EmbedFn = Callable[[list[bytes]], list]
STORED = "content_key string, vector array<float>, payload_bytes int, batch string, model_key string"


def embed(df: DataFrame, payload: str, embed_fn: EmbedFn, out: str = "vector", batch: int = 64) -> DataFrame:
    """``df`` with vectors; a null payload or a failure gives null (M8)."""

    @F.pandas_udf("array<float>")
    def vectors(payloads: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in payloads:
            found: list = [None] * len(series)
            at = [i for i, p in enumerate(series) if p is not None]
            for i in range(0, len(at), batch):
                part = at[i : i + batch]
                for j, v in zip(part, embed_fn([series.iloc[k] for k in part]), strict=True):
                    found[j] = None if v is None else np.asarray(v, np.float32)
            yield pd.Series(found, dtype=object)

    # Not deterministic as far as the optimiser knows: else a filter on the vector would run the model a second time.
    return df.withColumn(out, vectors.asNondeterministic()(F.col(payload)))


def with_key(df: DataFrame, model_key: str, config: str, payload: str) -> DataFrame:
    """``df`` with ``content_key``: digest of model, configuration and payload."""
    return df.withColumn("content_key", F.sha2(F.concat(F.lit(f"{model_key}\n{config}\n").cast("binary"), F.col(payload)), 256))


def _at(spark: SparkSession, path: str) -> tuple:
    """(file system, path) as Spark's own writers see them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def committed(spark: SparkSession, path: str) -> list[str]:
    """Batches of a store that are whole, in order: each has a file in its manifest."""
    system, where = _at(spark, f"{path}/committed")
    return sorted(s.getPath().getName() for s in system.listStatus(where)) if system.exists(where) else []


def append(entries: DataFrame, path: str, batch: str | None = None) -> str:
    """Add a batch to a store: its entries are written first, then it is committed. A batch of a name that is committed is not written again.

    Entries lie in the order of their keys, so a look-up reads the parts of files that can hold them.
    """
    spark, batch = entries.sparkSession, batch or uuid.uuid4().hex
    if batch not in committed(spark, path):
        rows = entries.select("content_key", "vector", "payload_bytes", "model_key")
        rows.repartition("content_key").sortWithinPartitions("model_key", "content_key").write.mode("overwrite").partitionBy("model_key").parquet(f"{path}/entries/batch={batch}")
        system, where = _at(spark, f"{path}/committed/{batch}")
        system.createNewFile(where)
    return batch


def store(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored embeddings, one for each model and content, or None before the first batch.

    Batches that did not end are not seen. Where several hold a content, since runs overlapped or were repeated, the first
    of the manifest counts.
    """
    batches = committed(spark, path)
    if not batches:
        return None
    found = spark.read.schema(STORED).option("basePath", f"{path}/entries").parquet(*[f"{path}/entries/batch={b}" for b in batches])
    if len(batches) == 1:
        return found.drop("batch")
    first = F.min_by(F.struct("vector", "payload_bytes"), "batch").alias("e")
    return found.groupBy("model_key", "content_key").agg(first).select("content_key", "e.vector", "e.payload_bytes", "model_key")


def embed_new(df: DataFrame, path: str, model_key: str, config: str, payload: str, embed_fn: EmbedFn, batch: str | None = None) -> DataFrame:
    """All rows with their vector; only contents that the store lacks are embedded and added (M9).

    Keys alone meet the store in the join; payloads are read for what is missing, once for each content. Runs may overlap
    and be repeated: no row of ``df`` gets more than one vector.
    """
    spark = df.sparkSession
    keyed = with_key(df.where(F.col(payload).isNotNull()), model_key, config, payload)
    known = store(spark, path)
    missing = keyed.select("content_key", payload).dropDuplicates(["content_key"])
    if known is not None:
        missing = missing.join(known.where(F.col("model_key") == model_key).select("content_key"), "content_key", "left_anti")
    fresh = embed(missing, payload, embed_fn).where("vector is not null")
    append(fresh.select("content_key", "vector", F.length(payload).alias("payload_bytes"), F.lit(model_key).alias("model_key")), path, batch)
    stored = store(spark, path).where(F.col("model_key") == model_key).select("content_key", "vector")
    return keyed.join(stored, "content_key", "left")


def reuse_violations(df: DataFrame, stored: DataFrame, model_key: str, config: str, payload: str, key: str) -> DataFrame:
    """(key, problem) of rows whose stored vector may not be used again: absent, of another payload length, not finite (V9).

    The key of a stored vector is the digest of model, configuration and payload, so a changed payload is an absent one.
    """
    own = stored.where(F.col("model_key") == model_key).select("content_key", "vector", "payload_bytes")
    both = with_key(df.where(F.col(payload).isNotNull()), model_key, config, payload).join(own, "content_key", "left")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    problem = F.when(F.col("vector").isNull(), "absent").when(F.col("payload_bytes") != F.length(payload), "payload length").when(~finite, "not finite")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def entry_digest(stored: DataFrame, model_key: str) -> DataFrame:
    """(n, sha256) of a model's entries in the order of their keys, bucket by bucket (V9)."""
    own = stored.where(F.col("model_key") == model_key)
    line = F.concat_ws("\t", "content_key", F.col("payload_bytes").cast("string"), F.sha2(F.array_join(F.transform("vector", lambda x: x.cast("string")), ",").cast("binary"), 256))
    return bucketed_digest(own, line, F.col("content_key"), F.substring("content_key", 1, 3))


def store_violations(stored: DataFrame, dimension: int) -> DataFrame:
    """(content_key, problem): repeated keys, wrong dimension, non-finite components (V9)."""
    repeated = stored.groupBy("content_key", "model_key").count().where("count > 1").select("content_key", F.lit("repeated").alias("problem"))
    sized = stored.where(F.size("vector") != dimension).select("content_key", F.lit("dimension").alias("problem"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    broken = stored.where(~finite).select("content_key", F.lit("not finite").alias("problem"))
    return repeated.unionByName(sized).unionByName(broken)

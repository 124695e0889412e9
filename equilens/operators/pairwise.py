"""Pooled vectors, prototypes, and objectives over pairs inside bounded blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import EPS, normalised

#: Rows of a block on average; work is quadratic inside a block only.
BLOCK_ROWS = 256


def mean_vectors(df: DataFrame, keys: list[str], vector: str, out: str = "vector") -> DataFrame:
    """(keys, out, n): component means in double precision; null vectors are left out (A1).

    A vector stays one value all the way, summed up before the shuffle and after it.
    """
    rows = df.where(F.col(vector).isNotNull()).select(*keys, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    found = rows.groupBy(*keys).agg(Summarizer.metrics("mean", "count").summary(F.col("_v")).alias("_s"))
    return found.select(*keys, vector_to_array("_s.mean").alias(out), F.col("_s.count").alias("n"))


def mean_scores(tiles: DataFrame, keys: str | list[str], score: str) -> DataFrame:
    """(keys, score, n_tiles): tiles without a score are left out (A2)."""
    return tiles.where(F.col(score).isNotNull()).groupBy(keys).agg(F.avg(score).alias(score), F.count("*").alias("n_tiles"))


def prototypes(df: DataFrame, cls: str, vector: str, condition: str | None = None) -> DataFrame:
    """(condition, class, prototype, n): normalised means; rows without a condition go to the marginal bank, condition null."""
    keys = [condition, cls] if condition else [cls]
    known = df.where(F.col(cls).isNotNull())
    return mean_vectors(known, keys, vector, "_mean").select(*keys, normalised(F.col("_mean")).alias("prototype"), "n")


#: Batch numbers of a range in which places of batches are counted.
RANGE = 4096


def places(batches: DataFrame, cls: str, batch: str) -> DataFrame:
    """(class, batch) with ``_after``, how many batches of the class follow, and ``_first``: counted in ranges of numbers, then over ranges."""
    ranged = batches.withColumn("_range", F.floor(F.col(batch) / RANGE))
    up_to = lambda *keys, by: Window.partitionBy(*keys).orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(cls, "_range").agg(F.count("*").alias("_n"), F.min(batch).alias("_low"))
    lowest = F.min("_low").over(Window.partitionBy(cls))
    beyond = sizes.select(cls, "_range", F.coalesce(F.sum("_n").over(up_to(cls, by="_range")), F.lit(0)).alias("_beyond"), lowest.alias("_low"))
    inside = ranged.withColumn("_inside", F.count("*").over(up_to(cls, "_range", by=batch)))
    return inside.join(beyond, [cls, "_range"]).select(cls, batch, (F.col("_beyond") + F.col("_inside")).alias("_after"), (F.col(batch) == F.col("_low")).alias("_first"))


def moving_prototypes(df: DataFrame, cls: str, batch: str, vector: str, ema: float, renormalise: bool = False) -> DataFrame:
    """(class, prototype): batch means in the order of batch numbers, the first copied, then ema * p + (1 - ema) * mean.

    Plainly, a mean counts ema ^ (batches after it), all but the first times 1 - ema; these weights sum to 1, so it is
    one weighted sum whatever the order. Renormalised after every batch it is a walk: means stream in order past one vector.
    """
    means = mean_vectors(df, [cls, batch], vector, "_m").drop("n")
    if not renormalise:
        weight = F.pow(F.lit(float(ema)), F.col("_after")) * F.when(F.col("_first"), 1.0).otherwise(1.0 - ema)
        weighted = means.join(places(means.select(cls, batch), cls, batch), [cls, batch]).select(cls, array_to_vector("_m").alias("_v"), weight.alias("_w"))
        return weighted.groupBy(cls).agg(vector_to_array(Summarizer.mean(F.col("_v"), F.col("_w"))).alias("prototype"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, p = None, None
        unit = lambda v: v / max(np.linalg.norm(v), EPS)
        for rows in batches:
            for key, mean in zip(rows[cls], rows["_m"], strict=True):
                if p is not None and key != at:
                    yield pd.DataFrame({cls: [at], "prototype": [p]})
                    p = None
                at, p = key, unit(np.array(mean)) if p is None else unit(ema * p + (1 - ema) * unit(np.array(mean)))
        if p is not None:
            yield pd.DataFrame({cls: [at], "prototype": [p]})

    known = means.where(F.col(cls).isNotNull())
    return known.repartition(cls).sortWithinPartitions(cls, batch).mapInPandas(walk, f"{cls} {df.schema[cls].dataType.simpleString()}, prototype array<double>")


def blocks(df: DataFrame, key: str, n_rows: int | None = None) -> DataFrame:
    """``df`` with ``block``: hash buckets of BLOCK_ROWS rows on average."""
    n = df.count() if n_rows is None else n_rows
    return df.withColumn("block", F.pmod(F.xxhash64(key), F.lit(max(1, -(-n // BLOCK_ROWS)))))


def _log_softmax(v: np.ndarray, temperature: float, allowed: np.ndarray) -> np.ndarray:
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), EPS)
    logits = np.where(allowed, unit @ unit.T / temperature, -np.inf)
    top = logits.max(axis=1, keepdims=True, initial=-np.inf, where=allowed)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return logits - top - np.log(np.exp(logits - top).sum(axis=1, keepdims=True))


#: Which pairs of rows are positives, from "other attribute value" and "same condition" of each pair.
RELATIONS = {
    "same": lambda other, alike: ~other,
    "different": lambda other, alike: other,
    "same_condition_different": lambda other, alike: other & alike,
}


def contrastive_anchors(df: DataFrame, key: str, vector: str, sensitive: str, relation: str = "different", condition: str | None = None, temperature: float = 0.2, consistent: bool = False) -> DataFrame:
    """(block, key, loss) of every anchor that has a positive (M10); ``df`` has ``block`` (see ``blocks``).

    Rows without sensitive value, or condition where one is named, are left out (F6).  ``consistent`` limits the
    denominator to positives and same-condition rows of the anchor's own group, and asks for both (M11).
    """
    if relation not in RELATIONS:
        raise ValueError(f"unknown relation {relation}")
    needed = [vector, sensitive, *([condition] if condition else [])]
    kind = df.schema[key].dataType.simpleString()

    def of_block(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.array(pdf["v"].tolist(), float)
        s = pdf["s"].to_numpy()
        c = pdf["c"].to_numpy() if condition else None
        self_ = np.eye(len(v), dtype=bool)
        other = s[:, None] != s[None, :]
        positive = RELATIONS[relation](other, c[:, None] == c[None, :] if condition else True) & ~self_
        allowed = ~self_
        if consistent:
            negative = ~other & ~self_
            negative &= (c[:, None] == c[None, :]) if condition else True
            allowed = (positive | negative) & negative.any(axis=1, keepdims=True)
            positive = positive & allowed
        valid = positive.any(axis=1)
        if not valid.any():
            return pd.DataFrame({"block": [], "key": [], "loss": []})
        logp = np.where(positive, _log_softmax(v, temperature, allowed), 0.0)
        loss = -logp.sum(axis=1) / np.maximum(positive.sum(axis=1), 1)
        return pd.DataFrame({"block": pdf["block"], "key": pdf["key"], "loss": loss})[valid]

    rows = df.dropna(subset=needed).select("block", F.col(key).alias("key"), F.col(vector).alias("v"), F.col(sensitive).alias("s"), (F.col(condition) if condition else F.lit(None).cast("string")).alias("c"))
    return rows.groupBy("block").applyInPandas(of_block, f"block long, key {kind}, loss double").withColumnRenamed("key", key)


def contrastive_loss(anchors: DataFrame, weights: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """One row (loss, anchors): mean, or mean by anchor weights >= 0; 0 where nothing is valid."""
    if weights is None:
        return anchors.agg(F.coalesce(F.avg("loss"), F.lit(0.0)).alias("loss"), F.count("*").alias("anchors"))
    w = F.when((F.col("weight") >= 0) & ~F.isnan("weight"), F.col("weight")).otherwise(F.raise_error(F.lit("anchor weights must be finite and not negative")).cast("double"))
    both = anchors.join(weights.select(key, w.alias("_w")), key)
    return both.agg(F.coalesce(F.sum(F.col("loss") * F.col("_w")) / F.nullif(F.sum("_w"), F.lit(0.0)), F.lit(0.0)).alias("loss"), F.count("*").alias("anchors"))


def preserving_objective(df: DataFrame, key: str, vector: str, sensitive: str, condition: str, weight: float, temperature: float = 0.2) -> DataFrame:
    """One row (preserve, fair, objective = preserve + weight * fair)."""
    preserve = contrastive_loss(contrastive_anchors(df, key, vector, condition, "same", None, temperature)).select(F.col("loss").alias("preserve"))
    fair = contrastive_loss(contrastive_anchors(df, key, vector, sensitive, "same_condition_different", condition, temperature, True)).select(F.col("loss").alias("fair"))
    return preserve.crossJoin(fair).withColumn("objective", F.col("preserve") + weight * F.col("fair"))


def uniformity(df: DataFrame, vector: str, concentration: float = 5.0) -> DataFrame:
    """One row (loss): mean log of the kernel density of each row among the others of its block."""

    def of_block(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.array(pdf["v"].tolist(), float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), EPS)
        logits = concentration * v @ v.T
        np.fill_diagonal(logits, -np.inf)
        if len(v) < 2:
            return pd.DataFrame({"total": [], "n": []})
        top = logits.max(axis=1)
        return pd.DataFrame({"total": [float((top + np.log(np.exp(logits - top[:, None]).sum(axis=1))).sum())], "n": [len(v)]})

    rows = df.where(F.col(vector).isNotNull()).select("block", F.col(vector).alias("v"))
    return rows.groupBy("block").applyInPandas(of_block, "total double, n long").agg(F.coalesce(F.sum("total") / F.sum("n"), F.lit(0.0)).alias("loss"))

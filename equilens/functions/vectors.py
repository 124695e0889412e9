"""Vector expressions over array columns, and small per-batch image statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """Divided by its length, EPS at least."""
    return F.transform(F.arrays_zip(v.alias("x"), F.array_repeat(F.greatest(norm(v), F.lit(EPS)), F.size(v)).alias("n")), lambda p: p["x"] / p["n"])


def cosine(a: Column, b: Column, temperature: float = 1.0) -> Column:
    """Cosine similarity over a temperature."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(EPS)) * F.greatest(norm(b), F.lit(EPS))) / temperature


def finite_prediction(y: Column, score: Column) -> Column:
    """Label 0 or 1 and a finite score; false for nulls."""
    return F.coalesce(y.isin(0, 1) & ~F.isnan(score) & (F.abs(score) < float("inf")), F.lit(False))


def filled_score(score: Column) -> Column:
    """0.5 for a null or undefined score."""
    return F.coalesce(F.nanvl(score, F.lit(None).cast("double")), F.lit(0.5))


def saturated_part(raw: bytes | None) -> float | None:
    if not raw:
        return None
    rgb = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(float)
    high, low = rgb.max(axis=1), rgb.min(axis=1)
    return float(((high - low) / (high + 1e-6) > 0.07).mean())


def tissue_fraction(pixels: Column) -> Column:
    """Part of the pixels whose saturation is above 0.07 (X19); pixels: flat RGB bytes decoded by the caller."""
    return F.pandas_udf(lambda batch: batch.map(saturated_part), "double")(pixels)

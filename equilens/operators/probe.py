"""Linear probes on vectors, cross-validated and cross-fitted."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import id_set_digest
from .folds import k_folds
from .linear import Model, fit_many, scored
from .metrics import auc_by, macro_auc

#: The grid of inverse regularisation strengths.
C_GRID = [0.001, 0.01, 0.1, 0.3, 1.0, 3.0, 10.0]
PASS_THROUGH = ["patient_id", "y", "fold"]
#: Strength of the probe that looks for an attribute.
LEAKAGE_REG = 1e-3


def features(df: DataFrame, vector: str) -> DataFrame:
    return df.where(F.col(vector).isNotNull()).withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))


def strength(c: float, n: int) -> float:
    """What an inverse strength adds to the mean loss of ``n`` rows."""
    return 1 / (c * n) if n else 0.0


def fold_counts(df: DataFrame) -> dict[int, int]:
    return {r["fold"]: r["count"] for r in df.groupBy("fold").count().collect()}


def grid_models(counts: dict[int, int], outs: Iterable[tuple[int, ...]], grid: Iterable[float]) -> list[Model]:
    """A model for every set of folds left out and, inside it, every strength."""
    return [Model(out, strength(c, sum(n for f, n in counts.items() if f not in out))) for out in outs for c in grid]


def fit_predict(train: DataFrame, test: DataFrame, c: float) -> DataFrame:
    """``test`` with ``score``; classes are balanced by weight; a training side of one class gives null scores (M1).

    The intercept is not regularised here. Both sides: (..., y, features).
    """
    own = train.withColumn("fold", F.lit(0))
    fitted = fit_many(own, grid_models(fold_counts(own), [()], [c]))
    out = scored(test.withColumn("_fold", F.col("fold") if "fold" in test.columns else F.lit(None)).withColumn("fold", F.lit(0)), fitted, {0: [0]}, "_p")
    out = out.withColumn("score", F.col("_p")[0][0]).drop("_p")
    return out.withColumn("fold", F.col("_fold")).drop("_fold") if "fold" in test.columns else out.drop("fold", "_fold")


def out_of_fold(df: DataFrame, c: float, folds: Iterable[int]) -> DataFrame:
    """All rows scored by a model of the other folds."""
    return grid_scores(df, list(folds), [c]).select(*PASS_THROUGH, "score")


def best_first(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The row with the largest auc, the first of the grid for ties (L2). df: (grid_pos, auc, ...)."""
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc_nulls_last("auc"), "grid_pos")
    return df.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def grid_scores(df: DataFrame, folds: list[int], grid: list[float]) -> DataFrame:
    """(grid_pos, c, patient_id, y, fold, score) of all strengths; every model of every fold is fitted in the same passes."""
    fitted = fit_many(df, grid_models(fold_counts(df), [(f,) for f in folds], grid))
    of_fold = {f: list(range(i * len(grid), (i + 1) * len(grid))) for i, f in enumerate(folds)}
    each = scored(df.where(F.col("fold").isin(folds)), fitted, of_fold).select(*PASS_THROUGH, F.posexplode("p").alias("grid_pos", "p"))
    return each.select("grid_pos", F.array(*[F.lit(float(c)) for c in grid])[F.col("grid_pos")].alias("c"), *PASS_THROUGH, F.col("p")[0].alias("score"))


def internal_cv(df: DataFrame, folds: list[int], grid: list[float] = C_GRID) -> DataFrame:
    """Out-of-fold rows of the strength with the best pooled AUROC (M2). df: (patient_id, y, fold, features)."""
    scores = grid_scores(df, folds, grid)
    best = best_first(auc_by(scores.where("score is not null"), ["grid_pos", "c"])).first()
    if best is None:
        return scores.withColumn("auc", F.lit(None).cast("double")).limit(0)
    return scores.where(F.col("grid_pos") == best["grid_pos"]).withColumn("auc", F.lit(best["auc"]))


def external(train: DataFrame, test: DataFrame, folds: list[int], grid: list[float] = C_GRID) -> DataFrame:
    """``test`` scored by a model of all of ``train`` at the strength with the best mean fold AUROC (M3)."""
    scores = grid_scores(train, folds, grid)
    per_fold = auc_by(scores.where("score is not null"), ["grid_pos", "c", "fold"])
    best = best_first(per_fold.groupBy("grid_pos", "c").agg(F.avg("auc").alias("auc"))).first()
    return fit_predict(train, test, best["c"]).withColumn("c", F.lit(best["c"]))


def fitting_folds(df: DataFrame, k: int = 5) -> int:
    """Folds that the smaller class can fill: at most k, at least 2 (M3)."""
    counts = [r["count"] for r in df.groupBy("y").count().collect()]
    return max(2, min([k, *counts]))


def external_folds(train: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """``train`` with ``fold``, as many as its smaller class can fill (M3)."""
    return k_folds(train.drop("fold"), "patient_id", "y", fitting_folds(train, k), seed)


def held_out_fold(df: DataFrame, fold: int, c: float) -> DataFrame:
    """Only the rows of one fold, scored by a model of all others (M4)."""
    return fit_predict(df.where(F.col("fold") != fold), df.where(F.col("fold") == fold), c)


def leakage_auc(df: DataFrame, label: str, folds: list[int]) -> float | None:
    """How well a standardised linear probe finds an attribute in vectors; null below ten rows or for one class (M5).

    df: (label as 0, 1, ..., fold, features). Binary AUROC, or the mean one-vs-rest AUROC for more classes.
    """
    classes = sorted(r[label] for r in df.select(label).distinct().collect())
    if len(classes) < 2 or df.count() < 10:
        return None
    fitted = fit_many(df, [Model((f,), LEAKAGE_REG) for f in folds], label, max(2, int(classes[-1]) + 1), balanced=False, scaled=True)
    out = scored(df.where(F.col("fold").isin(folds)), fitted, {f: [i] for i, f in enumerate(folds)}).select(label, F.col("p")[0].alias("p"))
    out = out.where("p is not null")
    binary = len(classes) == 2 and int(classes[-1]) == 1
    return macro_auc(out, classes[1:] if len(classes) == 2 else classes, label, lambda c: F.col("p")[0 if binary else int(c)]).first()["macro_auc"]


def nested_cross_fit(df: DataFrame, folds: list[int], c: float) -> tuple[DataFrame, DataFrame]:
    """Predictions with roles, and the audit of what each model was trained on (M7).

    For every outer fold k: one model without k scores k; for every other fold j, one without k and j scores j. So each
    patient has one outer and len(folds) - 1 inner rows.
    """
    outs = [(k, j) for k in folds for j in [None, *[f for f in folds if f != k]]]
    left_out = [(k,) if j is None else (k, j) for k, j in outs]
    fitted = fit_many(df, grid_models(fold_counts(df), left_out, [c]))
    # The rows of a fold are scored by the outer model without it and by the inner ones without it and another.
    of_fold = {f: [i for i, (k, j) in enumerate(outs) if (k if j is None else j) == f] for f in folds}
    role = lambda k, j: F.struct(F.lit("outer" if j is None else "inner").alias("prediction_role"), F.lit(k).alias("calibration_outer_fold"), F.lit(j).cast("int").alias("inner_fold"))
    roles = F.coalesce(*[F.when(F.col("fold") == f, F.array(*[role(*outs[i]) for i in of_fold[f]])) for f in folds])
    each = scored(df.where(F.col("fold").isin(folds)), fitted, of_fold).select("patient_id", "y", F.col("fold").alias("original_fold"), F.explode(F.arrays_zip("p", roles.alias("role"))).alias("e"))
    predictions = each.select("patient_id", "y", F.col("e.p")[0].alias("score"), "e.role.prediction_role", "original_fold", "e.role.calibration_outer_fold", "e.role.inner_fold")

    side = F.array(*[F.struct(F.lit(k).alias("outer_fold"), F.lit(j).cast("int").alias("inner_fold"), F.array(*map(F.lit, out)).alias("out")) for (k, j), out in zip(outs, left_out, strict=True)])
    keys = ["outer_fold", "inner_fold"]
    trained = df.select("patient_id", "fold", F.explode(side).alias("s")).where(~F.array_contains("s.out", F.col("fold"))).select("patient_id", "fold", "s.outer_fold", "s.inner_fold")
    seen = trained.groupBy(*keys).agg(F.array_sort(F.collect_set("fold")).alias("folds"), F.count("*").alias("n"))
    digests = id_set_digest(trained.withColumn("_inner", F.coalesce("inner_fold", F.lit(-1))), "patient_id", ["outer_fold", "_inner"]).select("outer_fold", "_inner", F.col("sha256").alias("patients_sha256"))
    audit = seen.withColumn("_inner", F.coalesce("inner_fold", F.lit(-1))).join(digests, ["outer_fold", "_inner"]).drop("_inner")
    return predictions, audit

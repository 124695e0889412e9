"""Many logistic models fitted in the same passes over the rows.

Models differ in the folds they leave out and in their strength.  A pass sums the loss and gradient of every model, and where
that is small enough its matrix of second derivatives, in the tasks; the driver solves one small system a model, so the
number of passes does not depend on how many models there are.  Without second derivatives (many columns or classes) the step
is that of L-BFGS.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Second derivatives of all models that a pass may sum, passes at most, and steps that L-BFGS remembers.
MOST_CELLS, MOST_PASSES, MEMORY = 1 << 23, 200, 10


@dataclass(frozen=True)
class Model:
    """Trained on all folds but ``out``, with ``reg`` / 2 times the squared coefficients added to the mean loss."""

    out: tuple[int, ...]
    reg: float


@dataclass
class Descent:
    """Where one model's search is: a step is taken once its loss is seen to fall, else it is halved."""

    at: np.ndarray
    value: float = np.inf
    slope: float = 0.0
    step: float = 1.0
    direction: np.ndarray | None = None
    gradient: np.ndarray | None = None
    pairs: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    done: bool = False

    @property
    def candidate(self) -> np.ndarray:
        return self.at if self.direction is None else self.at + self.step * self.direction

    def told(self, value: float, gradient: np.ndarray, hessian: np.ndarray | None) -> None:
        if self.direction is not None and not value <= self.value + 1e-4 * self.step * self.slope + 1e-13 * abs(self.value):
            self.step /= 2
            self.done = self.step < 1e-9
            return
        if self.direction is not None:
            self.pairs = [*self.pairs[1 - MEMORY :], (self.step * self.direction, gradient - self.gradient)]
        self.at, self.value, self.gradient = self.candidate, value, gradient
        self.direction = self.quasi_newton() if hessian is None else -np.linalg.solve(hessian + 1e-13 * np.trace(hessian) * np.eye(len(hessian)), gradient)
        self.slope, self.step = float(gradient @ self.direction), 1.0
        if hessian is None:
            self.done = np.abs(gradient).max() < 1e-8
        elif abs(self.slope) < 1e-12:  # the next error is the square of this one
            self.at, self.done = self.candidate, True

    def quasi_newton(self) -> np.ndarray:
        q, rates = self.gradient.copy(), []
        useful = [(s, y) for s, y in self.pairs if s @ y > 1e-14]
        for s, y in reversed(useful):
            rates.append(s @ q / (s @ y))
            q -= rates[-1] * y
        if useful:
            s, y = useful[-1]
            q *= s @ y / (y @ y)
        else:
            q /= max(1.0, np.linalg.norm(q))
        for (s, y), rate in zip(useful, reversed(rates), strict=True):
            q += (rate - y @ q / (s @ y)) * s
        return -q


@dataclass
class Fitted:
    """Coefficients (models x columns and intercept x scores) over unscaled columns; models without two classes are not a number."""

    models: Sequence[Model]
    coefficients: np.ndarray
    passes: int

    def probabilities(self, x: np.ndarray, model: int) -> np.ndarray:
        """Of class 1 for two classes, else of every class."""
        z = np.column_stack([x, np.ones(len(x))]) @ self.coefficients[model]
        if z.shape[1] == 1:
            return 1 / (1 + np.exp(-z))
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def added_up(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sums of (model, sums as binary) by model, one row in memory at a time; the sums are of the models' size, not of the rows'."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for model, sums in zip(batch["model"], batch["sums"], strict=True):
                total[model] = total.get(model, 0) + np.frombuffer(sums)
        yield pd.DataFrame({"model": list(total), "sums": [v.tobytes() for v in total.values()]})

    found = parts.repartition("model").mapInPandas(run, "model int, sums binary").collect()
    return {r["model"]: np.frombuffer(r["sums"]) for r in found}


def one_pass(rows: DataFrame, summed) -> dict[int, np.ndarray]:
    """Add up what ``summed(x with ones, y, fold)`` gives for each batch: model -> vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            if len(b):
                x = np.array(b["x"].tolist(), float)
                for model, sums in summed(np.column_stack([x, np.ones(len(x))]), b["y"].to_numpy(), b["fold"].to_numpy()).items():
                    total[model] = total.get(model, 0) + sums
        yield pd.DataFrame({"model": list(total), "sums": [v.tobytes() for v in total.values()]})

    return added_up(rows.mapInPandas(run, "model int, sums binary"))


def derivatives(x: np.ndarray, y: np.ndarray, weight: np.ndarray, b: np.ndarray, second: bool) -> np.ndarray:
    """Summed loss, gradient and, if asked for, second derivatives of one model over a batch."""
    z = x @ b
    if z.shape[1] == 1:
        z = z[:, 0]
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        loss, g = weight @ (np.logaddexp(0, z) - y * z), x.T @ (weight * (p - y))
        more = [((x * (weight * p * (1 - p))[:, None]).T @ x).ravel()] if second else []
        return np.concatenate([[loss], g, *more])
    top = z - z.max(axis=1, keepdims=True)
    logp = top - np.log(np.exp(top).sum(axis=1, keepdims=True))
    p = np.exp(logp)
    at = np.arange(len(y))
    loss = -(weight @ logp[at, y])
    p[at, y] -= 1
    return np.concatenate([[loss], (x.T @ (p * weight[:, None])).ravel()])


def fit_many(df: DataFrame, models: Sequence[Model], label: str = "y", classes: int = 2, balanced: bool = True, scaled: bool = False, passes: int = MOST_PASSES) -> Fitted:
    """df: (label 0, 1, ..., fold, features). ``balanced``: classes of a training side weigh the same; ``scaled``: its
    columns have mean 0 and variance 1 while it is fitted. The rows are kept in executors while passes go over them.
    """
    rows = df.select(vector_to_array("features").alias("x"), F.col(label).cast("int").alias("y"), F.col("fold").cast("int").alias("fold")).persist()
    try:
        return _fit(rows, list(models), classes, balanced, scaled, passes)
    finally:
        rows.unpersist()


def _fit(rows: DataFrame, models: list[Model], classes: int, balanced: bool, scaled: bool, passes: int) -> Fitted:
    counts = {(r["fold"], r["y"]): r["count"] for r in rows.groupBy("fold", "y").count().collect()}
    first = rows.first()
    width, scores = (len(first["x"]) if first else 0) + 1, 1 if classes == 2 else classes
    of_class = np.array([[sum(n for (f, y), n in counts.items() if y == k and f not in m.out) for k in range(classes)] for m in models], dtype=float).reshape(len(models), classes)
    fitting = [i for i in range(len(models)) if (of_class[i] > 0).sum() > 1]
    n = of_class.sum(axis=1)
    weight = np.divide(n[:, None], (of_class > 0).sum(axis=1)[:, None] * of_class, out=np.zeros_like(of_class), where=of_class > 0) if balanced else (of_class > 0).astype(float)
    mean, deviation = np.zeros((len(models), width - 1)), np.ones((len(models), width - 1))
    if scaled and fitting:
        # By fold; a training side is the sum of its folds. Shifted by a row, so that squares lose nothing to a large mean.
        shift = np.array(first["x"], float)
        moments = one_pass(rows, lambda x, y, f: {int(k): np.concatenate([(d := x[f == k][:, :-1] - shift).sum(axis=0), (d * d).sum(axis=0)]) for k in np.unique(f)})
        for i in fitting:
            total = sum(v for k, v in moments.items() if k not in models[i].out)
            one, two = total[: width - 1] / n[i], total[width - 1 :]
            mean[i] = one + shift
            deviation[i] = np.sqrt(np.maximum(two - n[i] * one**2, 0) / max(1, n[i] - 1))
        # As the scaler of Spark has it, a constant column becomes 0.
    flat = deviation <= 1e-12
    inverse = np.where(flat, 0, 1 / np.where(flat, 1, deviation))
    second = scores == 1 and len(fitting) * width**2 <= MOST_CELLS
    search = {i: Descent(np.zeros(width * scores)) for i in fitting}

    def unscaled(i: int, b: np.ndarray) -> np.ndarray:
        b = b.reshape(width, scores)
        raw = b[:-1] * inverse[i][:, None]
        return np.vstack([raw, b[-1:] - mean[i] @ raw])

    done = 0
    while (active := [i for i in fitting if not search[i].done]) and done < passes:
        done += 1
        at = rows.sparkSession.sparkContext.broadcast({i: (models[i].out, weight[i], unscaled(i, search[i].candidate)) for i in active})
        found = one_pass(rows, lambda x, y, f, at=at: {i: derivatives(x, y, w[y] * ~np.isin(f, out), b, second) for i, (out, w, b) in at.value.items()})
        at.unpersist()
        for i in active:
            total, sums = weight[i] @ of_class[i], found[i]
            # The chain rule back to scaled columns: d z / d b = (x - mean) / deviation.
            back = np.eye(width)
            back[:-1, :-1] = np.diag(inverse[i])
            back[-1, :-1] = 0
            back[:-1, -1] = -mean[i] * inverse[i]
            b, ridge = search[i].candidate.reshape(width, scores), np.append(np.full(width - 1, models[i].reg), 0.0)
            gradient = back @ sums[1 : 1 + width * scores].reshape(width, scores) / total + ridge[:, None] * b
            hessian = back @ sums[1 + width :].reshape(width, width) @ back.T / total + np.diag(ridge) if second else None
            search[i].told(sums[0] / total + 0.5 * float((ridge[:, None] * b * b).sum()), gradient.ravel(), hessian)
    out = np.full((len(models), width, scores), np.nan)
    for i in fitting:
        out[i] = unscaled(i, search[i].at)
    return Fitted(models, out, done)


def scored(df: DataFrame, fitted: Fitted, of_fold: dict[int, list[int]], out: str = "p") -> DataFrame:
    """``df`` with ``out``: for each row the probabilities by the models that ``of_fold`` names for its fold, in their order; null where a model is not a number."""
    shared = df.sparkSession.sparkContext.broadcast((fitted, of_fold))

    @F.pandas_udf("array<array<double>>")
    def score(xs: pd.Series, folds: pd.Series) -> pd.Series:
        fitted, of_fold = shared.value
        found: list = [[]] * len(xs)
        for fold in folds.dropna().unique():
            at = np.flatnonzero((folds == fold).to_numpy())
            x = np.array(xs.iloc[at].tolist(), float).reshape(len(at), -1)
            by_model = [fitted.probabilities(x, m) for m in of_fold.get(int(fold), [])]
            for j, i in enumerate(at):
                found[i] = [None if np.isnan(p[j]).any() else p[j].tolist() for p in by_model]
        return pd.Series(found, dtype=object)

    return df.withColumn(out, score(vector_to_array("features"), F.col("fold").cast("int")))

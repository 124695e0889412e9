"""Data-parallel fit of a task head that forgets attributes.

The head maps a vector to a hidden layer, and that to a score.  Every epoch is one pass for all heads that are wanted, of every
fold and strength: each task steps through its rows in small batches from the parameters that the driver has sent, and the
parameters, whose number does not depend on the data, are averaged over the tasks by their rows.  Rows lie in tasks and batches by
hashes of their keys, so a fit does not depend on how its table was partitioned.  Methods, all against any number of
attributes at once:

* ``dann``        an adversary with a hidden layer finds the attribute, the hidden layer of the head ascends on its loss;
* ``fino``        as dann, but the adversary is a bank of prototypes: normalised class means of the hidden layer, moved
  by an exponential average after each batch and never trained; logits are cosines over a temperature;
* ``pcgrad``      the task's gradient has its part along the adversary's removed, ``gt - l (gt.gd / |gd|^2) gd``;
* ``contrastive`` rows of other attribute values in a block are drawn together, by the loss of ``pairwise``.

``conditions`` > 0 makes all this conditional: rows with a condition use the adversary or prototypes of their own
condition, rows without one those of the marginal bank (0); contrastive positives share the condition.  With
``lambda_`` = 0 neither attributes nor the pool of rows without a task label have any influence on scores.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear, metrics, pairwise, probe

METHODS = ("dann", "fino", "pcgrad", "contrastive")
Arrays = dict[str, np.ndarray]
#: Rows of a step, rows that a task holds as a matrix at once, and rows of a task at least, about.
BATCH_ROWS, SLICE_ROWS, PART_ROWS = 64, 4096, 8192


@dataclass
class Settings:
    """What a head is made of. groups: classes of each attribute; conditions: strata, 0 for a marginal head."""

    groups: dict[str, int]
    method: str = "dann"
    conditions: int = 0
    width: int = 8
    temperature: float = 0.1
    ema: float = 0.9

    def __post_init__(self) -> None:
        if self.method not in METHODS:
            raise ValueError(f"unknown method {self.method}")

    @property
    def learned(self) -> bool:
        return self.method in ("dann", "pcgrad")


@dataclass
class Head:
    """Parameters by name; ``cosines`` holds that of both gradients before and after projecting, for each epoch."""

    settings: Settings
    arrays: Arrays
    cosines: list[tuple[float, float]] = field(default_factory=list)

    @classmethod
    def new(cls, dimension: int, settings: Settings, seed: int) -> Head:
        rng, w = np.random.default_rng(seed), settings.width
        layer = lambda n, m, *lead: np.concatenate([rng.normal(0, np.sqrt(2 / n), (*lead, n, m)), np.zeros((*lead, 1, m))], axis=-2)
        arrays = {"trunk": layer(dimension, w), "task": layer(w, 1)}
        for a, n in settings.groups.items():
            banks = settings.conditions + 1
            if settings.learned:
                arrays |= {f"hidden:{a}": layer(w, w, banks), f"logits:{a}": layer(w, n, banks)}
            elif settings.method == "fino":
                arrays[f"prototypes:{a}"] = np.zeros((banks, n, w))
        return cls(settings, arrays)

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(with_one(x) @ self.arrays["trunk"], 0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(with_one(self.hidden(x)) @ self.arrays["task"])[:, 0]


def with_one(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((*x.shape[:-1], 1))], axis=-1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-6)
    return x / size, size


def softmax_loss(logits: np.ndarray, s: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum of the cross-entropies, and its gradient."""
    top = logits - logits.max(axis=1, keepdims=True)
    logp = top - np.log(np.exp(top).sum(axis=1, keepdims=True))
    at = np.arange(len(s))
    gradient = np.exp(logp)
    gradient[at, s] -= 1
    return float(-logp[at, s].sum()), gradient


def adversary(head: Head, h: np.ndarray, s: np.ndarray, bank: np.ndarray, a: str) -> tuple[Arrays, np.ndarray]:
    """Sums of loss, rows and gradients of the adversary on one attribute, and the gradient of the hidden layer."""
    back, loss = np.zeros_like(h), 0.0
    learned = {k: np.zeros_like(head.arrays[k]) for k in (f"hidden:{a}", f"logits:{a}") if k in head.arrays}
    for b in np.unique(bank[s >= 0]):
        at = np.flatnonzero((s >= 0) & (bank == b))
        if head.settings.learned:
            one, two = head.arrays[f"hidden:{a}"][b], head.arrays[f"logits:{a}"][b]
            inner = with_one(h[at])
            active = np.maximum(inner @ one, 0)
            part, g = softmax_loss(with_one(active) @ two, s[at])
            down = (g @ two[:-1].T) * (active > 0)
            learned[f"hidden:{a}"][b] += inner.T @ down
            learned[f"logits:{a}"][b] += with_one(active).T @ g
            back[at] = down @ one[:-1].T
        else:
            bank_, t = unit(head.arrays[f"prototypes:{a}"][b])[0], head.settings.temperature
            u, size = unit(h[at])
            part, g = softmax_loss(u @ bank_.T / t, s[at])
            du = g @ bank_ / t
            back[at] = (du - u * (du * u).sum(axis=1, keepdims=True)) / size
        loss += part
    return learned | {f"loss:{a}": np.array([loss]), f"rows:{a}": np.array([float((s >= 0).sum())])}, back


def class_means(h: np.ndarray, s: np.ndarray, bank: np.ndarray, banks: int, n: int) -> np.ndarray:
    """Sums of the hidden layer and numbers of rows by bank and class."""
    out = np.zeros((banks, n, h.shape[1] + 1))
    has = s >= 0
    np.add.at(out, (bank[has], s[has]), with_one(h[has]))
    return out


def contrast(h: np.ndarray, s: np.ndarray, c: np.ndarray | None, temperature: float) -> tuple[float, int, np.ndarray]:
    """Of one block: summed loss of the anchors with a positive, their number, and the gradient of the hidden layer.

    Positives are the rows of another attribute value (and the same condition); all other rows are in the denominator.
    """
    known = np.flatnonzero((s >= 0) if c is None else (s >= 0) & (c >= 0))
    back = np.zeros_like(h)
    if len(known) < 2:
        return 0.0, 0, back
    u, size = unit(h[known])
    positive = s[known][:, None] != s[known][None, :]
    if c is not None:
        positive &= c[known][:, None] == c[known][None, :]
    valid = positive.any(axis=1)
    logits = u @ u.T / temperature
    np.fill_diagonal(logits, -np.inf)
    top = logits - logits.max(axis=1, keepdims=True)
    p = np.exp(top)
    logp = top - np.log(p.sum(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    wanted = positive / np.maximum(positive.sum(axis=1, keepdims=True), 1)
    loss = -np.where(positive, logp, 0.0) * wanted
    g = (p - wanted) * valid[:, None] / temperature
    du = (g + g.T) @ u
    back[known] = (du - u * (du * u).sum(axis=1, keepdims=True)) / size
    return float(loss[valid].sum()), int(valid.sum()), back


def gradients(head: Head, x: np.ndarray, y: np.ndarray, s: dict[str, np.ndarray], c: np.ndarray, block: np.ndarray, weights: Sequence[float] = (1.0, 1.0)) -> Arrays:
    """Sums over rows. y: 0, 1 or -1 for pool rows; s: class of each attribute or -1; c: condition or -1; block: for
    contrastive; weights: of both values of y."""
    settings, h = head.settings, head.hidden(x)
    x1, h1, on = with_one(x), with_one(h), h > 0
    known = y >= 0
    score = h1 @ head.arrays["task"]
    weight = np.where(known, np.asarray(weights)[np.maximum(y, 0)], 0.0)
    dt = weight[:, None] * (sigmoid(score) - y[:, None])
    loss = weight * (np.logaddexp(0, score[:, 0]) - y * score[:, 0])
    out = {"task": h1.T @ dt, "trunk_task": x1.T @ ((dt @ head.arrays["task"][:-1].T) * on), "n_task": np.array([float(known.sum())]), "loss_task": np.array([loss[known].sum()])}
    banks = settings.conditions + 1
    bank = np.where((c >= 0) & (c < settings.conditions), c + 1, 0)
    for a, n in settings.groups.items():
        if settings.method == "contrastive":
            total, anchors, back = 0.0, 0, np.zeros_like(h)
            for b in np.unique(block):
                at = np.flatnonzero(block == b)
                part, valid, back[at] = contrast(h[at], s[a][at], c[at] if settings.conditions else None, settings.temperature)
                total, anchors = total + part, anchors + valid
            out |= {f"loss:{a}": np.array([total]), f"rows:{a}": np.array([float(anchors)])}
        else:
            learned, back = adversary(head, h, s[a], bank, a)
            out |= learned
            if settings.method == "fino":
                out[f"means:{a}"] = class_means(h, s[a], bank, banks, n)
        out[f"trunk:{a}"] = x1.T @ (back * on)
    return out


def whole_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches that end where a block ends; rows come in the order of their blocks."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if len(batch):
            last = batch["block"] == batch["block"].iloc[-1]
            if not last.all() or (held and held[-1]["block"].iloc[-1] != batch["block"].iloc[0]):
                yield pd.concat([*held, batch[~last]])
                held = []
            held.append(batch[last])
    if held:
        yield pd.concat(held)


def epoch_sums(df: DataFrame, head: Head) -> Arrays:
    """One pass over ``prepared`` rows: partial sums in the tasks, added up by Spark."""
    shared = df.sparkSession.sparkContext.broadcast(head)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Arrays = {}
        settings = shared.value.settings
        for b in whole_blocks(batches) if settings.method == "contrastive" else batches:
            if len(b):
                s = {a: b[f"s_{a}"].to_numpy() for a in settings.groups}
                got = gradients(shared.value, np.array(b["x"].tolist(), float), b["y"].to_numpy(), s, b["c"].to_numpy(), b["block"].to_numpy())
                total = {k: total.get(k, 0) + v for k, v in got.items()}
        if total:
            yield pd.DataFrame({"name": list(total), "value": [v.ravel().tolist() for v in total.values()]})

    parts = df.mapInPandas(partial, "name string, value array<double>").select("name", F.posexplode("value").alias("i", "v"))
    rows = parts.groupBy("name", "i").agg(F.sum("v").alias("v")).toPandas()
    return {name: g.sort_values("i")["v"].to_numpy() for name, g in rows.groupby("name")}


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    return float(a.ravel() @ b.ravel() / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-12))


def projected(gt: np.ndarray, gd: np.ndarray, lambda_: float, only_if_aligned: bool = False) -> np.ndarray:
    """The task's gradient without ``lambda_`` times its part along the attribute's."""
    along = (gt * gd).sum()
    if only_if_aligned and along <= 0:
        return gt
    return gt - lambda_ * along / max((gd * gd).sum(), 1e-12) * gd


def moved(bank: np.ndarray, sums: np.ndarray, ema: float) -> np.ndarray:
    """Prototypes after an epoch: normalised means, the first copied; classes that did not occur keep theirs."""
    n = sums[..., -1:]
    mean = unit(sums[..., :-1] / np.maximum(n, 1))[0]
    first = ~bank.any(axis=-1, keepdims=True)
    return np.where(n > 0, np.where(first, mean, ema * bank + (1 - ema) * mean), bank)


def prepared(task: DataFrame, pool: DataFrame | None, settings: Settings, lambda_: float, key: str | None = None) -> DataFrame:
    """(x, y, s_<attribute>, c, block) of both; unknown values are -1. A block is about 256 rows, for contrastive alone."""

    def rows(df: DataFrame, y) -> DataFrame:
        known = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-1).cast("long")) if c in df.columns else F.lit(-1).cast("long")
        return df.select("x", y.cast("long").alias("y"), *[known(a).alias(f"s_{a}") for a in settings.groups], known("condition").alias("c"), (F.col(key) if key else F.col("x")).alias("_key"))

    out = rows(task, F.col("y"))
    if pool is not None and lambda_ != 0:
        out = out.unionByName(rows(pool, F.lit(-1)))
    if settings.method != "contrastive":
        return out.drop("_key").withColumn("block", F.lit(0).cast("long"))
    return pairwise.blocks(out, "_key").drop("_key").repartition("block").sortWithinPartitions("block")


def step(head: Head, g: Arrays, lambda_: float, rate: float) -> None:
    """One step down the task's gradient, with the attributes' part of the method."""
    settings, arrays = head.settings, head.arrays
    per = lambda name, n: g[name] / max(1.0, g[n][0])
    gt = per("trunk_task", "n_task").reshape(arrays["trunk"].shape)
    gd = sum(per(f"trunk:{a}", f"rows:{a}") for a in settings.groups).reshape(gt.shape) if settings.groups else np.zeros_like(gt)
    if lambda_ == 0:
        down = gt
    elif settings.method == "pcgrad":
        down = projected(gt, gd, lambda_)
        head.cosines.append((cosine(gt, gd), cosine(down, gd)))
    else:
        down = gt + (lambda_ if settings.method == "contrastive" else -lambda_) * gd
    arrays["trunk"] = arrays["trunk"] - rate * down
    arrays["task"] = arrays["task"] - rate * per("task", "n_task").reshape(arrays["task"].shape)
    for a in settings.groups:
        for name in (f"hidden:{a}", f"logits:{a}"):
            if name in arrays:
                arrays[name] = arrays[name] - rate * per(name, f"rows:{a}").reshape(arrays[name].shape)
        if settings.method == "fino":
            bank = arrays[f"prototypes:{a}"]
            arrays[f"prototypes:{a}"] = moved(bank, g[f"means:{a}"].reshape(*bank.shape[:2], -1), settings.ema)


@dataclass(frozen=True)
class Job:
    """A head to fit: its strength, and the fold whose rows it does not see."""

    lambda_: float
    out: int | None = None


def dealt(task: DataFrame, pool: DataFrame | None, settings: Settings, key: str | None, parts: int) -> DataFrame:
    """(part, u, x, y, s_<attribute>, c, fold, block) in the order of u, a hash of the key; every block lies in one part.

    Unknown values are -1; pool rows have y = -1 and no fold. A block is about 256 rows.
    """

    def rows(df: DataFrame, y, fold) -> DataFrame:
        known = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-1).cast("long")) if c in df.columns else F.lit(-1).cast("long")
        u = F.xxhash64(F.col(key) if key else F.col("x")).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)) / F.lit(float(1 << 63))
        return df.select(u.alias("u"), "x", y.cast("long").alias("y"), *[known(a).alias(f"s_{a}") for a in settings.groups], known("condition").alias("c"), fold.cast("long").alias("fold"))

    out = rows(task, F.col("y"), F.col("fold") if "fold" in task.columns else F.lit(-1))
    if pool is not None:
        out = out.unionByName(rows(pool, F.lit(-1), F.lit(-1)))
    blocks = parts * max(1, -(-out.count() // (parts * pairwise.BLOCK_ROWS))) if settings.method == "contrastive" else parts
    place = lambda n: F.least(F.floor(F.col("u") * n), F.lit(n - 1)).cast("long")
    out = out.withColumns({"part": place(parts), "block": place(blocks)})
    return out.repartition(parts, "part").sortWithinPartitions("part", "u", "y", *[f"s_{a}" for a in settings.groups], "c")


class Local:
    """One head inside a task: batches of rows in, steps of BATCH_ROWS rows; what is left over waits for more."""

    def __init__(self, head: Head, job: Job, rate: float, weights: Sequence[float]):
        self.head = Head(head.settings, {k: v.copy() for k, v in head.arrays.items()})
        self.job, self.rate, self.weights, self.rows = job, rate, weights, 0
        self.waiting: list[dict[str, np.ndarray]] = []

    def wants(self, batch: dict[str, np.ndarray]) -> np.ndarray:
        seen = np.ones(len(batch["y"]), dtype=bool) if self.job.out is None else batch["fold"] != self.job.out
        return seen & (batch["y"] >= 0) if self.job.lambda_ == 0 else seen

    def feed(self, batch: dict[str, np.ndarray]) -> None:
        here = self.wants(batch)
        self.waiting.append({k: v[here] for k, v in batch.items()})
        if self.whole_blocks:
            self.step_through(self.borders())
        elif sum(len(w["y"]) for w in self.waiting) >= BATCH_ROWS:
            n = sum(len(w["y"]) for w in self.waiting)
            self.step_through(list(range(0, n + 1, BATCH_ROWS)))

    @property
    def whole_blocks(self) -> bool:
        return self.head.settings.method == "contrastive" and self.job.lambda_ != 0

    def borders(self) -> list[int]:
        block = np.concatenate([w["block"] for w in self.waiting])
        return [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist()]

    def step_through(self, borders: list[int]) -> None:
        """A step for each range between borders; the rows after the last one wait on."""
        rows = {k: np.concatenate([w[k] for w in self.waiting]) for k in self.waiting[0]}
        for low, high in zip(borders[:-1], borders[1:], strict=True):
            b = {k: v[low:high] for k, v in rows.items()}
            settings = self.head.settings
            g = gradients(self.head, b["x"], b["y"], {a: b[f"s_{a}"] for a in settings.groups}, b["c"], b["block"], self.weights)
            step(self.head, g, self.job.lambda_, self.rate)
            self.rows += high - low
        self.waiting = [{k: v[borders[-1] :] for k, v in rows.items()}]

    def finished(self) -> np.ndarray:
        """Rows, then the parameters and the mean cosines times the rows, to be added up over tasks."""
        if self.waiting and (n := len(self.waiting[0]["y"] if len(self.waiting) == 1 else np.concatenate([w["y"] for w in self.waiting]))):
            self.step_through([0, n])
        cosines = np.mean(self.head.cosines, axis=0) if self.head.cosines else np.zeros(2)
        return np.concatenate([[self.rows], self.rows * cosines, *(self.rows * self.head.arrays[k].ravel() for k in sorted(self.head.arrays))])


def averaged(head: Head, sums: np.ndarray) -> Head:
    """The head with the mean parameters of the tasks."""
    mean, arrays, at = sums[3:] / max(1.0, sums[0]), {}, 0
    for k in sorted(head.arrays):
        size = head.arrays[k].size
        arrays[k], at = mean[at : at + size].reshape(head.arrays[k].shape), at + size
    return Head(head.settings, arrays, [*head.cosines, (float(sums[1] / max(1.0, sums[0])), float(sums[2] / max(1.0, sums[0])))])


def one_round(rows: DataFrame, heads: list[Head], jobs: Sequence[Job], rate: float, weights: Sequence[float]) -> list[Head]:
    """One pass for all heads."""
    shared = rows.sparkSession.sparkContext.broadcast((heads, list(jobs), rate, tuple(weights)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heads, jobs, rate, weights = shared.value
        local = [Local(h, j, rate, weights) for h, j in zip(heads, jobs, strict=True)]
        for b in batches:
            for at in range(0, len(b), SLICE_ROWS):
                part = b.iloc[at : at + SLICE_ROWS]
                columns = {c: part[c].to_numpy() for c in part.columns if c != "x"} | {"x": np.array(part["x"].tolist(), float)}
                for one in local:
                    one.feed(columns)
        done = [one.finished() for one in local]
        yield pd.DataFrame({"model": range(len(done)), "sums": [d.tobytes() for d in done]})

    sums = linear.added_up(rows.drop("part", "u").mapInPandas(run, "model int, sums binary"))
    shared.unpersist()
    return [averaged(h, sums[i]) if i in sums and sums[i][0] else h for i, h in enumerate(heads)]


def fit_all(task: DataFrame, pool: DataFrame | None, dimension: int, settings: Settings, jobs: Sequence[Job], epochs: int = 20, rate: float = 0.5, seed: int = 42, key: str | None = None, balanced: bool = False) -> list[Head]:
    """Heads of all jobs in the same passes. task: (x array, y 0/1, attributes and condition as 0, 1, ... or null, fold where jobs
    leave one out); pool: the same without y, for the attributes' part alone (M12). The rate falls to zero over the epochs.
    """
    counts = {r["y"]: r["count"] for r in task.groupBy("y").count().collect()}
    n = sum(counts.values())
    weights = [n / (len(counts) * counts[y]) if balanced and y in counts else 1.0 for y in (0, 1)]
    parts = min(int(task.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(1, n // PART_ROWS))
    rows = dealt(task, pool if any(j.lambda_ for j in jobs) else None, settings, key, parts).persist()
    heads = [Head.new(dimension, settings, seed) for _ in jobs]
    try:
        for epoch in range(epochs):
            heads = one_round(rows, heads, jobs, rate * (1 - epoch / epochs), weights)
    finally:
        rows.unpersist()
    return heads


def fit(task: DataFrame, pool: DataFrame | None, dimension: int, settings: Settings, lambda_: float, **options) -> Head:
    """One head over all rows."""
    return fit_all(task, pool, dimension, settings, [Job(lambda_)], **options)[0]


def predict(df: DataFrame, head: Head, vector: str = "x", score: str = "score", hidden: str | None = None) -> DataFrame:
    """``df`` with scores, and with the hidden layer where a name is given."""
    shared = df.sparkSession.sparkContext.broadcast(head)

    @F.pandas_udf("score double, hidden array<double>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array(b.tolist(), float).reshape(len(b), -1)
            yield pd.DataFrame({"score": shared.value.scores(x), "hidden": list(shared.value.hidden(x))})

    out = df.withColumn("_p", scored(F.col(vector))).withColumn(score, F.col("_p.score"))
    return (out.withColumn(hidden, F.col("_p.hidden")) if hidden else out).drop("_p")


def predict_of_fold(df: DataFrame, heads: dict[int, Head]) -> DataFrame:
    """The rows of the given folds with score and hidden layer, each by the head of its fold."""
    shared = df.sparkSession.sparkContext.broadcast(heads)

    @F.pandas_udf("score double, hidden array<double>")
    def scored(xs: pd.Series, folds: pd.Series) -> pd.DataFrame:
        score, hidden = np.full(len(xs), np.nan), np.empty(len(xs), dtype=object)
        for f in folds.unique():
            at = np.flatnonzero((folds == f).to_numpy())
            x = np.array(xs.iloc[at].tolist(), float).reshape(len(at), -1)
            score[at] = shared.value[f].scores(x)
            for i, h in zip(at, shared.value[f].hidden(x), strict=True):
                hidden[i] = h
        return pd.DataFrame({"score": score, "hidden": hidden})

    out = df.where(F.col("fold").isin(list(heads))).withColumn("_p", scored("x", "fold"))
    return out.withColumns({"score": F.col("_p.score"), "hidden": F.col("_p.hidden")}).drop("_p")


def of_patients(tiles: DataFrame, heads: dict[int, Head], carried: Sequence[str]) -> DataFrame:
    out, keys = predict_of_fold(tiles, heads), ["patient_id", "y", "fold", *carried]
    return pairwise.mean_scores(out, keys, "score").join(pairwise.mean_vectors(out, ["patient_id"], "hidden", "hidden").drop("n"), "patient_id")


def out_of_fold(tiles: DataFrame, pool: DataFrame | None, dimension: int, settings: Settings, lambda_: float, folds: Sequence[int], carried: Sequence[str] = (), **fit_options) -> DataFrame:
    """(patient_id, y, fold, carried, score, hidden, n_tiles): every fold scored by a head of the others, tiles averaged to patients (M6).

    tiles: (patient_id, fold, x, y, attributes). With ``lambda_`` = 0 this is the plain task head.
    """
    heads = fit_all(tiles, pool, dimension, settings, [Job(lambda_, f) for f in folds], **fit_options)
    return of_patients(tiles, dict(zip(folds, heads, strict=True)), carried)


def comparison(tiles: DataFrame, pool: DataFrame | None, dimension: int, settings: Settings, lambdas: Sequence[float], folds: Sequence[int], min_n: int = 20, **fit_options) -> DataFrame:
    """(lambda, attribute, overall_auc, leakage_auc, attr_overall_auc, auc_delta, ece_delta, es_auc, n_eligible): heads side by side.

    Leakage is how well a linear probe, itself cross-validated over the folds, finds the attribute in the hidden layer.
    """
    out, jobs = None, [Job(lambda_, f) for lambda_ in lambdas for f in folds]
    heads = dict(zip(jobs, fit_all(tiles, pool, dimension, settings, jobs, **fit_options), strict=True))
    for lambda_ in lambdas:
        scored = of_patients(tiles, {f: heads[Job(lambda_, f)] for f in folds}, list(settings.groups)).persist()
        report = metrics.gaps(scored, list(settings.groups), min_n=min_n)
        overall = metrics.auc_by(scored, []).select(F.col("auc").alias("overall_auc"))
        for a in settings.groups:
            known = probe.features(scored.where(F.col(a).isNotNull()), "hidden")
            leak = F.lit(probe.leakage_auc(known, a, list(folds))).cast("double")
            row = report.where(F.col("attribute") == a).crossJoin(F.broadcast(overall))
            # A handful of rows; made now, so that the scores need not be kept.
            part = tiles.sparkSession.createDataFrame(row.select(F.lit(float(lambda_)).alias("lambda"), "*", leak.alias("leakage_auc")).collect(), "lambda double, attribute string, n_eligible long, attr_overall_auc double, auc_delta double, ece_delta double, es_auc double, overall_auc double, leakage_auc double")
            out = part if out is None else out.unionByName(part)
        scored.unpersist()
    return out

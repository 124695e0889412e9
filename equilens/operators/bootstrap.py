"""Paired hierarchical bootstrap of three study arms, contrasts and the decision rule."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import hash_rank, numbered
from .metrics import arm_metrics

ARMS = ["control", "posthoc", "pretraining"]


def draw(seed: int, *parts: Column | str, below: Column) -> Column:
    """A number from 0 up to ``below`` that depends on seed and parts alone."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 13), 16, 10).cast("long") % below


def contrasts(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fairness and utility of both interventions against control and against each other)."""
    wide = metrics.groupBy(*keys).pivot("arm", ARMS).agg(F.first("overall_auc").alias("auc"), F.first("auc_gap").alias("gap"))
    c = F.col
    return wide.select(
        *keys,
        (c("control_gap") - c("pretraining_gap")).alias("pretraining_fairness_improvement"), (c("pretraining_auc") - c("control_auc")).alias("pretraining_utility_delta"),
        (c("control_gap") - c("posthoc_gap")).alias("posthoc_fairness_improvement"), (c("posthoc_auc") - c("control_auc")).alias("posthoc_utility_delta"),
        (c("posthoc_gap") - c("pretraining_gap")).alias("fairness_advantage"), (c("pretraining_auc") - c("posthoc_auc")).alias("utility_delta"),
    )


def run_summary(scores: DataFrame, group: str, groups: DataFrame) -> DataFrame:
    """Contrasts of every run (B5). scores: (arm, run, patient_id, y, score, group)."""
    return contrasts(arm_metrics(scores, ["arm", "run"], group, groups), ["run"])


#: Iterations that are held as one vector, patients of a label that are counted together (a place among them has 16 bits), and draws of
#: each iteration that a task makes.
BLOCK, RANGE, SLOTS = 128, 1 << 16, 1 << 17
#: Rows between two of the scores that cut a sorted table into buckets, about.
BUCKET_ROWS = 1 << 16
#: Rows of vectors that are summed up at once.
TOGETHER = 1 << 16
TIMES, SUMS, PLACES, SIZES = np.dtype("<u2"), np.dtype("<u4"), np.dtype("<u2"), np.dtype("<u4")
WEIGHTED = "arm string, run string, block long, bucket long, score double, y int, grp string, times binary"
PARTIAL = "arm string, run string, block long, grp string, bucket long, pos binary, neg binary, wins binary"


def draws_of(label: str, iteration: int, slots: range, size: int, seed: int) -> np.ndarray:
    """``draw`` for some slots of a label in one iteration."""
    start = hashlib.sha256(f"{seed}:{iteration}:{label}:".encode())
    digests = []
    for slot in slots:
        one = start.copy()
        one.update(b"%d" % slot)
        digests.append(one.digest())
    return (np.frombuffer(b"".join(digests), dtype=">u8")[::4] >> np.uint64(12)).astype(np.int64) % size


def drawn_places(patients: DataFrame, iterations: int, seed: int, block: int = BLOCK) -> DataFrame:
    """(label, block, part, drawn): the patients drawn from a part of a label in a block of iterations (B1).

    Every draw is hashed once, in one task, and takes two bytes: ``drawn`` holds how many each iteration has and then
    their places in the part. No draw is ever a row.
    """
    sizes = patients.groupBy(F.col("y").cast("string").alias("label")).agg(F.count("*").alias("size"))
    last = -(-iterations // block) - 1
    tasks = sizes.select("label", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("block"))
    tasks = tasks.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(SLOTS).cast("long"))).alias("low"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for label, size, at, low in batch.itertuples(index=False, name=None):
                parts = -(-size // RANGE)
                counts, places = [], [[] for _ in range(parts)]
                for it in range(at * block, min(iterations, (at + 1) * block)):
                    drawn = draws_of(label, it, range(low, min(size, low + SLOTS)), size, seed)
                    part = drawn // RANGE
                    counts.append(np.bincount(part, minlength=parts))
                    ordered = (drawn[np.argsort(part, kind="stable")] % RANGE).astype(PLACES)
                    for of, some in zip(places, np.split(ordered, np.cumsum(counts[-1])[:-1]), strict=True):
                        of.append(some)
                sizes = np.array(counts, dtype=SIZES).T
                yield pd.DataFrame({"label": label, "block": at, "part": np.arange(parts), "drawn": [n.tobytes() + np.concatenate(of).tobytes() for n, of in zip(sizes, places, strict=True)]})

    dealt = tasks.repartition(tasks.sparkSession.sparkContext.defaultParallelism * 4)
    return dealt.mapInPandas(run, "label string, block long, part long, drawn binary")


def counted(drawn: pd.Series, width: int, patients: int) -> np.ndarray:
    """How often each of a part's ``patients`` is drawn in each of ``width`` iterations."""
    times = np.zeros((width, patients), dtype=SUMS)
    for one in drawn:
        ends = np.cumsum(np.frombuffer(one, dtype=SIZES, count=width))
        for of, some in zip(times, np.split(np.frombuffer(one, dtype=PLACES, offset=width * SIZES.itemsize), ends[:-1]), strict=True):
            of += np.bincount(some, minlength=patients).astype(SUMS)
    return np.ascontiguousarray(times.T)


def iterations_in(at: int, iterations: int, block: int) -> int:
    return min(iterations - at * block, block)


def multiplicity_vectors(patients: DataFrame, iterations: int, seed: int, block: int = BLOCK) -> DataFrame:
    """(label, k, block, times): how often the k-th patient of a label is drawn in each iteration of a block, where it is drawn at all (B1)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        label, at, part = key
        times = counted(rows["drawn"], iterations_in(at, iterations, block), RANGE)
        found = np.flatnonzero(times.any(axis=1))
        return pd.DataFrame({"label": label, "k": part * RANGE + found, "block": at, "times": [t.tobytes() for t in times[found].astype(TIMES)]})

    drawn = drawn_places(patients, iterations, seed, block)
    return drawn.groupBy("label", "block", "part").applyInPandas(run, "label string, k long, block long, times binary")


def drawn_cells(placed: DataFrame, patients: DataFrame, iterations: int, seed: int, block: int = BLOCK) -> DataFrame:
    """WEIGHTED: for rows of equal arm, run, bucket, score, y and group within a part of a label, how often their patients are drawn together.

    placed: (arm, run, label, k, y, score, grp, bucket). Rows of a part meet its draws; the vectors of single patients stay in the task.
    """
    cells = placed.groupBy("label", F.expr(f"k div {RANGE}").alias("part"), "arm", "run", "bucket", "score", "y", "grp").agg(F.collect_list((F.col("k") % RANGE).cast("int")).alias("places"))
    last = -(-iterations // block) - 1
    cells = cells.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))))

    def run(key: tuple, drawn: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = rows[["arm", "run", "block", "bucket", "score", "y", "grp"]]
        if not len(rows):
            return out.assign(times=[])
        times = counted(drawn["drawn"], iterations_in(key[1], iterations, block), RANGE)
        sizes = rows["places"].str.len().to_numpy()
        summed = []
        for _, some in rows["places"].groupby((np.cumsum(sizes) - sizes) // TOGETHER, sort=False):
            starts = np.cumsum([0, *map(len, some[:-1])])
            summed += [t.tobytes() for t in np.add.reduceat(times[np.concatenate(some.to_list())], starts, axis=0, dtype=SUMS)]
        return out.assign(times=summed)

    keys = ["label", "block", "part"]
    return drawn_places(patients, iterations, seed, block).groupBy(*keys).cogroup(cells.groupBy(*keys)).applyInPandas(run, WEIGHTED)


def numbered_patients(patients: DataFrame) -> DataFrame:
    """(patient_id, label, k): patients of each label in the order of their hashes."""
    return numbered(patients, ["y"], hash_rank("bootstrap", F.col("patient_id")), "patient_id", "k").select("patient_id", F.col("y").cast("string").alias("label"), "k")


def multiplicities(patients: DataFrame, iterations: int, seed: int) -> DataFrame:
    """(it, patient_id, times): in every iteration as many draws with replacement from each label as it has patients (B1).

    patients: (patient_id, y), one row each. Draws are hashes of seed, iteration, label and slot, so they do not depend
    on order or partitions. The vectors are unfolded here; the bootstrap itself works on them as they are.
    """
    unfold = F.udf(lambda t: np.frombuffer(t, dtype=TIMES).tolist(), "array<int>", useArrow=True)
    # Spark takes what Python returns to be as small as what it was given, and would broadcast it.
    vectors = multiplicity_vectors(patients, iterations, seed).join(numbered_patients(patients).hint("merge"), ["label", "k"])
    each = vectors.select("patient_id", "block", F.posexplode(unfold("times")).alias("j", "times")).where("times > 0")
    return each.select((F.col("block") * BLOCK + F.col("j")).alias("it"), "patient_id", F.col("times").cast("long").alias("times"))


def run_draws(scores: DataFrame, iterations: int, seed: int) -> DataFrame:
    """(it, run, run_times): as many draws of runs with replacement as there are runs (B2)."""
    runs = scores.select("run").distinct().withColumn("k", F.row_number().over(Window.orderBy("run")) - 1)  # a handful of runs
    its = F.sequence(F.lit(0).cast("long"), F.lit(iterations - 1).cast("long"))
    slots = runs.withColumn("of", F.count("*").over(Window.partitionBy())).withColumn("it", F.explode(its))
    drawn = slots.select("it", draw(seed, F.lit("run"), "it", F.col("k").cast("string"), below=F.col("of")).alias("k"))
    return drawn.groupBy("it", "k").agg(F.count("*").alias("run_times")).join(runs, "k").select("it", "run", "run_times")


class Wins:
    """Rows in ascending order of score in, for every iteration the positives, negatives and pairs won; ties count half.

    What is held is a few vectors: a score that many rows share is summed up before it is compared.
    """

    def __init__(self, iterations: int):
        self.pos, self.neg, self.wins, self.open_pos, self.open_neg = np.zeros((5, iterations))
        self.score: float | None = None

    def close(self) -> None:
        self.wins += self.open_pos * (self.neg + self.open_neg / 2)
        self.pos += self.open_pos
        self.neg += self.open_neg
        self.open_pos, self.open_neg, self.score = np.zeros_like(self.pos), np.zeros_like(self.pos), None

    def feed(self, scores: np.ndarray, positive: np.ndarray, times: np.ndarray) -> None:
        starts = np.flatnonzero(np.append(True, scores[1:] != scores[:-1]))
        pos, neg = (np.add.reduceat(times * side[:, None], starts) for side in (positive, 1 - positive))
        if self.score is not None and self.score != scores[0]:
            self.close()
        pos[0] += self.open_pos
        neg[0] += self.open_neg
        below = np.cumsum(neg[:-1], axis=0) - neg[:-1] + self.neg
        self.wins += (pos[:-1] * (below + neg[:-1] / 2)).sum(axis=0)
        self.pos += pos[:-1].sum(axis=0)
        self.neg += neg[:-1].sum(axis=0)
        self.open_pos, self.open_neg, self.score = pos[-1], neg[-1], scores[-1]


def runs_of_keys(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Parts of sorted batches that have one key each; a key's rows may come in several parts."""
    for batch in batches:
        if len(batch):
            new = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy()
            bounds = [*np.flatnonzero(new), len(batch)]
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                yield tuple(batch[keys].iloc[low]), batch.iloc[low:high]


def partial_wins(weighted: DataFrame) -> DataFrame:
    """PARTIAL of rows (arm, run, block, bucket, score, y, grp, times), in which a null group counts only for all (an empty ``grp``)."""
    keys = ["arm", "run", "block", "bucket"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, found = None, {}

        def out() -> pd.DataFrame:
            for w in found.values():
                w.close()
            made = [(*at[:3], g, at[3], w.pos.tobytes(), w.neg.tobytes(), w.wins.tobytes()) for g, w in found.items()]
            return pd.DataFrame(made, columns=["arm", "run", "block", "grp", "bucket", "pos", "neg", "wins"])

        for key, part in runs_of_keys(batches, keys):
            if key != at and found:
                yield out()
                found = {}
            at = key
            times = np.frombuffer(b"".join(part["times"]), dtype=SUMS).reshape(len(part), -1).astype(float)
            scores, positive, groups = part["score"].to_numpy(), part["y"].to_numpy(dtype=float), part["grp"].to_numpy(dtype=object)
            for g in ["", *part["grp"].dropna().unique()]:
                of = slice(None) if g == "" else groups == g
                found.setdefault(g, Wins(times.shape[1])).feed(scores[of], positive[of], times[of])
        if found:
            yield out()

    return weighted.repartition(*keys).sortWithinPartitions(*keys, "score").mapInPandas(run, PARTIAL)


def whole_aucs(partial: DataFrame) -> DataFrame:
    """(arm, run, block, grp, auc): the AUROCs of a block's iterations, from the buckets of scores in order; null without both classes."""
    keys = ["arm", "run", "block", "grp"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, pos, neg, wins = None, 0.0, 0.0, 0.0

        def out() -> pd.DataFrame:
            auc = [float(w / (p * n)) if p and n else None for w, p, n in zip(wins, pos, neg, strict=True)]
            return pd.DataFrame([(*at, auc)], columns=[*keys, "auc"])

        for key, part in runs_of_keys(batches, keys):
            if key != at:
                if at is not None:
                    yield out()
                at, pos, neg, wins = key, 0.0, 0.0, 0.0
            for p, n, w in zip(*(map(np.frombuffer, part[c]) for c in ("pos", "neg", "wins")), strict=True):
                wins, pos, neg = wins + w + p * neg, pos + p, neg + n
        if at is not None:
            yield out()

    return partial.repartition(*keys).sortWithinPartitions(*keys, "bucket").mapInPandas(run, "arm string, run string, block long, grp string, auc array<double>")


def in_buckets(df: DataFrame) -> DataFrame:
    """``df`` with ``bucket``: ranges of scores that rise with the score; their number follows the rows."""
    cuts = -(-df.count() // BUCKET_ROWS)
    bounds = sorted(set(df.approxQuantile("score", [i / cuts for i in range(1, cuts)], 0.1 / cuts))) if cuts > 1 else []
    cut = Bucketizer(splits=[float("-inf"), *(bounds or [0.0]), float("inf")], inputCol="score", outputCol="bucket", handleInvalid="keep")
    return cut.transform(df).withColumn("bucket", F.col("bucket").cast("long"))


def resampled_metrics(scores: DataFrame, group: str, groups: DataFrame, iterations: int, seed: int, block: int = BLOCK) -> DataFrame:
    """(it, arm, run, overall_auc, auc_gap) of every iteration and run: ``arm_metrics`` over drawn patients.

    Multiplicities are vectors over a block of iterations, added up over equal scores before they are shuffled; scores are sorted once for
    all iterations and cut into buckets; AUROCs are prefix sums of vectors inside buckets and then over them. The plan does not depend on
    the iterations.
    """
    patients = scores.select("patient_id", "y").distinct()
    known = scores.join(groups.select(F.col(group), F.concat(F.lit("="), F.col(group).cast("string")).alias("grp")), group, "left")
    placed = known.withColumn("label", F.col("y").cast("string")).join(numbered_patients(patients), ["patient_id", "label"])
    columns = [F.col("arm").cast("string").alias("arm"), F.col("run").cast("string").alias("run"), "label", "k", F.col("y").cast("int").alias("y"), F.col("score").cast("double").alias("score"), "grp"]
    weighted = drawn_cells(in_buckets(placed.where("score is not null").select(*columns)), patients, iterations, seed, block)
    aucs = whole_aucs(partial_wins(weighted)).select("arm", "run", "block", "grp", F.posexplode("auc").alias("j", "auc"))
    each = aucs.select((F.col("block") * block + F.col("j")).alias("it"), "arm", "run", "grp", "auc")
    of_group = F.when(F.col("grp") != "", F.col("auc"))
    found = each.groupBy("it", "arm", "run").agg(F.max(F.when(F.col("grp") == "", F.col("auc"))).alias("overall_auc"), F.count(of_group).alias("_n"), (F.max(of_group) - F.min(of_group)).alias("_gap"))
    most = groups.agg(F.count("*").alias("_groups"))
    gap = F.when(F.col("_n") == F.col("_groups"), F.col("_gap"))
    return found.crossJoin(F.broadcast(most)).select("it", "arm", "run", "overall_auc", gap.alias("auc_gap"))  # one row


def paired_bootstrap(scores: DataFrame, group: str, groups: DataFrame, iterations: int, seed: int, block: int = BLOCK) -> DataFrame:
    """(it, fairness_advantage, utility_delta): medians over drawn runs; iterations with an undefined AUROC are dropped."""
    draws = run_draws(scores, iterations, seed).withColumn("run", F.col("run").cast("string"))
    per_run = contrasts(resampled_metrics(scores, group, groups, iterations, seed, block), ["it", "run"]).join(draws, ["it", "run"])
    repeated = per_run.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("run_times").cast("int"))))
    whole = F.count("fairness_advantage") == F.count("*")
    medians = repeated.groupBy("it").agg(whole.alias("whole"), F.percentile("fairness_advantage", 0.5).alias("fairness_advantage"), F.percentile("utility_delta", 0.5).alias("utility_delta"))
    return medians.where("whole").drop("whole")


def intervals(samples: DataFrame) -> DataFrame:
    """One row: valid_iterations and, for both contrasts, the 95 % interval and the part at or below zero."""
    out = [F.count("*").alias("valid_iterations")]
    for c in ("fairness_advantage", "utility_delta"):
        q = F.percentile(c, F.array(F.lit(0.025), F.lit(0.975)))
        out += [q[0].alias(f"{c}_lower"), q[1].alias(f"{c}_upper"), F.avg((F.col(c) <= 0).cast("double")).alias(f"{c}_le_zero")]
    return samples.agg(*out)


def decision(ci: DataFrame, iterations: int, min_advantage: float = 0.0, margin: float = 0.02) -> DataFrame:
    """The interval row with the verdict of the declared rule (B6); too few valid iterations give null."""
    enough = F.col("valid_iterations") >= max(100, iterations // 2)
    fair, useful = F.col("fairness_advantage_lower") > min_advantage, F.col("utility_delta_lower") >= -margin
    return ci.withColumns({"fairness_superior": F.when(enough, fair), "utility_noninferior": F.when(enough, useful), "supports_pretraining": F.when(enough, fair & useful)})

"""Training-log rates, cumulative counters and run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rates(log: DataFrame, run: str, step: str, seconds: str, counters: list[str], validation: str | None = None) -> DataFrame:
    """``log`` with <counter>_per_s since the row before; after a validation row the clock starts anew."""
    order = Window.partitionBy(run).orderBy(step)
    keys = [run]
    own = "_segment"
    while own in log.columns:
        own += "_"
    if validation:
        log = log.withColumn(own, F.sum(F.col(validation).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        keys.append(own)
    before = Window.partitionBy(*keys).orderBy(step)
    elapsed = F.col(seconds) - F.lag(seconds).over(before)
    return log.withColumns({f"{c}_per_s": (F.col(c) - F.lag(c).over(before)) / F.nullif(elapsed, F.lit(0).cast("double")) for c in counters}).drop(own)


def cumulative_uniques(seen: DataFrame, run: str, step: str, key: str) -> DataFrame:
    """(run, step, unique_so_far) for every step."""
    first = seen.groupBy(run, key).agg(F.min(step).alias(step)).groupBy(run, step).agg(F.count("*").alias("new"))
    steps = seen.select(run, step).distinct().join(first, [run, step], "left").fillna(0, ["new"])
    return steps.select(run, step, F.sum("new").over(Window.partitionBy(run).orderBy(step)).alias("unique_so_far"))


def distinct_counts(df: DataFrame, columns: list[str], by: list[str], exact: bool = True) -> DataFrame:
    """Distinct values of each column (A19); the approximate form needs one pass and constant memory."""
    count = F.countDistinct if exact else F.approx_count_distinct
    return df.groupBy(*by).agg(*[count(c).alias(f"n_{c}") for c in columns])


#: Logarithm of the registers of a sketch; its relative error is about 1.04 / sqrt(registers), 1.6 % here.
REGISTERS = 12


def distinct_sketches(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by, sketch_<column>): sketches of the distinct values, which later runs can merge without any id."""
    return df.groupBy(*by).agg(*[F.hll_sketch_agg(F.col(c).cast("string"), F.lit(REGISTERS)).alias(f"sketch_{c}") for c in columns])


def merged_sketches(sketches: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Sketches of any number of runs and steps, merged by ``by``."""
    return sketches.groupBy(*by).agg(*[F.hll_union_agg(f"sketch_{c}").alias(f"sketch_{c}") for c in columns])


def sketched_counts(sketches: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by, n_<column>) about."""
    return sketches.select(*by, *[F.hll_sketch_estimate(f"sketch_{c}").alias(f"n_{c}") for c in columns])


def cumulative_sketches(sketches: DataFrame, run: str, step: str, column: str) -> DataFrame:
    """(run, step, unique_so_far) about, from one sketch a step, of bounded size each."""
    so_far = F.hll_union_agg(f"sketch_{column}").over(Window.partitionBy(run).orderBy(step))
    return sketches.select(run, step, F.hll_sketch_estimate(so_far).alias("unique_so_far"))


def stop_report(log: DataFrame, run: str, step: str, budgets: dict[str, float]) -> DataFrame:
    """(run, last_step, <counter>, <counter>_part of its budget, stopped_by): the first counter in order that reached its budget, else "end" (A26)."""
    last = log.groupBy(run).agg(F.max_by(F.struct(F.col(step).alias("step"), *[F.col(c) for c in budgets]), F.col(step)).alias("last"))
    parts = {c: F.col(f"last.{c}") / float(b) for c, b in budgets.items()}
    stopped = F.coalesce(*[F.when(p >= 1, c) for c, p in parts.items()], F.lit("end"))
    return last.select(run, F.col("last.step").alias("last_step"), *[F.col(f"last.{c}").alias(c) for c in budgets], *[p.alias(f"{c}_part") for c, p in parts.items()], stopped.alias("stopped_by"))


def run_report(log: DataFrame, run: str, step: str, seconds: str, counter: str, budget: float) -> DataFrame:
    """(run, last step, its counter, part of the budget, mean rate); several budgets: ``stop_report``."""
    last = F.max_by(F.struct(F.col(step).alias("step"), F.col(counter).alias("n"), F.col(seconds).alias("s")), F.col(step)).alias("last")
    out = log.groupBy(run).agg(last)
    return out.select(run, F.col("last.step").alias("last_step"), F.col("last.n").alias("n"), (F.col("last.n") / budget).alias("budget_part"), (F.col("last.n") / F.greatest(F.lit(1.0), F.col("last.s"))).alias("mean_rate"))


def run_header(predictions: DataFrame, y: str = "y_true", tiles: str = "n_tiles", known: str = "has_demographics") -> DataFrame:
    """One row: patients, positives, negatives, tiles, join rate."""
    return predictions.agg(
        F.count("*").alias("patients"), F.sum(y).alias("n_pos"), F.sum(1 - F.col(y)).alias("n_neg"), F.sum(tiles).alias("tiles"), F.avg(F.col(known).cast("double")).alias("join_rate")
    )

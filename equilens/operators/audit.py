"""Audits: each returns a table of violations, empty when all is well."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import finite_prediction
from ..sources.contracts import receipt_mismatches


def prediction_rows(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, patient_id, problem): no id, bad label or score, repeated patient; without ``by``, no rows at all is a problem too (V1)."""
    keys = by or []
    problem = F.when(F.coalesce(F.trim("patient_id"), F.lit("")) == "", "no id").when(~finite_prediction(F.col("y_true"), F.col("y_score")), "label or score")
    bad = predictions.select(*keys, "patient_id", problem.alias("problem")).where("problem is not null")
    repeated = predictions.groupBy(*keys, "patient_id").count().where("count > 1").select(*keys, "patient_id", F.lit("repeated").alias("problem"))
    found = bad.unionByName(repeated)
    if not keys:
        none = predictions.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("patient_id"), F.lit("no rows").alias("problem"))
        found = found.unionByName(none)
    return found


def arm_alignment(records: DataFrame, compared: list[str], reference: tuple[str, int]) -> DataFrame:
    """(arm, run, patient_id, problem) against the reference run: patients absent or extra, values that differ."""
    arm, run = reference
    ref = records.where((F.col("arm") == arm) & (F.col("run") == run)).select("patient_id", *[F.col(c).alias(f"_{c}") for c in compared]).withColumn("_in", F.lit(True))
    runs = records.select("arm", "run").distinct()
    wanted = ref.crossJoin(F.broadcast(runs))  # every run has to hold every patient of the reference
    both = wanted.join(records.withColumn("_has", F.lit(True)), ["arm", "run", "patient_id"], "full")
    problem = F.when(F.col("_has").isNull(), "absent").when(F.col("_in").isNull(), "extra")
    for c in compared:
        problem = problem.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), f"{c} differs")
    return both.select("arm", "run", "patient_id", problem.alias("problem")).where("problem is not null")


def run_counts(records: DataFrame) -> DataFrame:
    """(arm, runs) of arms with another number of runs than the arm with most (V2)."""
    runs = records.groupBy("arm").agg(F.countDistinct("run").alias("runs"))
    return runs.crossJoin(F.broadcast(runs.agg(F.max("runs").alias("most")))).where("runs != most").drop("most")


def fold_coverage(records: DataFrame, fold: str, required: list[int], by: list[str] | None = None) -> DataFrame:
    """(by, fold, problem): required folds absent, others present (V3, U4)."""
    keys = by or []
    seen = records.select(*keys, F.col(fold).cast("int").alias("fold")).distinct()
    groups = records.select(*keys).distinct() if keys else None
    wanted = records.sparkSession.createDataFrame([(f,) for f in required], "fold int")
    wanted = groups.crossJoin(F.broadcast(wanted)) if keys else wanted
    on = [*keys, "fold"]
    absent = wanted.join(seen, on, "left_anti").withColumn("problem", F.lit("absent"))
    other = seen.where(~F.coalesce(F.col("fold").isin(required), F.lit(False))).withColumn("problem", F.lit("not required"))
    return absent.select(*on, "problem").unionByName(other.select(*on, "problem"))


def nested_records(records: DataFrame, folds: int = 5) -> DataFrame:
    """(problem, n) of nested cross-fit rows (V4).

    A patient has one outer row in its own fold and an inner row in every other calibration fold.
    """
    k, own, j = F.col("calibration_outer_fold"), F.col("original_fold"), F.col("inner_fold")
    outer = F.col("prediction_role") == "outer"
    problem = (
        F.when(~F.coalesce(F.col("prediction_role").isin("outer", "inner"), F.lit(False)), "role")
        .when(F.coalesce(F.trim("tss"), F.lit("")) == "", "no site")
        .when(outer & ((k != own) | j.isNotNull()), "outer fold")
        .when(~outer & ((k == own) | j.isNull() | (j != own)), "inner fold")
    )
    bad = records.select(problem.alias("problem")).where("problem is not null")
    repeated = records.groupBy("patient_id", "prediction_role", "calibration_outer_fold").count().where("count > 1").select(F.lit("repeated").alias("problem"))
    counts = records.groupBy("patient_id").agg(F.sum(outer.cast("int")).alias("o"), F.sum((~outer).cast("int")).alias("i"))
    uneven = counts.where((F.col("o") != 1) | (F.col("i") != folds - 1)).select(F.lit("rows of a patient").alias("problem"))
    return bad.unionByName(repeated).unionByName(uneven).groupBy("problem").agg(F.count("*").alias("n"))


def nested_training(audit: DataFrame, folds: list[int], by: list[str] | None = None) -> DataFrame:
    """(by, outer_fold, inner_fold, problem) of training audits against the full grid (V5). audit: (by, outer_fold, inner_fold, folds)."""
    keys = by or []
    grid = [(k, j, [f for f in folds if f not in (k, j)]) for k in folds for j in [None, *[f for f in folds if f != k]]]
    want = audit.sparkSession.createDataFrame(grid, "outer_fold int, inner_fold int, _folds array<int>")
    on = [*keys, "outer_fold", "inner_fold"]
    want = audit.select(*keys).distinct().crossJoin(F.broadcast(want)) if keys else want  # the grid of each audit, as many rows as models
    want = want.select(*[F.col(c).alias(f"_{c}") for c in on], "_folds")
    a = audit.select(*on, F.array_sort("folds").alias("folds")).withColumn("_has", F.lit(True))
    both = want.join(a, functools.reduce(lambda x, y: x & y, [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in on]), "full")
    problem = F.when(F.col("_has").isNull(), "absent").when(F.col("_folds").isNull(), "extra").when(F.col("_folds") != F.col("folds"), "folds")
    # Of the keys an inner fold alone may be null, on both sides.
    return both.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) for c in on], problem.alias("problem")).where("problem is not null")


def checks(rows: DataFrame, rules: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """(by, check) of the rules that contracts, one a row, do not meet, nulls included."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda c: c.isNotNull())
    return rows.select(*(by or []), F.explode(failed).alias("check"))


def study_contract(contract: DataFrame, seed: int, lambda_: float | None = None, command: dict[str, object] | None = None, by: list[str] | None = None) -> DataFrame:
    """(by, check): a study declaration's own rules; the strength of a run and the fields of its command, where given, have to be those declared (V6)."""
    seeds = F.col("planned_head_seeds")
    required = ["study", "fold_seed", "head_architecture", "primary_estimand", "sensitive", "method"]
    rules = {f"{c} present": F.col(c).isNotNull() for c in required}
    rules |= {
        "seeds unique": F.size(F.array_distinct(seeds)) == F.size(seeds), "at most five seeds": F.size(seeds).between(1, 5), "seed declared": F.array_contains(seeds, seed),
        "margin": F.col("utility_noninferiority_margin") >= 0, "lambda": F.col("posthoc_lambda") >= 0, "temperature": F.col("temperature") > 0,
    }
    if lambda_ is not None:
        rules["lambda of the run"] = F.lit(lambda_).isin(0.0) | (F.lit(lambda_) == F.col("posthoc_lambda"))
    rules |= {f"{k} of the command": F.col(k).eqNullSafe(F.lit(v)) for k, v in (command or {}).items()}
    return checks(contract, rules, by)


def provenance(runs: DataFrame, files: DataFrame, posthoc_lambda: float) -> DataFrame:
    """(arm, run, problem) of run results against prediction files.

    runs: (arm, run, schema, seed, task, lambda_adv, checkpoint, sha256, n), and where a study records them split_seed,
    contract_sha256, intervention (whether the checkpoint was trained with one) and inputs (digests by name);
    files: (arm, run, sha256, n).
    """
    both = runs.join(files.select("arm", "run", F.col("sha256").alias("_sha"), F.col("n").alias("_n")), ["arm", "run"], "left")
    expected = F.when(F.col("arm") == "posthoc", posthoc_lambda).otherwise(0.0)
    problem = F.when(F.col("_sha").isNull(), "no file").when(F.col("sha256") != F.col("_sha"), "digest").when(F.col("n") != F.col("_n"), "record count").when(F.col("lambda_adv") != expected, "lambda")
    bad = both.select("arm", "run", problem.alias("problem")).where("problem is not null")
    one = lambda df, by, c, says: df.groupBy(*by).agg(F.countDistinct(c).alias("n"), F.min("arm").alias("arm") if "arm" not in by else F.lit(1).alias("_")).where("n > 1").select("arm", (F.col("run") if "run" in by else F.lit(None).cast("int")).alias("run"), F.lit(says).alias("problem"))
    constant = one(runs, ["arm"], "checkpoint", "checkpoint differs between seeds").unionByName(one(runs, ["arm"], "schema", "schema")).unionByName(one(runs, ["run"], "seed", "seed order")).unionByName(one(runs, ["run"], "task", "task"))
    same = {"split_seed": "split seed", "contract_sha256": "contract digest"}
    for c in [c for c in same if c in runs.columns]:
        whole = runs.withColumn("arm", F.lit(None).cast("string")).groupBy("arm").agg(F.countDistinct(c).alias("n"), F.count(F.when(F.col(c).isNull(), 1)).alias("absent"))
        constant = constant.unionByName(whole.where("n > 1 or absent > 0").select("arm", F.lit(None).cast("int").alias("run"), F.lit(same[c]).alias("problem")))
    if "intervention" in runs.columns:
        wrong = runs.where(~F.col("intervention").eqNullSafe(F.col("arm") == "pretraining"))
        constant = constant.unionByName(wrong.select("arm", "run", F.lit("intervention").alias("problem")))
    if "inputs" in runs.columns:
        blank = F.coalesce(F.size("inputs"), F.lit(0)) <= 0
        unrecorded = runs.where(blank | F.exists(F.map_values("inputs"), lambda d: F.coalesce(d, F.lit("")) == ""))
        constant = constant.unionByName(unrecorded.select("arm", "run", F.lit("inputs not recorded").alias("problem")))
    reused = files.groupBy("sha256").agg(F.count("*").alias("n"), F.min("arm").alias("arm"), F.min("run").alias("run")).where("n > 1").select("arm", "run", F.lit("file reused").alias("problem"))
    of = runs.groupBy("arm").agg(F.min("checkpoint").alias("c"))
    wide = of.agg(*[F.max(F.when(F.col("arm") == a, F.col("c"))).alias(a) for a in ("control", "posthoc", "pretraining")])
    stage = F.when(F.col("control") != F.col("posthoc"), "control and posthoc checkpoints differ").when(F.col("control") == F.col("pretraining"), "pretraining checkpoint is the control's")
    staged = wide.select(F.lit(None).cast("string").alias("arm"), F.lit(None).cast("int").alias("run"), stage.alias("problem")).where("problem is not null")
    return bad.unionByName(constant).unionByName(reused).unionByName(staged)


def coverage_agreement(coverage: DataFrame, predictions: DataFrame) -> DataFrame:
    """(task, problem): predicted patients against those with tiles, labelled against both parts (V8)."""
    n = predictions.groupBy("task").agg(F.countDistinct("patient_id").alias("predicted"))
    problem = F.when(~F.col("predicted").eqNullSafe(F.col("with_tiles")), "predicted").when(F.col("labelled") != F.col("with_tiles") + F.col("missing"), "labelled")
    return coverage.join(n, "task", "left").select("task", problem.alias("problem")).where("problem is not null")


def digests_disagree(receipts: DataFrame) -> DataFrame:
    """(field, values) of digests that receipts name differently or not at all (V8). receipts: (receipt, field, sha256)."""
    return receipts.groupBy("field").agg(F.countDistinct("sha256").alias("values"), F.count(F.when(F.col("sha256").isNull(), 1)).alias("absent")).where("values != 1 or absent > 0").select("field", "values")


def checkpoint_holdout(checkpoints: DataFrame, task: str, by: list[str] | None = None) -> DataFrame:
    """(by, check) of checkpoints, one a row, that did not hold out the task's patients (V11). checkpoints: (by, holdout_task)."""
    return checks(checkpoints, {"holdout task": F.col("holdout_task") == task}, by)


def training_inputs(config: DataFrame, receipt: DataFrame, fields: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, field, expected, observed) of training configurations against the metadata receipts, one row of each for each ``by``."""
    return receipt_mismatches(receipt, config, fields, by)


def leaked(training: DataFrame, holdout: DataFrame, key: str) -> DataFrame:
    """Holdout ids that occur in training."""
    return training.select(key).distinct().join(holdout.select(key), key, "left_semi")


def slides_in_several_files(tiles: DataFrame, slide: str, file: str) -> DataFrame:
    """(slide, files)."""
    return tiles.groupBy(slide).agg(F.countDistinct(file).alias("files")).where("files > 1")

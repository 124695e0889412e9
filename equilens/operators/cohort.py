"""Cohort joins, filters, coverage and count tables.

Which side of a join is broadcast is left to Spark, which knows sizes in bytes, at planning and again at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import k_folds

def tiles_of(tiles: DataFrame, patients: DataFrame, key: str) -> DataFrame:
    """Tiles of the given patients."""
    return tiles.join(patients.select(key).distinct(), key, "left_semi")


def exclude_holdout(tiles: DataFrame, holdout: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Tiles without the holdout patients, and one row (tiles_excluded, patients_excluded) (F2)."""
    held = holdout.select(key).distinct()
    gone = tiles.join(held, key, "left_semi").agg(F.count("*").alias("tiles_excluded"), F.countDistinct(key).alias("patients_excluded"))
    return tiles.join(held, key, "left_anti"), gone


def labelled(patients: DataFrame, label: str, fold: str | None = None, where: Column | None = None) -> DataFrame:
    """Patients with a whole-number label, and fold where asked for; ``where`` narrows the task."""
    out = patients.withColumn(label, F.col(label).cast("string").try_cast("double").try_cast("int")).where(F.col(label).isNotNull())
    if fold:
        out = out.withColumn(fold, F.col(fold).cast("string").try_cast("double").try_cast("int")).where(F.col(fold).isNotNull())
    return out if where is None else out.where(where)


def known(df: DataFrame, *columns: str) -> DataFrame:
    """Rows where all of the columns are known."""
    return df.dropna(subset=list(columns))


def join_demographics(patients: DataFrame, demographics: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Patients with what is known of them, and one row (patients, join_rate); where no patient is found at all, reading that row is an error."""
    d = demographics.withColumn("_known", F.lit(True))
    joined = patients.join(d, key, "left")
    rate = joined.agg(F.count("*").alias("patients"), F.avg(F.col("_known").isNotNull().cast("double")).alias("join_rate"))
    none = F.raise_error(F.lit("no patient has demographics: are the keys of one kind?")).cast("double")
    return joined.drop("_known"), rate.withColumn("join_rate", F.when((F.col("patients") > 0) & (F.col("join_rate") == 0), none).otherwise(F.col("join_rate")))


def merge_right_wins(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """All keys of both; of a column in both, the right one's value where it has one."""
    both = [c for c in left.columns if c in right.columns and c != key]
    r = right.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_r_{c}") for c in right.columns if c != key])
    joined = left.join(r, left[key] == r["_key"], "full")
    columns = [F.coalesce(F.col("_key"), left[key]).alias(key)]
    columns += [(F.coalesce(F.col(f"_r_{c}"), left[c]) if c in both else left[c]).alias(c) for c in left.columns if c != key]
    columns += [F.col(f"_r_{c}").alias(c) for c in right.columns if c != key and c not in both]
    return joined.select(*columns)


def molecular_cohort(molecular: DataFrame, demographics: DataFrame, key: str, cancer_col: str, cancer_type: str) -> DataFrame:
    """Molecular rows of patients with the cancer type."""
    return molecular.join(demographics.where(F.upper(cancer_col) == cancer_type.upper()), key)


def with_hospital_folds(cohort: DataFrame, folds: DataFrame, key: str) -> DataFrame:
    """The cohort inside the hospital folds; an empty result is an error when it is run."""
    joined = cohort.join(folds, key)
    if not joined.limit(1).count():
        raise ValueError("no patient of the cohort is in a hospital fold")
    return joined


def factor_labels(tiles: DataFrame, factors: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Tiles with one column for each factor, null where it is unknown (J8). factors: (factor, key, id)."""
    wide = factors.groupBy(key).pivot("factor", names).agg(F.first("id"))
    return tiles.join(wide, key, "left")


def later_file_wins(files: list[DataFrame], key: str, fields: list[str]) -> DataFrame:
    """Per key and field, the value of the last file that has one."""
    rows = None
    for priority, df in enumerate(files):
        part = df.select(key, F.lit(priority).alias("_p"), *[(F.col(f) if f in df.columns else F.lit(None)).cast("string").alias(f) for f in fields])
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("_p"))).alias(f) for f in fields])


def first_named(df: DataFrame, candidates: list[str]) -> Column:
    """The value of the first of the candidate columns that ``df`` has and that is not blank."""
    there = {c.lower(): c for c in df.columns}
    found = [F.nullif(F.trim(F.col(f"`{there[c.lower()]}`").cast("string")), F.lit("")) for c in candidates if c.lower() in there]
    if not found:
        raise ValueError(f"none of {candidates} among {df.columns}")
    return F.coalesce(*found)


def with_tissue(tiles: DataFrame, fraction: Column, least: float) -> DataFrame:
    """Tiles with at least that much tissue; an undecodable tile has none."""
    return tiles.where(F.coalesce(fraction >= least, F.lit(False)))


def with_tile_labels(indexed: DataFrame, labels: DataFrame, index: str = "tile_index") -> DataFrame:
    """Tiles, numbered through all shards, with the labels kept by that number (S11, on W13); null where there is none."""
    return indexed.join(labels, index, "left")


def without_payload(embedded: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """Patients all of whose tiles failed (F8)."""
    return embedded.groupBy(key).agg(F.count(vector).alias("_n"), F.count("*").alias("tiles")).where("_n = 0").select(key, "tiles")


#: Label and usual fold column of the tasks, and the cancer type that the demographics must have.
MOLECULAR_TASKS = {
    **{f"{c}_tp53": ("tp53_status", f"fold_tp53_{c}", None) for c in ("brca", "ucec", "coad", "luad")},
    "coad_stage": ("stage_bin", None, "COAD"),
    "lihc_grade": ("tumor_grade_bin", None, "LIHC"),
}
CLINICAL_TASKS = ("nsclc", "glioma", "brca")


def task_cohort(task: str, demographics: DataFrame, molecular: DataFrame, key: str, fold: str | None = None, label: str | None = None, k: int = 5) -> DataFrame:
    """(key, label, fold) of a task; folds are dealt by label where the task has no fold column.

    A task that has no name here is an external cohort: its label, and fold if any, are columns of ``molecular``.
    """
    if task in CLINICAL_TASKS:
        source, label, fold = demographics, f"label_{task}", fold or f"fold_{task}"
    else:
        if task not in MOLECULAR_TASKS and not label:
            raise ValueError(f"unknown task {task}, and no label column")
        own, usual, cancer = MOLECULAR_TASKS.get(task, (label, None, None))
        source, label, fold = molecular, own, fold or usual
        if cancer:
            source = source.join(demographics.where(F.upper(F.trim("cancer_type")) == cancer).select(key).distinct(), key, "left_semi")
    rows = labelled(source, label, fold)
    return rows.select(key, F.col(label).alias("label"), F.col(fold).alias("fold")) if fold else k_folds(rows.select(key, F.col(label).alias("label")), key, "label", k)


def first_names(df: DataFrame, name: str, n: int = 5) -> str:
    """The first few names in order, for an error (L4)."""
    found = [r[0] for r in df.select(name).orderBy(name).limit(n + 1).collect()]
    return ", ".join(map(str, found[:n])) + (", ..." if len(found) > n else "")


def annotate(predictions: DataFrame, folds: DataFrame, sites: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Predictions with fold and site, and the patients that have no fold; see ``annotated`` for the strict form."""
    joined = predictions.join(folds, key, "left").join(sites, key, "left")
    return joined, joined.where(F.col("outer_fold").isNull()).select(key).distinct()


def annotated(predictions: DataFrame, folds: DataFrame, sites: DataFrame, key: str) -> DataFrame:
    """The same, and an unknown patient is an error that names the first few."""
    joined, unknown = annotate(predictions, folds, sites, key)
    if unknown.limit(1).count():
        raise ValueError(f"patients without a fold: {first_names(unknown, key)}")
    return joined


def with_roles(train: DataFrame, external: DataFrame) -> DataFrame:
    """Both cohorts with ``role``."""
    return train.withColumn("role", F.lit("train")).unionByName(external.withColumn("role", F.lit("external")), allowMissingColumns=True)


def tile_roles(slides: DataFrame, task: DataFrame, pool: DataFrame, key: str) -> DataFrame:
    """Slides of task patients and of pool patients, with ``role``; a patient of both is of the task (S3)."""
    roles = task.select(key).distinct().withColumn("role", F.lit("task")).unionByName(pool.select(key).distinct().join(task.select(key), key, "left_anti").withColumn("role", F.lit("pool")))
    return slides.join(roles, key)


def coverage(labels: DataFrame, tiles: DataFrame, key: str, task: str = "task") -> DataFrame:
    """(task, labelled, with_tiles, fraction, missing, slides) (J5, A14). labels: (task, key); tiles: (key, slide)."""
    slides = tiles.groupBy(key).agg(F.countDistinct("slide").alias("slides"))
    joined = labels.select(task, key).distinct().join(slides, key, "left")
    have = F.col("slides").isNotNull()
    return joined.groupBy(task).agg(
        F.count("*").alias("labelled"), F.sum(have.cast("long")).alias("with_tiles"), F.avg(have.cast("double")).alias("fraction"),
        F.sum((~have).cast("long")).alias("missing"), F.coalesce(F.sum("slides"), F.lit(0)).alias("slides"),
    )


def missing_ids(labels: DataFrame, tiles: DataFrame, key: str, task: str = "task") -> DataFrame:
    """(task, key) of labelled patients without tiles."""
    return labels.select(task, key).distinct().join(tiles.select(key), key, "left_anti")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n), blank as <missing>."""
    value = F.coalesce(F.nullif(F.trim(F.col(column)), F.lit("")), F.lit("<missing>"))
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("n"))


def status_matrix(df: DataFrame, cohorts: dict[str, Column], status: str, statuses: list[str]) -> DataFrame:
    """(cohort, one count for each status); a patient counts in every cohort it is in, zeros are kept."""
    member = F.filter(F.array(*[F.when(is_in, F.lit(name)) for name, is_in in cohorts.items()]), lambda c: c.isNotNull())
    counted = df.select(status, F.explode(member).alias("cohort")).groupBy("cohort").pivot(status, statuses).count()
    every = df.sparkSession.createDataFrame([(name,) for name in cohorts], "cohort string")
    return every.join(counted, "cohort", "left").fillna(0, statuses)


def class_counts(df: DataFrame, labels: list[str]) -> DataFrame:
    """(task, label, n) over all label columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("task"), F.col(c).cast("string").alias("label")) for c in labels])
    return df.select(F.explode(pairs).alias("p")).select("p.*").where("label is not null").groupBy("task", "label").agg(F.count("*").alias("n"))

"""Readers and writers of cohort tables; every format goes through Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clinical import CASE, clean, whole
from ..functions.identity import last_wins, patient_of_path
from . import file_index

PREDICTION = "patient_id string, y_true int, y_score double, race string, sex string, age double, outer_fold int, tss string, site string, prediction_role string, original_fold int, calibration_outer_fold int, inner_fold int"
IMAGE_COLUMNS = ["jpeg", "image", "image_bytes"]


def tile_index(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file, row_index, patient_id) of the shards; no payload is read."""
    tiles = spark.read.option("pathGlobFilter", "shard-*.parquet").parquet(folder)
    return tiles.select("path", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row_index"), patient_of_path(F.col("path")).alias("patient_id"))


def slide_tiles(spark: SparkSession, folder: str, allowed: DataFrame | None = None, patient: str = "patient_id") -> DataFrame:
    """All files below a folder with ``file`` and ``row_index``, of the allowed patients alone where those are given.

    The patient of a file is that of its name, else of its first row (``file_index``); only the allowed patients' files are scanned.
    """
    if allowed is not None:
        return file_index.planned_scan(spark, file_index.listing(spark, folder), allowed, patient)
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(folder)
    return df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_index"))


def payload_of_files(spark: SparkSession, files: list[str], columns: list[str]) -> DataFrame:
    """Payload columns of a selected list of files alone, so that no other file is opened."""
    df = spark.read.parquet(*files)
    return df.select(*columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_index"))


def image_column(df: DataFrame) -> str:
    """The payload column."""
    for name in IMAGE_COLUMNS:
        if name in df.columns:
            return name
    raise ValueError(f"no image column among {df.columns}")


def keyed_csv(spark: SparkSession, path: str, key: str) -> DataFrame:
    """One row per key; of repeated keys the last row of the last file, by name; blank keys are dropped."""
    df = spark.read.option("header", True).option("nullValue", "").csv(path)
    return last_wins(in_file_order(df).where(clean(F.col(key)).isNotNull()), key, "_ordinal").drop("_ordinal")


def in_file_order(df: DataFrame, out: str = "_ordinal") -> DataFrame:
    """``df`` with its place as (file, start of the block, row in the scan), which orders rows as their files do.

    The number of a row in the scan rises inside a block, but blocks and files are dealt to tasks by size.
    """
    return df.withColumn(out, F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))


def subtype_labels(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, label) of a tab-separated file; what is no number is dropped."""
    df = spark.read.option("header", True).option("sep", "\t").csv(path)
    return df.select("case_id", whole(F.col("subtype")).alias("label")).where("label is not null")


def hospital_folds(spark: SparkSession, path: str) -> DataFrame:
    """(patient_barcode, fold) without blanks."""
    df = spark.read.option("header", True).csv(path)
    return df.select(clean(F.col("patient_barcode")).alias("patient_barcode"), whole(F.col("fold")).alias("fold")).dropna()


def cases(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a response file; a total that differs from the number of cases is an error."""
    schema = f"data struct<hits: array<struct<{CASE}>>, pagination: struct<total: long>>"
    response = spark.read.schema(schema).option("multiLine", True).json(path)
    n = F.size("data.hits").cast("long")
    whole_ = F.when(n == F.col("data.pagination.total"), F.col("data.hits")).otherwise(F.raise_error(F.lit("incomplete response")).cast(f"array<struct<{CASE}>>"))
    return response.select(F.explode(whole_).alias("c")).select("c.*")


def id_list(spark: SparkSession, path: str, name: str = "patient_id") -> DataFrame:
    """One id per line, blanks dropped."""
    return spark.read.text(path).select(F.trim("value").alias(name)).where(F.col(name) != "")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with the file of each row."""
    return spark.read.schema(PREDICTION).json(path).withColumn("file", F.col("_metadata.file_name"))


def factor_maps(spark: SparkSession, path: str) -> DataFrame:
    """(factor, patient_id, id) of a metadata file's discrete part."""
    df = spark.read.schema("discrete map<string, map<string, int>>").option("multiLine", True).json(path)
    return df.select(F.explode("discrete").alias("factor", "ids")).select("factor", F.explode("ids").alias("patient_id", "id"))


def factor_values(spark: SparkSession, path: str) -> DataFrame:
    """(factor, patient_id, values, width) of a metadata file's continuous part, scalars and arrays of numbers."""
    df = spark.read.schema("continuous map<string, map<string, string>>").option("multiLine", True).json(path)
    long = df.select(F.explode("continuous").alias("factor", "of")).select("factor", F.explode("of").alias("patient_id", "text"))
    values = F.coalesce(F.from_json("text", "array<double>"), F.array(F.col("text").try_cast("double")))
    return long.select("factor", "patient_id", values.alias("values"), F.size(values).alias("width"))


def run_results(spark: SparkSession, path: str) -> DataFrame:
    """One row per result file."""
    schema = "lambda_adv double, reliable_fairness struct<schema:string, core_task:string, split_seed:int, head_seed:int, prediction_artifact:struct<sha256:string, record_count:long>, checkpoint_identity:struct<sha256:string>>"
    r = spark.read.schema(schema).option("multiLine", True).json(path)
    f = "reliable_fairness."
    return r.select(
        F.col("_metadata.file_name").alias("file"), "lambda_adv", F.col(f + "schema").alias("schema"), F.col(f + "core_task").alias("task"), F.col(f + "split_seed").alias("split_seed"),
        F.col(f + "head_seed").alias("seed"), F.col(f + "prediction_artifact.sha256").alias("sha256"), F.col(f + "prediction_artifact.record_count").alias("n"), F.col(f + "checkpoint_identity.sha256").alias("checkpoint"),
    )


def study_contract(spark: SparkSession, path: str) -> DataFrame:
    """The one row of a study declaration."""
    schema = "study string, fold_seed int, head_architecture string, planned_head_seeds array<int>, primary_estimand string, utility_noninferiority_margin double, sensitive string, method string, condition_col string, temperature double, posthoc_lambda double"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def slide_per_file(df: DataFrame, slide: str = "slide_path", file: str = "file") -> DataFrame:
    """(file, slide, slides); a file with another number of slides than one shows in ``slides``."""
    return df.groupBy(file).agg(F.min(slide).alias(slide), F.countDistinct(slide).alias("slides"))


def first_row_ids(df: DataFrame, key: str, file: str = "file", place: str = "row_index") -> DataFrame:
    """(file, key) of the first row of each file."""
    return df.groupBy(file).agg(F.min_by(key, place).alias(key))


def training_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of a run's metrics."""
    return spark.read.json(path).withColumn("file", F.col("_metadata.file_name"))


def write_csv(df: DataFrame, path: str) -> None:
    """With header; an existing target is an error (K1, K7)."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Predictions, receipts, reports and factor maps (K2, K4, K5, K6, K7)."""
    df.write.mode("errorifexists").json(path)


def write_ids(df: DataFrame, key: str, path: str) -> None:
    """A sorted id list; patient-size sets make one file (K3)."""
    df.select(F.col(key).cast("string").alias("value")).distinct().orderBy("value").coalesce(1).write.mode("errorifexists").text(path)

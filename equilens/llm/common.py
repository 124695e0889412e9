"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediates: spark.checkpoint.dir.

    Where that is unset, a session that runs in one process gets a fresh local folder; on a cluster it is an error,
    since executors would not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Tables:
    """Intermediates of one run of an operator, as Parquet in the shared folder: lineage ends there, and a lost executor
    costs nothing.  They are dropped by name as soon as nothing reads them any more; what a returned DataFrame still
    reads stays in the folder of the application."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written and read back; a table that had the name before is dropped once the new one stands."""
        before, path = self.paths.get(name), f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        if before:
            self._delete(before)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                self._delete(self.paths.pop(name))

    def _delete(self, path: str) -> None:
        context = self.spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows that hold long arrays go to Python in batches of so many while this lasts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns that an operator is about to produce (case-insensitive, as Spark resolves them)."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])

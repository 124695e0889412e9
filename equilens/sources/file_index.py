"""An index of table files made from names, footers and one row, and scans planned by it.

Listing opens nothing.  A file whose name starts with a barcode is never opened to know its patient; of the others, tasks
read the first row.  Row counts, row groups and ranges of columns come from footers, which tasks read.  A file that cannot be
read shows in ``problem``; it stops nothing unless it is chosen for a scan.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import STEM, patient_of_file
from .contracts import files, located

RANGE = "struct<column:string,low:string,high:string,nulls:long,exact:boolean>"
FOOTER = f"path string, rows long, row_groups int, ranges array<{RANGE}>, problem string"
FIRST = "path string, case_id string, slide_path string, problem string"
#: Writers may cut longer texts in a footer's statistics.
WHOLE_TEXT = 64


def each_file(listed: DataFrame, read: Callable[[object], tuple], schema: str) -> DataFrame:
    """One row for each path: what ``read`` finds in the opened file, or nulls and the problem. Paths are dealt out to tasks."""
    width = len(schema.split(", ")) - 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import parquet

        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    system, name = located(path)
                    with system.open_input_file(name) as stream:
                        rows.append((path, *read(parquet.ParquetFile(stream)), None))
                except Exception as e:  # noqa: BLE001  whatever is wrong with the file is its problem
                    rows.append((path, *[None] * width, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")], dtype=object)

    return listed.select("path").repartition("path").mapInPandas(run, schema)


def first_ids(listed: DataFrame) -> DataFrame:
    """(path, case_id, slide_path, problem) of each file's first row; a column that a file lacks is null."""

    def read(file) -> tuple:
        wanted = ["case_id", "slide_path"]
        there = [c for c in wanted if c in file.schema_arrow.names]
        batch = next(file.iter_batches(batch_size=1, row_groups=[0], columns=there), None) if file.num_row_groups and there else None
        row = batch.to_pylist()[0] if batch is not None and len(batch) else {}
        return tuple(None if row.get(c) is None else str(row[c]) for c in wanted)

    return each_file(listed, read, FIRST)


def range_of(file, column: str) -> dict:
    """Lowest and highest value of a column over all row groups; not ``exact`` where some group does not say."""
    meta, found = file.metadata, {"column": column, "low": None, "high": None, "nulls": None, "exact": False}
    places = [i for i in range(meta.num_columns) if meta.schema.column(i).path == column]
    if not places:
        return found
    groups = [meta.row_group(g) for g in range(meta.num_row_groups)]
    stats = [g.column(places[0]).statistics for g in groups if g.num_rows]
    if not all(s is not None and s.has_null_count for s in stats):
        return found
    nulls = sum(s.null_count for s in stats)
    valued = [s for s in stats if s.has_min_max]
    lows, highs = [s.min for s in valued], [s.max for s in valued]
    said = all(s.has_min_max or s.num_values == 0 for s in stats) and all(not isinstance(v, str | bytes) or len(v) < WHOLE_TEXT for v in lows + highs)
    text = lambda v: v.decode(errors="replace") if isinstance(v, bytes) else str(v)
    return found | {"nulls": nulls, "exact": said, "low": text(min(lows)) if lows else None, "high": text(max(highs)) if highs else None}


def footers(listed: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """FOOTER of each file: rows, row groups and ranges of the given columns; no data page is read."""
    wanted = columns or []
    return each_file(listed, lambda file: (file.metadata.num_rows, file.metadata.num_row_groups, [range_of(file, c) for c in wanted]), FOOTER)


def row_counts(listed: DataFrame) -> DataFrame:
    """(name, rows) from footers, for ``counts_violations``; an unreadable file has no rows."""
    return footers(listed).join(listed.select("path", "name"), "path").select("name", "rows")


def slides_of_files(spark: SparkSession, listed: DataFrame, column: str = "slide_path") -> DataFrame:
    """(path, slide, slides): the one slide of each file, and how many there are where it is not one.

    Where a footer says that lowest and highest are the same and nothing is null, it decides. Only the other files are read.
    """
    said = footers(listed, [column]).withColumn("r", F.col("ranges")[0])
    one = F.coalesce(F.col("r.exact") & (F.col("r.low") == F.col("r.high")) & (F.col("r.nulls") == 0), F.lit(False))
    decided = said.where(one).select("path", F.col("r.low").alias("slide"), F.lit(1).cast("long").alias("slides"))
    unsure = [r["path"] for r in said.where(~one).select("path").toLocalIterator()]
    if not unsure:
        return decided
    read = spark.read.parquet(*unsure).select(local_uri(F.col("_metadata.file_path")).alias("uri"), F.col(column).cast("string").alias("slide"))
    counted = read.groupBy("uri").agg(F.min("slide").alias("slide"), F.countDistinct("slide").alias("slides"))
    known = listed.select("path", "uri").join(spark.createDataFrame([(p,) for p in unsure], "path string"), "path")
    return decided.unionByName(known.join(counted, "uri", "left").select("path", "slide", F.coalesce("slides", F.lit(0)).alias("slides")))


def local_uri(path):
    """Readers write the authority of local paths in different ways."""
    return F.regexp_replace(path, "^file:/+", "file:///")


def listing(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """``files`` with ``uri``, as a scan of them names them."""
    return files(spark, folder, pattern).withColumn("uri", local_uri(F.col("_metadata.file_path")))


def patients_of_files(listed: DataFrame, patient: str = "patient_id") -> DataFrame:
    """``listed`` with the patient of each file and ``problem``: by its name, else its first row's case, slide, else the stem."""
    stem = F.regexp_replace("name", r"\.parquet$", "")
    named = F.regexp_extract(stem, STEM, 1) != ""
    by_name = listed.where(named).withColumns({patient: F.regexp_extract(stem, STEM, 1), "problem": F.lit(None).cast("string")})
    first = first_ids(listed.where(~named))
    by_row = listed.where(~named).join(first, "path").withColumn(patient, patient_of_file(stem, F.col("case_id"), F.col("slide_path")))
    return by_name.unionByName(by_row.drop("case_id", "slide_path"))


def file_index(listed: DataFrame, allowed: DataFrame | None = None, patient: str = "patient_id") -> DataFrame:
    """(path, uri, name, size, patient, rows, row_groups, problem) of the allowed patients' files.

    Footers are read of these alone.
    """
    found = patients_of_files(listed, patient)
    if allowed is not None:
        found = found.join(allowed.select(patient).distinct(), patient, "left_semi")
    found = found.select("path", "uri", "name", "size", patient, F.col("problem").alias("_problem"))
    read = found.join(footers(found).drop("ranges"), "path")
    return read.withColumn("problem", F.coalesce("_problem", "problem")).drop("_problem")


def planned_scan(spark: SparkSession, listed: DataFrame, allowed: DataFrame, patient: str = "patient_id", columns: list[str] | None = None) -> DataFrame:
    """Rows of the allowed patients' files with ``file``, ``row_index`` and the patient; no other file is opened for its rows.

    The paths of the chosen files pass through the driver, as those of any scan do.
    """
    chosen = patients_of_files(listed, patient).join(allowed.select(patient).distinct(), patient, "left_semi")
    found = [(r["path"], r["uri"], r[patient]) for r in chosen.select("path", "uri", patient).collect()]
    if not found:
        return _like_any(spark, listed, patient, columns)
    df = spark.read.parquet(*[path for path, _, _ in found])
    df = df.select(*(columns or df.columns), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_index"))
    of_file = spark.createDataFrame([(uri, p) for _, uri, p in found], f"_uri string, {patient} string")
    out = df.drop(patient).withColumn("_uri", local_uri(F.col("file"))).join(of_file, "_uri")
    return out.drop("_uri")


def _like_any(spark: SparkSession, listed: DataFrame, patient: str, columns: list[str] | None) -> DataFrame:
    """No rows, in the columns of the first file that can be read."""
    for row in listed.orderBy("path").select("path").toLocalIterator():
        try:
            df = spark.read.parquet(row["path"])
        except Exception:  # noqa: BLE001  another file says it as well
            continue
        df = df.select(*(columns or df.columns), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_index"))
        return df.drop(patient).withColumn(patient, F.lit(None).cast("string")).where("false")
    return functools.reduce(lambda d, c: d.withColumn(c, F.lit(None).cast("string")), columns or [], spark.createDataFrame([], f"file string, row_index long, {patient} string"))

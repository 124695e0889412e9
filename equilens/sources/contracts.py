"""Dataset contracts: file inventories, digests, schemas, completeness and receipts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.identity import bucketed_digest, id_set_digest

RECEIPT = ["file_count", "total_bytes", "names_sha256", "sizes_sha256", "stats_sha256"]
#: Bytes that a content digest holds in memory.
CHUNK = 1 << 22


def files(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """(name, path, size, modified) of the files below a folder; contents are not read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    return df.select(F.substring_index("path", "/", -1).alias("name"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def listing_digest(listed: DataFrame, line: Column, out: str) -> DataFrame:
    """One row (out): lines in the order of names, by 4,096 buckets of names, so no task holds a whole listing."""
    return bucketed_digest(listed, line, F.struct(F.col("name"), line), F.substring(F.sha2(F.col("name").cast("binary"), 256), 1, 3)).select(F.col("sha256").alias(out))


def flat_digest(listed: DataFrame, line: Column) -> DataFrame:
    """One row (n, sha256): the digest of all lines in order as one text, each with a line feed.

    This is what a single reader would compute. It cannot be cut into parts: sorted lines stream through one task, which
    holds one of them at a time. Receipts that need not equal such a value use ``inventory``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h, n = hashlib.sha256(), 0
        for b in batches:
            for text in b["line"]:
                h.update(text.encode() + b"\n")
            n += len(b)
        yield pd.DataFrame({"n": [n], "sha256": [h.hexdigest()]})

    found = listed.select(line.alias("line")).repartition(1).sortWithinPartitions("line").mapInPandas(run, "n long, sha256 string")
    empty = hashlib.sha256(b"").hexdigest()
    return found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("sha256"), F.lit(empty)).alias("sha256"))


def inventory(listed: DataFrame) -> DataFrame:
    """One row: count, bytes, digests of names, of names with sizes, of names with sizes and times."""
    tab, size, time = F.lit("\t"), F.col("size").cast("string"), F.col("modified").cast("long").cast("string")
    out = listed.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"))
    lines = {"names_sha256": F.col("name"), "sizes_sha256": F.concat("name", tab, size), "stats_sha256": F.concat("name", tab, size, tab, time)}
    for name, line in lines.items():
        out = out.crossJoin(F.broadcast(listing_digest(listed, line, name)))  # one row each
    return out


def located(path: str) -> tuple:
    """(file system, name in it) of a path as listed, whose characters are not escaped."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(quote(path, safe=":/"))


def opened(path: str):
    """A stream of a file for a task, by the file system that its path names."""
    system, name = located(path)
    return system.open_input_stream(name)


def content_digests(listed: DataFrame, tasks: int | None = None) -> DataFrame:
    """(name, size, sha256) of every file; paths are dealt out to tasks, which read CHUNK bytes at a time."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path in b["path"]:
                h = hashlib.sha256()
                with opened(path) as stream:
                    while part := stream.read(CHUNK):
                        h.update(part)
                out.append(h.hexdigest())
            yield b[["name", "size"]].assign(sha256=out)

    paths = listed.select("name", "size", "path")
    paths = paths.repartition(tasks, "path") if tasks else paths.repartition("path")
    return paths.mapInPandas(digest, "name string, size long, sha256 string")


def manifest(digests: DataFrame) -> DataFrame:
    """One row: digest of the ordered names, sizes and content digests."""
    line = F.concat("name", F.lit("\t"), F.col("size").cast("string"), F.lit("\t"), "sha256")
    return digests.agg(F.count("*").alias("file_count")).crossJoin(F.broadcast(listing_digest(digests, line, "content_sha256")))


def schema_violations(listed: DataFrame, expected: str) -> DataFrame:
    """(path, field, expected, found) where a file's own schema is not exactly the contract's; tasks read the footers (C4)."""
    want = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(expected)}

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import parquet
        from pyspark.sql.pandas.types import from_arrow_type

        for b in batches:
            rows = []
            for path in b["path"]:
                system, name = located(path)
                have = {f.name: from_arrow_type(f.type).simpleString() for f in parquet.read_schema(name, filesystem=system)}
                rows += [(path, n, want.get(n), have.get(n)) for n in sorted(want.keys() | have.keys()) if want.get(n) != have.get(n)]
            yield pd.DataFrame(rows, columns=["path", "field", "expected", "found"])

    return listed.select("path").repartition("path").mapInPandas(compared, "path string, field string, expected string, found string")


def shard_completeness(listed: DataFrame, n: int, name: str = "shard-%05d.parquet") -> DataFrame:
    """(name, problem): expected shards that are absent, files that are not expected."""
    expected = listed.sparkSession.range(n).select(F.format_string(name, "id").alias("name"))
    absent = expected.join(listed, "name", "left_anti").withColumn("problem", F.lit("missing"))
    extra = listed.select("name").join(expected, "name", "left_anti").withColumn("problem", F.lit("extra"))
    return absent.unionByName(extra)


def counts_violations(listed: DataFrame, rows_per_file: DataFrame, file_count: int, total_bytes: int, total_rows: int) -> DataFrame:
    """(check, expected, found) of counts against the contract; empty files count too (C6). rows_per_file: (name, rows)."""
    both = listed.join(rows_per_file, "name", "left").fillna(0, ["rows"])
    found = both.agg(F.count("*").alias("file count"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum((F.col("rows") == 0).cast("long")), F.lit(0)).alias("empty files"))
    want = {"file count": file_count, "bytes": total_bytes, "rows": total_rows, "empty files": 0}
    checks = F.array(*[F.struct(F.lit(k).alias("check"), F.lit(v).cast("long").alias("expected"), F.col(k).cast("long").alias("found")) for k, v in want.items()])
    return found.select(F.explode(checks).alias("c")).select("c.*").where("expected != found")


def empty_first_rows(df: DataFrame, payload: str, file: str = "file", place: str = "row_index") -> DataFrame:
    """Files whose first row has no payload."""
    return df.where((F.col(place) == 0) & (F.coalesce(F.length(payload), F.lit(0)) == 0)).select(file)


def stray_files(found: DataFrame, listed: DataFrame) -> DataFrame:
    """Paths outside the contract."""
    return found.select("path").join(listed.select("path"), "path", "left_anti")


def receipt(current: DataFrame, content: DataFrame, dataset: str, revision: str, total_rows: int) -> DataFrame:
    """One row: what a dataset was when it was checked (K4). current: ``inventory``; content: ``manifest``."""
    named = {"schema": "dataset-receipt/v1", "dataset": dataset, "revision": revision}
    return current.crossJoin(content.select("content_sha256")).select(*[F.lit(v).alias(k) for k, v in named.items()], *RECEIPT, "content_sha256", F.lit(total_rows).cast("long").alias("total_rows"))


def pool_receipt(pool: DataFrame, strata: DataFrame, key: str, seed: int) -> DataFrame:
    """One row: seed, counts by stratum and the digest of the selected ids (K4). strata: (stratum, candidates, selected)."""
    counts = strata.agg(F.sum("candidates").alias("candidates"), F.sum("selected").alias("selected"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("stratum", "selected")))).alias("strata"))
    return counts.crossJoin(id_set_digest(pool, key).select("sha256")).select(F.lit("balanced-pool/v1").alias("schema"), F.lit(seed).alias("seed"), "candidates", "selected", "strata", F.col("sha256").alias("selected_sha256"))


def pairs_of(row: DataFrame, fields: list[str], name: str, by: list[str] | None = None) -> DataFrame:
    """(by, field, name) of a table with one row, or one for each ``by``."""
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields])
    return row.select(*(by or []), F.explode(entries).alias("p")).select(*(by or []), "p.*")


def contract_mismatches(row: DataFrame, contract: dict[str, object]) -> DataFrame:
    """(field, expected, observed) of a receipt against a pinned contract: schema, dataset, revision, counts and digests."""
    wanted = [(k, str(v)) for k, v in contract.items()]
    expected = row.sparkSession.createDataFrame(wanted, "field string, expected string")
    both = expected.join(pairs_of(row, list(contract), "observed"), "field", "left")
    return both.where(~F.col("expected").eqNullSafe(F.col("observed")))


def artifact_mismatches(receipt_digests: DataFrame, digests: DataFrame) -> DataFrame:
    """(name, expected, observed) of artifacts that are absent or not those of the receipt (C10, V13). Both: (name, sha256)."""
    both = receipt_digests.select("name", F.col("sha256").alias("expected")).join(digests.select("name", F.col("sha256").alias("observed")), "name", "left")
    return both.where(~F.col("expected").eqNullSafe(F.col("observed")))


def receipt_mismatches(receipt: DataFrame, current: DataFrame, fields: list[str] = RECEIPT, by: list[str] | None = None) -> DataFrame:
    """(by, field, expected, observed) of one receipt, or of one for each ``by``."""
    both = pairs_of(receipt, fields, "expected", by).join(pairs_of(current, fields, "observed", by), [*(by or []), "field"], "full")
    return both.where(~F.col("expected").eqNullSafe(F.col("observed")))


def duplicates(listed: DataFrame) -> DataFrame:
    """Names that occur more than once below the root."""
    return listed.withColumn("n", F.count("*").over(Window.partitionBy("name"))).where("n > 1").select("name").distinct()

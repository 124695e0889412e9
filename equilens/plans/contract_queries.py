"""Source, contract, audit, factor and report queries with their SQL; the tables stand in for listings, receipts and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clinical, identity, vectors
from ..operators import audit, cohort, embed, factors, folds, metrics, pairwise, runlog, sampling
from ..sources import contracts, file_index, tables
from .roles import ARM_SCORES, PATIENTS, PREDICTIONS, SLIDES, TILES, arm_scores, patients, predictions, slides, table, tiles

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# Listings and receipts: orders as files


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("name", F.format_string("shard-%05d.parquet", "o_orderkey"))
    size = F.floor("o_totalprice").cast("long")
    modified = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(o_orderdate AS timestamp_ntz))")
    return o.select("name", F.concat(F.lit("/data/"), "name").alias("path"), size.alias("size"), modified.alias("modified"), "o_orderkey", "o_orderstatus")


LISTING = "listing AS (SELECT printf('shard-%05d.parquet', o_orderkey) AS name, floor(o_totalprice)::BIGINT AS size, epoch(o_orderdate)::BIGINT AS modified, o_orderkey, o_orderstatus FROM orders)"


def lines(text: str) -> str:
    """Of all names in ``listing``: lines by bucket, then the buckets."""
    return f"(SELECT sha256(coalesce(string_agg(d, chr(10) ORDER BY b), '')) FROM (SELECT substr(sha256(name), 1, 3) AS b, sha256(string_agg({text}, chr(10) ORDER BY name, {text})) AS d FROM listing GROUP BY b))"


@query
def listing_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.inventory(listing(spark, sf_dir))


SQL["listing_inventory"] = f"""WITH {LISTING} SELECT count(*) AS file_count, sum(size)::BIGINT AS total_bytes, {lines("name")} AS names_sha256,
{lines("name || chr(9) || size")} AS sizes_sha256, {lines("name || chr(9) || size || chr(9) || modified")} AS stats_sha256 FROM listing"""


@query
def receipt_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs once a file in ten has grown by a byte."""
    before = listing(spark, sf_dir)
    after = before.withColumn("size", F.col("size") + (F.col("o_orderkey") % 10 == 0).cast("long"))
    return contracts.receipt_mismatches(contracts.inventory(before), contracts.inventory(after))


GROWN = "size + (o_orderkey % 10 = 0)::BIGINT"
SQL["receipt_check"] = f"""WITH {LISTING} SELECT 'total_bytes' AS field, sum(size)::BIGINT::VARCHAR AS expected, sum({GROWN})::BIGINT::VARCHAR AS observed FROM listing
UNION ALL SELECT 'sizes_sha256', {lines("name || chr(9) || size")}, {lines(f"name || chr(9) || ({GROWN})")}
UNION ALL SELECT 'stats_sha256', {lines("name || chr(9) || size || chr(9) || modified")}, {lines(f"name || chr(9) || ({GROWN}) || chr(9) || modified")}"""


@query
def dataset_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A receipt against a contract that has another revision and another number of rows."""
    listed = listing(spark, sf_dir)
    content = contracts.manifest(listed.withColumn("sha256", F.sha2(F.col("name").cast("binary"), 256)))
    row = contracts.receipt(contracts.inventory(listed), content, "orders", "r2", 7)
    return contracts.contract_mismatches(row, {"schema": "dataset-receipt/v1", "dataset": "orders", "revision": "r1", "total_rows": 8, "content_sha256": "none"})


SQL["dataset_receipt"] = f"""WITH {LISTING} SELECT * FROM (VALUES ('revision', 'r1', 'r2'), ('total_rows', '8', '7')) t(field, expected, observed)
UNION ALL SELECT 'content_sha256', 'none', {lines("name || chr(9) || size || chr(9) || sha256(name)")}"""


@query
def artifact_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = listing(spark, sf_dir).select("o_orderkey", "name", F.sha2(F.col("size").cast("string").cast("binary"), 256).alias("sha256"))
    current = digests.where("o_orderkey % 50 != 0").withColumn("sha256", F.when(F.col("o_orderkey") % 30 == 0, "edited").otherwise(F.col("sha256")))
    return contracts.artifact_mismatches(digests, current)


SQL["artifact_check"] = f"""WITH {LISTING} SELECT name, sha256(size::VARCHAR) AS expected, CASE WHEN o_orderkey % 50 != 0 THEN 'edited' END AS observed FROM listing WHERE o_orderkey % 50 = 0 OR o_orderkey % 30 = 0"""


@query
def shard_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "part").where("p_partkey % 7 != 0").select(F.format_string("shard-%05d.parquet", "p_partkey").alias("name"))
    return contracts.shard_completeness(listed, 150)


SQL["shard_completeness"] = """WITH listed AS (SELECT printf('shard-%05d.parquet', p_partkey) AS name FROM part WHERE p_partkey % 7 != 0), wanted AS (SELECT printf('shard-%05d.parquet', k) AS name FROM range(150) t(k))
SELECT name, 'missing' AS problem FROM wanted ANTI JOIN listed USING (name) UNION ALL SELECT name, 'extra' FROM listed ANTI JOIN wanted USING (name)"""


@query
def counts_against_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tiles(spark, sf_dir).groupBy(F.format_string("shard-%05d.parquet", "slide").alias("name")).agg(F.count("*").alias("rows"))
    return contracts.counts_violations(listing(spark, sf_dir), rows.where("rows > 1"), 5, 0, 10)


SQL["counts_against_contract"] = f"""WITH {LISTING}, {TILES}, r AS (SELECT printf('shard-%05d.parquet', slide) AS name, count(*) AS n FROM tiles GROUP BY slide HAVING count(*) > 1),
f AS (SELECT size, coalesce(n, 0) AS n FROM listing LEFT JOIN r USING (name))
SELECT * FROM (SELECT 'file count' AS "check", 5::BIGINT AS expected, count(*) AS found FROM f UNION ALL SELECT 'bytes', 0, sum(size)::BIGINT FROM f UNION ALL SELECT 'rows', 10, sum(n)::BIGINT FROM f UNION ALL SELECT 'empty files', 0, count(*) FILTER (WHERE n = 0) FROM f) WHERE expected != found"""


@query
def empty_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as files of orders, the first without a payload in a file of five."""
    rows = sampling.global_index(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"], "place")
    first = rows.groupBy("o_custkey").agg(F.min("place").alias("first"))
    placed = rows.join(first, "o_custkey").withColumn("row_index", F.col("place") - F.col("first")).withColumnRenamed("o_custkey", "file")
    return contracts.empty_first_rows(placed.withColumn("payload", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus").cast("binary"))), "payload")


SQL["empty_first_rows"] = "SELECT o_custkey AS file FROM orders GROUP BY o_custkey HAVING min(o_orderkey) % 5 = 0"


@query
def stray_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = listing(spark, sf_dir)
    return contracts.stray_files(found, found.where("o_orderstatus != 'P'"))


SQL["stray_files"] = f"WITH {LISTING} SELECT '/data/' || name AS path FROM listing WHERE o_orderstatus = 'P'"


@query
def repeated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.duplicates(table(spark, sf_dir, "part").select(F.col("p_type").alias("name")))


SQL["repeated_names"] = "SELECT p_type AS name FROM part GROUP BY p_type HAVING count(*) > 1"


# Files of tiles


@query
def footer_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and the range of the key of some tables, from the footers of their files."""
    keys = {"orders": "o_orderkey", "lineitem": "l_orderkey", "customer": "c_custkey", "embeddings": "vec_id"}
    listed = file_index.listing(spark, sf_dir).withColumn("name", F.regexp_extract("path", r"/(\w+)\.parquet(?:/|$)", 1))
    found = file_index.footers(listed.where(F.col("name").isin(*keys)), list(keys.values())).join(listed.select("path", "name"), "path")
    of_key = found.withColumn("r", F.explode("ranges")).where(F.col("r.exact") & F.col("r.low").isNotNull())
    ranges = of_key.groupBy("name").agg(F.min(F.col("r.low").cast("long")).alias("low"), F.max(F.col("r.high").cast("long")).alias("high"))
    return found.groupBy("name").agg(F.sum("rows").alias("rows")).join(ranges, "name")


SQL["footer_ranges"] = """SELECT 'orders' AS name, count(*) AS rows, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders UNION ALL SELECT 'lineitem', count(*), min(l_orderkey), max(l_orderkey) FROM lineitem
UNION ALL SELECT 'customer', count(*), min(c_custkey), max(c_custkey) FROM customer UNION ALL SELECT 'embeddings', count(*), min(vec_id), max(vec_id) FROM embeddings"""


def tile_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as tiles in files by supplier."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("slide_path"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("row_index"))


@query
def slide_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.slide_per_file(tile_files(spark, sf_dir))


SQL["slide_per_file"] = "SELECT l_suppkey AS file, min(l_orderkey) AS slide_path, count(DISTINCT l_orderkey) AS slides FROM lineitem GROUP BY l_suppkey"


@query
def first_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.first_row_ids(tile_files(spark, sf_dir), "slide_path")


SQL["first_row_ids"] = "SELECT l_suppkey AS file, min(l_orderkey) AS slide_path FROM lineitem GROUP BY l_suppkey"


@query
def last_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.last_wins(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


SQL["last_rows"] = "SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id"


@query
def tile_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = sampling.global_index(slides(spark, sf_dir).withColumn("shard", F.format_string("shard-%05d", F.col("slide") % 16)), "shard", ["slide"])
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tile_index"), "label")
    return cohort.with_tile_labels(numbered, labels).select("slide", "tile_index", "label")


SQL["tile_labels"] = f"WITH {SLIDES}, t AS (SELECT slide, row_number() OVER (ORDER BY slide % 16, slide) - 1 AS tile_index FROM slides) SELECT slide, tile_index, label FROM t LEFT JOIN embeddings ON vec_id = tile_index"


@query
def tissue_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten pixels from the digest of each customer's name, kept where most of them are saturated."""
    pixels = table(spark, sf_dir, "customer").select("c_custkey", F.substring(F.md5(F.col("c_name").cast("binary")), 1, 30).cast("binary").alias("pixels"))
    marked = pixels.withColumn("fraction", vectors.tissue_fraction(F.col("pixels")))
    return cohort.with_tissue(marked, F.col("fraction"), 0.75).select("c_custkey", F.round("fraction", 6).alias("fraction"))


SQL["tissue_tiles"] = """WITH m AS (SELECT c_custkey, md5(c_name) AS m FROM customer), p AS (SELECT c_custkey, [ascii(m[k * 3 + 1]), ascii(m[k * 3 + 2]), ascii(m[k * 3 + 3])] AS rgb FROM m, range(10) t(k)),
f AS (SELECT c_custkey, avg(((list_max(rgb) - list_min(rgb)) / (list_max(rgb) + 1e-6::DOUBLE) > 0.07)::INTEGER) AS fraction FROM p GROUP BY c_custkey) SELECT c_custkey, round(fraction, 6) AS fraction FROM f WHERE fraction >= 0.75"""


@query
def patients_without_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 20).alias("patient_id"), F.when(F.col("vec_id") % 20 % 3 != 0, F.col("embedding")).alias("vector"))
    return cohort.without_payload(e, "patient_id")


SQL["patients_without_vectors"] = "SELECT vec_id % 20 AS patient_id, count(*) AS tiles FROM embeddings WHERE vec_id % 20 % 3 = 0 GROUP BY 1"


@query
def mean_tile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = slides(spark, sf_dir).join(tiles(spark, sf_dir), "slide").withColumn("score", F.when(F.col("flag") != "A", F.col("quantity") / 100))
    return pairwise.mean_scores(scored, "patient_id", "score").withColumn("score", F.round("score", 9))


SQL["mean_tile_scores"] = f"WITH {SLIDES}, {TILES} SELECT patient_id, round(avg(quantity / 100), 9) AS score, count(*) AS n_tiles FROM slides JOIN tiles USING (slide) WHERE flag != 'A' GROUP BY patient_id"


# Scores, labels, ids


@query
def filled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("patient_id") % 5 == 0, None).when(F.col("patient_id") % 7 == 0, float("nan")).otherwise(F.col("score"))
    return predictions(spark, sf_dir).select("patient_id", vectors.filled_score(score).alias("score"))


SQL["filled_scores"] = f"WITH {PREDICTIONS} SELECT patient_id, CASE WHEN patient_id % 5 = 0 OR patient_id % 7 = 0 THEN 0.5::DOUBLE ELSE score END AS score FROM preds"


@query
def compact_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """63-bit ids are not negative and tell all slides apart."""
    ids = slides(spark, sf_dir).select(identity.compact_id(F.col("patient_id"), F.col("slide")).alias("id"))
    return ids.agg(F.count("*").alias("slides"), F.countDistinct("id").alias("ids"), (F.min("id") >= 0).alias("not_negative"))


SQL["compact_ids"] = "SELECT count(*) AS slides, count(DISTINCT (o_custkey, o_orderkey)) AS ids, true AS not_negative FROM orders"


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as nested clinical cases."""
    k = F.col("c_custkey")
    of = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    names = F.when(k % 4 == 0, F.array(F.lit("Infiltrating duct carcinoma"))).when(k % 4 == 1, F.array(F.lit("Lobular carcinoma, NOS "))).when(k % 4 == 2, F.array(F.lit("Lobular carcinoma"), F.lit("Duct carcinoma")))
    return table(spark, sf_dir, "customer").select(
        F.concat(F.when(k % 11 == 0, "CPTAC-").otherwise("TCGA-"), k.cast("string")).alias("submitter_id"),
        F.struct(F.concat(F.lit("TCGA-"), of(["LUAD", "LUSC", "LGG", "GBM", "BRCA", "KIRC"], k)).alias("project_id")).alias("project"),
        F.struct(of(["white", " Asian", "Not Reported", "", "other"], k).alias("race"), of(["male", "female", "x"], k).alias("sex_at_birth"), (-k * 100.0).alias("days_to_birth")).alias("demographic"),
        F.transform(names, lambda d: F.struct(d.alias("primary_diagnosis"))).alias("diagnoses"),
    )


@query
def program_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clinical.patients_of_cases(cases(spark, sf_dir)).drop("race_raw", "age")


SQL["program_cases"] = """WITH c AS (SELECT c_custkey AS k, ['LUAD', 'LUSC', 'LGG', 'GBM', 'BRCA', 'KIRC'][c_custkey % 6 + 1] AS cancer, ['ductal', 'lobular', 'ambiguous', 'unclassified'][c_custkey % 4 + 1] AS subtype FROM customer WHERE c_custkey % 11 != 0)
SELECT 'TCGA-' || k AS patient_barcode, cancer, [ 'White', 'Asian', NULL, NULL, NULL][k % 5 + 1] AS race, ['mapped', 'mapped', 'not_reported', 'missing', 'unsupported_category'][k % 5 + 1] AS race_status, ['Male', 'Female', NULL][k % 3 + 1] AS sex,
['Infiltrating duct carcinoma', 'Lobular carcinoma, NOS', 'Duct carcinoma|Lobular carcinoma', ''][k % 4 + 1] AS primary_diagnosis, subtype,
CASE cancer WHEN 'LUAD' THEN 0 WHEN 'LUSC' THEN 1 END AS label_nsclc, CASE cancer WHEN 'LGG' THEN 0 WHEN 'GBM' THEN 1 END AS label_glioma, CASE WHEN cancer = 'BRCA' THEN CASE subtype WHEN 'ductal' THEN 0 WHEN 'lobular' THEN 1 END END AS label_brca FROM c"""


@query
def task_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    demographics = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, " coad").otherwise("LIHC").alias("cancer_type"), (F.col("c_custkey") % 2).cast("string").alias("label_brca"), F.when(F.col("c_custkey") % 3 != 0, "1.0").otherwise("").alias("fold_brca"))
    molecular = c.select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, (F.col("c_custkey") % 3 % 2).cast("string")).alias("stage_bin"), (F.col("c_custkey") % 2).alias("tp53_status"), (F.col("c_custkey") % 4).alias("fold_tp53_coad"))
    out = None
    for task in ("brca", "coad_tp53", "coad_stage"):
        part = cohort.task_cohort(task, demographics, molecular, "c_custkey").withColumn("task", F.lit(task))
        out = part if out is None else out.unionByName(part)
    return out


SQL["task_cohorts"] = """WITH s AS (SELECT c_custkey, c_custkey % 3 % 2 AS label FROM customer WHERE c_custkey % 5 != 0 AND c_custkey % 2 = 0)
SELECT c_custkey, (c_custkey % 2)::INTEGER AS label, 1 AS fold, 'brca' AS task FROM customer WHERE c_custkey % 3 != 0
UNION ALL SELECT c_custkey, (c_custkey % 2)::INTEGER, (c_custkey % 4)::INTEGER, 'coad_tp53' FROM customer
UNION ALL SELECT c_custkey, label::INTEGER, ((row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || c_custkey), c_custkey) - 1) % 5)::INTEGER, 'coad_stage' FROM s"""


@query
def named_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("gender", F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_mktsegment")))
    return c.select("c_custkey", cohort.first_named(c, ["sex", "Gender", "c_name"]).alias("sex"))


SQL["named_fields"] = "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment END AS sex FROM customer"


@query
def annotated_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).select("patient_id", "score")
    known = table(spark, sf_dir, "documents").where("doc_id % 9 != 0").select(F.col("doc_id").alias("patient_id"), (F.col("doc_id") % 5).alias("outer_fold"))
    sites = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("patient_id"), F.col("source").alias("tss"))
    joined, unknown = cohort.annotate(p, known, sites, "patient_id")
    return joined.join(unknown.withColumn("unknown", F.lit(True)), "patient_id", "left").fillna(False, ["unknown"])


SQL["annotated_predictions"] = f"WITH {PREDICTIONS} SELECT patient_id, score, CASE WHEN patient_id % 9 != 0 THEN patient_id % 5 END AS outer_fold, source AS tss, patient_id % 9 = 0 AS unknown FROM preds"


# Factors


@query
def factor_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = patients(spark, sf_dir).select(F.col("region").alias("factor"), F.length("region").alias("width")).where("factor != 'ASIA'").distinct().withColumn("width", F.when(F.col("factor") == "AFRICA", 3).otherwise(1))
    p = patients(spark, sf_dir)
    selected = p.select(F.col("region").alias("factor")).distinct().withColumn("sign", F.when(F.col("factor") == "EUROPE", 0).otherwise(1))
    return factors.selection_violations(selected.unionByName(selected.where("factor = 'AMERICA'")), maps)


SQL["factor_selection"] = f"""WITH {PATIENTS}, r AS (SELECT DISTINCT region AS factor FROM patients) SELECT factor, 'repeated' AS problem FROM r WHERE factor = 'AMERICA' UNION ALL SELECT factor, 'no sign' FROM r WHERE factor = 'EUROPE'
UNION ALL SELECT factor, 'absent' FROM r WHERE factor = 'ASIA' UNION ALL SELECT factor, 'not a scalar' FROM r WHERE factor = 'AFRICA'"""


@query
def factor_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = factors.metadata(patients(spark, sf_dir).withColumn("balance", F.col("balance").cast("string")), "patient_id", ["segment", "region"], ["balance"])
    ids = made.select("n", F.explode("discrete").alias("factor", "ids"), "categories").select("n", "factor", F.explode("ids").alias("patient_id", "id"), F.col("categories")[F.col("factor")].alias("names"))
    ids = ids.select("n", "factor", "patient_id", F.get("names", F.col("id")).alias("category"), F.col("id").cast("double").alias("value"))
    numbers = made.select("n", F.explode("continuous").alias("factor", "of")).select("n", "factor", F.explode("of").alias("patient_id", "v")).select("n", "factor", "patient_id", F.lit(None).cast("string").alias("category"), F.round(F.col("v")[0], 5).alias("value"))
    return ids.unionByName(numbers)


SQL["factor_metadata"] = f"""WITH {PATIENTS}, n AS (SELECT count(DISTINCT patient_id) AS n FROM patients), long AS (SELECT 'segment' AS factor, patient_id, segment AS category FROM patients WHERE segment IS NOT NULL UNION ALL SELECT 'region', patient_id, region FROM patients)
SELECT n, factor, patient_id, category, (dense_rank() OVER (PARTITION BY factor ORDER BY category) - 1)::DOUBLE AS value FROM long, n
UNION ALL SELECT n, 'balance', patient_id, NULL, round(round((balance - avg(balance) OVER ()) / stddev_samp(balance) OVER (), 8), 5) FROM patients, n"""


# Audits and reports


@query
def nested_training_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds of patients that each model of a segment's grid has seen; each segment lacks one model, some train one on a fold too many."""
    p = patients(spark, sf_dir).select("segment", (F.col("patient_id") % 3).cast("int").alias("fold")).distinct()
    grid = p.select("segment", F.col("fold").alias("outer_fold")).join(p.select("segment", F.col("fold").alias("inner_fold")), "segment")
    grid = grid.withColumn("inner_fold", F.when(F.col("inner_fold") != F.col("outer_fold"), F.col("inner_fold")))
    leaks = (F.col("outer_fold") == 1) & (F.col("inner_fold") == 2) & F.col("segment").contains("U")
    seen = grid.join(p, "segment").where(((F.col("fold") != F.col("outer_fold")) & ~F.col("fold").eqNullSafe(F.col("inner_fold"))) | leaks)
    audits = seen.groupBy("segment", "outer_fold", "inner_fold").agg(F.collect_set("fold").alias("folds"))
    missing = (F.col("outer_fold") == F.length("segment") % 3) & F.col("inner_fold").isNull()
    return audit.nested_training(audits.where(~missing), [0, 1, 2], ["segment"])


SQL["nested_training_audit"] = f"""WITH {PATIENTS}, p AS (SELECT DISTINCT segment, (patient_id % 3)::INTEGER AS fold FROM patients),
grid AS (SELECT a.segment, a.fold AS k, CASE WHEN b.fold != a.fold THEN b.fold END AS j FROM p a JOIN p b USING (segment)),
made AS (SELECT g.segment, k, j, list_sort(list(fold)) AS folds FROM grid g JOIN p USING (segment) WHERE (fold != k AND fold IS DISTINCT FROM j) OR (k = 1 AND j = 2 AND contains(g.segment, 'U')) GROUP BY ALL),
given AS (SELECT * FROM made WHERE NOT (k = length(segment) % 3 AND j IS NULL)),
wanted AS (SELECT segment, k::INTEGER AS k, CASE WHEN j != k THEN j::INTEGER END AS j, list_sort(list(f::INTEGER)) AS folds FROM (SELECT DISTINCT segment FROM given), range(3) a(k), range(3) b(j), range(3) c(f) WHERE f != k AND f != j GROUP BY ALL)
SELECT coalesce(w.segment, g.segment) AS segment, coalesce(w.k, g.k) AS outer_fold, coalesce(w.j, g.j) AS inner_fold, CASE WHEN g.segment IS NULL THEN 'absent' WHEN w.segment IS NULL THEN 'extra' ELSE 'folds' END AS problem
FROM wanted w FULL JOIN given g ON w.segment = g.segment AND w.k = g.k AND w.j IS NOT DISTINCT FROM g.j WHERE g.segment IS NULL OR w.segment IS NULL OR w.folds != g.folds"""


@query
def study_contract_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declaration for each nation: fields, seeds, margins, temperatures and strengths follow from its keys."""
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    rows = table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("study"), F.lit(42).alias("fold_seed"), F.when(k % 4 != 0, "linear").alias("head_architecture"), F.array((k % 3).cast("int"), (k % 5).cast("int"), F.lit(7)).alias("planned_head_seeds"), F.lit("gap").alias("primary_estimand"),
        ((r - 1) * 0.01).alias("utility_noninferiority_margin"), F.when(k % 2 == 0, "race").otherwise("sex").alias("sensitive"), F.lit("contrastive").alias("method"), r.cast("double").alias("temperature"), (k / 2).alias("posthoc_lambda"),
    )
    return audit.study_contract(rows, 1, 2.0, {"method": "contrastive", "sensitive": "race"}, ["study"])


SQL["study_contract_checks"] = """WITH rules AS (SELECT n_name AS study, unnest([
  CASE WHEN n_nationkey % 4 = 0 THEN 'head_architecture present' END, CASE WHEN n_nationkey % 3 = n_nationkey % 5 THEN 'seeds unique' END, CASE WHEN n_nationkey % 3 != 1 AND n_nationkey % 5 != 1 THEN 'seed declared' END,
  CASE WHEN n_regionkey < 1 THEN 'margin' END, CASE WHEN n_regionkey = 0 THEN 'temperature' END, CASE WHEN n_nationkey != 4 THEN 'lambda of the run' END, CASE WHEN n_nationkey % 2 = 1 THEN 'sensitive of the command' END]) AS "check" FROM nation)
SELECT study, "check" FROM rules WHERE "check" IS NOT NULL"""


def runs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = arm_scores(spark, sf_dir).groupBy("arm", "run").agg(F.count("*").alias("n"))
    return of.select("arm", "run", F.lit("v1").alias("schema"), (F.col("run") + 1).alias("seed"), F.lit("brca").alias("task"), F.when(F.col("arm") == "posthoc", 1.0).otherwise(0.0).alias("lambda_adv"),
                     F.when(F.col("arm") == "pretraining", "fair").otherwise("plain").alias("checkpoint"), F.concat("arm", "run").alias("sha256"), "n", F.lit(42).alias("split_seed"), (F.col("arm") == "pretraining").alias("intervention"))


@query
def provenance_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results whose files are swapped, whose seeds and strengths differ from the plan, and one file that serves twice."""
    runs = runs_of(spark, sf_dir)
    files = runs.select("arm", "run", F.when((F.col("arm") == "posthoc") & (F.col("run") == 1), "posthoc0").otherwise(F.col("sha256")).alias("sha256"), (F.col("n") + ((F.col("arm") == "control") & (F.col("run") == 1)).cast("int")).alias("n"))
    edited = runs.withColumn("lambda_adv", F.when((F.col("arm") == "posthoc") & (F.col("run") == 0), 0.5).otherwise(F.col("lambda_adv"))).withColumn("split_seed", F.when(F.col("arm") == "control", 41).otherwise(42))
    edited = edited.withColumn("intervention", (F.col("arm") == "pretraining") & (F.col("run") == 0))
    return audit.provenance(edited, files, 1.0)


SQL["provenance_audit"] = f"""WITH {ARM_SCORES}, any_row AS (SELECT count(*) AS n FROM scores) SELECT arm, run, problem FROM any_row, (VALUES ('posthoc', 1, 'digest'), ('posthoc', 0, 'lambda'), ('control', 1, 'record count'), ('posthoc', 0, 'file reused'),
('pretraining', 1, 'intervention'), (NULL, NULL, 'split seed')) t(arm, run, problem) WHERE n > 0"""


@query
def runs_per_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.run_counts(arm_scores(spark, sf_dir, 3).where("not (arm = 'posthoc' and run = 2)"))


SQL["runs_per_arm"] = f"WITH {PREDICTIONS} SELECT 'posthoc' AS arm, 2::BIGINT AS runs FROM preds LIMIT 1"


@query
def coverage_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for all patients with tiles but those of one region, where some are absent."""
    labels = patients(spark, sf_dir).select(F.col("region").alias("task"), "patient_id")
    seen = slides(spark, sf_dir).where("status = 'P'")
    made = cohort.tiles_of(labels, seen, "patient_id").where("not (task = 'ASIA' and patient_id % 2 = 0)")
    return audit.coverage_agreement(cohort.coverage(labels, seen, "patient_id"), made)


SQL["coverage_agreement"] = f"WITH {PATIENTS}, {SLIDES} SELECT 'ASIA' AS task, 'predicted' AS problem FROM patients SEMI JOIN (SELECT patient_id FROM slides WHERE status = 'P') USING (patient_id) WHERE region = 'ASIA' AND patient_id % 2 = 0 LIMIT 1"


@query
def receipts_disagree(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("field"), F.col("o_orderstatus").alias("receipt")).agg(F.sha2((F.count("*") > 0).cast("string").cast("binary"), 256).alias("sha256"))
    return audit.digests_disagree(o.withColumn("sha256", F.when((F.col("field").startswith("1")) & (F.col("receipt") == "F"), "other").when(F.col("field").startswith("2") & (F.col("receipt") == "O"), None).otherwise(F.col("sha256"))))


SQL["receipts_disagree"] = "SELECT DISTINCT o_orderpriority AS field, CASE WHEN o_orderpriority LIKE '1%' THEN 2 ELSE 1 END::BIGINT AS values FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%'"


@query
def counters_of_merged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by type of event over two runs of which only sketches are kept, beside the exact count and whether they are near."""
    e = table(spark, sf_dir, "events").withColumn("run", F.col("event_id") % 2)
    kept = runlog.distinct_sketches(e, ["user_id"], ["run", "event_type"])
    about = runlog.sketched_counts(runlog.merged_sketches(kept, ["user_id"], ["event_type"]), ["user_id"], ["event_type"])
    exact = runlog.distinct_counts(e, ["user_id"], ["event_type"]).withColumnRenamed("n_user_id", "exact")
    near = F.abs(F.col("n_user_id") - F.col("exact")) <= 0.08 * F.col("exact")  # five times the stated error
    return exact.join(about, "event_type").select("event_type", "exact", near.alias("near"))


SQL["counters_of_merged_runs"] = "SELECT event_type, count(DISTINCT user_id) AS exact, true AS near FROM events GROUP BY event_type"


@query
def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An embedding store in which keys repeat, vectors are cut short, and components are undefined."""
    k = F.col("vec_id")
    vector = F.when(k % 40 == 1, F.slice("embedding", 1, 60)).when(k % 40 == 2, F.transform("embedding", lambda x: F.when(x > 0, x).otherwise(float("nan")))).otherwise(F.col("embedding"))
    stored = table(spark, sf_dir, "embeddings").select(F.when(k % 40 == 3, k - 3).otherwise(k).cast("string").alias("content_key"), vector.alias("vector"), F.lit("m").alias("model_key"))
    return embed.store_violations(stored, 64).groupBy("problem").agg(F.count("*").alias("n"))


SQL["stored_vectors"] = """SELECT problem, count(*) AS n FROM (SELECT 'repeated' AS problem FROM embeddings WHERE vec_id % 40 = 3 UNION ALL SELECT 'dimension' FROM embeddings WHERE vec_id % 40 = 1
UNION ALL SELECT 'not finite' FROM embeddings WHERE vec_id % 40 = 2 AND list_min(embedding) <= 0) GROUP BY problem"""


@query
def training_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A receipt for each nation's customers; some configurations have another seed, lack a patient, or held out another task."""
    k = F.col("c_nationkey")
    receipts = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("patients")).select("c_nationkey", "patients", (k % 4 + 40).alias("fold_seed"), F.when(k % 7 == 2, "nsclc").otherwise("brca").alias("holdout_task"))
    configs = receipts.select("c_nationkey", (F.col("patients") - (k % 5 == 0).cast("int")).alias("patients"), (F.col("fold_seed") + (k % 3 == 0).cast("int")).alias("fold_seed"))
    found = audit.training_inputs(configs, receipts, ["patients", "fold_seed"], ["c_nationkey"])
    held = audit.checkpoint_holdout(receipts, "brca", ["c_nationkey"]).select("c_nationkey", F.col("check").alias("field"), F.lit("brca").alias("expected"), F.lit("nsclc").alias("observed"))
    return found.unionByName(held)


SQL["training_inputs"] = """WITH r AS (SELECT c_nationkey, count(*) AS n, c_nationkey % 4 + 40 AS seed FROM customer GROUP BY c_nationkey)
SELECT c_nationkey, 'patients' AS field, n::VARCHAR AS expected, (n - 1)::VARCHAR AS observed FROM r WHERE c_nationkey % 5 = 0
UNION ALL SELECT c_nationkey, 'fold_seed', seed::VARCHAR, (seed + 1)::VARCHAR FROM r WHERE c_nationkey % 3 = 0 UNION ALL SELECT c_nationkey, 'holdout task', 'brca', 'nsclc' FROM r WHERE c_nationkey % 7 = 2"""


@query
def extreme_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.extreme_groups(predictions(spark, sf_dir), ["lang", "source"], min_n=10)


@query
def support_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = metrics.support_flags(metrics.subgroup_report(predictions(spark, sf_dir), ["lang", "source"], min_n=100))
    return flags.select(F.array_join("flags", ",").alias("flags"))


LONG = PREDICTIONS + ", long AS (SELECT 'lang' AS attribute, lang AS grp, y, score FROM preds WHERE lang IS NOT NULL UNION ALL SELECT 'source', source, y, score FROM preds WHERE source IS NOT NULL)"
SQL["support_flags"] = f"WITH {LONG}, n AS (SELECT attribute, grp, count(*) AS n, sum(y) AS pos FROM long GROUP BY ALL) SELECT coalesce(string_agg(attribute || ':' || grp, ',' ORDER BY attribute || ':' || grp), '') AS flags FROM n WHERE n < 100 OR least(pos, n - pos) < 5"
SQL["extreme_groups"] = f"""WITH {LONG}, pairs AS (SELECT p.attribute, p.grp, avg(CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0.0 END) AS auc FROM long p JOIN long q ON p.attribute = q.attribute AND p.grp = q.grp AND p.y = 1 AND q.y = 0 GROUP BY ALL),
n AS (SELECT attribute, grp FROM long GROUP BY ALL HAVING count(*) >= 10 AND sum(y) >= 5 AND sum(1 - y) >= 5), e AS (SELECT * FROM pairs SEMI JOIN n USING (attribute, grp))
SELECT attribute, first(grp ORDER BY round(auc, 9) DESC, grp) AS best, first(grp ORDER BY round(auc, 9), grp) AS worst FROM e GROUP BY attribute"""


@query
def stop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("run"), F.col("event_id").alias("step"), (F.col("event_id") * 1.0).alias("examples"), (F.col("event_id") % 10 * 1.0).alias("flops"))
    return runlog.stop_report(log, "run", "step", {"examples": 950.0, "flops": 8.0})


SQL["stop_reasons"] = """WITH l AS (SELECT user_id % 50 AS run, max(event_id) AS step FROM events GROUP BY 1) SELECT run, step AS last_step, step * 1.0::DOUBLE AS examples, step % 10 * 1.0::DOUBLE AS flops, step / 950.0::DOUBLE AS examples_part, step % 10 / 8.0::DOUBLE AS flops_part,
CASE WHEN step >= 950 THEN 'examples' WHEN step % 10 >= 8 THEN 'flops' ELSE 'end' END AS stopped_by FROM l"""


@query
def pool_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = patients(spark, sf_dir)
    pool = sampling.balanced_pool(p, "patient_id", "region", ["segment"], 200)
    out = contracts.pool_receipt(pool, sampling.pool_receipt(p, pool, "patient_id", "region", ["segment"]), "patient_id", 1337)
    return out.select("schema", "seed", "candidates", "selected", F.size("strata").alias("strata"), "selected_sha256")


SQL["pool_receipts"] = f"""WITH {PATIENTS}, q AS (SELECT patient_id, region || '|' || segment AS stratum, row_number() OVER (PARTITION BY region, segment ORDER BY sha256('1337:' || patient_id), patient_id) - 1 AS turn FROM patients WHERE segment IS NOT NULL),
pool AS (SELECT * FROM q ORDER BY turn, stratum LIMIT 200), b AS (SELECT substr(sha256(patient_id::VARCHAR), 1, 3) AS bucket, sha256(string_agg(patient_id::VARCHAR, chr(10) ORDER BY patient_id::VARCHAR)) AS d FROM pool GROUP BY 1)
SELECT 'balanced-pool/v1' AS schema, 1337 AS seed, (SELECT count(*) FROM q) AS candidates, (SELECT count(*) FROM pool) AS selected, (SELECT count(DISTINCT stratum) FROM q)::INTEGER AS strata, (SELECT sha256(string_agg(d, chr(10) ORDER BY bucket)) FROM b) AS selected_sha256"""


@query
def split_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.train_validation(patients(spark, sf_dir), "patient_id", 0.2, seed=7).select("patient_id", "is_train")


SQL["split_sides"] = f"WITH {PATIENTS} SELECT patient_id, ('0x' || substr(sha256('7:' || patient_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE >= 0.2 AS is_train FROM patients"

"""Cohort, fold, sampling, factor, clinical, audit, log and contract queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clinical, identity
from ..operators import audit, cohort, factors, folds, metrics, probe, runlog, sampling
from ..sources import contracts
from .roles import ARM_SCORES, PATIENTS, PREDICTIONS, SLIDES, TILES, arm_scores, auc_sql, patients, predictions, slides, table, tiles

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# Folds and splits


@query
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.stratified_folds(patients(spark, sf_dir), "patient_id", "region", "segment", "region").select("patient_id", "region", "segment", "fold")


SQL["stratified_folds"] = f"""WITH {PATIENTS},
known AS (SELECT *, coalesce(nullif(segment, ''), '__missing__') AS race FROM patients WHERE region IS NOT NULL),
strata AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY region, race) >= 5 THEN race ELSE '__sparse__' END AS stratum FROM known),
dealt AS (SELECT *, row_number() OVER (PARTITION BY region, stratum ORDER BY sha256('42:region:' || patient_id), patient_id) - 1 AS position FROM strata)
SELECT patient_id, region, segment, ((position + ('0x' || substr(sha256('42:region:' || region || ':' || stratum), 1, 13))::BIGINT % 5) % 5)::INTEGER AS fold FROM dealt"""


@query
def fold_class_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.too_small(patients(spark, sf_dir), "segment", 400)


SQL["fold_class_support"] = f"WITH {PATIENTS} SELECT segment, count(*) AS n FROM patients WHERE segment IS NOT NULL GROUP BY segment HAVING count(*) < 400"


@query
def k_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.k_folds(predictions(spark, sf_dir), "patient_id", "y", 5, inside=["lang"]).select("patient_id", "lang", "y", "fold")


SQL["k_folds"] = f"""WITH {PREDICTIONS}, counts AS (SELECT lang, y, count(*) AS n FROM preds GROUP BY ALL), k AS (SELECT lang, greatest(2, least(5, min(n))) AS k FROM counts GROUP BY lang)
SELECT patient_id, lang, y, ((row_number() OVER (PARTITION BY lang, y ORDER BY sha256('42:' || patient_id), patient_id) - 1) % k)::INTEGER AS fold FROM preds JOIN k USING (lang)"""


@query
def train_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.train_validation(slides(spark, sf_dir), "patient_id", 0.1).groupBy("is_train").agg(F.count("*").alias("slides"), F.countDistinct("patient_id").alias("patients"))


SQL["train_split"] = f"""WITH {SLIDES} SELECT ('0x' || substr(sha256('42:' || patient_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE >= 0.1 AS is_train,
count(*) AS slides, count(DISTINCT patient_id) AS patients FROM slides GROUP BY 1"""


# Factors and weights


@query
def category_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.with_category_ids(patients(spark, sf_dir), "segment").select("patient_id", "id")


SQL["category_ids"] = f"WITH {PATIENTS} SELECT patient_id, CASE WHEN trim(segment) NOT IN ('', 'nan', 'None') THEN (dense_rank() OVER (ORDER BY trim(segment)) - 1)::INTEGER END AS id FROM patients"


@query
def z_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.z_scores(patients(spark, sf_dir), "patient_id", "balance").select("patient_id", F.round("z", 6).alias("z"))


SQL["z_scores"] = f"WITH {PATIENTS} SELECT patient_id, round(round((balance - avg(balance) OVER ()) / stddev_samp(balance) OVER (), 8), 6) AS z FROM patients WHERE balance IS NOT NULL"


@query
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = patients(spark, sf_dir)
    both = [sampling.class_weights(p, "segment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "NONE"], absent).withColumn("absent", F.lit(absent)) for absent in (1.0, 0.0)]
    return both[0].unionByName(both[1]).select("class", "absent", F.round("weight", 6).alias("weight"))


SQL["class_weights"] = f"""WITH {PATIENTS}, c AS (SELECT segment AS class, 1.0::DOUBLE / count(*) AS w FROM patients WHERE segment IS NOT NULL GROUP BY segment),
every(class) AS (VALUES ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('HOUSEHOLD'), ('MACHINERY'), ('NONE'))
SELECT class, absent, round(coalesce(w / (SELECT avg(w) FROM c), absent), 6) AS weight FROM every LEFT JOIN c USING (class), (VALUES (1.0::DOUBLE), (0.0::DOUBLE)) a(absent)"""


def labelled_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles(spark, sf_dir).withColumn("label", F.when(F.col("flag") != "N", F.col("flag")))


@query
def tile_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = sampling.tile_weights(labelled_tiles(spark, sf_dir), "label")
    return weighted.groupBy("flag").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 6).alias("weight"))


SQL["tile_weights"] = f"""WITH {TILES}, t AS (SELECT *, CASE WHEN flag != 'N' THEN flag END AS label FROM tiles), n AS (SELECT label, 1.0::DOUBLE / count(*) AS w FROM t WHERE label IS NOT NULL GROUP BY label),
raw AS (SELECT t.flag, coalesce(n.w, (SELECT avg(n.w) FROM t JOIN n USING (label))) AS w FROM t LEFT JOIN n USING (label))
SELECT flag, count(*) AS n, round(avg(w) / (SELECT avg(w) FROM raw), 6) AS weight FROM raw GROUP BY flag"""


@query
def weighted_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = sampling.tile_weights(labelled_tiles(spark, sf_dir), "label").withColumn("key", F.concat_ws("-", "slide", "tile", "part", "flag"))
    return sampling.resampled(weighted, "key", "weight", weighted.count()).groupBy("flag").agg(F.count("*").alias("draws"))


# Rows on a line, each as long as its weight in whole numbers; every hashed point takes the row it falls on.
SQL["weighted_resample"] = f"""WITH {TILES}, t AS (SELECT *, CASE WHEN flag != 'N' THEN flag END AS label FROM tiles), n AS (SELECT label, 1.0::DOUBLE / count(*) AS w FROM t WHERE label IS NOT NULL GROUP BY label),
raw AS (SELECT t.flag, coalesce(n.w, (SELECT avg(n.w) FROM t JOIN n USING (label))) AS w, slide || '-' || tile || '-' || part || '-' || t.flag AS key FROM t LEFT JOIN n USING (label)),
weighted AS (SELECT flag, key, w / (SELECT avg(w) FROM raw) AS w FROM raw),
items AS (SELECT flag, key, round(w * pow(2, 50 - ceil(log2((SELECT sum(w) FROM weighted)))))::BIGINT AS w FROM weighted),
line AS (SELECT flag, (sum(w) OVER (ORDER BY sha256('42:draw:' || key), key ROWS UNBOUNDED PRECEDING))::BIGINT AS high FROM items),
points AS (SELECT ('0x' || substr(sha256('42:point:' || range), 1, 13))::BIGINT % (SELECT sum(w)::BIGINT FROM items) AS place FROM range((SELECT count(*) FROM items)))
SELECT flag, count(*) AS draws FROM points ASOF JOIN line ON place < high GROUP BY flag"""


# Pools, caps and permutations


@query
def balanced_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.balanced_pool(patients(spark, sf_dir), "patient_id", "region", ["segment"], 200)


POOL = f"""{PATIENTS}, queued AS (SELECT patient_id, region || '|' || segment AS stratum, row_number() OVER (PARTITION BY region, segment ORDER BY sha256('1337:' || patient_id), patient_id) - 1 AS turn
  FROM patients WHERE segment IS NOT NULL), pool AS (SELECT * FROM queued ORDER BY turn, stratum LIMIT 200)"""
SQL["balanced_pool"] = f"WITH {POOL} SELECT * FROM pool"


@query
def pool_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = patients(spark, sf_dir)
    return sampling.pool_receipt(p, sampling.balanced_pool(p, "patient_id", "region", ["segment"], 200), "patient_id", "region", ["segment"])


SQL["pool_receipt"] = f"WITH {POOL} SELECT stratum, count(*) AS candidates, count(p.patient_id) AS selected FROM queued q LEFT JOIN pool p USING (patient_id, stratum) GROUP BY stratum"


@query
def first_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = sampling.balanced_pool(patients(spark, sf_dir), "patient_id", "region", ["segment"], 200)
    placed = pool.select("patient_id", F.col("patient_id").alias("patient_pos"))
    return sampling.first_slides(slides(spark, sf_dir), placed, "patient_id", "slide", 300).select("patient_id", "slide", "r")


SQL["first_slides"] = f"""WITH {POOL}, {SLIDES}, mine AS (SELECT patient_id, slide, row_number() OVER (PARTITION BY patient_id ORDER BY slide) AS r FROM slides SEMI JOIN pool USING (patient_id))
SELECT patient_id, slide, r FROM mine ORDER BY r > 1, patient_id, r LIMIT 300"""


@query
def tile_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.cap_per(tiles(spark, sf_dir), "slide", ["tile", "part", "quantity"], 2).groupBy("slide").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))


SQL["tile_cap"] = f"WITH {TILES} SELECT slide, count(*) AS n, sum(quantity) AS quantity FROM (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY tile, part, quantity) AS r FROM tiles) WHERE r <= 2 GROUP BY slide"


@query
def slide_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = slides(spark, sf_dir).select("slide", "patient_id")
    return sampling.cap_slides(s, "slide", 100, True).withColumn("k", F.lit(100)).unionByName(sampling.cap_slides(s, "slide", 0, False).withColumn("k", F.lit(0)))


SQL["slide_cap"] = f"WITH {SLIDES} SELECT slide, patient_id, 100::INTEGER AS k FROM slides ORDER BY slide LIMIT 100"


@query
def placebo_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.permuted(patients(spark, sf_dir), "patient_id", "segment").select("patient_id", "segment")


SQL["placebo_permutation"] = f"""WITH {PATIENTS}, known AS (SELECT patient_id, segment FROM patients WHERE segment IS NOT NULL),
a AS (SELECT patient_id, row_number() OVER (ORDER BY sha256('key:' || patient_id), patient_id) AS k FROM known),
b AS (SELECT segment, row_number() OVER (ORDER BY sha256('42:segment:' || patient_id), patient_id) AS k FROM known) SELECT patient_id, segment FROM a JOIN b USING (k)"""


@query
def global_tile_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = slides(spark, sf_dir).withColumn("shard", F.format_string("shard-%05d", F.col("slide") % 16))
    return sampling.global_index(t, "shard", ["slide"]).select("shard", "slide", "tile_index")


SQL["global_tile_index"] = f"WITH {SLIDES} SELECT printf('shard-%05d', slide % 16) AS shard, slide, row_number() OVER (ORDER BY slide % 16, slide) - 1 AS tile_index FROM slides"


# Joins, coverage and counts


def cohort_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.known(patients(spark, sf_dir).where("region in ('ASIA', 'EUROPE')"), "segment")


COHORT = "cohort AS (SELECT * FROM patients WHERE region IN ('ASIA', 'EUROPE') AND segment IS NOT NULL)"


@query
def tiles_of_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = cohort.tiles_of(slides(spark, sf_dir), cohort_patients(spark, sf_dir), "patient_id")
    return mine.join(tiles(spark, sf_dir), "slide").groupBy("patient_id").agg(F.count("*").alias("tiles"), F.sum("quantity").alias("quantity"))


SQL["tiles_of_cohort"] = f"WITH {PATIENTS}, {COHORT}, {SLIDES}, {TILES} SELECT patient_id, count(*) AS tiles, sum(quantity) AS quantity FROM (SELECT * FROM slides SEMI JOIN cohort USING (patient_id)) JOIN tiles USING (slide) GROUP BY patient_id"


@query
def holdout_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, gone = cohort.exclude_holdout(slides(spark, sf_dir), cohort_patients(spark, sf_dir), "patient_id")
    return kept.agg(F.count("*").alias("tiles_kept"), F.countDistinct("patient_id").alias("patients_kept")).crossJoin(F.broadcast(gone))


SQL["holdout_exclusion"] = f"""WITH {PATIENTS}, {COHORT}, {SLIDES} SELECT count(*) FILTER (WHERE c.patient_id IS NULL) AS tiles_kept, count(DISTINCT s.patient_id) FILTER (WHERE c.patient_id IS NULL) AS patients_kept,
count(*) FILTER (WHERE c.patient_id IS NOT NULL) AS tiles_excluded, count(DISTINCT s.patient_id) FILTER (WHERE c.patient_id IS NOT NULL) AS patients_excluded FROM slides s LEFT JOIN cohort c USING (patient_id)"""


@query
def tile_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = patients(spark, sf_dir).select(F.col("region").alias("task"), "patient_id")
    out = cohort.coverage(labels, slides(spark, sf_dir).where("status = 'P'"), "patient_id")
    return out.withColumn("fraction", F.round("fraction", 6))


SQL["tile_coverage"] = f"""WITH {PATIENTS}, {SLIDES}, s AS (SELECT patient_id, count(DISTINCT slide) AS slides FROM slides WHERE status = 'P' GROUP BY patient_id)
SELECT region AS task, count(*) AS labelled, count(slides) AS with_tiles, round(count(slides) / count(*)::DOUBLE, 6) AS fraction, count(*) - count(slides) AS missing, coalesce(sum(slides), 0)::BIGINT AS slides
FROM patients LEFT JOIN s USING (patient_id) GROUP BY region"""


@query
def patients_without_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = patients(spark, sf_dir).select(F.col("region").alias("task"), "patient_id")
    return cohort.missing_ids(labels, slides(spark, sf_dir).where("status = 'P'"), "patient_id")


SQL["patients_without_tiles"] = f"WITH {PATIENTS}, {SLIDES} SELECT region AS task, patient_id FROM patients ANTI JOIN (SELECT patient_id FROM slides WHERE status = 'P') USING (patient_id)"


@query
def demographics_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("patient_id"), "lang")
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("patient_id"), "quality")
    joined, rate = cohort.join_demographics(d, known, "patient_id")
    of = joined.groupBy("lang").agg(F.count("quality").alias("known"), F.count("*").alias("n"))
    return of.crossJoin(F.broadcast(rate)).withColumn("join_rate", F.round("join_rate", 6))


SQL["demographics_join"] = """SELECT lang, count(quality) AS known, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS patients, round(sum(count(l.doc_id)) OVER () / sum(count(*)) OVER ()::DOUBLE, 6) AS join_rate
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang"""


@query
def merged_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = patients(spark, sf_dir)
    right = p.where("patient_id % 3 = 0").select("patient_id", F.when(F.col("patient_id") % 2 == 0, F.lit("CORRECTED")).alias("segment"), F.lit("x").alias("extra"))
    return cohort.merge_right_wins(p.where("patient_id % 5 != 0").select("patient_id", "segment", "region"), right, "patient_id")


SQL["merged_metadata"] = f"""WITH {PATIENTS}, l AS (SELECT patient_id, segment, region FROM patients WHERE patient_id % 5 != 0),
r AS (SELECT patient_id, CASE WHEN patient_id % 2 = 0 THEN 'CORRECTED' END AS segment, 'x' AS extra FROM patients WHERE patient_id % 3 = 0)
SELECT coalesce(r.patient_id, l.patient_id) AS patient_id, coalesce(r.segment, l.segment) AS segment, region, extra FROM l FULL JOIN r ON l.patient_id = r.patient_id"""


@query
def molecular_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    molecular = slides(spark, sf_dir).groupBy("patient_id").agg(F.min("status").alias("status"))
    return cohort.molecular_cohort(molecular, patients(spark, sf_dir), "patient_id", "region", "asia").select("patient_id", "status", "segment")


SQL["molecular_cohort"] = f"WITH {PATIENTS}, {SLIDES} SELECT patient_id, min(status) AS status, any_value(segment) AS segment FROM slides JOIN patients USING (patient_id) WHERE upper(region) = 'ASIA' GROUP BY patient_id"


@query
def hospital_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("patient_id"), (F.col("s_nationkey") % 5).alias("hospital_fold"))
    return cohort.with_hospital_folds(cohort_patients(spark, sf_dir), f, "patient_id").groupBy("region", "hospital_fold").agg(F.count("*").alias("n"))


SQL["hospital_cohort"] = f"WITH {PATIENTS}, {COHORT} SELECT region, s_nationkey % 5 AS hospital_fold, count(*) AS n FROM cohort JOIN supplier ON patient_id = s_suppkey GROUP BY ALL"


@query
def factor_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = patients(spark, sf_dir)
    long = factors.with_category_ids(p, "segment").select(F.lit("segment").alias("factor"), "patient_id", "id").where("patient_id % 7 != 0").unionByName(factors.with_category_ids(p, "region").select(F.lit("region").alias("factor"), "patient_id", "id"))
    return cohort.factor_labels(slides(spark, sf_dir), long, "patient_id", ["segment", "region"]).fillna(-1, ["segment", "region"]).groupBy("segment", "region").agg(F.count("*").alias("slides"))


SQL["factor_labels"] = f"""WITH {PATIENTS}, {SLIDES}, ids AS (SELECT patient_id, (dense_rank() OVER (ORDER BY segment) - 1)::INTEGER AS segment, (dense_rank() OVER (ORDER BY region) - 1)::INTEGER AS region FROM patients)
SELECT coalesce(CASE WHEN patient_id % 7 != 0 THEN segment END, -1) AS segment, coalesce(region, -1) AS region, count(*) AS slides FROM slides LEFT JOIN ids USING (patient_id) GROUP BY ALL"""


@query
def site_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = patients(spark, sf_dir)
    first = p.select("patient_id", F.col("segment").alias("tss"), F.col("region").alias("site"))
    second = p.where("patient_id % 4 = 0").select("patient_id", F.when(F.col("patient_id") % 8 == 0, F.lit("S2")).alias("tss"))
    return cohort.later_file_wins([first, second], "patient_id", ["tss", "site"])


SQL["site_metadata"] = f"WITH {PATIENTS} SELECT patient_id, CASE WHEN patient_id % 8 = 0 THEN 'S2' ELSE segment END AS tss, region AS site FROM patients"


@query
def tile_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = patients(spark, sf_dir)
    return cohort.tile_roles(slides(spark, sf_dir), p.where("region = 'ASIA'"), p.where("segment = 'BUILDING'"), "patient_id").groupBy("role").agg(F.count("*").alias("slides"), F.countDistinct("patient_id").alias("patients"))


SQL["tile_roles"] = f"""WITH {PATIENTS}, {SLIDES} SELECT CASE WHEN region = 'ASIA' THEN 'task' ELSE 'pool' END AS role, count(*) AS slides, count(DISTINCT patient_id) AS patients
FROM slides JOIN patients USING (patient_id) WHERE region = 'ASIA' OR segment = 'BUILDING' GROUP BY 1"""


@query
def fit_and_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    both = cohort.with_roles(p.where("lang = 'en'"), p.where("lang != 'en'"))
    return metrics.auc_by(both, ["role"]).withColumn("auc", F.round("auc", 6))


SQL["fit_and_external"] = f"WITH {PREDICTIONS}, r AS (SELECT *, CASE WHEN lang = 'en' THEN 'train' ELSE 'external' END AS role FROM preds WHERE lang IS NOT NULL) SELECT * REPLACE (round(auc, 6) AS auc) FROM ({auc_sql('r', 'role')})"


@query
def id_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = slides(spark, sf_dir).where("status = 'F'").select("patient_id"), slides(spark, sf_dir).where("status = 'O'").select("patient_id")
    parts = {"union": a.union(b).distinct(), "both": a.intersect(b), "only_first": a.distinct().exceptAll(b.distinct()), "only_second": b.distinct().exceptAll(a.distinct())}
    out = None
    for name, df in parts.items():
        row = df.agg(F.lit(name).alias("set"), F.count("*").alias("n"), F.sum("patient_id").alias("ids"))
        out = row if out is None else out.unionByName(row)
    return out


SQL["id_set_operations"] = f"""WITH {SLIDES}, a AS (SELECT patient_id FROM slides WHERE status = 'F'), b AS (SELECT patient_id FROM slides WHERE status = 'O'),
s AS (SELECT 'union' AS set, patient_id FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'both', patient_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'only_first', patient_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'only_second', patient_id FROM (SELECT * FROM b EXCEPT SELECT * FROM a))
SELECT set, count(*) AS n, sum(patient_id)::BIGINT AS ids FROM s GROUP BY set"""


@query
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.value_counts(table(spark, sf_dir, "orders").withColumn("p", F.when(F.col("o_orderkey") % 10 == 0, " ").otherwise(F.col("o_orderpriority"))), "p")


SQL["value_counts"] = "SELECT CASE WHEN o_orderkey % 10 = 0 THEN '<missing>' ELSE o_orderpriority END AS value, count(*) AS n FROM orders GROUP BY 1"


@query
def status_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = patients(spark, sf_dir).withColumn("status", F.when(F.col("balance") < 0, "missing").when(F.col("balance") < 3000, "not_reported").otherwise("mapped"))
    return cohort.status_matrix(p, {"all": F.lit(True), "asia": F.col("region") == "ASIA", "building": F.col("segment") == "BUILDING", "none": F.lit(False)}, "status", clinical.RACE_STATUSES)


SQL["status_matrix"] = f"""WITH {PATIENTS}, m AS (SELECT *, CASE WHEN balance < 0 THEN 'missing' WHEN balance < 3000 THEN 'not_reported' ELSE 'mapped' END AS status FROM patients),
c(cohort) AS (VALUES ('all'), ('asia'), ('building'), ('none'))
SELECT cohort, {', '.join(f"count(*) FILTER (WHERE status = '{s}' AND (cohort = 'all' OR (cohort = 'asia' AND region = 'ASIA') OR (cohort = 'building' AND segment = 'BUILDING'))) AS {s}" for s in clinical.RACE_STATUSES)} FROM c, m GROUP BY cohort"""


@query
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.class_counts(predictions(spark, sf_dir), ["y", "toxic"])


SQL["class_counts"] = f"WITH {PREDICTIONS} SELECT 'y' AS task, y::VARCHAR AS label, count(*) AS n FROM preds WHERE y IS NOT NULL GROUP BY ALL UNION ALL SELECT 'toxic', toxic::VARCHAR, count(*) FROM preds WHERE toxic IS NOT NULL GROUP BY ALL"


@query
def labelled_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).withColumns({"raw": F.when(F.col("patient_id") % 11 == 0, "NaN").when(F.col("patient_id") % 5 == 0, "").otherwise(F.concat(F.col("y").cast("string"), F.lit(".0"))), "fold": (F.col("patient_id") % 5).cast("string")})
    return cohort.labelled(p.where(clinical.number(F.col("raw")).isNotNull()), "raw", "fold", F.col("lang") == "en").groupBy("raw", "fold").agg(F.count("*").alias("n"))


SQL["labelled_cohort"] = f"WITH {PREDICTIONS} SELECT y AS raw, (patient_id % 5)::INTEGER AS fold, count(*) AS n FROM preds WHERE patient_id % 11 != 0 AND patient_id % 5 != 0 AND lang = 'en' GROUP BY ALL"


# Clinical fields and identities


@query
def clinical_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = patients(spark, sf_dir)
    raw = F.element_at(F.array(*[F.lit(x) for x in ("\tWhite\n", "black or african american\u00a0", " \r\nAsian", "unknown\x0b", "\t \n", "martian")]), (F.col("patient_id") % 6 + 1).cast("int"))
    days = -F.floor(F.abs(F.col("balance")) * 4)
    return p.select("patient_id", clinical.lookup(raw, clinical.RACES).alias("race"), clinical.race_status(raw).alias("race_status"), F.round(days / 365.25, 6).alias("exact"), clinical.age_bin(clinical.age_years(days)).alias("age_bin"))


SQL["clinical_fields"] = f"""WITH {PATIENTS} SELECT patient_id, CASE patient_id % 6 WHEN 0 THEN 'White' WHEN 1 THEN 'Black' WHEN 2 THEN 'Asian' END AS race,
CASE WHEN patient_id % 6 < 3 THEN 'mapped' WHEN patient_id % 6 = 3 THEN 'not_reported' WHEN patient_id % 6 = 4 THEN 'missing' ELSE 'unsupported_category' END AS race_status,
round(-floor(abs(balance) * 4) / 365.25::DOUBLE, 6) AS exact, CASE WHEN round(floor(abs(balance) * 4) / 365.25::DOUBLE, 4) < 65 THEN 'age<65' ELSE 'age>=65' END AS age_bin FROM patients"""


@query
def diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of an order as the diagnoses of a case."""
    t, p = tiles(spark, sf_dir), table(spark, sf_dir, "part")
    words = {"ring": "\tductal Carcinoma\n", "widget": "Lobular carcinoma \u2003"}
    name = F.substring_index("p_name", " ", -1)
    named = t.join(p, F.col("part") == F.col("p_partkey")).select("slide", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), name), name).alias("d"))
    case = named.groupBy("slide").agg(F.collect_list("d").alias("names"))
    return case.select("slide", clinical.diagnoses_joined(F.col("names")).alias("primary_diagnosis"), clinical.breast_subtype(F.col("names")).alias("subtype"))


SQL["diagnoses"] = f"""WITH {TILES}, n AS (SELECT slide, CASE split_part(p_name, ' ', -1) WHEN 'ring' THEN 'ductal Carcinoma' WHEN 'widget' THEN 'Lobular carcinoma' ELSE split_part(p_name, ' ', -1) END AS d FROM tiles JOIN part ON part = p_partkey)
SELECT slide, string_agg(DISTINCT d, '|' ORDER BY d) AS primary_diagnosis,
CASE WHEN bool_or(d LIKE 'duct%') AND bool_or(d LIKE 'Lob%') THEN 'ambiguous' WHEN bool_or(d LIKE 'duct%') THEN 'ductal' WHEN bool_or(d LIKE 'Lob%') THEN 'lobular' ELSE 'unclassified' END AS subtype FROM n GROUP BY slide"""


@query
def parsed_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return e.select("event_id", clinical.whole(k).alias("k"), clinical.number(F.when(F.col("event_id") % 3 == 0, "nan").otherwise(k)).alias("x"), clinical.factor_value(F.when(F.col("event_id") % 4 == 0, "\n None\t").otherwise(F.col("event_type"))).alias("factor"))


SQL["parsed_properties"] = """SELECT event_id, (props->>'$.k')::DOUBLE::INTEGER AS k, CASE WHEN event_id % 3 != 0 THEN (props->>'$.k')::DOUBLE END AS x,
CASE WHEN event_id % 4 != 0 THEN event_type END AS factor FROM events"""


@query
def path_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = slides(spark, sf_dir)
    barcode = F.format_string("TCGA-%02d-%04d", F.col("patient_id") % 90 + 10, F.col("patient_id") % 9000 + 1000)
    path = F.concat(barcode, F.lit("-01Z/"), barcode, F.format_string("-DX%d.svs", F.col("slide")))
    return s.select(
        "slide", identity.patient_of_path(path).alias("of_path"), identity.patient_of_slide(path).alias("of_slide"), identity.patient_of_slide(F.lit("a/b-c")).alias("short"),
        identity.patient_of_file(F.when(F.col("slide") % 2 == 0, barcode).otherwise(F.lit("other")), F.lit(None).cast("string"), path).alias("of_file"), identity.strict_patient(path).alias("strict"), identity.site_code(barcode).alias("site"),
    )


SQL["path_identities"] = f"WITH {SLIDES}, b AS (SELECT slide, printf('TCGA-%02d-%04d', patient_id % 90 + 10, patient_id % 9000 + 1000) AS b FROM slides) SELECT slide, b AS of_path, b AS of_slide, NULL::VARCHAR AS short, b AS of_file, b AS strict, substr(b, 6, 2) AS site FROM b"


@query
def id_set_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.id_set_digest(slides(spark, sf_dir), "patient_id", ["status"])


SQL["id_set_digest"] = f"""WITH {SLIDES}, ids AS (SELECT DISTINCT status, patient_id::VARCHAR AS id FROM slides WHERE patient_id IS NOT NULL),
b AS (SELECT status, substr(sha256(id), 1, 3) AS bucket, count(*) AS n, sha256(string_agg(id, chr(10) ORDER BY id)) AS d FROM ids GROUP BY ALL)
SELECT status, sum(n)::BIGINT AS n, sha256(string_agg(d, chr(10) ORDER BY bucket)) AS sha256 FROM b GROUP BY status"""


@query
def ordered_payload_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("payload", F.coalesce("text", F.lit("")).cast("binary"))
    return identity.payload_digest(d.withColumn("key", F.col("doc_id").cast("string")), "doc_id", "key", "payload", "source")


SQL["ordered_payload_digest"] = """WITH b AS (SELECT source, doc_id // 4096 AS bucket, count(*) AS n, sha256(string_agg(doc_id || chr(9) || doc_id || chr(9) || octet_length(encode(coalesce(text, ''))) || chr(9) || sha256(coalesce(text, '')), chr(10) ORDER BY doc_id)) AS d
FROM documents GROUP BY ALL) SELECT source, sum(n)::BIGINT AS n, sha256(string_agg(d, chr(10) ORDER BY bucket)) AS sha256 FROM b GROUP BY source"""


@query
def canonical_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("orders"), F.min("o_orderstatus").alias("status"))
    return o.select("o_custkey", clinical.digest(clinical.canonical_json(F.struct("o_custkey", "orders", "status"))).alias("sha256"))


SQL["canonical_records"] = """SELECT o_custkey, sha256('{"o_custkey":' || o_custkey || ',"orders":[' || string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) || '],"status":"' || min(o_orderstatus) || '"}') AS sha256
FROM orders GROUP BY o_custkey"""


# Audits


@query
def audit_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    rows = p.select(F.when(F.col("patient_id") % 50 == 0, "").otherwise((F.col("patient_id") / 2).cast("int").cast("string")).alias("patient_id"), F.when(F.col("patient_id") % 40 == 1, 2).otherwise(F.col("y")).alias("y_true"), F.when(F.col("patient_id") % 30 == 1, float("nan")).otherwise(F.col("score")).alias("y_score"))
    return audit.prediction_rows(rows).groupBy("problem").agg(F.count("*").alias("n"))


SQL["audit_predictions"] = f"""WITH {PREDICTIONS}, r AS (SELECT CASE WHEN patient_id % 50 = 0 THEN '' ELSE (patient_id // 2)::VARCHAR END AS id, patient_id % 40 = 1 OR patient_id % 30 = 1 AS bad FROM preds)
SELECT problem, count(*) AS n FROM (SELECT CASE WHEN id = '' THEN 'no id' WHEN bad THEN 'label or score' END AS problem FROM r UNION ALL SELECT 'repeated' FROM r GROUP BY id HAVING count(*) > 1) WHERE problem IS NOT NULL GROUP BY problem"""


@query
def audit_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = arm_scores(spark, sf_dir).where("not (arm = 'posthoc' and patient_id % 17 = 0)").withColumn("y", F.when((F.col("arm") == "pretraining") & (F.col("patient_id") % 13 == 0), 1 - F.col("y")).otherwise(F.col("y")))
    return audit.arm_alignment(s, ["y", "lang"], ("control", 0)).groupBy("arm", "run", "problem").agg(F.count("*").alias("n"))


SQL["audit_arms"] = f"""WITH {ARM_SCORES} SELECT arm, run, CASE WHEN arm = 'posthoc' THEN 'absent' ELSE 'y differs' END AS problem, count(*) AS n FROM scores
WHERE (arm = 'posthoc' AND patient_id % 17 = 0) OR (arm = 'pretraining' AND patient_id % 13 = 0) GROUP BY ALL"""


@query
def audit_fold_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).withColumn("fold", F.when(F.col("lang") == "en", F.col("patient_id") % 6).otherwise(F.col("patient_id") % 4))
    return audit.fold_coverage(p, "fold", [0, 1, 2, 3, 4], ["lang"])


SQL["audit_fold_coverage"] = f"""WITH {PREDICTIONS}, f AS (SELECT DISTINCT lang, (CASE WHEN lang = 'en' THEN patient_id % 6 ELSE patient_id % 4 END)::INTEGER AS fold FROM preds),
w AS (SELECT DISTINCT lang, k::INTEGER AS fold FROM preds, range(5) r(k))
SELECT lang, fold, 'absent' AS problem FROM w ANTI JOIN f USING (lang, fold) UNION ALL SELECT lang, fold, 'not required' FROM f WHERE fold NOT BETWEEN 0 AND 4"""


def nested_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).withColumn("original_fold", (F.col("patient_id") % 5).cast("int")).withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(5)])))
    own = F.col("k") == F.col("original_fold")
    return p.select("patient_id", F.col("lang").alias("tss"), "original_fold", F.when(own, "outer").otherwise("inner").alias("prediction_role"), F.col("k").alias("calibration_outer_fold"), F.when(~own, F.col("original_fold")).alias("inner_fold"))


@query
def audit_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nested_rows(spark, sf_dir).where("not (patient_id % 19 = 0 and calibration_outer_fold = 2)")
    rows = rows.withColumn("inner_fold", F.when((F.col("patient_id") % 23 == 0) & (F.col("prediction_role") == "inner"), F.lit(9)).otherwise(F.col("inner_fold")))
    return audit.nested_records(rows)


SQL["audit_nested"] = f"""WITH {PREDICTIONS}, r AS (SELECT patient_id, patient_id % 5 AS own, k FROM preds, range(5) t(k) WHERE NOT (patient_id % 19 = 0 AND k = 2))
SELECT problem, count(*) AS n FROM (SELECT 'inner fold' AS problem FROM r WHERE own != k AND patient_id % 23 = 0 UNION ALL SELECT 'rows of a patient' FROM r GROUP BY patient_id HAVING count(*) != 5) GROUP BY problem"""


@query
def slides_in_several_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.slides_in_several_files(tiles(spark, sf_dir).withColumn("file", F.col("part") % 3), "slide", "file")


SQL["slides_in_several_files"] = f"WITH {TILES} SELECT slide, count(DISTINCT part % 3) AS files FROM tiles GROUP BY slide HAVING count(DISTINCT part % 3) > 1"


@query
def holdout_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.leaked(slides(spark, sf_dir).where("status = 'F'"), cohort_patients(spark, sf_dir), "patient_id")


SQL["holdout_leak"] = f"WITH {PATIENTS}, {COHORT}, {SLIDES} SELECT DISTINCT patient_id FROM slides SEMI JOIN cohort USING (patient_id) WHERE status = 'F'"


@query
def best_regularisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = metrics.auc_by(arm_scores(spark, sf_dir), ["lang", "arm", "run"]).withColumns({"grid_pos": F.col("run"), "auc": F.round("auc", 2)})
    return probe.best_first(runs, ["lang", "arm"]).select("lang", "arm", "grid_pos", "auc")


SQL["best_regularisation"] = f"""WITH {ARM_SCORES}, a AS (SELECT lang, arm, run, round(auc, 2) AS auc FROM ({auc_sql('scores', 'lang, arm, run')}))
SELECT lang, arm, run AS grid_pos, auc FROM a QUALIFY row_number() OVER (PARTITION BY lang, arm ORDER BY auc DESC NULLS LAST, run) = 1"""


# Run logs


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))") / 1e6).alias("seconds"), (F.col("event_id") * 10.0).alias("examples"), (F.col("event_type") == "signup").alias("validation"), "event_type")


LOG = "log AS (SELECT user_id AS run, event_id AS step, epoch_us(ts) / 1e6::DOUBLE AS seconds, event_id * 10.0::DOUBLE AS examples, event_type = 'signup' AS validation, event_type FROM events)"


@query
def log_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.rates(log(spark, sf_dir), "run", "step", "seconds", ["examples"], "validation").select("run", "step", F.round("examples_per_s", 4).alias("examples_per_s"))


SQL["log_rates"] = f"""WITH {LOG}, s AS (SELECT *, sum(validation::INTEGER) OVER (PARTITION BY run ORDER BY step) AS seg FROM log)
SELECT run, step, round((examples - lag(examples) OVER w) / nullif(seconds - lag(seconds) OVER w, 0), 4) AS examples_per_s FROM s WINDOW w AS (PARTITION BY run, seg ORDER BY step)"""


@query
def cumulative_uniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 3).alias("run"), F.floor(F.col("event_id") / 100).alias("step"), "user_id")
    return runlog.cumulative_uniques(e, "run", "step", "user_id")


SQL["cumulative_uniques"] = """WITH e AS (SELECT event_id % 3 AS run, event_id // 100 AS step, user_id FROM events), f AS (SELECT run, min(step) AS step FROM e GROUP BY run, user_id), n AS (SELECT run, step, count(*) AS new FROM f GROUP BY ALL)
SELECT run, step, sum(coalesce(new, 0)) OVER (PARTITION BY run ORDER BY step)::BIGINT AS unique_so_far FROM (SELECT DISTINCT run, step FROM e) LEFT JOIN n USING (run, step)"""


@query
def coverage_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = slides(spark, sf_dir).join(tiles(spark, sf_dir), "slide")
    return runlog.distinct_counts(both, ["patient_id", "slide", "part"], ["status"])


SQL["coverage_counters"] = f"WITH {SLIDES}, {TILES} SELECT status, count(DISTINCT patient_id) AS n_patient_id, count(DISTINCT slide) AS n_slide, count(DISTINCT part) AS n_part FROM slides JOIN tiles USING (slide) GROUP BY status"


@query
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min("seconds").over(Window.partitionBy("run"))
    out = runlog.run_report(log(spark, sf_dir).withColumn("wall", F.col("seconds") - first), "run", "step", "wall", "examples", 1e6)
    return out.withColumns({"budget_part": F.round("budget_part", 6), "mean_rate": F.round("mean_rate", 6)})


SQL["run_report"] = f"""WITH {LOG}, l AS (SELECT *, seconds - min(seconds) OVER (PARTITION BY run) AS wall, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS r FROM log)
SELECT run, step AS last_step, examples AS n, round(examples / 1e6, 6) AS budget_part, round(examples / greatest(1.0, wall), 6) AS mean_rate FROM l WHERE r = 1"""


@query
def run_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).withColumn("known", F.col("lang") == "en")
    return runlog.run_header(p, "y", "n_chars", "known").withColumn("join_rate", F.round("join_rate", 6))


SQL["run_header"] = f"WITH {PREDICTIONS} SELECT count(*) AS patients, sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg, sum(n_chars)::BIGINT AS tiles, round(avg((lang = 'en')::INTEGER), 6) AS join_rate FROM preds"


# Contracts


@query
def dataset_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory and content manifest of the tables' files themselves."""
    listed = contracts.files(spark, sf_dir, "*.parquet")
    return contracts.inventory(listed).crossJoin(contracts.manifest(contracts.content_digests(listed)).select("content_sha256"))

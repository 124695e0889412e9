"""The given tables in the roles that the operators ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARMS = {"control": (7, 131, 0), "posthoc": (11, 57, 250), "pretraining": (13, 89, 400)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(patient_id, segment, region, balance)."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), F.col("n_regionkey") == r["r_regionkey"])
    return joined.select(F.col("c_custkey").alias("patient_id"), F.col("c_mktsegment").alias("segment"), F.col("r_name").alias("region"), F.col("c_acctbal").alias("balance"))


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(patient_id, slide, status)."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("patient_id"), F.col("o_orderkey").alias("slide"), F.col("o_orderstatus").alias("status"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slide, tile, part, quantity, flag)."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("slide"), F.col("l_linenumber").alias("tile"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag")
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(patient_id, lang, source, n_chars, y, toxic, score)."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(l, "doc_id").select(
        F.col("doc_id").alias("patient_id"), "lang", "source", "n_chars", F.col("quality").alias("y"), "toxic", (F.col("n_chars") % 1000 / 1000.0).alias("score")
    )


def arm_scores(spark: SparkSession, sf_dir: str, runs: int = 2) -> DataFrame:
    """(arm, run, patient_id, y, lang, score) of three arms whose scores follow from the length and the label."""
    base = predictions(spark, sf_dir).drop("score")
    arms = F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(m).alias("m"), F.lit(s).alias("s"), F.lit(b).alias("b")) for a, (m, s, b) in ARMS.items()])
    long = base.withColumn("a", F.explode(arms)).withColumn("run", F.explode(F.array(*[F.lit(i) for i in range(runs)])))
    score = (F.col("n_chars") * F.col("a.m") + F.col("run") * F.col("a.s") + F.col("y") * F.col("a.b")) % 1000 / 1000.0
    return long.select("a.arm", "run", "patient_id", "y", "lang", score.alias("score"))


PATIENTS = "patients AS (SELECT c_custkey AS patient_id, c_mktsegment AS segment, r_name AS region, c_acctbal AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
SLIDES = "slides AS (SELECT o_custkey AS patient_id, o_orderkey AS slide, o_orderstatus AS status FROM orders)"
TILES = "tiles AS (SELECT l_orderkey AS slide, l_linenumber AS tile, l_partkey AS part, l_quantity AS quantity, l_returnflag AS flag FROM lineitem)"
PREDICTIONS = "preds AS (SELECT d.doc_id AS patient_id, lang, source, n_chars, quality AS y, toxic, (n_chars % 1000) / 1000.0::DOUBLE AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
ARM_SCORES = (
    PREDICTIONS
    + """, arms(arm, m, s, b) AS (VALUES ('control', 7, 131, 0), ('posthoc', 11, 57, 250), ('pretraining', 13, 89, 400)),
scores AS (SELECT arm, run, patient_id, y, lang, ((n_chars * m + run * s + y * b) % 1000) / 1000.0::DOUBLE AS score FROM preds, arms, (VALUES (0), (1)) r(run))"""
)


def auc_sql(source: str, keys: str, weight: str = "1") -> str:
    """AUROC by distinct score."""
    part = f"PARTITION BY {keys} ORDER BY score ROWS UNBOUNDED PRECEDING" if keys else "ORDER BY score ROWS UNBOUNDED PRECEDING"
    head, by = (f"{keys},", f"GROUP BY {keys}") if keys else ("", "")
    return f"""SELECT {head} sum(n)::BIGINT AS n, sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg,
  CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below - neg / 2.0))::DOUBLE / (sum(pos) * sum(neg))::DOUBLE END AS auc
FROM (SELECT *, sum(neg) OVER ({part}) AS below FROM (
  SELECT {head} score, sum({weight})::DOUBLE AS n, sum({weight} * y)::DOUBLE AS pos, sum({weight} * (1 - y))::DOUBLE AS neg FROM {source} GROUP BY {head} score)) {by}"""

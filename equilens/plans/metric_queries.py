"""Metric, bootstrap, model and vector queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import cosine, normalised
from ..operators import bootstrap, debias, metrics, pairwise, probe
from .roles import ARM_SCORES, PREDICTIONS, arm_scores, auc_sql, predictions, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
ATTRIBUTES = ["lang", "source"]
ITERATIONS, SEED = 2000, 11


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query
def subgroup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = metrics.subgroup_report(predictions(spark, sf_dir), ATTRIBUTES, min_n=10)
    return rounded(report, "auc", "ece")


LONG = PREDICTIONS + ", long AS (SELECT 'lang' AS attribute, lang AS grp, y, score FROM preds WHERE lang IS NOT NULL UNION ALL SELECT 'source', source, y, score FROM preds WHERE source IS NOT NULL)"
EDGES = ", ".join(repr(e) + "::DOUBLE" for e in metrics.ECE_EDGES)
BIN = f"CASE WHEN score >= 0 AND score <= 1 THEN len(list_filter([{EDGES}], lambda e: score >= e)) END"
REPORT = LONG + f""", aucs AS ({auc_sql("long", "attribute, grp")}),
bins AS (SELECT attribute, grp, {BIN} AS bin, count(*) AS n, abs(sum(y) - sum(score)) AS off FROM long GROUP BY ALL),
eces AS (SELECT attribute, grp, coalesce(sum(off) FILTER (WHERE bin IS NOT NULL), 0) / sum(n) AS ece FROM bins GROUP BY ALL),
report AS (SELECT attribute, grp, n, n_pos, n_neg, auc, ece, n < 10 OR least(n_pos, n_neg) < 5 AS insufficient_support,
  NOT (n < 10 OR least(n_pos, n_neg) < 5) AND auc IS NOT NULL AS eligible_for_gap FROM aucs JOIN eces USING (attribute, grp))"""
SQL["subgroup_report"] = f"WITH {REPORT} SELECT * REPLACE (round(auc, 6) AS auc, round(ece, 6) AS ece) FROM report"


@query
def gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.gaps(predictions(spark, sf_dir), ATTRIBUTES, min_n=10), "attr_overall_auc", "auc_delta", "ece_delta", "es_auc")


SQL["gap_report"] = f"""WITH {REPORT}, overall AS ({auc_sql("long", "attribute")}),
joined AS (SELECT o.attribute, o.auc AS o, CASE WHEN eligible_for_gap THEN r.auc END AS a, CASE WHEN eligible_for_gap THEN ece END AS e FROM overall o JOIN report r USING (attribute)),
g AS (SELECT attribute, o, count(a) AS n_eligible, max(a) - min(a) AS da, max(e) - min(e) AS de, sum(abs(o - a)) AS off FROM joined GROUP BY ALL)
SELECT attribute, n_eligible, round(o, 6) AS attr_overall_auc, round(CASE WHEN n_eligible >= 2 THEN da END, 6) AS auc_delta,
  round(CASE WHEN n_eligible >= 2 THEN de END, 6) AS ece_delta, round(CASE WHEN n_eligible >= 2 THEN o / (1 + off) END, 6) AS es_auc FROM g"""


@query
def average_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_rank(predictions(spark, sf_dir), "score", ["lang"]).select("patient_id", "lang", "rank")


SQL["average_rank"] = f"""WITH {PREDICTIONS} SELECT patient_id, lang,
  rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0::DOUBLE AS rank FROM preds"""


@query
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = predictions(spark, sf_dir).withColumn("bin", metrics.ece_bin(F.col("score"))).groupBy("lang", "bin")
    return bins.agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("observed"), F.round(F.avg("score"), 6).alias("expected"))


SQL["calibration_bins"] = f"WITH {PREDICTIONS} SELECT lang, {BIN}::INTEGER AS bin, count(*) AS n, round(avg(y), 6) AS observed, round(avg(score), 6) AS expected FROM preds GROUP BY ALL"


def groups_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.eligible_groups(predictions(spark, sf_dir), "lang", "y", 20, 5)


@query
def eligible_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups_of(spark, sf_dir)


ELIGIBLE = "eligible AS (SELECT lang FROM preds WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= 20 AND sum(y) >= 5 AND sum(1 - y) >= 5)"
SQL["eligible_groups"] = f"WITH {PREDICTIONS}, {ELIGIBLE} SELECT lang FROM eligible"


def metrics_sql(keys: str, source: str, weight: str = "1") -> str:
    plain = ", ".join(keys.split(", "))
    return f"""overall AS ({auc_sql(source, plain, weight)}),
by_group AS ({auc_sql(f"(SELECT s.* FROM {source} s SEMI JOIN eligible USING (lang))", plain + ", lang", weight)}),
gap AS (SELECT {plain}, CASE WHEN count(auc) = (SELECT count(*) FROM eligible) THEN max(auc) - min(auc) END AS gap FROM by_group GROUP BY ALL),
arm_metrics AS (SELECT {plain}, auc, gap FROM overall LEFT JOIN gap USING ({plain}))"""


def contrasts_sql(keys: str) -> str:
    of = lambda c, a: f"max({c}) FILTER (WHERE arm = '{a}')"
    diff = lambda c, a, b: f"{of(c, a)} - {of(c, b)}"
    return f"""contrasts AS (SELECT {keys},
  {diff('gap', 'control', 'pretraining')} AS pretraining_fairness_improvement, {diff('auc', 'pretraining', 'control')} AS pretraining_utility_delta,
  {diff('gap', 'control', 'posthoc')} AS posthoc_fairness_improvement, {diff('auc', 'posthoc', 'control')} AS posthoc_utility_delta,
  {diff('gap', 'posthoc', 'pretraining')} AS fairness_advantage, {diff('auc', 'pretraining', 'posthoc')} AS utility_delta FROM arm_metrics GROUP BY {keys})"""


@query
def arm_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bootstrap.run_summary(arm_scores(spark, sf_dir), "lang", groups_of(spark, sf_dir))
    return rounded(out, *[c for c in out.columns if c != "run"])


CONTRAST_COLUMNS = ["pretraining_fairness_improvement", "pretraining_utility_delta", "posthoc_fairness_improvement", "posthoc_utility_delta", "fairness_advantage", "utility_delta"]
ARMS_SQL = f"WITH {ARM_SCORES}, {ELIGIBLE}, {metrics_sql('arm, run', 'scores')}, {contrasts_sql('run')}"
SQL["arm_contrasts"] = ARMS_SQL + " SELECT run, " + ", ".join(f"round({c}, 6) AS {c}" for c in CONTRAST_COLUMNS) + " FROM contrasts"


@query
def timing_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bootstrap.run_summary(arm_scores(spark, sf_dir), "lang", groups_of(spark, sf_dir))
    return out.agg(*[F.round(F.percentile(c, 0.5), 6).alias(c) for c in CONTRAST_COLUMNS])


SQL["timing_point"] = ARMS_SQL + " SELECT " + ", ".join(f"round(median({c}), 6) AS {c}" for c in CONTRAST_COLUMNS) + " FROM contrasts"


@query
def bootstrap_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = bootstrap.paired_bootstrap(arm_scores(spark, sf_dir), "lang", groups_of(spark, sf_dir), ITERATIONS, SEED)
    out = bootstrap.decision(bootstrap.intervals(samples), ITERATIONS)
    return rounded(out, *[c for c, t in out.dtypes if t == "double"])


def draw_sql(parts: str, below: str) -> str:
    return f"('0x' || substr(sha256('{SEED}:' || {parts}), 1, 13))::BIGINT % {below}"


SQL["bootstrap_decision"] = f"""WITH {ARM_SCORES}, {ELIGIBLE},
ranked AS (SELECT patient_id, y, row_number() OVER (PARTITION BY y ORDER BY sha256('bootstrap:' || patient_id), patient_id) - 1 AS k, count(*) OVER (PARTITION BY y) AS of_y FROM (SELECT DISTINCT patient_id, y FROM scores)),
its AS (SELECT range AS it FROM range({ITERATIONS})),
times AS (SELECT it, y, {draw_sql("it || ':' || y || ':' || k", "of_y")} AS k, count(*) AS times FROM ranked, its GROUP BY ALL),
drawn AS (SELECT it, patient_id, times FROM times JOIN ranked USING (y, k)),
runs AS (SELECT run, row_number() OVER (ORDER BY run) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT run FROM scores)),
run_draws AS (SELECT it, run, run_times FROM (SELECT it, {draw_sql("'run:' || it || ':' || k", "n")} AS k, count(*) AS run_times FROM runs, its GROUP BY ALL) JOIN runs USING (k)),
sampled AS (SELECT it, arm, run, lang, y, score, times FROM scores JOIN drawn USING (patient_id) JOIN run_draws USING (it, run)),
{metrics_sql('it, arm, run', 'sampled', 'times')}, {contrasts_sql('it, run')},
repeated AS (SELECT c.* FROM contrasts c JOIN run_draws USING (it, run), range(64) t WHERE t.range < run_times),
samples AS (SELECT it, median(fairness_advantage) AS fairness_advantage, median(utility_delta) AS utility_delta FROM repeated GROUP BY it HAVING count(fairness_advantage) = count(*)),
ci AS (SELECT count(*) AS valid_iterations, {', '.join(f"quantile_cont({c}, 0.025) AS {c}_lower, quantile_cont({c}, 0.975) AS {c}_upper, avg(({c} <= 0)::DOUBLE) AS {c}_le_zero" for c in ("fairness_advantage", "utility_delta"))} FROM samples)
SELECT valid_iterations, {', '.join(f"round({c}, 6) AS {c}" for k in ("fairness_advantage", "utility_delta") for c in (k + "_lower", k + "_upper", k + "_le_zero"))},
  CASE WHEN valid_iterations >= {ITERATIONS // 2} THEN fairness_advantage_lower > 0 END AS fairness_superior, CASE WHEN valid_iterations >= {ITERATIONS // 2} THEN utility_delta_lower >= -0.02 END AS utility_noninferior,
  CASE WHEN valid_iterations >= {ITERATIONS // 2} THEN fairness_advantage_lower > 0 AND utility_delta_lower >= -0.02 END AS supports_pretraining FROM ci"""


@query
def macro_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return rounded(metrics.macro_auc(vectors, list(range(10)), "label", lambda c: F.get("embedding", F.lit(c)).cast("double")), "macro_auc")


SQL["macro_auc"] = f"""WITH long AS (SELECT c AS class, (label = c)::INTEGER AS y, embedding[c + 1]::DOUBLE AS score FROM embeddings, (SELECT range::INTEGER AS c FROM range(10)))
SELECT round(avg(auc), 6) AS macro_auc, count(auc) AS n_classes FROM ({auc_sql("long", "class")})"""


@query
def patient_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = pairwise.mean_vectors(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return means.select("label", "n", F.posexplode("vector").alias("i", "x")).select("label", "n", "i", F.round("x", 6).alias("x"))


MEANS = "means AS (SELECT label, i - 1 AS i, avg(embedding[i]::DOUBLE) AS x, count(*) AS n FROM embeddings, (SELECT range::INTEGER AS i FROM range(1, 65)) GROUP BY ALL)"
SQL["patient_vectors"] = f"WITH {MEANS} SELECT label, n, i::INTEGER AS i, round(x, 6) AS x FROM means"


@query
def class_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pairwise.prototypes(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return made.select("label", F.posexplode("prototype").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


SQL["class_prototypes"] = f"WITH {MEANS} SELECT label, i::INTEGER AS i, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY label)), 1e-6), 6) AS x FROM means"


@query
def prototype_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    made = pairwise.prototypes(vectors, "label", "embedding").select("label", "prototype")
    return vectors.join(F.broadcast(made), "label").select("vec_id", F.round(cosine(F.col("embedding"), F.col("prototype"), 0.2), 6).alias("similarity"))


SQL["prototype_similarity"] = f"""WITH {MEANS}, p AS (SELECT label, list(x ORDER BY i) AS v FROM means GROUP BY label),
e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS w FROM embeddings)
SELECT vec_id, round(list_dot_product(w, v) / (sqrt(list_dot_product(w, w)) * sqrt(list_dot_product(v, v))) / 0.2, 6) AS similarity FROM e JOIN p USING (label)"""


def in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "embedding", (F.col("label") % 2).alias("sensitive"), (F.col("label") % 5).alias("condition"), F.floor(F.col("vec_id") / 128).alias("block"))


@query
def contrastive_disparity(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = pairwise.contrastive_anchors(in_blocks(spark, sf_dir), "vec_id", "embedding", "sensitive", "same_condition_different", "condition")
    return anchors.select("block", "vec_id", F.round("loss", 5).alias("loss"))


def pairs_sql(allowed: str) -> str:
    return f"""WITH e AS (SELECT vec_id, vec_id // 128 AS block, label % 2 AS s, label % 5 AS c, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT * REPLACE (list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-6)) AS v) FROM e),
pairs AS (SELECT a.block, a.vec_id, list_dot_product(a.v, b.v) / 0.2 AS logit, a.c = b.c AND a.s != b.s AS positive FROM u a JOIN u b ON a.block = b.block AND a.vec_id != b.vec_id WHERE {allowed}),
den AS (SELECT block, vec_id, ln(sum(exp(logit))) AS lse FROM pairs GROUP BY ALL)"""


SQL["contrastive_disparity"] = pairs_sql("true") + " SELECT block, vec_id, round(-avg(logit - lse), 5) AS loss FROM pairs JOIN den USING (block, vec_id) WHERE positive GROUP BY ALL"


@query
def consistent_disparity(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = pairwise.contrastive_anchors(in_blocks(spark, sf_dir), "vec_id", "embedding", "sensitive", "same_condition_different", "condition", consistent=True)
    return anchors.select("block", "vec_id", F.round("loss", 5).alias("loss"))


SQL["consistent_disparity"] = pairs_sql("a.c = b.c") + """ SELECT block, vec_id, round(-avg(logit - lse) FILTER (WHERE positive), 5) AS loss FROM pairs JOIN den USING (block, vec_id)
GROUP BY ALL HAVING count(*) FILTER (WHERE positive) > 0 AND count(*) FILTER (WHERE NOT positive) > 0"""


@query
def preserving_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pairwise.preserving_objective(in_blocks(spark, sf_dir).withColumn("condition", F.col("condition").cast("int")), "vec_id", "embedding", "sensitive", "condition", 0.5)
    return found.select(*[F.round(c, 5).alias(c) for c in ("preserve", "fair", "objective")])


ANCHORS = f"""WITH same AS ({pairs_sql("true").replace("a.c = b.c AND a.s != b.s AS positive", "a.c = b.c AS positive")} SELECT -avg(logit - lse) AS loss FROM pairs JOIN den USING (block, vec_id) WHERE positive GROUP BY block, vec_id),
fair AS ({SQL["consistent_disparity"].replace("round(", "(").replace(", 5) AS loss", ") AS loss")})"""
SQL["preserving_objective"] = ANCHORS + """, m AS (SELECT coalesce((SELECT avg(loss) FROM same), 0) AS preserve, coalesce((SELECT avg(loss) FROM fair), 0) AS fair)
SELECT round(preserve, 5) AS preserve, round(fair, 5) AS fair, round(preserve + 0.5 * fair, 5) AS objective FROM m"""


@query
def vector_uniformity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.uniformity(in_blocks(spark, sf_dir), "embedding").select(F.round("loss", 5).alias("loss"))


SQL["vector_uniformity"] = f"""{pairs_sql("true")}, d AS (SELECT ln(sum(exp(5.0 * 0.2 * logit))) AS l FROM pairs GROUP BY block, vec_id) SELECT round(avg(l), 5) AS loss FROM d"""


@query
def moving_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("batch", F.floor(F.col("vec_id") / 100))
    moved = pairwise.moving_prototypes(e, "label", "batch", "embedding", 0.9)
    return moved.select("label", F.posexplode("prototype").alias("i", "x")).select("label", "i", F.round("x", 5).alias("x"))


# The average in closed form: the first mean fades with every later batch, a later one enters with 0.1.
SQL["moving_prototypes"] = """WITH m AS (SELECT label, vec_id // 100 AS batch, i - 1 AS i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, (SELECT range::INTEGER AS i FROM range(1, 65)) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY label, i ORDER BY batch) AS place, count(*) OVER (PARTITION BY label, i) AS n FROM m)
SELECT label, i::INTEGER AS i, round(sum(x * pow(0.9::DOUBLE, n - place) * CASE WHEN place = 1 THEN 1 ELSE 0.1::DOUBLE END), 5) AS x FROM k GROUP BY label, i"""


def probe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("patient_id"), (F.col("label") < 5).cast("int").alias("y"), (F.col("vec_id") % 3).cast("int").alias("fold"), "label", normalised(F.col("embedding")).alias("v"))
    return probe.features(e, "v")


@query
def probe_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe.internal_cv(probe_rows(spark, sf_dir), [0, 1, 2]).select("patient_id", "y", "fold", "c", F.round("score", 4).alias("score"), F.round("auc", 4).alias("auc"))


@query
def probe_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = probe_rows(spark, sf_dir)
    fit, other = probe.external_folds(rows.where("patient_id % 2 = 0")), rows.where("patient_id % 2 = 1")
    return probe.external(fit, other, list(range(probe.fitting_folds(fit)))).select("patient_id", "y", "c", F.round("score", 4).alias("score"))


@query
def attribute_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = probe_rows(spark, sf_dir).withColumn("attribute", (F.col("label") % 3).cast("int"))
    found = probe.leakage_auc(rows, "attribute", [0, 1, 2])
    return rows.agg(F.count("*").alias("n"), F.lit(found).cast("double").alias("leakage_auc"))


@query
def nested_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe.nested_cross_fit(probe_rows(spark, sf_dir), [0, 1, 2], 1.0)[0].withColumn("score", F.round("score", 4))


def debias_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as tiles of patients, ten each, with two attributes and a condition."""
    e = table(spark, sf_dir, "embeddings")
    of_label = lambda c, n: (F.col("label") % n).cast("int").alias(c)
    return e.select("vec_id", normalised(F.col("embedding")).alias("x"), (F.col("label") < 5).cast("int").alias("y"), of_label("sex", 2), of_label("race", 3), (F.col("vec_id") % 4).cast("int").alias("condition"), F.concat_ws("-", F.floor(F.col("vec_id") / 100), "label").alias("patient_id"), (F.floor(F.col("vec_id") / 100) % 2).cast("int").alias("fold"))


@query
def debiased_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients' scores outside their fold, of a plain head and of a conditional one with both attributes projected out."""
    tiles, out = debias_rows(spark, sf_dir), None
    for name, method, strength in (("plain", "dann", 0.0), ("projected", "pcgrad", 1.0)):
        settings = debias.Settings({"sex": 2, "race": 3}, method, conditions=4)
        part = debias.out_of_fold(tiles, None, 64, settings, strength, [0, 1], epochs=20)
        part = part.select("patient_id", "y", "fold", F.round("score", 6).alias(f"score_{name}"))
        out = part if out is None else out.join(part, ["patient_id", "y", "fold"])
    return out


@query
def debias_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leakage and gaps of a plain head and one with prototypes, side by side."""
    return debias.comparison(debias_rows(spark, sf_dir), None, 64, debias.Settings({"sex": 2}, "fino"), [0.0, 1.0], [0, 1], min_n=5, epochs=20)

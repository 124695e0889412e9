"""Operators on small tables with values worked out by hand or by numpy."""

import collections
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from equilens.functions import clinical, identity, vectors
from equilens.operators import audit, bootstrap, cohort, debias, embed, factors, folds, linear, metrics, pairwise, probe, runlog, sampling
from equilens.sources import contracts, file_index, tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def brute_auc(y, s):
    pos, neg = [b for a, b in zip(y, s) if a == 1], [b for a, b in zip(y, s) if a == 0]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None


def test_auc_ties_and_one_class(spark):
    rng = np.random.default_rng(0)
    data = [(g, int(rng.integers(0, 2)), float(rng.integers(0, 300)) / 290 - 0.01) for g in "ab" for _ in range(200)] + [("c", 1, 0.5)]
    df = spark.createDataFrame(data, "g string, y int, score double")
    got = {r["g"]: r["auc"] for r in metrics.auc_by(df, ["g"]).collect()}
    for g in "abc":
        want = brute_auc([y for h, y, _ in data if h == g], [s for h, _, s in data if h == g])
        assert got[g] == pytest.approx(want)


def test_weighted_auc_is_that_of_repeated_rows(spark):
    data = [(1, 0.2, 3), (0, 0.2, 2), (1, 0.9, 1), (0, 0.5, 4)]
    df = spark.createDataFrame(data, "y int, score double, w int")
    many = [(y, s) for y, s, w in data for _ in range(w)]
    assert metrics.auc_by(df, [], weight=F.col("w")).first()["auc"] == pytest.approx(brute_auc(*zip(*many)))


def test_ece_edges(spark):
    df = spark.createDataFrame([("a", 1, 0.3), ("a", 0, 1.0), ("a", 0, 1.5), ("a", 1, 0.0)], "g string, y int, score double")
    assert [r[0] for r in df.select(metrics.ece_bin(F.col("score"))).collect()] == [2, 9, None, 0]
    assert metrics.ece_by(df, ["g"]).first()["ece"] == pytest.approx((0.7 + 1.0 + 1.0) / 4)


def test_support_needs_both_classes(spark):
    df = spark.createDataFrame([(0, 0.1, "A")] * 30 + [(1, 0.9, "A")], "y int, score double, grp string")
    r = metrics.subgroup_report(df, ["grp"], min_n=20).first()
    assert (r["n"], r["n_pos"], r["insufficient_support"], r["eligible_for_gap"]) == (31, 1, True, False)


def three_arms(spark):
    data = []
    for g in "AB":
        for y in (0, 1):
            for i in range(10):
                good = float(y)
                data += [(a, 0, f"{g}{y}{i}", y, g, good if a == "pretraining" or g == "A" else 0.5) for a in bootstrap.ARMS]
    return spark.createDataFrame(data, "arm string, run int, patient_id string, y int, race string, score double")


def test_three_arms(spark):
    scores = three_arms(spark)
    groups = metrics.eligible_groups(scores.where("arm = 'control'"), "race", "y", 20, 10)
    assert rows(groups) == [("A",), ("B",)]
    assert bootstrap.run_summary(scores, "race", groups).first()["fairness_advantage"] == pytest.approx(0.5)
    ci = bootstrap.decision(bootstrap.intervals(bootstrap.paired_bootstrap(scores, "race", groups, 100, 3)), 100).first()
    assert ci["valid_iterations"] == 100 and ci["fairness_advantage_lower"] > 0 and ci["fairness_superior"]
    times = bootstrap.multiplicities(scores.select("patient_id", "y").distinct(), 5, 3)
    assert {r["sum(times)"] for r in times.groupBy("it").sum("times").collect()} == {40}


def clinical_cases(spark):
    kinds = [("LUAD", None), ("LUSC", None), ("LGG", None), ("GBM", None), ("BRCA", "Ductal carcinoma"), ("BRCA", "Lobular Carcinoma")]
    data = []
    for k, (code, d) in enumerate(kinds):
        for i in range(10):
            data.append((f"TCGA-{k}{i % 10}-{k}{i:03d}", (f"TCGA-{code}",), (["white", "asian"][i % 2], "female", -20000.0), [(d,)] if d else []))
    data.append(("TCGA-99-9999", ("TCGA-KIRC",), ("martian", "male", None), None))
    return spark.createDataFrame(data, clinical.CASE)


def test_clinical_rows_and_folds(spark):
    p = clinical.patients_of_cases(clinical_cases(spark))
    assert {r[0] for r in p.select("race").distinct().collect()} == {"White", "Asian", None}
    assert rows(cohort.class_counts(p, ["label_brca"])) == [("label_brca", "0", 10), ("label_brca", "1", 10)]
    assert p.where("race_status = 'unsupported_category'").count() == 1
    dealt = folds.stratified_folds(p, "patient_barcode", "label_brca", "race", "brca")
    assert {r[0] for r in dealt.select("fold").distinct().collect()} == {0, 1, 2, 3, 4}
    again = folds.stratified_folds(p.orderBy(F.desc("patient_barcode")).repartition(3), "patient_barcode", "label_brca", "race", "brca")
    assert rows(dealt.select("patient_barcode", "fold")) == rows(again.select("patient_barcode", "fold"))
    assert p.select("age").where("age is not null").first()[0] == round(20000 / 365.25, 4)


def test_factors(spark):
    df = spark.createDataFrame([("P2", "B", 60.0), ("P1", "A", 40.0), ("P3", "A", 50.0)], "p string, cancer string, age double")
    assert rows(factors.with_category_ids(df, "cancer").select("p", "id")) == [("P1", 0), ("P2", 1), ("P3", 0)]
    assert sum(r["z"] for r in factors.z_scores(df, "p", "age").collect()) == pytest.approx(0)
    with pytest.raises(ValueError):
        factors.with_category_ids(df.where("cancer = 'A'"), "cancer")
    long = df.select(F.lit("f").alias("factor"), F.col("p").alias("patient_id"), F.lit(1).alias("id"))
    maps = factors.factor_maps(long, "patient_id")
    assert rows(factors.from_maps(maps, "patient_id")) == rows(long)
    chosen = spark.createDataFrame([("f", 1), ("f", 1), ("g", 0)], "factor string, sign int")
    assert rows(factors.selection_violations(chosen, maps)) == [("f", "repeated"), ("g", "absent"), ("g", "no sign")]


def test_balanced_pool_is_a_round_robin(spark):
    data = [(f"p{i:02d}", "ab"[i % 2], i % 4) for i in range(16)]
    df = spark.createDataFrame(data, "p string, race string, condition int")
    pool = sampling.balanced_pool(df, "p", "condition", ["race"], 8)
    assert rows(pool.groupBy("stratum").count()) == [("0|a", 2), ("1|b", 2), ("2|a", 2), ("3|b", 2)]
    assert rows(pool) == rows(sampling.balanced_pool(df.orderBy(F.desc("p")).repartition(5), "p", "condition", ["race"], 8))
    assert sampling.balanced_pool(df, "p", "condition", ["race"], 0).count() == 0


def test_caps_permutation_and_resample(spark):
    df = spark.range(2000).select("id", (F.col("id") % 3).alias("k"), F.when(F.col("id") % 4 == 0, "x").otherwise("y").alias("a"))
    assert sampling.cap_per(df, "k", ["id"], 2).count() == 6 and sampling.cap_per(df, "k", ["id"], 0).count() == 2000
    assert sampling.cap_slides(df, "id", 0, True).count() == 2000 and sampling.cap_slides(df, "id", 0, False).count() == 0
    moved = sampling.permuted(df, "id", "a")
    assert rows(moved.groupBy("a").count()) == rows(df.groupBy("a").count()) and rows(moved) != rows(df.select("id", "a"))
    weighted = sampling.tile_weights(df.withColumn("a", F.when(F.col("id") % 10 != 3, F.col("a"))), "a")
    assert weighted.agg(F.avg("weight")).first()[0] == pytest.approx(1.0)
    drawn = sampling.resampled(weighted, "id", "weight", 2000).where("a is not null").groupBy("a").count().collect()
    assert all(abs(r["count"] - 900) < 150 for r in drawn)


def test_contrastive_against_numpy(spark):
    rng = np.random.default_rng(1)
    v, s, c = rng.normal(size=(40, 5)), rng.integers(0, 2, 40), rng.integers(0, 3, 40)
    df = spark.createDataFrame([(i, v[i].tolist(), int(s[i]), int(c[i]), 0) for i in range(40)], "id int, v array<double>, s int, c int, block long")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    logits = u @ u.T / 0.2
    np.fill_diagonal(logits, -np.inf)
    logp = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
    positive = (s[:, None] != s) & (c[:, None] == c)
    want = np.mean([-logp[i][positive[i]].mean() for i in range(40) if positive[i].any()])
    anchors = pairwise.contrastive_anchors(df, "id", "v", "s", "same_condition_different", "c")
    assert pairwise.contrastive_loss(anchors).first()["loss"] == pytest.approx(want)
    missing = df.withColumn("s", F.when(F.col("id") == 0, F.col("s")))
    assert pairwise.contrastive_loss(pairwise.contrastive_anchors(missing, "id", "v", "s")).first()["loss"] == 0
    with pytest.raises(Exception, match="not negative"):
        pairwise.contrastive_loss(anchors, df.select("id", F.lit(-1.0).alias("weight")), "id").collect()


def test_prototypes_and_moving_average(spark):
    df = spark.createDataFrame([("a", 0, [2.0, 0.0]), ("a", 1, [0.0, 4.0]), ("b", 0, [0.0, 1.0]), (None, 0, [9.0, 9.0])], "k string, batch int, v array<double>")
    got = {r["k"]: r["prototype"] for r in pairwise.moving_prototypes(df.where("k is not null"), "k", "batch", "v", 0.5).collect()}
    assert got == {"a": [1.0, 2.0], "b": [0.0, 1.0]}
    made = {r["k"]: r["prototype"] for r in pairwise.prototypes(df, "k", "v").collect()}
    assert made["a"] == pytest.approx([1 / 5**0.5, 2 / 5**0.5]) and set(made) == {"a", "b"}
    assert df.select(vectors.cosine(F.col("v"), F.col("v"))).first()[0] == pytest.approx(1)
    pixels = spark.createDataFrame([(bytearray([255, 0, 0, 10, 10, 10]),), (None,)], "p binary")
    assert [r[0] for r in pixels.select(vectors.tissue_fraction(F.col("p"))).collect()] == [0.5, None]


def vector_rows(spark, n=120):
    rng = np.random.default_rng(5)
    y, s = rng.integers(0, 2, n), rng.integers(0, 2, n)
    x = rng.normal(0, 0.3, (n, 4))
    x[:, 0] += y * 2 - 1
    x[:, 1] += s * 2 - 1
    return spark.createDataFrame([(i, int(y[i]), i % 3, int(s[i]), x[i].tolist()) for i in range(n)], "patient_id long, y int, fold int, s int, x array<double>")


def test_probe_and_nested(spark):
    df = probe.features(vector_rows(spark), "x").persist()
    assert metrics.auc_by(probe.internal_cv(df, [0, 1, 2], [0.1, 1.0]), []).first()["auc"] > 0.95
    assert probe.leakage_auc(df, "s", [0, 1, 2]) > 0.95
    predictions, seen = probe.nested_cross_fit(df, [0, 1, 2], 1.0)
    assert predictions.count() == 3 * 120
    assert audit.nested_training(seen, [0, 1, 2]).count() == 0 and audit.nested_training(seen.where("outer_fold = 1"), [0, 1, 2]).count() == 6
    records = predictions.withColumn("tss", F.lit("AA"))
    assert audit.nested_records(records, 3).count() == 0
    one = probe.fit_predict(df.where("y = 1"), df, 1.0)
    assert one.where("score is null").count() == 120


SETTINGS = [debias.Settings({"s": 2}), debias.Settings({"s": 2, "r": 3}, conditions=2), debias.Settings({"s": 2, "r": 3}, "fino", conditions=2), debias.Settings({"r": 3}, "pcgrad", conditions=2), debias.Settings({"s": 2}, "contrastive", conditions=2), debias.Settings({"r": 3}, "contrastive")]


def head_rows(n=60):
    rng = np.random.default_rng(3)
    return rng.normal(size=(n, 4)), rng.integers(-1, 2, n), {"s": rng.integers(-1, 2, n), "r": rng.integers(-1, 3, n)}, rng.integers(-1, 2, n), rng.integers(0, 3, n)


def losses(head, x, y, s, c, block):
    got = debias.gradients(head, x, y, {a: s[a] for a in head.settings.groups}, c, block)
    return got["loss_task"][0], sum(got[f"loss:{a}"][0] for a in head.settings.groups), got


@pytest.mark.parametrize("settings", SETTINGS, ids=lambda s: f"{s.method}-{s.conditions}-{len(s.groups)}")
def test_gradients_of_the_head_are_those_of_its_losses(settings):
    x, y, s, c, block = head_rows()
    head = debias.Head.new(4, settings, 0)
    for v in head.arrays.values():  # no unit stands exactly at its kink
        v += np.random.default_rng(4).normal(0, 0.1, v.shape)
    for a in settings.groups:
        if settings.method == "fino":
            head.arrays[f"prototypes:{a}"] = np.random.default_rng(1).normal(size=head.arrays[f"prototypes:{a}"].shape)
    _, _, got = losses(head, x, y, s, c, block)
    whole = {"task": (0, got["task"]), "trunk": (0, got["trunk_task"])}
    checks = [(name, which, g) for name, (which, g) in whole.items()] + [("trunk", 1, sum(got[f"trunk:{a}"] for a in settings.groups))]
    checks += [(k, 1, got[k]) for k in head.arrays if k.startswith(("hidden:", "logits:"))]
    rng = np.random.default_rng(2)
    for name, which, gradient in checks:
        for _ in range(6):
            at = tuple(int(rng.integers(0, n)) for n in head.arrays[name].shape)
            values = []
            for step in (1e-5, -1e-5):
                moved = debias.Head(settings, {k: v.copy() for k, v in head.arrays.items()})
                moved.arrays[name][at] += step
                values.append(losses(moved, x, y, s, c, block)[which])
            assert abs((values[0] - values[1]) / 2e-5 - gradient.reshape(head.arrays[name].shape)[at]) < 1e-4, (name, which, at)


@pytest.mark.parametrize("settings", SETTINGS[1:5], ids=lambda s: s.method)
def test_sums_of_an_epoch_do_not_depend_on_partitions(spark, settings):
    x, y, s, c, _ = head_rows(200)
    data = [(i, v.tolist(), int(y[i]), *(int(s[a][i]) if s[a][i] >= 0 else None for a in ("s", "r")), int(c[i]) if c[i] >= 0 else None) for i, v in enumerate(x)]
    df = spark.createDataFrame(data, "id int, x array<double>, y int, s int, r int, condition int")
    head = debias.Head.new(4, settings, 0)
    one, many = (debias.epoch_sums(debias.prepared(d, None, settings, 1.0, "id"), head) for d in (df.coalesce(1), df.repartition(5)))
    assert one.keys() == many.keys() and all(np.allclose(one[k], many[k]) for k in one)
    if settings.method != "contrastive":
        alone = debias.gradients(head, x, y, {a: s[a] for a in settings.groups}, c, np.zeros(200))
        assert all(np.allclose(alone[k].ravel(), one[k]) for k in alone)


def test_debias_by_property(spark):
    df = vector_rows(spark)
    settings = debias.Settings({"s": 2})
    plain = debias.fit(df, None, 4, settings, 0.0, epochs=10)
    with_pool = debias.fit(df, df.select("x", "s"), 4, settings, 0.0, epochs=10)
    assert all(np.allclose(plain.arrays[k], with_pool.arrays[k]) for k in ("trunk", "task"))
    turned = debias.fit(df, df.select("x", "s"), 4, debias.Settings({"s": 2}, "pcgrad"), 1.0, epochs=10)
    assert len(turned.cosines) == 10 and all(abs(after) < 1e-9 for _, after in turned.cosines)
    assert metrics.auc_by(debias.predict(df, turned), []).first()["auc"] > 0.9
    moved = debias.moved(np.zeros((1, 2, 2)), np.array([[[3.0, 4.0, 1.0], [0.0, 0.0, 0.0]]]), 0.9)
    assert np.allclose(moved, [[[0.6, 0.8], [0, 0]]]) and np.allclose(debias.moved(moved, np.array([[[0.0, 2.0, 2.0], [1.0, 0.0, 1.0]]]), 0.9), [[[0.54, 0.82], [1, 0]]])
    for method in ("fino", "contrastive"):
        assert metrics.auc_by(debias.predict(df, debias.fit(df, df.select("x", "s"), 4, debias.Settings({"s": 2}, method), 0.1, epochs=10)), []).first()["auc"] > 0.8
    with pytest.raises(ValueError, match="unknown method"):
        debias.Settings({}, "none")


def test_comparison_of_heads(spark):
    tiles = vector_rows(spark).withColumn("patient_id", F.col("patient_id") % 60).drop("fold").withColumn("fold", (F.col("patient_id") % 2).cast("int"))
    tiles = tiles.withColumn("y", F.first("y").over(Window.partitionBy("patient_id"))).withColumn("s", F.first("s").over(Window.partitionBy("patient_id")))
    scored = debias.out_of_fold(tiles, None, 4, debias.Settings({"s": 2}), 0.0, [0, 1], ["s"], epochs=3)
    assert scored.count() == 60 and scored.agg(F.sum("n_tiles")).first()[0] == 120
    report = debias.comparison(tiles, None, 4, debias.Settings({"s": 2}), [0.0, 1.0], [0, 1], min_n=5, epochs=3).collect()
    assert [(r["lambda"], r["attribute"]) for r in report] == [(0.0, "s"), (1.0, "s")] and all(0 <= r["leakage_auc"] <= 1 for r in report)


def test_audits(spark):
    p = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.1), ("", 1, 0.1), ("b", 3, 0.1), ("c", 1, float("nan"))], "patient_id string, y_true int, y_score double")
    assert rows(audit.prediction_rows(p)) == [("", "no id"), ("a", "repeated"), ("b", "label or score"), ("c", "label or score")]
    arms = spark.createDataFrame([("control", 0, "a", 1), ("control", 0, "b", 0), ("posthoc", 0, "a", 0), ("posthoc", 0, "c", 0)], "arm string, run int, patient_id string, y int")
    assert rows(audit.arm_alignment(arms, ["y"], ("control", 0))) == [("posthoc", 0, "a", "y differs"), ("posthoc", 0, "b", "absent"), ("posthoc", 0, "c", "extra")]
    runs = [("control", 0, "v1", 1, "brca", 0.0, "c0", "x", 4), ("posthoc", 0, "v1", 1, "brca", 0.5, "c0", "y", 4), ("pretraining", 0, "v1", 1, "brca", 0.0, "c1", "z", 4)]
    runs = spark.createDataFrame(runs, "arm string, run int, schema string, seed int, task string, lambda_adv double, checkpoint string, sha256 string, n int")
    files = runs.select("arm", "run", "sha256", "n")
    assert audit.provenance(runs, files, 0.5).count() == 0
    swapped = files.withColumn("sha256", F.when(F.col("arm") == "posthoc", "z").otherwise(F.col("sha256")))
    assert {r["problem"] for r in audit.provenance(runs, swapped, 0.5).collect()} == {"digest", "file reused"}
    seeds = runs.withColumn("seed", F.when(F.col("arm") == "posthoc", 2).otherwise(F.col("seed")))
    assert {r["problem"] for r in audit.provenance(seeds, files, 0.5).collect()} == {"seed order"}
    contract = "study string, fold_seed int, head_architecture string, planned_head_seeds array<int>, primary_estimand string, utility_noninferiority_margin double, sensitive string, method string, temperature double, posthoc_lambda double"
    good = spark.createDataFrame([("s", 1, "h", [1, 2], "e", 0.02, "race", "m", 0.2, 1.0)], contract)
    assert audit.study_contract(good, 1).count() == 0 and rows(audit.study_contract(good, 7)) == [("seed declared",)]
    cov = spark.createDataFrame([("t", 3, 2, 1)], "task string, labelled long, with_tiles long, missing long")
    assert audit.coverage_agreement(cov, spark.createDataFrame([("t", "a"), ("t", "b")], "task string, patient_id string")).count() == 0


def test_crosswalk(spark):
    labels = spark.createDataFrame([("brca", "1"), ("brca", "2"), ("nsclc", "3")], "task string, p string")
    tiles = spark.createDataFrame([("1", "s1"), ("3", "s3"), ("1", "s1")], "p string, slide string")
    assert rows(cohort.coverage(labels, tiles, "p").select("task", "labelled", "with_tiles", "slides")) == [("brca", 2, 1, 1), ("nsclc", 1, 1, 1)]
    assert rows(cohort.missing_ids(labels, tiles, "p").select("task", "p")) == [("brca", "2")]
    with pytest.raises(ValueError):
        cohort.with_hospital_folds(labels, spark.createDataFrame([("9", 1)], "p string, f int"), "p")


def test_identities(spark):
    df = spark.createDataFrame([("TCGA-AB-1234-01Z/TCGA-AB-1234-DX.svs", "x"), ("odd", "y")], "path string, k string")
    assert [r[0] for r in df.select(identity.patient_of_path(F.col("path"))).collect()] == ["TCGA-AB-1234", "odd"]
    assert [r[0] for r in df.select(identity.strict_patient(F.col("path"))).collect()] == ["TCGA-AB-1234", None]
    with pytest.raises(Exception, match="no patient barcode"):
        df.select(identity.strict_patient(F.col("path"), fail=True)).collect()
    many = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    ids = many.select(identity.compact_id(F.col("k")).alias("i"), F.xxhash64("k").alias("h"))
    assert ids.where("i < 0").count() == 0 and ids.where("h < 0").count() > 0 and ids.select("i").distinct().count() == 2000
    digest = identity.bucketed_digest(df, F.col("path"), F.col("k"), F.hex(F.col("k"))).first()
    inner = [hashlib.sha256(p.encode()).hexdigest() for p in ("TCGA-AB-1234-01Z/TCGA-AB-1234-DX.svs", "odd")]
    assert digest["sha256"] == hashlib.sha256("\n".join(inner).encode()).hexdigest()
    assert digest["n"] == 2 and digest == identity.bucketed_digest(df.repartition(2), F.col("path"), F.col("k"), F.hex(F.col("k"))).first()


def test_run_log(spark):
    log = spark.createDataFrame([(1, 1, 0.0, 0.0, False), (1, 2, 2.0, 10.0, False), (1, 3, 9.0, 10.0, True), (1, 4, 10.0, 15.0, False)], "run int, step int, s double, n double, v boolean")
    assert [r["n_per_s"] for r in runlog.rates(log, "run", "step", "s", ["n"], "v").orderBy("step").collect()] == [None, 5.0, None, 5.0]
    seen = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b")], "run int, step int, k string")
    assert rows(runlog.cumulative_uniques(seen, "run", "step", "k")) == [(1, 1, 1), (1, 2, 1), (1, 3, 2)]


def test_embedding_store(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def model(payloads):
        with open(calls, "a") as f:
            f.write("x" * len(payloads))
        return [None if p == b"bad" else [float(len(p)), 1.0] for p in payloads]

    df = spark.createDataFrame([("a", bytearray(b"one")), ("b", bytearray(b"one")), ("c", bytearray(b"bad")), ("d", None)], "patient_id string, payload binary").coalesce(1)
    path = str(tmp_path / "store")
    assert rows(embed.embed_new(df, path, "m1", "cfg", "payload", model).select("patient_id", "vector")) == [("a", [3.0, 1.0]), ("b", [3.0, 1.0]), ("c", None)]
    changed = df.withColumn("payload", F.when(F.col("patient_id") == "a", F.lit(b"three")).otherwise(F.col("payload")))
    embed.embed_new(changed, path, "m1", "cfg", "payload", model).collect()
    stored = embed.store(spark, path)
    assert stored.count() == 2 and embed.store_violations(stored, 2).count() == 0 and embed.store_violations(stored, 3).count() == 2
    assert len(open(calls).read()) == 4


def test_sources(spark, tmp_path):
    (tmp_path / "d.csv").write_text("id,race\nA,White\nB,\nA,Asian\n,Black\n")
    assert rows(tables.keyed_csv(spark, str(tmp_path / "d.csv"), "id")) == [("A", "Asian"), ("B", None)]
    (tmp_path / "l.tsv").write_text("case_id\tsubtype\nC1\t1.0\nC2\tx\n")
    assert rows(tables.subtype_labels(spark, str(tmp_path / "l.tsv"))) == [("C1", 1)]
    (tmp_path / "h.txt").write_text(" A \n\nB\n")
    assert rows(tables.id_list(spark, str(tmp_path / "h.txt"))) == [("A",), ("B",)]
    case = {"submitter_id": "TCGA-AA-0001", "project": {"project_id": "TCGA-LUAD"}, "demographic": None, "diagnoses": []}
    (tmp_path / "c.json").write_text(json.dumps({"data": {"hits": [case], "pagination": {"total": 1}}}))
    assert tables.cases(spark, str(tmp_path / "c.json")).count() == 1
    (tmp_path / "c2.json").write_text(json.dumps({"data": {"hits": [case], "pagination": {"total": 2}}}))
    with pytest.raises(Exception, match="incomplete"):
        tables.cases(spark, str(tmp_path / "c2.json")).collect()
    (tmp_path / "m.json").write_text(json.dumps({"discrete": {"f": {"A": 1}}}))
    assert rows(tables.factor_maps(spark, str(tmp_path / "m.json"))) == [("f", "A", 1)]
    ids = spark.createDataFrame([("b",), ("a",)], "p string")
    tables.write_ids(ids, "p", str(tmp_path / "ids"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "ids")).collect()] == ["a", "b"]
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        tables.write_ids(ids, "p", str(tmp_path / "ids"))


def test_contracts(spark, tmp_path):
    for i in range(3):
        folder = tmp_path / "t" / f"part{i}"
        spark.createDataFrame([(f"TCGA-AA-000{i}/t.jpg", bytearray(b"x" * i))], "path string, jpeg binary").coalesce(1).write.parquet(str(folder))
        [f] = folder.glob("part-*.parquet")
        f.rename(tmp_path / "t" / f"shard-{i:05d}.parquet")
    root = str(tmp_path / "t")
    listed = contracts.files(spark, root, "shard-*.parquet").persist()
    assert listed.count() == 3
    receipt = contracts.inventory(listed).persist()
    assert receipt.first()["file_count"] == 3 and contracts.receipt_mismatches(receipt, contracts.inventory(listed)).count() == 0
    assert rows(contracts.shard_completeness(listed, 4)) == [("shard-00003.parquet", "missing")]
    digests = contracts.content_digests(listed)
    assert contracts.manifest(digests).first()["file_count"] == 3
    for r in digests.collect():
        assert r["sha256"] == hashlib.sha256((tmp_path / "t" / r["name"]).read_bytes()).hexdigest()
    assert contracts.schema_violations(listed, "path string, jpeg binary").count() == 0
    assert contracts.schema_violations(listed, "path string, jpeg string").count() == 3
    made = contracts.receipt(contracts.inventory(listed), contracts.manifest(digests), "pretraining", "r1", 3)
    assert contracts.contract_mismatches(made, {"dataset": "pretraining", "revision": "r1", "file_count": 3, "total_rows": 3}).count() == 0
    assert rows(contracts.contract_mismatches(made, {"revision": "r2", "file_count": 3})) == [("revision", "r2", "r1")]
    # An edit that keeps the size shows in the contents alone.
    first = tmp_path / "t" / "shard-00000.parquet"
    edited = bytearray(first.read_bytes())
    edited[len(edited) // 2] ^= 1
    before = rows(digests.select("name", "sha256"))
    first.write_bytes(bytes(edited))
    changed = rows(contracts.artifact_mismatches(spark.createDataFrame(before, "name string, sha256 string"), contracts.content_digests(contracts.files(spark, root, "shard-*.parquet"))).select("name"))
    assert changed == [("shard-00000.parquet",)]
    edited[len(edited) // 2] ^= 1
    first.write_bytes(bytes(edited))
    index = tables.tile_index(spark, root)
    assert rows(index.select("patient_id", "row_index"))[0] == ("TCGA-AA-0000", 0)
    tiles = tables.slide_tiles(spark, root)
    assert tables.image_column(tiles) == "jpeg" and contracts.empty_first_rows(tiles, "jpeg").count() == 1
    counts = listed.select("name", F.lit(1).alias("rows"))
    total = receipt.first()["total_bytes"]
    assert contracts.counts_violations(listed, counts, 3, total, 3).count() == 0
    assert rows(contracts.counts_violations(listed, counts, 2, total, 3)) == [("file count", 2, 3)]
    (tmp_path / "t" / "other.parquet").write_bytes(b"x")
    assert rows(contracts.stray_files(contracts.files(spark, root, "*.parquet"), listed).select(F.substring_index("path", "/", -1))) == [("other.parquet",)]


def test_readers_and_writers_of_files(spark, tmp_path):
    """Every format that is read or written by name."""
    (tmp_path / "h.csv").write_text("patient_barcode,fold\nA,1\n ,2\nB,\nC,2.0\n")
    assert rows(tables.hospital_folds(spark, str(tmp_path / "h.csv"))) == [("A", 1), ("C", 2)]
    line = {"patient_id": "p", "y_true": 1, "y_score": 0.5, "race": None, "outer_fold": 2}
    (tmp_path / "p.jsonl").write_text(json.dumps(line) + "\n")
    got = tables.predictions(spark, str(tmp_path / "p.jsonl")).first()
    assert (got["patient_id"], got["y_score"], got["outer_fold"], got["inner_fold"], got["file"]) == ("p", 0.5, 2, None, "p.jsonl")
    result = {"lambda_adv": 0.5, "reliable_fairness": {"schema": "v2", "core_task": "brca", "split_seed": 42, "head_seed": 1, "prediction_artifact": {"sha256": "d", "record_count": 7}, "checkpoint_identity": {"sha256": "c"}}}
    (tmp_path / "r.json").write_text(json.dumps(result))
    got = tables.run_results(spark, str(tmp_path / "r.json")).first()
    assert (got["lambda_adv"], got["schema"], got["task"], got["n"], got["checkpoint"]) == (0.5, "v2", "brca", 7, "c")
    (tmp_path / "s.json").write_text(json.dumps({"study": "a", "fold_seed": 42, "planned_head_seeds": [1, 2], "posthoc_lambda": 1.0}))
    contract = tables.study_contract(spark, str(tmp_path / "s.json"))
    assert contract.first()["planned_head_seeds"] == [1, 2] and contract.first()["method"] is None
    failed = {r["check"] for r in audit.study_contract(contract, 1, 1.0).collect()}
    assert "method present" in failed and "seed declared" not in failed and "lambda of the run" not in failed
    (tmp_path / "m.jsonl").write_text('{"step": 1, "examples": 10.0}\n{"step": 2, "examples": 20.0}\n')
    log = tables.training_log(spark, str(tmp_path / "m.jsonl"))
    assert rows(runlog.stop_report(log, "file", "step", {"examples": 15.0}).select("last_step", "stopped_by")) == [(2, "examples")]
    (tmp_path / "f.json").write_text(json.dumps({"discrete": {"race": {"A": 1}}, "continuous": {"age": {"A": -0.5, "B": 1}, "axis": {"A": [1.0, 2.5]}}}))
    assert rows(tables.factor_values(spark, str(tmp_path / "f.json"))) == [("age", "A", [-0.5], 1), ("age", "B", [1.0], 1), ("axis", "A", [1.0, 2.5], 2)]
    df = spark.createDataFrame([("a", 1), ("b", None)], "id string, n int")
    tables.write_csv(df, str(tmp_path / "out.csv"))
    tables.write_jsonl(df, str(tmp_path / "out.jsonl"))
    assert rows(spark.read.option("header", True).schema("id string, n int").csv(str(tmp_path / "out.csv"))) == rows(spark.read.schema("id string, n int").json(str(tmp_path / "out.jsonl"))) == [("a", 1), ("b", None)]
    for write in (tables.write_csv, tables.write_jsonl):
        with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
            write(df, str(tmp_path / "out.csv"))


def test_tiles_of_allowed_patients_and_of_files(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for k in range(3):
        t = pa.table({"slide_path": [f"x/TCGA-AA-000{k}-01.svs"] * 3, "image_bytes": [b"one", b"two", b"three"]})
        pq.write_table(t, tmp_path / f"TCGA-AA-000{k}-01.parquet", row_group_size=1)
    root = str(tmp_path)
    assert tables.slide_tiles(spark, root).count() == 9
    allowed = spark.createDataFrame([("TCGA-AA-0001",), ("TCGA-AA-0009",)], "patient_id string")
    mine = tables.slide_tiles(spark, root, allowed)
    assert {r["patient_id"] for r in mine.collect()} == {"TCGA-AA-0001"} and mine.count() == 3
    files = [r["file"] for r in mine.select("file").distinct().collect()]
    payload = tables.payload_of_files(spark, files, ["image_bytes"])
    assert sorted(bytes(r["image_bytes"]) for r in payload.collect()) == [b"one", b"three", b"two"]
    assert rows(tables.first_row_ids(mine, "slide_path").select("slide_path")) == [("x/TCGA-AA-0001-01.svs",)]
    assert [r["slides"] for r in tables.slide_per_file(mine).collect()] == [1]


def test_what_fails_closed(spark):
    one = spark.createDataFrame([("a", "1"), ("b", "1")], "id string, x string")
    with pytest.raises(Exception, match="fewer than two values"):
        factors.z_scores(one, "id", "x").collect()
    _, rate = cohort.join_demographics(one.select("id"), one.select(F.concat("id", F.lit("?")).alias("id")), "id")
    with pytest.raises(Exception, match="no patient has demographics"):
        rate.collect()
    empty = spark.createDataFrame([], "patient_id string, y_true int, y_score double")
    assert rows(audit.prediction_rows(empty)) == [(None, "no rows")]
    folds_of = spark.createDataFrame([("a", 1)], "id string, outer_fold int")
    sites = spark.createDataFrame([("a", "AA")], "id string, tss string")
    assert rows(cohort.annotated(one.where("id = 'a'"), folds_of, sites, "id")) == [("a", "1", 1, "AA")]
    with pytest.raises(ValueError, match="without a fold: b"):
        cohort.annotated(one, folds_of, sites, "id")
    with pytest.raises(ValueError, match="none of"):
        cohort.first_named(one, ["sex"])
    with pytest.raises(ValueError, match="unknown task"):
        cohort.task_cohort("other", one, one, "id")
    external = cohort.task_cohort("duke", one, one, "id", label="x", k=2)
    assert {r["label"] for r in external.collect()} == {1} and {r["fold"] for r in external.collect()} == {0, 1}
    flat = metrics.arm_metrics(spark.createDataFrame([("control", 0, 1, 0.5, "g")], "arm string, run int, y int, score double, lang string"), ["arm", "run"], "lang", spark.createDataFrame([("g",)], "lang string"))
    assert rows(metrics.undefined(flat, ["arm", "run"])) == [("control", 0)]


def test_ranks_of_any_range(spark):
    values = [-1e9, -3.5, -1e-12, 0.0, 1e-300, 0.25, 0.5, 0.5, 1.0, 7.0, 1e300]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r["v"]: r["rank"] for r in metrics.average_rank(df, "v").collect()}
    assert got == {v: (values.index(v) + 1 + len(values) - values[::-1].index(v)) / 2 for v in values}
    logits = spark.createDataFrame([(y, s) for y, s in zip([0, 1, 0, 1, 1], [-40.0, -2.0, 3.0, 9.0, 250.0])], "y int, score double")
    assert abs(metrics.auc_by(logits, []).first()["auc"] - 5 / 6) < 1e-12


def test_store_without_vectors_and_reuse(spark, tmp_path):
    df = spark.createDataFrame([("a", bytearray(b"bad")), ("b", None)], "patient_id string, payload binary")
    path = str(tmp_path / "store")
    assert rows(embed.embed_new(df, path, "m", "cfg", "payload", lambda ps: [None] * len(ps)).select("patient_id", "vector")) == [("a", None)]
    ok = spark.createDataFrame([("a", bytearray(b"one")), ("c", bytearray(b"four"))], "patient_id string, payload binary")
    embed.embed_new(ok, path, "m", "cfg", "payload", lambda ps: [[float(len(p))] for p in ps]).collect()
    stored = embed.store(spark, path)
    assert embed.reuse_violations(ok, stored, "m", "cfg", "payload", "patient_id").count() == 0
    edited = ok.withColumn("payload", F.when(F.col("patient_id") == "a", F.lit(b"two")).otherwise(F.col("payload")))
    assert rows(embed.reuse_violations(edited, stored, "m", "cfg", "payload", "patient_id")) == [("a", "absent")]
    assert embed.entry_digest(stored, "m").first() == embed.entry_digest(stored.repartition(3), "m").first() and embed.entry_digest(stored, "m").first()["n"] == 2


def test_bootstrap_blocks_change_nothing(spark):
    scores = spark.createDataFrame([(a, r, f"p{i}", i % 2, (i * 7 + r + len(a)) % 10 / 10, "AB"[i // 2 % 2]) for a in bootstrap.ARMS for r in range(2) for i in range(24)], "arm string, run int, patient_id string, y int, score double, race string")
    groups = spark.createDataFrame([("A",), ("B",)], "race string")
    whole, cut = (rows(bootstrap.paired_bootstrap(scores, "race", groups, 7, 5, block=n)) for n in (128, 3))
    assert len(whole) == 7 and np.allclose(np.array(whole, float), np.array(cut, float))


def test_bootstrap_against_repeated_rows(spark, monkeypatch):
    """Every iteration equals AUROCs of rows that are really repeated; ties, batches that cut a score, and several ranges of patients."""
    monkeypatch.setattr(bootstrap, "RANGE", 7)
    monkeypatch.setattr(bootstrap, "BUCKET_ROWS", 60)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        data = [(a, r, f"p{i}", i % 2, (i * 7 + r + len(a)) % 6 / 10 - 0.2, [None, "A", "B"][i // 2 % 3]) for a in bootstrap.ARMS for r in range(2) for i in range(37)]
        scores, groups = spark.createDataFrame(data, "arm string, run int, patient_id string, y int, score double, race string"), spark.createDataFrame([("A",), ("B",)], "race string")
        times = {(r["it"], r["patient_id"]): r["times"] for r in bootstrap.multiplicities(scores.select("patient_id", "y").distinct(), 6, 3).collect()}
        got = {(r["it"], r["arm"], r["run"]): (r["overall_auc"], r["auc_gap"]) for r in bootstrap.resampled_metrics(scores, "race", groups, 6, 3, 4).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 6 * 3 * 2 and {sum(n for (it, _), n in times.items() if it == i) for i in range(6)} == {37}
    for (it, arm, run), (overall, gap) in got.items():
        drawn = [(y, s, g) for a, r, p, y, s, g in data if (a, str(r)) == (arm, run) for _ in range(times.get((it, p), 0))]
        auc = {k: brute_auc([y for y, _, g in drawn if k in ("all", g)], [s for _, s, g in drawn if k in ("all", g)]) for k in ("all", "A", "B")}
        assert overall == pytest.approx(auc["all"])
        assert gap is None if None in (auc["A"], auc["B"]) else gap == pytest.approx(abs(auc["A"] - auc["B"]))


def test_bootstrap_draws_are_made_once_and_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "RANGE", 7)
    monkeypatch.setattr(bootstrap, "SLOTS", 10)
    scores = spark.createDataFrame([(a, r, f"p{i}", i % 2, i % 5 / 10, "AB"[i // 2 % 2]) for a in bootstrap.ARMS for r in range(2) for i in range(61)], "arm string, run int, patient_id string, y int, score double, race string")
    patients = scores.select("patient_id", "y").distinct()
    drawn = bootstrap.drawn_places(patients, 5, 3, 2).collect()
    assert sum(len(r["drawn"]) - 4 * (1 if r["block"] == 2 else 2) for r in drawn) == 2 * 5 * 61
    got = collections.Counter({(r["it"], r["label"], r["k"]): r["times"] for r in bootstrap.multiplicities(patients, 5, 3).join(bootstrap.numbered_patients(patients), "patient_id").collect()})
    want = collections.Counter((it, str(y), int(hashlib.sha256(f"3:{it}:{y}:{slot}".encode()).hexdigest()[:13], 16) % n) for it in range(5) for y, n in ((0, 31), (1, 30)) for slot in range(n))
    assert got == want
    found = bootstrap.resampled_metrics(scores, "race", spark.createDataFrame([("A",), ("B",)], "race string"), 5, 3)
    found.collect()
    within = None  # the depth of the broadcast that a line of the final plan stands below
    for line in found._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0].splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        within = within if within is not None and depth > within else None
        assert within is None or "Pandas" not in line
        within = depth if within is None and "BroadcastExchange" in line else within


def test_bootstrap_plan_does_not_grow(spark):
    scores, groups = three_arms(spark), spark.createDataFrame([("A",), ("B",)], "race string")
    plans = [bootstrap.paired_bootstrap(scores, "race", groups, n, 3)._jdf.queryExecution().optimizedPlan().toString() for n in (10, 100_000)]
    assert plans[0].count("\n") == plans[1].count("\n")


def test_probe_folds_and_held_out(spark):
    df = probe.features(vector_rows(spark), "x").persist()
    few = df.where("y = 1").unionByName(df.where("y = 0").limit(3))
    assert probe.fitting_folds(few) == 3 and probe.external_folds(few).select("fold").distinct().count() == 3
    held = probe.held_out_fold(df, 1, 1.0)
    assert held.select("fold").distinct().collect()[0][0] == 1 and held.where("score is null").count() == 0


def test_duplicates_and_runs(spark):
    assert rows(contracts.duplicates(spark.createDataFrame([("a",), ("a",), ("b",)], "name string"))) == [("a",)]
    runs = spark.createDataFrame([("control", 0), ("control", 1), ("posthoc", 0)], "arm string, run int")
    assert rows(audit.run_counts(runs)) == [("posthoc", 1)]
    assert rows(pairwise.mean_scores(spark.createDataFrame([("p", 0.25), ("p", 0.75), ("p", None)], "k string, v double"), "k", "v")) == [("p", 0.5, 2)]
    filled = spark.createDataFrame([(None,), (float("nan"),), (0.25,)], "v double").select(vectors.filled_score(F.col("v")))
    assert [r[0] for r in filled.collect()] == [0.5, 0.5, 0.25]


def write_slides(folder, files):
    """files: name -> (rows of columns)."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    for name, columns in files.items():
        pq.write_table(pa.table(columns), folder / name, row_group_size=2)


def spoil_pages(path):
    """Overwrite all that is not magic number or footer."""
    data = bytearray(path.read_bytes())
    footer = int.from_bytes(data[-8:-4], "little")
    data[4 : len(data) - 8 - footer] = b"\xff" * (len(data) - 12 - footer)
    path.write_bytes(bytes(data))


def test_planned_scan_opens_only_chosen_files(spark, tmp_path):
    """A foreign patient's file may be corrupted; names, else first rows, decide whose a file is."""
    write_slides(tmp_path, {
        "TCGA-AA-0001-01.parquet": {"slide_path": ["x/TCGA-AA-0001-01.svs"] * 3, "image_bytes": [b"a", b"b", b"c"]},
        "TCGA-AA-0002-01.parquet": {"slide_path": ["x/TCGA-AA-0002-01.svs"] * 3, "image_bytes": [b"d", b"e", b"f"]},
        "slide 17.parquet": {"case_id": ["TCGA-AA-0001"], "slide_path": ["x/other.svs"], "image_bytes": [b"g"]},
        "s18.parquet": {"case_id": [None], "slide_path": ["x/TCGA-AA-0003-01.svs"], "image_bytes": [b"h"]},
        "s19.parquet": {"slide_path": ["plain"], "image_bytes": [b"i"]},
    })
    (tmp_path / "TCGA-AA-0002-01.parquet").write_bytes(b"no parquet at all")
    (tmp_path / "broken.parquet").write_bytes(b"neither")
    allow = lambda *ids: spark.createDataFrame([(i,) for i in ids], "patient_id string")
    scan = lambda *ids: sorted((r["patient_id"], bytes(r["image_bytes"]), r["row_index"]) for r in tables.slide_tiles(spark, str(tmp_path), allow(*ids)).collect())
    assert scan("TCGA-AA-0001") == [("TCGA-AA-0001", b"a", 0), ("TCGA-AA-0001", b"b", 1), ("TCGA-AA-0001", b"c", 2), ("TCGA-AA-0001", b"g", 0)]
    assert scan("TCGA-AA-0003", "s19") == [("TCGA-AA-0003", b"h", 0), ("s19", b"i", 0)]
    assert scan("TCGA-AA-0009") == []
    with pytest.raises(Exception, match="0002"):
        scan("TCGA-AA-0002")
    index = file_index.file_index(file_index.listing(spark, str(tmp_path)), allow("TCGA-AA-0001", "TCGA-AA-0002", "broken"))
    got = {r["name"]: (r["patient_id"], r["rows"], r["row_groups"], r["problem"] is None) for r in index.collect()}
    assert got == {"TCGA-AA-0001-01.parquet": ("TCGA-AA-0001", 3, 2, True), "slide 17.parquet": ("TCGA-AA-0001", 1, 1, True), "TCGA-AA-0002-01.parquet": ("TCGA-AA-0002", None, None, False), "broken.parquet": ("broken", None, None, False)}


def test_footers_answer_without_data_pages(spark, tmp_path):
    """Counts and single slides of files whose pages are spoiled; only files with several slides are read."""
    long = "y" * 80
    write_slides(tmp_path, {"a.parquet": {"slide_path": ["s1"] * 5}, "b.parquet": {"slide_path": [None, "s2"]}, "c.parquet": {"slide_path": ["s3", "s4", "s3"]}, "d.parquet": {"slide_path": [long] * 2}, "e.parquet": {"slide_path": pa_strings([])}})
    spoil_pages(tmp_path / "a.parquet")
    listed = file_index.listing(spark, str(tmp_path))
    assert rows(file_index.row_counts(listed)) == [("a.parquet", 5), ("b.parquet", 2), ("c.parquet", 3), ("d.parquet", 2), ("e.parquet", 0)]
    found = {r["path"].rsplit("/", 1)[1]: (r["slide"], r["slides"]) for r in file_index.slides_of_files(spark, listed).collect()}
    assert found == {"a.parquet": ("s1", 1), "b.parquet": ("s2", 1), "c.parquet": ("s3", 2), "d.parquet": (long, 1), "e.parquet": (None, 0)}
    with pytest.raises(Exception):  # noqa: B017  the page is really spoiled
        spark.read.parquet(str(tmp_path / "a.parquet")).collect()
    checks = contracts.counts_violations(listed, file_index.row_counts(listed), 5, 0, 12).where("check != 'bytes'")
    assert rows(checks) == [("empty files", 0, 1)]


def pa_strings(values):
    import pyarrow as pa

    return pa.array(values, pa.string())


def test_last_row_across_files_of_any_size(spark, tmp_path):
    """The later file by name wins, whichever is larger, and the later block of a file that is cut into several."""
    small, large = "k,v\nx,small\n", "k,v\n" + "".join(f"p{i},{i}\n" for i in range(3000)) + "x,large\n"
    for first, second, want in ((large, small, "small"), (small, large, "large")):
        folder = tmp_path / want
        folder.mkdir()
        (folder / "a.csv").write_text(first)
        (folder / "b.csv").write_text(second)
        assert [r["v"] for r in tables.keyed_csv(spark, str(folder), "k").where("k = 'x'").collect()] == [want]
    (tmp_path / "one.csv").write_text("k,v\n" + "".join(f"x,{i}\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = tables.keyed_csv(spark, str(tmp_path / "one.csv"), "k")
        assert spark.read.csv(str(tmp_path / "one.csv")).rdd.getNumPartitions() > 4 and df.first()["v"] == "19999"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def spark_logistic(train, reg, weight=None):
    from pyspark.ml.classification import LogisticRegression

    options = {"weightCol": weight} if weight else {}
    return LogisticRegression(labelCol="y", regParam=reg, standardization=False, maxIter=500, tol=1e-14, **options).fit(train)


def many_rows(spark, classes=2):
    rng = np.random.default_rng(5)
    data = []
    for i in range(400):
        y = int(rng.integers(0, classes)) if rng.random() < 0.8 else 0
        data.append((f"p{i}", y, i % 3, [float(v) for v in rng.normal(size=5) * [1, 2, 0.5, 1, 1] + np.eye(5)[y] + 3]))
    return probe.features(spark.createDataFrame(data, "patient_id string, y int, fold int, x array<double>"), "x").persist()


def test_many_models_equal_one_at_a_time(spark):
    """Coefficients of every strength and fold are Spark's, and more models do not take more passes."""
    df = many_rows(spark)
    models = probe.grid_models(probe.fold_counts(df), [(0,), (1,), (2,), (0, 1)], probe.C_GRID)
    fitted = linear.fit_many(df, models)
    assert fitted.passes <= 15 and linear.fit_many(df, models[:1]).passes <= 15
    for i in (0, 4, 6, 9, 20, 27):
        train = df.where(~F.col("fold").isin(*models[i].out))
        n, pos = train.count(), train.where("y = 1").count()
        one = spark_logistic(train.withColumn("w", F.when(F.col("y") == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos)))), models[i].reg, "w")
        assert np.allclose(fitted.coefficients[i][:, 0], [*one.coefficients, one.intercept], atol=1e-6)


def test_many_models_of_several_classes_and_by_gradients_alone(spark, monkeypatch):
    df, models = many_rows(spark, 3), [linear.Model((f,), 0.01) for f in range(3)]
    fitted = linear.fit_many(df, models, classes=3, balanced=False)
    train = df.where("fold != 1")
    one = spark_logistic(train, 0.01).transform(train).select("x", "probability").collect()
    assert np.allclose(fitted.probabilities(np.array([r["x"] for r in one]), 1), [r["probability"].toArray() for r in one], atol=1e-5)
    newton = linear.fit_many(many_rows(spark), models)
    monkeypatch.setattr(linear, "MOST_CELLS", 0)
    assert np.allclose(linear.fit_many(many_rows(spark), models).coefficients, newton.coefficients, atol=1e-5)


def test_scaled_models_are_those_of_scaled_rows(spark):
    from pyspark.ml.feature import StandardScaler

    df, models = many_rows(spark), [linear.Model((2,), 0.05)]
    fitted = linear.fit_many(df, models, balanced=False, scaled=True)
    train = df.where("fold != 2")
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(train)
    one = spark_logistic(scaler.transform(train).drop("features").withColumnRenamed("scaled", "features"), 0.05)
    by_spark = [r["probability"][1] for r in one.transform(scaler.transform(df).drop("features").withColumnRenamed("scaled", "features")).orderBy("patient_id").collect()]
    mine = [r["p"][0][0] for r in linear.scored(df, fitted, {f: [0] for f in range(3)}).orderBy("patient_id").collect()]
    assert np.allclose(mine, by_spark, atol=1e-6)


def test_nested_audit_in_one_pass(spark):
    df = many_rows(spark)
    predictions, seen = probe.nested_cross_fit(df, [0, 1, 2], 1.0)
    ids = collections.defaultdict(set)
    for r in df.select("patient_id", "fold").collect():
        ids[r["fold"]].add(r["patient_id"])
    got = {(r["outer_fold"], r["inner_fold"]): r for r in seen.collect()}
    assert set(got) == {(k, j) for k in range(3) for j in (None, *[f for f in range(3) if f != k])}
    for (k, j), r in got.items():
        left = [f for f in range(3) if f not in (k, j)]
        assert r["folds"] == left and r["n"] == sum(len(ids[f]) for f in left)
        alone = identity.id_set_digest(df.where(F.col("fold").isin(left)), "patient_id").first()["sha256"]
        assert r["patients_sha256"] == alone
    rows_ = predictions.collect()
    assert len(rows_) == 3 * 400 and sum(r["prediction_role"] == "outer" for r in rows_) == 400
    assert all((r["calibration_outer_fold"] == r["original_fold"]) == (r["prediction_role"] == "outer") for r in rows_)


def confounded(spark, n=1500):
    """Labels and an attribute along two axes that lean on each other; in three folds."""
    rng = np.random.default_rng(9)
    y, s_ = rng.integers(0, 2, n), rng.integers(0, 2, n)
    x = rng.normal(size=(n, 6)) * 0.6
    x[:, 0] += 1.2 * y + 0.2 * s_
    x[:, 1] += 1.5 * s_
    data = [(i, i % 3, x[i].tolist(), int(y[i]), int(s_[i])) for i in range(n)]
    return spark.createDataFrame(data, "patient_id int, fold int, x array<double>, y int, s int").persist()


def test_plain_head_reaches_the_probe_and_leakage_falls(spark):
    df = confounded(spark)
    by_probe = metrics.auc_by(probe.out_of_fold(probe.features(df, "x"), 1.0, [0, 1, 2]), []).first()["auc"]
    report = debias.comparison(df, None, 6, debias.Settings({"s": 2}), [0.0, 0.5, 2.0], [0, 1, 2], epochs=30)
    got = {r["lambda"]: (r["overall_auc"], r["leakage_auc"]) for r in report.collect()}
    assert abs(got[0.0][0] - by_probe) < 0.01
    assert got[0.0][1] > got[2.0][1] + 0.02 and got[2.0][0] > by_probe - 0.05


def test_fit_does_not_depend_on_partitions_or_company(spark):
    """A head is the same however its table is cut, and whatever other heads are fitted beside it."""
    df = confounded(spark, 700)
    settings = debias.Settings({"s": 2}, "contrastive")
    jobs = [debias.Job(0.3, 1), debias.Job(0.0, None)]
    both = debias.fit_all(df.repartition(7), None, 6, settings, jobs, epochs=2, key="patient_id")
    for job, head in zip(jobs, both):
        alone = debias.fit_all(df.coalesce(1), None, 6, settings, [job], epochs=2, key="patient_id")[0]
        assert all(np.allclose(alone.arrays[k], head.arrays[k]) for k in alone.arrays)


def test_exact_draws_equal_points_on_a_line(spark, monkeypatch):
    """As many rows as are asked for, each point on the row that a plain walk over the line finds; many buckets and a heavy row."""
    monkeypatch.setattr(sampling, "BUCKET_ROWS", 4)
    rng = np.random.default_rng(2)
    data = [(f"k{i}", float(w)) for i, w in enumerate(rng.integers(1, 2000, 300) / 16)] + [("heavy", 9000.0), ("none", 0.0), ("null", None), ("less", -1.0), (None, 3.0)]
    df = spark.createDataFrame(data, "id string, w double").withColumn("_w", F.lit("clash"))
    got = collections.Counter(r["id"] for r in sampling.resampled(df.drop("_w"), "id", "w", 5000).collect())
    number = lambda text: int(hashlib.sha256(text.encode()).hexdigest()[:13], 16)
    known = [(k, w) for k, w in data if k and w and w > 0]
    scale = 2.0 ** (50 - int(np.ceil(np.log2(sum(w for _, w in known)))))
    line = sorted(known, key=lambda r: (hashlib.sha256(f"42:draw:{r[0]}".encode()).hexdigest(), r[0]))
    ends = np.cumsum([round(w * scale) for _, w in line])
    want = collections.Counter(line[int(np.searchsorted(ends, number(f"42:point:{i}") % int(ends[-1]), side="right"))][0] for i in range(5000))
    assert sum(got.values()) == 5000 and got == want and got["heavy"] > 500
    assert sampling.resampled(df.where("w < 0").drop("_w"), "id", "w", 10).count() == 0 and sampling.resampled(df.limit(0).drop("_w"), "id", "w", 10).count() == 0


def test_moving_prototypes_equal_a_plain_loop(spark):
    """Ten thousand batches with gaps, of two classes; nothing gathers the batches of a class."""
    rng = np.random.default_rng(3)
    data = [(int(k), int(b) * 3, rng.normal(size=3).tolist()) for k in range(2) for b in rng.permutation(10_000)]
    df = spark.createDataFrame(data, "c int, b int, v array<double>")
    for again in (False, True):
        made = pairwise.moving_prototypes(df, "c", "b", "v", 0.99, again)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan
        got = {r["c"]: r["prototype"] for r in made.collect()}
        unit = lambda v: v / np.linalg.norm(v) if again else v
        for k in range(2):
            p = None
            for _, _, v in sorted(r for r in data if r[0] == k):
                p = unit(np.array(v)) if p is None else unit(0.99 * p + 0.01 * unit(np.array(v)))
            assert np.allclose(got[k], p, atol=1e-9)


def test_white_space_of_every_kind(spark):
    white = "\t\n\x0b\x0c\r\x1c\x1f \x85\u00a0\u2003\u3000"
    assert clinical.WHITE == "".join(c for c in map(chr, range(0x10000)) if c.isspace())
    df = spark.createDataFrame([(white + "White" + white, white, f"{white}1.5{white}", f"{white}None\n")], "a string, b string, c string, d string")
    got = df.select(clinical.lookup(F.col("a"), clinical.RACES), clinical.race_status(F.col("a")), clinical.race_status(F.col("b")), clinical.clean(F.col("b")), clinical.number(F.col("c")), clinical.factor_value(F.col("d"))).first()
    assert tuple(got) == ("White", "mapped", "missing", None, 1.5, None)


def test_digests_of_listings(spark):
    """By buckets of names, whatever the order; and the flat one that a single reader computes."""
    data = [(f"s{i}.parquet", i, "2020-01-01") for i in range(500)]
    df = spark.createDataFrame(data, "name string, size long, day string").withColumn("modified", F.col("day").cast("timestamp"))
    one, two = contracts.inventory(df).first(), contracts.inventory(df.orderBy(F.desc("size")).repartition(5)).first()
    assert one == two and one["file_count"] == 500 and one["names_sha256"] != one["sizes_sha256"]
    buckets = collections.defaultdict(list)
    for name, size, _ in sorted(data):
        buckets[hashlib.sha256(name.encode()).hexdigest()[:3]].append(f"{name}\t{size}")
    of = lambda lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert one["sizes_sha256"] == of(of(v) for _, v in sorted(buckets.items()))
    flat = contracts.flat_digest(df, F.concat("name", F.lit("\t"), F.col("size").cast("string"))).first()
    assert flat["n"] == 500 and flat["sha256"] == hashlib.sha256("".join(f"{n}\t{s}\n" for n, s, _ in sorted(data)).encode()).hexdigest()
    assert contracts.flat_digest(df.limit(0), F.col("name")).first()["sha256"] == hashlib.sha256(b"").hexdigest()


def test_overlapping_runs_leave_one_entry(spark, tmp_path):
    """Two runs that saw the same store, a repeated batch, and one that broke off before it was committed."""
    path = str(tmp_path / "store")
    entry = lambda key, value: spark.createDataFrame([(key, [value], 3, "m")], embed.STORED.replace(" batch string,", ""))
    assert embed.store(spark, path) is None
    embed.append(entry("a", 1.0), path, "b1")
    embed.append(entry("a", 2.0), path, "b2")
    embed.append(entry("b", 3.0), path, "b2")  # committed already: nothing is written
    entry("c", 4.0).write.partitionBy("model_key").parquet(f"{path}/entries/batch=b3")
    assert rows(embed.store(spark, path).select("content_key", "vector")) == [("a", [1.0])]
    df = spark.createDataFrame([("p", bytearray(b"xyz")), ("q", bytearray(b"xyz"))], "patient_id string, payload binary")
    runs = [embed.embed_new(df, path, "m", "cfg", "payload", lambda ps: [[7.0]] * len(ps)) for _ in range(2)]
    assert all(rows(r.select("patient_id", "vector")) == [("p", [7.0]), ("q", [7.0])] for r in runs)
    assert embed.store_violations(embed.store(spark, path), 1).count() == 0


def test_numbering_at_any_size(spark, monkeypatch):
    """Positions are those of a sort, and a bucket's rows stay bounded as the table grows."""
    monkeypatch.setattr(folds, "BUCKET_ROWS", 16)
    for n in (0, 1, 200, 5000):
        df = spark.range(n).withColumn("g", F.col("id") % 2)
        got = {r["id"]: r["position"] for r in folds.numbered(df, ["g"], folds.hash_rank(1, F.col("id")), "id").collect()}
        hashes = {i: hashlib.sha256(f"1:{i}".encode()).hexdigest() for i in range(n)}
        want = {i: k for g in range(2) for k, i in enumerate(sorted(range(g, n, 2), key=lambda i: hashes[i]))}
        assert got == want
        bits = folds.bucket_bits(n, 16)
        assert max(collections.Counter(int(h[:13], 16) >> (52 - bits) for h in hashes.values()).values(), default=0) < 64


def test_sketches_of_runs_merge(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("run"), (F.col("id") % 5).alias("step"), (F.col("id") % 20_000).alias("user"))
    kept = runlog.distinct_sketches(df, ["user"], ["run", "step"])
    whole = runlog.sketched_counts(runlog.merged_sketches(kept.withColumn("_", F.lit(0)), ["user"], ["_"]), ["user"], ["_"]).first()["n_user"]
    assert abs(whole - 20_000) < 0.08 * 20_000
    so_far = {(r["run"], r["step"]): r["unique_so_far"] for r in runlog.cumulative_sketches(kept, "run", "step", "user").collect()}
    exact = {(r["run"], r["step"]): r["unique_so_far"] for r in runlog.cumulative_uniques(df, "run", "step", "user").collect()}
    assert so_far.keys() == exact.keys() and all(abs(so_far[k] - exact[k]) <= 0.08 * exact[k] for k in exact)


def test_tiles_are_not_dealt_by_class(spark, monkeypatch):
    """All tiles of a few classes would go to a few tasks; with too many classes to broadcast the weights are the same."""
    tiles = spark.createDataFrame([(i, "abc"[min(i % 5, 2)] if i % 7 else None) for i in range(100)], "id int, label string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        weighted = sampling.tile_weights(tiles, "label")
        assert "SortMergeJoin" not in weighted._jdf.queryExecution().sparkPlan().toString()
        few = sorted(tuple(r) for r in weighted.select("id", "weight").collect())
        monkeypatch.setattr(sampling, "BROADCAST_CLASSES", 0)
        shuffled = sampling.tile_weights(tiles, "label")
        assert "SortMergeJoin" in shuffled._jdf.queryExecution().sparkPlan().toString()
        assert sorted(tuple(r) for r in shuffled.select("id", "weight").collect()) == few and len(few) == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)

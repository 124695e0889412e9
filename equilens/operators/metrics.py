"""Subgroup metrics: AUROC, calibration error, gaps (null labels, scores and groups are left out by the caller's filter)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Score buckets for each doubling of a score, in which ranks are counted; a bucket is a task's work, so no window covers all.
PER_DOUBLING = 64
#: Inner edges of ten equal bins, as the doubles k * 0.1.
ECE_EDGES = [k * 0.1 for k in range(1, 10)]


def average_rank(df: DataFrame, order: str, by: list[str] | None = None, out: str = "rank") -> DataFrame:
    """``df`` with ranks that ties share.

    Distinct values are counted, ranked inside a score bucket and offset by the buckets below, as in ``auc_by``; rows
    then look up their value, so no window holds all rows of a group. Rows with a null value or key have no rank and
    are left out.
    """
    keys = by or ["_all"]
    df = df if by else df.withColumn("_all", F.lit(0))
    counts = df.groupBy(*keys, order).agg(F.count("*").alias("_n")).withColumn("_b", bucket_of(F.col(order)))
    inside = F.sum("_n").over(Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    lower = F.sum("_m").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m")
    buckets = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_m")).withColumn("_lower", lower).drop("_m")
    ranks = counts.withColumn("_up_to", inside).join(buckets, [*keys, "_b"])
    # The last rank of a value is what lies below and up to it; its ties share the mean.
    ranks = ranks.select(*keys, order, (F.col("_lower") + F.col("_up_to") - (F.col("_n") - 1) / 2).alias(out))
    return df.join(ranks, [*keys, order]).drop("_all")


def bucket_of(score: Column) -> Column:
    """A number that rises with the score, over probabilities, logits and any other range: 64 for each doubling, both signs."""
    level = lambda x: F.floor(F.log2(x) * PER_DOUBLING) + 2000 * PER_DOUBLING  # noqa: E731  above 0 for every double
    x = score.cast("double")
    return F.when(x > 0, level(x)).when(x < 0, -level(-x)).otherwise(F.lit(0)).cast("long")


def auc_by(df: DataFrame, keys: list[str], y: str = "y", score: str = "score", weight: Column | None = None) -> DataFrame:
    """(keys, n, n_pos, n_neg, auc) by the rank statistic; ties count half, one class alone gives null (A3, A4).

    Scores are first summed up by distinct value, ranked inside a bucket, and offset by the negatives of all buckets
    below; so a group of any size is spread over many tasks.
    """
    w = F.lit(1) if weight is None else weight
    keys = keys or ["_all"]
    df = df.withColumn("_all", F.lit(0)) if keys == ["_all"] else df
    sums = df.groupBy(*keys, F.col(score).alias("_s")).agg(F.sum(w).alias("n"), F.sum(w * F.col(y)).alias("pos"), F.sum(w * (1 - F.col(y))).alias("neg"))
    sums = sums.withColumn("_b", bucket_of(F.col("_s")))
    up_to = Window.partitionBy(*keys, "_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    inside = sums.withColumn("below", F.sum("neg").over(up_to) - F.col("neg"))
    # Wins over the negatives of the same bucket; those of lower buckets are added by bucket.
    by_bucket = inside.groupBy(*keys, "_b").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("wins"))
    lower = F.sum("neg").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("neg")
    total = by_bucket.withColumn("lower", lower).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("wins") + F.col("pos") * F.col("lower")).alias("wins")
    )
    auc = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("wins") / (F.col("n_pos") * F.col("n_neg")))
    return total.select(*[k for k in keys if k != "_all"], "n", "n_pos", "n_neg", auc.alias("auc"))


def ece_bin(score: Column) -> Column:
    """0 to 9; the last bin holds 1; null outside 0..1."""
    reached = sum((F.when(score >= e, 1).otherwise(0) for e in ECE_EDGES), F.lit(0))
    return F.when((score >= 0) & (score <= 1), reached)


def ece_by(df: DataFrame, keys: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """(keys, ece): rows outside 0..1 count in n but are in no bin (A5)."""
    bins = df.withColumn("_bin", ece_bin(F.col(score))).groupBy(*keys, "_bin").agg(F.count("*").alias("n"), F.abs(F.sum(y) - F.sum(score)).alias("off"))
    return bins.groupBy(*keys).agg((F.coalesce(F.sum(F.when(F.col("_bin").isNotNull(), F.col("off"))), F.lit(0.0)) / F.sum("n")).alias("ece"))


def unpivoted(df: DataFrame, attributes: list[str], carried: list[str]) -> DataFrame:
    """(carried, attribute, grp), a row for each attribute with a value."""
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("grp")) for a in attributes])
    return df.select(*carried, F.explode(pairs).alias("_p")).select(*carried, "_p.attribute", "_p.grp").where("grp is not null")


def subgroup_report(df: DataFrame, attributes: list[str], y: str = "y", score: str = "score", min_n: int = 20, min_class_n: int = 5) -> DataFrame:
    """(attribute, grp, n, n_pos, n_neg, auc, ece, insufficient_support, eligible_for_gap)."""
    long = unpivoted(df, attributes, [y, score])
    keys = ["attribute", "grp"]
    report = auc_by(long, keys, y, score).join(ece_by(long, keys, y, score), keys)
    weak = (F.col("n") < min_n) | (F.least("n_pos", "n_neg") < min_class_n)
    return report.withColumns({"insufficient_support": weak, "eligible_for_gap": ~weak & F.col("auc").isNotNull()})


def gaps(df: DataFrame, attributes: list[str], y: str = "y", score: str = "score", min_n: int = 20, min_class_n: int = 5) -> DataFrame:
    """(attribute, n_eligible, attr_overall_auc, auc_delta, ece_delta, es_auc); deltas are null for fewer than two eligible groups.

    The overall AUROC of an attribute is over all rows that have a group, eligible or not.
    """
    overall = auc_by(unpivoted(df, attributes, [y, score]), ["attribute"], y, score).select("attribute", F.col("auc").alias("attr_overall_auc"))
    both = overall.join(subgroup_report(df, attributes, y, score, min_n, min_class_n), "attribute", "left")
    ok = lambda c: F.when(F.col("eligible_for_gap"), F.col(c))
    spread = lambda c: F.max(ok(c)) - F.min(ok(c))
    off = F.sum(F.abs(F.col("attr_overall_auc") - ok("auc")))
    out = both.groupBy("attribute", "attr_overall_auc").agg(F.count(ok("auc")).alias("n_eligible"), spread("auc").alias("_a"), spread("ece").alias("_e"), off.alias("_off"))
    two = (F.col("n_eligible") >= 2) & F.col("attr_overall_auc").isNotNull()
    return out.select(
        "attribute", "n_eligible", "attr_overall_auc",
        F.when(two, F.col("_a")).alias("auc_delta"), F.when(two, F.col("_e")).alias("ece_delta"),
        F.when(two, F.col("attr_overall_auc") / (1 + F.col("_off"))).alias("es_auc"),
    )


def extreme_groups(df: DataFrame, attributes: list[str], y: str = "y", score: str = "score", min_n: int = 20, min_class_n: int = 5) -> DataFrame:
    """(attribute, best, worst): the eligible groups with the highest and the lowest AUROC, the first by name of equals (L3)."""
    fit = subgroup_report(df, attributes, y, score, min_n, min_class_n).where("eligible_for_gap")
    return fit.groupBy("attribute").agg(F.min_by("grp", F.struct(-F.col("auc"), F.col("grp"))).alias("best"), F.min_by("grp", F.struct("auc", "grp")).alias("worst"))


def support_flags(report: DataFrame) -> DataFrame:
    """One row (flags): "attribute:group" of all groups without support, in order."""
    flag = F.when(F.col("insufficient_support"), F.concat_ws(":", "attribute", "grp"))
    return report.agg(F.array_sort(F.collect_list(flag)).alias("flags"))


def eligible_groups(df: DataFrame, group: str, y: str = "y", min_group_n: int = 20, min_class_n: int = 5) -> DataFrame:
    """(group) with enough rows and enough of both classes."""
    counts = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.sum(y).alias("pos"))
    return counts.where((F.col("n") >= min_group_n) & (F.col("pos") >= min_class_n) & (F.col("n") - F.col("pos") >= min_class_n)).select(group)


def arm_metrics(scores: DataFrame, keys: list[str], group: str, groups: DataFrame, weight: Column | None = None) -> DataFrame:
    """(keys, overall_auc, auc_gap): overall over all rows, gap over the given groups; null where any AUROC is (A8, see ``undefined``)."""
    overall = auc_by(scores, keys, weight=weight).select(*keys, F.col("auc").alias("overall_auc"))
    of_groups = auc_by(scores.join(groups, group, "left_semi"), [*keys, group], weight=weight)
    most = groups.agg(F.count("*").alias("_groups"))
    gap = of_groups.groupBy(*keys).agg(F.count("auc").alias("_n"), (F.max("auc") - F.min("auc")).alias("_gap"))
    gap = gap.crossJoin(F.broadcast(most)).select(*keys, F.when(F.col("_n") == F.col("_groups"), F.col("_gap")).alias("auc_gap"))
    return overall.join(gap, keys, "left")


def undefined(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """(keys) of arms and runs whose metrics are undefined: some AUROC of theirs is."""
    return metrics.where("overall_auc is null or auc_gap is null").select(*keys)


def macro_auc(df: DataFrame, classes: list, label: str, score_of) -> DataFrame:
    """(macro_auc, n_classes): mean one-vs-rest AUROC over the classes that have both outcomes (A10). score_of: class -> column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("class"), score_of(c).alias("score")) for c in classes])
    long = df.select(F.col(label).alias("_l"), F.explode(pairs).alias("_p")).select("_p.class", "_p.score", (F.col("_l") == F.col("_p.class")).cast("int").alias("y"))
    return auc_by(long, ["class"]).agg(F.avg("auc").alias("macro_auc"), F.count("auc").alias("n_classes"))

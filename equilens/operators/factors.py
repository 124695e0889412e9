"""Factor metadata: category ids, z-scores, maps and their selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clinical import factor_value, number


def category_ids(df: DataFrame, column: str) -> DataFrame:
    """(category, id): 0-based ranks of the sorted distinct values, by their first two characters and inside those."""
    values = df.select(factor_value(F.col(column)).alias("category")).where("category is not null").distinct()
    values = values.withColumn("_start", F.substring("category", 1, 2))
    counts = values.groupBy("_start").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_start")) - F.col("_n")).drop("_n")  # a row for each two characters
    inside = F.row_number().over(Window.partitionBy("_start").orderBy("category")) - 1
    return values.withColumn("_inside", inside).join(before, "_start").select("category", (F.col("_before") + F.col("_inside")).cast("int").alias("id"))


def with_category_ids(df: DataFrame, column: str, out: str = "id") -> DataFrame:
    """``df`` with the id of its value, null where that is missing; one class alone is an error."""
    ids = category_ids(df, column)
    if ids.limit(2).count() < 2:
        raise ValueError(f"{column}: fewer than two classes")
    return df.withColumn("_c", factor_value(F.col(column))).join(ids.withColumnRenamed("category", "_c").withColumnRenamed("id", out), "_c", "left").drop("_c")


def z_scores(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, z) by the sample deviation, 8 decimals; fewer than two values, or all equal, are an error when it is read."""
    known = df.select(key, number(F.col(column).cast("string")).alias("x")).where("x is not null")
    moments = known.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    deviation = F.when(F.col("s") > 0, F.col("s")).otherwise(F.raise_error(F.lit(f"{column}: fewer than two values, or all equal")).cast("double"))
    return known.crossJoin(F.broadcast(moments)).select(key, F.round((F.col("x") - F.col("m")) / deviation, 8).alias("z"))


def factor_maps(long: DataFrame, key: str) -> DataFrame:
    """(factor, ids map<key, id>) from (factor, key, id) of patient size (K6)."""
    return long.groupBy("factor").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "id")))).alias("ids"))


def metadata(patients: DataFrame, key: str, discrete: list[str], continuous: list[str]) -> DataFrame:
    """One row of factor metadata: discrete and continuous maps by factor, categories in the order of their ids, patients n (K6).

    A continuous column is a number, written as its z-score, or an array of numbers, written as it is.
    """
    spark = patients.sparkSession
    maps, names, numbers = None, None, None
    for c in discrete:
        ids = with_category_ids(patients, c).where("id is not null").select(F.lit(c).alias("factor"), F.struct(key, "id").alias("e"))
        one = category_ids(patients, c).groupBy(F.lit(c).alias("factor")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "category"))), lambda s: s["category"]).alias("names"))
        maps, names = (ids, one) if maps is None else (maps.unionByName(ids), names.unionByName(one))
    for c in continuous:
        if patients.schema[c].dataType.typeName() == "array":
            part = patients.where(F.col(c).isNotNull()).select(key, F.col(c).cast("array<double>").alias("v"))
        else:
            part = z_scores(patients, key, c).select(key, F.array("z").alias("v"))
        part = part.select(F.lit(c).alias("factor"), F.struct(key, "v").alias("e"))
        numbers = part if numbers is None else numbers.unionByName(part)
    of = lambda df, kind: (df.groupBy("factor").agg(F.map_from_entries(F.array_sort(F.collect_list("e"))).alias("m")).agg(F.map_from_entries(F.collect_list(F.struct("factor", "m"))).alias("m")) if df is not None else spark.range(1).select(F.create_map().cast(kind).alias("m")))
    kind = patients.schema[key].dataType.simpleString()
    out = of(maps, f"map<string,map<{kind},int>>").withColumnRenamed("m", "discrete").crossJoin(of(numbers, f"map<string,map<{kind},array<double>>>").withColumnRenamed("m", "continuous"))
    if names is not None:
        out = out.crossJoin(names.agg(F.map_from_entries(F.collect_list(F.struct("factor", "names"))).alias("categories")))
    return out.crossJoin(patients.agg(F.countDistinct(key).alias("n")))


def from_maps(maps: DataFrame, key: str) -> DataFrame:
    """(factor, key, id) from (factor, ids)."""
    return maps.select("factor", F.explode("ids").alias(key, "id"))


def selection_violations(selected: DataFrame, maps: DataFrame) -> DataFrame:
    """(factor, problem) of selected factors (factor, sign): repeated, without a sign, absent, or not a scalar.

    maps: (factor, ...), with ``width``, the numbers that a value of the factor has, where some are continuous.
    """
    repeated = selected.groupBy("factor").count().where("count > 1").select("factor", F.lit("repeated").alias("problem"))
    unsigned = selected.where("sign = 0 or sign is null").select("factor", F.lit("no sign").alias("problem"))
    absent = selected.join(maps.select("factor").distinct(), "factor", "left_anti").select("factor", F.lit("absent").alias("problem"))
    found = repeated.unionByName(unsigned).unionByName(absent)
    if "width" in maps.columns:
        wide = maps.where("width > 1").select("factor").distinct()
        found = found.unionByName(selected.join(wide, "factor", "left_semi").select("factor", F.lit("not a scalar").alias("problem")))
    return found.distinct()

"""Clinical case fields: mapping, parsing and labels (null in, null out unless said otherwise)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Modelled groups and words for "not reported".
RACES = {"white": "White", "black or african american": "Black", "asian": "Asian"}
SEXES = {"male": "Male", "female": "Female"}
NOT_REPORTED = ["not reported", "unknown", "not allowed to collect"]
#: Task labels by cancer code.
NSCLC = {"LUAD": 0, "LUSC": 1}
GLIOMA = {"LGG": 0, "GBM": 1}
RACE_STATUSES = ["mapped", "missing", "not_reported", "unsupported_category"]

#: The characters that stripping takes from both ends, all white space of Unicode and four separators.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

CASE = "submitter_id string, project struct<project_id:string>, demographic struct<race:string, sex_at_birth:string, days_to_birth:double>, diagnoses array<struct<primary_diagnosis:string>>"


def strip(value: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(value, F.lit(WHITE))


def clean(value: Column) -> Column:
    """Stripped; empty is null."""
    return F.nullif(strip(value), F.lit(""))


def is_clean(value: Column) -> Column:
    return clean(value).isNotNull()


def lookup(value: Column, table: dict[str, str]) -> Column:
    """By lower-case stripped value, else null."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.lower(strip(value)))


def race_status(value: Column) -> Column:
    """mapped, missing, not_reported or unsupported_category."""
    low = F.lower(strip(value))
    return (
        F.when(clean(value).isNull(), "missing")
        .when(low.isin(list(RACES)), "mapped")
        .when(low.isin(NOT_REPORTED), "not_reported")
        .otherwise("unsupported_category")
    )


def age_years(days: Column) -> Column:
    """Days, of either sign, to years with four decimals, half to even."""
    return F.bround(F.abs(days) / 365.25, 4)


def age_bin(age: Column, cutoff: float = 65) -> Column:
    """Null for a null or non-finite age."""
    finite = age.isNotNull() & ~F.isnan(age) & (F.abs(age) < float("inf"))
    return F.when(finite, F.when(age < cutoff, f"age<{cutoff:g}").otherwise(f"age>={cutoff:g}"))


def number(value: Column) -> Column:
    """Double, null for what is none or is not finite."""
    x = strip(value.cast("string")).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def whole(value: Column) -> Column:
    """Integer by truncation."""
    return number(value).try_cast("int")


def factor_value(value: Column) -> Column:
    """Stripped; empty, nan and None are null."""
    v = strip(value)
    return F.when(~v.isin("", "nan", "None"), v)


def cancer_code(project_id: Column) -> Column:
    return F.regexp_replace(project_id, "^TCGA-", "")


def diagnoses_joined(names: Column) -> Column:
    """Sorted distinct non-empty names with a vertical bar between."""
    known = F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), strip), lambda d: d.isNotNull() & (d != ""))
    return F.array_join(F.array_sort(F.array_distinct(known)), "|")


def breast_subtype(names: Column) -> Column:
    """ductal, lobular, ambiguous or unclassified."""
    low = F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda d: F.lower(strip(F.coalesce(d, F.lit("")))))
    says = lambda word: F.exists(low, lambda d: d.contains(word) & d.contains("carcinoma"))
    duct, lobe = says("duct"), says("lobular")
    return F.when(duct & lobe, "ambiguous").when(duct, "ductal").when(lobe, "lobular").otherwise("unclassified")


def task_labels(code: Column, subtype: Column) -> dict[str, Column]:
    """Labels of the three tasks, null outside a task (X11)."""
    by = lambda table: F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), code)
    return {"label_nsclc": by(NSCLC), "label_glioma": by(GLIOMA), "label_brca": F.when(code == "BRCA", F.when(subtype == "ductal", 0).when(subtype == "lobular", 1))}


def patients_of_cases(cases: DataFrame) -> DataFrame:
    """One row per program case: id, cancer, demographics with status, diagnoses and task labels."""
    own = cases.where(F.col("submitter_id").startswith("TCGA-") & F.col("project.project_id").startswith("TCGA-"))
    names = F.transform("diagnoses", lambda d: d["primary_diagnosis"])
    out = own.select(
        F.col("submitter_id").alias("patient_barcode"),
        cancer_code(F.col("project.project_id")).alias("cancer"),
        lookup(F.col("demographic.race"), RACES).alias("race"),
        F.col("demographic.race").alias("race_raw"),
        race_status(F.col("demographic.race")).alias("race_status"),
        lookup(F.col("demographic.sex_at_birth"), SEXES).alias("sex"),
        age_years(F.col("demographic.days_to_birth")).alias("age"),
        diagnoses_joined(names).alias("primary_diagnosis"),
        breast_subtype(names).alias("subtype"),
    )
    return out.withColumns(task_labels(F.col("cancer"), F.col("subtype")))


def canonical_json(value: Column) -> Column:
    """JSON of a struct whose fields are in key order and whose lists are sorted by the caller."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)

"""Every query with SQL against DuckDB, and the driver contract."""

import pytest

from conftest import SF, table_rows
from equilens import plans


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = plans.QUERIES[name](spark, SF).toPandas(), duck.execute(plans.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert table_rows(got) == table_rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["probe_cross_validation", "nested_predictions", "debiased_scores", "debias_comparison", "dataset_inventory", "probe_external", "attribute_leakage"])
def test_query_without_sql_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_result_does_not_depend_on_partitioning(spark, monkeypatch):
    from equilens.plans import cohort_queries

    before = table_rows(plans.QUERIES["stratified_folds"](spark, SF).toPandas())
    given = cohort_queries.patients
    monkeypatch.setattr(cohort_queries, "patients", lambda s, d: given(s, d).orderBy("balance").repartition(7))
    assert table_rows(plans.QUERIES["stratified_folds"](spark, SF).toPandas()) == before

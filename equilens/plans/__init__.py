"""Queries over the given tables, one for each operator, with the SQL that checks them."""

from . import cohort_queries, contract_queries, metric_queries

QUERIES = metric_queries.QUERIES | cohort_queries.QUERIES | contract_queries.QUERIES
ORACLE_SQL = metric_queries.SQL | cohort_queries.SQL | contract_queries.SQL

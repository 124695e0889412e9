"""Spark-native cohort preparation and fairness analytics."""

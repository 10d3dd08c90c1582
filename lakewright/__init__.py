"""Lakewright: a Spark-native evidence-lake analytics engine."""

"""Spark-native catalog reconciliation, record linkage and plan auditing."""

"""Spark-native toolkit for cross-notation entity normalisation.

Sub-packages: ``sources`` (scans and sinks), ``functions`` (column
expressions), ``operators`` (DataFrame to DataFrame), ``plans`` (whole
queries with their SQL twins), ``streaming`` (incremental forms).
"""

"""Spark-native analytics over change-sets: diffs, findings, rules, projects, jobs and review plans as DataFrames."""

__version__ = "0.1.0"

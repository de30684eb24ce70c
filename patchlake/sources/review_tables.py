"""The tables of the review domain in the forms that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlake.functions.paths import plain_path, rule_key
from patchlake.runtime import once, spread, table


def change_sets(spark: SparkSession, d: str) -> DataFrame:
    """Change-sets without repeated rows, the state in lower case."""
    return table(spark, d, "change_sets").distinct().withColumn("state", F.lower("state"))


def files(spark: SparkSession, d: str) -> DataFrame:
    """Changed files, each delivery once: file_id, provider in lower case, path with slashes, patch."""
    return once(table(spark, d, "changed_files"), "file_id", "ingested_at").select("file_id", F.lower("provider").alias("provider"), "repository", "number", plain_path("file_path").alias("path"), "status", "language", "patch")


def findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the manifest, each once: seq, repository, path and line of the location, severity, rule key, texts.

    A location without a line, a blank severity or a blank rule gives null.
    """
    raw = spread(table(spark, d, "python_findings_manifest")).drop("reported_at").dropDuplicates(["manifest_id"])
    line = F.regexp_extract("location", r":(\d+)$", 1)
    blank = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", None).otherwise(c)
    return raw.select(
        F.col("manifest_id").alias("seq"),
        "repository",
        plain_path(F.regexp_replace("location", r":\d*$", "")).alias("path"),
        F.when(line != "", line.cast("int")).alias("line_number"),
        blank(F.lower(F.trim("severity"))).alias("severity"),
        blank(rule_key("rule")).alias("rule_id"),
        F.lower(F.trim("category")).alias("category"),
        "issue",
        "impact",
        "evidence",
        "suggestion",
    )

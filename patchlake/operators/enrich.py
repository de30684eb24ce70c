"""What is added to findings and files after the rules: evidence from the lines, categories, and whether a model needs to look at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchlake.functions.paths import strip
from patchlake.operators.classify import meaningful

#: Ends of lines that go on in the next.
GOES_ON = r"(?:[(,\\:=+-]|->)$"
#: Share of lines that findings must cover for a file to need no model, for files and for short ones, and what is short.
COVERED, COVERED_SHORT, SHORT = 0.8, 0.5, 8
#: Words of lines that are worth a look; a file with one is always looked at.
SIGNAL_WORDS = (
    "auth token secret permission role payment transaction database request response fetch http await async promise subscribe throw catch return parse serialize deserialize validate route middleware"
    " worker deploy build workflow cache concurr lock stream"
).split()
SIGNAL = r"(?i)\b(?:" + "|".join(SIGNAL_WORDS) + r")\b"


def line_evidence(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines with evidence: the line itself and up to two that follow it directly, while each goes on in the next."""
    w = Window.partitionBy(*keys).orderBy("line_number")
    code = strip("content")
    rows = lines.withColumn("_c0", code)
    for k in (1, 2):
        follows = F.lead("line_number", k).over(w) == F.col("line_number") + k
        rows = rows.withColumn(f"_c{k}", F.when(follows, F.lead("_c0", k).over(w)))
    one = F.when(F.col("_c0").rlike(GOES_ON), F.col("_c1"))
    two = F.when(F.col("_c0").rlike(GOES_ON) & F.col("_c1").rlike(GOES_ON), F.col("_c2"))
    text = F.concat_ws("\n", F.concat(F.lit("Changed line "), F.col("line_number").cast("string"), F.lit(": "), F.col("_c0")), one, two)
    return rows.withColumn("evidence", text).drop("_c0", "_c1", "_c2")


def categorised(findings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Findings with a category: their own, else that of their rule, else general."""
    c = catalog.select(F.col("rule_id").alias("_rule"), F.col("category").alias("_category"))
    return findings.join(F.broadcast(c), F.col("canonical") == F.col("_rule"), "left").withColumn("category", F.coalesce("category", "_category", F.lit("general"))).drop("_rule", "_category")


def coverage(lines: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., meaningful, covered, needed): how many lines of code of a file findings cover, and whether a model must look."""
    own = lines.where(meaningful(F.col("content"))).groupBy(*keys, "line_number").agg(F.max(F.col("content").rlike(SIGNAL).cast("int")).alias("signal"))
    hit = found.select(*keys, "line_number").distinct().withColumn("hit", F.lit(1))
    n = own.join(hit, [*keys, "line_number"], "left").groupBy(*keys).agg(F.count("*").alias("meaningful"), F.count("hit").alias("covered"), F.max("signal").alias("signal"))
    share = F.col("covered") / F.col("meaningful")
    enough = (share >= COVERED) | ((F.col("meaningful") <= SHORT) & (share >= COVERED_SHORT))
    return n.select(*keys, "meaningful", "covered", (~enough | (F.col("signal") == 1)).alias("needed"))


def counts(rows: DataFrame, keys: list[str], named: dict[str, Column]) -> DataFrame:
    """(keys..., one count for each condition)."""
    return rows.groupBy(*keys).agg(*(F.count_if(c).alias(n) for n, c in named.items()))

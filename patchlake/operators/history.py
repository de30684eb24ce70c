"""Reading jobs, runs and change-sets: filters, pages, counts and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def search(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """Rows in which the text stands, whatever its case, in the columns joined by blanks, nulls left out."""
    return rows.where(F.lower(F.concat_ws(" ", *columns)).contains(text.lower()))


def limited(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows with total, the number of all."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).limit(n).crossJoin(F.broadcast(total))  # one row of totals


def page(rows: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    """One page of rows, the last one where the number lies beyond it; page numbers begin with 1.

    Only the rows up to the page are ranked: the sort is a top-k.
    """
    total = rows.count()
    last = max(1, -(-total // size))
    at = min(max(1, number), last)
    top = rows.orderBy(*order).limit(at * size)
    return top.withColumn("row", F.row_number().over(Window.orderBy(*order))).where(F.col("row") > (at - 1) * size)


def recent(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def enriched(rows: DataFrame, order: list[Column], counts: DataFrame, keys: list[str], n: int = 30) -> DataFrame:
    """Rows whose null counts are looked up for the first n of them; others stay null."""
    n = min(max(n, 0), 100)
    first = rows.orderBy(*order).limit(n).select(*keys).withColumn("_looked", F.lit(True))
    null_safe = lambda a, b: F.expr(" and ".join(f"{a}.{k} <=> {b}.{k}" for k in keys))
    joined = rows.alias("r").join(F.broadcast(first).alias("f"), null_safe("r", "f"), "left").join(counts.alias("c"), null_safe("r", "c"), "left")
    return joined.select(*(F.col(f"r.{k}") for k in keys), F.coalesce(F.col("r.n"), F.when(F.col("f._looked"), F.col("c.n"))).alias("n"))


def trend(rows: DataFrame, day: str, good: Column, bad: Column, most: int = 31) -> DataFrame:
    """(bucket, start, passed, blocked, share): counts over the days from first to last, in at most so many buckets, none left out."""
    days = rows.select(F.to_date(day).alias("d"), good.alias("good"), bad.alias("bad")).where("d is not null")
    span = days.agg(F.min("d").alias("lo"), F.max("d").alias("hi")).withColumn("w", F.ceil((F.datediff("hi", "lo") + 1) / most).cast("int"))
    starts = span.where("lo is not null").select("lo", "w", F.posexplode(F.expr("sequence(lo, hi, make_interval(0, 0, 0, w))")).alias("bucket", "start")).select("lo", "w", "bucket", F.to_date("start").alias("start"))
    counted = days.join(F.broadcast(span), F.lit(True)).groupBy(F.floor(F.datediff("d", "lo") / F.col("w")).cast("int").alias("bucket")).agg(F.count_if("good").alias("passed"), F.count_if("bad").alias("blocked"))
    out = starts.join(counted, "bucket", "left").select("bucket", "start", F.coalesce("passed", F.lit(0)).alias("passed"), F.coalesce("blocked", F.lit(0)).alias("blocked"))
    top = out.agg(F.max(F.greatest("passed", "blocked")).alias("top"))
    return out.join(F.broadcast(top), F.lit(True)).select("bucket", "start", "passed", "blocked", (F.col("passed") / F.greatest("top", F.lit(1))).alias("share"))


def options(rows: DataFrame, column: str) -> DataFrame:
    """(value): the distinct values of a column in order, "all" first."""
    values = rows.select(F.col(column).alias("value")).where("value is not null").distinct()
    return values.sparkSession.createDataFrame([("all",)], "value string").union(values)


# ---- rows and filters of screens, as data --------------------------------------------------------------------------------


def chosen(rows: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows that have each wanted value; None and "all" want nothing."""
    for column, value in wanted.items():
        if value not in (None, "all"):
            rows = rows.where(F.col(column) == value)
    return rows


def searched(rows: DataFrame, columns: list[str], term: str | None) -> DataFrame:
    """Rows of which one of the columns holds the term, in any case; nothing is wanted where the term is blank."""
    term = (term or "").strip().lower()
    if not term:
        return rows
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(term), F.lit(False))
    return rows.where(hit)


def within(rows: DataFrame, column: str, first: str | None, last: str | None) -> DataFrame:
    """Rows of the days from first to last, both included; either may be open; an inverted range has no rows."""
    day = F.to_date(column)
    if first:
        rows = rows.where(day >= F.lit(first).cast("date"))
    if last:
        rows = rows.where(day <= F.lit(last).cast("date"))
    return rows


def clock(seconds: Column) -> Column:
    """Minutes and seconds of two figures at least; null stays null, and so does less than nothing."""
    part = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    minutes = F.floor(seconds / 60)
    text = F.when(minutes < 100, part(minutes)).otherwise(minutes.cast("long").cast("string"))
    return F.when(seconds >= 0, F.concat(text, F.lit(":"), part(F.floor(seconds % 60))))


def outcome(state: Column, decision: Column) -> Column:
    """How a run stands: running, failed, passed, blocked or changes."""
    said = F.lower(F.coalesce(decision, F.lit("")))
    return F.when(state.isin("queued", "running"), "running").when(state.isin("failed", "cancelled"), "failed").when(said.contains("pass"), "passed").when(said.contains("block"), "blocked").otherwise("changes")


def mode(state: Column, dry: Column) -> Column:
    return F.when(dry, "Dry run").when(state == "completed", "Published").when(state.isin("queued", "running"), "Publishing").otherwise("Not published")


def buckets(counts: DataFrame) -> DataFrame:
    """With danger, warning and info: five severities in three."""
    return counts.withColumn("danger", F.col("critical_count") + F.col("high_count")).withColumn("warning", F.col("medium_count")).withColumn("info", F.col("low_count") + F.col("suggestion_count"))


def page_buttons(pages: Column, current: Column) -> Column:
    """The numbers of pages to show, 0 for each gap: all of seven, else the ends, the neighbours, and a run at the start."""
    near = F.array(F.lit(1), pages, current - 1, current, current + 1)
    some = F.when(current < 5, F.concat(near, F.array(*map(F.lit, (2, 3, 4, 5))))).otherwise(near)
    shown = F.sort_array(F.array_distinct(F.filter(some, lambda n: (n > 0) & (n <= pages))))
    spaced = F.flatten(F.transform(shown, lambda n, i: F.when((i > 0) & (n - F.get(shown, i - 1) > 1), F.array(F.lit(0), n)).otherwise(F.array(n))))
    return F.when(pages <= 7, F.sequence(F.lit(1), pages)).otherwise(spaced)


def reconciled(metrics: DataFrame, found: str = "findings", final: str = "final_ai_findings") -> DataFrame:
    """Metrics with static_findings filled, where it is null, by all findings but the model's, never below 0."""
    return metrics.withColumn("static_findings", F.coalesce("static_findings", F.greatest(F.lit(0), F.col(found) - F.col(final))))

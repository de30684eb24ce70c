"""What becomes of findings after review: comments to publish, their accounts, summaries, and findings told by other labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchlake.operators.findings import line_groups, quota, render
from patchlake.operators.rules import SEVERITIES

#: Beginning of the hidden line by which a summary is known again.
SUMMARY_MARKER = "<!-- review-summary -->"
#: How decisions and severities are written.
DECISIONS = {"block": "Blocked", "request_changes": "Changes requested", "review_recommended": "Review recommended", "non_blocking": "Not blocking", "optional": "Optional", "pass": "Passed"}


def outcomes(findings: DataFrame, published: DataFrame, failing: DataFrame, keys: list[str], limit: int = 40) -> DataFrame:
    """(keys..., published, skipped_duplicates, summary_only, failed, processed, rate_limited) of publishing one run.

    findings: keys..., seq, path, line_number, rule_id, severity, marker; published: (keys..., marker) of comments that are
    there; failing: (keys..., rate_limited) where the one call of a run fails, by which all of it counts as failed. A finding
    whose marker is there or repeats an earlier one is a duplicate; the first groups of lines within the quota, less those that
    are there already, are published; the rest is told in the summary.
    """
    first = Window.partitionBy(*keys, "marker").orderBy("seq")
    told = published.select(*keys, "marker").distinct().withColumn("there", F.lit(True))
    own = findings.withColumn("again", F.row_number().over(first) > 1).join(told, [*keys, "marker"], "left")
    own = own.withColumn("duplicate", F.col("again") | F.col("there").isNotNull())
    there = published.groupBy(*keys).agg(F.countDistinct("marker").alias("n_there"))
    groups = line_groups(own.where("not duplicate"), [*keys, "path"]).join(there, keys, "left")
    w = Window.partitionBy(*keys).orderBy("first_rank", "first_seq")
    open_ = F.greatest(F.lit(limit) - F.coalesce("n_there", F.lit(0)), F.lit(0))
    shown = groups.withColumn("shown", F.row_number().over(w) <= open_).groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("shown"), F.size("rules"))), F.lit(0)).alias("shown"), F.coalesce(F.sum(F.when(~F.col("shown"), F.size("rules"))), F.lit(0)).alias("summary_only")
    )
    skipped = own.groupBy(*keys).agg(F.count_if("duplicate").alias("skipped_duplicates"))
    all_ = skipped.join(shown, keys, "left").join(failing.select(*keys, "rate_limited"), keys, "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    broken = F.col("rate_limited").isNotNull()
    return all_.select(
        *keys,
        F.when(broken, 0).otherwise(n("shown")).cast("long").alias("published"),
        n("skipped_duplicates").alias("skipped_duplicates"),
        n("summary_only").alias("summary_only"),
        F.when(broken, n("shown")).otherwise(0).cast("long").alias("failed"),
        (n("shown") + n("skipped_duplicates") + n("summary_only")).alias("processed"),
        F.coalesce("rate_limited", F.lit(False)).alias("rate_limited"),
    )


def rendered_groups(findings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., line_number, body): the comment of each line; several findings stand under one head, in order of seq."""
    one = findings.withColumn("body", render(F.col("marker")))
    g = one.groupBy(*keys, "line_number").agg(F.array_sort(F.collect_list(F.struct("seq", "body"))).alias("g"))
    bodies = F.transform("g", lambda x: x["body"])
    many = F.concat(F.lit("### "), F.size("g").cast("string"), F.lit(" findings on this line\n\n---\n\n"), F.array_join(bodies, "\n\n---\n\n"))
    return g.select(*keys, "line_number", F.when(F.size("g") == 1, bodies[0]).otherwise(many).alias("body"))


def summaries(findings: DataFrame, gates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., summary): decision, counts, and the findings of each severity in order of seq; gates as gate() gives them."""
    line = F.concat(F.lit("- `"), "path", F.lit(":"), F.col("line_number").cast("string"), F.lit("` **"), "rule_id", F.lit("** - "), F.coalesce("issue", F.lit("")))
    lists = findings.groupBy(*keys, "severity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("t")))), lambda x: x["t"]), "\n").alias("lines"))
    parts = lists.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("severity", "lines"))).alias("by"))
    counts = F.concat_ws("\n", *(F.concat(F.lit(f"- {s.capitalize()}: "), F.col(f"{s}_count").cast("string")) for s in SEVERITIES))
    label = F.element_at(F.create_map(*(F.lit(x) for pair in DECISIONS.items() for x in pair)), F.col("decision"))
    total = sum((F.col(f"{s}_count") for s in SEVERITIES[1:]), F.col(f"{SEVERITIES[0]}_count"))
    sections = [F.when(F.col("by")[s].isNotNull(), F.concat(F.lit(f"#### {s.capitalize()}\n\n"), F.col("by")[s])) for s in SEVERITIES]
    body = F.when(total == 0, F.lit("No issues were found in the changed lines.")).otherwise(F.concat_ws("\n\n", F.lit("### Findings"), *sections))
    return gates.join(parts, keys, "left").select(*keys, F.concat_ws("\n\n", F.concat(F.lit("**Decision:** "), label), counts, F.concat(F.lit("**Total:** "), total.cast("string")), body).alias("summary"))


def summary_upserts(summaries: DataFrame, comments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., action, comment_id, summary): the first comment with the marker is updated, else one is created."""
    there = comments.where(F.col("body").contains(SUMMARY_MARKER)).groupBy(*keys).agg(F.min("comment_id").alias("comment_id"))
    return summaries.join(there, keys, "left").select(*keys, F.when(F.col("comment_id").isNull(), "create").otherwise("update").alias("action"), "comment_id", "summary")


def severity_text(findings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., text): the counts of severities, those first seen first."""
    n = findings.groupBy(*keys, "severity").agg(F.min("seq").alias("s"), F.count("*").alias("n"))
    text = F.concat_ws(" ", "severity", F.col("n").cast("string"))
    return n.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", text.alias("t")))), lambda x: x["t"]), ", ").alias("text"))


def together(static: DataFrame, model: DataFrame, order: list[str]) -> DataFrame:
    """Both bags with place: all of the first, then all of the second, each in order; nothing is dropped."""
    both = static.withColumn("bag", F.lit(0)).unionByName(model.withColumn("bag", F.lit(1)))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("repository").orderBy("bag", *order))).drop("bag")


# ---- other labels ------------------------------------------------------------------------------------------------------

#: What a claim is about, whatever its label: a rule, then groups of words of each of which one must occur.
CLAIMS = [
    ("empty-catch-block", [("empty catch",)]),
    ("empty-catch-block", [("catch block",), ("silently", "ignored")]),
    ("json-parse-without-error-handling", [("json.parse", "parsing json", "parse json", "json parsing"), ("error", "exception", "throw", "invalid", "fail", "handling")]),
    ("setinterval-without-timer-reference", [("setinterval", "clearinterval", "timer reference", "timer handle", "returned timer", "reference to the timer", "timer is not retained")]),
    ("global-event-listener-without-removal", [("listener",), ("remov", "cleanup", "clean up", "memory leak")]),
    ("cache-consistency", [("cache",), ("key", "stale", "incorrect result", "wrong result"), ("missing", "absent", "exclude", "omit", "collision", "stale")]),
    ("logic-error", [("pagination", "page offset", "page index", "first page"), ("skip", "incorrect", "wrong", "offset", "start")]),
    ("incorrect-result-handling", [("always report", "always return success", "reports success", "return value ignored", "result ignored")]),
    ("async-blocking-operation", [("blocking",), ("async", "event loop", "non-blocking")]),
    ("missing-timeout", [("timeout",), ("request", "external", "network", "http", "client")]),
    ("authorization", [("authorization", "authorisation", "required role", "permission check")]),
    ("command-injection", [("command injection", "shell injection", "shell=true", "shell true")]),
    ("unsafe-code-execution", [("unsafe code execution", "dynamic evaluation", "untrusted eval", "arbitrary code")]),
    ("insufficient-test-assertion", [("weak test", "weak assertion", "insufficient assertion", "only checks status", "does not verify"), ("test", "assert", "response", "result", "behavior", "behaviour")]),
]


def relabelled(rule: Column, authority: Column, *texts: str) -> Column:
    """The rule that the words of a model's finding claim, the first of CLAIMS that holds; authoritative findings keep theirs."""
    said = F.lower(F.concat_ws(" ", *texts))
    out = rule
    for name, groups in reversed(CLAIMS):
        hit = F.lit(True)
        for words in groups:
            one = F.lit(False)
            for w in words:
                one = one | said.contains(w)
            hit = hit & one
        out = F.when(hit, name).otherwise(out)
    return F.when(authority, rule).otherwise(out)


def category_of(rule: Column, category: Column) -> Column:
    """The category, but for weak tests, which are of test quality whatever was said."""
    return F.when(rule == "insufficient-test-assertion", "test-quality").otherwise(category)


# ---- prompts and calls -------------------------------------------------------------------------------------------------


def prompts(lines: DataFrame, keys: list[str], head: str) -> DataFrame:
    """(keys..., paths, prompt): one prompt for each batch: its head, then the numbered lines of each file in order."""
    text = F.concat(F.col("line_number").cast("string"), F.lit(" | "), "content")
    files = lines.groupBy(*keys, "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", text.alias("t")))), lambda x: x["t"]), "\n").alias("t"))
    every = files.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("path", "t"))).alias("g"))
    body = F.array_join(F.transform("g", lambda x: F.concat(F.lit("File: "), x["path"], F.lit("\n"), x["t"])), "\n\n")
    return every.select(*keys, F.transform("g", lambda x: x["path"]).alias("paths"), F.concat(F.lit(head + "\n\n"), body).alias("prompt"))


def answers(prompts: DataFrame, keys: list[str], call: Callable[[str], str], attempts: int = 2) -> DataFrame:
    """(keys..., answer, failed): what a client answers to each prompt; a prompt that fails attempts times has no answer.

    call runs on the workers, once a prompt where it succeeds; one failing prompt doesn't stop the others.
    """
    from collections.abc import Iterator

    import pandas as pd

    schema = ", ".join(f"{k} {t}" for k, t in prompts.select(*keys).dtypes) + ", answer string, failed int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got, tried = [], []
            for p in b["prompt"]:
                for n in range(attempts + 1):
                    try:
                        answer = call(p) if n < attempts else None
                        break
                    except Exception:  # whatever a client raises is a failed attempt
                        continue
                got.append(answer)
                tried.append(n)
            yield b[keys].assign(answer=pd.Series(got, dtype=object, index=b.index), failed=pd.Series(tried, dtype="int32", index=b.index))

    return prompts.mapInPandas(run, schema)


def owned_answers(rows: DataFrame, prompts: DataFrame, keys: list[str]) -> DataFrame:
    """Answered findings whose path is one of those that their call was about."""
    return rows.join(prompts.select(*keys, "paths"), keys).where(F.array_contains("paths", F.col("file_path"))).drop("paths")


__all__ = ["outcomes", "rendered_groups", "summaries", "summary_upserts", "severity_text", "together", "relabelled", "category_of", "prompts", "answers", "owned_answers", "quota"]

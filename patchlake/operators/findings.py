"""The life of findings: matching to lines and to each other, folding duplicates, gates, groups, quotas and rendering."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from patchlake.functions.paths import dedup_path, split_lines, strip
from patchlake.operators.rules import SEVERITIES, rank
from patchlake.runtime import broadcast_if_small, by_group, ship_package

#: Beginning of the hidden line by which a published finding is known again.
MARKER = "<!-- finding:"
#: Rules that tell of one construct under several names.
FAMILIES = {
    "hardcoded-secret": "hardcoded-secret security-hardcoded-secret hardcoded-credential hardcoded-credentials embedded-secret exposed-secret credential-hardcoded",
    "unused-value": "unused-variable unused-code unused-constant unnecessary-constant unused-declaration",
    "unused-parameter": "unused-parameter unused-function-parameter unused-function-argument unused-method-parameter unused-argument",
    "console": "no-console console-log console-statement",
    "effect-cleanup": "missing-effect-cleanup react-use-effect-cleanup react-effect-cleanup hook-cleanup effect-cleanup",
    "effect-dependency": "react-use-effect-dependency react-hooks-missing-dependency missing-hook-dependency hook-dependency effect-dependency",
    "loose-equality": "loose-equality javascript-loose-equality typescript-loose-equality non-strict-equality non-strict-comparison eqeqeq",
    "json-parse": "json-parse json-parse-error json-parsing-error json-parse-without-error-handling unsafe-json-parsing",
    "timer-reference": "setinterval set-interval setinterval-without-timer-reference setinterval-without-retaining-timer-reference set-interval-without-retaining-timer-reference setinterval-without-referencing-timer set-interval-without-referencing-timer",
    "global-listener": "global-event-listener global-listener window-event-listener global-event-listener-without-removal",
    "html-injection": "unsafe-inner-html xss-vulnerability dom-xss unsafe-html unsanitized-html",
    "jwt-verification": "jwt-signature-verification-disabled jwt-verification insecure-jwt security data-validation",
    "empty-catch": "empty-catch-block no-empty-catch empty-catch swallowed-exception bare-except bare-exception-handler error-handling exception-handling",
    "authorization": "authorization missing-endpoint-authorization role-check access-control permission-check api-misuse security",
}
FAMILY_OF = {rule: family for family, rules in reversed(FAMILIES.items()) for rule in rules.split()}
BY_SUBJECT = {"hardcoded-secret", "unused-value", "unused-parameter"}
BY_NEARNESS = {"loose-equality", "effect-cleanup", "effect-dependency", "json-parse", "timer-reference", "global-listener", "html-injection", "empty-catch", "jwt-verification"}
AUTHORITATIVE = ("static", "framework", "compiler")
NEAR, NEAR_SUBJECT, NEAR_AUTHORITY = 2, 10, 4


def matched_files(findings: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Findings with matched: whether their file is among the changed files."""
    known = files.select(*keys).distinct().withColumn("matched", F.lit(True))
    return findings.join(known, keys, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def commentable(findings: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Findings that stand on an added line."""
    return findings.join(lines.select(*keys, "line_number").distinct(), [*keys, "line_number"], "left_semi")


def gate(findings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., decision, one count for each severity): the heaviest severity there is decides."""
    counts = {s: F.count_if(F.col("severity") == s) for s in SEVERITIES}
    out = findings.groupBy(*keys).agg(*(c.alias(f"{s}_count") for s, c in counts.items()))
    names = ["block", "request_changes", "review_recommended", "non_blocking", "optional"]
    decision = F.lit("pass")
    for s, n in reversed(list(zip(SEVERITIES, names))):
        decision = F.when(F.col(f"{s}_count") > 0, n).otherwise(decision)
    return out.withColumn("decision", decision)


def histogram(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """(keys..., out): a map of the counts of a value; nulls aren't counted."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").cast("int").alias("n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(value).alias("k"), "n")))).alias(out))


def line_groups(findings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., line_number, rules, first_rank, first_seq): findings of a line, the heaviest first, then in order of seq."""
    r = rank(F.col("severity"))
    g = findings.where(r.isNotNull()).groupBy(*keys, "line_number").agg(F.array_sort(F.collect_list(F.struct(r.alias("r"), "seq", "rule_id"))).alias("g"))
    return g.select(*keys, "line_number", F.transform("g", lambda x: x["rule_id"]).alias("rules"), F.col("g")[0]["r"].alias("first_rank"), F.col("g")[0]["seq"].alias("first_seq"))


def marker(rule: Column, path: Column, line: Column) -> Column:
    return F.concat(F.lit(MARKER), rule, F.lit(":"), path, F.lit(":"), line.cast("string"), F.lit(" -->"))


def markers_in(comments: DataFrame, body: str = "body") -> DataFrame:
    """(marker): the markers that stand alone on a line of a comment."""
    line = comments.select(F.explode(F.transform(split_lines(body), strip)).alias("marker"))
    return line.where(F.col("marker").startswith(MARKER) & F.col("marker").endswith("-->")).distinct()


def unpublished(findings: DataFrame, published: DataFrame) -> DataFrame:
    """Findings whose marker neither stands in a comment nor repeats an earlier finding's; the first of equal markers stays."""
    own = findings.withColumn("marker", marker(F.col("rule_id"), F.col("path"), F.col("line_number"))).where("marker is not null")
    first = own.groupBy("marker").agg(F.min("seq").alias("seq"))
    return own.join(first, ["marker", "seq"], "left_semi").join(published.select("marker"), "marker", "left_anti")


def quota(groups: DataFrame, keys: list[str], limit: int = 40) -> DataFrame:
    """Groups with published: the first limit groups of each key, by rank and first appearance; the rest is told in summaries."""
    w = Window.partitionBy(*keys).orderBy("first_rank", "first_seq")
    return groups.withColumn("published", F.row_number().over(w) <= limit)


def render(marked: Column) -> Column:
    """The comment of a finding: hidden marker, severity, then the sections that have text."""
    part = lambda name, c: F.when(F.length(strip(F.col(c))) > 0, F.concat(F.lit(f"**{name}:** "), strip(F.col(c))))
    return F.concat_ws("\n\n", marked, F.concat(F.lit("**"), F.upper("severity"), F.lit("**")), part("Category", "category"), part("Issue", "issue"), part("Impact", "impact"), part("Evidence", "evidence"), part("Suggestion", "suggestion"), F.concat(F.lit("_Rule: `"), F.col("rule_id"), F.lit("`_")))


#: Names whose values are hidden in error text, and schemes that may stand before a value.
SECRET_NAMES, SCHEMES = ("token", "pat", "authorization", "password"), ("bearer", "basic")


def redact_errors(text: Column) -> Column:
    """Error text without the values that follow a secret's name and a sign, at most 2000 characters."""
    after = r"(?i)(?<=(?:%s)\s{0,9}[:=]\s{0,9})(?![\s:=])(?:(?:%s)\s+)?[^\s,;]+" % ("|".join(SECRET_NAMES), "|".join(SCHEMES))
    return F.substring(F.regexp_replace(text, after, "[redacted]"), 1, 2000)


def near_matches(left: DataFrame, right: DataFrame, keys: list[str], distance: int) -> DataFrame:
    """Pairs (l_seq, r_seq) with equal keys and at most distance lines apart: a band join over buckets of lines.

    A row falls into its bucket, and the right side into the two beside it as well, so that lines meet by equality; no
    other pairs are made, and a file with very many findings is spread over its buckets.
    """
    width = distance + 1
    l = left.select(*keys, F.col("seq").alias("l_seq"), F.col("line_number").alias("l_line"), F.floor(F.col("line_number") / width).alias("bucket"))
    r = right.select(*keys, F.col("seq").alias("r_seq"), F.col("line_number").alias("r_line"), F.explode(F.array(*(F.floor(F.col("line_number") / width) + k for k in (-1, 0, 1)))).alias("bucket"))
    return l.join(r, [*keys, "bucket"]).where((F.abs(F.col("l_line") - F.col("r_line")) <= distance) & (F.col("l_seq") != F.col("r_seq"))).select("l_seq", "r_seq", *keys, "l_line", "r_line")


def owned(ai: DataFrame, authoritative: DataFrame, catalog: DataFrame, keys: list[str], distance: int = 5) -> DataFrame:
    """Findings of a model that the catalog lets it make, or that an authoritative finding of the rule nearby confirms."""
    free = catalog.where("ai_policy = 'validate'").select(F.col("rule_id").alias("canonical"))
    confirmed = near_matches(ai, authoritative, [*keys, "canonical"], distance).select(F.col("l_seq").alias("seq")).distinct()
    return ai.join(F.broadcast(free), "canonical", "left_semi").unionByName(ai.join(broadcast_if_small(confirmed), "seq", "left_semi")).dropDuplicates(["seq"])


# ---- duplicates --------------------------------------------------------------------------------------------------------
#
# Findings of a path are told to be one only if they are kin: of one family, or of one rule outside the families. So each kin of
# a path is settled by itself. What is kept stands in slots, looked up by line: a new finding meets the slots of the few lines
# within reach, never all that were kept.

#: The columns that settle() takes, in order.
SETTLED = ("seq", "line_number", "rule", "subject", "authority", "weight", "test", "block")


def kin_columns(findings: DataFrame) -> DataFrame:
    """With kin, rule, subject (the first quoted name in the text), authority, weight (of the severity) and test."""
    rule = F.lower(F.trim(F.coalesce("rule_id", F.lit(""))))
    families = F.create_map(*(F.lit(x) for pair in FAMILY_OF.items() for x in pair))
    subject = F.lower(F.regexp_extract("issue", r"[`'\"]([A-Za-z_$][A-Za-z0-9_$]*)[`'\"]", 1))
    return (
        findings.withColumn("rule", rule)
        .withColumn("kin", F.coalesce(F.element_at(families, F.col("rule")), F.concat(F.lit("="), F.col("rule"))))
        .withColumn("subject", F.nullif(subject, F.lit("")))
        .withColumn("authority", F.coalesce(F.col("source").isin(*AUTHORITATIVE), F.lit(False)))
        .withColumn("weight", -rank(F.col("severity")))
        .withColumn("test", (F.col("rule") == "insufficient-test-assertion") | F.coalesce(F.col("category") == "test-quality", F.lit(False)))
    )


def settle(kin: str, rows: list[tuple]) -> list[tuple[int, int]]:
    """(seq, kept_as) of the findings of one kin of a path, in the order in which they came; rows as SETTLED."""
    wide = NEAR_SUBJECT if kin in BY_SUBJECT else NEAR_AUTHORITY
    slots: list[int] = []
    by_line: dict[int, set[int]] = {}
    by_block: dict[tuple, set[int]] = {}
    heir = list(range(len(rows)))

    def crowded(line: int) -> bool:
        """Whether what is kept near a line names two subjects."""
        near = (rows[slots[s]][3] for at in range(line - NEAR, line + NEAR + 1) for s in by_line.get(at, ()))
        return len({x for x in near if x}) > 1

    def reach(x: tuple, y: tuple) -> int:
        """How many lines apart two findings may stand and be one; -1: none."""
        if x[6] != y[6]:
            return -1
        named = None if x[3] is None or y[3] is None else x[3] == y[3]
        if x[1] == y[1] and x[2] == y[2]:
            apart = kin in BY_SUBJECT and (named is False or named is None and crowded(x[1]))
            return -1 if apart else 0
        if kin in BY_SUBJECT:
            loose = kin == "hardcoded-secret" and named is None and not crowded(x[1])
            own = NEAR_SUBJECT if named else NEAR if loose else -1
        elif kin in BY_NEARNESS:
            own = NEAR
        else:
            own = -1 if kin.startswith("=") else 0
        return max(own, NEAR_AUTHORITY if x[4] != y[4] else -1)

    def place(slot: int, k: int) -> None:
        by_line.setdefault(rows[k][1], set()).add(slot)
        by_block.setdefault(rows[k][6:], set()).add(slot)

    for k, x in enumerate(rows):
        met = {s for at in range(x[1] - wide, x[1] + wide + 1) for s in by_line.get(at, ()) if reach(x, rows[slots[s]]) >= abs(x[1] - rows[slots[s]][1])}
        if kin == "effect-cleanup" and x[7] is not None:
            met |= by_block.get(x[6:], set())
        if not met:
            slots.append(k)
            place(len(slots) - 1, k)
            continue
        slot = min(met)
        y = rows[slots[slot]]
        if (x[4], x[5]) > (y[4], y[5]):
            by_line[y[1]].discard(slot)
            by_block[y[6:]].discard(slot)
            heir[slots[slot]] = slots[slot] = k
            place(slot, k)
        else:
            heir[k] = slots[slot]
    out = []
    for k in range(len(rows) - 1, -1, -1):  # an heir that came later is known by now
        end = k
        while heir[end] != end:
            end = heir[end]
        heir[k] = end
        out.append((rows[k][0], rows[end][0]))
    return out


def fold(rows: list[dict]) -> list[int]:
    """For findings of one path in order, as plain rows: the seq that stands for each one in the end, its own where it is kept."""
    import re

    groups: dict[str, list[tuple]] = {}
    for x in rows:
        rule = (x["rule_id"] or "").strip().lower()
        named = re.search(r"[`'\"]([A-Za-z_$][A-Za-z0-9_$]*)[`'\"]", x["issue"] or "")
        test = rule == "insufficient-test-assertion" or x["category"] == "test-quality"
        y = (x["seq"], x["line_number"], rule, named and named[1].lower(), x["source"] in AUTHORITATIVE, -SEVERITIES.index(x["severity"]), test, x.get("block"))
        groups.setdefault(FAMILY_OF.get(rule, "=" + rule), []).append(y)
    kept = dict(pair for kin, some in groups.items() for pair in settle(kin, some))
    return [kept[x["seq"]] for x in rows]


def deduplicated(findings: DataFrame, keys: list[str], blocks: DataFrame | None = None) -> DataFrame:
    """(seq, kept_as): each finding with the finding that stands for it in the end.

    What comes later may take the place of what it repeats, so that the order matters within a kin of a path. Kin more than
    NEAR_SUBJECT lines apart never meet (but in one effect block), so that a path is cut at such gaps and the pieces are settled
    apart. blocks: (keys..., p, start, end) of effects, as effect_blocks() gives them.
    """
    rows = kin_columns(findings.where("line_number is not null and severity is not null").withColumn("p", dedup_path("path")))
    if blocks is None:
        rows = rows.withColumn("block", F.lit(None).cast("int"))
    else:
        own = rows.where("kin = 'effect-cleanup'").select(*keys, "p", "seq", "line_number").join(blocks, [*keys, "p"]).where("line_number between start and end")
        rows = rows.join(own.groupBy("seq").agg(F.min("start").alias("block")), "seq", "left")
    w = Window.partitionBy(*keys, "p", "kin").orderBy("line_number", "seq")
    far = F.col("line_number") - F.lag("line_number").over(w) > NEAR_SUBJECT
    gap = far & ~F.coalesce(F.col("block") == F.lag("block").over(w), F.lit(False))
    pieces = rows.withColumn("gap", F.coalesce(gap.cast("int"), F.lit(0))).withColumn("piece", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    held = len(keys) + 3

    def run(rows: list[tuple]) -> list[tuple]:
        return settle(rows[0][held - 2], [x[held:] for x in rows])

    return by_group(pieces.select(*keys, "p", "kin", "piece", *SETTLED), [*keys, "p", "kin", "piece"], ["seq"], run, "seq long, kept_as long")


def effect_blocks(files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys..., p, start, end): the lines of each outermost call of an effect hook in a text."""
    ship_package(files.sparkSession)
    schema = StructType([*(files.schema[k] for k in keys), *_parse_datatype_string("p string, start int, end int").fields])
    names = schema.names

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            owner, out = [], []
            for k, body in enumerate(rb.column(len(keys) + 1).to_pylist()):
                for a, b in calls(body or ""):
                    owner.append(k)
                    out.append((a, b))
            held = [rb.column(k).take(pa.array(owner, pa.int64())) for k in range(len(keys) + 1)]
            lines = [pa.array(c, pa.int32()) for c in zip(*out)] if out else [pa.array([], pa.int32())] * 2
            yield pa.RecordBatch.from_arrays([*held, *lines], names)

    some = files.where(F.col(text).rlike(EFFECT)).select(*keys, dedup_path("path").alias("p"), text)
    return some.mapInArrow(run, schema)


#: The call of an effect hook.
EFFECT = r"\buse(?:Layout)?Effect\s*\("


def calls(text: str) -> list[tuple[int, int]]:
    """The first and last line of each outermost effect call, by one walk over strings, brackets and calls."""
    import re

    out, depth, begin, line, at = [], 0, None, 1, 0
    token = re.compile(EFFECT + r"|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`|[()]", re.DOTALL)
    for m in token.finditer(text):
        line, at = line + text.count("\n", at, m.start()), m.start()
        if m[0] == ")":
            depth -= depth > 0
            if begin and depth == begin[1]:
                out.append((begin[0], line))
                begin = None
        elif m[0][-1] == "(":
            if m[0] != "(" and not begin:
                begin = (line, depth)
            depth += 1
    return out

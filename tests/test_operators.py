"""Operators on small tables: odd values, ties, empty tables and clashing columns."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from patchlake.functions import paths
from patchlake.operators import classify, diff, findings, history, planning, projects, rules
from patchlake.sources.pages import ChangeSetPages
from patchlake.streaming import progress

PATCH = "@@ -1,3 +10,4 @@ def f\n a\n+b\n+\n-c\n+d\n\\ No newline at end of file\n@@ -20 +30,2 @@\n+++ x\n+e\r\n z"


def test_added_lines_keep_numbers_and_positions(spark):
    df = spark.createDataFrame([(1, PATCH, "x"), (2, None, "x"), (3, "", "x"), (4, "+early", "x")], "file_id int, patch string, lines string")
    got = sorted(map(tuple, diff.added_lines(df, ["file_id"]).collect()))
    assert got == [(1, 11, "b", 2), (1, 13, "d", 5), (1, 30, "e", 8), (4, 0, "early", 1)]


def test_hunks_and_counts(spark):
    df = spark.createDataFrame([(1, "k", PATCH), (2, "k", None)], "file_id int, k string, patch string")
    h = sorted(map(tuple, diff.hunks(df, ["file_id"]).drop("added").collect()))
    assert h == [(1, 1, 1, 3, 10, 4), (1, 2, 20, 1, 30, 2)]
    assert tuple(diff.run_counts(df, ["k"]).first()) == ("k", None, None)
    assert sorted(map(tuple, diff.api_counts(df, ["file_id"]).collect())) == [(1, 5, 1), (2, 0, 0)]


def test_lines_end_everywhere(spark):
    df = spark.createDataFrame([("a\rb\x0bc d\n",), ("",), (None,), ("\n",)], "t string")
    assert [r[0] for r in df.select(paths.split_lines("t")).collect()] == [["a", "b", "c", "d"], [], None, [""]]


def test_keys(spark):
    df = spark.createDataFrame([("  Unused__Var - x ", ".\\a\\B/", " ./A\\b ")], "r string, p string, q string")
    assert tuple(df.select(paths.rule_key("r"), paths.project_path("p"), paths.dedup_path("q")).first()) == ("unused-var-x", "a/B", "./a/b")


@pytest.mark.parametrize(
    "path, want",
    [
        ("src/a.py", "source_code"), ("tsconfig.spec.json", "context_configuration"), ("build.gradle.kts", "project_configuration"), ("a/tests/x.py", "test"), ("app-e2e/x.ts", "end_to_end"), (".github/skills/x.md", "tool_configuration"),
        ("public/i.svg", "static_asset"), ("i.svg", "unknown"), ("x/dist/a.js", "generated"), ("yarn.lock", "lock_file"), ("a.png", "binary"), ("README.md", "documentation"), (".eslintrc.json", "tool_configuration"), ("a/b.scss", "stylesheet"), ("", "unknown"),
    ],
)
def test_categories(spark, path, want):
    assert classify.categorized(spark.createDataFrame([(path,), (None,)], "path string")).orderBy(F.desc("path")).collect()[0].category == want


def test_route_and_barrel(spark):
    df = spark.createDataFrame([("index.ts", ["import a", " ", "// x"]), ("index.ts", ["const a = 1"]), ("a.ts", []), ("a.md", ["x"]), ("a.ts", None)], "p string, c array<string>")
    assert [r.route for r in classify.routed(df, "p", "c").collect()] == ["skip: barrel", "source_code", "skip: no lines", "skip: documentation", "skip: no lines"]


def test_rules_resolve_clamp_and_policy(spark):
    df = spark.createDataFrame([(1, "console-log", "critical"), (2, "react-unused-var", "high"), (3, "hardcoded-secret", "low"), (4, "naming-style", "low"), (5, None, None), (6, "ssrf", "medium")], "seq int, rule_id string, severity string")
    got = {r.seq: (r.canonical, r.severity) for r in rules.clamp(rules.resolve(df)).collect()}
    assert got == {1: ("no-console", "low"), 2: ("unused-variable", "low"), 3: ("hardcoded-secret", "critical"), 4: ("naming-style", "low"), 5: (None, None), 6: ("ssrf", "high")}
    assert sorted(r.seq for r in rules.policy(rules.clamp(rules.resolve(df))).collect()) == [1, 2, 3, 5, 6]
    assert rules.catalog(spark).count() == 105 and rules.catalog(spark, [("own", "x", "static", "block", None, None, [])]).count() == 106


def test_line_rules_fire_and_stay_silent(spark):
    bad = [("a.js", "console.log(x)"), ("a.ts", "if (a == b) {"), ("a.py", "except:"), ("a.py", "x = eval(y)"), ("b.yml", 'api_key: "abcdef123"')]
    good = [("a.py", "console.log(x)"), ("a.ts", "if (a === b) {"), ("a.py", "except ValueError:"), ("a.py", "x = retrieval(y)"), ("b.yml", 'api_key: "changeme"'), ("a.py", None)]
    df = spark.createDataFrame([(p, i, c) for i, (p, c) in enumerate(bad + good)], "path string, line_number int, content string")
    assert sorted(r.line_number for r in rules.line_findings(df, ["path"]).collect()) == [0, 1, 2, 3, 4]


def brute_fold(rows):
    """The fold told anew over dictionaries, one finding after the other."""
    kept = []
    stand = {}
    for x in rows:
        hit = None
        for k in kept:
            one = [dict(k), dict(x)]
            if len(set(findings.fold(one))) == 1:
                hit = k
                break
        if hit is None:
            kept.append(x)
            stand[x["seq"]] = x["seq"]
    return len(kept)


def finding(seq, line, rule, severity="low", source="static", issue="", path="a"):
    return dict(path=path, seq=seq, line_number=line, rule_id=rule, severity=severity, category="c", issue=issue, source=source)


def test_fold_replaces_by_strength_and_keeps_subjects_apart():
    assert findings.fold([finding(1, 5, "no-console"), finding(2, 5, "no-console", "high")]) == [2, 2]
    assert findings.fold([finding(1, 5, "no-console", source="llm", severity="high"), finding(2, 6, "no-console")]) == [2, 2]
    assert findings.fold([finding(1, 5, "unused-variable", issue="`a`"), finding(2, 5, "unused-variable", issue="`b`")]) == [1, 2]
    assert findings.fold([finding(1, 5, "loose-equality"), finding(2, 7, "eqeqeq"), finding(3, 9, "eqeqeq")]) == [1, 1, 3]


def test_deduplicated_pieces_agree_with_one_fold(spark):
    random.seed(4)
    rs = ["no-console", "loose-equality", "eqeqeq", "unused-variable", "hardcoded-secret", "error-handling", "bare-except", "x"]
    rows = [finding(i, random.randint(1, 120), random.choice(rs), random.choice(rules.SEVERITIES), random.choice(["static", "llm"]), random.choice(["", "`a`", "'b'"])) for i in range(120)]
    df = spark.createDataFrame(rows, "path string, seq long, line_number int, rule_id string, severity string, category string, issue string, source string").withColumn("repository", F.lit("r"))
    got = {r.seq: r.kept_as for r in findings.deduplicated(df, ["repository"]).collect()}
    assert got == dict(zip([r["seq"] for r in rows], findings.fold(rows)))
    assert findings.deduplicated(df.limit(0), ["repository"]).count() == 0


def test_near_matches_equal_brute_force(spark):
    random.seed(1)
    rows = [(random.choice("ab"), i, random.randint(0, 60)) for i in range(80)]
    df = spark.createDataFrame(rows, "k string, seq int, line_number int")
    got = {(r.l_seq, r.r_seq) for r in findings.near_matches(df, df, ["k"], 5).collect()}
    assert got == {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and abs(a[2] - b[2]) <= 5}


def test_gate_decides_by_the_heaviest(spark):
    df = spark.createDataFrame([("a", "low"), ("a", "high"), ("b", "suggestion"), ("c", None)], "k string, severity string")
    assert {r.k: r.decision for r in findings.gate(df, ["k"]).collect()} == {"a": "request_changes", "b": "optional", "c": "pass"}


def test_markers_and_quota(spark):
    c = spark.createDataFrame([("x\n  <!-- finding:r:p:1 -->\ny",), (None,), ("<!-- finding:r:p:2 --> not alone",)], "body string")
    assert [r[0] for r in findings.markers_in(c).collect()] == ["<!-- finding:r:p:1 -->"]
    f = spark.createDataFrame([(1, "r", "p", 1), (2, "r", "p", 3), (3, "r", "p", 3)], "seq int, rule_id string, path string, line_number int")
    assert [r.seq for r in findings.unpublished(f, findings.markers_in(c)).collect()] == [2]
    g = spark.createDataFrame([("k", 0, 5), ("k", 0, 1), ("k", 2, 0)], "k string, first_rank int, first_seq int")
    assert {(r.first_seq, r.published) for r in findings.quota(g, ["k"], 2).collect()} == {(1, True), (5, True), (0, False)}


def test_owners_take_the_longest_prefix(spark):
    f = spark.createDataFrame([("r", 1, "a/b/c.py"), ("r", 2, "a/bc/d.py"), ("r", 3, "z.py"), ("s", 4, "a/x")], "repository string, file_id int, path string")
    p = spark.createDataFrame([("r", "a"), ("r", "a/b"), ("r", ".")], "repository string, root string")
    assert {r.file_id: r.root for r in projects.owners(f, p, ["repository"]).collect()} == {1: "a/b", 2: "a", 3: ".", 4: None}


def brute_parts(lines, tokens, most, few):
    cost = lambda x: max(1, -(-len(x) // 3)) + 4
    out, now, load = [], [], 0
    for x in lines:
        if now and (load + cost(x) > tokens or len(now) >= most):
            out.append(now)
            now, load = [], 0
        now.append(x)
        load += cost(x)
    out += [now] if now else []
    if len(out) > few:
        size = -(-len(lines) // few)
        out = [lines[k : k + size] for k in range(0, len(lines), size)]
    return [(len(p), sum(map(cost, p))) for p in out]


def test_parts_equal_brute_force(spark):
    random.seed(2)
    rows = [(i, ["x" * random.randint(0, 90) for _ in range(random.randint(0, 40))]) for i in range(30)]
    df = spark.createDataFrame(rows, "k int, lines array<string>")
    got: dict = {}
    for r in planning.parts(df, ["k"], tokens=200, most=9).orderBy("k", "part").collect():
        got.setdefault(r.k, []).append((r.n, r.tokens))
    assert got == {k: brute_parts(v, 200, 9, 2) for k, v in rows if v}


def test_batches_keep_budgets(spark):
    rows = [("k", i, "a" if i % 3 else "b", 700) for i in range(11)]
    df = spark.createDataFrame(rows, "k string, seq int, kind string, tokens int")
    got: dict = {}
    for r in planning.file_batches(df, ["k"]).collect():
        got.setdefault(r.batch, []).append(r.seq)
    assert sorted(map(sorted, got.values())) == [[0, 3, 6], [1, 2, 4], [5, 7, 8], [9], [10]]
    assert [min(v) for _, v in sorted(got.items())] == sorted(min(v) for v in got.values())


def test_context_marks_gaps(spark):
    lines = spark.createDataFrame([("f", i, f"l{i}") for i in range(1, 12)], "k string, line_number int, content string")
    got = planning.context(lines, lines.where("line_number in (2, 9)"), ["k"], 1).first().content
    assert got == "1 | l1\n2 | l2\n3 | l3\n... omitted unrelated lines ...\n8 | l8\n9 | l9\n10 | l10"


def test_trend_keeps_empty_buckets(spark):
    df = spark.createDataFrame([(dt.datetime(2030, 1, 1), True), (dt.datetime(2030, 1, 4), False), (None, True)], "t timestamp, ok boolean")
    got = [tuple(r) for r in history.trend(df, "t", F.col("ok"), ~F.col("ok")).orderBy("bucket").collect()]
    assert [(b, p, n) for b, _, p, n, _ in got] == [(0, 1, 0), (1, 0, 0), (2, 0, 0), (3, 0, 1)]
    assert history.trend(df.limit(0), "t", F.col("ok"), ~F.col("ok")).count() == 0


def test_pages_clamp(spark):
    df = spark.range(7)
    assert [r.id for r in history.page(df, [F.col("id")], 3, 9).collect()] == [6]
    assert history.page(df.limit(0), [F.col("id")], 3, 2).count() == 0


def test_paged_source(spark, tmp_path):
    for n, (items, after) in enumerate([([{"provider": "p", "repository": "r", "number": 1, "title": "t", "state": "open"}], 2), ([{"number": 2}], None)], 1):
        (tmp_path / f"page-{n}.json").write_text(json.dumps({"items": items, "next": after}))
    spark.dataSource.register(ChangeSetPages)
    assert sorted(r.number for r in spark.read.format("change_set_pages").load(str(tmp_path)).collect()) == [1, 2]
    (tmp_path / "page-2.json").write_text(json.dumps({"items": [], "next": 1}))
    with pytest.raises(Exception, match="comes twice"):
        spark.read.format("change_set_pages").load(str(tmp_path)).collect()


def test_stream_replays_to_the_batch(spark, tmp_path):
    random.seed(3)
    rows = [(random.randint(1, 6), i, i, dt.datetime(2030, 1, 1) + dt.timedelta(seconds=i), random.choice(["queued", "running", "note", "completed", "failed", "cancelled"]), random.choice([None, -5, 20, 150])) for i in range(90)]
    schema = "job long, event_id long, seq long, ts timestamp, kind string, progress int"
    events = spark.createDataFrame(rows, schema)
    for k in range(3):
        events.where(f"seq div 30 = {k}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = progress.streamed(stream).writeStream.outputMode("update").format("memory").queryName("jobs").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    last = spark.sql("select job, max_by(struct(events, progress, state), events) x from jobs group by job").collect()
    want = {r.job: (r.events, r.progress, r.state) for r in progress.reduced(events).collect()}
    assert {r.job: tuple(r.x) for r in last} == want


def test_once_keeps_the_first_delivery(spark):
    from patchlake.runtime import once

    t = [dt.datetime(2030, 1, d) for d in (1, 2)]
    df = spark.createDataFrame([(1, t[1], "b"), (1, t[0], "a"), (2, t[0], "c"), (2, t[0], "c"), (3, None, "d"), (None, t[0], "e")], "k int, t timestamp, x string")
    assert sorted((r.k or 0, r.x) for r in once(df, "k", "t").collect()) == [(0, "e"), (1, "a"), (2, "c"), (3, "d")]
    assert once(df.where("k = 3"), "k", "t").count() == 1 and once(df.limit(0), "k", "t").count() == 0


def test_lines_and_parts_of_a_very_long_patch_take_seconds(spark):
    import time

    patch = "\n".join("@@ -1,1 +%d,9 @@" % (i + 1) if i % 1000 == 0 else f"+line {i}" for i in range(100_000))
    df = spark.createDataFrame([(1, patch)], "file_id long, patch string")
    start = time.time()
    assert diff.added_lines(df, ["file_id"]).agg(F.count("*"), F.max("line_number"), F.max("diff_position")).first() == (99_900, 99_999, 99_900)
    long = df.select("file_id", F.split("patch", "\n").alias("lines"))
    assert [tuple(r) for r in planning.parts(long, ["file_id"], few=100_000).agg(F.count("*"), F.sum("n")).collect()] == [(200, 100_000)]
    assert time.time() - start < 20


def test_duplicates_in_cases(spark):
    one = lambda *rows: findings.fold(list(rows))
    assert one(finding(1, 10, "no-console"), finding(2, 10, "no-console")) == [1, 1]
    assert one(finding(1, 10, "no-console"), finding(2, 10, "console-log", "high"), finding(3, 20, "no-console")) == [2, 2, 3]
    assert one(finding(1, 10, "hardcoded-secret"), finding(2, 11, "exposed-secret")) == [1, 1]
    assert one(finding(1, 10, "hardcoded-secret"), finding(2, 13, "exposed-secret")) == [1, 2]
    assert one(finding(1, 10, "hardcoded-secret", issue="`a`"), finding(2, 11, "hardcoded-secret", issue="`b`"), finding(3, 11, "exposed-secret")) == [1, 2, 3]
    assert one(finding(1, 10, "unused-value", issue="`a`"), finding(2, 19, "unused-variable", issue="'a'")) == [1, 2]
    assert one(finding(1, 10, "unused-code", issue="`a`"), finding(2, 19, "unused-variable", issue="'a'")) == [1, 1]
    assert one(finding(1, 10, "bare-except"), finding(2, 14, "bare-except", source="llm"), finding(3, 15, "bare-except")) == [1, 1, 3]


def test_findings_of_one_effect_are_one(spark):
    text = 'x\nuseEffect(() => {\n  go(")");\n' + "  y();\n" * 30 + "}, []);\nuseLayoutEffect(() => z(), [])\n"
    assert findings.calls(text) == [(2, 34), (35, 35)]
    files = spark.createDataFrame([("r", "a.tsx", text), ("r", "b.ts", None)], "repository string, path string, text string")
    blocks = findings.effect_blocks(files, ["repository"])
    rows = [finding(1, 3, "effect-cleanup", path="a.tsx"), finding(2, 33, "hook-cleanup", path="a.tsx"), finding(3, 35, "effect-cleanup", path="b.ts"), finding(4, 50, "effect-cleanup", path="a.tsx")]
    df = spark.createDataFrame(rows, "path string, seq long, line_number int, rule_id string, severity string, category string, issue string, source string").withColumn("repository", F.lit("r"))
    assert dict(map(tuple, findings.deduplicated(df, ["repository"], blocks).collect())) == {1: 1, 2: 1, 3: 3, 4: 4}
    assert dict(map(tuple, findings.deduplicated(df, ["repository"]).collect())) == {1: 1, 2: 2, 3: 3, 4: 4}

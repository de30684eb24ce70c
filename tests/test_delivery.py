"""Publishing, sources, labels and contradictions on small tables."""

import pytest
from pyspark.sql import functions as F

from patchlake.operators import contradictions, history, publishing
from patchlake.sources import providers

#: file, rule, words, text, line, reason (None: the finding stands).
CLAIMS = [
    ("a.js", "r", "JSON.parse allows remote code execution", "x = JSON.parse(t)", "x", "parsing JSON runs no code"),
    ("a.js", "r", "JSON.parse allows remote code execution", "x = JSON.parse(t); eval(x)", "x", None),
    ("a.js", "r", "password length is not enforced: missing minimum", "if (password.length < 8) no()", "x", "the length of the password is checked"),
    ("a.js", "r", "password length is not enforced: missing minimum", "save(password)", "x", None),
    ("a.ts", "r", "password strength should be checked on login", "x", "x", "a login needs no test of strength"),
    ("a.ts", "r", "port is hardcoded, use the environment", "listen(process.env.PORT || 3000)", "x", "the port has a fallback"),
    ("a.ts", "r", "port is hardcoded, use the environment", "listen(3000)", "x", None),
    ("a.tsx", "r", "useEffect runs on every render", "import x from 'react'\nuseEffect(() => go(), [])", "x", "an effect without dependencies runs once"),
    ("a.tsx", "r", "useMemo is misused", "import x from 'react'\nuseRef()", "x", "useMemo is not in the file"),
    ("a.tsx", "r", "useMemo is misused", "import x from 'react'\nuseMemo(() => 1)", "x", None),
    ("a.js", "r", "unhandled error in async route", "const e = require('express'); go().catch(next)", "x", "the error is passed on"),
    ("src/app.config.ts", "error-handling", "no error handling", "export const c: ApplicationConfig = {}", "x", "the configuration can't fail"),
    ("a.component.ts", "subscription-cleanup", "leak", "constructor(http: HttpClient)", "this.http.get('/x').subscribe(y)", "the request ends by itself"),
    ("a.component.ts", "subscription-cleanup", "leak", "timer", "timer(1).subscribe(y)", None),
    ("a.html", "resource-cleanup", "event listener never removed", "x", '<b (click)="go()">', "the template's own binding ends with it"),
    ("a.ts", "r", "routes are missing", "const routes: Routes = []", "x", "the routes are empty on purpose"),
    ("a.ts", "r", "router provider missing", "providers: [provideRouter(routes)]", "x", "the router is provided"),
    ("package.json", "r", "name does not match the folder", "x", "x", "a name need not be its folder's"),
    ("package.json", "r", "tsc is redundant", '"build": "tsc -b && vite build"', "x", "the build runs the compiler for its references"),
    ("tsconfig.json", "r", "files is empty", '{"files": [], "references": [{"path": "a"}]}', "x", "a solution has no files of its own"),
    ("tsconfig.json", "r", "noEmit stops output", '{"noEmit": true, "moduleResolution": "bundler"}', "x", "the bundler writes the output"),
    ("a.py", "data-validation", "no validation", "x", "    raise ValueError(x)", "raising is validating"),
    ("a.py", "missing-timeout", "no timeout", "c = httpx.Client()", "x", "the client has a timeout of its own"),
    ("a.py", "missing-timeout", "no timeout", "c = httpx.Client(timeout=None)", "x", None),
    ("a.cs", "r", "service may be null", "x", "var service = new Service();", "the instance was just made"),
    ("a.cs", "sql-injection", "r", "x", "await client.GetAsync(url)", "no query is run"),
    ("a.cs", "command-injection", "r", "x", "Process.Start(x)", None),
    ("a.cs", "command-injection", "r", "x", "y = z;", "no process is started"),
    ("tests/ATests.cs", "open-redirect", "r", "x", "x", "a test redirects nobody"),
    ("a.cs", "unsafe-code-execution", "r", "x", "SHA256.HashData(b)", "hashing runs no code"),
    ("a.spec.ts", "null-safety", "r", "await x", "  it('works', () => {", "a declaration of a test shows no defect"),
    ("a.spec.ts", "async-issue", "r", "await x", "await go()", None),
    ("a.spec.ts", "async-issue", "r", "await x", "x = 1", "the line waits for nothing"),
    ("a.spec.ts", "r", "compileComponents is not awaited", "await TestBed.configure().compileComponents()", "x", "compiling is awaited"),
    ("a.spec.ts", "resource-cleanup", "r", "of(1).subscribe()", "of(1).subscribe()", "no source outlives the test"),
    ("a.spec.ts", "resource-cleanup", "r", "interval(1).subscribe()", "x", None),
]


def test_each_contradiction_with_and_without_its_evidence(spark):
    rows = [(i, f"d{i}/{p}", 5, rule, words, None) for i, (p, rule, words, *_) in enumerate(CLAIMS)]
    f = spark.createDataFrame(rows, "seq int, path string, line_number int, rule_id string, issue string, suggestion string")
    files = spark.createDataFrame([(f"d{i}/{c[0]}", c[3]) for i, c in enumerate(CLAIMS)] + [("no", None)], "path string, text string")
    lines = spark.createDataFrame([(f"d{i}/{c[0]}", 5, c[4]) for i, c in enumerate(CLAIMS)], "path string, line_number int, content string")
    got = {r.seq: r.reasons for r in contradictions.contradicted(f, files, lines, ["path"]).collect()}
    for i, c in enumerate(CLAIMS):
        assert (c[5] in got[i]) if c[5] else not got[i], (c, got[i])
    told = f.withColumn("source", F.lit("static"))
    assert all(not r.reasons for r in contradictions.contradicted(told, files, lines, ["path"]).collect())
    assert contradictions.contradicted(f.limit(0), files, lines, ["path"]).count() == 0


def test_sources_by_name():
    assert providers.source(" Tables ").name == providers.source("PARQUET").name == "tables"
    with pytest.raises(ValueError, match="no source"):
        providers.source("nowhere")
    with pytest.raises(NotImplementedError, match="comments"):
        providers.source("tables").ask("comments", None, "")


def test_calls_that_fail_stop_no_others(spark):
    p = spark.createDataFrame([(1, ["a"], "good"), (2, ["b"], "bad"), (3, [], "")], "k int, paths array<string>, prompt string")

    def call(prompt):
        if prompt == "bad":
            raise RuntimeError
        return prompt.upper()

    got = publishing.answers(p, ["k"], call)
    assert {r.k: (r.answer, r.failed) for r in got.collect()} == {1: ("GOOD", 0), 2: (None, 2), 3: ("", 0)}
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b")], "k int, file_path string")
    assert sorted(map(tuple, publishing.owned_answers(rows, p, ["k"]).collect())) == [(1, "a"), (2, "b")]


def test_prefetch_reads_each_once(spark):
    w = spark.createDataFrame([("a", "r"), ("a", "r"), (None, "r"), ("b", "r")], "path string, ref string")
    c = spark.createDataFrame([("a", "r", "t")], "path string, ref string, text string")
    assert sorted(map(tuple, providers.prefetch(w, c, 2).collect())) == [("a", "r", "t"), ("b", "r", None)]


def test_clock_and_days(spark):
    df = spark.createDataFrame([(59.9,), (3600.0,), (7000.0,), (-1.0,), (None,)], "s double")
    assert [r[0] for r in df.select(history.clock(F.col("s"))).collect()] == ["00:59", "60:00", "116:40", None, None]
    d = spark.createDataFrame([("2024-01-01 23:59:59",), ("2024-01-02 00:00:00",), (None,)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    assert history.within(d, "t", "2024-01-01", "2024-01-01").count() == 1 and history.within(d, "t", None, None).count() == 3 and history.within(d, "t", "2024-02-01", "2024-01-01").count() == 0

GATED = {
    "a.py": ("# only remarks\n\"\"\"text\"\"\"", "module of remarks"), "m.py": ("from x import y\nclass A(B):\n    name: str\n    age: int = 3", "passive declaration"), "w.py": ("def f():\n    return go()", None),
    "A.cs": ("using X;\npublic class A\n{\n    public string Name { get; set; }\n}", "passive declaration"), "B.cs": ("public class B {\n  void Go() { Run(); }\n}", None), "A.java": ("package a;\nimport b;\n@Entity\npublic class A {\n  private String name;\n}", "passive declaration"),
    "x/p.csproj": ("<Project>", "configuration alone"), "appsettings.json": ('"Level": "x"', "configuration alone"), "y/appsettings.json": ('"Password": "abc123"', None), "a.css": ("a { color: red; }", "plain styles"), "b.css": ("a { background: url(x); }", None),
    "c.js": ("one = 1\ntwo = 2", "lines covered"), "d.js": ("one = 1\nthree = await x", None), "e.js": ("function go() {\n  one = fetch(x)\n}", "every construct covered"),
}


def test_gates_in_order(spark):
    from patchlake.operators import gates

    rows = [(p, i + 1, x) for p, (t, _) in GATED.items() for i, x in enumerate(t.split("\n"))]
    lines = spark.createDataFrame(rows, "path string, line_number int, content string").withColumn("k", F.col("path"))
    found = spark.createDataFrame([("c.js", 1), ("c.js", 1), ("d.js", 1), ("e.js", 2)], "k string, line_number int")
    texts = spark.createDataFrame([(p, t) for p, (t, _) in GATED.items()] + [("none", None)], "k string, text string")
    spans = gates.spans(texts, ["k"])
    assert {(r.k, r.start, r.end) for r in spans.collect()} == {("B.cs", 2, 2), ("e.js", 1, 3)}
    got = {r.k: r.reason for r in gates.value_gate(lines, found, gates.covered_constructs(spans, found, ["k"]), ["k"]).collect()}
    assert got == {p: reason for p, (_, reason) in GATED.items()}
    deep = gates.value_gate(lines, found, gates.covered_constructs(spans, found, ["k"]), ["k"], "deep")
    assert all(r.reason is None for r in deep.collect())
    fast = {r.k: r.reason for r in gates.value_gate(lines.withColumn("content", F.lit("x = 1")), found.limit(0), gates.covered_constructs(spans, found, ["k"]).limit(0), ["k"], "fast").collect()}
    assert fast["d.js"] == "no signal"


def test_references_between_files(spark):
    from patchlake.operators import crossfile

    rows = [
        ("r", "src/app/a.ts", "import { x } from './b'\nimport y from '../lib/c.js'\nconst z = require('./none')\nselector: 'app-a'\ntemplateUrl: './a.html'\ndocument.getElementById('root'); document.getElementById('gone')"),
        ("r", "src/app/b.ts", None), ("r", "src/lib/c.js", ""), ("r", "src/app/a.html", '<div id="root"><app-a></app-a></div>'), ("s", "src/app/none.ts", "x"),
        ("r", "tests/test_api.py", "from api import app\nimport os"), ("r", "tests/test_both.py", "from api import app\nfrom web import x"),
    ]
    df = spark.createDataFrame(rows, "repository string, path string, text string")
    assert {(r.target, r.exists) for r in crossfile.references(df, ["repository"]).collect()} == {("src/app/b", True), ("src/lib/c.js", True), ("src/app/none", False)}
    assert [(r.target, r.exists) for r in crossfile.templates(df, ["repository"]).collect()] == [("src/app/a.html", True)]
    assert {(r.name, r.exists) for r in crossfile.elements(df, ["repository"]).collect()} == {("root", True), ("gone", False)}
    assert [(r.name, r.component, r.pages) for r in crossfile.selectors(df, ["repository"]).collect()] == [("app-a", "src/app/a.ts", 1)]
    modules = spark.createDataFrame([("r", "api", "fastapi"), ("r", "web", "react"), ("r", "os", "unknown")], "repository string, module string, framework string")
    assert [tuple(r) for r in crossfile.tested_modules(df, modules, ["repository"]).collect()] == [("r", "tests/test_api.py", "fastapi")]
    roots = spark.createDataFrame([("r", "src"), ("r", "src/app"), ("r", "tests")], "repository string, root string")
    kind = F.when(F.col("path").endswith(".ts"), "typescript").otherwise("unknown")
    got = {r.root: (r.files, r.languages, r.framework) for r in crossfile.project_contexts(df, roots, ["repository"], kind, F.when(F.col("path").endswith("a.ts"), "angular").otherwise("unknown")).collect()}
    assert got == {"src": (1, [], "unknown"), "src/app": (3, ["typescript"], "angular"), "tests": (2, [], "unknown")}


def test_claims_that_the_text_refutes(spark):
    from patchlake.operators import proofs

    text = "function load() {\n  return 1;\n}\nfunction save() {\n  let n = 1;\n  use(n);\n}\nconst a = [\n  'x',\n  'y',\n  'x',\n];"
    cases = [(1, 5, "The `load` function leaks", ["outside the callable named"]), (2, 2, "The `load` function leaks", None), (3, 10, "duplicate entry 'y'", ["stands there once"]), (4, 9, "duplicate entry 'x'", None), (5, 6, "`n` is read before it is assigned", ["assigned before it is read"]), (6, 6, "The `other` function", ["names nothing in the file"]), (7, None, "The `load` function", None), (8, 6, "`use` may fail, unlike `nothing`", None)]
    f = spark.createDataFrame([(s, "p", line, c, None) for s, line, c, _ in cases], "seq int, path string, line_number int, issue string, suggestion string")
    files = spark.createDataFrame([("p", text), ("q", None)], "path string, text string")
    assert {r.seq: r.reasons for r in proofs.refuted(f, files, ["path"]).collect()} == {s: r for s, _, _, r in cases if r}

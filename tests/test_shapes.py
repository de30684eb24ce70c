"""Answers, flags, versions, validation, detection and the shape of code on small tables and snippets."""

import json
import random

import pytest
from pyspark.sql import functions as F

from patchlake.operators import detection, diff, responses, syntax, validation

ONE = {"file_path": "a", "line_number": 3, "severity": "HIGH", "rule_id": "r", "message": "m", "suggestion": None}


def test_answers_whole_cut_and_wrong(spark):
    whole = json.dumps({"findings": [ONE] * 5})
    answers = ["```json\n" + whole + "\n```", whole[:-2] + ', {"file_path": "br', json.dumps({"findings": [ONE | {"line_number": 0}, ONE]}), whole[:-1] + " junk", "", None, "no json", '{"findings": []}', json.dumps({"findings": [ONE | {"severity": "x"}]})]
    df = spark.createDataFrame(list(enumerate(answers)), "k int, answer string")
    got: dict = {}
    for r in responses.answered(df, ["k"]).collect():
        got.setdefault(r.k, []).append((r.n, r.severity))
    assert got == {0: [(0, "high"), (1, "high"), (2, "high")], 1: [(0, "high"), (1, "high"), (2, "high")], 2: [(1, "high")]}
    assert responses.answered(df.limit(0), ["k"]).count() == 0


def test_flags_status_versions_and_contents(spark):
    df = spark.createDataFrame([(10, "edit, rename", "^18.2.1", "w7w="), (16, "Delete", "v3", None), (0, "none", "x", "/w==")], "bits int, words string, v string, c string")
    rows = df.select(responses.flags(F.col("bits")), responses.status(responses.flags(F.col("bits"))), responses.flag_words(F.col("words")), responses.version(F.col("v")), responses.decoded("c")).collect()
    assert [tuple(r) for r in rows] == [(["edit", "rename"], "renamed", ["edit", "rename"], [18, 2, 1], "ü"), (["delete"], "removed", ["delete"], [3, 0, 0], ""), ([], "modified", [], None, "�")]


def test_lenient_json(spark):
    text = '{\n  // note\n  "a": [1, 2,], /* x */ "b": {"c": 1,},\n}'
    got = spark.createDataFrame([(text,)], "t string").select(responses.lenient_json(F.col("t"))).first()[0]
    assert json.loads(got) == {"a": [1, 2], "b": {"c": 1}}


def test_made_patches_give_their_added_lines(spark):
    random.seed(1)
    rows = []
    for i in range(20):
        old = [random.choice("abcdef") * 3 for _ in range(random.randint(0, 25))]
        new = [x for x in old if random.random() > 0.2] + ["new"] * random.randint(0, 3)
        rows.append((i, "\n".join(old), "\n".join(new), "p"))
    df = spark.createDataFrame(rows, "file_id int, old string, new string, path string").withColumn("patch", responses.patch_of("old", "new", "path"))
    assert df.where("old = new and patch is not null").count() == 0
    for r in diff.added_lines(df.select("file_id", "new", "patch"), ["file_id", "new"]).collect():
        assert r.new.split("\n")[r.line_number - 1] == r.content


def test_latest_iteration(spark):
    df = spark.createDataFrame([("k", 1, "a", None), ("k", 3, None, "c"), ("k", 2, "b", None)], "k string, iteration int, commit string, source_commit string")
    assert tuple(responses.latest_iteration(df, ["k"]).first()) == ("k", 3, "c")


def test_frameworks_workspace_and_roots(spark):
    files = [("a", "src/x.ts", "import React from 'react'"), ("a", "package.json", None), ("b", "m.py", "+from flask import Flask"), ("b", "manage.py", "+import django"), ("c", "z.txt", "react"), ("d", "apps/one/project.json", None), ("d", "apps/one/src/x.ts", None), ("d", "libs/two/y.ts", None), ("d", "nx.json", None)]
    df = spark.createDataFrame(files, "repository string, path string, patch string")
    assert {r.repository: r.framework for r in detection.frameworks(df, ["repository"]).collect()} == {"a": "react", "b": "django", "c": "unknown", "d": "unknown"}
    assert {r.repository for r in detection.workspace(df, ["repository"]).where("workspace = 'nx'").collect()} == {"d"}
    assert {(r.repository, r.root, r.explicit) for r in detection.project_roots(df, ["repository"]).collect()} == {("d", "apps/one", True), ("d", "libs/two", False), ("a", ".", False), ("b", ".", False), ("c", ".", False)}
    names = spark.createDataFrame([(["flask", "django"],), (["spring", "spring-boot"],), (["react", "flask"],), (["unknown"],), (["vue", "unknown"],)], "n array<string>")
    assert [r[0] for r in names.select(detection.resolved_framework(F.col("n"))).collect()] == ["python-mixed", "spring-boot", "mixed", "unknown", "vue"]


def test_validation_tells_reasons(spark):
    f = spark.createDataFrame([(1, "r", "a.py", 5, "bare-except", "caught all", None), (2, "r", "a.py", 6, "bare-except", "It might fail", None), (3, "r", "a.py", 99, "x", "m", None), (4, "r", "", None, None, None, None), (5, "r", "a.py", 7, "no-console", "m", None)], "seq int, repository string, path string, line_number int, rule_id string, issue string, suggestion string")
    lines = spark.createDataFrame([("r", "a.py", 5, "    except:"), ("r", "a.py", 6, "    # except:"), ("r", "a.py", 7, "x = 1")], "repository string, path string, line_number int, content string")
    got = {r.seq: r.reasons for r in validation.grounded(f, lines, ["repository", "path"], 1).collect()}
    assert got == {1: [], 2: ["speculative", "comment line"], 3: ["not a changed line"], 4: ["no path", "no line", "no rule", "no message", "not a changed line"], 5: ["wrong file type", "no evidence on the line"]}


PYTHON = {
    "def f(a=[]): pass": "mutable-default-argument", "async def f():\n    time.sleep(1)": "async-blocking-operation", "try:\n    a()\nexcept:\n    b()": "bare-except", "try:\n    a()\nexcept ValueError:\n    pass": "empty-catch-block",
    "x is 'a'": "identity-comparison-literal", "asyncio.create_task(f())": "unowned-background-task", "eval(x)": "unsafe-code-execution", "yaml.load(f)": "unsafe-deserialization", "hashlib.md5(b)": "weak-cryptography",
    "run(c, shell=True)": "command-injection", "c.execute(f'select {x}')": "sql-injection", "def f():\n    return 1\n    g()": "unreachable-code",
}
SAFE = ["def f(a=None): pass", "async def f():\n    await asyncio.sleep(1)", "try:\n    a()\nexcept ValueError:\n    b()", "x is None", "t = asyncio.create_task(f())", "retrieval(x)", "yaml.load(f, Loader=yaml.SafeLoader)", "hashlib.sha256(b)", "run(c, shell=False)", "c.execute('select ?', [x])", "def f(:", ""]


@pytest.mark.parametrize("code", PYTHON)
def test_python_shapes(code):
    assert PYTHON[code] in {r for _, r, _ in syntax.python_findings(code)}


@pytest.mark.parametrize("code", SAFE)
def test_python_safe_twins(code):
    assert not list(syntax.python_findings(code))


SCRIPT = {"try { a() } catch (e) { /* x */ }": "empty-catch-block", "const b = JSON.parse(c);": "json-parse-without-error-handling", "for (const x of y) { await z(x) }": "sequential-await-in-loop", "useEffect(() => { window.addEventListener('x', f) }, [])": "effect-cleanup", "setInterval(f, 1)": "setinterval-without-timer-reference", "  return 1;\n  f();": "unreachable-code"}
SCRIPT_SAFE = ["try { a() } catch (e) { log(e) }", "try { b = JSON.parse(c) } catch (e) { log(e) }", "for (const x of y) { z(x) }", "const t = setInterval(f, 1)", "  return 1;\n}", "const s = '{ (';"]


@pytest.mark.parametrize("code", SCRIPT)
def test_script_shapes(code):
    assert SCRIPT[code] in {r for _, r, _ in syntax.script_findings(code)}


@pytest.mark.parametrize("code", SCRIPT_SAFE)
def test_script_safe_twins(code):
    assert not list(syntax.script_findings(code))


def test_brackets_pass_over_strings_and_comments():
    text = "f('(', `)`, /* ) */ \"\\\"(\") // )\n + g(1)"
    assert syntax.matching(text, 1) == text.index(" // )") - 1
    assert syntax.matching("(]", 0) is None and syntax.matching("((", 0) is None


def test_syntax_over_patches(spark):
    patch = "@@ -1,1 +10,4 @@\n     x = 1\n+    try:\n+        f()\n+    except:\n+        g()\n@@ -50 +60 @@\n+def broken(:"
    df = spark.createDataFrame([(1, "a.py", patch), (2, "a.py", None), (3, "a.txt", patch)], "file_id long, path string, patch string")
    assert [tuple(r) for r in syntax.syntax_findings(df).collect()] == [(1, 13, "bare-except", "medium")]
    assert syntax.syntax_findings(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("code", "rule", "safe"),
    [
        ("(root / name).read_text()", "path-traversal", '(root / "a.txt").read_text()'),
        ("user.update(payload)", "mass-assignment", "cache.update(payload)"),
        ('log.info("%s", request.headers["Authorization"])', "sensitive-data-logging", 'log.info("%s", name)'),
        ('api_key: str = "zx81-kq77"', "hardcoded-secret", 'api_key: str = "changeme"'),
    ],
)
def test_python_paths_updates_headers_and_typed_secrets(code, rule, safe):
    assert [x[1] for x in syntax.python_findings(code)] == [rule] and not list(syntax.python_findings(safe))


def test_answers_that_break_off_give_their_whole_objects():
    whole = '{"rule_id": "a", "message": "one } and ] inside \\" quotes"}'
    assert responses.whole_objects('{"findings": [' + whole + ', {"rule_id": "b", "mess') == [whole]
    assert responses.whole_objects('{"findings": [' + whole + ', {"nested": [1, {"x": 2}]}, ') == [whole, '{"nested": [1, {"x": 2}]}']
    for closed in ('{"findings": [' + whole + "], nonsense", '{"findings": [3, ' + whole, '{"findings": ["x", ' + whole, "no array", None, '{"findings": ['):
        assert responses.whole_objects(closed) is None


def test_lenient_json_keeps_strings(spark):
    texts = ['{"a": "src/**/*.ts", "b": "// no"}', '{"a": "src/**/*.ts", /* c */ "b": [1, 2,], // x\n}', None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(responses.lenient_json("t")).collect()]
    assert got[0] == texts[0] and json.loads(got[1]) == {"a": "src/**/*.ts", "b": [1, 2]} and got[2] is None


def test_guesses_and_concepts_are_words(spark):
    df = spark.createDataFrame([("It MAY  fail here.",), ("Maybe fails",), ("unclear whether it runs",), ("mighty words, considered",), ("A hard-coded API key",), (None,)], "t string")
    got = [tuple(r) for r in df.select(validation.says(validation.spoken(F.col("t")), validation.GUESSES), validation.says(validation.spoken(F.col("t")), validation.CONCEPTS["hardcoded-secret"][0])).collect()]
    assert got == [(True, False), (False, False), (True, False), (False, False), (False, True), (False, False)]

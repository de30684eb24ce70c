"""Which changed files a model need not look at, and what lines must show for a model's finding to count."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from patchlake.functions.paths import file_name
from patchlake.operators.classify import meaningful
from patchlake.operators.enrich import COVERED, COVERED_SHORT, SHORT, SIGNAL
from patchlake.operators.validation import says, spoken
from patchlake.runtime import ship_package

#: Names of build and settings files, what keeps them worth a look, what does so for styles, and a large change.
BUILDS = r"(?:\.(?:sln|csproj|fsproj|vbproj)|^(?:directory\.build\.(?:props|targets)|global\.json|pom\.xml|build\.gradle(?:\.kts)?|settings\.gradle(?:\.kts)?|gradle\.properties))$"
SETTINGS = r"^(?:appsettings[\w.]*\.json|launchsettings\.json|web\.config|app\.config|nlog\.config|application[\w-]*\.(?:properties|ya?ml)|logback[\w-]*\.xml)$"
SENSITIVE = r"(?i)(?:password|secret|token)[\"']?\s*[:=]\s*[\"']?[^\s\"']{3,}|credential|(?:api|access|private)[_-]?key|cors|allowed[_-]?origins|csrf|\bssl\b|\btls\b|connectionstrings|signingkey"
STYLE_RISK = r"(?i)url\s*\(|@import|expression\s*\(|behavior\s*:"
SUBSTANTIAL = 40
#: By language, lines that declare without acting; a file of nothing else is passive.
PASSIVE = {
    "python": r"^(?:from\s.*|import\s.*|class\s+\w+.*:|@dataclass\b.*|[\w.]+\s*:\s*[^=]+(?:=\s*(?:None|Field\(.*\)|\d+|True|False|[\"'][^\"']*[\"']))?|\"\"\".*|'''.*|pass|#.*|model_config\s*=.*|__all__\s*=.*)$",
    "csharp": r"^(?:using\s.*;|namespace\s.*|\[[^\]]*\]|(?:public|internal|private|protected|sealed|abstract|partial|static|required|readonly|virtual)\s[^=(]*\{\s*get;.*\}.*|(?:public|internal|sealed|abstract|partial|static)?\s*.*\b(?:class|record|interface|enum|struct)\s+\w+.*|\w+(?:\s*=\s*\d+)?,?|//.*)$",
    "java": r"^(?:package\s.*;|import\s.*;|@\w+(?:\([^)]*\))?|(?:public|private|protected|final|static)\s+[\w<>,\s\[\]?]+;|(?:public|abstract|final)?\s*.*\b(?:class|record|interface|enum)\s+\w+.*|\w+(?:\(\w*\))?[,;]?|//.*|/?\*.*)$",
}
MODULE = r"^(?:\"\"\".*|'''.*|#.*|[^=(){}\[\]:]*)$"
KINDS = {"python": r"\.pyw?$", "csharp": r"\.cs$", "java": r"\.java$"}


def spans(files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys..., start, end): the first and last line of each callable of a text in a brace language."""
    ship_package(files.sparkSession)
    schema = StructType([*(files.schema[k] for k in keys), *_parse_datatype_string("start int, end int").fields])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from patchlake.operators.methods import callables

        for rb in rows:
            owner, out = [], []
            for k, body in enumerate(rb.column(len(keys)).to_pylist()):
                for a, b in callables(body or ""):
                    owner.append(k)
                    out.append((body.count("\n", 0, a) + 1, body.count("\n", 0, b - 1) + 1))
            held = [rb.column(k).take(pa.array(owner, pa.int64())) for k in range(len(keys))]
            lines = [pa.array(c, pa.int32()) for c in zip(*out)] if out else [pa.array([], pa.int32())] * 2
            yield pa.RecordBatch.from_arrays([*held, *lines], schema.names)

    return files.where(F.col(text).contains("{")).select(*keys, text).mapInArrow(run, schema)


def covered_constructs(spans: DataFrame, covered: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., constructs, covered): the callables of each file, and whether a covered line stands in each of them."""
    c = covered.select(*keys, "line_number").distinct()
    hit = spans.join(c, keys, "left").groupBy(*keys, "start", "end").agg(F.coalesce(F.max(F.col("line_number").between(F.col("start"), F.col("end"))), F.lit(False)).alias("hit"))
    return hit.groupBy(*keys).agg(F.count("*").alias("constructs"), F.bool_and("hit").alias("covered"))


def value_gate(lines: DataFrame, found: DataFrame, constructs: DataFrame, keys: list[str], depth: str = "standard", category: Column | None = None) -> DataFrame:
    """(keys..., reason): why a model need not look at a file, null where it must.

    lines: keys..., path, line_number, content of all changed lines; found: (keys..., line_number) of deterministic findings;
    constructs: as covered_constructs gives them. In order: modules of remarks, passive declarations, build and settings files,
    files of which every construct is covered, plain styles, files whose lines are covered and hold no signal, and, at fast
    depth, small files without a signal. At deep depth a model looks at everything.
    """
    hit = found.select(*keys, "line_number").distinct().withColumn("hit", F.lit(1))
    own = lines.where(meaningful(F.col("content"))).join(hit, [*keys, "line_number"], "left").withColumn("bare", F.trim("content"))
    forms = {k: F.bool_and(F.col("bare").rlike(p)) for k, p in PASSIVE.items()}
    n = own.groupBy(*keys, "path").agg(
        F.count("*").alias("n"), F.count("hit").alias("c"), F.max(F.col("content").rlike(SIGNAL)).alias("signal"), F.max(F.col("content").rlike(SENSITIVE)).alias("sensitive"),
        F.max(F.col("content").rlike(STYLE_RISK)).alias("style_risk"), F.bool_and(F.col("bare").rlike(MODULE)).alias("module"), *(c.alias(k) for k, c in forms.items()),
    )
    n = n.join(constructs.withColumnRenamed("covered", "all_covered"), keys, "left")
    low, name = F.lower("path"), F.lower(file_name(F.col("path")))
    passive = F.lit(False)
    for k, ends in KINDS.items():
        passive = passive | (low.rlike(ends) & F.col(k))
    share = F.col("c") / F.col("n")
    saturated = (share >= COVERED) | ((F.col("n") <= SHORT) & (share >= COVERED_SHORT))
    reason = (
        F.when(low.rlike(KINDS["python"]) & F.col("module"), "module of remarks")
        .when(passive, "passive declaration")
        .when(name.rlike(BUILDS) | (name.rlike(SETTINGS) & ~F.col("sensitive")), "configuration alone")
        .when((F.col("constructs") > 0) & F.col("all_covered"), "every construct covered")
        .when(low.rlike(r"\.(?:css|scss|sass|less|styl)$") & ~F.col("style_risk"), "plain styles")
        .when(saturated & ~F.col("signal"), "lines covered")
    )
    if depth == "fast":
        reason = F.coalesce(reason, F.when(~F.col("signal") & (F.col("n") < SUBSTANTIAL), "no signal"))
    return n.select(*keys, (F.lit(None).cast("string") if depth == "deep" else reason).alias("reason"))


# ---- evidence of semantic claims -----------------------------------------------------------------------------------------

#: Phrases that assume; what local settings are about; what a changed line must show for a claim, one of each group.
ASSUMING = ("assume", "assumes", "assuming", "assumption", "probably", "might be", "could be", "should come from", "appears to be", "seems to", "without knowing", "come from a database")
LOCAL = ("empty password", "create drop", "h2", "embedded database", "default password", "debug")
SHOWN = {
    "incorrect-result-handling": (("return", "update", "save", "delete", "create", "result", "success"),),
    "async-blocking-operation": (("time sleep", "thread sleep", "wait", "result", "readfilesync", "execsync"),),
    "missing-timeout": (("get", "post", "put", "patch", "delete", "request", "send"),),
    "authorization": (("if", "unless", "require", "check", "contains", "includes"),),
    "command-injection": (("shell true", "exec", "system", "popen", "check output", "process start"),),
    "unsafe-code-execution": (("eval", "exec", "compile", "function"),),
    "cache-consistency": (("cache", "key", "memo"),),
    "insufficient-test-assertion": (("assert", "expect", "verify", "should"), ("status", "status code", "called", "true", "not none", "not null", "notnull", "istype", "equal")),
    "unsafe-deserialization": (("pickle load", "pickle loads", "dill load", "dill loads", "yaml load"),),
    "weak-cryptography": (("md5", "sha1"),),
    "resource-cleanup": (("open", "clientsession", "response", "stream", "reader", "writer"),),
    "unowned-background-task": (("create task", "run in executor", "submit", "task run", "startnew"),),
    "exception-detail-exposure": (("str error", "str exception", "str exc", "str e", "message", "stacktrace"),),
}


def semantic_reasons(findings: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """(seq, reasons): why a model's finding has no semantic evidence: it assumes, it is about local settings, or its line shows nothing."""
    at = lines.groupBy(*keys, "line_number").agg(F.min("content").alias("content"))
    own = findings.join(at, [*keys, "line_number"], "left")
    said, shown = spoken(F.concat_ws(" ", "issue", "suggestion")), spoken(F.col("content"))
    local = F.lower("path").rlike(r"\.(?:properties|ya?ml|env)$") & says(said, LOCAL)
    asked, holds = F.lit(False), F.lit(True)
    for rule, groups in SHOWN.items():
        every = F.lit(True)
        for words in groups:
            every = every & says(shown, words)
        asked = asked | (F.col("rule_id") == rule)
        holds = F.when(F.col("rule_id") == rule, every).otherwise(holds)
    no_line = F.coalesce(asked, F.lit(False)) & F.col("content").isNull()
    reasons = F.array(
        F.when(says(said, ASSUMING), "assumes"), F.when(local, "local settings"), F.when(no_line, "no changed line"), F.when(F.col("content").isNotNull() & ~F.coalesce(holds, F.lit(True)), "line shows nothing of it")
    )
    return own.select("seq", F.array_compact(reasons).alias("reasons"))

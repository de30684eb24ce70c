"""Findings of a model that the source itself contradicts.

Each check is a row: the files it knows, the rules or words by which a finding makes the claim, and what the file, the line or the
lines around it must show, or must lack, for the claim to be false. Checks only reject; none makes a finding.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlake.operators.findings import AUTHORITATIVE

#: Lines before and after a finding's own that count as near.
BEFORE, AFTER = 8, 3
SCRIPT, TEST = r"\.(?:js|jsx|mjs|cjs|ts|tsx)$", r"(?:\.(?:spec|test)\.[jt]sx?$|(?:^|/)tests?/|tests?\.cs$)"


@dataclass(frozen=True)
class Check:
    reason: str
    files: str
    #: Groups of words; of each group the finding's rule and texts hold one.
    claim: tuple[tuple[str, ...], ...] = ()
    #: The finding's rule is one of these.
    rules: tuple[str, ...] = ()
    #: None of these words is said.
    unsaid: tuple[str, ...] = ()
    #: What must be there: patterns by place (text of the file, line, near); and what must not.
    shows: tuple[tuple[str, str], ...] = ()
    lacks: tuple[tuple[str, str], ...] = ()


#: Words and patterns by which claims and facts are known.
_ASYNC = r"\b(?:await|async|Promise|subscribe|firstValueFrom|lastValueFrom|whenStable|fakeAsync|tick|flush|setTimeout|setInterval|Observable)\b"
_CLEANUP = ("subscription-cleanup", "resource-cleanup", "memory-leak")
CHECKS = (
    Check("parsing JSON runs no code", SCRIPT, (("json.parse", "json-pars", "json_parse"), ("code execution", "execute arbitrary", "rce")), shows=(("text", r"(?i)json\.parse"),), lacks=(("text", r"\b(?:eval|Function)\s*\("),)),
    Check("the length of the password is checked", SCRIPT, (("password",), ("length", "minimum", "too short", "short password"), ("missing", "does not", "doesn't", "no check", "not validate", "not enforce", "without")),
          shows=(("text", r"(?i)\b(?:password|pwd|pass)\w*\s*\.\s*length\s*[<>=!]=?=?\s*\d|\d\s*[<>]=?\s*(?:password|pwd|pass)\w*\s*\.\s*length\b"),)),
    Check("a login needs no test of strength", SCRIPT, (("password",), ("strength",), ("login",), ("missing", "verification", "validat", "meter", "check", "should")), unsaid=("regist", "sign up", "signup", "create account", "change password", "reset password")),
    Check("the strength of the password is rated", SCRIPT, (("password",), ("strength",), ("missing", "verification", "validat", "meter", "check", "should")), unsaid=("login",), shows=(("text", r"\.length\s*[<>]=?\s*\d"), ("text", r"(?i)strength|weak|\[0-9\]|\\d"))),
    Check("the port has a fallback", SCRIPT, (("port",), ("environment", "hardcoded", "config")), shows=(("text", r"process\.env\.PORT\s*(?:\|\||\?\?)\s*\d"),)),
    Check("an effect without dependencies runs once", SCRIPT, (("useeffect", "use effect"), ("every render", "each render")), shows=(("text", r"(?is)useEffect\s*\(.*?,\s*\[\s*\]\s*\)"),)),
    *(Check(f"{hook} is not in the file", SCRIPT, ((hook.lower(),),), shows=(("text", r"(?i)from\s+['\"]react['\"]|\breact\b"),), lacks=(("text", rf"(?i)\b{hook}\s*\("),)) for hook in ("useEffect", "useLayoutEffect", "useState", "useMemo", "useCallback", "useRef")),
    Check("the error is passed on", SCRIPT, (("next(", "error middleware", "pass the error", "propagat", "unhandled"), ("async", "route", "handler", "promise", "express")), shows=(("text", r"(?i)\brequire\(['\"]express['\"]\)|from ['\"]express['\"]|\brouter\.\w+\("), ("text", r"\.catch\s*\(\s*next\s*\)"))),
    Check("the configuration can't fail", r"(?:^|/)app\.config\.ts$", (("error-handling", "exception-handling", "applicationconfig"), ("error", "exception")), shows=(("text", "ApplicationConfig"),), lacks=(("text", r"(?i)\b(?:throw|catch|promise|subscribe|http)\b"),)),
    Check("the request ends by itself", r"\.ts$", rules=_CLEANUP, shows=(("text", r"\bHttpClient\b"), ("near", r"\.(?:get|post|put|patch|delete)\s*[<(]"), ("near", r"\.subscribe\s*\("))),
    Check("the template's own binding ends with it", r"\.html?$", (("listener", "event handler"),), rules=_CLEANUP, shows=(("line", r"\(\w[\w.-]*\)\s*="),)),
    Check("the routes are empty on purpose", r"\.ts$", (("route",), ("empty", "no routes", "missing")), shows=(("text", r"\broutes\b[^=\n]*=\s*\[\s*\]"),)),
    Check("the router is provided", r"\.ts$", (("router",), ("provide", "missing", "not configured")), shows=(("text", r"(?s)providers\s*:\s*\[.*?\bprovideRouter\s*\("),)),
    Check("router features are optional", r"\.ts$", (("preload", "scroll position", "component input", "view transition"), ("missing", "should", "without")), shows=(("text", r"\bprovideRouter\s*\("),)),
    Check("a name need not be its folder's", r"(?:^|/)(?:package|angular)\.json$", (("name",), ("folder", "directory"), ("match", "differ", "inconsistent", "mismatch"))),
    Check("the build runs the compiler for its references", r"(?:^|/)package\.json$", (("tsc",), ("redundant", "unnecessary", "duplicate")), shows=(("text", r"tsc\s+-b\b.*\bvite\s+build\b"),)),
    Check("a solution has no files of its own", r"(?:^|/)tsconfig[\w.-]*\.json$", (("files",), ("empty",)), shows=(("text", r"\"files\"\s*:\s*\[\s*\]"), ("text", r"\"references\"\s*:\s*\[\s*\{"))),
    Check("the options are there or referenced", r"(?:^|/)tsconfig[\w.-]*\.json$", (("compileroptions", "compiler options"), ("missing", "absent", "no ", "lacks")), shows=(("text", r"\"(?:compilerOptions\"\s*:\s*\{|references\"\s*:\s*\[\s*\{)"),)),
    Check("the configuration isn't empty", r"(?:^|/)tsconfig[\w.-]*\.json$", (("configuration is empty", "config is empty", "empty tsconfig", "empty configuration"),), shows=(("text", r"\"[^\"\s]+\"\s*:"),)),
    Check("the bundler writes the output", r"(?:^|/)tsconfig[\w.-]*\.json$", (("noemit", "no emit", "not emit"),), shows=(("text", r"\"noEmit\"\s*:\s*true"), ("text", r"(?i)vite|bundler"))),
    Check("raising is validating", r"\.pyw?$", rules=("data-validation",), shows=(("line", r"\braise\s+(?:ValueError|TypeError|ValidationError)\b"),)),
    Check("the client has a timeout of its own", r"\.pyw?$", rules=("missing-timeout",), shows=(("text", r"\bhttpx\.(?:AsyncClient|Client)\s*\("),), lacks=(("text", r"(?s)\bhttpx\.(?:AsyncClient|Client)\s*\([^)]*timeout\s*=\s*None"),)),
    Check("the instance was just made", r"\.cs$", (("may be null", "might be null", "could be null", "potentially null", "potentially be null"), ("service",)), shows=(("near", r"\bvar\s+service\s*=\s*new\s+"),)),
    Check("the list is never null", r"\.cs$", (("may be null", "might be null", "could be null", "potentially null", "potentially be null"),), shows=(("near", r"\bvar\s+\w+\s*=\s*await\s+[^;]*\.ToListAsync\s*\("),)),
    Check("no query is run", r"\.cs$", (("sql injection", "sql-injection"),), shows=(("near", r"(?i)httpclient|getasync|getstringasync"),), lacks=(("near", r"(?i)select|insert|update|delete|fromsql|executesql"),)),
    Check("no process is started", r"\.cs$", (("command injection", "command-injection"),), lacks=(("near", r"(?i)process|cmd|powershell"),)),
    Check("a test redirects nobody", r"(?:(?:^|/)tests/.*\.cs|tests?\.cs)$", (("open redirect", "open-redirect"),)),
    Check("hashing runs no code", r"\.cs$", (("code execution", "unsafe-code-execution"),), shows=(("near", r"(?i)hash|md5|sha"),)),
    Check("a declaration of a test shows no defect", TEST, rules=("null-safety", "async-issue", "error-handling"), shows=(("line", r"^\s*(?:it|test|describe)\s*\("),)),
    Check("an assertion shows no missing handling", TEST, rules=("error-handling",), shows=(("line", r"\bexpect\s*\("),)),
    Check("the line waits for nothing", TEST, rules=("async-issue",), lacks=(("line", _ASYNC),)),
    Check("nothing in the file waits", TEST, (("async", "await", "promise"), ("wait", "missing", "not awaited")), lacks=(("text", _ASYNC),)),
    Check("the test asserts on what it selects", TEST, rules=("insufficient-test-assertion", "test-quality"), shows=(("text", r"\b(?:expect|assert)\w*\s*\("), ("text", r"(?i)querySelector|getBy\w+\(|By\.css\(|screen\.")),),
    Check("compiling is awaited", TEST, (("compilecomponents",),), shows=(("text", r"(?s)\bawait\s+TestBed.*?\.compileComponents\s*\("),)),
    Check("the suggested call is deprecated", TEST, (("topromise",),)),
    Check("flushing is synchronous", TEST, (("await",), ("flush",)), shows=(("text", "httpMock"),)),
    Check("no source outlives the test", TEST, rules=_CLEANUP[:2], lacks=(("text", r"\b(?:interval|timer|fromEvent|Subject|BehaviorSubject|ReplaySubject|WebSocket)\s*\("),)),
)


def _false(check: Check) -> Column:
    said = F.col("said")
    out = F.lower("path").rlike(check.files)
    for words in check.claim:
        one = F.lit(False)
        for w in words:
            one = one | said.contains(w)
        out = out & one
    if check.rules:
        out = out & F.col("rule_id").isin(*check.rules)
    for w in check.unsaid:
        out = out & ~said.contains(w)
    for place, pattern in check.shows:
        out = out & F.col(place).rlike(pattern)
    for place, pattern in check.lacks:
        out = out & ~F.col(place).rlike(pattern)
    return F.when(F.coalesce(out, F.lit(False)), check.reason)


def contradicted(findings: DataFrame, files: DataFrame, lines: DataFrame, keys: list[str], checks: tuple[Check, ...] = CHECKS) -> DataFrame:
    """(seq, reasons) of every finding: why the source contradicts it, none for one that it doesn't.

    files: keys..., text; lines: keys..., line_number, content. A finding of an authoritative source (where findings have one) is
    never contradicted. A file without text shows nothing, and what it lacks can't be told. Lines near a finding are met by
    equality of their numbers.
    """
    said = F.lower(F.concat_ws(" ", "rule_id", "issue", "suggestion"))
    own = findings.withColumn("said", said)
    bypass = F.col("source").isin(*AUTHORITATIVE) if "source" in findings.columns else F.lit(False)
    at = F.explode(F.sequence(F.col("line_number") - BEFORE, F.col("line_number") + AFTER))
    around = own.where("line_number is not null").select("seq", *keys, "line_number", at.alias("at"))
    l = lines.select(*keys, F.col("line_number").alias("at"), "content")
    near = around.join(l, [*keys, "at"]).groupBy("seq").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "content"))), lambda x: x["content"]), "\n").alias("near"),
        F.max(F.when(F.col("at") == F.col("line_number"), F.col("content"))).alias("line"),
    )
    texts = files.where("text is not null").groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("text")), "\n").alias("text"))
    met = own.join(texts, keys, "left").join(near, "seq", "left")
    reasons = F.array_compact(F.array(*(_false(c) for c in checks)))
    return met.select("seq", F.when(F.coalesce(bypass, F.lit(False)), F.array().cast("array<string>")).otherwise(reasons).alias("reasons"))

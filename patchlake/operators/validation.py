"""Reasons to reject a finding, as an array column: what is missing, made up, guessed, or contradicted by the line it names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlake.functions.paths import strip, suffix

#: Words that guess alone, and those that guess before or after others.
GUESSING = ("might", "possibly", "perhaps", "potentially", "consider")
AFTER_MAY = ("be", "not", "throw", "fail", "cause", "lead to", "result in")
SEEMING, DOUBTFUL = ("appears to", "seems to", "could be"), ("not clear", "unclear", "not obvious")
GUESSES = (*GUESSING, *(f"may {x}" for x in AFTER_MAY), *SEEMING, *(f"{x} {y}" for x in DOUBTFUL for y in ("if", "whether")))


def spoken(text: Column) -> Column:
    """A text as its words in lower case between single blanks, for phrases to be looked up in."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")), F.lit(" "))


def says(words: Column, phrases) -> Column:
    """Whether spoken words hold one of the phrases."""
    out = F.lit(False)
    for p in phrases:
        out = out | words.contains(f" {p} ")
    return out


#: Rule ids that are a template's.
PLACEHOLDERS = "rule-id rule_id your-rule-id unknown none n/a example-rule rule todo-rule undefined null".split()
#: Kinds of rules that only some files can break, by a part of the rule's name.
ONLY_IN = {r"^(?:css|font|selector|stylesheet)-": ".css .scss .sass .less .styl", r"^(?:html|aria|alt-text|label)-": ".html .htm .hbs .ejs .jinja .jinja2 .twig .vue .cshtml .jsx .tsx", r"^(?:eqeqeq|loose-equality|no-console|debugger|unsafe-inner-html|explicit-any)$": ".js .jsx .mjs .cjs .ts .tsx .vue .svelte"}
#: What the line of a finding of a rule must show.
EVIDENCE = {
    "no-console": r"\bconsole\s*\.",
    "debugger": r"\bdebugger\b",
    "loose-equality": r"[^=!]==[^=]|!=[^=]",
    "bare-except": r"\bexcept\s*:",
    "unsafe-inner-html": r"innerHTML",
    "hardcoded-secret": r"[:=(,]\s*[\"'`]",
    "embedded-credential": r"[\"'`]",
    "weak-cryptography": r"(?i)\b(?:md5|sha1)\b",
    "command-injection": r"(?i)\b(?:exec|system|popen|subprocess|shell)\b",
    "sql-injection": r"(?i)\b(?:select|insert|update|delete|execute|query|raw)\b",
}


def structural(f: DataFrame) -> Column:
    """Reasons in the finding itself."""
    blank = lambda c: F.length(F.coalesce(strip(c), F.lit(""))) == 0
    text = F.concat_ws(" ", "issue", "suggestion")
    wrong = F.lit(False)
    for pattern, ends in ONLY_IN.items():
        wrong = wrong | (F.col("rule_id").rlike(pattern) & ~suffix(F.col("path")).isin(ends.split()))
    cases = [
        ("no path", blank("path")),
        ("no line", F.coalesce(F.col("line_number") <= 0, F.lit(True))),
        ("no rule", blank("rule_id")),
        ("no message", blank("issue")),
        ("placeholder rule", F.col("rule_id").isin(PLACEHOLDERS)),
        ("speculative", says(spoken(text), GUESSES)),
        ("wrong file type", wrong),
    ]
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), r) for r, c in cases)))


def grounded(f: DataFrame, lines: DataFrame, keys: list[str], around: int = 3) -> DataFrame:
    """(seq, reasons): structural reasons, then those that the named line and its neighbours give.

    Lines within around of a finding are met by equality of numbers, so that no file meets itself line by line.
    """
    own = f.withColumn("reasons", structural(f))
    near = own.select("seq", *keys, "rule_id", "line_number", F.explode(F.sequence(F.col("line_number") - around, F.col("line_number") + around)).alias("at")).where("line_number is not null")
    l = lines.select(*keys, F.col("line_number").alias("at"), "content")
    shows = F.lit(True)
    for rule, pattern in EVIDENCE.items():
        shows = F.when(F.col("rule_id") == rule, F.col("content").rlike(pattern)).otherwise(shows)
    seen = near.join(l, [*keys, "at"]).groupBy("seq").agg(
        F.max((F.col("at") == F.col("line_number")).cast("int")).alias("on_line"),
        F.max(F.when(F.col("at") == F.col("line_number"), strip("content").rlike(r"^(?:#|//|/\*|\*|<!--)").cast("int"))).alias("comment"),
        F.max(shows.cast("int")).alias("shows"),
    )
    extra = F.array_compact(
        F.array(
            F.when(F.coalesce("on_line", F.lit(0)) == 0, "not a changed line"),
            F.when(F.col("comment") == 1, "comment line"),
            F.when((F.col("on_line") == 1) & (F.col("shows") == 0), "no evidence on the line"),
        )
    )
    return own.join(seen, "seq", "left").select("seq", F.concat("reasons", extra).alias("reasons"))


def _each(*lists) -> tuple[str, ...]:
    """All phrases of one word of each list."""
    out = [""]
    for some in lists:
        out = [f"{x} {y}".strip() for x in out for y in some]
    return tuple(out)


#: What tells of the root cause of a rule: one phrase of each group of phrases.
CONCEPTS = {
    "hardcoded-secret": (_each(("hardcoded", "hard coded"), ("secret", "credential", "password", "token", "api key", "apikey")) + _each(("embedded", "exposed"), ("secret", "credential")),),
    "loose-equality": (("loose equal", "loose equality", "strict equal", "strict equality", "type coercion") + _each(("nonstrict", "non strict"), ("equality", "comparison")),),
    "no-console": (_each(("console",), ("log", "logging", "debug", "info", "warn", "error")),),
    "unused-variable": (_each(("unused",), ("variable", "value", "constant", "local")) + ("declared but never used",),),
    "sql-injection": (("sql injection",) + _each(("interpolated", "dynamic", "concatenated"), ("sql",)),),
    "path-traversal": (("path traversal", "directory traversal", "file path"), ("path traversal", "directory traversal", "escape", "root", "unvalidated")),
    "weak-cryptography": (_each(("weak", "broken", "insecure"), ("hash", "cryptography", "crypto")) + ("md5", "sha1"),),
    "resource-cleanup": (_each(("resource", "file", "session", "response"), ("leak",)) + ("unclosed", "not closed", "without closing", "without being closed"),),
}


def root_causes(pairs: DataFrame, ai: DataFrame) -> DataFrame:
    """(l_seq, r_seq) of near pairs where the model's text tells of the root cause of the authoritative rule, canonical."""
    text = spoken(F.concat_ws(" ", "rule_id", "issue", "impact", "evidence", "suggestion"))
    told = ai.select(F.col("seq").alias("l_seq"), text.alias("text"))
    hit = F.lit(False)
    for rule, groups in CONCEPTS.items():
        every = F.lit(True)
        for phrases in groups:
            every = every & says(F.col("text"), phrases)
        hit = F.when(F.col("canonical") == rule, every).otherwise(hit)
    return pairs.join(told, "l_seq").where(hit).select("l_seq", "r_seq")

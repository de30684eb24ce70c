"""Template residue, filler and error-page text in findings.

Method: the sentences of each record are normalised and counted by host (the repository, where records have no other); a
sentence that stands in at least SHARE of a host's records, and in LEAST of them, is boilerplate of the host and is subtracted;
a record is excluded when what remains holds evidence of an unfilled placeholder, filler, an unfinished stub, an unrendered
value, or an error, login, script or robot-check page. Evidence that a sentence of the finding itself quotes or discusses (in
code quotes, or as the subject of a longer sentence about the code) is none.

Scale: one pass over the texts. From the parse tree of each pattern comes a set of literals of which a match must hold one; only
a field that holds one is cut into sentences. A sentence without evidence changes nothing whether it is subtracted or not, so
that the counting by host, after the pass, is pushed down to the sentences with evidence; the number of a host's records is
counted over all of them.

Defined results: null and blank fields hold no evidence; a manifest_id delivered again counts once (equal copies; where copies
differ, any with evidence counts); null hosts are one host; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as sre
from re import _parser

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlake.runtime import materialize, ship_package

FIELDS = ("rule", "issue", "suggestion")
SHARE, LEAST = 0.2, 25

#: Code in quotes is what a finding speaks of; it is blanked before evidence is looked for.
QUOTED = re.compile(r"`[^`\n]*`|\*\*[^*\n]+\*\*")
#: Words that begin a sentence even where the one before it has no stop.
STARTS = (
    r"TODO|FIXME|TBD|Please|You|Your|This|The|That|I'm|We|It|An|Sorry|Error|Access|Page|Session|Sign|Log|Login|Too|Checking|Confirm|Verify|Enable|Turn|Loading|Sample|Lorem|None|Null|NaN|undefined|asdf"
    r"|\[[A-Z]|<html|<!DOCTYPE|[45]\d\d|%s|\[object"
)
SENTENCE_END = re.compile(r"(?<=[.!?;])\s+|\s*[\r\n]+\s*|\s+-\s+(?=\S)|(?<=[^\s,:(\"'])\s+(?=(?:" + STARTS + r")\b)")

#: Words of filler text.
LATIN = "lorem|ipsum|dolor|sit|amet|elit|massa|augue|porta|quis|sodales|velit|vitae|tempor|semper|magna|nulla|ligula|pretium|rutrum|sed|eiusmod|incididunt|labore|aliqua|enim|minim|veniam|nostrud|consectetur|adipiscing"
#: Evidence by kind, as patterns over a sentence without quoted code.
EVIDENCE = {
    "placeholder": (
        r"\{\{\s*[\w.| ]+\s*\}\}|\{%-?\s*\w+[^%]*%\}|[$#]\{\s*[\w.]+\s*\}|\[\[\s*[\w. ]+\s*\]\]|<%=?[^%]*%>|%\(\w+\)[sd]",
        r"\b[Ii](?:nsert|NSERT) [A-Z]{2,}(?: [A-Z]{2,})* (?:here|HERE)\b",
        r"(?i)\[(?:describe|insert|add|enter|explain|write|your|fill in|placeholder|todo|tbd)\b[^\]]*\]",
        r"(?i)<(?:insert|describe|your|enter|rule|issue|suggestion|message|file|line|name|placeholder|title|text)(?:[ _-][\w -]*)?>",
        r"(?i)\byour (?:\w+ )?(?:suggestion|issue|text|message|finding|description|answer|explanation|recommendation|comment|content|advice|summary) (?:goes )?here\b",
        r"(?i)\b(?:placeholder|sample|dummy) text\b(?! (?:attribute|field|of|in|for|is|that))",
    ),
    "filler": (
        r"(?i)\b(?:lorem ipsum dolor|ipsum dolor sit|dolor sit amet|consectetur adipiscing)\b",
        r"(?i)\b(?:asdf|qwerty\s+qwerty|blah\s+blah|foo\s+bar\s+baz|test\s+test\s+test|xxx\s+xxx)\b",
        rf"(?i)\b(?:{LATIN})(?:\W+(?:{LATIN})){{3}}\b",
    ),
    "stub": (
        r"(?i)^\W*(?:todo|tbd|fixme|xxx)\b\W*(?:$|(?:write|add|fill|describe|explain|complete|insert|replace|finish|provide)\b)",
        r"(?i)\breplace (?:this )?before (?:release|publishing|merge)\b",
        r"(?i)\b(?:to be (?:written|completed|filled in)|coming soon|work in progress)\W*$",
        r"(?i)^\W*(?:write|answer) (?:your|the) (?:answer|finding|review) (?:here|below)\b",
    ),
    "unrendered": (
        r"(?i)\[object object\]",
        r"(?:^|\W)undefined: undefined\b|\bat line (?:NaN|%d|undefined|null|None)\b",
        r"^\W*(?:None|undefined|null|NaN) (?:was|is|should|has|in)\b|\b(?:None|undefined|NaN) (?:in|with|at|of) (?:None|undefined|NaN)\b",
        r"^\W*%[sd]\b|%[sd]\b[^\"']*%[sd]\b[^\"']*%[sd]\b|\{[0-9]\}[^{}]*\{[0-9]\}",
    ),
    "error page": (
        r"(?i)<html\b|<!doctype html|<title>[^<]*</title>|</body>",
        r"(?i)^\W*(?:error )?[45]\d\d\b[\s:-]*(?:page not found|not found|bad gateway|gateway time-?out|service (?:temporarily )?unavailable|internal server error|forbidden|unauthorized|proxy error|request timeout|too many requests)",
        r"(?i)\b[45]\d\d (?:bad gateway|gateway time-?out|service (?:temporarily )?unavailable|internal server error|not found|forbidden)\b[\s-]*(?:nginx|apache|please try|the server|$)",
        r"(?i)^\W*(?:page not found|access denied|internal server error|proxy error|request timeout|service unavailable|bad gateway|gateway time-?out|forbidden|unauthorized)\W*$",
        r"(?i)^\W*the (?:page|resource|document|url) you (?:asked|requested|are looking|were looking)\b",
        r"(?i)^\W*(?:the )?(?:upstream|origin|remote|proxy|web)? ?server (?:did not|didn't|does not|failed to|could not|took too long)\b",
        r"(?i)\bcould not be loaded\W+\(?error code|^\W*\(?error code: \w+\)?\W*$",
        r"(?i)\bi'?m sorry, (?:the|but|i) (?:model response|can(?:'|no)t|am unable|response)|^\W*as an ai (?:language )?model\b",
        r"(?i)^\W*too many requests\b|^\W*(?:an|the) (?:unexpected|internal|unknown) error (?:has )?occurred\b|^\W*something went wrong\b",
    ),
    "login page": (
        r"(?i)^\W*(?:please )?(?:sign|log) in(?: again)? to (?:see|view|continue|read|open|access)\b|^\W*(?:your session has expired|session expired)\b",
        r"(?i)^\W*you (?:do not|don't) have permission to (?:open|view|see|access)\b|^\W*you (?:must|need to) (?:be (?:logged|signed) in|(?:log|sign) in)\b",
    ),
    "script page": (
        r"(?i)^\W*(?:please )?(?:enable|turn on|switch on|activate|allow) (?:java)?scripts?\b|^\W*you (?:need|have|must)(?: to)? (?:turn on|enable|activate|switch on|allow) (?:java)?scripts?\b",
        r"(?i)^\W*(?:this|the) (?:page|site|app|application|report) (?:does not|doesn't|will not|cannot) (?:work|run|load|be shown) without (?:java)?scripts?\b",
        r"(?i)^\W*(?:java)?scripts? (?:is|are) (?:required|disabled|needed|not enabled)\b|^\W*this (?:page|site|app) (?:requires|needs) (?:java)?scripts?\b",
    ),
    "robot check": (
        r"(?i)^\W*(?:please )?(?:confirm|verify|prove|check) (?:that )?you are (?:not a robot|(?:a )?human)\b|^\W*checking your browser\b",
        r"(?i)^\W*(?:are you a robot|i am not a robot|complete the captcha|unusual traffic)\b",
    ),
}

#: Rules that are a template's own name.
RULE_RESIDUE = re.compile(
    r"(?i)^\s*(?:todo(?:[-_ ]rule)?|tbd|fixme|n/?a|none|null|nan|undefined|unknown[-_ ]rule|your[-_ ]rule(?:[-_ ](?:id|name))?(?:[-_ ]here)?"
    r"|rule[-_ ](?:id|name)(?:[-_ ]here)?|insert[-_ ]rule(?:[-_ ]here)?|example[-_ ]rule|placeholder(?:[-_ ]rule)?|sample[-_ ]rule|<[^>]*>|[$#]\{[^}]*\}|\{\{[^}]*\}\}|\[\[?[^\]]*\]\]?|\{%.*%\}|%s|xxx+|test|asdf)\s*$"
)
COMPILED = {kind: [re.compile(p) for p in patterns] for kind, patterns in EVIDENCE.items()}


def needed(pattern: str) -> list[tuple[str, ...]]:
    """Sets of literals in lower case, of each of which every match of the pattern holds one; the most telling first."""

    def best(sets: list[set[str]]) -> set[str]:
        return max(sets, key=lambda x: (min(map(len, x)), -len(x)), default=set())

    def of(tree) -> list[set[str]]:
        sets: list[set[str]] = []
        run = ""
        for op, arg in [*tree, (sre.ANY, None)]:
            if op is sre.LITERAL:
                run += chr(arg).lower()
                continue
            if op is sre.AT:
                continue
            if run:
                sets.append({run})
            run = ""
            if op is sre.SUBPATTERN:
                sets += of(arg[3])
            elif op is sre.BRANCH:
                every = [best(of(x)) for x in arg[1]]
                sets += [set().union(*every)] if all(every) else []
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                sets += of(arg[2])
            elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
                sets.append({chr(c).lower() for _, c in arg})
        return sets

    every = of(_parser.parse(pattern))
    return [tuple(sorted(x)) for x in sorted(every, key=lambda x: (-min(map(len, x)), len(x)))]


#: Of each pattern in turn: its kind, itself, and the sets of literals it needs.
RULES = [(kind, p, [frozenset(x) for x in dict.fromkeys(needed(p.pattern))]) for kind, patterns in COMPILED.items() for p in patterns]


def _literals() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for x in sorted({x for _, _, sets in RULES for some in sets for x in some}):
        a.add_word(x, x)
    a.make_automaton()
    return a


LITERALS = _literals()


def evident(field: str, text: str | None) -> list[tuple[str, str]]:
    """(kind, sentence) of the sentences of a field that hold evidence, each with the first kind it shows."""
    if not text or text.isspace():
        return []
    if field == "rule" and RULE_RESIDUE.match(text):
        return [("placeholder", text.strip())]
    held = {x for _, x in LITERALS.iter(text.lower())}
    tried = [(kind, p) for kind, p, sets in RULES if not any(map(held.isdisjoint, sets))] if held else []
    if not tried:
        return []
    whole = [text] if field == "rule" else SENTENCE_END.split(QUOTED.sub("\x01", text))
    out = []
    for s in filter(None, map(str.strip, whole)):
        kind = next((kind for kind, p in tried if p.search(s)), None)
        if kind:
            out.append((kind, s))
    return out


def normal(sentence: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"\d+", "0", sentence.lower())).strip()


def evidence(findings: DataFrame, host: str = "repository") -> DataFrame:
    """(manifest_id, host, field, kind, sentence, line): every sentence with evidence, boilerplate or not."""
    ship_package(findings.sparkSession)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            out = []
            for i, h, *texts in zip(*(c.to_pylist() for c in rb.columns)):
                for field, text in zip(FIELDS, texts):
                    out += [(i, h, field, kind, s, normal(s)) for kind, s in evident(field, text)]
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:])], ["manifest_id", "host", "field", "kind", "sentence", "line"])

    own = findings.select(F.col("manifest_id").cast("long"), F.col(host).cast("string"), *(F.col(f).cast("string") for f in FIELDS))
    return own.mapInArrow(run, "manifest_id long, host string, field string, kind string, sentence string, line string")


def boilerplate(some: DataFrame, findings: DataFrame, host: str = "repository") -> DataFrame:
    """(host, line): of the lines of some, those that recur through the records of their host."""
    lines = some.where("field <> 'rule'").groupBy("host", "line").agg(F.countDistinct("manifest_id").alias("n")).where(F.col("n") >= LEAST)
    total = findings.groupBy(F.col(host).cast("string").alias("t_host")).agg(F.countDistinct("manifest_id").alias("records"))
    return lines.join(total, F.expr("host <=> t_host")).where(F.col("n") >= SHARE * F.col("records")).select("host", "line")


def residue(findings: DataFrame, host: str = "repository") -> DataFrame:
    """(manifest_id, field, kind, sentence): the evidence left in each record when the boilerplate of its host is subtracted."""
    some = materialize(evidence(findings, host), "evident")
    plates = boilerplate(some, findings, host).select(F.col("host").alias("b_host"), F.col("line").alias("b_line"))
    return some.join(plates, F.expr("host <=> b_host and line = b_line and field <> 'rule'"), "left_anti").select("manifest_id", "field", "kind", "sentence")


def found(findings: DataFrame, host: str = "repository") -> DataFrame:
    """(manifest_id) of the records with residue."""
    return residue(findings, host).select("manifest_id").where("manifest_id is not null").distinct()

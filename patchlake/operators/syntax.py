"""Rules that need the shape of code: Python by its syntax tree, brace languages by a matcher of balanced brackets.

Both run over Arrow batches of whole texts. A text that doesn't parse gives nothing. One matcher serves all brace languages:
strings, templates, comments and, where asked, regular expressions are passed over.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlake.runtime import ship_package

SCHEMA = "file_id long, line_number int, rule_id string, severity string"
PAIRS = {"(": ")", "[": "]", "{": "}"}
#: Names of annotated secrets, and values that stand for a secret without being one.
SECRET_NAME = re.compile("password|passwd|pwd|secret|apikey|accesskey|token|privatekey")
STAND_INS = "changeme change-me example placeholder secret password token your-secret your-token todo".split()


def matching(text: str, at: int) -> int | None:
    """The place of the bracket that closes the one at a place; null where none does."""
    stack, i, n = [], at, len(text)
    while i < n:
        c = text[i]
        if c in "\"'`":
            j = i + 1
            while j < n and text[j] != c and (c == "`" or text[j] != "\n"):
                j += 2 if text[j] == "\\" else 1
            i = j + 1
            continue
        if text.startswith("//", i):
            j = text.find("\n", i)
            i = n if j < 0 else j
            continue
        if text.startswith("/*", i):
            j = text.find("*/", i + 2)
            i = n if j < 0 else j + 2
            continue
        if c in PAIRS:
            stack.append(PAIRS[c])
        elif c in ")]}":
            if not stack or stack.pop() != c:
                return None
            if not stack:
                return i
        i += 1
    return None


def script_findings(text: str) -> Iterator[tuple[int, str, str]]:
    """(offset, rule, severity) of the rules over brace-matched code."""
    tries = []
    for m in re.finditer(r"\btry\s*\{", text):
        end = matching(text, m.end() - 1)
        if end is not None and re.match(r"\s*catch\b", text[end + 1 :]):
            tries.append((m.start(), end))
    for m in re.finditer(r"\bcatch\s*(?:\([^)]*\))?\s*\{", text):
        end = matching(text, m.end() - 1)
        if end is not None and not re.sub(r"//[^\n]*|/\*.*?\*/", "", text[m.end() : end], flags=re.DOTALL).strip():
            yield m.start(), "empty-catch-block", "medium"
    for m in re.finditer(r"\bJSON\.parse\s*\(", text):
        if not any(a <= m.start() <= b for a, b in tries):
            yield m.start(), "json-parse-without-error-handling", "medium"
    for m in re.finditer(r"\bfor\s*(?:await\s*)?\(", text):
        close = matching(text, m.end() - 1)
        if close is not None and (b := re.match(r"\s*\{", text[close + 1 :])):
            end = matching(text, close + b.end())
            if end is not None and (w := re.search(r"\bawait\b", text[close:end])) and not m[0].startswith("for await"):
                yield close + w.start(), "sequential-await-in-loop", "medium"
    for m in re.finditer(r"\buse(?:Layout)?Effect\s*\(", text):
        end = matching(text, m.end() - 1)
        if end is not None:
            body = text[m.end() : end]
            for start, stop in (("setInterval", "clearInterval"), ("addEventListener", "removeEventListener")):
                if start in body and stop not in body:
                    yield m.start(), "effect-cleanup", "high"
    for m in re.finditer(r"\bsetInterval\s*\(", text):
        line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
        if not re.search(r"(?:=|\breturn\b)\s*(?:window\.)?$", line):
            yield m.start(), "setinterval-without-timer-reference", "medium"
    for m in re.finditer(r"(?m)^([ \t]*)(?:return\b[^\n]*|throw\b[^\n]*);[ \t]*\n+([ \t]*)(?!\}|\)|\]|case\b|default\b|//|/\*)(\S)", text):
        if m[1] == m[2]:
            yield m.start(3), "unreachable-code", "medium"


_DECLARED = re.compile(r"(?m)^[ \t]*(export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*(?!\s*(?:set(?:Interval|Timeout)|requestAnimationFrame)\b)")
_FUNCTION = re.compile(r"\bfunction\b\s*[\w$]*\s*\(|\bconstructor\s*\(|(?<=[=(,:])\s*(?:async\s*)?\((?=[^()]*\)\s*(?::[^={]+)?=>)")
_PARAMETER = re.compile(r"^\s*(?:(?:public|private|protected|readonly)\s+)*\.{0,3}([A-Za-z$][\w$]*)\s*\??\s*(?::|=|$)")


def _occurs(name: str, text: str) -> int:
    return len(re.findall(rf"(?<![\w$]){re.escape(name)}(?![\w$])", text))


def unused_findings(text: str, whole: str) -> Iterator[tuple[int, str, str]]:
    """(offset, rule, severity) of values that stand once in the whole file, and of parameters that their body never names.

    Exported values and handles of timers are used elsewhere; a parameter property is a member, used as one or not at all.
    """
    for m in _DECLARED.finditer(text):
        if not m[1] and _occurs(m[2], whole) == 1:
            yield m.start(2), "unused-variable", "low"
    for m in _FUNCTION.finditer(text):
        close = matching(text, m.end() - 1)
        if close is None:
            continue
        after = re.compile(r"\s*(?::[^={;]+?)?\s*(?:=>\s*)?").match(text, close + 1)
        begin = after.end()
        if text[begin : begin + 1] == "{":
            end = matching(text, begin)
        else:
            end = text.find("\n", begin) if "=>" in after[0] else None
            end = len(text) if end == -1 else end
        if end is None:
            continue
        depth, first, pieces = 0, m.end(), []
        for at in range(m.end(), close + 1):
            c = text[at]
            depth += c in "([{<" if c in "([{<" else -(c in ")]}>" and not text.startswith("=>", at - 1)) if at < close else 0
            if at == close or c == "," and depth == 0:
                pieces.append((first, text[first:at]))
                first = at + 1
        for at, piece in pieces:
            p = _PARAMETER.match(piece)
            if p and not p[1].startswith("_") and not _occurs(p[1], text[begin:end]) and not (re.match(r"\s*(?:public|private|protected|readonly)\b", piece) and re.search(rf"\bthis\.{re.escape(p[1])}\b", whole)):
                yield at + p.start(1), "unused-parameter", "low"


_ALIAS = re.compile(r"\btype\s+(\w+)\s*=\s*((?:\|?\s*['\"][^'\"]+['\"]\s*)+);?")
_LITERAL = re.compile(r"['\"]([^'\"]+)['\"]")


def missing_members(declared: set[str], handled: set[str]) -> set[str]:
    """The members of a union that no case handles."""
    return declared - handled


def typed_findings(text: str, whole: str) -> Iterator[tuple[int, str, str]]:
    """(offset, rule, severity) of TypeScript: switches that miss members of a union, timers kept in members and never cleared,
    optional properties read through without narrowing."""
    aliases = {m[1]: set(_LITERAL.findall(m[2])) for m in _ALIAS.finditer(whole)}
    for m in re.finditer(r"\bswitch\s*\(\s*(\w+)\s*\)\s*\{", text):
        end = matching(text, m.end() - 1)
        kind = re.search(rf"\b{m[1]}\s*\??\s*:\s*(\w+)", whole)
        if end is None or not kind or kind[1] not in aliases or re.search(r"\bdefault\s*:", text[m.end() : end]):
            continue
        handled = {x for c in re.findall(r"\bcase\s*([^:]+):", text[m.end() : end]) for x in _LITERAL.findall(c)}
        if missing_members(aliases[kind[1]], handled):
            yield m.start(), "non-exhaustive-union", "medium"
    for m in re.finditer(r"\bthis\.(\w+)\s*=\s*(?:window\.)?set(Interval|Timeout)\s*\(", text):
        if not re.search(rf"\bclear{m[2]}\s*\(\s*this\.{m[1]}\b", whole):
            yield m.start(), "timer-without-cleanup", "medium"
    optional = {p for body in re.findall(r"\b(?:interface\s+\w+[^{]*|type\s+\w+\s*=\s*)\{([^}]*)\}", whole) for p in re.findall(r"\b(\w+)\?\s*:", body)}
    for p in sorted(optional):
        if not re.search(rf"\b{p}\b\s*(?:&&|!==?|===?|\?\?)|\bif\s*\([^)]*\b{p}\b", whole):
            for m in re.finditer(rf"\.{p}\.\w", text):
                yield m.start(), "typescript-optional-property", "medium"


def python_findings(text: str) -> Iterator[tuple[int, str, str]]:
    """(line, rule, severity) of the rules over the syntax tree; nothing where the text doesn't parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    from patchlake.operators.python_shapes import function_findings

    yield from function_findings(tree)
    dotted = lambda f: ast.unparse(f) if isinstance(f, (ast.Name, ast.Attribute)) else ""
    for n in ast.walk(tree):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            for x in [*n.args.defaults, *filter(None, n.args.kw_defaults)]:
                if isinstance(x, (ast.List, ast.Dict, ast.Set)) or isinstance(x, ast.Call) and dotted(x.func) in ("list", "dict", "set"):
                    yield x.lineno, "mutable-default-argument", "medium"
        if isinstance(n, ast.AsyncFunctionDef):
            for x in ast.walk(n):
                if isinstance(x, ast.Call) and dotted(x.func) == "time.sleep":
                    yield x.lineno, "async-blocking-operation", "medium"
        if isinstance(n, ast.ExceptHandler):
            if n.type is None:
                yield n.lineno, "bare-except", "medium"
            elif len(n.body) == 1 and isinstance(n.body[0], ast.Pass):
                yield n.lineno, "empty-catch-block", "medium"
            for x in n.body:
                if isinstance(x, ast.Return) and isinstance(x.value, ast.Constant) and x.value.value is True:
                    yield x.lineno, "incorrect-result-handling", "medium"
                if n.name and isinstance(x, ast.Return) and isinstance(x.value, ast.Call) and dotted(x.value.func) == "str" and x.value.args and dotted(x.value.args[0]) == n.name:
                    yield x.lineno, "exception-detail-exposure", "medium"
        if isinstance(n, ast.Compare) and any(isinstance(o, (ast.Is, ast.IsNot)) for o in n.ops):
            if any(isinstance(c, ast.Constant) and c.value not in (None, True, False, ...) for c in n.comparators):
                yield n.lineno, "identity-comparison-literal", "medium"
        if isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name) and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str):
            value = n.value.value.strip()
            if SECRET_NAME.search(re.sub(r"[\W_]", "", n.target.id.lower())) and len(value) >= 6 and value.lower() not in STAND_INS:
                yield n.lineno, "hardcoded-secret", "critical"
        if isinstance(n, ast.Expr) and isinstance(n.value, ast.Call) and dotted(n.value.func).endswith("create_task"):
            yield n.lineno, "unowned-background-task", "medium"
        if isinstance(n, ast.Call):
            name = dotted(n.func)
            last = name.rpartition(".")[2]
            if name in ("eval", "exec"):
                yield n.lineno, "unsafe-code-execution", "high"
            if name in ("pickle.load", "pickle.loads", "dill.load", "dill.loads") or name == "yaml.load" and not any("safe" in ast.unparse(k.value).lower() for k in n.keywords if k.arg == "Loader"):
                yield n.lineno, "unsafe-deserialization", "high"
            if name in ("hashlib.md5", "hashlib.sha1"):
                yield n.lineno, "weak-cryptography", "medium"
            if last.lower() in ("print", "debug", "info", "warning", "error", "critical") and re.search(r"authorization|cookie|x-api-key|api_key", ast.unparse(n).lower()):
                yield n.lineno, "sensitive-data-logging", "high"
            elif name == "print":
                yield n.lineno, "debug-print", "low"
            if last == "update" and n.args and isinstance(n.args[0], ast.Name):
                if re.search(r"user|account|entity", name.rpartition(".")[0].lower()) and re.search(r"payload|data|body|request|input|changes|fields", n.args[0].id.lower()):
                    yield n.lineno, "mass-assignment", "high"
            if isinstance(n.func, ast.Attribute) and n.func.attr in ("read_text", "read_bytes") and isinstance(n.func.value, ast.BinOp) and isinstance(n.func.value.op, ast.Div):
                if any(isinstance(x, ast.Name) for x in ast.walk(n.func.value.right)):
                    yield n.lineno, "path-traversal", "high"
            for k in n.keywords:
                if k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True:
                    yield k.value.lineno, "command-injection", "high"
                if k.arg == "options" and "verify_signature" in ast.unparse(k.value) and "False" in ast.unparse(k.value) and last == "decode":
                    yield n.lineno, "jwt-signature-verification-disabled", "high"
            if last in ("execute", "raw", "text") and n.args and (isinstance(n.args[0], ast.JoinedStr) or isinstance(n.args[0], ast.BinOp) and isinstance(n.args[0].op, (ast.Add, ast.Mod)) or isinstance(n.args[0], ast.Call) and dotted(n.args[0].func).endswith(".format")):
                yield n.lineno, "sql-injection", "high"
        for body in (getattr(n, b, None) for b in ("body", "orelse", "finalbody")):
            if isinstance(body, list):
                for a, b in zip(body, body[1:]):
                    if isinstance(a, (ast.Return, ast.Raise, ast.Break, ast.Continue)):
                        yield b.lineno, "unreachable-code", "medium"
                        break


def added_blocks(patch: str | None) -> list[tuple[int, str]]:
    """(first line, text) of each hunk's new side, brought to the left by its common indent."""
    out = []
    start, block = None, []
    for raw in [*re.split(r"\r\n|[\n\r]", patch or ""), "@@"]:
        if raw.startswith("@@"):
            if start is not None and block:
                width = min((len(x) - len(x.lstrip()) for x in block if x.strip()), default=0)
                out.append((start, "\n".join(x[width:] for x in block)))
            m = re.match(r"@@ -\d+(?:,\d+)? \+(\d+)", raw)
            start, block = int(m[1]) if m else None, []
        elif start is not None and raw[:1] in ("+", " ", "") and not raw.startswith("+++"):
            block.append(raw[1:])
    return out


def syntax_findings(files: DataFrame) -> DataFrame:
    """(file_id, line_number, rule_id, severity) by the shape of the new side of each hunk, on added and kept lines alike."""
    ship_package(files.sparkSession)
    low = F.lower("path")
    kind = F.when(low.rlike(r"\.pyw?$"), "python").when(low.rlike(r"\.(?:js|jsx|mjs|cjs|ts|tsx)$"), "script").when(low.rlike(r"\.(?:cs|java)$"), "methods")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from patchlake.operators.methods import method_findings

        for rb in batches:
            out = set()
            for i, k, path, patch in zip(*(rb.column(c).to_pylist() for c in range(4))):
                blocks = added_blocks(patch)
                whole = "\n".join(text for _, text in blocks)
                for first, text in blocks:
                    if k == "python":
                        out |= {(i, first + line - 1, rule, s) for line, rule, s in python_findings(text)}
                        continue
                    shapes = [*script_findings(text), *unused_findings(text, whole)] if k == "script" else []
                    if path.lower().endswith((".ts", ".tsx")):
                        shapes += typed_findings(text, whole)
                    out |= {(i, first + text.count("\n", 0, at), rule, s) for at, rule, s in [*shapes, *method_findings(path, text)]}
            cols = list(zip(*sorted(out))) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], ["file_id", "line_number", "rule_id", "severity"])

    return files.withColumn("kind", kind).where("kind is not null and patch is not null").select("file_id", "kind", "path", "patch").mapInArrow(run, SCHEMA)

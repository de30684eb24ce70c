"""Rules over whole Python functions: what is called, awaited, checked and returned in each, gathered once and asked by all rules."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

#: Names by which calls and parameters are known.
HTTP = re.compile(r"(?:^|\.|_)(?:client|session|http|httpx|requests|aiohttp)\w*\.(?:get|post|put|patch|delete|request|send)$", re.IGNORECASE)
CHANGES = re.compile(r"\.(?:update|delete|remove|save|insert|create)\w*$")
OPENERS = ("open", "io.open", "socket.socket", "sqlite3.connect", "aiohttp.ClientSession", "requests.Session", "httpx.Client", "httpx.AsyncClient")
ROLE, PAGE, SIZE = re.compile(r"role|admin", re.IGNORECASE), re.compile(r"^page(?:_?(?:no|num|number|index))?$"), re.compile(r"^(?:page_?)?(?:size|limit)$|^per_page$")
IDENTITY = re.compile(r"current_?user|user_?id|tenant|identity|principal", re.IGNORECASE)


def dotted(n: ast.AST) -> str:
    return ast.unparse(n) if isinstance(n, (ast.Name, ast.Attribute)) else ""


class Facts:
    """What one function does, without the functions within it."""

    def __init__(self, f: ast.FunctionDef | ast.AsyncFunctionDef):
        self.f = f
        a = f.args
        self.params = [x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs] if x.arg not in ("self", "cls")]
        self.nodes = list(self._own(f))
        self.calls = [n for n in self.nodes if isinstance(n, ast.Call)]
        self.names = {n.id for n in self.nodes if isinstance(n, ast.Name)}
        self.text = ast.unparse(f)
        self.test = f.name.startswith("test")

    @staticmethod
    def _own(f: ast.AST) -> Iterator[ast.AST]:
        for child in ast.iter_child_nodes(f):
            yield child
            if not isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, ast.ClassDef)):
                yield from Facts._own(child)

    def headers(self) -> set[str]:
        """Parameters that Header() gives."""
        a = self.f.args
        named = [*zip(reversed([*a.posonlyargs, *a.args]), reversed(a.defaults)), *((x, d) for x, d in zip(a.kwonlyargs, a.kw_defaults) if d)]
        return {x.arg for x, d in named if isinstance(d, ast.Call) and dotted(d.func).endswith("Header")}

    def assigned(self) -> Iterator[tuple[str, ast.AST, ast.AST]]:
        """(name, value without await, statement) of plain assignments."""
        for n in self.nodes:
            if isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name):
                yield n.targets[0].id, n.value.value if isinstance(n.value, ast.Await) else n.value, n


def _true(n: ast.AST) -> bool:
    return isinstance(n, ast.Return) and isinstance(n.value, ast.Constant) and n.value.value is True


def _blocks(f: ast.AST) -> Iterator[list[ast.stmt]]:
    for n in ast.walk(f):
        for field in ("body", "orelse", "finalbody"):
            block = getattr(n, field, None)
            if isinstance(block, list) and block and isinstance(block[0], ast.stmt):
                yield block


def results(x: Facts) -> Iterator[tuple[int, str, str]]:
    for block in _blocks(x.f):
        for a, b in zip(block, block[1:]):
            call = a.value.value if isinstance(a, ast.Expr) and isinstance(a.value, ast.Await) else a.value if isinstance(a, ast.Expr) else None
            if isinstance(call, ast.Call) and CHANGES.search(dotted(call.func)) and _true(b):
                yield a.lineno, "incorrect-result-handling", "medium"
            if isinstance(a, ast.Try) and _true(b) and any(len(h.body) == 1 and isinstance(h.body[0], ast.Pass) for h in a.handlers):
                yield b.lineno, "incorrect-result-handling", "medium"
    for n in x.nodes:
        if isinstance(n, ast.ExceptHandler):
            for r in n.body:
                good = isinstance(r, ast.Return) and re.search(r"['\"](?:ok|success)['\"]\s*:\s*True|['\"]status['\"]\s*:\s*['\"](?:ok|success)|status_code=2\d\d", ast.unparse(r))
                if good:
                    yield r.lineno, "incorrect-result-handling", "medium"


def resources(x: Facts) -> Iterator[tuple[int, str, str]]:
    for name, value, n in x.assigned():
        if isinstance(value, ast.Call) and dotted(value.func) in OPENERS and not re.search(rf"\b{name}\.a?close\(|with {name}\b|(?m:\breturn {name}$)|closing\({name}\)", x.text):
            yield n.lineno, "resource-cleanup", "medium"


def guards(x: Facts) -> Iterator[tuple[int, str, str]]:
    given = {h for h in x.headers() if ROLE.search(h)}
    for n in x.nodes:
        if isinstance(n, ast.If) and (isinstance(n.test, ast.Name) and n.test.id in given or isinstance(n.test, ast.UnaryOp) and isinstance(n.test.operand, ast.Name) and n.test.operand.id in given):
            if not any(isinstance(c, ast.Compare) and any(isinstance(v, (ast.Constant, ast.Set, ast.Tuple, ast.List)) for v in c.comparators) for c in x.nodes):
                yield n.lineno, "authorization", "high"
    if re.match(r"(?:require|check|ensure|verify)_.*(?:role|admin|permission)", x.f.name):
        compares = [c for c in x.nodes if isinstance(c, ast.Compare)]
        if compares and not any(isinstance(v, (ast.Constant, ast.Set, ast.Tuple, ast.List)) for c in compares for v in [c.left, *c.comparators]):
            yield compares[0].lineno, "authorization", "high"
    if IDENTITY.search(x.f.name) and (own := x.headers()):
        for n in x.nodes:
            if isinstance(n, ast.Return) and n.value is not None and own & {m.id for m in ast.walk(n.value) if isinstance(m, ast.Name)}:
                yield n.lineno, "untrusted-identity-header", "high"


def logic(x: Facts) -> Iterator[tuple[int, str, str]]:
    for n in x.nodes:
        if isinstance(n, ast.BinOp) and isinstance(n.op, ast.Mult) and isinstance(n.left, ast.Name) and isinstance(n.right, ast.Name):
            pair = (n.left.id, n.right.id)
            if set(pair) <= set(x.params) and any(PAGE.match(a) and SIZE.match(b) for a, b in (pair, pair[::-1])):
                yield n.lineno, "logic-error", "medium"
    for name, value, n in x.assigned():
        if "key" in name and re.search(r"cache", x.text, re.IGNORECASE) and isinstance(value, (ast.JoinedStr, ast.BinOp, ast.Tuple)):
            used = {m.id for m in ast.walk(value) if isinstance(m, ast.Name)}
            later = {m.id for m in x.nodes if isinstance(m, ast.Name) and m.lineno > n.lineno}
            if used & set(x.params) and (set(x.params) - used) & later:
                yield n.lineno, "cache-consistency", "medium"


def tests(x: Facts) -> Iterator[tuple[int, str, str]]:
    asserts = [n for n in x.nodes if isinstance(n, ast.Assert)]
    if not x.test or not asserts:
        return
    texts = [ast.unparse(n.test) for n in asserts]
    if all("status" in t for t in texts):
        yield asserts[0].lineno, "insufficient-test-assertion", "medium"
    elif any(re.search(r"\b(?:total|page|page_size|pages)\b", t) for t in texts) and not any(re.search(r"items|records|results|data\b", t) for t in texts):
        yield asserts[0].lineno, "insufficient-test-assertion", "medium"
    if "missing" in x.f.name:
        for n, t in zip(asserts, texts):
            if re.search(r"(?:is|==) True$|in \(.*True.*\)$", t):
                yield n.lineno, "insufficient-test-assertion", "medium"


def remote(x: Facts) -> Iterator[tuple[int, str, str]]:
    loops = [n for n in x.nodes if isinstance(n, (ast.For, ast.While, ast.AsyncFor))]
    for n in x.nodes:
        call = n.value if isinstance(n, ast.Await) else None
        if not isinstance(call, ast.Call) or not HTTP.search(dotted(call.func)):
            continue
        if not any(k.arg == "timeout" for k in call.keywords) and "httpx" not in x.text and not re.search(r"timeout", x.text):
            yield call.lineno, "missing-timeout", "medium"
        if any(n in set(ast.walk(loop)) for loop in loops):
            yield call.lineno, "sequential-await-in-loop", "medium"
    for name, value, n in x.assigned():
        if isinstance(value, ast.Call) and HTTP.search(dotted(value.func)) and not x.test:
            if not re.search(rf"\b{name}\.(?:raise_for_status|status_code|status|ok|is_success)\b", x.text):
                yield n.lineno, "http-status-not-checked", "medium"
            if re.search(rf"\b{name}\.json\(\)", x.text) and not re.search(r"model_validate|parse_obj|validate|schema|TypeAdapter", x.text):
                yield n.lineno, "unvalidated-external-data", "medium"


def uploads(x: Facts) -> Iterator[tuple[int, str, str]]:
    for a in [*x.f.args.args, *x.f.args.kwonlyargs]:
        if a.annotation is not None and "UploadFile" in ast.unparse(a.annotation):
            if re.search(rf"\b{a.arg}\.filename\b", x.text) and not re.search(rf"\b{a.arg}\.(?:content_type|size)\b|splitext|suffix|allowed", x.text, re.IGNORECASE):
                yield x.f.lineno, "unrestricted-file-upload", "high"
    for c in x.calls:
        if re.search(r"(?:^|\.)(?:RedirectResponse|redirect|HttpResponseRedirect)$", dotted(c.func)) and c.args and isinstance(c.args[0], ast.Name) and c.args[0].id in x.params:
            if not re.search(r"startswith|urlparse|allowed|url_has_allowed", x.text):
                yield c.lineno, "open-redirect", "high"


def contracts(tree: ast.Module) -> Iterator[tuple[int, str, str]]:
    """Routes whose declared response model asks for fields that the model they return lacks, both in one text."""
    fields = {c.name: {s.target.id for s in c.body if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name) and s.value is None} for c in ast.walk(tree) if isinstance(c, ast.ClassDef)}
    every = {c.name: {s.target.id for s in c.body if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name)} for c in ast.walk(tree) if isinstance(c, ast.ClassDef)}
    for f in ast.walk(tree):
        if not isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        declared = [k.value.id for d in f.decorator_list if isinstance(d, ast.Call) for k in d.keywords if k.arg == "response_model" and isinstance(k.value, ast.Name)]
        for name in declared:
            for r in Facts(f).nodes:
                made = r.value.func.id if isinstance(r, ast.Return) and isinstance(r.value, ast.Call) and isinstance(r.value.func, ast.Name) else None
                if name in fields and made in every and made != name and fields[name] - every[made]:
                    yield r.lineno, "response-contract-mismatch", "medium"


def function_findings(tree: ast.Module) -> Iterator[tuple[int, str, str]]:
    """(line, rule, severity) of all rules over all functions of a tree."""
    for f in ast.walk(tree):
        if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
            x = Facts(f)
            for rule in (results, resources, guards, logic, tests, remote, uploads):
                yield from rule(x)
    yield from contracts(tree)

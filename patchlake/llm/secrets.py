"""Credentials in patches and paths: places, and the text with only the secret values masked.

Method: a trigram index over file chunks. The trigrams that a detection regex cannot match without are derived from its parsed
form; the chunks' postings of those trigrams alone are built and intersected (and joined where the regex has alternatives), and
regexes are tried on the chunks that remain. A rule from whose regex no trigram follows is tried on every chunk. The index is
local to the batch of rows a worker holds, so that nothing is shuffled.

What counts: tokens of known form; values of names that say password, secret, token or key; passwords in URLs, connection
strings, command lines and password files; private key blocks, at their opening line. Placeholders, masked values, references
to an environment or a vault, digests, identifiers, public keys and certificates do not count.

Defined results: a null or empty patch has no place and stays as it is; line 0 is the path; a file_id delivered again gives
each place once; patches of any length are read whole; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from re import _constants as C
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlake.runtime import ship_package

#: Characters of a chunk of the index; a chunk ends at a line end.
CHUNK = 4096
#: Bytes indexed at once by one worker.
BLOCK = 2_000_000

#: The forms of known tokens.
TOKENS = (
    r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36}|(?<![A-Za-z0-9])glpat-[\w-]{20}"
    r"|(?<![A-Za-z0-9])xox[abprs]-[0-9A-Za-z-]{12,}|(?<![A-Za-z0-9])[sr]k_(?:live|test)_[0-9A-Za-z]{16,}|(?<![A-Za-z0-9])AIza[\w-]{35}"
    r"|(?<![A-Za-z0-9])npm_[A-Za-z0-9]{36}|(?<![A-Za-z0-9])SG\.[\w-]{22}\.[\w-]{43}|(?<![A-Za-z0-9_-])eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}"
)
#: Parts of names that announce a secret.
CORE = (
    r"(?i)passw(?:or)?d|passphrase|pwd|passwort|(?<![a-z])pass(?![a-z])|(?:db|root|admin|user|smtp|mail|ftp|sql|svc|my)[_-]?pass(?![a-z])|secret|token|bearer|authorization|credential"
    r"|(?:api|access|private|encryption|signing|service|licen[cs]e|auth|client|account|master|storage|deploy|ssh|consumer)[_-]?key|(?:admin|root|user|db|sql)[_-]?pw(?![a-z])|[_\"' .(,-]pw(?![a-z])"
)
#: The ends of such names, without separators, in lower case.
NAME_END = re.compile(
    r"(?:password|passwd|passphrase|pwd|passwort|secret|token|bearer|authorization|credentials?"
    r"|(?:api|access|private|encryption|signing|service|licen[cs]e|secret|auth|client|account|master|storage|deploy|ssh|consumer)key"
    r"|(?:admin|root|user|db|sql)pw|^pw|^x?pass|(?:db|root|admin|user|smtp|mail|ftp|sql|svc|my)pass)$"
)
PRIVATE_KEY = r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
URL = r"[a-zA-Z][a-zA-Z0-9+.-]*://[^\s:/@'\"`<>]*:([^\s/@'\"`<>]+)@[\w.\[-]"
COMMAND = r"\bsshpass\s+-p\s*(\S+)|\bcurl\b[^\n]*?\s(?:-u|--user)[ =]['\"]?[^\s:'\"]+:([^\s'\"]+)|\b(?:mysql|mysqldump|mysqladmin)\b[^\n]*?\s-p(?!ort)([^\s-]\S*)|\bdocker login\b[^\n]*?\s-p\s+(\S+)|\bredis-cli\b[^\n]*?\s-a\s+(\S+)|(?i:\bidentified by\s+(?:password\s+)?['\"]([^'\"\n]+)['\"])"
PASSWORD_FILE = r"(?m)(?<=[\w*])(?::\d\d\d{0,3}:|:\*:)[\w*.-]+:[\w*.-]+:([^\s:]+)\s*$"

RULES = {"token": TOKENS, "named": CORE, "private key": PRIVATE_KEY, "url": URL, "command": COMMAND, "password file": PASSWORD_FILE}
COMPILED = {k: re.compile(v) for k, v in RULES.items()}

PLACEHOLDER = re.compile(
    r"\$\{|\$\(|\{\{|\}\}|<[^>]*>|%\(|%[A-Z_]{3,}%|EXAMPLE|X{4,}|(?i:x{5,}|change[-_ ]?(?:me|it)|your[-_ ]|placeholder|redacted|dummy|insert[-_ ]|not[-_ ]?set|todo)|\*{3,}|\.{3,}|^#+$|^-+$|^_+$"
    r"|(?i:os\.environ|process\.env|getenv|get_secret|vault|secretsmanager|keyring|config\.)"
)
#: Words that stand for a secret without being one.
STAND_INS = frozenset(
    "password passwd pass pwd secret token user username string str text none null nil true false undefined empty hidden required optional default test example sample masked env vault bearer basic key value input".split()
)


# ---- required trigrams -------------------------------------------------------------------------------------------------


def _fold(c: int) -> int:
    return c + 32 if 65 <= c <= 90 else c


#: The alternatives of a part of a regex are spelt out up to so many strings.
SPELT = 128


def _spelt(strings: set[str]) -> tuple:
    """What a text holds that holds one of the strings."""
    if any(len(x.encode()) < 3 for x in strings):
        return ("all", [])
    grams = lambda b: [b[i : i + 3] for i in range(len(b) - 2)]
    return ("any", [("all", grams(x.encode())) for x in sorted(strings)])


def _node(op, arg) -> tuple[set[str] | None, tuple]:
    """The strings that a part can match, where they are few; else what its match must hold."""
    nothing = ("all", [])
    if op is C.LITERAL:
        return {chr(_fold(arg))}, nothing
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return {""}, nothing
    if op is C.IN:
        signs: set[str] = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                signs.add(chr(_fold(x)))
            elif kind is C.RANGE and x[1] - x[0] < 10:
                signs |= {chr(_fold(c)) for c in range(x[0], x[1] + 1)}
            elif kind is C.CATEGORY and x is C.CATEGORY_DIGIT:
                signs |= set("0123456789")
            else:
                return None, nothing
        return signs, nothing
    if op is C.SUBPATTERN:
        return _sequence(arg[3])
    if op is C.BRANCH:
        ways = [_sequence(w) for w in arg[1]]
        if all(w[0] is not None for w in ways) and sum(len(w[0]) for w in ways) <= SPELT:
            return set().union(*(w[0] for w in ways)), nothing
        return None, ("any", [w[1] if w[0] is None else _spelt(w[0]) for w in ways])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        least, most, body = arg
        own = _sequence(body)
        if own[0] is not None and most <= 2 and (len(own[0]) + 1) ** most <= SPELT:
            out: set[str] = set()
            for k in range(least, most + 1):
                some = {""}
                for _ in range(k):
                    some = {x + y for x in some for y in own[0]}
                out |= some
            return out, nothing
        if least:
            return None, own[1] if own[0] is None else _spelt(own[0])
    return None, nothing


def _sequence(items, start: frozenset[str] = frozenset([""])) -> tuple[set[str] | None, tuple]:
    """As _node, for parts in a row after one of the strings of start."""
    parts: list = []
    now = set(start)
    whole = True
    for op, arg in items:
        strings, query = _node(op, arg)
        inner = arg[3] if op is C.SUBPATTERN and len(arg[3]) == 1 and arg[3][0][0] is C.BRANCH else [(op, arg)]
        if strings is None and inner[0][0] is C.BRANCH:
            ways = [_sequence(w, frozenset(now)) for w in inner[0][1][1]]
            parts.append(("any", [w[1] if w[0] is None else _spelt(w[0]) for w in ways]))
            now, whole = {""}, False
            continue
        if strings is not None and len(now) * len(strings) <= SPELT:
            now = {x + y for x in now for y in strings}
            continue
        whole = False
        parts.append(_spelt(now))
        parts.append(query)
        now = strings if strings is not None and len(strings) <= SPELT else {""}
    if whole:
        return now, ("all", [])
    parts.append(_spelt(now))
    return None, ("all", parts)


def required(pattern: str) -> tuple:
    """What a match of pattern must hold: ("all", parts), ("any", parts) or a trigram; ("all", []) says nothing.

    Letters are folded to lower case, so that the query holds for case-blind regexes too.
    """
    strings, query = _sequence(parser.parse(pattern))
    return simplify(query if strings is None else _spelt(strings))


def simplify(q):
    if isinstance(q, bytes):
        return q
    kind, parts = q
    parts = [simplify(p) for p in parts]
    if kind == "any" and any(p == ("all", []) for p in parts):
        return ("all", [])
    parts = [p for p in parts if p != ("all", [])]
    return parts[0] if len(parts) == 1 else (kind, parts)


def trigrams(q) -> set[bytes]:
    return {q} if isinstance(q, bytes) else set().union(*(trigrams(p) for p in q[1]))


def holds(q, column: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    if isinstance(q, bytes):
        return column[q]
    rows = [holds(p, column, n) for p in q[1]]
    if not rows:
        return np.ones(n, bool)
    return np.logical_and.reduce(rows) if q[0] == "all" else np.logical_or.reduce(rows)


_index: dict = {}


def _table() -> tuple[dict, list[bytes], np.ndarray]:
    if not _index:
        queries = {k: required(v) for k, v in RULES.items()}
        wanted = sorted(set().union(*(trigrams(q) for q in queries.values())))
        table = np.zeros(1 << 24, np.uint16)
        for k, t in enumerate(wanted):
            table[t[0] << 16 | t[1] << 8 | t[2]] = k + 1
        _index.update(queries=queries, wanted=wanted, table=table)
    return _index["queries"], _index["wanted"], _index["table"]


def candidates(chunks: list[bytes]) -> dict[str, np.ndarray]:
    """For each rule, which chunks its postings leave."""
    queries, wanted, table = _table()
    n = len(chunks)
    present = np.zeros((n, len(wanted) + 1), bool)
    buffer = np.frombuffer(b"\n".join(chunks).lower(), np.uint8)
    if len(buffer) > 2:
        wide = buffer.astype(np.uint32)
        hits = table[wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]]
        at = np.flatnonzero(hits)
        starts = np.cumsum([0] + [len(c) + 1 for c in chunks[:-1]])
        present[np.searchsorted(starts, at, side="right") - 1, hits[at]] = True
    column = {t: present[:, k + 1] for k, t in enumerate(wanted)}
    return {rule: holds(q, column, n) for rule, q in queries.items()}


# ---- verification ------------------------------------------------------------------------------------------------------


def usable(value: str, quoted: bool) -> bool:
    """Whether a value can be a secret rather than a stand-in for one."""
    v = value.strip()
    if len(v) < 6 or PLACEHOLDER.search(v) or v.lower() in STAND_INS or re.search(r"\s", v):
        return False
    if len(set(v)) <= 2 or v.isdigit() and len(v) < 10 or "://" in v:
        return False
    if re.fullmatch(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", v):
        return False
    if re.fullmatch(r"[A-Za-z]+(?:[._/ -][A-Za-z]+)*", v):
        return _random(v)
    if not quoted:
        if re.search(r"[()\[\]{}]", v) or re.match(r"(?:self|this|args|opts|config|cfg|env|request|req|params|props|ctx|std)\b", v):
            return False
        if re.fullmatch(r"[A-Za-z_][A-Za-z_.]*\d{0,2}", v):
            return _random(v)
    return True


def _random(v: str) -> bool:
    """Whether letters alone look drawn rather than written: upper case within, not at the heads of words."""
    for word in re.split(r"[._/ -]", v):
        parts = re.findall(r"[A-Z]?[a-z]+|[A-Z]+", word)
        if len(word) >= 8 and re.search(r"[a-z]", word) and len(parts) > 2 and 3 * sum(len(p) < 3 for p in parts) >= len(parts):
            return True
    return False


SEPARATOR = re.compile(r"[\"'\])]*\s*(?:\?\s*)?(?::\s*(?:str|string|String|&str|&'static str|text)\s*(?==))?(?:\s*(?::=|=>|===|!==|==|!=|=|:))\s*(?:\w[\w.]*\s*(?:\|\||\?\?|or)\s*)?")
NEXT_ARGUMENT = re.compile(r"[\"']\s*,\s*(?:(?:default|value|fallback)\s*=\s*)?")
ATTRIBUTE = re.compile(r"[\"']\s+value\s*=\s*")
OPEN_END = re.compile(r"[\"'\])]*\s*(?:\?\s*)?(?:(?::\s*(?:str|string|String)\s*)?(?::=|=>|=|:))\s*(?:\(|\\|[|>][+-]?|new)?\s*$")
QUOTED = re.compile(r"[@$]?[bBrRuUfF]{0,2}(\"\"\"|'''|[\"'`])")
SCHEME = re.compile(r"(?i)(?:bearer|basic|token)\s+")
BARE = re.compile(r"[^\s'\"`,;)\]}]+")
JOIN = re.compile(r"\s*(?:\+|\.|\|\||&|\\)?\s*([\"'])")


def _literal(text: str, at: int, end: int) -> tuple[str, list[tuple[int, int]], bool] | None:
    """The value that begins at a place of a line: its text, its spans, and whether it is quoted."""
    m = QUOTED.match(text, at, end)
    if not m:
        m = BARE.match(text, at, end)
        if not m:
            return None
        a, b = m.span()
        for tail in ("*/", "-->"):
            if text[a:b].endswith(tail):
                b -= len(tail)
        scheme = SCHEME.match(text, a, end)
        if scheme and (n := BARE.match(text, scheme.end(), end)):
            a, b = n.span()
        return text[a:b], [(a, b)], False
    spans, value, where = [], "", m.end()
    quote = m[1]
    while True:
        stop = where
        while stop < end and not text.startswith(quote, stop):
            stop += 2 if text[stop] == "\\" else 1
        stop = min(stop, end)
        a = where
        if not value and (scheme := SCHEME.match(text, a, stop)):
            a = scheme.end()
        spans.append((a, stop))
        value += text[a:stop]
        more = JOIN.match(text, stop + len(quote), end) if stop < end else None
        if not more or not re.search(r"[+.&\\|]", more[0]):
            return value, spans, True
        quote, where = more[1], more.end()


def _named(text: str, line: int, lines: list[int], m: re.Match) -> tuple[int, list[tuple[int, int]]] | None:
    """The secret that the name around a match announces."""
    a, b = m.span()
    start, end = lines[line], lines[line + 1] - 1
    while a > start and (text[a - 1].isalnum() or text[a - 1] in "_-."):
        a -= 1
    while b < end and (text[b].isalnum() or text[b] in "_-"):
        b += 1
    name = re.sub(r"[_-]|\d+$", "", text[a:b].rpartition(".")[2].strip("-").lower())
    if not NAME_END.search(name):
        return None
    if end > start and text[end - 1] == "\r":
        end -= 1
    tail = None
    for rule in (ATTRIBUTE, NEXT_ARGUMENT, SEPARATOR):
        if tail := rule.match(text, b, end):
            break
    if tail and tail.end() < end and not OPEN_END.match(text, b, end):
        got = _literal(text, tail.end(), end)
        if got and usable(got[0], got[2]):
            return line, got[1]
        return None
    if tail and OPEN_END.match(text, b, end) and line + 2 < len(lines):
        at, stop = lines[line + 1], lines[line + 2] - 1
        if text.startswith("@@", at):
            return None
        at += text[at : at + 1] in ("+", "-", " ")
        while at < stop and text[at] in " \t(":
            at += 1
        got = _literal(text, at, stop)
        if got and usable(got[0], got[2]) and (got[2] or not re.match(r"[\"'\w.-]+\s*[:=]", text[at:stop])):
            return line + 1, got[1]
        return None
    if not tail:
        before = text[start + 1 : a].strip()
        if re.match(r"(?:#|//|/\*|--|;|<!--|\*|rem\b)", before + text[a:b]) or re.search(r"\b(?:machine|login|user)\b", before) or re.match(r"(?i:env|arg|export|setx?)\b", before) or text[a : a + 2] == "--":
            at = b
            while at < end and text[at] in " \t":
                at += 1
            if at > b and (got := _literal(text, at, end)) and usable(got[0], got[2]):
                rest = text[got[1][-1][1] : end].strip()
                if got[2] or not re.match(r"\w", rest) or "machine" in before:
                    return line, got[1]
    return None


def _key_block(text: str, m: re.Match) -> list[tuple[int, int]] | None:
    """The lines of a private key after its opening, or null where none follow."""
    body = re.compile(r"(?:\\n|\\r|\r?\n)[+\- ]?[ \t]*[\"']?(?:[A-Za-z][\w-]*: [^\n]*|[A-Za-z0-9+/=]{8,}|)[\"']?\s?[+,]?(?=\\|\r|\n|$|[\"'`])")
    spans, at = [], m.end()
    while n := body.match(text, at):
        if k := re.search(r"[A-Za-z0-9+/=]{8,}", n[0]):
            spans.append((n.start() + k.start(), n.start() + k.end()))
        if n.end() == at:
            break
        at = n.end()
    return spans or None


def places(text: str, lines: list[int], a: int, b: int, rules: set[str]) -> list[tuple[int, str, list[tuple[int, int]]]]:
    """Secrets that begin in text[a:b]: (line from 0, rule, spans). lines holds where each line begins, and the end."""
    out = []
    line_of = lambda i: bisect_right(lines, i) - 1
    for rule in rules:
        for m in COMPILED[rule].finditer(text, a, b):
            if rule == "token":
                if not PLACEHOLDER.search(m[0]):
                    out.append((line_of(m.start()), rule, [m.span()]))
            elif rule == "private key":
                if spans := _key_block(text, m):
                    out.append((line_of(m.start()), rule, spans))
            elif rule == "named":
                if got := _named(text, line_of(m.start()), lines, m):
                    out.append((got[0], rule, got[1]))
            else:
                k = next(k for k in range(1, len(m.groups()) + 1) if m[k] is not None)
                if usable(m[k], True) or rule == "url" and len(m[k]) >= 4 and not PLACEHOLDER.search(m[k]) and m[k].lower() not in STAND_INS and re.search(r"\d|\W", m[k]):
                    out.append((line_of(m.start(k)), rule, [m.span(k)]))
    return out


def scan(patches: list[str | None], paths: list[str | None]) -> list[list[tuple[int, str, list[tuple[int, int]]]]]:
    """For each patch and path the secrets found; line -1 is the path."""
    out: list[list] = [[] for _ in patches]
    chunks: list[bytes] = []
    where: list[tuple[int, int, int]] = []
    bounds: dict[int, list[int]] = {}

    def flush() -> None:
        if not chunks:
            return
        hits = candidates(chunks)
        rules = list(hits)
        some = np.logical_or.reduce([hits[r] for r in rules])
        for c in np.flatnonzero(some).tolist():
            i, a, b = where[c]
            text = paths[i] if a < 0 else patches[i]
            if a < 0:
                # an assigned value ends with its part of the path
                part = lambda r, s: s if r in ("token", "url") else [(x, y if (k := text.find("/", x, y)) <= x else k) for x, y in s]  # noqa: B023, E731
                out[i] += [(-1, r, part(r, s)) for _, r, s in places(text, [0, len(text) + 1], 0, len(text), {r for r in rules if hits[r][c]})]
                continue
            if i not in bounds:
                bounds[i] = [0, *(m.end() for m in re.finditer("\n", text)), len(text) + 1]
            out[i] += places(text, bounds[i], a, b, {r for r in rules if hits[r][c]})
        chunks.clear()
        where.clear()
        bounds.clear()

    held = 0
    for i, (patch, path) in enumerate(zip(patches, paths)):
        if path:
            chunks.append(path.encode("utf-8", "surrogatepass"))
            where.append((i, -1, 0))
        a = 0
        while patch and a < len(patch):
            b = len(patch) if len(patch) - a <= CHUNK else (patch.find("\n", a + CHUNK) + 1 or len(patch))
            chunks.append(patch[a:b].encode("utf-8", "surrogatepass"))
            where.append((i, a, b))
            held += len(chunks[-1])
            a = b
        if held > BLOCK:
            flush()
            held = 0
    flush()
    return out


def _each(files: DataFrame, schema: str, row) -> DataFrame:
    ship_package(files.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            ids, paths, patches = (rb.column(k).to_pylist() for k in range(3))
            out = [x for i, path, patch, got in zip(ids, paths, patches, scan(patches, paths)) for x in row(i, path, patch, got)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], pa_schema)

    pa_schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[t]) for n, t in (x.split() for x in schema.split(", "))])
    return files.select(F.col("file_id").cast("long").alias("file_id"), "file_path", "patch").where("file_id is not null").mapInArrow(run, schema)


def secret_places(files: DataFrame) -> DataFrame:
    """(file_id, line_no, rule): each place once, whatever rules meet there (the first by name is told)."""
    found = _each(files, "file_id long, line_no int, rule string", lambda i, path, patch, got: [(i, line + 1, rule) for line, rule in {(x, r) for x, r, _ in got}])
    return found.groupBy("file_id", "line_no").agg(F.min("rule").alias("rule"))


def mask(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with the characters of the spans replaced by asterisks, one for one."""
    out = list(text)
    for a, b in spans:
        out[a:b] = "*" * (b - a)
    return "".join(out)


def redacted(files: DataFrame) -> DataFrame:
    """(file_id, file_path, patch) of the files with secrets, the values masked; no shuffle but for the copies."""

    def row(i, path, patch, got):
        if got:
            spans = [s for line, _, ss in got if line >= 0 for s in ss]
            own = [s for line, _, ss in got if line < 0 for s in ss]
            yield i, mask(path, own) if own else path, mask(patch, spans) if spans else patch

    return _each(files, "file_id long, file_path string, patch string", row).dropDuplicates(["file_id"])


def found(files: DataFrame) -> DataFrame:
    return secret_places(files).select("file_id", "line_no")

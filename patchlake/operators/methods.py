"""Rules over callables of brace languages: one table of rules, one walk over balanced braces.

A callable is a header that ends in a parameter list and the block that follows, with the annotations before it. A rule fires at each
place of a callable where its pattern stands, if the callable shows all that the rule asks and lacks all that would excuse it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from patchlake.operators.syntax import matching

CS, JAVA, JS, TS = (".cs",), (".java",), (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx"), (".ts", ".tsx")


@dataclass(frozen=True)
class Rule:
    rule: str
    severity: str
    files: tuple[str, ...]
    at: str
    shows: tuple[str, ...] = ()
    lacks: tuple[str, ...] = ()
    #: Only in tests (True), only outside (False), or anywhere (None).
    test: bool | None = None
    #: Fires at the first place of a callable alone; times: only where the pattern stands so often.
    once: bool = False
    times: int = 1


_TOKEN = r"(?i)(?:token|otp|reset|invite|verif|secret|password)\w*"
_SQL = r"(?i)\b(?:select\b.+\bfrom|insert\s+into|update\b.+\bset|delete\s+from)\b"
_HTTP_CS = r"\b\w*(?:[Cc]lient|[Hh]ttp)\w*\s*\.\s*(?:Get|Post|Put|Patch|Delete|Send)\w*Async\s*\("
_HTTP_JAVA = r"\b(?:restTemplate|webClient|restClient|httpClient|client)\s*\.\s*(?:get|post|put|delete|exchange|getFor\w+|postFor\w+|send)\s*\("
_INPUT_JAVA = r"@(?:RequestParam|PathVariable|RequestBody|RequestHeader)\b"
#: The rules, by language: what is looked for, what must be there, what excuses it.
RULES = (
    # Java
    Rule("identity-comparison-literal", "medium", JAVA, r"\b\w+\s*[!=]=\s*\"[^\"]*\"|\"[^\"]*\"\s*[!=]=\s*\w"),
    Rule("null-safety", "medium", JAVA, r"\.orElse\(\s*null\s*\)", lacks=(r"^[^{]*\bOptional<", r"@Nullable")),
    Rule("cache-consistency", "high", JAVA, r"\b\w*[cC]ache\w*\s*\.\s*(?:get|put|computeIfAbsent)\s*\(\s*(?!\s*tenant)[^,)]*[,)]", shows=(r"^[^{]*\btenant\w*",), lacks=(r"(?i)[cC]ache\w*\s*\.\s*\w+\([^,)]*tenant", r"(?i)key\w*\s*=\s*[^;]*tenant")),
    Rule("async-blocking-operation", "medium", JAVA, r"\bThread\.sleep\s*\(", shows=(r"^[^{]*@Async\b",)),
    Rule("path-traversal", "high", JAVA, r"\bFiles\.(?:read\w*|newInputStream|lines|copy)\s*\([^;]*\.resolve\s*\(", lacks=(r"\.startsWith\s*\(",)),
    Rule("sql-injection", "high", JAVA, r"(?i)=\s*\"\s*(?:select|insert|update|delete)\b[^;]*\"\s*\+", shows=(r"(?i)\b(?:createNativeQuery|createQuery|executeQuery|executeUpdate|queryFor\w+|prepareStatement|jdbcTemplate)\b",), lacks=(r"\.setParameter\s*\(",)),
    Rule("sql-injection", "high", JAVA, r"\bcreateNativeQuery\s*\(\s*[^;)]*\n[^;]*\"\s*\+"),
    Rule("weak-cryptography", "high", JAVA, r"\bnew\s+Random\s*\(", shows=(_TOKEN,)),
    Rule("resource-cleanup", "medium", JAVA, r"\bFiles\.lines\s*\(", lacks=(r"\btry\s*\([^)]*Files\.lines", r"\.close\s*\(")),
    Rule("security", "high", JAVA, r"\b(?:DocumentBuilderFactory|SAXParserFactory|XMLInputFactory)\.new\w+\s*\(", lacks=(r"disallow-doctype-decl|FEATURE_SECURE_PROCESSING|SUPPORT_DTD|external-general-entities",)),
    Rule("ssrf", "high", JAVA, r"\.uri\s*\(\s*\w+", shows=(_INPUT_JAVA,), lacks=(r"(?i)allow(?:ed)?\w*(?:hosts?|urls?|list)",)),
    Rule("ssrf", "high", JAVA, _HTTP_JAVA + r"\s*(?:url|uri|target|host|endpoint|callback)\w*", shows=(_INPUT_JAVA,), lacks=(r"(?i)allow(?:ed)?\w*(?:hosts?|urls?|list)",)),
    Rule("open-redirect", "medium", JAVA, r"\.sendRedirect\s*\(\s*[a-z]\w*\s*\)|return\s+\"redirect:\"\s*\+\s*\w", shows=(_INPUT_JAVA + r"|getParameter\s*\(",), lacks=(r"\.startsWith\s*\(", r"(?i)allow(?:ed)?\w*")),
    Rule("sequential-io-operations", "medium", JAVA, _HTTP_JAVA, lacks=(r"\bCompletableFuture\b|\.zip\s*\(|parallel",), once=True, times=2),
    Rule("unrestricted-file-upload", "medium", JAVA, r"\bMultipartFile\s+\w+", shows=(r"\.(?:transferTo|getInputStream|getBytes)\s*\(",), lacks=(r"getContentType\s*\(|(?i:extension|allowed)",), once=True),
    Rule("incorrect-result-handling", "medium", JAVA, r"\.ifPresent\s*\(\s*[\w.]+(?:::save|\s*->[^;]*save)", shows=(r"\breturn\s+true\s*;",)),
    Rule("authorization", "high", JAVA, r"(?i)\b\w*role\w*\s*(?:==\s*null|\.(?:isBlank|isEmpty)\s*\(\))", shows=(r"(?i)@RequestHeader\s*\([^)]*role|getHeader\s*\(\s*\"[^\"]*role",), lacks=(r"(?i)\w*role\w*\.equals\w*\s*\(|\.equals\w*\s*\(\s*\w*role|hasRole|contains\s*\(\s*\w*role",)),
    Rule("insufficient-test-assertion", "medium", JAVA, r"\.andExpect\s*\(\s*status\(\)", shows=(r"@Test\b",), lacks=(r"jsonPath|content\s*\(\)|\bassert\w+\s*\(|\bverify\s*\(",), once=True),
    Rule("insufficient-test-assertion", "medium", JAVA, r"\.expectStatus\s*\(\)", shows=(r"@Test\b",), lacks=(r"expectBody|jsonPath|\bassert\w+\s*\(|\bverify\s*\(",), once=True),
    Rule("insufficient-test-assertion", "medium", JAVA, r"assert\w*\([^;]*(?:getTotal\w+|getPageNumber|getNumber)\s*\(\)", shows=(r"@Test\b",), lacks=(r"getContent\s*\(\)",), once=True),
    Rule("insufficient-test-assertion", "medium", JAVA, r"assertEquals\s*\([^;]*(?:200|HttpStatus\.OK|getStatus\w*\s*\(\))", shows=(r"@Test\b",), lacks=(r"getBody|jsonPath|\bverify\s*\(",), once=True),
    # C#
    Rule("unowned-background-task", "medium", CS, r"(?m)^\s*(?:_\s*=\s*)?Task\.(?:Run|Factory\.StartNew)\s*\(", lacks=(r"\bawait\s+Task\.Run|WhenAll",)),
    Rule("missing-cancellation-propagation", "medium", CS, r"\bawait\s+_?\w*[rR]epository\.\w+Async\s*\((?![^;]*(?:ct|[cC]ancel|[tT]oken))[^;]*\)", shows=(r"^[^{]*\bCancellationToken\b",)),
    Rule("missing-cancellation-propagation", "medium", CS, r"\bSearchAsync\s*\(", shows=(r"^[^{]*\bSearchAsync\s*\(",), lacks=(r"^[^{]*\bCancellationToken\b",), once=True),
    Rule("missing-cancellation-propagation", "medium", CS, _HTTP_CS, lacks=(r"CancellationToken|\bct\b|stoppingToken",), test=False, once=True),
    Rule("missing-cancellation-propagation", "medium", CS, _HTTP_CS + r"(?![^;]*(?:\bct\b|[cC]ancel|[tT]oken))[^;]*;", shows=(r"^[^{]*\bCancellationToken\b",), once=True),
    Rule("missing-cancellation-propagation", "medium", CS, r"\bawait\s+(?:Task\.Delay|[^;]*\.ToListAsync)\s*\((?![^;]*[tT]oken)[^;]*\)", shows=(r"^[^{]*\bstoppingToken\b",)),
    Rule("cache-consistency", "medium", CS, r"(?i)\b\w*cache\w*\s*\.\s*(?:TryGetValue|GetOrCreate\w*|Set)\s*\(\s*(?![^,)]*tenant)[^,)]+[,)]", shows=(r"(?i)^[^{]*\btenant\w*",), lacks=(r"(?i)key\w*\s*=\s*[^;]*tenant",)),
    Rule("empty-catch-block", "medium", CS + JAVA, r"\bcatch\s*(?:\([^)]*\))?\s*\{\s*(?://[^\n]*\n\s*|/\*.*?\*/\s*)*\}"),
    Rule("predictable-random-token", "high", CS, r"\bnew\s+Random\s*\(|\bRandom\.Shared\b", shows=(_TOKEN,)),
    Rule("predictable-random-token", "high", JS, r"\bMath\.random\s*\(", shows=(_TOKEN,)),
    Rule("resource-cleanup", "medium", CS, r"(?<!using )\b(?:var|FileStream|Stream\w+)\s+\w+\s*=\s*(?:new\s+(?:FileStream|Stream(?:Reader|Writer)|MemoryStream)|File\.Open\w*)\s*\(", lacks=(r"\.(?:Dispose|DisposeAsync|Close)\s*\(",)),
    Rule("resource-cleanup", "medium", CS, r"(?<!using )\bvar\s+response\s*=\s*await\s+[^;]*\.(?:Get|Post|Put|Send|Delete)Async\s*\(", lacks=(r"response\.Dispose\s*\(",)),
    Rule("sequential-io-operations", "medium", CS, r"\bawait\s+" + _HTTP_CS, lacks=(r"\bWhenAll\b",), test=False, once=True, times=2),
    Rule("tenant-isolation", "high", CS, r"\.Where\s*\([^;]*\.Name\b", shows=(r"(?i)^[^{]*tenant",), lacks=(r"(?i)\.Where\s*\([^;]*tenant",)),
    Rule("sql-injection", "high", CS, r"(?i)(?:\$\"[^\"]*\b(?:select|insert|update|delete)\b[^\"]*\{|\"\s*(?:select|insert|update|delete)\b[^\"]*\"\s*\+)", lacks=(r"Interpolated\s*\(|Parameters\.Add",)),
    Rule("ef-tracking-read", "low", CS, r"\.ToListAsync\s*\(", shows=(r"^[^{]*\b(?:Get|List|Find|Search)\w*\s*\(", r"_?(?:context|db)\w*\."), lacks=(r"AsNoTracking|SaveChanges",), once=True),
    Rule("n-plus-one-query", "medium", CS, r"\bforeach\s*\([^)]*\)\s*\{[^}]*\bawait\s+[^;]*(?:context|db|[rR]epository)\w*\.", once=True),
    Rule("null-safety", "medium", CS, r"\b(?:First|Single)OrDefault(?:Async)?\s*\([^;]*\)\s*;(?=[^}]*\b\w+\.\w+)", lacks=(r"(?:==|!=|is|is not)\s*null|\?\.|\?\?",)),
    Rule("missing-save-changes", "medium", CS, r"\bawait\s+[^;]*\.AddAsync\s*\(", shows=(r"_?(?:context|db)\w*\.",), lacks=(r"\bSaveChanges(?:Async)?\s*\(",)),
    Rule("unstable-pagination", "medium", CS, r"\.Skip\s*\(", lacks=(r"\.OrderBy",)),
    Rule("cors-misconfiguration", "high", CS, r"\.AllowAnyOrigin\s*\(", shows=(r"\.AllowCredentials\s*\(",), once=True),
    Rule("insecure-cookie", "high", CS, r"\.Cookies\.Append\s*\(", lacks=(r"(?s)HttpOnly\s*=\s*true.*Secure\s*=\s*true|Secure\s*=\s*true.*HttpOnly\s*=\s*true",)),
    Rule("developer-exception-page", "medium", CS, r"\.UseDeveloperExceptionPage\s*\(", lacks=(r"\bIsDevelopment\s*\(",)),
    Rule("background-cancellation", "medium", CS, r"\bwhile\s*\(\s*true\s*\)", shows=(r"^[^{]*\bstoppingToken\b",), lacks=(r"IsCancellationRequested",)),
    Rule("authorization", "high", CS, r"(?i)string\.IsNullOr(?:Empty|WhiteSpace)\s*\(\s*\w*role\w*", shows=(r"(?i)Headers\s*\[\s*\"[^\"]*role|FromHeader[^)]*role",), lacks=(r"(?i)\w*role\w*\s*[!=]=\s*\"|IsInRole|\.Equals\s*\(|\[Authorize",)),
    Rule("exception-detail-exposure", "medium", CS, r"\b(?:BadRequest|StatusCode|Problem|Ok|Json|Content)\s*\([^;]*\b(?:ex|e|exception)\.(?:Message|StackTrace|ToString\(\))"),
    Rule("path-traversal", "high", CS, r"\bPath\.Combine\s*\([^;]*[fF]ile[nN]ame", lacks=(r"\.StartsWith\s*\(|Path\.GetFileName\s*\(",)),
    Rule("path-traversal", "high", CS, r"\bFile\.(?:Create|OpenWrite|WriteAll\w+)\s*\([^;]*[fF]ile[nN]ame", lacks=(r"\.StartsWith\s*\(|Path\.GetFileName\s*\(",)),
    Rule("unrestricted-file-upload", "high", CS, r"\bIFormFile\s+\w+", shows=(r"\.CopyTo(?:Async)?\s*\(",), lacks=(r"ContentType|\.Length\s*[<>]|GetExtension",), once=True),
    Rule("ssrf", "high", CS, _HTTP_CS + r"\s*(?i:\w*(?:url|uri|endpoint|callback))\b", shows=(r"(?i)^[^{]*string\s+\w*(?:url|uri|endpoint|callback)",), lacks=(r"(?i)allowed?\w*|IsWellFormed|whitelist",)),
    Rule("open-redirect", "medium", CS, r"\bRedirect(?:Permanent)?\s*\(\s*(?i:\w*(?:url|uri|return\w*))\s*\)", lacks=(r"IsLocalUrl|LocalRedirect",), test=False),
    Rule("command-injection", "high", CS, r"\bProcess\.Start\s*\([^;]*(?:\$\"|\+|cmd|bash|powershell)|Arguments\s*=\s*(?:\$\"[^\"]*\{|[^;]*\+)", shows=(r"^[^{]*\(\s*[^)]+\)",)),
    Rule("mass-assignment", "high", CS, r"\[FromBody\]\s*(?:User|Account|Order|Customer|Product|Entity|\w+Entity)\s+\w+", lacks=(r"\b\w+(?:Dto|Request|Command)\s+\w+",), once=True),
    Rule("missing-endpoint-authorization", "high", CS, r"\[Http(?:Post|Put|Delete|Patch)[^\]]*admin[^\]]*\]", lacks=(r"\[Authorize",), once=True),
    Rule("insufficient-test-assertion", "low", CS, r"Assert\.\w+\s*\([^;]*(?:Page|TotalCount|PageSize)\b", shows=(r"\[(?:Fact|Theory|Test|TestMethod)\b",), lacks=(r"Assert\.\w+\s*\([^;]*(?:Items|Data|Results)\b",), once=True),
    Rule("insufficient-test-assertion", "low", CS, r"Assert\.(?:NotNull|IsNotNull)\s*\(", shows=(r"\[(?:Fact|Theory|Test|TestMethod)\b", r"\bawait\b"), lacks=(r"Assert\.(?!NotNull|IsNotNull)\w+\s*\(",), once=True),
    # JavaScript and TypeScript
    Rule("fetch-status-not-checked", "medium", JS, r"\bawait\s+fetch\s*\(", shows=(r"\.(?:json|text|blob)\s*\(",), lacks=(r"\.(?:ok|status)\b",), test=False),
    Rule("missing-timeout", "medium", JS, r"\bfetch\s*\((?![^;]*\bsignal\b)[^;]*\)", shows=(r"\bawait\b",), lacks=(r"\bAbortController\b|\bsignal\b",), test=False),
    Rule("null-safety", "medium", JS, r"\b(?:const|let|var)\s+(\w+)\s*=\s*document\.(?:getElementById|querySelector)\s*\([^)]*\)\s*;(?=(?:(?!\n\}).)*?\b\1\.)", lacks=(r"\bif\s*\(\s*!?\w+\s*\)|\?\.",)),
    Rule("path-traversal", "high", JS, r"\bpath\.(?:join|resolve)\s*\([^;]*(?:req\.\w+|\b(?:file[nN]ame|name|file|userPath)\b)", lacks=(r"\.startsWith\s*\(|path\.basename",)),
    Rule("async-issue", "medium", JS, r"\.addEventListener\s*\([^;]*?async\b[^;]*?\bawait\b", lacks=(r"\btry\s*\{|\.catch\s*\(",)),
    Rule("async-issue", "medium", JS, r"\.then\s*\(", lacks=(r"\.catch\s*\(|\btry\s*\{|\breturn\s+[^;]*\.then",), once=True, test=False),
    Rule("listener-cleanup", "medium", JS, r"\b(?!window|document)\w+\.addEventListener\s*\(", shows=(r"^[^{]*\b(?:setup|init|mount|attach|bind)\w*\s*\(",), lacks=(r"removeEventListener|\bsignal\b|once\s*:",)),
    Rule("direct-dom-manipulation", "medium", (".jsx", ".tsx"), r"\bdocument\.(?:getElementById|querySelector(?:All)?)\s*\(", lacks=(r"createRoot|hydrateRoot|ReactDOM",), test=False),
    Rule("unsafe-type-assertion", "medium", TS, r"\bas\s+unknown\s+as\s+\w+"),
    Rule("unsafe-type-assertion", "medium", TS, r"\b(\w+)\s+as\s+(?!const\b|unknown\b|any\b)[A-Z]\w*", shows=(r"^[^{]*\b\w+\s*:\s*unknown\b",), lacks=(r"\btypeof\b|\binstanceof\b|\bis[A-Z]\w*\s*\(",)),
    Rule("unsafe-indexed-access", "medium", TS, r"\b\w+\s*\[\s*[a-z]\w*\s*(?:as\s+[^\]]+)?\]", shows=(r"^[^{]*\b\w+\s*:\s*object\b",), lacks=(r"hasOwn|\bin\s+\w+\s*\)",)),
    Rule("broad-function-type", "medium", TS, r"[\w)]\s*:\s*Function\b", once=True),
    Rule("typescript-possibly-undefined-result", "medium", TS, r"\breturn\s+[\w.]+\.find\s*\(", shows=(r"^[^{]*\)\s*:\s*\w",), lacks=(r"^[^{]*\)\s*:[^{]*undefined|\?\?|\.find\s*\([^;]*\)\s*!",)),
    Rule("typescript-possibly-undefined-result", "medium", TS, r"\breturn\s+[\w.]+\[\s*[A-Za-z_]\w*\s*\]\s*;", shows=(r"^[^{]*\)\s*:\s*\w",), lacks=(r"^[^{]*\)\s*:[^{]*undefined|\bif\s*\(|\?\?",)),
    Rule("unvalidated-external-data", "medium", TS, r"\breturn\s+(?:await\s+)?\w+\.json\s*\(\s*\)", shows=(r"^[^{]*\)\s*:\s*Promise<",), lacks=(r"(?i)\.parse\s*\(|validate|schema",), test=False),
    Rule("prototype-pollution", "medium", JS, r"\b\w+\s*\[\s*(?:key|k|prop|name|path\w*)\s*\]\s*=[^=]", lacks=(r"__proto__|hasOwn|Object\.create\s*\(\s*null|new\s+Map",), test=False),
    Rule("typescript-use-before-assignment", "medium", TS, r"\blet\s+(\w+)\s*:\s*number\s*;(?=(?:(?!\1\s*=[^=]).)*?\b\1\s*(?:\+=|\+\+))"),
    Rule("typescript-use-before-assignment", "medium", TS, r"\blet\s+(\w+)\s*:\s*\w+\s*;(?=(?:(?!\1\s*=[^=]).)*?\breturn\s+\1\b)"),
    Rule("global-event-listener-without-removal", "medium", JS, r"\b(?:window|document)\.addEventListener\s*\(", lacks=(r"removeEventListener|\bsignal\b|once\s*:",)),
    Rule("rxjs-subscription-without-cleanup", "medium", TS, r"\b(?:interval|timer)\s*\([^;]*\.subscribe\s*\(", lacks=(r"takeUntil|unsubscribe|DestroyRef|\bfirst\s*\(|\btake\s*\(",), test=False),
    Rule("typescript-null-dereference", "medium", TS, r"^[^{]*\b(\w+)\s*:\s*[\w<>\[\]]+\s*\|\s*(?:null|undefined)\b[^{]*\{(?=.*?\b\1\.\w)", lacks=(r"\?\.|\bif\s*\(|&&|\?\?",)),
    Rule("typescript-optional-operand", "medium", TS, r"^[^{]*\b(\w+)\?\s*:\s*number\b[^{]*\{(?=.*?\b\1\s*[-+*/]\s*\w|.*?\w\s*[-+*/]\s*\1\b)", lacks=(r"\bif\s*\(|\?\?|&&",)),
    Rule("observer-without-cleanup", "medium", JS, r"\bnew\s+(?:Mutation|Resize|Intersection)Observer\s*\(", shows=(r"\.observe\s*\(",), lacks=(r"\.(?:disconnect|unobserve)\s*\(",), test=False),
)

_CONTROL = re.compile(r"\b(?:if|for|while|switch|catch|using|lock|foreach|do|else|try|synchronized|fixed|finally|return|new)\b\s*(?:await\s*)?\(")
_HEADER = re.compile(r"\)\s*(?:=>|throws\s[\w.,\s]+|where\s[^{]*|:\s*[^{;=]+|async|const)?\s*$")
_TESTS = re.compile(r"(?:\.(?:spec|test)\.[jt]sx?$|tests?\.(?:cs|java)$|(?:^|/)tests?/)", re.IGNORECASE)


@lru_cache(maxsize=1)
def _compiled() -> list[tuple[Rule, re.Pattern, list[re.Pattern], list[re.Pattern]]]:
    return [(r, re.compile(r.at, re.DOTALL), [re.compile(x, re.DOTALL) for x in r.shows], [re.compile(x, re.DOTALL) for x in r.lacks]) for r in RULES]


def callables(text: str) -> list[tuple[int, int]]:
    """The places where each callable begins, header and annotations included, and where its block ends."""
    out = []
    for m in re.finditer(r"\{", text):
        before = max(text.rfind(c, 0, m.start()) for c in ";{}")
        head = text[before + 1 : m.start()]
        if not _HEADER.search(head) or _CONTROL.search(re.sub(r"@\w+\s*\([^)]*\)|\[[^\]]*\]", "", head)):
            continue
        end = matching(text, m.start())
        if end is not None:
            out.append((before + 1 + len(head) - len(head.lstrip()), end + 1))
    return out


def method_findings(path: str, text: str) -> Iterator[tuple[int, str, str]]:
    """(offset, rule, severity) of the rules over the callables of a text; a place in nested callables counts for the inner one."""
    low = path.lower()
    mine = [x for x in _compiled() if low.endswith(x[0].files) and (x[0].test is None or x[0].test == bool(_TESTS.search(low))) and x[1].search(text)]
    if not mine:
        return
    spans = callables(text)
    for begin, end in spans:
        inner = [(a - begin, b - begin) for a, b in spans if begin < a and b < end]
        body = text[begin:end]
        for rule, at, shows, lacks in mine:
            hits = [m.start() + len(m[0]) - len(m[0].lstrip()) for m in at.finditer(body)]
            hits = [h for h in hits if not any(a <= h < b for a, b in inner)]
            if len(hits) < rule.times or not all(p.search(body) for p in shows) or any(p.search(body) for p in lacks):
                continue
            for h in hits[:1] if rule.once else hits:
                yield begin + h, rule.rule, rule.severity

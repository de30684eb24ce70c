"""The catalog of rules: keys, aliases, owners, severity clamps, policy, and the rules that read single lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlake.functions.paths import rule_key

#: Severities from the heaviest.
SEVERITIES = ["critical", "high", "medium", "low", "suggestion"]

#: Rule, category, owner, what a model may do with it, highest and lowest severity, and after a colon its aliases.
CATALOG = """
hardcoded-secret security static block - critical : security-101 password-hardcoded hardcoded-password hardcoded-credential hardcoded-credentials embedded-secret embedded-credential security-hardcoded-secret exposed-secret credential-hardcoded hardcoded-token hardcoded-api-key hardcoded-jwt-secret
unused-variable code-quality static block low - : unused-var unused-constant unused-variable-declaration unused-local-variable unused-local unnecessary-variable unnecessary-constant unnecessary-variable-declaration dead-variable dead-local-variable unused-code
unused-import code-quality static block low - : unused-import-statement unnecessary-import redundant-import
unused-parameter code-quality static block low - : unused-argument unused-function-argument unused-function-parameter unused-method-parameter
no-console code-quality static block low - : console-log console-statement console-log-statement console-logging debug-console console-debug
debugger code-quality static block medium - : debug-statement debugger-statement
debug-print code-quality static block low - : print-statement debug-print-statement
mutable-default-argument correctness static block medium - : mutable-default shared-mutable-default
identity-comparison-literal correctness static block medium - : literal-identity-comparison incorrect-identity-comparison
bare-except reliability static block medium - : bare-exception-handler catch-all-exception
sql-injection security ai validate - - : unsafe-sql dynamic-sql-injection
path-traversal security ai validate - - : directory-traversal unsafe-file-path
unsafe-deserialization security ai validate - - : insecure-deserialization unsafe-pickle unsafe-yaml-load
weak-cryptography security ai validate high - : weak-hash insecure-hash weak-crypto
unowned-background-task resource-lifecycle ai validate medium - : fire-and-forget-task discarded-background-task
exception-detail-exposure security ai validate medium - : exception-information-disclosure internal-error-exposure
explicit-any type-safety static block low - : typescript-explicit-any no-explicit-any
typescript-null-dereference type-safety static block medium - : typescript-possibly-null
typescript-optional-property type-safety static block medium -
typescript-optional-operand type-safety static block medium -
typescript-possibly-undefined-result correctness static block medium -
typescript-use-before-assignment correctness static block medium -
unsafe-type-assertion type-safety static block medium -
unsafe-indexed-access type-safety static block medium -
broad-function-type type-safety static block medium -
non-error-throw reliability static block medium -
unobserved-promise-rejection reliability static block medium -
timer-without-cleanup resource-lifecycle static block medium -
unvalidated-external-data type-safety static block medium -
jwt-signature-verification-disabled security static block high -
untrusted-identity-header security static block high -
http-status-not-checked reliability static block medium -
response-contract-mismatch correctness static block medium -
sequential-await-in-loop performance static block medium -
observer-without-cleanup resource-lifecycle static block medium -
prototype-pollution security static block high -
always-truthy-condition correctness static block medium -
non-exhaustive-union correctness static block medium -
loose-equality correctness static block medium - : javascript-loose-equality typescript-loose-equality non-strict-equality non-strict-comparison eqeqeq loose-equality-check loose-equality-operator equality-comparison comparison-operator
unreachable-code correctness static block medium - : dead-code-after-return unreachable-statement
empty-catch-block reliability static block medium - : no-empty-catch empty-catch swallowed-exception
json-parse-without-error-handling reliability static block medium - : json-parse json-parse-error json-parsing-error unsafe-json-parse unsafe-json-parsing insecure-json-parse insecure-json-parsing json-parse-security json-security json-injection
setinterval-without-timer-reference resource-lifecycle static block medium - : setinterval set-interval setinterval-without-retaining-timer-reference set-interval-without-retaining-timer-reference setinterval-without-referencing-timer set-interval-without-referencing-timer unhandled-interval interval-not-cleared timer-not-cleared
rxjs-subscription-without-cleanup resource-lifecycle static block medium - : angular-subscription-without-cleanup rxjs-missing-unsubscribe rxjs-subscription-leak
global-event-listener-without-removal resource-lifecycle static block medium - : global-event-listener global-listener window-event-listener unhandled-event-listener event-listener-without-removal
unsafe-inner-html security static block - - : xss-vulnerability dom-xss unsafe-html unsanitized-html
effect-cleanup resource-lifecycle framework block - - : missing-effect-cleanup missing-cleanup react-use-effect-cleanup react-missing-effect-cleanup react-effect-cleanup hook-cleanup
effect-dependency correctness framework block - - : react-use-effect-dependency react-hooks-missing-dependency react-empty-dependency-array missing-hook-dependency hook-dependency
direct-dom-manipulation framework-correctness framework block - - : react-direct-dom-manipulation direct-dom-access
fetch-status-not-checked reliability static block - - : missing-response-status-check fetch-response-status
logic-error correctness ai validate - -
error-handling reliability ai validate medium - : missing-error-handling unhandled-error unhandled-exception missing-exception-handling exception-not-handled fetch-error-handling missing-fetch-error-handling
async-issue reliability ai validate - - : unhandled-promise missing-await missing-async-await async-await-issue async-error
null-safety correctness ai validate - - : null-reference null-dereference possible-null-reference none-dereference nil-dereference
resource-cleanup resource-lifecycle ai validate - - : resource-leak missing-resource-cleanup resource-not-closed unclosed-resource
subscription-cleanup resource-lifecycle ai validate - - : missing-unsubscribe subscription-leak unclosed-subscription
listener-cleanup resource-lifecycle ai validate - - : event-listener-leak missing-listener-cleanup
api-misuse correctness ai validate - -
data-validation correctness ai validate - -
concurrency reliability ai validate - -
security security ai validate - -
duplicate-logic maintainability ai validate medium - : duplicated-code duplicate-code duplicated-logic code-duplication
performance performance ai validate medium - : performance-issue performance-problem performance-concern
maintainability maintainability ai validate medium - : code-maintainability maintainability-issue maintainability-problem
accessibility accessibility ai validate medium - : accessibility-issue accessibility-problem a11y a11y-issue
return-value-handling correctness ai validate low -
incorrect-result-handling correctness ai validate - -
async-blocking-operation reliability ai validate medium -
missing-timeout reliability ai validate medium -
authorization security ai validate - -
command-injection security ai validate - -
unsafe-code-execution security ai validate - -
cache-consistency correctness ai validate medium -
insufficient-test-assertion test-quality ai validate low -
sync-over-async reliability static block medium - : blocking-on-task task-result-blocking task-wait-blocking
null-forgiving-nullable correctness static block medium - : unsafe-null-forgiving suppressed-nullability
async-void reliability static block medium - : async-void-method
missing-cancellation-propagation reliability static block medium - : cancellation-token-not-propagated ignored-cancellation-token
pagination-offset correctness static block medium - : incorrect-pagination-offset one-based-pagination
predictable-random-token security static block - high : insecure-random weak-random-token weak-randomness predictable-token
weak-encryption security static block - high : ecb-mode insecure-cipher-mode aes-ecb
httpclient-lifetime resource-lifecycle static block medium - : httpclient-per-request new-httpclient-per-call
tenant-isolation security static block - high : missing-tenant-filter cross-tenant-data-access
ef-tracking-read performance static block low - : missing-as-no-tracking unnecessary-entity-tracking
n-plus-one-query performance static block medium - : n+1-query query-in-loop
missing-save-changes correctness static block medium - : missing-savechanges entity-not-persisted
unstable-pagination correctness static block medium - : pagination-without-order unordered-pagination
dbcontext-concurrency reliability static block - high : concurrent-dbcontext-use parallel-dbcontext-operations
singleton-mutable-state security static block - high : mutable-singleton-state singleton-request-state
cors-misconfiguration security static block - high : permissive-cors cors-any-origin-credentials
developer-exception-page security static block medium - : developer-errors-production detailed-errors-enabled
dependency-lifetime reliability static block - high : captive-dependency scoped-service-in-singleton
background-cancellation resource-lifecycle static block medium - : background-service-ignores-stop infinite-background-loop
unrestricted-file-upload security static block - high : unsafe-file-upload missing-upload-validation upload-security
missing-input-validation reliability static block medium - : request-validation-missing missing-validation unvalidated-request-body
sequential-io-operations performance static block medium - : sequential-network-calls blocking-sequential-http unparallelized-outbound-calls
ssrf security static block - high : server-side-request-forgery unsafe-outbound-url
open-redirect security static block medium - : unsafe-redirect unvalidated-redirect
mass-assignment security static block - high : over-posting overposting unsafe-model-binding
sensitive-data-logging security static block - high : password-logging credential-logging secret-logging log-sensitive-data
missing-endpoint-authorization security static block - high : missing-authorize unprotected-endpoint missing-authorization
insecure-cookie security static block - high : missing-httponly-cookie missing-secure-cookie insecure-cookie-header
debug-logging security static block low - : production-debug-logging verbose-production-logging
wildcard-postmessage security static block - high : postmessage-wildcard-origin unsafe-postmessage-origin
browser-token-storage security static block - high : localstorage-token script-readable-token-storage
"""
#: Rules that never become comments, by name or by the beginning of the name; highest severities besides the catalog's.
REJECTED = (
    "external-css-not-minified asset-not-minified css-not-minified js-not-minified naming-preference variable-naming function-naming class-naming formatting code-formatting style-preference cosmetic-cleanup"
    " consistent-cursor-styles consistent-border-radius consistent-font-size cursor-pointer-suggestion unnecessary-uppercase-heading uppercase-heading heading-uppercase text-transform-uppercase"
    " unnecessary-text-transform font-size-preference font-weight-preference line-height-preference letter-spacing-preference border-radius-preference padding-preference margin-preference color-preference"
    " unnecessary-absolute-positioning unnecessary-relative-positioning css-selector-preference css-class-reuse font-family-optimization font-family-duplication unnecessary-router-outlet suggestion-empty-block"
    " suggestion-empty-function empty-block empty-function unnecessary-empty-block unnecessary-empty-function empty-code-block empty-method empty-callback password-input-label unnecessary-else"
).split()
REJECTED_STARTS = "consistent- cosmetic- formatting- naming- style-preference- typography- visual-preference- suggestion-empty-".split()
HIGHEST = {
    "unsafe-json-parsing": "medium", "set-interval-without-retaining-timer-reference": "medium", "setinterval-without-retaining-timer-reference": "medium", "unhandled-interval": "medium",
    "unhandled-event-listener": "medium", "no-empty-catch": "medium", "environment-variable-usage": "low", "missing-password-strength-check": "suggestion",
}
#: Contexts that may stand before a known rule.
CONTEXTS = "react angular vue nextjs next javascript typescript js ts security frontend backend vite".split()


def rows() -> list[tuple]:
    """(rule_id, category, owner, ai_policy, highest, lowest, aliases) of each rule."""
    out = []
    for line in CATALOG.strip().splitlines():
        own, _, aliases = line.partition(" : ")
        rule, category, owner, policy, high, low = own.split()
        out.append((rule, category, owner, policy, None if high == "-" else high, None if low == "-" else low, aliases.split()))
    return out


def catalog(spark: SparkSession, more: list[tuple] = ()) -> DataFrame:
    """The catalog as a table, with rules that a caller registers; a later row of a rule replaces an earlier one."""
    last = {r[0]: r for r in [*rows(), *more]}
    return spark.createDataFrame(list(last.values()), "rule_id string, category string, owner string, ai_policy string, highest string, lowest string, aliases array<string>")


def aliases(spark: SparkSession) -> DataFrame:
    """(alias, rule_id): a few hundred rows, every rule an alias of itself."""
    t = catalog(spark)
    return t.select("rule_id", F.explode(F.array_union(F.array("rule_id"), "aliases")).alias("alias")).select(rule_key("alias").alias("alias"), "rule_id").dropDuplicates(["alias"])


def resolve(findings: DataFrame, column: str = "rule_id") -> DataFrame:
    """With canonical: the rule of a key, through its aliases, or through what follows contexts before it; itself if unknown.

    The table of aliases is of fixed size and is broadcast.
    """
    spark = findings.sparkSession
    a = aliases(spark).select(F.col("alias").alias("_a"), F.col("rule_id").alias("_r"))
    bare = F.regexp_replace(column, "^(" + "|".join(CONTEXTS) + ")-((" + "|".join(CONTEXTS) + ")-)*", "")
    b = a.toDF("_b", "_s")
    return (
        findings.join(F.broadcast(a), F.col(column) == F.col("_a"), "left")
        .join(F.broadcast(b), bare == F.col("_b"), "left")
        .withColumn("canonical", F.coalesce("_r", "_s", F.col(column)))
        .drop("_a", "_r", "_b", "_s")
    )


def rank(severity: Column) -> Column:
    """0 for critical to 4 for suggestion; null for others."""
    out = F.lit(None).cast("int")
    for k, s in enumerate(SEVERITIES):
        out = F.when(severity == s, k).otherwise(out)
    return out


def named(r: Column) -> Column:
    return F.get(F.array(*map(F.lit, SEVERITIES)), r)


def clamp(findings: DataFrame) -> DataFrame:
    """Severities within the bounds of their canonical rule: the lowest is applied before the highest."""
    c = catalog(findings.sparkSession).select(F.col("rule_id").alias("_r"), rank(F.col("highest")).alias("_h"), rank(F.col("lowest")).alias("_l"))
    r = rank(F.col("severity"))
    return findings.join(F.broadcast(c), F.col("canonical") == F.col("_r"), "left").withColumn("severity", F.when(r.isNotNull(), named(F.greatest(F.least(r, F.coalesce("_l", r)), F.coalesce("_h", F.lit(0)))))).drop("_r", "_h", "_l")


def policy(findings: DataFrame) -> DataFrame:
    """Without rejected rules, and no severity above the ceiling of its rule."""
    starts = F.lit(False)
    for s in REJECTED_STARTS:
        starts = starts | F.col("canonical").startswith(s)
    top = F.lit(None).cast("int")
    for rule, s in HIGHEST.items():
        top = F.when(F.col("canonical") == rule, SEVERITIES.index(s)).otherwise(top)
    r = rank(F.col("severity"))
    return findings.where(~F.coalesce(F.col("canonical").isin(REJECTED) | starts, F.lit(False))).withColumn("severity", named(F.greatest(r, F.coalesce(top, r))))


#: Rules that a single added line shows: rule, severity, files, pattern.
JS = r"\.(?:js|jsx|mjs|cjs|ts|tsx)$"
PY = r"\.pyw?$"
CS = r"\.cs$"
JAVA = r"\.java$"
LINE_RULES = [
    ("no-console", "low", JS, r"\bconsole\s*\.\s*log\s*\("),
    ("debugger", "medium", JS, r"^\s*debugger\s*;?\s*$"),
    ("loose-equality", "medium", JS, r"[^=!<>]==[^=]|!=[^=]"),
    ("explicit-any", "low", r"\.tsx?$", r":\s*any\b|<\s*any\s*>"),
    ("unsafe-inner-html", "high", JS, r"\.innerHTML\s*\+?=[^=]"),
    ("open-redirect", "medium", JS, r"\blocation\.href\s*=\s*[A-Za-z_$]"),
    ("wildcard-postmessage", "high", JS, r"\.postMessage\s*\([^)]*,\s*['\"]\*['\"]"),
    ("browser-token-storage", "high", JS, r"(?i)\blocalStorage\.setItem\s*\(\s*['\"][^'\"]*(?:token|session|auth)"),
    ("command-injection", "high", JS, r"\bexec\s*\(\s*(?:`[^`]*\$\{|['\"][^'\"]*['\"]\s*\+)"),
    ("sql-injection", "high", JS, r"(?i)\.query\s*\(.*(?:select|insert|update|delete)\b.*(?:\$\{|['\"]\s*\+)"),
    ("sensitive-data-logging", "high", JS, r"(?i)\b(?:console|logger)\.\w+\s*\([^)]*password"),
    ("non-error-throw", "medium", r"\.tsx?$", r"\bthrow\s+(?:['\"`]|\d)"),
    ("debug-print", "low", PY, r"^\s*print\s*\("),
    ("bare-except", "medium", PY, r"^\s*except\s*:"),
    ("unsafe-code-execution", "high", PY, r"(?:^|[^\w.])(?:eval|exec)\s*\("),
    ("unsafe-deserialization", "high", PY, r"\b(?:pickle|dill)\.loads?\s*\("),
    ("weak-cryptography", "medium", PY, r"\bhashlib\.(?:md5|sha1)\s*\("),
    ("mutable-default-argument", "medium", PY, r"^\s*(?:async\s+)?def\s+\w+\(.*=\s*(?:\[\]|\{\}|list\(\)|dict\(\)|set\(\))"),
    ("command-injection", "high", PY, r"\bshell\s*=\s*True\b"),
    ("async-void", "medium", CS, r"\basync\s+void\b"),
    ("sync-over-async", "medium", CS, r"\.(?:Result\b|Wait\(\)|GetAwaiter\(\)\.GetResult\(\))"),
    ("null-safety", "medium", JS, r"\bdocument\.(?:getElementById|querySelector)\s*\([^)]*\)\s*\.\s*\w"),
    ("authorization", "high", JS, r"(?i)\bheaders\s*(?:\[\s*['\"]|\.get\(\s*['\"]|\.)\s*x-(?:user-)?(?:role|admin)"),
    ("insufficient-test-assertion", "medium", r"\.(?:spec|test)\.[jt]sx?$", r"\bexpect\s*\(\s*(?:result|response|data)\w*\s*\)\s*\.\s*(?:toBeTruthy|toBeDefined)\s*\("),
    ("insufficient-test-assertion", "medium", r"\.(?:spec|test)\.[jt]sx?$", r"\bexpect\s*\([^)]*\)\s*\.\s*(?:toBeUndefined\s*\(|toBe\s*\(\s*undefined\s*\)|toEqual\s*\(\s*undefined\s*\))"),
    ("unobserved-promise-rejection", "medium", r"\.tsx?$", r"^\s*Promise\.reject\s*\([^)]*\)\s*;"),
    ("always-truthy-condition", "medium", r"\.tsx?$", r"\bif\s*\([^)]*\|\|\s*(?:'[^']+'|\"[^\"]+\")\s*\)"),
    ("logic-error", "medium", JAVA, r"(?i)\b(?:offset|skip|setFirstResult)\w*\s*(?:=|\()\s*page\w*\s*\*\s*\w*size"),
    ("command-injection", "high", JAVA, r"\.exec\s*\([^)]*(?:\"\s*\+|\+\s*\w)"),
    ("sql-injection", "high", JAVA, r"\bcreateNativeQuery\s*\(.*(?:\"\s*\+|\+\s*\w)"),
    ("path-traversal", "high", JAVA, r"\.resolve\s*\(\s*\w*[eE]ntry\.getName\s*\(\s*\)"),
    ("unsafe-deserialization", "high", JAVA, r"\.readObject\s*\(\s*\)"),
    ("weak-cryptography", "high", JAVA, r"(?i)\bgetInstance\s*\(\s*\"(?:md5|sha-?1)\""),
    ("exception-detail-exposure", "medium", JAVA, r"\b(?:ResponseEntity|body)\b.*\b(?:e|ex|exception)\.getMessage\s*\("),
    ("data-validation", "high", JAVA, r"\bBeanUtils\.copyProperties\s*\(\s*(?:request|dto|input)\w*\s*,"),
    ("unowned-background-task", "medium", JAVA, r"^\s*CompletableFuture\.(?:runAsync|supplyAsync)\s*\("),
    ("sensitive-data-logging", "high", JAVA, r"(?i)\b(?:log|logger)\.\w+\s*\(.*password"),
    ("missing-input-validation", "medium", JAVA, r"[(,]\s*@RequestBody\s+[A-Z]"),
    ("insufficient-test-assertion", "medium", r"(?i)tests?\.java$", r"\bassert(?:True|NotNull)\s*\(\s*\w*[sS]ervice\.(?:save|update|delete|create)\w*\s*\("),
    ("null-forgiving-nullable", "medium", CS, r"(?:\bawait\b[^;]*\)|\.Result)!\s*[.;]"),
    ("missing-cancellation-propagation", "medium", CS, r"\.SaveChangesAsync\s*\(\s*\)"),
    ("pagination-offset", "medium", CS, r"\.Skip\s*\(\s*page\w*\s*\*\s*\w+\s*\)"),
    ("weak-cryptography", "high", CS, r"\b(?:MD5|SHA1)(?:\.(?:Create|HashData)\s*\(|CryptoServiceProvider\b|Managed\b)"),
    ("weak-encryption", "high", CS, r"\bCipherMode\.ECB\b"),
    ("httpclient-lifetime", "medium", CS, r"^\s*(?:var|HttpClient)\s+\w+\s*=\s*new\s+HttpClient\s*\("),
    ("dbcontext-concurrency", "high", CS, r"\bWhenAll\s*\(.*_?(?:context|db)\w*\..*_?(?:context|db)\w*\."),
    ("singleton-mutable-state", "high", CS, r"\bAddSingleton\s*<[^>]*(?:Tenant|Request|User)\w*(?:State|Context|Session)"),
    ("dependency-lifetime", "high", CS, r"\bclass\s+\w+\s*\([^)]*DbContext\b[^)]*\)\s*:\s*BackgroundService"),
    ("mass-assignment", "high", CS, r"\.(?:IsAdmin|Role|Roles|IsVerified|Balance)\s*=\s*(?:request|input|dto|model)\w*\."),
    ("sensitive-data-logging", "high", CS, r"(?i)\b_?log(?:ger)?\.\w+\s*\(.*password"),
    ("hardcoded-secret", "critical", r"(?:^|/)appsettings[\w.]*\.json$", r"(?i)\bpassword=[^;\"{$]{3,}"),
    ("debug-logging", "low", r"(?:^|/)appsettings[\w.]*\.json$", r"\"Default\"\s*:\s*\"(?:Trace|Debug)\""),
    ("insufficient-test-assertion", "low", r"(?i)tests?\.cs$", r"\bAssert\.Equal\s*\(\s*0\s*,.*[pP]arse"),
    ("insufficient-test-assertion", "low", r"(?i)tests?\.cs$", r"\bAssert\.IsType\s*<\s*(?:OkResult|NoContentResult|OkObjectResult)\s*>\s*\(.*[uU]pdate"),
    ("insufficient-test-assertion", "low", r"(?i)tests?\.cs$", r"\bAssert\.NotNull\s*\(.*[cC]lear"),
    ("hardcoded-secret", "critical", r".", r"(?i)\b[\w-]*(?:password|passwd|secret|api_?key|access_?token|auth_?token|private_?key)[\w-]*['\"]?\s*[:=]\s*(?:\"[^\"']{6,}\"|'[^\"']{6,}')"),
]
#: Literals that stand for a secret without being one.
STAND_INS = "changeme change-me example placeholder password secret your-password your_password".split()


def line_findings(lines: DataFrame, keep: list[str], rules: list[tuple] = LINE_RULES) -> DataFrame:
    """(keep..., line_number, rule_id, severity): all rules over all added lines in one pass; path and content are read."""
    low, value = F.lower("path"), F.lower(F.regexp_extract("content", r"[:=]\s*[\"']([^\"']+)[\"']", 1))
    real = ~value.isin(STAND_INS) & ~value.rlike(r"^[x*.]+$|^\$\{|^\{\{|^<")
    # the kind of file, which rules out most rules, is asked once for all of its rules
    kinds: dict[str, list[Column]] = {}
    for rule, severity, files, pattern in rules:
        hit = F.col("content").rlike(pattern) & (real if rule == "hardcoded-secret" else F.lit(True))
        kinds.setdefault(files, []).append(F.when(hit, F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"))))
    none = F.array().cast("array<struct<rule_id:string,severity:string>>")
    found = F.concat(*(F.when(low.rlike(files), F.array_compact(F.array(*some))).otherwise(none) for files, some in kinds.items()))
    # an outer explode: of an inner one, the optimizer would ask for the size of the array first, by all patterns once more
    return lines.select(*keep, "line_number", F.explode_outer(found).alias("f")).where("f is not null").select(*keep, "line_number", "f.rule_id", "f.severity")

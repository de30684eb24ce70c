"""All queries of the engine by name, with the SQL that gives the same rows.

The tables are read whole. Where a query keeps the first rows of an order, that is what it is for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlake.functions import paths
from patchlake.operators import classify, detection, diff, enrich, findings, history, planning, projects, responses, rules, syntax, validation
from patchlake.runtime import table
from patchlake.sources import review_tables as tables
from patchlake.streaming import progress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "review_gate"
KEY = ["provider", "repository", "number"]


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# ---- parts of the SQL ---------------------------------------------------------------------------------------------------

FILES = r"""files as (
    select distinct file_id, lower(provider) provider, repository, number, regexp_replace(replace(file_path, '\', '/'), '^(\./)+', '') path, status, language, patch from changed_files)"""

#: Every line of every patch with its kind, its place, the start of its hunk and how far the hunk has moved.
LINES = (
    FILES
    + r""",
    cut as (select *, regexp_split_to_array(patch, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') a from files where patch is not null),
    trimmed as (select * exclude (a), case when a[len(a)] = '' then a[:len(a) - 1] else a end a from cut),
    raw as (select file_id, provider, repository, number, path, unnest(a) line, generate_subscripts(a, 1) pos from trimmed),
    kinds as (select *, case when regexp_matches(line, '^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@') then '@' when starts_with(line, '+++') then 'p' when starts_with(line, '+') then '+'
        when starts_with(line, '-') then '-' when starts_with(line, '\') then 'n' else '.' end kind from raw),
    hunked as (select *, sum((kind = '@')::int) over w hunk, sum((kind <> '@')::int) over w diff_position from kinds window w as (partition by file_id order by pos)),
    moved as (select *, coalesce(max(case when kind = '@' then regexp_extract(line, '^@@ -\d+(?:,\d+)? \+(\d+)', 1)::int end) over (partition by file_id, hunk), 0) start,
        sum((kind not in ('-', 'p', '@'))::int) over (partition by file_id, hunk order by pos) - (kind not in ('-', 'p', '@'))::int moves from hunked),
    added as (select file_id, provider, repository, number, path, (start + moves)::int line_number, line[2:] content, diff_position::int diff_position, pos, hunk from moved
        where kind = '+' and regexp_matches(line[2:], '[^\s\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{2028}\x{2029}\x{3000}]'))"""
)

FINDINGS = r"""findings as (
    select distinct manifest_id seq, repository, regexp_replace(replace(regexp_replace(location, ':\d*$', ''), '\', '/'), '^(\./)+', '') path,
        case when regexp_matches(location, ':\d+$') then regexp_extract(location, ':(\d+)$', 1)::int end line_number,
        case when trim(coalesce(severity, '')) = '' then null else lower(trim(severity)) end severity,
        nullif(regexp_replace(regexp_replace(lower(trim(rule)), '[\s_-]+', '-', 'g'), '^-+|-+$', '', 'g'), '') rule_id,
        lower(trim(category)) category, issue, impact, evidence, suggestion
    from python_findings_manifest)"""

RANK = "case {} when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 when 'suggestion' then 4 end"
SUFFIX = r"lower(regexp_extract(string_split(path, '/')[-1], '[^.](\.[^.]+)$', 1))"

RULES = "rules as (select * from (values " + ", ".join(
    f"('{r}', '{c}', '{o}', '{p}', {'null' if h is None else chr(39) + h + chr(39)}, {'null' if low is None else chr(39) + low + chr(39)})" for r, c, o, p, h, low, _ in rules.rows()
) + ") t(rule_id, category, owner, ai_policy, highest, lowest))"


def _alias_sql() -> str:
    pairs: dict[str, str] = {}
    for r, *_, names in rules.rows():
        pairs.setdefault(r, r)
    for r, *_, names in rules.rows():
        for n in names:
            pairs.setdefault(n, r)
    return "aliases as (select * from (values " + ", ".join(f"('{a}', '{r}')" for a, r in pairs.items()) + ") t(alias, rule_id))"


ALIASES = _alias_sql()
CANONICAL = (
    FINDINGS
    + ", "
    + ALIASES
    + f""", canonical as (select f.*, coalesce(a.rule_id, b.rule_id, f.rule_id) canonical from findings f left join aliases a on a.alias = f.rule_id
    left join aliases b on b.alias = regexp_replace(f.rule_id, '^({"|".join(rules.CONTEXTS)})-(({"|".join(rules.CONTEXTS)})-)*', ''))"""
)

EVENTS = """log as (select user_id job, event_id, event_id seq, ts, case event_type when 'signup' then 'running' when 'purchase' then 'completed' when 'error' then 'failed' when 'view' then 'queued' else 'note' end kind,
    floor(value)::int progress from events)"""


# ---- sources ------------------------------------------------------------------------------------------------------------


@query("select provider, repository, number, title, lower(state) state from change_sets group by all")
def scan_change_sets(spark, d):
    return tables.change_sets(spark, d).select(*KEY, "title", "state").distinct()


@query(f"with {FILES} select provider, repository, number, count(*) files from files group by all")
def count_changed_files(spark, d):
    return tables.files(spark, d).groupBy(*KEY).agg(F.count("*").alias("files"))


@query("""with s as (select distinct lower(provider) provider, repository, number, commit_count, created_at from change_sets),
    c as (select lower(provider) provider, repository, number, count(distinct file_id) n from changed_files group by all),
    one as (select provider, repository, number, max(commit_count) n, max(created_at) as made from s group by all),
    first as (select * from one order by made desc nulls last, provider, repository, number limit 30)
    select o.provider, o.repository, o.number, coalesce(o.n, case when f.number is not null then c.n end, -1)::bigint n from one o
    left join first f on f.provider is not distinct from o.provider and f.repository is not distinct from o.repository and f.number is not distinct from o.number
    left join c on c.provider = o.provider and c.repository = o.repository and c.number = o.number""")
def enriched_change_sets(spark, d):
    one = table(spark, d, "change_sets").groupBy(F.lower("provider").alias("provider"), "repository", "number").agg(F.max("commit_count").cast("long").alias("n"), F.max("created_at").alias("made"))
    counts = table(spark, d, "changed_files").groupBy(F.lower("provider").alias("provider"), "repository", "number").agg(F.countDistinct("file_id").alias("n"))
    return history.enriched(one, [F.desc_nulls_last("made"), *map(F.col, KEY)], counts, KEY).withColumn("n", F.coalesce("n", F.lit(-1).cast("long")))


@query(f"""with {FILES}, eligible as (select file_id from files where status <> 'removed' and path not like '%.lock')
    select f.file_id, f.path, case when e.file_id is not null then coalesce(length(f.patch), 0) else 0 end::bigint hydrated from files f left join eligible e using (file_id)""")
def hydrate_eligible(spark, d):
    f = tables.files(spark, d)
    return f.select("file_id", "path", F.when((F.col("status") != "removed") & ~F.col("path").endswith(".lock"), F.coalesce(F.length("patch"), F.lit(0))).otherwise(0).cast("long").alias("hydrated"))


# ---- parsing ------------------------------------------------------------------------------------------------------------


@query(f"with {LINES} select file_id, line_number, content, diff_position from added")
def added_lines(spark, d):
    return diff.added_lines(tables.files(spark, d), ["file_id"])


@query(f"with {LINES} select file_id, hunk::int hunk, min(start)::int new_start, count(*) filter (kind = '+') added_lines from moved where hunk > 0 group by file_id, hunk")
def hunk_sizes(spark, d):
    return diff.hunks(tables.files(spark, d), ["file_id"]).select("file_id", "hunk", "new_start", F.size("added").cast("long").alias("added_lines"))


@query(f"""with {LINES}, c as (select file_id, sum((kind = '+')::int) p, sum((starts_with(line, '-') and not starts_with(line, '---'))::int) m from kinds group by all)
    select f.provider, f.repository, f.number, bool_and(f.patch is not null) known, case when bool_and(f.patch is not null) then sum(coalesce(p, 0)) else 0 end::bigint additions, case when bool_and(f.patch is not null) then sum(coalesce(m, 0)) else 0 end::bigint deletions
    from files f left join c using (file_id) group by all""")
def run_line_counts(spark, d):
    n = diff.run_counts(tables.files(spark, d), KEY)
    return n.select(*KEY, F.col("additions").isNotNull().alias("known"), F.coalesce("additions", F.lit(0)).alias("additions"), F.coalesce("deletions", F.lit(0)).alias("deletions"))


@query(f"""with {LINES}, c as (select file_id, sum((starts_with(line, '+'))::int) p, sum((starts_with(line, '-'))::int) m from hunked where hunk > 0 and not starts_with(line, '@@') group by all)
    select file_id, coalesce(p, 0)::bigint additions, coalesce(m, 0)::bigint deletions from files left join c using (file_id)""")
def api_line_counts(spark, d):
    return diff.api_counts(tables.files(spark, d), ["file_id"]).select("file_id", F.col("additions").cast("long").alias("additions"), F.col("deletions").cast("long").alias("deletions"))


# ---- classification -----------------------------------------------------------------------------------------------------


def _category_sql() -> str:
    within = lambda what, values: f"list_has_any({what}, [{_list(values)}])"
    ends = lambda values: "(" + " or ".join(f"ends_with(name, '{v}')" for v in values) + ")"
    starts = lambda values: "(" + " or ".join(f"starts_with(name, '{v}')" for v in values) + ")"
    holds = lambda values: "(" + " or ".join(f"contains(name, '{v}')" for v in values) + ")"
    c = classify
    return f"""case when {within("parts", c.ASSISTANT_FOLDERS)} or contains('/' || array_to_string(parts, '/'), '/.github/skills/') then 'tool_configuration'
        when {within("folders", c.E2E_FOLDERS)} or len(list_filter(folders, lambda x: ends_with(x, '-e2e'))) > 0 or {holds(c.E2E_MARKS)} then 'end_to_end'
        when name in ({_list(c.CONTEXT_NAMES)}) or {ends(c.CONTEXT_ENDS)} or {starts(c.CONTEXT_STARTS)} then 'context_configuration'
        when name in ({_list(c.LOCK_NAMES)}) then 'lock_file' when suffix in ({_list(c.BINARY)}) then 'binary'
        when suffix = '.svg' and {within("folders", c.ASSET_FOLDERS)} then 'static_asset'
        when {within("folders", c.OUTPUT_FOLDERS)} or {ends(c.OUTPUT_ENDS)} then 'generated'
        when name in ({_list(c.TOOL_NAMES)}) or {starts(c.TOOL_STARTS)} then 'tool_configuration'
        when name in ({_list(c.CONFIG_NAMES)}) or {ends(c.CONFIG_ENDS)} or suffix in ({_list(c.CONFIG)}) then 'project_configuration'
        when {within("folders", c.TEST_FOLDERS)} or {holds(c.TEST_MARKS)} then 'test'
        when suffix in ({_list(c.SOURCE)}) then 'source_code' when suffix in ({_list(c.TEMPLATES)}) then 'template'
        when suffix in ({_list(c.STYLES)}) then 'stylesheet' when suffix in ({_list(c.DOCUMENTS)}) then 'documentation' else 'unknown' end"""


CATEGORIES = (
    FILES
    + f""", named as (select *, string_split(lower(path), '/') parts, string_split(lower(path), '/')[:-2] folders, lower(string_split(path, '/')[-1]) as name, {SUFFIX} suffix from files),
    categories as (select *, {_category_sql()} category from named)"""
)


@query(f"with {CATEGORIES} select file_id, category from categories")
def classify_files(spark, d):
    return classify.categorized(tables.files(spark, d).select("file_id", "path")).select("file_id", "category")


@query(f"with {FILES} select file_id, coalesce(case {' '.join(f'when {SUFFIX} in (' + _list(e.split()) + f') then ' + chr(39) + n + chr(39) for n, e in classify.LANGUAGES.items())} end, 'unknown') as lang from files")
def file_language(spark, d):
    return tables.files(spark, d).select("file_id", classify.language(F.col("path")).alias("lang"))


ROUTES = (
    CATEGORIES.replace(FILES, LINES)
    + rf""", contents as (select file_id, list(content) c from added group by all),
    meaning as (select file_id, list_filter([trim(x, E' \t\f\x0b') for x in c], lambda x: x <> '' and not regexp_matches(x, '^(//|/\*|\*|\*/)')) m from contents),
    routes as (select f.file_id, f.provider, f.repository, f.number, f.category, case when m is null then 'skip: no lines'
        when ends_with(name, '.sln') or name in ({_list(classify.BARRELS)}) and len(list_filter(m, lambda x: not regexp_matches(x, '^(import |export \*|export \{{|export type \{{|export type \*|global using |using )'))) = 0 then 'skip: barrel'
        when category not in ({_list(classify.REVIEWED)}) then 'skip: ' || category else category end route from categories f left join meaning using (file_id))"""
)


def _routes(spark, d):
    f = tables.files(spark, d)
    content = F.filter(F.transform(F.filter(F.coalesce(paths.split_lines("patch"), F.array().cast("array<string>")), lambda x: x.startswith("+") & ~x.startswith("+++")), lambda x: F.substring(x, 2, 1 << 30)), lambda x: x.rlike(diff.NOT_BLANK))
    return classify.routed(f.select(*KEY, "file_id", "path", content.alias("contents"))).select(*KEY, "file_id", "route")


@query(f"with {ROUTES} select file_id, route from routes")
def route_files(spark, d):
    return _routes(spark, d).select("file_id", "route")


@query(f"with {ROUTES} select provider, repository, number, count(*) filter (not starts_with(route, 'skip')) kept, count(*) filter (starts_with(route, 'skip')) skipped from routes group by all")
def route_partition(spark, d):
    skip = F.col("route").startswith("skip")
    return _routes(spark, d).groupBy(*KEY).agg(F.count_if(~skip).alias("kept"), F.count_if(skip).alias("skipped"))


@query(f"""with {ROUTES}, c as (select provider, repository, number, substr(route, 7) reason, count(*)::int n from routes where starts_with(route, 'skip') group by all)
    select provider, repository, number, map_from_entries(list({{'k': reason, 'v': n}} order by reason)) skipped_by_reason from c group by all""")
def skip_histogram(spark, d):
    rows = _routes(spark, d).where(F.col("route").startswith("skip")).withColumn("reason", F.substring("route", 7, 100))
    return findings.histogram(rows, KEY, "reason", "skipped_by_reason")


# ---- rules and findings -------------------------------------------------------------------------------------------------


def _canonical(spark, d):
    return rules.resolve(tables.findings(spark, d))


@query(f"with {CANONICAL} select seq, rule_id, canonical from canonical")
def canonical_rules(spark, d):
    return _canonical(spark, d).select("seq", "rule_id", "canonical")


NAMED = "[{}][{} + 1]".format("'critical', 'high', 'medium', 'low', 'suggestion'", "{}")
CLAMPED = (
    CANONICAL
    + ", "
    + RULES
    + f""", clamped as (select c.* exclude (severity), case when r is not null then {NAMED.format("greatest(least(r, coalesce(l, r)), coalesce(h, 0))")} end severity from
    (select c.*, {RANK.format("severity")} r, {RANK.format("highest")} h, {RANK.format("lowest")} l from canonical c left join rules on rules.rule_id = c.canonical) c)"""
)


@query(f"with {CLAMPED} select seq, canonical, severity from clamped")
def clamp_severity(spark, d):
    return rules.clamp(_canonical(spark, d)).select("seq", "canonical", "severity")


@query(f"""with {CLAMPED} select seq, canonical, case {" ".join(f"when canonical = '{r}' then " + NAMED.format(f"greatest({RANK.format('severity')}, {rules.SEVERITIES.index(s)})") for r, s in rules.HIGHEST.items())} else severity end severity
    from clamped where coalesce(canonical not in ({_list(rules.REJECTED)}) and not ({" or ".join(f"starts_with(canonical, '{s}')" for s in rules.REJECTED_STARTS)}), true)""")
def policy_findings(spark, d):
    return rules.policy(rules.clamp(_canonical(spark, d))).select("seq", "canonical", "severity")


@query(f"""with {FINDINGS}, {FILES}, known as (select distinct repository, path from files)
    select seq, k.path is not null matched from findings f left join known k using (repository, path)""")
def findings_in_changed_files(spark, d):
    return findings.matched_files(tables.findings(spark, d), tables.files(spark, d), ["repository", "path"]).select("seq", "matched")


@query(f"with {FINDINGS}, {LINES} select seq from findings f where exists (select 1 from added a where a.repository = f.repository and a.path = f.path and a.line_number = f.line_number)")
def commentable_findings(spark, d):
    lines = diff.added_lines(tables.files(spark, d), ["repository", "path"])
    return findings.commentable(tables.findings(spark, d), lines, ["repository", "path"]).select("seq")


GATE = """count(*) filter (severity = 'critical') critical_count, count(*) filter (severity = 'high') high_count, count(*) filter (severity = 'medium') medium_count,
    count(*) filter (severity = 'low') low_count, count(*) filter (severity = 'suggestion') suggestion_count,
    case when count(*) filter (severity = 'critical') > 0 then 'block' when count(*) filter (severity = 'high') > 0 then 'request_changes' when count(*) filter (severity = 'medium') > 0 then 'review_recommended'
    when count(*) filter (severity = 'low') > 0 then 'non_blocking' when count(*) filter (severity = 'suggestion') > 0 then 'optional' else 'pass' end decision"""


@query(f"with {FINDINGS} select repository, {GATE} from findings group by all")
def quality_gate(spark, d):
    return findings.gate(tables.findings(spark, d), ["repository"])


def _line_rule_sql() -> str:
    out = []
    for rule, severity, files, pattern in rules.LINE_RULES:
        more = ""
        if rule == "hardcoded-secret":
            more = f""" and v not in ({_list(rules.STAND_INS)}) and not regexp_matches(v, '^[x*.]+$|^\\$\\{{|^\\{{\\{{|^<')"""
        quoted, shown = pattern.replace("'", "''"), files.replace("'", "''")
        out.append(f"select file_id, provider, repository, number, line_number, '{rule}' rule_id, '{severity}' severity from valued where regexp_matches(lower(path), '{shown}') and regexp_matches(content, '{quoted}'){more}")
    return r"""valued as (select *, lower(regexp_extract(content, '[:=]\s*["'']([^"'']+)["'']', 1)) v from added), fired as (""" + " union all ".join(out) + ")"


FIRED = LINES + ", " + _line_rule_sql()


def _fired(spark, d):
    lines = diff.added_lines(tables.files(spark, d), [*KEY, "file_id", "path"])
    return rules.line_findings(lines, [*KEY, "file_id"])


@query(f"with {FIRED} select file_id, line_number, rule_id, severity from fired")
def line_rule_findings(spark, d):
    return _fired(spark, d).select("file_id", "line_number", "rule_id", "severity")


@query(f"with {FIRED} select provider, repository, number, {GATE} from fired group by all")
def review_gate(spark, d):
    return findings.gate(_fired(spark, d), KEY)


@query(f"with {FINDINGS} select repository, map_from_entries(list({{'k': category, 'v': n}} order by category)) by_category from (select repository, category, count(*)::int n from findings where category is not null group by all) group by all")
def category_histogram(spark, d):
    return findings.histogram(tables.findings(spark, d), ["repository"], "category", "by_category")


GROUPS = f"""ranked as (select *, {RANK.format("severity")} r from findings), groups as (select repository, path, line_number, list(rule_id order by r, seq) rules, min(r)::int first_rank, arg_min(seq, r * 1000000000000 + seq) first_seq
    from ranked where r is not null and line_number is not null group by repository, path, line_number)"""


@query(f"with {FINDINGS}, {GROUPS} select * from groups")
def findings_by_line(spark, d):
    return findings.line_groups(tables.findings(spark, d).where("line_number is not null"), ["repository", "path"])


@query(f"with {FINDINGS}, {GROUPS} select repository, path, line_number, first_seq, row_number() over (partition by repository order by first_rank, first_seq) <= 40 published from groups")
def publish_quota(spark, d):
    groups = findings.line_groups(tables.findings(spark, d).where("line_number is not null"), ["repository", "path"])
    return findings.quota(groups, ["repository"]).select("repository", "path", "line_number", "first_seq", "published")


MARKER = "'<!-- finding:' || rule_id || ':' || path || ':' || line_number || ' -->'"


@query(f"""with {FINDINGS}, marked as (select *, {MARKER} marker from findings), old as (select distinct marker from marked where suggestion is null or length(suggestion) % 2 = 0)
    select min(seq) seq, marker from marked where marker is not null and marker not in (select marker from old where marker is not null) group by marker""")
def unpublished_findings(spark, d):
    f = tables.findings(spark, d)
    m = findings.marker(F.col("rule_id"), F.col("path"), F.col("line_number"))
    comments = f.where("suggestion is null or length(suggestion) % 2 = 0").select(F.concat(F.lit("text\n  "), m, F.lit("\r\nmore")).alias("body")).where("body is not null")
    return findings.unpublished(f, findings.markers_in(comments)).select("seq", "marker")


@query(f"""with {FINDINGS} select seq, concat_ws(E'\\n\\n', {MARKER}, '**' || upper(severity) || '**', {", ".join(f"case when trim(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')) <> '' then '**{n}:** ' || regexp_replace({c}, '^\\s+|\\s+$', '', 'g') end" for n, c in (("Category", "category"), ("Issue", "issue"), ("Impact", "impact"), ("Evidence", "evidence"), ("Suggestion", "suggestion")))}, '_Rule: `' || rule_id || '`_') as body from findings""")
def rendered_findings(spark, d):
    return tables.findings(spark, d).select("seq", findings.render(findings.marker(F.col("rule_id"), F.col("path"), F.col("line_number"))).alias("body"))


@query("""select event_id, substr(regexp_replace(event_type || ': token=' || user_id || ' failed; password: ' || value || ', at ' || props, '(?i)(token|pat|authorization|password)(\\s*[:=]\\s*)[^\\s,;]+', '\\1\\2[redacted]', 'g'), 1, 2000) message from events""")
def redacted_errors(spark, d):
    text = F.concat(F.col("event_type"), F.lit(": token="), F.col("user_id").cast("string"), F.lit(" failed; password: "), F.col("value").cast("string"), F.lit(", at "), F.col("props"))
    return table(spark, d, "events").select("event_id", findings.redact_errors(text).alias("message"))


SOURCED = FINDINGS + ", sourced as (select *, case when seq % 3 = 0 then 'llm' else 'static' end source from findings where line_number is not null)"


def _sourced(spark, d):
    return tables.findings(spark, d).withColumn("source", F.when(F.col("seq") % 3 == 0, "llm").otherwise("static")).where("line_number is not null")


@query(f"""with {SOURCED} select a.seq l_seq, b.seq r_seq, a.line_number l_line, b.line_number r_line from sourced a join sourced b on a.repository = b.repository and a.rule_id = b.rule_id
    and abs(a.line_number - b.line_number) <= 5 where a.source = 'llm' and b.source = 'static'""")
def near_authoritative(spark, d):
    s = _sourced(spark, d)
    return findings.near_matches(s.where("source = 'llm'"), s.where("source = 'static'"), ["repository", "rule_id"], 5).select("l_seq", "r_seq", "l_line", "r_line")


@query()
def deduplicated_findings(spark, d):
    return findings.deduplicated(_sourced(spark, d), ["repository"])


# ---- projects -----------------------------------------------------------------------------------------------------------

ROOTS = FILES + ", roots as (select distinct repository, array_to_string(string_split(path, '/')[1:2], '/') root from files where len(string_split(path, '/')) > 2 union select distinct repository, string_split(path, '/')[1] from files where path like 'packages/%')"


def _roots(spark, d):
    f = tables.files(spark, d)
    parts = F.split("path", "/")
    two = f.where(F.size(parts) > 2).select("repository", F.array_join(F.slice(parts, F.lit(1), F.lit(2)), "/").alias("root"))
    return f, two.union(f.where(F.col("path").startswith("packages/")).select("repository", F.lit("packages"))).distinct()


@query(f"with {ROOTS} select f.file_id, arg_max(r.root, length(r.root)) root from files f left join roots r on r.repository = f.repository and (f.path = r.root or starts_with(f.path, r.root || '/')) group by f.file_id")
def project_of_file(spark, d):
    f, roots = _roots(spark, d)
    return projects.owners(f, roots, ["repository"])


@query(f"""with {FILES}, tools as (select * from (values {", ".join(f"('{t}', '{p}')" for t, p in projects.TOOLS)}) t(tool, pattern)),
    hit as (select distinct repository, tool, path from files join tools on regexp_matches(lower(string_split(path, '/')[-1]), pattern)),
    lists as (select repository, tool, list(path order by path) paths from hit group by all)
    select repository, map_from_entries(list({{'k': tool, 'v': paths}} order by tool)) tools from lists group by all""")
def build_tools(spark, d):
    return projects.build_tools(tables.files(spark, d), ["repository"])


@query(f"""with {FILES}, named as (select repository, list(distinct lower(string_split(path, '/')[-1])) n from files group by all)
    select repository, case {" ".join(f"when list_contains(n, '{f}') then '{m}'" for m, f in projects.MANAGERS)} end package_manager from named""")
def package_manager(spark, d):
    return projects.package_manager(tables.files(spark, d), ["repository"])


@query(f"with {FILES} select repository, list(distinct l order by l) languages from (select repository, lower(language) l from files where language is not null) group by all")
def repository_languages(spark, d):
    return tables.files(spark, d).where("language is not null").groupBy("repository").agg(F.array_sort(F.collect_set(F.lower("language"))).alias("languages"))


@query(f"""with {ROOTS}, owned as (select f.file_id, f.repository, f.path, arg_max(r.root, length(r.root)) root from files f join roots r on r.repository = f.repository and (f.path = r.root or starts_with(f.path, r.root || '/')) group by all),
    kinded as (select *, lower(string_split(path, '/')[-1]) as name from owned)
    select repository, root, file_id, place::int place from (select *, row_number() over (partition by repository, root order by case when regexp_matches(name, '^(main|app|server|program|startup|application)\\.') then 0
        when regexp_matches(name, '(component|controller|service|view)') then 1 when regexp_matches(name, '^index\\.') then 3 else 2 end, length(path), path, file_id) place from kinded) where place <= 3""")
def discovery_sample(spark, d):
    f, roots = _roots(spark, d)
    own = projects.owners(f, roots, ["repository"]).where("root is not null")
    return projects.discovery_sample(f.join(own, "file_id"), ["repository"])


# ---- planning -----------------------------------------------------------------------------------------------------------


@query(f"with {LINES} select file_id, line_number, diff_position, (floor((row_number() over w - 1) / 30) + 1)::int chunk_index, ceil(count(*) over (partition by file_id) / 30)::int total from added window w as (partition by file_id order by diff_position)")
def line_chunks(spark, d):
    lines = diff.added_lines(tables.files(spark, d), ["file_id"])
    return planning.chunks(lines, ["file_id"]).select("file_id", "line_number", "diff_position", "chunk_index", "total")


def _framework_sql() -> str:
    flags, cases = [], []
    for k, (name, needs, where, pattern) in enumerate(detection.FRAMEWORKS):
        quoted = pattern.replace("'", "''")
        flags.append(f"coalesce(bool_or(regexp_matches(lower({'path' if where == 'path' else 'patch'}), '{quoted}')), false) s{k}")
        flags.append(f"coalesce(bool_or(regexp_matches(lower(path), '{needs}')), false) n{k}" if needs else f"true n{k}")
        cases.append(f"when s{k} and n{k} then '{name}'")
    return f"with {FILES}, flags as (select repository, {', '.join(flags)} from files group by all) select repository, case {' '.join(cases)} else 'unknown' end framework from flags"


@query("""with recursive c as (select distinct chunk_id, [greatest(1, ceil(length(coalesce(x.content, '')) / 3.0)::int) + 4 for x in changed_lines] s from review_chunks where len(changed_lines) > 0),
    walk(chunk_id, s, i, part, n, t) as (select chunk_id, s, 1, 1, 1, s[1] from c
        union all select chunk_id, s, i + 1, case when t + s[i + 1] > 600 or n >= 100 then part + 1 else part end, case when t + s[i + 1] > 600 or n >= 100 then 1 else n + 1 end, case when t + s[i + 1] > 600 or n >= 100 then s[i + 1] else t + s[i + 1] end
        from walk where i < len(s)),
    grown as (select chunk_id, part, count(*) n, sum(s[i]) t from walk group by all), many as (select chunk_id, max(part) total from grown group by all),
    even as (select chunk_id, unnest([1, 2]) part, s, ceil(len(s) / 2.0)::int e from c join many using (chunk_id) where total > 2),
    every as (select chunk_id, part, n, t from grown join many using (chunk_id) where total <= 2
        union all select chunk_id, part, len(s[(part - 1) * e + 1:part * e]), list_sum(s[(part - 1) * e + 1:part * e]) from even)
    select chunk_id, part::int part, (count(*) over (partition by chunk_id))::int total, (1 + coalesce(sum(n) over (partition by chunk_id order by part rows between unbounded preceding and 1 preceding), 0))::int as first, n::int n, t::int tokens from every""")
def review_parts(spark, d):
    chunks = table(spark, d, "review_chunks").select("chunk_id", F.transform("changed_lines", lambda x: F.coalesce(x["content"], F.lit(""))).alias("lines")).dropDuplicates(["chunk_id"])
    return planning.parts(chunks, ["chunk_id"], tokens=600, most=100)


@query(f"""with recursive {FILES}, named as ({_framework_sql()}),
    k as (select f.provider, f.repository, f.number, file_id seq, case when framework in ('django', 'fastapi', 'flask') and regexp_matches(lower(path), '[.]pyw?$') then 'python-backend' else framework end kind,
        coalesce(ceil(length(patch) / 4.0), 0)::int tokens from files f join named using (repository)),
    o as (select *, row_number() over (partition by provider, repository, number, kind order by seq) i from k),
    walk as (select *, 0 as local, 1 as c, tokens as t from o where i = 1
        union all select o.*, case when w.c >= 5 or w.t + o.tokens > 2200 then w.local + 1 else w.local end, case when w.c >= 5 or w.t + o.tokens > 2200 then 1 else w.c + 1 end, case when w.c >= 5 or w.t + o.tokens > 2200 then o.tokens else w.t + o.tokens end
        from walk w join o on o.provider = w.provider and o.repository = w.repository and o.number is not distinct from w.number and o.kind = w.kind and o.i = w.i + 1),
    firsts as (select *, min(seq) over (partition by provider, repository, number, kind, local) f from walk)
    select provider, repository, number, seq, (dense_rank() over (partition by provider, repository, number order by f, kind))::int batch from firsts""")
def review_file_batches(spark, d):
    files = tables.files(spark, d)
    named = detection.frameworks(files, ["repository"])
    f = files.select(*KEY, F.col("file_id").alias("seq"), "path", paths.text_tokens(F.col("patch")).alias("tokens")).join(named, "repository")
    python = F.col("framework").isin("django", "fastapi", "flask", "python") & F.lower("path").rlike(r"\.pyw?$")
    return planning.file_batches(f.withColumn("kind", F.when(python, "python-backend").otherwise(F.col("framework"))), KEY)


@query(f"""with {LINES}, near as (select distinct file_id, unnest(range(greatest(1, line_number - 3), line_number + 4)) line_number from added where content like '%return%'),
    own as (select file_id, line_number, min(content) content from added group by all),
    kept as (select o.*, lag(o.line_number) over (partition by file_id order by o.line_number) before from own o join near using (file_id, line_number))
    select file_id, string_agg(case when line_number > before + 1 then '... omitted unrelated lines ...' || chr(10) else '' end || line_number || ' | ' || content, chr(10) order by line_number) as content from kept group by all""")
def context_windows(spark, d):
    lines = diff.added_lines(tables.files(spark, d), ["file_id"]).groupBy("file_id", "line_number").agg(F.min("content").alias("content"))
    return planning.context(lines, lines.where(F.col("content").contains("return")), ["file_id"], around=3)


@query(f"""with {LINES}, own as (select file_id, line_number, min(content) content from added group by all),
    around as (select *, string_agg(content, chr(10)) over (partition by file_id order by line_number rows between 2 preceding and 2 following) a from own)
    select file_id, line_number from around where content like '%response%' and not regexp_matches(a, 'raise_for_status')""")
def unchecked_neighbours(spark, d):
    lines = diff.added_lines(tables.files(spark, d), ["file_id"]).groupBy("file_id", "line_number").agg(F.min("content").alias("content"))
    near = planning.neighbours(lines, ["file_id"], 2)
    return near.where(F.col("content").contains("response") & ~F.col("around").rlike("raise_for_status")).select("file_id", "line_number")


@query(rf"""with {LINES}, own as (select file_id, line_number, min(content) content from added group by all),
    named as (select *, nullif(regexp_extract(content, '^\s*(?:async\s+)?def\s+([A-Za-z0-9_]+)', 1), '') n from own)
    select file_id, line_number, last_value(n ignore nulls) over (partition by file_id order by line_number rows between unbounded preceding and current row) as name from named""")
def enclosing_definition(spark, d):
    lines = diff.added_lines(tables.files(spark, d), ["file_id"]).groupBy("file_id", "line_number").agg(F.min("content").alias("content"))
    return planning.enclosing(lines, ["file_id"], r"^\s*(?:async\s+)?def\s+([A-Za-z0-9_]+)").select("file_id", "line_number", "name")


@query("""select provider, repository, number, sum(coalesce(estimated_tokens, 0))::bigint tokens, count(*) contexts, count(*) filter (truncated) truncated from
    (select distinct context_id, lower(provider) provider, repository, number, estimated_tokens, truncated from review_contexts) group by all""")
def context_totals(spark, d):
    c = table(spark, d, "review_contexts").dropDuplicates(["context_id"]).withColumn("provider", F.lower("provider"))
    return c.groupBy(*KEY).agg(F.sum(F.coalesce("estimated_tokens", F.lit(0))).cast("long").alias("tokens"), F.count("*").alias("contexts"), F.count_if("truncated").alias("truncated"))


@query("""select lower(provider) provider, repository, number, count(distinct batch_index) batches, count(distinct replace(f, '\\', '/')) files from (select provider, repository, number, batch_index, unnest(files) f from review_batches) group by all""")
def batch_members(spark, d):
    b = table(spark, d, "review_batches").select(F.lower("provider").alias("provider"), "repository", "number", "batch_index", F.explode("files").alias("f"))
    return b.groupBy(*KEY).agg(F.countDistinct("batch_index").alias("batches"), F.countDistinct(paths.slashes("f")).alias("files"))


# ---- history ------------------------------------------------------------------------------------------------------------

RUNS = """runs as (select distinct run_id, lower(provider) provider, repository, number, changed_files, ai_review_files, skipped_files, review_depth, llm_retries, total_review_seconds, finished_at from review_diagnostics)"""


def _runs(spark, d):
    cols = ["run_id", F.lower("provider").alias("provider"), "repository", "number", "changed_files", "ai_review_files", "skipped_files", "review_depth", "llm_retries", "total_review_seconds", "finished_at"]
    return table(spark, d, "review_diagnostics").select(*cols).distinct()


@query("select provider, repository, number, title from change_sets where contains(lower(concat_ws(' ', title, author, repository, head_branch)), 'policy') group by all")
def search_change_sets(spark, d):
    c = tables.change_sets(spark, d)
    return history.search(c, ["title", "author", "repository", "head_branch"], "Policy").select(*KEY, "title").distinct()


@query(f"with {RUNS} select run_id, provider, repository, number, finished_at, place::int place from (select *, row_number() over (partition by provider, repository, number order by finished_at desc nulls last, run_id) place from runs) where place <= 1")
def latest_runs(spark, d):
    return history.recent(_runs(spark, d), KEY, [F.desc_nulls_last("finished_at"), F.col("run_id")], 1).select("run_id", *KEY, "finished_at", "place")


@query(f"with {RUNS} select run_id, finished_at, row::int as row from (select *, row_number() over (order by finished_at desc nulls last, run_id) as row from runs) where row between 6 and 10")
def history_page(spark, d):
    return history.page(_runs(spark, d), [F.desc_nulls_last("finished_at"), F.col("run_id")], 5, 2).select("run_id", "finished_at", "row")


@query(f"with {RUNS} select review_depth, count(*) runs, count(*) filter (skipped_files > 0) with_skips, count(*) filter (llm_retries > 0) with_retries, sum(changed_files)::bigint files, round(sum(case when total_review_seconds > 0 then total_review_seconds else 0 end), 3) as total_seconds from runs group by all")
def run_kpis(spark, d):
    s = F.when(F.col("total_review_seconds") > 0, F.col("total_review_seconds")).otherwise(0.0)
    return _runs(spark, d).groupBy("review_depth").agg(F.count("*").alias("runs"), F.count_if(F.col("skipped_files") > 0).alias("with_skips"), F.count_if(F.col("llm_retries") > 0).alias("with_retries"), F.sum("changed_files").cast("long").alias("files"), F.round(F.sum(s), 3).alias("total_seconds"))


@query(f"""with {RUNS}, days as (select finished_at::date d, coalesce(skipped_files, 0) = 0 good, coalesce(skipped_files, 0) > 0 bad from runs where finished_at is not null),
    span as (select min(d) lo, max(d) hi, ceil((max(d) - min(d) + 1) / 31)::int w from days),
    starts as (select i::int bucket, (lo + (i * w)::int)::date as start from span, range(((hi - lo) // w + 1)::bigint) t(i)),
    counted as (select ((d - lo) // w)::int bucket, count(*) filter (good) passed, count(*) filter (bad) blocked from days, span group by all),
    filled as (select bucket, start, coalesce(passed, 0) passed, coalesce(blocked, 0) blocked from starts left join counted using (bucket))
    select bucket, strftime(start, '%Y-%m-%d') as start_day, passed, blocked, passed / greatest((select max(greatest(passed, blocked)) from filled), 1) share from filled""")
def run_trend(spark, d):
    skipped = F.coalesce("skipped_files", F.lit(0))
    return history.trend(_runs(spark, d), "finished_at", skipped == 0, skipped > 0).select("bucket", F.date_format("start", "yyyy-MM-dd").alias("start_day"), "passed", "blocked", "share")


@query("select 'all' as value union all select distinct lower(severity) from python_findings_manifest where severity is not null")
def severity_options(spark, d):
    return history.options(table(spark, d, "python_findings_manifest").withColumn("s", F.lower("severity")), "s")


@query("""select lower(provider) provider, repository, number, map_from_entries(list({'k': k, 'v': v} order by k)) skipped_by_reason from
    (select provider, repository, number, lower(e.key) k, sum(e.value)::bigint v from (select lower(provider) provider, repository, number, unnest(map_entries(skipped_by_reason)) e from (select distinct * from review_diagnostics)) where e.value is not null group by all) group by all""")
def skip_reasons_of_runs(spark, d):
    rows = table(spark, d, "review_diagnostics")
    own = rows.withColumn("m", F.to_json("skipped_by_reason")).groupBy(*[c for c in rows.columns if c != "skipped_by_reason"], "m").agg(F.first("skipped_by_reason").alias("skipped_by_reason"))
    e = own.select(F.lower("provider").alias("provider"), "repository", "number", F.explode("skipped_by_reason").alias("k", "v")).where("v is not null")
    sums = e.groupBy(*KEY, F.lower("k").alias("k")).agg(F.sum("v").alias("v"))
    return sums.groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("skipped_by_reason"))


# ---- progress -----------------------------------------------------------------------------------------------------------


def _log(spark, d):
    kinds = {"signup": "running", "purchase": "completed", "error": "failed", "view": "queued"}
    kind = F.lit("note")
    for k, v in kinds.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    return table(spark, d, "events").select(F.col("user_id").alias("job"), "event_id", F.col("event_id").alias("seq"), "ts", kind.alias("kind"), F.floor("value").cast("int").alias("progress"))


@query(f"""with {EVENTS}, w as (select *, coalesce(max((kind in ('completed', 'failed'))::int) over p, 0) done, coalesce(max((kind = 'running')::int) over p, 0) started from log
        window p as (partition by job order by ts, seq rows between unbounded preceding and 1 preceding)),
    kept as (select * from w where done = 0 and (kind <> 'cancelled' or started = 0)),
    agg as (select job, count(*) events, max(least(greatest(progress, 0), 100)) top, coalesce(last(kind order by ts, seq) filter (kind <> 'note'), 'queued') state, max(ts) as last from kept group by all)
    select job, events, case when state = 'completed' then 100 else least(coalesce(top, 0), 99) end::int progress, state, last from agg""")
def job_progress(spark, d):
    return progress.reduced(_log(spark, d))


@query(f"with {EVENTS}, own as (select job, event_id, min(ts) ts, max(kind) kind, max(progress) progress from log group by all) select job, event_id, ts, kind, progress from (select *, row_number() over (partition by job order by ts desc, event_id desc) place from own) where place <= 200")
def job_event_ring(spark, d):
    return progress.ring(_log(spark, d))


# ---- detection, answers and validation ----------------------------------------------------------------------------------


@query(_framework_sql())
def repository_framework(spark, d):
    return detection.frameworks(tables.files(spark, d), ["repository"])


@query(f"with {FILES} select repository, case when bool_or(regexp_matches(lower(path), '(^|/)nx\\.json$')) then 'nx' else 'standalone' end workspace from files group by all")
def repository_workspace(spark, d):
    return detection.workspace(tables.files(spark, d), ["repository"], nested=True)


@query(f"""with {FILES}, explicit as (select distinct repository, regexp_extract(path, '^(.*)/[^/]*$', 1) root from files where regexp_matches(lower(path), '/project\\.json$') or regexp_matches(lower(path), '^(?:apps|libs|packages|services)/.*/?package\\.json$')),
    guess as (select distinct repository, regexp_extract(path, '^((?:apps|libs|packages|services)/[^/]+)/', 1) root from files),
    free as (select * from guess g where root <> '' and not exists (select 1 from explicit e where e.repository = g.repository and (e.root = g.root or starts_with(g.root, e.root || '/') or starts_with(e.root, g.root || '/')))),
    roots as (select *, true explicit from explicit where root <> '' union all select *, false from free)
    select * from roots union all select distinct repository, '.' root, false explicit from files where repository not in (select repository from roots)""")
def project_roots(spark, d):
    return detection.project_roots(tables.files(spark, d), ["repository"])


FLAG_SQL = "list_filter([" + ", ".join(f"case when bits & {b} <> 0 then '{n}' end" for b, n in responses.FLAGS.items()) + "], lambda x: x is not null)"


@query(f"""select file_id, flags, case when list_contains(flags, 'delete') then 'removed' when list_has_any(flags, ['rename', 'sourcerename', 'targetrename']) then 'renamed' when list_has_any(flags, ['add', 'undelete']) then 'added' else 'modified' end status
    from (select file_id, {FLAG_SQL} flags from (select distinct file_id, (file_id % 8192)::int bits from changed_files))""")
def change_flags(spark, d):
    f = table(spark, d, "changed_files").select("file_id", (F.col("file_id") % 8192).cast("int").alias("bits")).distinct()
    return f.select("file_id", responses.flags(F.col("bits")).alias("flags")).withColumn("status", responses.status(F.col("flags")))


@query(f"""with {LINES}, v as (select file_id, line_number, regexp_extract(content, '"version": *"([^"]*)"', 1) t from added where content like '%"version":%')
    select file_id, line_number, [coalesce(try_cast(regexp_extract(t, '(\\d+)(?:\\.(\\d+))?(?:\\.(\\d+))?', k) as int), 0) for k in [1, 2, 3]] as version
    from (select file_id, line_number, t from v where regexp_matches(t, '\\d'))""".replace("regexp_extract(t, '(\\d+)(?:\\.(\\d+))?(?:\\.(\\d+))?', k)", "string_split(regexp_extract(t, '\\d+(?:\\.\\d+)?(?:\\.\\d+)?'), '.')[k]"))
def locked_versions(spark, d):
    lines = diff.added_lines(tables.files(spark, d), ["file_id"]).where(F.col("content").contains('"version":'))
    t = lines.select("file_id", "line_number", F.regexp_extract("content", '"version": *"([^"]*)"', 1).alias("t"))
    return t.select("file_id", "line_number", responses.version(F.col("t")).alias("version")).where("version is not null")


@query(f"""with {FINDINGS}, placed as (select *, row_number() over (partition by repository, path order by seq) - 1 n from findings)
    select repository, path, n::int n, line_number, lower(severity) severity, rule_id, issue as message from placed where n < 3 and line_number > 0 and trim(rule_id) <> '' and trim(issue) <> '' and severity in ('critical', 'high', 'medium', 'low', 'suggestion')""")
def parsed_answers(spark, d):
    f = tables.findings(spark, d)
    row = F.struct(F.col("path").alias("file_path"), "line_number", "severity", "rule_id", F.col("issue").alias("message"), "suggestion")
    lists = f.groupBy("repository", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", row.alias("row")))), lambda x: x["row"]).alias("findings"), F.min("seq").alias("first"))
    whole = F.to_json(F.struct("findings"))
    cut = F.concat(F.substring(whole, 1, F.length(whole) - 2), F.lit(', {"file_path": "broken o'))
    answer = F.when(F.col("first") % 3 == 0, cut).otherwise(F.concat(F.lit("Here it is:\n```json\n"), whole, F.lit("\n```")))
    return responses.answered(lists.select("repository", "path", answer.alias("answer")), ["repository", "path"]).select("repository", "path", "n", "line_number", "severity", "rule_id", "message")


SPOKEN = "(' ' || trim(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]+', ' ', 'g')) || ' ')"
#: Phrases that tell of root causes, told apart from the operator's lists.
CAUSES = {
    "hardcoded-secret": " (hard ?coded (secret|credential|password|token|api ?key)|(embedded|exposed) (secret|credential)) ",
    "loose-equality": " ((loose|strict) equal(ity)?|type coercion|non ?strict (equality|comparison)) ",
    "no-console": " console (log|logging|debug|info|warn|error) ",
    "unused-variable": " (unused (variable|value|constant|local)|declared but never used) ",
    "sql-injection": " (sql injection|(interpolated|dynamic|concatenated) sql) ",
    "weak-cryptography": " ((weak|broken|insecure) (hash|cryptography|crypto)|md5|sha1) ",
    "resource-cleanup": " ((resource|file|session|response) leak|unclosed|not closed|without closing|without being closed) ",
}


def _reasons_sql() -> str:
    wrong = " or ".join(f"(regexp_matches(rule_id, '{p}') and {SUFFIX} not in ({_list(e.split())}))" for p, e in validation.ONLY_IN.items())
    cases = [
        ("no path", "trim(coalesce(path, '')) = ''"), ("no line", "coalesce(line_number <= 0, true)"), ("no rule", "trim(coalesce(rule_id, '')) = ''"), ("no message", "trim(regexp_replace(coalesce(issue, ''), '\\s', ' ', 'g')) = ''"),
        ("placeholder rule", f"rule_id in ({_list(validation.PLACEHOLDERS)})"), ("speculative", f"regexp_matches({SPOKEN.format("concat_ws(' ', issue, suggestion)")}, ' (might|possibly|perhaps|potentially|consider|may (be|not|throw|fail|cause|lead to|result in)|appears to|seems to|could be|(not clear|unclear|not obvious) (if|whether)) ')"), ("wrong file type", wrong),
    ]
    return "list_filter([" + ", ".join(f"case when coalesce({c}, false) then '{r}' end" for r, c in cases) + "], lambda x: x is not null)"


@query(f"with {FINDINGS} select seq, {_reasons_sql()} reasons from findings")
def structural_reasons(spark, d):
    f = tables.findings(spark, d)
    return f.select("seq", validation.structural(f).alias("reasons"))


@query(rf"""with {FINDINGS}, {LINES}, near as (select f.seq, f.rule_id, a.line_number = f.line_number at_it, a.content from findings f join added a on a.repository = f.repository and a.path = f.path and a.line_number between f.line_number - 3 and f.line_number + 3),
    seen as (select seq, bool_or(at_it) on_line, bool_or(at_it and regexp_matches(regexp_replace(content, '^\s+', ''), '^(#|//|/\*|\*|<!--)')) remark,
        bool_or(case rule_id when 'no-console' then regexp_matches(content, '\bconsole\s*\.') when 'debugger' then regexp_matches(content, '\bdebugger\b') when 'loose-equality' then regexp_matches(content, '[^=!]==[^=]|!=[^=]') when 'bare-except' then regexp_matches(content, '\bexcept\s*:')
            when 'unsafe-inner-html' then contains(content, 'innerHTML') when 'hardcoded-secret' then regexp_matches(content, '[:=(,]\s*["''`]') when 'embedded-credential' then regexp_matches(content, '["''`]') when 'weak-cryptography' then regexp_matches(content, '(?i)\b(md5|sha1)\b')
            when 'command-injection' then regexp_matches(content, '(?i)\b(exec|system|popen|subprocess|shell)\b') when 'sql-injection' then regexp_matches(content, '(?i)\b(select|insert|update|delete|execute|query|raw)\b') else true end) shows from near group by all)
    select seq, {_reasons_sql()} || list_filter([case when not coalesce(on_line, false) then 'not a changed line' end, case when remark then 'comment line' end, case when on_line and not shows then 'no evidence on the line' end], lambda x: x is not null) reasons from findings left join seen using (seq)""")
def grounded_reasons(spark, d):
    lines = diff.added_lines(tables.files(spark, d), ["repository", "path"])
    return validation.grounded(tables.findings(spark, d), lines, ["repository", "path"])


SOURCED_CANONICAL = CANONICAL + ", sourced as (select *, case when seq % 3 = 0 then 'llm' else 'static' end source from canonical where line_number is not null)"


@query(f"""with {SOURCED_CANONICAL}, pairs as (select a.seq l_seq, b.seq r_seq, b.canonical, {SPOKEN.format("concat_ws(' ', a.rule_id, a.issue, a.impact, a.evidence, a.suggestion)")} t from sourced a join sourced b on a.repository = b.repository and abs(a.line_number - b.line_number) <= 5 and a.seq <> b.seq
    where a.source = 'llm' and b.source = 'static') select l_seq, r_seq from pairs where case {" ".join(f"when canonical = '{r}' then regexp_matches(t, '{p}')" for r, p in CAUSES.items())}
    when canonical = 'path-traversal' then regexp_matches(t, ' (path traversal|directory traversal) ') or t like '% file path %' and regexp_matches(t, ' (escape|root|unvalidated) ') else false end""")
def root_cause_matches(spark, d):
    s = rules.resolve(_sourced(spark, d))
    pairs = findings.near_matches(s.where("source = 'llm'"), s.where("source = 'static'"), ["repository"], 5)
    told = s.select(F.col("seq").alias("r_seq"), "canonical")
    return validation.root_causes(pairs.join(told, "r_seq"), s.where("source = 'llm'"))


@query()
def syntax_findings(spark, d):
    return syntax.syntax_findings(tables.files(spark, d))


@query(f"""with {FIRED} select provider, repository, number, map_from_entries(list({{'k': rule_id, 'v': n}} order by rule_id)) by_rule from (select provider, repository, number, rule_id, count(*)::int n from fired group by all) group by all""")
def rule_histogram(spark, d):
    return findings.histogram(_fired(spark, d), KEY, "rule_id", "by_rule")


# ---- enrichment ---------------------------------------------------------------------------------------------------------


@query(rf"""with {LINES}, own as (select file_id, line_number, min(content) content from added group by all),
    stripped as (select file_id, line_number, regexp_replace(content, '^[\s\x0b]+|[\s\x0b]+$', '', 'g') c from own),
    led as (select *, case when lead(line_number, 1) over w = line_number + 1 then lead(c, 1) over w end c1, case when lead(line_number, 2) over w = line_number + 2 then lead(c, 2) over w end c2 from stripped window w as (partition by file_id order by line_number))
    select file_id, line_number, concat_ws(chr(10), 'Changed line ' || line_number || ': ' || c, case when regexp_matches(c, '{enrich.GOES_ON}') then c1 end, case when regexp_matches(c, '{enrich.GOES_ON}') and regexp_matches(c1, '{enrich.GOES_ON}') then c2 end) evidence from led""")
def line_evidence(spark, d):
    lines = diff.added_lines(tables.files(spark, d), ["file_id"]).groupBy("file_id", "line_number").agg(F.min("content").alias("content"))
    return enrich.line_evidence(lines, ["file_id"]).select("file_id", "line_number", "evidence")


@query(f"with {CANONICAL}, {RULES} select seq, coalesce(c.category, r.category, 'general') category from canonical c left join rules r on r.rule_id = c.canonical")
def finding_categories(spark, d):
    return enrich.categorised(_canonical(spark, d), rules.catalog(spark)).select("seq", "category")


@query(rf"""with {FIRED}, own as (select file_id, line_number, max(regexp_matches(content, '{enrich.SIGNAL}')::int) signal from added
    where not regexp_matches(content, '^\s*(?:[{{}}()\[\]]|\}};|\);|\],|\}},)?\s*$') and not regexp_matches(content, '^\s*//') group by all),
    hit as (select distinct file_id, line_number from fired),
    n as (select file_id, count(*) meaningful, count(h.line_number) covered, max(signal) signal from own left join hit h using (file_id, line_number) group by all)
    select file_id, meaningful, covered, not (covered / meaningful >= 0.8 or meaningful <= 8 and covered / meaningful >= 0.5) or signal = 1 needed from n""")
def coverage_gate(spark, d):
    lines = diff.added_lines(tables.files(spark, d), [*KEY, "file_id", "path"])
    return enrich.coverage(lines, rules.line_findings(lines, ["file_id"]), ["file_id"])


@query("""select repository, count(*) filter (lower(state) = 'open') open_sets, count(*) filter (lower(state) in ('merged', 'closed')) done_sets, count(*) filter (state is null) unknown_sets, count(*) filter (commit_count > 5) large_sets
    from (select distinct * from change_sets) group by all""")
def change_set_counts(spark, d):
    s = F.col("state")
    return enrich.counts(tables.change_sets(spark, d), ["repository"], {"open_sets": s == "open", "done_sets": s.isin("merged", "closed"), "unknown_sets": s.isNull(), "large_sets": F.col("commit_count") > 5})

"""Queries over publishing, screens as data, sources and labels, with SQL written apart from the operators' lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchlake.catalog import FILES, FINDINGS, GATE, KEY, LINES, RANK, RUNS, _runs, _sourced, query
from patchlake.operators import contradictions, crossfile, diff, findings, gates, history, proofs, publishing
from patchlake.runtime import table
from patchlake.sources import providers
from patchlake.sources import review_tables as tables

# ---- publishing ----------------------------------------------------------------------------------------------------------

MARKED = FINDINGS + ", marked as (select *, '<!-- finding:' || rule_id || ':' || path || ':' || line_number || ' -->' marker from findings where rule_id is not null and line_number is not null and severity is not null)"


def _marked(spark, d):
    f = tables.findings(spark, d).where("rule_id is not null and line_number is not null and severity is not null")
    return f.withColumn("marker", findings.marker(F.col("rule_id"), F.col("path"), F.col("line_number")))


@query(f"""with {MARKED}, there as (select distinct repository, marker from marked where seq % 5 = 0), t as (select repository, count(*) n from there group by all),
    own as (select m.*, row_number() over (partition by m.repository, m.marker order by seq) > 1 or h.marker is not null dup from marked m left join there h on h.repository = m.repository and h.marker = m.marker),
    g as (select repository, path, line_number, count(*) c, min({RANK.format("severity")}) r, min(struct_pack(r := {RANK.format("severity")}, seq := seq)).seq s from own where not dup group by all),
    p as (select g.*, row_number() over (partition by g.repository order by r, s) <= greatest(3 - coalesce(n, 0), 0) shown from g left join t using (repository)),
    c as (select repository, coalesce(sum(c) filter (shown), 0) shown, coalesce(sum(c) filter (not shown), 0) rest from p group by all),
    k as (select repository, count(*) filter (dup) dup from own group by all), f as (select repository, length(repository) % 3 = 0 broken, length(repository) % 2 = 0 rate from k)
    select k.repository, case when broken then 0 else coalesce(shown, 0) end::bigint published, dup::bigint skipped_duplicates, coalesce(rest, 0)::bigint summary_only, case when broken then coalesce(shown, 0) else 0 end::bigint failed,
        (coalesce(shown, 0) + dup + coalesce(rest, 0))::bigint processed, broken and rate rate_limited from k join f using (repository) left join c using (repository)""")
def publish_outcomes(spark, d):
    m = _marked(spark, d)
    failing = m.select("repository").distinct().where(F.length("repository") % 3 == 0).withColumn("rate_limited", F.length("repository") % 2 == 0)
    return publishing.outcomes(m, m.where("seq % 5 = 0").select("repository", "marker"), failing, ["repository"], 3)


_BODY = """concat_ws(chr(10) || chr(10), marker, '**' || upper(severity) || '**', case when trim(coalesce(category, '')) <> '' then '**Category:** ' || trim(category) end, case when {0} <> '' then '**Issue:** ' || {0} end,
    case when {1} <> '' then '**Impact:** ' || {1} end, case when {2} <> '' then '**Evidence:** ' || {2} end, case when {3} <> '' then '**Suggestion:** ' || {3} end, '_Rule: `' || rule_id || '`_')""".format(
    *(rf"regexp_replace(coalesce({c}, ''), '^\s+|\s+$', '', 'g')" for c in ("issue", "impact", "evidence", "suggestion"))
)


@query(f"""with {MARKED}, b as (select repository, path, line_number, seq, {_BODY} body from marked)
    select repository, path, line_number, case when count(*) = 1 then min(body) else '### ' || count(*) || ' findings on this line' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || string_agg(body, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by seq) end body from b group by all""")
def rendered_groups(spark, d):
    return publishing.rendered_groups(_marked(spark, d), ["repository", "path"])


_SEVERITY_LINES = "case when {0} then '#### ' || '{1}' || chr(10) || chr(10) || string_agg(t, chr(10) order by seq) filter (severity = '{2}') end"
SUMMARY = f"""own as (select *, '- `' || path || ':' || line_number || '` **' || rule_id || '** - ' || coalesce(issue, '') t from marked), gates as (select repository, {GATE} from marked group by all),
    parts as (select repository, concat_ws(chr(10) || chr(10), '### Findings', {", ".join(_SEVERITY_LINES.format(f"count(*) filter (severity = '{s}') > 0", s.capitalize(), s) for s in ("critical", "high", "medium", "low", "suggestion"))}) body from own group by all),
    summaries as (select repository, '**Decision:** ' || case decision when 'block' then 'Blocked' when 'request_changes' then 'Changes requested' when 'review_recommended' then 'Review recommended' when 'non_blocking' then 'Not blocking' when 'optional' then 'Optional' else 'Passed' end
        || chr(10) || chr(10) || '- Critical: ' || critical_count || chr(10) || '- High: ' || high_count || chr(10) || '- Medium: ' || medium_count || chr(10) || '- Low: ' || low_count || chr(10) || '- Suggestion: ' || suggestion_count
        || chr(10) || chr(10) || '**Total:** ' || (critical_count + high_count + medium_count + low_count + suggestion_count) || chr(10) || chr(10) || case when critical_count + high_count + medium_count + low_count + suggestion_count = 0 then 'No issues were found in the changed lines.' else body end summary from gates join parts using (repository))"""


def _summaries(spark, d):
    m = _marked(spark, d)
    return publishing.summaries(m, findings.gate(m, ["repository"]), ["repository"])


@query(f"with {MARKED}, {SUMMARY} select repository, summary from summaries")
def run_summaries(spark, d):
    return _summaries(spark, d)


@query(f"""with {MARKED}, {SUMMARY}, comments as (select repository, seq comment_id, case when seq % 7 = 0 then '<!-- review-summary -->' || chr(10) || 'old' else issue end body from findings),
    there as (select repository, min(comment_id) comment_id from comments where contains(body, '<!-- review-summary -->') group by all)
    select repository, case when comment_id is null then 'create' else 'update' end as action, coalesce(comment_id, -1)::bigint comment_id, summary from summaries left join there using (repository)""")
def summary_upserts(spark, d):
    f = tables.findings(spark, d)
    comments = f.select("repository", F.col("seq").alias("comment_id"), F.when(F.col("seq") % 7 == 0, F.lit(publishing.SUMMARY_MARKER + "\nold")).otherwise(F.col("issue")).alias("body"))
    return publishing.summary_upserts(_summaries(spark, d), comments, ["repository"]).withColumn("comment_id", F.coalesce("comment_id", F.lit(-1)).cast("long"))


@query(f"with {FINDINGS}, n as (select repository, severity, min(seq) s, count(*) c from findings where severity is not null group by all) select repository, string_agg(severity || ' ' || c, ', ' order by s) as text from n group by all")
def severity_texts(spark, d):
    return publishing.severity_text(tables.findings(spark, d).where("severity is not null"), ["repository"])


@query(f"with {FINDINGS} select seq, (row_number() over (partition by repository order by case when seq % 3 = 0 then 1 else 0 end, path, line_number, rule_id, seq))::int place from findings where line_number is not null")
def findings_together(spark, d):
    s = _sourced(spark, d)
    order = ["path", "line_number", F.asc_nulls_last("rule_id"), "seq"]
    return publishing.together(s.where("source = 'static'"), s.where("source = 'llm'"), order).select("seq", "place")


# ---- labels --------------------------------------------------------------------------------------------------------------

_HAS = lambda *words: "(" + " or ".join(f"contains(t, '{w}')" for w in words) + ")"
RELABEL = f"""case when seq % 3 <> 0 then rule_id when {_HAS("empty catch")} then 'empty-catch-block' when {_HAS("catch block")} and {_HAS("silently", "ignored")} then 'empty-catch-block'
    when {_HAS("json.parse", "parsing json", "parse json", "json parsing")} and {_HAS("error", "exception", "throw", "invalid", "fail", "handling")} then 'json-parse-without-error-handling'
    when {_HAS("setinterval", "clearinterval", "timer reference", "timer handle", "returned timer", "reference to the timer", "timer is not retained")} then 'setinterval-without-timer-reference'
    when {_HAS("listener")} and {_HAS("remov", "cleanup", "clean up", "memory leak")} then 'global-event-listener-without-removal'
    when {_HAS("cache")} and {_HAS("key", "stale", "incorrect result", "wrong result")} and {_HAS("missing", "absent", "exclude", "omit", "collision", "stale")} then 'cache-consistency'
    when {_HAS("pagination", "page offset", "page index", "first page")} and {_HAS("skip", "incorrect", "wrong", "offset", "start")} then 'logic-error'
    when {_HAS("always report", "always return success", "reports success", "return value ignored", "result ignored")} then 'incorrect-result-handling'
    when {_HAS("blocking")} and {_HAS("async", "event loop", "non-blocking")} then 'async-blocking-operation' when {_HAS("timeout")} and {_HAS("request", "external", "network", "http", "client")} then 'missing-timeout'
    when {_HAS("authorization", "authorisation", "required role", "permission check")} then 'authorization' when {_HAS("command injection", "shell injection", "shell=true", "shell true")} then 'command-injection'
    when {_HAS("unsafe code execution", "dynamic evaluation", "untrusted eval", "arbitrary code")} then 'unsafe-code-execution'
    when {_HAS("weak test", "weak assertion", "insufficient assertion", "only checks status", "does not verify")} and {_HAS("test", "assert", "response", "result", "behavior", "behaviour")} then 'insufficient-test-assertion' else rule_id end"""


@query(f"with {FINDINGS}, s as (select *, lower(concat_ws(' ', issue, suggestion)) t from findings), r as (select seq, category, {RELABEL} rule_id from s) select seq, rule_id, case when rule_id = 'insufficient-test-assertion' then 'test-quality' else category end category from r")
def relabelled_findings(spark, d):
    f = tables.findings(spark, d)
    rule = publishing.relabelled(F.col("rule_id"), F.col("seq") % 3 != 0, "issue", "suggestion")
    return f.withColumn("rule_id", rule).select("seq", "rule_id", publishing.category_of(F.col("rule_id"), F.col("category")).alias("category"))


@query("select count(distinct repository) filter (severity = 'high') with_high, list_sort(array_agg(distinct category) filter (category is not null)) categories from (select repository, lower(trim(severity)) severity, lower(trim(category)) category from python_findings_manifest)")
def capability_sets(spark, d):
    f = tables.findings(spark, d)
    return f.agg(F.countDistinct(F.when(F.col("severity") == "high", F.col("repository"))).alias("with_high"), F.sort_array(F.collect_set("category")).alias("categories"))


@query("""with own as (select provider, repository, number, list_sort(array_agg(distinct f)) files from (select lower(provider) provider, repository, number, unnest(files) f from review_batches) where f is not null group by all),
    had as (select lower(provider) provider, repository, number, array_agg(distinct file_path) files from review_contexts where file_path is not null group by all)
    select o.provider, o.repository, o.number, list_sort(list_filter(o.files, lambda x: not list_contains(coalesce(h.files, []), x))) missing from own o left join had h on h.provider is not distinct from o.provider and h.repository is not distinct from o.repository and h.number is not distinct from o.number""")
def missing_members(spark, d):
    b = table(spark, d, "review_batches").select(F.lower("provider").alias("provider"), "repository", "number", F.explode("files").alias("f")).where("f is not null").groupBy(*KEY).agg(F.collect_set("f").alias("files"))
    c = table(spark, d, "review_contexts").where("file_path is not null").groupBy(F.lower("provider").alias("h_p"), F.col("repository").alias("h_r"), F.col("number").alias("h_n")).agg(F.collect_set("file_path").alias("had"))
    both = b.join(c, F.expr("provider <=> h_p and repository <=> h_r and number <=> h_n"), "left")
    return both.select(*KEY, F.sort_array(F.array_except("files", F.coalesce("had", F.array().cast("array<string>")))).alias("missing"))


# ---- screens as data -----------------------------------------------------------------------------------------------------


@query(f"""with {RUNS}, s as (select run_id, total_review_seconds t, case when number % 4 = 0 then 'running' when number % 4 = 1 then 'failed' else 'completed' end state, case when coalesce(skipped_files, 0) = 0 then 'pass' when skipped_files > 5 then 'block' else 'optional' end decision, number % 3 = 0 dry from runs)
    select run_id, case when state = 'running' then 'running' when state = 'failed' then 'failed' when decision = 'pass' then 'passed' when decision = 'block' then 'blocked' else 'changes' end outcome,
        case when dry then 'Dry run' when state = 'completed' then 'Published' when state = 'running' then 'Publishing' else 'Not published' end as mode,
        case when t >= 0 then (case when floor(t / 60) < 100 then lpad(floor(t / 60)::bigint::varchar, 2, '0') else floor(t / 60)::bigint::varchar end) || ':' || lpad(floor(t % 60)::bigint::varchar, 2, '0') end clock from s""")
def history_rows(spark, d):
    n = F.col("number")
    state = F.when(n % 4 == 0, "running").when(n % 4 == 1, "failed").otherwise("completed")
    skipped = F.coalesce("skipped_files", F.lit(0))
    decision = F.when(skipped == 0, "pass").when(skipped > 5, "block").otherwise("optional")
    return _runs(spark, d).select("run_id", history.outcome(state, decision).alias("outcome"), history.mode(state, n % 3 == 0).alias("mode"), history.clock(F.col("total_review_seconds")).alias("clock"))


@query(f"with {RUNS}, lo as (select min(finished_at)::date d from runs) select run_id, finished_at from runs, lo where review_depth = 'standard' and finished_at::date between d + 3 and d + 60 and contains(lower(repository), 'or')")
def filtered_history(spark, d):
    r = _runs(spark, d)
    low = r.agg(F.to_date(F.min("finished_at")).alias("d")).first()["d"]  # one date
    import datetime as dt

    first, last = (low + dt.timedelta(days=k) if low else None for k in (3, 60))
    rows = history.within(history.chosen(r, review_depth="standard", repository="all"), "finished_at", first and first.isoformat(), last and last.isoformat())
    return history.searched(rows, ["repository"], " OR ").select("run_id", "finished_at")


@query("select distinct lower(provider) provider, repository, number from change_sets where lower(state) = 'open' and (contains(lower(title), 'a') or contains(lower(author), 'a') or contains(lower(head_branch), 'a') or contains(number::varchar, 'a'))")
def filtered_dashboard(spark, d):
    c = tables.change_sets(spark, d)
    return history.searched(history.chosen(c, state="open"), ["title", "author", "head_branch", "number"], "A").select(F.lower("provider").alias("provider"), "repository", "number").distinct()


@query(f"with {FINDINGS} select seq, {RANK.format('severity')}::int place from findings where severity in ('high', 'low', 'critical', 'medium', 'suggestion') and repository like '%-labs/%' and contains(lower(concat_ws(' ', path, rule_id, issue)), 'log')")
def visible_findings(spark, d):
    from patchlake.operators.rules import rank

    f = tables.findings(spark, d).withColumn("text", F.concat_ws(" ", "path", "rule_id", "issue")).where("repository like '%-labs/%'")
    return history.searched(f.withColumn("place", rank(F.col("severity"))).where("place is not null"), ["text"], "Log").select("seq", "place")


@query("select distinct lower(c.provider) provider, c.repository, c.number from change_sets c where exists (select 1 from review_diagnostics r where r.repository = c.repository and lower(r.provider) = lower(c.provider))")
def allowed_change_sets(spark, d):
    allowed = table(spark, d, "review_diagnostics").select(F.lower("provider").alias("provider"), "repository").distinct()
    return table(spark, d, "change_sets").select(F.lower("provider").alias("provider"), "repository", "number").distinct().join(allowed, ["provider", "repository"], "left_semi")


@query(f"with {FILES} select provider, repository, number, count(*) files, count(distinct status) statuses, sum(coalesce(length(patch), 0))::bigint chars from files group by all")
def diff_totals(spark, d):
    return tables.files(spark, d).groupBy(*KEY).agg(F.count("*").alias("files"), F.countDistinct("status").alias("statuses"), F.sum(F.coalesce(F.length("patch"), F.lit(0))).cast("long").alias("chars"))


@query(f"""with {FINDINGS}, g as (select repository, {GATE} from findings group by all), n as (select repository, count(*) c from findings group by all)
    select repository, decision, case when critical_count + high_count + medium_count + low_count + suggestion_count = 0 then c else critical_count + high_count + medium_count + low_count + suggestion_count end::bigint findings, (critical_count + high_count)::bigint danger, medium_count::bigint warning, (low_count + suggestion_count)::bigint info from g join n using (repository)""")
def job_summaries(spark, d):
    f = tables.findings(spark, d)
    g = history.buckets(findings.gate(f, ["repository"])).join(f.groupBy("repository").agg(F.count("*").alias("c")), "repository")
    n = F.col("danger") + F.col("warning") + F.col("info")
    return g.select("repository", "decision", F.when(n == 0, F.col("c")).otherwise(n).alias("findings"), "danger", "warning", "info")


@query("""with p as (select number, (1 + number % 23)::int pages, (1 + number % 11)::int cur from (select distinct number from change_sets where number is not null)),
    q as (select number, pages, least(cur, pages) cur from p), s as (select *, list_sort(list_distinct(list_filter([1, pages, cur - 1, cur, cur + 1] || case when cur < 5 then [2, 3, 4, 5] else [] end, lambda n: n > 0 and n <= pages))) l from q)
    select number, case when pages <= 7 then range(1, pages + 1)::int[] else flatten([case when i > 1 and l[i] - l[i - 1] > 1 then [0, l[i]] else [l[i]] end for i in range(1, len(l) + 1)])::int[] end buttons from s""")
def page_buttons(spark, d):
    n = table(spark, d, "change_sets").select("number").where("number is not null").distinct()
    pages = (1 + F.col("number") % 23).cast("int")
    p = n.select("number", pages.alias("pages"), F.least((1 + F.col("number") % 11).cast("int"), pages).alias("cur"))
    return p.select("number", history.page_buttons(F.col("pages"), F.col("cur")).alias("buttons"))


@query(f"with {RUNS} select run_id, coalesce(case when number % 2 = 0 then skipped_files end, greatest(0, changed_files - ai_review_files))::int static_findings from runs")
def reconciled_metrics(spark, d):
    r = _runs(spark, d).withColumn("static_findings", F.when(F.col("number") % 2 == 0, F.col("skipped_files")))
    return history.reconciled(r, "changed_files", "ai_review_files").select("run_id", "static_findings")


# ---- sources -------------------------------------------------------------------------------------------------------------


@query("""with e as (select distinct file_id, file_path, status from changed_files where file_id % 9 <> 0),
    m as (select file_id, regexp_replace(trim(file_path), '^/+', '') path, case status when 'added' then 'added' when 'removed' then 'removed' when 'renamed' then 'renamed' else 'modified' end status, file_path from e)
    select file_id, path, case when status = 'renamed' then 'old/' || path else path end original_path, status, file_id tracking_id from m where path <> ''""")
def change_entries(spark, d):
    f = table(spark, d, "changed_files").select("file_id", "file_path", "status").distinct()
    change = F.when(F.col("status") == "added", "add").when(F.col("status") == "removed", "delete, sourceRename").when(F.col("status") == "renamed", "rename, edit").otherwise("edit")
    e = f.select(
        "file_id", F.col("file_path").alias("path"), change.alias("change"), (F.col("file_id") % 18 == 0).alias("is_folder"), F.when(F.col("file_id") % 9 == 0, "TREE").alias("object_kind"),
        F.lit(None).cast("string").alias("original"), F.concat(F.lit("/old/"), F.regexp_replace(F.trim("file_path"), "^/+", "")).alias("source_item"), F.when(F.col("file_id") % 2 == 0, F.col("file_id")).otherwise(F.lit(0)).alias("tracking_id"), F.col("file_id").alias("change_id"),
    )
    return providers.change_entries(e, ["file_id"])


@query("select distinct file_id, file_path path from changed_files where file_id % 4 <> 0 and trim(file_path) <> ''")
def tree_files(spark, d):
    e = table(spark, d, "changed_files").select("file_id", F.col("file_path").alias("path"), F.when(F.col("file_id") % 4 == 0, "tree").otherwise("blob").alias("kind")).distinct()
    return providers.tree_files(e).select("file_id", "path")


@query("with one as (select distinct lower(provider) provider, repository, number from change_sets) select provider, split_part(repository, '/', 1) as owner, repository, count(*) change_sets from one group by all")
def listed_repositories(spark, d):
    one = table(spark, d, "change_sets").select(F.lower("provider").alias("provider"), "repository", "number").distinct()
    return providers.listing(one, F.split_part("repository", F.lit("/"), F.lit(1)))


@query(f"with {FILES}, ctx as (select distinct repository, regexp_replace(replace(file_path, '\\', '/'), '^(\\./)+', '') path from review_contexts where file_path is not null), ch as (select distinct repository, path from files where file_id % 2 = 0) select repository, path, true changed from ch union all select repository, path, false from ctx where (repository, path) not in (select repository, path from ch)")
def files_with_tree(spark, d):
    from patchlake.functions.paths import plain_path

    ch = tables.files(spark, d).where("file_id % 2 = 0").select("repository", "path").distinct()
    tree = table(spark, d, "review_contexts").where("file_path is not null").select("repository", plain_path("file_path").alias("path")).distinct()
    return providers.with_tree(ch, tree, ["repository", "path"])


# ---- prompts -------------------------------------------------------------------------------------------------------------


@query(f"""with {LINES}, f as (select repository, number, provider, path, string_agg(line_number || ' | ' || content, chr(10) order by line_number, content) t from added where file_id % 10 = 3 group by all)
    select provider, repository, number, list(path order by path) paths, 'Review these lines.' || chr(10) || chr(10) || string_agg('File: ' || path || chr(10) || t, chr(10) || chr(10) order by path) prompt from f group by all""")
def batch_prompts(spark, d):
    lines = diff.added_lines(tables.files(spark, d).where("file_id % 10 = 3"), [*KEY, "path"])
    return publishing.prompts(lines, KEY, "Review these lines.")


# ---- claims that the source contradicts ------------------------------------------------------------------------------------


@query()
def contradicted_findings(spark, d):
    f = tables.files(spark, d)
    return contradictions.contradicted(tables.findings(spark, d), f.select("repository", "path", F.col("patch").alias("text")), diff.added_lines(f, ["repository", "path"]), ["repository", "path"])


# ---- gates ---------------------------------------------------------------------------------------------------------------


@query(rf"""with {LINES}, own as (select file_id, path, line_number, content, trim(content) bare from added where not regexp_matches(content, '^\s*(?:[{{}}()\[\]]|\}};|\);|\],|\}},)?\s*$') and not regexp_matches(content, '^\s*//')),
    n as (select file_id, path, count(*) n, bool_or(regexp_matches(content, '(?i)(?:password|secret|token)["'']?\s*[:=]\s*["'']?[^\s"'']{{3,}}|credential|(?:api|access|private)[_-]?key|cors|allowed[_-]?origins|csrf|\bssl\b|\btls\b|connectionstrings|signingkey')) sensitive,
        bool_or(regexp_matches(content, '(?i)url\s*\(|@import|expression\s*\(|behavior\s*:')) risk, bool_and(regexp_matches(bare, '^(?:["]{{3}}.*|['']{{3}}.*|#.*|[^=(){{}}\[\]:]*)$')) remarks from own group by all),
    r as (select *, regexp_extract(lower(path), '[^/]*$') name from n)
    select file_id, case when regexp_matches(lower(path), '\.pyw?$') and remarks then 'module of remarks'
        when regexp_matches(name, '(?:\.(?:sln|csproj|fsproj|vbproj)|^(?:directory\.build\.(?:props|targets)|global\.json|pom\.xml|build\.gradle(?:\.kts)?|settings\.gradle(?:\.kts)?|gradle\.properties))$')
            or regexp_matches(name, '^(?:appsettings[\w.]*\.json|launchsettings\.json|web\.config|app\.config|nlog\.config|application[\w-]*\.(?:properties|ya?ml)|logback[\w-]*\.xml)$') and not sensitive then 'configuration alone'
        when regexp_matches(lower(path), '\.(?:css|scss|sass|less|styl)$') and not risk then 'plain styles' else 'other' end reason from r where not regexp_matches(lower(path), '\.(?:cs|java)$')""")
def gated_files(spark, d):
    lines = diff.added_lines(tables.files(spark, d), ["file_id", "path"]).where(~F.lower("path").rlike(r"\.(?:cs|java)$"))
    none = lines.select("file_id", "line_number").limit(0)
    constructs = lines.limit(0).select("file_id", F.lit(0).alias("constructs"), F.lit(True).alias("covered"))
    g = gates.value_gate(lines, none, constructs, ["file_id"])
    # passive declarations are tested on fixtures: their forms are no SQL patterns
    return g.select("file_id", F.when(F.col("reason") == "passive declaration", "other").otherwise(F.coalesce("reason", F.lit("other"))).alias("reason"))


@query()
def value_gate(spark, d):
    from patchlake.operators import rules

    f = tables.files(spark, d)
    lines = diff.added_lines(f, ["file_id", "path"])
    found = rules.line_findings(lines, ["file_id"])
    texts = lines.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("line_number", "content"))).alias("l")).select("file_id", F.array_join(F.transform("l", lambda x: x["content"]), "\n").alias("text"), F.col("l")[0]["line_number"].alias("first"))
    spans = gates.spans(texts.select("file_id", "first", "text"), ["file_id", "first"]).select("file_id", (F.col("start") + F.col("first") - 1).alias("start"), (F.col("end") + F.col("first") - 1).alias("end"))
    return gates.value_gate(lines, found, gates.covered_constructs(spans, found, ["file_id"]), ["file_id"])


@query(rf"""with {FINDINGS}, {LINES}, l as (select repository, path, line_number, min(content) content from added group by all),
    s as (select f.seq, f.rule_id, f.path, content, regexp_replace(lower(concat_ws(' ', issue, suggestion)), '[^a-z0-9]+', ' ', 'g') t, ' ' || trim(regexp_replace(lower(coalesce(content, '')), '[^a-z0-9]+', ' ', 'g')) || ' ' c from findings f left join l on l.repository = f.repository and l.path = f.path and l.line_number = f.line_number),
    k as (select *, ' ' || trim(t) || ' ' u, case rule_id when 'incorrect-result-handling' then regexp_matches(c, ' (return|update|save|delete|create|result|success) ') when 'async-blocking-operation' then regexp_matches(c, ' (time sleep|thread sleep|wait|result|readfilesync|execsync) ')
        when 'missing-timeout' then regexp_matches(c, ' (get|post|put|patch|delete|request|send) ') when 'authorization' then regexp_matches(c, ' (if|unless|require|check|contains|includes) ') when 'command-injection' then regexp_matches(c, ' (shell true|exec|system|popen|check output|process start) ')
        when 'unsafe-code-execution' then regexp_matches(c, ' (eval|exec|compile|function) ') when 'cache-consistency' then regexp_matches(c, ' (cache|key|memo) ') when 'unsafe-deserialization' then regexp_matches(c, ' ((pickle|dill) loads?|yaml load) ')
        when 'insufficient-test-assertion' then regexp_matches(c, ' (assert|expect|verify|should) ') and regexp_matches(c, ' (status|called|true|not none|not null|notnull|istype|equal) ') when 'weak-cryptography' then regexp_matches(c, ' (md5|sha1) ')
        when 'resource-cleanup' then regexp_matches(c, ' (open|clientsession|response|stream|reader|writer) ') when 'unowned-background-task' then regexp_matches(c, ' (create task|run in executor|submit|task run|startnew) ')
        when 'exception-detail-exposure' then regexp_matches(c, ' (str (error|exception|exc|e)|message|stacktrace) ') end ok from s)
    select seq, list_filter([case when regexp_matches(u, ' (assume|assumes|assuming|assumption|probably|might be|could be|should come from|appears to be|seems to|without knowing|come from a database) ') then 'assumes' end,
        case when regexp_matches(lower(path), '\.(?:properties|ya?ml|env)$') and regexp_matches(u, ' (empty password|create drop|h2|embedded database|default password|debug) ') then 'local settings' end,
        case when ok is not null and content is null then 'no changed line' end, case when content is not null and not ok then 'line shows nothing of it' end], lambda x: x is not null) reasons from k""")
def semantic_reasons(spark, d):
    lines = diff.added_lines(tables.files(spark, d), ["repository", "path"])
    return gates.semantic_reasons(tables.findings(spark, d), lines, ["repository", "path"])


# ---- from file to file ---------------------------------------------------------------------------------------------------

TEXTS = FILES + ", texts as (select repository, path, max(patch) as text from files group by all)"


def _texts(spark, d):
    return tables.files(spark, d).groupBy("repository", "path").agg(F.max("patch").alias("text"))


@query(rf"""with {TEXTS}, refs as (select distinct repository, path, unnest(regexp_extract_all(text, '(?:\bfrom\s*|\brequire\(\s*|\bimport\(?\s*)["''](\.{{1,2}}/[^"''\n]+)["'']', 1)) ref from texts where text is not null),
    parts as (select *, list_filter(string_split(path, '/')[:-2] || string_split(ref, '/'), lambda x: x not in ('', '.')) p from refs),
    own as (select distinct repository, path, array_to_string(case when len(p) = 0 then [] else list_reduce(list_prepend([]::varchar[], [[x] for x in p]), lambda a, x: case when x[1] = '..' then a[:-2] else a || x end) end, '/') target from parts),
    tried as (select *, unnest(['', '.js', '.jsx', '.mjs', '.ts', '.tsx', '.json', '.vue', '/index.js', '/index.ts', '/index.tsx']) e from own)
    select t.repository, t.path, t.target, bool_or(k.path is not null) "exists" from tried t left join texts k on k.repository = t.repository and k.path = t.target || t.e group by all""")
def file_references(spark, d):
    return crossfile.references(_texts(spark, d), ["repository"])


@query(rf"""with {TEXTS}, asked as (select distinct repository, path, unnest(regexp_extract_all(text, '\bgetElementById\s*\(\s*["'']([\w-]+)["'']', 1)) as name from texts where not regexp_matches(lower(path), '\.html?$')),
    has as (select distinct repository, unnest(regexp_extract_all(text, '\bid\s*=\s*["'']([\w-]+)["'']', 1)) as name from texts where regexp_matches(lower(path), '\.html?$'))
    select a.repository, a.path, a.name, h.name is not null "exists" from asked a left join has h on h.repository = a.repository and h.name = a.name""")
def page_elements(spark, d):
    return crossfile.elements(_texts(spark, d), ["repository"])


@query(rf"""with {TEXTS}, declared as (select distinct repository, path component, unnest(regexp_extract_all(text, '\bselector\s*:\s*["'']([\w-]+)["'']', 1)) as name from texts where regexp_matches(lower(path), '\.ts$')),
    used as (select distinct repository, path, unnest(regexp_extract_all(text, '<([a-z][a-z0-9]*-[\w-]+)', 1)) as name from texts where regexp_matches(lower(path), '\.html?$')), n as (select repository, name, count(*) pages from used group by all)
    select d.repository, d.name, component, coalesce(pages, 0) pages from declared d left join n on n.repository = d.repository and n.name = d.name""")
def component_selectors(spark, d):
    return crossfile.selectors(_texts(spark, d), ["repository"])


@query()
def refuted_findings(spark, d):
    return proofs.refuted(tables.findings(spark, d), _texts(spark, d), ["repository", "path"])

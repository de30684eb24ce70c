"""Each rule over callables with a case that breaks it and one that doesn't."""

import pytest

from patchlake.operators import methods, syntax

J = "public {0} go({1}) {{\n  {2}\n}}\n"
C = "public async Task<IActionResult> {0}({1})\n{{\n    {2}\n}}\n"

#: path, rule, code that breaks it, code that doesn't.
CASES = [
    ("A.java", "identity-comparison-literal", J.format("void", "String a", 'if (a == "x") stop();'), J.format("void", "String a", 'if (a.equals("x")) stop();')),
    ("A.java", "null-safety", J.format("User", "", "return repo.find().orElse(null);"), J.format("Optional<User>", "", "return x.orElse(null);")),
    ("A.java", "cache-consistency", J.format("User", "String tenant, String id", "return userCache.get(id);"), J.format("User", "String tenant, String id", "return userCache.get(tenant + id);")),
    ("A.java", "async-blocking-operation", "@Async\n" + J.format("void", "", "Thread.sleep(5);"), J.format("void", "", "Thread.sleep(5);")),
    ("A.java", "path-traversal", J.format("byte[]", "String n", "return Files.readAllBytes(root.resolve(n));"), J.format("byte[]", "String n", "Path p = root.resolve(n); if (!p.startsWith(root)) stop(); return Files.readAllBytes(root.resolve(n));")),
    ("A.java", "sql-injection", J.format("void", "String n", 'String q = "select x from t where n=" + n; em.createNativeQuery(q);'), J.format("void", "String n", 'String q = "select x from t where n=:n"; em.createNativeQuery(q).setParameter("n", n);')),
    ("A.java", "weak-cryptography", J.format("String", "", "String token = \"\" + new Random().nextInt(); return token;"), J.format("int", "", "return new Random().nextInt();")),
    ("A.java", "resource-cleanup", J.format("long", "", "return Files.lines(p).count();"), J.format("long", "", "try (var s = Files.lines(p)) { return s.count(); }")),
    ("A.java", "security", J.format("void", "", "DocumentBuilderFactory.newInstance().newDocumentBuilder().parse(x);"), J.format("void", "", 'var f = DocumentBuilderFactory.newInstance(); f.setFeature("disallow-doctype-decl", true);')),
    ("A.java", "ssrf", J.format("void", "@RequestParam String url", "webClient.get().uri(url).retrieve();"), J.format("void", "@RequestParam String url", "if (!allowedHosts.contains(url)) stop(); webClient.get().uri(url).retrieve();")),
    ("A.java", "open-redirect", J.format("void", "@RequestParam String next", "response.sendRedirect(next);"), J.format("void", "@RequestParam String next", 'if (next.startsWith("/")) response.sendRedirect(next);')),
    ("A.java", "sequential-io-operations", J.format("void", "", "restTemplate.getForObject(a);\n  restTemplate.getForObject(b);"), J.format("void", "", "restTemplate.getForObject(a);")),
    ("A.java", "unrestricted-file-upload", J.format("void", "MultipartFile f", "f.transferTo(x);"), J.format("void", "MultipartFile f", "check(f.getContentType()); f.transferTo(x);")),
    ("A.java", "incorrect-result-handling", J.format("boolean", "", "find().ifPresent(repo::save); return true;"), J.format("boolean", "", "find().ifPresent(repo::save); return done;")),
    ("A.java", "authorization", J.format("void", '@RequestHeader("X-Role") String role', "if (role == null) stop();"), J.format("void", '@RequestHeader("X-Role") String role', 'if (role == null || !role.equals("A")) stop();')),
    ("ATest.java", "insufficient-test-assertion", "@Test\n" + J.format("void", "", "mvc.perform(x).andExpect(status().isOk());"), "@Test\n" + J.format("void", "", 'mvc.perform(x).andExpect(status().isOk()).andExpect(jsonPath("$.a"));')),
    ("A.java", "empty-catch-block", J.format("void", "", "try { a(); } catch (Exception e) { // no\n }"), J.format("void", "", "try { a(); } catch (Exception e) { log(e); }")),
    ("A.cs", "unowned-background-task", C.format("Go", "", "Task.Run(() => x());"), C.format("Go", "", "await Task.Run(() => x());")),
    ("A.cs", "missing-cancellation-propagation", C.format("Go", "CancellationToken ct", "await _repository.FindAsync(id);"), C.format("Go", "CancellationToken ct", "await _repository.FindAsync(id, ct);")),
    ("A.cs", "cache-consistency", C.format("Go", "string tenantId, int id", "_cache.TryGetValue(id, out var x);"), C.format("Go", "string tenantId, int id", "_cache.TryGetValue(tenantId + id, out var x);")),
    ("A.cs", "predictable-random-token", C.format("Go", "", "var token = new Random().Next();"), C.format("Go", "", "var n = new Random().Next();")),
    ("A.cs", "resource-cleanup", C.format("Go", "", "var s = new StreamReader(p);"), C.format("Go", "", "using var s = new StreamReader(p);")),
    ("A.cs", "sequential-io-operations", C.format("Go", "CancellationToken ct", "await _client.GetAsync(a, ct);\n await _client.GetAsync(b, ct);"), C.format("Go", "CancellationToken ct", "await Task.WhenAll(_client.GetAsync(a, ct), _client.GetAsync(b, ct));")),
    ("A.cs", "tenant-isolation", C.format("Go", "string tenantId", "return q.Where(x => x.Name == n);"), C.format("Go", "string tenantId", "return q.Where(x => x.Name == n && x.TenantId == tenantId);")),
    ("A.cs", "sql-injection", C.format("Go", "string n", 'Run($"select * from t where n = {n}");'), C.format("Go", "string n", 'FromSqlInterpolated($"select * from t where n = {n}");')),
    ("A.cs", "ef-tracking-read", C.format("GetAll", "", "return await _context.Users.ToListAsync();"), C.format("GetAll", "", "return await _context.Users.AsNoTracking().ToListAsync();")),
    ("A.cs", "n-plus-one-query", C.format("Go", "", "foreach (var x in xs) { await _context.Users.FindAsync(x); }"), C.format("Go", "", "foreach (var x in xs) { y(x); }")),
    ("A.cs", "null-safety", C.format("Go", "", "var u = xs.FirstOrDefault(x => x.A);\n u.Save();"), C.format("Go", "", "var u = xs.FirstOrDefault(x => x.A);\n if (u == null) return; u.Save();")),
    ("A.cs", "missing-save-changes", C.format("Go", "", "await _context.Users.AddAsync(u);"), C.format("Go", "", "await _context.Users.AddAsync(u); await _context.SaveChangesAsync(ct);")),
    ("A.cs", "unstable-pagination", C.format("Go", "", "return q.Skip(5).Take(5);"), C.format("Go", "", "return q.OrderBy(x => x.Id).Skip(5).Take(5);")),
    ("A.cs", "cors-misconfiguration", C.format("Go", "", "p.AllowAnyOrigin().AllowCredentials();"), C.format("Go", "", "p.AllowAnyOrigin();")),
    ("A.cs", "insecure-cookie", C.format("Go", "", 'Response.Cookies.Append("a", b);'), C.format("Go", "", 'Response.Cookies.Append("a", b, new CookieOptions { HttpOnly = true, Secure = true });')),
    ("A.cs", "developer-exception-page", C.format("Go", "", "app.UseDeveloperExceptionPage();"), C.format("Go", "", "if (env.IsDevelopment()) app.UseDeveloperExceptionPage();")),
    ("A.cs", "background-cancellation", C.format("Run", "CancellationToken stoppingToken", "while (true) { go(); }"), C.format("Run", "CancellationToken stoppingToken", "while (!stoppingToken.IsCancellationRequested) { go(); }")),
    ("A.cs", "exception-detail-exposure", C.format("Go", "", "return BadRequest(ex.Message);"), C.format("Go", "", 'return BadRequest("no");')),
    ("A.cs", "path-traversal", C.format("Go", "string fileName", "return File(Path.Combine(root, fileName));"), C.format("Go", "string fileName", "return File(Path.Combine(root, Path.GetFileName(fileName)));")),
    ("A.cs", "unrestricted-file-upload", C.format("Go", "IFormFile f", "await f.CopyToAsync(s);"), C.format("Go", "IFormFile f", "check(f.ContentType); await f.CopyToAsync(s);")),
    ("A.cs", "ssrf", C.format("Go", "string url", "await _client.GetAsync(url);"), C.format("Go", "string url", "if (!AllowedHosts.Contains(url)) return; await _client.GetAsync(url);")),
    ("A.cs", "open-redirect", C.format("Go", "string returnUrl", "return Redirect(returnUrl);"), C.format("Go", "string returnUrl", "return Url.IsLocalUrl(returnUrl) ? Redirect(returnUrl) : Home();")),
    ("A.cs", "command-injection", C.format("Go", "string x", 'Process.Start("bash", $"-c {x}");'), C.format("Go", "string x", "Process.Start(info);")),
    ("A.cs", "mass-assignment", C.format("Go", "[FromBody] User user", "save(user);"), C.format("Go", "[FromBody] UserDto user", "save(user);")),
    ("A.cs", "missing-endpoint-authorization", '[HttpPost("admin/x")]\n' + C.format("Go", "", "x();"), '[Authorize]\n[HttpPost("admin/x")]\n' + C.format("Go", "", "x();")),
    ("ATests.cs", "insufficient-test-assertion", "[Fact]\n" + C.format("Go", "", "var r = await x(); Assert.NotNull(r);"), "[Fact]\n" + C.format("Go", "", "var r = await x(); Assert.NotNull(r); Assert.Equal(1, r.A);")),
    ("a.js", "fetch-status-not-checked", "async function go() {\n const r = await fetch(u);\n return r.json();\n}", "async function go() {\n const r = await fetch(u);\n if (!r.ok) throw e;\n return r.json();\n}"),
    ("a.js", "missing-timeout", "async function go() {\n await fetch(u);\n}", "async function go() {\n await fetch(u, { signal });\n}"),
    ("a.js", "predictable-random-token", "function makeToken() {\n return Math.random();\n}", "function pick() {\n return Math.random();\n}"),
    ("a.js", "null-safety", "function go() {\n const e = document.getElementById('x');\n e.focus();\n}", "function go() {\n const e = document.getElementById('x');\n if (e) e.focus();\n}"),
    ("a.js", "path-traversal", "function go(req) {\n return path.join(root, req.query.f);\n}", "function go(req) {\n return path.join(root, path.basename(req.query.f));\n}"),
    ("a.js", "async-issue", "function go() {\n load().then(x);\n}", "function go() {\n load().then(x).catch(y);\n}"),
    ("a.js", "listener-cleanup", "function setupMenu(el) {\n el.addEventListener('click', go);\n}", "function setupMenu(el, signal) {\n el.addEventListener('click', go, { signal });\n}"),
    ("a.tsx", "direct-dom-manipulation", "function App() {\n document.getElementById('x').focus();\n}", "function start() {\n createRoot(document.getElementById('x'));\n}"),
    ("a.ts", "unsafe-type-assertion", "function go(a: A) {\n return a as unknown as B;\n}", "function go(a: A) {\n return a as const;\n}"),
    ("a.ts", "unsafe-indexed-access", "function go(o: object, k: string) {\n return o[k];\n}", "function go(o: object, k: string) {\n if (k in o) return o[k];\n}"),
    ("a.ts", "broad-function-type", "function go(f: Function) {\n f();\n}", "function go(f: () => void) {\n f();\n}"),
    ("a.ts", "typescript-possibly-undefined-result", "function go(): User {\n return xs.find(x);\n}", "function go(): User | undefined {\n return xs.find(x);\n}"),
    ("a.ts", "typescript-possibly-undefined-result", "function go(xs: A[], i: number): A {\n return xs[i];\n}", "function go(xs: A[], i: number): A | undefined {\n return xs[i];\n}"),
    ("a.ts", "unvalidated-external-data", "async function go(): Promise<User> {\n return r.json();\n}", "async function go(): Promise<User> {\n return schema.parse(await r.json());\n}"),
    ("a.ts", "prototype-pollution", "function go(o, key, v) {\n o[key] = v;\n}", "function go(o, key, v) {\n if (key === '__proto__') return;\n o[key] = v;\n}"),
    ("a.ts", "typescript-use-before-assignment", "function go() {\n let n: number;\n n += 1;\n}", "function go() {\n let n: number;\n n = 0;\n n += 1;\n}"),
    ("a.js", "global-event-listener-without-removal", "function go() {\n window.addEventListener('x', () => y());\n}", "function go() {\n window.addEventListener('x', y);\n return () => window.removeEventListener('x', y);\n}"),
    ("a.ts", "rxjs-subscription-without-cleanup", "function go() {\n interval(5).subscribe(x);\n}", "function go() {\n interval(5).pipe(takeUntilDestroyed()).subscribe(x);\n}"),
    ("a.ts", "typescript-null-dereference", "function go(a: User | null) {\n return a.name;\n}", "function go(a: User | null) {\n return a?.name;\n}"),
    ("a.ts", "typescript-optional-operand", "function go(n?: number) {\n return n * 2;\n}", "function go(n?: number) {\n return (n ?? 1) * 2;\n}"),
    ("a.ts", "observer-without-cleanup", "function go() {\n const o = new ResizeObserver(f);\n o.observe(x);\n}", "function go() {\n const o = new ResizeObserver(f);\n o.observe(x);\n return () => o.disconnect();\n}"),
]


@pytest.mark.parametrize("case", CASES, ids=lambda c: f"{c[0]}-{c[1]}")
def test_rule_fires_and_is_excused(case):
    path, rule, bad, good = case
    assert rule in {r for _, r, _ in methods.method_findings(path, bad)}
    assert rule not in {r for _, r, _ in methods.method_findings(path, good)}


def test_callables_and_their_nesting():
    text = "class A {\n  @X(\"a\")\n  void go(int a) throws B {\n    if (a) { x(); }\n  }\n}\n"
    assert [text[a:b].split("\n")[0].strip() for a, b in methods.callables(text)] == ['@X("a")']
    nested = "function outer() {\n  const f = (x) => {\n    Math.random(); let token;\n  };\n}"
    assert len(methods.callables(nested)) == 2
    assert [r for _, r, _ in methods.method_findings("a.js", nested)].count("predictable-random-token") == 1
    assert methods.callables("") == [] and not list(methods.method_findings("a.cs", "{ ( [")) and not list(methods.method_findings("x", "f() {}"))


def test_methods_of_a_patch_by_line(spark):
    patch = "@@ -1 +10,4 @@\n+public void Go(string a)\n {\n+    Run($\"delete from t where n = {a}\");\n }"
    df = spark.createDataFrame([(1, "A.cs", patch), (2, "b.java", None)], "file_id long, path string, patch string")
    assert [tuple(r) for r in syntax.syntax_findings(df).collect()] == [(1, 12, "sql-injection", "high")]


#: path, rule, a line that breaks it, one that doesn't.
LINES = [
    ("a.js", "null-safety", "document.getElementById('x').value", "document.getElementById('x')?.value"), ("a.js", "authorization", "if (req.headers['x-user-role'] === 'a')", "req.headers['x-request-id']"),
    ("a.spec.ts", "insufficient-test-assertion", "expect(result).toBeTruthy()", "expect(result).toEqual(3)"), ("a.test.ts", "insufficient-test-assertion", "expect(x).toBe(undefined)", "expect(x).toBe(1)"),
    ("a.ts", "unobserved-promise-rejection", "  Promise.reject(e);", "  return Promise.reject(e);"), ("a.ts", "always-truthy-condition", "if (a === 'x' || 'y') {", "if (a === 'x' || b === 'y') {"),
    ("A.java", "logic-error", "int offset = page * size;", "int offset = (page - 1) * size;"), ("A.java", "command-injection", 'Runtime.getRuntime().exec("ls " + x);', 'Runtime.getRuntime().exec("ls");'),
    ("A.java", "sql-injection", 'em.createNativeQuery("select " + x)', 'em.createNativeQuery("select 1")'), ("A.java", "path-traversal", "root.resolve(entry.getName())", 'root.resolve("a")'),
    ("A.java", "unsafe-deserialization", "in.readObject()", "in.readObjectId()"), ("A.java", "weak-cryptography", 'MessageDigest.getInstance("SHA-1")', 'MessageDigest.getInstance("SHA-256")'),
    ("A.java", "exception-detail-exposure", "return ResponseEntity.status(500).body(e.getMessage());", "log.warn(e.getMessage());"), ("A.java", "data-validation", "BeanUtils.copyProperties(request, user);", "BeanUtils.copyProperties(user, view);"),
    ("A.java", "unowned-background-task", "  CompletableFuture.runAsync(x);", "  var f = CompletableFuture.runAsync(x);"), ("A.java", "sensitive-data-logging", 'log.info("password {}", p);', 'log.info("user {}", u);'),
    ("A.java", "missing-input-validation", "void go(@RequestBody User u)", "void go(@Valid @RequestBody User u)"), ("ATest.java", "insufficient-test-assertion", "assertNotNull(userService.save(u));", "assertEquals(1, x);"),
    ("A.cs", "null-forgiving-nullable", "var x = (await Find())!.Name;", "var x = (await Find())?.Name;"), ("A.cs", "missing-cancellation-propagation", "await db.SaveChangesAsync();", "await db.SaveChangesAsync(ct);"),
    ("A.cs", "pagination-offset", "q.Skip(page * size)", "q.Skip((page - 1) * size)"), ("A.cs", "weak-cryptography", "MD5.Create()", "SHA256.Create()"), ("A.cs", "weak-encryption", "CipherMode.ECB", "CipherMode.CBC"),
    ("A.cs", "httpclient-lifetime", "var c = new HttpClient();", "using var c = new HttpClient();"), ("A.cs", "dbcontext-concurrency", "await Task.WhenAll(_context.A(), _context.B());", "await Task.WhenAll(a, b);"),
    ("A.cs", "singleton-mutable-state", "services.AddSingleton<TenantContext>();", "services.AddScoped<TenantContext>();"), ("A.cs", "dependency-lifetime", "class W(AppDbContext db) : BackgroundService", "class W(IServiceScopeFactory f) : BackgroundService"),
    ("A.cs", "mass-assignment", "user.IsAdmin = request.IsAdmin;", "user.Name = request.Name;"), ("A.cs", "sensitive-data-logging", '_logger.LogInformation("password {P}", p);', '_logger.LogInformation("x");'),
    ("appsettings.json", "debug-logging", '"Default": "Debug"', '"Default": "Warning"'), ("x/appsettings.Dev.json", "hardcoded-secret", '"c": "Server=a;Password=Zk29xm;"', '"c": "Server=a;Password=${P};"'),
    ("ATests.cs", "insufficient-test-assertion", "Assert.Equal(0, Parser.Parse(x));", "Assert.Equal(3, Parser.Parse(x));"),
]


def test_line_rules(spark):
    from patchlake.operators import rules

    df = spark.createDataFrame([(2 * i + k, c[0], 1, c[2 + k]) for i, c in enumerate(LINES) for k in (0, 1)], "k int, path string, line_number int, content string")
    fired = {(r.k, r.rule_id) for r in rules.line_findings(df, ["k"]).collect()}
    for i, c in enumerate(LINES):
        assert (2 * i, c[1]) in fired and (2 * i + 1, c[1]) not in fired, c


def test_unused_values_and_parameters():
    found = lambda text, whole=None: [(text[at:].split()[0].strip("(),;=:"), r) for at, r, _ in syntax.unused_findings(text, whole or text)]
    assert found("const a = 1;\nlet b = 2;\nuse(b);\nexport const c = 3;\nconst t = setInterval(f, 1);") == [("a", "unused-variable")]
    assert found("const a = 1;", "const a = 1;\n...\nuse(a)") == []
    assert found("function f(a, b = [1, 2], { c }, ...rest) {\n return b;\n}") == [("a", "unused-parameter"), ("rest", "unused-parameter")]
    assert found("xs.map((x, i) => x)\nys.map((_y) => 1)") == [("i", "unused-parameter")]
    assert found("class A {\n constructor(private http: Http, name: string) {}\n go() { this.http.get(); }\n}") == [("name", "unused-parameter")]
    assert found("function f(a {") == [] and found("") == []


def test_console_and_unused_value_are_the_findings_of_a_small_change(spark):
    from patchlake.operators import diff, findings, rules

    patch = "@@ -1,1 +1,3 @@\n function greet() {}\n+console.log('hi');\n+const unused = 3;"
    df = spark.createDataFrame([(1, "src/a.js", patch)], "file_id long, path string, patch string")
    by_line = rules.line_findings(diff.added_lines(df, ["file_id", "path"]), ["file_id"])
    both = by_line.unionByName(syntax.syntax_findings(df))
    assert sorted((r.line_number, r.rule_id) for r in both.collect()) == [(2, "no-console"), (3, "unused-variable")]
    assert findings.gate(both, ["file_id"]).first().decision == "non_blocking"


#: rule, code that breaks it, code that doesn't.
FUNCTIONS = [
    ("incorrect-result-handling", "def f(r):\n    repo.delete(r)\n    return True", "def f(r):\n    return repo.delete(r)"),
    ("incorrect-result-handling", "def f():\n    try:\n        go()\n    except ValueError:\n        pass\n    return True", "def f():\n    try:\n        go()\n    except ValueError:\n        return False\n    return True"),
    ("incorrect-result-handling", "def f():\n    try:\n        go()\n    except ValueError:\n        return {'success': True}", "def f():\n    try:\n        go()\n    except ValueError:\n        return {'success': False}"),
    ("resource-cleanup", "def f(p):\n    h = open(p)\n    return h.read()", "def f(p):\n    with open(p) as h:\n        return h.read()"),
    ("authorization", "def f(role=Header()):\n    if role:\n        go()", "def f(role=Header()):\n    if role == 'admin':\n        go()"),
    ("authorization", "def require_role(a, b):\n    if a != b:\n        stop()", "def require_role(a):\n    if a != 'admin':\n        stop()"),
    ("untrusted-identity-header", "def current_user(x=Header()):\n    return x", "def current_user(x=Depends(y)):\n    return x"),
    ("logic-error", "def f(page, page_size):\n    return q.offset(page * page_size)", "def f(page, page_size):\n    return q.offset((page - 1) * page_size)"),
    ("cache-consistency", "def f(a, b):\n    key = f'x{a}'\n    return cache.get(key) or load(a, b)", "def f(a, b):\n    key = f'x{a}{b}'\n    return cache.get(key) or load(a, b)"),
    ("insufficient-test-assertion", "def test_a():\n    assert r.status_code == 200", "def test_a():\n    assert r.status_code == 200\n    assert r.json() == 3"),
    ("insufficient-test-assertion", "def test_a():\n    assert r.total == 3", "def test_a():\n    assert r.total == 3\n    assert r.items == [1]"),
    ("insufficient-test-assertion", "def test_missing():\n    assert go() is True", "def test_missing():\n    assert go() is False"),
    ("missing-timeout", "async def f():\n    await session.get(u)", "async def f():\n    await session.get(u, timeout=3)"),
    ("http-status-not-checked", "async def f():\n    r = await client.get(u)\n    return r.text", "async def f():\n    r = await client.get(u)\n    r.raise_for_status()\n    return r.text"),
    ("unvalidated-external-data", "async def f():\n    r = await client.get(u)\n    return r.json()", "async def f():\n    r = await client.get(u)\n    return User.model_validate(r.json())"),
    ("sequential-await-in-loop", "async def f():\n    for u in us:\n        await client.get(u)", "async def f():\n    await client.get(u)"),
    ("unrestricted-file-upload", "def f(x: UploadFile):\n    save(x.filename)", "def f(x: UploadFile):\n    check(x.content_type)\n    save(x.filename)"),
    ("open-redirect", "def f(url):\n    return RedirectResponse(url)", "def f(url):\n    if url.startswith('/'):\n        return RedirectResponse(url)"),
    ("response-contract-mismatch", "class A(B):\n    x: int\n    y: int\nclass C(B):\n    x: int\n@app.get('/', response_model=A)\ndef f():\n    return C(x=1)", "class A(B):\n    x: int\nclass C(B):\n    x: int\n@app.get('/', response_model=A)\ndef f():\n    return C(x=1)"),
]


@pytest.mark.parametrize("case", FUNCTIONS, ids=lambda c: c[0])
def test_python_functions(case):
    rule, bad, good = case
    assert rule in {r for _, r, _ in syntax.python_findings(bad)} and rule not in {r for _, r, _ in syntax.python_findings(good)}


TYPED = [
    ("non-exhaustive-union", "type A = 'x' | 'y';\nfunction f(a: A) {\n switch (a) {\n case 'x': return 1;\n }\n}", "type A = 'x' | 'y';\nfunction f(a: A) {\n switch (a) {\n case 'x': return 1;\n case 'y': return 2;\n }\n}"),
    ("timer-without-cleanup", "class A { go() { this.t = setInterval(f, 1); } }", "class A { go() { this.t = setInterval(f, 1); }\n end() { clearInterval(this.t); } }"),
    ("typescript-optional-property", "interface A { b?: B; }\nconst c = (a: A) => a.b.c;", "interface A { b?: B; }\nconst c = (a: A) => a.b && a.b.c;"),
]


@pytest.mark.parametrize("case", TYPED, ids=lambda c: c[0])
def test_typed_shapes(case):
    rule, bad, good = case
    assert [r for _, r, _ in syntax.typed_findings(bad, bad)] == [rule] and not list(syntax.typed_findings(good, good))

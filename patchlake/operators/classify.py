"""What a changed file is, which language, and whether and how it is reviewed: column expressions over its path and lines."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlake.functions.paths import file_name, slashes, strip, suffix

# Names, folders and suffixes by which files are told apart.
LOCK_NAMES = "package-lock.json yarn.lock pnpm-lock.yaml npm-shrinkwrap.json composer.lock cargo.lock poetry.lock pipfile.lock uv.lock gemfile.lock packages.lock.json".split()
OUTPUT_FOLDERS = "dist build target bin obj coverage node_modules vendor .angular .next .nuxt .gradle .idea".split()
ASSISTANT_FOLDERS = ".agents .cursor .codex .claude .gemini .opencode .vscode .nx".split()
E2E_FOLDERS = "e2e e2es cypress".split()
E2E_MARKS = ".e2e. -e2e. _e2e.".split()
OUTPUT_ENDS = ".min.js .min.css .bundle.js .bundle.css .map .generated.cs .g.cs .designer.cs".split()
ASSET_FOLDERS = "assets public static images icons".split()
BINARY = ".png .jpg .jpeg .gif .bmp .webp .ico .pdf .zip .gz .tar .7z .rar .jar .war .dll .exe .so .dylib .class .pyc .pdb .woff .woff2 .ttf .eot .mp3 .mp4 .wav .avi .mov".split()
DOCUMENTS = ".md .mdx .rst .adoc .txt".split()
STYLES = ".css .scss .sass .less .styl".split()
TEMPLATES = ".html .htm .hbs .handlebars .ejs .jinja .jinja2 .twig .mustache .razor .cshtml".split()
CONFIG = ".json .yaml .yml .toml .properties .xml".split()
CONFIG_NAMES = (
    "package.json angular.json tsconfig.json tsconfig.app.json tsconfig.spec.json jsconfig.json pyproject.toml requirements.txt pom.xml build.gradle build.gradle.kts go.mod cargo.toml composer.json gemfile"
    " dockerfile .python-version setup.py setup.cfg pipfile docker-compose.yml docker-compose.yaml makefile jenkinsfile procfile .env.example"
).split()
CONFIG_ENDS = ".csproj .fsproj .vbproj".split()
CONTEXT_NAMES = (
    "package.json nx.json angular.json project.json tsconfig.json tsconfig.base.json tsconfig.app.json tsconfig.spec.json dockerfile .python-version pyproject.toml requirements.txt setup.py setup.cfg pipfile global.json"
).split()
CONTEXT_ENDS = [".sln"]
CONTEXT_STARTS = "tsconfig. vite.config. vitest.config. eslint.config.".split()
TOOL_NAMES = ".editorconfig .gitignore .dockerignore .prettierignore .eslintignore .npmignore .gitattributes .prettierrc .eslintrc .stylelintrc opencode.json".split()
TOOL_STARTS = ".prettierrc. .eslintrc. .stylelintrc.".split()
TEST_FOLDERS = "test tests __tests__ spec specs".split()
TEST_MARKS = ".test. .spec. _test. _tests.".split()
SOURCE = (
    ".js .jsx .mjs .cjs .ts .tsx .java .kt .kts .scala .groovy .clj .cljs .cs .fs .fsx .vb .py .pyw .go .rs .c .h .cc .cpp .cxx .hpp .hxx .m .mm .swift .php .rb .dart .ex .exs .erl .hrl"
    " .sh .bash .zsh .fish .ps1 .bat .cmd .sql .graphql .gql .hs .lhs .ml .mli .lua .r .pl .pm .sol .zig .vue .svelte .astro"
).split()
LANGUAGES = {
    "javascript": ".js .jsx .mjs .cjs", "typescript": ".ts .tsx", "python": ".py", "java": ".java", "kotlin": ".kt .kts", "scala": ".scala", "csharp": ".cs", "fsharp": ".fs", "visual-basic": ".vb",
    "html": ".html .htm", "css": ".css", "scss": ".scss", "sass": ".sass", "less": ".less", "vue": ".vue", "svelte": ".svelte", "c": ".c .h", "cpp": ".cpp .cc .cxx .hpp", "rust": ".rs", "go": ".go",
    "swift": ".swift", "objective-c": ".m", "objective-cpp": ".mm", "dart": ".dart", "php": ".php", "ruby": ".rb", "shell": ".sh .bash", "powershell": ".ps1", "sql": ".sql", "json": ".json",
    "yaml": ".yaml .yml", "toml": ".toml", "xml": ".xml", "markdown": ".md",
}
BARRELS = "index.ts index.js test-setup.ts test-setup.js usings.cs".split()
#: Categories that are read by a model, with their strategy's name.
REVIEWED = "source_code test template stylesheet project_configuration unknown".split()


def parted(df: DataFrame, path: str = "path") -> DataFrame:
    """With _parts, _folders, _name and _end of the path, in lower case: computed once for all tests."""
    p = slashes(strip(path))
    parts = F.filter(F.split(F.lower(p), "/"), lambda x: (x != "") & (x != "."))
    step = df.withColumn("_parts", parts).withColumn("_name", F.lower(file_name(p))).withColumn("_end", suffix(p))
    return step.withColumn("_folders", F.slice("_parts", F.lit(1), F.greatest(F.size("_parts") - 1, F.lit(0))))


def category() -> Column:
    """The category of a parted file: the first that fits, in fixed order; null for a null path."""
    parts, folders, name, end = F.col("_parts"), F.col("_folders"), F.col("_name"), F.col("_end")
    within = lambda arr, values: F.arrays_overlap(arr, F.array(*map(F.lit, values)))
    of = lambda how, values: name.rlike({"start": "^(?:%s)", "end": "(?:%s)$", "in": "(?:%s)"}[how] % "|".join(v.replace(".", r"\.") for v in values))
    skills = F.concat(F.lit("/"), F.array_join(parts, "/")).contains("/.github/skills/")
    steps = [
        ("tool_configuration", within(parts, ASSISTANT_FOLDERS) | skills),
        ("end_to_end", F.exists(folders, lambda x: x.isin(E2E_FOLDERS) | x.endswith("-e2e")) | of("in", E2E_MARKS)),
        ("context_configuration", name.isin(CONTEXT_NAMES) | of("end", CONTEXT_ENDS) | of("start", CONTEXT_STARTS)),
        ("lock_file", name.isin(LOCK_NAMES)),
        ("binary", end.isin(BINARY)),
        ("static_asset", (end == ".svg") & within(folders, ASSET_FOLDERS)),
        ("generated", within(folders, OUTPUT_FOLDERS) | of("end", OUTPUT_ENDS)),
        ("tool_configuration", name.isin(TOOL_NAMES) | of("start", TOOL_STARTS)),
        ("project_configuration", name.isin(CONFIG_NAMES) | of("end", CONFIG_ENDS) | end.isin(CONFIG)),
        ("test", within(folders, TEST_FOLDERS) | of("in", TEST_MARKS)),
        ("source_code", end.isin(SOURCE)),
        ("template", end.isin(TEMPLATES)),
        ("stylesheet", end.isin(STYLES)),
        ("documentation", end.isin(DOCUMENTS)),
    ]
    out = F.lit("unknown")
    for value, test in reversed(steps):
        out = F.when(test, value).otherwise(out)
    return F.when(name.isNotNull(), out)


def categorized(df: DataFrame, path: str = "path") -> DataFrame:
    """With category; every column of df is kept."""
    return parted(df, path).withColumn("category", category()).drop("_parts", "_folders", "_name", "_end")


def reviewable(cat: Column) -> Column:
    return cat.isin(REVIEWED)


def language(path: Column) -> Column:
    """The language of the last suffix, "unknown" for others."""
    pairs = [(F.lit(e), F.lit(name)) for name, ends in LANGUAGES.items() for e in ends.split()]
    return F.coalesce(F.element_at(F.create_map(*chain(*pairs)), suffix(path)), F.lit("unknown"))


def barrel(path: Column, contents: Column) -> Column:
    """Whether a file only passes on imports and exports; contents are its added lines."""
    name = F.lower(file_name(slashes(path)))
    meaning = F.filter(F.transform(contents, strip), lambda x: (x != "") & ~x.rlike(r"^(//|/\*|\*|\*/)"))
    passing = F.forall(meaning, lambda x: x.rlike(r"^(import |export \*|export \{|export type \{|export type \*|global using |using )"))
    return name.endswith(".sln") | (name.isin(BARRELS) & passing)


def routed(df: DataFrame, path: str = "path", contents: str = "contents") -> DataFrame:
    """With route: what is done with a file, which is its category as strategy, or the reason why it is skipped."""
    cat = F.col("category")
    return categorized(df, path).withColumn(
        "route",
        F.when(F.coalesce(F.size(contents), F.lit(0)) <= 0, "skip: no lines")
        .when(barrel(F.col(path), F.col(contents)), "skip: barrel")
        .when(~reviewable(cat), F.concat(F.lit("skip: "), cat))
        .otherwise(cat),
    )


def meaningful(content: Column) -> Column:
    """Whether a line carries code: not blank, not a lone bracket, not a line comment."""
    bare = strip(content)
    return ~bare.isin("", "{", "}", "(", ")", "[", "]", "};", ");", "],", "},") & ~bare.startswith("//")

"""Projects of a repository: their roots, what belongs to them, build tools, languages and package managers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlake.functions.paths import project_path

#: Package managers in order of precedence, by the file that tells of each.
MANAGERS = [("pnpm", "pnpm-lock.yaml"), ("yarn", "yarn.lock"), ("npm", "package-lock.json"), ("bun", "bun.lock"), ("bun", "bun.lockb"), ("uv", "uv.lock"), ("poetry", "poetry.lock"), ("pip", "requirements.txt"), ("maven", "pom.xml"), ("gradle", "build.gradle"), ("gradle", "build.gradle.kts"), ("nuget", "packages.lock.json"), ("cargo", "cargo.lock"), ("composer", "composer.lock"), ("bundler", "gemfile.lock"), ("go", "go.mod")]
#: Names of files that show a build tool.
TOOLS = [("vite", r"^vite\.config\.(?:js|ts|mjs|cjs)$"), ("angular-cli", r"^angular\.json$"), ("webpack", r"^webpack\.config\.(?:js|ts|cjs|mjs)$"), ("rollup", r"^rollup\.config\.(?:js|ts|mjs)$"), ("maven", r"^pom\.xml$"), ("gradle", r"^build\.gradle(?:\.kts)?$"), ("dotnet", r"\.(?:csproj|fsproj|vbproj|sln)$"), ("poetry", r"^poetry\.lock$"), ("yarn", r"^yarn\.lock$"), ("npm", r"^package-lock\.json$"), ("pnpm", r"^pnpm-lock\.yaml$"), ("cargo", r"^cargo\.(?:toml|lock)$"), ("make", r"^makefile$"), ("docker", r"^dockerfile$")]


def path_prefixes(path: Column) -> Column:
    """Every folder above a path and the path itself, the longest last, "." first."""
    parts = F.split(path, "/")
    return F.concat(F.array(F.lit(".")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))


def owners(files: DataFrame, projects: DataFrame, keys: list[str]) -> DataFrame:
    """(file_id, root): the deepest project root above each file, "." where that is a project; null where there is none.

    Prefixes of the path meet the roots by equality, and each file keeps the longest: no join of all files with all roots.
    """
    f = files.select(*keys, "file_id", project_path("path").alias("path"))
    wide = f.select(*keys, "file_id", F.explode(path_prefixes(F.col("path"))).alias("root"))
    best = wide.join(projects.select(*keys, "root").distinct(), [*keys, "root"]).groupBy("file_id").agg(F.max_by("root", F.when(F.col("root") == ".", 0).otherwise(F.length("root"))).alias("root"))
    return f.select("file_id").join(best, "file_id", "left")


def build_tools(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., tools): for each build tool the paths that show it, in order."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    tools = F.array_compact(F.array(*(F.when(name.rlike(p), F.lit(t)) for t, p in TOOLS)))
    rows = files.select(*keys, "path", F.explode(tools).alias("tool")).distinct()
    lists = rows.groupBy(*keys, "tool").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return lists.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "paths")))).alias("tools"))


def package_manager(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., package_manager): the first of the managers whose file is there, else null."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    flags = files.groupBy(*keys).agg(*(F.max((name == f).cast("int")).alias(f"m{k}") for k, (_, f) in enumerate(MANAGERS)))
    out = F.lit(None).cast("string")
    for k in range(len(MANAGERS) - 1, -1, -1):
        out = F.when(F.col(f"m{k}") == 1, MANAGERS[k][0]).otherwise(out)
    return flags.select(*keys, out.alias("package_manager"))


def discovery_sample(files: DataFrame, keys: list[str], per_root: int = 3) -> DataFrame:
    """(keys..., root, file_id, place): the first source files of each root: entries, then components, others, indexes last."""
    from pyspark.sql import Window

    name = F.lower(F.element_at(F.split("path", "/"), -1))
    kind = F.when(name.rlike(r"^(main|app|server|program|startup|application)\."), 0).when(name.rlike(r"(component|controller|service|view)"), 1).when(name.rlike(r"^index\."), 3).otherwise(2)
    w = Window.partitionBy(*keys, "root").orderBy(kind, F.length("path"), "path", "file_id")
    return files.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_root).select(*keys, "root", "file_id", "place")

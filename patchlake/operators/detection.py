"""Frameworks, workspaces and project roots of repositories from paths and texts: one pass of flags, then an order of precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frameworks in order of precedence: name, files that must be there, then what a text or path shows.
FRAMEWORKS = [
    ("angular", None, "path", r"(?:^|/)angular\.json$"),
    ("nextjs", None, "path", r"next\.config\.(?:js|mjs|ts|cjs)$"),
    ("nuxt", None, "path", r"nuxt\.config\.(?:js|ts|mjs|cjs)$"),
    ("react-native", None, "path", r"(?:^|/)metro\.config\.(?:js|cjs|mjs)$"),
    ("spring-boot", r"\.(?:java|kt|kts|groovy|scala)$|pom\.xml$|build\.gradle(?:\.kts)?$", "text", r"org\.springframework\.boot|@springbootapplication|spring-boot-starter|springframework\.boot"),
    ("spring", r"\.(?:java|kt|kts|groovy|scala)$", "text", r"springframework\.|@restcontroller|@controller|@service|@repository|@autowired|@component"),
    ("aspnet-core", r"\.(?:cs|csproj)$", "text", r"microsoft\.aspnetcore|webapplication\.createbuilder|addcontrollers\(|mapcontrollers\(|controllerbase|\[apicontroller\]"),
    ("django", r"\.py$|requirements\.txt$|pyproject\.toml$", "text", r"from django|import django|django\.|django==|django>="),
    ("fastapi", r"\.py$|requirements\.txt$|pyproject\.toml$", "text", r"from fastapi|import fastapi|fastapi\(|fastapi==|fastapi>="),
    ("flask", r"\.py$|requirements\.txt$|pyproject\.toml$", "text", r"from flask|import flask|flask\(|flask==|flask>="),
    ("laravel", r"\.php$", "text", r"illuminate\\\\|laravel/framework"),
    ("rails", r"\.rb$|gemfile$", "text", r"rails\.application|activerecord::base|gem ['\"]rails['\"]"),
    ("nestjs", r"\.[jt]sx?$|package\.json$", "text", r"@nestjs/"),
    ("express", r"\.[cm]?[jt]sx?$|package\.json$", "text", r"require\(['\"]express['\"]\)|from ['\"]express['\"]|express\(\)|\"express\"\s*:|\brouter\.(?:get|post|put|delete)\("),
    ("vue", r"\.vue$|\.[jt]sx?$|package\.json$", "text", r"from ['\"]vue['\"]|\"vue\"\s*:"),
    ("react", r"\.[jt]sx?$|package\.json$", "text", r"from ['\"]react['\"]|\"react\"\s*:|\busestate\(|\buseeffect\("),
    ("nodejs", r"\.[cm]?js$|package\.json$", "text", r"require\(['\"]|module\.exports|process\.env"),
]


def frameworks(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., framework): the first framework that the paths and texts of a group show, "unknown" for none."""
    path, text = F.lower("path"), F.lower("patch")
    aggregates = []
    for k, (_, needs, where, pattern) in enumerate(FRAMEWORKS):
        aggregates.append(F.max(F.coalesce((path if where == "path" else text).rlike(pattern), F.lit(False)).cast("int")).alias(f"s{k}"))
        aggregates.append(F.max(F.coalesce(path.rlike(needs), F.lit(False)).cast("int") if needs else F.lit(1)).alias(f"n{k}"))
    out = F.lit("unknown")
    for k in range(len(FRAMEWORKS) - 1, -1, -1):
        out = F.when((F.col(f"s{k}") == 1) & (F.col(f"n{k}") == 1), FRAMEWORKS[k][0]).otherwise(out)
    return files.groupBy(*keys).agg(*aggregates).select(*keys, out.alias("framework"))


def workspace(files: DataFrame, keys: list[str], nested: bool = False) -> DataFrame:
    """(keys..., workspace): nx where nx.json stands at the root (or anywhere, if nested), else standalone."""
    hit = F.lower("path").rlike(r"(?:^|/)nx\.json$" if nested else r"^nx\.json$")
    return files.groupBy(*keys).agg(F.when(F.max(hit.cast("int")) == 1, "nx").otherwise("standalone").alias("workspace"))


def project_roots(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., root, explicit): folders with a project.json, or with a package.json below apps, libs, packages or services;
    then conventional folders that neither hold nor lie in one of those; "." where there is none at all."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    low = F.lower("path")
    stated = low.rlike(r"/project\.json$") | low.rlike(r"^(?:apps|libs|packages|services)/.*/?package\.json$")
    explicit = files.where(stated).select(*keys, folder.alias("root")).where("root <> ''").distinct()
    guess = files.select(*keys, F.regexp_extract("path", r"^((?:apps|libs|packages|services)/[^/]+)/", 1).alias("root")).where("root <> ''").distinct()
    e = explicit.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("root").alias("_root"))
    same = F.expr(" and ".join(f"{k} <=> _{k}" for k in keys))
    over = (F.col("root") == F.col("_root")) | F.col("root").startswith(F.concat("_root", F.lit("/"))) | F.col("_root").startswith(F.concat("root", F.lit("/")))
    free = guess.join(e, same & over, "left_anti")
    roots = explicit.withColumn("explicit", F.lit(True)).union(free.withColumn("explicit", F.lit(False)))
    bare = files.select(*keys).distinct().join(roots.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit(".").alias("root"), F.lit(False).alias("explicit"))
    return roots.union(bare)


def resolved_framework(names: Column) -> Column:
    """One framework for the set of those of the parts: the only one; python family mixed is "python-mixed"; else "mixed"."""
    known = F.array_sort(F.array_distinct(F.filter(names, lambda x: x != "unknown")))
    python = F.array(*map(F.lit, ("django", "fastapi", "flask")))
    return F.when(F.size(known) == 0, "unknown").when(F.size(known) == 1, known[0]).when(F.size(F.array_except(known, python)) == 0, "python-mixed").when(F.size(F.array_except(known, F.array(F.lit("spring"), F.lit("spring-boot")))) == 0, "spring-boot").otherwise("mixed")

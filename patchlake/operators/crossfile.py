"""What one file says of another: references that exist, templates of components, elements of pages, modules of tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlake.operators.projects import path_prefixes

#: What may be left out at the end of a reference to a script.
ENDINGS = ("", ".js", ".jsx", ".mjs", ".ts", ".tsx", ".json", ".vue", "/index.js", "/index.ts", "/index.tsx")
REFERENCE = r"(?:\bfrom\s*|\brequire\(\s*|\bimport\(?\s*)[\"'](\.{1,2}/[^\"'\n]+)[\"']"
SELECTOR = r"\bselector\s*:\s*[\"']([\w-]+)[\"']"
TEMPLATE = r"\btemplateUrl\s*:\s*[\"']([^\"'\n]+)[\"']"
ELEMENT = r"\bgetElementById\s*\(\s*[\"']([\w-]+)[\"']"


def resolved(path: Column, reference: Column) -> Column:
    """The path that a relative reference means in a file; what leads above the root stays at the root."""
    folder = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    parts = F.filter(F.concat(folder, F.split(reference, "/")), lambda x: ~x.isin("", "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda s, x: F.when(x == "..", F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(x))))
    return F.array_join(up, "/")


def references(files: DataFrame, keys: list[str], pattern: str = REFERENCE, endings: tuple[str, ...] = ENDINGS) -> DataFrame:
    """(keys..., path, target, exists): each path that a file refers to, and whether a file of the same keys stands there."""
    own = files.where(F.col("text").rlike(pattern)).select(*keys, "path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))).alias("reference"))
    own = own.select(*keys, "path", resolved(F.col("path"), F.col("reference")).alias("target")).distinct()
    tried = own.withColumn("candidate", F.explode(F.array(*(F.concat("target", F.lit(e)) for e in endings))))
    known = files.select(*keys, F.col("path").alias("candidate")).distinct().withColumn("there", F.lit(True))
    return tried.join(known, [*keys, "candidate"], "left").groupBy(*keys, "path", "target").agg(F.coalesce(F.bool_or("there"), F.lit(False)).alias("exists"))


def templates(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., path, target, exists): components with the template that they name."""
    return references(files.where(F.lower("path").rlike(r"\.ts$") | F.lower("path").rlike(r"\.html?$")), keys, TEMPLATE, ("",))


def names_in(files: DataFrame, keys: list[str], pattern: str) -> DataFrame:
    """(keys..., path, name): each name that a pattern's first group finds in a text."""
    return files.where(F.col("text").rlike(pattern)).select(*keys, "path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))).alias("name"))


def elements(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., path, name, exists): elements that scripts ask for by id, and whether a page has them. Ids meet by equality."""
    pages = F.lower("path").rlike(r"\.html?$")
    asked = names_in(files.where(~pages), keys, ELEMENT)
    has = names_in(files.where(pages), keys, r"\bid\s*=\s*[\"']([\w-]+)[\"']").select(*keys, "name").distinct().withColumn("there", F.lit(True))
    return asked.join(has, [*keys, "name"], "left").select(*keys, "path", "name", F.coalesce("there", F.lit(False)).alias("exists"))


def selectors(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., name, component, pages): components by their selector, with the number of pages that use it."""
    declared = names_in(files.where(F.lower("path").rlike(r"\.ts$")), keys, SELECTOR).select(*keys, "name", F.col("path").alias("component"))
    used = names_in(files.where(F.lower("path").rlike(r"\.html?$")), keys, r"<([a-z][a-z0-9]*-[\w-]+)")
    n = used.groupBy(*keys, "name").agg(F.countDistinct("path").alias("pages"))
    return declared.join(n, [*keys, "name"], "left").select(*keys, "name", "component", F.coalesce("pages", F.lit(0)).alias("pages"))


def tested_modules(files: DataFrame, frameworks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., path, framework): the framework of the one module that a test file imports; none where it imports several.

    Modules are folders below the root that have a framework; an import is a reference into such a folder, met by equality.
    """
    tests = files.where(F.lower("path").rlike(r"(?:\.(?:spec|test)\.[jt]sx?$|(?:^|/)tests?/|(?:^|/)test_[^/]*\.py$)"))
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?:\bfrom|\bimport|\brequire\()\s*[\"']?(?:\.{0,2}/)*([A-Za-z_][\w-]*)"), F.lit(1)))
    asked = tests.where("text is not null").select(*keys, "path", F.explode(words).alias("module"))
    met = asked.join(frameworks.select(*keys, "module", "framework").where("framework <> 'unknown'"), [*keys, "module"])
    return met.groupBy(*keys, "path").agg(F.countDistinct("framework").alias("n"), F.min("framework").alias("framework")).where("n = 1").drop("n")


def project_contexts(files: DataFrame, roots: DataFrame, keys: list[str], language: Column, framework: Column) -> DataFrame:
    """(keys..., root, files, languages, framework): what the files under each root show together; files meet their longest root."""
    told = files.withColumn("language", language).withColumn("framework", framework).select(*keys, "path", "language", "framework").distinct()
    wide = told.withColumn("root", F.explode(path_prefixes(F.col("path"))))
    deepest = F.max_by("root", F.when(F.col("root") == ".", 0).otherwise(F.length("root")))
    own = wide.join(roots.select(*keys, "root").distinct(), [*keys, "root"]).groupBy(*keys, "path", "language", "framework").agg(deepest.alias("root"))
    known = lambda c: F.sort_array(F.collect_set(F.when(F.col(c) != "unknown", F.col(c))))
    g = own.groupBy(*keys, "root").agg(F.count("*").alias("files"), known("language").alias("languages"), known("framework").alias("frameworks"))
    e2e = F.lower("root").rlike(r"(?:^|[/_-])e2e(?:$|[/_-])")
    return g.select(*keys, "root", "files", "languages", F.when(F.size("frameworks") == 1, F.col("frameworks")[0]).when(F.size("frameworks") > 1, "mixed").when(e2e, "e2e").otherwise("unknown").alias("framework"))

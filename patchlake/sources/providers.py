"""Sources of change-sets by name, and what their listings give, as rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlake.operators.responses import flag_words, status


@dataclass(frozen=True)
class Source:
    """What a source gives, each as a function of the session and a place; what it can't give raises when it is asked for."""

    name: str
    change_sets: Callable[[SparkSession, str], DataFrame]
    changed_files: Callable[[SparkSession, str], DataFrame]
    tree: Callable[[SparkSession, str], DataFrame] | None = None
    comments: Callable[[SparkSession, str], DataFrame] | None = None

    def ask(self, what: str, spark: SparkSession, place: str) -> DataFrame:
        give = getattr(self, what)
        if give is None:
            raise NotImplementedError(f"{self.name} has no {what}")
        return give(spark, place)


_sources: dict[str, Source] = {}


def register(source: Source, *aliases: str) -> None:
    for name in (source.name, *aliases):
        _sources[name.strip().lower()] = source


def source(name: str) -> Source:
    """The source of a name or alias, in any case; an unknown one raises and tells the known ones."""
    key = name.strip().lower()
    if key not in _sources:
        raise ValueError(f"no source {name!r}; there are {sorted(_sources)}")
    return _sources[key]


def _tables() -> None:
    from patchlake.sources import review_tables as t

    register(Source("tables", t.change_sets, t.files), "files", "parquet")


_tables()


def tree_files(entries: DataFrame) -> DataFrame:
    """Of the entries of a tree: the files that have a path."""
    return entries.where("kind = 'blob' and trim(path) <> ''")


def change_entries(entries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., path, original_path, status, tracking_id): the changes of files among change entries.

    Folders and trees are no files; entries without path or kind of change are left out; the origin is the stated one, for a
    renamed file also its source on the server, else the path itself; tracking_id is the first positive of two numbers, and null
    where the source gave none, which is a fault of the source.
    """
    path = F.regexp_replace(F.trim("path"), "^/+", "")
    kinds = flag_words(F.col("change"))
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    own = entries.where(~F.coalesce("is_folder", F.lit(False)) & (F.lower(F.coalesce("object_kind", F.lit(""))) != "tree"))
    own = own.select(*keys, path.alias("path"), kinds.alias("kinds"), "original", "source_item", "tracking_id", "change_id").where("path <> '' and size(kinds) > 0").withColumn("status", status(F.col("kinds")))
    origin = F.coalesce(F.nullif(F.col("original"), F.lit("")), F.when(F.col("status") == "renamed", F.nullif(F.col("source_item"), F.lit(""))), F.col("path"))
    plain = F.regexp_replace(F.trim(origin), "^/+", "")
    return own.select(*keys, "path", F.coalesce(F.nullif(plain, F.lit("")), F.col("path")).alias("original_path"), "status", F.coalesce(positive("tracking_id"), positive("change_id")).alias("tracking_id"))


def prefetch(wanted: DataFrame, contents: DataFrame, parts: int) -> DataFrame:
    """(path, ref, text) of what is wanted, each path at a ref fetched once, by at most parts tasks."""
    once = wanted.select("path", "ref").where("path is not null and ref is not null").dropDuplicates(["path", "ref"])
    return once.repartition(parts, "path", "ref").join(contents, ["path", "ref"], "left")


def listing(change_sets: DataFrame, owner: Column) -> DataFrame:
    """(provider, owner, repository, change_sets): what a provider lists."""
    return change_sets.groupBy("provider", owner.alias("owner"), "repository").agg(F.count("*").alias("change_sets"))


def with_tree(changed: DataFrame, tree: DataFrame, keys: list[str]) -> DataFrame:
    """Changed files, and those of the tree whose path is not among them; changed is told in a column."""
    rest = tree.join(changed.select(*keys).distinct(), keys, "left_anti")
    return changed.withColumn("changed", F.lit(True)).unionByName(rest.withColumn("changed", F.lit(False)), allowMissingColumns=True)

"""Patches as rows: added lines, hunks and counts, without a shuffle.

Lines of a batch of patches are walked as arrays: kinds of lines, the last header before each, and running counts since it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from patchlake.functions.paths import split_lines
from patchlake.runtime import ship_package

HEADER = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@"
#: Any character that isn't white space.
NOT_BLANK = r"[^\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The same for all four numbers, by name.
HUNK = r"^@@ -(?P<a>\d+)(?:,(?P<b>\d+))? \+(?P<c>\d+)(?:,(?P<d>\d+))? @@"


def _kind(line: Column) -> Column:
    """@ header, p the +++ of a file, + added, - deleted, n the note of a missing line end, . else."""
    return (
        F.when(line.rlike(HEADER), "@")
        .when(line.startswith("+++"), "p")
        .when(line.startswith("+"), "+")
        .when(line.startswith("-"), "-")
        .when(line.startswith("\\"), "n")
        .otherwise(".")
    )


def lined(files: DataFrame) -> DataFrame:
    """With lines, kinds (one character a line) and starts (the new start of each hunk); null patches have no line."""
    lines = F.coalesce(split_lines("patch"), F.array().cast("array<string>"))
    return (
        files.withColumn("lines", lines)
        .withColumn("kinds", F.array_join(F.transform("lines", _kind), ""))
        .withColumn("starts", F.transform(F.filter("lines", lambda x: x.rlike(HEADER)), lambda x: F.regexp_extract(x, HEADER, 1).cast("int")))
    )


def _count(s: Column, signs: str) -> Column:
    """How often any of the signs stands in s."""
    return F.length(s) - F.length(F.translate(s, signs, ""))


class Walk:
    """The lines of a batch of patches as arrays: each line's patch, kind, last header and how far that hunk has moved."""

    def __init__(self, lists: pa.Array, still: str):
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.lines = lists.flatten()
        n = len(self.lines)
        self.owner = np.repeat(np.arange(len(counts)), counts)
        first = pc.fill_null(pc.utf8_slice_codeunits(self.lines, 0, 1), "").to_numpy(zero_copy_only=False)
        self.kind = np.full(n, ".", "U1")
        for sign in "+-":
            self.kind[first == sign] = sign
        self.kind[first == "\\"] = "n"
        marked = np.flatnonzero((first == "@") | (first == "+"))
        some = self.lines.take(pa.array(marked))
        parts = pc.extract_regex(some, HUNK)
        at = np.flatnonzero(pc.is_valid(parts).to_numpy(zero_copy_only=False))
        self.headers = marked[at]
        self.kind[self.headers] = "@"
        self.kind[marked[pc.starts_with(some, "+++").to_numpy(zero_copy_only=False)]] = "p"
        numbers = parts.take(pa.array(at))
        text = [pc.struct_field(numbers, [k]) for k in range(4)]
        whole = [pc.cast(pc.if_else(pc.or_(pc.equal(t, ""), pc.greater(pc.utf8_length(t), 9)), None, t), pa.int64()) for t in text]
        self.old, self.olds, self.new, self.news = (
            pc.if_else(pc.equal(t, ""), 1, v) if k % 2 else v for k, (t, v) in enumerate(zip(text, whole))
        )
        place = np.arange(n)
        begin = np.repeat(np.cumsum(counts) - counts, counts)
        header = np.full(n, -1, np.int64)
        header[self.headers] = self.headers
        self.header = np.maximum.accumulate(header) if n else header
        self.header[self.header < begin] = -1  # a header of an earlier patch
        moving = ~np.isin(self.kind, list(still + "@"))
        before = np.concatenate([[0], np.cumsum(moving)])
        known = self.header >= 0
        self.moved = before[place] - before[np.where(known, self.header, begin)]
        starts = np.zeros(n, np.int64)
        starts[self.headers] = pc.fill_null(self.new, 0).to_numpy(zero_copy_only=False)
        self.number = np.where(known, starts[self.header], 0) + self.moved
        other = np.concatenate([[0], np.cumsum(self.kind != "@")])
        self.position = other[place + 1] - other[begin] if n else place


def _schema(files: DataFrame, keep: list[str], more: str) -> StructType:
    return StructType([*(files.schema[k] for k in keep), *_parse_datatype_string(more).fields])


def added_lines(files: DataFrame, keep: list[str], still: str = "-p", blanks: bool = False) -> DataFrame:
    """(keep..., line_number, content, diff_position): the added lines of each patch.

    still: kinds of lines that don't move the number of the next line; the note of a missing line end moves it here unless
    "n" is among them. Blank added lines are left out, though they count. Lines before the first header count from 0. One pass
    over whole batches of lines, in proportion to their number however long a patch is.
    """
    ship_package(files.sparkSession)
    names = [*keep, "line_number", "content", "diff_position"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            w = Walk(rb.column(len(keep)), still)
            at = np.flatnonzero(w.kind == "+")
            owner = pa.array(w.owner[at])
            content = pc.utf8_slice_codeunits(w.lines.take(pa.array(at)), 1)
            columns = [rb.column(k).take(owner) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(w.number[at], pa.int32()), content, pa.array(w.position[at], pa.int32())], names)

    lines = files.where("patch is not null").select(*keep, split_lines("patch").alias("lines"))
    out = lines.mapInArrow(run, _schema(files, keep, "line_number int, content string, diff_position int"))
    return out if blanks else out.where(F.col("content").rlike(NOT_BLANK))


def hunks(files: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., hunk, old_start, old_count, new_start, new_count, added): each hunk with the numbers of its added lines."""
    ship_package(files.sparkSession)
    names = [*keep, "hunk", "old_start", "old_count", "new_start", "new_count", "added"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            w = Walk(rb.column(len(keep)), "-pn")
            at = np.flatnonzero((w.kind == "+") & (w.header >= 0))
            owner = w.owner[w.headers]
            begin = np.searchsorted(owner, owner)
            edges = np.append(np.searchsorted(w.header[at], w.headers), len(at)).astype(np.int32)
            added = pa.ListArray.from_arrays(pa.array(edges), pa.array(w.number[at], pa.int32()))
            numbers = [x.cast(pa.int32()) for x in (w.old, w.olds, w.new, w.news)]
            columns = [rb.column(k).take(pa.array(owner)) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(len(owner)) - begin + 1, pa.int32()), *numbers, added], names)

    lines = files.where("patch is not null").select(*keep, split_lines("patch").alias("lines"))
    return lines.mapInArrow(run, _schema(files, keep, "hunk int, old_start int, old_count int, new_start int, new_count int, added array<int>"))


def run_counts(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., additions, deletions): by change-set, null where a file has no patch; file headers don't count."""
    lines = lined(files)
    minus = F.size(F.filter("lines", lambda x: x.startswith("-") & ~x.startswith("---")))
    whole = F.bool_and(F.col("patch").isNotNull())
    plus = _count(F.col("kinds"), "+")
    return lines.groupBy(*keys).agg(F.when(whole, F.sum(plus)).cast("long").alias("additions"), F.when(whole, F.sum(minus)).cast("long").alias("deletions"))


def api_counts(files: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., additions, deletions): by file, signs after the first header alone, file headers inside hunks included."""
    body = F.filter(F.col("lines"), lambda x, i: i > F.length(F.substring_index("kinds", "@", 1)))
    inside = F.when(F.instr("kinds", "@") > 0, body).otherwise(F.array().cast("array<string>"))
    signs = F.filter(inside, lambda x: ~x.startswith("@@"))
    return lined(files).select(
        *keep,
        F.size(F.filter(signs, lambda x: x.startswith("+"))).alias("additions"),
        F.size(F.filter(signs, lambda x: x.startswith("-"))).alias("deletions"),
    )

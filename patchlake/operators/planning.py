"""Plans of a review: parts of changed lines, batches of files, and windows of context around lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from patchlake.functions.paths import line_tokens
from patchlake.runtime import by_group, ship_package

#: Tokens and lines of a call and parts of a file; files and tokens of a batch; lines of a chunk; lines of context.
CALL_TOKENS, CALL_LINES, FILE_PARTS = 6000, 500, 2
BATCH_FILES, BATCH_TOKENS = 5, 2200
CHUNK_LINES, CONTEXT_LINES = 30, 20
GAP = "... omitted unrelated lines ..."


def chunks(lines: DataFrame, keys: list[str], size: int = CHUNK_LINES) -> DataFrame:
    """Lines with chunk_index and total: size lines a chunk, in order of position."""
    w = Window.partitionBy(*keys)
    n = F.row_number().over(w.orderBy("diff_position")) - 1
    return lines.withColumn("chunk_index", (F.floor(n / size) + 1).cast("int")).withColumn("total", F.ceil(F.count("*").over(w) / size).cast("int"))


def cut(sizes: list[int], tokens: int, most: int, few: int) -> list[tuple[int, int]]:
    """(lines, tokens) of the parts of one file: see parts."""
    out, n, t = [], 0, 0
    for x in sizes:
        if n and (t + x > tokens or n >= most):
            out.append((n, t))
            n, t = 0, 0
        n, t = n + 1, t + x
    if n:
        out.append((n, t))
    if len(out) <= few:
        return out
    even = -(-len(sizes) // few)
    return [(len(p), sum(p)) for p in (sizes[k : k + even] for k in range(0, len(sizes), even))]


def parts(files: DataFrame, keys: list[str], lines: str = "lines", tokens: int = CALL_TOKENS, most: int = CALL_LINES, few: int = FILE_PARTS) -> DataFrame:
    """(keys..., part, total, first, n, tokens): consecutive lines of a file under the budgets of a call.

    A part ends where the next line would exceed the tokens or lines; where more than few parts came of it, the lines are
    dealt evenly into few. One walk over the sizes of a row's lines, without a shuffle; their texts stay in the JVM.
    """
    ship_package(files.sparkSession)
    names = [*keys, "part", "total", "first", "n", "tokens"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            owner, out = [], []
            for k, sizes in enumerate(rb.column(len(keys)).to_pylist()):
                made, first = cut(sizes, tokens, most, few), 1
                for p, (n, t) in enumerate(made):
                    owner.append(k)
                    out.append((p + 1, len(made), first, n, t))
                    first += n
            held = [rb.column(k).take(pa.array(owner, pa.int64())) for k in range(len(keys))]
            numbers = [pa.array(c, pa.int32()) for c in zip(*out)] if out else [pa.array([], pa.int32())] * 5
            yield pa.RecordBatch.from_arrays([*held, *numbers], names)

    some = files.where(F.size(lines) > 0).select(*keys, F.transform(lines, line_tokens).alias("sizes"))
    schema = StructType([*(files.schema[k] for k in keys), *_parse_datatype_string("part int, total int, first int, n int, tokens int").fields])
    return some.mapInArrow(run, schema)


def file_batches(files: DataFrame, keys: list[str], most: int = BATCH_FILES, tokens: int = BATCH_TOKENS) -> DataFrame:
    """(keys..., seq, batch): files of a change-set in order, each kind apart, a new batch where files or tokens are exceeded.

    The kind is what may stand together in one prompt: the framework of the files' project. Batches are numbered by their first file.
    """
    def run(rows: list[tuple]) -> list[tuple]:
        batch, count, load = 0, 0, 0
        out = []
        for row in rows:
            t = row[-1]
            if count and (count >= most or load + t > tokens):
                batch, count, load = batch + 1, 0, 0
            out.append((*row[:-1], batch))
            count, load = count + 1, load + t
        return out

    kinds = dict(files.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, "kind", "seq"]) + ", local int"
    made = by_group(files.select(*keys, "kind", "seq", "tokens"), [*keys, "kind"], ["seq"], run, schema)
    first = F.min("seq").over(Window.partitionBy(*keys, "kind", "local"))
    return made.withColumn("first", first).withColumn("batch", F.dense_rank().over(Window.partitionBy(*keys).orderBy("first", "kind"))).select(*keys, "seq", "batch")


def context(lines: DataFrame, changed: DataFrame, keys: list[str], around: int = CONTEXT_LINES) -> DataFrame:
    """(keys..., content): numbered lines within around lines of a change, a mark between parts that don't touch."""
    near = changed.select(*keys, F.explode(F.sequence(F.greatest(F.lit(1), F.col("line_number") - around), F.col("line_number") + around)).alias("line_number")).distinct()
    w = Window.partitionBy(*keys).orderBy("line_number")
    kept = lines.join(near, [*keys, "line_number"]).withColumn("before", F.lag("line_number").over(w))
    text = F.concat(F.when(F.col("line_number") > F.col("before") + 1, F.lit(GAP + "\n")).otherwise(""), F.col("line_number").cast("string"), F.lit(" | "), F.col("content"))
    return kept.select(*keys, "line_number", text.alias("t")).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "t"))), lambda x: x["t"]), "\n").alias("content"))


def neighbours(lines: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Lines with around: the contents of at most k lines before and after in order, joined by line feeds."""
    w = Window.partitionBy(*keys).orderBy("line_number").rowsBetween(-k, k)
    return lines.withColumn("around", F.array_join(F.collect_list("content").over(w), "\n"))


def enclosing(lines: DataFrame, keys: list[str], pattern: str) -> DataFrame:
    """Lines with name: what the pattern's first group found at the nearest line at or above."""
    w = Window.partitionBy(*keys).orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    got = F.regexp_extract("content", pattern, 1)
    return lines.withColumn("name", F.last(F.when(got != "", got), ignorenulls=True).over(w))

"""Filling batches of fixed capacity with the contexts of each change-set.

Method: hierarchical multi-length packing. A context above the capacity is divided into full parts and a rest; all others stay
whole. Sizes fall into tiers (above 1/2, 1/3, 1/4, 1/8 of the capacity, and the rest); from the longest, each tier is packed by
itself, best-fit decreasing, and the gaps of its batches are then filled with the best sums that shorter tiers offer. Where
that takes more batches than the lower bound, two other packings are tried and the least is taken: every batch begun with the
longest context left and filled with the best sum of all others, and best-fit decreasing over all. Up to EXACT contexts that fit
a gap the best sum is exact, beyond that it is the best of EXACT of them. Batches are put into step groups of even load.

A change-set of any size is cut into blocks of at most BLOCK contexts, packed apart; of each block only the one batch less
than half full is packed again with those of the other blocks, so that no task holds more than BLOCK contexts or one batch
a block.

Defined results: a null estimate stands for content_chars / 4 rounded up, nulls in both and negatives for 0; a context of 0
tokens goes into the first batch; rows without context_id are left out; a context_id delivered again counts once; null parts
of the change-set key are a value of their own; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchlake.runtime import broadcast_if_small, by_group, materialize

BLOCK = 20_000
#: So many contexts are tried for the best sum in the gap of a batch.
EXACT = 400
STEP = 8
TIERS = (2, 3, 4, 8)
KEY = ["provider", "repository", "number"]


def tier(size: int, capacity: int) -> int:
    """0 for the longest contexts, one more for each shorter tier."""
    return next((k for k, share in enumerate(TIERS) if size * share > capacity), len(TIERS))


def best_fit(order: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    """Batches of indexes: each in its turn into the fullest batch with room."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (room left, batch), sorted
    for i in order:
        k = bisect_left(room, (sizes[i], -1))
        if k < len(room):
            left, b = room.pop(k)
        else:
            left, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        insort(room, (left - sizes[i], b))
    return bins


def fill(gap: int, left: list[tuple[int, int]]) -> list[int]:
    """Takes out of left, sorted pairs of size and index, those of the best sum within the gap, and returns their indexes.

    Where more than EXACT fit, half as many of the longest and as many at even steps among the others are tried.
    """
    fit = bisect_left(left, (gap + 1, -1))
    if fit > EXACT:
        half = EXACT // 2
        tried = [*range(fit - 1, fit - 1 - half, -1), *((fit - half) * k // half for k in range(half - 1, -1, -1))]
    else:
        tried = list(range(fit - 1, -1, -1))
    sums, steps, mask = 1, [], (1 << (gap + 1)) - 1
    for k in tried:
        steps.append(sums)
        sums |= (sums << left[k][0]) & mask
        if sums >> gap & 1:
            break
    best, chosen = sums.bit_length() - 1, []
    for n in range(len(steps) - 1, -1, -1):
        if not steps[n] >> best & 1:
            chosen.append(tried[n])
            best -= left[tried[n]][0]
    return [left.pop(k)[1] for k in sorted(chosen, reverse=True)]


def pack_tiers(sizes: list[int], capacity: int) -> list[list[int]]:
    """Batches of indexes: from the longest tier, each packed by itself, the gaps of its batches then filled from shorter tiers."""
    left = sorted((s, i) for i, s in enumerate(sizes))
    bins = []
    for k in range(len(TIERS) + 1):
        begin = bisect_left(left, True, key=lambda x: tier(x[0], capacity) <= k)
        own, left = left[begin:], left[:begin]
        for b in sorted(best_fit([i for _, i in reversed(own)], sizes, capacity), key=lambda b: -sum(sizes[i] for i in b)):
            bins.append([*b, *fill(capacity - sum(sizes[i] for i in b), left)])
    return bins


def pack_gaps(sizes: list[int], capacity: int) -> list[list[int]]:
    """Batches of indexes, each begun with the longest context left and filled with the best sum of shorter ones."""
    left = sorted((s, i) for i, s in enumerate(sizes))
    bins = []
    while left:
        size, first = left.pop()
        bins.append([first, *fill(capacity - size, left)])
    return bins


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """The packing by tiers, or another that is tried where it needs more batches than the bound and that has fewer; sizes of 0
    go into the first batch."""
    some = [i for i, s in enumerate(sizes) if s > 0]
    own = [sizes[i] for i in some]
    least = max(-(-sum(own) // capacity), sum(2 * s > capacity for s in own))
    bins = pack_tiers(own, capacity)
    if len(bins) > least:
        bins = min(bins, pack_gaps(own, capacity), key=len)
    if len(bins) > least:
        bins = min(bins, best_fit(sorted(range(len(own)), key=lambda i: (-own[i], i)), own, capacity), key=len)
    out = [[some[i] for i in b] for b in bins]
    nothing = [i for i, s in enumerate(sizes) if s <= 0]
    if nothing:
        out = [[*out[0], *nothing], *out[1:]] if out else [nothing]
    return out


def parts(contexts: DataFrame, capacity: int) -> DataFrame:
    """One row for each part of each context: context_id, key, file_path, part, parts, tokens."""
    size = F.coalesce(F.col("estimated_tokens").cast("long"), F.ceil(F.col("content_chars") / 4).cast("long"), F.lit(0))
    return (
        contexts.where("context_id is not null")
        .select("context_id", F.lower("provider").alias("provider"), "repository", "number", F.regexp_replace("file_path", r"\\", "/").alias("file_path"), F.greatest(size, F.lit(0)).alias("size"))
        .dropDuplicates(["context_id"])
        .withColumn("parts", F.greatest(F.ceil(F.col("size") / capacity), F.lit(1)).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("tokens", F.least(F.lit(capacity), F.col("size") - F.col("part") * capacity).cast("int"))
    )


def pack_contexts(contexts: DataFrame, capacity: int) -> DataFrame:
    """One row for each part with its batch: KEY, batch, context_id, file_path, part, parts, tokens. Full parts are batches alone."""
    every = parts(contexts, capacity)
    alone = every.where(F.col("tokens") >= capacity)
    rest = every.where(F.col("tokens") < capacity)
    blocks = rest.groupBy(*KEY).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    many = blocks.where("blocks > 1")  # at most all rows / BLOCK change-sets
    b = many.select(*(F.col(k).alias(f"b_{k}") for k in KEY), "blocks")
    salted = (
        rest.join(b, F.expr(" and ".join(f"{k} <=> b_{k}" for k in KEY)), "left")
        .withColumn("block", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("context_id"), F.col("blocks"))).cast("int"))
        .select(*KEY, "block", "context_id", "file_path", "part", "parts", "tokens")
    )
    schema = "provider string, repository string, number int, block int, context_id long, file_path string, part int, parts int, tokens int, bin int, load int, weak boolean"

    def first(rows: list[tuple]) -> list[tuple]:
        sizes = [x[-1] for x in rows]
        out: list = [None] * len(rows)
        for k, batch in enumerate(pack(sizes, capacity)):
            load = sum(sizes[i] for i in batch)
            for i in batch:
                out[i] = (*rows[i], k, load, 2 * load < capacity)
        return out

    packed = by_group(salted, [*KEY, "block"], ["context_id", "part"], first, schema)
    cut = packed.join(b, F.expr(" and ".join(f"{k} <=> b_{k}" for k in KEY)), "left").withColumn("again", F.col("weak") & F.col("blocks").isNotNull())
    weak = cut.where("again").select(*KEY, F.lit(-1).alias("block"), "context_id", "file_path", "part", "parts", "tokens")
    again = by_group(weak, [*KEY, "block"], ["context_id", "part"], first, schema)
    kept = cut.where("not again").select(again.columns)
    cols = [*KEY, "context_id", "file_path", "part", "parts", "tokens"]
    name = lambda prefix, *x: F.concat_ws("/", F.lit(prefix), *x).alias("batch")
    return (
        alone.select(*cols, name("a", "context_id", "part"))
        .union(kept.select(*cols, name("b", "block", "bin")))
        .union(again.select(*cols, name("b", "block", "bin")))
    )


def batches(contexts: DataFrame, capacity: int) -> DataFrame:
    """Batches of each change-set: KEY, batch_index, step_group, files, n_contexts, tokens.

    Batches of a change-set are numbered from 0 in the order of their first context; a step group takes STEP batches, dealt
    by falling load to and fro, so that the groups of a change-set carry much the same.
    """
    rows = pack_contexts(contexts, capacity)
    made = rows.groupBy(*KEY, "batch").agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("context_id", "part", "file_path"))), lambda x: x["file_path"])).alias("files"),
        F.countDistinct("context_id").cast("int").alias("n_contexts"),
        F.sum("tokens").cast("int").alias("tokens"),
        F.min("context_id").alias("first"),
    )
    made = materialize(made, "batches")  # the numbers below are taken from it several times
    # a hot change-set is numbered in buckets by the first context, each a task of its own, after what stands in earlier ones
    span = made.groupBy(*KEY).agg(F.min("first").alias("low"), F.max("first").alias("high"), F.count("*").alias("count")).where(F.col("count") > BLOCK)
    if span.isEmpty():  # no task of a window holds more than BLOCK batches
        w = Window.partitionBy(*KEY)
        ranked = made.withColumn("batch_index", F.row_number().over(w.orderBy("first", "batch")) - 1).withColumn("rank", F.row_number().over(w.orderBy(F.desc("tokens"), "first", "batch")) - 1)
        return _stepped(ranked.withColumn("groups", F.ceil(F.count("*").over(w) / STEP)))
    s = broadcast_if_small(span.select(*(F.col(k).alias(f"s_{k}") for k in KEY), "low", "high", "count"))
    wide = (F.col("high") - F.col("low") + 1) / F.ceil(F.col("count") / BLOCK)
    bucket = F.coalesce(F.floor((F.col("first") - F.col("low")) / wide), F.lit(0)).cast("int")
    own = made.join(s, F.expr(" and ".join(f"{k} <=> s_{k}" for k in KEY)), "left").withColumn("bucket", bucket).select(*made.columns, "bucket")
    numbered = _numbered(own, ["bucket"], ["first", "batch"], "batch_index")
    ranked = _numbered(numbered.withColumn("light", -F.col("tokens")), ["light", "bucket"], ["first", "batch"], "rank")
    sizes = made.groupBy(*KEY).agg(F.ceil(F.count("*") / STEP).alias("groups"))
    g = sizes.select(*(F.col(k).alias(f"g_{k}") for k in KEY), "groups")
    return _stepped(ranked.join(g, F.expr(" and ".join(f"{k} <=> g_{k}" for k in KEY))))


def _stepped(ranked: DataFrame) -> DataFrame:
    """The batches with their step group: dealt by rank to and fro."""
    turn = F.floor(F.col("rank") / F.col("groups"))
    place = F.pmod(F.col("rank"), F.col("groups"))
    step = F.when(turn % 2 == 0, place).otherwise(F.col("groups") - 1 - place).cast("int")
    return ranked.select(*KEY, F.col("batch_index").cast("int").alias("batch_index"), step.alias("step_group"), "files", "n_contexts", "tokens")


def _numbered(rows: DataFrame, parts: list[str], order: list[str], name: str) -> DataFrame:
    """Rows with name: their number from 0 within the change-set, by parts and then order.

    Only rows of equal parts are sorted together; what stands before them is a sum over the parts, of which there are few.
    """
    keys = [*KEY, *parts]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*KEY).orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*(F.col(k).alias(f"p_{k}") for k in keys), F.coalesce(F.sum("c").over(w), F.lit(0)).alias("before"))
    within = rows.withColumn("within", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    return within.join(before, F.expr(" and ".join(f"{k} <=> p_{k}" for k in keys))).withColumn(name, (F.col("before") + F.col("within")).cast("int")).drop("before", "within", *(f"p_{k}" for k in keys))


def found(contexts: DataFrame, capacity: int) -> DataFrame:
    """(context_id) of the contexts that the packing divided, from the rows it packed."""
    return pack_contexts(contexts, capacity).where("parts > 1").select("context_id").distinct()

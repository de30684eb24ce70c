"""Near-duplicate records by the words they share, over collections too large to compare in pairs.

Method: size-aware heavy-light join. A record is the multiset of its words, written as a set by numbering repetitions; records
with the same multiset are one class and are compared once. Elements are ordered from rare to common. Of two classes that share
the threshold, the smaller holds l common elements among its first n - ceil(2t / (1 + t) * n) + l and the larger among its first
n - ceil(t * n) + l. Light (small) classes enumerate the subsets of SUBSET of those elements and meet on equal subsets; for heavy
(large) classes the inverted lists of single elements are scanned. The boundary between both is the size of least estimated
cost: rows written for subsets (ROW_COST each) against entries scanned. What meets is held against sizes, the places of the
shared elements and a parity sketch of the whole sets, all of which can only leave out pairs below the threshold, and is then
verified by the exact share; nothing is capped.

Scale: the order needs only the counts of elements of FREQUENT parts of all, so that the table of counts sent to the workers has
at most FREQUENT rows whatever the collection; rarer elements come first, in order of their hash. A list is scanned by arrays, a
worker holding at most about LIST entries of the smaller side; longer lists are cut into parts of the smaller side, each of
which the larger side runs past. Copies are dropped where the entries are made and where they meet; they return as membership,
in blocks of BLOCK rows on either side, so that a class of very many copies is dealt to many tasks.

Defined results: a record without words shares nothing with any; null fields are nothing; a manifest_id delivered again counts
once (the version of the least print, where copies differ); nulls in the key leave the row out; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlake.runtime import broadcast_if_small, materialize, ship_package

SUBSET = 2
FIELDS = ("rule", "issue", "suggestion")
THRESHOLD = 0.7
#: Most rows of the table of counts: an element is in it when it makes up more than one part in FREQUENT of all.
FREQUENT = 400_000
#: Entries of the smaller side that one scan holds, and rows of a class that one block holds.
LIST, BLOCK = 30_000, 1_000
#: What a row costs that is made, shuffled, sorted and read again, in pairs of entries scanned (measured: 1.6 us against 4 ns).
ROW_COST = 400
#: Prints that a task remembers, so as not to write the entries of a copy again.
REMEMBERED = 500_000


_word = re.compile(r"[^\W_]+")


def _records(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in rows:
        out = []
        for i, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
            words = sorted(_word.findall(text.lower()))
            if words:
                line = " ".join(words)
                out.append((i, hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest(), len(words), line))
        members, prints, sizes, lines = zip(*out) if out else ((), (), (), ())
        ids = np.frombuffer(b"".join(prints), np.int64)[::2]
        columns = [pa.array(members, pa.int64()), pa.array(prints, pa.binary()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(lines, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["member", "print", "id", "n", "words"])


def records(rows: DataFrame, key: str = "manifest_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(member, print, id, n, words) of each delivery with words, as a table; words are sorted and joined by blanks."""
    ship_package(rows.sparkSession)
    text = F.concat_ws(" ", *(F.col(f).cast("string") for f in fields))
    own = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long"), text)
    return materialize(own.mapInArrow(_records, "member long, print binary, id long, n int, words string"), "records")


def members(held: DataFrame) -> DataFrame:
    """(member, print): each record once."""
    return held.groupBy("member").agg(F.min("print").alias("print"))


# ---- elements of a batch of records, as arrays -----------------------------------------------------------------------


def _elements(lines: pa.Array, known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of sorted words: the size of each record; for all its numbered words a code; of each code the hash and the count.

    Codes are in order of count and hash: from rare to common. Counts are those known, 1 for an element too rare to be among
    them; without any known, they are those of the batch.
    """
    import xxhash

    lists = pc.split_pattern(lines, " ")
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    own = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    at = np.arange(len(word))
    first = np.ones(len(word), bool)
    first[1:] = word[1:] != word[:-1]
    first[np.cumsum(n) - n] = True
    repeat = at - np.maximum.accumulate(np.where(first, at, 0))
    most = int(repeat.max(initial=0)) + 1
    kinds, code = np.unique(word * most + repeat, return_inverse=True)
    with np.errstate(over="ignore"):
        h = (own[kinds // most] ^ ((kinds % most).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    if known is None:
        f = np.bincount(code, minlength=len(h))
    elif len(known[0]):
        where = np.minimum(np.searchsorted(known[0], h), len(known[0]) - 1)
        f = np.where(known[0][where] == h, known[1][where], 1)
    else:
        f = np.ones(len(h), np.int64)
    order = np.lexsort((h, f))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return n, rank[code], h[order], f[order]


def _prefix(n: np.ndarray, threshold: float, more: int, smaller: bool) -> np.ndarray:
    """How many of its first elements a class must show; smaller: to classes of its size or larger, else to smaller ones."""
    t = 2 * threshold / (1 + threshold) if smaller else threshold
    return np.minimum(n, n - np.ceil(t * n - 1e-9).astype(np.int64) + more)


def _ordered(lines: pa.Array, known: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch: n, and for all elements, from the rarest of each record: its place, the element, its count."""
    n, code, h, f = _elements(lines, known)
    wide = max(1, len(h))
    code = np.sort(np.repeat(np.arange(len(n)), n) * wide + code) % wide
    return n, np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n), h[code], f[code]


def _counts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in rows:
        _, _, h, f = _elements(rb.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(f, pa.int64())], ["element", "f"])


def frequent(held: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes and counts of the elements that make up more than 1 / FREQUENT of all: at most FREQUENT rows."""
    total = held.agg(F.sum("n")).first()[0] or 0
    some = held.select("words").mapInArrow(_counts, "element long, f long").groupBy("element").agg(F.sum("f").alias("f")).where(F.col("f") > total / FREQUENT).toArrow()
    keys = some.column("element").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], some.column("f").to_numpy()[order]


# ---- the boundary between light and heavy ------------------------------------------------------------------------------


def boundary(held: DataFrame, known, threshold: float) -> tuple[int, int]:
    """The largest size that is light, of least cost over all records, grouped by powers of 1.25 of their size; the largest size."""
    row_cost = ROW_COST

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            n, at, _, f = _ordered(rb.column(0), known.value)
            owner = np.repeat(np.arange(len(n)), n)
            shown = lambda more, smaller: np.bincount(owner, np.where(at < np.repeat(_prefix(n, threshold, more, smaller), n), f, 0), len(n))
            p, q = _prefix(n, threshold, SUBSET, True), _prefix(n, threshold, SUBSET, False)
            subsets = row_cost * q * (q - 1) / 2
            scans = row_cost * _prefix(n, threshold, 1, False) + shown(1, True)
            met = shown(SUBSET, True) * shown(SUBSET, False) / 2
            bucket = np.floor(np.log(np.maximum(n, 1)) / np.log(1.25)).astype(np.int64)
            keys, inv = np.unique(bucket, return_inverse=True)
            add = lambda x: pa.array(np.bincount(inv, x, len(keys)), pa.float64())
            most = np.zeros(len(keys), np.int64)
            np.maximum.at(most, inv, n)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(most), add(np.ones(len(n))), add(subsets), add(met), add(scans)], ["b", "n", "rows", "subsets", "met", "scans"])

    sums = (
        held.select("words")
        .mapInArrow(run, "b long, n long, rows double, subsets double, met double, scans double")
        .groupBy("b")
        .agg(F.max("n").alias("n"), *(F.sum(c).alias(c) for c in ("rows", "subsets", "met", "scans")))
        .orderBy("b")
        .collect()  # a row for each power of 1.25
    )
    every = sum(r.rows for r in sums)
    light = [r.subsets + r.met / max(every, 1) for r in sums]
    heavy = [r.scans for r in sums]
    cost = [sum(light[:k]) + sum(heavy[k:]) for k in range(len(sums) + 1)]
    best = min(range(len(cost)), key=cost.__getitem__, default=0)
    return sums[best - 1].n if best else 0, max((r.n for r in sums), default=0)


# ---- entries of the lists ------------------------------------------------------------------------------------------------

#: key: its last bit tells the entries that can only be the larger of a pair, which so come after the others of a list. meta: n
#: in the upper half; below it how many elements are left from the shared one on, and whether the entry may be the smaller or the
#: larger one of a pair.
ENTRIES = "key long, id long, meta long, s0 long, s1 long"


def entries(held: DataFrame, known, threshold: float, edge: int, most: int) -> DataFrame:
    """The entries of all lists: of subsets for classes up to edge elements, of single elements for all others and whatever
    such a class may meet; most: the size of the largest class."""
    length = LIST

    def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (a ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(31))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for rb in rows:
            ids = rb.column(0).to_pylist()
            fresh = []
            for k, i in enumerate(ids):
                if i not in seen:
                    seen.add(i)
                    fresh.append(k)
            if len(seen) > REMEMBERED:
                seen.clear()
            ids = np.array(ids, np.int64)[fresh]
            n, at, h, f = _ordered(rb.column(1).take(pa.array(fresh, pa.int64())), known.value)
            if not len(h):
                continue
            start = np.cumsum(n) - n
            bit = (h >> np.uint64(5)) & np.uint64(127)
            one = np.uint64(1) << (bit & np.uint64(63))
            s = [np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == k, one, np.uint64(0)), start).view(np.int64) for k in (0, 1)]
            owner = np.repeat(np.arange(len(n)), n)
            light = (n <= edge) & (np.ceil(threshold * n - 1e-9) >= SUBSET)
            out = []

            def add(key: np.ndarray, who: np.ndarray, left: np.ndarray, small: np.ndarray, large: np.ndarray) -> None:
                meta = (n[who] << 32) | (left << 2) | (small.astype(np.int64) << 1) | large
                out.append(((key & ~np.uint64(1) | (~small).astype(np.uint64)).view(np.int64), ids[who], meta, s[0][who], s[1][who]))

            # single elements: heavy classes as the larger, all as the smaller
            small = (at < _prefix(n, threshold, 1, True)[owner]) & ((most > edge) | (threshold * n <= 1))[owner]
            large = (at < _prefix(n, threshold, 1, False)[owner]) & ~light[owner]
            k = np.flatnonzero(small | large)
            if len(k):
                parts = -(-f[k] // length)
                key, who, left = h[k], owner[k], (n[owner] - at)[k]
                whole = parts == 1
                add(key[whole], who[whole], left[whole], small[k][whole], large[k][whole])
                if not whole.all():
                    # of a long list, the smaller side falls into parts, and the larger side runs past each
                    k2, times = k[~whole], parts[~whole]
                    own = mixed(ids[owner[k2]].view(np.uint64), np.uint64(17)) % times.astype(np.uint64)
                    again = np.repeat(np.arange(len(k2)), times)
                    part = (np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)).astype(np.uint64)
                    at_home = part == own[again]
                    keep = (large[k2][again]) | (small[k2][again] & at_home)
                    again, part, at_home = again[keep], part[keep], at_home[keep]
                    w = owner[k2][again]
                    add(mixed(h[k2][again], part + np.uint64(1)), w, (n[owner] - at)[k2][again], small[k2][again] & at_home, large[k2][again])
            # subsets: light classes as either, smaller ones as the smaller
            for r in np.flatnonzero(n <= edge):
                p, q = _prefix(n[r : r + 1], threshold, SUBSET, True)[0], _prefix(n[r : r + 1], threshold, SUBSET, False)[0]
                shown = h[start[r] : start[r] + (q if light[r] else p)]
                if len(shown) < SUBSET:
                    continue
                x, y = np.triu_indices(len(shown), 1)
                add(mixed(shown[x], shown[y]), np.full(len(x), r), n[r] - y + SUBSET - 1, y < p, np.full(len(x), bool(light[r])))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["key", "id", "meta", "s0", "s1"])

    return held.select("id", "words").mapInArrow(run, ENTRIES)


# ---- scans ---------------------------------------------------------------------------------------------------------------


class Scan:
    """Compares the entries of lists; yields pairs of ids that may share the threshold."""

    def __init__(self, threshold: float):
        self.length, self.block = LIST, 1 << 16
        self.t, self.c, self.q = threshold, threshold / (1 + threshold), (1 - threshold) / (1 + threshold)

    def kept(self, a: tuple, i: np.ndarray, b: tuple, j: np.ndarray) -> np.ndarray:
        """Of pairs of the entries i of a, as the larger, and j of b: those that sizes, places and sketches allow."""
        na, nb = a[1][i], b[1][j]
        both = self.c * (na + nb) - 1e-9
        ok = ((nb < na) | (nb == na) & (b[0][j] < a[0][i])) & (nb >= self.t * na - 1e-9) & (np.minimum(a[2][i], b[2][j]) >= both)
        i, j = i[ok], j[ok]
        apart = np.bitwise_count(a[3][i] ^ b[3][j]) + np.bitwise_count(a[4][i] ^ b[4][j])
        ok = apart <= self.q * (a[1][i] + b[1][j]) + 1e-9
        x, y = a[0][i[ok]], b[0][j[ok]]
        return np.stack([np.minimum(x, y), np.maximum(x, y)])

    def long(self, a: tuple, b: tuple) -> Iterator[np.ndarray]:
        """All pairs of the entries of a, as the larger, and b, in blocks between the sizes that can meet."""
        # how much larger the other may be, as the places of b allow; those that allow little meet few
        slack = b[2] / self.c - 2 * b[1]
        for part in np.array_split(np.argsort(slack, kind="stable"), max(1, min(6, len(slack) // 200))):
            part = part[np.argsort(b[1][part], kind="stable")]
            yield from self.blocks(a, tuple(x[part] for x in b), float(slack[part].max()))

    def blocks(self, a: tuple, b: tuple, slack: float) -> Iterator[np.ndarray]:
        low = np.searchsorted(b[1], np.maximum(self.t * a[1], a[1] - slack) - 1e-6)
        high = np.searchsorted(b[1], np.minimum(a[1], np.floor(a[2] / self.c - a[1] + 1e-6)), side="right")
        some = np.flatnonzero(low < high)
        some = some[np.lexsort((low[some], high[some]))]
        k, ups, downs, held = 0, [], [], 0
        while k < len(some):
            # as many rows as keep a block within a cache
            i = some[k : k + max(1, min(512, self.block // int(high[some[k]] - low[some[k]])))]
            k += len(i)
            x, y = int(low[i].min()), int(high[i].max())
            apart = np.bitwise_count(a[3][i][:, None] ^ b[3][None, x:y])
            apart += np.bitwise_count(a[4][i][:, None] ^ b[4][None, x:y])
            most = np.minimum(255, self.q * (a[1][i] + b[1][y - 1]) + 1e-9).astype(np.uint8)
            hit = np.flatnonzero((apart <= most[:, None]).ravel())
            if len(hit):
                r, s = np.divmod(hit, y - x)
                ups.append(i[r])
                downs.append(s + x)
                held += len(hit)
            if held and (held > 100_000 or k >= len(some)):
                yield self.kept(a, np.concatenate(ups), b, np.concatenate(downs))
                ups, downs, held = [], [], 0

    def short(self, every: tuple, small: np.ndarray, large: np.ndarray, begin: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
        """All pairs within each of many short lists at once."""
        reach = np.repeat(size, size)  # each entry meets all of its list
        first = np.repeat(begin, size)
        i = np.concatenate([np.arange(b, b + s) for b, s in zip(begin, size)]) if len(begin) else np.zeros(0, np.int64)
        use = large[i]
        i, reach, first = i[use], reach[use], first[use]
        edges = np.searchsorted(np.cumsum(reach), np.arange(0, int(reach.sum()) + 1, 2_000_000))
        for x, y in zip(edges, [*edges[1:], len(i)]):
            if x < y:
                r = reach[x:y]
                j = np.arange(int(r.sum())) - np.repeat(np.cumsum(r) - r, r) + np.repeat(first[x:y], r)
                k = np.repeat(i[x:y], r)
                ok = small[j]
                yield self.kept(every, k[ok], every, j[ok])

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        found: list[np.ndarray] = []
        for rb in batches:
            new = [rb.column(k).to_numpy() for k in range(5)]
            new[0] = new[0] >> 1
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            last = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if last:
                found += self.lists([x[:last] for x in held])
                held = [x[last:] for x in held]
            if len(held[0]) > 4 * self.length:
                # one list only; its smaller side came first: what is past it runs by and is dropped
                meta = held[2]
                if not meta[-1] & 2:
                    found += self.lists(held)
                    stay = np.flatnonzero(meta & 2)
                    held = [x[stay] for x in held]
                    held[2] = held[2] & ~np.int64(1)
            if found and sum(x.shape[1] for x in found) > 100_000:
                yield self.out(found)
                found = []
        if held is not None and len(held[0]):
            found += self.lists(held)
        if found:
            yield self.out(found)

    @staticmethod
    def out(found: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.concatenate(found, 1)
        pairs = pairs[:, np.lexsort(pairs)]
        pairs = pairs[:, np.append(True, (np.diff(pairs) != 0).any(0))] if pairs.shape[1] else pairs
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    def lists(self, held: list[np.ndarray]) -> list[np.ndarray]:
        key, ids, meta = held[:3]
        every = (ids, meta >> 32, (meta >> 2) & 0x3FFFFFFF, held[3].view(np.uint64), held[4].view(np.uint64))
        small, large = meta & 2 > 0, meta & 1 > 0
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(begin, len(key)))
        few = (size > 1) & (size <= 128)
        out = [*self.short(every, small, large, begin[few], size[few])]
        for b, s in zip(begin[size > 128].tolist(), size[size > 128].tolist()):
            x, y = np.flatnonzero(large[b : b + s]) + b, np.flatnonzero(small[b : b + s]) + b
            if len(x) and len(y):
                out += self.long(tuple(v[x] for v in every), tuple(v[y] for v in every))
        return out


# ---- pairs ---------------------------------------------------------------------------------------------------------------


def class_pairs(held: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(print_a, print_b, share): all pairs of classes of the records that share at least the threshold."""
    spark = held.sparkSession
    ship_package(spark)
    known = spark.sparkContext.broadcast(frequent(held))
    rows = entries(held, known, threshold, *boundary(held, known, threshold))
    scan = Scan(threshold)
    met = rows.repartition(F.shiftright("key", 1)).sortWithinPartitions("key").mapInArrow(lambda x: scan(x), "a long, b long")
    candidates = materialize(met.distinct(), "candidates")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            n, code, h, _ = _elements(rb.column(2))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(h[code].view(np.int64)))
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), lists], ["id", "print", "e"])

    # the classes that a candidate names, once each; copies of one are dealt by salt
    salts = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("salt")
    named = candidates.select(F.col("a").alias("id")).union(candidates.select("b")).distinct().select("id", salts)
    salted = held.withColumn("salt", F.pmod(F.xxhash64("member"), F.lit(8)).cast("int"))
    reps = salted.join(named, ["id", "salt"], "left_semi").select("id", "print", "words").dropDuplicates(["id", "print"]).mapInArrow(hashed, "id long, print binary, e array<long>")
    side = lambda x: reps.select(F.col("id").alias(x), F.col("print").alias(f"print_{x}"), F.col("e").alias(f"e{x}"))
    both = candidates.join(side("a"), "a").join(side("b"), "b").select("print_a", "print_b", (F.size("ea") + F.size("eb")).alias("n"), F.size(F.array_intersect("ea", "eb")).alias("o"))
    return both.where(F.col("o") >= threshold * (F.col("n") - F.col("o")) - 1e-9).select("print_a", "print_b", (F.col("o") / (F.col("n") - F.col("o"))).alias("share"))


def record_pairs(rows: DataFrame, threshold: float = THRESHOLD, key: str = "manifest_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(key_a, key_b): all pairs of different keys that share the threshold, the smaller first; copies of a class included.

    The rows of a class stand in blocks of about BLOCK; a pair of classes, or a class with itself, meets block by block.
    """
    held = records(rows, key, fields)
    member = members(held)
    links = class_pairs(held, threshold).select("print_a", "print_b")
    copies = member.groupBy("print").agg(F.count("*").alias("c")).where("c > 1")
    blocks = copies.where(F.col("c") > BLOCK).select("print", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))  # at most rows / BLOCK
    few = broadcast_if_small(blocks)
    own = copies.select(F.col("print").alias("print_a"), F.col("print").alias("print_b"))
    for x in ("a", "b"):
        links = links.join(few.select(F.col("print").alias(f"print_{x}"), F.col("blocks").alias(f"n_{x}")), f"print_{x}", "left")
    own = own.join(few.select(F.col("print").alias("print_a"), F.col("blocks").alias("n_a")), "print_a", "left").select("print_a", "print_b", "n_a", F.col("n_a").alias("n_b"))
    count = lambda x: F.sequence(F.lit(0), F.coalesce(f"n_{x}", F.lit(1)) - 1)
    met = links.select("print_a", "print_b", "n_a", "n_b").union(own).withColumn("i", F.explode(count("a"))).withColumn("j", F.explode(count("b")))
    met = met.where((F.col("print_a") != F.col("print_b")) | (F.col("i") <= F.col("j"))).drop("n_a", "n_b")
    home = F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("member"), F.col("blocks"))).cast("int")
    dealt = member.join(few, "print", "left").select("member", "print", home.alias("block"))
    left = dealt.select(F.col("print").alias("print_a"), F.col("block").alias("i"), F.col("member").alias("x"))
    right = dealt.select(F.col("print").alias("print_b"), F.col("block").alias("j"), F.col("member").alias("y"))
    pairs = met.join(left, ["print_a", "i"]).join(right, ["print_b", "j"])
    once = (F.col("print_a") != F.col("print_b")) | (F.col("i") != F.col("j")) | (F.col("x") < F.col("y"))
    return pairs.where(once).select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))


def groups(rows: DataFrame, threshold: float = THRESHOLD, key: str = "manifest_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(key, group, links, copies): the connected group of each record, its links to other classes, and its exact copies.

    The least class of a group spreads along the links; each round also jumps to the label of the label, so that the rounds
    grow with the logarithm of a chain's length. Each round is written as a table.
    """
    held = records(rows, key, fields)
    member = members(held)
    heads = member.groupBy("print").agg(F.min("member").alias("class"), (F.count("*") - 1).alias("copies"))
    links = class_pairs(held, threshold)
    for x in ("a", "b"):
        links = links.join(heads.select(F.col("print").alias(f"print_{x}"), F.col("class").alias(x)), f"print_{x}")
    links = materialize(links.select("a", "b"), "links")
    both = links.union(links.select("b", "a")).toDF("a", "b")
    degree = both.groupBy("a").agg(F.count("*").alias("links"))
    label = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("g")), "labels")
    while True:
        near = both.join(label.select(F.col("a").alias("b"), "g"), "b").groupBy("a").agg(F.min("g").alias("m"))
        step = label.join(near, "a").select("a", F.least("g", "m").alias("g"), F.col("g").alias("old"))
        jump = step.join(label.select(F.col("a").alias("g"), F.col("g").alias("gg")), "g", "left").select("a", F.coalesce(F.least("g", "gg"), "g").alias("g"), "old")
        done = materialize(jump, "labels")
        label = done.select("a", "g")
        if done.where("g <> old").isEmpty():
            break
    told = heads.join(label.withColumnRenamed("a", "class"), "class", "left").join(degree.withColumnRenamed("a", "class"), "class", "left")
    return member.join(told, "print").select(F.col("member").alias(key), F.coalesce("g", "class").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"), "copies")

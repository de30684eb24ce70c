"""Encoding of a corpus with a public byte-level BPE vocabulary, each distinct word encoded once.

Method: texts are split into pre-tokens with their positions; the positions of one batch of texts are kept as codes into the
batch's own list of distinct words, so that a word crosses the network once per batch however often it stands there; the
distinct words of all batches meet in one global shuffle and each is encoded once; the ids return to the batches by a join on
the word, and the codes put them back in position. A word occurs at most once per batch; words that stand in a large share of all
batches, of which there are few, return by broadcast, so that no word is a hot key of the join.

Defined results: a null or empty text has an empty list; a string of a special token is ordinary text; a doc_id delivered
more than once has one row (any of its copies, which TESTDATA gives as equal); extra columns are ignored; an empty table
gives an empty result; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlake.runtime import materialize, ship_package, small

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters of text in one batch; a longer text is a batch of its own.
BATCH_CHARS = 600_000
#: A word that stands in more than one of so many batches is hot; the first share whose words fit a broadcast is taken.
HOT, HOT_ROWS, HOT_BYTES = (64, 16, 4), 400_000, 24 << 20
#: The split pattern of the vocabulary is public_tokenizers.PATTERN; these are its contractions.
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
_state: dict = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _classes() -> np.ndarray:
    """The class of each code point, from the Unicode properties."""
    if "classes" not in _state:
        import regex

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        kind = np.full(0x110000, OTHER, np.uint8)
        for pattern, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
            for m in regex.finditer(pattern, every):
                a, b = ord(m[0][0]), ord(m[0][-1])
                if b - a == len(m[0]) - 1:
                    kind[a : b + 1] = value
                else:
                    kind[[ord(c) for c in m[0]]] = value
        _state["classes"] = kind
        rng = np.random.Generator(np.random.PCG64(20240607))
        _state["factors"] = rng.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return _state["classes"]


def split_points(cp: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of one text begin; cp are its code points.

    The pattern takes, in this order: a contraction; letters, numbers or other signs with one leading blank; white space
    but for its last character before a sign; white space.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[cp]
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    space = kind == SPACE
    # the last white space before a sign leaves its run; a blank goes to the sign, another character stands alone
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:]
    first |= last
    blank = last & (cp == 32)
    first[1:] &= ~blank[:-1]
    # contractions begin where a token of other signs would begin with the apostrophe itself
    marks = np.flatnonzero((cp == 39) & first)
    for i in marks:
        if i and blank[i - 1]:
            continue
        for word in CONTRACTIONS:
            j = i + 1 + len(word)
            if j <= n and all(cp[i + 1 + k] == ord(c) for k, c in enumerate(word)):
                first[i + 1 : j] = False
                if j < n:
                    # what follows starts anew, as if the text began here
                    if kind[j] != SPACE and not (last[j] and cp[j] == 32):
                        first[j] = True
                break
    return np.flatnonzero(first)


def pretokens(text: str) -> list[str]:
    """The pre-tokens of one text by the pattern itself; split_points must agree with it."""
    if "pattern" not in _state:
        import regex

        words = "|".join(f"'{w}" for w in ("s", "t", "re", "ve", "m", "ll", "d"))
        _state["pattern"] = regex.compile(words + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    return _state["pattern"].findall(text)


def codes_of(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct pre-tokens of the texts, the code of each pre-token in order, and the number of them in each text."""
    points, counts, base = [], [], 0
    arrays = []
    for t in texts:
        cp = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        p = split_points(cp)
        points.append(p + base)
        counts.append(len(p))
        arrays.append(cp)
        base += len(cp)
    if not base:
        return [], np.zeros(0, np.int64), np.array(counts, np.int64)
    cp, start = np.concatenate(arrays), np.concatenate(points)
    size = np.diff(np.append(start, base))
    at = np.arange(base, dtype=np.int64) - np.repeat(start, size)
    factor = _state["factors"]
    with np.errstate(over="ignore"):
        mixed = (cp.astype(np.uint64) + np.uint64(1)) * factor[at & 4095] + (at >> 12).astype(np.uint64) * cp.astype(np.uint64)
        key = np.add.reduceat(mixed, start)
    _, where, code = np.unique(key, return_index=True, return_inverse=True)
    whole = "".join(texts)
    words = [whole[start[i] : start[i] + size[i]] for i in where]
    if "".join([words[c] for c in code.tolist()]) != whole:  # two words with one key: count them by the words themselves
        seen: dict[str, int] = {}
        pieces = [whole[a : a + b] for a, b in zip(start.tolist(), size.tolist())]
        code = np.array([seen.setdefault(w, len(seen)) for w in pieces], np.int64)
        words = list(seen)
    return words, code, np.array(counts, np.int64)


BATCHES = "batch long, doc_ids array<long>, counts array<int>, width int, codes binary, words array<string>"


def _batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    context = TaskContext.get()
    key = (context.partitionId() if context else 0) << 32
    ids: list[int] = []
    texts: list[str] = []
    chars, seen = 0, set()

    def out() -> pa.RecordBatch:
        words, code, counts = codes_of(texts)
        width = 2 if len(words) <= 65536 else 4
        return pa.RecordBatch.from_arrays(
            [
                pa.array([key], pa.int64()),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([counts.tolist()], pa.list_(pa.int32())),
                pa.array([width], pa.int32()),
                pa.array([code.astype(np.uint16 if width == 2 else np.uint32).tobytes()], pa.binary()),
                pa.array([words], pa.list_(pa.string())),
            ],
            ["batch", "doc_ids", "counts", "width", "codes", "words"],
        )

    for rb in rows:
        for i, t in zip(rb.column(0).to_pylist(), rb.column(1)):
            t = t.as_py() or ""
            if i in seen:
                continue
            if texts and chars + len(t) > BATCH_CHARS:
                yield out()
                key += 1
                ids, texts, chars, seen = [], [], 0, set()
            ids.append(i)
            texts.append(t)
            seen.add(i)
            chars += len(t)
    if texts:
        yield out()


def word_batches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Batches of documents as codes into their distinct words; written as a table, which both later joins read."""
    ship_package(docs.sparkSession)
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return materialize(plain.mapInArrow(_batches, BATCHES), "word_batches")


def _encode(held, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, ids) of rows (word, n); the encoder is built once for each worker and vocabulary."""
    import tiktoken

    text = held.value
    key = ("encoder", hash(text))
    if key not in _state:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, text.splitlines())}
        _state[key] = tiktoken.Encoding("own", pat_str=r"\s+|\S+", mergeable_ranks=ranks, special_tokens={})
    piece = _state[key]._encode_single_piece
    for rb in rows:
        ids = [piece(w.encode("utf-8", "surrogatepass")) for w in rb.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """(word, n, ids) for rows (word, n), each encoded once. The vocabulary is of fixed size and goes to the workers whole."""
    with open(path, "rb") as f:
        held = words.sparkSession.sparkContext.broadcast(f.read())
    # a function of the module, so that what it keeps outlives its task
    return words.select("word", "n").mapInArrow(functools.partial(_encode, held), "word string, n long, ids array<int>")


def _assemble(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in rows:
        cols = {n: rb.column(n) for n in rb.schema.names}
        for r in range(rb.num_rows):
            doc_ids = np.array(cols["doc_ids"][r].as_py(), np.int64)
            counts = np.array(cols["counts"][r].as_py(), np.int64)
            code = np.frombuffer(cols["codes"][r].as_py(), np.uint16 if cols["width"][r].as_py() == 2 else np.uint32).astype(np.int64)
            entries = cols["entries"][r].values
            if entries is None or not len(entries):
                flat, size, begin = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
            else:
                pos = entries.field("pos").to_numpy(zero_copy_only=False)
                lists = entries.field("ids")
                lens = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
                starts = np.cumsum(lens) - lens
                size, begin = np.zeros(pos.max() + 1, np.int64), np.zeros(pos.max() + 1, np.int64)
                size[pos], begin[pos] = lens, starts
            n = size[code]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            value = flat[np.repeat(begin[code] - (ends - n), n) + np.arange(total)] if total else flat[:0]
            edge = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
            drop = set(cols["drops"][r].as_py() or ())
            lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(value, pa.int32()))
            batch = pa.RecordBatch.from_arrays([pa.array(doc_ids), lists], ["doc_id", "ids"])
            if drop:
                batch = batch.filter(pa.array([i not in drop for i in doc_ids.tolist()]))
            yield batch


def encode_corpus(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of every document by the vocabulary at path."""
    path = path or vocabulary_path()
    batches = word_batches(docs, key, text)
    every = batches.count()
    words = batches.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    ids = materialize(encode_words(words, path), "word_ids")
    entries = batches.select("batch", F.posexplode("words").alias("pos", "word"))
    # What stands in more than one of so many batches: at most that many times the words of a batch, whatever the corpus. These
    # words go to the batches by broadcast; a word of the rest has entries in few batches alone.
    met, rest, left = [], ids, entries
    for share in HOT:
        often = F.col("n") > every / share
        held = ids.where(often).select("word", "ids")
        if small(held, HOT_ROWS, HOT_BYTES):
            met, rest = [entries.join(F.broadcast(held), "word")], ids.where(~often)
            left = entries.join(F.broadcast(held), "word", "left_anti")
            break
    met.append(left.join(rest.select("word", "ids"), "word"))
    met = functools.reduce(DataFrame.unionByName, met)
    entries = met.groupBy("batch").agg(F.collect_list(F.struct("pos", "ids")).alias("entries"))
    # a doc_id in two batches stays in the first
    owner = batches.select("batch", F.explode("doc_ids").alias("doc_id")).groupBy("doc_id").agg(
        F.count("*").alias("n"), F.min("batch").alias("keep"), F.collect_set("batch").alias("held")
    )
    drops = (
        owner.where("n > 1")
        .select("doc_id", "keep", F.explode("held").alias("batch"))
        .where("batch <> keep")
        .groupBy("batch")
        .agg(F.collect_list("doc_id").alias("drops"))
    )
    joined = batches.drop("words").join(entries, "batch", "left").join(drops, "batch", "left")
    kept = joined.select("doc_ids", "counts", "width", "codes", "entries", "drops")
    return kept.mapInArrow(_assemble, "doc_id long, ids array<int>")


def token_bytes(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The table (id, bytes) of the vocabulary: of fixed size."""
    ranks = read_ranks(path or vocabulary_path())
    return spark.createDataFrame([(i, bytearray(b)) for b, i in ranks.items()], "id int, bytes binary")


def decode_corpus(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): the distinct ids of each document are joined to the token-byte table.

    The table is bounded by the vocabulary (about 50,000 rows) and is broadcast. A null list of ids gives an empty text.
    """
    spark = encoded.sparkSession
    ship_package(spark)
    tokens = F.broadcast(token_bytes(spark, path))
    distinct = encoded.select("doc_id", F.explode(F.array_distinct("ids")).alias("id")).join(tokens, "id")
    held = distinct.groupBy("doc_id").agg(F.collect_list(F.struct("id", "bytes")).alias("entries"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            out = []
            for ids, entries in zip(rb.column("ids").to_pylist(), rb.column("entries").to_pylist()):
                table = {e["id"]: bytes(e["bytes"]) for e in entries or ()}
                out.append(b"".join([table[i] for i in ids or ()]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.join(held, "doc_id", "left").select("doc_id", "ids", "entries").mapInArrow(run, "doc_id long, text string")

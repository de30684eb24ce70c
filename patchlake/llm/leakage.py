"""Evaluation passages inside a corpus of subtitles.

Method: a prefix-filtered set join. The words of items and documents are folded (case, markup, cue numbers and times, speaker
names and sound descriptions go; signs that misreading confuses become one; what a wrong encoding garbled is put right where
that is certain and left out of a word elsewhere; words of other scripts keep their letters). Of
every stretch of an item that a match must cover, the rarest shingles of five words are its prefix; a document meets an item
only where it holds one of them, at a place that lengths and positions allow. Around each such place a stretch of the document
as long as the item is compared with the item word by word, and words that differ by a misread character still agree.

Scale: what folding makes of a token is worked out once by each worker, so that a document costs a look-up for each of its tokens.
Rarity is counted over the items, in a shuffle. A bitmap of the prefixes, of fixed size whatever their number, goes to the
workers; the shingles of documents that pass it meet the prefixes, and then the words of their items, by broadcast where rows
and bytes of that side were measured to be small, else by shuffle joins over salted keys.

Defined results: null and empty texts carry nothing; items under LEAST words can't be carried; a document or an item delivered
again counts once; texts of any length are read whole, in the order of the text; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlake.llm.abuse import repaired
from patchlake.runtime import by_group, materialize, ship_package, small

#: Consecutive words of an item that make a case, and words of a shingle.
LEAST, SHINGLE = 12, 5
#: Words of a stretch that misreading may spoil beyond what folding repairs, without losing the stretch.
SPOILT = 1
#: Ranges of the bitmap of shingles, and parts of a hot key where a side is too large for a broadcast.
SEGMENTS, SALTS = 64, 8
#: Tokens of documents taken together, and bytes about which a worker forgets the tokens it has folded.
AT_ONCE, FOLDED_BYTES = 1 << 17, 1 << 27

HEAD = re.compile(r"\ufeff?WEBVTT|(?:NOTE|STYLE|REGION)\b")
MARKUP = re.compile(r"<[^<>\n]{0,60}>|\{\\?[^{}\n]{0,40}\}|&(?:nbsp|amp|lt|gt|quot|#39|lrm|rlm);")
SOUND = re.compile(r"\[[^\[\]]{0,80}\]|\([^()]{0,80}\)|\*[^*\n]{1,60}\*|♪[^♪\n]{0,120}♪|♪|♫|#")
SPEAKER = re.compile(r"(?:[ \t]*(?:-|–|—|>>)[ \t]*)?[A-ZÀ-ÖØ-ÞА-Я][A-ZÀ-ÖØ-ÞА-Я0-9 .'-]{1,24}:[ \t]*")
GARBLED = re.compile(r"(?<=\w)[?](?=\w)|[?](?=[a-zA-Z]{2})")
FOREIGN = re.compile(r"[!-~]*[^\x00-\x7f\s]\S*")
IDEOGRAPH = re.compile(r"[\u3041-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_BLANK = str.maketrans(dict.fromkeys("–—…\u00a0", " "))
WORD = re.compile(r"[a-z0-9|$@'\x80-\U0010ffff]+")


def spoken(text: str) -> str:
    """A text without what belongs to its format or isn't spoken; words stay apart, lines stay lines."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    lines = text.split("\n")
    for k, line in enumerate(lines):
        if line and ("-->" in line or line.isdecimal() or line.lstrip(" \t\ufeff").rstrip(" \t").isdecimal() or line[0] in "\ufeffWNSR" and HEAD.match(line)):
            lines[k] = ""
    text = "\n".join(lines)
    if "<" in text or "{" in text or "&" in text:
        text = MARKUP.sub(" ", text)
    if "[" in text or "(" in text or "*" in text or "#" in text or "♪" in text or "♫" in text:
        text = SOUND.sub(" ", text)
    if ":" in text:
        text = "\n".join([line[m.end() :] if ":" in line and (m := SPEAKER.match(line)) else line for line in text.split("\n")])
    return text


def fold_words(text: str) -> list[str]:
    """The words of a text, as misreading and wrong encoding leave them recognisable. Nothing reaches across a blank or a line."""
    if not text.isascii():
        text = text.replace("’", "'").replace("\u00ad", "")
        if not text.isascii():
            text = FOREIGN.sub(lambda m: foreign(m[0]), repaired(text).translate(_BLANK))
    if "?" in text:
        text = GARBLED.sub("", text)
    text = text.lower().replace("'", "").replace("vv", "w").replace("rn", "m").replace("cl", "d")
    text = text.translate(_SAME)
    return [text] if text.isalnum() else WORD.findall(text)


def foreign(token: str) -> str:
    """What a token with signs beyond ASCII is compared by.

    A word of another script keeps its letters without marks, each ideograph or kana a word of its own. Of a Latin word the
    accented letters go, as a wrong encoding may have put any sign there, but a word of nothing else keeps their base letters. A
    lone sign of replacement stays for a short word.
    """
    letters = [c for c in token if c.isalpha()]
    other = sum(c > "\u024f" and not "\u1e00" <= c <= "\u1eff" for c in letters)
    out = "".join(c if c.isascii() else "" for c in token)
    core = token.strip("".join(c for c in token if not c.isalnum() and c != "\ufffd"))
    if 2 * other > len(letters):
        base = unicodedata.normalize("NFKD", token.lower())
        out = "".join(f" {c} " if IDEOGRAPH.match(c) else c if c.isalnum() or c.isascii() or unicodedata.category(c) == "Mc" else "" if unicodedata.combining(c) else " " for c in base)
    elif not re.search(r"[A-Za-z0-9]", out):
        if core.isalnum() and core != "Â":
            out = "".join(c for c in unicodedata.normalize("NFKD", core) if c.isalnum())
        elif core == "\ufffd":
            out = core
    return out


#: Signs that look alike become one.
_SAME = str.maketrans({"l": "i", "1": "i", "|": "i", "0": "o", "5": "s", "$": "s", "8": "b"})


def alike(a: str, b: str) -> bool:
    """Whether two folded words agree but for a misread character or two."""
    if a == b:
        return True
    m, n = len(a), len(b)
    if "\ufffd" in (a, b):
        return max(m, n) <= 2
    most = 1 if min(m, n) < 6 else 2
    if abs(m - n) > most or min(m, n) < 3:
        return False
    before = list(range(n + 1))
    for i in range(1, m + 1):
        now = [i]
        for j in range(1, n + 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (a[i - 1] != b[j - 1])))
        if min(now) > most:
            return False
        before = now
    return before[n] <= most


class Tokens(dict):
    """Tokens by number, each folded once: the words of token t are counts[t] of `words` from starts[t] on, with their hashes."""

    def __init__(self) -> None:
        from xxhash import xxh64_intdigest

        self.hash = xxh64_intdigest
        self.renew()

    def renew(self) -> None:
        self.clear()
        self.words: list[str] = []
        self.prints, self.starts, self.counts = array("Q"), array("q"), array("q")
        self.bytes = 0

    def __missing__(self, token: str) -> int:
        words = fold_words(token)
        number = self[token] = len(self.starts)
        self.starts.append(len(self.words))
        self.counts.append(len(words))
        self.words += words
        self.prints.extend([self.hash(w) | 1 for w in words])
        self.bytes += 300 + 100 * len(words) + 5 * len(token)
        return number

    def numbers(self, text: str) -> np.ndarray:
        """The numbers of the tokens of a text, one at least."""
        tokens = spoken(text).replace("\n", " ").split(" ")
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))

    def places(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in `words` of the words of tokens, and how many words there are up to the end of each token."""
        counts = np.frombuffer(self.counts, np.int64)[numbers]
        ends = counts.cumsum()
        return np.repeat(np.frombuffer(self.starts, np.int64)[numbers] - ends + counts, counts) + np.arange(ends[-1]), ends

    def hashes(self, places: np.ndarray) -> np.ndarray:
        return np.frombuffer(self.prints, np.uint64)[places] if len(places) else np.zeros(0, np.uint64)


def rolled(h: np.ndarray) -> np.ndarray:
    """The hash of each shingle of five words, by the hashes of the words."""
    n = max(0, len(h) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            out = (out ^ (out >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def item_words(text: str | None) -> list[str]:
    """The words of an item, each kept (as "") where folding leaves nothing of it, so that places count all words."""
    out = []
    for w in re.findall(r"\S+", MARKUP.sub(" ", text or "")):
        some = fold_words(w)
        if re.search(r"\w", w):
            out += some if IDEOGRAPH.search(w) else ["".join(some)]
    return out


def shingled(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, words, shingles) of the items long enough for a match."""
    import xxhash

    known: dict[str, int] = {}
    for rb in rows:
        out = []
        if len(known) > 1_000_000:
            known.clear()
        for item, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
            whole = item_words(text)
            words = [w for w in whole if w]
            if len(whole) >= LEAST and len(words) >= SHINGLE:
                out.append((item, words, rolled(np.array([known.get(w) or known.setdefault(w, xxhash.xxh64_intdigest(w) | 1) for w in words], np.uint64)).tolist()))
        columns = list(zip(*out)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.list_(pa.string())), pa.array(columns[2], pa.list_(pa.int64()))], ["item_id", "words", "shingles"])


def chosen(rows: list[tuple]) -> list[tuple]:
    """(item, place, shingle) of the shingles of an item that a match of LEAST words can't avoid; rows: item, place, shingle, count.

    A match covers LEAST - SHINGLE + 1 shingles in a row, of which SPOILT spoilt words leave at least the rest whole; that many
    less one may be left out of each stretch, the commonest first. Places are among the words that folding leaves.
    """
    span = LEAST - SHINGLE + 1
    left = max(1, span - SPOILT * SHINGLE)
    keep: set[int] = set()
    for a in range(max(1, len(rows) - span + 1)):
        stretch = sorted(range(a, min(len(rows), a + span)), key=lambda k: (rows[k][3], rows[k][2]))
        keep.update(stretch[: max(1, len(stretch) - left + 1)])
    return [rows[k][:3] for k in sorted(keep)]


def prefixes(held: DataFrame) -> DataFrame:
    """(item_id, place, shingle): the rarest shingles of each stretch of each item, rarity counted over all items."""
    places = held.select("item_id", F.posexplode("shingles").alias("place", "shingle"))
    counts = held.select("item_id", F.explode(F.array_distinct("shingles")).alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"))
    rows = places.join(counts, "shingle").select("item_id", "place", "shingle", "n")
    return by_group(rows, ["item_id"], ["place"], chosen, "item_id long, place int, shingle long")


def bitmap(prefix: DataFrame, count: int) -> np.ndarray:
    """A bit for each remainder of a shingle: 2 ** 16 to 2 ** 27 bits, whatever the number of shingles.

    Each task sets the bits of one of at most SEGMENTS ranges; the driver joins the ranges, 16 MB at most.
    """
    bits = min(27, max(16, (64 * max(1, count)).bit_length()))
    segments = min(SEGMENTS, 1 << max(0, bits - 18))
    each = (1 << bits) // segments

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for rb in rows:
            at = rb.column(1).to_numpy()
            for seg in np.unique(rb.column(0).to_numpy()).tolist():
                own = made.setdefault(seg, np.zeros(each, np.uint8))
                own[at[rb.column(0).to_numpy() == seg] % each] = 1
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int64()), pa.array([np.packbits(x).tobytes() for x in made.values()], pa.binary())], ["seg", "bits"])

    at = F.pmod("shingle", F.lit(1 << bits))
    rows = prefix.select(F.floor(at / each).alias("seg"), at.alias("at")).distinct().repartition(segments, "seg").mapInArrow(run, "seg long, bits binary").collect()
    out = np.zeros((segments, each // 8), np.uint8)
    for r in rows:
        out[r["seg"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def marked(rows: Iterator[pa.RecordBatch], wanted: np.ndarray, longest: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, at, shingle, around): each shingle of the documents that the bitmap has, at its place among `longest` words on
    either side."""
    tokens = Tokens()
    last = np.int64(8 * len(wanted) - 1)

    def met(docs: list[int], numbers: list[np.ndarray]) -> pa.RecordBatch:
        places, ends = tokens.places(np.concatenate(numbers))
        begin = np.concatenate([[0], ends[np.cumsum([len(x) for x in numbers]) - 1]])
        h = rolled(tokens.hashes(places))
        bit = h & last
        hits = np.flatnonzero((wanted[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1)
        of = np.searchsorted(begin, hits, side="right") - 1
        ids, ats, prints, around = [], [], [], []
        for k, d, p in zip(hits.tolist(), of.tolist(), h[hits].tolist()):
            if k + SHINGLE > begin[d + 1]:  # it reaches into the next document
                continue
            a = max(int(begin[d]), k - longest)
            ids.append(docs[d])
            ats.append(k - a)
            prints.append(p)
            around.append([tokens.words[w] for w in places[a : min(k + longest, int(begin[d + 1]))].tolist()])
        if tokens.bytes > FOLDED_BYTES:
            tokens.renew()
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ats, pa.int32()), pa.array(prints, pa.int64()), pa.array(around, pa.list_(pa.string()))], ["doc_id", "at", "shingle", "around"])

    for rb in rows:
        docs, numbers, held = [], [], 0
        for doc, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
            if text:
                docs.append(doc)
                numbers.append(tokens.numbers(text))
                held += len(numbers[-1])
            if held >= AT_ONCE:
                yield met(docs, numbers)
                docs, numbers, held = [], [], 0
        if docs:
            yield met(docs, numbers)


def carried(words: list[str], at: int, item: list[str], place: int) -> int:
    """How many words in a row of the item the words carry around a shared shingle; a differing word or one left out ends it,
    but for a word read as two or two as one."""

    def extend(i: int, j: int, step: int) -> int:
        n = 0
        while 0 <= i < len(words) and 0 <= j < len(item):
            if alike(words[i], item[j]):
                i, j, n = i + step, j + step, n + 1
                continue
            two = (words[i] + words[i + 1] if step > 0 else words[i - 1] + words[i]) if 0 <= i + step < len(words) else None
            if two is not None and len(item[j]) > 3 and alike(two, item[j]):
                i, j, n = i + 2 * step, j + step, n + 1
                continue
            pair = (item[j] + item[j + 1] if step > 0 else item[j - 1] + item[j]) if 0 <= j + step < len(item) else None
            if pair is not None and len(words[i]) > 3 and alike(words[i], pair):
                i, j, n = i + step, j + 2 * step, n + 2
                continue
            break
        return n

    return SHINGLE + extend(at + SHINGLE, place + SHINGLE, 1) + extend(at - 1, place - 1, -1)


def carriers(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, words): the longest stretch of each item that each document carries, of LEAST words or more."""
    spark = docs.sparkSession
    ship_package(spark)
    plain = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").dropDuplicates(["item_id"])
    held = materialize(plain.mapInArrow(shingled, "item_id long, words array<string>, shingles array<long>"), "items")
    prefix = materialize(prefixes(held), "prefixes")
    bits = spark.sparkContext.broadcast(bitmap(prefix, prefix.count()))
    longest = max(LEAST, held.agg(F.max(F.size("words"))).first()[0] or 0) + LEAST

    def of_docs(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return marked(rows, bits.value, longest)

    places = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of_docs, "doc_id long, at int, shingle long, around array<string>")
    met = _met(places, prefix, "shingle")
    words = held.select("item_id", "words")
    # a match needs LEAST words: the place must leave room for them on both sides together
    room = F.least("at", "place") + F.least(F.size("around") - F.col("at"), F.size("words") - F.col("place")) >= LEAST - 3

    def verify(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            doc, item, at, place, around, words = (rb.column(k).to_pylist() for k in range(6))
            n = [carried(w, a, x, p) for a, p, w, x in zip(at, place, around, words)]
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(n, pa.int32())], ["doc_id", "item_id", "words"])

    checked = _met(met, words, "item_id").where(room).select("doc_id", "item_id", "at", "place", "around", "words").mapInArrow(verify, "doc_id long, item_id long, words int")
    return checked.where(F.col("words") >= LEAST).groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))


def _met(many: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """The join on key: by broadcast where side was measured to be small, else with a hot key of many dealt over SALTS."""
    if small(side):
        return many.join(F.broadcast(side), key)
    salted = side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("salt", F.pmod(F.xxhash64("doc_id", "at"), F.lit(SALTS)).cast("int")).join(salted, [key, "salt"]).drop("salt")


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    return carriers(docs, items).select("doc_id", "item_id")


def leaked_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, suite, documents): every leaked item with the number of documents that carry it."""
    n = found(docs, items).groupBy("item_id").agg(F.count("*").alias("documents"))
    return items.select("item_id", "suite").dropDuplicates(["item_id"]).join(n, "item_id")

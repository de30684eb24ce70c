"""Splitting oversized chunks of changed lines at natural boundaries.

Method: content-defined chunking. A rolling hash over the last 32 characters marks landmarks; a cut belongs where the first
landmark within the allowed sizes stands, and snaps to the nearest natural boundary: before a definition or a hunk, after a
blank or closing line, or between lines, the better kind first where one lies within SNAP_SHARE of the limit; inside a line too
long for any piece, at the nearest blank or sign. Cuts depend on the characters near them alone, so that an edit alters its own
piece and the ones beside it.

Defined results: null and empty arrays have no length and no piece; null contents are empty lines; lines come in the order of
their numbers (null numbers first, ties as delivered); a chunk_id delivered again counts once; a piece never exceeds the
limit; of the whole piece before, as many last lines are repeated as leave room for the next line (for some of it, where it is
longer than a piece), and none where the cut falls inside a line; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlake.runtime import ship_package

#: Least size of a piece and mean distance of landmarks, as shares of the limit.
LEAST_SHARE, LANDMARK_SHARE = 0.4, 0.2
#: How far from its landmark a cut may lie, as a share of the limit, to stand before a definition or hunk rather than any line.
SNAP_SHARE = 0.25
WINDOW = 32

DEFINITION = re.compile(
    r"\s*(?:(?:export|public|private|protected|internal|static|final|abstract|async|default|override|sealed|partial)\s+)*"
    r"(?:def|class|function|func|fn|interface|struct|enum|record|trait|impl|module|namespace|type|create\s+table|@\w+)\b",
    re.IGNORECASE,
)
_gear: list[np.ndarray] = []


def rolling_hash(cp: np.ndarray) -> np.ndarray:
    """At each place, a hash of the 32 characters that end there."""
    if not _gear:
        _gear.append(np.random.Generator(np.random.PCG64(97)).integers(0, 2**32, 1 << 16, dtype=np.uint32))
    g = _gear[0][(cp ^ (cp >> 16)) & 0xFFFF]
    h = g.copy()
    for k in range(1, min(WINDOW, len(g))):
        h[k:] += g[:-k] << np.uint32(k)
    return h


def line_ranks(lines: list[str], numbers: list[int | None]) -> list[int]:
    """How natural a cut before each line is: 3 before a definition or hunk, 2 after a blank or closing line, 1 elsewhere."""
    ranks = [0]
    for k in range(1, len(lines)):
        a, b = numbers[k - 1], numbers[k]
        if a is not None and b is not None and b - a > 1 or DEFINITION.match(lines[k]):
            ranks.append(3)
        elif not lines[k - 1].strip() or lines[k - 1].strip() in ("}", "};", "end", ");", "]", "]);", "})", "});"):
            ranks.append(2)
        else:
            ranks.append(1)
    return ranks


def split(lines: list[str], numbers: list[int | None], limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """Pieces (first line, last line, repeated lines, text) of lines joined by line feeds; the whole text if it fits."""
    text = "\n".join(lines)
    n = len(text)
    if n <= limit:
        return [(0, len(lines) - 1, 0, text)] if lines else []
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    landmarks = np.flatnonzero(rolling_hash(cp) % np.uint32(max(2, int(limit * LANDMARK_SHARE))) == 0)
    begins = np.cumsum([0] + [len(x) + 1 for x in lines[:-1]])
    ranks = np.array(line_ranks(lines, numbers))
    out: list[tuple[int, int, int, str]] = []
    at, reach = 0, max(1, int(limit * SNAP_SHARE))
    before = ""
    while at < n:
        repeated: list[str] = []
        if before and overlap and at in begins:
            repeated = before.split("\n")[-overlap:]
            # the next line still fits whole, or any of it where it is too long for a piece of its own
            line = int(begins[k]) - 1 - at if (k := int(np.searchsorted(begins, at, side="right"))) < len(begins) else n - at
            while repeated and len("\n".join(repeated)) + 1 + (max(line, 1) if line <= limit else 1) > limit:
                repeated = repeated[1:]
        head = "\n".join(repeated) + "\n" if repeated else ""
        room = limit - len(head)
        if n - at <= room:
            end = n
        else:
            least = at + max(1, int(room * LEAST_SHARE))
            most = min(at + room, max(least + 1, n - (least - at)))  # the last piece isn't a scrap
            k = int(np.searchsorted(landmarks, least))
            aim = int(landmarks[k]) if k < len(landmarks) and landmarks[k] < most else most
            # a cut before line k ends the piece at the line feed before it, which is not kept
            i, j = int(np.searchsorted(begins, least)), int(np.searchsorted(begins, most + 1, side="right"))
            whole = int(np.searchsorted(begins, min(at + room + 1, n - 1), side="right")) - 1
            if j <= i and begins[whole] > at:
                end = int(begins[whole])  # no line is cut while one fits whole
            elif j > i:
                # the nearest boundary of the best kind within reach of the landmark, else the nearest of any kind
                away = np.abs(begins[i:j] - aim)
                near = away <= reach
                kind = ranks[i:j] == (ranks[i:j][near].max() if near.any() else ranks[i:j])
                end = int(begins[i + int(np.argmin(np.where(kind & (near | ~near.any()), away, n + limit)))])
            else:
                marks = [m.end() + least for m in re.finditer(r"[\s;,){}\]>]", text[least:most])]
                end = min(marks, key=lambda x: abs(x - aim)) if marks else most
        body = text[at:end]
        cut = end < n and body.endswith("\n") and end in begins
        body = body[:-1] if cut else body
        first = int(np.searchsorted(begins, at, side="right")) - 1
        last = int(np.searchsorted(begins, max(at, end - 1), side="right")) - 1
        out.append((first, last, len(repeated), head + body))
        before, at = head + body, end
    return out


PIECES = "chunk_id long, piece_index int, pieces int, first_line int, last_line int, repeated_lines int, n_chars int, content string"


def split_oversized(chunks: DataFrame, limit: int, overlap: int) -> DataFrame:
    """The pieces of every chunk longer than limit. No shuffle but for chunk_ids delivered more than once."""
    ship_package(chunks.sparkSession)
    size = F.aggregate("changed_lines", F.lit(0).cast("long"), lambda s, x: s + F.coalesce(F.length(x["content"]), F.lit(0)) + 1) - 1
    long = (
        chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), "changed_lines")
        .where(F.col("chunk_id").isNotNull() & F.col("changed_lines").isNotNull() & (size > limit))
        .select("chunk_id", F.transform("changed_lines", lambda x: x["line_number"]).alias("numbers"), F.transform("changed_lines", lambda x: x["content"]).alias("contents"))
        .dropDuplicates(["chunk_id"])
    )

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            out: list[tuple] = []
            for i, numbers, contents in zip(*(rb.column(k).to_pylist() for k in range(3))):
                order = sorted(range(len(contents)), key=lambda k: (numbers[k] is not None, numbers[k] or 0, k))
                pieces = split([contents[k] or "" for k in order], [numbers[k] for k in order], limit, overlap)
                for p, (a, b, again, text) in enumerate(pieces):
                    number = lambda k: numbers[order[k]]
                    out.append((i, p, len(pieces), number(a), number(b), again, len(text), text))
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in PIECES.split(", ")])

    return long.mapInArrow(run, PIECES)


def found(chunks: DataFrame, limit: int, overlap: int) -> DataFrame:
    """(chunk_id) of the chunks that had to be split."""
    return split_oversized(chunks, limit, overlap).where("piece_index = 0 and pieces > 1").select("chunk_id")

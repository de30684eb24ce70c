"""Claims about code that the code itself can prove or refute: the callable named, repeated entries, reads before assignment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlake.operators.methods import callables
from patchlake.operators.syntax import matching
from patchlake.runtime import ship_package

_NAMED = re.compile(r"[`'\"]?([A-Za-z_$][\w$]*)[`'\"]?(?:\(\))?\s+(?:method|function|handler|callback|constructor)\b|\b(?:method|function|handler)\s+[`'\"]?([A-Za-z_$][\w$]*)", re.IGNORECASE)
_QUOTED = re.compile(r"[`'\"]([\w$./@:-]+)[`'\"]")


def _line_at(text: str, line: int) -> tuple[int, int]:
    """Where a line begins and ends in a text."""
    begin = 0
    for _ in range(line - 1):
        begin = text.find("\n", begin) + 1
        if not begin:
            return len(text), len(text)
    end = text.find("\n", begin)
    return begin, len(text) if end < 0 else end


def outside_callable(text: str, line: int, claim: str) -> bool:
    """Whether a claim names a callable that the text has, and the line stands in none of that name."""
    for m in _NAMED.finditer(claim):
        name = m[1] or m[2]
        mine = [(a, b) for a, b in callables(text) if re.search(rf"\b{re.escape(name)}\b", text[a : text.find("{", a)])]
        begin, end = _line_at(text, line)
        if mine and not any(a <= end and begin < b for a, b in mine):
            return True
    return False


def unrepeated(text: str, line: int, claim: str) -> bool:
    """Whether a claim of a repeated entry names one that stands less than twice in the brackets around the line."""
    if "duplicate" not in claim.lower() or not (quoted := _QUOTED.search(claim)):
        return False
    begin, end = _line_at(text, line)
    around = [(m.start(), close) for m in re.finditer(r"[\[{]", text[:end]) if (close := matching(text, m.start())) is not None and close >= begin]
    if not around:
        return False
    a, b = around[-1]
    name = re.escape(quoted[1])
    return len(re.findall(rf"[\"'`]{name}[\"'`]|(?<![\w-]){name}\s*:", text[a:b])) < 2


def absent(text: str, claim: str) -> bool:
    """Whether a claim names code in quotes, and the text holds none of it."""
    names = re.findall(r"`([A-Za-z_$][\w$.]*)(?:\(\))?`", claim)
    return bool(names) and not any(re.search(rf"(?<![\w$]){re.escape(n.rpartition('.')[2])}(?![\w$])", text) for n in names)


def assigned_first(text: str, claim: str) -> bool:
    """Whether a claim of a read before assignment names what the text assigns before its first other use."""
    low = claim.lower()
    if "before" not in low or not re.search(r"assign|initiali", low) or not (quoted := _QUOTED.search(claim)):
        return False
    name = re.escape(quoted[1])
    use = re.search(rf"\b{name}\b", text)
    return use is not None and re.match(rf"\b{name}\b\s*(?::[^=\n;]+)?=[^=]", text[use.start() :]) is not None


def refuted(findings: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """(seq, reasons) of findings that the whole text of their file refutes; a finding without line or text is refuted by none."""
    ship_package(findings.sparkSession)
    claim = F.concat_ws(" ", "issue", "suggestion")
    rows = findings.where("line_number is not null").select("seq", *keys, "line_number", claim.alias("claim"))
    # a text is read only where a claim has the words of a proof
    worth = F.lower("claim").rlike(r"`|\b(?:method|function|handler|callback|constructor|duplicate|before)\b")
    texts = files.where("text is not null").groupBy(*keys).agg(F.max("text").alias("text"))
    met = rows.where(worth).join(texts, keys).select("seq", "line_number", "claim", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            out = []
            for seq, line, said, text in zip(*(c.to_pylist() for c in rb.columns)):
                reasons = [r for r, hit in (("outside the callable named", outside_callable(text, line, said)), ("stands there once", unrepeated(text, line, said)), ("assigned before it is read", assigned_first(text, said)), ("names nothing in the file", absent(text, said))) if hit]
                if reasons:
                    out.append((seq, reasons))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([r for _, r in out], pa.list_(pa.string()))], ["seq", "reasons"])

    return met.withColumn("seq", F.col("seq").cast("long")).mapInArrow(run, "seq long, reasons array<string>")

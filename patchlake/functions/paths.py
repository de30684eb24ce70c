"""Path and rule keys. The normalisers differ on purpose and decide which rows meet in joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a line end is, beyond CR and LF.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def strip(c: Column | str) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"(?U)^\s+|\s+$", "")


def slashes(c: Column | str) -> Column:
    return F.replace(F.col(c) if isinstance(c, str) else c, F.lit("\\"), F.lit("/"))


def plain_path(c: Column | str) -> Column:
    """The key of a file: slashes, no leading ./; null stays null."""
    return F.regexp_replace(slashes(c), r"^(\./)+", "")


def dedup_path(c: Column | str) -> Column:
    """The key under which findings are compared: stripped, slashes, lower case."""
    return F.lower(slashes(strip(c)))


def project_path(c: Column | str) -> Column:
    """The key for project roots: no leading ./, no outer slashes, "." for nothing."""
    bare = F.regexp_replace(F.regexp_replace(strip(slashes(c)), r"^(\./)+", ""), r"^/+|/+$", "")
    return F.when(bare == "", ".").otherwise(bare)


def rule_key(c: Column | str) -> Column:
    """A rule id as a token: lower case, one hyphen for each run of blanks, underscores and hyphens, none at the ends."""
    low = F.lower(strip(c))
    return F.regexp_replace(F.regexp_replace(low, r"(?U)[\s_-]+", "-"), r"^-+|-+$", "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The last suffix of the name in lower case, "" for none; a name's own leading dot begins no suffix."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.](\.[^.]+)$", 1))


def split_lines(c: Column | str) -> Column:
    """The lines of a text at any line end; an empty text has none, a trailing line end adds none; null gives null."""
    parts = F.split(F.col(c) if isinstance(c, str) else c, LINE_END)
    last = F.element_at(parts, -1)
    return F.when(last == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def text_tokens(c: Column) -> Column:
    """Tokens of a text by four characters, rounded up; null and empty give 0."""
    return F.coalesce(F.ceil(F.length(c) / 4), F.lit(0)).cast("int")


def line_tokens(c: Column) -> Column:
    """Tokens of a changed line by three characters, with what its number costs in a prompt."""
    return (F.greatest(F.lit(1), F.ceil(F.length(c) / 3)) + 4).cast("int")

"""What connectors and models return, as rows: JSON answers whole or cut off, change flags, encoded contents, patches made of two texts."""

from __future__ import annotations

import difflib
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a change entry.
FLAGS = {1: "add", 2: "edit", 4: "encoding", 8: "rename", 16: "delete", 32: "undelete", 64: "branch", 128: "merge", 256: "lock", 512: "rollback", 1024: "sourcerename", 2048: "targetrename", 4096: "property"}
ANSWER = "struct<findings:array<struct<file_path:string,line_number:int,severity:string,rule_id:string,message:string,suggestion:string>>>"
#: Findings of one answer that are taken.
TAKEN = 3


def json_text(answer: Column) -> Column:
    """The JSON of an answer: without code fences, from the first brace to the last."""
    bare = F.regexp_replace(F.regexp_replace(answer, r"(?i)```(?:json)?", ""), r"^\s+|\s+$", "")
    return F.regexp_extract(bare, r"(?s)\{.*\}", 0)


#: Strings whole (so that brackets in them don't count), brackets, and what a broken string leaves.
_SIGNS = re.compile(r'"(?:[^"\\]|\\.)*"|[][{}]|"', re.DOTALL)


def whole_objects(text: str | None) -> list[str] | None:
    """The texts of the objects in the findings array of an answer that breaks off inside it.

    None where there is no such array, where it is closed after all (then something else is wrong with the answer), where a
    value in it is no object, and where no object is whole.
    """
    head = re.search(r'\{\s*"findings"\s*:\s*\[', text or "")
    if not head:
        return None
    spans, depth, begin = [], 0, 0
    between = head.end()
    for m in _SIGNS.finditer(text, head.end()):
        sign = m[0]
        if depth == 0 and (sign != "{" or text[between : m.start()].strip(" \t\r\n,")):
            if sign == "]" and not text[between : m.start()].strip(" \t\r\n,"):
                return None
            break
        if sign in "{[":
            if depth == 0:
                begin = m.start()
            depth += 1
        elif sign in "]}":
            depth -= 1
            if depth == 0:
                spans.append(text[begin : m.end()])
                between = m.end()
        elif sign == '"':
            break
    return spans or None


@F.pandas_udf(T.StringType())
def recovered(answers: pd.Series) -> pd.Series:
    """The whole objects of a findings array that breaks off, as JSON, up to the first that is none; else null."""

    def one(text: str | None) -> str | None:
        out = []
        for span in whole_objects(text) or ():
            try:
                out.append(json.loads(span))
            except ValueError:
                break
        return json.dumps({"findings": out}) if out else None

    return answers.map(one)


def answered(answers: DataFrame, keys: list[str], column: str = "answer") -> DataFrame:
    """(keys..., n, the fields of a finding): the first TAKEN findings of each answer that fit the schema.

    The JVM parses whole answers; only those it can't parse go to Python.
    """
    text = json_text(F.col(column))
    whole = answers.select(*keys, column, F.from_json(text, ANSWER).alias("a"))
    cut = F.col("a").isNull() | F.col("a.findings").isNull()
    good = whole.where(~cut).select(*keys, "a")
    rest = whole.where(cut).select(*keys, F.from_json(recovered(column), ANSWER).alias("a")).where("a.findings is not null")
    rows = good.union(rest).select(*keys, F.posexplode(F.slice("a.findings", 1, TAKEN)).alias("n", "f")).select(*keys, "n", "f.*")
    return rows.where("line_number > 0 and trim(rule_id) <> '' and trim(message) <> '' and lower(severity) in ('critical', 'high', 'medium', 'low', 'suggestion')").withColumn("severity", F.lower("severity"))


@F.pandas_udf(T.StringType())
def lenient_json(texts: pd.Series) -> pd.Series:
    """Text that is JSON as it stands; else without comments and trailing commas, which inside strings are kept."""
    sign = re.compile(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?(?:\*/|$)|,(?=(?:\s|//[^\n]*\n|/\*.*?\*/)*[}\]])', re.DOTALL)

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            json.loads(text)
            return text
        except ValueError:
            return sign.sub(lambda m: m[1] or "", text)

    return texts.map(one)


def version(text: Column) -> Column:
    """[major, minor, patch] of a version, missing parts 0; null where no number stands."""
    part = lambda k: F.coalesce(F.expr("cast(null as int)"), F.when(F.regexp_extract(text, r"(\d+)(?:\.(\d+))?(?:\.(\d+))?", k) != "", F.regexp_extract(text, r"(\d+)(?:\.(\d+))?(?:\.(\d+))?", k).cast("int")).otherwise(0))
    return F.when(text.rlike(r"\d"), F.array(part(1), part(2), part(3)))


def flags(bits: Column) -> Column:
    """The names of the bits that are set."""
    return F.array_compact(F.array(*(F.when(bits.bitwiseAND(b) != 0, n) for b, n in FLAGS.items())))


def flag_words(text: Column) -> Column:
    """The names in a delimited string, in lower case, but for none and all."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0)), F.lower), lambda x: ~x.isin("none", "all")))


def status(names: Column) -> Column:
    """removed before renamed before added before modified."""
    has = lambda *x: F.arrays_overlap(names, F.array(*map(F.lit, x)))
    return F.when(has("delete"), "removed").when(has("rename", "sourcerename", "targetrename"), "renamed").when(has("add", "undelete"), "added").otherwise("modified")


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """The text of base64, malformed bytes replaced; nothing gives an empty text."""
    import base64

    return content.map(lambda x: base64.b64decode(x or "").decode("utf-8", "replace"))


@F.pandas_udf(T.StringType())
def patch_of(old: pd.Series, new: pd.Series, path: pd.Series) -> pd.Series:
    """The unified patch from one text to another with three lines of context; null where they are equal."""

    def one(a: str | None, b: str | None, p: str | None) -> str | None:
        return "\n".join(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), f"a/{p}", f"b/{p}", lineterm="")) or None

    return pd.Series([one(*x) for x in zip(old, new, path)], dtype=object)


def latest_iteration(entries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., iteration, commit): the last iteration of each change-set, its commit from either of two places."""
    return entries.groupBy(*keys).agg(F.max("iteration").alias("iteration"), F.max_by(F.coalesce("commit", "source_commit"), "iteration").alias("commit"))

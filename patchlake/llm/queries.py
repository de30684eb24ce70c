"""The queries of this folder, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from patchlake.llm import abuse, corpus_ids, leakage, near_records, packing, residue, secrets, split_pieces, written_source
from patchlake.runtime import spread
from patchlake.runtime import table as scanned


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt to all cores where it is small."""
    return spread(scanned(spark, sf_dir, name))


def budget(spark: SparkSession, sf_dir: str, name: str) -> int:
    """One amount of review_budgets (3 rows at every scale)."""
    return int(scanned(spark, sf_dir, "review_budgets").where(f"budget = '{name}'").first()["amount"])


def _limits(spark: SparkSession, d: str) -> tuple[int, int]:
    return budget(spark, d, "chunk_max_chars"), budget(spark, d, "chunk_overlap_lines")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return written_source.found(table(spark, d, "changed_files"))


def p1_skipped(spark: SparkSession, d: str) -> DataFrame:
    return written_source.skipped_by_reason(table(spark, d, "changed_files"), table(spark, d, "review_diagnostics"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return split_pieces.found(table(spark, d, "review_chunks"), *_limits(spark, d))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_pieces.split_oversized(table(spark, d, "review_chunks"), *_limits(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near_records.record_pairs(table(spark, d, "python_findings_manifest"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_records.groups(table(spark, d, "python_findings_manifest"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.found(table(spark, d, "changed_files"))


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.redacted(table(spark, d, "changed_files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.found(table(spark, d, "review_contexts"), budget(spark, d, "batch_capacity_tokens"))


def p5_batches(spark: SparkSession, d: str) -> DataFrame:
    return packing.batches(table(spark, d, "review_contexts"), budget(spark, d, "batch_capacity_tokens"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.found(table(spark, d, "python_findings_manifest"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return corpus_ids.encode_corpus(table(spark, d, "documents"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    return corpus_ids.decode_corpus(corpus_ids.encode_corpus(table(spark, d, "documents")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.found(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.found(table(spark, d, "documents"), table(spark, d, "doc_labels"))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scores(table(spark, d, "documents"), table(spark, d, "doc_labels"))


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(table(spark, d, "documents"), table(spark, d, "doc_labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_skipped, p2_found, p2_pieces, p3_found, p3_groups, p4_found, p4_redacted, p5_found, p5_batches, p6_found, p7_ids, p7_decoded, p8_found, p8_items, p9_found, p9_scores, p9_rates)
}

_LIMIT = "(select amount from review_budgets where budget = '{}')"

SQL: dict[str, str] = {
    "p2_found": f"""
        select distinct chunk_id from review_chunks
        where length(array_to_string([coalesce(x.content, '') for x in changed_lines], chr(10))) > {_LIMIT.format("chunk_max_chars")}""",
    "p3_found": r"""
        with r as (select distinct manifest_id, lower(concat_ws(' ', rule, issue, suggestion)) t from python_findings_manifest),
        c as (select manifest_id, w, count(*) c from (select manifest_id, unnest(regexp_extract_all(t, '[\p{L}\p{N}]+')) w from r) group by all),
        n as (select manifest_id, sum(c) n from c group by all),
        p as (select a.manifest_id a, b.manifest_id b, sum(least(a.c, b.c)) o from c a join c b on a.w = b.w and a.manifest_id < b.manifest_id group by all)
        select a manifest_id_a, b manifest_id_b from p join n x on x.manifest_id = a join n y on y.manifest_id = b where o >= 0.7 * (x.n + y.n - o) - 1e-9""",
    "p7_decoded": "select distinct doc_id, coalesce(text, '') as text from documents",
    "p5_found": f"""
        select distinct context_id from review_contexts
        where coalesce(estimated_tokens, ceil(content_chars / 4.0)) > {_LIMIT.format("batch_capacity_tokens")}""",
}

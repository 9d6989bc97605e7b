"""Queries of the training-data operators; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from daftar.llm import answer_defects, eval_leaks, lookalikes, mixing, mojibake, pieces, scan_noise, site_lines, split_overlap, vector_neighbors
from daftar.llm.sql import SQL  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(s: SparkSession, d: str) -> DataFrame:
    return split_overlap.found(_t(s, d, "qa_pairs"))


@query
def p1_report(s: SparkSession, d: str) -> DataFrame:
    return split_overlap.report(_t(s, d, "qa_pairs"))


@query
def p1_records(s: SparkSession, d: str) -> DataFrame:
    return split_overlap.records(_t(s, d, "qa_pairs"))


@query
def p8_found(s: SparkSession, d: str) -> DataFrame:
    return eval_leaks.found(_t(s, d, "documents"), _t(s, d, "eval_items"))


@query
def p8_report(s: SparkSession, d: str) -> DataFrame:
    return eval_leaks.report(_t(s, d, "documents"), _t(s, d, "eval_items"))


@query
def p2_found(s: SparkSession, d: str) -> DataFrame:
    return vector_neighbors.found(_t(s, d, "vectors"))


@query
def p2_neighbours(s: SparkSession, d: str) -> DataFrame:
    return vector_neighbors.neighbours(_t(s, d, "vectors"))


@query
def p6_found(s: SparkSession, d: str) -> DataFrame:
    return site_lines.found(_t(s, d, "chunks"))


@query
def p6_lines(s: SparkSession, d: str) -> DataFrame:
    return site_lines.report(_t(s, d, "chunks"))


@query
def p6_clean(s: SparkSession, d: str) -> DataFrame:
    return site_lines.clean(_t(s, d, "chunks"))


@query
def p3_found(s: SparkSession, d: str) -> DataFrame:
    return answer_defects.found(_t(s, d, "qa_pairs"))


@query
def p3_report(s: SparkSession, d: str) -> DataFrame:
    return answer_defects.report(_t(s, d, "qa_pairs"))


@query
def p4_found(s: SparkSession, d: str) -> DataFrame:
    return lookalikes.found(_t(s, d, "qa_pairs"))


@query
def p4_normalised(s: SparkSession, d: str) -> DataFrame:
    return lookalikes.normalised(_t(s, d, "qa_pairs").select("row_id", "question", "context"), ["question", "context"])


@query
def p4_groups(s: SparkSession, d: str) -> DataFrame:
    return lookalikes.groups(_t(s, d, "qa_pairs"), "question", "context")


@query
def p4_members(s: SparkSession, d: str) -> DataFrame:
    return lookalikes.members(_t(s, d, "qa_pairs"), "question", "context")


@query
def p10_found(s: SparkSession, d: str) -> DataFrame:
    return mojibake.found(_t(s, d, "documents"))


@query
def p10_restored(s: SparkSession, d: str) -> DataFrame:
    return mojibake.restored(_t(s, d, "documents"))


@query
def p5_found(s: SparkSession, d: str) -> DataFrame:
    return pieces.found(_t(s, d, "chunks"), _t(s, d, "sources"), _t(s, d, "split_limits"))


@query
def p5_pieces(s: SparkSession, d: str) -> DataFrame:
    return pieces.numbered(_t(s, d, "chunks"), _t(s, d, "sources"), _t(s, d, "split_limits"))


@query
def p7_found(s: SparkSession, d: str) -> DataFrame:
    return scan_noise.found(_t(s, d, "chunks"), _t(s, d, "qa_pairs"), _t(s, d, "sources"))


@query
def p7_repaired(s: SparkSession, d: str) -> DataFrame:
    return scan_noise.repaired(_t(s, d, "chunks"), _t(s, d, "qa_pairs"), _t(s, d, "sources"))


@query
def p9_mixture(s: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(_t(s, d, "documents"), _t(s, d, "mix_targets"))


@query
def p9_shares(s: SparkSession, d: str) -> DataFrame:
    return mixing.shares(_t(s, d, "documents"), _t(s, d, "mix_targets"))

"""Queries of this subpackage over the job and document tables, with their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobweft.llm.canonical import map_to_canonical
from jobweft.llm.entity_linking import link_names, same_entity_pairs
from jobweft.llm.leakage import leaked_items, leaked_passages
from jobweft.llm.near_duplicates import near_duplicate_groups, near_duplicate_pairs
from jobweft.llm.packing import pack_report, pack_texts
from jobweft.llm.pii import find_personal, redact_personal
from jobweft.llm.sql import SQL
from jobweft.session import table


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return same_entity_pairs(table(spark, sf, "companies"))


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    return link_names(table(spark, sf, "companies"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicate_pairs(table(spark, sf, "jobs")).select("id_a", "id_b")


def p6_groups(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf, "jobs"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return map_to_canonical(table(spark, sf, "jobs"), table(spark, sf, "canonical_values"))


def p8_packed(spark: SparkSession, sf: str) -> DataFrame:
    return pack_texts(table(spark, sf, "documents"), table(spark, sf, "pack_sizes"))


def p8_summary(spark: SparkSession, sf: str) -> DataFrame:
    return pack_report(table(spark, sf, "documents"), table(spark, sf, "pack_sizes"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id")


def p9_passages(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_passages(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return find_personal(table(spark, sf, "documents"))


def p10_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return redact_personal(table(spark, sf, "documents"), spark.conf.get("spark.jobweft.pii.secret", "set spark.jobweft.pii.secret to a secret of your own"))


QUERIES = {"p5_found": p5_found, "p5_groups": p5_groups, "p6_found": p6_found, "p6_groups": p6_groups, "p7_found": p7_found, "p8_packed": p8_packed, "p8_summary": p8_summary, "p9_found": p9_found, "p9_passages": p9_passages, "p10_found": p10_found, "p10_redacted": p10_redacted}
__all__ = ["QUERIES", "SQL"]

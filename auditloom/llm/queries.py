"""Queries over the operators for training text, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditloom.llm import boilerplate as B
from auditloom.llm import leakage as L
from auditloom.llm import neardup as N
from auditloom.llm import packing as K
from auditloom.llm import quality as Q
from auditloom.llm import residue as R
from auditloom.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return B.main_lines(table(spark, d, "pages"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return N.near_duplicate_pairs(table(spark, d, "pages"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return N.near_duplicate_groups(table(spark, d, "pages"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return R.residue(table(spark, d, "pages")).select("seq").distinct()


def p3_kinds(spark: SparkSession, d: str) -> DataFrame:
    return R.residue(table(spark, d, "pages"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return K.containers(table(spark, d, "documents"))


def p8_summary(spark: SparkSession, d: str) -> DataFrame:
    return K.packing_summary(p8_containers(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return L.leaked_items(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p9_paraphrases(spark: SparkSession, d: str) -> DataFrame:
    return L.paraphrased_items(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return Q.not_prose(table(spark, d, "documents")).select("doc_id").distinct()


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return Q.text_statistics(table(spark, d, "documents"))


def p10_outlierness(spark: SparkSession, d: str) -> DataFrame:
    return Q.outlierness(table(spark, d, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p3_found": p3_found,
    "p3_kinds": p3_kinds,
    "p8_containers": p8_containers,
    "p8_summary": p8_summary,
    "p9_found": p9_found,
    "p9_paraphrases": p9_paraphrases,
    "p10_found": p10_found,
    "p10_statistics": p10_statistics,
    "p10_outlierness": p10_outlierness,
}
SQL: dict[str, str] = {
    "p9_found": r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
        b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
        dg AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 14], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 13)) AS i FROM d)),
        bg AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 14], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 13)) AS i FROM b))
        SELECT DISTINCT doc_id, item_id FROM dg JOIN bg ON dg.g = bg.g""",
}

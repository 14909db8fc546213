"""The register of the core's queries, and inputs that several of them share, as DataFrames and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sources.readers import latest
from .storage import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

REF = "ref AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM reference_answer) WHERE rn = 1 AND question_id IS NOT NULL)"
RES = "res AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM answer_result) WHERE rn = 1 AND result_id IS NOT NULL)"
PAGE = "page AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY loaded_at DESC NULLS LAST) AS rn FROM extracted_page) WHERE rn = 1 AND doc_id IS NOT NULL AND page_number IS NOT NULL)"
CHUNK = "chunk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM chunk_record) WHERE rn = 1 AND chunk_id IS NOT NULL)"


def query(sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "reference_answer"), "question_id")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "answer_result"), "result_id")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "extracted_page"), "doc_id", "page_number")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "chunk_record"), "chunk_id")

"""Sinks: JSON Lines, per-document Markdown, ledgers, the run summary with upsert, submissions and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def document_markdown(pages: DataFrame) -> DataFrame:
    """doc_id and markdown: every page of a document under a heading with its number, in page order."""
    part = F.concat(F.lit("## Page "), F.col("page_number").cast("string"), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    rows = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", part.alias("part")))).alias("parts"))
    return rows.select("doc_id", F.array_join(F.transform("parts", lambda x: x["part"]), "\n\n").alias("markdown"))


def fixed_decimals(x: Column) -> Column:
    """A float as ledgers print it, with twelve decimals."""
    return F.format_string("%.12f", x)


def summary_upsert(old: DataFrame, new: DataFrame, key: str = "run_id") -> DataFrame:
    """old with the rows of new's keys replaced by new's; a writer orders by key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def trace_name(question_id: Column) -> Column:
    """File name of a question's trace: its cleaned id of at most 48 characters and twelve digits of its digest."""
    return F.concat(F.substring(F.regexp_replace(question_id, "[^A-Za-z0-9._-]+", "_"), 1, 48), F.lit("__"), F.substring(F.sha2(question_id, 256), 1, 12), F.lit(".json"))


def submission(answers: DataFrame, *columns: str) -> DataFrame:
    """run_id and the payload of its answers as one JSON object, in the order of question_id."""
    rows = answers.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("question_id", *[c for c in columns if c != "question_id"]))).alias("answers"))
    return rows.select("run_id", F.to_json(F.struct("answers"), {"ignoreNullFields": "false"}).alias("payload"), F.size("answers").alias("n_answers"))

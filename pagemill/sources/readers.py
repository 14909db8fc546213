"""Sources: rows as delivered, the latest delivery of each key, files, and what is derived from them directly."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest(rows: DataFrame, *keys: str, by: str = "loaded_at") -> DataFrame:
    """The last delivery of each key; rows with a NULL in a key are left out. The row limit is applied before the shuffle too."""
    named = rows.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    return named.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(by)))).where("_at = 1").drop("_at")


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One record a line, lines ending in LF only; a record that doesn't fit fails the job, fields outside the schema too."""
    found = spark.read.option("lineSep", "\n").json(path)
    unknown = sorted(set(found.columns) - set(schema.names))
    if unknown:
        raise ValueError(f"unknown fields: {', '.join(unknown)}")
    return spark.read.schema(schema).option("lineSep", "\n").option("mode", "FAILFAST").json(path)


def json_records(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """Records of a .jsonl file, of a JSON array, or of an object that holds them under the first of keys that it has."""
    if path.endswith(".jsonl"):
        return spark.read.option("lineSep", "\n").json(path)
    whole = spark.read.option("multiLine", True).json(path)
    for k in keys:
        if k in whole.columns:
            return whole.select(F.explode(k).alias("_r")).select("_r.*")
    return whole


def delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A delimited file with a header, every column a string; a missing file has no rows."""
    if "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], T.StructType([]))
    return spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)


def page_registry(pages: DataFrame) -> DataFrame:
    """doc_id and page_count, the highest page number."""
    return pages.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("page_number").alias("page_count"))


def reloaded_text(text: Column, mode: Column) -> Column:
    """Page text with block boundaries: lines of an OCR page that aren't blank become paragraphs, other text stays."""
    return F.when(mode == "ocr", F.array_join(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), "\n\n")).otherwise(text)


def extraction_route(text: Column, least: int = 50) -> Column:
    """native where a page has at least `least` characters besides outer white space, else ocr."""
    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) < least, "ocr").otherwise("native")

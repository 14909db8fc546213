"""Merging and fusing ranked candidates: (qid, chunk_id) rows with dense and sparse scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import signal

RRF_K = 60
ENTITY_BOOST, TITLE_BOOST, MOST_BOOST = 0.18, 0.12, 0.72


def merged_hits(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """(qid, chunk_id, dense_score, sparse_score, retrieval_score): the hits of both channels, their scores added."""
    both = dense.select("qid", "chunk_id", F.col("score").alias("dense_score")).join(sparse.select("qid", "chunk_id", F.col("score").alias("sparse_score")), ["qid", "chunk_id"], "full_outer")
    return both.withColumn("retrieval_score", F.round(F.coalesce("dense_score", F.lit(0.0)) + F.coalesce("sparse_score", F.lit(0.0)), 6))


def signals_match(candidate: Column, wanted: Column) -> Column:
    """How many wanted signals contain a candidate signal or are contained in one."""
    return F.size(F.filter(wanted, lambda t: F.exists(candidate, lambda s: s.contains(t) | t.contains(s))))


def metadata_boost(entities: Column, titles: Column, candidate: Column) -> Column:
    """0.18 for each matching entity and 0.12 for each title cue, at most 0.72; all arguments are arrays of raw signals."""

    def clean(x: Column) -> Column:
        return F.array_distinct(F.filter(F.transform(x, signal), lambda s: s.isNotNull() & (s != "")))

    return F.round(F.least(ENTITY_BOOST * signals_match(clean(candidate), clean(entities)) + TITLE_BOOST * signals_match(clean(candidate), clean(titles)), F.lit(MOST_BOOST)), 6)


def top(rows: DataFrame, k: int, score: str) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc(score), "chunk_id")
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def channel_rank(score: Column, order_by: Column) -> Column:
    """1 for the highest score of a query, of equal ones the lowest id; NULL for none."""
    window = Window.partitionBy("qid").orderBy(F.desc_nulls_last(score), order_by)
    return F.when(score.isNotNull(), F.row_number().over(window))


def reciprocal_ranks(rows: DataFrame, fallback: bool = True) -> DataFrame:
    """rows with dense_rank, sparse_rank, best_rank, rank_sum and the fused retrieval_score, which replaces the raw one.

    With fallback, a candidate without a dense score is ranked in the dense list by its raw score.
    """
    dense = F.coalesce("dense_score", "retrieval_score") if fallback else F.col("dense_score")
    out = rows.withColumn("dense_rank", channel_rank(dense, F.col("chunk_id"))).withColumn("sparse_rank", channel_rank(F.col("sparse_score"), F.col("chunk_id")))
    part = lambda r: F.coalesce(1.0 / (RRF_K + F.col(r)), F.lit(0.0))
    out = out.withColumn("retrieval_score", F.round(part("dense_rank") + part("sparse_rank"), 6))
    out = out.withColumn("best_rank", F.least("dense_rank", "sparse_rank")).withColumn("rank_sum", F.coalesce("dense_rank", F.lit(0)) + F.coalesce("sparse_rank", F.lit(0)))
    order = Window.partitionBy("qid").orderBy(F.desc("retrieval_score"), "best_rank", "rank_sum", "chunk_id")
    return out.withColumn("rank", F.row_number().over(order))


def fused_channels(dense: DataFrame, sparse: DataFrame, k: int) -> DataFrame:
    """(qid, chunk_id, score, rank): both channels' ranks fused without a merge of scores, the k best of each query."""
    both = dense.select("qid", "chunk_id", "rank").unionByName(sparse.select("qid", "chunk_id", "rank"))
    scored = both.groupBy("qid", "chunk_id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 6).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_of_queries(rows: DataFrame, group: str, identity: str = "chunk_id", score: str = "score", position: str = "position") -> DataFrame:
    """Of each group (a question with its further wordings) and candidate the row of the highest score, of equal ones the first wording's."""
    order = Window.partitionBy(group, identity).orderBy(F.desc(score), position)
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")

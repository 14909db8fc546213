"""Hybrid retrieval: both channels over-fetched, merged, boosted, cut, and only then fused by rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fusion, search


def hybrid_retrieval(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 24, size: int = 64, over_fetch: int = 3) -> DataFrame:
    """The k best chunks of each query (qid, text, query vector), fused over the dense and the lexical channel.

    chunks has chunk_id, doc_id and text, one row a chunk; vectors has chunk_id and vectors. Queries are a stated set that
    every task holds; texts are joined to candidates alone, of which each query has at most 2 * over_fetch * k.
    """
    dense = search.dense_top(vectors, queries.select("qid", "query"), over_fetch * k, "chunk_id", "vectors", size)
    sparse = search.lexical_top(chunks, queries.select("qid", F.col("text").alias("query")), over_fetch * k)
    candidates = fusion.merged_hits(dense, sparse)
    asked = queries.select("qid", T.statutes(F.col("text")).alias("laws"), T.case_numbers(F.col("text")).alias("cases"), T.title_cues(F.col("text")).alias("titles"))
    boosted = candidates.join(chunks.select("chunk_id", "doc_id", "text"), "chunk_id").join(F.broadcast(asked), "qid")
    boost = fusion.metadata_boost(F.concat("cases", "laws"), F.col("titles"), F.array("doc_id", "text"))
    boosted = boosted.withColumn("boost", boost).withColumn("retrieval_score", F.round(F.col("retrieval_score") + F.col("boost"), 6))
    fused = fusion.reciprocal_ranks(fusion.top(boosted.drop("text", "laws", "cases", "titles"), k, "retrieval_score"))
    return fused.select("qid", "chunk_id", "dense_score", "sparse_score", "boost", "dense_rank", "sparse_rank", "retrieval_score", "rank")

"""Lexical and dense search of a stated set of queries against all rows, in blocks.

The queries (bounded: MOST_QUERY_TERMS postings, MOST_QUERY_VALUES numbers) go to every task; each Arrow batch of rows is
scored against all of them with matrix products and only its best k rows a query leave the task, so neither texts nor
vectors nor full score tables are shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B = 1.5, 0.75
#: Query terms, and numbers of query vectors, that are sent to every task at most.
MOST_QUERY_TERMS, MOST_QUERY_VALUES = 5_000_000, 20_000_000
#: Queries that are scored at once.
QUERY_BLOCK = 256
#: Decimals of a score; ties behind them are broken by id.
DECIMALS = 6
TOKEN = re.compile("[a-z0-9]+")


def corpus_statistics(rows: DataFrame, text: str = "text") -> DataFrame:
    """One row: n texts and avgdl, the mean of their token counts, each counting as one at least."""
    length = F.greatest(F.size(tokens(F.coalesce(text, F.lit("")))), F.lit(1))
    return rows.agg(F.count("*").alias("n"), F.avg(length).alias("avgdl"))


def term_counts(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, tf, dl) of every distinct term of every text; a text's terms are counted where it lies, before the shuffle."""
    toks = tokens(F.coalesce(text, F.lit("")))
    each = rows.select(key, F.greatest(F.size(toks), F.lit(1)).alias("dl"), F.explode(toks).alias("term"))
    return each.groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))


def document_frequencies(rows: DataFrame, vocabulary: DataFrame, text: str = "text") -> DataFrame:
    """(term, df) of the vocabulary's terms; of each task one row a term is shuffled."""
    each = rows.select(F.explode(F.array_distinct(tokens(F.coalesce(text, F.lit(""))))).alias("term"))
    return each.join(F.broadcast(vocabulary), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))


def inverse_frequencies(counts: DataFrame, statistics: DataFrame) -> DataFrame:
    """(term, df, idf) of term counts; statistics is one row."""
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(statistics.select("n"))).select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def saturated(idf: str = "idf", tf: str = "tf", dl: str = "dl", avgdl: str = "avgdl"):
    tf = F.col(tf)
    return F.col(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col(dl) / F.col(avgdl)))


def term_weights(counts: DataFrame, frequencies: DataFrame, statistics: DataFrame) -> DataFrame:
    """counts with w, the saturated weight of each term; terms without a frequency are dropped."""
    return counts.join(frequencies.select("term", "idf"), "term").join(F.broadcast(statistics.select("avgdl"))).withColumn("w", saturated()).drop("avgdl")


def best(scored: DataFrame, k: int, query: str = "qid", row: str = "chunk_id", score: str = "score") -> DataFrame:
    """The k rows of each query with the highest scores, of equal ones those with the lowest ids."""
    order = Window.partitionBy(query).orderBy(F.desc(score), F.asc(row))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _cut(ids: np.ndarray, scores: np.ndarray, k: int, least: float | None) -> Iterator[tuple[int, np.ndarray]]:
    """Of each column of scores the rows that can be among its k best."""
    for j in range(scores.shape[1]):
        s = scores[:, j]
        at = np.arange(len(s)) if least is None else np.flatnonzero(s > least)
        if len(at) > k:
            edge = np.partition(s[at], len(at) - k)[len(at) - k]
            at = at[s[at] >= edge]
            if len(at) > k:
                at = at[np.lexsort((ids[at], -s[at]))[:k]]
        yield j, at


def lexical_top(rows: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(qid, key, score, rank): for each query (qid, query) its k best rows by the product of both saturated weights.

    Rows without a common term have no score. NULL texts count as empty. The corpus gives the frequencies and the mean length.
    """
    spark = rows.sparkSession
    statistics = corpus_statistics(rows, text)
    n, mean = statistics.first()
    asked = term_counts(queries.withColumnRenamed("query", "_q"), "qid", "_q")
    vocabulary = asked.select("term").distinct()
    postings = asked.join(document_frequencies(rows, vocabulary, text), "term").limit(MOST_QUERY_TERMS + 1).toPandas()
    if len(postings) > MOST_QUERY_TERMS:
        raise ValueError(f"more than {MOST_QUERY_TERMS} query terms: search in several sets of queries")
    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, {key} {rows.schema[key].dataType.simpleString()}, score double"
    if postings.empty:
        return best(spark.createDataFrame([], schema), k, row=key)
    idf = np.log(1 + (n - postings["df"] + 0.5) / (postings["df"] + 0.5))
    weights = idf * postings["tf"] * (K1 + 1) / (postings["tf"] + K1 * (1 - B + B * postings["dl"] / mean))
    terms = {t: i for i, t in enumerate(sorted(set(postings["term"])))}
    term_idf = np.zeros(len(terms))
    term_idf[postings["term"].map(terms)] = idf
    qids = sorted(set(postings["qid"]))
    column = {q: i for i, q in enumerate(qids)}
    shared = spark.sparkContext.broadcast((terms, term_idf, qids, postings["term"].map(terms).to_numpy(), postings["qid"].map(column).to_numpy(), weights.to_numpy()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms, term_idf, qids, at_term, at_query, weights = shared.value
        for batch in batches:
            ids = batch[key].to_numpy()
            found = []
            for t in batch[text]:
                toks = TOKEN.findall((t or "").lower())
                tf = {terms[w]: c for w, c in Counter(toks).items() if w in terms}
                at, c = np.fromiter(tf.keys(), np.int64, len(tf)), np.fromiter(tf.values(), float, len(tf))
                found.append((at, term_idf[at] * c * (K1 + 1) / (c + K1 * (1 - B + B * max(len(toks), 1) / mean))))
            for start in range(0, len(qids), QUERY_BLOCK):
                size = min(QUERY_BLOCK, len(qids) - start)
                dense = np.zeros((len(terms), size))
                inside = (at_query >= start) & (at_query < start + size)
                dense[at_term[inside], at_query[inside] - start] = weights[inside]
                scores = np.round(np.stack([w @ dense[at] for at, w in found]), DECIMALS) if found else np.zeros((0, size))
                for j, rows_at in _cut(ids, scores, k, 0.0):
                    if len(rows_at):
                        yield pd.DataFrame({"qid": qids[start + j], key: ids[rows_at], "score": scores[rows_at, j]})

    return best(spread(rows.select(key, text), key).mapInPandas(run, schema), k, row=key)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows in as many partitions as a shuffle has, by key: scoring is worth more tasks than the size of the rows would give."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def usable_vectors(rows: DataFrame, vector: str, size: int) -> DataFrame:
    """Rows whose vector has `size` numbers, no NULL or NaN among them, and isn't all zero."""
    v = F.col(vector)
    return rows.where((F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(v, lambda x: x != 0))


def dense_top(rows: DataFrame, queries: DataFrame, k: int, key: str, vector: str, size: int) -> DataFrame:
    """(qid, key, score, rank): for each query (qid, query vector) the k rows of the highest cosine, whatever the vectors' lengths."""
    spark = rows.sparkSession
    asked = usable_vectors(queries, "query", size).orderBy("qid").limit(MOST_QUERY_VALUES // size + 1).toPandas()
    if len(asked) * size > MOST_QUERY_VALUES:
        raise ValueError("too many query vectors: search in several sets of queries")
    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, {key} {rows.schema[key].dataType.simpleString()}, score double"
    if asked.empty:
        return best(spark.createDataFrame([], schema), k, row=key)
    q = np.stack(asked["query"].to_list()).astype(float)
    shared = spark.sparkContext.broadcast((asked["qid"].to_list(), q / np.linalg.norm(q, axis=1, keepdims=True)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, q = shared.value
        for batch in batches:
            if len(batch):
                x = np.stack(batch[vector].to_list()).astype(float)
                ids = batch[key].to_numpy()
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                for start in range(0, len(qids), QUERY_BLOCK):
                    scores = np.round(x @ q[start : start + QUERY_BLOCK].T, DECIMALS)
                    for j, at in _cut(ids, scores, k, None):
                        yield pd.DataFrame({"qid": qids[start + j], key: ids[at], "score": scores[at, j]})

    return best(usable_vectors(rows, vector, size).select(key, vector).mapInPandas(run, schema), k, row=key)

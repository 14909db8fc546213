"""Queries of search, fusion and candidate selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import CHUNK, REF, RES, chunks, query, references, results
from .functions import text as T
from .operators import fusion, search
from .plans.retrieval import hybrid_retrieval as hybrid_plan
from .storage import table

WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
BM25 = f"""tok AS (SELECT chunk_id, unnest({WORDS}) AS term FROM chunk),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM tok GROUP BY chunk_id, term),
dl AS (SELECT chunk_id, greatest(len({WORDS}), 1) AS dl FROM chunk),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
idf AS (SELECT term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, st GROUP BY term),
w AS (SELECT chunk_id, term, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS w FROM tf JOIN dl USING (chunk_id) JOIN idf USING (term), st)"""
SEARCH = f"""qtok AS (SELECT qid, unnest({WORDS}) AS term, greatest(len({WORDS}), 1) AS dl FROM q),
qw AS (SELECT qid, term, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS w FROM (SELECT qid, term, any_value(dl) AS dl, count(*) AS tf FROM qtok GROUP BY qid, term) JOIN idf USING (term), st),
sparse AS (SELECT qid, chunk_id, round(sum(qw.w * w.w), 6) AS score FROM qw JOIN w USING (term) GROUP BY qid, chunk_id),
sparse_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM sparse WHERE score > 0) WHERE rank <= 72)"""
ASKED = "q AS (SELECT DISTINCT question_id AS qid, question AS text FROM ref JOIN res USING (question_id) WHERE result_id % 50 = 0 AND question IS NOT NULL)"
GOOD = "len(vectors) = 64 AND len(list_filter(vectors, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vectors, lambda x: x <> 0)) > 0"
DENSE = f"""v AS (SELECT vec_id, chunk_id, CAST(vectors AS DOUBLE[]) AS v FROM chunk_vector WHERE {GOOD}),
dense_top AS (SELECT * FROM (SELECT a.vec_id AS qid, b.chunk_id, round(list_cosine_similarity(a.v, b.v), 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 6) DESC, b.chunk_id) AS rank
  FROM v a, v b WHERE a.vec_id % 50 = 0) WHERE rank <= 72)"""
EXAMPLES = "q AS (SELECT vec_id AS qid, text FROM v JOIN chunk USING (chunk_id) WHERE vec_id % 50 = 0)"
K, SIZE = 24, 64


def questions_asked(spark, sf_dir):
    """The query set: questions of the results whose id is divisible by 50."""
    asked = results(spark, sf_dir).where("result_id % 50 = 0").select("question_id").distinct()
    return references(spark, sf_dir).where("question IS NOT NULL").join(asked, "question_id", "left_semi").select(F.col("question_id").alias("qid"), F.col("question").alias("text"))


def examples(spark, sf_dir):
    """The query set of both channels: chunks whose vector's id is divisible by 50, by their text and vector."""
    picked = search.usable_vectors(table(spark, sf_dir, "chunk_vector").where("vec_id % 50 = 0"), "vectors", SIZE)
    return picked.join(chunks(spark, sf_dir).select("chunk_id", "text"), "chunk_id").select(F.col("vec_id").alias("qid"), "text", F.col("vectors").alias("query"))


def both_channels(spark, sf_dir):
    q = examples(spark, sf_dir)
    dense = search.dense_top(table(spark, sf_dir, "chunk_vector"), q, 3 * K, "chunk_id", "vectors", SIZE)
    return dense, search.lexical_top(chunks(spark, sf_dir), q.select("qid", F.col("text").alias("query")), 3 * K)


@query(f"WITH {CHUNK}, {BM25} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_idf(spark, sf_dir):
    """Document frequency and inverse frequency of every term of the chunks (A1)."""
    rows = chunks(spark, sf_dir)
    idf = search.inverse_frequencies(search.term_counts(rows, "chunk_id"), search.corpus_statistics(rows))
    return idf.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {CHUNK}, {BM25} SELECT chunk_id, count(*) AS terms, round(sum(w), 6) AS total, round(max(w), 6) AS heaviest FROM w GROUP BY chunk_id")
def bm25_weights(spark, sf_dir):
    """Saturated weights of every chunk's terms (A2), summed up."""
    rows = chunks(spark, sf_dir)
    counts, stats = search.term_counts(rows, "chunk_id"), search.corpus_statistics(rows)
    w = search.term_weights(counts, search.inverse_frequencies(counts, stats), stats)
    return w.groupBy("chunk_id").agg(F.count("*").alias("terms"), F.round(F.sum("w"), 6).alias("total"), F.round(F.max("w"), 6).alias("heaviest"))


@query(f"WITH {CHUNK}, {BM25} SELECT n, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM idf) AS terms, 1.5 AS k1, 0.75 AS b FROM st")
def sparse_state(spark, sf_dir):
    """What restores the lexical encoder (K9)."""
    rows = chunks(spark, sf_dir)
    terms = search.term_counts(rows, "chunk_id").select("term").distinct().agg(F.count("*").alias("terms"))
    stats = search.corpus_statistics(rows).join(terms)
    return stats.select("n", F.round("avgdl", 6).alias("avgdl"), "terms", F.lit(search.K1).alias("k1"), F.lit(search.B).alias("b"))


@query(f"WITH {CHUNK}, {REF}, {RES}, {ASKED}, {BM25}, {SEARCH} SELECT qid, chunk_id, score, rank FROM sparse_top WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    """The ten best chunks of each question by lexical score."""
    return search.lexical_top(chunks(spark, sf_dir), questions_asked(spark, sf_dir).withColumnRenamed("text", "query"), 10).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {DENSE} SELECT qid, chunk_id, score, rank FROM dense_top WHERE rank <= 10")
def dense_cosine_topk(spark, sf_dir):
    """The ten chunks of the highest cosine to each query vector."""
    rows = table(spark, sf_dir, "chunk_vector")
    q = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("vectors").alias("query"))
    return search.dense_top(rows, q, 10, "chunk_id", "vectors", SIZE).withColumn("rank", F.col("rank").cast("long"))


MERGED = "merged AS (SELECT coalesce(d.qid, s.qid) AS qid, coalesce(d.chunk_id, s.chunk_id) AS chunk_id, d.score AS dense_score, s.score AS sparse_score, round(coalesce(d.score, 0) + coalesce(s.score, 0), 6) AS retrieval_score FROM dense_top d FULL JOIN sparse_top s ON d.qid = s.qid AND d.chunk_id = s.chunk_id)"
BOTH = f"WITH {CHUNK}, {DENSE}, {EXAMPLES}, {BM25}, {SEARCH}"


@query(f"{BOTH}, {MERGED} SELECT * FROM merged")
def hybrid_merge(spark, sf_dir):
    """Hits of both channels with their scores added."""
    return fusion.merged_hits(*both_channels(spark, sf_dir))


FUSED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY coalesce(dense_score, retrieval_score) DESC, chunk_id) AS dense_rank,
  CASE WHEN sparse_score IS NOT NULL THEN row_number() OVER (PARTITION BY qid ORDER BY sparse_score DESC NULLS LAST, chunk_id) END AS sparse_rank FROM cut),
fused AS (SELECT * EXCLUDE (retrieval_score), round(1.0 / (60 + dense_rank) + coalesce(1.0 / (60 + sparse_rank), 0), 6) AS retrieval_score FROM ranked)"""
LAST = "row_number() OVER (PARTITION BY qid ORDER BY retrieval_score DESC, least(dense_rank, coalesce(sparse_rank, dense_rank)), dense_rank + coalesce(sparse_rank, 0), chunk_id) AS rank"
TOP_RAW = "cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY retrieval_score DESC, chunk_id) AS r FROM {rows}) WHERE r <= 24)"


@query(f"{BOTH}, {MERGED}, {TOP_RAW.format(rows='merged')}, {FUSED} SELECT qid, chunk_id, dense_rank, sparse_rank, retrieval_score, {LAST} FROM fused")
def rrf_fuse(spark, sf_dir):
    """The merged hits' best by raw score, fused by rank."""
    fused = fusion.reciprocal_ranks(fusion.top(fusion.merged_hits(*both_channels(spark, sf_dir)), K, "retrieval_score"))
    return fused.select("qid", "chunk_id", F.col("dense_rank").cast("long").alias("dense_rank"), F.col("sparse_rank").cast("long").alias("sparse_rank"), "retrieval_score", F.col("rank").cast("long").alias("rank"))


@query(f"{BOTH}, u AS (SELECT qid, chunk_id, rank FROM dense_top UNION ALL SELECT qid, chunk_id, rank FROM sparse_top), s AS (SELECT qid, chunk_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM u GROUP BY qid, chunk_id) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 24")
def rrf_experiment(spark, sf_dir):
    """Each channel's best 72 fused by rank alone, the best 24 of each query."""
    return fusion.fused_channels(*both_channels(spark, sf_dir), K).withColumn("rank", F.col("rank").cast("long"))


LAWS = r"list_distinct(list_transform(regexp_extract_all(text, '\b((?:[A-Z]{2,}\s+)?[A-Za-z]+(?:\s+[A-Za-z]+){0,3}\s+Law)\b', 1), lambda x: lower(regexp_replace(trim(regexp_replace(x, '\s+', ' ', 'g')), '^(?:which|what|under|the)\s+', '', 'i'))))"
TITLES = r"list_distinct(list_transform(regexp_extract_all(text, '\b([A-Z][A-Za-z0-9''&/-]*(?:\s+[A-Z][A-Za-z0-9''&/-]*)*\s+(?:Agreement|Contract|Deed|Order|Policy|Protocol|Arrangement|Lease))\b', 1), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))))"
CLEAN = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
BOOSTED = f"""asked AS (SELECT qid, list_distinct(list_transform({LAWS}, lambda x: {CLEAN.format(x='x')})) AS laws, list_distinct(list_transform({TITLES}, lambda x: {CLEAN.format(x='x')})) AS titles FROM q),
signals AS (SELECT chunk_id, {CLEAN.format(x='doc_id')} AS s1, {CLEAN.format(x="coalesce(text, '')")} AS s2 FROM chunk),
matched AS (SELECT m.*, len(list_filter(laws, lambda t: t <> '' AND ((s1 <> '' AND (contains(s1, t) OR contains(t, s1))) OR (s2 <> '' AND (contains(s2, t) OR contains(t, s2)))))) AS e,
  len(list_filter(titles, lambda t: t <> '' AND ((s1 <> '' AND (contains(s1, t) OR contains(t, s1))) OR (s2 <> '' AND (contains(s2, t) OR contains(t, s2)))))) AS c
  FROM merged m JOIN asked USING (qid) JOIN signals USING (chunk_id)),
boosted AS (SELECT * EXCLUDE (e, c, retrieval_score), round(least(0.18 * e + 0.12 * c, 0.72), 6) AS boost, round(retrieval_score + round(least(0.18 * e + 0.12 * c, 0.72), 6), 6) AS retrieval_score FROM matched)"""


@query(f"{BOTH}, {MERGED}, {BOOSTED}, {TOP_RAW.format(rows='boosted')}, {FUSED} SELECT qid, chunk_id, dense_score, sparse_score, boost, dense_rank, sparse_rank, retrieval_score, {LAST} FROM fused")
def hybrid_retrieval(spark, sf_dir):
    """The 24 best chunks of each query over both channels, boosted by its laws, cases and titles and fused by rank."""
    out = hybrid_plan(chunks(spark, sf_dir), table(spark, sf_dir, "chunk_vector"), examples(spark, sf_dir), K, SIZE)
    for c in ("dense_rank", "sparse_rank", "rank"):
        out = out.withColumn(c, F.col(c).cast("long"))
    return out


WORDINGS = "unnest(list_concat([question], list_transform({laws}, lambda x: x))) AS text, unnest(range(0, 1 + len({laws}))) AS position"


@query(
    f"""WITH {CHUNK}, {REF}, {RES}, q0 AS (SELECT DISTINCT question_id AS qid, question AS text FROM ref JOIN res USING (question_id) WHERE result_id % 50 = 0 AND question IS NOT NULL),
    e AS (SELECT qid, text, list_sort(list_filter(list_distinct({LAWS}), lambda x: x <> lower(trim(text)))) AS laws FROM q0),
    q1 AS (SELECT qid AS group_id, 0 AS position, text FROM e UNION ALL SELECT qid, CAST(p.pos AS INTEGER), laws[p.pos] FROM e, LATERAL (SELECT unnest(range(1, len(laws) + 1)) AS pos) p),
    q AS (SELECT group_id || '#' || position AS qid, text FROM q1), {BM25}, {SEARCH},
    s AS (SELECT regexp_extract(qid, '^(.*)#', 1) AS question_id, CAST(regexp_extract(qid, '#([0-9]+)$', 1) AS INTEGER) AS position, chunk_id, score FROM sparse_top WHERE rank <= 24)
    SELECT question_id, chunk_id, score, position FROM (SELECT *, row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY score DESC, position) AS r FROM s) WHERE r = 1"""
)
def multi_query_merge(spark, sf_dir):
    """Candidates of a question and of the laws that it names, each candidate once with its best score."""
    asked = questions_asked(spark, sf_dir)
    laws = F.array_sort(F.filter(T.statutes(F.col("text")), lambda x: x != F.lower(F.trim("text"))))
    wordings = asked.select("qid", F.posexplode(F.concat(F.array("text"), laws)).alias("position", "query"))
    keyed = wordings.select(F.concat_ws("#", "qid", "position").alias("qid"), "query")
    hits = search.lexical_top(chunks(spark, sf_dir), keyed, K)
    hits = hits.select(F.regexp_extract("qid", "^(.*)#", 1).alias("question_id"), F.regexp_extract("qid", "#([0-9]+)$", 1).cast("int").alias("position"), "chunk_id", "score")
    return fusion.best_of_queries(hits, "question_id").select("question_id", "chunk_id", "score", "position")

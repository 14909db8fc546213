"""Queries of evidence selection, attribution, answers and validation.

Candidates stand in for a retriever's: of each question the chunks on the pages that its results cite, with the highest mean
confidence of such a page as retrieval score and the share of the question's words in the chunk as rerank score.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from .catalog import CHUNK, PAGE, REF, RES, chunks, pages, query, references, results
from .functions import scores as S
from .functions import text as T
from .operators import evidence as E
from .operators import ledger as L
from .queries_pages import CLASS, LAWS, RERANK, first_of
from .queries_scoring import FIRST, LEDGER, PAIRS, PLAIN
from .sources import sinks


CAND = f"""cited AS (SELECT x.question_id AS qid, e.d AS doc_id, p.n AS page_number, avg(coalesce(confidence, 0)) AS c FROM res x, LATERAL (SELECT unnest(list_transform(evidence_pages, lambda e: {{'d': e.doc_id, 'p': e.page_numbers}})) AS u) y, LATERAL (SELECT y.u.d AS d, y.u.p AS p) e, LATERAL (SELECT unnest(e.p) AS n) p GROUP BY ALL),
near AS (SELECT qid, chunk_id, round(max(c), 6) AS retrieval_score FROM cited JOIN (SELECT chunk_id, doc_id, unnest(page_span) AS page_number FROM chunk WHERE text IS NOT NULL) k USING (doc_id, page_number) GROUP BY qid, chunk_id),
cand AS (SELECT qid, chunk_id, c.doc_id, page_span, chunk_type, segments, text, retrieval_score, CASE WHEN chunk_type = 'section' THEN NULL ELSE round(len(list_intersect({RERANK.format(x='question')}, {RERANK.format(x='text')})) / len({RERANK.format(x='question')}), 6) END AS rerank_score FROM near JOIN ref r ON near.qid = r.question_id JOIN chunk c USING (chunk_id) WHERE question IS NOT NULL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC NULLS LAST, retrieval_score DESC, chunk_id) AS rank FROM cand) WHERE rank <= 24)"""
TOP = f"WITH {REF}, {RES}, {CHUNK}, {CAND}"


def candidates(spark, sf_dir):
    """The 24 best candidates of every question; texts are joined to its candidates alone."""
    asked = references(spark, sf_dir).where("question IS NOT NULL").select(F.col("question_id").alias("qid"), T.rerank_words(F.col("question")).alias("asked"))
    cited = results(spark, sf_dir).select(F.col("question_id").alias("qid"), F.coalesce("confidence", F.lit(0.0)).alias("c"), F.explode("evidence_pages").alias("e"))
    cited = cited.select("qid", "c", F.col("e.doc_id").alias("doc_id"), F.explode("e.page_numbers").alias("page_number")).groupBy("qid", "doc_id", "page_number").agg(F.avg("c").alias("c"))
    every = chunks(spark, sf_dir).where("text IS NOT NULL AND page_span IS NOT NULL")
    near = cited.join(every.select("chunk_id", "doc_id", F.explode("page_span").alias("page_number")), ["doc_id", "page_number"])
    near = near.groupBy("qid", "chunk_id").agg(F.round(F.max("c"), 6).alias("retrieval_score")).join(asked, "qid")
    rows = near.join(every.withColumn("said", T.rerank_words(F.col("text"))), "chunk_id")
    rows = rows.withColumn("rerank_score", F.when(F.col("chunk_type") != "section", F.round(T.overlap(F.col("asked"), F.col("said")) / F.size("asked"), 6)))
    order = Window.partitionBy("qid").orderBy(F.desc_nulls_last("rerank_score"), F.desc("retrieval_score"), "chunk_id")
    rows = rows.withColumn("rank", F.row_number().over(order)).where("rank <= 24")
    return rows.select("qid", "chunk_id", "doc_id", "page_span", "chunk_type", "segments", "text", "retrieval_score", "rerank_score", "rank")


def long(df, *names):
    for n in names:
        df = df.withColumn(n, F.col(n).cast("long"))
    return df


@query(f"{TOP} SELECT qid, chunk_id, rank, retrieval_score, rerank_score FROM top")
def rerank_order(spark, sf_dir):
    """Every question's candidates in rerank order."""
    return long(candidates(spark, sf_dir).select("qid", "chunk_id", "rank", "retrieval_score", "rerank_score"), "rank")


@query(f"{TOP} SELECT qid, chunk_id FROM top WHERE rerank_score >= 0.5")
def rerank_threshold(spark, sf_dir):
    """Candidates with a rerank score of at least 0.5 (F2)."""
    return E.above_threshold(candidates(spark, sf_dir), 0.5).select("qid", "chunk_id")


LIFT = "lifted AS (SELECT qid, doc_id, page_number, list_sort(list(DISTINCT chunk_id)) AS chunk_ids, max(retrieval_score) AS retrieval_score, max(rerank_score) AS rerank_score FROM (SELECT *, unnest(page_span) AS page_number FROM top) GROUP BY qid, doc_id, page_number)"


@query(f"{TOP}, {LIFT} SELECT qid, doc_id, page_number, array_to_string(chunk_ids, '|') AS chunk_ids, retrieval_score, rerank_score, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC NULLS LAST, retrieval_score DESC, doc_id, page_number) AS rank FROM lifted")
def page_lift(spark, sf_dir):
    """Pages of the candidates with their best scores (A3, L2)."""
    return long(E.lifted_pages(candidates(spark, sf_dir)), "rank").withColumn("chunk_ids", F.array_join("chunk_ids", "|"))


@query(f"{TOP}, {LIFT} SELECT qid, doc_id, string_agg(CAST(page_number AS VARCHAR), ',' ORDER BY page_number) AS pages FROM lifted GROUP BY qid, doc_id")
def page_refs(spark, sf_dir):
    """Pages of the candidates by document (A4)."""
    out = E.page_references(E.lifted_pages(candidates(spark, sf_dir)))
    return out.withColumn("pages", F.array_join(F.transform("pages", lambda p: p.cast("string")), ","))


@query(f"{TOP} SELECT qid, doc_id, t.r AS rerank_score, t.s AS retrieval_score FROM (SELECT qid, doc_id, max({{'r': coalesce(rerank_score, -1), 's': retrieval_score}}) AS t FROM top GROUP BY qid, doc_id) WHERE t.r >= 0 UNION ALL SELECT qid, doc_id, NULL, t.s FROM (SELECT qid, doc_id, max({{'r': coalesce(rerank_score, -1), 's': retrieval_score}}) AS t FROM top GROUP BY qid, doc_id) WHERE t.r < 0")
def doc_best_score(spark, sf_dir):
    """The best scores of every candidate document (A5)."""
    return E.best_of_documents(candidates(spark, sf_dir))


@query(f"{TOP} SELECT qid, array_to_string({first_of('types')}, '|') AS families, CAST(n AS BIGINT) AS candidates FROM (SELECT qid, list(chunk_type ORDER BY rank) AS types, count(*) AS n FROM top GROUP BY qid)")
def family_participation(spark, sf_dir):
    """Chunk families among every question's candidates, in order."""
    rows = candidates(spark, sf_dir).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_type"))).alias("t"), F.count("*").alias("candidates"))
    return rows.select("qid", F.array_join(F.array_distinct(F.transform("t", lambda x: x["chunk_type"])), "|").alias("families"), "candidates")


SEGS = "segs AS (SELECT qid, rank, doc_id, s.page_number AS page_number, s.text AS text, position FROM (SELECT qid, rank, doc_id, unnest(segments) AS s, unnest(range(0, len(segments))) AS position FROM top))"
WORDS = "len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))"


@query(f"""{TOP}, {SEGS}, d AS (SELECT *, {WORDS} AS n, row_number() OVER (PARTITION BY qid, doc_id, page_number, text ORDER BY rank, position) AS same FROM segs), k AS (SELECT *, least(n, 120) AS cap FROM d WHERE same = 1 AND n > 0),
  u AS (SELECT *, sum(cap) OVER (PARTITION BY qid ORDER BY rank, position) - cap AS used, row_number() OVER (PARTITION BY qid ORDER BY rank, position) AS slot FROM k)
  SELECT qid, slot, doc_id, page_number, CAST(least(cap, 600 - used) AS BIGINT) AS tokens FROM u WHERE used < 600 AND slot <= 8""")
def context_pack(spark, sf_dir):
    """Segments of the candidates packed into 600 tokens, at most 120 each and eight together."""
    rows = candidates(spark, sf_dir).select("qid", "rank", "doc_id", F.posexplode("segments").alias("position", "s"))
    rows = rows.select("qid", "rank", "position", "doc_id", F.col("s.page_number").alias("page_number"), F.col("s.text").alias("text"))
    return long(E.packed_context(rows, 600, 120, 8).select("qid", "slot", "doc_id", "page_number", F.col("take").alias("tokens")), "slot", "tokens")


@query()
def evidence_compressor(spark, sf_dir):
    """Up to eight candidates of every question, spread over its pages."""
    return E.compressed(candidates(spark, sf_dir), 8)


DOCBEST = "db AS (SELECT qid, doc_id, t.r AS r, t.s AS s, row_number() OVER (PARTITION BY qid ORDER BY t.r DESC, t.s DESC, doc_id DESC) AS rk FROM (SELECT qid, doc_id, max({'r': coalesce(rerank_score, -1), 's': retrieval_score}) AS t FROM top GROUP BY qid, doc_id))"


@query(f"{TOP}, {DOCBEST}, two AS (SELECT qid, max(CASE WHEN rk = 1 THEN r END) AS a, max(CASE WHEN rk = 2 AND r >= 0 THEN r END) AS b, max(CASE WHEN rk = 1 THEN doc_id END) AS keep FROM db WHERE rk <= 2 GROUP BY qid) SELECT top.qid, chunk_id FROM top JOIN two USING (qid) WHERE NOT coalesce(a >= 0.2 AND round(a - b, 9) >= 0.25, false) OR keep = doc_id")
def confidence_gap(spark, sf_dir):
    """Candidates of the leading document alone where it leads clearly."""
    return E.confident_document(candidates(spark, sf_dir)).select("qid", "chunk_id")


@query(f"""{TOP}, sel AS (SELECT * FROM top WHERE rank <= 3), seen AS (SELECT DISTINCT qid, doc_id FROM sel), have AS (SELECT qid, count(*) AS have FROM seen GROUP BY qid),
  f AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY rank, chunk_id) AS d FROM top WHERE (qid, doc_id) NOT IN (SELECT qid, doc_id FROM seen)), n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, chunk_id) AS n FROM f WHERE d = 1)
  SELECT qid, chunk_id, false AS injected FROM sel UNION ALL SELECT n.qid, chunk_id, true FROM n JOIN have USING (qid) WHERE n <= 4 AND n <= 5 - have""")
def coverage_augment(spark, sf_dir):
    """The three best candidates and one of each uncovered document, up to five documents (U4)."""
    pool = candidates(spark, sf_dir)
    return E.covered(pool.where("rank <= 3"), pool, 5, 4).select("qid", "chunk_id", "injected")


@query(f"""{TOP}, laws AS (SELECT question_id AS qid, {LAWS} AS laws FROM ref WHERE question IS NOT NULL), hit AS (SELECT DISTINCT qid, doc_id FROM top JOIN laws USING (qid) WHERE len(list_filter(laws, lambda l: contains(lower(replace(text, ' ', '')), replace(l, ' ', '')))) > 0)
  SELECT top.qid, chunk_id FROM top LEFT JOIN hit ON top.qid = hit.qid AND top.doc_id = hit.doc_id WHERE hit.qid IS NOT NULL OR top.qid NOT IN (SELECT qid FROM hit)""")
def entity_filter(spark, sf_dir):
    """Candidates of documents that hold a law of the question, or all where none does."""
    rows = candidates(spark, sf_dir)
    laws = references(spark, sf_dir).where("question IS NOT NULL").select(F.col("question_id").alias("qid"), T.statutes(F.col("question")).alias("laws"))
    bare = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    hits = rows.join(laws, "qid").where(F.exists("laws", lambda l: F.lower(bare(F.col("text"))).contains(bare(l)))).select("qid", "doc_id")
    return E.aligned(rows, hits).select("qid", "chunk_id")


MK = "len(regexp_extract_all(text, '(?i)\\b(?:article|clause|section|schedule|tribunal|court|claim|claimant|respondent|agreement|shall|must|may)\\b'))"
NT = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"
TITLE = f"(page_number = 1 AND ({MK} <= 1 OR contains({NT}, 'table of contents')))"
PAGES = f"""cp0 AS (SELECT *, {MK} AS mk, {NT} AS nt FROM (SELECT *, unnest(page_span) AS page_number FROM top) WHERE page_number > 0),
cp AS (SELECT qid, doc_id, page_number, arg_max(text, {{'a': CASE WHEN {TITLE} THEN 0 ELSE 1 END, 'b': mk, 'c': coalesce(rerank_score, -1), 'd': retrieval_score, 'e': length(nt), 'f': nt}}) AS text, list_sort(list(DISTINCT chunk_id)) AS chunk_ids, max(retrieval_score) AS retrieval_score, max(rerank_score) AS rerank_score FROM cp0 GROUP BY qid, doc_id, page_number)"""


@query(f"{TOP}, {PAGES} SELECT qid, doc_id, page_number, sha256(text) AS digest, array_to_string(chunk_ids, '|') AS chunk_ids, retrieval_score, rerank_score FROM cp")
def candidate_pages(spark, sf_dir):
    """Pages of the candidates with their most telling text."""
    out = E.candidate_pages(candidates(spark, sf_dir))
    return out.select("qid", "doc_id", "page_number", F.sha2("text", 256).alias("digest"), F.array_join("chunk_ids", "|").alias("chunk_ids"), "retrieval_score", "rerank_score")


PRUNE = f"""p1 AS (SELECT *, {TITLE} AS title, count(*) OVER (PARTITION BY qid, doc_id, {NT}) > 1 AS rep, {{'r': coalesce(rerank_score, -1), 's': retrieval_score, 'p': -page_number}} AS st FROM cp),
p2 AS (SELECT *, arg_max(page_number, st) OVER w AS strongest, arg_max(page_number, st) FILTER (WHERE NOT title AND NOT rep) OVER w AS anch FROM p1 WINDOW w AS (PARTITION BY qid, doc_id)),
p3 AS (SELECT *, coalesce(anch, strongest) AS anchor FROM p2), p4 AS (SELECT *, max(chunk_ids) FILTER (WHERE page_number = anchor) OVER (PARTITION BY qid, doc_id) AS aids FROM p3),
p5 AS (SELECT *, (page_number <> strongest OR anchor <> strongest) AND page_number <> anchor AND ((rep AND NOT list_has_any(chunk_ids, aids)) OR title) AS sup FROM p4),
p6 AS (SELECT *, count(*) FILTER (WHERE NOT sup) OVER (PARTITION BY qid) AS kept, arg_max({{'d': doc_id, 'p': page_number}}, st) OVER (PARTITION BY qid) AS best FROM p5)"""


@query(f"{TOP}, {PAGES}, {PRUNE} SELECT qid, doc_id, page_number, CASE WHEN kept = 0 THEN NOT (best.d = doc_id AND best.p = page_number) ELSE sup END AS suppressed FROM p6")
def page_prune(spark, sf_dir):
    """Which pages are suppressed as titles or repeated texts."""
    return E.pruned_pages(E.candidate_pages(candidates(spark, sf_dir))).select("qid", "doc_id", "page_number", "suppressed")


STG = LEDGER + ", att AS (SELECT l.run_id, l.question_id, l.raw, l.narrowed, l.final, l.gold, f.answer IS NULL AS is_none, coalesce(f.confidence >= 0.5, false) AND f.answer IS NOT NULL AS ok FROM led l JOIN first_ans f ON l.run_id = f.run_id AND l.question_id = f.question_id), ac AS (SELECT *, CASE WHEN len(narrowed) > 0 THEN narrowed ELSE raw END AS cand FROM att), ad AS (SELECT *, list_intersect(cand, gold) AS sup, len(list_intersect(cand, final)) AS selected FROM ac)"


def attribution(narrow):
    keep = "list_sort(sup)" if narrow else "list_sort(cand)"
    action = "trimmed_pages" if narrow else "solver_narrowing_disabled_preserved"
    cond = "ok AND len(sup) > 0 AND len(sup) < len(cand)"
    return f"{STG} SELECT run_id, question_id, CASE WHEN len(cand) = 0 THEN 'no_candidate_pages' WHEN {cond} THEN '{action}' WHEN ok THEN 'preserved_pages' WHEN is_none THEN 'no_answer_preserved' ELSE 'unsupported_preserved' END AS action, coalesce({PLAIN.format(x=f'CASE WHEN {cond} THEN {keep} ELSE list_sort(cand) END')}, '') AS pages, CAST(selected AS BIGINT) AS selected FROM ad"


def attributed(spark, sf_dir, narrowing):
    res, ref = results(spark, sf_dir), references(spark, sf_dir)
    own = L.first_answers(res).select("run_id", "question_id", F.col("answer").isNull().alias("is_none"), (F.coalesce(F.col("confidence") >= 0.5, F.lit(False)) & F.col("answer").isNotNull()).alias("is_supported"))
    rows = L.page_stages(res, ref).join(own, ["run_id", "question_id"]).withColumn("solver", F.col("final")).withColumn("supported", F.col("gold"))
    out = E.final_attribution(rows.drop("final"), narrowing)
    return out.select("run_id", "question_id", "action", S.encoded_pairs(F.col("final")).alias("pages"), F.col("selected").cast("long").alias("selected"))


@query(attribution(False))
def attribution_final(spark, sf_dir):
    """Final pages of every answer, narrowing off."""
    return attributed(spark, sf_dir, False)


@query(attribution(True))
def attribution_narrowed(spark, sf_dir):
    """Final pages of every answer, narrowing on (X11)."""
    return attributed(spark, sf_dir, True)


KEY = "CASE answer_type WHEN 'boolean' THEN CAST(x.answer.b AS VARCHAR) WHEN 'number' THEN CAST(CAST(x.answer.n AS DECIMAL(18,3)) AS VARCHAR) WHEN 'names' THEN array_to_string(list_sort(list_transform(x.answer.arr, lambda v: lower(trim(v)))), '|') ELSE lower(trim(x.answer.s)) END"


def keyed_answers(spark, sf_dir):
    kinds = references(spark, sf_dir).select("question_id", "answer_type")
    key = (
        F.when(F.col("answer_type") == "boolean", F.col("answer.b").cast("string")).when(F.col("answer_type") == "number", F.col("answer.n").cast("decimal(18,3)").cast("string"))
        .when(F.col("answer_type") == "names", F.array_join(F.array_sort(F.transform("answer.arr", lambda v: F.lower(F.trim(v)))), "|")).otherwise(F.lower(F.trim("answer.s")))
    )
    return results(spark, sf_dir).join(kinds, "question_id").select("question_id", "run_id", "confidence", key.alias("value"))


@query(f"WITH {REF}, {RES}, k AS (SELECT x.question_id, {KEY} AS value, confidence FROM res x JOIN ref r ON x.question_id = r.question_id WHERE confidence IS NOT NULL), t AS (SELECT * FROM k WHERE value IS NOT NULL), m AS (SELECT *, max(confidence) OVER (PARTITION BY question_id) AS top FROM t) SELECT question_id, CASE WHEN min(value) = max(value) THEN min(value) END AS value FROM m WHERE confidence = top GROUP BY question_id")
def unique_best(spark, sf_dir):
    """Of every question the answer of the highest confidence, NULL where several share it."""
    return E.unique_best(keyed_answers(spark, sf_dir).where("value IS NOT NULL AND confidence IS NOT NULL"), "question_id", "value", "confidence")


@query(f"WITH {REF}, {RES} SELECT result_id, CASE WHEN x.answer IS NULL THEN 'unanswerable' WHEN answer_type = 'boolean' AND x.answer.b IS NULL THEN 'no_value' WHEN answer_type = 'number' AND x.answer.n IS NULL THEN 'no_value' WHEN answer_type = 'names' AND len(list_filter(coalesce(x.answer.arr, []), lambda v: trim(v) <> '')) = 0 THEN 'no_value' WHEN answer_type = 'date' AND NOT coalesce(regexp_full_match(x.answer.s, '\\d{{4}}-\\d{{2}}-\\d{{2}}'), false) THEN 'bad_date' WHEN answer_type IN ('name', 'free_text') AND coalesce(trim(x.answer.s), '') = '' THEN 'no_value' WHEN answer_type = 'free_text' AND length(x.answer.s) > 280 THEN 'too_long' ELSE 'ok' END AS code, CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence ELSE 0.0 END AS confidence FROM res x JOIN ref r ON x.question_id = r.question_id")
def validate_answers(spark, sf_dir):
    """The first rule of its type that every answer breaks, and its coerced confidence."""
    kinds = references(spark, sf_dir).select("question_id", "answer_type")
    k, blank = F.col("answer_type"), F.coalesce(F.trim("answer.s"), F.lit("")) == ""
    names = F.size(F.filter(F.coalesce("answer.arr", F.array().cast("array<string>")), lambda v: F.trim(v) != ""))
    code = (
        F.when(F.col("answer").isNull(), "unanswerable").when((k == "boolean") & F.col("answer.b").isNull(), "no_value").when((k == "number") & F.col("answer.n").isNull(), "no_value").when((k == "names") & (names == 0), "no_value")
        .when((k == "date") & ~F.coalesce(F.col("answer.s").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)), "bad_date").when(k.isin("name", "free_text") & blank, "no_value").when((k == "free_text") & (F.length("answer.s") > 280), "too_long").otherwise("ok")
    )
    return results(spark, sf_dir).join(kinds, "question_id").select("result_id", code.alias("code"), S.coerced_confidence(F.col("confidence")).alias("confidence"))


@query(f"WITH {REF}, r2 AS (SELECT question_id, unnest(list_filter([CASE WHEN question IS NULL OR trim(question) = '' THEN 'no_question' END, CASE WHEN answer IS NULL THEN 'no_answer' END, CASE WHEN len(coalesce(gold_retrieval, [])) = 0 THEN 'no_gold_pages' END, CASE WHEN len(list_filter(flatten(list_transform(coalesce(gold_retrieval, []), lambda g: g.page_numbers)), lambda p: p <= 0)) > 0 THEN 'bad_page' END, CASE WHEN difficulty IS NULL THEN 'no_difficulty' END, CASE WHEN source_type IS NULL THEN 'no_source_type' END], lambda x: x IS NOT NULL)) AS issue FROM ref) SELECT question_id, issue FROM r2")
def validate_references(spark, sf_dir):
    """What is wrong with every reference."""
    gold = F.coalesce("gold_retrieval", F.array())
    rules = {
        "no_question": F.col("question").isNull() | (F.trim("question") == ""), "no_answer": F.col("answer").isNull(), "no_gold_pages": F.size(gold) == 0,
        "bad_page": F.exists(F.flatten(F.transform(gold, lambda g: g["page_numbers"])), lambda p: p <= 0), "no_difficulty": F.col("difficulty").isNull(), "no_source_type": F.col("source_type").isNull(),
    }
    issues = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return references(spark, sf_dir).select("question_id", F.explode(issues).alias("issue"))


@query(f"WITH {REF}, o AS (SELECT question_id, answer_type, difficulty FROM ref WHERE tags IS NOT NULL) SELECT r.question_id, coalesce(r.source_type, 'unknown') AS source_type, CASE WHEN len(coalesce(r.tags, [])) > 0 THEN 'tagged' ELSE coalesce(r.difficulty, 'unknown') END AS level FROM ref r")
def metadata_overlay(spark, sf_dir):
    """References with their missing labels filled from an overlay of defaults, tags before difficulty (F8)."""
    ref = references(spark, sf_dir)
    overlay = ref.select("question_id", F.when(F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0, "tagged").alias("o_level"))
    return ref.join(overlay, "question_id", "left").select("question_id", F.coalesce("source_type", F.lit("unknown")).alias("source_type"), F.coalesce("o_level", "difficulty", F.lit("unknown")).alias("level"))


@query(f"WITH {PAGE}, s AS (SELECT doc_id, page_number, '## Page ' || page_number || chr(10) || chr(10) || coalesce(text, '') AS part FROM page) SELECT doc_id, sha256(string_agg(part, chr(10) || chr(10) ORDER BY page_number)) AS digest, count(*) AS pages FROM s GROUP BY doc_id")
def document_markdown(spark, sf_dir):
    """The digest of every document's Markdown."""
    rows = pages(spark, sf_dir)
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("pages"))
    return sinks.document_markdown(rows).join(counts, "doc_id").select("doc_id", F.sha2("markdown", 256).alias("digest"), "pages")


@query(f"WITH {PAGE}, {CHUNK}, b AS (SELECT doc_id, page_span[1] AS page_number, list_sort(list(chunk_id)) AS blocks, list_sort(list(DISTINCT chunk_type)) AS roles FROM chunk WHERE len(page_span) > 0 GROUP BY ALL) SELECT p.doc_id, p.page_number, coalesce(CAST(len(blocks) AS BIGINT), 0) AS blocks, coalesce(array_to_string(roles, '|'), '') AS roles, CAST(len(coalesce(page_tables, [])) AS BIGINT) AS tables FROM page p LEFT JOIN b ON p.doc_id = b.doc_id AND p.page_number = b.page_number")
def canonical_pages(spark, sf_dir):
    """Every page with its blocks, their roles and its tables (K8)."""
    blocks = chunks(spark, sf_dir).where(F.size("page_span") > 0).groupBy("doc_id", F.element_at("page_span", 1).alias("page_number")).agg(F.count("*").alias("blocks"), F.array_join(F.array_sort(F.collect_set("chunk_type")), "|").alias("roles"))
    return pages(spark, sf_dir).join(blocks, ["doc_id", "page_number"], "left").select("doc_id", "page_number", F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("roles", F.lit("")).alias("roles"), F.size(F.coalesce("page_tables", F.array().cast("array<string>"))).cast("long").alias("tables"))


@query(f"{TOP}, x AS (SELECT qid, chunk_id, CASE WHEN rank <= 5 THEN list_sort(list_distinct(list_concat(page_span, list_filter(list_transform(page_span, lambda p: p + 1), lambda p: p > 1)))) ELSE page_span END AS pages, doc_id FROM top), m AS (SELECT doc_id, max(page_number) AS last FROM page GROUP BY doc_id) SELECT qid, chunk_id, array_to_string(list_filter(pages, lambda p: p <= coalesce(last, 1000000)), ',') AS pages FROM x LEFT JOIN m USING (doc_id)".replace(f"WITH {REF}", f"WITH {PAGE}, {REF}"))
def page_hints(spark, sf_dir):
    """The five best candidates of every question take the page after theirs too, clipped to the document."""
    last = pages(spark, sf_dir).groupBy("doc_id").agg(F.max("page_number").alias("last"))
    rows = candidates(spark, sf_dir).join(last, "doc_id", "left")
    more = F.array_sort(F.array_distinct(F.concat("page_span", F.filter(F.transform("page_span", lambda p: p + 1), lambda p: p > 1))))
    wide = F.when(F.col("rank") <= 5, more).otherwise(F.col("page_span"))
    kept = F.filter(wide, lambda p: p <= F.coalesce(F.col("last"), F.lit(1000000)))
    return rows.select("qid", "chunk_id", F.array_join(F.transform(kept, lambda p: p.cast("string")), ",").alias("pages"))


STRATA = f"s AS (SELECT question_id, answer_type, {CLASS} AS class FROM ref WHERE question IS NOT NULL)"


@query(f"WITH {REF}, {STRATA}, n AS (SELECT *, row_number() OVER (PARTITION BY answer_type, class ORDER BY question_id) - 1 AS i, count(*) OVER (PARTITION BY answer_type, class) AS n FROM s), k AS (SELECT *, CAST(greatest(1, floor(n / 5)) AS BIGINT) AS k FROM n) SELECT answer_type, class, question_id FROM k WHERE i IN (SELECT unnest(list_transform(range(0, k), lambda j: ((2 * j + 1) * n) // (2 * k))))")
def strat_sample(spark, sf_dir):
    """A fifth of every stratum of questions, one at least, spread evenly by id."""
    s = references(spark, sf_dir).where("question IS NOT NULL").select("question_id", "answer_type", T.question_class(F.col("question")).alias("class"))
    w = Window.partitionBy("answer_type", "class")
    rows = s.withColumn("i", F.row_number().over(w.orderBy("question_id")) - 1).withColumn("n", F.count("*").over(w)).withColumn("k", F.greatest(F.lit(1), F.floor(F.col("n") / 5)))
    picks = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.floor((2 * j + 1) * F.col("n") / (2 * F.col("k"))))
    return rows.where(F.array_contains(picks, F.col("i").cast("long"))).select("answer_type", "class", "question_id")


PARTY = first_of("list_transform(regexp_extract_all(question, '\\b[A-Z][a-z]+ [A-Z][a-z]+(?: [A-Z][A-Za-z]+)*'), lambda x: x)")


@query(f"WITH {REF}, p AS (SELECT question_id, answer_type, {PARTY} AS names FROM ref WHERE question IS NOT NULL AND answer_type IN ('boolean', 'name')) SELECT question_id, unnest(range(1, least(len(names), 4) + 1)) AS part, 'Who are the main parties in ' || unnest(names[1:4]) || '?' AS question FROM p WHERE len(names) >= 2")
def decompose(spark, sf_dir):
    """Questions that name several parties, one question for each of at most four."""
    names = F.array_distinct(T.all_matches(F.col("question"), r"\b[A-Z][a-z]+ [A-Z][a-z]+(?: [A-Z][A-Za-z]+)*"))
    rows = references(spark, sf_dir).where("question IS NOT NULL AND answer_type IN ('boolean', 'name')").select("question_id", names.alias("names")).where(F.size("names") >= 2)
    return rows.select("question_id", F.posexplode(F.slice("names", 1, 4)).alias("at", "name")).select("question_id", (F.col("at") + 1).cast("long").alias("part"), F.concat(F.lit("Who are the main parties in "), "name", F.lit("?")).alias("question"))


@query(f"WITH {REF}, {RES}, s AS (SELECT x.question_id, list_distinct(list_transform(x.answer.arr, lambda v: lower(trim(v)))) AS names FROM res x JOIN ref r ON x.question_id = r.question_id WHERE answer_type = 'names' AND len(x.answer.arr) > 0), u AS (SELECT question_id, names, unnest(names) AS v FROM s), n AS (SELECT question_id, count(*) AS runs FROM s GROUP BY question_id), c AS (SELECT question_id, v, count(*) AS k FROM u GROUP BY question_id, v) SELECT n.question_id, count(c.v) > 0 AS common FROM n LEFT JOIN c ON n.question_id = c.question_id AND c.k = n.runs GROUP BY n.question_id")
def recompose(spark, sf_dir):
    """Whether all answers to a question of names have a name in common."""
    kinds = references(spark, sf_dir).where("answer_type = 'names'").select("question_id")
    rows = results(spark, sf_dir).join(kinds, "question_id", "left_semi").where(F.size("answer.arr") > 0).select("question_id", F.array_distinct(F.transform("answer.arr", lambda v: F.lower(F.trim(v)))).alias("names"))
    runs = rows.groupBy("question_id").agg(F.count("*").alias("runs"))
    every = rows.select("question_id", F.explode("names").alias("v")).groupBy("question_id", "v").agg(F.count("*").alias("k")).join(runs, "question_id").where("k = runs").select("question_id", F.lit(True).alias("c")).distinct()
    return runs.join(every, "question_id", "left").select("question_id", F.coalesce("c", F.lit(False)).alias("common"))


@query(f"WITH {REF}, {RES}, {FIRST} SELECT run_id, question_id, CASE WHEN answer IS NULL THEN 'unanswered' WHEN coalesce(confidence, 0) >= CASE r.answer_type WHEN 'boolean' THEN 0.7 WHEN 'number' THEN 0.55 WHEN 'name' THEN 0.75 WHEN 'names' THEN 0.75 WHEN 'date' THEN 0.6 ELSE 0.5 END THEN 'accepted' ELSE 'below_threshold' END AS state, {PLAIN.format(x=PAIRS.format(c='evidence_pages'))} AS pages FROM (SELECT * EXCLUDE (rf) FROM first_ans) f JOIN (SELECT question_id, answer_type FROM ref) r USING (question_id)")
def typed_states(spark, sf_dir):
    """Whether every answer's confidence reaches its type's threshold; its pages stay all the same."""
    kinds = references(spark, sf_dir).select("question_id", "answer_type")
    limits = {"boolean": 0.7, "number": 0.55, "name": 0.75, "names": 0.75, "date": 0.6}
    limit = F.lit(0.5)
    for k, v in limits.items():
        limit = F.when(F.col("answer_type") == k, v).otherwise(limit)
    state = F.when(F.col("answer").isNull(), "unanswered").when(F.coalesce("confidence", F.lit(0.0)) >= limit, "accepted").otherwise("below_threshold")
    return L.first_answers(results(spark, sf_dir)).join(kinds, "question_id").select("run_id", "question_id", state.alias("state"), S.encoded_pairs(L.S_pairs("evidence_pages")).alias("pages"))


@query()
def submissions(spark, sf_dir):
    """One payload of every run's answers (K4)."""
    return sinks.submission(L.first_answers(results(spark, sf_dir)), "answer", "evidence_pages", "confidence")


@query("SELECT c AS corpus, v AS variant, CASE WHEN v = 'R0' THEN false ELSE true END AS ocr, v NOT IN ('R0', 'R1') AS multiscale FROM (VALUES ('mixed'), ('original')) a(c), (VALUES ('R0'), ('R1'), ('R2'), ('R3'), ('R4'), ('R5'), ('R6')) b(v) WHERE c = 'mixed' OR v IN ('R0', 'R1')")
def condition_specs(spark, sf_dir):
    """The nine conditions of the experiment and what index each needs."""
    a = spark.createDataFrame([("mixed",), ("original",)], "corpus string")
    b = spark.createDataFrame([(f"R{i}",) for i in range(7)], "variant string")
    return a.crossJoin(b).where("corpus = 'mixed' OR variant IN ('R0', 'R1')").select("corpus", "variant", (F.col("variant") != "R0").alias("ocr"), (~F.col("variant").isin("R0", "R1")).alias("multiscale"))  # two rows by seven




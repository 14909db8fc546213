"""Queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


SPACE = r"[\s\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINES = rf"""
WITH d AS (
  SELECT doc_id, source, string_split(text, chr(10)) AS rows FROM documents
  WHERE source IS NOT NULL AND regexp_replace(text, '{SPACE}+', '', 'g') <> ''
), l AS (
  SELECT doc_id, source, unnest(rows) AS line, unnest(range(1, len(rows) + 1)) AS line_no FROM d
), k AS (
  SELECT doc_id, source, CAST(line_no AS INTEGER) AS line_no,
    trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '{SPACE}+', ' ', 'g')) AS form
  FROM l WHERE len(regexp_replace(line, '\PL', '', 'g')) >= 10
), n AS (SELECT source, count(DISTINCT doc_id) AS n_source FROM d GROUP BY source
), c AS (
  SELECT k.source, form, count(DISTINCT doc_id) AS n_docs, any_value(n_source) AS n_source FROM k JOIN n ON k.source = n.source
  GROUP BY k.source, form HAVING count(DISTINCT doc_id) >= 3 AND 10 * count(DISTINCT doc_id) >= any_value(n_source)
)"""


@query(LINES + " SELECT doc_id, line_no FROM k JOIN c ON k.source = c.source AND k.form = c.form")
def p2_found(spark, sf_dir):
    """Every line that its document's source repeats."""
    from .site_lines import repeated_lines

    return repeated_lines(table(spark, sf_dir, "documents"))[0].select("doc_id", "line_no")


@query(LINES + " SELECT source, count(*) AS lines, CAST(sum(n_docs) AS BIGINT) AS holdings, any_value(n_source) AS n_source FROM c GROUP BY source")
def p2_sources(spark, sf_dir):
    """Of each source: how many lines it repeats, and how often documents hold one."""
    from .site_lines import repeated_lines

    lines = repeated_lines(table(spark, sf_dir, "documents"))[1]
    return lines.groupBy("source").agg(F.count("*").alias("lines"), F.sum("n_docs").alias("holdings"), F.first("n_source").alias("n_source"))


@query(
    LINES
    + """, gone AS (SELECT doc_id, line_no FROM k JOIN c ON k.source = c.source AND k.form = c.form),
    every AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents),
    kept AS (SELECT e.doc_id, string_agg(CASE WHEN g.doc_id IS NULL THEN line END, chr(10) ORDER BY e.line_no) AS text, count(g.doc_id) AS lines_removed
      FROM every e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.line_no = g.line_no GROUP BY e.doc_id)
    SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text, CAST(coalesce(lines_removed, 0) AS INTEGER) AS lines_removed
    FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id"""
)
def p2_clean_text(spark, sf_dir):
    """Every document's text without its source's repeated lines."""
    from .site_lines import remove_repeated_lines, repeated_lines

    docs = table(spark, sf_dir, "documents")
    return remove_repeated_lines(docs, repeated_lines(docs)[1])


@query()
def p1_found(spark, sf_dir):
    """Documents that are mainly not sentences, and what they are."""
    from .quality import document_kinds

    return document_kinds(table(spark, sf_dir, "documents"), table(spark, sf_dir, "kind_label")).where("kind <> 'prose'").select("doc_id", "kind")


@query()
def p1_statistics(spark, sf_dir):
    """Every non-blank document's statistics beside what was recorded for it last, and its kind."""
    from .quality import document_kinds, last_signal

    kinds = document_kinds(table(spark, sf_dir, "documents"), table(spark, sf_dir, "kind_label"))
    signal = last_signal(table(spark, sf_dir, "page_signal"))
    return kinds.join(signal, "doc_id", "left")


@query(
    r"""SELECT doc_id, recorded_chars, recorded_words, recorded_bad_ratio,
      CAST(length(text) AS INTEGER) AS chars, CAST(len(list_filter(string_split_regex(text, '[ \t\n\v\f\r]+'), lambda x: x <> '')) AS INTEGER) AS words,
      recorded_chars IS DISTINCT FROM length(text) AS stale
    FROM documents LEFT JOIN (
      SELECT doc_id, text_char_count AS recorded_chars, word_count AS recorded_words, bad_char_ratio AS recorded_bad_ratio FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY recorded_at DESC NULLS LAST, text_char_count DESC NULLS LAST, word_count DESC NULLS LAST, bad_char_ratio DESC NULLS LAST) AS rn
        FROM page_signal WHERE doc_id IS NOT NULL) WHERE rn = 1) USING (doc_id)"""
)
def p1_signals(spark, sf_dir):
    """Every document's counts beside the last recorded ones."""
    from .quality import last_signal

    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("chars"), F.size(F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda x: x != "")).alias("words"))
    docs = docs.withColumn("words", F.when(F.col("chars").isNotNull(), F.col("words")))
    out = docs.join(last_signal(table(spark, sf_dir, "page_signal")), "doc_id", "left")
    return out.select("doc_id", "recorded_chars", "recorded_words", "recorded_bad_ratio", "chars", "words", (~F.col("recorded_chars").eqNullSafe(F.col("chars"))).alias("stale"))


def prose_findings(spark, sf_dir):
    """(documents, their site lines, the sources' repeated lines, doc_id of what isn't prose, findings of scanned documents that are prose)."""
    from .common import maybe_broadcast
    from .quality import document_kinds
    from .scanned import scan_findings
    from .site_lines import repeated_lines

    docs = table(spark, sf_dir, "documents")
    site, lines = repeated_lines(docs)
    others = document_kinds(docs, table(spark, sf_dir, "kind_label"), lines=lines).where("kind <> 'prose'").select("doc_id").distinct()
    return docs, site, lines, others, scan_findings(docs, lines).join(maybe_broadcast(others, 8), "doc_id", "left_anti")


@query()
def p3_found(spark, sf_dir):
    """Headers, page numbers, divided words and misread characters of scanned documents."""
    return prose_findings(spark, sf_dir)[-1].select("doc_id", "line_no", "defect").distinct()


def clean_text(spark, sf_dir):
    """(repaired texts of all documents, the sources' repeated lines, doc_id of what isn't prose)."""
    from ..storage import materialise
    from .scanned import repaired

    docs, site, lines, others, found = prose_findings(spark, sf_dir)
    return repaired(docs, site, materialise(found)), lines, others


@query()
def p3_clean_text(spark, sf_dir):
    """Every document's text, of scanned ones the continuous paragraphs."""
    return clean_text(spark, sf_dir)[0]


@query()
def p8_pipeline(spark, sf_dir):
    """The stages in a row over all documents: what isn't prose is left out (p1), scans are repaired (p3), site lines taken out (p2), and the texts packed by tokens (p7, p8)."""
    from ..storage import materialise
    from .packing import pack_documents
    from .site_lines import remove_repeated_lines

    texts, lines, others = clean_text(spark, sf_dir)
    prose = materialise(texts.join(others, "doc_id", "left_anti"))
    sources = table(spark, sf_dir, "documents").select("doc_id", "source")
    cleaned = materialise(remove_repeated_lines(prose.join(sources, "doc_id"), lines).select("doc_id", "text"))
    return pack_documents(cleaned, base_budget(spark, sf_dir))


@query()
def p8_audit(spark, sf_dir):
    """What must hold of p8_containers: none above capacity, each document whole and once, and only larger ones divided; and the fill."""
    from .encoding import count_tokens
    from .packing import pack_documents

    capacity = base_budget(spark, sf_dir)
    docs = table(spark, sf_dir, "documents")
    packed = pack_documents(docs, capacity)
    used = packed.groupBy("shard", "bin").agg(F.sum("size").alias("size"))
    held = packed.groupBy("doc_id").agg(F.sum("size").alias("held"), F.max("piece").alias("last"))
    from .common import non_blank

    sizes = count_tokens(docs.where(non_blank())).join(held, "doc_id", "full_outer")
    wrong = sizes.agg(F.count_if(~F.col("tokens").cast("long").eqNullSafe(F.col("held").cast("long"))).alias("wrong_sizes"), F.count_if((F.col("last") > 0) & (F.col("tokens") <= capacity)).alias("needlessly_divided"))
    return used.agg(F.count("*").alias("containers"), F.ceil(F.sum("size") / capacity).alias("fewest"), F.count_if(F.col("size") > capacity).alias("overfull"), (F.sum("size") / (F.count("*") * capacity)).alias("filled")).join(wrong)


@query()
def p7_ids(spark, sf_dir):
    """The ids of every document's text."""
    from .encoding import encode

    return encode(table(spark, sf_dir, "documents"))


@query()
def p7_lengths(spark, sf_dir):
    """Of each language mark: documents, tokens and characters."""
    from .encoding import count_tokens

    docs = table(spark, sf_dir, "documents")
    sizes = count_tokens(docs).join(docs.select("doc_id", "lang", F.length("text").alias("chars")), "doc_id")
    return sizes.groupBy("lang").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.sum("chars").alias("chars"))


def base_budget(spark, sf_dir) -> int:
    """context_token_budget of the protocol `base`."""
    return table(spark, sf_dir, "protocol_setting").where("protocol_id = 'base'").orderBy(F.desc("protocol_version")).select("context_token_budget").first()[0]


@query()
def p8_found(spark, sf_dir):
    """Documents that the packing had to divide."""
    from .packing import pack_documents

    packed = pack_documents(table(spark, sf_dir, "documents"), base_budget(spark, sf_dir))
    return packed.where("piece > 0").select("doc_id").distinct()


@query()
def p8_containers(spark, sf_dir):
    """What each container holds."""
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), base_budget(spark, sf_dir))


@query()
def p8_fill(spark, sf_dir):
    """Containers used, the fewest that could do, and the share of their space that is filled."""
    from .packing import pack_documents

    capacity = base_budget(spark, sf_dir)
    packed = pack_documents(table(spark, sf_dir, "documents"), capacity)
    used = packed.groupBy("shard", "bin").agg(F.sum("size").alias("size"), F.count("*").alias("items"))
    return used.agg(F.count("*").alias("containers"), F.ceil(F.sum("size") / capacity).alias("fewest"), (F.sum("size") / (F.count("*") * capacity)).alias("filled"), F.max("size").alias("fullest"))


TOKENS = "list_filter(string_split_regex(text, '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '')"
PAGES = f"""
WITH p AS (
  SELECT doc_id, page_number, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY loaded_at DESC NULLS LAST, text DESC NULLS LAST) AS rn FROM extracted_page) WHERE rn = 1 AND text IS NOT NULL
), s AS (
  SELECT doc_id, page_number, text, len({TOKENS}) AS tokens,
    list_max(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?;:])[ \\t\\v\\f]+', '\\1' || chr(10), 'g'), '[\\n\\r]+', chr(10), 'g'), chr(10)), lambda u: len(list_filter(string_split_regex(u, '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '')))) AS longest
  FROM p
)"""


@query(
    PAGES
    + """ SELECT protocol_id, doc_id, page_number, 'oversized' AS issue FROM s, protocol_setting WHERE tokens > chunk_token_size
    UNION ALL SELECT protocol_id, doc_id, page_number, 'no_boundary' AS issue FROM s, protocol_setting WHERE longest > chunk_token_size"""
)
def p5_found(spark, sf_dir):
    """Pages above a protocol's size, and those that can't be cut at boundaries alone."""
    from .splitting import latest_pages, settings_of, split_texts

    cut = split_texts(latest_pages(table(spark, sf_dir, "extracted_page")), ["doc_id", "page_number"], settings_of(table(spark, sf_dir, "protocol_setting")))
    sizes = F.broadcast(table(spark, sf_dir, "protocol_setting").select("protocol_id", "chunk_token_size").distinct())  # settings_of has bounded it
    issue = F.explode(F.expr("filter(array(if(size(pieces) > 1 AND tokens > chunk_token_size, 'oversized', NULL), if(longest_run > chunk_token_size, 'no_boundary', NULL)), x -> x IS NOT NULL)"))
    return cut.join(sizes, "protocol_id").select("protocol_id", "doc_id", "page_number", issue.alias("issue"))


@query()
def p5_pieces(spark, sf_dir):
    """The pieces of every page for every protocol."""
    from .splitting import latest_pages, settings_of, split_texts

    pages = latest_pages(table(spark, sf_dir, "extracted_page"))
    cut = split_texts(pages, ["doc_id", "page_number"], settings_of(table(spark, sf_dir, "protocol_setting")))
    piece = cut.select("protocol_id", "doc_id", "page_number", F.posexplode("pieces").alias("piece_no", "piece"))
    return piece.select("protocol_id", "doc_id", "page_number", "piece_no", F.col("piece.start").alias("first_char"), F.col("piece.end").alias("end_char"), F.col("piece.tokens").alias("tokens"))


@query()
def p6_found(spark, sf_dir):
    """Pairs of vectors of which one is among the other's five most similar, with a cosine of at least 0.85."""
    from .neighbours import nearest

    near = nearest(table(spark, sf_dir, "chunk_vector"), 5, 0.85, scan=False)
    return near.select(F.least("vec_id", "neighbour").alias("vec_a"), F.greatest("vec_id", "neighbour").alias("vec_b")).distinct()


@query()
def p6_neighbours(spark, sf_dir):
    """The five most similar vectors of every vector."""
    from .neighbours import nearest

    return nearest(table(spark, sf_dir, "chunk_vector"), 5)


@query()
def p6_recall(spark, sf_dir):
    """The share of the true five nearest of every fiftieth vector that p6_neighbours finds, and of those with a cosine of at least 0.85 that p6_found does."""
    from ..operators.search import dense_top, usable_vectors
    from .neighbours import nearest

    rows = table(spark, sf_dir, "chunk_vector")
    asked = usable_vectors(rows, "vectors", 64).where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("vectors").alias("query"))
    true = dense_top(rows, asked, 6, "vec_id", "vectors", 64).where("qid <> vec_id").drop("rank")
    edge = true.groupBy("qid").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("qid", F.try_element_at("s", F.lit(5)).alias("edge"))
    asked_ids = asked.select(F.col("qid").alias("vec_id"))
    every = nearest(rows, 5).join(asked_ids, "vec_id").join(edge, F.col("vec_id") == F.col("qid"))
    close = nearest(rows, 5, 0.85, scan=False).join(asked_ids, "vec_id")
    good = every.agg(F.avg((F.col("cosine") >= F.coalesce("edge", F.lit(-1.0)) - 1e-5).cast("double")).alias("recall_all"), F.count("*").alias("neighbours"))
    want = true.join(edge, "qid").where("score >= 0.85 AND score >= coalesce(edge, -1)").agg(F.count("*").alias("wanted"))
    have = close.agg(F.count("*").alias("found"))
    return good.join(want).join(have).select("recall_all", "neighbours", F.least(F.col("found") / F.col("wanted"), F.lit(1.0)).alias("recall_close"), "wanted", "found")


@query()
def p4_found(spark, sf_dir):
    """Broken pairs of question and answer, of the references and of the results, and what is wrong with them."""
    from .answers import answer_defects

    return answer_defects(table(spark, sf_dir, "reference_answer"), table(spark, sf_dir, "answer_result"))


@query()
def p9_found(spark, sf_dir):
    """Documents whose running text breaks off inside a sentence or word."""
    from .cut_off import cut_off
    from .quality import document_kinds, ngram_model
    from .site_lines import repeated_lines

    docs = table(spark, sf_dir, "documents")
    lines = repeated_lines(docs)[1]
    model = ngram_model(docs)
    kinds = document_kinds(docs, table(spark, sf_dir, "kind_label"), lines=lines, model=model)
    return cut_off(docs, lines, kinds.where("kind <> 'prose'"), model)


@query()
def p9_sources(spark, sf_dir):
    """Of each source: non-blank documents, those that break off, and their share."""
    from .common import non_blank

    docs = table(spark, sf_dir, "documents").where(non_blank()).select("doc_id", "source")
    cut = p9_found(spark, sf_dir).withColumn("cut", F.lit(1))
    report = docs.join(cut, "doc_id", "left").groupBy("source").agg(F.count("*").alias("documents"), F.count("cut").alias("cut_off"))
    return report.withColumn("share", F.col("cut_off") / F.col("documents"))

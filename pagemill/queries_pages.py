"""Queries of text functions, pages and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import CHUNK, PAGE, REF, RES, chunks, pages, query, references, results
from .functions import pages as P
from .functions import text as T
from .operators import chunks as C
from .sources import readers
from .storage import table


def first_of(expr: str, n: int | None = None) -> str:
    """DuckDB's distinct values of a list in their order, the first n of them."""
    kept = f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"
    return f"{kept}[1:{n}]" if n else kept


def joined(c):
    return F.array_join(c, "|")


ENTITIES = first_of("regexp_extract_all(coalesce(text, ''), '\\b[A-Z][A-Za-z0-9&/-]{2,}\\b')", 8)
DATES = first_of("regexp_extract_all(coalesce(text, ''), '\\b(?:\\d{1,2}\\s+[A-Z][a-z]+\\s+\\d{4}|[A-Z][a-z]+\\s+\\d{1,2},\\s+\\d{4}|\\d{4}-\\d{2}-\\d{2})\\b')", 6)


@query(f"WITH {CHUNK} SELECT chunk_id, array_to_string({ENTITIES}, '|') AS entities FROM chunk")
def entities(spark, sf_dir):
    """The first eight names of every chunk."""
    return chunks(spark, sf_dir).select("chunk_id", joined(T.entities(F.coalesce("text", F.lit("")))).alias("entities"))


@query(f"WITH {CHUNK} SELECT chunk_id, array_to_string({DATES}, '|') AS dates FROM chunk")
def dates(spark, sf_dir):
    """The first six date strings of every chunk."""
    return chunks(spark, sf_dir).select("chunk_id", joined(T.date_strings(F.coalesce("text", F.lit("")))).alias("dates"))


MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"


@query(f"""WITH {CHUNK}, m AS (SELECT chunk_id, unnest(list_concat(list_transform(regexp_extract_all(text, '\\b\\d{{1,2}}\\s+(?:{MONTHS})\\s+\\d{{4}}\\b', 0, 'i'), lambda x: strftime(try_strptime(regexp_replace(x, '\\s+', ' ', 'g'), '%-d %B %Y'), '%Y-%m-%d')),
  list_transform(regexp_extract_all(text, '\\b(?:{MONTHS})\\s+\\d{{1,2}}(?:,\\s*|\\s+)\\d{{4}}\\b', 0, 'i'), lambda x: strftime(try_strptime(regexp_replace(regexp_replace(x, ',', ' ', 'g'), '\\s+', ' ', 'g'), '%B %-d %Y'), '%Y-%m-%d')),
  list_transform(regexp_extract_all(text, '\\b\\d{{4}}-\\d{{2}}-\\d{{2}}\\b'), lambda x: strftime(try_cast(x AS DATE), '%Y-%m-%d')))) AS d FROM chunk)
  SELECT chunk_id, string_agg(DISTINCT d, '|' ORDER BY d) AS dates FROM m WHERE d IS NOT NULL GROUP BY chunk_id""")
def date_candidates(spark, sf_dir):
    """Valid dates of every chunk that has any."""
    rows = chunks(spark, sf_dir).select("chunk_id", T.iso_dates(F.coalesce("text", F.lit(""))).alias("d"))
    return rows.where(F.size("d") > 0).select("chunk_id", joined(F.col("d")).alias("dates"))


def stop(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


KEYS = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN " + stop(T.STOPWORDS) + "))"
RERANK = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), lambda w: w NOT IN " + stop(T.RERANK_STOPWORDS) + "))"


def answered(spark, sf_dir):
    asked = references(spark, sf_dir).select("question_id", "question")
    return results(spark, sf_dir).select("result_id", "question_id", F.coalesce("answer.s", F.lit("")).alias("s"), "confidence").join(asked, "question_id")


@query(f"WITH {REF}, {RES} SELECT result_id, CAST(len(list_intersect({KEYS.format(x='question')}, {KEYS.format(x='x.answer.s')})) AS BIGINT) AS overlap, CAST(len({KEYS.format(x='question')}) AS BIGINT) AS asked FROM res x JOIN ref r ON x.question_id = r.question_id")
def keyword_overlap(spark, sf_dir):
    """Keywords that every answer shares with its question."""
    a, b = T.keywords(F.coalesce("question", F.lit(""))), T.keywords(F.col("s"))
    return answered(spark, sf_dir).select("result_id", T.overlap(a, b).cast("long").alias("overlap"), F.size(a).cast("long").alias("asked"))


@query(f"WITH {REF}, {RES} SELECT result_id, round(0.7 * CASE WHEN len({RERANK.format(x='question')}) > 0 THEN len(list_intersect({RERANK.format(x='question')}, {RERANK.format(x='x.answer.s')})) / len({RERANK.format(x='question')}) ELSE 0 END + 0.3 * coalesce(confidence, 0), 6) AS score FROM res x JOIN ref r ON x.question_id = r.question_id")
def rerank_lexical(spark, sf_dir):
    """The lexical rerank score of every answer against its question."""
    a, b = T.rerank_words(F.coalesce("question", F.lit(""))), T.rerank_words(F.col("s"))
    return answered(spark, sf_dir).select("result_id", F.round(T.lexical_score(a, b, F.coalesce("confidence", F.lit(0.0))), 6).alias("score"))


PARTS = "list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


@query(f"WITH {CHUNK} SELECT chunk_id, CAST(len({PARTS.format(x='text')}) AS BIGINT) AS sentences, CAST(list_max(list_transform({PARTS.format(x='text')}, lambda s: length(s))) AS BIGINT) AS longest FROM chunk WHERE text IS NOT NULL")
def sentence_split(spark, sf_dir):
    """Sentences of every chunk."""
    rows = chunks(spark, sf_dir).where("text IS NOT NULL").select("chunk_id", T.sentences(F.col("text")).alias("s"))
    return rows.select("chunk_id", F.size("s").cast("long").alias("sentences"), F.array_max(F.transform("s", F.length)).cast("long").alias("longest"))


MARKED = "regexp_replace(trim(regexp_replace(answer.s, '\\s+', ' ', 'g')), '([\\pL\\pN_]+)', chr(2) || '\\1' || chr(2), 'g')"  # RE2's own word boundary knows ASCII only


@query(f"WITH {RES} SELECT result_id, array_to_string(list_filter(list_transform(string_split_regex({MARKED}, '(?i)\\x02(?:because|since|due\\x02 \\x02to|as|therefore|thus|but)\\x02|[;:]'), lambda x: regexp_replace(replace(x, chr(2), ''), '^[ ,.]+|[ ,.]+$', '', 'g')), lambda x: x <> ''), '|') AS clauses FROM res WHERE answer.s IS NOT NULL")
def grounding_clauses(spark, sf_dir):
    """Clauses of every answer's text."""
    return results(spark, sf_dir).where("answer.s IS NOT NULL").select("result_id", joined(T.grounding_clauses(F.col("answer.s"))).alias("clauses"))


SIGNAL = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"WITH {RES} SELECT result_id, {SIGNAL.format(x='answer.s')} AS signal, array_to_string(list_filter([{', '.join(f'CASE WHEN regexp_matches(lower(answer.s), {chr(39)}{p}{chr(39)}) THEN {chr(39)}{k}{chr(39)} END' for k, p in sorted(T.OUTCOMES.items()))}], lambda x: x IS NOT NULL), '|') AS outcomes FROM res WHERE answer.s IS NOT NULL")
def answer_signals(spark, sf_dir):
    """Every answer's normalised text and the outcomes that it names."""
    rows = results(spark, sf_dir).where("answer.s IS NOT NULL").withColumn("s", F.col("answer.s"))
    return rows.select("result_id", T.signal(F.col("s")).alias("signal"), joined(T.outcome_flags(F.col("s"))).alias("outcomes"))


VERBOSE = "trim(regexp_replace(answer.s, '\\s+', ' ', 'g'))"
CUTS = " ".join(f"WHEN strpos({VERBOSE}, '{s}') > 1 AND length(trim(split_part({VERBOSE}, '{s}', 1))) >= 3 THEN trim(split_part({VERBOSE}, '{s}', 1))" for s in (" has ", " is ", " was ", " (", " — "))


@query(f"WITH {RES} SELECT result_id, CASE WHEN regexp_matches({VERBOSE}, '(?i)^((?:CFI|SCT|ARB|DEC|TCD|ENF|CA)\\s*\\d{{1,4}}\\s*/\\s*\\d{{2,4}})\\b') THEN regexp_extract({VERBOSE}, '(?i)^((?:CFI|SCT|ARB|DEC|TCD|ENF|CA)\\s*\\d{{1,4}}\\s*/\\s*\\d{{2,4}})\\b', 1) {CUTS} ELSE {VERBOSE} END AS name FROM res WHERE answer.s IS NOT NULL")
def verbose_names(spark, sf_dir):
    """Every answer without what explains its name."""
    return results(spark, sf_dir).where("answer.s IS NOT NULL").select("result_id", T.verbose_name(F.col("answer.s")).alias("name"))


MARKS = " + ".join(f"CAST(contains(lower(text), '{m}') AS BIGINT)" for m in T.LEGAL_MARKERS)


@query(f"WITH {PAGE} SELECT doc_id, page_number, {MARKS} AS markers, CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS BIGINT) AS tokens, round(CASE WHEN length(text) > 0 THEN (length(text) - length(regexp_replace(text, '[\\x{{FFFD}}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'))) / length(text) ELSE 0 END, 6) AS bad_ratio, sha256(text) AS digest FROM page WHERE text IS NOT NULL")
def page_text_signals(spark, sf_dir):
    """Markers, tokens, bad characters and digest of every page."""
    t = F.col("text")
    return pages(spark, sf_dir).where("text IS NOT NULL").select("doc_id", "page_number", T.legal_marker_count(t).cast("long").alias("markers"), T.token_estimate(t).cast("long").alias("tokens"), F.round(T.bad_char_ratio(t), 6).alias("bad_ratio"), F.sha2(t, 256).alias("digest"))


SIGNALS = "SELECT DISTINCT doc_id, recorded_at, coalesce(text_char_count, 0) AS c, coalesce(bad_char_ratio, 0) AS b, coalesce(max_image_area_ratio, 0) AS i, coalesce(table_count, 0) AS t, coalesce(legal_marker_count, 0) AS m FROM page_signal"


def signals(spark, sf_dir):
    cols = {"c": "text_char_count", "b": "bad_char_ratio", "i": "max_image_area_ratio", "t": "table_count", "m": "legal_marker_count"}
    return table(spark, sf_dir, "page_signal").select("doc_id", "recorded_at", *[F.coalesce(v, F.lit(0)).alias(k) for k, v in cols.items()]).distinct()


TRIAGE = "CASE WHEN c < 50 OR (i >= 0.70 AND c < 200) THEN 'scan' WHEN c <= 200 OR b >= 0.05 OR (i >= 0.25 AND c < 1500) THEN 'suspicious' ELSE 'native_clean' END"


@query(f"WITH s AS ({SIGNALS}) SELECT doc_id, recorded_at, c, {TRIAGE} AS label FROM s")
def page_triage(spark, sf_dir):
    """The route of every recording."""
    return signals(spark, sf_dir).select("doc_id", "recorded_at", "c", P.triage_label(F.col("c"), F.col("b"), F.col("i")).alias("label"))


@query(f"WITH s AS ({SIGNALS}) SELECT doc_id, recorded_at, round(0.5 * least(c / 1500, 1.0) + 0.3 * (1 - least(b / 0.05, 1.0)) + 0.2 * least(m / 3, 1.0), 4) AS score, array_to_string(list_filter([CASE WHEN c < 50 THEN 'low_text' END, CASE WHEN b >= 0.05 THEN 'bad_encoding' END, CASE WHEN i >= 0.25 THEN 'large_image' END, CASE WHEN t > 0 THEN 'has_tables' END, CASE WHEN m = 0 THEN 'missing_legal_markers' END], lambda x: x IS NOT NULL), '|') AS flags FROM s")
def page_quality(spark, sf_dir):
    """The quality score and flags of every recording."""
    c = {k: F.col(k) for k in "cbitm"}
    return signals(spark, sf_dir).select("doc_id", "recorded_at", P.quality_score(c["c"], c["b"], c["m"]).alias("score"), joined(P.quality_flags(c["c"], c["b"], c["i"], c["t"], c["m"])).alias("flags"))


STATE = "CASE WHEN native_chars < 50 THEN 'scan' WHEN native_chars <= 200 THEN 'suspicious' ELSE 'native_clean' END"


@query(f"""WITH {PAGE}, s AS (SELECT doc_id, page_number, {STATE} AS label, coalesce(ocr_enabled, false) AS req, CASE WHEN source_mode = 'ocr' THEN '' ELSE coalesce(text, '') END AS nat, CASE WHEN source_mode = 'ocr' THEN coalesce(text, '') ELSE '' END AS ocr FROM page),
  r AS (SELECT *, label <> 'native_clean' AND length(trim(ocr)) > 0 AND (label = 'scan' OR length(trim(nat)) = 0 OR length(trim(ocr)) > length(trim(nat))) AS use_ocr FROM s)
  SELECT doc_id, page_number, label, CASE WHEN use_ocr THEN 'ocr' ELSE 'native' END AS mode, CASE WHEN NOT use_ocr AND ((label = 'scan' AND length(trim(ocr)) = 0) OR (label = 'suspicious' AND req AND length(trim(ocr)) = 0)) THEN 'degraded' ELSE 'parsed' END AS status FROM r""")
def page_state(spark, sf_dir):
    """Which text of every page counts, native or read, and its status."""
    label = F.when(F.col("native_chars") < 50, "scan").when(F.col("native_chars") <= 200, "suspicious").otherwise("native_clean")
    rows = pages(spark, sf_dir).select(
        "doc_id", "page_number", label.alias("label"), F.coalesce("ocr_enabled", F.lit(False)).alias("req"),
        F.when(F.col("source_mode") == "ocr", "").otherwise(F.coalesce("text", F.lit(""))).alias("nat"), F.when(F.col("source_mode") == "ocr", F.coalesce("text", F.lit(""))).otherwise("").alias("ocr"),
    )
    return rows.select("doc_id", "page_number", "label", P.page_state(F.col("label"), F.col("nat"), F.col("ocr"), F.col("req")).alias("s")).select("doc_id", "page_number", "label", "s.mode", "s.status")


HEAD = "upper(array_to_string(list_transform(string_split_regex(text, '\\r?\\n')[1:4], lambda x: trim(x, ' ')), ' '))"


@query(f"WITH h AS (SELECT doc_id, {HEAD} AS h, list_filter(list_transform(string_split_regex(text, '\\r?\\n'), lambda x: trim(x, ' ')), lambda x: x <> '')[1] AS title FROM documents WHERE text IS NOT NULL) SELECT doc_id, title, CASE WHEN contains(h, 'LAW NO.') OR contains(h, 'DIFC LAW') OR ends_with(h, ' LAW') THEN 'law_or_regulation' WHEN {' OR '.join(f'contains(h, {chr(39)}{m}{chr(39)})' for m in T.COURT_MARKERS)} THEN 'court_or_arbitration_decision' ELSE 'other_legal_document' END AS family FROM h")
def doc_family(spark, sf_dir):
    """The family and title of every document by its first lines."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", T.first_line(F.col("text")).alias("title"), T.document_family(F.col("text")).alias("family"))


@query("SELECT doc_id, CASE WHEN max(legal_marker_count) >= 8 THEN 'tagged' WHEN sum(coalesce(text_char_count, 0)) >= 50 OR coalesce(bool_or(table_count > 0 OR drawing_count > 0 OR image_block_count > 0), false) THEN 'hybrid' ELSE 'local_only' END AS route FROM page_signal GROUP BY doc_id")
def parser_route(spark, sf_dir):
    """The parser route of every document by its profile."""
    rows = table(spark, sf_dir, "page_signal").groupBy("doc_id").agg(
        F.max("legal_marker_count").alias("m"), F.sum(F.coalesce("text_char_count", F.lit(0))).alias("c"),
        F.coalesce(F.bool_or((F.col("table_count") > 0) | (F.col("drawing_count") > 0) | (F.col("image_block_count") > 0)), F.lit(False)).alias("x"),
    )
    return rows.select("doc_id", P.parser_route(F.coalesce(F.col("m") >= 8, F.lit(False)), F.col("c") >= 50, F.col("x"), F.lit(True)).alias("route"))


SAMPLES = "(VALUES (1, 'glyph<c=3>Rule/comma see A/hyphen.B/space.x end'), (2, '/unknown.alt text /period'), (3, '  plain   text '), (4, NULL)) AS t(id, raw)"


@query(f"SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, 'glyph<[^>]*>', '', 'g'), '/comma(?:\\.[a-z]+)*', ',', 'g'), '/period(?:\\.[a-z]+)*', '.', 'g'), '/colon(?:\\.[a-z]+)*', ':', 'g'), '/hyphen(?:\\.[a-z]+)*', '-', 'g'), '/space(?:\\.[a-z]+)*', ' ', 'g'), '/[a-z]+(?:\\.[a-z]+)*', '', 'g'), '\\s+', ' ', 'g')) AS cleaned FROM {SAMPLES}")
def glyph_cleanup(spark, sf_dir):
    """Glyph marks and commands of parsers taken out of a few samples, as no table holds any."""
    return spark.sql(f"SELECT * FROM {SAMPLES.replace('AS t(id, raw)', 'AS t(id, raw)')}").select("id", T.glyph_cleanup(F.col("raw")).alias("cleaned"))


@query(f"WITH {PAGE} SELECT doc_id, max(page_number) AS page_count FROM page GROUP BY doc_id")
def page_count_registry(spark, sf_dir):
    """Page counts of all documents."""
    return readers.page_registry(pages(spark, sf_dir))


@query(f"WITH {PAGE} SELECT doc_id, page_number, CASE WHEN source_mode = 'ocr' THEN array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> ''), chr(10) || chr(10)) ELSE text END AS text, CASE WHEN length(trim(coalesce(text, ''), ' ')) < 50 THEN 'ocr' ELSE 'native' END AS route FROM page")
def page_reload(spark, sf_dir):
    """Every page's text with block boundaries and its extraction route."""
    return pages(spark, sf_dir).select("doc_id", "page_number", readers.reloaded_text(F.col("text"), F.col("source_mode")).alias("text"), readers.extraction_route(F.col("text")).alias("route"))


PAGE_WORDS = "regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')"


@query(f"WITH {PAGE}, w AS (SELECT doc_id, page_number, {PAGE_WORDS} AS w FROM page), s AS (SELECT *, unnest(range(0, CAST(greatest(ceil((len(w) - 300) / 250), 0) AS BIGINT) + 1)) * 250 AS start FROM w WHERE len(w) > 0) SELECT doc_id, page_number, CAST(start AS INTEGER) AS start, CAST(len(w[start + 1:start + 300]) AS INTEGER) AS tokens, array_to_string(w[start + 1:start + 300], ' ') AS text FROM s")
def fixed_chunks(spark, sf_dir):
    """Windows of 300 tokens that overlap by 50 over every page."""
    return C.fixed_windows(pages(spark, sf_dir), 300, 50)


SEG = "list_filter(list_transform(segments, lambda s: {'p': s.page_number, 'w': regexp_extract_all(coalesce(s.text, ''), '[^ \\t\\n\\x0B\\f\\r]+')}), lambda s: len(s.w) > 0)"


@query(f"""WITH {CHUNK}, s AS (SELECT chunk_id, doc_id, unnest({SEG}) AS s, unnest(range(1, len({SEG}) + 1)) AS i FROM chunk),
  u AS (SELECT chunk_id, doc_id, i, s.p AS p, s.w AS w, 60 - coalesce(sum(len(s.w)) OVER (PARTITION BY chunk_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM s),
  k AS (SELECT chunk_id, doc_id, string_agg(CAST(p AS VARCHAR), ',' ORDER BY i) AS pages, string_agg(array_to_string(w[1:CAST(room AS BIGINT)], ' '), chr(10) ORDER BY i) AS text FROM u WHERE room > 0 GROUP BY chunk_id, doc_id)
  SELECT chunk_id, doc_id, pages, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pages, text ORDER BY chunk_id) AS r FROM k) WHERE r = 1""")
def chunk_dedupe_cap(spark, sf_dir):
    """Chunks of at most 60 tokens, equal ones once."""
    out = C.capped_chunks(chunks(spark, sf_dir), 60)
    return out.select("chunk_id", "doc_id", F.array_join(F.transform("page_span", lambda p: p.cast("string")), ",").alias("pages"), "text")


@query()
def carried_headings(spark, sf_dir):
    """Headings in force on every page."""
    return C.carried_headings(pages(spark, sf_dir)).select("doc_id", "page_number", "part", "article", "section", "label")


@query(f"""WITH {PAGE}, l AS (SELECT doc_id, page_number, source_mode AS k FROM page), g AS (SELECT *, sum(CASE WHEN k IS NULL OR k IS DISTINCT FROM pk THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_number) AS run FROM (SELECT *, lag(k) OVER (PARTITION BY doc_id ORDER BY page_number) AS pk FROM l)),
  i AS (SELECT doc_id, k AS source_mode, min(page_number) AS "first", max(page_number) AS "last", count(*) AS size FROM g WHERE k IS NOT NULL GROUP BY doc_id, k, run) SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "first") AS island FROM i""")
def section_islands(spark, sf_dir):
    """Runs of consecutive pages of the same mode in every document."""
    return C.islands(pages(spark, sf_dir).select("doc_id", "page_number", "source_mode"), "doc_id", "page_number", "source_mode").withColumn("island", F.col("island").cast("long"))


@query(f'WITH {PAGE}, g AS (SELECT doc_id, page_number, page_number - row_number() OVER (PARTITION BY doc_id ORDER BY page_number) AS g FROM page) SELECT doc_id, min(page_number) AS "first", max(page_number) AS "last" FROM g GROUP BY doc_id, g')
def page_runs(spark, sf_dir):
    """Runs of consecutive page numbers of every document."""
    return C.page_runs(pages(spark, sf_dir))


@query(f"""WITH {PAGE}, p AS (SELECT doc_id, page_number, list_filter(list_transform(string_split(regexp_replace(text, '\\n\\s*\\n', chr(10), 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ps FROM page WHERE text IS NOT NULL),
  r AS (SELECT doc_id, page_number, unnest(ps) AS para, unnest(range(0, len(ps))) AS pos FROM p),
  o AS (SELECT *, nullif(regexp_extract(para, '^(\\([A-Za-z0-9]+\\)|\\d+[A-Za-z]?(?:[.)])?|[A-Za-z](?:[.)]))\\s+\\S', 1), '') AS own FROM r),
  n AS (SELECT *, count(own) OVER (PARTITION BY doc_id, page_number) AS labels, count(own) OVER (PARTITION BY doc_id, page_number ORDER BY pos) AS k FROM o)
  SELECT doc_id, page_number, clause, CASE WHEN labels = 0 THEN CAST(clause AS VARCHAR) WHEN clause = 0 THEN 'lead-in' ELSE own END AS label, text FROM (SELECT doc_id, page_number, CAST(CASE WHEN labels = 0 THEN pos + 1 ELSE k END AS INTEGER) AS clause, any_value(labels) AS labels, max(own) AS own, string_agg(para, chr(10) || chr(10) ORDER BY pos) AS text FROM n GROUP BY doc_id, page_number, CAST(CASE WHEN labels = 0 THEN pos + 1 ELSE k END AS INTEGER))""")
def clause_groups(spark, sf_dir):
    """Clauses of every page."""
    return C.clause_groups(pages(spark, sf_dir))


@query(f"WITH {CHUNK}, p AS (SELECT chunk_id, page_span FROM chunk WHERE page_span IS NOT NULL) SELECT chunk_id, array_to_string(CASE WHEN len(list_filter(page_span, lambda x: x IS NULL OR x <= 0)) = 0 THEN list_sort(list_distinct(page_span)) ELSE [] END, ',') AS strict, array_to_string(list_filter(page_span, lambda x: x > 0), ',') AS lenient FROM p")
def page_spans(spark, sf_dir):
    """Page spans of every chunk by both rules."""
    text = lambda c: F.array_join(F.transform(c, lambda p: p.cast("string")), ",")
    return chunks(spark, sf_dir).where("page_span IS NOT NULL").select("chunk_id", text(P.strict_span(F.col("page_span"))).alias("strict"), text(P.lenient_span(F.col("page_span"))).alias("lenient"))


@query(f"WITH {CHUNK} SELECT doc_id, chunk_type, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens, CAST(max(length(text)) AS BIGINT) AS longest FROM chunk WHERE chunk_type IN ('page', 'clause', 'section') GROUP BY doc_id, chunk_type")
def index_statistics(spark, sf_dir):
    """Chunks and tokens of every document by family."""
    rows = chunks(spark, sf_dir).where(F.col("chunk_type").isin("page", "clause", "section"))
    return rows.groupBy("doc_id", "chunk_type").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.max(F.length("text")).cast("long").alias("longest"))


@query(f"""WITH {PAGE}, {CHUNK}, a AS (SELECT doc_id, list_sort(list(page_number)) AS pages FROM page GROUP BY doc_id), b AS (SELECT doc_id, list_sort(list(DISTINCT p)) AS mapped FROM (SELECT doc_id, unnest(page_span) AS p FROM chunk) WHERE p IS NOT NULL GROUP BY doc_id)
  SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, pages IS NOT DISTINCT FROM mapped AS equal FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def attribution_check(spark, sf_dir):
    """Whether the chunks of every document cover exactly its pages."""
    a = pages(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list("page_number")).alias("pages"))
    b = chunks(spark, sf_dir).select("doc_id", F.explode("page_span").alias("p")).where("p IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_set("p")).alias("mapped"))
    return a.join(b, "doc_id", "full_outer").select("doc_id", F.col("pages").eqNullSafe(F.col("mapped")).alias("equal"))


TABLES = f"""t AS (SELECT doc_id, page_number, unnest(page_tables) AS tab, unnest(range(1, len(page_tables) + 1)) AS n FROM (SELECT * FROM page WHERE len(page_tables) > 0)),
rws AS (SELECT doc_id, page_number, n, list_transform(list_filter(string_split_regex(tab, '\\r?\\n'), lambda r: regexp_replace(r, '[-+|=:\\s]', '', 'g') <> ''), lambda r: list_transform(string_split_regex(regexp_replace(trim(r, ' '), '^\\||\\|$', '', 'g'), '\\||\\t|;|\\s{{2,}}'), lambda c: trim(c, ' '))) AS cells FROM t)"""


def table_rows_of(spark, sf_dir):
    rows = pages(spark, sf_dir).where(F.size("page_tables") > 0).select("doc_id", "page_number", F.posexplode("page_tables").alias("at", "tab"))
    return rows.select("doc_id", "page_number", (F.col("at") + 1).cast("long").alias("n"), P.table_cells(F.col("tab")).alias("cells"))


@query(f"WITH {PAGE}, {TABLES} SELECT doc_id, page_number, n, unnest(range(1, len(cells) + 1)) AS row_no, unnest(list_transform(cells, lambda r: array_to_string(r, '; '))) AS text FROM rws")
def table_rows(spark, sf_dir):
    """Every table's rows as texts."""
    rows = table_rows_of(spark, sf_dir).select("doc_id", "page_number", "n", F.posexplode("cells").alias("at", "cells"))
    return rows.select("doc_id", "page_number", "n", (F.col("at") + 1).cast("long").alias("row_no"), F.array_join("cells", "; ").alias("text"))


LINE = "'| ' || array_to_string(list_resize(r, CAST(wide AS BIGINT), ''), ' | ') || ' |'"


@query(f"""WITH {PAGE}, {TABLES}, w AS (SELECT *, list_max(list_transform(cells, lambda r: len(r))) AS wide FROM rws WHERE len(cells) > 0), ls AS (SELECT doc_id, page_number, n, wide, list_transform(cells, lambda r: {LINE}) AS lines FROM w)
  SELECT doc_id, page_number, n, array_to_string(list_concat(list_concat(lines[1:1], ['| ' || array_to_string(list_transform(range(0, wide), lambda i: '---'), ' | ') || ' |']), lines[2:]), chr(10)) AS markdown FROM ls""")
def table_markdown(spark, sf_dir):
    """Every table as a pipe table."""
    return table_rows_of(spark, sf_dir).where(F.size("cells") > 0).select("doc_id", "page_number", "n", P.markdown_rows(F.col("cells")).alias("markdown"))


Q = "FROM ref WHERE question IS NOT NULL"
CASES = first_of("list_transform(list_concat(regexp_extract_all(question, '\\bcase\\s*(?:no\\.?|number)?\\s*(\\d{1,4}\\s*/\\s*\\d{2,4})\\b', 1, 'i'), regexp_extract_all(question, '\\b(?:CFI|SCT|ARB|DEC|TCD|ENF|CA)\\s*(\\d{1,4}\\s*/\\s*\\d{2,4})\\b', 1, 'i')), lambda x: regexp_replace(x, '\\s+', '', 'g'))")
LAWS = first_of("list_filter(list_transform(regexp_extract_all(question, '\\b((?:[A-Z]{2,}\\s+)?[A-Za-z]+(?:\\s+[A-Za-z]+){0,3}\\s+Law)\\b', 1), lambda z: lower(regexp_replace(trim(regexp_replace(z, '\\s+', ' ', 'g')), '^(?:which|what|under|the)\\s+', '', 'i'))), lambda y: y <> '')")
LOW = "lower(trim(regexp_replace(question, '\\s+', ' ', 'g')))"
MULTI = f"(len({CASES}) >= 2 OR regexp_matches({LOW}, '\\b(across|between|both|related\\s+matters?|related\\s+cases?|multiple|versus|vs\\.?)\\b') OR (length({LOW}) - length(replace({LOW}, ' and ', ''))) / 5 >= 2)"
CLASS = f"CASE WHEN {MULTI} THEN 'cross_case' WHEN len({CASES}) > 0 THEN 'case' WHEN len({LAWS}) > 0 THEN 'statute' ELSE 'free_text' END"


def asked(spark, sf_dir):
    return references(spark, sf_dir).where("question IS NOT NULL").withColumn("q", F.col("question"))


@query(f"WITH {REF} SELECT question_id, array_to_string({CASES}, '|') AS cases, array_to_string({LAWS}, '|') AS laws, {MULTI} AS multi {Q}")
def query_metadata(spark, sf_dir):
    """Cases, laws and the sign of several documents in every question."""
    q = F.col("q")
    return asked(spark, sf_dir).select("question_id", joined(T.case_numbers(q)).alias("cases"), joined(T.statutes(q)).alias("laws"), T.likely_multi_document(q).alias("multi"))


@query(f"WITH {REF} SELECT question_id, {CLASS} AS class {Q}")
def question_class(spark, sf_dir):
    """The class of every question."""
    return asked(spark, sf_dir).select("question_id", T.question_class(F.col("q")).alias("class"))


@query(f"WITH {REF}, c AS (SELECT question_id, question, {CLASS} AS class, regexp_matches(question, '(?i)\\b(?:title|cover)\\s+page\\b') AND regexp_matches(question, '(?i)\\b(?:official\\s+)?(?:difc\\s+)?law\\s+(?:no\\.?|number)\\b') AS t {Q}), b AS (SELECT *, CASE WHEN class IN ('case', 'cross_case') THEN regexp_matches(question, '(?i)\\b(?:across|between|both|all\\s+documents?|every\\s+document|full\\s+case\\s+files?|each\\s+document)\\b') WHEN class = 'statute' THEN regexp_matches(question, '(?i)\\b(?:which\\s+specific|which)\\s+.*\\blaws?\\b.*\\bamend(?:ed|s|ing)\\b') ELSE false END AS m FROM c) SELECT question_id, CAST(greatest(10, CASE WHEN t THEN 12 ELSE 0 END, CASE WHEN m AND class = 'cross_case' THEN 30 WHEN m AND class = 'case' THEN 18 WHEN m AND class = 'statute' THEN 40 ELSE 0 END) AS INTEGER) AS candidates, CAST(greatest(5, CASE WHEN m AND class = 'cross_case' THEN 10 WHEN m AND class = 'case' THEN 8 WHEN m AND class = 'statute' THEN 12 ELSE 0 END) AS INTEGER) AS reranked, CAST(greatest(3, CASE WHEN m AND class = 'cross_case' THEN 6 WHEN m AND class = 'case' THEN 5 WHEN m AND class = 'statute' THEN 8 ELSE 0 END) AS INTEGER) AS evidence FROM b")
def budgets(spark, sf_dir):
    """Budgets of every question: the defaults, raised by its class and predicates."""
    q = F.col("q")
    rows = asked(spark, sf_dir).select("question_id", T.question_class(q).alias("k"), T.title_law_number(q).alias("t"), T.needs_coverage(q, T.question_class(q)).alias("m"))
    floor = lambda cross, case, law: F.when(F.col("m") & (F.col("k") == "cross_case"), cross).when(F.col("m") & (F.col("k") == "case"), case).when(F.col("m") & (F.col("k") == "statute"), law).otherwise(0)
    title = lambda n: F.when(F.col("t"), n).otherwise(0)
    return rows.select("question_id", F.greatest(F.lit(10), title(12), floor(30, 18, 40)).alias("candidates"), F.greatest(F.lit(5), title(4), floor(10, 8, 12)).alias("reranked"), F.greatest(F.lit(3), title(2), floor(6, 5, 8)).alias("evidence"))


@query()
def query_expansion(spark, sf_dir):
    """Up to three further wordings of every question."""
    return asked(spark, sf_dir).select("question_id", F.posexplode(T.query_expansions(F.col("q"))).alias("at", "wording"))


@query()
def sentence_chunks(spark, sf_dir):
    """Windows of whole sentences of every page, 300 tokens with an overlap of 50."""
    return C.sentence_chunks(pages(spark, sf_dir), 300, 50)


@query(f"WITH {CHUNK} SELECT chunk_id, array_to_string(list_transform(regexp_extract_all(text, '(?:^|[^\\w.,])([-+]?\\d[\\d,]*(?:\\.\\d+)?)', 1), lambda x: replace(x, ',', '')), '|') AS numbers FROM chunk WHERE text IS NOT NULL")
def number_candidates(spark, sf_dir):
    """Numbers in digits of every chunk, without thousands separators."""
    return chunks(spark, sf_dir).where("text IS NOT NULL").select("chunk_id", joined(T.numbers(F.col("text"))).alias("numbers"))


@query(f"WITH {RES} SELECT result_id, coalesce(try_cast(answer.s AS DOUBLE), 0.0) AS score FROM res")
def score_coercion(spark, sf_dir):
    """Every answer's text as a score, 0 where it is none."""
    from .functions.scores import coerced_score

    return results(spark, sf_dir).select("result_id", coerced_score(F.col("answer.s")).alias("score"))

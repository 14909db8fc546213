"""Queries of scoring, benchmarks and the grounding ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import REF, RES, query, references, results
from .functions import scores as S
from .functions import text as T
from .operators import ledger as L
from .sources import sinks
from .storage import table

PAIRS = "list_sort(list_distinct(flatten(list_transform(coalesce({c}, []), lambda r: list_transform(list_filter(r.page_numbers, lambda p: p > 0), lambda p: r.doc_id || ':' || lpad(CAST(p AS VARCHAR), 9, '0'))))))"
NORM = "lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"
NAMES = f"list_distinct(list_filter(list_transform(coalesce({{x}}.arr, []), lambda v: {NORM.format(x='v')}), lambda v: v <> ''))"
FIRST = "first_ans AS (SELECT * FROM (SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY run_id, question_id ORDER BY result_id) AS rf FROM res WHERE run_id IS NOT NULL AND question_id IS NOT NULL) WHERE rf = 1)"
FBETA = "CASE WHEN len({p}) = 0 AND len({g}) = 0 THEN 1.0 WHEN len({p}) = 0 OR len({g}) = 0 OR len(list_intersect({p}, {g})) = 0 THEN 0.0 ELSE 7.25 * (len(list_intersect({p}, {g})) / len({p})) * (len(list_intersect({p}, {g})) / len({g})) / (6.25 * (len(list_intersect({p}, {g})) / len({p})) + len(list_intersect({p}, {g})) / len({g})) END"
TTFT = "CASE WHEN {ms} IS NULL THEN 0.85 WHEN {ms} < 1000 THEN 1.05 WHEN {ms} < 2000 THEN 1.02 WHEN {ms} <= 3000 THEN 1.0 ELSE 0.99 - (least({ms}, 10000.0) - 3000.0) / 7000.0 * 0.14 END"
VALUE = "CASE answer_type WHEN 'boolean' THEN CAST({x}.b AS VARCHAR) WHEN 'number' THEN CAST({x}.n AS VARCHAR) WHEN 'names' THEN CASE WHEN {x}.arr IS NOT NULL THEN 'x' END ELSE {x}.s END"
ISO = "CASE WHEN regexp_full_match({x}.s, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast({x}.s AS DATE) END"
SCORED = f"""paired AS (SELECT f.run_id, f.question_id, f.confidence, f.answer AS got, r.answer AS want, r.answer_type, {PAIRS.format(c='r.gold_retrieval')} AS gold, {PAIRS.format(c='f.evidence_pages')} AS found
  FROM first_ans f JOIN ref r ON f.question_id = r.question_id),
parts AS (SELECT *, {VALUE.format(x='got')} AS gv, {VALUE.format(x='want')} AS wv, {NAMES.format(x='got')} AS gn, {NAMES.format(x='want')} AS wn, round((1 - confidence) * 12000.0, 3) AS ttft_ms FROM paired),
scored AS (SELECT run_id, question_id, answer_type, gold, found, ttft_ms,
  CASE WHEN answer_type <> 'free_text' THEN CASE WHEN gv IS NULL OR wv IS NULL THEN CASE WHEN gv IS NULL AND wv IS NULL THEN 1.0 ELSE 0.0 END
    ELSE CASE answer_type WHEN 'number' THEN CASE WHEN (want.n = 0 AND got.n = 0) OR (want.n <> 0 AND abs(got.n - want.n) <= abs(want.n) * 0.01) THEN 1.0 ELSE 0.0 END
      WHEN 'boolean' THEN CASE WHEN got.b = want.b THEN 1.0 ELSE 0.0 END WHEN 'name' THEN CASE WHEN {NORM.format(x='got.s')} = {NORM.format(x='want.s')} THEN 1.0 ELSE 0.0 END
      WHEN 'names' THEN CASE WHEN len(list_distinct(list_concat(gn, wn))) = 0 THEN 1.0 ELSE len(list_intersect(gn, wn)) / len(list_distinct(list_concat(gn, wn))) END
      WHEN 'date' THEN CASE WHEN {ISO.format(x='got')} = {ISO.format(x='want')} THEN 1.0 ELSE 0.0 END ELSE 0.0 END END END AS deterministic,
  CASE WHEN answer_type = 'free_text' THEN CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence ELSE 0.0 END END AS assistant,
  {FBETA.format(p='found', g='gold')} AS grounding, CASE WHEN len(found) = 0 THEN 0.9 ELSE 1.0 END AS telemetry, {TTFT.format(ms='ttft_ms')} AS ttft FROM parts),
totals AS (SELECT *, coalesce(deterministic, assistant, 0) * grounding * telemetry * ttft AS total FROM scored)"""
BASE = f"WITH {REF}, {RES}, {FIRST}, {SCORED}"
MEANS = "count(*) AS questions, coalesce(avg(deterministic), 0) AS deterministic, coalesce(avg(assistant), 0) AS assistant, avg(grounding) AS grounding, avg(telemetry) AS telemetry, avg(ttft) AS ttft, avg(ttft_ms) AS ttft_ms"
RUNS = "runs AS (SELECT *, (0.7 * deterministic + 0.3 * assistant) * grounding * telemetry * ttft AS total FROM (SELECT {by}, " + MEANS + " FROM {rows} GROUP BY {by}))"
OFF_TIES = ", ".join(f"round({m} + 1e-9, 6) AS {m}" for m in L.METRICS)
ROUND = ", ".join(f"round({m}, 6) AS {m}" for m in L.METRICS)


def scored(spark, sf_dir):
    return L.answer_scores(results(spark, sf_dir), references(spark, sf_dir))


def rounded(df, *names):
    for n in names:
        df = df.withColumn(n, F.round(n, 6))
    return df


def off_ties(df, *names):
    """Rounded means whose exact value may lie half way between two roundings."""
    for n in names:
        df = df.withColumn(n, F.round(F.col(n) + 1e-9, 6))
    return df


@query(f"{BASE} SELECT run_id, question_id, answer_type, {ROUND} FROM totals")
def score_answer(spark, sf_dir):
    """Scores of every answer."""
    return rounded(scored(spark, sf_dir), *L.METRICS).select("run_id", "question_id", "answer_type", *L.METRICS)


@query(f"{BASE}, {RUNS.format(by='run_id', rows='totals')} SELECT run_id, questions, {ROUND}, round(ttft_ms, 6) AS ttft_ms FROM runs")
def score_total(spark, sf_dir):
    """Scores of every run."""
    return rounded(L.run_scores(scored(spark, sf_dir), "run_id"), *L.METRICS, "ttft_ms")


@query(f"SELECT event_id, round({TTFT.format(ms='(value * 25)')}, 6) AS factor FROM events")
def score_ttft(spark, sf_dir):
    """The time factor of every event's value."""
    return table(spark, sf_dir, "events").select("event_id", F.round(S.ttft_factor(F.col("value") * 25), 6).alias("factor"))


@query(f"""{BASE} SELECT run_id, question_id, CAST(len(gold) AS BIGINT) AS gold_pages, CAST(len(list_intersect(found, gold)) AS BIGINT) AS hits, CAST(len(gold) - len(list_intersect(found, gold)) AS BIGINT) AS missed,
  round(grounding, 6) AS grounding, round(CASE WHEN len(gold) > 0 THEN CASE WHEN len(found) = 0 THEN 0.0 ELSE len(list_intersect(found, gold)) / len(found) END END, 6) AS strict_precision,
  round(CASE WHEN len(gold) > 0 THEN len(list_intersect(found, gold)) / len(gold) END, 6) AS strict_recall FROM totals""")
def score_grounding(spark, sf_dir):
    """Hits, misses, F-beta and both precision rules of every answer's pages."""
    rows = scored(spark, sf_dir)
    hits = S.common(F.col("found"), F.col("gold"))
    return rows.select(
        "run_id", "question_id", F.size("gold").cast("long").alias("gold_pages"), hits.cast("long").alias("hits"), F.size(F.array_except("gold", "found")).cast("long").alias("missed"),
        F.round("grounding", 6).alias("grounding"), F.round(S.strict_precision(F.col("found"), F.col("gold")), 6).alias("strict_precision"), F.round(S.strict_recall(F.col("found"), F.col("gold")), 6).alias("strict_recall"),
    )


DOCS = "len(list_distinct(list_transform(coalesce(gold_retrieval, []), lambda r: r.doc_id)))"
SLICES = f"""sl AS (SELECT DISTINCT question_id, unnest(list_concat(['answer_type:' || answer_type, 'source_type:' || source_type, 'difficulty:' || difficulty, 'doc_count:' || CAST({DOCS} AS VARCHAR),
  CASE WHEN {DOCS} <= 1 THEN 'doc_count:single' ELSE 'doc_count:multi' END], list_transform(coalesce(tags, []), lambda t: 'tag:' || t))) AS slice_id FROM ref), slices AS (SELECT * FROM sl WHERE slice_id IS NOT NULL)"""


@query(f"WITH {REF}, {SLICES} SELECT slice_id, count(*) AS questions, min(question_id) AS first_id FROM slices GROUP BY slice_id")
def slices_default(spark, sf_dir):
    """The default slices and their sizes."""
    return L.slices(references(spark, sf_dir)).groupBy("slice_id").agg(F.count("*").alias("questions"), F.min("question_id").alias("first_id"))


SLICED = "sliced AS (SELECT * FROM totals JOIN slices USING (question_id))"


def slice_rows(spark, sf_dir):
    return L.run_scores(scored(spark, sf_dir).join(L.slices(references(spark, sf_dir)), "question_id"), "run_id", "slice_id")


@query(f"{BASE}, {SLICES}, {SLICED}, {RUNS.format(by='run_id, slice_id', rows='sliced')} SELECT run_id, slice_id, questions, {OFF_TIES} FROM runs")
def slice_scores(spark, sf_dir):
    """Scores of every run in every slice (A10)."""
    return off_ties(slice_rows(spark, sf_dir), *L.METRICS).drop("ttft_ms")


DELTAS = ", ".join(f"round(c.{m} - b.{m} + 1e-9, 6) AS {m}_delta" for m in L.METRICS)


@query(f"{BASE}, {SLICES}, {SLICED}, {RUNS.format(by='run_id, slice_id', rows='sliced')} SELECT c.run_id, c.slice_id, {DELTAS} FROM runs c JOIN runs b ON b.run_id = 'run00' AND b.slice_id = c.slice_id WHERE c.run_id <> 'run00'")
def run_delta(spark, sf_dir):
    """Every run against the baseline run in the slices that both have."""
    return off_ties(L.run_deltas(slice_rows(spark, sf_dir), "run00", "slice_id"), *[f"{m}_delta" for m in L.METRICS])


@query(f"{BASE} SELECT c.run_id, c.question_id, round(c.total - b.total, 6) AS delta FROM totals c JOIN totals b ON b.run_id = 'run00' AND b.question_id = c.question_id WHERE c.run_id <> 'run00' AND c.total < b.total")
def regressions(spark, sf_dir):
    """Questions that a run scores lower than the baseline run."""
    rows = scored(spark, sf_dir).select("run_id", "question_id", "total")
    base = rows.where("run_id = 'run00'").select("question_id", F.col("total").alias("base"))
    return rows.where("run_id <> 'run00'").join(base, "question_id").where("total < base").select("run_id", "question_id", F.round(F.col("total") - F.col("base"), 6).alias("delta"))


@query(f"{BASE} SELECT question_id, count(*) AS runs, round(avg(total), 6) AS mean, round(stddev_pop(total), 6) AS deviation, round(min(total), 6) AS least, round(max(total), 6) AS most, stddev_pop(total) > 0.05 AS unstable FROM totals GROUP BY question_id HAVING count(*) >= 2")
def consistency(spark, sf_dir):
    """How much each question's score varies between runs."""
    return rounded(L.consistency(scored(spark, sf_dir)), "mean", "deviation", "least", "most")


@query(f"""{BASE}, m AS (SELECT run_id, coalesce(avg(deterministic), 0) AS structured, coalesce(avg(assistant), 0) AS free, avg(CASE WHEN len(gold) > 0 THEN CASE WHEN len(found) = 0 THEN 0.0 ELSE len(list_intersect(found, gold)) / len(found) END END) AS citation_precision,
  avg(CASE WHEN len(gold) > 0 THEN len(list_intersect(found, gold)) / len(gold) END) AS citation_recall FROM totals GROUP BY run_id),
  q AS (SELECT *, 0.7 * structured + 0.3 * free AS quality FROM m)
  SELECT run_id, round(quality, 6) AS quality, round(citation_precision, 6) AS citation_precision, round(citation_recall, 6) AS citation_recall,
  round(100 * (quality - lag(quality) OVER (ORDER BY run_id)), 6) AS quality_step, round(100 * (citation_recall - lag(citation_recall) OVER (ORDER BY run_id)), 6) AS recall_step FROM q""")
def variant_delta(spark, sf_dir):
    """Quality and citations of every run and the steps between consecutive ones in percentage points."""
    from pyspark.sql import Window

    rows = scored(spark, sf_dir)
    found, gold = F.col("found"), F.col("gold")
    m = rows.groupBy("run_id").agg(
        F.coalesce(F.avg("deterministic"), F.lit(0.0)).alias("s"), F.coalesce(F.avg("assistant"), F.lit(0.0)).alias("f"),
        F.avg(S.strict_precision(found, gold)).alias("citation_precision"), F.avg(S.strict_recall(found, gold)).alias("citation_recall"),
    ).withColumn("quality", 0.7 * F.col("s") + 0.3 * F.col("f"))
    order = Window.orderBy("run_id")  # one row a run
    step = lambda c: F.round(100 * (F.col(c) - F.lag(c).over(order)), 6)
    m = m.withColumn("quality_step", step("quality")).withColumn("recall_step", step("citation_recall"))
    return rounded(m.drop("s", "f"), "quality", "citation_precision", "citation_recall")


STAGES = f"""cited AS (SELECT question_id, pair, count(*) AS n FROM (SELECT question_id, unnest({PAIRS.format(c='evidence_pages')}) AS pair FROM first_ans) GROUP BY question_id, pair),
pools AS (SELECT question_id, list_sort(list(pair)) AS raw, list_sort(list(pair) FILTER (WHERE n >= 2)) AS often FROM cited GROUP BY question_id),
stages AS (SELECT f.run_id, f.question_id, r.answer_type, {PAIRS.format(c='r.gold_retrieval')} AS gold, coalesce(raw, []) AS raw, CASE WHEN len(coalesce(often, [])) > 0 THEN often ELSE coalesce(raw, []) END AS narrowed, {PAIRS.format(c='f.evidence_pages')} AS final
  FROM first_ans f JOIN ref r ON f.question_id = r.question_id LEFT JOIN pools p ON p.question_id = f.question_id),
led AS (SELECT *, CASE WHEN len(gold) = 0 THEN 1.0 ELSE len(list_intersect(gold, raw)) / len(gold) END AS raw_recall, CASE WHEN len(gold) = 0 THEN 1.0 ELSE len(list_intersect(gold, narrowed)) / len(gold) END AS pass_a_recall,
  CASE WHEN len(final) = 0 THEN CASE WHEN len(gold) = 0 THEN 1.0 ELSE 0.0 END ELSE len(list_intersect(gold, final)) / len(final) END AS final_precision, {FBETA.format(p='final', g='gold')} AS final_grounding,
  CASE WHEN len(gold) = 0 THEN 'gold_empty' WHEN list_has_any(gold, final) THEN 'hit' WHEN NOT list_has_any(gold, raw) THEN 'raw_miss' WHEN NOT list_has_any(gold, narrowed) THEN 'pass_a_miss' ELSE 'final_miss' END AS failure_bucket FROM stages)"""
LEDGER = f"WITH {REF}, {RES}, {FIRST}, {STAGES}"
PLAIN = "array_to_string(list_transform({x}, lambda p: regexp_replace(p, ':0*', ':')), '|')"


def ledger_rows(spark, sf_dir):
    return L.grounding_ledger(L.page_stages(results(spark, sf_dir), references(spark, sf_dir)))


@query(f"{LEDGER} SELECT run_id, question_id, answer_type, {PLAIN.format(x='gold')} AS gold_pages, {PLAIN.format(x='raw')} AS raw_pages, {PLAIN.format(x='narrowed')} AS pass_a_pages, {PLAIN.format(x='final')} AS final_pages, round(raw_recall, 6) AS raw_recall, round(pass_a_recall, 6) AS pass_a_recall, round(final_precision, 6) AS final_precision, round(final_grounding, 6) AS final_grounding, failure_bucket FROM led")
def grounding_ledger(spark, sf_dir):
    """Which pages each run had at each stage and where it lost the gold ones."""
    rows = rounded(ledger_rows(spark, sf_dir), "raw_recall", "pass_a_recall", "final_precision", "final_grounding")
    text = {"gold": "gold_pages", "raw": "raw_pages", "narrowed": "pass_a_pages", "final": "final_pages"}
    return rows.select("run_id", "question_id", "answer_type", *[S.encoded_pairs(F.col(k)).alias(v) for k, v in text.items()], "raw_recall", "pass_a_recall", "final_precision", "final_grounding", "failure_bucket")


SUMMARY = """SELECT run_id, count(*) AS question_count, count(*) FILTER (WHERE failure_bucket = 'gold_empty') AS gold_empty_count, count(*) FILTER (WHERE failure_bucket = 'raw_miss') AS raw_miss_count, count(*) FILTER (WHERE failure_bucket = 'pass_a_miss') AS pass_a_miss_count,
  count(*) FILTER (WHERE failure_bucket = 'final_miss') AS final_miss_count, count(*) FILTER (WHERE failure_bucket = 'hit') AS hit_count, round(coalesce(avg(raw_recall) FILTER (WHERE failure_bucket <> 'gold_empty'), 0), 6) AS mean_raw_recall,
  round(coalesce(avg(pass_a_recall) FILTER (WHERE failure_bucket <> 'gold_empty'), 0), 6) AS mean_pass_a_recall, round(coalesce(avg(final_grounding) FILTER (WHERE failure_bucket <> 'gold_empty'), 0), 6) AS mean_final_grounding,
  round(coalesce(count(*) FILTER (WHERE failure_bucket = 'raw_miss') / nullif(count(*) FILTER (WHERE failure_bucket <> 'gold_empty'), 0), 0), 6) AS raw_miss_rate, round(coalesce(count(*) FILTER (WHERE failure_bucket = 'pass_a_miss') / nullif(count(*) FILTER (WHERE failure_bucket <> 'gold_empty'), 0), 0), 6) AS pass_a_miss_rate,
  round(coalesce(count(*) FILTER (WHERE failure_bucket = 'final_miss') / nullif(count(*) FILTER (WHERE failure_bucket <> 'gold_empty'), 0), 0), 6) AS final_miss_rate FROM led GROUP BY run_id"""


def summary_rows(spark, sf_dir):
    means = ["mean_raw_recall", "mean_pass_a_recall", "mean_final_grounding", "raw_miss_rate", "pass_a_miss_rate", "final_miss_rate"]
    return rounded(L.grounding_summary(ledger_rows(spark, sf_dir)), *means)


@query(f"{LEDGER} {SUMMARY}")
def grounding_summary(spark, sf_dir):
    """Failure counts, rates and means of each run."""
    return summary_rows(spark, sf_dir)


@query(f"""{LEDGER}, f AS (SELECT question_id, count(DISTINCT run_id) AS run_count, count(*) AS total_failures, count(*) FILTER (WHERE failure_bucket = 'raw_miss') AS raw_miss_count, count(*) FILTER (WHERE failure_bucket = 'pass_a_miss') AS pass_a_miss_count,
  count(*) FILTER (WHERE failure_bucket = 'final_miss') AS final_miss_count, min(answer_type) AS answer_type FROM led WHERE failure_bucket IN ('raw_miss', 'pass_a_miss', 'final_miss') GROUP BY question_id)
  SELECT *, CASE WHEN raw_miss_count >= greatest(pass_a_miss_count, final_miss_count) THEN 'raw_miss' WHEN pass_a_miss_count >= final_miss_count THEN 'pass_a_miss' ELSE 'final_miss' END AS dominant_bucket FROM f ORDER BY run_count DESC, total_failures DESC, question_id LIMIT 50""")
def top_failures(spark, sf_dir):
    """The fifty questions that fail in most runs."""
    return L.top_failures(ledger_rows(spark, sf_dir), 50)


@query(f"{LEDGER}, new AS ({SUMMARY}) SELECT run_id, question_count, hit_count, printf('%.12f', mean_final_grounding) AS grounding FROM new")
def summary_upsert(spark, sf_dir):
    """The summary of all runs after half of its rows were stale and have been replaced (K3)."""
    new = summary_rows(spark, sf_dir).select("run_id", "question_count", "hit_count", sinks.fixed_decimals(F.col("mean_final_grounding")).alias("grounding"))
    old = new.withColumn("question_count", F.when(F.col("run_id") < "run04", F.lit(-1)).otherwise(F.col("question_count")).cast("long"))
    return sinks.summary_upsert(old, new.where("run_id < 'run04'"))


@query(f"WITH {REF}, {RES}, {FIRST} SELECT run_id, question_id, {PLAIN.format(x=PAIRS.format(c='evidence_pages'))} AS encoded, CAST(len({PAIRS.format(c='evidence_pages')}) AS BIGINT) AS decoded FROM first_ans")
def pairs_codec(spark, sf_dir):
    """Pages of every answer encoded, and how many come back."""
    rows = L.first_answers(results(spark, sf_dir)).withColumn("encoded", S.encoded_pairs(L.S_pairs("evidence_pages")))
    return rows.select("run_id", "question_id", "encoded", F.size(S.decoded_pairs(F.col("encoded"))).cast("long").alias("decoded"))


@query(f"WITH {REF} SELECT question_id, substr(regexp_replace(question_id, '[^A-Za-z0-9._-]+', '_', 'g'), 1, 48) || '__' || substr(sha256(question_id), 1, 12) || '.json' AS name FROM ref")
def trace_filename(spark, sf_dir):
    """The name of every question's trace file (K4)."""
    return references(spark, sf_dir).select("question_id", sinks.trace_name(F.col("question_id")).alias("name"))


BUCKET = "CASE WHEN len(regexp_extract_all(question, '\\b[A-Z]{2,4}\\s?\\d{1,3}/\\d{4}\\b')) >= 2 OR " + " OR ".join(f"contains(' ' || lower(trim(question)) || ' ', '{h}')" for h in T.COMPARATIVE_HINTS) + " THEN 'comparative_multi_document' WHEN " + " OR ".join(f"contains(' ' || lower(trim(question)) || ' ', '{h}')" for h in T.NEGATIVE_HINTS) + " THEN 'negative_unanswerable' WHEN answer_type = 'free_text' THEN 'free_text' ELSE 'standard' END"


@query(f"WITH {REF} SELECT question_id, {BUCKET} AS bucket FROM ref WHERE question IS NOT NULL")
def structural_bucket(spark, sf_dir):
    """The structural bucket of every question."""
    return references(spark, sf_dir).where("question IS NOT NULL").select("question_id", T.structural_bucket(F.col("question"), F.col("answer_type")).alias("bucket"))


@query(f"WITH {REF}, b AS (SELECT answer_type, {BUCKET} AS bucket FROM ref WHERE question IS NOT NULL) SELECT answer_type, bucket, count(*) AS questions FROM b GROUP BY answer_type, bucket")
def question_summary(spark, sf_dir):
    """Questions by type and bucket."""
    rows = references(spark, sf_dir).where("question IS NOT NULL").select("answer_type", T.structural_bucket(F.col("question"), F.col("answer_type")).alias("bucket"))
    return rows.groupBy("answer_type", "bucket").agg(F.count("*").alias("questions"))


@query(f"WITH {REF} SELECT doc_id, count(*) AS questions FROM (SELECT DISTINCT question_id, unnest(list_transform(gold_retrieval, lambda r: r.doc_id)) AS doc_id FROM ref) GROUP BY doc_id")
def referenced_docs(spark, sf_dir):
    """Documents that references name, and how often."""
    rows = references(spark, sf_dir).select("question_id", F.explode(F.transform("gold_retrieval", lambda r: r["doc_id"])).alias("doc_id")).distinct()
    return rows.groupBy("doc_id").agg(F.count("*").alias("questions"))


@query(f"WITH {REF}, {RES} SELECT x.run_id, count(DISTINCT x.question_id) AS answered, count(*) - count(DISTINCT x.question_id) AS repeated, count(DISTINCT x.question_id) FILTER (WHERE r.question_id IS NULL) AS unknown, (SELECT count(*) FROM ref) - count(DISTINCT r.question_id) AS missing FROM res x LEFT JOIN ref r ON x.question_id = r.question_id GROUP BY x.run_id")
def validate_coverage(spark, sf_dir):
    """Of each run the questions answered, answered again, unknown and missing."""
    known = references(spark, sf_dir).select("question_id", F.col("question_id").alias("known"))
    rows = results(spark, sf_dir).join(known, "question_id", "left").groupBy("run_id").agg(
        F.countDistinct("question_id").alias("answered"), (F.count("*") - F.countDistinct("question_id")).alias("repeated"),
        F.countDistinct(F.when(F.col("known").isNull(), F.col("question_id"))).alias("unknown"), F.countDistinct("known").alias("seen"),
    )
    every = known.agg(F.count("*").alias("every"))
    return rows.join(F.broadcast(every)).withColumn("missing", F.col("every") - F.col("seen")).drop("every", "seen")


@query(f"WITH {RES} SELECT run_id, count(*) AS answers, count(DISTINCT model_name) AS models, count(answer) AS with_answer, round(sum(confidence), 4) AS confidence FROM res GROUP BY run_id")
def usage_totals(spark, sf_dir):
    """Answers, models and sums of each run."""
    return results(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("answers"), F.countDistinct("model_name").alias("models"), F.count("answer").alias("with_answer"), F.round(F.sum("confidence"), 4).alias("confidence"))

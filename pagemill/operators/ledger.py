"""Scores of answers, runs and slices, and the ledger of which stage lost the gold pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S

METRICS = ["deterministic", "assistant", "grounding", "telemetry", "ttft", "total"]


def flat_pairs(pages: Column) -> Column:
    """Sorted distinct (doc_id, page_number) of page references; NULLs and pages below 1 are dropped."""
    one = lambda r: F.transform(F.filter(r["page_numbers"], lambda p: p.isNotNull() & (p > 0)), lambda p: F.struct(r["doc_id"].alias("doc_id"), p.alias("page_number")))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(F.coalesce(pages, F.array()), lambda r: r["doc_id"].isNotNull() & r["page_numbers"].isNotNull()), one))))


def first_answers(results: DataFrame) -> DataFrame:
    """Of each run and question the first answer, by result_id."""
    window = Window.partitionBy("run_id", "question_id").orderBy("result_id")
    return results.where("run_id IS NOT NULL AND question_id IS NOT NULL").withColumn("_r", F.row_number().over(window)).where("_r = 1").drop("_r")


def answer_scores(results: DataFrame, references: DataFrame) -> DataFrame:
    """One row a run and question: deterministic and assistant score, grounding, telemetry and time factor, and their product.

    Free text has an assistant score (here the confidence, coerced) and no deterministic one, other types the reverse.
    Telemetry is 0.9 without evidence pages. Time to the first token is the part of confidence that is missing, times 12 s.
    """
    want = references.select("question_id", "answer_type", F.col("answer").alias("want"), S_pairs("gold_retrieval").alias("gold"))
    rows = first_answers(results).join(want, "question_id")
    free = F.col("answer_type") == "free_text"
    ms = F.round((1 - F.col("confidence")) * 12000.0, 3)
    rows = rows.withColumn("found", S_pairs("evidence_pages"))
    rows = rows.select(
        "run_id", "question_id", "answer_type", "gold", "found",
        F.when(~free, S.answer_score(F.col("answer_type"), F.col("answer"), F.col("want"))).alias("deterministic"),
        F.when(free, S.coerced_confidence(F.col("confidence"))).alias("assistant"),
        S.f_beta(F.col("found"), F.col("gold")).alias("grounding"),
        F.when(F.size("found") == 0, 0.9).otherwise(1.0).alias("telemetry"),
        ms.alias("ttft_ms"), S.ttft_factor(ms).alias("ttft"),
    )
    return rows.withColumn("total", S.answer_total(*(F.col(c) for c in METRICS[:5])))


def S_pairs(name: str) -> Column:
    return flat_pairs(F.col(name))


def run_scores(scored: DataFrame, *by: str) -> DataFrame:
    """Means of each metric by the given columns, 0 where none has it, and total = (0.7 det + 0.3 asst) * grounding * telemetry * ttft."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    out = scored.groupBy(*by).agg(
        F.count("*").alias("questions"), mean("deterministic").alias("deterministic"), mean("assistant").alias("assistant"), mean("grounding").alias("grounding"),
        mean("telemetry").alias("telemetry"), mean("ttft").alias("ttft"), F.avg("ttft_ms").alias("ttft_ms"),
    )
    return out.withColumn("total", F.expr("(0.7D * deterministic + 0.3D * assistant) * grounding * telemetry * ttft"))


def slices(references: DataFrame) -> DataFrame:
    """(slice_id, question_id): every reference in the slices of its type, source, difficulty, number of documents and tags."""
    docs = F.size(F.array_distinct(F.transform(F.coalesce("gold_retrieval", F.array()), lambda r: r["doc_id"])))
    named = F.array(
        F.concat(F.lit("answer_type:"), "answer_type"), F.concat(F.lit("source_type:"), "source_type"), F.concat(F.lit("difficulty:"), "difficulty"),
        F.concat(F.lit("doc_count:"), docs.cast("string")), F.when(docs <= 1, "doc_count:single").otherwise("doc_count:multi"),
    )
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.concat(F.lit("tag:"), t))
    every = F.array_distinct(F.filter(F.concat(named, tags), lambda x: x.isNotNull()))
    return references.select("question_id", F.explode(every).alias("slice_id"))


def run_deltas(scores: DataFrame, baseline: str, *by: str) -> DataFrame:
    """Each run's metrics less the baseline run's, by the given columns that both have."""
    base = scores.where(F.col("run_id") == baseline).select(*by, *[F.col(m).alias(f"base_{m}") for m in METRICS])
    return scores.where(F.col("run_id") != baseline).join(F.broadcast(base) if not by else base, list(by) or None).select("run_id", *by, *[(F.col(m) - F.col(f"base_{m}")).alias(f"{m}_delta") for m in METRICS])


def consistency(scored: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Of each question over the runs that answered it: mean, population deviation, bounds, and whether it is unstable."""
    out = scored.groupBy("question_id").agg(F.count("*").alias("runs"), F.avg("total").alias("mean"), F.stddev_pop("total").alias("deviation"), F.min("total").alias("least"), F.max("total").alias("most"))
    return out.where("runs >= 2").withColumn("unstable", F.col("deviation") > threshold)


def page_stages(results: DataFrame, references: DataFrame) -> DataFrame:
    """(run_id, question_id, answer_type, gold, raw, narrowed, final): raw is what any run cited for the question, narrowed what two runs did, or raw."""
    answers = first_answers(results).select("run_id", "question_id", S_pairs("evidence_pages").alias("final"))
    cited = answers.select("question_id", F.explode("final").alias("pair")).groupBy("question_id", "pair").agg(F.count("*").alias("runs"))
    pools = cited.groupBy("question_id").agg(F.array_sort(F.collect_list("pair")).alias("raw"), F.array_sort(F.collect_list(F.when(F.col("runs") >= 2, F.col("pair")))).alias("often"))
    empty = F.array().cast("array<struct<doc_id:string,page_number:int>>")
    rows = answers.join(references.select("question_id", "answer_type", S_pairs("gold_retrieval").alias("gold")), "question_id").join(pools, "question_id", "left")
    rows = rows.withColumn("raw", F.coalesce("raw", empty))
    return rows.withColumn("narrowed", F.when(F.size(F.coalesce("often", empty)) > 0, F.col("often")).otherwise(F.col("raw"))).drop("often")


def grounding_ledger(stages: DataFrame) -> DataFrame:
    """stages with recall, precision and grounding of each set of pages and the failure bucket."""
    gold = F.col("gold")
    return stages.select(
        "run_id", "question_id", "answer_type", "gold", "raw", "narrowed", "final",
        S.ledger_recall(F.col("raw"), gold).alias("raw_recall"), S.ledger_recall(F.col("narrowed"), gold).alias("pass_a_recall"),
        S.ledger_precision(F.col("final"), gold).alias("final_precision"), S.f_beta(F.col("final"), gold).alias("final_grounding"),
        S.failure_bucket(gold, F.col("raw"), F.col("narrowed"), F.col("final")).alias("failure_bucket"),
    )


def grounding_summary(ledger: DataFrame) -> DataFrame:
    """Of each run: questions by bucket, rates and means over those with gold pages; 0 where there are none."""
    counts = [F.count_if(F.col("failure_bucket") == b).alias(f"{b}_count") for b in ("gold_empty", "raw_miss", "pass_a_miss", "final_miss", "hit")]
    eligible = F.col("failure_bucket") != "gold_empty"
    mean = lambda c: F.coalesce(F.avg(F.when(eligible, F.col(c))), F.lit(0.0))
    out = ledger.groupBy("run_id").agg(F.count("*").alias("question_count"), *counts, mean("raw_recall").alias("mean_raw_recall"), mean("pass_a_recall").alias("mean_pass_a_recall"), mean("final_grounding").alias("mean_final_grounding"))
    n = F.col("question_count") - F.col("gold_empty_count")
    for b in ("raw_miss", "pass_a_miss", "final_miss"):
        out = out.withColumn(f"{b}_rate", F.when(n > 0, F.col(f"{b}_count") / n).otherwise(0.0))
    return out


def top_failures(ledger: DataFrame, limit: int) -> DataFrame:
    """The questions that failed in most runs: failures by bucket and the dominant one, of equal ones the last by name."""
    buckets = ("raw_miss", "pass_a_miss", "final_miss")
    failed = ledger.where(F.col("failure_bucket").isin(*buckets))
    rows = failed.groupBy("question_id").agg(F.countDistinct("run_id").alias("run_count"), F.count("*").alias("total_failures"), *[F.count_if(F.col("failure_bucket") == b).alias(f"{b}_count") for b in buckets], F.min("answer_type").alias("answer_type"))
    dominant = F.greatest(*[F.struct(F.col(f"{b}_count").alias("n"), F.lit(b).alias("b")) for b in buckets])["b"]
    return rows.withColumn("dominant_bucket", dominant).orderBy(F.desc("run_count"), F.desc("total_failures"), "question_id").limit(limit)

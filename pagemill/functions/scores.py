"""Scoring functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalised

BETA = 2.5


def coerced_score(x: Column, fallback: float | None = 0.0) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(fallback))


def coerced_confidence(x: Column, default: float = 0.0) -> Column:
    """x where it lies in [0, 1], else default; NaN lies outside."""
    return F.when(x.between(0.0, 1.0), x).otherwise(default)


def ttft_factor(ms: Column) -> Column:
    """1.05 below a second, 1.02 below two, 1 up to three, then from 0.99 down to 0.85 at ten seconds; 0.85 for NULL."""
    late = 0.99 - (F.least(ms, F.lit(10000.0)) - 3000.0) / 7000.0 * 0.14
    return F.when(ms.isNull(), 0.85).when(ms < 1000, 1.05).when(ms < 2000, 1.02).when(ms <= 3000, 1.0).otherwise(late)


def common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def f_beta(predicted: Column, gold: Column, beta: float = BETA) -> Column:
    """F-beta of two sets: 1 if both are empty, 0 if one is or none is common."""
    hit = common(predicted, gold)
    p, r, b2 = hit / F.size(predicted), hit / F.size(gold), beta * beta
    return F.when((F.size(predicted) == 0) & (F.size(gold) == 0), 1.0).when((F.size(predicted) == 0) | (F.size(gold) == 0) | (hit == 0), 0.0).otherwise((1 + b2) * p * r / (b2 * p + r))


def ledger_recall(predicted: Column, gold: Column) -> Column:
    return F.when(F.size(gold) == 0, 1.0).otherwise(common(predicted, gold) / F.size(gold))


def ledger_precision(predicted: Column, gold: Column) -> Column:
    return F.when(F.size(predicted) == 0, F.when(F.size(gold) == 0, 1.0).otherwise(0.0)).otherwise(common(predicted, gold) / F.size(predicted))


def strict_precision(predicted: Column, gold: Column) -> Column:
    """The experiment's precision: NULL without gold pages, 0 without predicted ones."""
    return F.when(F.size(gold) == 0, F.lit(None).cast("double")).when(F.size(predicted) == 0, 0.0).otherwise(common(predicted, gold) / F.size(predicted))


def strict_recall(predicted: Column, gold: Column) -> Column:
    return F.when(F.size(gold) > 0, common(predicted, gold) / F.size(gold))


def failure_bucket(gold: Column, raw: Column, narrowed: Column, final: Column) -> Column:
    """gold_empty, hit, or the first stage at which no gold page was left."""
    return (
        F.when(F.size(gold) == 0, "gold_empty").when(F.arrays_overlap(gold, final), "hit").when(~F.arrays_overlap(gold, raw), "raw_miss")
        .when(~F.arrays_overlap(gold, narrowed), "pass_a_miss").otherwise("final_miss")
    )


def encoded_pairs(pairs: Column) -> Column:
    """Sorted doc:page items joined by bars, of an array of (doc_id, page_number)."""
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: F.concat(x["doc_id"], F.lit(":"), x["page_number"].cast("string"))), "|")


def decoded_pairs(text: Column) -> Column:
    """The inverse of encoded_pairs: items are split at their first colon, incomplete ones and those without a number dropped."""
    pair = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("doc_id"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).try_cast("int").alias("page_number"))
    items = F.filter(F.split(text, r"\|"), lambda x: x.contains(":"))
    return F.array_sort(F.array_distinct(F.filter(F.transform(items, pair), lambda p: (p["doc_id"] != "") & p["page_number"].isNotNull())))


def answer_score(kind: Column, got: Column, want: Column) -> Column:
    """Deterministic score of two answer structs (b, n, s, arr): both NULL 1, one NULL 0, else by type."""

    def names(x: Column) -> Column:
        return F.array_distinct(F.filter(F.transform(F.coalesce(x["arr"], F.array().cast("array<string>")), normalised), lambda v: v != ""))

    def value(x: Column) -> Column:
        return F.when(kind == "boolean", x["b"].cast("string")).when(kind == "number", x["n"].cast("string")).when(kind == "names", F.when(x["arr"].isNotNull(), "x")).otherwise(x["s"])

    a, b = names(got), names(want)
    union = F.size(F.array_union(a, b))
    number = F.when(want["n"] == 0, got["n"] == 0).otherwise(F.abs(got["n"] - want["n"]) <= F.abs(want["n"]) * 0.01)
    as_date = lambda x: F.when(x["s"].rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(x["s"], "yyyy-MM-dd"))
    typed = (
        F.when(kind == "number", number.cast("double")).when(kind == "boolean", (got["b"] == want["b"]).cast("double"))
        .when(kind == "name", (normalised(got["s"]) == normalised(want["s"])).cast("double"))
        .when(kind == "names", F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union))
        .when(kind == "date", F.coalesce((as_date(got) == as_date(want)).cast("double"), F.lit(0.0))).otherwise(0.0)
    )
    missing = value(got).isNull() | value(want).isNull()
    return F.when(missing, (value(got).isNull() & value(want).isNull()).cast("double")).otherwise(typed)


def answer_total(deterministic: Column, assistant: Column, grounding: Column, telemetry: Column, ttft: Column) -> Column:
    return F.coalesce(deterministic, assistant, F.lit(0.0)) * grounding * telemetry * ttft

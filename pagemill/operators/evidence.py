"""Choosing evidence: lifted pages, packing into a token budget, coverage, gaps, pruning and final attribution.

Candidates are (qid, chunk_id, doc_id, page_span, retrieval_score, rerank_score, text) rows; a question has few of them, so
windows by question stay small however many questions there are.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ci, normalised
from .chunks import words

MARKERS = r"\b(?:article|clause|section|schedule|tribunal|court|claim|claimant|respondent|agreement|shall|must|may)\b"


def lifted_pages(candidates: DataFrame) -> DataFrame:
    """(qid, doc_id, page_number, chunk_ids, retrieval_score, rerank_score, rank): the best scores of every page, ranked."""
    rows = candidates.select("qid", "doc_id", "chunk_id", "retrieval_score", "rerank_score", F.explode("page_span").alias("page_number"))
    out = rows.groupBy("qid", "doc_id", "page_number").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"), F.max("retrieval_score").alias("retrieval_score"), F.max("rerank_score").alias("rerank_score"))
    order = Window.partitionBy("qid").orderBy(F.desc_nulls_last("rerank_score"), F.desc("retrieval_score"), "doc_id", "page_number")
    return out.withColumn("rank", F.row_number().over(order))


def page_references(pages: DataFrame) -> DataFrame:
    """(qid, doc_id, pages): sorted distinct pages of each document."""
    return pages.groupBy("qid", "doc_id").agg(F.array_sort(F.collect_set("page_number")).alias("pages"))


def best_of_documents(candidates: DataFrame) -> DataFrame:
    """(qid, doc_id, rerank_score, retrieval_score): of each document the highest pair, NULL lowest."""
    low = F.lit(float("-inf"))
    top = F.max(F.struct(F.coalesce("rerank_score", low).alias("r"), F.coalesce("retrieval_score", F.lit(0.0)).alias("s")))
    out = candidates.where("doc_id <> ''").groupBy("qid", "doc_id").agg(top.alias("t"))
    return out.select("qid", "doc_id", F.when(F.col("t.r") > low, F.col("t.r")).alias("rerank_score"), F.col("t.s").alias("retrieval_score"))


def above_threshold(candidates: DataFrame, threshold: float) -> DataFrame:
    """All candidates for a threshold of at most 0, else those with a rerank score from it up."""
    return candidates if threshold <= 0 else candidates.where(F.col("rerank_score") >= threshold)


def packed_context(segments: DataFrame, budget: int, item: int, most: int) -> DataFrame:
    """Segments (qid, rank, position, doc_id, page_number, text) that fit, in order, with the tokens taken of each.

    Repeated (document, page, text) and empty segments are passed over; each gives at most `item` tokens; packing ends when the
    budget is used or `most` items are taken. As only the item that uses it up is cut, running sums give the greedy result.
    """
    rows = segments.withColumn("n", F.size(words(F.coalesce("text", F.lit("")))))
    same = Window.partitionBy("qid", "doc_id", "page_number", "text").orderBy("rank", "position")
    rows = rows.withColumn("_same", F.row_number().over(same)).where("_same = 1 AND n > 0")
    order = Window.partitionBy("qid").orderBy("rank", "position")
    rows = rows.withColumn("take", F.least("n", F.lit(item))).withColumn("used", F.sum("take").over(order) - F.col("take")).withColumn("slot", F.row_number().over(order))
    return rows.where((F.col("used") < budget) & (F.col("slot") <= most)).withColumn("take", F.least("take", F.lit(budget) - F.col("used"))).drop("_same", "n")


def compressed(candidates: DataFrame, most: int) -> DataFrame:
    """At most `most` candidates of each question: first the best unseen chunk of each lifted page in order, then the rest in order.

    Which chunks are seen depends on those taken before, hence a loop over a question's few candidates in a grouped map.
    """

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(r=rows["rerank_score"].fillna(float("-inf"))).sort_values(["r", "retrieval_score", "chunk_id"], ascending=[False, False, True])
        pages: dict[tuple, list] = {}
        for x in rows.itertuples():
            for p in dict.fromkeys(x.page_span):
                best = pages.setdefault((x.doc_id, p), [x.r, x.retrieval_score, []])
                best[0], best[1] = max(best[0], x.r), max(best[1], x.retrieval_score)
                best[2].append(x.chunk_id)
        taken: list = []
        for _, (_, _, ids) in sorted(pages.items(), key=lambda e: (-e[1][0], -e[1][1], e[0])):
            new = next((i for i in ids if i not in taken), None)
            if new is not None and len(taken) < most:
                taken.append(new)
        taken += [i for i in rows["chunk_id"] if i not in taken][: max(most - len(taken), 0)]
        return pd.DataFrame({"qid": rows["qid"].iloc[0], "chunk_id": taken, "slot": range(1, len(taken) + 1)})

    kind = candidates.schema["qid"].dataType.simpleString()
    return candidates.select("qid", "chunk_id", "doc_id", "page_span", "retrieval_score", "rerank_score").groupBy("qid").applyInPandas(pick, f"qid {kind}, chunk_id string, slot int")


def confident_document(candidates: DataFrame, least: float = 0.2, gap: float = 0.25) -> DataFrame:
    """Candidates of the best document alone where its rerank score is at least `least` and leads by `gap`; else all."""
    ranked = best_of_documents(candidates).withColumn("rk", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc_nulls_last("rerank_score"), F.desc("retrieval_score"), F.desc("doc_id"))))
    two = ranked.where("rk <= 2").groupBy("qid").agg(F.max(F.when(F.col("rk") == 1, F.col("rerank_score"))).alias("a"), F.max(F.when(F.col("rk") == 2, F.col("rerank_score"))).alias("b"), F.max(F.when(F.col("rk") == 1, F.col("doc_id"))).alias("keep"))
    clear = F.coalesce((F.col("a") >= least) & (F.round(F.col("a") - F.col("b"), 9) >= gap), F.lit(False))
    return candidates.join(two.select("qid", F.when(clear, F.col("keep")).alias("keep")), "qid").where("keep IS NULL OR keep = doc_id").drop("keep")


def covered(selected: DataFrame, pool: DataFrame, target: int, most: int) -> DataFrame:
    """selected and, while a question has fewer than `target` documents, the first pool candidate of up to `most` uncovered ones."""
    seen = selected.select("qid", "doc_id").distinct()
    have = seen.groupBy("qid").agg(F.count("*").alias("have"))
    first = pool.join(seen, ["qid", "doc_id"], "left_anti").withColumn("_d", F.row_number().over(Window.partitionBy("qid", "doc_id").orderBy("rank", "chunk_id"))).where("_d = 1")
    first = first.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "chunk_id"))).join(have, "qid", "left")
    extra = first.where((F.col("_n") <= most) & (F.col("_n") <= target - F.coalesce("have", F.lit(0)))).select("qid", "chunk_id", "doc_id", "rank", F.lit(True).alias("injected"))
    return selected.select("qid", "chunk_id", "doc_id", "rank", F.lit(False).alias("injected")).unionByName(extra)


def aligned(selected: DataFrame, hits: DataFrame) -> DataFrame:
    """Candidates of documents that are hit (qid, doc_id), or all of a question's where none is."""
    marked = selected.join(hits.select("qid", "doc_id", F.lit(True).alias("hit")).distinct(), ["qid", "doc_id"], "left")
    some = F.max(F.coalesce("hit", F.lit(False))).over(Window.partitionBy("qid"))
    return marked.withColumn("_s", some).where("hit OR NOT _s").drop("hit", "_s")


def markers(text: Column) -> Column:
    return F.regexp_count(text, F.lit(ci(MARKERS)))


def looks_like_title(page: Column, text: Column) -> Column:
    return (page == 1) & ((markers(text) <= 1) | normalised(text).contains("table of contents"))


def candidate_pages(candidates: DataFrame) -> DataFrame:
    """(qid, doc_id, page_number, text, chunk_ids, scores): every page with its most telling text and its best scores."""
    rows = candidates.select("*", F.explode("page_span").alias("page_number")).where("page_number > 0")
    rank = F.struct((~looks_like_title(F.col("page_number"), F.col("text"))).cast("int"), markers(F.col("text")), F.coalesce("rerank_score", F.lit(float("-inf"))), "retrieval_score", F.length(normalised(F.col("text"))), normalised(F.col("text")))
    return rows.groupBy("qid", "doc_id", "page_number").agg(F.max_by("text", rank).alias("text"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"), F.max("retrieval_score").alias("retrieval_score"), F.max("rerank_score").alias("rerank_score"))


def pruned_pages(pages: DataFrame) -> DataFrame:
    """pages with suppressed: title pages, and texts repeated in a document that share no chunk with its strongest page.

    The strongest page of a document stays unless one that is neither title nor repeated can stand for it; never all pages of a
    question are suppressed.
    """
    doc = Window.partitionBy("qid", "doc_id")
    rows = pages.withColumn("title", looks_like_title(F.col("page_number"), F.col("text"))).withColumn("repeated", F.count("*").over(Window.partitionBy("qid", "doc_id", normalised(F.col("text")))) > 1)
    strength = F.struct(F.coalesce("rerank_score", F.lit(float("-inf"))), F.col("retrieval_score"), (-F.col("page_number")).alias("p"))
    rows = rows.withColumn("strongest", F.max_by("page_number", strength).over(doc)).withColumn("anchor", F.coalesce(F.max_by(F.when(~F.col("title") & ~F.col("repeated"), F.col("page_number")), F.when(~F.col("title") & ~F.col("repeated"), strength)).over(doc), F.col("strongest")))
    anchor_ids = F.max_by("chunk_ids", F.when(F.col("page_number") == F.col("anchor"), F.lit(1)).otherwise(0)).over(doc)
    open_to = (F.col("page_number") != F.col("strongest")) | (F.col("anchor") != F.col("strongest"))
    rows = rows.withColumn("suppressed", open_to & (F.col("page_number") != F.col("anchor")) & ((F.col("repeated") & ~F.arrays_overlap("chunk_ids", anchor_ids)) | F.col("title")))
    question = Window.partitionBy("qid")
    left = F.count_if(~F.col("suppressed")).over(question)
    best = F.max_by(F.struct("doc_id", "page_number"), strength).over(question)
    return rows.withColumn("suppressed", F.when(left == 0, ~F.struct("doc_id", "page_number").eqNullSafe(best)).otherwise(F.col("suppressed"))).drop("strongest", "anchor", "title", "repeated")


def final_attribution(rows: DataFrame, narrowing: bool = False, empty_for_none: bool = False, strict: bool = False) -> DataFrame:
    """rows (raw, narrowed, solver, supported: arrays of pairs; is_supported, is_none) with the final pages and how they were chosen."""
    cand = F.when(F.size("narrowed") > 0, F.col("narrowed")).otherwise(F.col("raw"))
    rows = rows.withColumn("cand", cand).withColumn("sup", F.array_intersect("cand", "supported")).withColumn("accepted", F.array_intersect("cand", "solver"))
    none, trims = F.size("cand") == 0, F.col("is_supported") & (F.size("sup") > 0) & (F.size("sup") < F.size("cand"))
    empty = F.col("is_none") & F.lit(empty_for_none)
    action = (
        F.when(none, "no_candidate_pages").when(empty, "no_answer_empty").when(trims & F.lit(narrowing), "trimmed_pages").when(trims, "solver_narrowing_disabled_preserved")
        .when(F.col("is_supported"), "preserved_pages").when(F.col("is_none"), "no_answer_preserved").otherwise("unsupported_preserved")
    )
    final = F.when(none | empty, F.slice("cand", 1, 0)).when(trims & F.lit(narrowing), F.col("sup")).otherwise(F.col("cand"))
    return rows.withColumn("final", F.array_sort(final)).withColumn("action", action).withColumn("collapsed", F.lit(strict) & ~F.col("is_supported") & ~F.col("is_none")).withColumn("selected", F.size("accepted"))


def unique_best(rows: DataFrame, group: str, value: str, score: str) -> DataFrame:
    """(group, value): the value of the highest score, NULL where several values share it."""
    top = rows.withColumn("_top", F.max(score).over(Window.partitionBy(group))).where(F.col(score) == F.col("_top"))
    out = top.groupBy(group).agg(F.min(value).alias("a"), F.max(value).alias("b"))
    return out.select(group, F.when(F.col("a") == F.col("b"), F.col("a")).alias(value))

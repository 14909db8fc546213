"""Search, fusion, chunks and evidence against small cases and brute force."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagemill.operators import chunks as C
from pagemill.operators import evidence as E
from pagemill.operators import fusion, search
from pagemill.sources import readers, sinks

TEXTS = {"a": "the court heard the claim", "b": "the lease was signed", "c": None, "d": "claim claim lease", "e": ""}


def brute_bm25(texts, query):
    words = {k: re.findall("[a-z0-9]+", (t or "").lower()) for k, t in texts.items()}
    n, mean = len(words), sum(max(len(w), 1) for w in words.values()) / len(words)
    df = Counter(t for w in words.values() for t in set(w))
    idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}

    def weights(w):
        return {t: idf[t] * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * max(len(w), 1) / mean)) for t, f in Counter(w).items() if t in idf}

    q = weights(re.findall("[a-z0-9]+", query.lower()))
    out = {k: round(sum(v * q.get(t, 0.0) for t, v in weights(w).items()), 6) for k, w in words.items()}
    return sorted(((-s, k) for k, s in out.items() if s > 0))


def test_lexical_search_is_exact(spark):
    rows = spark.createDataFrame(list(TEXTS.items()), "chunk_id string, text string").selectExpr("*", "1 AS score")
    queries = spark.createDataFrame([(1, "the claim"), (2, "lease of the court"), (3, "unknown words"), (4, None)], "qid int, query string")
    got = {}
    for r in search.lexical_top(rows, queries, 2).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((-r.score, r.chunk_id))
    for qid, q in ((1, "the claim"), (2, "lease of the court")):
        want = brute_bm25(TEXTS, q)[:2]
        assert [k for _, k in got[qid]] == [k for _, k in want] and [s for s, _ in got[qid]] == pytest.approx([s for s, _ in want], abs=2e-6)
    assert 3 not in got and 4 not in got


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "chunk_id string, text string")
    queries = spark.createDataFrame([(1, "the claim")], "qid int, query string")
    assert search.lexical_top(none, queries, 3).count() == 0
    vectors = spark.createDataFrame([], "chunk_id string, vectors array<float>")
    assert search.dense_top(vectors, spark.createDataFrame([(1, [1.0, 0.0])], "qid int, query array<float>"), 3, "chunk_id", "vectors", 2).count() == 0


def test_cosine_does_not_depend_on_length(spark):
    rows = [("a", [1.0, 0.0]), ("b", [30.0, 6.0]), ("c", [0.0, 2.0]), ("z", [0.0, 0.0]), ("n", [float("nan"), 1.0]), ("s", [1.0]), ("m", None)]
    df = spark.createDataFrame(rows, "chunk_id string, vectors array<float>")
    for factor in (1.0, 100.0):
        q = spark.createDataFrame([(1, [2.0 * factor, 0.1 * factor])], "qid int, query array<float>")
        got = [r.chunk_id for r in search.dense_top(df, q, 5, "chunk_id", "vectors", 2).orderBy("rank").collect()]
        assert got == ["a", "b", "c"]


def test_rank_fusion(spark):
    rows = [(1, "a", 0.9, None, 0.9), (1, "b", 0.8, 2.0, 2.8), (1, "c", None, 3.0, 3.0)]
    df = spark.createDataFrame(rows, "qid int, chunk_id string, dense_score double, sparse_score double, retrieval_score double")
    got = {r.chunk_id: r for r in fusion.reciprocal_ranks(df).collect()}
    assert (got["c"].dense_rank, got["c"].sparse_rank, got["b"].dense_rank, got["b"].sparse_rank, got["a"].sparse_rank) == (1, 1, 3, 2, None)
    assert got["b"].retrieval_score == pytest.approx(1 / 63 + 1 / 62, abs=1e-6)
    plain = {r.chunk_id: r.dense_rank for r in fusion.reciprocal_ranks(df, fallback=False).collect()}
    assert plain == {"a": 1, "b": 2, "c": None}


def test_metadata_boost_is_capped(spark):
    df = spark.createDataFrame([(["law a", "law b", "law c", "law d", "law e"], ["the deed"], ["Law A; law b, LAW C law d law e", "x the deed"])], "e array<string>, t array<string>, c array<string>")
    assert df.select(fusion.metadata_boost(F.col("e"), F.col("t"), F.col("c"))).first()[0] == 0.72


def test_windows_of_tokens(spark):
    words = lambda n: " ".join(f"w{i}" for i in range(n))
    pages = spark.createDataFrame([("a", 1, words(300)), ("b", 1, words(301)), ("c", 1, " "), ("d", 1, None)], "doc_id string, page_number int, text string")
    got = sorted((r.doc_id, r.start, r.tokens) for r in C.fixed_windows(pages, 300, 50).collect())
    assert got == [("a", 0, 300), ("b", 0, 300), ("b", 250, 51)]
    with pytest.raises(ValueError):
        C.fixed_windows(pages, 50, 50)


def test_headings_are_carried_and_reset(spark):
    rows = [(1, "Part 1 General"), (2, "no heading here at all."), (3, "Article 2 Scope"), (4, "Part 3 Other")]
    pages = spark.createDataFrame([("d", n, t) for n, t in rows], "doc_id string, page_number int, text string")
    got = {r.page_number: (r.part, r.article, r.label) for r in C.carried_headings(pages).collect()}
    assert got == {1: ("Part 1 General", None, "Part 1 General"), 2: ("Part 1 General", None, "Part 1 General"), 3: ("Part 1 General", "Article 2 Scope", "Article 2 Scope"), 4: ("Part 3 Other", None, "Part 3 Other")}


def test_islands_and_runs(spark):
    rows = spark.createDataFrame([("d", i, k) for i, k in enumerate(["A", "A", None, "B", "A"], 1)], "doc_id string, page_number int, label string")
    got = [(r.label, r.first, r.last) for r in C.islands(rows, "doc_id", "page_number", "label").orderBy("island").collect()]
    assert got == [("A", 1, 2), ("B", 4, 4), ("A", 5, 5)]
    runs = spark.createDataFrame([("d", i) for i in (1, 2, 4, 5, 7, 7)], "doc_id string, page_number int")
    assert sorted((r.first, r.last) for r in C.page_runs(runs).collect()) == [(1, 2), (4, 5), (7, 7)]


def test_clauses(spark):
    pages = spark.createDataFrame([("d", 1, "Intro\n(a) first\ntail\n(b) second"), ("e", 1, "one\ntwo")], "doc_id string, page_number int, text string")
    got = {(r.doc_id, r.label): r.text for r in C.clause_groups(pages).collect()}
    assert got == {("d", "lead-in"): "Intro", ("d", "(a)"): "(a) first\n\ntail", ("d", "(b)"): "(b) second", ("e", "1"): "one", ("e", "2"): "two"}


def test_packing_takes_whole_budget_in_order(spark):
    text = lambda i: " ".join(f"p{i}w{j}" for j in range(700))
    rows = [("q", 1, i, "d", i, text(i)) for i in range(1, 10)]
    df = spark.createDataFrame(rows, "qid string, rank int, position int, doc_id string, page_number int, text string")
    got = [(r.page_number, r.take) for r in E.packed_context(df, 2400, 600, 8).orderBy("slot").collect()]
    assert got == [(1, 600), (2, 600), (3, 600), (4, 600)]


def test_packing_equals_greedy(spark):
    rng = random.Random(3)
    rows = [(q, r, 0, "d", rng.randint(1, 4), " ".join("w" * rng.randint(1, 2) for _ in range(rng.choice([0, 3, 30, 80])))) for q in range(20) for r in range(12)]
    df = spark.createDataFrame(rows, "qid int, rank int, position int, doc_id string, page_number int, text string")
    got = {(r.qid, r.rank): r.take for r in E.packed_context(df, 100, 40, 5).collect()}
    want = {}
    for q in range(20):
        left, seen, taken = 100, set(), 0
        for _, r, _, d, p, t in sorted(x for x in rows if x[0] == q):
            take = min(len(t.split()), left, 40)
            if (d, p, t) in seen or not take or taken == 5:
                continue
            seen.add((d, p, t))
            want[q, r] = take
            left, taken = left - take, taken + 1
    assert got == want


def test_narrowing_changes_pages_alone(spark):
    pair = "array<struct<doc_id:string,page_number:int>>"
    rows = [([("d", 1), ("d", 2)], [("d", 1), ("d", 2)], [("d", 1)], [("d", 1)], True, False), ([], [], [], [], True, False), ([("d", 1)], [], [], [], False, False), ([("d", 1)], [], [], [], False, True)]
    df = spark.createDataFrame(rows, f"raw {pair}, narrowed {pair}, solver {pair}, supported {pair}, is_supported boolean, is_none boolean")
    off, on = ([(r.action, len(r.final)) for r in E.final_attribution(df, n).collect()] for n in (False, True))
    assert off == [("solver_narrowing_disabled_preserved", 2), ("no_candidate_pages", 0), ("unsupported_preserved", 1), ("no_answer_preserved", 1)]
    assert on[0] == ("trimmed_pages", 1) and on[1:] == off[1:]


def test_compressor_spreads_over_pages(spark):
    rows = [("q", "a", "d", [1], 0.5, 0.9), ("q", "b", "d", [1], 0.5, 0.8), ("q", "c", "d", [2], 0.5, 0.1), ("q", "e", "d", [3], 0.5, None)]
    df = spark.createDataFrame(rows, "qid string, chunk_id string, doc_id string, page_span array<int>, retrieval_score double, rerank_score double")
    assert [r.chunk_id for r in E.compressed(df, 3).orderBy("slot").collect()] == ["a", "c", "e"]
    assert [r.chunk_id for r in E.compressed(df, 4).orderBy("slot").collect()] == ["a", "c", "e", "b"]


def test_never_all_pages_are_pruned(spark):
    rows = [("q", "d", 1, "Title", ["a"], 0.5, None)]
    df = spark.createDataFrame(rows, "qid string, doc_id string, page_number int, text string, chunk_ids array<string>, retrieval_score double, rerank_score double")
    assert [r.suppressed for r in E.pruned_pages(df).collect()] == [False]


def test_latest_delivery_and_upsert(spark):
    rows = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), (None, 3, "x")], "k string, loaded_at int, v string")
    assert [r.v for r in readers.latest(rows, "k").collect()] == ["new"]
    old = spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, n int")
    got = sorted(tuple(r) for r in sinks.summary_upsert(old, spark.createDataFrame([("r2", 9)], "run_id string, n int")).collect())
    assert got == [("r1", 1), ("r2", 9)]


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"references": [{"id": "x"}, {"id": "y"}]}')
    assert sorted(r.id for r in readers.json_records(spark, str(tmp_path / "a.json"), "references", "answers").collect()) == ["x", "y"]
    assert readers.delimited(spark, str(tmp_path / "missing.csv")).count() == 0
    (tmp_path / "b.tsv").write_text("n\tt\n1\tu\n")
    assert [tuple(r) for r in readers.delimited(spark, str(tmp_path / "b.tsv"), "\t").collect()] == [("1", "u")]
    (tmp_path / "c.jsonl").write_text('{"id": "x", "extra": 1}\n')
    from pyspark.sql import types as T

    with pytest.raises(ValueError):
        readers.json_lines(spark, str(tmp_path / "c.jsonl"), T.StructType().add("id", "string"))


def test_sentence_windows():
    text = "one two three. four five! six? seven eight nine ten."
    assert C.sentence_windows(text, 5, 0) == [(0, 2, 5), (1, 2, 3), (2, 2, 5)]
    assert C.sentence_windows(text, 2, 1) == [(0, 1, 3), (1, 1, 2), (2, 1, 1), (3, 1, 4)]
    assert C.sentence_windows(text, 100, 10) == [(0, 4, 10)] and C.sentence_windows(None, 5, 1) == [] and C.sentence_windows(" ", 5, 1) == []


def test_sentence_chunks(spark):
    pages = spark.createDataFrame([("d", 1, "a b. c d."), ("e", 1, None)], "doc_id string, page_number int, text string")
    assert [tuple(r) for r in C.sentence_chunks(pages, 2, 0).collect()] == [("d", 1, 0, 0, 1, 2), ("d", 1, 1, 1, 1, 2)]

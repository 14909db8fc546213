"""Scoring functions against cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from pagemill.functions import pages as P
from pagemill.functions import scores as S
from pagemill.functions import text as T
from pagemill.operators import evidence as E
from pagemill.operators import ledger as L

PAIR = "array<struct<doc_id:string,page_number:int>>"


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "x int"
    row = tuple(v for _, v in values.values()) or (1,)
    return spark.createDataFrame([row], schema).select(column.alias("out")).first()[0]


@pytest.mark.parametrize("ms, factor", [(None, 0.85), (999.0, 1.05), (1999.0, 1.02), (3000.0, 1.0), (6500.0, 0.92), (20000.0, 0.85), (8507.449837998138, 0.8798510032400373)])
def test_ttft(spark, ms, factor):
    assert one(spark, S.ttft_factor(F.col("ms")), ms=("double", ms)) == pytest.approx(factor, abs=1e-12)


@pytest.mark.parametrize("p, g, beta, precision, recall, strict", [
    ([("d", 1), ("d", 2)], [("d", 1)], 0.8787878787878788, 0.5, 1.0, 0.5),
    ([], [], 1.0, 1.0, 1.0, None), ([], [("d", 1)], 0.0, 0.0, 0.0, 0.0), ([("d", 1)], [], 0.0, 0.0, 1.0, None), ([("d", 2)], [("d", 1)], 0.0, 0.0, 0.0, 0.0),
])
def test_grounding(spark, p, g, beta, precision, recall, strict):
    row = spark.createDataFrame([(p, g)], f"p {PAIR}, g {PAIR}").select(*(f(F.col("p"), F.col("g")) for f in (S.f_beta, S.ledger_precision, S.ledger_recall, S.strict_precision))).first()
    assert row[0] == pytest.approx(beta, abs=1e-12) and (row[1], row[2], row[3]) == (precision, recall, strict)


ANSWER = "struct<b:boolean,n:double,s:string,arr:array<string>>"


@pytest.mark.parametrize("kind, got, want, score", [
    ("number", (None, 101.0, None, None), (None, 100.0, None, None), 1.0), ("number", (None, 102.0, None, None), (None, 100.0, None, None), 0.0),
    ("number", (None, 0.0001, None, None), (None, 0.0, None, None), 0.0), ("number", None, None, 1.0), ("boolean", None, (False, None, None, None), 0.0),
    ("boolean", (True, None, None, None), (True, None, None, None), 1.0), ("name", (None, None, " Acme  Ltd", None), (None, None, "ACME ltd", None), 1.0),
    ("names", (None, None, None, ["A", "b"]), (None, None, None, ["a", "c"]), 1 / 3), ("date", (None, None, "2025-13-01", None), (None, None, "2025-13-01", None), 0.0),
    ("date", (None, None, "2025-03-01", None), (None, None, "2025-03-01", None), 1.0),
])
def test_answers(spark, kind, got, want, score):
    row = spark.createDataFrame([(kind, got, want)], f"k string, got {ANSWER}, want {ANSWER}").select(S.answer_score(F.col("k"), F.col("got"), F.col("want"))).first()
    assert row[0] == pytest.approx(score, abs=1e-12)


def test_bucket_order(spark):
    bucket = S.failure_bucket(*(F.col(c) for c in "grnf"))
    rows = [([], [("d", 1)], [], []), ([("d", 1)], [], [], [("d", 1)]), ([("d", 1)], [("d", 2)], [("d", 1)], []), ([("d", 1)], [("d", 1)], [], []), ([("d", 1)], [("d", 1)], [("d", 1)], [("d", 2)])]
    got = [r[0] for r in spark.createDataFrame(rows, ", ".join(f"{c} {PAIR}" for c in "grnf")).select(bucket).collect()]
    assert got == ["gold_empty", "hit", "raw_miss", "pass_a_miss", "final_miss"]


def test_pair_codec(spark):
    pairs = [("b", 2), ("a", 10), ("a", 2)]
    text = one(spark, S.encoded_pairs(F.col("p")), p=(PAIR, pairs))
    assert text == "a:2|a:10|b:2"
    back = one(spark, S.decoded_pairs(F.col("t")), t=("string", text + "|broken|:3|x:y"))
    assert [tuple(r) for r in back] == sorted(pairs)


def test_confidence_outside_its_range(spark):
    rows = spark.createDataFrame([(0.5,), (1.5,), (-0.1,), (float("nan"),), (None,)], "c double").select(S.coerced_confidence(F.col("c"), 0.25)).collect()
    assert [r[0] for r in rows] == [0.5, 0.25, 0.25, 0.25, 0.25]


@pytest.mark.parametrize("chars, image, label", [(49, 0.0, "scan"), (199, 0.7, "scan"), (200, 0.0, "suspicious"), (1499, 0.25, "suspicious"), (1500, 0.25, "native_clean")])
def test_triage(spark, chars, image, label):
    assert one(spark, P.triage_label(F.col("c"), F.lit(0.0), F.col("i")), c=("int", chars), i=("double", image)) == label


def test_quality(spark):
    assert one(spark, P.quality_score(F.lit(750), F.lit(0.0), F.lit(1))) == 0.6167


def test_spans(spark):
    rows = spark.createDataFrame([([3, 1, 3],), ([2, 0],), ([],)], "p array<int>").select(P.strict_span(F.col("p")), P.lenient_span(F.col("p"))).collect()
    assert [tuple(r) for r in rows] == [([1, 3], [3, 1, 3]), ([], [2]), ([], [])]


def test_question_classes(spark):
    q = spark.createDataFrame([("What is the date in case CFI 057/2025?",), ("Does the Trusts Law apply?",), ("Who signed?",), ("Is it the same in SCT 295/2025 and SCT 514/2025?",)], "q string")
    assert [r[0] for r in q.select(T.question_class(F.col("q"))).collect()] == ["case", "statute", "free_text", "cross_case"]


def test_text_functions(spark):
    assert one(spark, T.glyph_cleanup(F.lit("glyph<c=3>Rule/comma see A/hyphen.B/commander"))) == "Rule, see A-.B"
    assert one(spark, T.iso_dates(F.lit("on 3 May 2020, June 5, 2021, 31 June 2020 and 2022-02-30"))) == ["2020-05-03", "2021-06-05"]
    assert one(spark, T.verbose_name(F.lit("SCT 295/2025 has the earlier date"))) == "SCT 295/2025"
    assert one(spark, T.entities(F.lit("The Acme Trust and Acme"))) == ["The", "Acme", "Trust"]
    assert one(spark, T.bad_char_ratio(F.lit(""), 1.0)) == 1.0


def test_slices_and_pairs(spark):
    refs = spark.createDataFrame([("q", "name", [("d", [1, 2]), ("d", [2, 0])], None, "hard", ["t", "t"])], "question_id string, answer_type string, gold_retrieval array<struct<doc_id:string,page_numbers:array<int>>>, source_type string, difficulty string, tags array<string>")
    assert sorted(r.slice_id for r in L.slices(refs).collect()) == ["answer_type:name", "difficulty:hard", "doc_count:1", "doc_count:single", "tag:t"]
    assert [tuple(p) for p in refs.select(L.flat_pairs(F.col("gold_retrieval"))).first()[0]] == [("d", 1), ("d", 2)]


def test_unique_best(spark):
    rows = spark.createDataFrame([("a", "x", 2), ("a", "y", 2), ("b", "x", 2), ("b", "x", 2), ("b", "z", 1)], "g string, v string, s int")
    assert {tuple(r) for r in E.unique_best(rows, "g", "v", "s").collect()} == {("a", None), ("b", "x")}

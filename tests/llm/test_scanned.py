"""Noise of scanned pages."""

from pagemill.llm import scanned as S
from pagemill.llm.site_lines import repeated_lines

PAGE = """Guidance on Removal of Clerks — 1
Guidance on Removal of Clerks
The registrar shall examine the con-
tract and the self-
employed founder must disclose the rec¬
GUIDANCE ON REMOVAL OF CLERKS
- 2 -
ord within nine days of the hearin9 in
the court, and the founder may not
amend it."""
CLEAN = "Title {}\nThe registrar shall examine the contract and the record within nine days of the hearing in the court. A self-employed founder must disclose it."


def docs_of(spark):
    rows = [(1, PAGE, "s"), (1, PAGE, "s"), (2, None, "s"), (3, " \n ", None)] + [(10 + i, CLEAN.format(i), None) for i in range(40)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "'x' AS form", "0 AS line_no")


def test_findings(spark):
    docs = docs_of(spark)
    found = S.scan_findings(docs, repeated_lines(docs)[1])
    got = {(r.doc_id, r.line_no, r.defect) for r in found.collect()}
    assert got == {(1, 1, "header"), (1, 6, "header"), (1, 7, "page_number"), (1, 3, "hyphen"), (1, 5, "hyphen"), (1, 8, "misread")}


def test_repaired(spark):
    docs = docs_of(spark).dropDuplicates(["doc_id"])
    site, lines = repeated_lines(docs)
    got = {r.doc_id: r.text for r in S.repaired(docs, site, S.scan_findings(docs, lines)).collect()}
    assert got[1] == "Guidance on Removal of Clerks\n\nThe registrar shall examine the contract and the self-employed founder must disclose the record within nine days of the hearing in the court, and the founder may not amend it."
    assert got[2] is None and got[10] == CLEAN.format(0)


def test_rivals_beyond_those_that_tasks_know(spark, monkeypatch):
    page = "Notes\nthey saw that the\neat sat while the\nbat fell and went\non to see it"
    clean = "Notes {}\nSee how the cat sat while dogs eat bread daily and how the hat fell while one bat flew away."
    docs = spark.createDataFrame([(1, page, None)] + [(10 + i, clean.format(i), None) for i in range(60)], "doc_id bigint, text string, source string")
    lines = repeated_lines(docs)[1]
    for most in (S.AMBIGUOUS, 1, 0):
        monkeypatch.setattr(S, "AMBIGUOUS", most)
        assert {(r.line_no, r.form, r.best) for r in S.scan_findings(docs, lines).where("defect = 'misread'").collect()} == {(3, "eat", "cat"), (4, "bat", "hat")}


def test_long_words(spark):
    word = "donau" * 12 + "gesetz"
    docs = spark.createDataFrame([(1, f"Notes\nthey saw the\n{word[:-1]}2 and\nwent on", None)] + [(10 + i, f"Notes {i}\nThis is the {word} again.", None) for i in range(40)], "doc_id bigint, text string, source string")
    found = S.scan_findings(docs, repeated_lines(docs)[1]).where("defect = 'misread'").collect()
    assert [(r.line_no, r.best) for r in found] == [(3, word)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert S.scan_findings(docs, repeated_lines(docs)[1]).count() == 0


def test_skeletons_of_confusable_forms():
    for right, wrong in (("amend", "arnend"), ("inventory", "inveritory"), ("could", "(ould"), ("agreed", "agreecl"), ("while", "vvhile"), ("due", "diie")):
        assert right.translate(S.SKELETON) == wrong.translate(S.SKELETON)

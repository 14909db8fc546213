"""Documents that break off inside a sentence or word."""

import numpy as np
import pytest

from pagemill.llm import cut_off as C
from pagemill.llm.quality import ngram_model
from pagemill.llm.queries import QUERIES
from pagemill.llm.site_lines import line_key, repeated_lines

WHOLE = "Guidance on Removal\nThe Registrar may register the lease within 8 days."
SITE = {line_key("shared 5 times by readers")}


def test_registered():
    assert {"p9_found", "p9_sources"} <= set(QUERIES)


@pytest.mark.parametrize("tail, end", [("\n(2) It is an offence for the liq", "the liq"), (" When a...", "When a"), (" The hearing took place [...]", "place"), (" An appeal against a\nShared 97 times by readers", "against a"), (" An award w (more)", "award w"), (" Damages &#8", "Damages")])
def test_ending_of_cut_text(tail, end):
    assert C.ending(WHOLE + tail, SITE).strip().endswith(end)


@pytest.mark.parametrize("tail", ["", "\n- 2 -", "\nii", "\nPage 1 of 3", "\nGuidance on Removal 4", "\n(Signed) Kiadorn Veraewum", "\nDone at Norousquay on 21 May 2016", "\nAnnex B follows", "\nMufat Peluheast\nSmall Disputes Chamber", "\nShared 97 times by readers", "\nChief Clerk, Norousquay"])
def test_ending_of_whole_text(tail):
    assert C.ending(WHOLE + tail, SITE).endswith("8 days.")


def test_title_alone_has_no_ending():
    assert C.ending("Guidance on Removal", set()) is None


def test_cut_documents(spark):
    whole = "Title of page {}\nThe court may register the lease in {} days. A party has to file the notice with the clerk."
    docs = [(i, whole.format(i, i), "en", None) for i in range(200)]
    docs += [(1000 + i, whole.format(i, i)[: -9 - i % 20], "en", None) for i in range(30)]
    docs += [(2000, None, "en", "s"), (2001, " ", None, None)]
    docs = spark.createDataFrame(docs + docs[:3], "doc_id bigint, text string, lang string, source string").selectExpr("*", "1 AS odds")
    others = spark.createDataFrame([(1005,)], "doc_id bigint")
    got = {r[0] for r in C.cut_off(docs, repeated_lines(docs)[1], others, ngram_model(docs)).collect()}
    assert got == {1000 + i for i in range(30)} - {1005}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
    assert C.cut_off(docs, repeated_lines(docs)[1], docs.select("doc_id"), ngram_model(docs)).count() == 0


def test_split_parts_two_groups():
    counts = np.zeros(C.STEPS)
    counts[30:40], counts[90:100] = 5, 50
    assert C.LOW + 39 / C.STEPS * 20 < C._split(counts) <= C.LOW + 90 / C.STEPS * 20

"""Repeated lines of a source against exact counts."""

from collections import Counter

from pagemill.llm import site_lines as L


def test_hot_source_with_many_lines(spark):
    docs = [(i, "\n".join([f"unique line number {chr(97 + i % 26)}{'x' * (i // 26)} of text", "Shared by readers of the page 5" if i % 9 == 0 else "another ordinary line here", "tiny"]), "hot") for i in range(600)]
    docs += [(1000 + i, "Legal notice of the site", f"small{i % 2}") for i in range(4)] + [(2000, None, "hot"), (2001, "\n ", "hot"), (2002, "Shared by readers of the page 5", None)]
    df = spark.createDataFrame(docs + docs[:5], "doc_id bigint, text string, source string").selectExpr("*", "1 AS key").repartition(7)
    found, lines = L.repeated_lines(df)
    got = {(r.source, r.key): r.n_docs for r in lines.collect()}
    want = {("hot", L.line_key("shared BY readers of the  page 77")): 67, ("hot", L.line_key("another ordinary line here")): 533}
    assert got == want
    assert found.count() == 600


def test_summary_bound():
    s = L.Summary(0.1)
    true = Counter()
    for i in range(4000):
        keys = {i * 7 + j for j in range(20)} | ({-1} if i % 5 == 0 else set()) | ({-2} if i % 3 else set())
        true.update(keys)
        s.add(keys)
    s.shrink()
    assert all(s.kept[k] <= true[k] <= s.kept[k] + s.error for k in (-1, -2))


def test_removal(spark):
    docs = spark.createDataFrame([(i, f"Title {chr(97 + i)} words\nShared by readers of the page {i}\r\nbody", "s") for i in range(5)] + [(9, None, "s")], "doc_id bigint, text string, source string")
    out = {r.doc_id: (r.text, r.lines_removed) for r in L.remove_repeated_lines(docs, L.repeated_lines(docs)[1]).collect()}
    assert out[0] == ("Title a words\nbody", 1) and out[9] == (None, 0)

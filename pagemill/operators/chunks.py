"""Pages to chunks: token windows, caps, headings carried forward, sections, clauses, runs of pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"\S+"
PART, ARTICLE, SECTION = "part", "article", "section"
TOKENS, SENTENCE_GAP = re.compile("[a-z0-9]+"), re.compile(r"(?<=[.!?])\s+")
#: A clause's label at the start of a paragraph.
CLAUSE = r"^(\([A-Za-z0-9]+\)|\d+[A-Za-z]?(?:[.)])?|[A-Za-z](?:[.)]))\s+\S"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def fixed_windows(pages: DataFrame, size: int, overlap: int) -> DataFrame:
    """(doc_id, page_number, start, tokens, text): windows of `size` tokens, each `overlap` before the end of the last; none behind a page's end."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    step = size - overlap
    toks = pages.select("doc_id", "page_number", words(F.coalesce("text", F.lit(""))).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.ceil((F.size("w") - size) / step), F.lit(0)).cast("int")
    rows = toks.select("doc_id", "page_number", "w", F.explode(F.sequence(F.lit(0), last)).alias("k")).withColumn("start", F.col("k") * step)
    part = F.slice("w", F.col("start") + 1, size)
    return rows.select("doc_id", "page_number", "start", F.size(part).alias("tokens"), F.array_join(part, " ").alias("text"))


def capped_chunks(chunks: DataFrame, cap: int) -> DataFrame:
    """Chunks of at most `cap` tokens over their segments in order; of those with the same document, pages and text the first by chunk_id."""
    segs = F.filter(F.transform("segments", lambda s: F.struct(s["page_number"].alias("page_number"), words(F.coalesce(s["text"], F.lit(""))).alias("w"))), lambda s: F.size(s["w"]) > 0)
    fold = F.aggregate(
        segs, F.struct(F.lit(cap).alias("left"), F.array().cast("array<struct<page_number:int,w:array<string>>>").alias("kept")),
        lambda acc, s: F.struct(
            F.greatest(acc["left"] - F.size(s["w"]), F.lit(0)).alias("left"),
            F.when(acc["left"] > 0, F.concat(acc["kept"], F.array(F.struct(s["page_number"].alias("page_number"), F.slice(s["w"], F.lit(1), acc["left"]).alias("w"))))).otherwise(acc["kept"]).alias("kept"),
        ),
    )["kept"]
    rows = chunks.select("chunk_id", "doc_id", fold.alias("kept")).where(F.size("kept") > 0)
    rows = rows.select("chunk_id", "doc_id", F.transform("kept", lambda s: s["page_number"]).alias("page_span"), F.array_join(F.transform("kept", lambda s: F.array_join(s["w"], " ")), "\n").alias("text"))
    first = Window.partitionBy("doc_id", F.xxhash64("page_span", "text"), "page_span", "text").orderBy("chunk_id")
    return rows.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def page_heading(text: Column, kind: str) -> Column:
    """The page's first line that is a heading of this kind: its keyword, a number and a title of at most twelve words; NULL if there is none."""
    lines = F.transform(F.split(text, r"\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    found = F.filter(lines, lambda x: x.rlike(rf"(?i)^{kind} [0-9A-Za-z]+( [^ ]+){{1,12}}$") & ~x.rlike(r"[.;:]$"))
    return F.initcap(F.try_element_at(found, F.lit(1)))


def carried_headings(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, part, article, section, label): headings in force on each page, by page number.

    A new part without article and section on its page clears both; a new article without section clears the section. "New"
    compares with what is in force, so this is a fold over a document's headings (not its texts), which are few numbers a page.
    """
    heads = pages.select("doc_id", "page_number", *[page_heading(F.col("text"), k).alias(k) for k in (PART, ARTICLE, SECTION)])
    state = "struct<page_number:int,part:string,article:string,section:string>"
    rows = heads.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", PART, ARTICLE, SECTION))).alias("h"))
    fold = F.expr(f"""aggregate(h, cast(array() as array<{state}>), (acc, x) -> concat(acc, array(
        CASE WHEN x.part IS NOT NULL AND NOT x.part <=> try_element_at(acc, -1).part AND x.article IS NULL AND x.section IS NULL
               THEN named_struct('page_number', x.page_number, 'part', x.part, 'article', cast(NULL as string), 'section', cast(NULL as string))
             WHEN x.article IS NOT NULL AND NOT x.article <=> try_element_at(acc, -1).article AND x.section IS NULL
               THEN named_struct('page_number', x.page_number, 'part', coalesce(x.part, try_element_at(acc, -1).part), 'article', x.article, 'section', cast(NULL as string))
             ELSE named_struct('page_number', x.page_number, 'part', coalesce(x.part, try_element_at(acc, -1).part), 'article', coalesce(x.article, try_element_at(acc, -1).article), 'section', coalesce(x.section, try_element_at(acc, -1).section)) END)))""")
    out = rows.select("doc_id", F.explode(fold).alias("p")).select("doc_id", "p.*")
    return out.withColumn("label", F.coalesce("section", "article", "part"))


def islands(rows: DataFrame, group: str, order: str, key: str) -> DataFrame:
    """(group, key, island, first, last, size): runs of consecutive rows of the same key; rows with a NULL key part runs."""
    w = Window.partitionBy(group).orderBy(order)
    changed = F.when(F.col(key).isNull() | ~F.col(key).eqNullSafe(F.lag(key).over(w)), 1).otherwise(0)
    runs = rows.select(group, order, key, F.sum(changed).over(w).alias("_run")).where(F.col(key).isNotNull())
    out = runs.groupBy(group, key, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("size"))
    return out.withColumn("island", F.row_number().over(Window.partitionBy(group).orderBy("first"))).drop("_run")


def page_runs(pages: DataFrame) -> DataFrame:
    """(doc_id, first, last): runs of consecutive page numbers."""
    w = Window.partitionBy("doc_id").orderBy("page_number")
    distinct = pages.select("doc_id", "page_number").distinct()
    return distinct.withColumn("_g", F.col("page_number") - F.row_number().over(w)).groupBy("doc_id", "_g").agg(F.min("page_number").alias("first"), F.max("page_number").alias("last")).drop("_g")


def clause_groups(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, clause, label, text): paragraphs of a page under the clause label before them.

    Paragraphs before the first label are lead-in; without any label each paragraph is a clause of its own, numbered.
    """
    paras = F.filter(F.transform(F.split("text", r"\n\s*\n|\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = pages.where("text IS NOT NULL").select("doc_id", "page_number", F.posexplode(paras).alias("at", "para"))
    rows = rows.withColumn("own", F.nullif(F.regexp_extract("para", CLAUSE, 1), F.lit("")))
    page = Window.partitionBy("doc_id", "page_number")
    upto = page.orderBy("at")
    rows = rows.withColumn("labels", F.count("own").over(page)).withColumn("clause", F.when(F.col("labels") == 0, F.col("at") + 1).otherwise(F.count("own").over(upto)).cast("int"))
    out = rows.groupBy("doc_id", "page_number", "clause", "labels").agg(F.max("own").alias("own"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "para"))), lambda x: x["para"]), "\n\n").alias("text"))
    label = F.when(F.col("labels") == 0, F.col("clause").cast("string")).when(F.col("clause") == 0, "lead-in").otherwise(F.col("own"))
    return out.select("doc_id", "page_number", "clause", label.alias("label"), "text")


def sentence_windows(text: str | None, size: int, overlap: int) -> list[tuple[int, int, int]]:
    """(first sentence, sentences, tokens) of windows that hold whole sentences up to `size` tokens, one at least.

    The next window starts with the trailing sentences that reach `overlap` tokens, one even for an overlap of 0, but always
    behind the start of the last.
    """
    sizes = [len(TOKENS.findall(s.lower())) for s in SENTENCE_GAP.split((text or "").strip()) if s.strip()]
    out, start = [], 0
    while start < len(sizes):
        end, total = start + 1, sizes[start]
        while end < len(sizes) and total + sizes[end] <= size:
            total += sizes[end]
            end += 1
        out.append((start, end - start, total))
        if end == len(sizes):
            break
        back, held = end - 1, sizes[end - 1]
        while back > start and held < overlap:
            back -= 1
            held += sizes[back]
        start = max(back, start + 1)
    return out


def sentence_chunks(pages: DataFrame, size: int, overlap: int) -> DataFrame:
    """(doc_id, page_number, piece, first_sentence, sentences, tokens): sentence windows of every page; NULL and blank texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, p, i, *w) for d, p, t in zip(b["doc_id"], b["page_number"], b["text"]) for i, w in enumerate(sentence_windows(t, size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "piece", "first_sentence", "sentences", "tokens"])

    return pages.select("doc_id", "page_number", "text").mapInPandas(run, "doc_id string, page_number int, piece int, first_sentence int, sentences int, tokens int")

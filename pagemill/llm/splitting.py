"""Cutting oversized texts at natural boundaries, with an overlap between consecutive pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map

TOKEN = re.compile(r"\S+")
HEADING = re.compile(r"(?:#+\s|(?:part|chapter|section|article|schedule|annex)\s+\w+|[IVXLC]+\.\s)", re.IGNORECASE)
# Separators from strong to weak; a boundary before a token has the strongest that stands there.
SECTION, PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD = range(6)


def boundaries(text: str) -> tuple[list[tuple[int, int]], list[int]]:
    """Each token's span, and the separator before it (WORD where there is only white space)."""
    spans = [m.span() for m in TOKEN.finditer(text)]
    ranks = []
    for k, (start, _) in enumerate(spans):
        if not k:
            ranks.append(SECTION)
            continue
        end = spans[k - 1][1]
        gap = text[end:start]
        last = text[end - 1]
        breaks = gap.count("\n") or ("\r" in gap)
        if breaks:
            ranks.append(SECTION if breaks > 1 and HEADING.match(text, start) else PARAGRAPH if breaks > 1 else LINE)
        else:
            ranks.append(SENTENCE if last in ".!?" else CLAUSE if last in ";:" else WORD)
    return spans, ranks


def units(ranks: list[int], lo: int, hi: int, limit: int, level: int = SECTION) -> tuple[list[tuple[int, int]], int]:
    """Ranges of tokens of at most limit, cut at the strongest separators that do; and the most tokens that only white space parts."""
    out, stack, longest = [], [(lo, hi, level)], 0
    while stack:
        lo, hi, level = stack.pop()
        if hi - lo <= limit:
            out.append((lo, hi))
        elif level >= WORD:
            longest = max(longest, hi - lo)
            out += [(a, min(a + limit, hi)) for a in range(lo, hi, limit)]
        else:
            cuts = [lo, *(k for k in range(lo + 1, hi) if ranks[k] <= level), hi]
            stack += [(a, b, level + 1) for a, b in zip(cuts[-2::-1], cuts[:0:-1])]
    return out, longest


def split(text: str | None, size: int, overlap: int, found: tuple[list[tuple[int, int]], list[int]] | None = None) -> tuple[list[tuple[int, int, int]], int, int]:
    """(pieces, tokens, longest): pieces as (first character, end, tokens); longest has the tokens of the longest range that could be cut between words alone, 0 if there was none.

    found: the text's boundaries, where they are known.

    A piece but the first starts with the overlap's tokens of the one before, and units of the text's separators follow as
    far as size allows. Blank and NULL texts have no pieces; an overlap of size or more counts as size - 1.
    """
    if size < 1:
        raise ValueError("size must be at least 1")
    overlap = max(0, min(overlap, size - 1))
    spans, ranks = found or boundaries(text or "")
    n = len(spans)
    if not n:
        return [], 0, 0
    if n <= size:
        return [(spans[0][0], spans[-1][1], n)], n, 0
    pieces, start, end = [], 0, 0
    ranges, longest = units(ranks, 0, n, size - overlap)
    for a, b in ranges:
        if b - start > size:
            pieces.append((start, end))
            start = end - min(overlap, end)
        end = b
    pieces.append((start, end))
    return [(spans[a][0], spans[b - 1][1], b - a) for a, b in pieces], n, longest


def split_texts(rows: DataFrame, keys: list[str], settings: list[tuple[str, int, int]]) -> DataFrame:
    """keys, protocol_id, tokens, longest_run, pieces array<struct<start, end, tokens>> for each row and setting (id, size, overlap)."""
    rows = rows.select(*keys, "text")
    schema = rows.select(*keys).schema
    schema = T.StructType([*schema.fields, T.StructField("protocol_id", T.StringType()), T.StructField("tokens", T.IntegerType()), T.StructField("longest_run", T.IntegerType()),
                           T.StructField("pieces", T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("start", "end", "tokens")])))])
    piece = pa.list_(pa.struct([(c, pa.int32()) for c in ("start", "end", "tokens")]))
    k = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(k).to_pylist()
            bounds = [boundaries(t or "") for t in texts]
            for name, size, overlap in settings:
                found = [split(t, size, overlap, at) for t, at in zip(texts, bounds)]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(j) for j in range(k)), pa.array([name] * len(texts), pa.string()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.int32()),
                     pa.array([[dict(zip(("start", "end", "tokens"), p)) for p in x[0]] for x in found], piece)],
                    names=[*keys, "protocol_id", "tokens", "longest_run", "pieces"],
                )

    return arrow_map(rows, run, schema)


def latest_pages(pages: DataFrame) -> DataFrame:
    """One row for each doc_id and page_number: the one loaded last, of equal ones that with the greatest text."""
    order = Window.partitionBy("doc_id", "page_number").orderBy(F.desc_nulls_last("loaded_at"), F.desc_nulls_last("text"))
    return pages.select("doc_id", "page_number", "text", "loaded_at").withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn", "loaded_at")


def settings_of(protocols: DataFrame) -> list[tuple[str, int, int]]:
    """The settings of a table of protocols, of which there may be at most a thousand."""
    rows = protocols.where("chunk_token_size > 0").select("protocol_id", "chunk_token_size", F.coalesce("chunk_token_overlap", F.lit(0))).distinct().orderBy("protocol_id").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than a thousand protocols")
    return [tuple(r) for r in rows]

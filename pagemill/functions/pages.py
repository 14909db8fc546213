"""Routing and quality of pages, as Column builders; limits are parameters with the service's values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_CHARS, SUSPICIOUS_CHARS, COMPLETE_CHARS = 50, 200, 1500
BAD_CHARS, LARGE_IMAGE, SCAN_IMAGE = 0.05, 0.25, 0.70


def triage_label(chars: Column, bad: Column, image: Column) -> Column:
    scan = (chars < LEAST_CHARS) | ((image >= SCAN_IMAGE) & (chars < SUSPICIOUS_CHARS))
    doubtful = (chars <= SUSPICIOUS_CHARS) | (bad >= BAD_CHARS) | ((image >= LARGE_IMAGE) & (chars < COMPLETE_CHARS))
    return F.when(scan, "scan").when(doubtful, "suspicious").otherwise("native_clean")


def quality_score(chars: Column, bad: Column, markers: Column) -> Column:
    complete = F.least(chars / COMPLETE_CHARS, F.lit(1.0))
    clean = 1 - F.least(bad / BAD_CHARS, F.lit(1.0))
    return F.round(0.5 * complete + 0.3 * clean + 0.2 * F.least(markers / 3, F.lit(1.0)), 4)


def quality_flags(chars: Column, bad: Column, image: Column, tables: Column, markers: Column) -> Column:
    flags = {"low_text": chars < LEAST_CHARS, "bad_encoding": bad >= BAD_CHARS, "large_image": image >= LARGE_IMAGE, "has_tables": tables > 0, "missing_legal_markers": markers == 0}
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]), lambda x: x.isNotNull())


def page_state(label: Column, native: Column, ocr: Column, requested: Column) -> Column:
    """(mode, status): which text of a page counts, and whether the page is degraded."""
    n, o = F.length(F.trim(F.coalesce(native, F.lit("")))), F.length(F.trim(F.coalesce(ocr, F.lit(""))))
    read = (label != "native_clean") & (o > 0) & ((label == "scan") | (n == 0) | (o > n))
    degraded = ~read & (((label == "scan") & (o == 0)) | ((label == "suspicious") & requested & (o == 0)))
    return F.struct(F.when(read, "ocr").otherwise("native").alias("mode"), F.when(degraded, "degraded").otherwise("parsed").alias("status"))


def parser_route(tagged: Column, born_digital: Column, complex_layout: Column, hybrid_healthy: Column) -> Column:
    return F.when(tagged, "tagged").when((born_digital | complex_layout) & hybrid_healthy, "hybrid").otherwise("local_only")


def strict_span(pages: Column) -> Column:
    """Sorted distinct pages; none if any is NULL or below 1."""
    return F.when(F.forall(pages, lambda p: F.coalesce(p > 0, F.lit(False))), F.array_sort(F.array_distinct(pages))).otherwise(F.array().cast("array<int>"))


def lenient_span(pages: Column) -> Column:
    """The pages from 1 up in their order."""
    return F.filter(pages, lambda p: p.isNotNull() & (p > 0))


def table_cells(table: Column) -> Column:
    """Rows of cells of a pipe, tab or semicolon table, or of one with columns parted by two spaces or more; rules are dropped."""
    rows = F.filter(F.split(table, r"\r?\n"), lambda r: F.regexp_replace(r, r"[-+|=:\s]", "") != "")
    bare = lambda r: F.regexp_replace(F.trim(r), r"^\||\|$", "")
    return F.transform(rows, lambda r: F.transform(F.split(bare(r), r"\||\t|;|\s{2,}"), lambda x: F.trim(x)))


def markdown_rows(rows: Column) -> Column:
    """A pipe table; rows are padded to the widest, and the first one is the head."""
    width = F.array_max(F.transform(rows, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, 1_000_000)), "\n")

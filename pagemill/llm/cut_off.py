"""Documents whose running text breaks off inside a sentence or word.

From the end of a text, site lines, page numbers, repetitions of the title, signatures, dates, annex notes, rows of tables and
marks of a cut are passed over. The characters that the running text then ends with are read backward: a character n-gram
model has counted how often they stand inside a text and how often a text ends with them. The log-odds of end against
continuation are compared with a threshold of the text's language and column, which splits the language's documents in two
groups. A text cut off right behind a sentence can't be told from a complete one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from .common import arrow_map, maybe_broadcast, non_blank
from .quality import BUCKETS, ngram_buckets
from .site_lines import line_form, line_key, with_all_site_keys

PAGE = regex.compile(r"[\W_]*(?:(?:page|seite|página|pág\.?|p\.|صفحة)\s*)?(?:\d{1,5}|[ivxlc]{1,6})(?:\s*(?:of|/|von|sur|de|من)\s*\d+)?[\W_]*", regex.I)
MARK = regex.compile(r"\s*(?:…|\.\.\.+|\[\s*(?:…|\.\.+|\w{0,12})\s*\]?|\((?:see|cf\.?|more|siehe|voir|véase|continued)?\)?|&#?\w{0,6};?|<[^<>]{0,12}|\\u?\w{0,4}|�+|»?\s*(?:read|see)\s+more)\s*$", regex.I)
CLOSING = regex.compile(
    r"\(?(?:signed|gezeichnet|gez\.|signé|firmado|توقيع)\b.*|(?:done|dated|issued|given|made|signed|fait|geschehen|hecho|dado|حرر)\b.{0,60}\d{4}\.?|(?:annex|appendix|schedule|annexe|anlage|anexo|ملحق)\b.{0,40}|(?:reported\s+by|source|filed\s+under|(?:back|return)\s+to)\b.{0,70}"
    r"|\P{L}*\d{1,2}\.?\s+\p{L}+\s+\d{4}",
    regex.I,
)
#: A word of running text as opposed to names and headings.
LOWER = regex.compile(r"(?<![\p{L}\p{N}])[\p{Ll}\p{Arabic}][\p{L}\p{M}'’-]*")
LINKS = {"of", "the", "and", "for", "v", "de", "la", "der", "des", "und", "et", "y", "du", "del", "von", "to", "in"}
STARTS = {"the", "a", "an", "any", "no", "on", "if", "when", "where", "each", "every", "under", "in", "by", "unless", "was", "for", "before", "having", "nothing", "it", "this", "that", "as", "at"}
TABLE = regex.compile(r"\t|\s{3,}\S|\|.*\||^[-+=|\s]{4,}$|<\w+[^>]*>|\S;\S+;\S|\.{5,}\s*\d+$")
ITEM = regex.compile(r"(?:[-*•□▪◦–]|\[\d+\])\s+")
SENTENCE_INSIDE = regex.compile(r"[.!?؟;]\s")

#: Weight of the shorter context's rate where the longer one is rare; and the rate of none.
BACKOFF, NEVER = 3.0, 0.02
#: Languages of fewer documents take the threshold of all; log-odds are split in so many steps, between these bounds.
LEAST_DOCS, STEPS, LOW, HIGH = 40, 120, -10.0, 10.0
#: The least spread of a group, in steps: a narrow group would else draw the threshold to its edge.
SPREAD = 4


def is_name(line: str) -> bool:
    """A heading, an office or a person: all words but linking ones start with a capital, and the first is none that opens sentences."""
    words = line.split()
    return bool(words) and len(words) <= 12 and words[0].casefold() not in STARTS and not SENTENCE_INSIDE.search(line) and not line.endswith((",", ";", ":", ".")) and all(w in LINKS for w in LOWER.findall(line))


def ending(text: str, site_keys: set[int]) -> str | None:
    """The last characters of the running text, or None where there is none under the title."""
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    title = next((f for x in lines if not PAGE.fullmatch(x) and len(f := line_form(x)) >= 8), "")
    at = len(lines) - 1
    while at > 0:
        last = lines[at]
        if not (
            len(last) >= 10 and line_key(last) in site_keys
            or len(last) < 30 and PAGE.fullmatch(last)
            or title and len(last) <= len(title) + 20 and title in line_form(last)
            or TABLE.search(last)
            or not MARK.search(last) and (CLOSING.fullmatch(last) or is_name(last) or ITEM.match(last) and len(last.split()) <= 10 and not last.endswith("."))
            or not regex.search(r"[\p{L}\p{N}]", last)
        ):
            break
        at -= 1
    if at <= 0:
        return None
    last = lines[at]
    while (cut := MARK.sub("", last)) != last:
        last = cut
    return last[-12:] or None


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [ending(t, set(k)) for t, k in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        two, three = np.zeros(len(found), np.int32), np.zeros(len(found), np.int32)
        for i, x in enumerate(found):
            if x:
                codes = np.array([32, 32, *map(ord, x.lower())], np.uint32)
                pair, triple = ngram_buckets(np.append(codes[-2:], np.uint32(0)))[0], ngram_buckets(codes[-3:])[1]
                two[i], three[i] = pair[0], int(triple[0]) + BUCKETS
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array(two), pa.array(three)], names=["doc_id", "lang", "last", "two", "three"])


def text_endings(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, lang (two letters, und where unknown), last (the running text's last characters) and their buckets of the n-gram model."""
    docs = docs.select("doc_id", "text", "source", F.coalesce(F.substring(F.lower(F.trim("lang")), 1, 2), F.lit("und")).alias("lang")).where(non_blank())
    schema = docs.select("doc_id", "lang").schema.add("last", "string").add("two", "integer").add("three", "integer")
    return arrow_map(with_all_site_keys(docs, lines).select("doc_id", "lang", "text", "site_keys"), _endings, schema)


def end_odds(endings: DataFrame, model: np.ndarray) -> DataFrame:
    """endings with odds: log2 of how much likelier than anywhere a text ends behind these characters, read backward.

    The document's own end isn't counted. Where the three last characters are rare, the two last weigh in.
    """
    spark = endings.sparkSession
    flat = model.reshape(-1)
    at = np.flatnonzero(flat)
    inside = F.broadcast(spark.createDataFrame(pa.table({"bucket": at.astype(np.int32), "inside": flat[at].astype(np.float64)})))  # at most 131,072 rows
    ends = {c: endings.groupBy(c).agg((F.count("*") - 1).alias(f"ends_{c}")) for c in ("two", "three")}
    out = endings
    for c in ("two", "three"):
        out = out.join(maybe_broadcast(ends[c], 16), c).join(inside.toDF(c, f"inside_{c}"), c, "left").fillna(0.0, [f"inside_{c}"])
    n = max(endings.count(), 1)
    base = n / max(float(model[0].sum()), 1.0)
    rate = f"((ends_two + {NEVER * base!r}D * {BACKOFF}D) / (inside_two + {BACKOFF}D))"
    rate = f"((ends_three + {BACKOFF}D * {rate}) / (inside_three + {BACKOFF}D))"
    return out.withColumn("odds", F.expr(f"log2({rate} / {base!r}D)"))


def _split(counts: np.ndarray) -> float:
    """Where a histogram parts in two normal groups with the fewest expected errors."""
    x, total = np.arange(STEPS), counts.sum()
    best, at = math.inf, STEPS // 2
    for k in range(1, STEPS):
        cost = 0.0
        for part in (slice(0, k), slice(k, STEPS)):
            n = counts[part].sum()
            if not n:
                break
            mean = (counts[part] * x[part]).sum() / n
            spread = math.sqrt((counts[part] * (x[part] - mean) ** 2).sum() / n + SPREAD**2)
            cost += n / total * (math.log(spread) - math.log(n / total))
        else:
            if cost < best:
                best, at = cost, k
    return LOW + (HIGH - LOW) * at / STEPS


def thresholds(odds: DataFrame) -> dict[str, float]:
    """The threshold of each language; "" is that of all documents. At most 1,000 languages of STEPS numbers reach the driver."""
    step = F.least(F.greatest(F.floor((F.col("odds") - LOW) / (HIGH - LOW) * STEPS), F.lit(0)), F.lit(STEPS - 1)).cast("int")
    rows = odds.groupBy("lang", step.alias("step")).agg(F.count("*").alias("n"))
    langs = rows.groupBy("lang").agg(F.sum("n").alias("docs")).where(F.col("docs") >= LEAST_DOCS).orderBy(F.desc("docs"), "lang").limit(1000)
    histogram: dict[str, np.ndarray] = {"": np.zeros(STEPS)}
    for r in rows.groupBy("step").agg(F.sum("n").alias("n")).collect():
        histogram[""][r.step] = r.n
    for r in rows.join(F.broadcast(langs), "lang").collect():
        histogram.setdefault(r.lang, np.zeros(STEPS))[r.step] = r.n
    return {k: _split(v) for k, v in histogram.items() if v.sum()}


def cut_off(docs: DataFrame, lines: DataFrame, others: DataFrame, model: np.ndarray) -> DataFrame:
    """doc_id of each document that breaks off.

    lines are the sources' repeated lines, others has the doc_id of documents that aren't prose (they are none), and model
    counts the n-grams of all texts. NULL and blank texts, and texts of a title alone, are none; repeated rows of a document
    give one row; an empty table gives none; other columns are ignored.
    """
    endings = text_endings(docs, lines).where("last IS NOT NULL")
    endings = materialise(endings.join(maybe_broadcast(others.select("doc_id").distinct(), 8), "doc_id", "left_anti").distinct())
    odds = materialise(end_odds(endings, model))
    found = thresholds(odds)
    limits = F.create_map(*[F.lit(x) for k, v in found.items() for x in (k, v)]) if found else F.lit(None).cast("map<string,double>")
    limit = F.coalesce(F.try_element_at(limits, F.col("lang")), F.try_element_at(limits, F.lit("")))
    return odds.where(F.col("odds") < limit).select("doc_id").distinct()

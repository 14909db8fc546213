"""Lines which a source puts into its texts again and again.

Pass one builds, per source and partition, a mergeable Misra-Gries summary of line identities; merged with its recorded
error it yields every line that can reach the threshold. Pass two counts only those lines exactly. Summaries are bounded
by the ratio of lines to documents, not by the corpus, so a source with a third of all rows needs no special path.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from .common import DIGITS, TEN_LETTERS, arrow_map, is_small, line_form, maybe_broadcast, non_blank

MIN_DOCS = 3
MIN_SHARE = 0.1


def form_key(form: str) -> int:
    """64 bits of a line's identity, as a signed number."""
    h = xxhash.xxh64_intdigest(form.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >= 1 << 63 else h


def line_key(line: str) -> int:
    return form_key(line_form(line))


def text_forms(text: str) -> list[str]:
    """line_form of each line."""
    return [" ".join(f.split()) for f in DIGITS.sub("0", text).casefold().split("\n")]


def line_forms(text: str) -> list[tuple[str, str]]:
    """Each line of at least ten characters and its line_form."""
    return [(x, f) for x, f in zip(text.split("\n"), text_forms(text)) if len(x) >= 10]


def words_key(words: list[str]) -> int:
    """line_key of a line of which words = line.casefold().split()."""
    return form_key(DIGITS.sub("0", " ".join(words)))


class Summary:
    """Misra-Gries over sets: after any number of updates a true count is at most the kept count plus error."""

    def __init__(self, share: float):
        self.share, self.kept, self.error, self.docs, self.seen = share, Counter(), 0, 0, 0

    def room(self) -> int:
        """Counters needed for an error of at most half the share of the documents."""
        return max(256, int(2 / self.share * self.seen / max(self.docs, 1)))

    def add(self, keys: set[int]) -> None:
        self.docs += 1
        self.seen += len(keys)
        self.kept.update(keys)
        if len(self.kept) > 2 * self.room():
            self.shrink()

    def shrink(self) -> None:
        counts = sorted(self.kept.values(), reverse=True)
        if len(counts) > (room := self.room()):
            less = counts[room]
            self.error += less
            self.kept = Counter({k: c - less for k, c in self.kept.items() if c > less})


def _summaries(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_source: dict[str, Summary] = {}
        for b in batches:
            for text, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keys = {form_key(f) for x, f in line_forms(text) if TEN_LETTERS.search(x)}
                if source not in by_source:
                    by_source[source] = Summary(share)
                by_source[source].add(keys)
        for source, s in by_source.items():
            s.shrink()
            keys = list(s.kept)
            n = len(keys) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([source] * n), pa.array([*keys, None], pa.int64()), pa.array([*(s.kept[k] for k in keys), 0], pa.int64()), pa.array([*[0] * len(keys), s.error], pa.int64())],
                names=["source", "key", "kept", "error"],
            )

    return run


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, sources, lines, keys = [], [], [], []
        for i, text, source, wanted in zip(*(b.column(k).to_pylist() for k in range(4))):
            wanted = set(wanted)
            for n, f in enumerate(text_forms(text), 1):
                if (k := form_key(f)) in wanted:
                    ids.append(i)
                    sources.append(source)
                    lines.append(n)
                    keys.append(k)
        yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(sources, pa.string()), pa.array(lines, pa.int32()), pa.array(keys, pa.int64())], names=["doc_id", "source", "line_no", "key"])


def repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> tuple[DataFrame, DataFrame]:
    """(found, lines): found has doc_id, source, line_no, key of each repeated line; lines has source, key, n_docs, n_source.

    A line of at least ten letters counts if at least min_docs of the source's documents hold it and at least min_share
    of its non-blank ones. NULL and blank texts and NULL sources have no lines; a document counts once for a line however
    often it or its row repeats; an empty table gives empty results; other columns are ignored.
    """
    docs = docs.select("doc_id", "text", "source").where(F.col("source").isNotNull() & non_blank())
    totals = docs.groupBy("source").agg(F.countDistinct("doc_id").alias("n_source"))
    parts = materialise(arrow_map(docs.select("text", "source"), _summaries(min_share), "source string, key bigint, kept bigint, error bigint"))
    slack = parts.where("key IS NULL").groupBy("source").agg(F.sum("error").alias("slack"))
    reach = F.greatest(F.lit(min_docs), F.ceil(F.lit(min_share) * F.col("n_source") - 1e-9))
    bounds = materialise(totals.join(slack, "source").withColumn("least", reach))
    possible = (
        parts.where("key IS NOT NULL").groupBy("source", "key").agg(F.sum("kept").alias("kept"))
        .join(maybe_broadcast(bounds, 100), "source").where("kept + slack >= least")
        .groupBy("source").agg(F.collect_list("key").alias("wanted"))
    )  # at most 2 / min_share keys for each line that a document of the source has on average
    possible = materialise(possible)
    fits = possible.agg(F.sum(F.size("wanted") * 8 + 64)).first()[0] or 0
    found = docs.join(F.broadcast(possible) if fits <= 8 << 20 else possible, "source").select("doc_id", "text", "source", "wanted")
    found = materialise(arrow_map(found, _matches, docs.select("doc_id").schema.add("source", "string").add("line_no", "integer").add("key", "long")).distinct())
    lines = (
        found.select("source", "key", "doc_id").distinct().groupBy("source", "key").agg(F.count("*").alias("n_docs"))
        .join(maybe_broadcast(bounds, 100), "source").where("n_docs >= least").select("source", "key", "n_docs", "n_source")
    )
    lines = materialise(lines)
    return found.join(F.broadcast(lines) if is_small(lines, 60) else lines, ["source", "key"], "left_semi").select("doc_id", "source", "line_no", "key"), lines


def with_site_keys(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """docs with site_keys, the keys of its source's repeated lines (an empty array where there are none)."""
    by_source = lines.groupBy("source").agg(F.collect_list("key").alias("site_keys"))
    fits = (lines.count()) * 16 <= 8 << 20
    return docs.join(F.broadcast(by_source) if fits else by_source, "source", "left").withColumn("site_keys", F.coalesce("site_keys", F.array().cast("array<bigint>")))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(i, k) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k in {form_key(f) for _, f in line_forms(text)}]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], b.column(0).type), pa.array([k for _, k in rows], pa.int64())], names=["doc_id", "key"])


def with_all_site_keys(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """docs with site_keys as with_site_keys has them; documents without a source have those of their lines that any source repeats."""
    loose = docs.where(F.col("source").isNull())
    keys = arrow_map(loose.where(non_blank()).select("doc_id", "text"), _keys, docs.select("doc_id").schema.add("key", "long"))
    keys = keys.join(maybe_broadcast(lines.select("key").distinct(), 8), "key", "left_semi").groupBy("doc_id").agg(F.collect_set("key").alias("site_keys"))
    loose = loose.join(maybe_broadcast(keys, 100), "doc_id", "left").withColumn("site_keys", F.coalesce("site_keys", F.array().cast("array<bigint>")))
    return with_site_keys(docs.where(F.col("source").isNotNull()), lines).unionByName(loose)


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out, gone = [], []
        for text, keys in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            if text is None or not keys:
                out.append(text)
                gone.append(0)
                continue
            keys = set(keys)
            rows = text.split("\n")
            kept = [x for x in rows if line_key(x) not in keys]
            out.append("\n".join(kept))
            gone.append(len(rows) - len(kept))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(gone, pa.int32())], names=["doc_id", "text", "lines_removed"])


def remove_repeated_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, text, lines_removed): each document's text without its source's repeated lines; NULL texts stay NULL."""
    docs = with_site_keys(docs.select("doc_id", "text", "source"), lines).select("doc_id", "text", "site_keys")
    return arrow_map(docs, _cleaned, docs.select("doc_id", "text").schema.add("lines_removed", "integer"))

"""Statistics of each document's text, and a learned rule list that tells prose from lists, tables and junk."""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise
from . import rules
from .common import arrow_map, non_blank
from .site_lines import repeated_lines, with_site_keys, words_key

#: The most labelled documents that rules are learned from; of more, those with the smallest hash of doc_id.
MAX_LABELS = 20_000

# Common words of the corpus' languages.
COMMON = frozenset(
    """the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were
    there been one all we can has their if will when no more who may its any would shall must under than such other
    le la les de des du un une et est en que qui dans pour par sur au aux ne pas ce cette il elle se son sa ses ou avec sont
    der die das den dem des ein eine einer eines einem einen und ist zu von mit auf für nicht im sich als auch an bei nach wird oder
    wurde werden daher soweit el los las del y es por con para una su al lo como más o pero sus sin sobre ser fue este
    esta debe ante في من على إلى أن لا هذا هذه التي الذي ما كل قد إذا عن قبل خلال فإن غير ذلك أو لم بعد يجب هو هي""".split()
)

BUCKETS = 1 << 16
SPACE, LETTER, DIGIT, SYMBOL, BAD = range(5)
FEATURES = (
    "prose_share", "short_share", "cell_share", "cell_line_share", "end_share", "common_share", "mean_word_len", "long_word_share",
    "variety", "repeated_line_share", "letter_share", "digit_share", "symbol_share", "bad_share", "familiarity",
)
COUNTS = ("text_char_count", "word_count", "line_count")
MULTI_SPACE = re.compile(r"\S {2,}(?=\S)")
TIGHT_COMMA = re.compile(r"\S,(?=[^\s\d])|,(?=\d+,)")
RULED = re.compile(r"[-+=|:_ ]{5,}")
ENDS = (".", "!", "?", ":", ";", "…", "؟", "。", '."', ".)", ".”", ".»")


def _classes() -> np.ndarray:
    """The class of each code point of the basic plane; index 65,535 stands for all beyond it."""
    kinds = {"Z": SPACE, "L": LETTER, "M": LETTER, "N": DIGIT, "P": SYMBOL, "S": SYMBOL, "C": BAD}
    out = np.array([kinds[unicodedata.category(chr(c))[0]] for c in range(65536)], np.uint8)
    out[[9, 10, 11, 12, 13]] = SPACE
    out[[0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0xAD, 0xFEFF]] = SYMBOL
    out[0xFFFD], out[65535] = BAD, SYMBOL
    return out


_TABLE: list[np.ndarray] = []


def classes() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_classes())
    return _TABLE[0]


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a line end, and where each text starts."""
    codes = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts), np.int64)
    np.cumsum([len(t) + 1 for t in texts[:-1]], out=starts[1:])
    return codes, starts


def ngram_buckets(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bucket for each two code points that a third follows, and one for all three; digits are alike."""
    c = codes.astype(np.uint32)
    c = np.where((c >= 48) & (c <= 57), np.uint32(48), c)
    two = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77)
    return _bucket(two), _bucket(two + c[2:] * np.uint32(0xC2B2AE3D))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)


def _ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(2 * BUCKETS, np.int64)
    for b in batches:
        if b.num_rows:
            for k, h in enumerate(ngram_buckets(codes_of([t.lower() for t in b.column(0).to_pylist()])[0])):
                total[k * BUCKETS : (k + 1) * BUCKETS] += np.bincount(h, minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])


def ngram_model(docs: DataFrame) -> np.ndarray:
    """Counts of all texts' buckets of two and of three code points: 131,072 numbers whatever the size of the corpus."""
    rows = arrow_map(docs.where(non_blank()).select("text"), _ngrams, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(2 * BUCKETS)
    n[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    return n.reshape(2, BUCKETS).astype(np.float32)


def log_model(n: np.ndarray) -> np.ndarray:
    """Counts as logarithms, so that the difference of both rows is how often a code point follows the two before it."""
    return np.log2(n + np.array([[5], [0.05]])).astype(np.float32)


def familiarity(codes: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """log2 of how often each code point follows the two before it, in the model's texts; 0 for the last two."""
    if len(codes) < 3:
        return np.zeros(len(codes), np.float32)
    two, three = ngram_buckets(codes)
    return np.append(logs[1][three] - logs[0][two], np.zeros(2, np.float32))


def line_stats(line: str, words: list[str]) -> tuple[int, bool, bool, bool]:
    """(common words, it is prose, it is a row of cells, it is a short item) of a line without outer white space; words are case folded."""
    n, common = len(words), sum(map(COMMON.__contains__, words))
    cells = max(line.count("|"), line.count("\t"), line.count(";"))
    if "  " in line:
        cells = max(cells, len(MULTI_SPACE.findall(line)))
    if cells < 2 and line.count(",") > 1:
        cells = len(TIGHT_COMMA.findall(line))
    rule = n < 4 and bool(RULED.fullmatch(line))
    if cells >= 2 and not rule and 2 * sum(map(str.isalnum, line)) < sum(map(len, words)) - line.count("|"):
        cells = 0  # symbols, not cells
    prose = cells * 6 <= n and (n >= 4 and common * 20 >= n * 3 or n >= 6 and line.endswith(ENDS) and common > 0)
    return common, prose, rule or cells >= 2 and not prose, n <= 10 and not prose and cells < 2 and not rule


def doc_features(texts: list[str], keys: list[list[int]], logs: np.ndarray) -> list[np.ndarray]:
    """A column for each of COUNTS and FEATURES. The body is what isn't blank, a site line or the first of the rest (the title)."""
    out = np.zeros((len(COUNTS) + len(FEATURES), len(texts)))
    bodies = []
    for i, (text, own) in enumerate(zip(texts, keys)):
        own = set(own)
        rows = [(x, w) for x in map(str.strip, text.split("\n")) if x and (w := x.casefold().split()) and not (own and len(x) >= 10 and words_key(w) in own)]
        if len(rows) > 1:
            del rows[0]
        chars = words = common = prose = short = cells = cell_chars = ends = longer = gaps = 0
        seen: set[str] = set()
        for x, w in rows:
            n, size = len(w), len(x)
            c, is_prose, is_cells, is_short = line_stats(x, w)
            chars += size
            words += n
            common += c
            prose += size * is_prose
            cells += is_cells
            short += is_short
            cell_chars += size * is_cells
            ends += x.endswith(ENDS)
            gaps += x.count(" ")
            seen.update(w)
            if size > 25 * n:
                longer += sum(len(v) for v in w if len(v) > 25)
        k, chars = max(len(rows), 1), max(chars, 1)
        body = "\n".join([x for x, _ in rows])
        bodies.append(body.lower() or " ")
        out[: len(COUNTS) + 10, i] = [
            len(text), len(text.split()), text.count("\n") + 1, prose / chars, short / k, cell_chars / chars, cells / k, ends / k, common / max(words, 1), (chars - gaps) / max(words, 1), longer / chars,
            math.log(len(seen) + 1) / math.log(words + 2), 1 - len({x for x, _ in rows}) / k,
        ]
    codes, starts = codes_of(bodies)
    sizes = np.diff(np.append(starts, len(codes)))
    kinds = classes()[np.minimum(codes, 65535)] + np.repeat(np.arange(len(texts)) * 5, sizes)
    shares = np.bincount(kinds, minlength=5 * len(texts)).reshape(-1, 5) / sizes[:, None]
    for j, kind in enumerate((LETTER, DIGIT, SYMBOL, BAD)):
        out[len(COUNTS) + 10 + j] = shares[:, kind]
    out[-1] = np.add.reduceat(familiarity(codes, logs), starts) / sizes
    return list(out)


def text_statistics(docs: DataFrame, lines: DataFrame, model: np.ndarray | None = None) -> DataFrame:
    """doc_id, counts of the whole text and FEATURES of its body, for each non-blank document."""
    docs = docs.select("doc_id", "text", "source").where(non_blank())
    shared = docs.sparkSession.sparkContext.broadcast(log_model(ngram_model(docs) if model is None else model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                columns = doc_features(b.column(1).to_pylist(), b.column(2).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c.astype(np.int64)) for c in columns[: len(COUNTS)]), *map(pa.array, columns[len(COUNTS) :])], names=["doc_id", *COUNTS, *FEATURES])

    schema = docs.select("doc_id").schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    for f in FEATURES:
        schema = schema.add(f, "double")
    return arrow_map(with_site_keys(docs, lines).select("doc_id", "text", "site_keys"), run, schema)


def agreed_labels(labels: DataFrame) -> DataFrame:
    """One kind for each labelled document: the one of most raters, then the latest, then the first by name."""
    votes = labels.where("doc_id IS NOT NULL AND kind IS NOT NULL").groupBy("doc_id", "kind").agg(F.count("*").alias("votes"), F.max("labelled_at").alias("last"))
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("votes"), F.desc_nulls_last("last"), "kind"))
    return votes.withColumn("rn", first).where("rn = 1").select("doc_id", "kind")


def learn_rules(stats: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> list[rules.Rule]:
    """A rule list from at most max_labels labelled documents; none if there are no labels."""
    sample = agreed_labels(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    rows = stats.select("doc_id", *FEATURES).join(F.broadcast(sample), "doc_id").orderBy("doc_id").toPandas()
    if rows.empty:
        return []
    return rules.learn(rows[list(FEATURES)].to_numpy(float), rows["kind"].tolist(), list(FEATURES), "prose")


def document_kinds(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, lines: DataFrame | None = None, model: np.ndarray | None = None) -> DataFrame:
    """doc_id, kind (prose, list, table or junk) and the statistics of every non-blank document.

    Blank and NULL texts have no row; a document whose lines all are site lines counts as it stands. Repeated rows of a
    document give equal rows. Without labels everything is prose. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text", "source")
    if lines is None:
        lines = repeated_lines(docs)[1]
    stats = materialise(text_statistics(docs, lines, model))
    found = learn_rules(stats, labels, max_labels)
    return stats.withColumn("kind", F.expr(rules.case_sql(found, "prose")))


def last_signal(signals: DataFrame) -> DataFrame:
    """The latest recording of each document (of simultaneous ones the largest counts): recorded_chars, _words, _bad_ratio."""
    order = [F.desc_nulls_last(c) for c in ("recorded_at", "text_char_count", "word_count", "bad_char_ratio")]
    rows = signals.where("doc_id IS NOT NULL").select("doc_id", "recorded_at", "text_char_count", "word_count", "bad_char_ratio")
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).where("rn = 1")
    return first.select("doc_id", F.col("text_char_count").alias("recorded_chars"), F.col("word_count").alias("recorded_words"), F.col("bad_char_ratio").alias("recorded_bad_ratio"))


if sys.byteorder != "little":
    raise ImportError("code points are read as little-endian numbers")

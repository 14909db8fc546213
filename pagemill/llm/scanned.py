"""Noise of scanned pages: running headers, page numbers, divided words and misread characters; and the text without them.

A text counts as scanned where its lines break inside sentences, whatever source_mode says: that field is missing or wrong
too often. Words are grouped by the skeleton of their glyphs, in which confusable characters are alike (0 and o; 1, l and i;
rn and m). Of each group the forms that are frequent, or usual in texts that aren't scanned, are supported; any other form is
a misreading of the most frequent one. Where a group has several supported forms, the words beside an occurrence decide.
Headers are lines that repeat the title once digits are masked. Repaired lines are joined to paragraphs by SQL windows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise
from .common import DIGITS, arrow_map, is_small, maybe_broadcast, non_blank
from .site_lines import line_key, with_site_keys

#: A form this many times rarer than its group's most frequent one isn't supported by its frequency.
RARER = 20
#: A rarer form is supported by so many uses in texts that aren't scanned, if they are such a share of its uses.
CLEAN_USES, CLEAN_SHARE = 3, 0.3
#: The forms that tasks know to be right and needn't send on; more are sent and joined.
KNOWN = 50_000
#: Forms of groups with several supported forms that tasks know; if there are more, the neighbours of all words that aren't known to be right are counted and joined.
AMBIGUOUS = 50_000
#: Different words that a task counts before it hands its counts on.
HELD = 200_000

# Characters that are read for one another, each with the glyph it stands for; composed letters are spelt by their strokes.
GLYPHS = {
    "0": "o", "1": "i", "l": "i", "|": "i", "!": "i", "e": "c", "(": "c", "9": "g", "q": "g", "5": "s", "8": "s", "f": "t", "y": "v", "b": "h", "6": "h", "2": "z",
    "d": "ci", "n": "ri", "m": "rri", "u": "ii", "w": "vv", "à": "a", "á": "a", "â": "a", "ä": "a", "ã": "a", "å": "a", "è": "c", "é": "c", "ê": "c", "ë": "c", "ç": "c",
    "ì": "i", "í": "i", "î": "i", "ï": "i", "ò": "o", "ó": "o", "ô": "o", "ö": "o", "ù": "ii", "ú": "ii", "û": "ii", "ü": "ii", "ñ": "ri",
}
SKELETON = str.maketrans(GLYPHS)
HYPHENS = "-‐­¬"
#: Ends of a line that breaks off inside a sentence; longer lines are paragraphs.
GOES_ON, LONG = frozenset(",;" + HYPHENS), 160
LETTER, WORD_PARTS = regex.compile(r"\p{L}"), regex.compile(r"\p{L}+|0")
FIRST_WORD = regex.compile(r"[\p{L}\p{N}|(]+")
TRAILING, LEADING = ".,;:!?\"”’'»)]", "\"“‘'«["
PAGE_LINE = regex.compile(r"[^\p{L}\p{N}]*(?:(?:page|seite|página|pág\.?|p\.|صفحة)\s*)?(?:[0-9]{1,5}|[ivxlc]{1,7})(?:\s*(?:of|/|von|sur|de|من)\s*[0-9]+)?[^\p{L}\p{N}.,;:]*", regex.I)
SEPARATED = regex.compile(r"^\s*\d{1,5}\s*[|–—\-]\s*|\s*[|–—\-]\s*(?:page\s*)?\d{1,5}\s*$", regex.I)


def form_of(token: str) -> str:
    return token.rstrip(TRAILING).lstrip(LEADING)


def is_word(form: str) -> bool:
    """An ordinary lower-case word, perhaps misread; not a name, a number or a mark of a list."""
    return len(form) > 1 and form.islower() and not (form[0] == "(" and len(form) < 4)


def is_scanned(text: str) -> bool:
    """Whether every fifth line or more breaks off inside a sentence and goes on in the next."""
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    n = 0
    for x, y in zip(lines, lines[1:]):
        if (y[0].islower() or y[0] == "(" and y[1:3].islower()) and (x[-1].islower() or x[-1] in GOES_ON) and len(x) < LONG:
            n += 1
    return n > 0 and 5 * n >= len(lines)


def header_form(line: str) -> str:
    """A line's letters and masked digits, without a page's number beside it."""
    return " ".join(WORD_PARTS.findall(DIGITS.sub("0", bare(line))))


def bare(line: str) -> str:
    """A line, case folded, without a page's number beside it."""
    return " ".join(SEPARATED.sub("", line).casefold().split())


def same_header(line: str, title: str, title_form: str) -> bool:
    """The same text as the bare title but for digits and at most one misread character in twenty."""
    if abs(len(line) - len(title)) > 24:
        return False
    start = line.lstrip("0123456789 |–—-")[:3].casefold()
    if not any(x == y for x, y in zip(start, title)):
        return False
    line = bare(line)
    if len(line) == len(title) and sum(x != y and not (x.isdigit() and y.isdigit()) for x, y in zip(line, title)) <= len(line) // 20:
        return True
    return header_form(line) == title_form


def layout(lines: list[str], site_keys: set[int]) -> list[str]:
    """What each line is: blank, site, title, header, page_number or text."""
    kinds = []
    for x in lines:
        x = x.strip()
        kinds.append("blank" if not x else "site" if site_keys and len(x) >= 10 and line_key(x) in site_keys else "page_number" if len(x) < 24 and PAGE_LINE.fullmatch(x) else "text")
    at = next((i for i, k in enumerate(kinds) if k == "text"), None)
    if at is None:
        return kinds
    title, form = bare(lines[at]), header_form(lines[at])
    if len(form) < 8:
        kinds[at] = "title"
        return kinds
    last = max(i for i, k in enumerate(kinds) if k != "blank")
    seen = []
    for i, k in enumerate(kinds):
        if k == "text" and (i == at or same_header(lines[i], title, form) or i == last and len(cut := header_form(lines[i])) * 2 >= len(form) and form.startswith(cut)):
            kinds[i] = "header"
            seen.append(i)
    start = next((i for i, k in enumerate(kinds) if k == "text"), len(kinds))  # headers above the running text end with the title
    above = [i for i in seen if i < start]
    plain = [i for i in above if not SEPARATED.search(lines[i])]
    kinds[(plain or above)[-1]] = "title"
    return kinds


def divided(lines: list[str], kinds: list[str]) -> dict[int, tuple[int, str, str, str]]:
    """Of each line of running text that ends in a hyphen: the next such line, the word before, the hyphen, the word after."""
    out = {}
    text = [i for i, k in enumerate(kinds) if k == "text"]
    for i, j in zip(text, text[1:]):
        line = lines[i].rstrip()
        if line[-1] in HYPHENS and (b := FIRST_WORD.match(lines[j].lstrip())):
            a = line.split()[-1]
            if len(a) > 1 and (a[-2].isalnum() or a[-2] in "|(") and LETTER.search(a):
                out[i] = (j, a[:-1], a[-1], b[0])
    return out


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """form, skeleton, uses, uses in texts that aren't scanned; parts of divided words are left out."""
    tokens: tuple[Counter[str], Counter[str]] = Counter(), Counter()

    def flush():
        total: Counter[str] = Counter()
        clean: Counter[str] = Counter()
        for k, counted in enumerate(tokens):
            for t, n in counted.items():
                if is_word(f := form_of(t)):
                    total[f] += n
                    clean[f] += n * k
            counted.clear()
        forms = list(total)
        yield pa.RecordBatch.from_arrays([pa.array(forms, pa.string()), pa.array([f.translate(SKELETON) for f in forms], pa.string()), pa.array([total[f] for f in forms], pa.int64()), pa.array([clean[f] for f in forms], pa.int64())], names=["form", "skeleton", "n", "clean"])

    for b in batches:
        for text in b.column(0).to_pylist():
            if is_scanned(text):
                tokens[0].update(undivided(text))
            else:
                tokens[1].update(text.split())
        if len(tokens[0]) + len(tokens[1]) > HELD:
            yield from flush()
    yield from flush()


def undivided(text: str) -> list[str]:
    """The words of a text without the parts of those that a line end divides."""
    out: list[str] = []
    cut = False
    for line in text.split("\n"):
        words = line.split()
        if not words:
            continue
        if cut:
            words = words[1:]
        cut = line.rstrip()[-1] in HYPHENS
        out += words[:-1] if cut else words
    return out


def word_forms(docs: DataFrame) -> DataFrame:
    """(form, skeleton, n, clean) of every lower-case word of all documents."""
    counts = arrow_map(docs.where(non_blank()).select("text"), _forms, "form string, skeleton string, n bigint, clean bigint")
    return counts.groupBy("form", "skeleton").agg(F.sum("n").alias("n"), F.sum("clean").alias("clean"))


def judged(forms: DataFrame) -> DataFrame:
    """forms with best (the group's most frequent form), supported (the form may stand) and rivals (supported forms of the group)."""
    group = forms.groupBy("skeleton").agg(F.max(F.struct("n", "form")).alias("top"))
    out = forms.join(group, "skeleton").withColumn("best", F.col("top.form"))
    usual = (F.col("clean") >= CLEAN_USES) & (F.col("clean") >= CLEAN_SHARE * F.col("n"))
    out = out.withColumn("supported", (F.col("n") * RARER >= F.col("top.n")) | usual)
    rivals = out.groupBy("skeleton").agg(F.count_if("supported").alias("rivals"))
    return out.join(rivals, "skeleton").select("form", "skeleton", "n", "best", "supported", "rivals")


def _lines(known: set[str], ambiguous: set[str], more: bool):
    """Of scanned texts each line's findings that need no counts, and those to be looked up; of all texts the neighbours of ambiguous words, with more those of any word that may be one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beside: Counter[tuple[str, str, str]] = Counter()
        empty = None
        for b in batches:
            rows = []
            for doc, text, keys in zip(*(c.to_pylist() for c in b.columns)):
                if ambiguous or more:
                    flat = text.split()
                    for k in [k for k, t in enumerate(flat) if t in ambiguous or more and t not in known and is_word(t) and form_of(t) == t]:
                        beside["left", flat[k], form_of(flat[k - 1]) if k else ""] += 1
                        beside["right", flat[k], form_of(flat[k + 1]) if k + 1 < len(flat) else ""] += 1
                if not is_scanned(text):
                    continue
                lines = text.split("\n")
                kinds = layout(lines, set(keys))
                cuts = divided(lines, kinds)
                tails = {j: (i, a, c) for i, (j, a, _, c) in cuts.items()}
                for i, k in enumerate(kinds):
                    if k in ("header", "page_number"):
                        rows.append((doc, i + 1, k, None, None, None, None))
                    if k != "text":
                        continue
                    words = lines[i].split()
                    if i in cuts:
                        j, a, h, c = cuts[i]
                        rows.append((doc, i + 1, "hyphen", form_of(a + c).lower(), form_of(f"{a}-{c}").lower(), None, None))
                        whole = form_of(a + c)
                        if is_word(whole) and whole not in known:
                            rows.append((doc, i + 1, "part", whole, str(len(a)), str(j + 1), None))
                        words = words[:-1]
                    flat = [form_of(t) for t in words]
                    for n, t in enumerate(flat):
                        if n == 0 and i in tails:
                            continue
                        if t not in known and is_word(t):
                            rows.append((doc, i + 1, "word", t, None, flat[n - 1] if n else "", flat[n + 1] if n + 1 < len(flat) else ""))
            empty = b.column(0).type
            yield _batch(rows, empty)
            if len(beside) > HELD:
                yield _batch([(None, c, side, form, other, None, None) for (side, form, other), c in beside.items()], empty)
                beside.clear()
        if beside:
            yield _batch([(None, c, side, form, other, None, None) for (side, form, other), c in beside.items()], empty)

    return run


def _batch(rows: list[tuple], doc_type: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 7
    types = [doc_type, pa.int32(), *[pa.string()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "line_no", "kind", "a", "b", "l", "r"])


def _some(rows: DataFrame, most: int) -> set[str]:
    return {r[0] for r in rows.select("form").limit(most).collect()}


def scan_findings(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, defect, form, best): header, page_number, hyphen and misread findings of every scanned document.

    lines are the sources' repeated lines, which are no running text. form and best are the word as it stands and as it should
    be, where there is one. NULL, blank and unscanned texts, and empty tables, give no rows; repeated rows of a document give
    its findings once; other columns are ignored.
    """
    docs = docs.select("doc_id", "text", "source").where(non_blank())
    forms = materialise(judged(materialise(word_forms(docs))))
    right = forms.where("supported AND rivals = 1").orderBy(F.desc("n"), "form")
    known = _some(right, KNOWN)
    rivals = forms.where("supported AND rivals > 1")
    ambiguous = _some(rivals.orderBy(F.desc("n"), "form"), AMBIGUOUS)
    more = len(ambiguous) == AMBIGUOUS and rivals.count() > AMBIGUOUS
    width = forms.agg(F.max(F.octet_length("form"))).first()[0] or 0
    schema = docs.select("doc_id").schema.add("line_no", "integer")
    for c in ("kind", "a", "b", "l", "r"):
        schema = schema.add(c, "string")
    seen = materialise(arrow_map(with_site_keys(docs, lines).select("doc_id", "text", "site_keys"), _lines(known, ambiguous, more), schema))

    plain = seen.where("kind IN ('header', 'page_number')").select("doc_id", "line_no", F.col("kind").alias("defect"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("string").alias("best"))

    uses = forms.select("form", "n")
    uses = F.broadcast(uses) if is_small(uses, max(60, width)) else uses
    cut = seen.where("kind = 'hyphen'").select("doc_id", "line_no", "a", "b")
    cut = cut.join(uses.toDF("a", "whole"), "a", "left").join(uses.toDF("b", "compound"), "b", "left")
    cut = cut.where("coalesce(compound, 0) <= coalesce(whole, 0)").select("doc_id", "line_no", F.lit("hyphen").alias("defect"), F.col("b").alias("form"), F.col("a").alias("best"))

    wrong = forms.where("NOT supported").select("form", "best")
    wrong = maybe_broadcast(wrong, max(120, 2 * width))
    words = seen.where("kind IN ('word', 'part')").join(wrong, F.col("a") == F.col("form"))
    first = F.expr("coalesce(array_position(transform(sequence(1, length(form)), i -> substring(form, i, 1) <> substring(best, i, 1)), true), 1)")
    where = F.when((F.col("kind") == "part") & (first > F.col("b").cast("int")), F.col("l").cast("int")).otherwise(F.col("line_no"))
    misread = words.select("doc_id", where.alias("line_no"), F.lit("misread").alias("defect"), "form", "best")

    found = plain.unionByName(cut).unionByName(misread)
    if ambiguous or more:
        found = found.unionByName(_out_of_place(seen, rivals, width))
    return found.distinct()


def _out_of_place(seen: DataFrame, rivals: DataFrame, width: int) -> DataFrame:
    """Supported words, of at most width bytes, that stand where, by the words beside them, a rival of their group belongs."""
    beside = seen.where("kind IN ('left', 'right')").join(maybe_broadcast(rivals.select(F.col("form").alias("a")), max(80, width)), "a", "left_semi")
    beside = materialise(beside.groupBy("kind", "a", "b").agg(F.sum(F.col("line_no").cast("bigint")).alias("n")))
    side = maybe_broadcast(beside, max(80, 2 * width))
    pairs = rivals.select("skeleton", "form").join(rivals.select("skeleton", F.col("form").alias("best")), "skeleton").where("form <> best").select("form", "best")
    at = seen.where("kind = 'word'").join(maybe_broadcast(pairs, max(80, 2 * width)), F.col("a") == F.col("form")).select("doc_id", "line_no", "form", "best", "l", "r")
    for name, kind, word, other in (("own_l", "left", "form", "l"), ("own_r", "right", "form", "r"), ("new_l", "left", "best", "l"), ("new_r", "right", "best", "r")):
        counts = side.where(F.col("kind") == kind).select(F.col("a").alias(word), F.col("b").alias(other), F.col("n").alias(name))
        at = at.join(counts, [word, other], "left")
    own, new = F.expr("coalesce(own_l, 0) + coalesce(own_r, 0)"), F.expr("coalesce(new_l, 0) + coalesce(new_r, 0)")
    return at.where(new >= RARER * F.greatest(own, F.lit(1))).select("doc_id", "line_no", F.lit("misread").alias("defect"), "form", "best")


def repaired(docs: DataFrame, site: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, text): scanned documents as paragraphs, without headers, page numbers and site lines; other texts stay as they are.

    site has (doc_id, line_no) of site lines, which are taken out of scanned documents. doc_id must be unique. Paragraphs end at
    blank lines; the text's first line stays a line of its own.
    """
    docs = docs.select("doc_id", "text", "source")
    scanned = findings.select("doc_id").distinct()
    site = site.join(scanned, "doc_id", "left_semi").select("doc_id", "line_no", F.lit("header").alias("defect"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("string").alias("best"))
    per_line = findings.unionByName(site).groupBy("doc_id", "line_no").agg(
        F.bool_or(F.col("defect").isin("header", "page_number")).alias("gone"), F.bool_or(F.col("defect") == "hyphen").alias("joined"),
        F.map_from_entries(F.array_distinct(F.filter(F.collect_list(F.when(F.col("defect") == "misread", F.struct("form", "best"))), lambda x: x.isNotNull()))).alias("fixes"),
    )
    rows = docs.join(scanned, "doc_id", "left_semi").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("line_no", F.col("at") + 1)
    rows = rows.join(per_line, ["doc_id", "line_no"], "left").where("NOT coalesce(gone, false)")
    fixed = F.expr(r"""array_join(transform(split(trim(line), ' +'), w -> CASE WHEN fixes[regexp_replace(w, '^["“‘\'«\\[]+|[.,;:!?"”’\'»)\\]]+$', '')] IS NULL THEN w
        ELSE replace(w, regexp_replace(w, '^["“‘\'«\\[]+|[.,;:!?"”’\'»)\\]]+$', ''), fixes[regexp_replace(w, '^["“‘\'«\\[]+|[.,;:!?"”’\'»)\\]]+$', '')]) END), ' ')""")
    rows = rows.withColumn("line", F.when(F.col("fixes").isNull(), F.trim("line")).otherwise(fixed))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = rows.withColumn("paragraph", F.sum(F.when((F.col("line") == "") | (F.lag("line_no").over(order).isNull()) | (F.row_number().over(order) == 2), 1).otherwise(0)).over(order)).where("line <> ''")
    part = F.when(F.coalesce("joined", F.lit(False)), F.expr(f"regexp_replace(line, '[{HYPHENS}]$', '')")).when(F.col("line").rlike(r"\p{L}-$"), F.col("line")).otherwise(F.concat("line", F.lit(" ")))
    text = rows.withColumn("part", part).groupBy("doc_id", "paragraph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "part"))), lambda x: x["part"]), "").alias("p"))
    text = text.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", F.trim("p").alias("p")))), lambda x: x["p"]), "\n\n").alias("repaired"))
    return docs.join(text, "doc_id", "left").select("doc_id", F.coalesce("repaired", "text").alias("text"))

"""Broken pairs of question and answer: empty, refusing, copied, in another language, broken off.

Refusals are found without a list of their wordings. Of each answer's first sentence the form is taken, in which names, numbers
and the question's own words are masked. Forms are clustered by the links of all similar pairs, which are found exactly by their rarest shingles; an opening that recurs over
unrelated questions (questions that open differently, in the answer's language) declines to answer, as a real answer opens in
the way its kind of question asks for. An opening that occurs once, or for one kind of question alone, can't be told so.
The other tests look at the pair alone. Of several defects the first of this order is named: empty, refusal, copy, language,
truncated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise
from .common import arrow_map, maybe_broadcast

NOTHING = {"na", "none", "null", "nil", "nan", "nothing", "unknown", "undefined", "missing", "tbd", "tba", "empty", "blank", "not available", "not applicable", "no answer", "no value", "keine", "nichts", "rien", "aucun", "aucune", "néant", "nada", "ninguno", "ninguna", "sin datos", "لا شيء", "لا يوجد", "غير متوفر"}
WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")
SENTENCE_END = regex.compile(r"(?<=[.!?؟])\s+")
#: An end of a sentence, perhaps with closing quotes or brackets; a row of dots is none.
ENDED = regex.compile(r"(?:(?<!\.)\.|[!?؟])[\"'”’»)\]]*$")

COMMON = {
    "en": "the of and to in is that for by on with was be has not or which any an after may shall within from are at this under what who how why does did",
    "fr": "le la les des et du une un que qui dans est pour par sur pas au aux ce cette ne été avait doit selon quel quelle pourquoi l d",
    "de": "der die das und den dem ein eine einer ist nicht von zu mit für auf wird wer nach wenn hat muss des kann im weil ab welche warum innerhalb",
    "es": "el la los las de que y en un una por para no se del al con es lo ha su fue según qué quién debe cuál porque durante",
}
COMMON = {k: set(v.split()) for k, v in COMMON.items()}
#: Words of an answer below which its language isn't judged.
LEAST_WORDS = 5
INVISIBLE = regex.compile(r"\p{C}")
CUT_MARK = regex.compile(r"(?:…|\.\.+|\[\.*…*\]|\((?:see|cf\.?|siehe|voir|véase|انظر)?)$", regex.I)
#: A reference behind a complete sentence.
REFERENCE = regex.compile(r"[.!?؟]\s+\P{Ll}[^.!?؟]*[)\]]$")
TOKEN = regex.compile(r"\d[\d,.()]*|[\p{L}\p{M}'’-]+")
MASKS = ("0", "x")
#: Words that stay in an opening's form though the question has them too.
FUNCTION = frozenset().union(*COMMON.values(), ["i", "we", "me", "my", "it", "you", "this", "that", "these", "those", "cannot", "can't"])
#: Words of an opening that are compared; those of them that must be no masks.
OPENING, LEAST_PLAIN = 6, 4
#: Kinds of questions that an opening of refusal recurs over, and the share that one of them may have at most.
KINDS, TOP_SHARE = 2, 0.8
#: Words of a shingle, and the share of common shingles (of those that either has) from which two forms are linked.
SHINGLE, SIMILAR = 5, 0.8
#: Rows of shingles that a task hands on at once.
SHINGLE_ROWS = 50_000
#: Characters from which a form's shingles aren't remembered for its next pair.
LONG_FORM = 2000
FRAME = {"question", "answer", "a", "q", "pregunta", "respuesta", "réponse", "frage", "antwort", "سؤال", "السؤال", "جواب"}
#: Answers of so many words may be complete without an end mark.
SHORT = 6
UNENDED = set("the a an of to in on by for with from and or that which is was are be has have had not may shall at as if no any each its under le la les des et du de der die das und el los las y que".split())


def is_empty(text: str | None) -> bool:
    """NULL, or nothing but space, invisible characters, punctuation or a word for nothing."""
    if text is None:
        return True
    words = WORD.findall(INVISIBLE.sub("", text).casefold())
    return not words or "".join(words) in NOTHING or " ".join(words) in NOTHING


def opening_form(text: str, question: str | None) -> str:
    """The first sentence in lower case, with numbers as 0 and names and the question's content words as x."""
    asked = _masked_words(question or "")
    out: list[str] = []
    for n, w in enumerate(TOKEN.findall(SENTENCE_END.split(text.strip(), maxsplit=1)[0])):
        c = w.casefold()
        x = "0" if w[0].isdigit() else "x" if n and len(w) > 1 and w[0].isupper() or c in asked else c
        if not (x in MASKS and out and out[-1] == x):
            out.append(x)
    return " ".join(out)


def question_kind(question: str | None) -> str | None:
    """How a question opens; questions that open differently are unrelated."""
    words = TOKEN.findall(question or "")
    return " ".join(w.casefold() for w in words[:2]) if words else None


@lru_cache(1 << 14)
def _question_words(question: str) -> frozenset[str]:
    return frozenset(WORD.findall(question.casefold()))


@lru_cache(1 << 14)
def _masked_words(question: str) -> frozenset[str]:
    return frozenset(w.casefold() for w in TOKEN.findall(question)) - FUNCTION


def is_copy(question: str, text: str) -> bool:
    """Nearly all words are the question's, and nearly all of the question's are there."""
    asked = _question_words(question)
    if len(asked) < 4 or len(text) > 3 * len(question) + 100:  # a longer text has new words
        return False
    said = set(WORD.findall(text.casefold()))
    return len(said - asked - FRAME) <= 0.1 * len(asked) and len(asked - said) <= 0.2 * len(asked)


LANGUAGES: dict[str, tuple[str, ...]] = {w: tuple(k for k in COMMON if w in COMMON[k]) for w in set().union(*COMMON.values())}
ARABIC = regex.compile(r"\p{Arabic}+")
LATIN = regex.compile(r"\p{Latin}+")


@lru_cache(1 << 14)
def _language(text: str) -> tuple[int, str | None]:
    """Words of a text, and ar, en, fr, de or es; None where that can't be told."""
    words = WORD.findall(text.casefold())
    found = dict.fromkeys(COMMON, 0)
    for w in words:
        for k in LANGUAGES.get(w, ()):
            found[k] += 1
    counts = sorted(((n, k) for k, n in found.items()), reverse=True)
    if not text.isascii():
        arabic, latin = sum(map(len, ARABIC.findall(text))), sum(map(len, LATIN.findall(text)))
        if arabic > latin or arabic >= 10 and counts[0][0] < 2:  # Latin letters in Arabic text are names
            return len(words), "ar"
    return len(words), counts[0][1] if counts[0][0] >= 2 and counts[0][0] > counts[1][0] else None


def language(text: str, least: int = LEAST_WORDS) -> str | None:
    """The language of a text of at least so many words."""
    n, found = _language(text)
    return found if n >= least else None


def is_truncated(text: str) -> bool:
    """Breaks off inside a sentence or word, whether or not a mark or remnant follows."""
    text = text.rstrip()
    if CUT_MARK.search(text):
        return True
    if ENDED.search(text):
        return False
    if text.endswith((")", "]")) and text.count("(") == text.count(")"):  # a reference after complete sentences
        return not REFERENCE.search(text) and len(WORD.findall(text)) > SHORT
    words = WORD.findall(text)
    return len(words) > SHORT or text.endswith((",", ";", ":", "-", "–")) or bool(words) and len(words) > 1 and words[-1] in UNENDED


def answer_texts(answer_type: str | None, b: bool | None, n: float | None, s: str | None, arr: list[str | None] | None) -> list[str] | None:
    """The texts of an answer; none if it is empty, None if it holds a value that is no text."""
    if answer_type == "boolean":
        return [] if b is None else None
    if answer_type == "number":
        return [] if n is None or math.isnan(n) else None
    texts = [x for x in arr or [] if not is_empty(x)] if answer_type == "names" else [] if is_empty(s) else [s]
    if answer_type is None and not texts:  # no type says which field counts
        texts = [x for x in arr or [] if not is_empty(x)]
        if not texts and (b is not None or n is not None):
            return None
    return texts


def pair_defect(answer_type: str | None, question: str | None, text: str) -> str | None:
    """copy, language or truncated, or None."""
    if question and is_copy(question, text):
        return "copy"
    if question and answer_type not in ("name", "names", "date"):
        asked, said = language(question, 3), language(text)
        if asked and said and asked != said:
            return "language"
    return "truncated" if answer_type == "free_text" and is_truncated(text) else None


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for origin, key, answer_type, question, b, n, s, arr in zip(*(c.to_pylist() for c in batch.columns)):
            texts = answer_texts(answer_type, b, n, s, arr)
            if texts is None:
                continue
            if not texts:
                out.append((origin, key, "empty", None, None))
                continue
            text = " ".join(texts)
            asked, said = language(question or "", 1), language(text, 1)
            kind = question_kind(question) if not (asked and said and asked != said) else None
            out.append((origin, key, pair_defect(answer_type, question, text), opening_form(texts[0], question), kind))
        columns = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["origin", "row_key", "defect", "form", "kind"])


def shingles(form: str) -> set[str]:
    words = form.split(" ")
    return {" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


_remembered = lru_cache(1 << 14)(shingles)


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, n, shingle: every shingle of each form, and how many it has."""
    for batch in batches:
        rows: list[tuple[int, int, str]] = []
        for key, form in zip(*(c.to_pylist() for c in batch.columns)):
            found = shingles(form)
            rows += [(key, len(found), x) for x in found]
            if len(rows) >= SHINGLE_ROWS:
                yield _shingle_batch(rows)
                rows = []
        yield _shingle_batch(rows)


def _shingle_batch(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))], names=["id", "n", "shingle"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            a, b = (_remembered(f) if len(f) < LONG_FORM else shingles(f) for f in (x, y))
            keep.append(len(a & b) >= SIMILAR * len(a | b))
        yield batch.filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, keyed: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose forms are similar."""
    texts = pairs.join(keyed.toDF("a", "x"), "a").join(keyed.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return materialise(arrow_map(texts, _similar, "a bigint, b bigint, x string, y string").select("a", "b"))


def _rarest(keyed: DataFrame) -> DataFrame:
    """(shingle, id, n, at): of each form's n shingles, rarest first, as many as must hold one of any similar form's; at is the place.

    Two forms that share none of them share fewer than SIMILAR of their shingles. Shingles of one form alone take a place but link nothing.
    """
    every = materialise(arrow_map(keyed, _shingled, "id bigint, n bigint, shingle string"))
    shared = every.join(every.groupBy("shingle").agg(F.count("*").alias("uses")).where("uses > 1"), "shingle")
    own = Window.partitionBy("id")
    at = F.row_number().over(own.orderBy("uses", "shingle")) + F.col("n") - F.count("*").over(own)
    return shared.withColumn("at", at).where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * SIMILAR - 1e-9) + 1).select("shingle", "id", "n", "at")


def form_links(keyed: DataFrame) -> DataFrame:
    """(a, b) of keyed(id, form): verified pairs that link all forms which similar pairs link, though not every such pair.

    The forms of a shingle are compared with its first one; then all those pairs whose forms this hasn't linked yet.
    """
    rare = materialise(_rarest(keyed))
    first = rare.groupBy("shingle").agg(F.min("id").alias("a"))
    star = _verified(rare.join(first, "shingle").where("id <> a").select("a", F.col("id").alias("b")).distinct(), keyed)
    near = star.groupBy("b").agg(F.min("a").alias("a"))
    near = near.join(near.toDF("a", "beyond"), "a", "left").select(F.col("b").alias("id"), F.coalesce("beyond", "a").alias("label"))
    rare = materialise(rare.join(near, "id", "left").withColumn("label", F.coalesce("label", "id")))
    x, y = (rare.select("shingle", *(F.col(c).alias(f"{c}_{k}") for c in ("id", "n", "at", "label"))) for k in "xy")
    most = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y")) + 1  # common shingles, if this is the first one
    pairs = x.join(y, "shingle").where((F.col("id_x") < F.col("id_y")) & (F.col("label_x") != F.col("label_y")))
    pairs = pairs.where(most * (1 + SIMILAR) >= SIMILAR * (F.col("n_x") + F.col("n_y")) - 1e-9)
    return star.unionByName(_verified(pairs.select(F.col("id_x").alias("a"), F.col("id_y").alias("b")).distinct(), keyed))


def components(links: DataFrame) -> DataFrame:
    """(id, label): of each id in links(a, b) the least one that any chain of links leads to.

    In each round every id is taken for the least beside it, and that for the least beside it; links between what is left go on.
    """
    links = materialise(links.where("a <> b").select("a", "b").distinct())
    labels = links.select(F.col("a").alias("id")).union(links.select("b")).distinct().withColumn("label", F.col("id"))
    while not links.isEmpty():
        least = materialise(links.union(links.select("b", "a")).groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), "a").alias("to")))
        for _ in range(2):
            least = materialise(least.join(least.toDF("to", "beyond"), "to").select("id", F.col("beyond").alias("to")))
        labels = materialise(labels.join(least.toDF("label", "to"), "label", "left").select("id", F.coalesce("to", "label").alias("label")))
        ends = links.join(least.toDF("a", "c"), "a").join(least.toDF("b", "d"), "b").where("c <> d")
        links = materialise(ends.select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct())
    return labels


def form_clusters(forms: DataFrame) -> DataFrame:
    """(form, leader): of each distinct form the first one by name that a chain of similar forms leads to, or itself."""
    keyed = materialise(forms.select(F.monotonically_increasing_id().alias("id"), "form"))
    labels = keyed.join(components(form_links(keyed)), "id", "left").select("form", F.coalesce("label", "id").alias("label"))
    leaders = labels.groupBy("label").agg(F.min("form").alias("leader"))
    return labels.join(leaders, "label").select("form", "leader")


def refusal_forms(judged: DataFrame) -> DataFrame:
    """The forms of openings that recur over unrelated questions."""
    uses = materialise(judged.where("form IS NOT NULL").groupBy("form", "kind").agg(F.count("*").alias("n")))
    clusters = form_clusters(uses.select("form").distinct())
    opening = F.substring_index("leader", " ", OPENING)
    clusters = materialise(clusters.select("form", opening.alias("opening")))
    kinds = uses.where("kind IS NOT NULL").join(maybe_broadcast(clusters, 200), "form").groupBy("opening", "kind").agg(F.sum("n").alias("n"))
    spread = kinds.groupBy("opening").agg(F.count("*").alias("kinds"), (F.max("n") / F.sum("n")).alias("top"))
    plain = F.size(F.filter(F.split("opening", " "), lambda w: ~w.isin(*MASKS)))
    refusing = spread.where((F.col("kinds") >= KINDS) & (F.col("top") <= TOP_SHARE) & (plain >= LEAST_PLAIN)).select("opening")
    return clusters.join(maybe_broadcast(refusing, 100), "opening", "left_semi").select("form")


def latest(rows: DataFrame, key: str) -> DataFrame:
    """The last delivery of each key."""
    last = Window.partitionBy(key).orderBy(F.desc_nulls_last("loaded_at"))
    return rows.where(F.col(key).isNotNull()).withColumn("at", F.row_number().over(last)).where("at = 1").drop("at")


def answer_defects(references: DataFrame, results: DataFrame) -> DataFrame:
    """(origin, row_key, defect): every broken answer of either table; NULL answers are none.

    Of rows delivered more than once the latest counts; rows without a key have no result; a question that is missing or NULL
    leaves the tests that need none; empty tables give no rows; other columns are ignored.
    """
    answer = ["answer_type", "question", "answer.b", "answer.n", "answer.s", "answer.arr"]
    asked = latest(references, "question_id")
    own = asked.where("answer IS NOT NULL").select(F.lit("reference").alias("origin"), F.col("question_id").alias("row_key"), *answer)
    given = latest(results, "result_id").where("answer IS NOT NULL").select("result_id", "question_id", "answer")
    given = given.join(maybe_broadcast(asked.select("question_id", "answer_type", "question"), 400), "question_id", "left")
    given = given.select(F.lit("result").alias("origin"), F.col("result_id").cast("string").alias("row_key"), *answer)
    judged = materialise(arrow_map(own.unionByName(given), _judged, "origin string, row_key string, defect string, form string, kind string"))
    refusing = refusal_forms(judged).withColumn("refusal", F.lit("refusal"))
    found = judged.join(maybe_broadcast(refusing, 200), "form", "left").select("origin", "row_key", F.coalesce("refusal", "defect").alias("defect"))
    return found.where("defect IS NOT NULL").distinct()

"""Text functions as Column builders; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STOPWORDS = ["a", "an", "and", "are", "do", "does", "for", "how", "in", "is", "of", "on", "or", "the", "to", "what", "when", "who"]
RERANK_STOPWORDS = ["a", "an", "and", "are", "for", "how", "in", "is", "of", "or", "the", "to", "what", "which", "who"]
LEGAL_MARKERS = ["article", "section", "clause", "law", "court", "judgment", "order", "decision", "regulation"]
COURT_MARKERS = ["COURT OF", "SCT", "ARBITRATION", "DIGITAL ECONOMY COURT", "TECHNOLOGY AND CONSTRUCTION DIVISION", "ENFORCEMENT", "JUDGMENT", "JUDGMENTS"]
ENTITY = r"\b[A-Z][A-Za-z0-9&/-]{2,}\b"
DATE = r"\b(?:\d{1,2}\s+[A-Z][a-z]+\s+\d{4}|[A-Z][a-z]+\s+\d{1,2},\s+\d{4}|\d{4}-\d{2}-\d{2})\b"
CASE_NUMBER = r"\bcase\s*(?:no\.?|number)?\s*(\d{1,4}\s*/\s*\d{2,4})\b"
COURT_REFERENCE = r"\b(?:CFI|SCT|ARB|DEC|TCD|ENF|CA)\s*(\d{1,4}\s*/\s*\d{2,4})\b"
STATUTE = r"\b((?:[A-Z]{2,}\s+)?[A-Za-z]+(?:\s+[A-Za-z]+){0,3}\s+Law)\b"
TITLE_CUE = r"\b([A-Z][A-Za-z0-9'&/-]*(?:\s+[A-Z][A-Za-z0-9'&/-]*)*\s+(?:Agreement|Contract|Deed|Order|Policy|Protocol|Arrangement|Lease))\b"
MULTI_DOCUMENT = r"\b(across|between|both|related\s+matters?|related\s+cases?|multiple|versus|vs\.?)\b"
COVERAGE = r"\b(?:across|between|both|all\s+documents?|every\s+document|full\s+case\s+files?|each\s+document)\b"
TITLE_PAGE = r"\b(?:title|cover)\s+page\b"
ISSUE_DATE = r"\b(?:date\s+of\s+issue|issue\s+date)\b"
LAW_NUMBER = r"\b(?:official\s+)?(?:difc\s+)?law\s+(?:no\.?|number)\b"
MULTI_LAW = r"\b(?:which\s+specific|which)\s+.*\blaws?\b.*\bamend(?:ed|s|ing)\b"
COMPARATIVE_HINTS = [" both ", " same ", " common ", " compare ", " across ", " between "]
NEGATIVE_HINTS = [" is there any ", " are there any ", " no information ", " not present ", " absent "]
OUTCOMES = {
    "dismiss": r"\bdismiss(?:ed|es|ing)?\b", "grant": r"\bgrant(?:ed|s|ing)?\b", "deny": r"\bden(?:y|ied|ies|ying)\b", "allow": r"\ballow(?:ed|s|ing)?\b",
    "prohibit": r"\bprohibit(?:ed|s|ing)?\b", "terminate": r"\bterminat(?:e|ed|es|ing)\b", "order": r"\border(?:ed|s|ing)?\b",
    "pay": r"\bpay(?:able|ment|ments|ing|s)?\b", "liable": r"\bliab(?:ility|le)\b",
}
CLAUSE_CUES = r"\b(?:because|since|due to|as|therefore|thus|but)\b|[;:]"
COMMANDS = {"comma": ",", "period": ".", "colon": ":", "hyphen": "-", "space": " "}


def ci(pattern: str) -> str:
    return "(?i)" + pattern


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def ordered_unique(values: Column) -> Column:
    """Without empty and NULL values, the first of equal ones kept."""
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != "")))


def tokens(text: Column) -> Column:
    return all_matches(F.lower(text), "[a-z0-9]+")


def token_estimate(text: Column) -> Column:
    return F.size(all_matches(text, "[A-Za-z0-9]+"))


def entities(text: Column, limit: int = 8) -> Column:
    return F.slice(ordered_unique(all_matches(text, ENTITY)), 1, limit)


def date_strings(text: Column, limit: int = 6) -> Column:
    return F.slice(ordered_unique(all_matches(text, DATE)), 1, limit)


def keywords(text: Column) -> Column:
    """Distinct tokens of more than one character that aren't stop words, sorted."""
    return F.array_sort(F.array_distinct(F.filter(tokens(text), lambda x: (F.length(x) > 1) & ~x.isin(STOPWORDS))))


def rerank_words(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(tokens(text), lambda x: ~x.isin(RERANK_STOPWORDS))))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalised(text: Column) -> Column:
    return F.lower(squeezed(text))


def signal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")


def grounding_clauses(text: Column) -> Column:
    parts = F.split(squeezed(text), ci(CLAUSE_CUES))
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, "^[ ,.]+|[ ,.]+$", "")), lambda x: x != "")


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def lexical_score(query: Column, candidate: Column, retrieval: Column) -> Column:
    """0.7 of the share of the query's words that the candidate has, and 0.3 of the retrieval score."""
    share = F.when(F.size(query) > 0, overlap(query, candidate) / F.size(query)).otherwise(0.0)
    return 0.7 * share + 0.3 * retrieval


def legal_marker_count(text: Column) -> Column:
    return sum((F.when(F.lower(text).contains(m), 1).otherwise(0) for m in LEGAL_MARKERS), F.lit(0))


def bad_char_ratio(text: Column, empty: float = 0.0) -> Column:
    """Share of replacement and control characters; `empty` for no text."""
    clean = F.regexp_replace(text, r"[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return F.when(F.length(text) > 0, (F.length(text) - F.length(clean)) / F.length(text)).otherwise(empty)


def document_family(text: Column) -> Column:
    head = F.upper(F.array_join(F.transform(F.slice(F.split(text, r"\r?\n"), 1, 4), lambda x: F.trim(x)), " "))
    court = F.lit(False)
    for m in COURT_MARKERS:
        court = court | head.contains(m)
    law = head.contains("LAW NO.") | head.contains("DIFC LAW") | head.endswith(" LAW")
    return F.when(law, "law_or_regulation").when(court, "court_or_arbitration_decision").otherwise("other_legal_document")


def first_line(text: Column) -> Column:
    return F.try_element_at(F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(1))


def glyph_cleanup(text: Column) -> Column:
    out = F.regexp_replace(text, "glyph<[^>]*>", "")
    for name, mark in COMMANDS.items():
        out = F.regexp_replace(out, rf"/{name}(?![a-z])(?:\.[a-z]+)*", mark)
    return squeezed(F.regexp_replace(out, r"/[a-z]+(?:\.[a-z]+)*", ""))


def verbose_name(text: Column) -> Column:
    """A name without what explains it: a leading case or claim number, else what stands before the first of the cuts."""
    x = squeezed(text)
    case = F.regexp_extract(x, ci(r"^((?:CFI|SCT|ARB|DEC|TCD|ENF|CA)\s*\d{1,4}\s*/\s*\d{2,4})\b"), 1)
    claim = F.regexp_extract(x, ci(r"^(Claim\s+No\.?\s*[A-Z0-9/_-]+(?:\s*/\s*\d+)?)\b"), 1)
    cut = x
    for sep in reversed((" has ", " is ", " was ", " (", " — ")):
        before = F.trim(F.substring_index(x, sep, 1))
        cut = F.when((F.instr(x, sep) > 1) & (F.length(before) >= 3), before).otherwise(cut)
    return F.when(case != "", case).when(claim != "", claim).otherwise(cut)


def outcome_flags(text: Column) -> Column:
    """The outcomes that a text names, sorted."""
    low = F.lower(text)
    return F.filter(F.array(*[F.when(low.rlike(p), F.lit(k)) for k, p in sorted(OUTCOMES.items())]), lambda x: x.isNotNull())


def iso_dates(text: Column) -> Column:
    """Valid dates of a text as yyyy-MM-dd, sorted and distinct."""
    months = "january|february|march|april|may|june|july|august|september|october|november|december"
    day_first = F.transform(all_matches(text, ci(rf"\b\d{{1,2}}\s+(?:{months})\s+\d{{4}}\b")), lambda x: F.try_to_date(F.initcap(squeezed(x)), "d MMMM yyyy"))
    month_first = F.transform(all_matches(text, ci(rf"\b(?:{months})\s+\d{{1,2}}(?:,\s*|\s+)\d{{4}}\b")), lambda x: F.try_to_date(F.initcap(squeezed(F.regexp_replace(x, ",", " "))), "MMMM d yyyy"))
    iso = F.transform(all_matches(text, r"\b\d{4}-\d{2}-\d{2}\b"), lambda x: F.try_to_date(x, "yyyy-MM-dd"))
    found = F.filter(F.concat(day_first, month_first, iso), lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.date_format(x, "yyyy-MM-dd"))))


def case_numbers(question: Column) -> Column:
    """Distinct case numbers without white space: those after the word case first, then those after a court's letters."""
    found = F.concat(all_matches(question, ci(CASE_NUMBER), 1), all_matches(question, ci(COURT_REFERENCE), 1))
    return ordered_unique(F.transform(found, lambda x: F.regexp_replace(x, r"\s+", "")))


def statutes(question: Column) -> Column:
    found = F.transform(all_matches(question, STATUTE, 1), lambda x: F.lower(F.regexp_replace(squeezed(x), ci(r"^(?:which|what|under|the)\s+"), "")))
    return ordered_unique(found)


def title_cues(question: Column) -> Column:
    return ordered_unique(F.transform(all_matches(question, TITLE_CUE, 1), squeezed))


def likely_multi_document(question: Column) -> Column:
    low = normalised(question)
    ands = (F.length(low) - F.length(F.regexp_replace(low, " and ", ""))) / 5
    return (F.size(case_numbers(question)) >= 2) | low.rlike(MULTI_DOCUMENT) | (ands >= 2)


def question_class(question: Column) -> Column:
    return F.when(likely_multi_document(question), "cross_case").when(F.size(case_numbers(question)) > 0, "case").when(F.size(statutes(question)) > 0, "statute").otherwise("free_text")


def query_expansions(question: Column, limit: int = 3) -> Column:
    """At most `limit` further wordings: each case and law with and without its word, then title cues; none equals the question."""
    cases = F.flatten(F.transform(case_numbers(question), lambda x: F.array(x, F.concat(F.lit("case "), x))))
    laws = F.flatten(F.transform(statutes(question), lambda x: F.array(x, F.concat(F.lit("law "), x))))
    every = ordered_unique(F.transform(F.concat(cases, laws, title_cues(question)), F.lower))
    return F.slice(F.filter(every, lambda x: x != F.lower(F.trim(question))), 1, limit)


def structural_bucket(question: Column, answer_type: Column) -> Column:
    padded = F.concat(F.lit(" "), F.lower(F.trim(question)), F.lit(" "))

    def has(hints: list[str]) -> Column:
        out = F.lit(False)
        for h in hints:
            out = out | padded.contains(h)
        return out

    cases = F.size(all_matches(question, r"\b[A-Z]{2,4}\s?\d{1,3}/\d{4}\b"))
    return F.when((cases >= 2) | has(COMPARATIVE_HINTS), "comparative_multi_document").when(has(NEGATIVE_HINTS), "negative_unanswerable").when(answer_type == "free_text", "free_text").otherwise("standard")


def title_law_number(question: Column) -> Column:
    """Whether a question asks for a law's number on a title page."""
    return question.rlike(ci(TITLE_PAGE)) & question.rlike(ci(LAW_NUMBER))


def needs_coverage(question: Column, kind: Column) -> Column:
    return F.when(kind.isin("case", "cross_case"), question.rlike(ci(COVERAGE))).when(kind == "statute", question.rlike(ci(MULTI_LAW))).otherwise(False)


def numbers(text: Column) -> Column:
    """Numbers in digits in their order, without thousands separators; digits inside words are none."""
    return F.transform(all_matches(text, r"(?:^|[^\w.,])([-+]?\d[\d,]*(?:\.\d+)?)", 1), lambda x: F.replace(x, F.lit(","), F.lit("")))

"""Text rules of the regulatory front end as column expressions.

Patterns are Java regular expressions.  The word lists and patterns below are fixed values that results depend on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
OBLIGATION = r"(?i)\b(shall|must|may|should|have to|required to|obligated to)\b"
FILLERS = ["without undue delay", "inter alia", "for example:?", "as appropriate", "by means of implementing acts", "in particular"]
ARTICLE_HEAD = r"(?im)^Article\s+\d+\s*\n+[^\n]+"
ALT_ARTICLE_HEAD = r"(?im)^Art\.\s+\d+(?:\s+[A-Z]+)?\.?\s+[^\n]+"
SECTION_HEAD = r"(?im)^\d+(?:\.\d+)*\.\s+([^\n]+)"
NUMBERED_PARAGRAPH = r"(?m)^\d{1,2}\.\s+(?=[A-Z])"
PARAGRAPH_STARTERS = ["the", "a", "an", "this", "these", "that", "those", "it", "they", "each", "any", "all", "no", "in", "for", "where", "if", "unless", "member"]
INTERNAL_REFERENCE = r"(?i)\b(?:paragraph|subparagraph|article|section|annex|indent|point|sub-paragraph|recital|schedule|appendix)\s+(?:\d+|[IVXLCDM]{1,10})(?:\s*\(\s*\d+\s*\))?(?:\s*,\s*point\s+\d+)?"
ACT_TYPES = ["Directive", "Regulation", "Decision", "Implementing Regulation", "Delegated Regulation", "Implementing Decision", "Delegated Decision"]
UNIT_SUFFIXES = ["authority", "agency", "commission", "council", "parliament", "board", "committee", "body", "office", "bureau", "directorate", "administration", "ministry", "department", "court", "tribunal"]
ROLE_SUFFIXES = ["officer", "manager", "director", "inspector", "auditor", "controller", "supervisor", "provider", "operator", "applicant", "representative", "holder", "user", "administrator", "assessor"]
DETERMINERS = ["the", "a", "an", "any", "each", "every", "all", "such", "those", "these", "this", "that", "their", "its"]
CONDITIONAL_OPENERS = ["if", "unless", "provided", "subject", "except", "where", "notwithstanding", "when", "before", "after", "until", "once", "while", "whenever", "although", "though", "even", "because", "since"]
DEONTIC_TYPES = [
    ("shall not", "prohibition"),
    ("must not", "prohibition"),
    ("may not", "prohibition"),
    ("should not", "recommendation"),
    ("is required to", "obligation"),
    ("are required to", "obligation"),
    ("shall", "obligation"),
    ("must", "obligation"),
    ("should", "recommendation"),
    ("may", "permission"),
]
DEONTIC_STYLES = {
    "obligation": ("deontic-obligation", "shall"),
    "permission": ("deontic-permission", "may"),
    "prohibition": ("deontic-prohibition", "shall not"),
    "recommendation": ("deontic-recommendation", "should"),
}
LABEL_NOISE = r"(?i)^\s*\d+(?:\([a-z]\))?\s+|^\s*(?:however|notwithstanding|therefore|furthermore|moreover)\s*,?\s*"
DANGLING = r"(?i)(?:\s*,|\s+(?:and|or|with|to|of|for|by|in|on|at|from|pursuant|under|as|via|per)\b)+\s*\."
XOR_WORDS = [r"(?i)\bif\b", r"(?i)\bunless\b", r"(?i)\bwhether\b", r"\bOR\b", r"(?i)\botherwise\b"]
AND_WORDS = [r"(?i)\bin parallel\b", r"(?i)\bsimultaneously\b", r"(?i)\bactivities occur in parallel\b", r"(?i)\bactivities? in parallel\b"]
#: The first leaves single blanks alone, so most texts are not written again.
SPACING = [(r"[ \t]{2,}|\t", " "), (r"\n{3,}", "\n\n"), (r"\(\s+", "("), (r"\s+\)", ")"), (r"(?m)^[\s,;:.]+(?=[A-Za-z])", "")]
SECTION_MATCHES, HEADING_WORDS = 3, 10


def obliges(text: Column) -> Column:
    return text.rlike(OBLIGATION)


def drop_fillers(text: Column) -> Column:
    """Only texts that hold one of the phrases are searched by the patterns."""
    out = text
    for f in FILLERS:
        out = F.regexp_replace(out, rf"(?i),?\s*{f},?\s*", " ")
    held = F.lit(False)
    for f in FILLERS:
        held = held | F.contains(F.lower(text), F.lit(f.removesuffix(":?")))
    return F.when(held, out).otherwise(text)


def shorten_accordance(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)\bin accordance with\b", "IAW")


def mark_condition(text: Column) -> Column:
    return F.regexp_replace(text, r"^(?:Where|If)\b", "IF")


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalize_spaces(text: Column) -> Column:
    """Single blanks, two line ends at most, no blank inside brackets, no mark before the first letter of a line."""
    for pattern, to in SPACING:
        text = F.regexp_replace(text, pattern, to)
    return trim_all(text)


def drop_dangling(text: Column) -> Column:
    """Prepositions, conjunctions and commas before a full stop, as many as there are, and the space before it."""
    return F.regexp_replace(F.regexp_replace(text, DANGLING, "."), r"\s+\.", ".")


def structure(text: Column) -> Column:
    """standard_article, alt_article, section, paragraph_body or raw: the first rule that holds."""
    heads = F.regexp_extract_all(text, F.lit(SECTION_HEAD), F.lit(1))
    starters = F.array(*[F.lit(w) for w in PARAGRAPH_STARTERS])

    def heading(h):
        words = F.filter(F.split(trim_all(h), r"\s+"), lambda w: w != "")
        return F.size(words).between(1, HEADING_WORDS) & ~F.array_contains(starters, F.lower(F.get(words, 0))) & ~h.rlike(OBLIGATION) & trim_all(h).rlike(r"^\p{Lu}")

    return (
        F.when(text.rlike(ARTICLE_HEAD), "standard_article")
        .when(text.rlike(ALT_ARTICLE_HEAD), "alt_article")
        .when(F.size(F.filter(heads, heading)) >= SECTION_MATCHES, "section")
        .when(F.regexp_count(text, F.lit(NUMBERED_PARAGRAPH)) >= SECTION_MATCHES, "paragraph_body")
        .otherwise("raw")
    )


def internal_references(text: Column) -> Column:
    """What the pattern of internal references finds, without case (``references`` has the token rules)."""
    return F.transform(F.regexp_extract_all(text, F.lit(INTERNAL_REFERENCE), F.lit(0)), lambda r: F.regexp_replace(r, r"\s+", " "))


def article_numbers(text: Column) -> Column:
    """Numbers of articles that a text refers to, lists such as ``Articles 5, 6 and 8`` included."""
    lists = F.regexp_extract_all(text, F.lit(r"(?i)\bArticles?\s+(\d+(?:\(\d+\))?(?:\s*,\s*\d+(?:\(\d+\))?)*(?:\s*and\s*\d+(?:\(\d+\))?)?)"), F.lit(1))
    return F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(x, F.lit(r"\d+(?:\(\d+\))?"), F.lit(0))))


def external_articles(numbers: Column, existing: Column) -> Column:
    """Referred numbers that the document lacks; a document without numbers takes all as external."""
    return F.when(F.size(existing) == 0, numbers).otherwise(F.filter(numbers, lambda n: ~F.array_contains(existing, n)))


def deontic_type(modal: Column) -> Column:
    out = None
    for words, kind in DEONTIC_TYPES:
        out = (F.when if out is None else out.when)(F.lower(modal) == words, kind)
    return out.otherwise("obligation")


def deontic_style(kind: Column) -> Column:
    out = None
    for name, (style, _) in DEONTIC_STYLES.items():
        out = (F.when if out is None else out.when)(kind == name, style)
    return out.otherwise("")


def deontic_badge(kind: Column, modality: Column) -> Column:
    out = None
    for name, (_, badge) in DEONTIC_STYLES.items():
        out = (F.when if out is None else out.when)(kind == name, badge)
    return out.otherwise(modality)


def clean_label(label: Column) -> Column:
    return trim_all(F.regexp_replace(label, LABEL_NOISE, ""))


def strip_determiner(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(trim_all(name), rf"(?i)^(?:{'|'.join(DETERMINERS)})\s+", ""), r"\s+", " ")


def infer_type(name: Column) -> Column:
    """ROLE by its suffix, else UNIT by its suffix, else UNIT."""
    return F.when(F.lower(name).rlike(f"({'|'.join(ROLE_SUFFIXES)})$"), "ROLE").otherwise("UNIT")


def opens_condition(text: Column) -> Column:
    return F.lower(F.regexp_extract(text, r"^\W*(\w+)", 1)).isin(CONDITIONAL_OPENERS)


def word_count(pattern_list: list[str], text: Column) -> Column:
    total = F.lit(0)
    for p in pattern_list:
        total = total + F.regexp_count(text, F.lit(p))
    return total

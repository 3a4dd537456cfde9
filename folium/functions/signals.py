"""Signals in instructions, passages and translations: directives, cue words, choices, term presence, role phrases."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Keywords that must all be there, the machine rule they stand for and its directive, the first one wins.
MACHINE_RULES = (
    (("arial",), "font_family", "formatting"),
    (("header", "footer"), "preserve_headers_footers", "prohibition"),
    (("add", "chapter", "do not"), "allow_new_h1", "prohibition"),
    (("table of content",), "toc_auto_generated", "prohibition"),
    (("toc",), "toc_auto_generated", "prohibition"),
    (("blue text", "delete"), "strip_blue_text", "requirement"),
    (("initial page",), "skip_cover_page", "prohibition"),
    (("cover page",), "skip_cover_page", "prohibition"),
)
# Markers of directives, and placeholders.
PROHIBITION = ("do not", "don't", "must not", "cannot", "can not", "is not possible", "not allowed", "never", "avoid ")
ICONS = ("infographic", "icon")
FORMATTING = ("font", "arial", "header", "footer", "table of content", "toc", "style", "numbering", "page break", "formatting", "bold", "italic")
REQUIREMENT = ("must ", "shall ", "ensure", "required", "delete", "insert ", "make sure")
PLACEHOLDER = r"(?i)\$\{[^}]+\}|<<[^>]+>>|\[Insert\s+[^\]]+\]|\[Role\s*\d+\]|\bn\.0\b"
# How a section says that it is optional, and that it takes no subsections.
OPTIONAL = ("delete this section", "delete this chapter", "remove this section", "section is optional", "chapter is optional")
NO_SUBSECTIONS = ("do not add sub", "no subsection", "no sub-chapter", "subchapters are not", "sub-chapters are not")


def holds_any(text: Column, markers: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for marker in markers:
        out = out | text.contains(marker)
    return out


def directive(text: Column, lead_in: Column) -> Column:
    """Struct (directive, rule) of an instruction; a list's lead-in counts with it, but not for placeholders."""
    low = F.lower(F.concat_ws(" ", lead_in, text))
    rule = None
    for keywords, name, kind in MACHINE_RULES:
        hit = low.contains(keywords[0])
        for keyword in keywords[1:]:
            hit = hit & low.contains(keyword)
        found = F.struct(F.lit(kind).alias("directive"), F.lit(name).alias("rule"))
        rule = F.when(hit, found) if rule is None else rule.when(hit, found)
    plain = (
        F.when(holds_any(low, PROHIBITION), "prohibition").when(holds_any(low, ICONS), "icon_usage")
        .when(text.rlike(PLACEHOLDER), "placeholder_hint").when(holds_any(low, FORMATTING), "formatting")
        .when(holds_any(low, REQUIREMENT), "requirement").otherwise("guidance")
    )
    return F.coalesce(rule, F.struct(plain.alias("directive"), F.lit(None).cast("string").alias("rule")))


def cue_hits(text: Column, cue: Column) -> Column:
    """Distinct cue words, case aside."""
    return F.size(F.array_distinct(F.regexp_extract_all(F.lower(text), cue, F.lit(0))))


def letters(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def answered_option(lead_in: Column, region: Column) -> Column:
    """The slash option of a region that a short lead-in with a colon uses; '' if none, null if it does not answer the region."""
    answers = lead_in.endswith(":") & (F.length(lead_in) <= 80) & (F.size(letters(lead_in)) > 0)
    answers = answers & (F.size(F.array_except(letters(lead_in), letters(region))) == 0)
    group = F.regexp_extract(region, r"[\w ]+(?:/[\w ]+)+", 0)
    options = F.transform(F.split(group, "/"), lambda o: F.element_at(F.split(F.trim(o), " +"), -1))
    used = F.filter(options, lambda o: F.array_contains(letters(lead_in), F.lower(o)))
    return F.when(answers, F.coalesce(F.get(used, F.lit(0)), F.lit("")))


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """Compatibility form without case and accents; Spark has no function for the normal forms."""

    def fold(x: str) -> str:
        bare = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", x).casefold())
        return unicodedata.normalize("NFC", "".join(c for c in bare if not unicodedata.combining(c)))

    return text.map(fold, na_action="ignore")


def inflected(term: Column) -> Column:
    """Pattern of a folded term as whole words; the last word may change its ending: the last letter (two from seven
    letters on) may differ and up to four may follow, short words take up to two more."""
    quoted = F.transform(F.split(F.trim(term), r"\s+"), lambda w: F.regexp_replace(w, r"([^\w\s])", r"\\$1"))
    last = F.element_at(F.split(F.trim(term), r"\s+"), -1)
    ends = last.rlike(r"(?U)\p{Alpha}$")
    cut = F.when(F.length(last) >= 7, 2).otherwise(1)
    stem = F.regexp_replace(F.substr(last, F.lit(1), F.length(last) - cut), r"([^\w\s])", r"\\$1")
    tail = F.when(~ends, F.element_at(quoted, -1)).when(F.length(last) <= 4, F.concat(F.element_at(quoted, -1), F.lit(r"\w{0,2}"))).otherwise(F.concat(stem, F.lit(r"\w{0,4}")))
    before = F.slice(quoted, 1, F.size(quoted) - 1)
    return F.concat(F.lit(r"(?U)(?<!\w)"), F.array_join(F.concat(before, F.array(tail)), r"\s+"), F.lit(r"(?!\w)"))


def term_present(translation: Column, term: Column, east_asian: Column) -> Column:
    """Whether a translation uses a term: inflected whole words, or in East Asian scripts the letters without spaces."""
    squash = lambda c: F.regexp_replace(c, r"\s+", "")
    words = F.rlike(folded(translation), inflected(folded(term)))
    return F.when(east_asian, F.contains(squash(F.lower(translation)), squash(F.lower(term)))).otherwise(words)


def served_paths(json: Column, document_id: Column) -> Column:
    """JSON text whose image_path, icon_path and path values become URLs of the document's assets, at any depth."""
    pattern = r'"(image_path|icon_path|path)"(\s*:\s*)"(?:[^"\\]*/)?([^"/\\]+)"'
    return F.regexp_replace(json, F.lit(pattern), F.concat(F.lit('"$1"$2"/documents/'), document_id, F.lit('/assets/$3"')))


# Words that head a role phrase, and words that may stand before one without being part of it.
ROLE_HEADS = (
    "Owner|Manager|Head|Lead|Leader|Officer|Coordinator|Approver|Reviewer|Author|Representative|Expert|Administrator|Specialist|Supervisor|Director|Auditor|Inspector|Operator|Analyst|Designee|Sponsor|Steward"
    "|Engineer|Scientist|Technician|Person|Committee|Board|Team|Department|User|Developer|Initiator|Assessor|Signatory|Requester|Requestor|Responsible|Approvers|Reviewers|Owners|Managers|Users"
)
ROLE_NOISE = "the|a|an|each|every|all|any|if|when|only|this|that|these|those|our|your|their|its|his|her|for|by|to|and|or"
# grammar, over text with single spaces: "Head of" and titles, or titles and a head word that no title follows
TITLE = r"[A-Z][\w&/-]*"
ROLE = "|".join((rf"\bHead of(?: {TITLE})+", rf"\b(?:{TITLE} )*(?:{ROLE_HEADS})\b(?! {TITLE})"))


def roles(text: Column) -> Column:
    """Distinct role phrases of a text, sorted; a role that only stands within longer ones is left out."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    bare = F.transform(F.regexp_extract_all(plain, F.lit(ROLE), F.lit(0)), lambda r: F.regexp_replace(r, rf"^(?i:(?:{ROLE_NOISE}) )+", ""))
    found = F.array_distinct(F.filter(bare, lambda r: (r != "") & (F.size(F.split(r, " ")) <= 6)))

    def alone(role: Column) -> Column:
        longer = F.filter(found, lambda r: F.length(r) > F.length(role))
        rest = F.aggregate(longer, plain, lambda t, r: F.replace(t, r, F.lit("|")))
        return F.contains(rest, role)

    return F.array_sort(F.filter(found, alone))

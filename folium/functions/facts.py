"""Protected facts in text: values in canonical form, obligations, abbreviations, quoted names, risk tags.

Kinds claim their places in a fixed order; what one has claimed is blanked before the next looks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# Number words, units, months.
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
TIME_UNITS = "(second|minute|hour|day|week|month|year)s?"
NUM = "([0-9]+(?:[.,][0-9]+)*|" + "|".join(NUMBER_WORDS) + ")"
_CLAIMS = (
    ("reference", "stfa", r"\b(?:section|table|figure|step|appendix) [0-9]+(?:\.[0-9]+)*(?: and (?:section|table|figure|step|appendix) [0-9]+(?:\.[0-9]+)*)?"),
    ("date", "0-9", r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b|\b[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}\b|\b[0-9]{1,2} (?:" + "|".join(MONTHS) + r") [0-9]{4}\b"),
    ("frequency", "ote", rf"\b(?:once|twice|thrice) (?:a|per|every) {TIME_UNITS.replace('(', '(?:')}\b|\bevery (?:{NUM[1:-1]}) {TIME_UNITS.replace('(', '(?:')}\b"),
    ("deadline", "w", rf"\bwithin (?:{NUM[1:-1]}) (?:working |business |calendar )?{TIME_UNITS.replace('(', '(?:')}\b"),
    ("duration", "0-9otfsen", rf"\b(?:{NUM[1:-1]}) (?:working |business |calendar )?{TIME_UNITS.replace('(', '(?:')}\b"),
    ("percentage", "a0-9", r"(?:at least |at most )?[0-9]+(?:[.,][0-9]+)? ?%"),
    ("number", "0-9", r"\b[0-9]+(?:[.,][0-9]+)*(?: (?:mg|g|kg|ml|l|mm|cm|m))?\b"),
)
#: kind and pattern; a look at the first character spares the pattern at most places
CLAIMS = tuple((kind, f"(?=[{first}])(?:{pattern})") for kind, first, pattern in _CLAIMS)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often it stands there: array functions are not compiled, so nothing else shares it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def number(text: Column) -> Column:
    """Digits without separators of thousands and trailing zeros, or a number word, as a canonical string."""
    word = lambda t: F.array_position(F.array(*[F.lit(w) for w in NUMBER_WORDS]), t)
    plain = lambda t: F.regexp_replace(F.regexp_replace(t, ",(?=[0-9]{3}(?:[^0-9]|$))", ""), ",", ".")
    trimmed = lambda p: F.when(p.contains("."), F.regexp_replace(p, r"\.?0+$", "")).otherwise(p)
    return _once(text, lambda t: F.when(word(t) > 0, word(t).cast("string")).otherwise(_once(plain(t), trimmed)))


def unit(text: Column) -> Column:
    """Singular time unit; working and business days are one unit."""
    base = F.regexp_replace(text, "s$", "")
    return F.regexp_replace(F.regexp_replace(base, "^(working|business) ", "business_"), "^calendar ", "calendar_")


def canonical(kind: Column, raw: Column) -> Column:
    """Canonical text of a claimed value."""
    n = number(F.regexp_extract(raw, f"({NUM[1:-1]})", 1))
    tail = unit(F.regexp_extract(raw, r"((?:working |business |calendar )?(?:second|minute|hour|day|week|month|year)s?)$", 1))
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.regexp_extract(raw, "([a-z]+)", 1)).cast("string")
    part = lambda p, i: F.lpad(F.regexp_extract(raw, p, i), 2, "0")
    dotted, spelled = r"^([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})$", r"^([0-9]{1,2}) [a-z]+ ([0-9]{4})$"
    date = (
        F.when(raw.rlike(dotted), F.concat_ws("-", F.regexp_extract(raw, dotted, 3), part(dotted, 2), part(dotted, 1)))
        .when(raw.rlike(spelled), F.concat_ws("-", F.regexp_extract(raw, spelled, 2), F.lpad(month, 2, "0"), part(spelled, 1))).otherwise(raw)
    )
    times = F.when(raw.startswith("once"), "1").when(raw.startswith("twice"), "2").when(raw.startswith("thrice"), "3")
    each = _once(F.concat(n, F.lit(" "), tail), lambda every: F.when(every == "12 month", "1/1 year").otherwise(F.concat(F.lit("1/"), every)))
    percent = F.concat(F.when(raw.startswith("at least"), ">=").when(raw.startswith("at most"), "<=").otherwise(""), n, F.lit("%"))
    measure = F.regexp_extract(raw, r" ([a-z]+)$", 1)
    return (
        F.when(kind == "date", date)
        .when(kind == "frequency", F.when(times.isNotNull(), F.concat(times, F.lit("/1 "), tail)).otherwise(each))
        .when(kind == "deadline", F.concat(F.lit("<="), n, F.lit(" "), tail)).when(kind == "duration", F.concat(n, F.lit(" "), tail))
        .when(kind == "percentage", percent).when(kind == "number", F.trim(F.concat(n, F.lit(" "), measure))).otherwise(raw)
    )


def values(text: Column | str) -> Column:
    """array<struct<kind, raw>> of the values of a text; references claim their places but are not values."""
    rest, found = F.lower(text), []
    for kind, pattern in CLAIMS:
        hits = F.regexp_extract_all(rest, F.lit(f"({pattern})"), F.lit(1))
        if kind != "reference":
            found.append(_tagged(hits, kind))
        rest = F.regexp_replace(rest, pattern, " ¤ ")
    return F.concat(*found)


def with_values(rows: DataFrame, text_col: str, out: str) -> DataFrame:
    """rows and `out`, the values() of a text. What earlier kinds leave of it is a column of its own, so it is computed once and not by each later kind."""
    given, found = rows.columns, []
    rows = rows.withColumn("_rest", F.lower(text_col))
    for k, (kind, pattern) in enumerate(CLAIMS):
        hits, rest = F.regexp_extract_all("_rest", F.lit(f"({pattern})"), F.lit(1)), F.regexp_replace("_rest", pattern, " ¤ ")
        if kind != "reference":
            found.append(_tagged(F.col(f"_hits{k}"), kind))
        rows = rows.withColumns({f"_hits{k}": hits, "_rest": rest})
    return rows.select(*given, F.concat(*found).alias(out))


def _tagged(hits: Column, kind: str) -> Column:
    return F.transform(hits, lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("raw")))


MODALITIES = (
    ("prohibition", r"\b(must|shall|should|may|can) not\b|\bmust never\b|\bnever\b|\bis prohibited\b"),
    ("obligation", r"\b(must|shall)\b|\bis required to\b|\bare required to\b|\bhas to\b|\bhave to\b"),
    ("recommendation", r"\b(should|ought to)\b|\bis recommended\b"),
    ("permission", r"\bmay\b|\bis allowed to\b|\bare allowed to\b"),
    ("capability", r"\bcan\b|\bis able to\b"),
)
MODAL_EXCLUSIONS = r"\bmay [0-9]{1,4}\b|\bas may be\b|\bif (?:must|shall)\b"


def modalities(sentence: Column | str) -> Column:
    """Modalities of a sentence; each pattern claims its places before the next looks."""
    rest, found = F.regexp_replace(F.lower(sentence), MODAL_EXCLUSIONS, " "), []
    for kind, pattern in MODALITIES:
        found.append(F.when(rest.rlike(pattern), F.lit(kind)))
        rest = F.regexp_replace(rest, pattern, " ")
    return F.array_compact(F.array(*found))


def abbreviations(text: Column | str) -> Column:
    """array<struct<abbr, full>>: 'Full Term (FT)' whose last words' initials spell the abbreviation."""
    hits = F.regexp_extract_all(text, F.lit(r"((?:[A-Za-z-]+ ){1,10}\([A-Z]{2,6}\))"), F.lit(1))
    abbr = lambda h: F.regexp_extract(h, r"\(([A-Z]{2,6})\)", 1)

    def full(h: Column) -> Column:
        before = F.split(F.trim(F.regexp_replace(h, r"\(.*$", "")), " ")
        tail = F.slice(before, F.greatest(F.lit(1), F.size(before) - F.length(abbr(h)) + 1), F.length(abbr(h)))
        initials = F.upper(F.array_join(F.transform(tail, lambda w: F.substring(w, 1, 1)), ""))
        return F.when(initials == abbr(h), F.array_join(tail, " "))

    return F.filter(F.transform(hits, lambda h: F.struct(abbr(h).alias("abbr"), full(h).alias("full"))), lambda x: x["full"].isNotNull())


def quoted_names(text: Column | str) -> Column:
    """Quoted names of two or more words."""
    return F.regexp_extract_all(text, F.lit("\"([A-Za-z]+(?: [A-Za-z]+)+)\""), F.lit(1))


RISKS = (("safety", r"hazard|injur|danger|toxic"), ("deviation", r"deviat|exception|unless"), ("approval", r"approv|authori[sz]|sign"), ("limit", r"limit|maximum|minimum|at least|at most"), ("record", r"record|retain|archive"))


def risk_tags(text: Column | str) -> Column:
    return F.array_compact(F.array(*[F.when(F.lower(text).rlike(p), F.lit(t)) for t, p in RISKS]))


def canonical_role(role: Column | str) -> Column:
    """Lower case, no article, known short forms spelled out, no final s."""
    r = F.regexp_replace(F.lower(F.trim(role)), "^(the|a|an) ", "")
    for short, long in (("qa", "quality assurance"), ("mgr", "manager"), ("dept", "department")):
        r = F.regexp_replace(r, rf"\b{short}\b", long)
    return F.when(r.endswith("ss"), r).otherwise(F.regexp_replace(r, "s$", ""))

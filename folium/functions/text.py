"""Scalar text functions as column expressions: normal forms, words, stems, sentences, readability, labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that carry no topic.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "will", "with")
# Signs stripped from the ends of a word.
WORD_EDGES = ".,;:!?()[]{}\"'"
SENTENCE_END = r"([.!?;])[ \t\r\n]+([A-Z0-9\"(])"
BREAK = "\u001e"


def collapse(text: Column | str) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f\x0B]+", " "))


def normal(text: Column | str) -> Column:
    return F.lower(collapse(text))


def content_hash(path: Column, text: Column | str) -> Column:
    """16 hex digits of SHA-256 over a structural path and the normal form."""
    return F.substring(F.sha2(F.concat(path, F.lit("|"), normal(text)), 256), 1, 16)


def words(text: Column | str) -> Column:
    """Lower-cased words without signs at their ends; what is only signs goes."""
    return F.filter(F.transform(F.split(normal(text), " "), lambda w: F.btrim(w, F.lit(WORD_EDGES))), lambda w: w != "")


def stem(word: Column) -> Column:
    """ies becomes y; a final s goes (not ss) from words of more than three letters."""
    long = F.length(word) > 3
    return F.when(long & word.endswith("ies"), F.concat(F.substr(word, F.lit(1), F.length(word) - 3), F.lit("y"))).when(
        long & word.endswith("s") & ~word.endswith("ss"), F.substr(word, F.lit(1), F.length(word) - 1)
    ).otherwise(word)


def topic_words(text: Column | str) -> Column:
    return F.filter(words(text), lambda w: ~w.isin(*STOP_WORDS))


def sentences(text: Column | str) -> Column:
    """Splits after . ! ? ; before a capital, digit, quote or bracket."""
    return F.split(F.regexp_replace(text, SENTENCE_END, f"$1{BREAK}$2"), BREAK)


def syllables(word: Column) -> Column:
    """Groups of vowels, a silent final e not counted, at least one."""
    groups = F.regexp_count(word, F.lit("[aeiouy]+"))
    silent = (word.endswith("e") & ~word.endswith("le") & (groups > 1)).cast("int")
    return F.greatest(F.lit(1), groups - silent)


def reading_ease(words_: Column, sentences_: Column, syllables_: Column) -> Column:
    return 206.835 - 1.015 * words_ / sentences_ - 84.6 * syllables_ / words_


def grade(words_: Column, sentences_: Column, syllables_: Column) -> Column:
    return 0.39 * words_ / sentences_ + 11.8 * syllables_ / words_ - 15.59


PASSIVE = r"\b(is|are|was|were|be|been|being) ([a-z]+ed|done|made|given|taken|written|kept|sent|held|shown|known)\b"


def is_passive(sentence: Column) -> Column:
    return F.lower(sentence).rlike(PASSIVE)


def token_estimate(text: Column | str) -> Column:
    return F.floor(F.length(text) / 4) + 1


def slug(text: Column | str, most: int = 40) -> Column:
    return F.substring(F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-")), 1, most)


def lead_sentence(text: Column | str) -> Column:
    """Up to the first '. ' if that comes before 180 characters, else 140 characters and dots; short texts as they are."""
    text = F.col(text) if isinstance(text, str) else text
    at = F.locate(". ", text)
    return F.when((at > 0) & (at < 180), F.substr(text, F.lit(1), at)).when(F.length(text) > 140, F.concat(F.substring(text, 1, 140), F.lit("..."))).otherwise(text)


def without_number(heading: Column | str) -> Column:
    """A heading without '1.2.3 ', 'A. ' or 'Section 4: ' before it."""
    h = F.trim(heading)
    for pattern in (r"^[0-9]+(\.[0-9]+)*[.)]?[ \t]+", r"^[A-Z][.)][ \t]+", r"^(Section|Chapter|Appendix) [0-9A-Z]+[:.]?[ \t]+"):
        cut = F.regexp_replace(h, pattern, "")
        h = F.when(cut != "", cut).otherwise(h)
    return h


LIST_PREFIX = r"^[ \t]*([-*•–]|[0-9]{1,3}[.)]|[a-z][.)])[ \t]+"


def is_list_item(line: Column) -> Column:
    return line.rlike(LIST_PREFIX)


def without_list_prefix(line: Column) -> Column:
    return F.regexp_replace(line, LIST_PREFIX, "")


def is_caption(line: Column) -> Column:
    return F.lower(line).rlike(r"^(figure|fig\.|table|image) [0-9]+")


def chunk_type(heading: Column) -> Column:
    h = F.lower(heading)
    return (
        F.when(h.rlike("procedure|step|instruction"), "procedure").when(h.rlike("reference|bibliography"), "reference")
        .when(h.rlike("appendix|annex"), "appendix").otherwise("section")
    )


def emails(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0))

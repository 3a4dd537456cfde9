"""Licence scan with ordered signature rules, in DataFrame functions only.

A text becomes its words (runs of letters and digits, A-Z lower-cased), each after one space. A rule has keywords,
one of which every match holds, and a word of its form, which every match holds too. Texts that hold none of
any rule's are done with there. For the others, the rules whose own occur are
tried: each is a regular expression over words with a label, a priority and a confidence. Detections that lie
inside one of higher priority, or of equal priority and greater length, are suppressed; the rest
give labels. The phrases of BASE are rules too; theirs are never suppressed. A text is scanned in blocks of BLOCK
words, read with REACH more on either side, more than a detection can be long: the work grows with its length.

Defined cases: a null text is empty and has no words; words count from 0; every row gives one
row, repeated ones too. Columns other than id and text are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK, REACH = 256, 32
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The phrases and labels of the base scan.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Licence names: label, keywords (by |) of which every match holds one, expression over words.
NAMES = (
    ("apache-2.0", "apache", "apache( software)? licen[cs]e,? (version |v ?)?2( 0)?|apache 2( 0)?"),
    ("apache-1.1", "apache", "apache( software)? licen[cs]e (version |v ?)?1 1"),
    ("mit", " mit ", "(the )?mit( x11)?"),
    ("bsd-2-clause", " bsd ", "(the )?(simplified|freebsd|2 clause) bsd|bsd 2 clause"),
    ("bsd-3-clause", " bsd ", "(the )?(new|modified|revised|3 clause) bsd|bsd 3 clause"),
    ("bsd-4-clause", " bsd ", "(the )?(original|4 clause) bsd|bsd 4 clause"),
    ("bsd", " bsd ", "(the )?bsd"),
    ("0bsd", " 0bsd ", "(the )?0bsd"),
    ("mit-0", " mit 0 ", "(the )?mit 0"),
    ("isc", " isc ", "(the )?isc"),
    ("gpl-2.0", "general public licen| gpl", "(gnu )?general public licen[cs]e (version |v ?)?2( 0)?|(gnu )?gpl ?(version |v ?)?2( 0)?"),
    ("gpl-3.0", "general public licen| gpl", "(gnu )?general public licen[cs]e (version |v ?)?3( 0)?|(gnu )?gpl ?(version |v ?)?3( 0)?"),
    ("lgpl-2.1", "general public licen", "(gnu )?(lesser|library) general public licen[cs]e (version |v ?)?2( 1)?"),
    ("lgpl-3.0", "lesser general public licen", "(gnu )?lesser general public licen[cs]e (version |v ?)?3( 0)?"),
    ("agpl-3.0", "affero general public licen", "(gnu )?affero general public licen[cs]e (version |v ?)?3( 0)?"),
    ("agpl-3.0", " affero gpl", "(gnu )?affero gpl ?(version |v ?)?3( 0)?"),
    ("lgpl-2.1", " lesser gpl", "(gnu )?lesser gpl ?(version |v ?)?2( 1)?"),
    ("lgpl-3.0", " lesser gpl", "(gnu )?lesser gpl ?(version |v ?)?3( 0)?"),
    ("mpl-1.1", "mozilla public licen", "mozilla public licen[cs]e (version |v ?)?1 1"),
    ("mpl-2.0", "mozilla public licen", "mozilla public licen[cs]e (version |v ?)?2( 0)?"),
    ("epl-1.0", "eclipse public licen", "eclipse public licen[cs]e (version |v ?)?1( 0)?"),
    ("epl-2.0", "eclipse public licen", "eclipse public licen[cs]e (version |v ?)?2( 0)?"),
    ("cddl-1.0", "common development", "common development and distribution licen[cs]e (version )?1( 0)?"),
    ("cpl-1.0", "common public licen", "common public licen[cs]e (version )?1( 0)?"),
    ("artistic-1.0", "artistic licen", "artistic licen[cs]e (version )?1( 0)?"),
    ("artistic-2.0", "artistic licen", "artistic licen[cs]e (version )?2( 0)?"),
    ("boost-1.0", "boost software", "boost software licen[cs]e (version )?1( 0)?"),
    ("zlib", " zlib ", "(the )?zlib( libpng)?"),
    ("unlicense", "unlicense", "(the )?unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("cc0-1.0", " cc0 ", "cc0( 1 0)?"),
    ("ofl-1.1", "sil open font", "sil open font licen[cs]e (version )?1 1"),
    ("eupl-1.2", " eupl ", "eupl (version |v ?)?1 2"),
    ("ms-pl", "microsoft public", "microsoft public licen[cs]e"),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal licen[cs]e"),
    ("python-2.0", "python software foundation", "python software foundation licen[cs]e( version 2)?"),
    ("postgresql", "postgresql", "postgresql licen[cs]e"),
    ("openssl", "openssl", "openssl licen[cs]e"),
    ("gfdl-1.3", "documentation licen", "(gnu )?free documentation licen[cs]e (version )?1 3"),
    ("proprietary", " proprietary ", "(a |the )?proprietary"),
)
# Short names, as SPDX has them: label, name, major and minor version.
SHORT = (
    ("apache-1.1", "apache", 1, 1), ("lgpl-2.1", "lgpl", 2, 1), ("lgpl-3.0", "lgpl", 3, 0), ("agpl-3.0", "agpl", 3, 0), ("mpl-1.1", "mpl", 1, 1), ("mpl-2.0", "mpl", 2, 0),
    ("epl-1.0", "epl", 1, 0), ("epl-2.0", "epl", 2, 0), ("cddl-1.0", "cddl", 1, 0), ("cpl-1.0", "cpl", 1, 0), ("artistic-1.0", "artistic", 1, 0), ("artistic-2.0", "artistic", 2, 0),
    ("boost-1.0", "bsl", 1, 0), ("ofl-1.1", "ofl", 1, 1), ("python-2.0", "python", 2, 0), ("python-2.0", "psf", 2, 0), ("gfdl-1.3", "gfdl", 1, 3),
)
ALONE = ("lgpl", "agpl", "gfdl", "cddl", "mpl", "affero gpl", "lesser gpl")  # these and a version say enough without a form
SPDX_ONLY = (("ms-pl", "ms pl"), ("ms-rl", "ms rl"), ("postgresql", "postgresql"), ("openssl", "openssl"))  # too common as words for the other forms
# Creative Commons licences: their parts and versions make the rules.
CC_PARTS = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
CC_WORDS = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(ative)?s?", "nc": "non ?commercial"}
# Ways to name a licence: how the name is set in, priority, confidence, word that every match holds.
FORMS = (
    ("spdx licen[cs]e identifier ({name})", 9, 1.0, "spdx licen"),
    ("licen[cs]ed under (the )?(terms of )?(the )?({name})( licen[cs]e)?", 8, 0.95, "ed under "),
    ("(released|distributed|available|published|provided) under (the )?(terms of )?(the )?({name})( licen[cs]e)?", 7, 0.95, " under "),
    ("subject to (the )?(terms of )?(the )?({name})( licen[cs]e)?", 6, 0.85, "subject to "),
    ("({name}) licen[cs]e", 4, 0.8, " licen"),
    ("licen[cs]e ({name})", 3, 0.7, " licen"),
    ("dual licen[cs]ed (under )?([a-z0-9]{1,20} ){1,8}(and|or) (the )?({name})", 1, 0.8, " dual licen"),
)
# Notices that name no licence: label, keywords, expression, priority, confidence.
NOTICES = (
    ("gpl", "general public licen", "(gnu )?general public licen[cs]e", 2, 0.75),
    ("gpl", " gpl ", "(gnu )?gpl(?! v?[0-9])", 2, 0.6),
    ("lgpl", " lgpl ", "(gnu )?lgpl(?! v?[0-9])", 2, 0.6),
    ("lgpl", " lesser gpl ", "(gnu )?lesser gpl(?! v?[0-9])", 2, 0.6),
    ("agpl", " agpl ", "(gnu )?agpl(?! v?[0-9])", 2, 0.6),
    ("agpl", " affero gpl ", "(gnu )?affero gpl(?! v?[0-9])", 2, 0.6),
    ("agpl", "affero general public licen", "(gnu )?affero general public licen[cs]e", 3, 0.75),
    ("lgpl", "lesser general public licen", "(gnu )?lesser general public licen[cs]e", 3, 0.75),
    ("apache", "apache", "apache( software)? licen[cs]e", 2, 0.7),
    ("mozilla", "mozilla public licen", "mozilla public licen[cs]e", 2, 0.7),
    ("creative-commons", "creative commons", "creative commons", 1, 0.6),
    ("public-domain", "public domain", "(in|into|to) the public domain|public domain dedication", 2, 0.7),
    ("copyright", " copyright ", "copyright (c )?[12][0-9]{3}", 1, 0.4),
    ("copyright", " copyright ", "copyright notice", 1, 0.4),
    ("no-warranty", " warranty ", "without (any )?warranty of any kind|no warranty", 1, 0.4),
    ("as-is", "provided as is ", "provided as is", 1, 0.4),
    ("permissive-grant", "permission is hereby", "permission is hereby granted free of charge", 5, 0.85),
    ("bsd-grant", "redistribution and use", "redistribution and use in source and binary forms", 5, 0.85),
)


def rules() -> list[tuple[str, str, str, int, float, bool, str]]:
    """(label, keywords, expression over words with their spaces, priority, confidence, base, word of the form or ""), highest priority first."""
    found = [(label, f" {phrase} ", phrase, 0, 0.6, True, "") for phrase, label in BASE]
    names = list(NAMES)
    for label, short, major, minor in SHORT:
        version = f"{major} {minor}" if minor else f"{major}( 0|(?! [0-9] ))"
        names.append((label, f" {short}", f"(gnu )?{short} ?(version |v ?)?{version}" if short in ALONE else f"{short} ?(version |v ?)?{version}"))
    for parts in CC_PARTS:
        long = " ".join(CC_WORDS[p] for p in parts.split())
        names += [(f"cc-{parts.replace(' ', '-')}-{v.replace(' ', '.')}", " cc by " if short else "creative commons", f"cc {parts} {v}" if short else f"creative commons {long} {v}") for v in CC_VERSIONS for short in (True, False)]
    for label, keywords, name in names:
        found += [(label, keywords, form.replace("{name}", name), rank, sure, False, word) for form, rank, sure, word in FORMS]
        if label.startswith("cc-") or "licen" in name or any(f"{short} ?(" in name for short in ALONE):  # the name alone says enough
            found.append((label, keywords, name, 2, 0.8, False, ""))
    form, rank, sure, word = FORMS[0]
    found += [(label, word, form.replace("{name}", name), rank, sure, False, word) for label, name in SPDX_ONLY]
    found += [(*x, False, "") for x in NOTICES]
    return sorted(found, key=lambda r: (-r[3], r[0], r[2]))


def _spans(text: Column, rule: Column) -> Column:
    """Where a rule matches: array of (label, rank, sure, base, start, stop), in words."""
    count = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" ")))
    pieces = F.split(text, rule["pattern"], -1)
    hits = F.regexp_extract_all(text, rule["pattern"], F.lit(0))
    kind = "array<struct<label:string,rank:int,sure:double,base:boolean,start:int,stop:int>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + count(x["piece"])
        stop = start + count(x["hit"])
        span = F.struct(rule["label"].alias("label"), rule["rank"].alias("rank"), rule["sure"].alias("sure"), rule["base"].alias("base"), start.alias("start"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.concat(s["spans"], F.array(span)).cast(kind).alias("spans"))

    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(hits)), hits, lambda p, h: F.struct(p.alias("piece"), h.alias("hit")))
    return F.aggregate(pairs, zero, step, lambda s: s["spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans: array of (label, rank, sure, base, start, stop) kept, by start; score: the greatest confidence, 0 without any.
    """
    lower = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    text = F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, SEPARATORS, " ")), F.lit(" "))
    rows = docs.select(F.col(id_col), text.alias("_text"))
    rows = rows.withColumn("n_words", F.when(F.length("_text") <= 2, 0).otherwise(F.length("_text") - F.length(F.replace("_text", F.lit(" "))) - 1).cast("long"))
    groups: dict[str, list[dict]] = {}
    fields = ("label", "pattern", "rank", "sure", "base", "form")
    for label, keywords, regex, rank, sure, base, form in rules():
        groups.setdefault(keywords, []).append(dict(zip(fields, (label, f" (?:{regex})(?= )", rank, sure, base, form), strict=True)))

    def holds(words: set[str]) -> Column:
        out = F.lit(False)
        for word in sorted(words):
            out = out | F.contains("_text", F.lit(word))
        return out

    alone = {w for k, g in groups.items() for w in k.split("|") if any(not r["form"] for r in g)}
    others = {w for k in groups for w in k.split("|")} - alone
    gate = holds(alone) | (holds({r["form"] for g in groups.values() for r in g} - {""}) & holds(others))
    table = [{"words": k.split("|"), "rules": g} for k, g in groups.items()]
    table = F.from_json(F.lit(json.dumps(table)), "array<struct<words:array<string>,rules:array<struct<label:string,pattern:string,rank:int,sure:double,base:boolean,form:string>>>>")
    words = F.split(F.trim("_text"), " ")
    at = F.sequence(F.lit(0), F.col("n_words").cast("int") - 1, F.lit(BLOCK))

    def block(i: Column) -> Column:
        first = F.greatest(F.lit(0), i - REACH)
        return F.struct(i.alias("at"), first.alias("first"), F.concat(F.lit(" "), F.array_join(F.slice(words, first + 1, i - first + BLOCK + REACH), " "), F.lit(" ")).alias("text"))

    wider = lambda s, t: (t["start"] <= s["start"]) & (t["stop"] >= s["stop"]) & ((t["rank"] > s["rank"]) | ((t["rank"] == s["rank"]) & (t["stop"] - t["start"] > s["stop"] - s["start"])))

    def found(b: Column) -> Column:
        near = F.filter(table, lambda g: F.exists(g["words"], lambda w: F.contains(b["text"], w)))
        tried = F.filter(F.flatten(F.transform(near, lambda g: g["rules"])), lambda r: F.contains(b["text"], r["form"]))
        every = F.flatten(F.transform(tried, lambda r: _spans(b["text"], r)))
        return F.transform(F.array(every), lambda e: kept(b, e))[0]

    def kept(b: Column, every: Column) -> Column:
        inside = lambda s: (s["start"] >= b["at"] - b["first"]) & (s["start"] < b["at"] - b["first"] + BLOCK)
        own = F.filter(every, lambda s: inside(s) & (s["base"] | ~F.exists(every, lambda t: ~t["base"] & wider(s, t))))
        return F.transform(own, lambda s: F.struct((s["start"] + b["first"]).alias("start"), (s["stop"] + b["first"]).alias("stop"), s["label"].alias("label"), s["rank"].alias("rank"), s["sure"].alias("sure"), s["base"].alias("base")))

    rows = rows.withColumn("spans", F.when(gate & (F.col("n_words") > 0), F.sort_array(F.flatten(F.transform(F.transform(at, block), found)))))
    base = F.filter("spans", lambda s: s["base"])
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["start"])
    return rows.select(
        id_col, "n_words", F.when(F.col("spans").isNull(), 0).otherwise(F.size(base)).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.coalesce(join(base), F.lit("")).alias("base_labels"), F.coalesce(join(F.col("spans")), F.lit("")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["sure"])), F.lit(0.0)).alias("score"), "spans",
    )

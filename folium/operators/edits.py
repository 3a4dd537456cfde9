"""Find and replace in versioned texts, with spans that stay as they are.

A text is taken apart into protected spans and the gaps between them, each gap into matches and what lies between, all by
regular expressions of the JVM. Positions are sums of lengths, in code points. A match lies in one gap: never inside or across a
protected span; the edges of a gap count as edges of words. Numbers of matches run through a text from 0.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

EDGE = r"(?<![\p{L}\p{N}])"
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
URL = r"https?://[^\s<>\"']+"
NUMBER = r"\d+(?:[.,]\d+)*%?"
TOKEN = r"\{\{[^{}]*\}\}"  # placeholders in double braces
PROTECTED = f"{TOKEN}|{EDGE}(?:{URL}|{EMAIL}|{NUMBER})"


def phrase(find: str, whole_word: bool = True, case_sensitive: bool = False) -> str:
    """The pattern of a word or phrase: any white space between its words."""
    if not find.strip():
        raise ValueError("what is sought is empty")
    body = r"\s+".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in find.split())
    body = rf"(?<![\p{{L}}\p{{N}}]){body}(?![\p{{L}}\p{{N}}])" if whole_word else body
    return body if case_sensitive else f"(?iu){body}"


def _pieces(text: Column, pattern: str) -> tuple[Column, Column]:
    """What lies between matches, one more than matches; the matches."""
    return F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def spans(rows: DataFrame, patterns: dict[str, str], id_cols: list[str], text_col: str = "text") -> DataFrame:
    """id_cols, kind, start, stop, value of what the patterns find, leftmost first, the first named of those that start together."""
    either = "|".join(f"(?:{p})" for p in patterns.values())
    between, found = _pieces(F.coalesce(F.col(text_col), F.lit("")), either)
    each = rows.select(*id_cols, F.posexplode(F.arrays_zip(F.transform(between, lambda x: F.length(x)).alias("gap"), found.alias("value"))).alias("n", "s"))
    before = F.sum(F.col("s.gap") + F.length(F.coalesce("s.value", F.lit("")))).over(Window.partitionBy(*id_cols).orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    kind = F.coalesce(*[F.when(F.regexp_extract("value", f"^(?:{p})$", 0) == F.col("value"), k) for k, p in patterns.items()])
    each = each.select(*id_cols, (F.coalesce(before, F.lit(0)) + F.col("s.gap")).cast("long").alias("start"), F.col("s.value").alias("value")).where("value IS NOT NULL")
    return each.select(*id_cols, kind.alias("kind"), "start", (F.col("start") + F.length("value")).alias("stop"), "value")


def _parts(text: Column, pattern: str, protected: str) -> Column:
    """array<struct<kind, t>> in order: gap, match and protected, some of them empty."""

    def cut(kind: str, between: Column, found: Column, inner) -> Column:
        zipped = F.arrays_zip(between.alias("b"), found.alias("f"))
        return F.flatten(F.transform(zipped, lambda z: F.concat(inner(z["b"]), F.when(z["f"].isNotNull(), F.array(F.struct(F.lit(kind).alias("kind"), z["f"].alias("t")))).otherwise(F.array().cast("array<struct<kind:string,t:string>>")))))

    plain = lambda x: F.array(F.struct(F.lit("gap").alias("kind"), x.alias("t")))
    return cut("protected", *_pieces(text, protected), lambda gap: cut("match", *_pieces(gap, pattern), plain))


def matches(segments: DataFrame, find: str, id_cols: list[str], text_col: str = "text", whole_word: bool = True, case_sensitive: bool = False, protected: str = PROTECTED) -> DataFrame:
    """id_cols, occurrence, start, stop, value of each match outside protected spans."""
    rows = segments.select(*id_cols, F.posexplode(_parts(F.coalesce(F.col(text_col), F.lit("")), phrase(find, whole_word, case_sensitive), protected)).alias("n", "p"))
    w = Window.partitionBy(*id_cols).orderBy("n")
    rows = rows.withColumn("stop", F.sum(F.length("p.t")).over(w)).where("p.kind = 'match'")
    return rows.select(*id_cols, (F.row_number().over(w) - 1).alias("occurrence"), (F.col("stop") - F.length("p.t")).alias("start"), "stop", F.col("p.t").alias("value"))


def longer_words(segments: DataFrame, find: str, text_col: str = "text", case_sensitive: bool = False, protected: str = PROTECTED) -> DataFrame:
    """word, n: the longer words that hold what is sought and that matching whole words leaves out."""
    gaps = F.split(F.coalesce(F.col(text_col), F.lit("")), protected, -1)
    around = rf"[\p{{L}}\p{{N}}]*{phrase(find, False, True)}[\p{{L}}\p{{N}}]*"
    around = around if case_sensitive else f"(?iu){around}"
    words = segments.select(F.explode(F.flatten(F.transform(gaps, lambda g: F.regexp_extract_all(g, F.lit(around), F.lit(0))))).alias("word"))
    whole = F.regexp_replace("word", phrase(find, True, case_sensitive), "") == ""
    return words.where(~whole).groupBy("word").agg(F.count("*").alias("n"))


def replaced(
    segments: DataFrame, find: str, replacement: str, expected: DataFrame, id_cols: list[str], chosen: DataFrame | None = None, text_col: str = "text",
    version_col: str = "version", whole_word: bool = True, case_sensitive: bool = False, protected: str = PROTECTED,
) -> DataFrame:
    """segments with text and version after the change, n_replaced and state: replaced, unchanged, stale (the version is not the expected one),
    skipped (the change would alter the protected spans).

    expected: id_cols and version, as the preview showed them; segments it does not name are stale. chosen: id_cols and occurrence; else all matches.
    """
    text, pattern = F.coalesce(F.col(text_col), F.lit("")), phrase(find, whole_word, case_sensitive)
    rows = segments.withColumn("_parts", _parts(text, pattern, protected))
    seen = expected.select(*[F.col(c).alias(f"_e{i}") for i, c in enumerate(id_cols)], F.col(version_col).alias("_seen"))
    on = [F.col(f"_e{i}").eqNullSafe(F.col(c)) for i, c in enumerate(id_cols)]
    rows = rows.join(seen, on, "left").drop(*[f"_e{i}" for i in range(len(id_cols))])
    number = lambda i: F.size(F.filter(F.slice("_parts", 1, i), lambda q: q["kind"] == "match"))
    if chosen is None:
        wanted = lambda p, i: p["kind"] == "match"
    else:
        some = chosen.groupBy(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(id_cols)]).agg(F.collect_set("occurrence").alias("_chosen"))  # bounded by one text
        rows = rows.join(some, [F.col(f"_c{i}").eqNullSafe(F.col(c)) for i, c in enumerate(id_cols)], "left").drop(*[f"_c{i}" for i in range(len(id_cols))])
        wanted = lambda p, i: (p["kind"] == "match") & F.coalesce(F.array_contains("_chosen", number(i)), F.lit(False))
    rows = rows.withColumn("_new", F.transform("_parts", lambda p, i: F.struct(wanted(p, i).alias("hit"), F.when(wanted(p, i), F.lit(replacement)).otherwise(p["t"]).alias("t"))))
    rows = rows.withColumn("_n", F.size(F.filter("_new", lambda p: p["hit"]))).withColumn("_text", F.array_join(F.transform("_new", lambda p: p["t"]), ""))
    same = F.regexp_extract_all("_text", F.lit(protected), F.lit(0)) == F.regexp_extract_all(text, F.lit(protected), F.lit(0))
    state = F.when(~F.col(version_col).eqNullSafe(F.col("_seen")), "stale").when(F.col("_n") == 0, "unchanged").when(~same, "skipped").otherwise("replaced")
    rows = rows.withColumn("_state", state)
    done = F.col("_state") == "replaced"
    kept = [c for c in segments.columns if c not in (text_col, version_col, "n_replaced", "state")]
    return rows.select(*kept, F.when(done, F.col("_text")).otherwise(F.col(text_col)).alias(text_col), (F.col(version_col) + done.cast("int")).alias(version_col), F.when(done, F.col("_n")).otherwise(0).alias("n_replaced"), F.col("_state").alias("state"))

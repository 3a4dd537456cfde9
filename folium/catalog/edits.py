"""Queries of find and replace, and of spans. In the SQL a text is a list of protected spans, words and single other signs."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.operators import edits as E
from folium.registry import query, table

_PROTECTED = rf"\{{\{{[^{{}}]*\}}\}}|https?://[^\s<>\"'']+|{E.EMAIL}|{E.NUMBER}".replace('\\"', '"')
_TOKENS = rf"SELECT *, regexp_extract_all(text, '{_PROTECTED}|[\pL\pN]+|[^\pL\pN]') AS w FROM conversations"
IDS = ["conv_id", "turn"]


@query("c18_protected_replace", rf"""
SELECT conv_id, turn, CASE WHEN n > 0 AND conv_id % 5 <> 0 THEN array_to_string(list_transform(w, lambda x: CASE WHEN lower(x) = 'the' THEN 'each' ELSE x END), '') ELSE text END AS text,
  turn + (n > 0 AND conv_id % 5 <> 0)::INT AS version, CASE WHEN conv_id % 5 = 0 THEN 0 ELSE n END AS n_replaced, CASE WHEN conv_id % 5 = 0 THEN 'stale' WHEN n = 0 THEN 'unchanged' ELSE 'replaced' END AS state
FROM (SELECT *, len(list_filter(w, lambda x: lower(x) = 'the')) AS n FROM ({_TOKENS}))""")
def protected_replace(spark, sf_dir):
    """A word replaced in all turns, outside numbers, addresses and URLs; turns that changed since the preview are left alone (C18). The turn's number stands for its version; each fifth conversation changed."""
    segments = table(spark, sf_dir, "conversations").withColumn("version", F.col("turn")).drop("role")
    preview = segments.select(*IDS, (F.col("version") - (F.col("conv_id") % 5 == 0).cast("int")).alias("version"))
    return E.replaced(segments, "the", "each", preview, IDS)


@query("c18_matches", rf"""
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS occurrence, stop - length(x) AS start, stop, x AS value FROM (
  SELECT *, sum(length(x)) OVER (PARTITION BY conv_id, turn ORDER BY i) AS stop FROM (SELECT conv_id, turn, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM ({_TOKENS})))
WHERE lower(x) = 'de'""")
def found_matches(spark, sf_dir):
    """Where a word stands, outside protected spans."""
    return E.matches(table(spark, sf_dir, "conversations"), "de", IDS)


@query("c18_longer_words", rf"SELECT x AS word, count(*) AS n FROM (SELECT unnest(w) AS x FROM ({_TOKENS})) WHERE regexp_matches(x, '^[\pL\pN]+$') AND NOT regexp_matches(x, '^[0-9]+$') AND contains(lower(x), 'that') AND lower(x) <> 'that' GROUP BY x")
def longer_words(spark, sf_dir):
    """Longer words that hold the word sought."""
    return E.longer_words(table(spark, sf_dir, "conversations"), "that")


KINDS = {"url": E.URL, "email": E.EMAIL, "document": r"[A-Z]{2,6}-\d{3,}(?:-\d+)*"}
_EITHER = "|".join(f"(?:{p})" for p in KINDS.values()).replace("'", "''").replace('\\"', '"')


@query("f42_spans", rf"""
SELECT doc_id, CASE WHEN value LIKE 'http%://%' THEN 'url' WHEN contains(value, '@') THEN 'email' ELSE 'document' END AS kind, start, start + length(value) AS stop, value FROM (
  SELECT doc_id, f[i] AS value, (list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start
  FROM (SELECT doc_id, f, b, unnest(range(1, len(f) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{_EITHER}') AS f, regexp_split_to_array(text, '{_EITHER}') AS b FROM documents)))""")
def text_spans(spark, sf_dir):
    """URLs, addresses and document numbers with their places, in whole documents (F42). The form of document numbers is a parameter."""
    return E.spans(table(spark, sf_dir, "documents"), KINDS, ["doc_id"])

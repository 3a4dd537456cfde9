"""Queries over text functions."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from folium.functions import text as T
from folium.registry import derived, query, table

NORMAL = r"lower(trim(regexp_replace({0}, '[ \t\r\n\f\x0B]+', ' ', 'g')))"
NORMAL_TEXT = NORMAL.format("text")
WORDS = "list_filter(list_transform(string_split(" + NORMAL_TEXT + ", ' '), lambda w: trim(w, '.,;:!?()[]{}\"''')), lambda w: w <> '')"


@query(
    "a03_repeated_lines",
    r"""
SELECT line, count(DISTINCT doc_id) AS n_docs, count(*) AS n_places
FROM (SELECT doc_id, trim(regexp_replace(l, '[ \t\r\f\v]+', ' ', 'g')) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents))
WHERE line <> '' GROUP BY line HAVING count(DISTINCT doc_id) >= 2
""",
)
def repeated_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    lines = lines.select("doc_id", F.trim(F.regexp_replace("l", r"[ \t\r\f\v]+", " ")).alias("line")).where("line != ''")
    return lines.groupBy("line").agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_places")).where("n_docs >= 2")


@query("f01_content_hash", f"""
SELECT doc_id, substr(sha256(source || '#' || row_number() OVER (PARTITION BY source, {NORMAL_TEXT} ORDER BY doc_id) || '|' || {NORMAL_TEXT}), 1, 16) AS content_hash, length({NORMAL_TEXT}) AS n_normal
FROM documents""")
def content_hashes(spark, sf_dir):
    """Hash of source, the duplicate's number within the source, and the normal form."""
    docs = table(spark, sf_dir, "documents").withColumn("normal", T.normal("text"))
    nth = F.row_number().over(Window.partitionBy("source", "normal").orderBy("doc_id"))
    docs = docs.withColumn("path", F.concat("source", F.lit("#"), nth.cast("string")))
    return docs.select("doc_id", T.content_hash(F.col("path"), "text").alias("content_hash"), F.length("normal").alias("n_normal"))


@query("f02_words", f"SELECT doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_distinct, list_max(list_transform(w, lambda x: length(x))) AS longest FROM (SELECT doc_id, {WORDS} AS w FROM documents)")
def word_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("w", T.words("text"))
    return docs.select("doc_id", F.size("w").alias("n_words"), F.size(F.array_distinct("w")).alias("n_distinct"), F.array_max(F.transform("w", lambda x: F.length(x))).alias("longest"))


STEM = "CASE WHEN length(w) > 3 AND ends_with(w, 'ies') THEN left(w, length(w) - 3) || 'y' WHEN length(w) > 3 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, length(w) - 1) ELSE w END"


@query("f03_stem_counts", f"""
SELECT stem, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, {STEM} AS stem FROM (SELECT doc_id, unnest({WORDS}) AS w FROM documents)) WHERE stem NOT IN {T.STOP_WORDS} GROUP BY stem HAVING count(*) >= 5""")
def stem_counts(spark, sf_dir):
    """Stems of words that carry a topic."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.words("text")).alias("w"))
    w = w.select("doc_id", T.stem(F.col("w")).alias("stem")).where(~F.col("stem").isin(*T.STOP_WORDS))
    return w.groupBy("stem").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs")).where("n >= 5")


SENTENCES = r"""string_split(regexp_replace(text, '([.!?;])[ \t\r\n]+([A-Z0-9"(])', '\1' || chr(30) || '\2', 'g'), chr(30))"""


@query("f05_sentences", f"SELECT doc_id, len(s) AS n_sentences, list_max(list_transform(s, lambda x: length(x))) AS longest FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)")
def sentence_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("s", T.sentences("text"))
    return docs.select("doc_id", F.size("s").alias("n_sentences"), F.array_max(F.transform("s", lambda x: F.length(x))).alias("longest"))


@query("f06_readability", f"""
WITH w AS (SELECT doc_id, {WORDS} AS w, len({SENTENCES}) AS s FROM documents WHERE lang = 'en'),
c AS (SELECT doc_id, s, len(w) AS n, list_sum(list_transform(w, lambda x: greatest(1, len(regexp_extract_all(x, '[aeiouy]+')) - CASE WHEN ends_with(x, 'e') AND NOT ends_with(x, 'le') AND len(regexp_extract_all(x, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END))) AS y FROM w WHERE len(w) > 0)
SELECT doc_id, n AS n_words, s AS n_sentences, y::BIGINT AS n_syllables, floor(100e0 * (206.835e0 - 1.015e0 * n / s - 84.6e0 * y / n)) AS ease_100, floor(100e0 * (0.39e0 * n / s + 11.8e0 * y / n - 15.59e0)) AS grade_100 FROM c""")
def readability(spark, sf_dir):
    """Flesch reading ease and Flesch-Kincaid grade, in hundredths."""
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").withColumn("w", T.words("text")).where(F.size("w") > 0)
    docs = docs.select("doc_id", F.size("w").alias("n_words"), F.size(T.sentences("text")).alias("n_sentences"), F.aggregate(F.transform("w", T.syllables), F.lit(0), lambda a, x: a + x).cast("long").alias("n_syllables"))
    args = F.col("n_words"), F.col("n_sentences"), F.col("n_syllables")
    return docs.select("*", F.floor(100 * T.reading_ease(*args)).cast("double").alias("ease_100"), F.floor(100 * T.grade(*args)).cast("double").alias("grade_100"))


@query("f07_passive_sentences", f"""
SELECT doc_id, count(*) AS n, count(*) FILTER (regexp_matches(lower(s), '{T.PASSIVE}')) AS n_passive FROM (SELECT doc_id, unnest({SENTENCES}) AS s FROM documents WHERE lang = 'en') GROUP BY doc_id""")
def passive_sentences(spark, sf_dir):
    s = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.explode(T.sentences("text")).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(T.is_passive(F.col("s"))).alias("n_passive"))


@query("f22_token_estimate", "SELECT lang, sum(length(text) // 4 + 1)::BIGINT AS tokens, max(length(text) // 4 + 1) AS largest FROM documents GROUP BY lang")
def token_estimates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("t", T.token_estimate("text"))
    return docs.groupBy("lang").agg(F.sum("t").alias("tokens"), F.max("t").alias("largest"))


@query("f30_lead_sentences", """
SELECT doc_id, CASE WHEN strpos(text, '. ') > 0 AND strpos(text, '. ') < 180 THEN left(text, strpos(text, '. ')) WHEN length(text) > 140 THEN left(text, 140) || '...' ELSE text END AS lead FROM documents""")
def lead_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.lead_sentence("text").alias("lead"))


@query("f35_list_lines", r"""
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (regexp_matches(l, '^[ \t]*([-*•–]|[0-9]{1,3}[.)]|[a-z][.)])[ \t]+')) AS n_items, count(*) FILTER (regexp_matches(lower(l), '^(figure|fig\.|table|image) [0-9]+')) AS n_captions
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id""")
def list_lines(spark, sf_dir):
    """Lines that begin like list items or captions."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(T.is_list_item(F.col("l"))).alias("n_items"), F.count_if(T.is_caption(F.col("l"))).alias("n_captions"))


@query("f42_emails", r"""
SELECT doc_id, len(e) AS n, array_to_string(list_sort(list_distinct(e)), ' ') AS emails FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS e FROM documents) WHERE len(e) > 0""")
def email_addresses(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("e", T.emails("text")).where(F.size("e") > 0)
    return docs.select("doc_id", F.size("e").alias("n"), F.array_join(F.array_sort(F.array_distinct("e")), " ").alias("emails"))


@query("f23_script_and_numbers", r"""
SELECT conv_id, turn, CASE WHEN length(regexp_replace(text, '[ \t\r\n]', '', 'g')) = 0 THEN 1.0::DOUBLE ELSE length(regexp_replace(text, '[^A-Za-zÀ-ÿ]', '', 'g')) / length(regexp_replace(text, '[ \t\r\n]', '', 'g')) END AS latin_share, len(regexp_extract_all(text, '[0-9]+([.,][0-9]+)*')) AS n_numbers FROM conversations""")
def script_and_numbers(spark, sf_dir):
    """Share of Latin letters among signs, and numbers in language-neutral form."""
    c = table(spark, sf_dir, "conversations")
    signs = F.length(F.regexp_replace("text", r"[ \t\r\n]", ""))
    return c.select("conv_id", "turn", F.when(signs == 0, 1.0).otherwise(F.length(F.regexp_replace("text", "[^A-Za-zÀ-ÿ]", "")) / signs).alias("latin_share"), F.regexp_count("text", F.lit(r"[0-9]+([.,][0-9]+)*")).alias("n_numbers"))


TAGGED = "(SELECT conv_id || ':' || turn AS id, '⟦1⟧' || split_part(text, ' ', 1) || '⟦/1⟧ ' || '⟦2⟧' || split_part(text, ' ', 2) || '⟦/2⟧' AS src, CASE length(text) % 5 WHEN 0 THEN '⟦2⟧' || split_part(text, ' ', 2) || '⟦/2⟧' || '⟦1⟧' || split_part(text, ' ', 1) || '⟦/1⟧ ' WHEN 1 THEN '⟦1⟧' || split_part(text, ' ', 1) || '⟦/1⟧ ' || split_part(text, ' ', 2) WHEN 2 THEN '⟦1⟧' || split_part(text, ' ', 1) || '⟦/1⟧ ' || '⟦2⟧' || split_part(text, ' ', 2) || '⟦/2⟧' || '⟦3⟧' WHEN 3 THEN 'none' ELSE '⟦1⟧' || split_part(text, ' ', 1) || '⟦/1⟧ ' || '⟦2⟧' || split_part(text, ' ', 2) || '⟦/2⟧' END AS tgt FROM conversations) AS inline_rows"


@query("f25_tags", f"""
SELECT id, array_to_string(list_sort(list_filter(s, lambda x: NOT list_contains(t, x))), ' ') AS lost, array_to_string(list_sort(list_filter(t, lambda x: NOT list_contains(s, x))), ' ') AS added, s = t AS same_order
FROM (SELECT id, regexp_extract_all(src, '⟦/?[0-9]+⟧') AS s, regexp_extract_all(tgt, '⟦/?[0-9]+⟧') AS t FROM {TAGGED})""")
def tags(spark, sf_dir):
    """Tags that a translation lost, added or moved."""
    t = derived(spark, sf_dir, TAGGED).select("id", *[F.regexp_extract_all(c, F.lit("⟦/?[0-9]+⟧"), F.lit(0)).alias(c) for c in ("src", "tgt")])
    return t.select("id", F.array_join(F.array_sort(F.array_except("src", "tgt")), " ").alias("lost"), F.array_join(F.array_sort(F.array_except("tgt", "src")), " ").alias("added"), (F.col("src") == F.col("tgt")).alias("same_order"))

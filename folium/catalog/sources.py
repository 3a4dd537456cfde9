"""Queries over sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.registry import derived, query, table
from folium.sources import files, pages as P


@query("s03_page_elements")
def page_elements(spark, sf_dir):
    """Typed elements of pages."""
    return P.elements(table(spark, sf_dir, "pages"))


@query("s03_heading_levels", r"SELECT page_id, level::INT AS level, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<(nav|header|footer|aside|script|style)\b.*?</(nav|header|footer|aside|script|style)>', '', 'g'), '<h([1-6])[^>]*>[^<]+<', 1)) AS level FROM pages) GROUP BY ALL")
def heading_levels(spark, sf_dir):
    e = P.elements(table(spark, sf_dir, "pages")).where("element_type = 'heading'")
    return e.groupBy("page_id", "level").agg(F.count("*").alias("n"))


PAIRS = "(SELECT o_custkey AS doc_id, o_orderkey AS seq, CASE o_orderkey % 5 WHEN 0 THEN 'Document Title' WHEN 1 THEN 'Number of ' || o_orderpriority WHEN 2 THEN 'Version' WHEN 3 THEN 'version no' ELSE 'subtitle' END AS label, CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE ' ' || o_orderkey || ' ' END AS value FROM orders) AS inline_rows"


@query("s11_metadata", f"""
SELECT doc_id, name, arg_min(trim(value), seq) AS value FROM (SELECT *, CASE WHEN regexp_matches(lower(label), '\\b(title)\\b') THEN 'title' WHEN regexp_matches(lower(label), '\\b(version)\\b') THEN 'version' WHEN regexp_matches(lower(label), '\\b(number|no)\\b') THEN 'number' END AS name FROM {PAIRS}) WHERE name IS NOT NULL AND trim(value) <> '' GROUP BY ALL""")
def metadata(spark, sf_dir):
    """Metadata from label and value rows."""
    return P.metadata(derived(spark, sf_dir, PAIRS), {"title": "title", "version": "version", "number": "number|no"})


@query("s14_table_scan", "SELECT * FROM nation")
def table_scan(spark, sf_dir):
    return table(spark, sf_dir, "nation")


@query("s15_union_of_common", "SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def union_of_common(spark, sf_dir):
    """Tables of different age in one."""
    s = table(spark, sf_dir, "supplier").toDF("id", "name", "nation", "balance")
    c = table(spark, sf_dir, "customer").toDF("id", "name", "nation", "balance", "segment")
    return files.union_of_common([s, c], ["id", "name", "nation", "segment"])


@query("k02_clean_json", """SELECT '{"doc_id":' || doc_id || ',"lang":"' || lang || '"' || CASE WHEN doc_id % 2 = 0 THEN ',"n_chars":' || n_chars ELSE '' END || '}' AS json FROM documents""")
def clean_json(spark, sf_dir):
    """JSON without nulls (K1, K2)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")).alias("n_chars"))
    return files.clean_json(d)


@query("p14_relative_paths", "SELECT page_id, regexp_replace(url, '^https?://[^/]+/?', '') AS path, 'assets/' || regexp_replace(url, '^https?://[^/]+/?', '') AS stored FROM pages")
def relative_paths(spark, sf_dir):
    """Paths made relative and set under another root."""
    p = F.regexp_replace("url", "^https?://[^/]+/?", "")
    return table(spark, sf_dir, "pages").select("page_id", p.alias("path"), F.concat(F.lit("assets/"), p).alias("stored"))


FILLS = "(SELECT p_partkey AS id, left(md5('' || p_partkey), 2) || upper(left(md5('' || p_partkey), 2)) || CASE WHEN p_size % 3 = 0 THEN substr(md5('' || p_partkey), 3, 2) ELSE left(md5('' || p_partkey), 2) END AS fill FROM part) AS inline_rows"


@query("p11_grey_fills", f"SELECT id, lower(fill[1:2]) = lower(fill[3:4]) AND lower(fill[3:4]) = lower(fill[5:6]) AND ('0x' || fill[1:2])::INT >= 160 AS is_grey FROM {FILLS}")
def grey_fills(spark, sf_dir):
    """Fills that are grey: equal parts, light enough."""
    r, g, b = (F.upper(F.substring("fill", i, 2)) for i in (1, 3, 5))
    return derived(spark, sf_dir, FILLS).select("id", ((r == g) & (g == b) & (F.conv(r, 16, 10).cast("int") >= 160)).alias("is_grey"))


MARKS = "(SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'DRAFT ' WHEN 1 THEN 'Confidential: ' WHEN 2 THEN 'Photocopy of ' ELSE '' END || p_name AS txt, p_size AS font, p_partkey % 500 AS width FROM part) AS inline_rows"


@query("s04_watermarks", f"SELECT id, regexp_matches(lower(txt), 'draft|confidential|copy') AND (font > 30 OR width > 0.4 * 600) AS is_watermark FROM {MARKS}")
def watermarks(spark, sf_dir):
    """A watermark has a keyword and is large."""
    return derived(spark, sf_dir, MARKS).select("id", (F.lower("txt").rlike("draft|confidential|copy") & ((F.col("font") > 30) | (F.col("width") > 0.4 * 600))).alias("is_watermark"))


@query("s07_pages_by_breaks", "SELECT doc_id, i, 1 + sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS page FROM (SELECT doc_id, i, i % 5 = 4 AS b FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents))")
def pages_by_breaks(spark, sf_dir):
    """Page numbers as a running count of breaks (S7); every fifth line stands for a break."""
    from pyspark.sql import Window

    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    w = Window.partitionBy("doc_id").orderBy("i")
    return lines.select("doc_id", "i", (1 + F.sum((F.col("i") % 5 == 4).cast("int")).over(w)).alias("page"))


@query("x13_fallback_texts", "SELECT a.conv_id, a.turn, coalesce(b.text, a.text) AS shown, b.text IS NULL AS fell_back FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 2")
def fallback_texts(spark, sf_dir):
    """Substitution with a fallback and what fell back."""
    c = table(spark, sf_dir, "conversations")
    b = c.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("other"))
    return c.join(b, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("other", "text").alias("shown"), F.col("other").isNull().alias("fell_back"))


RULESET = "(SELECT p_partkey AS rule_id, p_brand AS category, CASE p_size % 3 WHEN 0 THEN 'candidate' ELSE 'approved' END AS status, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'table list' WHEN 2 THEN 'figure' ELSE 'text' END AS types FROM part) AS inline_rows"


@query("x07_selected_rules", f"SELECT rule_id FROM {RULESET} WHERE status = 'approved' AND (types = '' OR list_has_any(string_split(types, ' '), ['list', 'text']))")
def selected_rules(spark, sf_dir):
    """Approved rules without content types or with one in common."""
    r = derived(spark, sf_dir, RULESET).where("status = 'approved'")
    return r.where((F.col("types") == "") | F.arrays_overlap(F.split("types", " "), F.array(F.lit("list"), F.lit("text")))).select("rule_id")


@query("x10_check_rollup", "SELECT source, CASE WHEN count(*) FILTER (l.doc_id IS NULL) = 0 THEN 'PASS' WHEN count(*) FILTER (l.doc_id IS NULL) <= 0.6 * count(*) THEN 'WARN' ELSE 'FAIL' END AS verdict FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source")
def check_rollup(spark, sf_dir):
    """PASS, WARN or FAIL by what is missing."""
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("l")).distinct(), "doc_id", "left")
    missing, n = F.count_if(F.col("l").isNull()), F.count("*")
    return both.groupBy("source").agg(F.when(missing == 0, "PASS").when(missing <= 0.6 * n, "WARN").otherwise("FAIL").alias("verdict"))

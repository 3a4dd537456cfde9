"""Queries over trees of pages and documents. The SQL finds parents by comparing levels and paths by recursion."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from folium.functions import text as X
from folium.plans import chunking as C, tree as T
from folium.registry import query, table
from folium.sources import pages as P

_HIDDEN = "(?s)" + "|".join(rf"<{t}\b[^>]*>.*?</{t}>" for t in ("script", "style", "nav", "footer", "header", "aside"))
_PLAIN = r"trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({}, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))".replace('\\"', '"')
#: elements of pages: doc, seq, level, kind, content
PAGE_SQL = f"""
WITH RECURSIVE raw AS (
  SELECT page_id AS doc, unnest(b) AS raw, generate_subscripts(b, 1) AS place FROM (SELECT page_id, regexp_extract_all(regexp_replace(html, '{_HIDDEN}', '', 'g'), '{P.OUTLINE}') AS b FROM pages)
), typed AS (
  SELECT doc, place, CASE WHEN raw LIKE '<p%<br>' THEN 7 WHEN regexp_matches(raw, '^<h[1-6]') THEN raw[3]::INT END AS level, CASE WHEN raw LIKE '<p%' THEN 'paragraph' WHEN raw LIKE '<li%' THEN 'list_item' ELSE 'other' END AS kind, {_PLAIN.format('raw')} AS content FROM raw
), elements AS (
  SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY place) - 1 AS seq, level, CASE WHEN level IS NOT NULL THEN 'heading' ELSE kind END AS kind, content FROM typed WHERE content <> ''
)"""
LINE_SQL = r"""
WITH RECURSIVE lines AS (
  SELECT doc_id AS doc, generate_subscripts(s, 1) AS place, trim(regexp_replace(unnest(s), '\s+', ' ', 'g')) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)
), elements AS (
  SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY place) - 1 AS seq, CASE WHEN n <= 5 THEN n END AS level, CASE WHEN n <= 5 THEN 'heading' ELSE 'paragraph' END AS kind, content
  FROM (SELECT *, len(string_split(content, ' ')) AS n FROM lines WHERE content <> '')
)"""
#: adds heads (seq, path, parent) and numbered (elements with section, ordinal)
TREE_SQL = """, parents AS (
  SELECT a.doc, a.seq, a.level, max(b.seq) AS parent FROM elements a LEFT JOIN elements b ON b.doc = a.doc AND b.seq < a.seq AND b.level < a.level WHERE a.level IS NOT NULL GROUP BY ALL
), ranks AS (
  SELECT *, row_number() OVER (PARTITION BY doc, parent ORDER BY seq) AS n FROM parents
), heads AS (
  SELECT doc, seq, parent, n::VARCHAR AS path FROM ranks WHERE parent IS NULL
  UNION ALL
  SELECT r.doc, r.seq, r.parent, h.path || '.' || r.n FROM ranks r JOIN heads h ON h.doc = r.doc AND h.seq = r.parent
), owned AS (
  SELECT *, max(CASE WHEN level IS NOT NULL THEN seq END) OVER (PARTITION BY doc ORDER BY seq) AS head FROM elements
), numbered AS (
  SELECT o.*, coalesce(h.path, '0') AS section, CASE WHEN o.level IS NOT NULL THEN 0 ELSE row_number() OVER (PARTITION BY o.doc, o.head ORDER BY o.seq) - (o.head IS NOT NULL)::INT END AS ordinal FROM owned o LEFT JOIN heads h ON h.doc = o.doc AND h.seq = o.head
)"""
_CHUNKS = """, own AS (
  SELECT doc, section, head, min(seq) AS first_seq, max(CASE WHEN ordinal = 0 THEN content END) AS heading, max(ordinal) AS n_own,
    string_agg(CASE WHEN ordinal = 0 THEN '# ' WHEN kind = 'list_item' THEN '- ' ELSE '' END || content, chr(10) || chr(10) ORDER BY seq) AS content FROM numbered GROUP BY ALL
), kept AS (SELECT * FROM own WHERE {emit}
), climb AS (
  SELECT k.doc, k.section, h.parent AS up FROM kept k JOIN heads h ON h.doc = k.doc AND h.seq = k.head
  UNION ALL
  SELECT c.doc, c.section, h.parent FROM climb c JOIN heads h ON h.doc = c.doc AND h.seq = c.up WHERE c.up NOT IN (SELECT head FROM kept k WHERE k.doc = c.doc AND head IS NOT NULL)
), above AS (
  SELECT c.doc, c.section, k.section AS parent FROM climb c JOIN kept k ON k.doc = c.doc AND k.head IS NOT DISTINCT FROM c.up
)
SELECT k.doc AS {doc}, k.section, row_number() OVER (PARTITION BY k.doc ORDER BY first_seq) - 1 AS sequence, a.parent, heading,
  CASE WHEN lower(heading) LIKE '%procedure%' OR lower(heading) LIKE '%step%' THEN 'procedure' WHEN lower(heading) LIKE '%reference%' THEN 'reference' WHEN lower(heading) LIKE '%appendix%' THEN 'appendix' ELSE 'section' END AS chunk_type,
  len(list_filter(string_split_regex(k.content, '\\s+'), lambda w: w <> '')) AS n_words, k.content
FROM kept k LEFT JOIN above a ON a.doc = k.doc AND a.section = k.section"""


@query("c01_page_chunks", PAGE_SQL + TREE_SQL + _CHUNKS.format(emit="true", doc="page_id"))
def page_chunks(spark, sf_dir):
    """Chunks of each page's tree of headings and bold leads, with the nearest chunk above."""
    return T.chunks(P.outline(table(spark, sf_dir, "pages")), "page_id").drop("has_table", "has_image")


@query("c01_line_tree_chunks", LINE_SQL + TREE_SQL + _CHUNKS.format(emit="n_own > 0", doc="doc_id"))
def line_tree_chunks(spark, sf_dir):
    """Chunks of a tree up to five deep: short lines of documents as headings. Headings without content give none, and are passed over on the way up."""
    return T.chunks(T.line_elements(table(spark, sf_dir, "documents")), "doc_id", bare=False).drop("has_table", "has_image")


_TYPE = rf"CASE WHEN kind = 'list_item' THEN 'bullet' WHEN regexp_matches(content, '{T.CAPTION}') THEN 'caption' WHEN regexp_matches(content, '{T.WARNING}') THEN 'warning' WHEN regexp_matches(content, '{T.NOTE}') THEN 'note' ELSE 'paragraph' END"


@query("c04_page_units", PAGE_SQL + TREE_SQL + rf""", u AS (
  SELECT doc, section, seq, ordinal, 'S' || section || '-U' || CASE WHEN ordinal < 1000 THEN lpad(ordinal::VARCHAR, 3, '0') ELSE ordinal::VARCHAR END AS unit_id, {_TYPE} AS unit_type, content FROM numbered WHERE ordinal > 0
), near AS (
  SELECT u.*, last_value(CASE WHEN unit_type IN ('paragraph', 'bullet') THEN unit_id END IGNORE NULLS) OVER (PARTITION BY doc, section ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
    first_value(CASE WHEN unit_type IN ('paragraph', 'bullet') THEN unit_id END IGNORE NULLS) OVER (PARTITION BY doc, section ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM u
)
SELECT doc AS page_id, unit_id, section, seq, unit_type, content, CASE WHEN unit_type IN ('warning', 'note') AND coalesce(before, after) IS NOT NULL THEN unit_type || '_for' END AS relation, CASE WHEN unit_type IN ('warning', 'note') THEN coalesce(before, after) END AS target FROM near""")
def page_units(spark, sf_dir):
    """Source units of pages, each word of content in exactly one (C4). The given pages hold no tables or figures; those are tested on fixtures."""
    return T.units(P.outline(table(spark, sf_dir, "pages")), "page_id").drop("table_id", "headers")


@query("c04_word_recall", PAGE_SQL + r" SELECT doc AS page_id, sum(len(string_split(content, ' ')))::BIGINT AS n_words, 1.0::DOUBLE AS recall FROM elements GROUP BY doc")
def word_recall(spark, sf_dir):
    """Share of each page's words that its units and headings hold: 1.0 everywhere."""
    elements = P.outline(table(spark, sf_dir, "pages"))
    n = lambda c: F.sum(F.size(F.split(c, " "))).cast("long")
    held = T.units(elements, "page_id").select("page_id", "content").unionByName(elements.where("level IS NOT NULL").select("page_id", "content")).groupBy("page_id").agg(n("content").alias("held"))
    return elements.groupBy("page_id").agg(n("content").alias("n_words")).join(held, "page_id").select("page_id", "n_words", (F.col("held") / F.col("n_words")).alias("recall"))


_KEPT = "length(content) % 3 <> 0"
_MAP = f""", heading AS (SELECT n.doc, n.seq, n.level, n.section, h.parent, {_KEPT} AS stays FROM numbered n JOIN heads h ON h.doc = n.doc AND h.seq = n.seq WHERE n.ordinal = 0
), parents2 AS (
  SELECT a.doc, a.seq, max(b.seq) AS parent FROM heading a LEFT JOIN heading b ON b.doc = a.doc AND b.seq < a.seq AND b.level < a.level AND b.stays WHERE a.stays GROUP BY ALL
), ranks2 AS (SELECT *, row_number() OVER (PARTITION BY doc, parent ORDER BY seq) AS n FROM parents2
), fresh AS (
  SELECT doc, seq, n::VARCHAR AS number FROM ranks2 WHERE parent IS NULL
  UNION ALL
  SELECT r.doc, r.seq, f.number || '.' || r.n FROM ranks2 r JOIN fresh f ON f.doc = r.doc AND f.seq = r.parent
), climb AS (
  SELECT doc, seq, parent AS up FROM heading WHERE NOT stays
  UNION ALL
  SELECT c.doc, c.seq, h.parent FROM climb c JOIN heading h ON h.doc = c.doc AND h.seq = c.up WHERE NOT h.stays
), map AS (
  SELECT h.doc, h.section, h.seq, f.number, 'exact' AS state FROM heading h JOIN fresh f ON f.doc = h.doc AND f.seq = h.seq
  UNION ALL
  SELECT h.doc, h.section, h.seq, m.number, CASE WHEN m.number IS NULL THEN 'unresolved' ELSE 'merged' END FROM heading h
  LEFT JOIN (SELECT c.doc, c.seq, f.number FROM climb c JOIN fresh f ON f.doc = c.doc AND f.seq = c.up) m ON m.doc = h.doc AND m.seq = h.seq WHERE NOT h.stays
)"""


@query("c12_number_map", LINE_SQL + TREE_SQL + _MAP + " SELECT doc AS doc_id, section, seq, number, state FROM map")
def number_map(spark, sf_dir):
    """Old and new numbers of all headings if some of them go (C12); those go whose length three divides."""
    return T.number_map(T.line_elements(table(spark, sf_dir, "documents")), "doc_id", F.length("content") % 3 != 0)


@query("c12_resolved_references", LINE_SQL + TREE_SQL + _MAP + """, refs AS (
  SELECT doc, seq, lag(section) OVER (PARTITION BY doc ORDER BY seq) AS target, 'see ' || lag(section) OVER (PARTITION BY doc ORDER BY seq) || ', not 1' || lag(section) OVER (PARTITION BY doc ORDER BY seq) AS phrase FROM heading
)
SELECT r.doc AS doc_id, r.seq, r.target, m.number, m.state, CASE WHEN m.number IS NULL THEN phrase ELSE 'see ' || m.number || ', not 1' || r.target END AS shown FROM refs r JOIN map m ON m.doc = r.doc AND m.section = r.target WHERE r.target IS NOT NULL""")
def resolved_references(spark, sf_dir):
    """Each heading refers to the one before it; its phrase shows the new number, whole numbers only."""
    elements = T.line_elements(table(spark, sf_dir, "documents"))
    heads = T.numbered(elements, "doc_id").where("ordinal = 0")
    target = F.lag("section").over(Window.partitionBy("doc_id").orderBy("seq"))
    refs = heads.select("doc_id", "seq", target.alias("target")).where("target IS NOT NULL").withColumn("phrase", F.concat(F.lit("see "), "target", F.lit(", not 1"), "target"))
    return T.resolved(refs, T.number_map(elements, "doc_id", F.length("content") % 3 != 0), "doc_id").drop("phrase")


def _heads(spark, sf_dir):
    """Headings of the tree of lines: doc_id, seq, section (path), up (path of the heading above), title."""
    heads = T.numbered(T.line_elements(table(spark, sf_dir, "documents")), "doc_id").where("ordinal = 0 AND section <> '0'")
    return heads.select("doc_id", "seq", "section", F.when(F.contains("section", F.lit(".")), F.regexp_replace("section", r"\.[0-9]+$", "")).alias("up"), F.col("content").alias("title"))


_TITLED = LINE_SQL + TREE_SQL + ", titled AS (SELECT h.doc, h.seq, h.parent, h.path, e.content AS title FROM heads h JOIN elements e ON e.doc = h.doc AND e.seq = h.seq)"


@query("w11_heading_numbers", _TITLED + " SELECT doc AS doc_id, seq, title, path AS number FROM titled")
def heading_numbers(spark, sf_dir):
    """Counters of any depth; deeper ones restart (W11, S10): short lines of documents as headings of up to five levels."""
    return _heads(spark, sf_dir).select("doc_id", "seq", "title", F.col("section").alias("number"))


@query("w03_heading_parents", _TITLED + " SELECT a.doc AS doc_id, a.seq, a.title, b.title AS parent FROM titled a LEFT JOIN titled b ON b.doc = a.doc AND b.seq = a.parent")
def heading_parents(spark, sf_dir):
    """Nearest heading before of a lower level, any number of levels."""
    heads = _heads(spark, sf_dir)
    above = heads.select("doc_id", F.col("section").alias("up"), F.col("title").alias("parent"))
    return heads.join(above, ["doc_id", "up"], "left").select("doc_id", "seq", "title", "parent")


@query("w24_paths_to_root", _TITLED + """, r AS (
  SELECT doc, seq, path AS section, title AS path FROM titled WHERE parent IS NULL
  UNION ALL
  SELECT t.doc, t.seq, t.path, r.path || ' > ' || t.title FROM titled t JOIN r ON r.doc = t.doc AND r.seq = t.parent
)
SELECT doc || ':' || section AS node_id, path FROM r""")
def paths_to_root(spark, sf_dir):
    """Titles from the root down to each heading (W24); a path's parts double with each join."""
    node = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws(":", "doc_id", c))
    return C.paths_to_root(_heads(spark, sf_dir).select(node("section").alias("node_id"), node("up").alias("parent_id"), "title"))


def _cut(column, pattern):
    return f"coalesce(nullif(regexp_replace({column}, '{pattern}', ''), ''), {column})"


_TITLE = _cut(_cut(_cut("trim(h)", r"^[0-9]+(\.[0-9]+)*[.)]?[ \t]+"), r"^[A-Z][.)][ \t]+"), r"^(Section|Chapter|Appendix) [0-9A-Z]+[:.]?[ \t]+")


@query("f29_headings", _TITLED + f""", n AS (SELECT doc, seq, CASE seq % 4 WHEN 1 THEN 'Section ' || left(path, 1) || ': ' WHEN 2 THEN 'A. ' WHEN 3 THEN 'Appendix B ' ELSE path || ' ' END || title AS h FROM titled)
SELECT doc AS doc_id, seq, {_TITLE} AS title,
 CASE WHEN regexp_matches(lower(h), 'procedure|step|instruction') THEN 'procedure' WHEN regexp_matches(lower(h), 'reference|bibliography') THEN 'reference' WHEN regexp_matches(lower(h), 'appendix|annex') THEN 'appendix' ELSE 'section' END AS kind,
 left(trim(regexp_replace(lower(h), '[^a-z0-9]+', '-', 'g'), '-'), 40) AS slug
FROM n""")
def headings(spark, sf_dir):
    """Titles without numbers, their kind and slug (F29, F31, F33): headings with numbers and names of four forms before them."""
    form, number = F.col("seq") % 4, F.substring("section", 1, 1)
    lead = F.when(form == 1, F.concat(F.lit("Section "), number, F.lit(": "))).when(form == 2, "A. ").when(form == 3, "Appendix B ").otherwise(F.concat("section", F.lit(" ")))
    h = _heads(spark, sf_dir).select("doc_id", "seq", F.concat(lead, "title").alias("h"))
    return h.select("doc_id", "seq", X.without_number("h").alias("title"), X.chunk_type(F.col("h")).alias("kind"), X.slug("h").alias("slug"))


@query("j10_resolved_references", _TITLED + r""", x AS (
  SELECT doc, seq, 'down' AS way, path AS own, path || '.1' AS target, CASE WHEN length(title) % 5 = 0 THEN 'external' ELSE 'section' END AS kind FROM titled
  UNION ALL
  SELECT doc, seq, 'up', path, regexp_replace(path, '\.[0-9]+$', ''), 'section' FROM titled WHERE parent IS NOT NULL
)
SELECT x.doc AS doc_id, x.seq, x.way, s.seq AS target_seq, CASE WHEN kind = 'external' THEN 'external' WHEN s.seq IS NULL THEN 'unresolved' ELSE 'resolved' END AS resolution,
  CASE WHEN s.seq IS NULL THEN NULL WHEN string_split(target, '.')::INT[] > string_split(own, '.')::INT[] THEN 'below' WHEN string_split(target, '.')::INT[] < string_split(own, '.')::INT[] THEN 'above' ELSE 'here' END AS direction
FROM x LEFT JOIN titled s ON kind = 'section' AND s.doc = x.doc AND s.path = x.target""")
def resolved_sections(spark, sf_dir):
    """Cross references to sections, what is unresolved, and where the target lies (J10, J12): each heading refers to its first child and the one above."""
    heads = _heads(spark, sf_dir)
    down = heads.select("doc_id", "seq", F.lit("down").alias("way"), F.col("section").alias("own"), F.concat("section", F.lit(".1")).alias("target"), F.when(F.length("title") % 5 == 0, "external").otherwise("section").alias("kind"))
    up = heads.where("up IS NOT NULL").select("doc_id", "seq", F.lit("up").alias("way"), F.col("section").alias("own"), F.col("up").alias("target"), F.lit("section").alias("kind"))
    known = heads.select("doc_id", F.col("section").alias("target"), F.lit("section").alias("kind"), F.col("seq").alias("target_seq"))
    x = down.unionByName(up).join(known, ["doc_id", "kind", "target"], "left")
    parts = lambda c: F.split(c, "[.]").cast("array<int>")  # noqa: E731  10 comes after 2
    there = F.when(F.col("target_seq").isNotNull(), parts("target"))
    way = F.when(there > parts("own"), "below").when(there < parts("own"), "above").when(there.isNotNull(), "here")
    state = F.when(F.col("kind") == "external", "external").when(F.col("target_seq").isNull(), "unresolved").otherwise("resolved")
    return x.select("doc_id", "seq", "way", "target_seq", state.alias("resolution"), way.alias("direction"))

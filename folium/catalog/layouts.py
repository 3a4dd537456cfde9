"""Queries over page geometry: documents set in pages of a title and two columns. The SQL knows the place of each block from
the text alone, so it states what the operators have to find in the boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.operators import relations as R
from folium.plans import layout as L
from folium.registry import query, table

#: blocks of pages with their boxes
BLOCKS = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(s, 1) - 1 AS seq, unnest(s) AS t FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda t: trim(t) <> '') AS s FROM documents)
), sized AS (
  SELECT doc_id || '-' || seq // {L.PER_PAGE} AS page, seq, CASE WHEN seq % {L.PER_PAGE} = 0 THEN 'title' WHEN seq % {L.PER_PAGE} <= {L.PER_PAGE // 2} THEN 'left' ELSE 'right' END AS col,
    ceil(length(t) / CASE WHEN seq % {L.PER_PAGE} = 0 THEN 80 ELSE 40 END)::INT AS n_rows, 4 + 4 * (length(t) % 2) AS gap, length(t) AS n FROM lines
), b AS (
  SELECT *, 'b' || lpad(seq::VARCHAR, 7, '0') AS box_id, CASE col WHEN 'right' THEN 320 ELSE 50 END AS x0, CASE col WHEN 'title' THEN 550 WHEN 'left' THEN 280 ELSE 550 END AS x1,
    (20 + CASE WHEN col = 'title' THEN 0 ELSE 50 + {L.ROW} * first(n_rows) OVER (PARTITION BY page ORDER BY seq) END + coalesce(sum({L.ROW} * n_rows + gap) OVER (PARTITION BY page, col ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS y0 FROM sized
)"""


def blocks(spark, sf_dir):
    return L.typeset(table(spark, sf_dir, "documents"))


@query("w21_reading_order", BLOCKS + f" SELECT page, box_id, seq % {L.PER_PAGE} + 1 AS place FROM b")
def reading_order(spark, sf_dir):
    """Reading order by XY-cut finds the order in which the blocks of a page were set."""
    return L.reading_order(blocks(spark, sf_dir).select("page", F.lit(L.PAGE_SIZE).alias("page_size"), "box_id", "x0", "y0", "x1", "y1"))


@query("j16_icon_texts", BLOCKS + " SELECT page, 'i' || box_id AS icon_id, box_id AS text_id FROM b WHERE col <> 'title' AND n_rows % 3 = 0")
def icon_texts(spark, sf_dir):
    """Icons and the texts beside them, each text once (J16); an icon stands left of each block whose number of rows three divides."""
    b = blocks(spark, sf_dir)
    texts = b.select("page", F.lit("text").alias("kind"), "box_id", "x0", "y0", "x1", "y1")
    beside = b.where((F.col("col") != "title") & (F.col("n_rows") % 3 == 0))
    icons = beside.select("page", F.lit("icon").alias("kind"), F.concat(F.lit("i"), "box_id").alias("box_id"), (F.col("x0") - 30).alias("x0"), "y0", (F.col("x0") - 10).alias("x1"), (F.col("y0") + 10).alias("y1"))
    return L.icon_texts(texts.unionByName(icons))


@query("s05_box_clusters", BLOCKS + """, g AS (SELECT *, sum(CASE WHEN before > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY page, col ORDER BY seq) AS run FROM (SELECT *, lag(gap) OVER (PARTITION BY page, col ORDER BY seq) AS before FROM b))
SELECT page, box_id, min(box_id) OVER (PARTITION BY page, col, run) AS cluster FROM g""")
def box_clusters(spark, sf_dir):
    """Clusters of boxes that meet within five points (S5): blocks of a column up to a wider space."""
    return L.box_clusters(blocks(spark, sf_dir).select("page", "box_id", "x0", "y0", "x1", "y1"))


@query("j17_points_in_boxes", BLOCKS + " SELECT page, box_id || '.' || unnest(range(n_rows)) AS point_id, box_id FROM b")
def points_in_boxes(spark, sf_dir):
    """The start of each row lies in one block, its own."""
    b = blocks(spark, sf_dir)
    rows = b.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)))
    points = rows.select("page", F.concat_ws(".", "box_id", "r").alias("point_id"), (F.col("x0") + 1).alias("x"), (F.col("y0") + L.ROW * F.col("r") + L.ROW // 2).alias("y"))
    return R.point_in_box(points, b.select("page", "box_id", "x0", "y0", "x1", "y1"))


@query("j18_outermost_boxes", BLOCKS + f" SELECT page, box_id, x0, y0, x1, y0 + {L.ROW} * n_rows AS y1 FROM b")
def outermost_boxes(spark, sf_dir):
    """Of blocks and the rows inside them the blocks (J18); a block of one row and its row are equal boxes."""
    b = blocks(spark, sf_dir)
    rows = b.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1))).withColumn("top", F.col("y0") + L.ROW * F.col("r"))
    rows = rows.select("page", F.concat_ws(".", "box_id", "r").alias("box_id"), "x0", F.col("top").alias("y0"), "x1", (F.col("top") + L.ROW).alias("y1"))
    return R.outermost(b.select("page", "box_id", "x0", "y0", "x1", "y1").unionByName(rows))


@query("a24_box_union", BLOCKS + f" SELECT page, col AS part, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y0 + {L.ROW} * n_rows) AS y1 FROM b GROUP BY page, col")
def box_union(spark, sf_dir):
    """The box around the blocks of each column."""
    b = blocks(spark, sf_dir).withColumnRenamed("col", "part")
    return b.groupBy("page", "part").agg(*[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")])


_TABLES = BLOCKS + f""", t AS (
  SELECT split_part(page, '-', 1)::BIGINT AS doc_id, split_part(page, '-', 2)::INT AS page, 't' || page AS table_id, min(y0) FILTER (col <> 'title') / max(y0 + {L.ROW} * n_rows) AS top, max(y0 + {L.ROW} * n_rows) FILTER (col = 'left') / max(y0 + {L.ROW} * n_rows) AS bottom,
    count(DISTINCT col) AS n_cols, arg_min(n, seq) % 20 AS deviation, arg_min(n, seq) % 2 = 0 AS header_same FROM b GROUP BY b.page
)"""


@query("w10_stitched_tables", _TABLES + """, c AS (
  SELECT *, coalesce(lag(n_cols) OVER w = n_cols AND lag(bottom) OVER w >= 0.75 AND top <= 0.20 AND lag(page) OVER w < page
    AND 40 + CASE WHEN deviation <= 5 THEN 40 WHEN deviation <= 15 THEN 28 WHEN deviation <= 30 THEN 12 END + CASE WHEN header_same THEN 20 ELSE 0 END >= 70, false) AS joins
  FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY page, top)
), r AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page, top) AS run FROM c)
SELECT doc_id, table_id, first(table_id) OVER (PARTITION BY doc_id, run ORDER BY page, top) AS group_id FROM r""")
def stitched_tables(spark, sf_dir):
    """Tables continued over pages (W10): the columns of a page stand for its table, letters of its title for edges and header."""
    b = blocks(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.filter(F.split("text", "\n"), lambda t: F.trim(t) != "")).alias("seq", "t"))
    title = d.where(F.col("seq") % L.PER_PAGE == 0).select(F.concat_ws("-", "doc_id", F.floor(F.col("seq") / L.PER_PAGE)).alias("page"), F.length("t").alias("letters"))
    low = F.max("y1")
    t = b.groupBy("page").agg(
        (F.min(F.when(F.col("col") != "title", F.col("y0"))) / low).alias("top"), (F.max(F.when(F.col("col") == "left", F.col("y1"))) / low).alias("bottom"), F.countDistinct("col").alias("n_cols"),
    ).join(title, "page")
    part = lambda i: F.split_part("page", F.lit("-"), F.lit(i))
    t = t.select(part(1).cast("long").alias("doc_id"), part(2).cast("int").alias("number"), F.concat(F.lit("t"), "page").alias("table_id"), "top", "bottom", "n_cols", (F.col("letters") % 20).alias("deviation"), (F.col("letters") % 2 == 0).alias("header_same"))
    return L.stitched_tables(t.withColumnRenamed("number", "page"))

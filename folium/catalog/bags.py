"""Queries of word bags. The SQL joins all terms and compares every pair."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.operators import bags as B
from folium.registry import query, table

_BAGS = r"""
t AS (SELECT kind, id, w, count(*) AS n FROM (SELECT kind, id, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\pL\pN]+'), lambda x: x <> '')) AS w FROM
  (SELECT 'item' AS kind, item_id AS id, text FROM benchmark UNION ALL SELECT 'doc', doc_id, text FROM documents)) GROUP BY ALL),
s AS (SELECT kind, id, sum(n * n) AS squares FROM t GROUP BY ALL),
p AS (SELECT a.id AS item_id, b.id AS doc_id, sum(a.n * b.n)::BIGINT AS dot FROM t a JOIN t b ON a.w = b.w AND a.kind = 'item' AND b.kind = 'doc' GROUP BY ALL),
c AS (SELECT item_id, doc_id, dot, dot / sqrt(x.squares::DOUBLE * y.squares) AS cosine FROM p JOIN s x ON x.kind = 'item' AND x.id = item_id JOIN s y ON y.kind = 'doc' AND y.id = doc_id)"""
LEAST, SOME = 0.55, 0.3


@query("f18_bag_cosine", f"WITH {_BAGS} SELECT item_id, doc_id, dot, cosine FROM c WHERE cosine >= {LEAST}")
def bag_cosine(spark, sf_dir):
    """Benchmark items and documents whose word bags have a cosine of 0.55 or more."""
    return B.similar(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), LEAST, "item_id", "doc_id")


@query("j19_best_targets", f"""WITH {_BAGS} SELECT * FROM (SELECT doc_id, item_id, row_number() OVER w AS rank, cosine, cosine - coalesce(lead(cosine) OVER w, 0) AS margin FROM c WHERE cosine >= {SOME} WINDOW w AS (PARTITION BY doc_id ORDER BY cosine DESC, item_id)) WHERE rank <= 3""")
def best_targets(spark, sf_dir):
    """The three best items of each document among those of a cosine of 0.3 or more, with margins."""
    return B.best_similar(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), SOME, "doc_id", "item_id")


_TURNS = r"""
t AS (SELECT id, w, count(*) AS n FROM (SELECT conv_id * 1000 + turn AS id, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\pL\pN]+'), lambda x: x <> '')) AS w FROM conversations) GROUP BY ALL),
s AS (SELECT id, sum(n * n) AS squares FROM t GROUP BY ALL),
p AS (SELECT a.id AS a, b.id AS b, sum(a.n * b.n)::BIGINT AS dot FROM t a JOIN t b ON a.w = b.w AND a.id < b.id GROUP BY ALL)"""


@query("f18_similar_turns", f"WITH {_TURNS} SELECT a, b, dot, dot / sqrt(x.squares::DOUBLE * y.squares) AS cosine FROM p JOIN s x ON x.id = a JOIN s y ON y.id = b WHERE dot / sqrt(x.squares::DOUBLE * y.squares) >= 0.8")
def similar_turns(spark, sf_dir):
    """Turns of conversations whose word bags have a cosine of 0.8 or more."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return B.similar_within(turns, 0.8, "id")

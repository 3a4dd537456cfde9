"""Queries over set operations, deduplication and accounting."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from folium.catalog.text import WORDS
from folium.functions import text as T
from folium.operators import sets as S
from folium.registry import inline, query, table, values


@query("u01_union_of_checks", "SELECT 'empty' AS check_name, doc_id FROM documents WHERE length(trim(text)) = 0 UNION ALL SELECT 'oversize', doc_id FROM documents WHERE len(string_split(text, ' ')) > 1500 UNION ALL SELECT 'one line', doc_id FROM documents WHERE strpos(text, chr(10)) = 0")
def union_of_checks(spark, sf_dir):
    """Check results in one list."""
    d = table(spark, sf_dir, "documents")
    checks = {"empty": F.length(F.trim("text")) == 0, "oversize": F.size(F.split("text", " ")) > 1500, "one line": F.instr("text", "\n") == 0}
    parts = [F.when(c, F.lit(n)) for n, c in checks.items()]
    return d.select(F.explode(F.array_compact(F.array(*parts))).alias("check_name"), "doc_id")


@query("u02_keep_last", "SELECT md5(text) AS issue, max(doc_id) AS doc_id FROM documents GROUP BY text")
def keep_last(spark, sf_dir):
    return S.keep_last(table(spark, sf_dir, "documents").select(F.md5("text").alias("issue"), "doc_id"), "issue", F.desc("doc_id"))


@query("u03_ordered_distinct", "SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS kinds FROM (SELECT user_id, event_type, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL) GROUP BY user_id")
def ordered_distinct(spark, sf_dir):
    """Distinct values in order of first appearance."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    return e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "event_type"))), lambda x: x["event_type"]), ">").alias("kinds"))


@query("u04_multiset_difference", f"""
WITH a AS (SELECT conv_id, w, count(*) AS n FROM (SELECT conv_id, unnest({WORDS}) AS w FROM conversations WHERE role = 'user') GROUP BY ALL), b AS (SELECT conv_id, w, count(*) AS n FROM (SELECT conv_id, unnest({WORDS}) AS w FROM conversations WHERE role <> 'user') GROUP BY ALL)
SELECT a.conv_id, a.w, a.n - coalesce(b.n, 0) AS n FROM a LEFT JOIN b ON a.conv_id = b.conv_id AND a.w = b.w WHERE a.n > coalesce(b.n, 0)""")
def multiset_difference(spark, sf_dir):
    """Words that one side has more often (U4)."""
    w = table(spark, sf_dir, "conversations").select("conv_id", "role", F.explode(T.words("text")).alias("w"))
    return S.multiset_difference(w.where("role = 'user'"), w.where("role != 'user'"), ["conv_id"], "w")


RULES = inline("rule_id, category, words", [("r1", "labels", "use approved label before storage"), ("r2", "labels", "use approved labels before storing"), ("r3", "dates", "record the date of each check"), ("r4", "labels", "approved label before use in storage"), ("r5", "dates", "check dates of each record")])
RULE_STEMS = "list_distinct(list_filter(list_transform(string_split(words, ' '), lambda w: CASE WHEN length(w) > 3 AND ends_with(w, 'ies') THEN left(w, length(w) - 3) || 'y' WHEN length(w) > 3 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, length(w) - 1) ELSE w END), lambda w: w NOT IN " + str(T.STOP_WORDS) + "))"


@query("u07_near_duplicate_rules", f"""
WITH s AS (SELECT rule_id, category, {RULE_STEMS} AS s FROM {RULES})
SELECT a.rule_id AS a, b.rule_id AS b, len(list_intersect(a.s, b.s)) AS n_same, len(list_distinct(list_concat(a.s, b.s))) AS n_all FROM s a JOIN s b ON a.category = b.category AND a.rule_id < b.rule_id WHERE len(list_intersect(a.s, b.s)) >= 0.6 * len(list_distinct(list_concat(a.s, b.s)))""")
def near_duplicate_rules(spark, sf_dir):
    """Rules of one category whose stems agree to 0.6 or more."""
    stems = F.array_distinct(F.filter(F.transform(F.split("words", " "), T.stem), lambda w: ~w.isin(*T.STOP_WORDS)))
    r = values(spark, RULES).select("rule_id", "category", stems.alias("s"))
    pairs = r.select(F.col("rule_id").alias("a"), "category", F.col("s").alias("x")).join(r.select(F.col("rule_id").alias("b"), "category", F.col("s").alias("y")), "category").where("a < b")
    pairs = pairs.select("a", "b", F.size(F.array_intersect("x", "y")).alias("n_same"), F.size(F.array_union("x", "y")).alias("n_all"))
    return pairs.where(F.col("n_same") >= 0.6 * F.col("n_all"))


@query("u08_accounting", """
WITH e AS (SELECT doc_id FROM documents), p AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY doc_id)
SELECT coalesce(e.doc_id, p.doc_id) AS doc_id, CASE WHEN e.doc_id IS NULL THEN 'outside scope' WHEN p.n IS NULL THEN 'missing' WHEN p.n > 1 THEN 'placed twice' ELSE 'placed' END AS state, coalesce(p.n, 0) AS n FROM e FULL JOIN p ON e.doc_id = p.doc_id""")
def accounting(spark, sf_dir):
    """Placed, missing, placed twice, outside the scope."""
    labels = table(spark, sf_dir, "labels")
    placed = labels.select("doc_id").union(labels.where("toxic = 1").select("doc_id"))
    return S.accounting(table(spark, sf_dir, "documents"), placed, "doc_id")


ICONS = inline("icon_id, hash, meaning", [(1, 255, "warning"), (2, 254, "caution"), (3, 3840, "note"), (4, 65535, "stop"), (5, 251, None), (6, 3847, None)])


@query("u09_hamming_match", f"SELECT a.icon_id, arg_min(b.meaning, b.icon_id) AS meaning FROM {ICONS.replace('inline_rows', 'a')} JOIN {ICONS.replace('inline_rows', 'b')} ON b.meaning IS NOT NULL AND bit_count(xor(a.hash, b.hash)) <= 5 WHERE a.meaning IS NULL GROUP BY a.icon_id")
def hamming_match(spark, sf_dir):
    """Icons without meaning take that of the first known one within 5 bits (U9); the known ones are few and broadcast."""
    icons = values(spark, ICONS)
    known = icons.where("meaning is not null").select(F.col("icon_id").alias("k"), F.col("hash").alias("h"), F.col("meaning").alias("m"))
    pairs = icons.where("meaning is null").join(F.broadcast(known), F.bit_count(F.col("hash").bitwiseXOR(F.col("h"))) <= 5)
    return pairs.groupBy("icon_id").agg(F.min_by("m", "k").alias("meaning"))


CELLS = "(SELECT page_id AS cell, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS parts FROM pages)"


@query("u06_cell_texts", f"SELECT cell AS page_id, string_agg(x, ' ' ORDER BY nth) AS text FROM (SELECT cell, p, x, min(i) AS nth FROM (SELECT cell, string_split(parts, ' ') AS p, unnest(string_split(parts, ' ')) AS x, generate_subscripts(string_split(parts, ' '), 1) AS i FROM {CELLS}) GROUP BY ALL) WHERE NOT list_any_value(list_filter(p, lambda y: y <> x AND contains(y, x))) IS NOT NULL GROUP BY cell")
def cell_texts(spark, sf_dir):
    """Parts of a text that another part contains are dropped (U6): words of each page's first heading."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.array_distinct(F.split(F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1), " ")).alias("p"))
    kept = F.filter("p", lambda x: ~F.exists("p", lambda y: (y != x) & y.contains(x)))
    return rows.select("page_id", F.array_join(kept, " ").alias("text"))


HITS = """
WITH RECURSIVE w AS (SELECT conv_id || ':' || turn AS doc, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations),
h AS (SELECT doc, i AS s, i + 1 + length(word) % 4 AS e FROM w), k AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY s - e, s) AS nth FROM h)"""


@query("u10_longest_matches", HITS + """, walk AS (
  SELECT doc, nth, [{'s': s, 'e': e}] AS chosen FROM k WHERE nth = 1
  UNION ALL
  SELECT k.doc, k.nth, CASE WHEN len(list_filter(chosen, lambda x: x.s < k.e AND k.s < x.e)) = 0 THEN list_append(chosen, {'s': k.s, 'e': k.e}) ELSE chosen END FROM walk JOIN k ON k.doc = walk.doc AND k.nth = walk.nth + 1
)
SELECT doc, array_to_string(list_transform(list_sort(chosen), lambda x: x.s || '-' || x.e), ',') AS spans FROM (SELECT doc, arg_max(chosen, nth) AS chosen FROM walk GROUP BY doc)""")
def longest_matches(spark, sf_dir):
    """Of overlapping terms the longest first, then those that fit beside it (U10): at each word of a turn a term of one to four words begins."""
    c = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("doc"), F.posexplode(F.split("text", " ")).alias("at", "word"))
    hits = c.select("doc", (F.col("at") + 1).alias("start_at"), (F.col("at") + 2 + F.length("word") % 4).alias("end_at"))
    found = S.longest_matches(hits.withColumn("term", F.concat_ws("-", "start_at", "end_at")), "doc")
    return found.select("doc", F.array_join("terms", ",").alias("spans"))


_GRAMS = """
WITH w AS (SELECT conv_id || ':' || turn AS text_id, string_split(lower(regexp_replace(text, '[.,\n]+', ' ', 'g')), ' ') AS w FROM conversations),
p AS (SELECT DISTINCT text_id, n, array_to_string(w[i:i + n - 1], ' ') AS term FROM (SELECT text_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT text_id, list_filter(w, lambda x: x <> '') AS w, unnest([2, 3]) AS n FROM w)))"""


@query("u11_absorbed_phrases", _GRAMS + """, c AS (SELECT term, count(*) AS n FROM p GROUP BY term)
SELECT a.term AS short, b.term AS long, c.n AS n_short, count(*) AS n_both FROM p a JOIN p b ON a.text_id = b.text_id AND a.n = 2 AND b.n = 3 AND (starts_with(b.term, a.term || ' ') OR ends_with(b.term, ' ' || a.term)) JOIN c ON c.term = a.term
WHERE c.n >= 2 GROUP BY ALL HAVING count(*) >= 0.75 * c.n""")
def absorbed_phrases(spark, sf_dir):
    """A phrase of two words that two or more texts hold yields to a longer one that covers 75% of them (U11). A long phrase gives its own parts, so phrases of a text are not paired."""
    words = F.filter(F.split(F.lower(F.regexp_replace("text", r"[.,\n]+", " ")), " "), lambda x: x != "")
    w = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("text_id"), words.alias("w"))
    runs = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, F.lit(n)), " ")))
    n = w.select("text_id", F.explode(F.array_distinct(runs(2))).alias("short")).groupBy("short").agg(F.count("*").alias("n_short")).where("n_short >= 2")
    long = w.select("text_id", F.explode(F.array_distinct(runs(3))).alias("long"))
    parts = F.array_distinct(F.array(F.substring_index("long", " ", 2), F.substring_index("long", " ", -2)))
    both = long.select("long", F.explode(parts).alias("short")).groupBy("short", "long").agg(F.count("*").alias("n_both"))
    return both.join(n, "short").where(F.col("n_both") >= 0.75 * F.col("n_short")).select("short", "long", "n_short", "n_both")


@query("u12_intersect_except", "SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS both_, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS only_docs")
def intersect_except(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return d.intersect(l).agg(F.count("*").alias("both_")).join(F.broadcast(d.exceptAll(l.distinct()).distinct().agg(F.count("*").alias("only_docs"))), how="inner")

"""Queries over aggregations: counts with zero rows, coverage, term frequencies, spellings, progress."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from folium.catalog.text import WORDS
from folium.functions import text as T
from folium.operators import ordered as O, sets as S, terms
from folium.registry import derived, query, table


@query("a01_node_counts", r"""
SELECT page_id, len(regexp_extract_all(html, '<h[1-6][^>]*>')) AS headings, len(regexp_extract_all(html, '<li[^>]*>')) AS list_items, len(regexp_extract_all(html, '<p[^>]*>')) AS paragraphs, len(regexp_extract_all(html, '<a [^>]*>')) AS links FROM pages""")
def node_counts(spark, sf_dir):
    """Counts of nodes by type (A1)."""
    count = lambda p: F.regexp_count("html", F.lit(p))
    return table(spark, sf_dir, "pages").select("page_id", count("<h[1-6][^>]*>").alias("headings"), count("<li[^>]*>").alias("list_items"), count("<p[^>]*>").alias("paragraphs"), count("<a [^>]*>").alias("links"))


@query("a04_sibling_counts", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def sibling_counts(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"))


@query("a05_batch_progress", """
SELECT c_custkey, count(o_orderkey) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'P') AS failed,
 CASE WHEN count(o_orderkey) = 0 THEN 100 ELSE floor(avg(CASE o_orderstatus WHEN 'O' THEN 40 ELSE 100 END))::BIGINT END AS progress,
 CASE WHEN count(*) FILTER (o_orderstatus = 'O') > 0 THEN 'RUNNING' WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def batch_progress(spark, sf_dir):
    """Progress of batches: whole percent, 100 when empty, failed only once all have ended (A5); orders stand for jobs."""
    status = F.col("o_orderstatus")
    both = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return both.groupBy("c_custkey").agg(
        F.count("o_orderkey").alias("total"), F.count_if(status == "F").alias("completed"), F.count_if(status == "P").alias("failed"),
        F.when(F.count("o_orderkey") == 0, 100).otherwise(F.floor(F.avg(F.when(status == "O", 40).otherwise(100)))).cast("long").alias("progress"),
        F.when(F.count_if(status == "O") > 0, "RUNNING").when(F.count_if(status == "P") > 0, "FAILED").otherwise("COMPLETED").alias("status"),
    )


ISSUES = "(SELECT 'i' || d.doc_id AS issue_id, CASE WHEN d.n_chars % 7 > 0 THEN d.source END AS gate, 1 + l.toxic + 2 * (1 - l.quality) AS severity, d.n_chars % 3 = 0 AS resolved FROM documents d JOIN labels l ON l.doc_id = d.doc_id) AS inline_rows"
GATES = "(SELECT DISTINCT source AS gate FROM documents) AS inline_rows"


@query("a06_gate_counts", f"SELECT g.gate, count(i.issue_id) AS n_open FROM {GATES.replace('inline_rows', 'g')} LEFT JOIN {ISSUES.replace('inline_rows', 'i')} ON i.gate = g.gate AND NOT i.resolved GROUP BY g.gate")
def gate_counts(spark, sf_dir):
    """Open issues of every gate, zero ones too."""
    issues = derived(spark, sf_dir, ISSUES).where("not resolved")
    return derived(spark, sf_dir, GATES).join(issues, "gate", "left").groupBy("gate").agg(F.count("issue_id").alias("n_open"))


@query("a26_worst_open", f"SELECT o.gate, coalesce(max(CASE WHEN NOT resolved THEN severity END), -1) AS worst FROM {GATES.replace('inline_rows', 'o')} LEFT JOIN {ISSUES.replace('inline_rows', 'i')} ON i.gate = o.gate GROUP BY o.gate")
def worst_open(spark, sf_dir):
    """Greatest severity of open issues, -1 without any."""
    both = derived(spark, sf_dir, GATES).join(derived(spark, sf_dir, ISSUES), "gate", "left")
    return both.groupBy("gate").agg(F.coalesce(F.max(F.when(~F.col("resolved"), F.col("severity"))), F.lit(-1)).alias("worst"))


@query("t04_issue_order", f"SELECT issue_id, row_number() OVER (ORDER BY resolved, CASE WHEN gate IS NULL THEN 1 ELSE 0 END, severity DESC, issue_id) AS place FROM {ISSUES}")
def issue_order(spark, sf_dir):
    """Open first, without gate last, worst first (T4)."""
    issues = derived(spark, sf_dir, ISSUES).withColumn("loose", F.col("gate").isNull())
    return O.places(issues, "resolved", "loose", F.desc("severity"), "issue_id").select("issue_id", "place")


@query("a07_label_coverage", "SELECT source, count(*) AS total, count(l.doc_id) AS covered, CASE WHEN count(*) = 0 THEN 1.0 ELSE count(l.doc_id) / count(*) END AS ratio FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source")
def label_coverage(spark, sf_dir):
    """Covered share of each source, 1 when empty."""
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("l")).distinct(), "doc_id", "left")
    out = both.groupBy("source").agg(F.count("*").alias("total"), F.count("l").alias("covered"))
    return out.withColumn("ratio", S.covered_ratio(F.col("covered"), F.col("total")))


@query("a09_label_profile", "SELECT source, floor(1000 * avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END)) AS good_1000, floor(1000 * avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END)) AS toxic_1000, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source")
def label_profile(spark, sf_dir):
    """Mean label weights of a group."""
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    share = lambda c: F.floor(1000 * F.avg(F.when(F.col(c) == 1, 1.0).otherwise(0.0))).cast("double")
    return both.groupBy("source").agg(share("quality").alias("good_1000"), share("toxic").alias("toxic_1000"), F.count("*").alias("n"))


@query("a12_term_frequency", """
WITH t AS (SELECT DISTINCT text FROM conversations), w AS (SELECT text, string_split(lower(trim(regexp_replace(text, '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g'))), ' ') AS w FROM t),
g AS (SELECT text, n, array_to_string(w[i : i + n - 1], ' ') AS term FROM (SELECT text, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT unnest([2, 3, 4]) AS n)))
SELECT term, n, count(DISTINCT text) AS n_texts FROM g GROUP BY term, n HAVING count(DISTINCT text) >= 3""")
def term_frequency(spark, sf_dir):
    """Runs of 2 to 4 words in three or more distinct texts."""
    t = table(spark, sf_dir, "conversations").select("text").distinct()
    return terms.frequent_runs(t, F.array(F.split(T.normal("text"), " ")))


@query("a13_usual_spelling", "SELECT k AS term, arg_max(w, (n, w)) AS spelling, max(n) AS n FROM (SELECT lower(w) AS k, w, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> '' GROUP BY ALL) GROUP BY k HAVING sum(n) >= 20")
def usual_spelling(spark, sf_dir):
    """Most frequent spelling of each term."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("w")).where("w != ''")
    n = w.groupBy(F.lower("w").alias("term"), "w").agg(F.count("*").alias("n"))
    return n.groupBy("term").agg(F.max_by("w", F.struct("n", "w")).alias("spelling"), F.max("n").alias("n"), F.sum("n").alias("_all")).where("_all >= 20").drop("_all")


@query("a14_distinct_texts", "SELECT md5(text) AS text_md5, min(conv_id * 1000 + turn) AS first_place, count(*) AS n FROM conversations GROUP BY text")
def distinct_texts(spark, sf_dir):
    """Segments grouped by text, in order of first appearance."""
    return table(spark, sf_dir, "conversations").groupBy("text").agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("first_place"), F.count("*").alias("n")).select(F.md5("text").alias("text_md5"), "first_place", "n")


@query("a15_word_recall", f"""
WITH w AS (SELECT item_id, unnest({WORDS}) AS w FROM benchmark), v AS (SELECT DISTINCT unnest({WORDS}) AS w FROM documents)
SELECT item_id, count(*) AS n_words, count(*) FILTER (v.w IS NULL) AS n_missing, CASE WHEN count(*) = 0 THEN 1.0 ELSE 1 - count(*) FILTER (v.w IS NULL) / count(*) END AS recall FROM w LEFT JOIN v USING (w) GROUP BY item_id""")
def word_recall(spark, sf_dir):
    """Share of an item's words that the export holds."""
    w = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.words("text")).alias("w"))
    v = table(spark, sf_dir, "documents").select(F.explode(T.words("text")).alias("w")).distinct().withColumn("known", F.lit(1))
    out = w.join(v, "w", "left").groupBy("item_id").agg(F.count("*").alias("n_words"), F.count_if(F.col("known").isNull()).alias("n_missing"))
    return out.withColumn("recall", F.when(F.col("n_words") == 0, 1.0).otherwise(1 - F.col("n_missing") / F.col("n_words")))


@query("a18_type_counts", "SELECT user_id, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) AS n FROM events GROUP BY user_id")
def type_counts(spark, sf_dir):
    """Counts by type as columns."""
    is_ = lambda t: F.count_if(F.col("event_type") == t).alias(t)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(is_("view"), is_("click"), is_("purchase"), F.count("*").alias("n"))


@query("a20_duplicate_numbers", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_numbers(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("a21_readiness", "SELECT o_orderpriority, max(CASE o_orderstatus WHEN 'P' THEN 2 WHEN 'O' THEN 1 ELSE 0 END) AS worst, count(*) AS n FROM orders GROUP BY o_orderpriority")
def readiness(spark, sf_dir):
    """Worst status of each group."""
    rank = F.when(F.col("o_orderstatus") == "P", 2).when(F.col("o_orderstatus") == "O", 1).otherwise(0)
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.max(rank).alias("worst"), F.count("*").alias("n"))


@query("a22_longer_words", r"SELECT length(w) AS len, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{8,}')) AS w FROM documents) GROUP BY 1")
def longer_words(spark, sf_dir):
    """Histogram of long words."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ÿ]{8,}"), F.lit(0))).alias("w"))
    return w.groupBy(F.length("w").alias("len")).agg(F.count("*").alias("n"))


@query("a25_manifest", "SELECT md5(html) AS asset, min(page_id) AS first_page, max(length(html)) AS size, count(*) AS n FROM pages GROUP BY md5(html)")
def manifest(spark, sf_dir):
    """Distinct assets with size and hash."""
    return table(spark, sf_dir, "pages").groupBy(F.md5("html").alias("asset")).agg(F.min("page_id").alias("first_page"), F.max(F.length("html")).alias("size"), F.count("*").alias("n"))


_LINES = "generate_subscripts(s, 1) - 1 AS i, unnest(s) AS line FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda t: trim(t) <> '') AS s FROM documents)"


@query("a03_running_texts", f"""
WITH l AS (SELECT doc_id, i // 10 AS page, i, regexp_replace(lower(trim(regexp_replace(line, '[ \\t]+', ' ', 'g'))), '[0-9]+', '#', 'g') AS t FROM (SELECT doc_id, {_LINES})),
z AS (SELECT *, i IN (min(i) OVER w, max(i) OVER w) AS edge, max(page) OVER (PARTITION BY doc_id) + 1 AS pages FROM l WINDOW w AS (PARTITION BY doc_id, page))
SELECT doc_id, t, count(DISTINCT page) AS n_pages FROM z WHERE edge AND pages > 1 GROUP BY doc_id, t, pages HAVING count(DISTINCT page) >= greatest(2, pages // 2)""")
def running_texts(spark, sf_dir):
    """Header and footer texts: at page edges, on max(2, half) of the pages (A3, P9); ten lines that are not blank are a page."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.filter(F.split("text", "\n"), lambda t: F.trim(t) != "")).alias("i", "line")).withColumn("page", F.floor(F.col("i") / 10))
    w = Window.partitionBy("doc_id", "page")
    lines = lines.select("doc_id", "page", F.regexp_replace(T.normal("line"), "[0-9]+", "#").alias("t"), ((F.col("i") == F.min("i").over(w)) | (F.col("i") == F.max("i").over(w))).alias("edge"))
    pages = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("pages")).where("pages > 1")
    found = lines.where("edge").groupBy("doc_id", "t").agg(F.countDistinct("page").alias("n_pages")).join(pages, "doc_id")
    return found.where(F.col("n_pages") >= F.greatest(F.lit(2), F.floor(F.col("pages") / 2))).drop("pages")


_ABBR = "array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1])), '') || p_type[1]"


@query("a19_abbreviations", f"SELECT abbr, count(DISTINCT full_term) > 1 AS conflict, min(pos) AS first_use, min(CASE WHEN full_term IS NOT NULL THEN pos END) AS first_spelled, count(full_term) = 0 AS is_undefined FROM (SELECT p_partkey AS pos, {_ABBR} AS abbr, CASE WHEN p_size % 3 <> 0 THEN p_name || ' ' || p_type END AS full_term FROM part) GROUP BY abbr")
def abbreviations(spark, sf_dir):
    """Conflicting and undefined abbreviations, first use and first spelling (A19): part names by their initials, not spelled out at each third size."""
    initials = F.array_join(F.transform(F.split(F.concat_ws(" ", "p_name", "p_type"), " "), lambda x: F.upper(F.substring(x, 1, 1))), "")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), initials.alias("abbr"), F.when(F.col("p_size") % 3 != 0, F.concat_ws(" ", "p_name", "p_type")).alias("full_term"))
    return p.groupBy("abbr").agg((F.countDistinct("full_term") > 1).alias("conflict"), F.min("pos").alias("first_use"), F.min(F.when(F.col("full_term").isNotNull(), F.col("pos"))).alias("first_spelled"), (F.count("full_term") == 0).alias("is_undefined"))


@query("a23_usage_sums", "SELECT event_type, count(props) AS n, sum(length(props)) AS chars, floor(sum(value)) AS value FROM events GROUP BY event_type")
def usage_sums(spark, sf_dir):
    """Usage by stage."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("props").alias("n"), F.sum(F.length("props")).alias("chars"), F.floor(F.sum("value")).cast("double").alias("value"))

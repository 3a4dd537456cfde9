"""Queries over ordered neighbours and running state."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from folium.operators import ordered as O
from folium.registry import query, table


@query("w01_latest_order", "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_order(spark, sf_dir):
    """Latest version of each record (W1); customers' orders stand for versions."""
    return O.latest(table(spark, sf_dir, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderdate")


@query("w02_latest_finished", "SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderstatus = 'F') WHERE n = 1")
def latest_finished(spark, sf_dir):
    """Latest approved record of each kind."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return O.latest(done, ["o_orderpriority"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_orderpriority", "o_orderkey")


@query("a02_next_version", "SELECT c_custkey, coalesce(max(n), 0) + 1 AS next_version FROM customer LEFT JOIN (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) ON o_custkey = c_custkey GROUP BY c_custkey")
def next_version(spark, sf_dir):
    """Next version number of each record, 1 without any (A2)."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    versions = table(spark, sf_dir, "orders").select("o_custkey", n.alias("n"))
    return O.next_version(table(spark, sf_dir, "customer").join(versions, F.col("o_custkey") == F.col("c_custkey"), "left"), ["c_custkey"], "n")


@query("w04_merged_continuations", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
r AS (SELECT *, sum(CASE WHEN i = 1 OR NOT regexp_matches(t, '^[a-zà-ÿ,);\\]-]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS para FROM l)
SELECT doc_id, para::BIGINT AS para, string_agg(t, ' ' ORDER BY i) AS text, count(*) AS n_lines FROM r GROUP BY doc_id, para""")
def merged_continuations(spark, sf_dir):
    """Lines that carry on join the paragraph before."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    return O.merged_continuations(lines, ["doc_id"], "i", "t")


@query("w05_event_runs", """
WITH c AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS s FROM events),
r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM c)
SELECT user_id, run::BIGINT AS run, min(event_type) AS event_type, count(*) AS n, min(event_id) AS first_event FROM r GROUP BY user_id, run""")
def event_runs(spark, sf_dir):
    """Consecutive rows of one kind form one list."""
    runs = O.islands(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], O.changes("event_type", ["user_id"], ["ts", "event_id"]), "run")
    return runs.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("w13_out_of_order", "SELECT l_orderkey, l_linenumber, l_partkey, m AS highest_before FROM (SELECT *, max(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM lineitem) WHERE l_partkey < m")
def out_of_order(spark, sf_dir):
    """Rows whose position is below the greatest before (W13); part keys along an order's lines stand for positions."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    return O.out_of_order(lines, ["l_orderkey"], ["l_linenumber", "l_suppkey", "l_partkey"], "l_partkey").drop("l_suppkey")


@query("w19_running_number", "SELECT o_custkey, o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS never_less FROM orders")
def running_number(spark, sf_dir):
    """A value that never decreases along an order."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.max("o_totalprice").over(w).alias("never_less"))


@query("w20_first_use", "SELECT user_id, event_type, min(ts) AS first_ts, arg_min(event_id, (ts, event_id)) AS first_event FROM events GROUP BY user_id, event_type")
def first_use(spark, sf_dir):
    """Where each term is first used (W20); event types stand for terms."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", "event_type").agg(F.min("ts").alias("first_ts"), F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"))


@query("w22_duplicate_number", "SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS nth, count(*) OVER (PARTITION BY text) AS of_all FROM documents")
def duplicate_number(spark, sf_dir):
    w = Window.partitionBy("_key")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("_key")).select("doc_id", F.row_number().over(w.orderBy("doc_id")).alias("nth"), F.count("*").over(w).alias("of_all"))


@query("w23_status_changes", "SELECT event_id, user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_status, event_type AS to_status FROM events")
def status_changes(spark, sf_dir):
    """Each event with the status before it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.lag("event_type").over(w).alias("from_status"), F.col("event_type").alias("to_status"))


@query("j15_nearest_content", """
SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
 first_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS near_turn FROM conversations""")
def nearest_content(spark, sf_dir):
    """Nearest content before, else after (J15); user turns stand for content."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", O.nearest_content(c, ["conv_id"], "turn", "turn", F.col("role") == "user").alias("near_turn"))


@query("j14_adjacent", "SELECT conv_id, turn, CASE WHEN lag(role) OVER w = 'user' THEN lag(turn) OVER w WHEN lead(role) OVER w = 'user' THEN lead(turn) OVER w END AS beside FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def adjacent(spark, sf_dir):
    """The neighbour before, else after, if it is of the wanted kind."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    side = lambda f: F.when(f("role").over(w) == "user", f("turn").over(w))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(side(F.lag), side(F.lead)).alias("beside"))


@query("t01_paging", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 20 OFFSET 40")
def paging(spark, sf_dir):
    return O.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), [F.desc("o_orderkey")], 20, 40)


@query("t02_stable_paging", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25")
def stable_paging(spark, sf_dir):
    return O.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 25)


@query("t03_ready_by_name", "SELECT p_name, p_partkey FROM part WHERE p_size >= 25 ORDER BY p_name, p_partkey DESC LIMIT 30")
def ready_by_name(spark, sf_dir):
    return O.page(table(spark, sf_dir, "part").where("p_size >= 25").select("p_name", "p_partkey"), [F.asc("p_name"), F.desc("p_partkey")], 30)


@query("t05_top_terms", """
SELECT w AS term, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS w FROM documents) WHERE w <> '' GROUP BY w ORDER BY n DESC, w LIMIT 80""")
def top_terms(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), " ")).alias("term")).where("term != ''")
    return w.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(80)


@query("t06_best_and_margin", """
WITH s AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM s)
SELECT user_id, max(event_type) FILTER (k = 1) AS best, max(n) FILTER (k = 1) AS score, max(n) FILTER (k = 1) - coalesce(max(n) FILTER (k = 2), 0) AS margin FROM r WHERE k <= 2 GROUP BY user_id""")
def best_and_margin(spark, sf_dir):
    """Best candidate and its lead over the second."""
    return O.best_and_margin(table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")), ["user_id"], "event_type", "n")


@query("t07_first_for_display", "SELECT source, array_to_string(list_sort(list(doc_id))[1:8], ' ') AS first_ids, greatest(count(*) - 8, 0) AS n_more FROM documents GROUP BY source")
def first_for_display(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    shown = F.array_sort(F.collect_list(F.when(F.col("_n") <= 8, F.col("doc_id"))))
    return d.groupBy("source").agg(F.array_join(shown.cast("array<string>"), " ").alias("first_ids"), F.greatest(F.count("*") - 8, F.lit(0)).alias("n_more"))


@query("t08_budgeted_prefix", """
WITH r AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS running FROM conversations), o AS (SELECT *, max(CASE WHEN running > 600 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS over FROM r)
SELECT conv_id, turn, running::BIGINT AS running FROM o WHERE over = 0""")
def budgeted_prefix(spark, sf_dir):
    """Turns before the first that exceeds the budget."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("cost"))
    return O.within_budget(c, ["conv_id"], ["turn"], "cost", 600).drop("cost")


@query("w17_reclaimed_fragments", """
SELECT doc_id, i, CASE WHEN regexp_matches(t, '[.!?:;]$') THEN false ELSE coalesce(regexp_matches(nxt, '^[a-zà-ÿ]'), false) END AS reclaims
FROM (SELECT *, lead(t) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents))""")
def reclaimed_fragments(spark, sf_dir):
    """Lines without an end whose next line begins in lower case."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    after = F.lead("t").over(Window.partitionBy("doc_id").orderBy("i"))
    return lines.select("doc_id", "i", (~F.col("t").rlike("[.!?:;]$") & F.coalesce(after.rlike("^[a-zà-ÿ]"), F.lit(False))).alias("reclaims"))


@query("w14_inherited_labels", """
SELECT conv_id, turn, role, CASE WHEN role <> 'user' THEN last_value(CASE WHEN role = 'user' THEN length(text) % 7 END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) ELSE length(text) % 7 END AS label FROM conversations""")
def inherited_labels(spark, sf_dir):
    """Rows after an intro line take its label until the next intro."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    own = F.length("text") % 7
    intro = F.last(F.when(F.col("role") == "user", own), ignorenulls=True).over(w)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when(F.col("role") != "user", intro).otherwise(own).alias("label"))

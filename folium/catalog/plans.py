"""Queries over chunking, planning, layout and event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.plans import chunking as C, layout as L
from folium.registry import query, table
from folium.streaming import events as E


@query("c01_line_chunks", "SELECT doc_id, i AS seq, length(t) AS n_chars, CASE WHEN trim(t) = '' THEN 'empty' WHEN len(list_filter(string_split_regex(t, '\\s+'), lambda w: w <> '')) > 60 THEN 'oversize' ELSE 'ok' END AS state FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)")
def line_chunks(spark, sf_dir):
    """Chunks with validator flags."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "t"))
    n = F.size(F.filter(F.split("t", r"\s+"), lambda w: w != ""))
    return lines.select("doc_id", "seq", F.length("t").alias("n_chars"), F.when(F.trim("t") == "", "empty").when(n > 60, "oversize").otherwise("ok").alias("state"))


@query("w06_merged_paragraphs")
def merged_paragraphs(spark, sf_dir):
    """Paragraphs merged by a fold over each document's lines."""
    d = table(spark, sf_dir, "documents").withColumn("p", C.merged_paragraphs(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")))
    return d.select("doc_id", F.size("p").alias("n_paragraphs"), F.array_max(F.transform("p", lambda x: F.length(x))).alias("longest"))


@query("w07_topic_parts")
def topic_parts(spark, sf_dir):
    """Parts of each document where adjacent lines share few terms."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    return C.semantic_parts(lines)


@query("c03_chunk_problems", r"SELECT doc_id, CASE WHEN n = 0 THEN 'empty' ELSE 'oversize' END AS problem FROM (SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS n FROM documents) WHERE n = 0 OR n > 1500")
def chunk_problems(spark, sf_dir):
    return C.chunk_problems(table(spark, sf_dir, "documents"), "text").select("doc_id", "problem")


@query("c14_packed_turns", """
WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
r AS (SELECT conv_id, turn, k, cost AS used, 1 AS bin FROM t WHERE k = 1 UNION ALL SELECT t.conv_id, t.turn, t.k, CASE WHEN r.used + t.cost > 500 THEN t.cost ELSE r.used + t.cost END, CASE WHEN r.used + t.cost > 500 THEN r.bin + 1 ELSE r.bin END FROM r JOIN t ON t.conv_id = r.conv_id AND t.k = r.k + 1)
SELECT conv_id, turn, bin FROM r""")
def packed_turns(spark, sf_dir):
    """Turns packed in order under a budget (C14)."""
    blocks = F.array_sort(F.collect_list(F.struct(F.col("turn").alias("id"), F.length("text").alias("cost"))))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(blocks.alias("b")).withColumn("z", F.arrays_zip("b", C.packed(F.col("b"), 500).alias("bin")))
    return c.select("conv_id", F.explode("z").alias("z")).select("conv_id", F.col("z.b.id").alias("turn"), F.col("z.bin").alias("bin"))


@query("c05_section_plan", """
WITH s AS (SELECT user_id, event_type, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS score FROM events GROUP BY user_id, event_type), r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY user_id ORDER BY score DESC, event_type))
SELECT user_id, CASE WHEN score >= 0.30 THEN event_type END AS event_type, score, score - coalesce(second, 0) AS margin, CASE WHEN score < 0.30 THEN 'unresolved' WHEN score - coalesce(second, 0) < 0.25 THEN 'check' ELSE 'mapped' END AS status FROM r WHERE k = 1""")
def section_plan(spark, sf_dir):
    """Best target by score, with what is unresolved or to check (C5); shares of event types stand for scores."""
    from pyspark.sql import Window

    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    s = n.select("user_id", "event_type", (F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))).alias("score"))
    return C.section_plan(s, ("user_id", "event_type"))


@query("x01_plan_kinds", "WITH m AS (SELECT DISTINCT o_custkey AS root, o_orderpriority AS target_id FROM orders), a AS (SELECT target_id, count(*) AS n FROM m GROUP BY 1), b AS (SELECT root, count(*) AS n FROM m GROUP BY 1) SELECT root, target_id, CASE WHEN a.n > 1 THEN 'merge' WHEN b.n > 1 THEN 'split' ELSE 'one-to-one' END AS kind FROM m JOIN a USING (target_id) JOIN b USING (root)")
def plan_kinds(spark, sf_dir):
    """Merge, split and one-to-one mappings."""
    return C.plan_kinds(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("root"), F.col("o_orderpriority").alias("target_id")))


@query("r05_attempts_in_window", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY date_trunc('second', ts) RANGE BETWEEN INTERVAL 15 MINUTES PRECEDING AND CURRENT ROW) AS n_in_window FROM events")
def attempts_in_window(spark, sf_dir):
    """Attempts within 15 minutes before each."""
    return E.attempts_in_window(table(spark, sf_dir, "events"), "user_id").select("event_id", "n_in_window")


@query("r05_rate_limited")
def rate_limited(spark, sf_dir):
    """Allowed and rejected attempts, rejected ones not counted."""
    return E.rate_limited(table(spark, sf_dir, "events"), "user_id", most=2, minutes=600)


@query("r06_lockouts")
def lockouts(spark, sf_dir):
    """Lock after failures in a row."""
    return E.lockouts(table(spark, sf_dir, "events"), "user_id", limit=2, minutes=6000)


INVALID = " OR ".join(f"(f = '{a}' AND event_type NOT IN {b})" for a, b in E.NEXT.items())


@query("r03_invalid_transitions", f"SELECT user_id, event_id, f AS from_status, event_type AS to_status FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events) WHERE {INVALID}")
def invalid_transitions(spark, sf_dir):
    """Status changes that the machine does not allow."""
    return E.invalid_transitions(table(spark, sf_dir, "events"), "user_id")


@query("r02_progress", "SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY user_id")
def progress(spark, sf_dir):
    return E.progress(table(spark, sf_dir, "events"), "user_id")


@query("r10_windowed_counts", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, sf_dir):
    """Counts by day and type through event-time windows."""
    w = E.windowed_counts(table(spark, sf_dir, "events"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("r11_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS s FROM events), r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start_s, count(*) AS n FROM r GROUP BY user_id, k""")
def sessions(spark, sf_dir):
    """Sessions with a gap of six hours."""
    return E.sessions(table(spark, sf_dir, "events"), "user_id").select("user_id", F.col("start_at").cast("long").alias("start_s"), "n")


@query("r08_retained", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 14 DAYS")
def retained(spark, sf_dir):
    """Rows of the last 14 days before a given time."""
    return E.retained(table(spark, sf_dir, "events"), "2024-01-30 00:00:00").select("event_id")

"""Queries that run as streams: the given table is replayed in micro-batches, with state and an idempotent commit."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from folium.registry import query, table
from folium.streaming import guards as G, queue as Q
from folium.streaming.events import NEXT

SLICES = 3
ORDERED = "e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, lag(event_type) OVER w AS expected, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


def _guarded(spark, events, fold, good: tuple[str, ...], ttl_days=None):
    """Main and side output of a guard over events, as committed."""
    folder = Q.new_folder(G.stateful(spark), "guard")
    out = G.guard(Q.replay(events, "ts", SLICES, f"{folder}/in"), fold, "user_id", ttl_days=ttl_days)
    Q.run(out, f"{folder}/out", side=~F.col("outcome").isin(*good), data_only=ttl_days is not None)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema)
    main, side = (Q.committed(spark, f"{folder}/out", schema, at) for at in (False, True))
    return main.withColumn("output", F.lit("main")).unionByName(side.withColumn("output", F.lit("side"))).withColumnRenamed("key", "user_id")


WINDOW = 36_000 * G.SECOND


@query("r05_rate_limit_stream", f"""
WITH RECURSIVE {ORDERED}, r AS (
  SELECT user_id, k, event_id, 'allowed' AS outcome, NULL::BIGINT AS retry_after, [us] AS times FROM e WHERE k = 1
  UNION ALL
  SELECT user_id, k, event_id, CASE WHEN len(t) >= 2 THEN 'rejected' ELSE 'allowed' END, CASE WHEN len(t) >= 2 THEN greatest(1, ({WINDOW} - (us - t[1])) // 1000000) END, CASE WHEN len(t) >= 2 THEN t ELSE list_append(t, us) END
  FROM (SELECT e.user_id, e.k, e.event_id, e.us, list_filter(r.times, lambda x: e.us - x < {WINDOW}) AS t FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))
SELECT user_id, event_id, outcome, retry_after, CASE WHEN outcome = 'allowed' THEN 'main' ELSE 'side' END AS output FROM r""")
def rate_limit_stream(spark, sf_dir):
    """At most two allowed events of a user within ten hours; rejected ones, which do not count, go to the side output with the seconds to wait."""
    return _guarded(spark, table(spark, sf_dir, "events"), G.RateLimit(2, 36_000), ("allowed",))


LOCK = 360_000 * G.SECOND


@query("r06_lockout_stream", f"""
WITH RECURSIVE {ORDERED}, r AS (
  SELECT user_id, k, event_id, 'open' AS outcome, (event_type = 'error')::INT AS failures, NULL::BIGINT AS until FROM e WHERE k = 1
  UNION ALL
  SELECT user_id, k, event_id, CASE WHEN us < until THEN 'locked' WHEN n >= 2 THEN 'lock' ELSE 'open' END, CASE WHEN us < until THEN failures ELSE n END, CASE WHEN us < until THEN until WHEN n >= 2 THEN us + {LOCK} END
  FROM (SELECT e.user_id, e.k, e.event_id, e.us, r.until, r.failures, CASE WHEN e.event_type = 'error' THEN 1 + CASE WHEN r.until IS NULL THEN r.failures ELSE 0 END ELSE 0 END AS n FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))
SELECT user_id, event_id, outcome, failures, CASE WHEN outcome = 'open' THEN 'main' ELSE 'side' END AS output FROM r""")
def lockout_stream(spark, sf_dir):
    """Two failures in a row lock a user for a hundred hours; expiry or success clears the count."""
    return _guarded(spark, table(spark, sf_dir, "events"), G.Lockout(2, 360_000), ("open",))


ALLOWED = " OR ".join(f"(s = '{a}' AND event_type IN ({', '.join(repr(b) for b in to)}))" for a, to in NEXT.items())


@query("r03_compare_and_set_stream", f"""
WITH RECURSIVE {ORDERED}, r AS (
  SELECT user_id, k, event_id, 'applied' AS outcome, NULL::VARCHAR AS from_status, event_type AS to_status, event_type AS status FROM e WHERE k = 1
  UNION ALL
  SELECT user_id, k, event_id, o, s, event_type, CASE WHEN o = 'applied' THEN event_type ELSE s END
  FROM (SELECT *, CASE WHEN expected IS DISTINCT FROM s THEN 'stale' WHEN {ALLOWED} THEN 'applied' ELSE 'invalid' END AS o FROM (SELECT e.*, r.status AS s FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)))
SELECT user_id, event_id, outcome, from_status, to_status, CASE WHEN outcome = 'applied' THEN 'main' ELSE 'side' END AS output FROM r""")
def compare_and_set_stream(spark, sf_dir):
    """Each event sets a user's status, expecting the event before it to have been applied; stale and invalid ones go to the side output."""
    before = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events").withColumn("expected", F.lag("event_type").over(before))
    return _guarded(spark, events, G.Statuses(NEXT), ("applied",), ttl_days=30)


@query("r01_worked_jobs", r"SELECT doc_id, source, CASE WHEN n = 0 THEN 'failed' ELSE 'done' END AS status, n AS n_words FROM (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> '')) AS n FROM documents)")
def worked_jobs(spark, sf_dir):
    """Documents as jobs in a queue, one job file for each third of them, worked off in order of submission; a text without words fails."""
    docs = table(spark, sf_dir, "documents")
    jobs = Q.Queue(spark, Q.new_folder(spark, "queue"), "doc_id long, source string")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(SLICES))
    for i in range(SLICES):
        jobs.submit(docs.where(part == i).select("doc_id", "source"))

    def handle(batch):
        n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
        return batch.join(docs.select("doc_id", n.alias("n_words")), "doc_id").select("doc_id", "source", F.when(F.col("n_words") == 0, "failed").otherwise("done").alias("status"), "n_words")

    jobs.work(handle)
    return jobs.results("doc_id long, source string, status string, n_words int").drop("batch_no")

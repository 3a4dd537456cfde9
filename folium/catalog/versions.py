"""Queries of versioned tables and of the log table."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.registry import query, table
from folium.sources import versions as V
from folium.streaming.queue import new_folder


@query("k03_latest_versions", "SELECT conv_id, turn, role, length(text) AS n_chars, CASE role WHEN 'user' THEN 2 ELSE 1 END AS version FROM conversations WHERE role <> 'user' OR turn > 0")
def latest_versions(spark, sf_dir):
    """Turns by role as versioned artifacts: users' are written twice, then without first turns; the latest versions are checked and read."""
    store = V.Versions(spark, new_folder(spark, "versions"))
    turns = table(spark, sf_dir, "conversations")
    store.write(turns.where("role <> 'user'"), "turns", "others")
    store.write(turns.where("role = 'user'"), "turns", "user")
    number = store.write(turns.where("role = 'user' AND turn > 0"), "turns", "user")
    out = store.read("turns", "others").withColumn("version", F.lit(1)).unionByName(store.read("turns", "user", number).withColumn("version", F.lit(number)))
    return out.select("conv_id", "turn", "role", F.length("text").alias("n_chars"), "version")


@query("k06_log_table", """
SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 2 = 1 THEN json_extract_string(props, '$.k') END AS other
FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-30' - 14""")
def log_table(spark, sf_dir):
    """Events as logs by day: a known extra as a column, others as VARIANT, days before the last fortnight deleted as whole partitions."""
    events = table(spark, sf_dir, "events").withColumn("props", F.when(F.col("event_id") % 2 == 1, F.replace("props", F.lit('"k"'), F.lit('"z"'))).otherwise(F.col("props")))
    folder = f"{new_folder(spark, 'log')}/rows"
    rows = V.log_rows(events, "props", ("k",), F.col("ts"))
    V.append_log(rows, folder)
    V.retain(spark, folder, "2024-01-30")
    kept = spark.read.schema(rows.schema).parquet(folder)
    return kept.select("event_id", F.col("day").cast("string").alias("day"), "k", F.expr("try_variant_get(extra, '$.z', 'string')").alias("other"))

"""Queries over versioned records, numbering, eligibility, find and replace, and translation segments."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from folium.operators import records as R
from folium.registry import derived, query, table


@query("s10_line_numbers", "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, a || '.' || b AS number FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, a ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice) AS b FROM (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS a FROM lineitem))")
def line_numbers(spark, sf_dir):
    """Two levels of counters, the second restarting."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    l = table(spark, sf_dir, "lineitem").withColumn("a", F.dense_rank().over(w))
    b = F.row_number().over(Window.partitionBy("l_orderkey", "a").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice"))
    return l.withColumn("b", b).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.concat_ws(".", F.col("a").cast("string"), F.col("b").cast("string")).alias("number"))


_DIGITS = lambda one, five, ten: str(["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten])


@query("s10_number_forms", f"""
SELECT p_partkey, n, CASE WHEN n BETWEEN 1 AND 3999 THEN repeat('M', n // 1000) || {_DIGITS("C", "D", "M")}[n // 100 % 10 + 1] || {_DIGITS("X", "L", "C")}[n // 10 % 10 + 1] || {_DIGITS("I", "V", "X")}[n % 10 + 1] END AS roman_form,
  CASE WHEN n > 0 THEN repeat(chr((97 + (n - 1) % 26)::INT), (n - 1) // 26 + 1) END AS letter_form FROM (SELECT p_partkey, p_partkey * 7 % 4000 AS n FROM part)""")
def number_forms(spark, sf_dir):
    """Roman and letter forms of list numbers (S10), of numbers from 0 to 3999 spread over the parts."""
    n = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 7 % 4000).cast("int").alias("n"))
    return n.select("p_partkey", "n", R.roman(F.col("n")).alias("roman_form"), R.letter(F.col("n")).alias("letter_form"))


WANTED = "(SELECT o_custkey AS record_id, CASE WHEN max(o_orderkey) % 2 = 0 THEN -1 ELSE min(o_orderkey) END AS version FROM orders GROUP BY o_custkey) AS inline_rows"
RECORDS = "(SELECT o_custkey AS record_id, o_orderkey AS version, CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'draft' ELSE 'approved' END AS status FROM orders) AS inline_rows"


@query("x09_eligible", f"""
SELECT w.record_id, coalesce(w.v, l.last) AS version, CASE WHEN l.last IS NULL THEN 'unknown record' WHEN r.status IS NULL THEN 'unknown version' WHEN r.status NOT IN ('ready', 'approved') THEN 'not ready' END AS reason
FROM (SELECT record_id, CASE WHEN version >= 0 THEN version END AS v FROM {WANTED}) w LEFT JOIN (SELECT record_id, max(version) AS last FROM {RECORDS} GROUP BY 1) l USING (record_id) LEFT JOIN {RECORDS.replace('inline_rows', 'r')} ON r.record_id = w.record_id AND r.version = coalesce(w.v, l.last)""")
def eligible(spark, sf_dir):
    """Latest or named version, and why it cannot be used."""
    wanted = derived(spark, sf_dir, WANTED).withColumn("version", F.when(F.col("version") >= 0, F.col("version")))
    return R.eligible(wanted, derived(spark, sf_dir, RECORDS))


@query("x14_blockers", "SELECT o_orderkey, unnest(list_filter([CASE WHEN o_orderstatus = 'O' THEN 'open' END, CASE WHEN o_totalprice > 400000 THEN 'too large' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' END], lambda x: x IS NOT NULL)) AS blocker FROM orders")
def blockers(spark, sf_dir):
    """All that stands against approval."""
    checks = {"open": F.col("o_orderstatus") == "O", "too large": F.col("o_totalprice") > 400000, "urgent": F.col("o_orderpriority").startswith("1")}
    return R.blockers(checks, table(spark, sf_dir, "orders"), "o_orderkey")


@query("r07_revoked_families", "SELECT user_id AS family, event_id AS token_id, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id) > 15 AS revoked FROM events")
def revoked_families(spark, sf_dir):
    """One misuse revokes the whole family (R7); users with many errors stand for misuse."""
    errors = F.count_if(F.col("event_type") == "error").over(Window.partitionBy("user_id"))
    e = table(spark, sf_dir, "events").withColumn("used_times", F.when(errors > 15, 2).otherwise(1))
    return R.revoked_families(e.select(F.col("user_id").alias("family"), F.col("event_id").alias("token_id"), "used_times"))


@query("r09_retries", "SELECT o_custkey, min(CASE WHEN o_orderstatus = 'F' THEN k END) AS accepted_at, count(*) AS n, CASE WHEN min(CASE WHEN o_orderstatus = 'F' THEN k END) IS NOT NULL THEN 'accepted' WHEN count(*) >= 2 THEN 'verbatim' ELSE 'pending' END AS state FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k <= 2 GROUP BY o_custkey")
def retries(spark, sf_dir):
    """Repair with two attempts at most."""
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    a = table(spark, sf_dir, "orders").select("o_custkey", k.alias("attempt"), (F.col("o_orderstatus") == "F").alias("ok"))
    return R.retried(a, "o_custkey")


@query("c18_find_replace", r"SELECT conv_id, turn, len(regexp_extract_all(text, '\b[Tt]he\b')) AS n, md5(regexp_replace(text, '\b([Tt])he\b', '\1hat', 'g')) AS after_md5 FROM conversations WHERE regexp_matches(text, '\b[Tt]he\b')")
def find_replace(spark, sf_dir):
    """Find and replace with whole words."""
    c = table(spark, sf_dir, "conversations").where(F.col("text").rlike(r"\b[Tt]he\b"))
    return c.select("conv_id", "turn", F.regexp_count("text", F.lit(r"\b[Tt]he\b")).alias("n"), F.md5(F.regexp_replace("text", r"\b([Tt])he\b", "$1hat")).alias("after_md5"))


@query("c15_segments", "SELECT conv_id, turn, kind, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, text ORDER BY turn) AS k, conv_id * 1000 + turn AS o, CASE WHEN role = 'user' THEN 'claim' ELSE 'cell' END AS kind FROM conversations) WHERE k = 1")
def segments(spark, sf_dir):
    """Segments in order, each text of a record once."""
    k = F.row_number().over(Window.partitionBy("conv_id", "text").orderBy("turn"))
    c = table(spark, sf_dir, "conversations").withColumn("k", k).where("k = 1")
    return c.select("conv_id", "turn", F.when(F.col("role") == "user", "claim").otherwise("cell").alias("kind"), F.md5("text").alias("text_md5"))


@query("c11_cascade", """
WITH RECURSIVE u AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem), back AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'),
f AS (SELECT l_orderkey FROM u WHERE l_partkey = 7 UNION SELECT u.l_orderkey FROM f JOIN back USING (l_orderkey) JOIN u ON u.l_suppkey = back.l_suppkey AND u.l_partkey = back.l_partkey)
SELECT l_orderkey FROM f""")
def cascade(spark, sf_dir):
    """What a failure reaches over shared units, to the fixed point (C11); returned parts of a supplier stand for units that pass it on."""
    l = table(spark, sf_dir, "lineitem")
    units = l.select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    passing = l.where("l_returnflag = 'R'").select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    return R.reached(units.where("l_partkey = 7"), units, passing, "l_orderkey", ["l_partkey", "l_suppkey"])


@query("x15_present_sections", "SELECT p_brand, count(*) AS n FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part GROUP BY p_brand HAVING max(p_size) < 50) GROUP BY p_brand")
def present_sections(spark, sf_dir):
    """Sections stay unless optional and without anything accepted."""
    p = table(spark, sf_dir, "part")
    gone = p.groupBy("p_brand").agg(F.max("p_size").alias("m")).where("m < 50").select("p_brand")
    return p.join(gone, "p_brand", "left_anti").groupBy("p_brand").agg(F.count("*").alias("n"))


@query("x18_placeholders", r"SELECT a.conv_id, a.turn, p AS placeholder, CASE WHEN contains(b.text, p) THEN 'medium' ELSE 'high' END AS severity FROM (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+'))) AS p FROM conversations WHERE turn > 0) a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = 0")
def placeholders(spark, sf_dir):
    """Placeholders: high if the source lacks them, else medium (X18); capitalised words stand for placeholders."""
    c = table(spark, sf_dir, "conversations")
    a = c.where("turn > 0").select("conv_id", "turn", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)))).alias("placeholder"))
    b = c.where("turn = 0").select("conv_id", F.col("text").alias("source_text"))
    return a.join(b, "conv_id").select("conv_id", "turn", "placeholder", F.when(F.contains("source_text", "placeholder"), "medium").otherwise("high").alias("severity"))

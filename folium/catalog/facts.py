"""Queries over facts, preservation checks and gates; where the given texts hold none, rows of given tables are written as sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.functions import facts as X, text as T
from folium.operators import quality as Q
from folium.registry import query, table

_WORD = "(" + ", ".join(f"'{w}'" for w in X.NUMBER_WORDS) + ")"
_PRICE = "round(l_extendedprice * 100)::BIGINT"



@query("f10_values", f"""
SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(list_sort([
  'date:' || strftime(l_shipdate, '%Y-%m-%d'), 'duration:' || l_quantity::INT || ' business_day', 'percentage:<=' || round(l_discount * 100)::INT || '%', 'deadline:<=' || (l_linenumber % 12 + 1) || ' week',
  'frequency:' || CASE l_returnflag WHEN 'A' THEN '1/1 year' WHEN 'N' THEN '2/1 week' ELSE '1/' || (l_linenumber + 2) || ' day' END,
  'number:' || {_PRICE} // 100 || CASE WHEN {_PRICE} % 100 = 0 THEN '' WHEN {_PRICE} % 10 = 0 THEN '.' || {_PRICE} % 100 // 10 ELSE '.' || lpad(({_PRICE} % 100)::VARCHAR, 2, '0') END || ' kg'
]), ',') AS found FROM lineitem""")
def fact_values(spark, sf_dir):
    """Values in canonical form, as kind and text (F8, F9, F10). Each line item is written as a sentence; SQL states the facts from its columns."""
    day, word = F.col("l_shipdate"), F.element_at(F.array(*[F.lit(w) for w in X.NUMBER_WORDS]), F.col("l_linenumber") % 12 + 1)
    spelled = F.concat_ws(" ", F.dayofmonth(day), F.element_at(F.array(*[F.lit(m.capitalize()) for m in X.MONTHS]), F.month(day)), F.year(day))
    shown = F.when(F.col("l_linenumber") % 3 == 0, F.date_format(day, "yyyy-MM-dd")).when(F.col("l_linenumber") % 3 == 1, F.date_format(day, "d.M.yyyy")).otherwise(spelled)
    often = F.when(F.col("l_returnflag") == "A", "every 12 months").when(F.col("l_returnflag") == "N", "Twice a week").otherwise(F.concat(F.lit("every "), F.col("l_linenumber") + 2, F.lit(" days")))
    txt = F.concat(
        F.lit("Ship on "), shown, F.lit("; hold for "), F.col("l_quantity").cast("int"), F.lit(" working days. Grant at most "), F.round(F.col("l_discount") * 100).cast("int"), F.lit(" %; reply within "), word,
        F.lit(" weeks, see section 2.4 and table 7; weigh "), F.format_number("l_extendedprice", 2), F.lit(" kg "), often, F.lit("."),
    )
    items = X.with_values(table(spark, sf_dir, "lineitem").withColumn("txt", txt), "txt", "v")
    found = F.transform("v", lambda v: F.concat_ws(":", v["kind"], X.canonical(v["kind"], v["raw"])))
    return items.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(F.array_sort(found), ",").alias("found"))


SENTENCES = {"1": "Operators must wear gloves.", "2": "Gloves must not be reused.", "3": "The file may be archived and should be signed.", "4": "Staff are required to log in; they can never share keys."}


@query("f11_modalities", "SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 'obligation' WHEN '2' THEN 'prohibition' WHEN '3' THEN 'permission recommendation' WHEN '4' THEN 'capability obligation prohibition' ELSE '' END AS modalities FROM orders")
def modality_sets(spark, sf_dir):
    """Modalities of sentences (F11): each order gives one of its priority, the last kind a month that is no modal verb."""
    kind = F.substring("o_orderpriority", 1, 1)
    txt = F.concat_ws(" ", F.lit("Approved in May"), F.year("o_orderdate")).alias("txt")
    for k, sentence in SENTENCES.items():
        txt = F.when(kind == k, F.concat_ws(" ", F.lit(sentence), F.lit("Order"), "o_orderkey")).otherwise(txt)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.array_sort(X.modalities(txt)), " ").alias("modalities"))


@query("f11_modal_documents", r"SELECT doc_id, len(regexp_extract_all(lower(text), '\b(must|shall|should|may|can)\b')) AS n FROM documents")
def modal_documents(spark, sf_dir):
    """Modal verbs in the real table (none are expected there)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count(F.lower("text"), F.lit(r"\b(must|shall|should|may|can)\b")).alias("n"))


@query("f12_names_and_risks", """
SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1])), '') || p_type[1] || '=' || p_name || ' ' || lower(p_type) AS abbr, p_name AS quoted,
  CASE p_size % 4 WHEN 0 THEN 'deviation approval' WHEN 1 THEN 'safety limit record' WHEN 2 THEN 'record' ELSE '' END AS tags, CASE p_size % 3 WHEN 0 THEN 'quality assurance manager' WHEN 1 THEN 'operator' ELSE 'boss' END AS role FROM part""")
def names_and_risks(spark, sf_dir):
    """Abbreviations, quoted names, risk tags and canonical roles (F12, F14, F15, F39): each part is written as a sentence, SQL states what it holds."""
    words = F.concat_ws(" ", "p_name", F.lower("p_type"))
    short = F.array_join(F.transform(F.split(words, " "), lambda x: F.upper(F.substring(x, 1, 1))), "")
    risk = F.when(F.col("p_size") % 4 == 0, "Report each change (XYZQ) unless approved.").when(F.col("p_size") % 4 == 1, "Keep records; toxic waste at most 5 kg.").when(F.col("p_size") % 4 == 2, "Then archive it.").otherwise("It rains.")
    role = F.when(F.col("p_size") % 3 == 0, "the QA managers").when(F.col("p_size") % 3 == 1, "Operators").otherwise("a boss")
    txt = F.concat(F.lit("Use the "), words, F.lit(" ("), short, F.lit('), a "'), F.col("p_name"), F.lit('" of "one". '), risk)
    n = table(spark, sf_dir, "part").select("p_partkey", txt.alias("txt"), role.alias("role_text"))
    abbr = F.array_join(F.transform(X.abbreviations("txt"), lambda x: F.concat_ws("=", x["abbr"], x["full"])), ",")
    return n.select("p_partkey", abbr.alias("abbr"), F.array_join(X.quoted_names("txt"), ",").alias("quoted"), F.array_join(X.risk_tags("txt"), " ").alias("tags"), X.canonical_role("role_text").alias("role"))


SOURCE, DRAFT = (f"(SELECT user_id AS unit, event_type AS kind, floor(value / 100)::INT::VARCHAR AS value FROM events WHERE hour(ts) {side} 12)" for side in ("<", ">="))


@query("c09_preservation", f"""
WITH a AS (SELECT unit, kind, value, count(*) AS n FROM {SOURCE} GROUP BY ALL), b AS (SELECT unit, kind, value, count(*) AS n FROM {DRAFT} GROUP BY ALL),
d AS (SELECT coalesce(a.unit, b.unit) AS unit, coalesce(a.kind, b.kind) AS kind, coalesce(a.value, b.value) AS value, coalesce(a.n, 0) - coalesce(b.n, 0) AS n FROM a FULL JOIN b ON a.unit = b.unit AND a.kind = b.kind AND a.value = b.value),
l AS (SELECT unit, kind, value, row_number() OVER (PARTITION BY unit, kind ORDER BY value) AS k FROM (SELECT unit, kind, value, unnest(range(n)) FROM d WHERE n > 0)),
m AS (SELECT unit, kind, value, row_number() OVER (PARTITION BY unit, kind ORDER BY value) AS k FROM (SELECT unit, kind, value, unnest(range(-n)) FROM d WHERE n < 0))
SELECT coalesce(l.unit, m.unit) AS unit, coalesce(l.kind, m.kind) AS kind, CASE WHEN l.unit IS NULL THEN 'added' WHEN m.unit IS NULL THEN 'missing' ELSE 'changed' END AS change, l.value AS was, m.value AS now
FROM l FULL JOIN m ON l.unit = m.unit AND l.kind = m.kind AND l.k = m.k""")
def preservation(spark, sf_dir):
    """Changed, missing and added values (C9): those of a user's mornings against the afternoons."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("unit"), F.col("event_type").alias("kind"), F.floor(F.col("value") / 100).cast("string").alias("value"), (F.hour("ts") < 12).alias("early"))
    return Q.compare_facts(e.where("early").drop("early"), e.where("not early").drop("early"), "unit")


@query("c09_number_preservation", r"""
WITH n AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[0-9]+')) AS v FROM conversations), a AS (SELECT conv_id, v, count(*) AS n FROM n WHERE turn % 2 = 0 GROUP BY ALL), b AS (SELECT conv_id, v, count(*) AS n FROM n WHERE turn % 2 = 1 GROUP BY ALL)
SELECT count(*) AS n_lost FROM a LEFT JOIN b USING (conv_id, v) WHERE a.n > coalesce(b.n, 0)""")
def number_preservation(spark, sf_dir):
    """Numbers of even turns that odd turns lack, over conversations."""
    n = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("v"))
    count = lambda r: n.where(F.col("turn") % 2 == r).groupBy("conv_id", "v").agg(F.count("*").alias(f"n{r}"))
    return count(0).join(count(1), ["conv_id", "v"], "left").where(F.col("n0") > F.coalesce("n1", F.lit(0))).agg(F.count("*").alias("n_lost"))


@query("c10_final_status", "SELECT source, coalesce(max(CASE WHEN quality = 0 THEN CASE WHEN toxic = 1 THEN 4 ELSE 2 END ELSE toxic END), -1) AS worst, CASE WHEN coalesce(max(CASE WHEN quality = 0 THEN CASE WHEN toxic = 1 THEN 4 ELSE 2 END ELSE toxic END), -1) >= 4 THEN 'blocked' WHEN coalesce(max(CASE WHEN quality = 0 THEN CASE WHEN toxic = 1 THEN 4 ELSE 2 END ELSE toxic END), -1) >= 2 THEN 'review' ELSE 'passed' END AS status FROM documents JOIN labels USING (doc_id) GROUP BY source")
def final_status(spark, sf_dir):
    """Final status of each group from its worst open issue."""
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    severity = F.when(F.col("quality") == 0, F.when(F.col("toxic") == 1, 4).otherwise(2)).otherwise(F.col("toxic"))
    return Q.final_status(both.select("source", severity.alias("severity"), F.lit(False).alias("resolved")), "source")


@query("c16_segment_checks", """
WITH s AS (SELECT a.conv_id, a.turn, a.text AS src, b.text AS tgt FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, c AS code FROM (SELECT conv_id, turn, unnest([CASE WHEN trim(tgt) = '' THEN 'empty' END, CASE WHEN src = tgt THEN 'copied' END, CASE WHEN length(tgt) > 3 * length(src) THEN 'too long' END, CASE WHEN 3 * length(tgt) < length(src) THEN 'too short' END, CASE WHEN regexp_matches(src, '[.!?]$') AND NOT regexp_matches(tgt, '[.!?]$') THEN 'end sign' END]) AS c FROM s) WHERE c IS NOT NULL""")
def segment_checks(spark, sf_dir):
    """Check codes of segments and their targets (C16); successive turns stand for both sides."""
    c = table(spark, sf_dir, "conversations")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tgt"))
    s = c.select("conv_id", "turn", F.col("text").alias("src")).join(b, ["conv_id", "turn"])
    a, t = F.length("src"), F.length("tgt")
    end = lambda x: F.col(x).rlike("[.!?]$")
    codes = (F.when(F.trim("tgt") == "", "empty"), F.when(F.col("src") == F.col("tgt"), "copied"), F.when(t > 3 * a, "too long"), F.when(3 * t < a, "too short"), F.when(end("src") & ~end("tgt"), "end sign"))
    return s.select("conv_id", "turn", F.explode(F.array_compact(F.array(*codes))).alias("code"))


@query("f38_json_details", """SELECT event_id, json_extract_string(props, '$.device') AS device, json_valid(props) AS ok FROM events""")
def json_details(spark, sf_dir):
    """Fields of event details; invalid JSON gives null."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.device").alias("device"), F.expr("try_parse_json(props) is not null").alias("ok"))

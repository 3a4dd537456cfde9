"""Queries over what protects, repairs, scores and carries over: units, segments, claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.registry import derived, query

PROTECTED = "(SELECT conv_id || ':' || turn AS unit_id, CASE turn % 4 WHEN 1 THEN 'Table of  Contents' WHEN 2 THEN split_part(text, ' ', 1) END AS heading, length(text) % 5 = 0 AS boilerplate, CASE WHEN length(text) % 11 = 0 THEN ' ' ELSE text END AS unit_text FROM conversations) AS inline_rows"


@query("p08_protected_units", rf"SELECT unit_id FROM {PROTECTED} WHERE NOT regexp_matches(lower(coalesce(heading, '')), '^\s*(table\s+of\s+contents?|contents)\s*$') AND NOT boilerplate AND trim(unit_text) <> ''")
def protected_units(spark, sf_dir):
    """Units whose facts are protected: no boilerplate, no blank text, no table of contents."""
    contents = F.lower(F.coalesce("heading", F.lit(""))).rlike(r"^\s*(table\s+of\s+contents?|contents)\s*$")
    return derived(spark, sf_dir, PROTECTED).where(~contents & ~F.col("boilerplate") & (F.trim("unit_text") != "")).select("unit_id")


SEGMENTS = "(SELECT conv_id || ':' || turn AS segment_id, CASE length(text) % 5 WHEN 0 THEN 'llm' WHEN 1 THEN 'copied' WHEN 2 THEN 'repair' WHEN 3 THEN 'edited' END AS origin, CASE WHEN length(text) % 7 > 0 THEN text END AS target FROM conversations) AS inline_rows"
ISSUES = "(SELECT conv_id || ':' || (turn + 1) AS segment_id, CASE length(text) % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'blocking' END AS severity, length(text) % 3 = 0 AS resolved FROM conversations) AS inline_rows"


@query("p13_repair_candidates", f"SELECT segment_id FROM {SEGMENTS.replace('inline_rows', 's')} WHERE (origin IS NULL OR origin = 'llm') AND segment_id IN (SELECT segment_id FROM {ISSUES} WHERE NOT resolved AND severity IN ('medium', 'high', 'blocking'))")
def repair_candidates(spark, sf_dir):
    """Segments with an open issue of medium severity or more that have had no retranslation."""
    open_ = derived(spark, sf_dir, ISSUES).where(~F.col("resolved") & F.col("severity").isin("medium", "high", "blocking"))
    return derived(spark, sf_dir, SEGMENTS).where("origin IS NULL OR origin = 'llm'").join(open_, "segment_id", "left_semi").select("segment_id")


@query("a11_translation_scores", f"""
SELECT round(count(target) / greatest(count(*), 1), 4) AS unit_coverage, round((count(target) - sum(CASE WHEN origin = 'copied' THEN 1 ELSE 0 END)) / greatest(count(*), 1), 4) AS translated,
 round(sum(CASE WHEN origin = 'copied' THEN 1 ELSE 0 END) / greatest(count(*), 1), 4) AS copied, round(sum(CASE WHEN origin = 'repair' THEN 1 ELSE 0 END) / greatest(count(*), 1), 4) AS repaired FROM {SEGMENTS}""")
def translation_scores(spark, sf_dir):
    """Shares of segments done, translated, copied and repaired."""
    total, copied = F.greatest(F.count("*"), F.lit(1)), F.count_if(F.col("origin") == "copied")
    share = lambda n, name: F.round(n / total, 4).alias(name)
    return derived(spark, sf_dir, SEGMENTS).agg(share(F.count("target"), "unit_coverage"), share(F.count("target") - copied, "translated"), share(copied, "copied"), share(F.count_if(F.col("origin") == "repair"), "repaired"))


PLACED = "(SELECT l_orderkey AS job_id, CAST(sum(l_quantity) AS INT) - 1 AS total, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END) AS INT) AS placed, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS skipped, sum(CASE WHEN l_quantity < 4 THEN 1 ELSE 0 END) AS blue, sum(CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END) AS loose_headings, sum(CASE WHEN l_discount > 0.09 THEN 1 ELSE 0 END) AS warnings FROM lineitem GROUP BY l_orderkey) AS inline_rows"


@query("a08_content_coverage", f"""
SELECT job_id, pct AS coverage, CASE WHEN blue > 0 THEN 'needs_review' WHEN loose_headings > 0 OR warnings > 0 OR pct < 80 THEN 'pass_with_warnings' ELSE 'pass' END AS status
FROM (SELECT *, round(CASE WHEN total = 0 THEN 100.0 ELSE least(100.0, (placed - skipped) * 100.0 / total) END, 1) AS pct FROM {PLACED})""")
def content_coverage(spark, sf_dir):
    """Placed less skipped content of all, at most 100 %, and the status of a job (A8); without content 100 %."""
    share = F.when(F.col("total") == 0, 100.0).otherwise(F.least(F.lit(100.0), (F.col("placed") - F.col("skipped")) * 100.0 / F.col("total")))
    p = derived(spark, sf_dir, PLACED).withColumn("coverage", F.round(share.cast("double"), 1))
    warned = (F.col("loose_headings") > 0) | (F.col("warnings") > 0) | (F.col("coverage") < 80)
    return p.select("job_id", "coverage", F.when(F.col("blue") > 0, "needs_review").when(warned, "pass_with_warnings").otherwise("pass").alias("status"))


BEFORE = "(SELECT conv_id || ':' || turn AS claim_id, text AS claim_text, role AS units FROM conversations) AS inline_rows"
AFTER = "(SELECT 'n' || conv_id || ':' || turn AS claim_id, text AS claim_text, CASE WHEN length(text) % 9 = 0 THEN 'other' ELSE role END AS units FROM conversations WHERE length(text) % 11 > 0) AS inline_rows"
FINDINGS = "(SELECT conv_id || ':' || (turn % 2) AS finding, conv_id || ':' || turn AS claim_id FROM conversations) AS inline_rows"


@query("j24_carried_findings", f"""
SELECT finding, string_agg(new_id, ',' ORDER BY new_id) AS claims FROM (SELECT f.finding, a.claim_id AS new_id FROM {FINDINGS.replace('inline_rows', 'f')} JOIN {BEFORE.replace('inline_rows', 'b')} ON b.claim_id = f.claim_id
 LEFT JOIN {AFTER.replace('inline_rows', 'a')} ON a.claim_text = b.claim_text AND a.units = b.units) GROUP BY finding HAVING count(*) = count(new_id)""")
def carried_findings(spark, sf_dir):
    """Findings all of whose claims stand unchanged (same text and units) in the next version, under the claims' new ids."""
    signature = F.xxhash64("claim_text", "units").alias("signature")
    before = derived(spark, sf_dir, BEFORE).select("claim_id", signature)
    after = derived(spark, sf_dir, AFTER).select(F.col("claim_id").alias("new_id"), signature)
    moved = derived(spark, sf_dir, FINDINGS).join(before, "claim_id").join(after, "signature", "left").groupBy("finding")
    moved = moved.agg(F.array_join(F.array_sort(F.collect_list("new_id")), ",").alias("claims"), F.count("*").alias("n"), F.count("new_id").alias("moved"))
    return moved.where("n = moved").select("finding", "claims")

"""Validators that give issues of one schema, their gates and final status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def issue_id(check: Column, key: Column) -> Column:
    return F.concat(F.lit("ISS-"), F.substring(F.sha1(F.concat_ws("|", check, key)), 1, 10))


def compare_facts(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Values of two sides (key, kind, value). Within a key and kind, one lost and one new value make 'changed', the rest 'missing' or 'added'.

    Values equal on both sides as often say nothing.
    """
    a = source.groupBy(key, "kind", "value").agg(F.count("*").alias("_a"))
    b = target.groupBy(key, "kind", "value").agg(F.count("*").alias("_b"))
    n = a.join(b, [key, "kind", "value"], "full").select(key, "kind", "value", (F.coalesce("_a", F.lit(0)) - F.coalesce("_b", F.lit(0))).alias("n"))
    repeat = lambda c: F.explode(F.sequence(F.lit(1), c))
    from pyspark.sql import Window

    w = Window.partitionBy(key, "kind").orderBy("value", "_i")
    lost = n.where("n > 0").withColumn("_i", repeat(F.col("n"))).select(key, "kind", F.col("value").alias("was"), F.row_number().over(w).alias("_k"))
    new = n.where("n < 0").withColumn("_i", repeat(-F.col("n"))).select(key, "kind", F.col("value").alias("now"), F.row_number().over(w).alias("_k"))
    both = lost.join(new, [key, "kind", "_k"], "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "missing").otherwise("changed")
    return both.select(key, "kind", change.alias("change"), "was", "now")


def final_status(issues: DataFrame, key: str) -> DataFrame:
    """blocked with an open issue of severity 4, review with one of 3 or 2, else passed."""
    worst = F.coalesce(F.max(F.when(~F.col("resolved"), F.col("severity"))), F.lit(-1))
    return issues.groupBy(key).agg(worst.alias("worst")).withColumn("status", F.when(F.col("worst") >= 4, "blocked").when(F.col("worst") >= 2, "review").otherwise("passed"))


def repairable(issues: DataFrame) -> DataFrame:
    """Open, by a machine, not structural, severe enough."""
    return issues.where((~F.col("resolved")) & (F.coalesce("source", F.lit("")) != "human") & (F.coalesce("gate", F.lit("")) != "structure") & (F.col("severity") >= 3))

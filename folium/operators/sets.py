"""Set and multiset operations, coverage accounting, near duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def multiset_difference(left: DataFrame, right: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Items that left has more often than right, and how many more."""
    a = left.groupBy(*keys, item).agg(F.count("*").alias("_a"))
    b = right.groupBy(*keys, item).agg(F.count("*").alias("_b"))
    return a.join(b, [*keys, item], "left").withColumn("n", F.col("_a") - F.coalesce("_b", F.lit(0))).where("n > 0").select(*keys, item, "n")


def accounting(expected: DataFrame, placed: DataFrame, key: str) -> DataFrame:
    """Each id with its state: placed once, twice or more, missing, or placed without being expected."""
    n = placed.groupBy(key).agg(F.count("*").alias("n"))
    both = expected.select(key, F.lit(True).alias("_e")).join(n, key, "full")
    state = F.when(F.col("_e").isNull(), "outside scope").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "placed twice").otherwise("placed")
    return both.select(key, state.alias("state"), F.coalesce("n", F.lit(0)).alias("n"))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(F.array_union(a, b))
    return F.when(all_ == 0, 0.0).otherwise(both / all_)


def covered_ratio(covered: Column, total: Column) -> Column:
    """covered / total; 1 when there is nothing to cover."""
    return F.when(total == 0, 1.0).otherwise(covered / total)


def keep_last(df: DataFrame, key: str, *order: Column) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def longest_matches(hits: DataFrame, key: str) -> DataFrame:
    """hits: key, term, start_at, end_at (exclusive). key and terms: of overlapping terms the longest first, on a tie the first; those that fit
    beside the chosen ones follow; terms in order of place. A key's hits are one array: give a text or a stretch of one as the key."""
    order = F.array_sort(F.collect_list(F.struct((F.col("start_at") - F.col("end_at")).alias("neg"), "start_at", "end_at", "term")))
    kind = "array<struct<neg:int,start_at:int,end_at:int,term:string>>"
    fits = lambda s, x: ~F.exists(s, lambda t: (x["start_at"] < t["end_at"]) & (t["start_at"] < x["end_at"]))
    chosen = F.aggregate(order.cast(kind), F.array().cast(kind), lambda s, x: F.when(fits(s, x), F.concat(s, F.array(x))).otherwise(s).cast(kind))
    found = hits.groupBy(key).agg(chosen.alias("_c"))
    return found.select(key, F.transform(F.array_sort(F.transform("_c", lambda x: F.struct(x["start_at"], x["term"]))), lambda x: x["term"]).alias("terms"))

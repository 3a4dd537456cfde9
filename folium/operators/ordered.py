"""Ordered neighbours and running state: versions, islands, counters, as-of neighbours, paging, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folium.operators.lineage import settle

NO_LIMIT = (Window.unboundedPreceding, -1)


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def next_version(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"))


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows; starts: whether a row begins a new run."""
    return df.withColumn(name, F.sum(starts.cast("int")).over(Window.partitionBy(*keys).orderBy(*order)))


def changes(column: str, keys: list[str], order: list[str]) -> Column:
    """Whether a value differs from the one before (true on the first row)."""
    before = F.lag(column).over(Window.partitionBy(*keys).orderBy(*order))
    return ~F.coalesce(F.col(column).eqNullSafe(before) & F.lag(F.lit(True)).over(Window.partitionBy(*keys).orderBy(*order)), F.lit(False))


def merged_continuations(lines: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Lines that begin in lower case or with a closing sign join the line before."""
    carries_on = F.col(text).rlike(r"^[a-zà-ÿ,);\]-]")
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) == 1
    runs = islands(lines, keys, [order], ~carries_on | first, "para")
    pieces = F.array_sort(F.collect_list(F.struct(order, text)))
    return runs.groupBy(*keys, "para").agg(F.array_join(F.transform(pieces, lambda p: p[text]), " ").alias("text"), F.count("*").alias("n_lines"))


def out_of_order(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value is below the greatest before them."""
    most = F.max(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*NO_LIMIT))
    return df.withColumn("highest_before", most).where(F.col(value) < F.col("highest_before"))


def nearest_content(df: DataFrame, keys: list[str], order: str, node: str, is_content: Column) -> Column:
    """The nearest content row before, else after, a row."""
    w = Window.partitionBy(*keys).orderBy(order)
    own = F.when(is_content, F.col(node))
    before = F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(own, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return F.coalesce(before, after)


def within_budget(df: DataFrame, keys: list[str], order: list[str], cost: str, budget: float) -> DataFrame:
    """The rows of a key before its first row at which the running cost exceeds the budget."""
    running = F.sum(cost).over(Window.partitionBy(*keys).orderBy(*order))
    over = F.max((running > budget).cast("int")).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumns({"running": running, "_over": over}).where("_over = 0").drop("_over")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def best_and_margin(df: DataFrame, keys: list[str], target: str, score: str) -> DataFrame:
    """Best target of each key, its score and how far the second is behind."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score).desc(), target))).where("_n <= 2")
    return ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("_n") == 1, F.col(target))).alias("best"), F.max(F.when(F.col("_n") == 1, F.col(score))).alias("score"),
        (F.max(F.when(F.col("_n") == 1, F.col(score))) - F.coalesce(F.max(F.when(F.col("_n") == 2, F.col(score))), F.lit(0))).alias("margin"),
    )


def places(rows: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """Rows with their place (from 1) in a total order, without bringing them into one task: ranges of the order are numbered on their own
    and moved on by the counts of those before. Only counts, one for each range, meet in one place. Ties take any order among themselves."""
    ranged = settle(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + own).drop("_range", "_before")

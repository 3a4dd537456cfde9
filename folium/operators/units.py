"""Runs of units and table rows: what a unit takes along from those after it.

Each function reads an order within a group through one window, so a group's rows meet once, sorted; nothing is joined
but lists with their own intros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# fixed values: the unit types that make a list
LIST_TYPES = ("bullet", "procedure_step")


def _filled(text: str) -> Column:
    return F.coalesce(F.trim(text) != "", F.lit(False))


def continued_rows(cells: DataFrame) -> DataFrame:
    """Cells (table_id, row_index, col, text) with a row of empty key (column 0) merged into the row above it.

    Nothing merges into the header (row 0) or into a row without key; the row must hold something else and be as wide
    as the row it continues. Rows may continue in a chain; the first that does not fit ends it.
    """
    row = cells.groupBy("table_id", "row_index").agg(
        F.count("*").alias("width"),
        F.max(_filled("text") & (F.col("col") == 0)).alias("key"),
        F.max(_filled("text") & (F.col("col") > 0)).alias("rest"),
    )
    upto = Window.partitionBy("table_id").orderBy("row_index").rowsBetween(Window.unboundedPreceding, 0)
    base = F.struct("row_index", "width", "key")
    row = row.withColumn("own", F.col("key") | ~F.col("rest") | (F.col("row_index") == 0))
    row = row.withColumn("base", F.last(F.when(F.col("own"), base), ignorenulls=True).over(upto))
    chain = Window.partitionBy("table_id", "base").orderBy("row_index").rowsBetween(Window.unboundedPreceding, 0)
    row = row.withColumn("fits", F.min(F.col("width") == F.col("base.width")).over(chain))
    joins = ~F.col("own") & F.col("fits") & F.col("base.key") & (F.col("base.row_index") > 0)
    row = row.select("table_id", "row_index", F.when(joins, F.col("base.row_index")).otherwise(F.col("row_index")).alias("into"))
    part = F.when(_filled("text"), F.struct("row_index", F.trim("text").alias("text")))
    merged = cells.join(row, ["table_id", "row_index"]).groupBy("table_id", F.col("into").alias("row_index"), "col").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return merged.select("table_id", "row_index", "col", F.array_join(F.col("parts.text"), " ").alias("text"))


def icon_rows(units: DataFrame) -> DataFrame:
    """Units (section, seq, unit_type, text, icon) with `head`: the icon unit whose label lines they are, or themselves.

    A label line is a paragraph or bullet of 1 to 80 characters without icon that does not end in . : or ;
    Spaces of any kind around it do not count; a line feed at its end does, so what stands before that is not the end.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\p{Zs}+|\p{Zs}+\z", "")
    label = F.col("unit_type").isin("paragraph", "bullet") & ~F.col("icon") & F.length(text).between(1, 80) & ~text.rlike(r"[.:;]\z")
    label = F.coalesce(label, F.lit(False))
    upto = Window.partitionBy("section").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(~label, F.struct("icon", "seq")), ignorenulls=True).over(upto)
    marked = units.withColumn("_label", label).withColumn("_last", last)
    head = F.when(F.col("_label") & F.coalesce("_last.icon", F.lit(False)), F.col("_last.seq")).otherwise(F.col("seq"))
    return marked.withColumn("head", head).drop("_label", "_last")


def items(units: DataFrame) -> DataFrame:
    """Units (section, seq, table_id) as items: consecutive rows of one table are one, any other unit is its own."""
    order = Window.partitionBy("section").orderBy("seq")
    starts = F.col("table_id").isNull() | ~F.col("table_id").eqNullSafe(F.lag("table_id").over(order))
    numbered = units.withColumn("item", F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("section", "item").agg(F.min("seq").alias("first"), F.count("*").alias("n"))


def extended_lists(units: DataFrame) -> DataFrame:
    """(section, intro, seq): the list units that each unit ending in a colon takes, the run of one list type behind it."""
    order = Window.partitionBy("section").orderBy("seq")
    turn = (~F.col("unit_type").eqNullSafe(F.lag("unit_type").over(order))).cast("int")
    runs = units.withColumn("turn", turn).withColumn("run", F.sum("turn").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.withColumn("next_run", F.lead("run").over(order))
    intro = runs.where(F.rtrim("text").endswith(":")).select("section", F.col("seq").alias("intro"), F.col("next_run").alias("run"))
    listed = runs.where(F.col("unit_type").isin(*LIST_TYPES)).select("section", "run", "seq")
    return intro.join(listed, ["section", "run"]).where("seq > intro").select("section", "intro", "seq")

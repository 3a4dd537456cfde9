"""Drafts against their plan, slots against their units, and small grids of a table or section.

Joins are on slot, claim or unit ids; windows stay within one table or section.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TOKEN = r"\{\{ref:[^}]+\}\}"


def tokens(text: Column | str) -> Column:
    """Distinct reference tokens of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))


def draft_issues(slots: DataFrame, planned: DataFrame, claims: DataFrame, cited: DataFrame, units: DataFrame) -> DataFrame:
    """(code, slot_id, item) of slots (slot_id, status), planned and cited units, claims (claim_id, slot_id, kind, text), unit texts.

    A gap marker where there is content, a citation that the plan does not give the slot, a token that no cited passage
    holds, a planned unit not cited, a token lost, a slot without its gap marker or draft.
    """
    prose = claims.where("kind = 'prose'")
    links = cited.join(prose.select("claim_id", "slot_id"), "claim_id")
    missing = "not_found"
    gap = claims.where("kind = 'gap'").join(slots.where(F.col("status") != missing), "slot_id")
    stray = links.join(planned, ["slot_id", "unit_id"], "left_anti")
    said = prose.select("claim_id", "slot_id", F.explode(tokens("text")).alias("token"))
    held = units.select("unit_id", F.explode(tokens("text")).alias("token"))
    foreign = said.join(cited.join(held, "unit_id"), ["claim_id", "token"], "left_anti")
    drafted = claims.select("slot_id").distinct()
    uncited = planned.join(drafted, "slot_id", "left_semi").join(links, ["slot_id", "unit_id"], "left_anti")
    wanted = planned.join(links, ["slot_id", "unit_id"], "left_semi").join(held, "unit_id")
    lost = wanted.join(links.join(said, ["claim_id", "slot_id"]), ["slot_id", "unit_id", "token"], "left_anti")
    undrafted = slots.join(drafted, "slot_id", "left_anti")
    no_gap = undrafted.where(F.col("status") == missing)
    no_draft = undrafted.where(F.col("status") != missing).join(planned, "slot_id", "left_semi")
    parts = [("gap", gap, "claim_id"), ("stray", stray, "claim_id"), ("foreign", foreign, "claim_id"), ("uncited", uncited, "unit_id"), ("lost", lost, "unit_id"), ("nogap", no_gap, "slot_id"), ("nodraft", no_draft, "slot_id")]
    out = None
    for code, rows, item in parts:
        part = rows.select(F.lit(code).alias("code"), "slot_id", F.col(item).alias("item")).distinct()
        out = part if out is None else out.unionByName(part)
    return out


def slot_statuses(slots: DataFrame, placed: DataFrame) -> DataFrame:
    """Slots (section, slot_id, one_of, display_order, required, callout, section_required) with their units in order.

    placed: (slot_id, unit_id, seq, doubt). Filled slots are mapped, or need a review if a placement is doubtful. Empty
    ones: not applicable if the section is optional and empty, a callout, another member of the one-of group is filled
    or stands before it, or the slot is optional; else a gap.
    """
    shared = placed.groupBy("unit_id").agg((F.countDistinct("slot_id") > 1).alias("shared"))
    unit = F.array_sort(F.collect_set(F.struct("seq", "unit_id")))
    units = placed.join(shared, "unit_id").groupBy("slot_id").agg(unit.alias("u"), F.max("doubt").alias("doubt"), F.max("shared").alias("shared"))
    rows = slots.join(units, "slot_id", "left").withColumn("filled", F.col("u").isNotNull())
    section, group = Window.partitionBy("section"), Window.partitionBy("section", "one_of")
    in_group = F.col("one_of").isNotNull()
    settled = in_group & (F.max("filled").over(group) | (F.col("display_order") > F.min("display_order").over(group)))
    idle = (~F.max("filled").over(section) & ~F.col("section_required")) | F.col("callout") | settled | (~in_group & ~F.col("required"))
    status = F.when(F.col("filled") & F.col("doubt"), "needs_review").when(F.col("filled"), "mapped").when(idle, "not_applicable").otherwise("not_found")
    return rows.select("section", "slot_id", status.alias("status"), F.coalesce("shared", F.lit(False)).alias("shared"), F.coalesce(F.array_join("u.unit_id", " "), F.lit("")).alias("unit_ids"))


def occupied_groups(cells: DataFrame) -> DataFrame:
    """(table_id, col, grp): columns of a sparse grid that hold text, those of one group never in the same row.

    A column joins the group on its left unless a row has text in both. A column's rows are a set; the fold runs over
    the columns of one table only.
    """
    col = cells.where(F.trim("text") != "").groupBy("table_id", "col").agg(F.collect_set("row_index").alias("rows"))
    start = F.struct(F.array().cast("array<struct<col:int,grp:int>>").alias("done"), F.lit(0).alias("grp"), F.array().cast("array<int>").alias("rows"))

    def step(state: Column, one: Column) -> Column:
        clash = F.arrays_overlap(state["rows"], one["rows"]) | (state["grp"] == 0)
        grp = state["grp"] + clash.cast("int")
        return F.struct(
            F.concat(state["done"], F.array(F.struct(one["col"].alias("col"), grp.alias("grp")))).alias("done"), grp.alias("grp"),
            F.when(clash, one["rows"]).otherwise(F.concat(state["rows"], one["rows"])).alias("rows"),
        )

    table = col.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("col", "rows"))).alias("cols"))
    return table.select("table_id", F.inline(F.aggregate("cols", start, step, lambda s: s["done"])))


def bounded_memory(entries: DataFrame, most: int) -> DataFrame:
    """Entries (block, kind, nth, chars) that fit: terms go first from their end, then roles, then references.

    Order of keeping is references, roles, terms; an entry stays if all up to it fit into `most` characters.
    """
    rank = F.when(F.col("kind") == "ref", 0).when(F.col("kind") == "role", 1).otherwise(2)
    upto = Window.partitionBy("block").orderBy(rank, "nth").rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("used", F.sum("chars").over(upto)).where(F.col("used") <= most)


def clean_split(passages: DataFrame, pieces: DataFrame) -> DataFrame:
    """(passage_id, clean): whether pieces (passage_id, nth, slot, piece) split a passage (passage_id, text, slots) word for word.

    Pieces follow each other; between and behind them stand no letters or digits; their slots are the passage's.
    """
    trimmed = F.btrim(F.trim(F.regexp_replace("piece", r"\s+", " ")), F.lit(" ,;"))
    kept = pieces.withColumn("p", trimmed).where("p <> ''").groupBy("passage_id")
    ordered = kept.agg(F.array_sort(F.collect_list(F.struct("nth", "p"))).alias("parts"), F.array_sort(F.collect_set("slot")).alias("named"))
    wordish = r"(?U)[^\W_]"

    def step(rest: Column, part: Column) -> Column:
        at = F.position(part["p"], rest)
        gap = F.substr(rest, F.lit(1), at - 1)
        return F.when((at > 0) & ~gap.rlike(wordish), F.substr(rest, at + F.length(part["p"])))

    joined = passages.join(ordered, "passage_id", "left")
    rest = F.aggregate("parts", F.trim(F.regexp_replace("text", r"\s+", " ")), step)
    clean = ~rest.rlike(wordish) & (F.col("named") == F.array_sort("slots"))
    return joined.select("passage_id", F.coalesce(clean, F.lit(False)).alias("clean"))


def spread_icons(elements: DataFrame) -> DataFrame:
    """Elements (section, seq, icons): each keeps its first icon, further ones go to the next elements without any.

    Icons wait in order; those for which no place is left return to their element. The fold runs over one section.
    """
    waiting, placed = "array<struct<seq:int,icon:string>>", "array<struct<seq:int,icons:array<string>>>"
    start = F.struct(F.array().cast(waiting).alias("wait"), F.array().cast(placed).alias("done"))

    def step(state: Column, e: Column) -> Column:
        empty, wait = F.size(e["icons"]) == 0, state["wait"]
        extra = F.transform(F.filter(e["icons"], lambda _, i: i > 0), lambda x: F.struct(e["seq"].alias("seq"), x.alias("icon")))
        own = F.when(empty, F.transform(F.slice(wait, 1, 1), lambda w: w["icon"])).otherwise(F.slice(e["icons"], 1, 1))
        left = F.when(empty, F.filter(wait, lambda _, i: i > 0)).otherwise(F.concat(wait, extra))
        return F.struct(left.alias("wait"), F.concat(state["done"], F.array(F.struct(e["seq"].alias("seq"), own.alias("icons")))).alias("done"))

    rows = elements.groupBy("section").agg(F.array_sort(F.collect_list(F.struct("seq", "icons"))).alias("es"))
    rows = rows.select("section", F.aggregate("es", start, step).alias("s")).select("section", "s.wait", F.inline("s.done"))
    back = F.transform(F.filter("wait", lambda w: w["seq"] == F.col("seq")), lambda w: w["icon"])
    return rows.select("section", "seq", F.concat("icons", back).alias("icons"))

"""Joins: traces, foreign-key checks, diffs, carry-over, containment, scoring against small dimensions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def trace(claims: DataFrame, units: DataFrame, sections: DataFrame) -> DataFrame:
    """claim_id, unit_id, section heading: a row for each cited unit; claims without units and unknown units keep a row.

    claims: claim_id, unit_ids (array); units: unit_id, section_id; sections: section_id, heading.
    """
    cited = claims.select("claim_id", F.explode_outer(F.array_distinct("unit_ids")).alias("unit_id"))
    return cited.join(units, "unit_id", "left").join(sections, "section_id", "left").select("claim_id", "unit_id", "section_id", "heading")


def missing_keys(checks: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(name, rows, column, dimension, key): values of the column that the dimension lacks, all checks in one list."""
    found = [
        rows.where(F.col(column).isNotNull()).join(dim.select(F.col(key).alias(column)), column, "left_anti").groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).withColumn("problem", F.lit(name))
        for name, rows, column, dim, key in checks
    ]
    return reduce(DataFrame.unionByName, found).select("problem", "value", "n")


def diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows added, removed or changed between two versions."""
    a = before.select(key, F.struct(*columns).alias("_a"))
    b = after.select(key, F.struct(*columns).alias("_b"))
    both = a.join(b, key, "full")
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.select(key, kind.alias("change")).where("change is not null")


def point_in_box(points: DataFrame, boxes: DataFrame, cell: int = 100) -> DataFrame:
    """points: page, point_id, x, y; boxes: page, box_id, x0, y0, x1, y1. Pairs whose point lies in the box.

    Both sides are dealt to cells of a grid first, so that the join is on equal keys.
    """
    at = lambda c: F.floor(F.col(c) / cell)
    p = points.withColumns({"_cx": at("x"), "_cy": at("y")})
    b = boxes.withColumn("_cx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("_cy", F.explode(F.sequence(at("y0"), at("y1"))))
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1"))
    return p.join(b, ["page", "_cx", "_cy"]).where(inside).select("page", "point_id", "box_id")


def outermost(boxes: DataFrame, cell: int = 100) -> DataFrame:
    """Boxes not inside another one of their page; of equal boxes the one of the least box_id stays. A box inside another has its corner in
    that one, so both meet in a cell of a grid and the join is on equal keys."""
    at = lambda c: F.floor(F.col(c) / cell)
    sides = ("x0", "y0", "x1", "y1")
    b = boxes.select("page", "box_id", *sides, at("x0").alias("_cx"), at("y0").alias("_cy"))
    o = boxes.select("page", F.col("box_id").alias("_o"), *[F.col(c).alias(f"_{c}") for c in sides])
    o = o.withColumn("_cx", F.explode(F.sequence(at("_x0"), at("_x1")))).withColumn("_cy", F.explode(F.sequence(at("_y0"), at("_y1"))))
    inside = (F.col("x0") >= F.col("_x0")) & (F.col("y0") >= F.col("_y0")) & (F.col("x1") <= F.col("_x1")) & (F.col("y1") <= F.col("_y1"))
    equal = (F.col("x0") == F.col("_x0")) & (F.col("y0") == F.col("_y0")) & (F.col("x1") == F.col("_x1")) & (F.col("y1") == F.col("_y1"))
    held = b.join(o, ["page", "_cx", "_cy"]).where(inside & F.when(equal, F.col("_o") < F.col("box_id")).otherwise(F.col("_o") != F.col("box_id"))).select("page", "box_id").distinct()
    return boxes.join(held, ["page", "box_id"], "left_anti")


def name_score(a: Column, b: Column) -> Column:
    """Of two word arrays: 1 if equal as sets, 0.55 + 0.4 * share of b if b holds a or the other way round, else 0.4 * Jaccard."""
    same, all_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    least, most = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    return F.when(all_ == 0, 0.0).when(same == all_, 1.0).when((same == least) & (least > 0), 0.55 + 0.4 * least / most).otherwise(0.4 * same / all_)


def cosine(a: Column, b: Column) -> Column:
    """Of two word arrays as bags given as sets with counts: here of arrays of doubles of equal length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def contained(texts: DataFrame, needles: DataFrame, text_id: str, needle_id: str, head: int = 3) -> DataFrame:
    """Pairs of a text (text_id, text) and a needle (needle_id, needle) whose words stand in it in a row; words are runs of a-z and 0-9.

    Texts and needles meet by the hash of a needle's first `head` words; only then is a text read whole.
    """
    normal = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    short = needles.select(needle_id, normal("needle").alias("_needle")).where("_needle != ''").withColumn("_words", F.split("_needle", " "))
    short = short.withColumn("_n", F.least(F.size("_words"), F.lit(head))).withColumn("_head", F.xxhash64(F.array_join(F.slice("_words", 1, F.col("_n")), " ")))
    lengths = sorted(r["_n"] for r in short.select("_n").distinct().collect())  # at most `head`

    def heads(n: int):
        return F.when(F.size("_words") >= n, F.transform(F.sequence(F.lit(1), F.size("_words") - n + 1), lambda i: F.xxhash64(F.array_join(F.slice("_words", i, F.lit(n)), " "))))

    every = F.array_distinct(F.flatten(F.array_compact(F.array(*[heads(n) for n in lengths])))) if lengths else F.array().cast("array<bigint>")
    split = texts.select(text_id, F.split(normal("text"), " ").alias("_words"))
    met = split.select(text_id, F.explode(every).alias("_head")).join(short.select(needle_id, "_head"), "_head").select(text_id, needle_id).distinct()
    both = met.join(texts.select(text_id, normal("text").alias("_text")), text_id).join(short.select(needle_id, "_needle"), needle_id)
    return both.where(F.contains(F.concat(F.lit(" "), "_text", F.lit(" ")), F.concat(F.lit(" "), "_needle", F.lit(" ")))).select(text_id, needle_id)

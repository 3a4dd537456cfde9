"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target in words: weights share a total, no source gets more than `most`
times its size, and what that leaves is shared again by weight. A document is then due
target / size of its source copies, most of the time a fraction. Two fractional documents at a
time, mass (copies x words) moves from one to the other, in a random direction with
the chances that keep both expectations, until one of the two is whole. The sum of masses never
changes, and the last fractional document of a source goes to the nearer side, so a source
misses its target by half a document at most. Documents of a source are
dealt to groups; each group leaves at most one fractional document, and these are
combined in a tree of small groups until one is left for each source.

Defined cases: a null text has size 0; sources are ranked by code point, null last, and null is a
source of its own; a source of size 0 has target 0; rows equal in id, source and text
share one decision; no rows give no rows. Columns named like the new ones are replaced.
"""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from folium.llm._store import cut, row_key

WORD = r"[^\x20\x09-\x0D]+"
GROUP_ROWS, FAN_IN = 20_000, 64


def words(text_col: str):
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """sizes: source, source_size. Adds target."""
    ranked = sizes.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(lambda x: (*x[0], float(weights[x[1] % len(weights)])))
    table = sizes.sparkSession.createDataFrame(ranked, "source string, source_size long, weight double")
    table = cut(table.withColumn("cap", most * F.col("source_size")), "mix-sources")
    goal = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    capped, rate = F.lit(False), 0.0
    while True:  # each round caps at least one more source
        now = table.agg(
            F.sum(F.when(capped, F.col("cap"))).alias("fixed"), F.sum(F.when(~capped, F.col("weight"))).alias("free"), F.count_if(capped).alias("n"),
        ).first()
        if not now["free"]:
            break
        rate = (goal - (now["fixed"] or 0.0)) / now["free"]
        more = F.col("cap") <= F.lit(rate) * F.col("weight")
        if table.where(more).count() <= now["n"]:
            break
        capped = more
    return table.select("source", "source_size", F.least(F.col("cap"), F.lit(rate) * F.col("weight")).alias("target"), F.when(capped, True).otherwise(False).alias("capped"))


def _pivot(seed: int):
    def pivot(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("unit")
        draw = random.Random(f"{seed}/{rows['unit'].iloc[0]}/{len(rows)}")
        size, p = rows["words"].tolist(), rows["p"].tolist()
        held = -1
        for i in range(len(p)):
            if not 0.0 < p[i] < 1.0:
                continue
            if held < 0:
                held = i
                continue
            j, ratio = held, size[i] / size[held]
            up, down = min(1.0 - p[i], p[j] / ratio), min(p[i], (1.0 - p[j]) / ratio)
            if draw.random() * (up + down) < down:
                filled = up == 1.0 - p[i]
                p[i], p[j] = (1.0, p[j] - up * ratio) if filled else (p[i] + up, 0.0)
            else:
                emptied = down == p[i]
                p[i], p[j] = (0.0, p[j] + down * ratio) if emptied else (p[i] - down, 1.0)
            p[i], p[j] = (round(x) if x < 1e-12 or x > 1 - 1e-12 else x for x in (p[i], p[j]))
            held = i if 0.0 < p[i] < 1.0 else j if 0.0 < p[j] < 1.0 else -1
        rows["p"] = [float(x) for x in p]
        return rows

    return pivot


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of docs: id_col, _row (row_key of id, source and text), source, size, source_size, target, copies, taken."""
    rows = docs.select(F.col(id_col), row_key({c: dict(docs.dtypes)[c] for c in (id_col, source_col, text_col)}).alias("_row"), F.col(source_col).cast("string").alias("source"), words(text_col).alias("size"))
    rows = cut(rows, "mix-rows")
    goals = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mix-targets")
    same = F.broadcast(goals) if goals.count() <= 100_000 else goals
    due = rows.join(same.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.when(F.col("capped"), F.lit(most)).otherwise(F.col("target") / F.col("source_size"))).otherwise(0.0)
    due = due.withColumn("_rate", rate)
    units = due.where("size > 0").groupBy("source", F.col("_row").alias("unit")).agg(F.sum("size").cast("double").alias("words"), F.first("_rate").alias("_rate"))
    units = units.withColumn("p", F.col("_rate") - F.floor("_rate"))
    groups = max(1, math.ceil(rows.count() / GROUP_ROWS))
    state = units.withColumn("slot", F.pmod(F.xxhash64("unit", F.lit(seed)), F.lit(groups))).select("source", "unit", "words", "p", "slot")
    schema, decided, level = "source string, unit long, words double, p double, slot long", None, 0
    while True:
        state = cut(state.groupBy("source", "slot").applyInPandas(_pivot(seed + level), schema), f"mix-level-{level}")
        whole = state.where("p = 0 or p = 1")
        decided = whole if decided is None else decided.unionByName(whole)
        left = state.where("p > 0 and p < 1")
        if groups == 1:
            decided = decided.unionByName(left.withColumn("p", F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0)))
            break
        groups = math.ceil(groups / FAN_IN)
        state, level = left.withColumn("slot", F.floor(F.col("slot") / FAN_IN)), level + 1
    extra = decided.select(F.col("unit"), F.col("source").alias("_source"), F.col("p").cast("long").alias("_extra"))
    out = due.join(extra, (F.col("_row") == F.col("unit")) & F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("copies", (F.floor("_rate") + F.coalesce("_extra", F.lit(0))).cast("long"))
    return out.select(id_col, "_row", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))

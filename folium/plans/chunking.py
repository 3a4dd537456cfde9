"""Chunks and packing: paragraph merges, per-chunk topic breaks, chunk validation, bins under a budget, section trees."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from folium.operators.lineage import settle

WORD = r"\b\w\w+\b"


def merged_paragraphs(paragraphs: Column) -> Column:
    """Folds an array of paragraphs: one joins the merged one before if that has an open bracket, ends in '-', or lacks an
    end sign while this one starts in lower case."""

    def step(s: Column, p: Column) -> Column:
        last = F.element_at(s, -1)
        open_ = F.regexp_count(last, F.lit(r"\(")) > F.regexp_count(last, F.lit(r"\)"))
        joins = (F.size(s) > 0) & (open_ | last.endswith("-") | (~last.rlike(r"[.!?:;]$") & p.rlike(r"^[a-zà-ÿ),;]")))
        longer = F.array(F.concat(last, F.when(last.endswith("-"), "").otherwise(" "), p))
        return F.when(joins, F.concat(F.slice(s, F.lit(1), F.size(s) - 1), longer)).otherwise(F.concat(s, F.array(p)))

    return F.aggregate(paragraphs, F.array().cast("array<string>"), step)


def chunk_problems(chunks: DataFrame, text: str, most_words: int = 1500) -> DataFrame:
    """Chunks that are empty or too long."""
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return chunks.withColumn("problem", F.when(n == 0, "empty").when(n > most_words, "oversize")).where("problem is not null")


def _terms(text: str) -> Counter:
    import re

    words = re.findall(WORD, text.lower())
    return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])


def topic_parts(rows: pd.DataFrame, threshold: float = 0.4, least_words: int = 50) -> pd.DataFrame:
    """One chunk's paragraphs in order: a new part begins where the cosine to the paragraph before is below the threshold.

    Term weights are fitted on the chunk's own paragraphs (one- and two-word terms, smoothed inverse frequency)."""
    rows = rows.sort_values("seq")
    bags = [_terms(t) for t in rows["text"]]
    part = [1] * len(rows)
    if len(rows) > 1 and sum(len(t.split()) for t in rows["text"]) >= least_words:
        df = Counter(t for b in bags for t in b)
        weight = [{t: c * (math.log((1 + len(bags)) / (1 + df[t])) + 1) for t, c in b.items()} for b in bags]
        norm = [math.sqrt(sum(x * x for x in w.values())) for w in weight]
        for i in range(1, len(rows)):
            dot = sum(x * weight[i - 1].get(t, 0.0) for t, x in weight[i].items())
            near = dot / (norm[i] * norm[i - 1]) if norm[i] and norm[i - 1] else 0.0
            part[i] = part[i - 1] + (near < threshold)
    return rows.assign(part=part)[["chunk_id", "seq", "part"]]


def semantic_parts(paragraphs: DataFrame) -> DataFrame:
    """paragraphs: chunk_id, seq, text. A chunk is bounded by the length of one document."""
    return paragraphs.groupBy("chunk_id").applyInPandas(lambda rows: topic_parts(rows), "chunk_id long, seq int, part int")


def packed(blocks: Column, budget: int) -> Column:
    """Sequential next fit over array<struct<id, cost>>: bin numbers; a block over the budget is alone in its bin."""
    state = F.struct(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("bins"))

    def step(s: Column, b: Column) -> Column:
        cost = b["cost"].cast("long")
        fresh = (s["bin"] == 0) | (s["used"] + cost > budget)
        number = F.when(fresh, s["bin"] + 1).otherwise(s["bin"])
        return F.struct(number.alias("bin"), F.when(fresh, cost).otherwise(s["used"] + cost).alias("used"), F.concat(s["bins"], F.array(number)).alias("bins"))

    return F.aggregate(blocks, state, step, lambda s: s["bins"])


def paths_to_root(nodes: DataFrame) -> DataFrame:
    """nodes: node_id, parent_id, title. Adds path ('A > B > C'). A node's parts double with each join, so a tree of depth d takes
    log d of them. A node whose parent is missing is a root; nodes on or below a cycle give no row."""
    up = nodes.select("node_id", F.col("parent_id").alias("_up"), F.col("title").alias("path"))
    known = nodes.select(F.col("node_id").alias("_up"))
    now = settle(up.join(known.withColumn("_here", F.lit(True)), "_up", "left").select("node_id", F.when(F.col("_here"), F.col("_up")).alias("_up"), "path"))
    left, before = now.where("_up is not null").count(), -1
    while left and left != before:
        above = now.select(F.col("node_id").alias("_up"), F.col("_up").alias("_next"), F.col("path").alias("_above"))
        step = now.join(above, "_up", "left")
        now = settle(step.select("node_id", F.col("_next").alias("_up"), F.concat_ws(" > ", "_above", "path").alias("path")))
        left, before = now.where("_up is not null").count(), left
    return now.where("_up is null").select("node_id", "path")


def section_plan(scores: DataFrame, names: tuple[str, str] = ("section_id", "target_id")) -> DataFrame:
    """scores: section, target, score. Best target: unresolved below 0.30, to check below a margin of 0.25, else mapped."""
    section, target = names
    w = Window.partitionBy(section).orderBy(F.desc("score"), target)
    ranked = scores.withColumns({"_n": F.row_number().over(w), "_second": F.lead("score").over(w)}).where("_n = 1")
    margin = F.col("score") - F.coalesce("_second", F.lit(0.0))
    status = F.when(F.col("score") < 0.30, "unresolved").when(margin < 0.25, "check").otherwise("mapped")
    return ranked.select(section, F.when(F.col("score") >= 0.30, F.col(target)).alias(target), "score", margin.alias("margin"), status.alias("status"))


def plan_kinds(mapped: DataFrame) -> DataFrame:
    """mapped: root, target_id. merge: a target fed by several roots; split: a root that feeds several targets; else one-to-one."""
    pairs = mapped.select("root", "target_id").distinct()
    roots = pairs.groupBy("target_id").agg(F.count("*").alias("_roots"))
    targets = pairs.groupBy("root").agg(F.count("*").alias("_targets"))
    kind = F.when(F.col("_roots") > 1, "merge").when(F.col("_targets") > 1, "split").otherwise("one-to-one")
    return pairs.join(roots, "target_id").join(targets, "root").select("root", "target_id", kind.alias("kind"))

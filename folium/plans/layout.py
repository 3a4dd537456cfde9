"""Page layout: reading order, icons beside texts, box clusters, tables that continue on the next page."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

COLUMNS = (("title", 50, 500, 80), ("left", 50, 230, 40), ("right", 320, 230, 40))  # name, x0, width, letters in a row
PAGE_SIZE, ROW, PER_PAGE = 600, 12, 11
EDGES = ("x0", "y0", "x1", "y1")


def typeset(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """page ('document-number'), seq, col, box_id, n_rows, x0, y0, x1, y1: texts set in pages of a title and two columns of five blocks.

    A line that is not blank is a block, as high as its letters need; a block of an odd number of letters has more space below it.
    Null texts give no blocks; positions depend on one page only, so a document of any length is set by windows over its pages.
    """
    blocks = docs.select(id_col, F.posexplode(F.filter(F.split(text_col, "\n"), lambda t: F.trim(t) != "")).alias("seq", "_t"))
    at = F.col("seq") % PER_PAGE
    pick = lambda i: F.when(at == 0, COLUMNS[0][i]).when(at <= PER_PAGE // 2, COLUMNS[1][i]).otherwise(COLUMNS[2][i])
    blocks = blocks.select(F.concat_ws("-", id_col, F.floor(F.col("seq") / PER_PAGE)).alias("page"), "seq", pick(0).alias("col"), pick(1).alias("x0"), pick(2).alias("_w"), F.ceil(F.length("_t") / pick(3)).cast("int").alias("n_rows"), (4 + 4 * (F.length("_t") % 2)).alias("_gap"))
    high, before = F.col("n_rows") * ROW, Window.partitionBy("page", "col").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    title = F.first("n_rows").over(Window.partitionBy("page").orderBy("seq")) * ROW
    top = 20 + F.when(F.col("col") == "title", 0).otherwise(title + 50) + F.coalesce(F.sum(high + F.col("_gap")).over(before), F.lit(0))
    placed = blocks.withColumn("y0", top.cast("int"))
    return placed.select("page", "seq", "col", F.concat(F.lit("b"), F.lpad(F.col("seq").cast("string"), 7, "0")).alias("box_id"), "n_rows", "x0", "y0", (F.col("x0") + F.col("_w")).alias("x1"), (F.col("y0") + high).alias("y1"))


def _order(boxes: list[tuple], page: float, turn: int = 0) -> list[tuple]:
    """XY-cut: split at the widest gap of at least 3% of the page, on alternating axes; leaves by top, then left."""
    for axis in (turn % 2, (turn + 1) % 2):
        by = sorted(boxes, key=lambda b: b[1 + axis])
        ends = list(accumulate((b[3 + axis] for b in by), max))
        gaps = [(b[1 + axis] - end, (b[1 + axis] + end) / 2) for end, b in zip(ends, by[1:])]
        width, at = max(gaps, default=(0, 0))
        if width >= 0.03 * page:
            first = [b for b in boxes if (b[1 + axis] + b[3 + axis]) / 2 < at]
            rest = [b for b in boxes if (b[1 + axis] + b[3 + axis]) / 2 >= at]
            if first and rest:
                return _order(first, page, turn + 1) + _order(rest, page, turn + 1)
    return sorted(boxes, key=lambda b: (b[2], b[1]))


def _page(boxes: DataFrame) -> str:
    return f"page {boxes.schema['page'].dataType.simpleString()}"


def _by_page(boxes: DataFrame, of_page: Callable[..., tuple[list, ...]], columns: tuple[str, ...], out: dict[str, str]) -> DataFrame:
    """Rows (page, *out) from of_page(first row, columns and edges as lists) of each page, its boxes sorted by box_id; many pages go to Python at once.

    of_page returns a list for each column of out: row numbers of boxes (or None) for strings, else whole numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch["boxes"]
            rows, ends = pages.flatten(), np.cumsum(pages.value_lengths().to_numpy()).tolist()
            lists = [pa.array(rows.field(c)).to_numpy(zero_copy_only=False).tolist() for c in (*columns, *EDGES)]
            found: list[list] = [[] for _ in range(1 + len(out))]
            for k, (lo, hi) in enumerate(zip([0, *ends], ends)):
                values = of_page(lo, *(x[lo:hi] for x in lists))
                found[0] += [k] * len(values[0])
                for x, more in zip(found[1:], values):
                    x += more
            arrays = [rows.field("box_id").take(pa.array(x, pa.int64())) if kind == "string" else pa.array(x, pa.int32()) for x, kind in zip(found[1:], out.values())]
            yield pa.RecordBatch.from_arrays([batch["page"].take(pa.array(found[0], pa.int64())), *arrays], names=["page", *out])

    box = F.struct(F.isnull("box_id").alias("_unnamed"), "box_id", *EDGES, *(c for c in columns if c != "box_id"))
    pages = boxes.groupBy("page").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    return pages.mapInArrow(run, ", ".join([_page(boxes), *(f"{name} {kind}" for name, kind in out.items())]))


def _page_order(first: int, size: list, *edges: list) -> tuple[list, ...]:
    done = _order(list(zip(range(first, first + len(size)), *edges)), float(size[0]))
    return [b[0] for b in done], list(range(1, len(done) + 1))


def reading_order(boxes: DataFrame) -> DataFrame:
    """boxes: page, page_size, box_id, x0, y0, x1, y1. A page's boxes are one group; equal places go by box."""
    return _by_page(boxes, _page_order, ("page_size",), {"box_id": "string", "place": "int"})


def _icons(first: int, kind: list, names: list, *edges: list) -> tuple[list, ...]:
    """Icons in order each take the best text not yet taken: vertical overlap of at least a quarter, not left of the icon."""
    rows = list(zip(range(first, first + len(kind)), *edges))
    texts, icons, took = [b for b, k in zip(rows, kind) if k == "text"], [b for b, k in zip(rows, kind) if k == "icon"], []
    for _, x0, y0, x1, y1 in icons:
        best = None
        for t, t_x0, t_y0, t_x1, t_y1 in texts:
            both = min(y1, t_y1) - max(y0, t_y0)
            share = both / max(1e-9, min(y1 - y0, t_y1 - t_y0))
            if share < 0.25 or t_x1 <= x0:
                continue
            rank = (-share, abs(t_x0 - x1), t)
            best = rank if best is None else min(best, rank)
        took.append(best[2] if best else None)
        if best:
            texts = [t for t in texts if names[t[0] - first] != names[best[2] - first]]
    return [b[0] for b in icons], took


def icon_texts(boxes: DataFrame) -> DataFrame:
    """boxes: page, kind (icon or text), box_id, x0, y0, x1, y1."""
    return _by_page(boxes, _icons, ("kind", "box_id"), {"icon_id": "string", "text_id": "string"})


def _clusters(gap: float):
    def clusters(rows: pd.DataFrame) -> pd.DataFrame:
        boxes = sorted(rows[["box_id", "x0", "y0", "x1", "y1"]].itertuples(index=False, name=None), key=lambda b: b[1])
        name = {b[0]: b[0] for b in boxes}

        def find(x):
            while name[x] != x:
                x = name[x]
            return x

        near: list[tuple] = []  # boxes that may still meet those to come
        for b in boxes:
            near = [o for o in near if o[3] + gap >= b[1]]
            for o in near:
                if b[2] <= o[4] + gap and o[2] <= b[4] + gap:
                    x, y = find(b[0]), find(o[0])
                    name[max(x, y)] = min(x, y)
            near.append(b)
        return pd.DataFrame({"page": rows["page"].iloc[0], "box_id": list(name), "cluster": [find(x) for x in name]})

    return clusters


def box_clusters(boxes: DataFrame, gap: float = 5.0) -> DataFrame:
    """Boxes of a page that meet within `gap`, over others too, are one cluster, named by its least box."""
    return boxes.groupBy("page").applyInPandas(_clusters(gap), f"{_page(boxes)}, box_id string, cluster string")


def stitched_tables(tables: DataFrame) -> DataFrame:
    """tables: doc_id, page, table_id, top, bottom (shares of the page), n_cols, deviation (of column edges from the table before), header_same.

    A table continues the one before on the previous page with tables if it starts near the top, that one ends near the
    bottom, the columns agree and the score reaches 0.7. group_id: the first table of each chain.
    """
    w = Window.partitionBy("doc_id").orderBy("page", "top")
    before = lambda c: F.lag(c).over(w)
    edge = F.when(F.col("deviation") <= 5, 0.4).when(F.col("deviation") <= 15, 0.28).when(F.col("deviation") <= 30, 0.12)
    score = F.lit(0.4) + edge + F.when(F.col("header_same"), 0.2).otherwise(0.0)
    joins = (before("n_cols") == F.col("n_cols")) & (before("bottom") >= 0.75) & (F.col("top") <= 0.20) & (before("page") < F.col("page")) & (score >= 0.7)
    flags = tables.withColumn("_starts", ~F.coalesce(joins, F.lit(False)))
    flags = flags.withColumn("_run", F.sum(F.col("_starts").cast("int")).over(w))
    return flags.withColumn("group_id", F.first("table_id").over(Window.partitionBy("doc_id", "_run").orderBy("page", "top"))).select("doc_id", "table_id", "group_id")

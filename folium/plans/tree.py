"""Trees over flat elements: numbers of any depth, chunks, source units, number maps.

An element with a level is a heading; it stands below the nearest heading before it that has a lower level. One ordered scan gives every
element the path of its section ("2.1.3"; "0" before the first heading), holding only the open headings of one document. A path is the
tree: its prefixes are the ancestors, so lookups along the tree are joins on equal paths.

elements: a document column, seq, level, kind, content and (for units) header. Documents of any length pass in batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

CAPTION = r"(?i)^(figure|fig\.|table|image|abbildung|tabelle|tableau)\s+\d"
WARNING = r"(?i)^(warning|caution|danger|warnung|attention)\b"
NOTE = r"(?i)^(note|hinweis|remarque|nota)\b"


def line_elements(docs: DataFrame, most: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines as elements: one of at most `most` words is a heading, of the level of its number of words."""
    lines = docs.select(F.col(id_col), F.posexplode(F.split(text_col, "\n")).alias("at", "line")).select(id_col, "at", F.trim(F.regexp_replace("line", r"\s+", " ")).alias("content")).where("content != ''")
    n = F.size(F.split("content", " "))
    level = F.when(n <= most, n)
    rows = lines.select(id_col, "at", level.alias("level"), F.when(level.isNotNull(), "heading").otherwise("paragraph").alias("kind"), F.lit(False).alias("header"), "content")
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(id_col).orderBy("at")) - 1).drop("at")


def numbered(elements: DataFrame, doc: str) -> DataFrame:
    """elements with section (path of the section that holds it; of a heading its own), depth, ordinal (place among the section's own content, from 1;
    0 for the heading), table_no (of rows: which table of the section) and headers (content of the table's header rows)."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, began = None, False
        open_, counts, section, ordinal, tables, in_table, headers = [], [0], "0", 0, 0, False, None
        for batch in batches:
            out = []
            level = batch["level"].astype(object).where(batch["level"].notna(), None)
            for d, n, kind, header, content in zip(batch[doc], level, batch["kind"], batch["header"], batch["content"]):
                d = None if pd.isna(d) else d
                if not began or d != now:
                    now, began = d, True
                    open_, counts, section, ordinal, tables, in_table, headers = [], [0], "0", 0, 0, False, None
                if n is not None:
                    while open_ and open_[-1] >= n:
                        open_.pop()
                    del counts[len(open_) + 1 :]
                    counts[len(open_)] += 1
                    section, ordinal, tables, in_table = ".".join(map(str, counts)), 0, 0, False
                    open_.append(n)
                    counts.append(0)
                    out.append((section, len(open_), 0, None, None))
                    continue
                ordinal += 1
                if kind != "row":
                    in_table = False
                else:
                    if not in_table:
                        in_table, tables, headers = True, tables + 1, None
                    if header:
                        headers = content if headers is None else f"{headers} / {content}"
                is_row = kind == "row"
                out.append((section, len(open_), ordinal, tables if is_row else None, headers if is_row and not header else None))
            added = pd.DataFrame(out, columns=["section", "depth", "ordinal", "table_no", "headers"], dtype=object)
            yield pd.concat([batch.reset_index(drop=True), added], axis=1)

    rows = elements.select(doc, "seq", "level", "kind", "header", "content").repartition(F.col(doc)).sortWithinPartitions(doc, "seq")
    kind = rows.schema[doc].dataType.simpleString()
    return rows.mapInPandas(scan, f"{doc} {kind}, seq int, level int, kind string, header boolean, content string, section string, depth int, ordinal int, table_no int, headers string")


def _above(rows: DataFrame, doc: str, wanted: DataFrame) -> DataFrame:
    """doc, section and near: the longest proper prefix of the path that is a section of wanted (doc, section)."""
    path = F.split("section", r"\.")
    ups = rows.select(doc, "section", F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.size(path) - 1), lambda i: F.struct(i.alias("d"), F.when(i == 0, "0").otherwise(F.array_join(F.slice(path, 1, i), ".")).alias("near"))), lambda x: x["near"] != F.col("section"))).alias("u"))
    ups = ups.select(doc, "section", F.col("u.d").alias("d"), F.col("u.near").alias("near"))
    there = wanted.select(F.col(doc).alias("_doc"), F.col("section").alias("_near"))
    hit = ups.join(there, F.col(doc).eqNullSafe(F.col("_doc")) & (F.col("near") == F.col("_near")))
    return hit.groupBy(doc, "section").agg(F.max_by("near", "d").alias("near"))


def chunks(elements: DataFrame, doc: str, bare: bool = True) -> DataFrame:
    """One chunk for each section, in order: doc, section, sequence, parent (nearest section above that has a chunk), heading, chunk_type, n_words, content.

    bare: whether a heading without content of its own gives a chunk.
    """
    rows = numbered(elements, doc)
    marked = F.when(F.col("ordinal") == 0, F.lit("# ")).when(F.col("kind") == "list_item", F.lit("- ")).otherwise("")
    parts = F.sort_array(F.collect_list(F.struct("seq", F.concat(marked, "content").alias("t"))))  # bounded by one section
    own = rows.groupBy(doc, "section").agg(
        F.min("seq").alias("at"), F.max("depth").alias("depth"), F.max(F.when(F.col("ordinal") == 0, F.col("content"))).alias("heading"), F.max("ordinal").alias("n_own"),
        F.bool_or(F.col("kind") == "row").alias("has_table"), F.bool_or(F.col("kind") == "figure").alias("has_image"),
        F.bool_and(F.col("kind").isin("heading", "row")).alias("only_table"), F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n").alias("content"),
    )
    own = own if bare else own.where("n_own > 0")
    title = F.lower(F.coalesce("heading", F.lit("")))
    named = F.when(title.contains("procedure") | title.contains("step"), "procedure").when(title.contains("reference"), "reference").when(title.contains("appendix"), "appendix").otherwise("section")
    own = own.withColumn("chunk_type", F.when(F.col("has_table") & F.col("only_table"), "table").otherwise(named))
    parent = _above(own, doc, own).withColumnsRenamed({doc: "_d", "section": "_s"})
    own = own.join(parent, F.col(doc).eqNullSafe(F.col("_d")) & (F.col("section") == F.col("_s")), "left")
    n = F.size(F.filter(F.split("content", r"\s+"), lambda w: w != ""))
    order = F.row_number().over(Window.partitionBy(doc).orderBy("at")) - 1
    return own.select(doc, "section", order.alias("sequence"), F.col("near").alias("parent"), "heading", "chunk_type", "has_table", "has_image", n.alias("n_words"), "content")


def units(elements: DataFrame, doc: str) -> DataFrame:
    """Source units: all content but headings, each once: doc, unit_id (section, then place in it), section, seq, unit_type, table_id, headers, content,
    relation and target (caption_of the figure beside it; warning_for and note_for the nearest content before, else after)."""
    rows = numbered(elements, doc).where("ordinal > 0")
    text = F.when(F.col("content").rlike(CAPTION), "caption").when(F.col("content").rlike(WARNING), "warning").when(F.col("content").rlike(NOTE), "note").otherwise("paragraph")
    kind = F.when(F.col("kind") == "paragraph", text).when(F.col("kind") == "list_item", "bullet").when(F.col("kind") == "row", F.when(F.col("header"), "table_header").otherwise("table_row")).otherwise("figure")
    name = F.concat(F.lit("S"), "section", F.lit("-U"), F.lpad(F.col("ordinal").cast("string"), F.greatest(F.lit(3), F.length(F.col("ordinal").cast("string"))), F.lit("0")))
    rows = rows.withColumns({"unit_type": kind, "unit_id": name, "table_id": F.when(F.col("table_no").isNotNull(), F.concat(F.lit("S"), "section", F.lit("-T"), F.col("table_no").cast("string")))})
    here = Window.partitionBy(doc, "section").orderBy("seq")
    before, after = here.rowsBetween(Window.unboundedPreceding, -1), here.rowsBetween(1, Window.unboundedFollowing)
    figure, plain = F.when(F.col("unit_type") == "figure", F.col("unit_id")), F.when(~F.col("unit_type").isin("warning", "note", "caption", "figure"), F.col("unit_id"))
    near = F.coalesce(F.lag(figure).over(here), F.lead(figure).over(here))
    content = F.coalesce(F.last(plain, True).over(before), F.first(plain, True).over(after))
    target = F.when(F.col("unit_type") == "caption", near).when(F.col("unit_type").isin("warning", "note"), content)
    relation = F.when(target.isNotNull(), F.when(F.col("unit_type") == "caption", "caption_of").otherwise(F.concat("unit_type", F.lit("_for"))))
    return rows.select(doc, "unit_id", "section", "seq", "unit_type", "table_id", "headers", "content", relation.alias("relation"), target.alias("target"))


def number_map(elements: DataFrame, doc: str, kept: Column) -> DataFrame:
    """Old and new numbers of sections if only those headings stay for which `kept` holds: doc, section, seq, number, state (exact; merged into the nearest section
    above that stays; unresolved, number null)."""
    heads = numbered(elements, doc).where("ordinal = 0").withColumn("_kept", F.coalesce(kept, F.lit(False)))
    stay = heads.where("_kept")
    fresh = numbered(stay, doc).select(F.col(doc).alias("_d"), F.col("seq").alias("_q"), F.col("section").alias("fresh"))
    exact = stay.join(fresh, F.col(doc).eqNullSafe(F.col("_d")) & (F.col("seq") == F.col("_q"))).select(doc, "section", "seq", F.col("fresh").alias("number"))
    gone = heads.where("not _kept")
    up = _above(gone, doc, exact).withColumnsRenamed({doc: "_d", "section": "_s"})
    held = exact.select(F.col(doc).alias("_e"), F.col("section").alias("_n"), F.col("number"))
    merged = gone.join(up, F.col(doc).eqNullSafe(F.col("_d")) & (F.col("section") == F.col("_s")), "left").join(held, F.col(doc).eqNullSafe(F.col("_e")) & (F.col("near") == F.col("_n")), "left")
    merged = merged.select(doc, "section", "seq", "number", F.when(F.col("number").isNull(), "unresolved").otherwise("merged").alias("state"))
    return exact.withColumn("state", F.lit("exact")).unionByName(merged)


def resolved(references: DataFrame, numbers: DataFrame, doc: str) -> DataFrame:
    """references (doc, target: an old number, phrase that shows it) with number, state and shown: the phrase with the new number where there is one.

    Only the whole number is replaced: 1.2 is not part of 11.2 or 1.2.3.
    """
    known = numbers.select(F.col(doc).alias("_d"), F.col("section").alias("_t"), "number", "state")
    rows = references.join(known, F.col(doc).eqNullSafe(F.col("_d")) & (F.col("target") == F.col("_t")), "left").drop("_d", "_t")
    whole = F.concat(F.lit(r"(?<![\d.])"), F.replace("target", F.lit("."), F.lit(r"\.")), F.lit(r"(?!\.?\d)"))
    return rows.withColumns({"state": F.coalesce("state", F.lit("unresolved")), "shown": F.when(F.col("number").isNull(), F.col("phrase")).otherwise(F.regexp_replace("phrase", whole, F.col("number")))})

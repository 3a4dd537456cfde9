"""HTML pages as typed elements in reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = r"<(h[1-6]|p|li|td|th)\b[^>]*>(.*?)</\1>"
HIDDEN = r"(?s)<(script|style|nav|footer|header|aside)\b[^>]*>.*?</\1>"


def plain(html: Column) -> Column:
    """Text without tags and with the common entities resolved."""
    text = F.regexp_replace(html, r"<[^>]*>", "")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, seq, element_type (heading, paragraph, list_item, cell), level (of headings), content; empty elements go."""
    body = F.regexp_replace(html_col, HIDDEN, "")
    blocks = F.regexp_extract_all(body, F.lit("(?s)(" + BLOCK.replace(r"\1", r"\2") + ")"), F.lit(1))
    rows = pages.select(F.col(id_col), F.posexplode(blocks).alias("seq", "raw"))
    tag = F.lower(F.regexp_extract("raw", r"^<([a-zA-Z0-9]+)", 1))
    kind = F.when(tag.rlike("^h[1-6]$"), "heading").when(tag == "p", "paragraph").when(tag == "li", "list_item").otherwise("cell")
    level = F.when(tag.rlike("^h[1-6]$"), F.substring(tag, 2, 1).cast("int"))
    return rows.select(id_col, "seq", kind.alias("element_type"), level.alias("level"), plain(F.col("raw")).alias("content")).where("content != ''")


def metadata(pairs: DataFrame, keys: dict[str, str]) -> DataFrame:
    """pairs: doc_id, seq, label, value. keys: name and the whole words its label holds. The first value that is not blank wins."""
    name = F.lit(None).cast("string")
    for key, pattern in keys.items():
        name = F.coalesce(name, F.when(F.lower("label").rlike(rf"\b({pattern})\b"), F.lit(key)))
    some = pairs.withColumn("name", name).where("name is not null and trim(coalesce(value, '')) != ''")
    return some.groupBy("doc_id", "name").agg(F.min_by(F.trim("value"), "seq").alias("value"))


LEAD = 7  # level of a bold lead: below every heading tag
OUTLINE = "(?s)" + "|".join([r"<p\b[^>]*><b>[^<]*<br>", *[rf"<{t}\b[^>]*>.*?</{t}>" for t in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "tr")], r"<img\b[^>]*>"])


def outline(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, seq (from 0, gapless), level (1 to 6 by tag, 7 for a bold lead; null for content), kind (heading, paragraph, list_item, row, figure), header
    (of rows), content. Cells of a row are joined by ' | '; a figure's content is its alt text or '[Figure]'; empty elements go."""
    blocks = F.regexp_extract_all(F.regexp_replace(html_col, HIDDEN, ""), F.lit(OUTLINE), F.lit(0))
    rows = pages.select(F.col(id_col), F.posexplode(blocks).alias("at", "raw"))
    tag = F.regexp_extract("raw", r"^<([a-z0-9]+)", 1)
    lead = F.col("raw").rlike(r"<br>$") & (tag == "p")
    level = F.when(lead, LEAD).when(tag.rlike("^h[1-6]$"), F.substring(tag, 2, 1).cast("int"))
    kind = F.when(level.isNotNull(), "heading").when(tag == "p", "paragraph").when(tag == "li", "list_item").when(tag == "tr", "row").otherwise("figure")
    cells = F.array_join(F.filter(F.transform(F.regexp_extract_all("raw", F.lit(r"(?s)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), plain), lambda c: c != ""), " | ")
    alt = plain(F.regexp_extract("raw", r'\balt="([^"]*)"', 1))
    content = F.when(kind == "row", cells).when(kind == "figure", F.when(alt != "", alt).otherwise("[Figure]")).otherwise(plain(F.col("raw")))
    rows = rows.select(id_col, "at", level.alias("level"), kind.alias("kind"), ((kind == "row") & F.contains("raw", F.lit("<th"))).alias("header"), content.alias("content")).where("content != ''")
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(id_col).orderBy("at")) - 1).drop("at")

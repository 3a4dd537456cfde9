"""Trees: numbers by a plain stack, fixtures with tables, figures and captions, number maps."""

import random

import pytest
from pyspark.sql import functions as F

from folium.plans import tree as T
from folium.sources import pages as P

SCHEMA = "doc long, seq int, level int, kind string, header boolean, content string"


def made(seed, n):
    draw, rows = random.Random(seed), []
    for d in range(4):
        for i in range(n):
            level = draw.choice([None, None, 1, 2, 3, 4, 9, 2])
            rows.append((d, i, level, "heading" if level else draw.choice(["paragraph", "list_item", "row"]), draw.random() < 0.3, f"w{i} " * draw.randint(1, 4)))
    return rows


def walked(rows):
    """(doc, seq) -> (path, ordinal), by walking each document."""
    out = {}
    for d in sorted({r[0] for r in rows}):
        stack, counts, path, ordinal = [], {(): 0}, "0", 0
        for _, seq, level, *_ in [r for r in rows if r[0] == d]:
            if level is None:
                ordinal += 1
                out[d, seq] = (path, ordinal)
                continue
            while stack and stack[-1][0] >= level:
                stack.pop()
            above = tuple(n for _, n in stack)
            counts[above] = counts.get(above, 0) + 1
            stack.append((level, counts[above]))
            counts.pop((*above, counts[above]), None)
            path, ordinal = ".".join(str(n) for _, n in stack), 0
            out[d, seq] = (path, 0)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_numbers_equal_a_walk(spark, seed):
    rows = made(seed, 150)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {(r.doc, r.seq): (r.section, r.ordinal) for r in T.numbered(df, "doc").collect()}
    assert got == walked(rows)
    # whatever the size of batches
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {(r.doc, r.seq): (r.section, r.ordinal) for r in T.numbered(df, "doc").collect()} == got
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_units_hold_every_word_once(spark):
    rows = made(3, 120)
    df = spark.createDataFrame(rows, SCHEMA)
    units = T.units(df, "doc").collect()
    assert sorted(w for u in units for w in u.content.split()) == sorted(w for r in rows if r[2] is None for w in r[5].split())
    assert len({(u.doc, u.unit_id) for u in units}) == len(units)


HTML = """<html><nav><p>skip</p></nav><p>Before.</p><h1>One</h1><p>Text.</p><img src="a" alt="Pump"><p>Figure 1: the pump</p><h3>Deep</h3><p>Warning: hot</p><p>Turn it.</p>
<p>Note that it turns</p><table><tr><th>Name</th><th>Use</th></tr><tr><td>A</td><td>a &amp; b</td></tr><tr><td>B</td><td></td></tr></table><p>x</p><table><tr><td>C</td></tr></table>
<h2>Reference list</h2><ul><li>First</li></ul><h1>Empty step</h1><h2>Inner</h2><p>End.<br></p><p><b>Lead<br><p>Led.</p></html>"""


def test_page_with_tables_and_figures(spark):
    pages = spark.createDataFrame([(1, HTML), (2, None), (3, "")], "page_id long, html string")
    elements = P.outline(pages)
    units = {u.unit_id: u for u in T.units(elements, "page_id").collect()}
    assert {k: (u.unit_type, u.content) for k, u in units.items()} == {
        "S0-U001": ("paragraph", "Before."), "S1-U001": ("paragraph", "Text."), "S1-U002": ("figure", "Pump"), "S1-U003": ("caption", "Figure 1: the pump"),
        "S1.1-U001": ("warning", "Warning: hot"), "S1.1-U002": ("paragraph", "Turn it."), "S1.1-U003": ("note", "Note that it turns"), "S1.1-U004": ("table_header", "Name | Use"),
        "S1.1-U005": ("table_row", "A | a & b"), "S1.1-U006": ("table_row", "B"), "S1.1-U007": ("paragraph", "x"), "S1.1-U008": ("table_row", "C"), "S1.2-U001": ("bullet", "First"),
        "S2.1-U001": ("paragraph", "End."), "S2.1.1-U001": ("paragraph", "Led."),
    }
    assert (units["S1-U003"].relation, units["S1-U003"].target) == ("caption_of", "S1-U002")
    assert (units["S1.1-U001"].relation, units["S1.1-U001"].target) == ("warning_for", "S1.1-U002")
    assert (units["S1.1-U003"].relation, units["S1.1-U003"].target) == ("note_for", "S1.1-U002")
    assert [units[f"S1.1-U00{i}"].headers for i in (5, 6, 8)] == ["Name | Use", "Name | Use", None]
    assert [units[f"S1.1-U00{i}"].table_id for i in (4, 6, 7, 8)] == ["S1.1-T1", "S1.1-T1", None, "S1.1-T2"]
    chunks = {c.section: c for c in T.chunks(elements, "page_id", bare=False).collect()}
    assert {k: c.parent for k, c in chunks.items()} == {"0": None, "1": "0", "1.1": "1", "1.2": "1", "2.1": "0", "2.1.1": "2.1"}
    assert chunks["1.2"].chunk_type == "reference" and chunks["1.2"].content == "# Reference list\n\n- First" and chunks["1.1"].has_table and chunks["1"].has_image
    whole = {c.section: (c.parent, c.sequence, c.chunk_type) for c in T.chunks(elements, "page_id").collect()}
    assert whole["2"] == ("0", 4, "procedure") and whole["2.1"][0] == "2"


def test_number_map_and_references(spark):
    heads = [(1, 1, "a"), (2, 2, "b"), (3, 3, "gone c"), (4, 3, "d"), (5, 1, "gone e"), (6, 2, "gone f"), (7, 1, "g"), (8, 4, "h")]
    rows = [(1, i, n, "heading", False, t) for i, n, t in heads] + [(1, 0, None, "paragraph", False, "p"), (1, 9, None, "paragraph", False, "q")]
    numbers = T.number_map(spark.createDataFrame(rows, SCHEMA), "doc", ~F.col("content").startswith("gone"))
    assert {r.section: (r.number, r.state) for r in numbers.collect()} == {
        "1": ("1", "exact"), "1.1": ("1.1", "exact"), "1.1.1": ("1.1", "merged"), "1.1.2": ("1.1.1", "exact"), "2": (None, "unresolved"), "2.1": (None, "unresolved"), "3": ("2", "exact"), "3.1": ("2.1", "exact"),
    }
    refs = spark.createDataFrame([(1, "3.1", "see 3.1, 13.1, 3.1.4 and 3.1."), (1, "2.1", "section 2.1"), (1, "9", "part 9"), (2, "3", "3")], "doc long, target string, phrase string")
    got = {(r.doc, r.target): (r.shown, r.state) for r in T.resolved(refs, numbers, "doc").collect()}
    assert got == {(1, "3.1"): ("see 2.1, 13.1, 3.1.4 and 2.1.", "exact"), (1, "2.1"): ("section 2.1", "unresolved"), (1, "9"): ("part 9", "unresolved"), (2, "3"): ("3", "unresolved")}


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert T.chunks(none, "doc").collect() == T.units(none, "doc").collect() == T.number_map(none, "doc", F.lit(True)).collect() == []

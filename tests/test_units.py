"""Runs of units, merged table rows and places in a total order: known cases at the edges."""

import random

from pyspark.sql import functions as F

from folium.operators import ordered, units

UNITS = [
    ("a", 1, "paragraph", "Wear gloves.", True, None), ("a", 2, "paragraph", "Laboratory", False, None), ("a", 3, "bullet", "Warehouse ", False, None), ("a", 4, "paragraph", "It ends here.", False, None), ("a", 5, "bullet", "Office", False, None),
    ("a", 6, "paragraph", "You need:", True, None), ("a", 7, "bullet", "a pump", False, None), ("a", 8, "bullet", "a hose:", False, None), ("a", 9, "bullet", "long", False, None), ("a", 10, "procedure_step", "Start", False, None),
    ("b", 1, "table_row", "r1", False, "t1"), ("b", 2, "table_row", "r2", False, "t1"), ("b", 3, "table_row", "r3", False, "t2"), ("b", 4, "paragraph", "Then:", False, None), ("b", 5, "table_row", "r4", False, "t2"), ("b", 6, "procedure_step", "Go:", False, None), ("b", 7, "procedure_step", "Stop", True, None),
]


def frame(spark):
    return spark.createDataFrame(UNITS, "section string, seq int, unit_type string, text string, icon boolean, table_id string")


def test_icon_units_take_their_labels(spark):
    got = {(r["section"], r["seq"]): r["head"] for r in units.icon_rows(frame(spark)).collect()}
    assert {k: v for k, v in got.items() if v != k[1]} == {("a", 2): 1, ("a", 3): 1, ("a", 7): 6}


def test_labels_end_where_their_last_character_is(spark):
    ends = ["", ".", ".\n", "\n.", "\n", ". ", ".\u00a0", ".\u00a0\n", ";\u3000", ":\u2003 "]
    rows = [("s", 2 * i + k, "bullet", ("icon", f"Office{end}")[k], k == 0) for i, end in enumerate(ends) for k in (0, 1)]
    rows += [("t", 0, "bullet", "icon", True), ("t", 1, None, "no type", False), ("t", 2, "bullet", "Office", False), ("u", 0, "bullet", "icon", True), ("u", 1, "bullet", "\u00a0", False), ("u", 2, "bullet", "x" * 80 + "\u3000", True), ("u", 3, "bullet", "\u2003" + "x" * 80, False)]
    got = {(r["section"], r["seq"]): r["head"] for r in units.icon_rows(spark.createDataFrame(rows, "section string, seq int, unit_type string, text string, icon boolean")).collect()}
    assert {ends[seq // 2] for (s, seq), head in got.items() if s == "s" and head != seq} == {"", ".\n", "\n", ".\u00a0\n"}
    assert {k: v for k, v in got.items() if k[0] != "s" and v != k[1]} == {("u", 3): 2}


def test_rows_of_a_table_are_one_item(spark):
    got = sorted((r["section"], r["first"], r["n"]) for r in units.items(frame(spark)).collect())
    assert [x for x in got if x[0] == "b"] == [("b", 1, 2), ("b", 3, 1), ("b", 4, 1), ("b", 5, 1), ("b", 6, 1), ("b", 7, 1)]


def test_lists_behind_a_colon(spark):
    got = sorted(tuple(r) for r in units.extended_lists(frame(spark)).collect())
    assert got == [("a", 6, 7), ("a", 6, 8), ("a", 6, 9), ("a", 8, 9), ("b", 6, 7)]


def test_rows_without_key_continue_the_row_above(spark):
    rows = [
        ("t", 0, 0, "Role"), ("t", 0, 1, "Duty"), ("t", 1, 0, ""), ("t", 1, 1, "under the header"), ("t", 2, 0, "Owner"), ("t", 2, 1, "approves"), ("t", 3, 0, None), ("t", 3, 1, "and reviews"),
        ("t", 4, 0, " "), ("t", 4, 1, "each year"), ("t", 5, 0, ""), ("t", 5, 1, ""), ("t", 6, 0, ""), ("t", 6, 1, "after a blank row"),
    ]
    got = {(r["row_index"], r["col"]): r["text"] for r in units.continued_rows(spark.createDataFrame(rows, "table_id string, row_index int, col int, text string")).collect()}
    assert got[(2, 1)] == "approves and reviews each year" and (3, 1) not in got and got[(1, 1)] == "under the header" and got[(6, 1)] == "after a blank row"


def test_places_are_those_of_one_sort(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2, 3]), rng.randrange(5), i) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int, id int")
    got = {r["id"]: r["place"] for r in ordered.places(df, F.col("a").asc_nulls_last(), F.desc("b"), "id").collect()}
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, -r[1], r[2]))
    assert got == {r[2]: i for i, r in enumerate(want, 1)}
    assert ordered.places(df.where("id < 0"), "id").count() == 0

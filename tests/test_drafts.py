"""Known cases of draft operators that have no SQL twin."""

import pytest

from folium.operators import records
from folium.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_clean_splits(spark):
    found = {r.passage_id: r.clean for r in QUERIES["f28_clean_splits"](spark, SF).collect()}
    assert found == {"a": True, "b": False, "c": False, "d": False, "e": True, "f": False}


def test_spread_icons(spark):
    found = {(r.section, r.seq): r.icons for r in QUERIES["w18_spread_icons"](spark, SF).collect()}
    assert found == {("a", 1): "i1", ("a", 2): "i4", ("a", 3): "i2", ("a", 4): "i3", ("b", 1): "j1", ("b", 2): "j2 j4", ("b", 3): "j3", ("c", 1): "", ("c", 2): "k1 k2"}


def test_roles(spark):
    found = {r.n: r.roles for r in QUERIES["f13_roles"](spark, SF).collect()}
    assert found[1] == "Manager, Quality Manager" and found[7] == "Head of Quality Control" and found[5] == ""
    assert found[4] == "Head"  # the leftmost match begins with the capital before it
    assert found[2] == "QA Manager, Site QA Manager" and found[3] == "QA Manager, Site QA Manager"


def test_updates_only_in_allowed_columns(spark):
    rows, changes = spark.sql("SELECT 1 AS id, 'a' AS name"), spark.sql("SELECT 1 AS id, 'b' AS other")
    with pytest.raises(ValueError, match="other"):
        records.updated(rows, changes, "id", ("name",))

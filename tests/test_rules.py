"""Unit labels and ids on known cases."""

from pyspark.sql import functions as F

from folium.functions import signals as S
from folium.operators import rules as R


def test_labels_are_shares(spark):
    rows = [(1, "The purpose and goal: apply before use.", "paragraph"), (2, "Water is wet.", "paragraph"), (3, None, "warning"), (4, "never never never never NEVER; then go", "paragraph"), (5, "notable steps", "paragraph")]
    units = spark.createDataFrame(rows, "unit_id int, text string, unit_type string")
    got = {}
    for r in R.unit_labels(units, ["unit_id"], types={"warning": ("restriction", 1.0)}).collect():
        got.setdefault(r.unit_id, {})[r.label] = round(r.weight, 4)
    assert got == {1: {"purpose": 0.5, "scope": 0.25, "prerequisite": 0.25}, 2: {"other": 1.0}, 3: {"restriction": 1.0}, 4: {"restriction": 0.75, "step": 0.25}, 5: {"step": 1.0}}


def test_labels_by_all_evidence(spark):
    """No cue is left out, and ids, kinds, phrases and scopes count too."""
    rows = [
        (1, "the the the the the der", "paragraph"), (2, "see AB-100-7", "reference"), (3, "XY-100", "table_row"), (4, "one two three four five six seven eight XY-100", "paragraph"), (5, "Never open.", "warning"),
        (6, "It applies to sites, sites and regions.", "paragraph"), (7, "Sites in scope.", "paragraph"), (8, "applies applies applies", "paragraph"), (9, None, None), (10, "Prior to step 2: its purpose", "definition"),
    ]
    units = spark.createDataFrame([(*r, ["AB-100"]) for r in rows], "unit_id int, text string, kind string, own array<string>").withColumn("unit_type", F.col("kind"))
    units = R.content_evidence(units, r"[A-Z]{2}-\d{3,}(?:-\d+)*", F.col("own"), F.col("kind"))
    got = {}
    for r in R.unit_labels(units, ["unit_id"], {"english": ("the",), "german": ("der",)}, other="supporting_information", cap=None, each=10, more=units["evidence"]).collect():
        got.setdefault(r.unit_id, {})[r.label] = r.weight
    assert got == {
        1: {"english": 5 / 6, "german": 1 / 6}, 2: {"associated_document": 1.0}, 3: {"reference": 1.0}, 4: {"reference": 0.4, "supporting_information": 0.6}, 5: {"restriction": 1.0},
        6: {"scope": 1.0}, 7: {"supporting_information": 1.0}, 8: {"scope": 1.0}, 9: {"supporting_information": 1.0}, 10: {"definition": 20 / 43, "purpose": 10 / 43, "prerequisite": 8 / 43, "ordered_procedure": 5 / 43},
    }


def test_own_and_part_ids(spark):
    units = spark.createDataFrame([("a", 0, "Plan AB-100"), ("a", 1, "see AB-100-7, XY-1000 and AB-100"), ("b", 0, "none"), ("b", 1, "AB-100-7"), ("c", 0, None)], "document string, n int, text string")
    form = r"[A-Z]{2}-\d{3,}(?:-\d+)*"
    own = R.own_ids(units, form, F.col("n") == 0)
    assert [tuple(r) for r in own.collect()] == [("a", "AB-100")]
    assert [tuple(r) for r in R.part_ids(units, own, form).collect()] == [("a", "AB-100", "AB-100-7")]


def test_roles(spark):
    texts = ["The Quality  Manager and each Head of Site Operations sign; the Manager files.", "Process Owner Name is blank", "nothing", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(S.roles(F.col("t"))).collect()]
    assert got[0] == ["Head of Site Operations", "Manager", "Quality Manager"] and got[2] == []

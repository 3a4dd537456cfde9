"""Facts in text: known sentences and their canonical forms; trees of titles."""

import pytest
from pyspark.sql import functions as F

from folium.functions import facts as X
from folium.plans import chunking

VALUES = [
    ("finish within three working days", "deadline:<=3 business_day"), ("hold for 12 calendar days", "duration:12 calendar_day"), ("twice a month", "frequency:2/1 month"),
    ("every 12 months", "frequency:1/1 year"), ("at least 80 %", "percentage:>=80%"), ("weigh 2,500 mg", "number:2500 mg"), ("on 3 March 2024 or 04.03.2024", "date:2024-03-03,date:2024-03-04"),
    ("see section 2.4 and table 7", ""), ("between 4 and 2.50 kg, every two weeks", "frequency:1/2 week,number:2.5 kg,number:4"), ("Released 2024-05-06", "date:2024-05-06"), ("", ""),
]
MODALITIES = [
    ("Operators must wear gloves.", "obligation"), ("Gloves must not be reused.", "prohibition"), ("The file may be archived and should be signed.", "permission recommendation"),
    ("Approved in May 2024.", ""), ("Staff are required to log in; they can never share keys.", "capability obligation prohibition"), ("It rains.", ""),
]


def column(spark, texts, make):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    return [r[0] for r in rows.orderBy("id").select(make(F.col("t"))).collect()]


def test_values_in_canonical_form(spark):
    form = lambda t: F.array_join(F.array_sort(F.transform(X.values(t), lambda v: F.concat_ws(":", v["kind"], X.canonical(v["kind"], v["raw"])))), ",")
    assert column(spark, [t for t, _ in VALUES], form) == [w for _, w in VALUES]


def test_values_look_once_for_each_kind(spark):
    rows = spark.createDataFrame([(t,) for t, _ in VALUES], "t string").withColumn("u", F.upper("t"))
    found = X.with_values(rows, "u", "v")
    assert [r["v"] for r in found.collect()] == [r["v"] for r in rows.select(X.values("u").alias("v")).collect()] and found.columns == ["t", "u", "v"]
    found = found.select(F.transform("v", lambda v: v["raw"]).alias("raw"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") < len(X.CLAIMS) and plan.count("regexp_extract_all(") == len(X.CLAIMS) - 1


def test_modalities(spark):
    assert column(spark, [t for t, _ in MODALITIES], lambda t: F.array_join(F.array_sort(X.modalities(t)), " ")) == [w for _, w in MODALITIES]


@pytest.mark.parametrize("text,want", [("The Standard Operating Procedure (SOP) names it.", ["SOP=Standard Operating Procedure"]), ("Report each deviation (XY).", []), ("", [])])
def test_abbreviations_need_their_initials(spark, text, want):
    assert column(spark, [text], lambda t: F.transform(X.abbreviations(t), lambda x: F.concat_ws("=", x["abbr"], x["full"]))) == [want]


def test_paths_of_a_deep_tree(spark):
    deep = [(f"n{i}", f"n{i - 1}" if i else None, f"T{i}") for i in range(40)]
    rows = deep + [("b", "n39", "leaf"), ("lost", "nobody", "orphan"), ("x", "y", "X"), ("y", "x", "Y")]
    got = {r["node_id"]: r["path"] for r in chunking.paths_to_root(spark.createDataFrame(rows, "node_id string, parent_id string, title string")).collect()}
    assert got["b"] == " > ".join([f"T{i}" for i in range(40)] + ["leaf"]) and got["lost"] == "orphan" and "x" not in got and len(got) == 42

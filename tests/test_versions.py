"""Versions: two writers, failures, damage, orphans; logs and retention."""

import threading

import pytest
from pyspark.sql import functions as F

from folium.sources import versions as V


def test_versions_count_up_and_stay(spark, tmp_path):
    store = V.Versions(spark, str(tmp_path))
    assert [store.write(spark.range(n), "plan", "s") for n in (3, 4)] == [1, 2] and store.write(spark.range(9), "plan") == 1
    assert store.read("plan", "s").count() == 4 and store.read("plan", "s", 1).count() == 3 and store.read("plan").count() == 9
    with pytest.raises(LookupError):
        store.read("plan", "s", 7)
    with pytest.raises(LookupError):
        store.read("none")
    assert store.clean() == []


def test_two_writers_get_a_version_each(spark, tmp_path, monkeypatch):
    store, got = V.Versions(spark, str(tmp_path)), []
    both = threading.Barrier(2)
    real = V.Versions.numbers

    def together(self, kind, scope=""):
        found = real(self, kind, scope)
        both.wait(60)  # both have seen the same numbers
        return found

    monkeypatch.setattr(V.Versions, "numbers", together)
    writers = [threading.Thread(target=lambda n=n: got.append(store.write(spark.range(n), "plan"))) for n in (5, 6)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    monkeypatch.setattr(V.Versions, "numbers", real)
    assert sorted(got) == [1, 2] and sorted(store.read("plan", version=v).count() for v in (1, 2)) == [5, 6]


def test_a_failed_index_leaves_no_data(spark, tmp_path, monkeypatch):
    store = V.Versions(spark, str(tmp_path))

    def broken(self, path, entry):
        raise OSError("full")

    monkeypatch.setattr(V.Versions, "_enter", broken)
    with pytest.raises(OSError):
        store.write(spark.range(3), "plan")
    assert V._names(spark, f"{tmp_path}/data") == [] and store.numbers("plan") == []


def test_damage_and_orphans_are_found(spark, tmp_path):
    store = V.Versions(spark, str(tmp_path))
    store.write(spark.range(5), "plan")
    spark.range(2).write.parquet(f"{tmp_path}/data/orphan")
    assert store.clean() == ["orphan"]
    (data,) = V._names(spark, f"{tmp_path}/data")
    spark.range(1).write.mode("append").parquet(f"{tmp_path}/data/{data}")
    with pytest.raises(V.Corrupted):
        store.read("plan")


def test_log_rows_and_retention(spark, tmp_path):
    rows = [(1, "2024-01-01 10:00:00", '{"job": "a", "x": 1}'), (2, "2024-01-20 10:00:00", '{"job": "b"}'), (3, "2024-01-31 00:00:00", None), (4, "2024-01-17 00:00:00", "broken")]
    events = spark.createDataFrame(rows, "id int, ts string, extras string").withColumn("ts", F.col("ts").cast("timestamp"))
    out = V.log_rows(events, "extras", ("job", "stage"), F.col("ts"))
    V.append_log(out, f"{tmp_path}/log")
    assert V.retain(spark, f"{tmp_path}/log", "2024-01-31") == ["2024-01-01"]
    got = spark.read.schema(out.schema).parquet(f"{tmp_path}/log").select("id", "job", "stage", F.to_json("extra")).collect()
    assert sorted(map(tuple, got)) == [(2, "b", None, None), (3, None, None, None), (4, None, None, None)]
    first = out.where("id = 1").select("job", F.to_json("extra")).first()
    assert tuple(first) == ("a", '{"x":"1"}')

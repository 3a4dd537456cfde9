"""Rows are told apart by which of their columns are null, and by nested columns."""

from pyspark.sql import functions as F

import corpus_pipeline
from folium.llm import decontaminate, jaccard_join, mixing
from folium.llm._store import row_key

TEXT = "a b c d e f g h i j k l"


def test_key_counts_nulls_and_nested_values(spark):
    rows = [(None, "a", None), ("a", None, None), ("a", "a", {"x": "1"}), ("a", "a", {"x": None}), ("a", "a", None), ("a", "a", {"x": "1"})]
    df = spark.createDataFrame(rows, "p string, q string, m map<string,string>")
    assert df.select(row_key(dict(df.dtypes))).distinct().count() == 5
    nested = spark.createDataFrame([((None, "a"),), (("a", None),)], "s struct<x:string,y:string>")
    assert nested.select(row_key(dict(nested.dtypes))).distinct().count() == 2


def test_mixing_gives_a_row_for_each_row(spark):
    rows = [(None, "a", TEXT), ("a", None, TEXT), ("b", "a", TEXT), ("b", "s", None)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id string, source string, text string")).collect()
    assert len(out) == 4 and len({r._row for r in out}) == 4 and all(r.taken == r.copies * r.size for r in out)


def test_keep_one_keeps_unrelated_rows(spark):
    rows = [(None, "a b c d e f", "x", "s"), ("a b c d e f", "x", None, "s"), ("q", "one two three", "x", "s")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")
    assert sorted(map(str, jaccard_join.keep_one(docs, k=5, percent=80).collect())) == sorted(map(str, docs.collect()))


def test_keep_one_of_equal_rows_and_of_equal_texts(spark):
    rows = [(1, TEXT, "x", None), (1, TEXT, None, "x"), (1, TEXT, None, "x"), (2, TEXT, "x", "y"), (3, None, "x", None), (3, None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = jaccard_join.keep_one(docs, k=5, percent=80).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3] and {tuple(r) for r in kept} <= set(rows)


def test_pipeline_stages_tell_rows_apart(spark, tmp_path):
    rows = [(None, "a", "a", "s"), ("a", None, "a", "s"), ("a", TEXT, None, "t"), (None, TEXT, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")
    spark.createDataFrame([(1, TEXT)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path)).collect()
    assert sorted(map(str, clean)) == sorted(map(str, docs.where("text IS NULL OR text = 'a'").collect()))
    mixed = corpus_pipeline.source_mixing(spark, docs, str(tmp_path))
    want = mixing.mix(docs).agg(F.sum("copies")).first()[0]
    assert mixed.count() == want


def test_decontamination_of_null_ids(spark):
    docs = spark.createDataFrame([(None, TEXT), (5, TEXT), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, TEXT)], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.n_equal) for r in decontaminate.contaminated(docs, items).collect()) == [(0, 12), (5, 12)]

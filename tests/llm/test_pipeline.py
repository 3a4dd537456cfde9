import corpus_pipeline


def test_stages_keep_columns_and_take_effect(spark, docs):
    import os
    import tempfile

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    docs.write.parquet(os.path.join(folder, "documents.parquet"))
    item = docs.where("doc_id = 10").select("text").first()[0]
    spark.createDataFrame([(1, " ".join(item.split()[:25]))], "item_id long, text string").write.parquet(os.path.join(folder, "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(os.path.join(folder, "labels.parquet"))
    rows, n = spark.read.parquet(os.path.join(folder, "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, folder)
        assert rows.columns == docs.columns, name
        n.append(rows.count())
    assert n[0] == docs.count() and n[1] < n[0] and n[2] < n[1] and n[3] > 0
    assert rows.where("doc_id = 10").count() == 0
    out = corpus_pipeline.run(spark, folder)
    assert out.count() == n[3] and out.where("shard_id is null").count() == 0

"""Micro-batches with an idempotent commit, and a queue of jobs on them.

A stream's checkpoint records which batch was last committed; a batch that was cut off runs again with the same rows and the same
number. commit() gives every batch a folder of its own that it overwrites, so running again changes nothing. Readers see whole batches
only: a batch counts once its marker is written, after its rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folium.operators.lineage import shared_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def replay(table: DataFrame, order: str, slices: int, folder: str) -> DataFrame:
    """A finished table as a stream of `slices` micro-batches in order of a column: each is written as one file after the one before, and read one at a time."""
    spark = table.sparkSession
    number = F.unix_micros(F.col(order).cast("timestamp")) if dict(table.dtypes)[order].startswith("timestamp") else F.col(order).cast("long")
    low, high = table.agg(F.min(number), F.max(number)).first()
    if low is None:
        low = high = 0
    edges = [low + (high - low + 1) * i // slices for i in range(1, slices)]
    part = sum([F.when(number >= edge, 1).otherwise(0) for edge in edges], F.lit(0))  # nulls come first
    for i in range(slices):
        table.where(part == i).coalesce(1).write.parquet(f"{folder}/slice={i:04d}")
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/slice=*")


def commit(folder: str, side: Column | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function. Rows for which `side` holds go to a table of their own."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if side is None:
            batch.write.mode("overwrite").parquet(f"{folder}/main/batch={number}")
        else:
            marked = batch.withColumn("_side", F.coalesce(side, F.lit(False)))
            marked.write.mode("overwrite").partitionBy("_side").parquet(f"{folder}/split/batch={number}")
        spark.range(1).write.mode("overwrite").parquet(f"{folder}/done/batch={number}")

    return write


def committed(spark: SparkSession, folder: str, schema: str, side: bool | None = None) -> DataFrame:
    """The rows of whole batches; side: those of the side output (True) or the main one (False) where commit() split them."""
    done = spark.read.parquet(f"{folder}/done").select("batch").distinct()
    if side is None:
        rows = spark.read.schema(f"{schema}, batch int").parquet(f"{folder}/main")
    else:
        rows = spark.read.schema(f"{schema}, batch int, _side boolean").parquet(f"{folder}/split").where(F.col("_side") == side).drop("_side")
    return rows.join(F.broadcast(done), "batch", "left_semi").drop("batch")


def run(stream: DataFrame, folder: str, side: Column | None = None, write: Callable[[DataFrame, int], None] | None = None, data_only: bool = False) -> str:
    """Runs a stream over all that is there; where a run was cut off, it goes on. Returns folder.

    data_only: no batches without rows; state with a time to live asks for such batches for ever, and a run of what is there would not end.
    """
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false" if data_only else before)
    try:
        query = stream.writeStream.foreachBatch(write or commit(folder, side)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    finally:
        conf.set(name, before)
    query.awaitTermination()
    return folder


class Queue:
    """Jobs in the order they were submitted, worked off in micro-batches.

    handle: jobs -> results, a DataFrame with the job's columns that it keys on, `status` (done or failed) and whatever it finds. A job that fails is a row
    like any other; a run that dies is started again and gives each job once.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, per_batch: int = 1):
        self.spark, self.folder, self.schema, self.per_batch = spark, folder, schema, per_batch

    def submit(self, jobs: DataFrame) -> None:
        """Adds one file of jobs to the end of the queue; what is submitted at once is worked off at once."""
        jobs.coalesce(1).write.mode("append").parquet(f"{self.folder}/jobs")

    def work(self, handle: Callable[[DataFrame], DataFrame], before_commit: Callable[[int], None] | None = None) -> None:
        """Works off what is queued. before_commit: called with a batch's number when its rows are written and not yet committed."""
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.per_batch).parquet(f"{self.folder}/jobs")
        write = commit(self.folder)

        def batch(jobs: DataFrame, number: int) -> None:
            write(handle(jobs).withColumn("batch_no", F.lit(number)), number)
            if before_commit:
                before_commit(number)

        run(stream, self.folder, write=batch)

    def results(self, schema: str) -> DataFrame:
        return committed(self.spark, self.folder, f"{schema}, batch_no int")

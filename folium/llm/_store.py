"""Cutting lineage: intermediate tables go to the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_own: dict[str, str] = {}  # by application


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset a new temporary one, on a single machine only."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        folder = _own[app] = _own.get(app) or tempfile.mkdtemp(prefix="spark-folium-", dir="/tmp")
    return folder.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again, so that later steps
    neither compute it twice nor depend on the executors that made it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def done(*tables: DataFrame) -> None:
    """Deletes the files of tables that cut() gave and that nothing reads any more."""
    for table in tables:
        for file in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            jvm = table.sparkSession.sparkContext._jvm
            folder = jvm.org.apache.hadoop.fs.Path(file)
            folder.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def row_key(columns: dict[str, str]) -> Column:
    """A 64-bit hash of some columns (name: type) that tells which of them are null. Nested values are hashed as JSON with their nulls."""
    parts = []
    for name, kind in columns.items():
        nested = any(x in kind for x in ("map<", "struct<", "array<"))
        parts += [F.col(name).isNull(), F.to_json(F.struct(F.col(name)), {"ignoreNullFields": "false"}) if nested else F.col(name)]
    return F.xxhash64(*parts)


def split_join(rows: DataFrame, groups: DataFrame, key: str, hot: int = 5_000, most: int = 500_000) -> DataFrame:
    """rows joined with groups (one row for each key; n: how many rows have it). The keys of more than `hot` rows are
    few; while there are at most `most` of them they are broadcast, so that their rows stay where they are."""
    large = groups.where(F.col("n") > hot)
    if not 0 < large.count() <= most:
        return rows.join(groups, key)
    large = F.broadcast(large)
    rest = rows.join(large.select(key), key, "left_anti").join(groups.where(F.col("n") <= hot), key)
    return rows.join(large, key).unionByName(rest)


def text_bytes(docs: DataFrame, column: str) -> int:
    """Total UTF-8 bytes of a text column: one number, for choosing partition counts."""
    return docs.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0

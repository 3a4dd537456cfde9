"""The corpus pipeline: quality, near duplicates, benchmark passages, source mix, shards.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but the
last return the columns of documents. A stage's output is written and read again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folium.llm import decontaminate, jaccard_join, mixing, quality, shard
from folium.llm._store import cut, row_key

SHARD_BYTES = 16 << 20
BROADCAST_ROWS = 500_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling does not draw go."""
    return quality.keep_resampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 0.8 or more of five-word shingles one document stays."""
    return jaccard_join.keep_one(docs, k=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    hit = cut(decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("_row").alias("_folium_row")).distinct(), "pipeline-hit")
    hit = F.broadcast(hit) if hit.count() <= BROADCAST_ROWS else hit
    return docs.withColumn("_folium_row", row_key({c: dict(docs.dtypes)[c] for c in ("doc_id", "text")})).join(hit, "_folium_row", "left_anti").select(docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it."""
    copies = mixing.mix(docs).groupBy(F.col("_row").alias("_folium_row")).agg(F.first("copies").alias("_folium_copies")).where("_folium_copies > 0")
    rows = docs.withColumn("_folium_row", row_key({c: dict(docs.dtypes)[c] for c in ("doc_id", "source", "text")})).join(copies, "_folium_row")
    return rows.withColumn("_folium_copy", F.explode(F.sequence(F.lit(1), F.col("_folium_copies")))).select(docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shards."""
    return shard.shard(docs, SHARD_BYTES)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("sharding", sharding),
]

ORACLE_SQL = None  # classifier, mix and hash have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = cut(docs, f"pipeline-{name}")
    return docs

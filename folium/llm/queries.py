"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folium.llm import ann, decontaminate, fill_middle, jaccard_join, licenses, lm_score, mixing, packing, pii, quality, repeats, shard, vector_codes


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


SHARD_BYTES = 16 << 20


def quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.ppm_scores(_read(spark, sf_dir, "documents"), lm_score.held_out_tenth())


def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_components(_read(spark, sf_dir, "documents"), k=4, percent=85)


def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).drop("_row")


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents")).drop("spans")


def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("_row")


def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"), every=100, k=10)


def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("doc_id", "n_bytes", "shard_id", "shard_depth", "shard_bytes", "shard_rows", "oversize")
    return shard.shard(_read(spark, sf_dir, "documents"), SHARD_BYTES).select(*names)


def suffix_array_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.repeated_passages(_read(spark, sf_dir, "documents"), least=50)
    spans = F.array_join(F.transform("passages", lambda p: F.concat_ws(":", p["start"].cast("string"), p["stop"].cast("string"))), ",")
    return found.withColumn("passages", spans)


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_read(spark, sf_dir, "documents"))


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.fill_in_middle(_read(spark, sf_dir, "documents"))
    digests = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256)}
    return cut.withColumns(digests).drop("output")


def vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(_read(spark, sf_dir, "embeddings"))
    coded = vector_codes.label_errors(coded).withColumn("codebooks_sha256", F.lit(vector_codes.digest(books)))
    return coded.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", "codebooks_sha256")


QUERIES = {
    "op1_quality_resampling": quality_resampling,
    "op2_lm_scoring": lm_scoring,
    "op3_ngram_jaccard_join": ngram_jaccard_join,
    "op4_source_mixing": source_mixing,
    "op5_license_scan": license_scan,
    "op6_benchmark_decontamination": benchmark_decontamination,
    "op7_nearest_neighbours": nearest_neighbours,
    "op8_sharding": sharding,
    "op9_suffix_array_repeats": suffix_array_repeats,
    "op10_personal_data": personal_data,
    "op11_best_fit_packing": best_fit_packing,
    "op12_fill_in_middle": fill_in_middle,
    "op13_vector_code_compression": vector_code_compression,
}

ORACLES = {
    "op3_ngram_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(k.class_id, d.doc_id) AS class_id, r.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id
LEFT JOIN (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS class_id FROM (SELECT doc_id, md5(string_agg(s, chr(10) ORDER BY s)) AS s FROM shingles GROUP BY doc_id)) k USING (doc_id)
""",
}

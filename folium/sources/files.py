"""Files: glossary CSV with aliases and problems, artifacts with checked hashes, union of legacy tables, JSON and CSV sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Header names of a glossary and what counts as yes.
HEADERS = {"source_term": ("source_term", "source", "term", "from"), "target_term": ("target_term", "target", "translation", "to"), "note": ("note", "comment", "remark"), "do_not_translate": ("do_not_translate", "dnt", "keep")}
YES = ("1", "yes", "true", "y", "x")


def glossary(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """(entries, problems) of a CSV: headers by alias; rows without a term, without a target to give, or repeated are problems."""
    raw = spark.read.csv(path, header=True, sep=sep, encoding=encoding, mode="PERMISSIVE")
    names = {c.strip().lower().lstrip("﻿"): c for c in raw.columns}
    pick = {k: next((names[a] for a in aliases if a in names), None) for k, aliases in HEADERS.items()}
    columns = [(F.trim(F.col(f"`{c}`")) if c else F.lit(None).cast("string")).alias(k) for k, c in pick.items()]
    rows = raw.select(*columns).withColumn("do_not_translate", F.coalesce(F.lower("do_not_translate").isin(*YES), F.lit(False)))
    rows = rows.withColumn("key", F.lower(F.coalesce("source_term", F.lit(""))))
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.coalesce("target_term", F.lit("")), F.coalesce("note", F.lit(""))))
    problem = F.when(F.col("key") == "", "no term").when((F.coalesce("target_term", F.lit("")) == "") & ~F.col("do_not_translate"), "no target").when(nth > 1, "repeated")
    rows = rows.withColumn("problem", problem)
    return rows.where("problem is null").drop("problem", "key"), rows.where("problem is not null").select("source_term", "target_term", "problem")


def artifacts(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """Files of a folder against an index (name, sha256): ok, changed, unknown or lost."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    both = files.join(index, "name", "full")
    state = F.when(F.col("found").isNull(), "lost").when(F.col("sha256").isNull(), "unknown").when(F.col("found") != F.col("sha256"), "changed").otherwise("ok")
    return both.select("name", state.alias("state"))


def union_of_common(frames: list[DataFrame], wanted: list[str]) -> DataFrame:
    """Rows of tables of different age: their columns in common with the wanted ones, the others null."""
    out = None
    for f in frames:
        part = f.select(*[c for c in f.columns if c in wanted])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    missing = [c for c in wanted if c not in out.columns]
    return out.select(*wanted[:0], *[F.col(c) for c in wanted if c not in missing], *[F.lit(None).cast("string").alias(c) for c in missing])


def clean_json(df: DataFrame) -> DataFrame:
    """One JSON document for each row, without nulls."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias("json"))


def write_version(df: DataFrame, folder: str, kind: str, scope: str, version: int) -> str:
    """Writes an immutable version; fails if it is there."""
    path = f"{folder}/kind={kind}/scope={scope}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def trace_csv(trace: DataFrame, path: str) -> None:
    """Lists become words set apart by spaces."""
    columns = [F.array_join(c, " ").alias(c) if t.startswith("array") else F.col(c) for c, t in trace.dtypes]
    trace.select(*columns).write.mode("errorifexists").csv(path, header=True)


def glossary_lines(entries: DataFrame) -> DataFrame:
    """Entries (source_term, target_term, note, case_sensitive, do_not_translate) as CSV lines, flags as yes or no."""
    flag = lambda c: F.when(F.col(c), "yes").otherwise("no").alias(c)
    row = F.struct("source_term", "target_term", F.coalesce("note", F.lit("")).alias("note"), flag("case_sensitive"), flag("do_not_translate"))
    return entries.select(F.to_csv(row, {"escape": '"', "emptyValue": "", "nullValue": ""}).alias("line"))

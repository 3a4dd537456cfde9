"""Registry of queries: name, DataFrame builder, SQL of the same result."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    """Registers a (spark, sf_dir) -> DataFrame function."""

    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")

    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, relation: str) -> DataFrame:
    """A small inline table for cases the driver tables do not have; the same text stands in the SQL."""
    return spark.sql(f"SELECT * FROM {relation}")


def derived(spark: SparkSession, sf_dir: str, relation: str) -> DataFrame:
    """A relation over given tables, in SQL that Spark and DuckDB both read: what a query takes in, made the same way for both."""
    names = set(re.findall(r"\b(?:FROM|JOIN) ([a-z]+)\b", relation))
    literal = relation.replace("{", "{{").replace("}", "}}")  # braces of its own, JSON for one, stay as they are
    text = re.sub(r"\b(FROM|JOIN) ([a-z]+)\b", r"\1 {\2}", literal)
    return spark.sql(f"SELECT * FROM {text}", **{n: table(spark, sf_dir, n) for n in names})


def inline(columns: str, rows: list[tuple]) -> str:
    """A relation of constants that both Spark and ANSI SQL read."""
    names = [c.strip() for c in columns.split(",")]

    def text(x) -> str:
        if x is None:
            return "CAST(NULL AS VARCHAR(100))"
        if isinstance(x, bool):
            return str(x).lower()
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    lines = ["SELECT " + ", ".join(f"{text(v)} AS {n}" for n, v in zip(names, row, strict=True)) for row in rows]
    return "(" + " UNION ALL ".join(lines) + ") AS inline_rows"

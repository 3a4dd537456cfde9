"""Versioned records and jobs: delete guards, eligibility, drift, resolution carry-over, approval blockers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folium.operators.lineage import settle


def numbered_steps(steps: DataFrame, keys: list[str], order: str, level: str, depth: int = 3) -> DataFrame:
    """Adds number ('1.2.1'): a counter for each level, deeper ones restart."""
    now = list(keys)
    for n in range(1, depth + 1):
        steps = steps.withColumn(f"_n{n}", F.sum((F.col(level) == n).cast("int")).over(Window.partitionBy(*now).orderBy(order)))
        now.append(f"_n{n}")
    parts = F.slice(F.array(*[F.col(f"_n{n}").cast("string") for n in range(1, depth + 1)]), F.lit(1), F.col(level))
    return steps.withColumn("number", F.array_join(parts, ".")).drop(*[f"_n{n}" for n in range(1, depth + 1)])


def roman(n: Column) -> Column:
    """Numbers from 1 to 3999 in Roman form; null for others, which have none."""
    parts = []
    for place, (one, five, ten) in ((1000, "M  "), (100, "CDM"), (10, "XLC"), (1, "IVX")):
        digits = ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)
        parts.append(F.try_element_at(F.array(*[F.lit(x) for x in digits]), (F.floor(n / place) % 10 + 1).cast("int")))
    return F.when(n.between(1, 3999), F.concat(*parts))


def letter(n: Column) -> Column:
    """a, b, ... z, aa, bb, ...; null below 1."""
    return F.when(n >= 1, F.repeat(F.char(F.lit(97) + (n - 1) % 26), (F.floor((n - 1) / 26) + 1).cast("int")))


def eligible(wanted: DataFrame, records: DataFrame) -> DataFrame:
    """wanted: record_id, version (null: the latest); records: record_id, version, status. Adds the version taken and a reason when it cannot be used."""
    last = records.groupBy("record_id").agg(F.max("version").alias("_last"))
    both = wanted.withColumnRenamed("version", "_asked").join(last, "record_id", "left").withColumn("version", F.coalesce("_asked", "_last"))
    both = both.join(records, ["record_id", "version"], "left")
    reason = F.when(F.col("_last").isNull(), "unknown record").when(F.col("status").isNull(), "unknown version").when(~F.col("status").isin("ready", "approved"), "not ready")
    return both.select("record_id", "version", reason.alias("reason"))


def blockers(checks: dict[str, Column], rows: DataFrame, key: str) -> DataFrame:
    """A row for each check that holds."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return rows.select(key, F.explode(names).alias("blocker"))


def revoked_families(tokens: DataFrame) -> DataFrame:
    """tokens: family, token_id, used_times. A token used twice revokes its whole family."""
    again = F.max("used_times").over(Window.partitionBy("family")) > 1
    return tokens.select("family", "token_id", again.alias("revoked"))


def retried(attempts: DataFrame, key: str, most: int = 2) -> DataFrame:
    """attempts: key, attempt, ok. Accepted at the first attempt that is, verbatim after `most`, else pending."""
    first = F.min(F.when(F.col("ok"), F.col("attempt")))
    out = attempts.where(F.col("attempt") <= most).groupBy(key).agg(first.alias("accepted_at"), F.count("*").alias("n"))
    return out.withColumn("state", F.when(F.col("accepted_at").isNotNull(), "accepted").when(F.col("n") >= most, "verbatim").otherwise("pending"))


def reached(seeds: DataFrame, units: DataFrame, passing: DataFrame, key: str, unit: list[str]) -> DataFrame:
    """The keys that a failure of the seeds reaches: a failed key fails its units in `passing`, a failed unit all its keys.

    Each round starts from the keys that the last one has added.
    """
    found = fresh = settle(seeds.select(key).distinct())
    while not fresh.isEmpty():
        failed = passing.join(fresh, key, "left_semi").select(*unit).distinct()
        fresh = settle(units.join(failed, unit, "left_semi").select(key).distinct().join(found, key, "left_anti"))
        found = settle(found.unionByName(fresh))
    return found


def updated(rows: DataFrame, changes: DataFrame, key: str, allowed: tuple[str, ...]) -> DataFrame:
    """Rows with the non-null values of changes by key; a changed column that is not allowed is an error before any work."""
    given = [c for c in changes.columns if c != key]
    unknown = sorted(set(given) - set(allowed))
    if unknown:
        raise ValueError(f"columns that may not be changed: {', '.join(unknown)}")
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in given])
    joined = rows.join(new, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in given else F.col(c) for c in rows.columns])

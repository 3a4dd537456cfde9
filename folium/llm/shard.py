"""Sharding by extendible hashing.

A row's key is 63 bits: 32 of a hash of its id, then 31 of a hash of id and text, so that rows with one
id can be told apart; it is a function of the row, so a lost executor changes nothing. The directory starts
as one bucket; a bucket over the byte limit splits on the next bit, others stay as they are.
Splitting is done on a histogram of key prefixes: only prefixes that are over the limit by
themselves are read again, on more bits. A shard is named by its bits. Rows equal in id and text that are too
many for one shard get a number each, are written once, and are split on by a hash of that number.

Defined cases: a null text has no bytes of text; each row also counts ROW_BYTES. One row over the limit
is a shard of its own, marked oversize. A null id is a value like any other. No row: no shard.
Columns named like the new ones are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from folium.llm._store import cut

KEY_BITS, STEP, ROW_BYTES = 63, 12, 16
BROADCAST_CELLS = 200_000
NAMES = ("shard_id", "shard_depth", "shard_bytes", "shard_rows")


def shard(docs: DataFrame, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_bytes, shard_id (prefix bits), shard_depth, shard_bytes, shard_rows and oversize.

    Every shard holds at most limit_bytes, or one row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    by_id = F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 32)
    by_row = F.shiftrightunsigned(F.xxhash64(F.col(id_col), text), 33)
    keyed = docs.withColumns({"n_bytes": F.octet_length(text).cast("long") + ROW_BYTES, "_folium_key": F.shiftleft(by_id, 31).bitwiseOR(by_row)})
    out, equal = _assign(keyed, limit_bytes)
    if equal is not None:
        same = out.join(equal, "_folium_key", "left_semi").drop(*NAMES[1:])
        same = cut(same.withColumnRenamed("shard_id", "_folium_above").withColumn("_folium_key", F.monotonically_increasing_id()), "shard-equal")
        same = same.withColumn("_folium_key", F.shiftrightunsigned(F.xxhash64("_folium_key"), 1))
        finer, _ = _assign(same, limit_bytes)
        finer = finer.withColumns({"shard_id": F.concat("_folium_above", "shard_id"), "shard_depth": F.col("shard_depth") + KEY_BITS}).drop("_folium_above")
        out = out.join(equal, "_folium_key", "left_anti").unionByName(finer)
    kept = [c for c in docs.columns if c not in (*NAMES, "oversize", "n_bytes")]
    return out.select(*kept, "n_bytes", *NAMES).withColumn("oversize", F.col("shard_bytes") > limit_bytes)


def _assign(keyed: DataFrame, limit_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """keyed (with _folium_key, n_bytes) with its shards, and the keys whose rows are too many for one shard, if any."""
    total = keyed.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(24, max(1, math.ceil(math.log2(max(1, total / limit_bytes))) + 6))
    depths, cells, rows, equal = [depth], None, keyed.select("_folium_key", "n_bytes"), None
    while True:
        found = cut(_cells(rows, depth), "shard-cells")
        heavy = (F.col("bytes") > limit_bytes) & (F.col("rows") > 1)
        over = found.where(heavy)
        n_over = over.count()
        at = over.select(F.col("cell").alias("_over"))
        at = F.broadcast(at) if n_over <= BROADCAST_CELLS else at
        if depth == KEY_BITS and n_over:
            equal = at.withColumnRenamed("_over", "_folium_key")
        last = depth == KEY_BITS or not n_over
        done = found if last else found.where(~heavy)
        cells = done if cells is None else cells.unionByName(done)
        if last:
            break
        rows = rows.join(at, F.shiftright("_folium_key", KEY_BITS - depth) == F.col("_over"), "left_semi")
        depth = min(KEY_BITS, depth + STEP)
        depths.append(depth)
    directory = cut(_directory(cells, limit_bytes), "shard-directory")
    small = directory.count() <= BROADCAST_CELLS
    out = keyed.drop(*NAMES, "oversize")
    for d in depths:
        own = directory.where(F.col("depth") == d).select(F.col("cell").alias(f"_folium_cell{d}"), *[F.col(c).alias(f"_folium_{c}{d}") for c in NAMES])
        own = F.broadcast(own) if small else own
        out = out.withColumn(f"_folium_at{d}", F.shiftright("_folium_key", KEY_BITS - d)).join(own, F.col(f"_folium_at{d}") == F.col(f"_folium_cell{d}"), "left")
    rest = [c for c in keyed.columns if c not in (*NAMES, "oversize")]
    return out.select(*rest, *[F.coalesce(*[F.col(f"_folium_{c}{d}") for d in depths]).alias(c) for c in NAMES]), equal


def _cells(rows: DataFrame, depth: int) -> DataFrame:
    return (
        rows.groupBy(F.shiftright("_folium_key", KEY_BITS - depth).alias("cell"))
        .agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows")).withColumn("depth", F.lit(depth))
    )


def _directory(cells: DataFrame, limit_bytes: int) -> DataFrame:
    """For each cell its shard: the shortest prefix that fits, or the cell itself."""
    up = cells.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("depth")))).withColumn("prefix", F.expr("shiftright(cell, depth - d)"))
    sums = up.groupBy("d", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
    fits = up.join(sums, ["d", "prefix"]).where((F.col("shard_bytes") <= limit_bytes) | (F.col("d") == F.col("depth")))
    best = fits.groupBy("cell", "depth").agg(F.min(F.struct("d", "prefix", "shard_bytes", "shard_rows")).alias("s"))
    bits = F.when(F.col("s.d") == 0, F.lit("")).otherwise(F.expr("lpad(bin(s.prefix), s.d, '0')"))
    return best.select("cell", "depth", bits.alias("shard_id"), F.col("s.d").alias("shard_depth"), "s.shard_bytes", "s.shard_rows")

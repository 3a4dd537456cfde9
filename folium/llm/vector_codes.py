"""Vector code compression by delta-maintained Lloyd rounds in integers.

Vectors become integers floor(scale * x) and are cut into parts; each part position has its codebook. A round reads
each vector with its previous assignment, assigns its parts anew and writes both on; a task also leaves one row with what its
changed parts take from their old entries and bring to their new ones. Only those plus and minus contributions are
shuffled; they are added to the running sums and counts, which are a table of entries x (components + 1) cells, kept from round to round.
A codebook entry is floor(sum / count), so every round is exact and repeatable in whatever order rows come.
Assignments and sums are written to the shared folder, the round before is deleted.

Defined cases: rows whose vector is null or empty, or holds null or non-finite components, take no part, nor do those
with another dimension than the first kept vector; a dimension that the parts do not divide gives the first parts one component more.
Components beyond +-sqrt(2^60 / dimension) after scaling (2^27 for 64) are clipped, so that errors fit 64 bits. Null ids come
after all others, equal ids in the order of their vectors; rows of one id are rows of their own. Fewer rows than entries give fewer
entries; no rows give no rows and empty codebooks. Other columns than id, vector and label are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from folium.llm._store import cut, done

BROADCAST_LABELS = 100_000
STATE = "v binary, codes binary, cells array<int>, moves array<long>"


def _integers(scale: int):
    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = np.floor(scale * pc.fill_null(pc.cast(column.flatten(), pa.float64()), float("nan")).to_numpy(zero_copy_only=False))
            ends = np.cumsum(size)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            kept = np.flatnonzero((size > 0) & (bad[ends] == bad[ends - size]))
            vectors = [np.clip(flat[ends[i] - size[i] : ends[i]], -(limit := int((2**60 / size[i]) ** 0.5)), limit).astype("<i4").tobytes() for i in kept.tolist()]
            at = pa.array(kept)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("label").take(at), pa.array(vectors, pa.binary())], ["id", "label", "v"])

    return integers


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dim).astype(np.int64)


def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry (the lowest of equals) and squared distance of each row of x. Exact: in doubles only where they are."""
    peak = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * peak * peak < 1 << 53 else np.int64
    a, b = x.astype(kind), book.astype(kind)
    apart = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
    best = apart.argmin(1)
    return best.astype(np.uint8), apart[np.arange(len(x)), best].astype(np.int64)


def _round(books: list[np.ndarray], bounds: list[tuple[int, int]], dim: int):
    """Assigns anew; the last row of a task has the cells that its changed parts touch, and by how much."""
    entries, width = len(books[0]), dim + len(bounds)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved, schema = np.zeros(entries * width, np.int64), None
        for batch in batches:
            schema = batch.schema
            x, old = _matrix(batch.column("v"), dim), batch.column("codes").to_pylist()
            fresh = np.array([c is None for c in old], bool)
            before = np.frombuffer(b"".join(bytes(len(bounds)) if c is None else c for c in old), np.uint8).reshape(-1, len(bounds))
            codes = np.empty_like(before)
            for p, (lo, hi) in enumerate(bounds):
                codes[:, p], _ = _nearest(x[:, lo:hi], books[p])
                changed = fresh | (codes[:, p] != before[:, p])
                own = np.c_[np.ones(int(changed.sum()), np.int64), x[changed, lo:hi]]  # count, then components
                cells = moved.reshape(entries, width)[:, lo + p : hi + p + 1]
                np.add.at(cells, codes[changed, p], own)
                np.subtract.at(cells, before[changed & ~fresh, p], own[~fresh[changed]])
            names = [c for c in schema.names if c != "codes"]
            none = [pa.nulls(len(x), pa.list_(pa.int32())), pa.nulls(len(x), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array([c.tobytes() for c in codes], pa.binary()), *none], [*names, "codes", "cells", "moves"])
        touched = np.flatnonzero(moved)
        if len(touched):
            names = [c for c in schema.names if c != "codes"]
            row = [pa.array([touched.tolist()], pa.list_(pa.int32())), pa.array([moved[touched].tolist()], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, schema.field(c).type) for c in names], pa.nulls(1, pa.binary()), *row], [*names, "codes", "cells", "moves"])

    return assign


def _final(books: list[np.ndarray], bounds: list[tuple[int, int]], dim: int):
    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), dim)
            found = [_nearest(x[:, lo:hi], book) for book, (lo, hi) in zip(books, bounds)]
            codes = np.stack([c for c, _ in found], 1)
            error = np.sum([e for _, e in found], axis=0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], ["id", "label", "codes", "error"])

    return final


def compress(
    embeddings: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> tuple[DataFrame, list[np.ndarray]]:
    """id, label, codes (a byte for each part) and error (squared distances, summed) of each vector; the codebooks, one array of entries for each part."""
    if not 0 < entries <= 256:
        raise ValueError("entries: 1 to 256, a code is a byte")
    rows = embeddings.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    own = f"id {rows.schema['id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}"
    state = cut(rows.mapInArrow(_integers(scale), f"{own}, v binary"), "codes-integers")
    firsts = [r["v"] for r in state.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    dim = len(firsts[0]) // 4 if firsts else parts
    firsts = [np.frombuffer(v, "<i4").astype(np.int64) for v in firsts if len(v) == 4 * dim]
    edges = np.cumsum([0, *[dim // parts + (p < dim % parts) for p in range(parts)]]).tolist()
    bounds = list(zip(edges[:-1], edges[1:]))
    books = [np.array([v[lo:hi] for v in firsts], np.int64).reshape(-1, hi - lo) for lo, hi in bounds]
    state = state.where(F.octet_length("v") == 4 * dim).withColumn("codes", F.lit(None).cast("binary"))
    written, sums, width = state, None, dim + parts
    for n in range(rounds if firsts else 0):
        after = cut(state.mapInArrow(_round(books, bounds, dim), f"{own}, {STATE}"), f"codes-round-{n}")
        done(written)
        written, state = after, after.where("cells IS NULL").select("id", "label", "v", "codes")
        moves = after.where("cells IS NOT NULL").select(F.explode(F.arrays_zip("cells", "moves")).alias("m")).select(F.col("m.cells").alias("cell"), F.col("m.moves").alias("x"))
        added = cut((moves if sums is None else moves.unionByName(sums)).groupBy("cell").agg(F.sum("x").alias("x")), f"codes-sums-{n}")
        if sums is not None:
            done(sums)
        sums = added
        table = np.zeros((len(firsts), width), np.int64)
        for r in sums.collect():  # entries x (components + parts) cells
            table.flat[r["cell"]] = r["x"]
        settled = True
        for p, (lo, hi) in enumerate(bounds):
            count, total = table[:, lo + p], table[:, lo + p + 1 : hi + p + 1]
            book = np.where(count[:, None] > 0, total // np.maximum(count, 1)[:, None], books[p])
            settled &= np.array_equal(book, books[p])
            books[p] = book
        if settled:
            break
    if not firsts:
        return state.select("id", "label", "codes", F.lit(0).cast("long").alias("error")).withColumnsRenamed({"id": id_col, "label": label_col}), books
    out = cut(state.mapInArrow(_final(books, bounds, dim), f"{own}, codes binary, error long"), "codes-final")
    done(written, *([] if sums is None else [sums]))
    return out.withColumnsRenamed({"id": id_col, "label": label_col}), books


def label_errors(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """coded with label_error: error summed over the rows of equal label, null ones together."""
    sums = cut(coded.groupBy(F.col(label_col).alias("_folium_label")).agg(F.sum("error").alias("label_error")), "codes-labels")
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums
    return coded.join(sums, F.col(label_col).eqNullSafe(F.col("_folium_label"))).drop("_folium_label")


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all components of all entries, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()

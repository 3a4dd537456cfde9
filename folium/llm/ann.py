"""Approximate nearest neighbours: inverted file of coarse centroids with product-quantised residuals.

Coarse centroids and the codebooks of residuals are fitted on a bounded sample (the rows with the
least hash of id and vector); every row is indexed. A row's list is that of its nearest centroid,
its code the nearest codebook entry for each part of its residual. A query visits the lists nearest to it until
they hold enough rows; there, a table of distances from the query's residual to all codebook entries
gives each code an approximate distance (asymmetric: the query itself is not quantised). The best
of each block are measured again on the original vectors, then all others that may be as near: a row is no
nearer than its code less the distance between the two, which is kept with the code. So nothing is missed in a list, however coarse
its codes are.

Further rounds visit the other lists that may hold a nearer row: no row of a list is nearer than its centroid less
the list's radius. They return only rows as near as the last of those found before. The nearest found are the nearest of all rows, whatever their distribution and that of the queries. Clustered
vectors need few lists; structureless ones need all of them.

Lists, and the queries that visit one, are dealt in blocks of bounded size, so no list, however large, is one task. Equal vectors
are searched for once, and of equal candidates only as many are kept as can be among the nearest of a query,
those of least id: this loses nothing.

Defined cases: vectors that are null, zero, or hold a null or non-finite component take no part, nor do rows without
id or whose length is not the commonest (the greater on a tie). Rows equal in id are rows of their own, as queries and as
candidates of each other. With fewer candidates than k all are returned; ties go to the smaller id. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from folium.llm._store import cut

PART_DIM = 4  # components per code byte
CODES = 256
BLOCK_ROWS, BLOCK_QUERIES = 8_192, 4_096


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    middle = centers.mean(0)  # far from the origin, the products below would lose the differences
    x, centers = x - middle, centers - middle
    return np.argmin((centers**2).sum(1)[None] - 2 * x @ centers.T, axis=1)


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    draw = np.random.default_rng(seed)
    x = x[draw.permutation(len(x))]
    centers = x[:k].copy()
    for _ in range(rounds):
        at = _nearest(x, centers)
        n = np.bincount(at, minlength=len(centers))
        total = np.stack([np.bincount(at, x[:, j], len(centers)) for j in range(x.shape[1])], axis=1)
        centers = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centers)
    return centers


class Index:
    """Centroids and codebooks; bounded by the sample."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int):
        self.centers = _kmeans(sample, min(lists, len(sample)), seed)
        rest = sample - self.centers[_nearest(sample, self.centers)]
        cuts = np.arange(0, sample.shape[1], PART_DIM)
        self.parts = [slice(c, min(c + PART_DIM, sample.shape[1])) for c in cuts]
        self.books = [_kmeans(rest[:, p], min(CODES, len(rest)), seed + 1 + i) for i, p in enumerate(self.parts)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lists, codes, distances to the centroids and to what the codes stand for."""
        at = _nearest(x, self.centers)
        rest = x - self.centers[at]
        codes = np.stack([_nearest(rest[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], axis=1)
        coarse = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)
        return at, codes.astype(np.uint8), np.sqrt((rest**2).sum(1)), np.sqrt(((rest - coarse) ** 2).sum(1))

    def share(self, sample: np.ndarray, k: int, recall: float, tries: int = 256) -> float:
        """The share of rows to visit so that queries from the sample find `recall` of their k nearest in the sample."""
        at = _nearest(sample, self.centers)
        size = np.bincount(at, minlength=len(self.centers))
        ranks = []
        for q in sample[:tries]:
            near = np.argsort(((sample - q) ** 2).sum(1), kind="stable")[1 : k + 1]
            order = np.argsort(((self.centers - q) ** 2).sum(1), kind="stable")
            held = np.empty(len(order))
            held[order] = np.cumsum(size[order])
            ranks += list(held[at[near]] / len(sample))
        return float(np.quantile(ranks, recall, method="higher")) if ranks else 1.0

    def distances(self, query: np.ndarray, center: int, codes: np.ndarray) -> np.ndarray:
        """Approximate squared distances from a query to codes of one list."""
        rest = query - self.centers[center]
        out = np.zeros(len(codes))
        for i, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            out += ((b - rest[p]) ** 2).sum(1)[codes[:, i]]
        return out


def _encoded(shared):
    def encode(batches):
        for rows in batches:
            if len(rows):
                at, codes, far, off = shared.value.encode(np.array(rows["vec"].tolist(), np.float64))
                yield pd.DataFrame({"row": rows["row"], "id": rows["id"], "vec": rows["vec"], "list": at, "code": [c.tobytes() for c in codes], "far": far, "off": off})

    return encode


def _slack(v: np.ndarray, *distances):
    """More than bounds made of these distances from v can be off by rounding."""
    return 1e-9 * (sum(distances) + np.sqrt((v**2).sum()))


def _visits(shared, lists: dict[int, tuple[int, float]], least: int, start: int, stop: int):
    """For each query (row, vec, limit) the lists nearest to it that hold `stop` rows, less those that hold `start`, and less those without a row within the limit."""

    def visits(batches):
        centers = shared.value.centers
        size, radius = (np.array([lists.get(i, (0, 0.0))[j] for i in range(len(centers))]) for j in (0, 1))
        for rows in batches:
            out, held = [], 0
            for query, vec, limit in zip(rows["row"], rows["vec"], rows["limit"], strict=True):
                v = np.asarray(vec, np.float64)
                far = np.sqrt(((centers - v) ** 2).sum(1))
                order = np.argsort(far, kind="stable")
                held_by = np.cumsum(size[order])
                first, last = (max(least, int((held_by < x).sum()) + 1) if x else 0 for x in (start, stop))
                some = order[first:last]
                some = some[(size[some] > 0) & ~(far[some] - radius[some] > limit + _slack(v, far[some], radius[some]))]
                out.append(pd.DataFrame({"query": query, "vec": [vec] * len(some), "limit": limit, "list": some}))
                held += len(some)
                if held > 20_000:
                    yield pd.concat(out)
                    out, held = [], 0
            if held:
                yield pd.concat(out)

    return visits


def _search(shared, keep: int, again: int):
    """Within one block of one list: the nearest for each query, of those within its limit. Codes tell which may be among them; they are measured on the originals."""

    def search(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(block):
            ids, rows, off = (block[c].to_numpy() for c in ("id", "row", "off"))
            vectors = np.array(block["vec"].tolist(), np.float64)
            codes = np.frombuffer(b"".join(block["code"]), np.uint8).reshape(len(block), -1)
            center = int(block["list"].iloc[0])
            for q, v, limit in zip(queries["query"], queries["vec"], queries["limit"], strict=True):
                v = np.asarray(v, np.float64)
                coarse = np.sqrt(shared.value.distances(v, center, codes))
                first = np.argsort(coarse, kind="stable")[:again]
                true = np.sqrt(((vectors[first] - v) ** 2).sum(1))
                most = min(limit, float(np.sort(true)[keep - 1])) if len(true) >= keep else limit
                may = ~(coarse - off > most + _slack(v, coarse, off))  # not-a-number, too, is measured
                may[first] = False
                rest = np.flatnonzero(may)
                near = np.concatenate([first, rest])
                true = np.concatenate([true, np.sqrt(((vectors[rest] - v) ** 2).sum(1))])
                near, true = (x[~(true > limit)] for x in (near, true))
                best = np.lexsort((rows[near], ids[near], true))[:keep]
                found.append(pd.DataFrame({"query": q, "row": rows[near][best], "id": ids[near][best], "score": true[best]}))
        return pd.concat(found) if found else pd.DataFrame({"query": [], "row": [], "id": [], "score": []}).astype({"query": "int64", "row": "int64", "id": "int64"})

    return search


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, sample_rows: int = 20_000, list_rows: int = 256, recall: float = 0.96, again: int = 128, seed: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest other rows of each row whose id is divisible by `every`: query_id, rank, id_col, score (Euclidean distance).

    About sample_rows rows at most fit the index; every row is indexed. There is a list for about list_rows rows, at most sample_rows / 16. A query
    first visits the lists that hold 50 * k rows, then as large a share of the rows as sampled queries need to find `recall` of their neighbours,
    then all other lists that may hold nearer ones, so that none is missed. again: codes measured first in each block.
    """
    ok = F.exists(vec_col, lambda x: x != 0) & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col(id_col).isNotNull() & F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    width = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "d")).alias("m")).first()["m"]
    schema = f"query_id long, rank int, {id_col} long, score double"
    spark = vectors.sparkSession
    if width is None:
        return spark.createDataFrame([], schema)
    rows = cut(rows.where(F.size("vec") == width["d"]).withColumn("row", F.monotonically_increasing_id()), "ann-rows")  # numbered once
    n = rows.count()
    some = rows.withColumn("h", F.xxhash64("id", "vec", F.lit(seed)))
    some = some if n <= sample_rows else some.where(F.col("h") <= F.lit(-(1 << 63) + (1 << 64) * sample_rows // n))
    sample = np.array([r["vec"] for r in sorted(some.select("h", "vec").collect())], np.float64).reshape(-1, width["d"])
    if not len(sample):  # all vectors are alike
        sample = np.array([rows.first()["vec"]], np.float64)
    lists = int(min(max(1, n // list_rows), max(1, sample_rows // 16)))
    index = Index(sample, lists, seed)
    shared = spark.sparkContext.broadcast(index)
    keep = k + 1
    same = Window.partitionBy("vec").orderBy("id", "row")
    some = rows.withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= keep).drop("_r")
    coded = cut(some.mapInPandas(_encoded(shared), "row long, id long, vec array<double>, list int, code binary, far double, off double"), "ann-codes")
    counts = coded.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    size = {r["list"]: (r["n"], r["radius"]) for r in counts.collect()}  # as many as there are lists: bounded
    asked = rows.where(F.col("id") % every == 0)
    distinct = cut(asked.groupBy("vec").agg(F.min("row").alias("row")), "ann-queries")
    enough = max(50 * k, math.ceil(index.share(sample, k, recall) * n))
    rounds = sorted({0, 50 * k, enough, n + 1})
    best = Window.partitionBy("query").orderBy("score", "id", "row")
    spread = lambda c, n: F.pmod(F.xxhash64(c, F.lit(9)), F.col(n)).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def found_in(queries: DataFrame, start: int, stop: int) -> DataFrame:
        visits = queries.repartition("row").mapInPandas(_visits(shared, size, min(4, lists), start, stop), "query long, vec array<double>, limit double, list int")
        visits = cut(visits, "ann-visits")
        asks = {r["list"]: r["n"] for r in visits.groupBy("list").agg(F.count("*").alias("n")).collect()}
        table = [(int(i), math.ceil(c / BLOCK_ROWS), math.ceil(asks.get(i, 0) / BLOCK_QUERIES)) for i, (c, _) in size.items()]
        table = F.broadcast(spark.createDataFrame(table, "list int, blocks int, parts int").where("parts > 0"))
        block = coded.drop("far").join(table, "list").withColumn("block", spread("row", "blocks")).withColumn("part", every_of("parts")).drop("blocks", "parts")
        visits = visits.join(table, "list").withColumn("part", spread("query", "parts")).withColumn("block", every_of("blocks")).drop("blocks", "parts")
        cells = ("list", "block", "part")
        return visits.groupBy(*cells).cogroup(block.groupBy(*cells)).applyInPandas(_search(shared, keep, again), "query long, row long, id long, score double")

    ranked = lambda found: cut(found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= keep), "ann-found")
    found = ranked(found_in(distinct.withColumn("limit", F.lit(float("inf"))), *rounds[:2]))
    for start, stop in zip(rounds[1:], rounds[2:]):
        limits = found.where(F.col("_r") == keep).select(F.col("query").alias("row"), F.col("score").alias("limit"))
        limited = distinct.join(limits, "row", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
        found = ranked(found.drop("_r").unionByName(found_in(limited, start, stop)))
    found = found.drop("_r")
    members = asked.join(distinct.withColumnRenamed("row", "query"), "vec").select("query", F.col("id").alias("query_id"), F.col("row").alias("query_row"))
    out = members.join(found, "query").where("row != query_row")
    own = Window.partitionBy("query_row").orderBy("score", "id", "row")
    out = out.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


"""Quality classifier: importance resampling with hashed n-gram generative models.

Features of a text are its runs of N bytes and, for each word equal to the one before it, one
shared feature, all hashed into BUCKETS. Two generative models count them: one over the target
(labelled rows of good quality that are not toxic), one over the whole raw table. A document's log weight
sums the log ratios of the two. Ratios are shrunk: counts the raw model expects get `prior`
added on both sides, and the log ratio moves towards 0 by `dead`, so that n-grams
whose ratio is within noise say nothing and length alone neither helps nor hurts.

Documents are then drawn by Gumbel top-k: key = log weight / temperature + Gumbel noise (a hash of the
id), the k largest keys stay. k is the number of documents whose log weight reaches the
threshold that parts best, among labelled rows that the models have not seen, good from other rows.

The tables of counts have BUCKETS rows at most, whatever the input, and may be broadcast.

Defined cases: a null text is empty; an empty text has log weight 0. Without labelled rows the
ratio is 1 everywhere and all documents stay. A row without id is never a labelled one. Several
labels for one id count as the worst. Rows with one id share their noise; rows with equal keys stay or go together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folium.llm._store import cut
from folium.llm._text import Texts, U, mix, texts

N, BITS = 5, 20
BUCKETS = 1 << BITS
REPEAT = 0  # the bucket of repeated words
TEXT, WEIGHT, KEY = "_folium_text", "_folium_weight", "_folium_key"  # beside a table's own columns


def _features(part: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of each feature."""
    n = len(part.data) - N + 1
    lens = np.diff(part.at)
    row_of = np.repeat(np.arange(part.rows), lens)
    got = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n > 0:
        key = np.zeros(n, U)
        for j in range(N):
            key = (key << U(8)) | part.data[j : n + j]
        inside = row_of[:n] == row_of[N - 1 :]
        got = (mix(key[inside], 5) >> U(64 - BITS)).astype(np.int64), row_of[:n][inside]
    part.words()
    if len(part.hashes) > 1:
        of = np.repeat(np.arange(part.rows), np.diff(part.word_at))
        again = (part.hashes[1:] == part.hashes[:-1]) & (of[1:] == of[:-1])
        got = np.concatenate([got[0], np.full(int(again.sum()), REPEAT)]), np.concatenate([got[1], of[1:][again]])
    return got


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a whole partition: bucket, raw, target."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        good = np.asarray(batch.column("good").fill_null(False).cast(pa.int8())) == 1
        for row, part in texts(batch.column("text"), raw=True):
            bucket, of = _features(part)
            raw += np.bincount(bucket, minlength=BUCKETS)
            mine = good[row : row + part.rows][of]
            if mine.any():
                target += np.bincount(bucket[mine], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])


def _weigh(shared, names: list[str]):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for row, part in texts(batch.column(TEXT), raw=True):
                bucket, of = _features(part)
                out[row : row + part.rows] = np.bincount(of, ratio[bucket], part.rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(out)], [*names, WEIGHT])

    return weigh


def log_ratios(docs: DataFrame, sample: DataFrame, prior: float, dead: float, id_col: str, text_col: str) -> np.ndarray:
    """The model: one shrunk log ratio for each bucket. sample: id_col, good; at most as many rows as its caller has limited it to."""
    known = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(sample), id_col, "left").select("text", "good")
    counts = known.mapInArrow(_count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    counts = cut(counts, "quality-counts")
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    ratio = np.zeros(BUCKETS, np.float32)
    if total["target"]:
        log = F.log((F.col("target") + prior) / (F.col("raw") * (total["target"] / total["raw"]) + prior))
        shrunk = counts.select("bucket", (F.signum(log) * (F.abs(log) - dead)).cast("float").alias("ratio"), F.abs(log).alias("size")).where(F.col("size") > dead)
        some = shrunk.select("bucket", "ratio").toPandas()
        ratio[some["bucket"].to_numpy()] = some["ratio"].to_numpy()
    return ratio


def threshold(log_weight: np.ndarray, good: np.ndarray) -> float:
    """Where the rates of good rows at or above and of other rows below sum to most; in the middle of the gap there."""
    if not good.any() or good.all():
        return float(log_weight.min()) - 1.0 if len(log_weight) else float("-inf")
    order = np.argsort(log_weight, kind="stable")
    w, g = log_weight[order], good[order]
    other = np.concatenate([[0], np.cumsum(~g)]) / max(1, (~g).sum())
    lost = np.concatenate([[0], np.cumsum(g)]) / max(1, g.sum())
    can = np.concatenate([[True], w[1:] > w[:-1], [False]])
    at = int(np.argmax(np.where(can, other - lost, -9)))
    return float(w[0]) - 1.0 if at == 0 else float(w[at - 1] + w[at]) / 2


def kth_largest(rows: DataFrame, key: str, k: int, bins: int = 1024) -> float:
    """The k-th largest value of a column, by histograms of at most `bins` rows."""
    lo, hi = rows.agg(F.min(key), F.max(key)).first()
    while lo < hi:
        step = (hi - lo) / bins
        at = F.least(F.floor((F.col(key) - lo) / step), F.lit(bins - 1)) if step > 0 else F.lit(0)
        found = rows.where(F.col(key).between(lo, hi)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
        for b in sorted(found, key=lambda b: -b["bin"]):
            if k <= b["n"]:
                break
            k -= b["n"]
        if (b["lo"], b["hi"]) == (lo, hi):
            return lo
        lo, hi = b["lo"], b["hi"]
    return lo


def _scored(docs: DataFrame, shared, temperature: float, seed: int, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """docs (columns of keep) with WEIGHT and KEY."""
    rows = docs.select(*keep, F.col(text_col).alias(TEXT))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    scored = rows.mapInArrow(_weigh(shared, keep), f"{kinds}, {WEIGHT} double")
    chance = (F.xxhash64(F.col(id_col), F.lit(seed), F.lit("gumbel")).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / F.lit(float(1 << 52))
    return scored.withColumn(KEY, F.col(WEIGHT) / F.lit(temperature) - F.log(-F.log(chance)))


def _fit(docs: DataFrame, labels: DataFrame, prior: float, dead: float, temperature: float, most_labels: int, seed: int, id_col: str, text_col: str):
    """(broadcast model, scores of all rows, least key that stays)."""
    bad = (F.col("quality") != 1) | (F.coalesce("toxic", F.lit(0)) != 0)
    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(id_col).agg((~F.bool_or(bad)).alias("good"))
    known = cut(known, "quality-all-labels")
    n = known.count()
    if n > most_labels:
        known = cut(known.where(F.xxhash64(id_col, F.lit(seed), F.lit("label")) <= F.lit(-(1 << 63) + (1 << 64) * most_labels // n)), "quality-labels")
    held = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(5)) == 0
    ratio = log_ratios(docs, known.where(~held), prior, dead, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    scored = cut(_scored(docs, shared, temperature, seed, id_col, text_col, [id_col]).withColumnsRenamed({WEIGHT: "log_weight", KEY: "gumbel_key"}), "quality-scores")
    check = scored.join(F.broadcast(known.where(held)), id_col).groupBy(id_col).agg(F.max("log_weight").alias("log_weight"), F.first("good").alias("good")).toPandas()
    least = threshold(check["log_weight"].to_numpy(), check["good"].to_numpy().astype(bool))
    k = scored.where(F.col("log_weight") >= least).count()
    return shared, scored, kth_largest(scored, "gumbel_key", k) if k else float("inf")


def resample(docs: DataFrame, labels: DataFrame, prior: float = 4.0, dead: float = 1.5, temperature: float = 0.25, most_labels: int = 50_000, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, log_weight, gumbel_key, kept.

    labels: id_col, quality, toxic (0 or 1). About most_labels labelled ids at most are used: those with the least
    hash. Four fifths of them fit the model, one fifth sets the threshold.
    """
    _, scored, cutoff = _fit(docs, labels, prior, dead, temperature, most_labels, seed, id_col, text_col)
    return scored.withColumn("kept", F.col("gumbel_key") >= F.lit(cutoff))


def keep_resampled(docs: DataFrame, labels: DataFrame, prior: float = 4.0, dead: float = 1.5, temperature: float = 0.25, most_labels: int = 50_000, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, whole, that resample() keeps."""
    shared, _, cutoff = _fit(docs, labels, prior, dead, temperature, most_labels, seed, id_col, text_col)
    scored = _scored(docs, shared, temperature, seed, id_col, text_col, docs.columns)
    return scored.where(F.col(KEY) >= F.lit(cutoff)).select(docs.columns)

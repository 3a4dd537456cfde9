"""Repeated passages by a sparse suffix array.

Suffixes are retained only at content-selected positions: where the hash of ANCHOR words is least within a window, so
that every passage of `least` words holds one and its copies hold the same. Those whose anchor occurs in one text
only are dropped. The suffixes of one anchor are sorted by their words, and so are, reversed, the words before them;
the words that neighbours in each order have in common give those of any two (the least between them). A match that
reaches x words left of a retained suffix and `least` - x words from it on is a run in both orders at once: all
suffixes of such a run that two different texts have are matched, and the match is extended to both sides as far as
it holds. Words are compared as words (those over LONG bytes as their SHA-256), hashes only choose positions.

The suffixes of one anchor meet in one task, with the words that passages around them can hold, while at most HOT
places hold it. Those of a more frequent anchor get a row for each passage around them, which meet by 128-bit digests
of their words, in an aggregation and a join that can be split.
Texts equal as a whole are one text here, repeated from end to end.

Defined cases: a null text is empty; words are runs of non-space with A-Z lower-cased; texts with fewer than
`least` words, or without any repeat, give no row; repeats within one text only do not count. Rows equal in id and
text give a row each. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from folium.llm._store import cut, done, split_join
from folium.llm._text import Texts, U, shingles, signed, texts

ANCHOR = 12
HOT = 50_000  # places of one anchor that one task compares
LONG = 64  # bytes of a word; longer ones are compared by digest


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of each run of w values."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _anchors(hashes: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the minimisers of one text, and their anchor hashes."""
    if len(hashes) < ANCHOR + w - 1:
        return np.zeros(0, np.int64), np.zeros(0, U)
    h = shingles(hashes, ANCHOR)
    least = _window_min(h, w)
    # a position is kept if some window that holds it has it as its least value
    padded = np.concatenate([np.zeros(w - 1, U), least, np.zeros(w - 1, U)])
    most = ~_window_min(~padded, w)
    covers = h == most[: len(h)]
    at = np.flatnonzero(covers)
    return at, h[at]


def _first_pass(w: int):
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, own, pos = [], [], []
            texts_of = batch.column("text_key").to_pylist()
            for row, part in texts(batch.column("text")):
                part.words()
                for i in range(part.rows):
                    key = texts_of[row + i]
                    if key in seen:
                        continue
                    seen.add(key)
                    at, h = _anchors(part.hashes[part.word_at[i] : part.word_at[i + 1]], w)
                    keys.append(h)
                    pos.append(at)
                    own.append(np.full(len(at), key, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(keys))), pa.array(np.concatenate(own)), pa.array(np.concatenate(pos).astype(np.int32))], ["anchor", "text_key", "pos"])

    return anchors


def _joined(part: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The words of all rows, each with one space after it, and where each begins (one more than words)."""
    data, lens = part.data, part.ends - part.starts
    long = np.flatnonzero(lens > LONG)
    if len(long):
        data, lens = data.copy(), lens.copy()
        for k, start, end in zip(long.tolist(), part.starts[long].tolist(), part.ends[long].tolist(), strict=True):
            data[start : start + 64] = np.frombuffer(hashlib.sha256(part.data[start:end].tobytes()).hexdigest().encode(), np.uint8)
            lens[k] = 64
    at = np.r_[0, np.cumsum(lens + 1)]
    out = np.full(at[-1], 0x20, np.uint8)
    within = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
    out[np.repeat(at[:-1], lens) + within] = data[np.repeat(part.starts, lens) + within]
    return out, at


def _suffixes(least: int):
    """Retained suffixes with the words of the passages that belong to them, those whose leftmost least anchor is the suffix's;
    before: how many of these words lie left of the suffix."""

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows equal in id and text are one text
        for batch in batches:
            wanted, keys = batch.column("places").to_pylist(), batch.column("text_key").to_pylist()
            anchor, often, own, at, before, words = [], [], [], [], [], []
            for row, part in texts(batch.column("text")):
                part.words()
                joined, begins = _joined(part)
                for i in range(part.rows):
                    if keys[row + i] in seen:
                        continue
                    seen.add(keys[row + i])
                    first, last = part.word_at[i], part.word_at[i + 1]
                    h = shingles(part.hashes[first:last], ANCHOR)
                    order = np.argsort(h, kind="stable")
                    rank = np.empty(len(h), np.int64)
                    rank[order] = np.arange(len(h))
                    least_at = order[_window_min(rank, least - ANCHOR + 1)]  # the anchor of each passage; never decreases
                    pos = [place["pos"] for place in wanted[row + i]]
                    lo, hi = np.searchsorted(least_at, pos, "left").tolist(), np.searchsorted(least_at, pos, "right").tolist()
                    for place, x, y in zip(wanted[row + i], lo, hi, strict=True):
                        if x < y:
                            anchor.append(place["anchor"])
                            often.append(place["n"])
                            own.append(keys[row + i])
                            at.append(place["pos"])
                            before.append(place["pos"] - x)
                            words.append(joined[begins[first + x] : begins[first + y - 1 + least] - 1].tobytes())
            columns = [pa.array(x, kind) for x, kind in ((anchor, pa.int64()), (often, pa.int64()), (own, pa.int64()), (at, pa.int32()), (before, pa.int32()), (words, pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "n", "text_key", "pos", "before", "words"])

    return suffixes


def _passages(least: int):
    """A row for each passage that belongs to a suffix: the digest of its words, text and start."""

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                digest, own, start = [], [], []
                for row in batch.slice(at, 1000).to_pylist():
                    run = row["words"] + b" "
                    begins = [0, *(np.flatnonzero(np.frombuffer(run, np.uint8) == 0x20) + 1).tolist()]
                    n = len(begins) - least
                    digest += [hashlib.blake2b(run[begins[j] : begins[j + least]], digest_size=16).digest() for j in range(n)]
                    own += [row["text_key"]] * n
                    start += range(row["pos"] - row["before"], row["pos"] - row["before"] + n)
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(own, pa.int64()), pa.array(start, pa.int32())], ["passage", "text_key", "start"])

    return passages


def _sorted_runs(group: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by group and words, and how many words each has in common with its predecessor there (-1: another group)."""
    rows = np.ascontiguousarray(np.column_stack([group, words]).astype(">u4"))
    order = np.argsort(rows.view(f"S{4 * rows.shape[1]}").ravel(), kind="stable")
    same = rows[order][1:] == rows[order][:-1]
    common = np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1)) - 1
    return order, np.r_[-1, common]


def _matches(rows: pa.Table, least: int) -> pa.RecordBatch:
    """Stretches around retained suffixes that a different text has too, extended to both sides. rows: sorted by anchor."""
    rows = rows.combine_chunks()
    lists = pc.split_pattern(rows.column("words").combine_chunks(), " ")
    ids = lists.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    count = pc.list_value_length(lists).to_numpy().astype(np.int64)
    anchor, key, pos, before = (rows.column(c).to_numpy() for c in ("anchor", "text_key", "pos", "before"))
    n, own = len(count), np.cumsum(count) - count + before  # own: where the suffix begins
    group = np.cumsum(np.r_[True, anchor[1:] != anchor[:-1]])
    none = -1 - np.arange(n)[:, None]  # past its end a row equals no other

    def side(steps: np.ndarray, held: np.ndarray) -> np.ndarray:
        inside = np.arange(len(steps)) < held[:, None]
        return np.where(inside, ids[np.where(inside, own[:, None] + steps, 0)], none)

    right, right_common = _sorted_runs(group, side(np.arange(least), count - before))
    left, left_common = _sorted_runs(group, side(-1 - np.arange(least - ANCHOR), before))
    kept = np.zeros((n, least - ANCHOR + 3), bool)  # by words left of the suffix, with a border
    run_right, run_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for x in range(least - ANCHOR + 1):
        run_right[right] = np.cumsum(right_common < least - x)
        run_left[left] = np.cumsum(left_common < x)
        held = np.flatnonzero((before >= x) & (count - before >= least - x))
        if not len(held):
            continue
        run = run_right[held] * (n + 1) + run_left[held]
        order = np.argsort(run, kind="stable")
        held, run = held[order], run[order]
        first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        twice = np.minimum.reduceat(key[held], first) != np.maximum.reduceat(key[held], first)
        kept[held, x + 1] = np.repeat(twice, np.diff(np.r_[first, len(held)]))
    row, low = np.nonzero(kept[:, 1:] & ~kept[:, :-1])
    _, high = np.nonzero(kept[:, :-1] & ~kept[:, 1:])  # in the same order
    return pa.RecordBatch.from_arrays([pa.array(key[row]), pa.array((pos[row] - high + 1).astype(np.int32)), pa.array((pos[row] - low + least).astype(np.int32))], ["text_key", "start", "stop"])


def _meet(least: int):
    """Compares the suffixes of each anchor; rows come sorted by anchor, the last anchor's are held back until it ends."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch.column("anchor").to_numpy()
            cut_at = int(np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])[-1])
            if cut_at or (held and held[-1].column("anchor")[-1].as_py() != anchor[0]):
                yield _matches(pa.Table.from_batches([*held, batch.slice(0, cut_at)]), least)
                held = []
            held.append(batch.slice(cut_at))
        if held:
            yield _matches(pa.Table.from_batches(held), least)

    return meet


def repeated_passages(docs: DataFrame, least: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that share a passage of at least `least` words with a different document.

    id_col, n_words, n_repeated (words within such passages), n_passages, passages (array of start and stop, in
    words, stop exclusive, merged), n_copies (rows with the same text).
    """
    w = least - ANCHOR + 1
    n_words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    digests = cut(docs.select(F.col(id_col), F.xxhash64(text_col).alias("text_key"), n_words.cast("int").alias("n_words")), "repeats-digests")
    classes = digests.where(F.col("n_words") >= least).groupBy("text_key").agg(F.min(id_col).alias("rep"), F.count("*").alias("n_copies"), F.first("n_words").alias("n_words"))
    classes = cut(classes, "repeats-texts")
    places = rows.select("text", "text_key").mapInArrow(_first_pass(w), "anchor long, text_key long, pos int")
    places = cut(places, "repeats-anchors")
    live = places.groupBy("anchor").agg(F.min("text_key").alias("lo"), F.max("text_key").alias("hi"), F.count("*").alias("n")).where("lo != hi").select("anchor", "n")
    shared = cut(split_join(places, cut(live, "repeats-anchor-counts"), "anchor"), "repeats-live")
    done(places)
    places = shared.groupBy("text_key").agg(F.collect_set(F.struct("anchor", "n", "pos")).alias("places"))  # bounded by the length of one text
    wanted = places.join(classes.select("text_key", F.col("rep").alias("_rep")), "text_key").withColumnRenamed("text_key", "_key")
    chosen = rows.join(wanted, F.col(id_col).eqNullSafe(F.col("_rep")) & (F.col("text_key") == F.col("_key"))).select("text", "text_key", "places")
    around = cut(chosen.mapInArrow(_suffixes(least), "anchor long, n long, text_key long, pos int, before int, words binary"), "repeats-suffixes")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretches = around.where(F.col("n") <= HOT).drop("n").repartition(partitions, "anchor").sortWithinPartitions("anchor").mapInArrow(_meet(least), "text_key long, start int, stop int")
    if not around.where(F.col("n") > HOT).isEmpty():
        each = cut(around.where(F.col("n") > HOT).mapInArrow(_passages(least), "passage binary, text_key long, start int"), "repeats-each")
        twice = each.groupBy("passage").agg(F.min("text_key").alias("lo"), F.max("text_key").alias("hi"), F.count("*").alias("n")).where("lo != hi").select("passage", "n")
        met = cut(split_join(each, cut(twice, "repeats-passage-counts"), "passage").select("text_key", "start"), "repeats-met")
        done(each)
        stretches = stretches.unionByName(met.select("text_key", "start", (F.col("start") + least).alias("stop")))
    whole = classes.where("n_copies > 1").select("text_key", F.lit(0).alias("start"), F.col("n_words").alias("stop"))
    return _per_document(stretches.unionByName(whole).distinct(), digests, classes, id_col)


def _per_document(stretches: DataFrame, digests: DataFrame, classes: DataFrame, id_col: str) -> DataFrame:
    """Merges overlapping stretches of each text and gives them to its documents."""
    before = Window.partitionBy("text_key").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)  # bounded by the length of one text
    upto = Window.partitionBy("text_key").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0)
    new = F.when(F.max("stop").over(before) >= F.col("start"), 0).otherwise(1)
    numbered = stretches.withColumn("_new", new).withColumn("_part", F.sum("_new").over(upto))
    parts = numbered.groupBy("text_key", "_part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    merged = parts.groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("passages"), F.sum(F.col("stop") - F.col("start")).cast("int").alias("n_repeated"))
    merged = merged.join(classes.select("text_key", "n_copies"), "text_key")
    out = digests.join(merged, "text_key")
    return out.select(id_col, "n_words", "n_repeated", F.size("passages").alias("n_passages"), "passages", "n_copies")

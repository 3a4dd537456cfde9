"""Exact set similarity join on word shingles: universe partition, pigeonhole, one-deletion neighbourhoods.

A document is the set of its k-word shingles, as 64-bit hashes. Documents with equal sets form one class. Set sizes are
cut into bands; two sets that may link lie in one band or in neighbouring ones. Of two linked
sets whose smaller one is in band b at most H(b) elements are in only one of them. Elements
are hashed into a quarter more segments than H(b) + 1, m of them, so linked sets share c = m - H(b) contents at least. If each set
leaves out the c - 1 dearest of its own in an order that is the same for all sets, they still share one (pigeonhole).
A hundredth of the segments, q, have their one-deletion neighbourhoods indexed too. A band may use them: linked sets that share
nothing there differ twice in each of these segments, so they share c + q contents of the others, and q more may be left
out. For each band of sizes that is done if it makes the sum of costs less.

The order is by cost, and the costs are exact: a first shuffle counts how many sets hold
each segment's content. Contents that one set alone holds are done with; of the others a
set keeps all but the dearest. So a passage that many documents share makes no candidates: each
leaves its contents out and keeps what it does not share.

All sets that keep a content are compared with one of them, the hub, not with
each other; the hub is the set that shares most with others, so of near copies the one nearest to their origin.
Components of the verified links follow. All that were compared with one hub are its star; two sets that share a kept content
lie in one star. Where a star holds more than one component, members outside the largest are compared across components, as far as
sizes and parities of their elements allow a link, if at most OUTSIDE are outside. Two sets that share many hubs meet at the
first of them, in the order of hubs, and at few others: a row has the set's BEFORE hubs before its own, and where those of two rows
overlap the sets have met before.

In a larger star members meet by what they do not share with the hub. Near copies of one text differ from it in different places:
if x and y differ from the hub in dx and dy elements, they differ from each other in dx + dy less twice the elements common to both
differences. Where dx + dy alone is small enough they link, and one comparison with the member nearest to the hub finds that.
Otherwise a link asks for some number of common elements, so the differences share one even if each leaves out its most
frequent elements, one less than that number; and where they meet first, enough must follow in both. Members of the hub's
component and others have different numbers, so these meet apart. What remains unlinked has then been verified
to differ, or is connected already.

Hot groups: contents held by many sets of one partition are counted there and cross the first shuffle as one row; later
joins on a content are salted by the size of its group.

Defined cases: a null text is empty; a document without words has an empty set, links with
nothing and is its own component; with fewer words than k the whole sequence is one shingle. Rows
equal in id give a row each. A null id is a component of its own unless linked. Columns other than id and text are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from folium.llm._store import cut, done, row_key, split_join, text_bytes
from folium.llm._text import U, mix, shingle_sets, signed, texts
from folium.llm.components import components

BROADCAST_ROWS = 500_000
SLACK = 0.25  # further segments, so that dear ones can be left out
SPREAD = 2_000  # members of a group for each salt
OUTSIDE = 1_000  # members of a star outside its largest component that are compared with all others as they are
BEFORE = 16  # hubs of a set before each of its own
FINEST, PARITIES = 12, 1024  # bits of the finest cells, cells with parities
PARITY = [f"p{i}" for i in range(PARITIES // 64)]


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    for _, part in texts(column):
        yield from shingle_sets(part, k)


def _class_of(s: np.ndarray) -> int:
    """64 bits that tell sets apart: sums over elements of two scramblings, and the size."""
    both = mix(mix(s, 7).sum(dtype=U)[None] + U(len(s))) ^ mix(s, 8).sum(dtype=U)[None]
    return int(signed(both)[0])


class Bands:
    """Set sizes in bands. percent: link if 100 * intersection >= percent * union."""

    def __init__(self, percent: int):
        self.percent = percent
        self.edges = [1]  # edges[b] is the least size in band b

    def of(self, size: int) -> int:
        while self.edges[-1] <= size:
            e = self.edges[-1]
            self.edges.append(max(e + 1, 100 * e // self.percent + 1))
        return int(np.searchsorted(self.edges, size, "right")) - 1

    def segments(self, band: int) -> tuple[int, int, int]:
        """(segments, those of them with deletions, what a lookup must be worth) for pairs whose smaller set is in the band."""
        self.of(self.edges[band] if band < len(self.edges) else 1)
        while len(self.edges) <= band + 1:
            self.of(self.edges[-1])
        small = self.edges[band + 1] - 1
        large = 100 * small // self.percent
        far = max((s + l) * (100 - self.percent) // (100 + self.percent) for s, l in ((small, large), (small, small)))
        m = far + 1 + math.ceil(far * SLACK)
        return m, 0 if m < 2 else math.ceil(m / 100), far + 1


def _signatures(s: np.ndarray, band: int, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of one set for one band, and their kinds: 0, 1 of a segment that has deletions too, 2 with a deletion."""
    m, q, _ = bands.segments(band)
    at = (mix(s, 11) % U(m)).astype(np.int64)
    by = np.argsort(at, kind="stable")
    at, value = at[by], mix(s, 12)[by]
    edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    sums = np.zeros(m, U)
    sums[at[edge]] = np.add.reduceat(value, edge)
    tag = mix(np.arange(m, dtype=U) + U(band << 32), 13)
    near = int(np.searchsorted(at, q))
    less = sums[at[:near]] - value[:near] + tag[at[:near]]
    kind = np.repeat(np.array([1, 0, 2], U), [q, m - q, near])
    return mix(np.concatenate([sums + tag, less]), 14), kind


def _emit(k: int, percent: int, bits: int):
    """Signature rows of a partition, each distinct set once.

    key: the first bits of a signature, then two for its kind, then whether the set serves as the
    larger set of the band below; a: class; n: how many sets of the partition hold the signature, negative
    but in the first of their rows.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), set()
        parts, held = [], 0

        def flush() -> pa.RecordBatch:
            key, own = (np.concatenate(x) for x in zip(*parts, strict=True))
            by = np.argsort(key, kind="stable")
            key, own = key[by], own[by]
            group = key >> 3
            first = np.concatenate([[True], group[1:] != group[:-1]])
            edge = np.flatnonzero(first)
            size = np.diff(np.concatenate([edge, [len(key)]]))
            n = np.repeat(size, size)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(own), pa.array(np.where(first, n, -n))], ["key", "a", "n"])

        for batch in batches:
            for s in _sets(batch.column("text"), k):
                if not len(s) or (c := _class_of(s)) in seen:
                    continue
                seen.add(c)
                b = bands.of(len(s))
                below = b and len(s) * percent <= 100 * (bands.edges[b] - 1)
                for band in (b, b - 1) if below else (b,):
                    key, kind_of = _signatures(s, band, bands)
                    key = (key >> U(64 - bits) << U(3)) | (kind_of << U(1)) | U(band != b)
                    parts.append((signed(key), np.full(len(key), c, np.int64)))
                    held += len(key)
                if held > 4_000_000:
                    yield flush()
                    parts, held = [], 0
        if parts:
            yield flush()

    return emit


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key those whose signature two or more sets hold; group: the signature."""
    kept = tuple(np.zeros(0, np.int64) for _ in range(3))  # first rows of the last group, which may go on
    for batch in itertools.chain(batches, [None]):
        rows = kept
        out = []
        if batch is not None:
            got = tuple(np.asarray(batch.column(c)) for c in ("key", "a", "n"))
            rows = tuple(np.concatenate([x, y[got[2] > 0]]) for x, y in zip(kept, got, strict=True))
            rest = got[2] < 0
            out.append((got[0][rest], got[1][rest]))
        key, own, n = rows
        if len(key):
            group = key >> 3
            edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            done = len(key) if batch is None else int(edge[-1])
            kept = tuple(x[done:] for x in rows)
            span = np.diff(np.concatenate([edge, [len(key)]]))
            alone = (np.minimum.reduceat(own, edge) == np.maximum.reduceat(own, edge)) & (np.maximum.reduceat(n, edge) == 1)  # one set, met in several partitions
            more = np.flatnonzero(~np.repeat(alone, span)[:done])
            out.append((key[more], own[more]))
        for x in out:
            if len(x[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x[0] >> 3), *[pa.array(y) for y in x]], ["group", "key", "a"])


def _looks(percent: int):
    """The rows of each set that it keeps, all but the dearest that it may skip: if a band does without deletions (plain), and
    if it uses them (deletions). rank: how much the set shares. Rows come sorted by set."""

    def choose(key: np.ndarray, own: np.ndarray, n: np.ndarray, size: np.ndarray, bands: Bands) -> pa.RecordBatch:
        by = np.lexsort((-n, key, own))
        by = by[np.concatenate([[True], (key[by][1:] != key[by][:-1]) | (own[by][1:] != own[by][:-1])])]  # a set met in several partitions
        by = by[np.lexsort((key[by], -n[by], key[by] & 1, own[by]))]  # the dearest in front
        key, own, n, size, below, kind = key[by], own[by], n[by], size[by], key[by] & 1, key[by] >> 1 & 3
        first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (below[1:] != below[:-1])]))
        span = np.diff(np.concatenate([first, [len(key)]]))
        got = [(bands.of(s) - low, *bands.segments(bands.of(s) - low)) for s, low in zip(size[first].tolist(), below[first].tolist(), strict=True)]
        band, m, q, worth = (np.repeat(x, span) for x in np.array(got).T)

        def rank(which: np.ndarray) -> np.ndarray:
            """How many rows of these, in the same set and band, stand before."""
            before = np.cumsum(which) - which
            return before - np.repeat(before[first], span)

        plain = (kind < 2) & (rank(kind < 2) >= m - worth)
        deletions = (kind > 0) | (rank(kind == 0) >= m + q - worth)
        edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        shares = np.repeat(np.add.reduceat(n, edge), np.diff(np.concatenate([edge, [len(own)]])))
        some = plain | deletions
        columns = [x[some] for x in (key >> 3, own, n, shares, band, plain, deletions)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "a", "n", "rank", "band", "plain", "deletions"])

    def looks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        held = tuple(np.zeros(0, np.int64) for _ in range(4))
        for batch in batches:
            rows = tuple(np.concatenate([x, np.asarray(batch.column(c))]) for x, c in zip(held, ("key", "a", "n", "size"), strict=True))
            if not len(rows[0]):
                continue
            done = int(np.searchsorted(rows[1], rows[1][-1]))  # the last set may go on
            if done:
                yield choose(*(x[:done] for x in rows), bands)
            held = tuple(x[done:] for x in rows)
        if len(held[0]):
            yield choose(*held, bands)

    return looks


def _sketch(s: np.ndarray) -> tuple[bytes, list[int]]:
    """How many elements fall into each of some cells, a byte each (modulo 256), about four elements to a cell; and the
    parities of PARITIES cells. Two sets differ in at least as many elements as either of these does."""
    count = np.bincount((mix(s, 15) >> U(64 - FINEST)).astype(np.int64), minlength=1 << FINEST)
    cells = 1 << min(FINEST, max(6, int(len(s) // 4).bit_length()))
    return count.reshape(cells, -1).sum(1).astype(np.uint8).tobytes(), np.packbits(count.reshape(PARITIES, -1).sum(1) & 1).view(np.int64).tolist()


def _digest(k: int, names: list[str]):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(len(s), _class_of(s), *_sketch(s)) for s in _sets(batch.column("text"), k)]
            n, c, sketch, parity = zip(*got, strict=True) if got else ((), (), (), ())
            columns = [pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(sketch, pa.binary())]
            columns += [pa.array([p[i] for p in parity], pa.int64()) for i in range(PARITIES // 64)]
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in names], *columns], [*names, "n_shingles", "class", "sketch", *PARITY])

    return digest


def _near(percent: int):
    """Of pairs with their sizes and sketches those that may link: their sketches differ no more than linked sets can."""

    def apart(x: bytes, y: bytes) -> int:
        x, y = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
        y = y.reshape(len(x), -1).sum(1, dtype=np.uint8)  # as coarse as the other
        return int(np.minimum(x - y, y - x).sum(dtype=np.int64))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = np.array([apart(x, y) for x, y in zip(batch.column("_sa").to_pylist(), batch.column("_sb").to_pylist(), strict=True)], np.int64)
            total = np.asarray(batch.column("_na")) + np.asarray(batch.column("_nb"))
            keep = pa.array(far * (100 + percent) <= (100 - percent) * total)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b", "n")], ["a", "b", "n"])

    return near


def _contents(k: int):
    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_sets(batch.column("text"), k))
            c = [_class_of(s) if len(s) else 0 for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array([signed(s) for s in sets], pa.list_(pa.int64()))], ["class", "elements"])

    return contents


def _salted(rows: DataFrame, groups: DataFrame, on: str) -> DataFrame:
    """rows (with n: about how many rows share their value of `on`) joined with groups (one row for each value, n: the
    greatest there), SPREAD rows to a salt."""
    salts = lambda n: F.ceil(F.col(n) / SPREAD)
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("a", F.lit(5)), salts("n")))
    groups = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts("n") - 1))).drop("n")
    return rows.join(groups, [on, "_salt"]).drop("_salt")


def _elements(wanted: DataFrame, docs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """class, elements for the classes in wanted (class), read from one text of each."""
    wanted = cut(wanted.join(classes, "class").select(F.col("class").alias("_class"), F.col("rep").alias("_rep")), "join-wanted")
    reps = wanted.select("_rep").distinct()
    reps = F.broadcast(reps) if wanted.count() <= BROADCAST_ROWS else reps
    chosen = docs.join(reps, F.col("_rep") == F.col("_row"), "left_semi").select("text")
    return cut(chosen.mapInArrow(_contents(k), "class long, elements array<long>").dropDuplicates(["class"]), "join-sets")


def _verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b; n: size of the group they come from) that link."""
    sets = _elements(pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b"))).distinct(), docs, classes, k)
    left = pairs.join(sets.withColumnsRenamed({"class": "a", "elements": "x"}), "a")
    right = pairs.groupBy("b").agg(F.max("n").alias("n")).join(sets.withColumnsRenamed({"class": "b", "elements": "y"}), "b")
    both = _salted(left, right, "b")
    same = F.size(F.array_intersect("x", "y"))
    return both.where(100 * same >= percent * (F.size("x") + F.size("y") - same)).select("a", "b")


def _least(labelled: DataFrame) -> DataFrame:
    """labelled with component_id, the least id of its component."""
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    return split_join(labelled, cut(least, "join-least"), "component", hot=SPREAD).drop("n")


def _labelled(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """id_col, _row (hash of the text), n_shingles, class, component (a class; null for the empty set), class_id, component_id."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("_row"))
    kind = dict(docs.dtypes)[id_col]
    parities = ", ".join(f"{p} long" for p in PARITY)
    digests = cut(rows.mapInArrow(_digest(k, [id_col, "_row"]), f"`{id_col}` {kind}, _row long, n_shingles long, class long, sketch binary, {parities}"), "join-digests")
    first = [F.first(c).alias(c) for c in ("sketch", *PARITY)]
    classes = digests.where("n_shingles > 0").groupBy("class").agg(F.min("_row").alias("rep"), F.first("n_shingles").alias("size"), *first, F.min(id_col).alias("least"))
    classes = cut(classes, "join-classes")
    size = classes.select(F.col("class").alias("a"), "size", "sketch", *PARITY)
    bits = min(60, math.ceil(math.log2(max(2, text_bytes(docs, text_col)))) + 12)  # so few unequal signatures meet that verifying them costs nothing
    keyed = rows.select("text").mapInArrow(_emit(k, percent, bits), "key long, a long, n long")
    spread = F.when(F.col("n") > 0, F.shiftright("key", 3)).otherwise(F.xxhash64("key", "a"))
    shared = cut(keyed.repartition(spread).sortWithinPartitions("key").mapInArrow(_shared, "group long, key long, a long"), "join-shared")
    counts = cut(shared.groupBy("group").agg(F.count("*").alias("n")), "join-counts")
    counted = cut(split_join(shared, counts, "group").drop("group"), "join-counted")
    done(shared)
    sized = counted.join(size.select("a", "size"), "a").repartition("a").sortWithinPartitions("a")  # a join may be broadcast or split: this keeps a set together
    members = cut(sized.mapInArrow(_looks(percent), "key long, a long, n long, rank long, band long, plain boolean, deletions boolean"), "join-members")
    done(counted)
    cost = lambda c: F.sum(F.when(F.col(c), F.col("n") - 1).otherwise(0))
    costs = members.groupBy("band").agg(cost("plain").alias("plain"), cost("deletions").alias("deletions")).collect()  # a row for each band of sizes
    cheaper = [r["band"] for r in costs if r["deletions"] < r["plain"]]
    chosen = members.where(F.when(F.col("band").isin(cheaper), F.col("deletions")).otherwise(F.col("plain"))).drop("band", "plain", "deletions")
    groups = chosen.groupBy("key").agg(F.max(F.struct("rank", "a")).alias("hub"), F.max("n").alias("n"), F.count("*").alias("m")).where("m > 1")
    grouped = cut(_salted(chosen.drop("rank"), groups.select("key", F.col("hub.a").alias("hub"), "n"), "key"), "join-groups")
    done(members)
    members = grouped
    tied = members.where("a != hub").select("a", F.col("hub").alias("b"), "n")
    first = cut(_fitting(tied, size, percent), "join-pairs")
    links = cut(_verify(first, rows, classes, k, percent), "join-links")
    elements = partial(_elements, docs=rows, classes=classes, k=k)
    rest = cut(_unsettled(members, components(links, "a", "b"), size, percent, elements).join(first.select("a", "b"), ["a", "b"], "left_anti"), "join-rest")
    if not rest.isEmpty():
        links = cut(links.union(_verify(rest, rows, classes, k, percent)), "join-links")
    found = components(links, "a", "b")
    labelled = classes.select("class", "least").join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    own = digests.drop("sketch", *PARITY).join(_least(labelled), "class", "left")
    some = F.col("n_shingles") > 0
    return own.select(
        id_col, "_row", "n_shingles", "class", F.when(some, F.col("component")).alias("component"), F.when(some, F.col("least")).otherwise(F.col(id_col)).alias("class_id"),
        F.when(some, F.col("component_id")).otherwise(F.col(id_col)).alias("component_id"),
    )


def similarity_components(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, n_shingles (size of its set), class_id (least id of the rows with an equal set), component_id.

    Two documents link if 100 * intersection >= percent * union of their sets of k-word shingles;
    component_id is the least id that links lead to.
    """
    return _labelled(docs, k, percent, id_col, text_col).select(id_col, "n_shingles", "class_id", "component_id")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, whole, that stay if of each component only the row of least id (then least hash of its text) stays.

    Documents without words stay. Of rows equal in id and text the one of least hash of all its columns stays.
    """
    found = cut(_labelled(docs, k, percent, id_col, text_col), "join-found")
    firsts = found.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.col(id_col), F.col("_row"))).alias("s")).select(F.col(f"s.{id_col}").alias("_folium_id"), F.col("s._row").alias("_folium_text"))
    stay = cut(firsts.union(found.where("n_shingles = 0").select(id_col, "_row")).distinct(), "join-stay")
    rows = docs.withColumns({"_folium_of": F.xxhash64(text_col), "_folium_whole": row_key(dict(docs.dtypes))})
    rows = rows.join(stay, (F.col("_folium_of") == F.col("_folium_text")) & docs[id_col].eqNullSafe(F.col("_folium_id")), "left_semi")
    least = rows.groupBy(F.col(id_col).alias("_folium_id"), F.col("_folium_of").alias("_folium_text")).agg(F.min("_folium_whole").alias("_folium_least"))
    same = (F.col("_folium_of") == F.col("_folium_text")) & (F.col("_folium_whole") == F.col("_folium_least")) & F.col(id_col).eqNullSafe(F.col("_folium_id"))
    return rows.join(least, same, "left_semi").dropDuplicates([id_col, "_folium_of", "_folium_whole"]).select(docs.columns)


def _fitting(pairs: DataFrame, size: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs, the lesser first, whose sizes and sketches allow a link; pairs: a, b, n (kept)."""
    pairs = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("n").alias("n"))
    for c in ("a", "b"):
        own = size.select(F.col("a").alias(c), F.col("size").alias(f"_n{c}"), F.col("sketch").alias(f"_s{c}"))
        pairs = pairs.join(own, c) if c == "a" else pairs.join(own, (pairs["b"] == own["b"]) & (100 * F.least("_na", "_nb") >= percent * F.greatest("_na", "_nb"))).drop(own["b"])
    return pairs.select("a", "b", "n", "_na", "_nb", "_sa", "_sb").mapInArrow(_near(percent), "a long, b long, n long")


def _parts(rows: DataFrame, key: str) -> DataFrame:
    """key, main (the component c of most rows), n (rows), out (rows outside it) of the groups that hold more than one component."""
    parts = rows.groupBy(key, "c").agg(F.count("*").alias("m")).groupBy(key)
    parts = parts.agg(F.count("*").alias("parts"), F.max(F.struct("m", "c")).alias("main"), F.sum("m").alias("n"))
    return parts.where("parts > 1").select(key, F.col("main.c").alias("main"), "n", (F.col("n") - F.col("main.m")).alias("out"))


def _across(rows: DataFrame, key: str, names: list[str], fits: Column, percent: int) -> DataFrame:
    """Pairs a, b of rows (a, c, size, main, names) with one key, of different components and fitting sizes; those of b end in _b, its c is d."""
    others = rows.drop("main").withColumnsRenamed({"a": "b", "c": "d", **{x: f"{x}_b" for x in ("size", *names)}})
    outside = rows.where("c != main")
    x, y = F.col("size"), F.col("size_b")
    fits = (F.col("c") != F.col("d")) & ((F.col("d") == F.col("main")) | (F.col("a") < F.col("b"))) & (100 * F.least(x, y) >= percent * F.greatest(x, y)) & fits
    return outside.join(others, (outside[key] == others[key]) & fits)


def _unsettled(members: DataFrame, found: DataFrame, size: DataFrame, percent: int, elements: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Pairs of different components in one star, one of them outside its largest component.

    elements: gives the elements of classes; without it large stars are treated like small ones.
    """
    tied = members.select("hub", "a").distinct().join(found.withColumnsRenamed({"node": "a", "component": "c"}), "a", "left")
    tied = cut(tied.withColumn("c", F.coalesce("c", "a")), "join-tied")
    parts = cut(_parts(tied, "hub").where("n > 2"), "join-parts")  # a hub and another have been compared
    earlier = Window.partitionBy("a").orderBy("hub").rowsBetween(-BEFORE, -1)
    stars = cut(split_join(tied, parts, "hub", hot=SPREAD).withColumn("before", F.collect_list("hub").over(earlier)), "join-stars")
    small = stars.where(F.col("out") <= OUTSIDE) if elements else stars
    open_ = cut(small.join(size.select("a", "size", *PARITY), "a"), "join-open")
    apart = sum(F.bit_count(F.col(p).bitwiseXOR(F.col(f"{p}_b"))) for p in PARITY)
    fits = (apart * (100 + percent) <= (100 - percent) * (F.col("size") + F.col("size_b"))) & ~F.arrays_overlap("before", "before_b")
    pairs = _across(open_.drop("out"), "hub", ["n", "before", *PARITY], fits, percent).select("a", "b", "n")
    if elements and not (large := stars.where(F.col("out") > OUTSIDE)).isEmpty():
        pairs = pairs.union(_by_differences(large, elements, percent))
    return _fitting(pairs, size, percent)


def _by_differences(stars: DataFrame, elements: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Pairs (a, b, n) of different components in stars (hub, a, c, n: members) that may link, by what they do not share with the hub."""
    sets = elements(stars.select(F.col("a").alias("class")).distinct())
    left = stars.select("hub", "a", "c", "n").join(sets.withColumnsRenamed({"class": "a", "elements": "x"}), "a")
    right = stars.groupBy("hub").agg(F.max("n").alias("n")).join(sets.withColumnsRenamed({"class": "hub", "elements": "y"}), "hub")
    both = _salted(left, right, "hub").withColumn("difference", F.concat(F.array_except("x", "y"), F.array_except("y", "x")))
    both = both.select("hub", "a", "c", "n", F.size("x").cast("long").alias("size"), F.size("difference").cast("long").alias("apart"), "difference")
    # x and y link if excess(x) + excess(y) <= 2 * (100 + percent) * elements common to both differences
    both = both.withColumn("excess", (100 + percent) * F.col("apart") - (100 - percent) * F.col("size"))
    both = cut(both.repartition("hub", "a"), "join-differences")

    own, other = F.col("a") == F.col("hub"), F.col("a") != F.col("hub")
    parts = both.groupBy("hub", "c").agg(F.max(own).alias("own"), F.min(F.when(other, F.col("excess"))).alias("least"), F.min(F.struct("excess", "a")).alias("nearest"), F.count("*").alias("n"))
    hubs = parts.groupBy("hub").agg(
        F.max(F.when(F.col("own"), F.col("c"))).alias("main"), F.min(F.when(F.col("own"), F.col("least"))).alias("within"),
        F.min(F.when(~F.col("own"), F.col("least"))).alias("without"), F.min("nearest").alias("nearest"), F.sum("n").alias("n"),
    )

    def reach(least: str) -> Column:
        """How many elements of a difference, the rarest, meet those of members with this excess or more; none without such members."""
        common = F.greatest(F.lit(1), F.ceil((F.col("excess") + F.col(least)) / (2 * (100 + percent))), F.col("apart") - F.floor((100 - percent) * F.col("size") / percent))
        return F.when(F.col(least).isNotNull(), F.col("apart") - common + 1)

    rows = split_join(both.drop("difference", "n"), cut(hubs, "join-hubs"), "hub", hot=SPREAD).where(other)
    inside = F.col("c") == F.col("main")
    rows = rows.withColumn("reach", F.array(F.when(inside, reach("without")).otherwise(reach("within")), F.when(~inside, reach("without"))))
    rows = cut(rows.withColumnRenamed("n", "m").drop("within", "without"), "join-reach")
    sure = rows.where(~inside & (F.col("excess") + F.col("nearest.excess") <= 0)).select("a", F.col("nearest.a").alias("b"), F.col("m").alias("n"))

    met = both.select("hub", "a", F.explode("difference").alias("element")).select(F.xxhash64("hub", "element").alias("key"), "hub", "a")
    held = met.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")
    held = cut(held.groupBy("hub", "a").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("held")), "join-held")
    alone = F.col("apart") - F.size("held")  # those that no other holds stand in front

    def front(side: int) -> Column:
        most = F.greatest(F.lit(0), F.coalesce(F.col("reach")[side], F.lit(0)) - alone).cast("int")
        return F.transform(F.slice("held", F.lit(1), most), lambda e, i: F.struct(F.xxhash64(e["key"], F.lit(side)).alias("key"), (F.size("held") - i).alias("left")))

    shared = rows.join(held, ["hub", "a"]).select("a", "c", "m", "size", "excess", F.explode(F.concat(front(0), front(1))).alias("e"))
    shared = cut(shared.select("e.key", "e.left", "a", "c", "m", "size", "excess"), "join-prefixes")
    open_ = cut(split_join(shared, cut(_parts(shared, "key"), "join-parts"), "key").drop("n", "out"), "join-open")
    enough = F.col("excess") + F.col("excess_b") <= 2 * (100 + percent) * F.least("left", "left_b")
    return _across(open_, "key", ["m", "excess", "left"], enough, percent).select("a", "b", F.col("m").alias("n")).union(sure)

"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed is a fixed mask of word offsets: the words at those offsets are hashed, those between
are ignored, so that a hit survives substitutions at ignored places. The masks are such that every stretch the
comparison below accepts, with `least` of 10 or more, holds a hit. Seeds of all benchmark
and document positions are joined. A hit gives a diagonal (document position minus item position); along
each diagonal that was hit, item and document are compared word by word and the best scoring stretch is
kept (a match scores 1, a difference -2). A document is contaminated by an item if that stretch
has at least `least` equal words.

The seeds of the benchmark are broadcast while they are at most BROADCAST_SEEDS rows (counted first);
beyond that the join shuffles.

Defined cases: words are runs of letters and digits, A-Z lower-cased; texts and items with fewer than
`least` words, null or empty ones too, never match. Null ids are kept as values. Rows equal
in id and text give one result. Several passages of an item in a text give the longest, the first of equals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folium.llm._store import cut, row_key

MASKS = ((0, 1, 2, 4, 5), (0, 1, 2, 3, 7))
SPAN = 10  # least words of texts and items
BROADCAST_SEEDS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_list(text_col: str) -> Column:
    lower = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lower, SEPARATORS), lambda w: w != "")


def _seeds(words: Column) -> Column:
    """array<struct<seed, pos>>; empty where there are fewer than SPAN words."""

    def of(mask: tuple[int, ...], number: int) -> Column:
        at = F.sequence(F.lit(0), F.size(words) - 1 - mask[-1])
        return F.transform(at, lambda i: F.struct(F.xxhash64(F.lit(number), *[F.get(F.col("_hashes"), i + j) for j in mask]).alias("seed"), i.alias("pos")))

    got = F.concat(*[of(m, n) for n, m in enumerate(MASKS)])
    return F.when(F.size(words) >= SPAN, got).otherwise(F.lit(None))


def _with_seeds(rows: DataFrame) -> DataFrame:
    """rows: some columns and _words. Adds seed and pos, a row for each."""
    hashed = rows.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    return hashed.withColumn("_seed", F.explode(_seeds(F.col("_words")))).withColumns({"seed": F.col("_seed.seed"), "pos": F.col("_seed.pos")}).drop("_seed", "_hashes", "_words")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row for each document and item that share a passage: id_col, _row (row_key of id and text), item_col, n_equal,
    n_length (words of the stretch), n_item (words of the item), doc_start, item_start (in words, from 0)."""
    items = benchmark.select(F.col(item_col), word_list("text").alias("_words")).where(F.size("_words") >= SPAN).distinct()
    items = cut(items, "bench-items")
    seeds = cut(_with_seeds(items).select(F.col(item_col), "seed", F.col("pos").alias("item_pos")), "bench-seeds")
    small = seeds.count() <= BROADCAST_SEEDS
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"), row_key({c: dict(docs.dtypes)[c] for c in (id_col, text_col)}).alias("_row"))
    mine = _with_seeds(rows.select("_row", word_list("text").alias("_words")))
    hits = mine.join(F.broadcast(seeds) if small else seeds, "seed").groupBy("_row", item_col, (F.col("pos") - F.col("item_pos")).alias("diagonal")).agg(F.count("*").alias("n_hits"))
    hits = cut(hits, "bench-hits")
    hit_rows = hits.select("_row").distinct()
    n_hit = hit_rows.count()
    texts = rows.join(F.broadcast(hit_rows) if n_hit <= BROADCAST_SEEDS else hit_rows, "_row", "left_semi").dropDuplicates(["_row"]).withColumn("_words", word_list("text")).drop("text")
    both = hits.join(texts, "_row").join((F.broadcast(items) if small else items).withColumnRenamed("_words", "_item"), item_col)
    first = F.greatest(F.lit(0), -F.col("diagonal")).cast("int")
    last = (F.least(F.size("_item"), F.size("_words") - F.col("diagonal")) - 1).cast("int")
    start = F.struct(*[F.lit(0).alias(c) for c in ("score", "equal", "start", "best", "best_equal", "best_start", "best_end")])

    def step(s: Column, i: Column) -> Column:
        same = F.get(F.col("_item"), i) == F.get(F.col("_words"), i + F.col("diagonal").cast("int"))
        fresh = s.score <= 0
        score = F.when(same, F.greatest(s.score, F.lit(0)) + 1).otherwise(s.score - 2)
        equal = F.when(same, F.when(fresh, 1).otherwise(s.equal + 1)).otherwise(s.equal)
        begin = F.when(same & fresh, i).otherwise(s.start)
        better = score > s.best
        return F.struct(
            score.alias("score"), equal.alias("equal"), begin.alias("start"), F.when(better, score).otherwise(s.best).alias("best"),
            F.when(better, equal).otherwise(s.best_equal).alias("best_equal"), F.when(better, begin).otherwise(s.best_start).alias("best_start"), F.when(better, i).otherwise(s.best_end).alias("best_end"),
        )

    found = both.withColumn("_s", F.aggregate(F.sequence(first, last), start, step)).where(F.col("_s.best_equal") >= least)
    found = found.select(
        F.col(id_col), "_row", F.col(item_col), F.col("_s.best_equal").alias("n_equal"), (F.col("_s.best_end") - F.col("_s.best_start") + 1).alias("n_length"),
        F.size("_item").alias("n_item"), (F.col("_s.best_start") + F.col("diagonal")).cast("int").alias("doc_start"), F.col("_s.best_start").alias("item_start"),
    )
    best = found.groupBy(id_col, "_row", item_col).agg(F.max(F.struct("n_equal", (-F.col("doc_start")).alias("near"), "n_length", "n_item", "item_start")).alias("s"))
    return best.select(id_col, "_row", item_col, *[F.col(f"s.{c}") for c in ("n_equal", "n_length", "n_item")], (-F.col("s.near")).alias("doc_start"), "s.item_start")

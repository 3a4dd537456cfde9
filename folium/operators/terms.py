"""Terms of a collection of texts: runs of words that several texts share.

Runs are counted as 64-bit hashes first; only runs whose hash enough texts have become strings, and are counted again as such, so equal
hashes of different runs change nothing. A phrase yields to a longer one that holds it: every text with the longer one has
the shorter one too, so the counts decide, and each phrase is looked up from its own sub-phrases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folium.operators.lineage import settle

BREAKS = r"[.,;:!?()\[\]{}\"“”„|/–—\n]|\s-\s"
TOKEN = r"[\p{L}\p{N}]+(?:[&'’-][\p{L}\p{N}]+)*"
BROADCAST_RUNS = 1_000_000


def chunks(text: Column) -> Column:
    """array<array<string>>: the words of each stretch between breaks."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), BREAKS), lambda c: F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)))


def spread(texts: DataFrame) -> DataFrame:
    """Few bytes of text are much work: as many partitions as a shuffle has, however small the texts are together."""
    return texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _runs(words: Column, size: int, of) -> Column:
    """of(words from i on) for each run of `size` words; an empty array where there are fewer."""
    at = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: of(F.slice(words, i, F.lit(size))))


def _all_runs(chunks_: Column, sizes: tuple[int, ...], of) -> Column:
    return F.flatten(F.transform(chunks_, lambda c: F.concat(*[_runs(c, n, of) for n in sizes])))


def frequent_runs(texts: DataFrame, words: Column, sizes: tuple[int, ...] = (2, 3, 4), least: int = 3) -> DataFrame:
    """term (words joined by spaces), n (words), n_texts of runs that at least `least` rows of texts have. words: array<array<string>>, without nulls."""
    rows = spread(texts.select(words.alias("c")))
    hashed = rows.select(F.explode(F.array_distinct(_all_runs(F.transform("c", lambda c: F.transform(c, lambda w: F.xxhash64(w))), sizes, lambda r: F.xxhash64(r)))).alias("h"))
    often = settle(hashed.groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") >= least).select("h"))
    often = F.broadcast(often) if often.count() <= BROADCAST_RUNS else often
    terms = rows.select(F.explode(F.array_distinct(_all_runs(F.col("c"), sizes, lambda r: F.array_join(r, " ")))).alias("term"))
    key = F.xxhash64(F.transform(F.split("term", " "), lambda w: F.xxhash64(w)))
    counted = terms.withColumn("h", key).join(often, "h", "left_semi").groupBy("term").agg(F.count("*").alias("n_texts")).where(F.col("n_texts") >= least)
    return counted.select("term", F.size(F.split("term", " ")).alias("n"), "n_texts")


def not_absorbed(terms: DataFrame, share: float = 0.75) -> DataFrame:
    """terms (term, n, n_texts) without those that a longer one holds in at least `share` of their texts."""
    words = F.split("term", " ")
    parts = F.filter(F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(F.lit(1), F.size(words) - i + 1), lambda n: F.array_join(F.slice(words, i, n), " ")))), lambda p: p != F.col("term"))
    held = terms.select(F.explode(F.array_distinct(parts)).alias("term"), F.col("n_texts").alias("n_longer")).groupBy("term").agg(F.max("n_longer").alias("n_longer"))
    return terms.join(held, "term", "left").where(F.coalesce(F.col("n_longer"), F.lit(0)) < share * F.col("n_texts")).drop("n_longer")


def spellings(texts: DataFrame, words: Column, terms: DataFrame, sizes: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """term, spelling, n_uses: how each term (lower case) is written most often, of equals the last by code point; n_uses of that spelling."""
    small = F.broadcast(terms.select("term")) if terms.count() <= BROADCAST_RUNS else terms.select("term")
    uses = texts.select(F.explode(_all_runs(words, sizes, lambda r: F.array_join(r, " "))).alias("spelling")).withColumn("term", F.lower("spelling")).join(small, "term", "left_semi")
    n = uses.groupBy("term", "spelling").agg(F.count("*").alias("n"))
    return n.groupBy("term").agg(F.max_by("spelling", F.struct("n", "spelling")).alias("spelling"), F.max("n").alias("n_uses"))


def find_terms(segments: DataFrame, text_col: str = "text", stop: tuple[str, ...] = (), least: int = 3, keep: int = 80) -> DataFrame:
    """rank, term, spelling, n, n_texts, n_uses: the `keep` terms that most distinct texts have; then longer ones, then by code point.

    Runs of 2 to 4 words without a stop word, within one stretch between breaks.
    """
    texts = segments.select(F.coalesce(text_col, F.lit("")).alias("t")).distinct()
    written = chunks(F.col("t"))
    if stop:  # a stop word ends a stretch
        cut = F.transform(written, lambda c: F.array_join(F.transform(c, lambda w: F.when(F.lower(w).isin(*stop), "\n").otherwise(w)), " "))
        written = F.transform(F.flatten(F.transform(cut, lambda c: F.split(c, "\n"))), lambda c: F.filter(F.split(c, " "), lambda w: w != ""))
    texts = settle(spread(texts).select(written.alias("c")))
    lower = F.transform("c", lambda c: F.transform(c, lambda w: F.lower(w)))
    terms = settle(not_absorbed(frequent_runs(texts, lower, least=least)))
    best = terms.orderBy(F.col("n_texts").desc(), F.col("n").desc(), "term").limit(keep)  # the feature: a short list
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n_texts").desc(), F.col("n").desc(), "term")))
    return ranked.join(spellings(texts, F.col("c"), best), "term").select("rank", "term", "spelling", "n", "n_texts", "n_uses")

"""Language-model scoring by partial matching (PPM) over bytes.

The model is a trie of byte contexts. A node (context of `order` bytes, next symbol) is one
64-bit number: the bytes from oldest to newest, the symbol last. Dropping the oldest byte of
a number gives the same symbol in the next shorter context, so all shorter orders are sums
over the longest one.

A symbol seen after its longest known context has probability (2c - 1) / 2T: c its count there,
T all counts there. Else an escape, d / 2T with d distinct symbols, is paid and the symbol is
looked up in the next shorter context, without the symbols already seen in the longer one
(symbol exclusion; as a shorter context has seen all that a longer one has, what is left out
are two sums per context). After order 0 follow equal shares of the symbols never seen.

Documents are dealt to buckets of bounded size. Each bucket says which nodes and words it
needs, the needs are joined with the trie, and what comes back is used with the bucket's
texts: neither the trie nor the vocabulary is ever held by one process. Words are told apart by
62 bits of a hash.

Defined cases: a null text is empty, and an empty text is its end symbol alone; a null id
counts as learnt from; repeated rows are scored and learnt each; without any row to learn
from every symbol has an equal share. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from folium.llm._store import cut, text_bytes
from folium.llm._text import U, Texts, texts

END, PAD = 0xFF, 0xFE  # no UTF-8 text holds these bytes
SYMBOLS = 255  # all bytes but PAD
WORD = 1 << 62  # words are numbered from here, by a hash of 62 bits
BUCKET_BYTES = 32 << 20


def _grams(part: Texts, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of each text, its end included: the node's number, and the row."""
    n, rows = len(part.data), part.rows
    lens = np.diff(part.at)
    size = n + rows * (order + 1)
    padded = np.full(size, PAD, np.uint8)
    row_of = np.repeat(np.arange(rows), lens)
    padded[np.arange(n) + (row_of + 1) * order + row_of] = part.data
    ends = part.at[1:] + (np.arange(rows) + 1) * order + np.arange(rows)
    padded[ends] = END
    gram = np.zeros(size - order, np.int64)
    for j in range(order + 1):
        gram <<= 8
        gram |= padded[j : size - order + j]
    symbol = np.concatenate([np.arange(n) + row_of * (order + 1), ends - order])  # index of the window that ends there
    return gram[symbol], np.concatenate([row_of, np.arange(rows)])


def _word_nodes(part: Texts) -> tuple[np.ndarray, np.ndarray]:
    """For each word: its number (a hash with bit 62 set, above all nodes), and the row."""
    part.words()
    number = (part.hashes >> U(2)).astype(np.int64) | WORD
    return number, np.repeat(np.arange(part.rows), np.diff(part.word_at))


def _need(order: int):
    """A bucket's distinct nodes and words, each with its count in the texts to learn from."""

    def need(table: pa.Table) -> pa.Table:
        learn = np.asarray(table["held_out"].fill_null(False)) == 0
        parts = []
        for row, part in texts(table["text"]):
            take = learn[row : row + part.rows]
            keys = [(number.view(U) << U(1)) | take[of].astype(U) for number, of in (_grams(part, order), _word_nodes(part))]
            key = np.concatenate(keys)
            key.sort()
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.diff(np.concatenate([edge, [len(key)]]))
            key = key[edge]
            parts.append(((key >> U(1)).view(np.int64), n * (key & U(1)).astype(np.int64)))
            if len(parts) == 8:
                parts = [_merged(parts)]
        node, n = _merged(parts) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        bucket = table["bucket"][0].as_py()
        return pa.table({"bucket": pa.array(np.full(len(node), bucket, np.int32)), "node": pa.array(node), "n": pa.array(n)})

    return need


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    node, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(node, kind="stable")
    node, n = node[order], n[order]
    edge = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    return node[edge], np.add.reduceat(n, edge)


def _score(order: int, names: list[str], learnt: int, distinct: int, ends: int):
    def score(docs: pa.Table, known: pa.Table) -> pa.Table:
        by = np.argsort(np.asarray(known["node"]))
        node, value = np.asarray(known["node"])[by], np.asarray(known["value"])[by]
        del known
        below = learnt + 0.1 * (distinct + 1)
        n_tokens, n_known, base, total = ([np.zeros(0)] for _ in range(4))
        for _, part in texts(docs["text"]):
            need, of = _grams(part, order)
            at = np.argsort(need)
            total.append(np.bincount(of[at], value[np.searchsorted(node, need[at])], part.rows))
            need, of = _word_nodes(part)
            c = value[np.searchsorted(node, need)]
            n_tokens.append(np.diff(part.word_at) + 1)
            n_known.append(np.bincount(of, c > 0, part.rows) + (ends > 0))
            base.append(np.bincount(of, np.log10((c + 0.1) / below), part.rows) + math.log10((ends + 0.1) / below))
        long = lambda x: pa.array(np.concatenate(x).astype(np.int64))
        return pa.table({
            **{c: docs[c] for c in names}, "n_tokens": long(n_tokens), "n_known": long(n_known), "train_tokens": pa.array(np.full(docs.num_rows, learnt)),
            "base_score": pa.array(np.concatenate(base)), "score": pa.array(np.concatenate(total)),
        })

    return score


def _trie(grams: DataFrame, order: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """nodes[k]: (node, c) of order k; contexts[k]: (ctx, t, d) with, for the next shorter context under exclusion, left_t and left_d."""
    nodes: list[DataFrame] = [grams] * (order + 1)
    for k in range(order - 1, -1, -1):
        mask = (1 << (8 * (k + 1))) - 1
        shorter = nodes[k + 1].groupBy(F.col("node").bitwiseAND(F.lit(mask)).alias("node")).agg(F.sum("c").alias("c"))
        nodes[k] = cut(shorter, f"ppm-nodes-{k}")
    contexts: list[DataFrame] = []
    for k in range(order + 1):
        own = nodes[k].withColumn("ctx", F.shiftright("node", 8))
        if not k:
            contexts.append(own.groupBy("ctx").agg(F.sum("c").alias("t"), F.count("*").alias("d")))
            continue
        mask = (1 << (8 * k)) - 1
        up = nodes[k - 1].select(F.col("node").alias("up"), F.col("c").alias("up_c"))
        above = contexts[k - 1].select(F.col("ctx").alias("above"), F.col("t").alias("above_t"), F.col("d").alias("above_d"))
        got = (
            own.withColumn("up", F.col("node").bitwiseAND(F.lit(mask)))
            .join(_bounded(up, k), "up")
            .groupBy("ctx").agg(F.sum("c").alias("t"), F.count("*").alias("d"), F.sum("up_c").alias("x"))
            .withColumn("above", F.col("ctx").bitwiseAND(F.lit((1 << (8 * (k - 1))) - 1)))
            .join(_bounded(above, k - 1), "above")
            .select("ctx", "t", "d", (F.col("above_t") - F.col("x")).alias("left_t"), (F.col("above_d") - F.col("d")).alias("left_d"))
        )
        contexts.append(cut(got, f"ppm-contexts-{k}"))
    return nodes, contexts


def _bounded(table: DataFrame, bytes_of_key: int) -> DataFrame:
    """Keys of up to two bytes are at most 65,536 rows: those tables are broadcast."""
    return F.broadcast(table) if bytes_of_key <= 2 else table


def _costs(all_grams: DataFrame, order: int) -> DataFrame:
    """(node, value): log10 probability of each node that any text needs."""
    seen = cut(all_grams.where("c > 0"), "ppm-nodes")
    nodes, contexts = _trie(seen, order)
    top = contexts[order].select("ctx", "t", "d")
    known = (
        seen.withColumn("ctx", F.shiftright("node", 8)).join(top, "ctx")
        .select("node", F.log10((2 * F.col("c") - 1) / (2 * F.col("t"))).alias("value"))
    )
    new = all_grams.where("c = 0").select("node", F.lit(0.0).alias("value"), F.lit(False).alias("found"))
    new = new.withColumns({"left_t": F.lit(None).cast("long"), "left_d": F.lit(None).cast("long")})
    for k in range(order, -1, -1):
        own = nodes[k].select(F.col("node").alias("key"), F.col("c").alias("own_c"))
        ctx = contexts[k]
        more = {x: F.col(x) if x in ctx.columns else F.lit(None).cast("long") for x in ("left_t", "left_d")}
        ctx = ctx.select(F.col("ctx").alias("ctx"), F.col("t").alias("own_t"), F.col("d").alias("own_d"), more["left_t"].alias("next_t"), more["left_d"].alias("next_d"))
        new = new.withColumns({"key": F.col("node").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1)), "ctx": F.shiftright(F.col("node").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1)), 8)})
        new = new.join(_bounded(ctx, k), "ctx", "left").join(_bounded(own, k + 1), "key", "left")
        t, d = F.coalesce("left_t", "own_t"), F.coalesce("left_d", "own_d")
        cost = F.when(F.col("own_c").isNotNull(), F.log10((2 * F.col("own_c") - 1) / (2 * t))).when(F.coalesce(t, F.lit(0)) > 0, F.log10(d / (2 * t))).otherwise(0.0)
        new = new.select(
            "node", F.when(F.col("found"), F.col("value")).otherwise(F.col("value") + cost).alias("value"), (F.col("found") | F.col("own_c").isNotNull()).alias("found"),
            F.col("next_t").alias("left_t"), F.col("next_d").alias("left_d"), F.when(F.lit(k == 0), F.col("own_d")).alias("d0"),
        )
        if k in (order - 2, order - 4):
            new = cut(new, f"ppm-new-{k}")
        new = new if k == 0 else new.drop("d0")
    rest = F.log10(F.lit(1.0) / (F.lit(SYMBOLS) - F.coalesce("d0", F.lit(0))))
    new = new.select("node", F.when(F.col("found"), F.col("value")).otherwise(F.col("value") + rest).alias("value"))
    return known.unionByName(new)


def ppm_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 5, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Scores every row with a model learnt from the rows where held_out is not true.

    Returns id_col, held_out, n_tokens, n_known, train_tokens, base_score (add-0.1 word model) and
    score (PPM, log10 probability of the lower-cased text and its end); one row for each input row.
    order: bytes of context, 1 to 6. bucket_bytes: text per bucket, the unit that one task holds.
    """
    if not 1 <= order <= 6:
        raise ValueError("order must be 1 to 6: a node is one 64-bit number")
    buckets = max(24, math.ceil(text_bytes(docs, text_col) / bucket_bytes))
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.col(id_col), F.col("text")), F.lit(buckets)).cast("int"))
    needs = cut(rows.groupBy("bucket").applyInArrow(_need(order), "bucket int, node long, n long"), "ppm-needs")
    counts = cut(needs.groupBy("node").agg(F.sum("n").alias("c")), "ppm-counts")
    grams, words = counts.where(F.col("node") < WORD), counts.where(F.col("node") >= WORD)
    total = words.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    ends = rows.where("not held_out").count()
    learnt, distinct = (total["n"] or 0) + ends, (total["v"] or 0) + (ends > 0)
    known = _costs(grams, order).unionByName(words.select("node", F.col("c").cast("double").alias("value")))
    back = needs.select("bucket", "node").join(known, "node").select("bucket", "node", "value")
    kind = dict(rows.dtypes)[id_col]
    out = f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("bucket").cogroup(back.groupBy("bucket")).applyInArrow(_score(order, [id_col, "held_out"], learnt, distinct, ends), out)


def held_out_tenth(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text leaves 0 on division by 10."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))

"""Packing against the plain tokenizer, exhaustive search and bounds."""

import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folium.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
STRANGE = [
    "Don't I'll they're 'S x'd a's,", "<|endoftext|> a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>", "é ́a café, NAÏVE— naïve.—", "a\x1cb\x85c d e", "ΣΑΣ Σ. İstanbul ǅ", "x_y __ _a a_ ~`^ 12,5 3.141 a1b2",
    "漢字かな 🙂🙂 e🙂", "Straße×÷ ÀÉ÷x", "", "   \n\t", "\x00 a\x00b",
]


def plain(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 0]


@pytest.fixture(scope="module")
def mixed(spark, rows):
    more = [(9000 + i, t, "en", "s") for i, t in enumerate(STRANGE)] + [(9100, "tale of two " * 2500, "en", "s"), (9100, "tale of two " * 2500, "en", "s"), (9101, "x" * 5000, "en", "s")]
    return [*rows, *more], spark.createDataFrame([*rows, *more], "doc_id long, text string, length string, piece string").repartition(3)


def test_pieces_and_sequences(mixed):
    rows, docs = mixed
    packed = packing.pack(docs, PATH, keep_ids=True).collect()
    known = {t: plain(t) for t in {r[1] for r in rows}}
    want = sorted(
        ((r[0] is None, r[0] or 0), i, 2048 * i, len(ids := known[r[1]][2048 * i : 2048 * i + 2048]), zlib.crc32(np.array(ids, "<u4").tobytes()))
        for r in rows for i in range(math.ceil(len(known[r[1]]) / 2048))
    )
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in packed)
    for _, own in itertools.groupby(sorted(packed, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= 2048
    total = sum(r.length for r in packed)
    assert len({r.sequence_id for r in packed}) <= math.ceil(total / 2048) + 1


def test_words_equal_whole_texts(rows):
    words = packing.Words(PATH, 0)
    for text in [*STRANGE, *[r[1] or "" for r in rows], "word " * 4000]:
        found = []
        for some in packing._split(text.encode()):
            found.append(np.array([words[w] for w in some]))
        words.learn()
        assert words.ids(np.concatenate(found))[0].tolist() == plain(text)


def test_long_texts_in_chunks(monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 50)
    text = " ".join(random.Random(2).choice(["one", "Two,", "x" * 70, "é!"]) for _ in range(400))
    words = packing.Words(PATH, 0)
    found = [np.array([words[w] for w in some]) for some in packing._split(text.encode())]
    words.learn()
    assert len(found) > 10 and words.ids(np.concatenate(found))[0].tolist() == plain(text)


def test_forgets(monkeypatch, spark, rows):
    monkeypatch.setattr(packing, "REMEMBERED", 10)
    words = packing.Words(PATH, 0)
    for text in ["a b c", "d e f"]:
        words.forget()
        numbers = np.array([words[w] for w in next(packing._split(text.encode()))])
        words.learn()
        assert words.ids(numbers)[0].tolist() == plain(text)


def test_fullest_is_exact():
    draw = random.Random(5)
    for _ in range(200):
        counts = dict(sorted(((draw.randint(1, 30), draw.randint(1, 4)) for _ in range(5)), reverse=True))
        room = draw.randint(1, 70)
        got = packing.fullest(counts, room)
        sums = {sum(n * t for n, t in zip(counts, ts)) for ts in itertools.product(*[range(c + 1) for c in counts.values()])}
        assert sum(n * t for n, t in got) == max(s for s in sums if s <= room) and all(t <= counts[n] for n, t in got)


def _fewest(items, capacity):
    """Fewest bins, by search."""
    for n in range(math.ceil(sum(items) / capacity), len(items) + 1):
        seen = set()

        def fits(at, bins):
            if at == len(items):
                return True
            if (at, bins) in seen:
                return False
            seen.add((at, bins))
            return any(fits(at + 1, tuple(sorted((*bins[:i], b + items[at], *bins[i + 1 :])))) for i, b in enumerate(bins) if b + items[at] <= capacity)

        if fits(0, (0,) * n):
            return n


def test_plan_holds_all_and_is_near_the_fewest():
    draw, extra = random.Random(3), 0
    for _ in range(60):
        items = sorted((draw.randint(1, 20) for _ in range(draw.randint(1, 11))), reverse=True)
        counts = {n: items.count(n) for n in items}
        rows, bins, held = packing.plan(counts, 20), {}, dict.fromkeys(counts, 0)
        for length, first, end, each, sequence, offset in rows:
            assert first == held[length]
            held[length] = end
            for rank in range(end - first):
                bins.setdefault(sequence + rank // each, []).append((offset + rank % each * length, length))
        assert held == counts
        for own in bins.values():
            own.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[0][0] == 0 and sum(own[-1]) <= 20
        extra += len(bins) - _fewest(items, 20)
    assert extra <= 3


def test_large_counts_make_a_short_plan():
    counts = {n: 10**9 // n for n in range(1, 2049)}
    rows = packing.plan(counts, 2048)
    assert len(rows) < 20 * 2048
    sequences = max(s + (end - first) // each for _, first, end, each, s, _ in rows)
    assert sequences <= 1.001 * sum(n * c for n, c in counts.items()) / 2048


def test_sequences_and_shuffled_cells(monkeypatch, mixed):
    _, docs = mixed
    monkeypatch.setattr(packing, "BROADCAST_CELLS", 0)
    packed = packing.pack(docs, PATH, keep_ids=True)
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r.sequence_id].ids[4 * r.offset : 4 * (r.offset + r.length)] == r.ids
    assert sum(r.length for r in whole.values()) == packed.agg(F.sum("length")).first()[0]


def test_no_rows(empty):
    assert packing.pack(empty, PATH).collect() == []

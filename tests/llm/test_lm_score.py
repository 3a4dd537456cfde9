import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folium.llm.lm_score import held_out_tenth, ppm_scores

K = 5


def brute(rows):
    train = [(t or "").encode().lower() for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10]
    ctx = [defaultdict(Counter) for _ in range(K + 1)]
    for t in train:
        b = bytes([0xFE] * K) + t + b"\xff"
        for p in range(K, len(b)):
            for k in range(K + 1):
                ctx[k][b[p - k : p]][b[p]] += 1
    words = Counter(w for t in train for w in [*t.split(), None])
    n, v = sum(words.values()), len(words)

    def log_p(b, p):
        out, seen = 0.0, set()
        for k in range(K, -1, -1):
            c = ctx[k].get(b[p - k : p])
            if not c:
                continue
            left = {s: m for s, m in c.items() if s not in seen}
            t = sum(left.values())
            if b[p] in left:
                return out + math.log10((2 * left[b[p]] - 1) / (2 * t))
            if t:
                out += math.log10(len(left) / (2 * t))
            seen |= set(c)
        return out + math.log10(1 / (255 - len(seen)))

    for i, t in rows:
        t = (t or "").encode().lower()
        b = bytes([0xFE] * K) + t + b"\xff"
        tokens = [*t.split(), None]
        base = sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        yield i, len(tokens), sum(words[w] > 0 for w in tokens), n, base, sum(log_p(b, p) for p in range(K, len(b)))


def test_equals_brute_force(docs, rows):
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5), round(r["score"], 4)) for r in ppm_scores(docs, held_out_tenth()).collect())
    want = sorted((i or -1, a, b, n, round(x, 5), round(y, 4)) for i, a, b, n, x, y in brute([r[:2] for r in rows]))
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want):
        assert g[4:] == pytest.approx(w[4:], abs=1e-3)


def test_empty_and_nothing_to_learn(empty, docs):
    assert ppm_scores(empty, held_out_tenth()).count() == 0
    some = ppm_scores(docs.where("doc_id = 5"), F.lit(True)).first()
    assert some["score"] == pytest.approx(4 * math.log10(1 / 255))
    assert (some["n_tokens"], some["n_known"], some["train_tokens"]) == (2, 0, 0)

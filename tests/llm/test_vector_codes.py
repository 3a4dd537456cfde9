"""Vector codes against plain Lloyd rounds in Python integers."""

import hashlib
import math
import random

import pytest

from folium.llm import vector_codes

INF, NAN = float("inf"), float("nan")


def brute(rows, parts, entries, rounds, scale):
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    dim = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == dim]
    size = dim // parts
    cut = lambda v: [tuple(v[p * size : p * size + size]) for p in range(parts)]
    vectors = [cut(v) for _, v, _ in kept]
    books = [[v[p] for v in vectors[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min(range(len(books[p])), key=lambda e: (far(v[p], books[p][e]), e))
    for _ in range(rounds):
        codes = [[near(v, p) for p in range(parts)] for v in vectors]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p] for v, c in zip(vectors, codes) if c[p] == e]
                if own:
                    books[p][e] = tuple(sum(x) // len(own) for x in zip(*own))
    out = []
    for (i, _, label), v in zip(kept, vectors):
        code = [near(v, p) for p in range(parts)]
        out.append((i, bytes(code), sum(far(v[p], books[p][c]) for p, c in enumerate(code)), label))
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    return out, hashlib.sha256(text.encode()).hexdigest()


def vectors(n, dim, seed, spread=1.0):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, spread) for _ in range(dim)] for _ in range(7)]
    # eighths of 1/4096 are exact in single precision
    return [(i, [round(8 * 4096 * (c + draw.gauss(0, 0.3 * spread))) / 8 / 4096 for c in draw.choice(centres)], draw.choice([None, 1, 2])) for i in range(n)]


def order(r):
    return (r[0] is None, r[0] or 0, bytes(r[1]), r[2], r[3] is None, r[3] or 0)


@pytest.mark.parametrize("n,dim,parts,entries,rounds,spread", [(300, 16, 8, 16, 6, 1.0), (5, 8, 8, 16, 6, 1.0), (200, 6, 2, 4, 9, 3.0), (120, 8, 4, 8, 3, 3e4), (40, 8, 8, 16, 0, 1.0)])
def test_equals_brute_force(spark, n, dim, parts, entries, rounds, spread):
    rows = vectors(n, dim, n, spread)
    rows += [(rows[2][0], rows[2][1], 2), (None, rows[3][1], 1), (n + 1, rows[0][1], None), (n + 2, rows[0][1], 1)]
    odd = [(-9, None, 1), (-8, [], 1), (-7, [NAN] * dim, 1), (-6, [INF] + [0.0] * (dim - 1), 1), (-5, [None] + [0.0] * (dim - 1), 1), (n + 5, [0.5] * (dim + 1), 1)]
    table = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<double>, label int, codes string").repartition(3)
    coded, books = vector_codes.compress(table, parts, entries, rounds)
    want, text = brute(rows, parts, entries, rounds, 4096)
    got = [(r.vec_id, bytes(r.codes), r.error, r.label) for r in coded.collect()]
    assert sorted(got, key=order) == sorted(want, key=order)
    assert vector_codes.digest(books) == text
    sums = {label: sum(r[2] for r in want if r[3] == label) for label in {r[3] for r in want}}
    assert {r.label: r.label_error for r in vector_codes.label_errors(coded).collect()} == sums


def test_shuffles_only_changes(spark, monkeypatch):
    """Once assignments hold, a round moves nothing."""
    moved, cut = [], vector_codes.cut

    def counting(df, name):
        out = cut(df, name)
        if name.startswith("codes-round"):
            moved.append(sum(len(r.cells) for r in out.where("cells IS NOT NULL").collect()))
        return out

    monkeypatch.setattr(vector_codes, "cut", counting)
    rows = [(i, [float(i % 4), float(i % 4)], 1) for i in range(200)]
    vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), parts=2, entries=4, rounds=9)
    assert moved[0] > 0 and len(moved) < 9 and (len(moved) == 1 or moved[-1] == 0)


def test_clipped_and_uneven_and_no_rows(spark):
    big = [(i, [1e30 * (-1) ** i, 0.25, float(i)], None) for i in range(4)]
    coded, books = vector_codes.compress(spark.createDataFrame(big, "vec_id long, embedding array<double>, label int"), parts=2, entries=2)
    assert [b.shape for b in books] == [(2, 2), (2, 1)] and sorted({r.codes[0] for r in coded.collect()}) == [0, 1]
    none = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    coded, books = vector_codes.compress(none)
    assert coded.collect() == [] and vector_codes.digest(books) == hashlib.sha256(b"").hexdigest() and vector_codes.label_errors(coded).collect() == []

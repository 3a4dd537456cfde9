import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from folium.llm.ann import nearest
from folium.llm.components import components
from folium.llm import repeats
from folium.llm.repeats import repeated_passages
from folium.llm.shard import ROW_BYTES, shard


def brute_nearest(x, q, k):
    d = {i: float(np.sqrt(((np.array(v, np.float64) - np.array(x[q], np.float64)) ** 2).sum())) for i, v in x.items() if i != q}
    return sorted(d.items(), key=lambda t: (t[1], t[0]))[:k]


def test_neighbours_recall_and_exact_scores(spark):
    draw = np.random.default_rng(2)
    centers = draw.normal(size=(20, 16))
    vectors = (centers[draw.integers(0, 20, 3000)] + 0.3 * draw.normal(size=(3000, 16))).astype(np.float32)
    x = {i: v.tolist() for i, v in enumerate(vectors)}
    for i in range(2000, 2400):
        x[i] = x[100]  # many equal vectors
    odd = [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [1.0] * 15 + [None]), (5400, [1.0, 2.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame([*x.items(), *odd, (7, x[7])], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in nearest(df, every=100, k=10).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == [i for i in x if i % 100 == 0]
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        want = brute_nearest(x, q, 10)
        hit += len({i for i, _ in want} & {f[1] for f in found})
        for _, i, score in found:
            assert score == pytest.approx(float(np.linalg.norm(np.array(x[i]) - np.array(x[q]))), rel=1e-9, abs=1e-12)
        assert [(f[2], f[1]) for f in found] == sorted((f[2], f[1]) for f in found)
    assert hit >= 0.9 * 10 * len(got)
    assert [f[1] for f in got[2300]] == [100, *range(2000, 2009)]


def test_neighbours_are_the_nearest_of_any_rows(spark):
    draw = np.random.default_rng(1)
    scales = np.exp(4 * draw.normal(size=(3000, 1))) * draw.normal(size=(3000, 32))
    apart = draw.normal(size=(3000, 32))  # the queries lie elsewhere than most rows
    apart[::100] = 5 + 0.1 * draw.normal(size=(30, 32))
    apart[1::50] = 5 + 2 * draw.normal(size=(60, 32))
    for x in (scales, apart, 1e6 + draw.normal(size=(3000, 16))):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = defaultdict(list)
        for r in nearest(df, every=100, k=10, sample_rows=1000, again=16).collect():
            got[r["query_id"]].append((r["score"], r["vec_id"]))
        for q in range(0, 3000, 100):
            assert [i for _, i in sorted(got[q])] == [i for i, _ in brute_nearest(dict(enumerate(x)), q, 10)]


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r["vec_id"]) for r in nearest(df).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert nearest(df.limit(0)).count() == 0


def check_shards(docs, limit):
    got = shard(docs, limit).collect()
    total, n = Counter(), Counter()
    for r in got:
        assert r["n_bytes"] == len((r["text"] or "").encode()) + ROW_BYTES
        total[r["shard_id"]] += r["n_bytes"]
        n[r["shard_id"]] += 1
    for r in got:
        assert (r["shard_bytes"], r["shard_rows"]) == (total[r["shard_id"]], n[r["shard_id"]])
        assert r["shard_depth"] == len(r["shard_id"])
        assert r["shard_bytes"] <= limit or r["shard_rows"] == 1
        assert r["oversize"] == (r["shard_bytes"] > limit)
    names = sorted(total)
    for a, b in zip(names, names[1:]):
        assert not b.startswith(a)  # no shard within another
    for s in names:  # a split was needed: the parent's rows exceed the limit
        if s:
            assert sum(v for t, v in total.items() if t.startswith(s[:-1])) > limit
    return got


def test_shards_fit_and_split_only_when_needed(spark, docs, rows, empty):
    for limit in (1 << 30, 4000, 600):
        assert len(check_shards(docs, limit)) == len(rows)
    same = spark.createDataFrame([(1, "equal text", "mine", 7)] * 300, "doc_id long, text string, shard_id string, _key int")
    assert len(check_shards(same, 400)) == 300
    assert shard(empty, 100).count() == 0


def test_repeats_equal_brute_force(docs, rows, empty):
    holders = defaultdict(set)
    texts = [(r[1] or "").encode().lower().split() for r in rows]
    for r, w in zip(rows, texts):
        for j in range(len(w) - 49):
            holders[tuple(w[j : j + 50])].add(r[1])
    copies = Counter(r[1] for r in rows)
    want = Counter()
    for r, w in zip(rows, texts):
        hit = np.zeros(len(w), bool)
        for j in range(len(w) - 49):
            if len(holders[tuple(w[j : j + 50])]) > 1 or copies[r[1]] > 1:
                hit[j : j + 50] = True
        if hit.any():
            want[(r[0], len(w), int(hit.sum()))] += 1
    got = Counter((r["doc_id"], r["n_words"], r["n_repeated"]) for r in repeated_passages(docs).collect())
    assert set(k[0] for k in got) == set(k[0] for k in want)
    assert sum((got & want).values()) >= 0.95 * sum(want.values())
    assert repeated_passages(empty).count() == 0


@pytest.mark.parametrize("hot", [50_000, 40])
def test_repeats_are_whole_where_a_footer_is_frequent(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    draw = random.Random(12)
    text = lambda n: [f"w{draw.randint(0, 50000)}" for _ in range(n)]
    words = []
    for own, foot in ((20, 30), (15, 40), (10, 45), (30, 20), (12, 37)):  # the last two meet in 49 words only
        for side in (1, -1):
            for _ in range(3):
                footer, before = text(foot), text(own)
                words += [(text(25) + before + footer + text(40))[::side] for _ in range(2)] + [(text(60) + footer + text(40))[::side] for _ in range(200)]
    words.append(words[0] + words[600][:60])
    got = {r["doc_id"]: (r["n_words"], r["n_repeated"]) for r in repeats.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string")).collect()}
    holders = defaultdict(set)
    for i, w in enumerate(words):
        for j in range(len(w) - 49):
            holders[tuple(w[j : j + 50])].add(i)
    want = {}
    for i, w in enumerate(words):
        hit = np.zeros(len(w), bool)
        for j in range(len(w) - 49):
            if len(holders[tuple(w[j : j + 50])]) > 1:
                hit[j : j + 50] = True
        if hit.any():
            want[i] = (len(w), int(hit.sum()))
    assert len(want) > 40 and got == want


def test_repeats_equal_brute_force_in_every_row(docs, rows):
    holders, texts = defaultdict(set), [(r[1] or "").encode().lower().split() for r in rows]
    for r, w in zip(rows, texts):
        for j in range(len(w) - 49):
            holders[tuple(w[j : j + 50])].add(r[1])
    copies, want = Counter(r[1] for r in rows), Counter()
    for r, w in zip(rows, texts):
        hit = np.zeros(len(w), bool)
        for j in range(len(w) - 49):
            if len(holders[tuple(w[j : j + 50])]) > 1 or copies[r[1]] > 1:
                hit[j : j + 50] = True
        if hit.any():
            want[(r[0], len(w), int(hit.sum()))] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_repeated"]) for r in repeats.repeated_passages(docs).collect()) == want


def test_components(spark):
    draw = random.Random(6)
    edges = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {a: find(a) for a in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_equal_rows_are_split_over_shards(spark):
    rows = spark.createDataFrame([(7, "same text") for _ in range(300)] + [(None, None)] * 5, "doc_id long, text string").repartition(4)
    out = shard(rows, 1000)
    got = out.groupBy("shard_id", "shard_bytes", "shard_rows").agg({"n_bytes": "sum", "*": "count"}).collect()
    assert sum(r["count(1)"] for r in got) == 305
    for r in got:
        assert r["shard_bytes"] == r["sum(n_bytes)"] <= 1000 and r["shard_rows"] == r["count(1)"]


def test_repeats_with_null_ids_and_repeated_rows(spark):
    common = " ".join(f"w{i}" for i in range(80))
    rows = [(None, f"a b {common}"), (2, f"{common} c d e"), (2, f"{common} c d e"), (3, f"x {common}")]
    got = sorted((r["doc_id"] or 0, r["n_repeated"], r["n_copies"]) for r in repeats.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 80, 1), (2, 83, 2), (2, 83, 2), (3, 80, 1)]


def test_repeated_ids_are_neighbours_of_each_other(spark):
    rows = [(100, [1.0, 2.0]), (100, [1.0, 2.5]), (1, [9.0, 9.0]), (100, [1.0, 2.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=100, k=2).collect()
    assert len(got) == 6
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 100, 0.0), (1, 100, 0.0), (1, 100, 0.5), (2, 100, 0.5), (2, 100, 0.5), (2, 100, 0.5)]


def test_matches_around_sorted_suffixes_equal_every_pair():
    draw, least = random.Random(8), 16
    for _ in range(40):
        rows, spare = [], repeats.ANCHOR
        for anchor in range(draw.randint(1, 4)):
            for _ in range(draw.randint(1, 12)):
                before = draw.randint(0, least - spare)
                after = draw.randint(least - before, least)
                words = ["ab"[draw.random() < 0.15] for _ in range(before + after)]  # the anchors differ at times: words decide
                rows.append((anchor, draw.randint(1, 5), draw.randint(before, 99), before, " ".join(words).encode()))
        table = pa.table(dict(zip(("anchor", "text_key", "pos", "before", "words"), map(list, zip(*rows)), strict=True)))
        got = defaultdict(set)
        for r in repeats._matches(table, least).to_pylist():
            got[r["text_key"]] |= set(range(r["start"], r["stop"] - least + 1))
        holders, want = defaultdict(set), defaultdict(set)
        passages = [(anchor, before - j, tuple(w[j : j + least]), key, pos - before + j) for anchor, key, pos, before, words in rows for w in [words.split()] for j in range(len(w) - least + 1) if 0 <= before - j <= least - spare]
        for anchor, left, words, key, _ in passages:
            holders[anchor, left, words].add(key)
        for anchor, left, words, key, start in passages:
            if len(holders[anchor, left, words]) > 1:
                want[key].add(start)
        assert got == want


def test_repeats_compare_long_words_to_their_ends(spark):
    long = ["x" * 100 + str(i) for i in range(60)]
    other = [*long[:30], long[30] + "y", *long[31:]]  # no 50 words in common with the first
    rows = [(1, " ".join(long)), (2, " ".join(other)), (3, "a " + "\t".join(long[:55]))]
    got = {r["doc_id"]: (r["n_repeated"], [tuple(p) for p in r["passages"]]) for r in repeats.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (55, [(0, 55)]), 3: (55, [(1, 56)])}

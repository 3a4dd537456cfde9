import random
from collections import Counter, defaultdict

import pytest

from folium.llm import jaccard_join
from folium.llm.jaccard_join import Bands, keep_one, similarity_components


def sets_of(rows, k):
    out = {}
    for n, r in enumerate(rows):
        w = (r[1] or "").encode().lower().split()
        out[n] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    return out


def brute(rows, k, percent):
    """Component number of each row."""
    sets = sets_of(rows, k)
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    holders = defaultdict(list)
    for n, s in sets.items():
        for x in s:
            holders[x].append(n)
    for n, s in sets.items():
        for m, both in Counter(m for x in s for m in holders[x] if m < n).items():
            if 100 * both >= percent * (len(s) + len(sets[m]) - both):
                parent[max(find(n), find(m))] = min(find(n), find(m))
    return [find(n) for n in range(len(rows))], sets


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_equals_brute_force(docs, rows, k, percent):
    part, sets = brute(rows, k, percent)
    least = {}
    for n, p in enumerate(part):
        if rows[n][0] is not None:
            least[p] = min(least.get(p, 1 << 60), rows[n][0])
    want = Counter((rows[n][0], len(sets[n]), least.get(part[n]) if sets[n] else rows[n][0]) for n in range(len(rows)))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in similarity_components(docs, k, percent).collect())
    assert got == want


def test_a_set_is_kept_together_over_many_partitions(spark, docs, rows):
    small = {"spark.sql.files.maxPartitionBytes": "4000", "spark.sql.files.openCostInBytes": "0", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {c: spark.conf.get(c) for c in small}
    for c, v in small.items():
        spark.conf.set(c, v)
    try:
        part, sets = brute(rows, 4, 85)
        got = keep_one(docs.repartition(8), 4, 85).count()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert got == len({part[n] for n in range(len(rows)) if sets[n]}) + len({rows[n][:2] for n in range(len(rows)) if not sets[n]})


def test_one_stays_of_each_group(docs, rows):
    part, sets = brute(rows, 5, 80)
    got = keep_one(docs.withColumn("class", docs["lang"]))
    assert got.columns == [*docs.columns, "class"]
    kept = Counter(r["doc_id"] for r in got.collect())
    groups = {part[n] for n in range(len(rows)) if sets[n]}
    blank = {rows[n][0] for n in range(len(rows)) if not sets[n]}
    assert sum(kept.values()) == len(groups) + len(blank)
    assert blank <= set(kept)


def test_segments_outnumber_the_difference():
    bands = Bands(85)
    for size in range(1, 3000):
        b = bands.of(size)
        assert bands.edges[b] <= size < bands.edges[b + 1]
        for other in range(size, 100 * size // 85 + 1):
            assert bands.of(other) - b in (0, 1)
            m, q, worth = bands.segments(b)
            assert m >= worth > 15 * (size + other) // 185 and q <= m


def test_sets_that_share_many_contents_meet_once(spark, monkeypatch):
    draw = random.Random(3)
    held = {a: set(range(100)) if a < 3 else set(draw.sample(range(1000), 80)) for a in range(1, 12)}
    members = spark.createDataFrame([(k, a, 11, 11) for a, keys in held.items() for k in keys], "key long, a long, n long, hub long")
    found = spark.createDataFrame([], "node long, component long")
    size = spark.createDataFrame([(a, 100, b"", *[0] * len(jaccard_join.PARITY)) for a in held], f"a long, size long, sketch binary, {', '.join(f'{p} long' for p in jaccard_join.PARITY)}")
    monkeypatch.setattr(jaccard_join, "_fitting", lambda pairs, size, percent: pairs)
    got = Counter(tuple(sorted((r["a"], r["b"]))) for r in jaccard_join._unsettled(members, found, size, 80).collect())
    assert set(got) == {(a, b) for a in held for b in held if a < b and held[a] & held[b]}  # each pair that shares a content
    assert got[1, 2] <= 2  # one content, a row for each that is outside the largest component there


@pytest.fixture(scope="module")
def copies():
    """Near copies of one text, changed little, near the limit and far; some copied on; copies cut short and run on."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    origin = [word() for _ in range(240)]

    def changed(words, n):
        words = list(words)
        for at in draw.sample(range(len(words)), n):
            words[at] = word()
        return words

    texts = [origin] + [changed(origin, n) for n in range(1, 13) for _ in range(7)]
    texts += [changed(t, 3) for t in texts[60:] for _ in range(2)]
    texts += [origin[: 240 - 6 * n] for n in range(1, 9)] + [origin + [word() for _ in range(6 * n)] for n in range(1, 9)]
    return [(n, " ".join(t), "en", "s") for n, t in enumerate(texts)]


@pytest.mark.parametrize(("k", "percent", "outside"), [(4, 85, 0), (5, 80, 0), (2, 60, 1), (4, 85, 1000)])
def test_differences_from_a_hub_lose_no_link(spark, monkeypatch, rows, copies, k, percent, outside):
    monkeypatch.setattr(jaccard_join, "OUTSIDE", outside)
    given = [(n, r[1], *r[2:]) for n, r in enumerate([*copies, *rows])]
    part, _ = brute(given, k, percent)
    got = similarity_components(spark.createDataFrame(given, "doc_id long, text string, lang string, source string"), k, percent)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == dict(enumerate(part))


@pytest.mark.parametrize("outside", [1000, 20])
def test_near_copies_of_one_text_do_not_meet_in_pairs(spark, monkeypatch, outside):
    monkeypatch.setattr(jaccard_join, "OUTSIDE", outside, raising=False)
    draw = random.Random(6)
    origin = [f"word{n}" for n in range(600)]
    given = [(0, " ".join(origin), "en", "s")]
    for n in range(1, 120):
        words = list(origin)
        for at in draw.sample(range(len(words)), 8 if n % 2 else 15):  # linked with the first or not, at four words and 85 per cent
            words[at] = f"new{n}x{at}"
        given.append((n, " ".join(words), "en", "s"))
    met, fitting = [], jaccard_join._fitting
    monkeypatch.setattr(jaccard_join, "_fitting", lambda pairs, size, percent: met.append(pairs.count()) or fitting(pairs, size, percent))
    part, _ = brute(given, 4, 85)
    got = similarity_components(spark.createDataFrame(given, "doc_id long, text string, lang string, source string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == dict(enumerate(part))
    assert len(set(part)) > 50 and len(met) == 2 and met[1] < 2 * len(given)


def test_empty_table(empty):
    assert similarity_components(empty).count() == 0
    assert keep_one(empty).count() == 0

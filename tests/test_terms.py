"""Terms against plain counting."""

import random
import re
from collections import Counter, defaultdict

from folium.operators import terms as T

STOP = ("the", "of")
TOKEN = r"[^\W_]+(?:[&'’-][^\W_]+)*"


def brute(texts, stop, least, keep):
    ids, written = defaultdict(set), defaultdict(Counter)
    for i, text in enumerate(set(texts)):
        for chunk in re.split(r"[.,;:!?()\[\]{}\"“”„|/–—\n]|\s-\s", text):
            words = re.findall(TOKEN, chunk)
            for n in (2, 3, 4):
                for j in range(len(words) - n + 1):
                    run = words[j : j + n]
                    if not any(w.lower() in stop for w in run):
                        ids[" ".join(run).lower()].add(i)
                        written[" ".join(run).lower()][" ".join(run)] += 1
    often = {t: len(x) for t, x in ids.items() if len(x) >= least}
    kept = [t for t, k in often.items() if not any(len(h.split()) > len(t.split()) and f" {t} " in f" {h} " and len(ids[h] & ids[t]) >= 0.75 * k for h in often)]
    kept.sort(key=lambda t: (-often[t], -len(t.split()), t))
    out = []
    for rank, t in enumerate(kept[:keep], 1):
        spelling, n = max(written[t].items(), key=lambda x: (x[1], x[0]))
        out.append((rank, t, spelling, len(t.split()), often[t], n))
    return out


def made():
    draw = random.Random(9)
    words = ["pump", "Pump", "valve", "main", "the", "of", "data-sheet", "safety", "x1", "été", "a's"]
    texts = [" ".join(draw.choice(words) + draw.choice(["", "", "", ".", ",", " -"]) for _ in range(draw.randint(0, 25))) for _ in range(60)]
    return [*texts, "main pump valve", "main pump valve", "Main pump valve again", "see main pump valve", "", None, "one"]


def test_terms_equal_plain_counting(spark):
    texts = made()
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    for keep in (5, 80):
        got = sorted(tuple(r) for r in T.find_terms(df, stop=STOP, keep=keep).collect())
        assert got == brute([t or "" for t in texts], STOP, 3, keep) and len(got) > 3
    T_small = T.BROADCAST_RUNS
    T.BROADCAST_RUNS = 0
    try:
        assert sorted(tuple(r) for r in T.find_terms(df, stop=STOP).collect()) == got
    finally:
        T.BROADCAST_RUNS = T_small


def test_no_texts(spark):
    none = spark.createDataFrame([], "text string")
    assert T.find_terms(none).collect() == []

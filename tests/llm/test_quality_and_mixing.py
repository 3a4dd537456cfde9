import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folium.llm.mixing import mix
from folium.llm.quality import keep_resampled, kth_largest, resample, threshold


def corpus(n):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("bdfgklmnprst") + draw.choice("aeiou") for _ in range(draw.randint(1, 3)))
    out = []
    for i in range(n):
        w = [word() for _ in range(60)]
        bad, junk = i % 10 == 0, i % 10 == 1
        if bad:
            for _ in range(4):
                w[draw.randrange(60)] = draw.choice(("xuqwort", "zzyvile"))
        out.append((i, " ".join(x.upper() + "!!" for x in w) if junk else " ".join(w), int(not junk), int(bad)))
    return out


def test_good_documents_stay_and_others_go(spark):
    rows = corpus(1500)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows if i % 3 != 2], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in resample(docs, labels).where("kept").select("doc_id").collect()}
    unseen = [r for r in rows if r[0] % 3 == 2]
    good = [r[0] for r in unseen if r[2] and not r[3]]
    other = [r[0] for r in unseen if not (r[2] and not r[3])]
    assert np.mean([i in kept for i in good]) > 0.97
    assert np.mean([i in kept for i in other]) < 0.1
    assert {r["doc_id"] for r in keep_resampled(docs, labels).collect()} == kept


def test_odd_rows_and_no_labels(spark, docs, empty):
    labels = spark.createDataFrame([(2, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    assert resample(docs, labels.limit(0)).where("kept").count() == docs.count()
    got = resample(docs, labels)
    assert got.count() == docs.count()
    assert got.where("log_weight is null or kept is null").count() == got.where("kept is null").count()
    assert resample(empty, labels).count() == 0
    more = docs.withColumns({"_text": F.lit("x"), "log_weight": F.lit(1), "good": F.lit(True)})
    kept = keep_resampled(more, labels.limit(0))
    assert kept.columns == more.columns and kept.where("_text = 'x' and log_weight = 1").count() == docs.count()


def test_threshold_and_selection(spark):
    assert threshold(np.array([1.0, 2.0, 5.0, 6.0]), np.array([False, False, True, True])) == 3.5
    values = [float(x) for x in random.Random(5).choices(range(50), k=400)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 7, 200, 400):
        assert kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]


def targets(rows):
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped, total = set(), 1.5 * sum(size.values())
    while True:
        rate = (total - sum(2 * size[s] for s in capped)) / max(1e-9, sum(weight[s] for s in names if s not in capped))
        more = {s for s in names if 2 * size[s] <= rate * weight[s]}
        if more <= capped:
            return size, {s: min(2.0 * size[s], rate * weight[s]) for s in names}
        capped |= more


def test_mix_meets_targets(docs, rows, empty):
    got = mix(docs).collect()
    assert len(got) == len(rows)
    size, want = targets(rows)
    largest = defaultdict(int)
    taken = defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["source_size"] == size[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in want:
        assert abs(taken[s] - want[s]) <= largest[s]
    again = {(r["_row"], r["taken"]) for r in mix(docs.repartition(5)).collect()}
    assert again == {(r["_row"], r["taken"]) for r in got}
    assert mix(empty).count() == 0

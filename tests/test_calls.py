"""Batched calls: halving, asking again, waiting; repair with a cap."""

import pytest
from pyspark.sql import functions as F

from folium.operators import calls as C


def test_halving_finds_the_bad_rows():
    asked = []

    def call(rows):
        asked.append([k for k, _ in rows])
        if any(t == "bad" for _, t in rows):
            raise RuntimeError
        return {k: t.upper() for k, t in rows} | {99: "X"}

    answers, calls = C.ask([(i, "bad" if i in (3, 6) else "ok") for i in range(8)], call)
    assert answers == {i: "OK" for i in range(8) if i not in (3, 6)}
    assert asked[0] == list(range(8)) and [3] in asked and [6] in asked and len(asked) <= 2 * 2 * 4 and calls[3] == 4


def test_left_out_rows_are_asked_once_more():
    asked = []

    def call(rows):
        asked.append([k for k, _ in rows])
        return {k: 1 for k, _ in rows[:-1]}

    answers, calls = C.ask([(1, ""), (2, ""), (3, "")], call)
    assert asked == [[1, 2, 3], [3]] and set(answers) == {1, 2} and calls == {1: 1, 2: 1, 3: 2}


def test_first_answer_stands():
    answers, _ = C.ask([(1, "a"), (2, "b")], lambda rows: {k: len(rows) for k, _ in rows if (k, len(rows)) != (2, 2)})
    assert answers == {1: 2, 2: 1}


def test_bucket_waits():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(round(s, 3))
        now[0] += s

    bucket = C.TokenBucket(2.0, 3, lambda: now[0], sleep)
    for _ in range(5):
        bucket.take()
    now[0] += 10
    bucket.take()
    assert slept == [0.5, 0.5]


@pytest.mark.parametrize("budget", [1, 30, 10_000])
def test_every_row_is_accepted_once(spark, budget):
    rows = [(i, None if i == 5 else f"text {i}" + (" @" if i % 11 == 0 else "")) for i in range(100)]

    def call(block):
        if any("@" in t for _, t in block):
            raise ValueError
        return {k: len(t) for k, t in block if len(block) == 1 or k % 5} | {-7: 1}

    got = {r.i: r for r in C.called(spark.createDataFrame(rows, "i long, t string").repartition(3), "i", "t", call, "int", budget, rate=10_000.0, burst=100).collect()}
    assert len(got) == 100 and {i for i, r in got.items() if r.state == "unanswered"} >= {i for i in range(100) if i % 11 == 0}
    assert all(r.answer == len(rows[i][1] or "") for i, r in got.items() if r.state == "answered")


def test_repair_stops_at_the_cap(spark):
    rows = spark.createDataFrame([(1, "aaa"), (2, "a"), (3, ""), (4, None)], "i int, t string")
    rewrite = lambda s, d, n: F.concat(F.coalesce(d, s), F.lit(str(n)))
    problem = lambda s, d: F.when(~F.coalesce(F.length(d) >= 3, F.lit(False)), "short")
    got = {r.i: (r.draft, r.state, r.attempt) for r in C.repaired(rows, "t", rewrite, problem).collect()}
    assert got == {1: ("aaa0", "accepted", 0), 2: ("a01", "accepted", 1), 3: ("012", "accepted", 2), 4: (None, "verbatim", 2)}

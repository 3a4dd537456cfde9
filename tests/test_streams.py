"""Guards and the queue as streams: several micro-batches, restarts, state between them."""

import random

import pytest
from pyspark.sql import functions as F

from folium.streaming import guards as G, queue as Q

FOLLOWING = {"new": ("open", "closed"), "open": ("waiting", "closed"), "waiting": ("open",)}


@pytest.fixture(scope="module")
def events(spark):
    draw, rows = random.Random(4), []
    for i in range(400):
        rows.append((i, 1_700_000_000 + i * 40 + draw.randint(0, 30), draw.choice([1, 1, 1, 2, 3, None]), draw.choice(["error", "error", "view"]), draw.choice([None, "new", "open", "waiting"]), draw.choice(["new", "open", "waiting", "closed"])))
    rows += [(1000 + i, rows[50][1], 1, "error", "new", "open") for i in range(3)]  # ties
    return spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, expected string, wanted string").withColumn("ts", F.timestamp_seconds("s")).drop("s").repartition(3)


def folds():
    return [(G.RateLimit(3, 600), None), (G.Lockout(2, 500), None), (G.Statuses(FOLLOWING, to="wanted", gates={"waiting": "review"}), 30)]


def by_hand(fold, events):
    """A third way: plain loops over all rows."""
    out, state = {}, {}
    for r in sorted(events.collect(), key=lambda r: (r.ts, r.event_id)):
        at = int(r.ts.timestamp() * G.SECOND)
        values = [r[c] for c in fold.columns]
        if r.user_id is None:
            out[r.event_id] = fold.step(fold.begin(), at, *values)[1]
            continue
        state[r.user_id], out[r.event_id] = fold.step(state.get(r.user_id, fold.begin()), at, *values)
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("number", range(3))
def test_stream_equals_table_and_loops(spark, events, number):
    fold, ttl = folds()[number]
    rows = lambda df: {r.event_id: tuple(r)[2:] for r in df.collect()}
    folder = Q.new_folder(G.stateful(spark), "t")
    out = G.guard(Q.replay(events, "ts", 3, f"{folder}/in"), fold, "user_id", ttl_days=ttl)
    Q.run(out, f"{folder}/out", side=F.col("outcome") != "allowed", data_only=ttl is not None)
    schema = f"key long, event_id long, {fold.result}"
    main, side = (Q.committed(spark, f"{folder}/out", schema, at) for at in (False, True))
    assert main.where("outcome <> 'allowed'").count() == side.where("outcome = 'allowed'").count() == 0
    got, want = rows(main.union(side)), by_hand(fold, events)
    assert not {k: (got.get(k), v) for k, v in want.items() if got.get(k) != v}
    assert got == want and main.count() + side.count() == len(want) and len({v[0] for v in want.values()}) > 1
    assert rows(G.folded(events, fold, "user_id")) == want
    assert spark.read.parquet(f"{folder}/out/done").count() >= 3


def test_rate_limit_waits_and_rejected_do_not_count():
    fold, s = G.RateLimit(2, 10), None
    s, results = fold.begin(), []
    for t in (0, 1, 9, 10, 10.5, 11):
        s, r = fold.step(s, int(t * G.SECOND))
        results.append(r)
    assert results == [("allowed", None), ("allowed", None), ("rejected", 1), ("allowed", None), ("rejected", 1), ("allowed", None)]


def test_gate_waits_for_approval():
    fold = G.Statuses({"a": ("b",), "review": ("c",)}, gates={"b": "review"})
    s = fold.begin()
    s, first = fold.step(s, 1, None, "a")
    s, second = fold.step(s, 2, "a", "b")
    s, third = fold.step(s, 3, "b", "c")
    s, fourth = fold.step(s, 4, "review", "c")
    assert [first[0], second, third[0], fourth[0]] == ["applied", ("gated", "a", "review"), "stale", "applied"]


def test_late_rows_are_not_counted(spark):
    fold = G.RateLimit(1, 100)
    state, out = G._steps(fold, fold.begin(), iter([(1, 50 * G.SECOND), (2, 40 * G.SECOND), (3, 160 * G.SECOND)]))
    assert [r[1] for r in out] == ["allowed", "late", "allowed"]


def test_queue_goes_on_where_it_was_killed(spark):
    queue, seen = Q.Queue(spark, Q.new_folder(spark, "q"), "job_id long"), []
    for i in range(4):
        queue.submit(spark.range(10 * i, 10 * i + 10).select(F.col("id").alias("job_id")))

    def handle(jobs):
        return jobs.select("job_id", F.when(F.col("job_id") % 7 == 3, "failed").otherwise("done").alias("status"))

    def killed(number):
        seen.append(number)
        if number == 2:
            raise RuntimeError("killed")  # rows of this batch are written, the batch is not committed

    with pytest.raises(Exception, match="killed"):
        queue.work(handle, killed)
    assert queue.results("job_id long, status string").count() == 30
    queue.work(handle, seen.append)
    got = queue.results("job_id long, status string").collect()
    assert seen == [0, 1, 2, 2, 3]
    assert sorted(r.job_id for r in got) == list(range(40)) and all((r.status == "failed") == (r.job_id % 7 == 3) for r in got)
    assert all(r.batch_no == r.job_id // 10 for r in got)
    queue.submit(spark.range(100, 105).select(F.col("id").alias("job_id")))
    queue.work(handle)
    assert queue.results("job_id long, status string").count() == 45


def test_half_written_batches_are_not_read(spark):
    folder = Q.new_folder(spark, "half")
    Q.commit(folder)(spark.range(3), 0)
    spark.range(9).write.parquet(f"{folder}/main/batch=1")
    assert Q.committed(spark, folder, "id long").count() == 3
    Q.commit(folder)(spark.range(4), 1)
    Q.commit(folder)(spark.range(4), 1)
    assert Q.committed(spark, folder, "id long").count() == 7


def test_nothing_to_replay(spark, events):
    folder = Q.new_folder(G.stateful(spark), "none")
    out = G.guard(Q.replay(events.limit(0), "ts", 2, f"{folder}/in"), G.RateLimit(), "user_id")
    Q.run(out, f"{folder}/out")
    assert G.folded(events.limit(0), G.RateLimit(), "user_id").collect() == []

"""Operators that SQL cannot express, against small brute-force versions and known cases."""

import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Window, functions as F

from folium.operators import relations, sets
from folium.plans import chunking, layout
from folium.queries import QUERIES
from folium.sources import files
from folium.streaming import events as E

SF = "/root/testdata/sf0.001"


def test_paragraph_merge_depends_on_the_merged_one(spark):
    rows = [(["Use the (first", "part) of it", "and more", "New."],), (["Ends.", "next", "well-", "known"],), ([],)]
    got = [r[0] for r in spark.createDataFrame(rows, "p array<string>").select(chunking.merged_paragraphs(F.col("p"))).collect()]
    assert got == [["Use the (first part) of it and more", "New."], ["Ends.", "next well-known"], []]


def test_topics_split_where_terms_change(spark):
    same, other = "alpha beta gamma delta epsilon zeta " * 6, "one two three four five six seven " * 6
    rows = [(1, 0, same), (1, 1, same), (1, 2, other), (2, 0, "short text"), (2, 1, "other words")]
    got = chunking.semantic_parts(spark.createDataFrame(rows, "chunk_id long, seq int, text string")).orderBy("chunk_id", "seq").collect()
    assert [r["part"] for r in got] == [1, 1, 2, 1, 1]


BOXES = "page long, page_size int, kind string, box_id string, x0 int, y0 int, x1 int, y1 int"


def test_reading_order_and_icons(spark):
    rows = [(1, 600, "text", "title", 50, 20, 550, 50), (1, 600, "text", "left1", 50, 100, 280, 200), (1, 600, "text", "left2", 50, 205, 280, 400), (1, 600, "text", "right1", 320, 100, 550, 300), (1, 600, "text", "right2", 320, 305, 550, 400)]
    got = {r["box_id"]: r["place"] for r in layout.reading_order(spark.createDataFrame(rows[::-1], BOXES)).collect()}
    assert sorted(got, key=got.get) == ["title", "left1", "left2", "right1", "right2"]
    rows = [(2, 600, "icon", "i1", 10, 10, 30, 30), (2, 600, "text", "t1", 40, 8, 200, 32), (2, 600, "icon", "i2", 10, 28, 30, 48), (2, 600, "text", "t2", 40, 34, 200, 60)]
    assert {r["icon_id"]: r["text_id"] for r in layout.icon_texts(spark.createDataFrame(rows, BOXES)).collect()} == {"i1": "t1", "i2": "t2"}


def test_many_pages_in_few_calls(spark):
    draw = random.Random(2)
    rows = [(page, 600, draw.choice(["text", "text", "icon"]), f"b{draw.randrange(30):02d}", draw.randrange(0, 500, 50), draw.randrange(0, 500, 20), 0, 0) for page in [*range(70), None] for _ in range(draw.randint(1, 15))]
    rows = [(*r[:6], r[4] + draw.randrange(20, 200, 20), r[5] + draw.randrange(10, 50, 10)) for r in rows]
    pages = defaultdict(list)
    for r in rows:
        pages[r[0]].append((r[3], *r[4:]))
    boxes = spark.createDataFrame(rows, BOXES)
    calls = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    for frame in (layout.reading_order(boxes), layout.icon_texts(boxes)):
        assert "MapInArrow" in calls(frame) and "FlatMapGroups" not in calls(frame)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("1", "7", old):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = defaultdict(list)
        for r in sorted(layout.reading_order(boxes).collect(), key=lambda r: r["place"]):
            got[r["page"]].append(r["box_id"])
        assert got == {page: [b[0] for b in layout._order(sorted(b), 600.0)] for page, b in pages.items()}
        assert Counter(tuple(r) for r in layout.icon_texts(boxes).collect()) == icons_one_by_one(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_pages_stay_whole_when_their_parts_are_united(spark):
    parts = [spark.range(3000, numPartitions=2).selectExpr("id % 1000 AS page", f"'{kind}' AS kind", f"'{kind[0]}' || id AS box_id", f"{x} AS x0", "id AS y0", f"{x + 9} AS x1", "id + 10 AS y1").repartition(4, "page") for kind, x in (("icon", 0), ("text", 10))]
    parts = [p.withColumn("n", F.count("*").over(Window.partitionBy("page"))).where(f"page < {most}").drop("n") for p, most in zip(parts, (20, 1000))]
    got = layout.icon_texts(parts[0].unionByName(parts[1])).collect()
    assert len(got) == 60 and {(r["icon_id"][1:], r["text_id"]) for r in got} == {(str(i), f"t{i}") for i in range(3000) if i % 1000 < 20}


def icons_one_by_one(rows):
    out = Counter()
    for page in {r[0] for r in rows}:
        taken = set()
        for i in sorted((r for r in rows if r[0] == page and r[2] == "icon"), key=lambda r: r[3:]):
            share = lambda t: (min(i[7], t[7]) - max(i[5], t[5])) / min(i[7] - i[5], t[7] - t[5])  # noqa: B023, E731
            fit = [(-share(t), abs(t[4] - i[6]), t[3]) for t in rows if t[0] == page and t[2] == "text" and t[3] not in taken and share(t) >= 0.25 and t[6] > i[4]]
            best = min(fit)[2] if fit else None
            taken.add(best)
            out[page, i[3], best] += 1
    return out


def test_outermost_keeps_one_of_equal_boxes(spark):
    rows = [(1, "a", 0, 0, 350, 350), (1, "b", 0, 0, 350, 350), (1, "c", 120, 130, 140, 150), (1, "d", 340, 340, 360, 360), (2, "c", 120, 130, 140, 150), (None, "e", 0, 0, 1, 1)]
    got = layout_boxes(spark, rows)
    assert got == {(1, "a"), (1, "d"), (2, "c"), (None, "e")}


def layout_boxes(spark, rows):
    boxes = spark.createDataFrame(rows, "page long, box_id string, x0 int, y0 int, x1 int, y1 int")
    return {(r["page"], r["box_id"]) for r in relations.outermost(boxes).collect()}


def test_typeset_of_empty_and_null_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "\n \n"), (4, "a\n\nb")], "doc_id long, text string")
    assert [(r["page"], r["col"], r["y0"], r["y1"]) for r in layout.typeset(docs).orderBy("seq").collect()] == [("4-0", "title", 20, 32), ("4-0", "left", 82, 94)]


def test_box_clusters_follow_chains(spark):
    rows = [(1, f"b{i:02d}", 10 * i, 0, 10 * i + 8, 8) for i in range(20)] + [(1, "far", 500, 500, 510, 510), (2, "b00", 0, 0, 1, 1)]
    got = {(r["page"], r["box_id"]): r["cluster"] for r in layout.box_clusters(spark.createDataFrame(rows, "page long, box_id string, x0 int, y0 int, x1 int, y1 int")).collect()}
    assert {got[(1, f"b{i:02d}")] for i in range(20)} == {"b00"}
    assert got[(1, "far")] == "far" and got[(2, "b00")] == "b00"


def test_tables_continue_over_pages(spark):
    rows = [("a", 9, "t1", 0.5, 0.9, 2, 99, False), ("a", 11, "t2", 0.1, 0.8, 2, 3, False), ("a", 12, "t3", 0.05, 0.3, 2, 4, True), ("a", 13, "t4", 0.5, 0.9, 2, 1, True), ("b", 1, "t5", 0.6, 0.95, 3, 99, False), ("b", 2, "t6", 0.1, 0.2, 4, 1, True)]
    tables = spark.createDataFrame(rows, "doc_id string, page int, table_id string, top double, bottom double, n_cols int, deviation int, header_same boolean")
    got = {r["table_id"]: r["group_id"] for r in layout.stitched_tables(tables).collect()}
    assert got == {"t1": "t1", "t2": "t1", "t3": "t1", "t4": "t4", "t5": "t5", "t6": "t6"}


def test_longest_matches(spark):
    rows = [("d1", "data sheet", 7, 17), ("d1", "safety data sheet", 0, 17), ("d1", "sheet metal", 12, 23), ("d1", "metal", 18, 23)]
    hits = spark.createDataFrame(rows, "doc string, term string, start_at int, end_at int")
    assert [tuple(r) for r in sets.longest_matches(hits, "doc").collect()] == [("d1", ["safety data sheet", "metal"])]


def by_user(spark):
    out = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").collect():
        out[r["user_id"]].append(r)
    return out


def test_rate_limit_ignores_rejected(spark):
    want = {}
    for rows in by_user(spark).values():
        kept = []
        for r in rows:
            kept = [t for t in kept if (r["ts"] - t).total_seconds() < 600 * 60]
            want[r["event_id"]] = len(kept) < 2
            if want[r["event_id"]]:
                kept.append(r["ts"])
    assert {r["event_id"]: r["allowed"] for r in QUERIES["r05_rate_limited"](spark, SF).collect()} == want
    assert False in want.values()


def test_lockout_states(spark):
    rows = [(1, i, f"2024-01-01 00:{i:02d}:00", k) for i, k in enumerate(["error", "view", "error", "error", "view", "view"])] + [(1, 9, "2024-01-01 01:00:00", "error")]
    e = spark.createDataFrame(rows, "user_id long, event_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r["event_id"]: r["state"] for r in E.lockouts(e, "user_id", limit=2, minutes=15).collect()}
    assert got == {0: "open", 1: "open", 2: "open", 3: "lock", 4: "locked", 5: "locked", 9: "open"}


@pytest.mark.parametrize("twin", ["progress", "windows", "machine"])
def test_streams_equal_their_batch_twins(spark, tmp_path, twin):
    path = str(tmp_path / "in")
    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.orderBy("ts").coalesce(1).write.parquet(path)
    stream = E.event_stream(spark, path)
    rows = lambda df: sorted(map(tuple, df.collect()))
    if twin == "progress":
        got = E.run_to_end(E.progress(stream, "user_id"), "p1", "complete", str(tmp_path / "c"))
        assert rows(got) == rows(E.progress(batch, "user_id"))
    elif twin == "windows":
        shown = lambda df: df.select("window.start", "event_type", "n")
        got = E.run_to_end(shown(E.windowed_counts(stream)), "p2", "append", str(tmp_path / "c"))
        want = set(rows(shown(E.windowed_counts(batch))))
        assert got.count() > 0 and set(rows(got)) <= want
    else:
        got = E.run_to_end(E.stream_invalid_transitions(stream, "user_id"), "p3", "append", str(tmp_path / "c"))
        assert rows(got) == rows(E.invalid_transitions(batch, "user_id"))


def test_glossary_and_problems(spark, tmp_path):
    for sep, name in ((",", "a"), (";", "b"), ("\t", "c")):
        lines = [("Source", "Translation", "DNT"), ("valve", "Ventil", ""), ("Valve", "Klappe", ""), ("ACME", "", "yes"), ("pump", "", ""), ("", "x", "")]
        (tmp_path / f"{name}.csv").write_text("\n".join(sep.join(x) for x in lines), encoding="utf-8-sig")
        entries, problems = files.glossary(spark, str(tmp_path / f"{name}.csv"), sep)
        assert {(r["source_term"].lower(), r["do_not_translate"]) for r in entries.collect()} == {("valve", False), ("acme", True)}
        assert sorted(r["problem"] for r in problems.collect()) == ["no target", "no term", "repeated"]


def test_artifacts_are_checked_and_never_overwritten(spark, tmp_path):
    import hashlib

    (tmp_path / "f").mkdir()
    for name, text in (("one", "1"), ("two", "2"), ("three", "3")):
        (tmp_path / "f" / name).write_text(text)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    index = spark.createDataFrame([("one", sha("1")), ("two", sha("x")), ("gone", sha("g"))], "name string, sha256 string")
    assert {r["name"]: r["state"] for r in files.artifacts(spark, str(tmp_path / "f"), index).collect()} == {"one": "ok", "two": "changed", "three": "unknown", "gone": "lost"}
    files.write_version(index, str(tmp_path / "v"), "plan", "s1", 1)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        files.write_version(index, str(tmp_path / "v"), "plan", "s1", 1)
    files.trace_csv(spark.createDataFrame([(1, ["a", "b"])], "id int, ids array<string>"), str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), header=True).first()["ids"] == "a b"


def test_entry_lists_every_query():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(QUERIES) <= set(names)
    assert set(entry.oracle_sql()) <= set(names)
    assert all(os.path.exists(f"{SF}/{t}.parquet") for t in ("documents", "events"))

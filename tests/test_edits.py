"""Find and replace against plain loops over each text."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from folium.operators import edits as E

IDS = ["doc", "part"]
WORDS = ["the", "The", "theme", "bathe", "valve", "main", "valve", "10,5%", "see", "the-x", "a@the.org", "https://the.example/the", "{{ref:the}}", "é", "thé", "漢", "🙂the", "the.", "2the", "the2", "\n", "  "]


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(7)
    out = [(d, p, " ".join(draw.choice(WORDS) for _ in range(draw.randint(0, 40))), draw.randint(1, 5), "x") for d in range(12) for p in range(6)]
    return [*out, (99, 0, None, 1, None), (None, 0, "the null the", 2, None), (100, None, "the", 3, "y")]


@pytest.fixture(scope="module")
def segments(spark, rows):
    return spark.createDataFrame(rows, "doc long, part int, text string, version int, extra string").repartition(3)


def found(text, find, whole, case):
    """(start, stop) outside protected spans, in each gap by itself."""
    body = r"\s+".join(regex.escape(w) for w in find.split())
    body = rf"(?<![\p{{L}}\p{{N}}]){body}(?![\p{{L}}\p{{N}}])" if whole else body
    pattern, out, at = regex.compile(body, 0 if case else regex.IGNORECASE), [], 0
    spans = [m.span() for m in regex.finditer(E.PROTECTED, text)] + [(len(text), len(text))]
    for a, b in spans:
        out += [(at + m.start(), at + m.end()) for m in pattern.finditer(text[at:a])]
        at = b
    return out


@pytest.mark.parametrize("find,whole,case", [("the", True, False), ("the", False, False), ("The", True, True), ("valve main", True, False), ("valve  valve", False, False), (".", False, False), ("the-x", True, False)])
def test_matches_and_replace(spark, rows, segments, find, whole, case):
    want = {(d, p, i): (*span, t[span[0] : span[1]]) for d, p, t, *_ in rows for i, span in enumerate(found(t or "", find, whole, case))}
    got = {(r.doc, r.part, r.occurrence): (r.start, r.stop, r.value) for r in E.matches(segments, find, IDS, whole_word=whole, case_sensitive=case).collect()}
    assert got == want and (want or find != "the")
    preview = segments.select(*IDS, (F.col("version") + F.col("part").eqNullSafe(3).cast("int")).alias("version")).where("part IS NULL OR part < 5")
    chosen = spark.createDataFrame([k for k in want if sum(map(ord, str(k))) % 3], "doc long, part int, occurrence int") if want else None
    for pick in (None, chosen) if want else (None,):
        kept = set(want) if pick is None else {tuple(r) for r in pick.collect()}
        out = {(r.doc, r.part): r for r in E.replaced(segments, find, "new", preview, IDS, chosen=pick, whole_word=whole, case_sensitive=case).collect()}
        assert len(out) == len(rows)
        for d, p, t, version, extra in rows:
            r, text, n = out[d, p], t or "", 0
            spans = found(text, find, whole, case)
            for i in reversed(range(len(spans))):
                if (d, p, i) in kept:
                    text, n = text[: spans[i][0]] + "new" + text[spans[i][1] :], n + 1
            same = regex.findall(E.PROTECTED, text) == regex.findall(E.PROTECTED, t or "")
            state = "stale" if p in (3, 5) else "unchanged" if n == 0 else "replaced" if same else "skipped"
            assert (r.text, r.version, r.n_replaced, r.state, r.extra) == ((text, version + 1, n, state, extra) if state == "replaced" else (t, version, 0, state, extra))


def test_replacement_that_brings_a_number_is_skipped(spark):
    segments = spark.createDataFrame([(1, "the 5 and the", 1), (2, "none", 1)], "id long, text string, version int")
    got = {r.id: (r.text, r.state) for r in E.replaced(segments, "the", "7", segments.select("id", "version"), ["id"]).collect()}
    assert got == {1: ("the 5 and the", "skipped"), 2: ("none", "unchanged")}
    with pytest.raises(ValueError):
        E.phrase("  ")


def test_longer_words(rows, segments):
    want = {}
    for *_, text, _, _ in rows:
        for gap in regex.split(E.PROTECTED, text or ""):
            for w in regex.findall(r"[\p{L}\p{N}]*the[\p{L}\p{N}]*", gap, regex.IGNORECASE):
                if w.lower() != "the":
                    want[w] = want.get(w, 0) + 1
    assert {r.word: r.n for r in E.longer_words(segments, "the").collect()} == want and "theme" in want


def test_spans(rows, segments):
    kinds = {"url": E.URL, "email": E.EMAIL, "number": E.NUMBER}
    want = set()
    for d, p, t, *_ in rows:
        for m in regex.finditer("|".join(f"(?P<{k}>{x})" for k, x in kinds.items()), t or ""):
            want.add((d, p, m.lastgroup, *m.span(), m.group()))
    assert {tuple(r) for r in E.spans(segments, kinds, IDS).collect()} == want and {w[2] for w in want} == set(kinds)


def test_no_rows(segments):
    none = segments.limit(0)
    assert E.matches(none, "a", IDS).collect() == E.replaced(none, "a", "b", none.select(*IDS, "version"), IDS).collect() == E.spans(none, {"n": E.NUMBER}, IDS).collect() == []

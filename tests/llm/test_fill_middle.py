"""Fill-in-middle against a version of a few lines a text."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from folium.llm import fill_middle as fim

UNITS = {"line": r"[^\n]*\n|[^\n]+", "character": r"(?s).", "word": r"(?s)[ \t\x0b-\r\n]*[^ \t\x0b-\r\n]*(?:[ \t\x0b-\r\n]+(?![^ \t\x0b-\r\n]))?"}
MORE = ["a\n", "\n", "\n\n\n", "é\nß\n\n漢\n🙂", "no break", "a\nb\nc\nd\ne\n", "has <P> in it\nx", "<M>", "ends<\nS>\n", "< P>\n<\n<S\n>\n", "l\n" * 4000, "\r\nx\r\n", "\n퟿\n \U0010ffff\n"]


def brute(doc_id, text, unit, fim_percent, spm_percent):
    text = text or ""
    lines = [u for u in re.findall(UNITS[unit], text) if u]
    if unit == "word":
        lines = re.findall(r"(?s)^[ \t\x0b-\r\n]+|[^ \t\x0b-\r\n]+[ \t\x0b-\r\n]*", text)
    assert "".join(lines) == text
    n, digest = len(lines), hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(s in text for s in fim.SENTINELS) or h3 % 100 >= fim_percent:
        return (doc_id, n, "plain", None, None, text)
    x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:x]), "".join(lines[x:y]), "".join(lines[y:])
    form = "spm" if h4 % 100 < spm_percent else "psm"
    return (doc_id, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("unit,fim_percent,spm_percent", [("line", 100, 50), ("character", 70, 50), ("word", 100, 0), ("line", 0, 50)])
def test_equals_brute_force(spark, rows, unit, fim_percent, spm_percent):
    texts = [(r[0], r[1]) for r in rows] + [(i * 100 + j, t) for i, t in enumerate(MORE) for j in range(8)] + [(None, "a\nb\n"), (77, None)]
    texts += [(i, (t or "").replace(" ", "\n")) for i, t in texts[:60]]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id long, text string, form string").repartition(3)
    got = fim.fill_in_middle(docs, unit, fim_percent=fim_percent, spm_percent=spm_percent, keep=("form",))
    back = got.withColumn("restored", fim.restored(F.col("output"), F.col("form"))).collect()
    order = lambda x: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in x)
    want = [brute(i, t, unit, fim_percent, spm_percent) for i, t in texts]
    assert sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in back], key=order) == sorted(want, key=order)
    assert sorted([(r.doc_id, r.restored) for r in back], key=order) == sorted([(i, t or "") for i, t in texts], key=order)


def test_keeps_columns_and_other_sentinels(spark):
    docs = spark.createDataFrame([("x", "one\ntwo\nthree\n", 5), (None, "", 6)], "name string, body string, extra int")
    got = fim.fill_in_middle(docs, keep=("extra",), id_col="name", text_col="body", sentinels=("[pre]", "[suf]", "[mid]"))
    assert got.columns == ["name", "extra", "n", "form", "prefix_chars", "middle_chars", "output"]
    back = {r.extra: r for r in got.withColumn("t", fim.restored(F.col("output"), F.col("form"), ("[pre]", "[suf]", "[mid]"))).collect()}
    assert back[5].t == "one\ntwo\nthree\n" and back[5].output.startswith("[") and back[6].form == "plain"


def test_one_very_long_text_and_no_rows(spark, empty):
    long = "line of some words\n" * 300_000
    got = fim.fill_in_middle(spark.createDataFrame([(1, long)], "doc_id long, text string"))
    assert got.withColumn("same", fim.restored(F.col("output"), F.col("form")) == long).select("n", "same").collect() == [(300_000, True)]
    assert fim.fill_in_middle(empty).collect() == []

"""Queries of batched calls and of the repair loop, with functions that are fixed by content."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.operators import calls as C
from folium.registry import query, table


def _measure(block: list[tuple]) -> dict:
    """Stands for an outside model: it breaks on a text with an address, overlooks one text of a longer list, and answers what nobody asked."""
    if any("@" in t for _, t in block):
        raise ValueError("cannot read this block")
    seen = [x for i, x in enumerate(block) if len(block) < 9 or i != 4]
    return {k: len(t.replace("\n", " ").split(" ")) for k, t in seen} | {-1: 0}


@query("c21_called_in_blocks", r"SELECT doc_id, CASE WHEN contains(text, '@') THEN NULL ELSE len(string_split(replace(coalesce(text, ''), chr(10), ' '), ' ')) END AS answer, CASE WHEN contains(text, '@') THEN 'unanswered' ELSE 'answered' END AS state FROM documents")
def called_in_blocks(spark, sf_dir):
    """All documents sent in blocks to a function that fails on some and overlooks others; every other one is answered once."""
    return C.called(table(spark, sf_dir, "documents"), "doc_id", "text", _measure, "int", budget=20_000).select("doc_id", "answer", "state")


@query("r09_repair_loop", r"""
WITH w AS (SELECT conv_id, turn, text, string_split(coalesce(text, ''), ' ') AS w FROM conversations),
d AS (SELECT *, list_filter(w, lambda x: length(x) <= 8) AS d0, list_filter(w, lambda x: length(x) <= 12) AS d1, list_filter(w, lambda x: length(x) <= 16) AS d2 FROM w),
a AS (SELECT *, CASE WHEN 10 * len(d0) >= 9 * len(w) THEN 0 WHEN 10 * len(d1) >= 9 * len(w) THEN 1 WHEN 10 * len(d2) >= 9 * len(w) THEN 2 END AS k FROM d)
SELECT conv_id, turn, CASE k WHEN 0 THEN array_to_string(d0, ' ') WHEN 1 THEN array_to_string(d1, ' ') WHEN 2 THEN array_to_string(d2, ' ') ELSE text END AS draft, CASE WHEN k IS NULL THEN 'verbatim' ELSE 'accepted' END AS state, coalesce(k, 2) AS attempt FROM a""")
def repair_loop(spark, sf_dir):
    """Turns shortened by their long words; a draft that loses more than a tenth of the words is written again, twice at most, then the source stands."""
    words = lambda c: F.split(F.coalesce(c, F.lit("")), " ")
    rewrite = lambda source, _, attempt: F.array_join(F.filter(words(source), lambda x: F.length(x) <= 8 + 4 * attempt), " ")
    kept = lambda source, draft: F.when(draft == "", 0).otherwise(F.size(words(draft)))
    problem = lambda source, draft: F.when(10 * kept(source, draft) < 9 * F.size(words(source)), "words lost")
    return C.repaired(table(spark, sf_dir, "conversations"), "text", rewrite, problem).select("conv_id", "turn", "draft", "state", "attempt")

"""Queries of term mining."""

from __future__ import annotations

from folium.operators import terms as T
from folium.registry import query, table

STOP = ("the", "of", "and", "is", "a", "in", "to", "der", "die", "und", "le", "la", "de", "et", "el", "los", "y")
_BREAK, _TOKEN = T.BREAKS, T.TOKEN.replace(r"\p{L}", r"\pL").replace(r"\p{N}", r"\pN").replace("'", "''")


@query("c17_terms", rf"""
WITH t AS (SELECT row_number() OVER () AS id, text FROM (SELECT DISTINCT coalesce(text, '') AS text FROM conversations)),
c AS (SELECT id, row_number() OVER () AS chunk, regexp_extract_all(x, '{_TOKEN}') AS w FROM (SELECT id, unnest(regexp_split_to_array(text, '{_BREAK}')) AS x FROM t)),
g AS (SELECT id, n, array_to_string(w[i : i + n - 1], ' ') AS spelling, lower(array_to_string(w[i : i + n - 1], ' ')) AS term FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM c, (SELECT unnest([2, 3, 4]) AS n))
  WHERE len(list_filter(w[i : i + n - 1], lambda x: list_contains({list(STOP)}, lower(x)))) = 0),
f AS (SELECT term, n, count(DISTINCT id) AS n_texts FROM g GROUP BY ALL HAVING count(DISTINCT id) >= 3),
k AS (SELECT * FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.n > a.n AND contains(' ' || b.term || ' ', ' ' || a.term || ' ') AND b.n_texts >= 0.75 * a.n_texts)),
r AS (SELECT *, row_number() OVER (ORDER BY n_texts DESC, n DESC, term) AS rank FROM k QUALIFY rank <= 80)
SELECT rank, term, arg_max(spelling, (u, spelling)) AS spelling, any_value(r.n) AS n, any_value(n_texts) AS n_texts, max(u) AS n_uses FROM r JOIN (SELECT term, spelling, count(*) AS u FROM g GROUP BY ALL) USING (term) GROUP BY rank, term""")
def mined_terms(spark, sf_dir):
    """The 80 terms of conversations that most distinct turns have, without phrases that longer ones hold, as they are mostly written (C17)."""
    return T.find_terms(table(spark, sf_dir, "conversations"), stop=STOP)

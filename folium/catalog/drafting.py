"""Queries over template instructions, drafts, slot plans and translations; the driver tables hold none, so inline tables do."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.functions import signals as S
from folium.operators import drafts as D
from folium.registry import derived, inline, query, table, values


def named(relation: str, name: str) -> str:
    return relation.replace("inline_rows", name)


def sql_any(column: str, markers: tuple[str, ...]) -> str:
    quoted = (m.replace("'", "''") for m in markers)
    return "(" + " OR ".join(f"contains({column}, '{m}')" for m in quoted) + ")"


INSTRUCTIONS = inline("n, lead_in, txt", [
    (1, None, "Use Arial 10 throughout."), (2, "Do NOT:", "change header or footer"), (3, "Do NOT:", "add a new chapter"), (4, None, "Update the Table of Contents."), (5, None, "Delete all blue text."),
    (6, None, "Never copy an image."), (7, None, "Choose the icon that fits."), (8, None, "[Insert name of the site]"), (9, None, "Keep the numbering."), (10, None, "Owners must sign."), (11, None, "Write plainly."),
    (12, "Do NOT:", "fill in <<site>>"), (13, None, "Skip the initial page."), (14, None, "Add a chapter."),
])


@query("p19_directives", f"""
WITH t AS (SELECT n, txt, lower(concat_ws(' ', lead_in, txt)) AS low FROM {INSTRUCTIONS}),
r AS (SELECT * FROM (VALUES (1, ['arial'], 'font_family', 'formatting'), (2, ['header', 'footer'], 'preserve_headers_footers', 'prohibition'), (3, ['add', 'chapter', 'do not'], 'allow_new_h1', 'prohibition'),
 (4, ['table of content'], 'toc_auto_generated', 'prohibition'), (5, ['toc'], 'toc_auto_generated', 'prohibition'), (6, ['blue text', 'delete'], 'strip_blue_text', 'requirement'),
 (7, ['initial page'], 'skip_cover_page', 'prohibition'), (8, ['cover page'], 'skip_cover_page', 'prohibition')) v(nth, words, rule, directive)),
hit AS (SELECT n, arg_min(rule, nth) AS rule, arg_min(directive, nth) AS directive FROM t, r WHERE len(list_filter(words, lambda w: NOT contains(low, w))) = 0 GROUP BY n)
SELECT t.n, rule, coalesce(directive, CASE WHEN {sql_any('low', S.PROHIBITION)} THEN 'prohibition' WHEN {sql_any('low', S.ICONS)} THEN 'icon_usage' WHEN regexp_matches(txt, '{S.PLACEHOLDER}') THEN 'placeholder_hint'
 WHEN {sql_any('low', S.FORMATTING)} THEN 'formatting' WHEN {sql_any('low', S.REQUIREMENT)} THEN 'requirement' ELSE 'guidance' END) AS directive FROM t LEFT JOIN hit ON hit.n = t.n""")
def directives(spark, sf_dir):
    """Directive and machine rule of instructions: ordered keyword rules first, then markers."""
    found = S.directive(F.col("txt"), F.col("lead_in")).alias("d")
    return values(spark, INSTRUCTIONS).select("n", found).select("n", "d.rule", "d.directive")


CONTRACT = inline("section, title, nth, kind, txt, icon, callout", [
    ("a", "Purpose", 1, "instruction", "Fill in <<site>>; do not add subsections.", "target", None), ("a", "Purpose", 2, "skeleton", "", "book", "note"), ("a", "Purpose", 3, "skeleton", " ", "target", "warning"),
    ("b", "Annex (optional)", 1, "skeleton", "Fixed text of <<owner>> and <<owner>>.", None, "note"), ("c", "Training", 1, "instruction", "You may DELETE THIS SECTION.", None, None),
    ("d", "Roles", 1, "skeleton", "[Role 1] signs.", "person", "note"), ("d", "Roles", 2, "skeleton", None, "book", "note"),
])


@query("x12_section_contracts", rf"""
WITH c AS (SELECT * FROM {CONTRACT}), m AS (SELECT section, icon, callout, nth, unnest(regexp_extract_all(coalesce(txt, ''), '{S.PLACEHOLDER}')) AS ph FROM c)
SELECT section, coalesce((SELECT string_agg(DISTINCT ph, ',' ORDER BY ph) FROM m WHERE m.section = c.section), '') AS placeholders,
 coalesce((SELECT string_agg(icon, ',' ORDER BY pos) FROM (SELECT icon, min(nth) AS pos FROM c x WHERE x.section = c.section AND icon IS NOT NULL GROUP BY icon)), '') AS icons,
 coalesce((SELECT string_agg(callout, ',' ORDER BY pos) FROM (SELECT callout, min(nth) AS pos FROM c x WHERE x.section = c.section AND callout IS NOT NULL GROUP BY callout)), '') AS callouts,
 NOT bool_or(kind = 'skeleton' AND trim(coalesce(txt, '')) <> '') AS editable,
 NOT (bool_or(regexp_matches(lower(title), '\((optional|if applicable)\)')) OR bool_or(kind = 'instruction' AND {sql_any("lower(coalesce(txt, ''))", S.OPTIONAL)})) AS required,
 NOT bool_or(kind = 'instruction' AND {sql_any("lower(coalesce(txt, ''))", S.NO_SUBSECTIONS)}) AS subsections FROM c GROUP BY section""")
def section_contracts(spark, sf_dir):
    """What a template section asks for: placeholders, icons and callouts as first seen, whether editable, required, divisible."""
    c = values(spark, CONTRACT).withColumn("txt", F.coalesce("txt", F.lit("")))
    low, told = F.lower("txt"), F.col("kind") == "instruction"
    seen = lambda name: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col(name).isNotNull(), F.struct("nth", F.col(name).alias("v"))))), lambda s: s["v"]))
    marks = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.regexp_extract_all("txt", F.lit(S.PLACEHOLDER), F.lit(0))))))
    bare = F.lower("title").rlike(r"\((optional|if applicable)\)")
    return c.groupBy("section").agg(
        F.array_join(marks, ",").alias("placeholders"), F.array_join(seen("icon"), ",").alias("icons"), F.array_join(seen("callout"), ",").alias("callouts"),
        (~F.bool_or(~told & (F.trim("txt") != ""))).alias("editable"), (~F.bool_or(bare | (told & S.holds_any(low, S.OPTIONAL)))).alias("required"),
        (~F.bool_or(told & S.holds_any(low, S.NO_SUBSECTIONS))).alias("subsections"),
    )


REGIONS = inline("n, lead_in, region", [
    (1, "This SOP is applicable:", "This Directive/SOP/Work Instruction/Guidance is applicable:"), (2, "This Guidance is applicable:", "This Directive/SOP/Work Instruction/Guidance is applicable:"),
    (3, "This SOP applies:", "This Directive/SOP/Work Instruction/Guidance is applicable:"), (4, "This is applicable:", "This Directive/SOP is applicable:"), (5, "This SOP is applicable", "This Directive/SOP is applicable:"),
])


@query("f21_inline_choices", r"""
SELECT n, CASE WHEN ok THEN coalesce(list_filter(list_transform(string_split(regexp_extract(region, '[\w ]+(?:/[\w ]+)+'), '/'), lambda o: list_last(string_split(trim(o), ' '))), lambda o: list_contains(w, lower(o)))[1], '') END AS option
FROM (SELECT *, regexp_extract_all(lower(lead_in), '[a-z]+') AS w, ends_with(lead_in, ':') AND length(lead_in) <= 80
 AND list_has_all(regexp_extract_all(lower(region), '[a-z]+'), regexp_extract_all(lower(lead_in), '[a-z]+')) AS ok FROM """ + REGIONS + ")")
def inline_choices(spark, sf_dir):
    """The option that a lead-in uses of a region's slash list."""
    return values(spark, REGIONS).select("n", S.answered_option(F.col("lead_in"), F.col("region")).alias("option"))


@query("f20_cue_hits", r"""
SELECT d.doc_id, b.item_id, len(list_distinct(regexp_extract_all(lower(d.text), b.cue))) * b.activation AS score FROM documents d,
 (SELECT * FROM (VALUES (1, '\b(?:this|it) (?:describes|covers|explains)\b', 2), (2, '\b(?:who|team|owner|user)s?\b', 2), (3, '\b(?:must|shall|never|only)\b', 1)) v(item_id, cue, activation)) b
WHERE len(list_distinct(regexp_extract_all(lower(d.text), b.cue))) > 0""")
def cue_hits(spark, sf_dir):
    """Distinct cue words of three slot concepts in each document, weighed by the slot's activation."""
    concepts = ((1, r"\b(?:this|it) (?:describes|covers|explains)\b", 2), (2, r"\b(?:who|team|owner|user)s?\b", 2), (3, r"\b(?:must|shall|never|only)\b", 1))
    scored = [F.struct(F.lit(n).alias("item_id"), (S.cue_hits(F.col("text"), F.lit(cue)) * weight).alias("score")) for n, cue, weight in concepts]
    rows = table(spark, sf_dir, "documents").select("doc_id", F.inline(F.array(*scored)))
    return rows.where("score > 0").select("doc_id", "item_id", F.col("score").cast("long").alias("score"))


TRANSLATED = inline("n, txt, term, east", [
    (1, "Die Qualitätssicherung prüft den Prozess.", "Prozess", False), (2, "des Prozesses", "Prozess", False), (3, "die Prozessoren und Geräte", "Prozess", False), (4, "drei Gerate stehen", "Gerät", False),
    (5, "Die Anlagen laufen", "Anlage", False), (6, "das rote  Bücher-Regal", "rotes Buch", False), (7, "rote Büchern", "rote Bücher", False), (8, "リスク 評価を行う", "リスク評価", True), (9, "Typ A1 gilt", "A1", False),
    (10, "Typ A12 gilt", "A1", False), (11, "Das Ohr", "Ohr", False), (12, "Ohren", "Ohr", False), (13, "ein Rohr", "Ohr", False),
])


@query("f24_term_presence", r"""
WITH t AS (SELECT n, east, lower(replace(txt, ' ', '')) AS squashed, lower(replace(term, ' ', '')) AS short, strip_accents(lower(txt)) AS x, string_split(strip_accents(lower(term)), ' ') AS w FROM """ + TRANSLATED + r"""),
p AS (SELECT *, list_last(w) AS l, array_to_string(w[1:-2], '\s+') AS lead FROM t)
SELECT n, CASE WHEN east THEN contains(squashed, short) ELSE regexp_matches(x, '(^|\W)' || CASE WHEN lead = '' THEN '' ELSE lead || '\s+' END
 || CASE WHEN NOT regexp_matches(l, '[a-z]$') THEN l WHEN length(l) <= 4 THEN l || '\w{0,2}' WHEN length(l) >= 7 THEN left(l, length(l) - 2) || '\w{0,4}' ELSE left(l, length(l) - 1) || '\w{0,4}' END || '(\W|$)') END AS present FROM p""")
def term_presence(spark, sf_dir):
    """Whether a translation uses the agreed term, endings, case and accents aside; East Asian scripts without spaces."""
    return values(spark, TRANSLATED).select("n", S.term_present(F.col("txt"), F.col("term"), F.col("east")).alias("present"))


ASSETS = "(SELECT page_id AS n, 'd' || page_id AS document_id, '{\"image_path\": \"' || url || '\", \"list\": [{\"path\":\"pic\", \"name\": \"a/b\"}, {\"icon_path\" : \"/x/' || page_id || '.png\"}]}' AS body FROM pages) AS inline_rows"


@query("p16_served_paths", r"""
SELECT n, regexp_replace(body, '"(image_path|icon_path|path)"(\s*:\s*)"([^"]*/)?([^"/]+)"', '"\1"\2"/documents/' || document_id || '/assets/\4"', 'g') AS body FROM """ + ASSETS)
def served_paths(spark, sf_dir):
    """Asset paths in JSON at any depth become URLs of their document."""
    return derived(spark, sf_dir, ASSETS).select("n", S.served_paths(F.col("body"), F.col("document_id")).alias("body"))


SLOTS = inline("slot_id, status", [("s1", "mapped"), ("s2", "mapped"), ("s3", "not_found"), ("s4", "not_found"), ("s5", "mapped")])
PLANNED = inline("slot_id, unit_id", [("s1", "u1"), ("s1", "u2"), ("s2", "u3"), ("s2", "u4"), ("s5", "u5")])
CLAIMS = inline("claim_id, slot_id, kind, text", [
    ("c1", "s1", "prose", "See {{ref:u9}}."), ("c2", "s1", "prose", "Sign it."), ("c3", "s2", "prose", "As in {{ref:x1}} and {{ref:u7}}."), ("c4", "s2", "gap", "To be written."), ("c5", "s3", "gap", "To be written."),
])
CITED = inline("claim_id, unit_id", [("c1", "u1"), ("c2", "u2"), ("c3", "u3"), ("c3", "u1")])
UNITS = inline("unit_id, text", [("u1", "See {{ref:u9}}."), ("u2", "Sign it, see {{ref:u4}}."), ("u3", "As in {{ref:u7}}."), ("u4", "More."), ("u5", "Last.")])


@query("c08_draft_issues", rf"""
WITH s AS (SELECT * FROM {SLOTS}), p AS (SELECT * FROM {PLANNED}), c AS (SELECT * FROM {CLAIMS}), i AS (SELECT * FROM {CITED}), u AS (SELECT * FROM {UNITS}),
l AS (SELECT i.claim_id, unit_id, slot_id FROM i JOIN c ON c.claim_id = i.claim_id AND kind = 'prose'), h AS (SELECT unit_id, unnest(regexp_extract_all(text, '{{{{ref:[^}}]+}}}}')) AS t FROM u),
k AS (SELECT claim_id, slot_id, unnest(regexp_extract_all(text, '{{{{ref:[^}}]+}}}}')) AS t FROM c WHERE kind = 'prose')
SELECT 'gap' AS code, c.slot_id, claim_id AS item FROM c JOIN s ON s.slot_id = c.slot_id WHERE kind = 'gap' AND status <> 'not_found'
UNION SELECT 'stray', slot_id, claim_id FROM l WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.slot_id = l.slot_id AND p.unit_id = l.unit_id)
UNION SELECT 'foreign', slot_id, claim_id FROM k WHERE NOT EXISTS (SELECT 1 FROM i JOIN h ON h.unit_id = i.unit_id WHERE i.claim_id = k.claim_id AND h.t = k.t)
UNION SELECT 'uncited', slot_id, unit_id FROM p WHERE slot_id IN (SELECT slot_id FROM c) AND NOT EXISTS (SELECT 1 FROM l WHERE l.slot_id = p.slot_id AND l.unit_id = p.unit_id)
UNION SELECT 'lost', p.slot_id, p.unit_id FROM p JOIN h ON h.unit_id = p.unit_id WHERE EXISTS (SELECT 1 FROM l WHERE l.slot_id = p.slot_id AND l.unit_id = p.unit_id)
 AND NOT EXISTS (SELECT 1 FROM l JOIN k ON k.claim_id = l.claim_id WHERE l.slot_id = p.slot_id AND l.unit_id = p.unit_id AND k.t = h.t)
UNION SELECT 'nogap', slot_id, slot_id FROM s WHERE status = 'not_found' AND slot_id NOT IN (SELECT slot_id FROM c)
UNION SELECT 'nodraft', slot_id, slot_id FROM s WHERE status <> 'not_found' AND slot_id NOT IN (SELECT slot_id FROM c) AND slot_id IN (SELECT slot_id FROM p)""")
def draft_issues(spark, sf_dir):
    """Drafts against the slot plan: gaps, stray and missing citations, foreign and lost tokens, slots without draft."""
    return D.draft_issues(*(values(spark, x) for x in (SLOTS, PLANNED, CLAIMS, CITED, UNITS)))


PLAN = inline("section, slot_id, one_of, display_order, required, callout, section_required", [
    ("t1", "a", None, 1, True, False, True), ("t1", "b", "g", 2, True, False, True), ("t1", "c", "g", 3, True, False, True), ("t1", "d", "h", 4, True, False, True), ("t1", "e", "h", 5, True, False, True),
    ("t1", "f", None, 6, False, False, True), ("t1", "k", None, 7, True, True, True), ("t2", "x", None, 1, True, False, False), ("t3", "y", None, 1, True, False, True), ("t1", "m", None, 8, True, False, True),
])
PLACED = inline("slot_id, unit_id, seq, doubt", [("a", "u3", 3, False), ("a", "u1", 1, False), ("e", "u3", 3, True), ("m", "u4", 4, False)])


@query("x02_slot_plan", f"""
WITH s AS (SELECT *, EXISTS (SELECT 1 FROM {named(PLACED, 'p')} WHERE p.slot_id = r.slot_id) AS filled FROM {named(PLAN, 'r')}), p AS (SELECT * FROM {PLACED}), many AS (SELECT unit_id FROM p GROUP BY unit_id HAVING count(DISTINCT slot_id) > 1)
SELECT section, slot_id, coalesce((SELECT string_agg(unit_id, ' ' ORDER BY seq) FROM p WHERE p.slot_id = s.slot_id), '') AS unit_ids, EXISTS (SELECT 1 FROM p JOIN many ON many.unit_id = p.unit_id WHERE p.slot_id = s.slot_id) AS shared,
 CASE WHEN filled THEN CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.slot_id = s.slot_id AND doubt) THEN 'needs_review' ELSE 'mapped' END
 WHEN callout OR (NOT section_required AND NOT EXISTS (SELECT 1 FROM s o WHERE o.section = s.section AND o.filled)) THEN 'not_applicable'
 WHEN one_of IS NOT NULL THEN CASE WHEN EXISTS (SELECT 1 FROM s o WHERE o.section = s.section AND o.one_of = s.one_of AND (o.filled OR o.display_order < s.display_order)) THEN 'not_applicable' ELSE 'not_found' END
 WHEN required THEN 'not_found' ELSE 'not_applicable' END AS status FROM s""")
def slot_plan(spark, sf_dir):
    """Slots with their units in order, units of several slots marked, and the status of empty ones, one-of groups told once."""
    return D.slot_statuses(values(spark, PLAN), values(spark, PLACED))


GRID = "(SELECT conv_id AS table_id, CAST(turn AS INT) AS row_index, 0 AS col, CASE WHEN (length(text) + 0) % 3 = 0 THEN '' || length(text) ELSE ' ' END AS text FROM conversations UNION ALL SELECT conv_id AS table_id, CAST(turn AS INT) AS row_index, 1 AS col, CASE WHEN (length(text) + 1) % 4 = 0 THEN '' || length(text) ELSE ' ' END AS text FROM conversations UNION ALL SELECT conv_id AS table_id, CAST(turn AS INT) AS row_index, 2 AS col, CASE WHEN (length(text) + 2) % 5 = 0 THEN '' || length(text) ELSE ' ' END AS text FROM conversations UNION ALL SELECT conv_id AS table_id, CAST(turn AS INT) AS row_index, 3 AS col, CASE WHEN (length(text) + 3) % 6 = 0 THEN '' || length(text) ELSE ' ' END AS text FROM conversations UNION ALL SELECT conv_id AS table_id, CAST(turn AS INT) AS row_index, 4 AS col, CASE WHEN (length(text) + 4) % 7 = 0 THEN '' || length(text) ELSE ' ' END AS text FROM conversations UNION ALL SELECT conv_id AS table_id, CAST(turn AS INT) AS row_index, 5 AS col, CASE WHEN (length(text) + 5) % 3 = 0 THEN '' || length(text) ELSE ' ' END AS text FROM conversations) AS inline_rows"


@query("a17_grid_columns", f"""
WITH RECURSIVE o AS (SELECT table_id, col, list(row_index) AS r, row_number() OVER (PARTITION BY table_id ORDER BY col) AS nth FROM {GRID} WHERE trim(text) <> '' GROUP BY table_id, col),
f AS (SELECT table_id, col, r, nth, 1 AS grp FROM o WHERE nth = 1 UNION ALL
 SELECT o.table_id, o.col, CASE WHEN list_has_any(f.r, o.r) THEN o.r ELSE list_concat(f.r, o.r) END, o.nth, f.grp + CASE WHEN list_has_any(f.r, o.r) THEN 1 ELSE 0 END FROM f JOIN o ON o.table_id = f.table_id AND o.nth = f.nth + 1)
SELECT table_id, col, grp FROM f""")
def grid_columns(spark, sf_dir):
    """Columns of a sparse grid in groups that never hold text in the same row."""
    return D.occupied_groups(derived(spark, sf_dir, GRID))


ENTRIES = "(SELECT conv_id AS block, CASE length(text) % 3 WHEN 0 THEN 'term' WHEN 1 THEN 'role' ELSE 'ref' END AS kind, turn AS nth, length(text) % 60 AS chars FROM conversations) AS inline_rows"


@query("x08_bounded_memory", f"""
SELECT * FROM (SELECT *, sum(chars) OVER (PARTITION BY block ORDER BY CASE kind WHEN 'ref' THEN 0 WHEN 'role' THEN 1 ELSE 2 END, nth) AS used FROM {ENTRIES}) WHERE used <= 100""")
def bounded_memory(spark, sf_dir):
    """What a block remembers within a budget: terms go first, then roles, then references."""
    return D.bounded_memory(derived(spark, sf_dir, ENTRIES), 100)


JOBS = "(SELECT event_id AS job_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' WHEN 'view' THEN 'drafting' WHEN 'signup' THEN 'pending' ELSE 'planning_slots' END AS status, value > 120 AS running, event_id AS created FROM events) AS inline_rows"


@query("r04_resumed_jobs", f"SELECT job_id, status AS stage, 'resumed' AS event FROM {JOBS} WHERE NOT running AND status IN ('pending', 'planning_slots', 'drafting')")
def resumed_jobs(spark, sf_dir):
    """Jobs that a stopped process left in a stage of work, with the event that resumes them."""
    left = ~F.col("running") & F.col("status").isin("pending", "planning_slots", "drafting")
    return derived(spark, sf_dir, JOBS).where(left).select("job_id", F.col("status").alias("stage"), F.lit("resumed").alias("event"))


PASSAGES = inline("passage_id, text, slots", [("a", "Sign the form, then  file it.", "who what"), ("b", "Sign the form and file it.", "who what"), ("c", "File it; sign it.", "who what"), ("d", "Sign it.", "who what"), ("e", "Über alles gilt: ja.", "who"), ("f", "Left alone", "who")])
PIECES = inline("passage_id, nth, slot, piece", [
    ("a", 1, "who", "Sign the form,"), ("a", 2, "what", "then file it"), ("b", 1, "who", "Sign the form"), ("b", 2, "what", "file it."), ("c", 1, "who", "sign it."), ("c", 2, "what", "File it;"), ("d", 1, "who", "Sign it."),
    ("e", 1, "who", "Über alles gilt"), ("e", 2, "who", "ja."), ("e", 3, "who", " ; "),
])


@query("f28_clean_splits")
def clean_splits(spark, sf_dir):
    """Whether pieces split a passage word for word among its slots (F28); known cases in the tests."""
    return D.clean_split(values(spark, PASSAGES).withColumn("slots", F.split("slots", " ")), values(spark, PIECES))


ELEMENTS = inline("section, seq, icons", [("a", 1, "i1 i2 i3"), ("a", 2, "i4"), ("a", 3, ""), ("a", 4, ""), ("b", 1, "j1"), ("b", 2, "j2 j3 j4"), ("b", 3, ""), ("c", 1, ""), ("c", 2, "k1 k2")])


@query("w18_spread_icons")
def spread_icons(spark, sf_dir):
    """Further icons of an element go to the next elements without one (W18); known cases in the tests."""
    icons = F.filter(F.split("icons", " "), lambda x: x != "")
    spread = D.spread_icons(values(spark, ELEMENTS).withColumn("icons", icons))
    return spread.select("section", "seq", F.array_join("icons", " ").alias("icons"))

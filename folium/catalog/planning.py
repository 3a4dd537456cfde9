"""Queries over plans: scopes, scores, runs of units, rule sets, overrides, reference tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.operators import units as U
from folium.registry import derived, inline, query, table, values


def named(relation: str, name: str) -> str:
    return relation.replace("inline_rows", name)


PAGE_LINES = 10


@query("p06_page_elements", f"""
SELECT doc_id, count(*) AS on_page, min(seq) AS first_seq, sum(length(line)) AS chars
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents) WHERE seq // {PAGE_LINES} = 1 GROUP BY doc_id""")
def page_elements(spark, sf_dir):
    """The flattened elements of one page (P6): ten lines are a page, the second one is asked for."""
    flat = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    page = flat.where(F.floor(F.col("seq") / PAGE_LINES) == 1)
    return page.groupBy("doc_id").agg(F.count("*").alias("on_page"), F.min("seq").alias("first_seq"), F.sum(F.length("line")).alias("chars"))


SECTIONS = inline("section_id, number, heading, level", [
    ("s0", "0", "Cover", 1), ("s1", "1", "Purpose", 1), ("s2", "7.1", "Purpose", 2), ("s3", None, "Scope", 1), ("s4", "2", "Definitions &  Abbreviations", 1), ("s5", "3", "Writing style", 1),
    ("s6", None, "Table of  contents", 1), ("s7", "8", "REFERENCES", 1), ("s8", "9", "Revision History", 2), ("s9", "4", "Roles and responsibilities", 1), ("s10", "5", "Purpose of steps", 1),
])
# fixed values: headings of sections without rules, and of a guide's own first chapters
NO_RULES = [
    "table of content", "table of contents", "contents", "general information", "reference", "references", "associated document",
    "associated documents", "document history", "revision history", "document approval", "document approvals",
]
OWN_CHAPTERS = [
    "purpose", "objective", "objectives", "scope", "applicability", "definition", "definitions", "definition and abbreviations", "definitions and abbreviations",
    "abbreviation", "abbreviations", "implementation", "prerequisite", "prerequisites", "pre-requisite", "pre-requisites", "role", "roles",
    "role and responsibilities", "roles and responsibilities", "responsibilities",
]


@query("p10_rule_bearing", rf"""
SELECT section_id FROM (SELECT *, trim(regexp_replace(lower(replace(heading, '&', ' and ')), '\s+', ' ', 'g')) AS h FROM {SECTIONS})
WHERE number IS DISTINCT FROM '0' AND NOT list_contains({NO_RULES}, h) AND NOT (level = 1 AND number IS NOT NULL AND list_contains({OWN_CHAPTERS}, h))""")
def rule_bearing(spark, sf_dir):
    """Sections that may hold rules (P10): no cover, lists, history; none of the numbered first chapters about the guide itself."""
    heading = F.trim(F.regexp_replace(F.lower(F.replace("heading", F.lit("&"), F.lit(" and "))), r"\s+", " "))
    own = (F.col("level") == 1) & F.col("number").isNotNull() & heading.isin(OWN_CHAPTERS)
    return values(spark, SECTIONS).where(~F.col("number").eqNullSafe("0") & ~heading.isin(NO_RULES) & ~own).select("section_id")


SIGNALS = "(SELECT user_id AS section_id, event_type AS target, (count(*) % 97) / 97e0 AS name_score, (max(event_id) % 97) / 97e0 AS label_score, (min(event_id) % 89) / 89e0 AS cosine FROM events GROUP BY user_id, event_type) AS inline_rows"


@query("f19_combined_scores", f"""
SELECT section_id, target, content, round(w * name_score + (1 - w) * content, 3) AS combined FROM (
 SELECT s.section_id, target, name_score, round(0.75 * label_score + 0.25 * cosine, 3) AS content, w FROM {named(SIGNALS, 's')} JOIN
 (SELECT section_id, CASE WHEN max(name_score) >= 0.8 THEN 0.7 ELSE 0.35 END AS w FROM {SIGNALS} GROUP BY section_id) AS m ON m.section_id = s.section_id)""")
def combined_scores(spark, sf_dir):
    """Name and content scores of a section for each target (F19): the name leads where one name is strong, else the content."""
    s = derived(spark, sf_dir, SIGNALS).select("section_id", "target", *[F.col(c).cast("double").alias(c) for c in ("name_score", "label_score", "cosine")])
    best = s.groupBy("section_id").agg(F.when(F.max("name_score") >= 0.8, 0.7).otherwise(0.35).alias("w"))
    s = s.join(best, "section_id").withColumn("content", F.round(0.75 * F.col("label_score") + 0.25 * F.col("cosine"), 3))
    return s.select("section_id", "target", "content", F.round(F.col("w") * F.col("name_score") + (1 - F.col("w")) * F.col("content"), 3).alias("combined"))


PHRASES = "(SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey AS ref_id, 'See ' || CASE WHEN l_suppkey % 3 = 0 THEN '1' ELSE 'section ' END || l_linenumber || '.' || l_partkey || ', Step ' || l_suppkey || ' and ' || l_linenumber || '.' || l_partkey || '.1' AS phrase, CASE WHEN l_returnflag <> 'R' THEN l_linenumber || '.' || l_partkey END AS old_number, CASE WHEN l_returnflag <> 'R' THEN '9.' || l_suppkey END AS new_number, '' || l_suppkey AS old_item, CASE WHEN l_linestatus = 'O' THEN '' || (l_suppkey + 1) END AS new_item FROM lineitem) AS inline_rows"


@query("f27_shown_numbers", r"""
SELECT ref_id, coalesce(head || new_number, '') || CASE WHEN new_item IS NULL OR old_item = new_item THEN tail
 ELSE regexp_replace(tail, '(?i)\b((?:no\.?|step)\s*)' || old_item || '\b', '\1' || new_item) END AS shown
FROM (SELECT *, CASE WHEN hit THEN regexp_extract(phrase, before, 1) END AS head,
  CASE WHEN hit THEN substr(phrase, length(regexp_extract(phrase, before, 1)) + length(old_number) + 1) ELSE phrase END AS tail
 FROM (SELECT *, coalesce(regexp_matches(phrase, before), false) AS hit
  FROM (SELECT *, '^(|.*?[^0-9.])' || replace(old_number, '.', '\.') || '(?:$|[^0-9.]|\.$|\.[^0-9])' AS before FROM """ + PHRASES + ")))")
def shown_numbers(spark, sf_dir):
    """Reference phrases with their new numbers (F27): the first free-standing old number, then the item number behind it."""
    p = derived(spark, sf_dir, PHRASES)
    quoted = F.concat(F.lit(r"(?s)^(.*?)(?<![\d.])\Q"), "old_number", F.lit(r"\E(?!\d|\.\d)"))
    hit = F.coalesce(F.rlike("phrase", "quoted"), F.lit(False))
    p = p.withColumn("quoted", quoted).withColumn("head", F.when(hit, F.expr("regexp_extract(phrase, quoted, 1)")))
    behind = F.expr("substring(phrase, length(head) + length(old_number) + 1)")
    p = p.withColumn("tail", F.coalesce(behind, "phrase"))
    item = F.concat(F.lit(r"(?is)^(?<before>.*?\b(?:no\.?|step)\s*)\Q"), "old_item", F.lit(r"\E\b"))
    renamed = F.regexp_replace("tail", item, F.concat(F.lit("${before}"), "new_item"))
    return p.select("ref_id", F.concat(F.coalesce(F.concat("head", "new_number"), F.lit("")), F.coalesce(renamed, "tail")).alias("shown"))


CELL_TEXTS = "(SELECT conv_id || ':' || turn AS cell_id, CASE WHEN turn % 2 = 1 THEN 'Working' || chr(10) || 'Copy' || chr(10) ELSE '' END || replace(text, ' ', chr(10)) AS cell_text FROM conversations) AS inline_rows"
# fixed values: lines that a watermark leaves in a cell
MARKS = ["o", "w", "copy", "working", "working copy"]


@query("f32_clean_cells", rf"""
SELECT c.cell_id, coalesce(string_agg(line, ' ' ORDER BY pos) FILTER (WHERE line <> '' AND NOT list_contains({MARKS}, regexp_replace(lower(line), '\s+', ' ', 'g')) AND NOT regexp_matches(line, '^\p{{L}}{{1,2}}$')), '') AS cleaned
FROM {named(CELL_TEXTS, 'c')} LEFT JOIN (SELECT cell_id, trim(unnest(l)) AS line, generate_subscripts(l, 1) AS pos
 FROM (SELECT cell_id, string_split(replace(cell_text, chr(8203), ''), chr(10)) AS l FROM {CELL_TEXTS})) AS u ON u.cell_id = c.cell_id GROUP BY c.cell_id""")
def clean_cells(spark, sf_dir):
    """Cells without what a watermark left in them (F32): its words, and lines of one or two letters; no text gives an empty one."""
    lines = F.transform(F.split(F.replace("cell_text", F.lit("\u200b"), F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: (x != "") & ~F.regexp_replace(F.lower(x), r"\s+", " ").isin(MARKS) & ~x.rlike(r"^\p{L}{1,2}$"))
    return derived(spark, sf_dir, CELL_TEXTS).select("cell_id", F.coalesce(F.array_join(kept, " "), F.lit("")).alias("cleaned"))


EXPANSIONS = "(SELECT a.p_partkey AS pair_id, upper(a.p_name) || '''s ' || a.p_type AS a, CASE WHEN a.p_size % 3 = 0 THEN b.p_name || 's' ELSE split_part(a.p_name, ' ', 2) || 's ' || lower(b.p_type) END AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1) AS inline_rows"


@query("f40_same_meaning", r"""
SELECT pair_id, x = y OR (x <> '' AND y <> '' AND (contains(' ' || x || ' ', ' ' || y || ' ') OR contains(' ' || y || ' ', ' ' || x || ' '))) AS same
FROM (SELECT pair_id, trim(regexp_replace(regexp_replace(lower(regexp_replace(a, '[''’]s\b', '', 'g')), '[^a-z0-9]+', ' ', 'g'), '\b([a-z0-9]{3,})s\b', '\1', 'g')) AS x,
 trim(regexp_replace(regexp_replace(lower(regexp_replace(b, '[''’]s\b', '', 'g')), '[^a-z0-9]+', ' ', 'g'), '\b([a-z0-9]{3,})s\b', '\1', 'g')) AS y FROM """ + EXPANSIONS + ")")
def same_meaning(spark, sf_dir):
    """Pairs of expansions that are loosely the same (F40): without case, plurals and possessives one contains the other's words."""

    def stems(c):
        words = F.regexp_extract_all(F.lower(F.regexp_replace(c, r"['’]s\b", "")), F.lit("[a-z0-9]+"), 0)
        return F.concat(F.lit(" "), F.array_join(F.transform(words, lambda w: F.regexp_replace(w, "^(.{3,})s$", "$1")), " "), F.lit(" "))

    x, y = stems("a"), stems("b")
    both = (F.trim(x) != "") & (F.trim(y) != "")
    return derived(spark, sf_dir, EXPANSIONS).select("pair_id", ((x == y) | (both & (x.contains(y) | y.contains(x)))).alias("same"))


CELLS = "(SELECT conv_id AS table_id, turn AS row_index, 0 AS col, CASE WHEN length(text) % 3 > 0 THEN '' ELSE split_part(text, ' ', 1) END AS text FROM conversations UNION ALL SELECT conv_id, turn, 1, split_part(text, ' ', 2) FROM conversations UNION ALL SELECT conv_id, turn, 2, split_part(text, ' ', 3) FROM conversations WHERE length(text) % 7 > 0) AS inline_rows"


@query("w09_continued_rows", f"""
WITH RECURSIVE grid AS (SELECT table_id, row_index, count(*) AS width, bool_or(col = 0 AND trim(coalesce(text, '')) <> '') AS keyed, bool_or(col > 0 AND trim(coalesce(text, '')) <> '') AS rest FROM {CELLS} GROUP BY ALL),
merged AS (SELECT table_id, row_index, row_index AS into_row, width, keyed FROM grid WHERE row_index = 0 UNION ALL
 SELECT g.table_id, g.row_index, CASE WHEN m.into_row > 0 AND NOT g.keyed AND m.keyed AND g.rest AND g.width = m.width THEN m.into_row ELSE g.row_index END, g.width,
  CASE WHEN m.into_row > 0 AND NOT g.keyed AND m.keyed AND g.rest AND g.width = m.width THEN m.keyed ELSE g.keyed END
 FROM merged AS m JOIN grid AS g ON g.table_id = m.table_id AND g.row_index = m.row_index + 1)
SELECT m.table_id, into_row AS row_index, col, coalesce(string_agg(trim(text), ' ' ORDER BY m.row_index) FILTER (WHERE trim(text) <> ''), '') AS text
FROM merged AS m JOIN {named(CELLS, 'c')} ON c.table_id = m.table_id AND c.row_index = m.row_index GROUP BY m.table_id, into_row, col""")
def continued_rows(spark, sf_dir):
    """Table rows of empty key merged into the row that they continue, in chains."""
    return U.continued_rows(derived(spark, sf_dir, CELLS))


UNITS = "(SELECT conv_id AS section, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS seq, CASE length(text) % 4 WHEN 0 THEN 'bullet' WHEN 1 THEN 'paragraph' WHEN 2 THEN 'procedure_step' ELSE 'table_row' END AS unit_type, CASE WHEN length(text) % 5 = 0 THEN left(text, 40) || ':' WHEN length(text) % 5 < 3 THEN left(text, 30) ELSE text END AS text, length(text) % 3 = 0 AS icon, CASE WHEN length(text) % 4 = 3 THEN 't' || (length(text) % 2) END AS table_id FROM conversations) AS inline_rows"


@query("w15_icon_rows", rf"""
WITH RECURSIVE marked AS (SELECT *, unit_type IN ('paragraph', 'bullet') AND NOT icon AND length(trim(text)) BETWEEN 1 AND 80 AND NOT regexp_matches(trim(text), '[.:;]$') AS label, row_number() OVER (PARTITION BY section ORDER BY seq) AS pos FROM {UNITS}),
walk AS (SELECT section, seq, pos, seq AS head, icon AS is_open FROM marked WHERE pos = 1 UNION ALL
 SELECT m.section, m.seq, m.pos, CASE WHEN NOT m.icon AND w.is_open AND m.label THEN w.head ELSE m.seq END, m.icon OR (w.is_open AND m.label) FROM walk AS w JOIN marked AS m ON m.section = w.section AND m.pos = w.pos + 1)
SELECT section, seq, head FROM walk""")
def icon_rows(spark, sf_dir):
    """Units with the icon unit that they label, or themselves."""
    return U.icon_rows(derived(spark, sf_dir, UNITS)).select("section", "seq", "head")


@query("w16_items", f"""
WITH RECURSIVE walk AS (SELECT section, seq, table_id, seq AS first FROM {UNITS} WHERE seq = 1 UNION ALL
 SELECT u.section, u.seq, u.table_id, CASE WHEN u.table_id = w.table_id THEN w.first ELSE u.seq END FROM walk AS w JOIN {named(UNITS, 'u')} ON u.section = w.section AND u.seq = w.seq + 1)
SELECT section, row_number() OVER (PARTITION BY section ORDER BY first) AS item, first, count(*) AS n FROM walk GROUP BY section, first""")
def unit_items(spark, sf_dir):
    """Consecutive rows of one table as one item, other units as their own."""
    return U.items(derived(spark, sf_dir, UNITS))


@query("x03_extended_lists", f"""
WITH t AS (SELECT *, CASE WHEN unit_type IS DISTINCT FROM lag(unit_type) OVER (PARTITION BY section ORDER BY seq) THEN 1 ELSE 0 END AS turn FROM {UNITS}), r AS (SELECT *, sum(turn) OVER (PARTITION BY section ORDER BY seq) AS run FROM t)
SELECT i.section, i.seq AS intro, u.seq FROM r AS i JOIN r AS n ON n.section = i.section AND n.seq = i.seq + 1 JOIN r AS u ON u.section = i.section AND u.run = n.run AND u.seq > i.seq
WHERE rtrim(i.text) LIKE '%:' AND u.unit_type IN ('bullet', 'procedure_step')""")
def extended_lists(spark, sf_dir):
    """The list items that a line ending in a colon takes along: those right behind it, of the first one's type."""
    return U.extended_lists(derived(spark, sf_dir, UNITS))


TARGETS = inline("section_id, heading, slot_id, instruction", [("s1", "Scope", "s1.a", "Describe the  scope and who is affected."), ("s2", "Process Steps", "s2.a", "List each step."), ("s2", "Process Steps", "s2.b", "Name the owner of a step"), ("s3", "Records", "s3.a", "None")])
GIVEN = inline("position, title, instruction_id, text", [
    (1, " scope ", "i1", "Describe the scope"), (1, " scope ", "i2", "who  is affected."), (1, " scope ", "i3", ""), (2, "Scope of supply", "i4", "describe the scope"),
    (3, "The process steps", "i5", "step"), (4, "Process steps, continued", "i6", "owner"), (5, "Annex", "i7", "none"),
])


@query("x04_linked_instructions", rf"""
WITH t AS (SELECT *, trim(regexp_replace(lower(heading), '\s+', ' ', 'g')) AS h, trim(regexp_replace(lower(instruction), '\s+', ' ', 'g')) AS i FROM {TARGETS}),
g AS (SELECT *, trim(regexp_replace(lower(title), '\s+', ' ', 'g')) AS k, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS x FROM {GIVEN})
SELECT slot_id, string_agg(instruction_id, ',' ORDER BY instruction_id) AS instructions FROM t JOIN g ON g.position = coalesce((SELECT min(e.position) FROM g AS e WHERE e.k = t.h), (SELECT min(e.position) FROM g AS e WHERE contains(e.k, t.h)))
WHERE x <> '' AND contains(i, x) GROUP BY slot_id""")
def linked_instructions(spark, sf_dir):
    """Slots with the earlier instructions that their own one holds, from the section of the same title, else the first that contains it."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    slots = values(spark, TARGETS).select("section_id", "slot_id", plain("heading").alias("h"), plain("instruction").alias("i"))
    given = values(spark, GIVEN).select("position", "instruction_id", plain("title").alias("k"), plain("text").alias("x"))
    titles, headings = given.select("position", "k").distinct(), slots.select("h").distinct()
    exact = headings.join(titles, F.col("h") == F.col("k")).groupBy("h").agg(F.min("position").alias("position"))
    within = headings.join(exact, "h", "left_anti").join(titles, F.col("k").contains(F.col("h"))).groupBy("h").agg(F.min("position").alias("position"))
    found = slots.join(exact.unionByName(within), "h").join(given, "position").where((F.col("x") != "") & F.col("i").contains(F.col("x")))
    return found.groupBy("slot_id").agg(F.array_join(F.array_sort(F.collect_list("instruction_id")), ",").alias("instructions"))


RULES = "(SELECT 'R' || p_partkey AS rule_id, CASE p_size % 3 WHEN 0 THEN 'baseline' WHEN 1 THEN 'guide' ELSE 'manual' END AS origin, CASE p_partkey % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'candidate' ELSE 'rejected' END AS status, CASE WHEN p_size % 4 = 0 THEN '' ELSE 's' || (p_partkey % 20) || ' s' || (p_size * 3) END AS cited FROM part) AS inline_rows"
BUILT_IN = "(SELECT 'R' || (p_partkey * 2) AS rule_id, 'approved' AS status FROM part) AS inline_rows"
KNOWN_UNITS = "(SELECT 's' || s_suppkey AS unit_id FROM supplier) AS inline_rows"


@query("x05_rule_problems", f"""
SELECT rule_id, 'not built in' AS problem FROM {RULES} WHERE origin = 'baseline' AND rule_id NOT IN (SELECT rule_id FROM {BUILT_IN}) UNION ALL
SELECT rule_id, 'no citation' FROM {RULES} WHERE origin = 'guide' AND cited = '' UNION ALL
SELECT rule_id, 'unknown units ' || string_agg(unit, ',' ORDER BY unit) FROM (SELECT rule_id, unnest(string_split(cited, ' ')) AS unit FROM {RULES} WHERE origin = 'guide' AND cited <> '')
WHERE unit NOT IN (SELECT unit_id FROM {KNOWN_UNITS}) GROUP BY rule_id""")
def rule_problems(spark, sf_dir):
    """What keeps a reviewed rule set from being saved (X5): false origin, no citation, citations of unknown units."""
    rules = derived(spark, sf_dir, RULES)
    false_origin = rules.where("origin = 'baseline'").join(derived(spark, sf_dir, BUILT_IN), "rule_id", "left_anti").select("rule_id", F.lit("not built in").alias("problem"))
    guide = rules.where("origin = 'guide'")
    bare = guide.where("cited = ''").select("rule_id", F.lit("no citation").alias("problem"))
    cited = guide.where("cited <> ''").select("rule_id", F.explode(F.split("cited", " ")).alias("unit_id")).join(derived(spark, sf_dir, KNOWN_UNITS), "unit_id", "left_anti")
    unknown = cited.groupBy("rule_id").agg(F.concat(F.lit("unknown units "), F.array_join(F.array_sort(F.collect_list("unit_id")), ",")).alias("problem"))
    return false_origin.unionByName(bare).unionByName(unknown)


NAMED = "(SELECT 'R' || (p_partkey * 3) AS rule_id FROM part) AS inline_rows"


@query("x06_approved", f"""
SELECT rule_id, CASE WHEN status = 'candidate' THEN 'approved' ELSE status END AS all_candidates, CASE WHEN rule_id IN (SELECT rule_id FROM {NAMED}) THEN 'approved' ELSE status END AS named_only FROM
(SELECT rule_id, status FROM {RULES} UNION ALL SELECT rule_id, status FROM {BUILT_IN} WHERE rule_id NOT IN (SELECT rule_id FROM {RULES}))
UNION ALL SELECT rule_id, NULL, 'unknown' FROM {NAMED} WHERE rule_id NOT IN (SELECT rule_id FROM {RULES} UNION ALL SELECT rule_id FROM {BUILT_IN})""")
def approved(spark, sf_dir):
    """Rules after approving all candidates, and after approving the named ones (X6); missing built-in rules come back first, unknown names are told."""
    rules, names = derived(spark, sf_dir, RULES).select("rule_id", "status"), derived(spark, sf_dir, NAMED).withColumn("named", F.lit(True))
    full = rules.unionByName(derived(spark, sf_dir, BUILT_IN).join(rules, "rule_id", "left_anti")).join(names, "rule_id", "full")
    every = F.when(F.col("status") == "candidate", "approved").otherwise(F.col("status"))
    only = F.when(F.col("status").isNull(), "unknown").when(F.col("named"), "approved").otherwise(F.col("status"))
    return full.select("rule_id", every.alias("all_candidates"), only.alias("named_only"))


SLOTS = "(SELECT 'o' || o_orderkey AS slot_ref, o_orderstatus = 'F' AS required, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS instruction FROM orders) AS inline_rows"
OVERRIDES = "(SELECT 'o' || (o_orderkey + 5) AS slot_ref, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS required, CASE WHEN o_orderkey % 4 > 0 THEN 'for ' || o_custkey END AS instruction FROM orders WHERE o_orderkey % 2 = 0) AS inline_rows"


@query("x11_overridden_slots", f"""
SELECT s.slot_ref, coalesce(CAST(o.required AS BOOLEAN), s.required) AS required, coalesce(o.instruction, s.instruction) AS instruction, true AS known FROM {named(SLOTS, 's')} LEFT JOIN {named(OVERRIDES, 'o')} ON o.slot_ref = s.slot_ref
UNION ALL SELECT slot_ref, NULL, NULL, false FROM {OVERRIDES} WHERE slot_ref NOT IN (SELECT slot_ref FROM {SLOTS})""")
def overridden_slots(spark, sf_dir):
    """Slots under their overrides, column by column, and overrides whose slot is unknown (X11)."""
    over = derived(spark, sf_dir, OVERRIDES).select("slot_ref", F.col("required").cast("boolean").alias("o_required"), F.col("instruction").alias("o_instruction"), F.lit(True).alias("over"))
    full = derived(spark, sf_dir, SLOTS).withColumn("known", F.lit(True)).join(over, "slot_ref", "full").withColumn("known", F.coalesce("known", F.lit(False)))
    return full.select(
        "slot_ref",
        F.when(F.col("known"), F.coalesce("o_required", "required")).alias("required"),
        F.when(F.col("known"), F.coalesce("o_instruction", "instruction")).alias("instruction"),
        "known",
    )


GAPS = "(SELECT l_orderkey || ':' || l_partkey AS issue_id, CASE WHEN l_returnflag = 'R' THEN 'missing_slot' ELSE 'lost_value' END AS gate, CASE WHEN l_quantity > 5 THEN 's' || l_linenumber END AS slot_id, l_linestatus = 'F' AS resolved, CASE WHEN l_tax > 0.02 THEN 'by ' || l_suppkey END AS note FROM lineitem) AS inline_rows"


@query("x16_accepted_gaps", f"SELECT slot_id, issue_id, note FROM {GAPS} WHERE gate = 'missing_slot' AND resolved AND slot_id IS NOT NULL")
def accepted_gaps(spark, sf_dir):
    """Required slots whose gap a reviewer has accepted."""
    return derived(spark, sf_dir, GAPS).where((F.col("gate") == "missing_slot") & F.col("resolved") & F.col("slot_id").isNotNull()).select("slot_id", "issue_id", "note")


CLAIMS = "(SELECT 'o' || o_orderkey AS claim_id, 't' || o_custkey AS target, 's' || (o_orderkey % 7) AS slot_id, CASE o_orderstatus WHEN 'F' THEN 'text' WHEN 'O' THEN 'heading' ELSE 'step' END AS kind, o_orderkey % 11 = 0 AS gap, CASE left(o_orderpriority, 1) WHEN '1' THEN 'note' WHEN '2' THEN 'tip' WHEN '3' THEN 'alarm' END AS callout, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'u' || (o_orderkey % 10) ELSE 'u' || (o_orderkey % 10) || ' v' || (o_orderkey % 7) END AS units FROM orders) AS inline_rows"


@query("x17_placed_claims", f"SELECT claim_id, target, slot_id FROM {CLAIMS} WHERE NOT gap AND kind <> 'heading'")
def placed_claims(spark, sf_dir):
    """Claims of nested drafts with their places, without gap markers and headings."""
    claim = F.struct("claim_id", "kind", "gap")
    drafts = derived(spark, sf_dir, CLAIMS).groupBy("target", "slot_id").agg(F.collect_list(claim).alias("claims"))
    drafts = drafts.groupBy("target").agg(F.collect_list(F.struct("slot_id", "claims")).alias("slots"))
    placed = drafts.select("target", F.explode("slots").alias("slot")).select("target", "slot.slot_id", F.explode("slot.claims").alias("claim"))
    return placed.where("NOT claim.gap AND claim.kind <> 'heading'").select("claim.claim_id", "target", "slot_id")


PALETTE = inline("kind", [("note",), ("tip",)])
SLOT_CALLOUTS = "(SELECT DISTINCT 's' || (o_orderkey % 7) AS slot_id, CASE o_orderkey % 7 WHEN 2 THEN 'tip' WHEN 3 THEN 'note' END AS slot_kind FROM orders) AS inline_rows"
ASSIGNED = "(SELECT DISTINCT 't' || o_custkey AS target, 'u' || (o_orderkey % 10) AS unit_id, 'note' AS kind FROM orders WHERE o_orderkey % 3 > 0 UNION SELECT 't' || o_custkey, 'v' || (o_orderkey % 7), 'note' FROM orders WHERE o_orderkey % 5 > 0) AS inline_rows"


@query("x19_callout_faults", f"""
SELECT claim_id, CASE WHEN callout NOT IN (SELECT kind FROM {PALETTE}) THEN 'not in the palette' ELSE 'not planned' END AS fault FROM {named(CLAIMS, 'c')} LEFT JOIN {named(SLOT_CALLOUTS, 's')} ON s.slot_id = c.slot_id
WHERE callout IS NOT NULL AND NOT gap AND (callout NOT IN (SELECT kind FROM {PALETTE}) OR NOT (coalesce(slot_kind = callout, false) OR (units <> '' AND
 len(string_split(units, ' ')) = (SELECT count(*) FROM {named(ASSIGNED, 'a')} WHERE a.target = c.target AND a.kind = c.callout AND list_contains(string_split(c.units, ' '), a.unit_id)))))""")
def callout_faults(spark, sf_dir):
    """Claims in a callout that the palette lacks, or that neither their slot nor the plan of all their units gives them."""
    c = derived(spark, sf_dir, CLAIMS).where("callout IS NOT NULL AND NOT gap")
    cited = c.where("units <> ''").select("claim_id", "target", F.col("callout").alias("kind"), F.explode(F.split("units", " ")).alias("unit_id"))
    planned = cited.join(derived(spark, sf_dir, ASSIGNED).withColumn("has", F.lit(True)), ["target", "unit_id", "kind"], "left")
    planned = planned.groupBy("claim_id").agg(F.every(F.coalesce("has", F.lit(False))).alias("planned"))
    c = c.join(values(spark, PALETTE).select(F.col("kind").alias("callout"), F.lit(True).alias("offered")), "callout", "left")
    c = c.join(derived(spark, sf_dir, SLOT_CALLOUTS), "slot_id", "left").join(planned, "claim_id", "left")
    fits = F.coalesce(F.col("slot_kind") == F.col("callout"), F.lit(False)) | F.coalesce("planned", F.lit(False))
    fault = F.when(F.col("offered").isNull(), "not in the palette").when(~fits, "not planned")
    return c.select("claim_id", fault.alias("fault")).where("fault IS NOT NULL")


MAPPED = "(SELECT o_orderkey AS mapping_id, CASE WHEN o_orderkey % 13 > 0 THEN 't' || o_custkey END AS target, CASE o_orderstatus WHEN 'F' THEN 'mapped' WHEN 'O' THEN 'needs_review' ELSE 'rejected' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'split' ELSE 'one_to_one' END AS mapping_type, 's' || CAST(floor(o_orderkey / 75) AS INT) || ' s' || CAST(floor(o_orderkey / 75) + 1 AS INT) AS sections, CASE WHEN o_orderkey % 6 = 0 THEN 'u' || CAST(floor(o_orderkey / 75) * 10 + o_orderkey % 10 AS INT) ELSE '' END AS units FROM orders) AS inline_rows"
SOURCE_UNITS = "(SELECT 's' || CAST(floor(p_partkey / 10) AS INT) AS section_id, 'u' || p_partkey AS unit_id, CASE WHEN p_size % 7 = 0 THEN ' ' ELSE p_name END AS unit_text, p_size % 3 = 0 AS boilerplate, CASE WHEN p_size % 14 = 0 THEN 'figure' ELSE 'paragraph' END AS unit_type FROM part) AS inline_rows"


@query("j13_section_scope", f"""
WITH parts AS (SELECT mapping_id, target, mapping_type, units, unnest(string_split(sections, ' ')) AS section_id FROM {MAPPED} WHERE target IS NOT NULL AND status IN ('mapped', 'needs_review')),
covered AS (SELECT DISTINCT target, unit_id, trim(unit_text) <> '' AS worded, NOT boilerplate AND (trim(unit_text) <> '' OR unit_type = 'figure') AS substantive FROM parts AS p JOIN {named(SOURCE_UNITS, 'u')} ON u.section_id = p.section_id
 WHERE NOT (mapping_type = 'split' AND EXISTS (SELECT 1 FROM {named(SOURCE_UNITS, 'x')} WHERE x.section_id = p.section_id AND list_contains(string_split(p.units, ' '), x.unit_id))) OR list_contains(string_split(p.units, ' '), u.unit_id))
SELECT target, unit_id FROM covered AS c WHERE substantive OR (worded AND NOT EXISTS (SELECT 1 FROM covered AS d WHERE d.target = c.target AND d.substantive))""")
def section_scope(spark, sf_dir):
    """The passages that the section plan sends to each target (J13): listed units of a split section, else all; substantive ones where there are any."""
    parts = derived(spark, sf_dir, MAPPED).where("target IS NOT NULL AND status IN ('mapped', 'needs_review')")
    parts = parts.select("mapping_id", "target", "mapping_type", F.split("units", " ").alias("listed"), F.explode(F.split("sections", " ")).alias("section_id"))
    covered = parts.join(derived(spark, sf_dir, SOURCE_UNITS), "section_id").withColumn("named", (F.col("mapping_type") == "split") & F.array_contains("listed", F.col("unit_id")))
    some = parts.join(derived(spark, sf_dir, SOURCE_UNITS), "section_id").where("mapping_type = 'split' AND array_contains(listed, unit_id)").select("mapping_id", "section_id", F.lit(True).alias("split")).distinct()
    covered = covered.join(some, ["mapping_id", "section_id"], "left").where("named OR split IS NULL")
    worded = F.trim("unit_text") != ""
    covered = covered.select("target", "unit_id", worded.alias("worded"), (~F.col("boilerplate") & (worded | (F.col("unit_type") == "figure"))).alias("substantive")).distinct()
    any_ = covered.groupBy("target").agg(F.bool_or("substantive").alias("some"))
    return covered.join(any_, "target").where("substantive OR (worded AND NOT some)").select("target", "unit_id")


CITING = "(SELECT conv_id || ':' || turn AS unit_id, text AS unit_text FROM conversations) AS inline_rows"
CITED = "(SELECT conv_id || ':' || turn AS unit_id, 1 AS ref_at, split_part(text, ' ', 2) AS raw_text, 's1' AS ref_target FROM conversations UNION ALL SELECT conv_id || ':' || turn AS unit_id, 2 AS ref_at, split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3) AS raw_text, 's2' AS ref_target FROM conversations UNION ALL SELECT conv_id || ':' || turn AS unit_id, 3 AS ref_at, lower(split_part(text, ' ', 4)) AS raw_text, 's3' AS ref_target FROM conversations) AS inline_rows"


@query("f26_reference_tokens", f"""
WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY length(raw_text) DESC, ref_at) AS k FROM {CITED} WHERE raw_text <> ''),
walk AS (SELECT unit_id, unit_text AS tokenized, 0 AS k FROM {CITING} UNION ALL
 SELECT w.unit_id, CASE WHEN position(lower(raw_text) IN lower(tokenized)) > 0 THEN left(tokenized, position(lower(raw_text) IN lower(tokenized)) - 1) || '{{{{ref:' || ref_target || '}}}}' || substr(tokenized, position(lower(raw_text) IN lower(tokenized)) + length(raw_text)) ELSE tokenized END, r.k
 FROM walk AS w JOIN r ON r.unit_id = w.unit_id AND r.k = w.k + 1)
SELECT unit_id, arg_max(tokenized, k) AS tokenized FROM walk GROUP BY unit_id""")
def reference_tokens(spark, sf_dir):
    """Units with a token for each internal reference (F26): longest phrases first, one occurrence for each, whatever the case."""
    order = F.struct((-F.length("raw_text")).alias("longest"), "ref_at", "raw_text", "ref_target")
    refs = derived(spark, sf_dir, CITED).where("raw_text <> ''").groupBy("unit_id").agg(F.array_sort(F.collect_list(order)).alias("refs"))
    first = lambda text, r: F.regexp_replace(
        text, F.concat(F.lit(r"(?isu)^(?<before>.*?)\Q"), r["raw_text"], F.lit(r"\E")), F.concat(F.lit("${before}{{ref:"), r["ref_target"], F.lit("}}"))
    )
    folded = F.aggregate("refs", F.col("unit_text"), first)
    return derived(spark, sf_dir, CITING).join(refs, "unit_id", "left").select("unit_id", F.coalesce(folded, "unit_text").alias("tokenized"))


DUTIES = "(SELECT conv_id AS table_id, 0 AS col, left(split_part(text, ' ', 1), 1) AS text FROM conversations UNION ALL SELECT conv_id AS table_id, 1 AS col, left(split_part(text, ' ', 2), 1) AS text FROM conversations UNION ALL SELECT conv_id AS table_id, 2 AS col, left(split_part(text, ' ', 3), 1) AS text FROM conversations UNION ALL SELECT conv_id AS table_id, 3 AS col, left(split_part(text, ' ', 4), 1) AS text FROM conversations) AS inline_rows"


@query("a16_duty_tables", r"SELECT table_id, round(coalesce(avg(CASE WHEN regexp_full_match(upper(trim(text)), '[RACIX](\s*[&/,+]?\s*[RACIX]){0,3}\s*[0-9¹²³⁴⁵⁶⁷⁸⁹)]*') THEN 1.0 ELSE 0.0 END) FILTER (WHERE col > 0 AND trim(text) <> ''), 0), 4) AS share, coalesce(avg(CASE WHEN regexp_full_match(upper(trim(text)), '[RACIX](\s*[&/,+]?\s*[RACIX]){0,3}\s*[0-9¹²³⁴⁵⁶⁷⁸⁹)]*') THEN 1.0 ELSE 0.0 END) FILTER (WHERE col > 0 AND trim(text) <> ''), 0) >= 0.3 AS duties FROM " + DUTIES + " GROUP BY table_id")
def duty_tables(spark, sf_dir):
    """Tables of duties (A16): 0.3 or more of their filled cells beyond the first column are duty letters."""
    # fixed value: one to four duty letters with marks between them, then footnote digits
    letters = F.upper(F.trim("text")).rlike(r"^[RACIX](\s*[&/,+]?\s*[RACIX]){0,3}\s*[0-9¹²³⁴⁵⁶⁷⁸⁹)]*$")
    share = F.coalesce(F.avg(F.when((F.col("col") > 0) & (F.trim("text") != ""), letters.cast("double"))), F.lit(0.0))
    return derived(spark, sf_dir, DUTIES).groupBy("table_id").agg(F.round(share, 4).alias("share"), (share >= 0.3).alias("duties"))

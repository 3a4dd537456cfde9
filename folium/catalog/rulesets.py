"""Queries over rule sets, unit labels and paragraphs, and small projections and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.functions import signals as S
from folium.operators import records, rules as R
from folium.registry import derived, inline, query, table, values
from folium.sources import files

RULES = inline("rule_id, category, params, cited", [
    ("r1", "STY", '{"kind": "forbidden_terms", "terms": ["utilise", "e.g."]}', "Avoid Utilise and e.g. in text."), ("r2", "STY", '{"kind": "forbidden_terms", "terms": ["jargon", "slang"]}', "Avoid jargon."),
    ("r3", "STY", '{"kind": "max_sentence_words", "max_words": 0}', ""), ("r4", "STY", '{"kind": "max_sentence_words", "limit": 30}', ""), ("r5", "STY", '{"kind": "passive_ratio", "max_ratio": 1.5, "note": "x"}', ""),
    ("r6", "STY", '{"kind": "readability"}', ""), ("r7", "STY", '{"kind": "modality"}', ""), ("r8", "PRES", '{"kind": "modality"}', ""), ("r9", "STY", '{"kind": "spelling"}', ""), ("r10", "STY", "{}", ""),
    ("r11", "STY", '{"kind": "forbidden_terms", "terms": []}', ""), ("r12", "STY", '{"kind": "readability", "fk_grade_max": 12}', ""),
])
VOCABULARY = ", ".join(f"('{k}', {list(need)}::VARCHAR[], {list(may)}::VARCHAR[])" for k, (need, may) in R.CHECKS.items())


@query("f41_rule_parameters", f"""
WITH r AS (SELECT rule_id, category, lower(cited) AS cited, params::JSON AS p, params::JSON->>'kind' AS kind, list_filter(json_keys(params::JSON), lambda x: x NOT IN ('kind', 'note')) AS given FROM {RULES}),
k AS (SELECT * FROM (VALUES {VOCABULARY}) v(kind, need, may)), j AS (SELECT r.*, need, may FROM r LEFT JOIN k ON k.kind = r.kind),
x AS (SELECT rule_id, 'unknown kind' AS problem FROM j WHERE need IS NULL UNION ALL SELECT rule_id, 'missing ' || unnest(list_filter(need, lambda n: NOT list_contains(given, n))) FROM j WHERE need IS NOT NULL
 UNION ALL SELECT rule_id, 'unexpected ' || unnest(list_filter(given, lambda g: NOT list_contains(need, g) AND NOT list_contains(may, g))) FROM j WHERE need IS NOT NULL),
y AS (SELECT * FROM j WHERE rule_id NOT IN (SELECT rule_id FROM x)),
z AS (SELECT * FROM x UNION ALL SELECT rule_id, 'no terms' FROM y WHERE kind = 'forbidden_terms' AND json_array_length(p->'terms') = 0 UNION ALL SELECT rule_id, 'max_words' FROM y WHERE kind = 'max_sentence_words' AND (p->>'max_words')::INT < 1
 UNION ALL SELECT rule_id, 'max_ratio' FROM y WHERE kind = 'passive_ratio' AND (p->>'max_ratio')::DOUBLE NOT BETWEEN 0 AND 1 UNION ALL SELECT rule_id, 'no bound' FROM y WHERE kind = 'readability' AND len(given) = 0
 UNION ALL SELECT rule_id, 'not a preservation rule' FROM y WHERE kind IN ('modality', 'protected_values') AND category <> 'PRES'
 UNION ALL SELECT DISTINCT rule_id, 'terms not quoted' FROM (SELECT rule_id, cited, unnest((p->'terms')::VARCHAR[]) AS t FROM y WHERE kind = 'forbidden_terms') WHERE NOT contains(cited, lower(t)))
SELECT r.rule_id, coalesce((SELECT string_agg(problem, '; ' ORDER BY problem) FROM z WHERE z.rule_id = r.rule_id), '') AS problems FROM r""")
def rule_parameters(spark, sf_dir):
    """Parameters of checks against the vocabulary of kinds, their ranges and the guide text they cite."""
    return R.parameter_problems(values(spark, RULES))


CANDIDATES = inline("category, text, unit_id", [
    ("STY", "Use short  sentences.", "g3"), ("STY", "use short sentences.", "g1"), ("STY", "Use verbs.", "g2"), ("STY", "Lost.", "g9"), ("PRES", "Keep ids.", "g4"), ("FMT", "Use verbs.", "g2"), ("FMT", " ", "g1"), ("PRES", "Keep names.", "g1"),
])
GUIDE = inline("unit_id, seq", [("g1", 1), ("g2", 2), ("g3", 3), ("g4", 4), ("g5", 5)])
MERGED = f"""(SELECT category, lower(trim(regexp_replace(c.text, '\\s+', ' ', 'g'))) AS text, min(seq) AS first, string_agg(DISTINCT c.unit_id, ' ' ORDER BY c.unit_id) AS unit_ids
 FROM {CANDIDATES.replace('inline_rows', 'c')} JOIN {GUIDE.replace('inline_rows', 'g')} ON g.unit_id = c.unit_id WHERE trim(c.text) <> '' GROUP BY 1, 2)"""


@query("c19_rule_set", f"""
SELECT category || '-' || lpad(CAST(row_number() OVER (PARTITION BY category ORDER BY first, text) + CASE category WHEN 'PRES' THEN 6 ELSE 0 END AS VARCHAR), 3, '0') AS rule_id, text, unit_ids FROM {MERGED}
UNION ALL SELECT 'PRES-00' || n, 'baseline', '' FROM range(1, 7) t(n)""")
def rule_set(spark, sf_dir):
    """Candidates merged and numbered in guide order behind the baseline rules, whose ids are reserved."""
    base = values(spark, inline("rule_id, text, unit_ids", [(x, "baseline", "") for x in R.BASELINE]))
    return R.numbered_rules(values(spark, CANDIDATES), values(spark, GUIDE)).unionByName(base)


@query("c19_uncovered_units", f"SELECT unit_id FROM {GUIDE} WHERE unit_id NOT IN (SELECT unit_id FROM {CANDIDATES.replace('inline_rows', 'c')} WHERE trim(text) <> '')")
def uncovered_units(spark, sf_dir):
    """Guide units that no rule cites."""
    cited = values(spark, CANDIDATES).where("trim(text) <> ''")
    return values(spark, GUIDE).join(cited, "unit_id", "left_anti").select("unit_id")


LANGUAGE_CUES = {"english": ("the", "of", "and", "is"), "german": ("der", "die", "und", "ist"), "french": ("le", "la", "et", "est"), "spanish": ("el", "los", "y", "es")}
_COUNTS = " UNION ALL ".join(f"SELECT conv_id, turn, '{label}' AS label, 10 * len(list_filter(w, lambda x: x IN {own})) AS weight FROM f" for label, own in LANGUAGE_CUES.items())
_PHRASES = " UNION ALL ".join(f"SELECT conv_id, turn, '{label}', {tenths} FROM f WHERE regexp_matches(plain, '{form}')" for label, (tenths, form) in R.PHRASES.items())
_KINDS = " UNION ALL ".join(f"SELECT conv_id, turn, '{label}', {tenths} FROM f WHERE kind = '{k}'" for k, (label, tenths) in R.KINDS.items())
UNIT_IDS = "PL-[0-9]{6,}(?:-[A-Z][0-9])?"
UNITS = """(SELECT conv_id, turn, role, turn = 0 AS boilerplate, CASE length(text) % 8 WHEN 0 THEN 'reference' WHEN 1 THEN 'definition' WHEN 2 THEN 'procedure_step' WHEN 3 THEN 'warning' WHEN 4 THEN 'table_row' ELSE 'paragraph' END AS kind,
 coalesce(text, '') || CASE length(text) % 11 WHEN 0 THEN ' The purpose is this.' WHEN 1 THEN ' Before use it must be in place.' WHEN 2 THEN ' One is responsible for it.' WHEN 3 THEN ' Step 3 follows.' WHEN 4 THEN ' It must not be opened.'
 WHEN 5 THEN ' It applies to all sites, regions and sites.' WHEN 6 THEN ' Sites in scope.' WHEN 7 THEN ' Out of scope, not covered: applicable, applies.' ELSE '' END
 || CASE WHEN turn = 0 THEN ' PL-' || (100000 + conv_id) WHEN length(text) % 5 = 0 THEN ' PL-' || (100000 + conv_id) || '-A1' WHEN length(text) % 5 = 1 THEN ' PL-' || (100001 + conv_id) WHEN length(text) % 5 = 2 THEN ' PL-' || (100000 + conv_id) ELSE '' END AS text
 FROM conversations) AS inline_rows"""


@query("f16_unit_labels", f"""
WITH u AS (SELECT *, string_split_regex(lower(text), '[^\\pL]+') AS w, ' ' || regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', '  ', 'g') || ' ' AS plain FROM {UNITS}),
o AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(text, '{UNIT_IDS}')) AS own FROM u WHERE boilerplate), i AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(text, '{UNIT_IDS}')) AS id FROM u),
p AS (SELECT DISTINCT conv_id, turn, true AS part FROM i JOIN o USING (conv_id) WHERE starts_with(id, own) AND id <> own), r AS (SELECT DISTINCT conv_id, turn, true AS names FROM i),
f AS (SELECT u.*, coalesce(part, false) AS part, names AND part IS NULL AS refers, len(regexp_extract_all(text, '[A-Za-z]+')) > 8 AND kind NOT IN ('reference', 'table_row') AS prose,
 len(regexp_extract_all(plain, '{R.SCOPE_STRONG}')) AS strong, len(regexp_extract_all(plain, '{R.SCOPE_WEAK}')) AS weak FROM u LEFT JOIN p USING (conv_id, turn) LEFT JOIN r USING (conv_id, turn)),
e AS (SELECT * FROM ({_COUNTS} UNION ALL SELECT conv_id, turn, 'question', 5 FROM f WHERE role = 'user' UNION ALL {_PHRASES} UNION ALL {_KINDS}
 UNION ALL SELECT conv_id, turn, CASE WHEN part THEN 'associated_document' ELSE 'reference' END, 20 FROM f WHERE kind = 'reference' UNION ALL SELECT conv_id, turn, 'associated_document', 20 FROM f WHERE part
 UNION ALL SELECT conv_id, turn, 'reference', CASE WHEN prose THEN 4 ELSE 15 END FROM f WHERE refers UNION ALL SELECT conv_id, turn, 'supporting_information', 6 FROM f WHERE refers AND prose
 UNION ALL SELECT conv_id, turn, 'scope', least(15, 6 * strong + 2 * weak) FROM f WHERE strong > 0) WHERE weight > 0),
a AS (SELECT * FROM e UNION ALL SELECT conv_id, turn, 'supporting_information', 10 FROM f WHERE (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM e))
SELECT conv_id, turn, label, sum(weight)::DOUBLE / any_value(total)::DOUBLE AS weight FROM (SELECT *, sum(weight) OVER (PARTITION BY conv_id, turn) AS total FROM a) GROUP BY conv_id, turn, label""")
def unit_labels(spark, sf_dir):
    """Labels of turns from weighted evidence, shares of 1: all words of languages, the role, phrases, kinds, scopes, and ids that go on from those of the first turn or
    do not (F16). Kinds, phrases and ids are set behind the given texts by their lengths."""
    units = derived(spark, sf_dir, UNITS).withColumn("unit_type", F.col("role"))
    own = R.own_ids(units.withColumn("document", F.col("conv_id")), UNIT_IDS, F.col("boilerplate")).groupBy(F.col("document").alias("conv_id")).agg(F.collect_set("own_id").alias("own"))
    units = units.join(own, "conv_id", "left").withColumn("own", F.coalesce("own", F.array().cast("array<string>")))
    units = R.content_evidence(units, UNIT_IDS, F.col("own"), F.col("kind"))
    return R.unit_labels(units, ["conv_id", "turn"], LANGUAGE_CUES, {"user": ("question", 5)}, "supporting_information", cap=None, each=10, more=F.col("evidence"))


_LINES = "SELECT doc_id AS document, unnest(s) AS text, generate_subscripts(s, 1) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)"
FORM = "[A-Z][a-z]{3,}"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document"), F.posexplode(F.split("text", "\n")).alias("n", "text"))


@query("x20_own_ids", f"SELECT DISTINCT document, unnest(regexp_extract_all(text, '{FORM}')) AS own_id FROM ({_LINES}) WHERE n = 1")
def own_document_ids(spark, sf_dir):
    """Ids that a document's own first line names (X20). The form of ids is a parameter: capitalised words stand for them here."""
    return R.own_ids(_lines(spark, sf_dir), FORM, F.col("n") == 0)


@query("x20_part_ids", f"""
WITH l AS ({_LINES}), o AS (SELECT DISTINCT document, unnest(regexp_extract_all(text, '{FORM}')) AS own_id FROM l WHERE n = 1), i AS (SELECT DISTINCT document, unnest(regexp_extract_all(text, '{FORM}')) AS part_id FROM l)
SELECT document, own_id, part_id FROM i JOIN o USING (document) WHERE starts_with(part_id, own_id) AND part_id <> own_id""")
def part_document_ids(spark, sf_dir):
    """Ids that go on from one of the document's own."""
    lines = _lines(spark, sf_dir)
    return R.part_ids(lines, R.own_ids(lines, FORM, F.col("n") == 0), FORM)


PARAGRAPHS = "(SELECT conv_id || ':' || turn AS n, CASE length(text) % 12 WHEN 0 THEN 'Heading ' || (1 + length(text) % 9) WHEN 1 THEN 'Title' WHEN 2 THEN 'Custom' WHEN 3 THEN 'List Bullet 2' WHEN 4 THEN 'List Number' WHEN 5 THEN 'Watermark Box' WHEN 6 THEN 'List Paragraph' WHEN 7 THEN 'Heading 9' ELSE 'Normal' END AS style, CASE WHEN length(text) % 5 = 0 THEN length(text) % 4 END AS outline, CASE WHEN length(text) % 7 = 0 THEN '' || turn END AS numbering, CASE WHEN length(text) % 11 = 0 THEN ' ' WHEN length(text) % 13 = 0 THEN 'draft of ' || text ELSE text END AS txt FROM conversations) AS inline_rows"
# fixed values: styles of lists, words of watermarks
LIST_STYLES = ["List Bullet", "List Bullet 2", "List Bullet 3", "List Number", "List Number 2", "List Number 3", "List Paragraph"]
WATERMARKS = "WORKING COPY|DRAFT|CONFIDENTIAL|DO NOT DISTRIBUTE|WATERMARK"
IN_LISTS = "style IN (" + ", ".join(f"'{s}'" for s in LIST_STYLES) + ")"


@query("s08_paragraph_kinds", f"""
SELECT n, CASE WHEN level IS NOT NULL THEN 'heading' WHEN {IN_LISTS} OR numbering IS NOT NULL THEN CASE WHEN contains(style, 'Number') OR numbering IS NOT NULL THEN 'numbered_step' ELSE 'list_item' END ELSE 'paragraph' END AS kind, CAST(level AS INT) AS level
FROM (SELECT *, CASE WHEN style = 'Title' THEN 1 WHEN regexp_matches(style, '^Heading [1-6]$') THEN CAST(right(style, 1) AS INT) WHEN NOT {IN_LISTS} THEN CAST(outline AS INT) + 1 END AS level FROM {PARAGRAPHS})
WHERE trim(txt) <> '' AND NOT regexp_matches(upper(txt || '|' || CASE WHEN contains(upper(style), 'WATERMARK') THEN 'WATERMARK' ELSE '' END), '{WATERMARKS}')""")
def paragraph_kinds(spark, sf_dir):
    """Paragraphs as headings with level, list items, numbered steps or plain; watermarks and blank ones go."""
    p = derived(spark, sf_dir, PARAGRAPHS).withColumn("outline", F.col("outline").cast("int"))
    listed, numbered = F.col("style").isin(LIST_STYLES), F.col("numbering").isNotNull()
    styled = F.regexp_extract("style", "^Heading ([1-6])$", 1)
    level = F.when(F.col("style") == "Title", 1).when(styled != "", F.try_to_number(styled, F.lit("9")).cast("int")).when(~listed, F.col("outline") + 1)
    marked = F.upper("txt").rlike(WATERMARKS) | F.upper("style").contains("WATERMARK")
    kind = F.when(F.col("level").isNotNull(), "heading").when(numbered | (listed & F.col("style").contains("Number")), "numbered_step").when(listed, "list_item").otherwise("paragraph")
    return p.where((F.trim("txt") != "") & ~marked).withColumn("level", level).select("n", kind.alias("kind"), "level")


TOKENS = "(SELECT 'k' || o_orderkey AS token, CASE WHEN o_custkey % 9 > 0 THEN 'f' || o_custkey END AS family, CASE WHEN o_orderstatus = 'F' THEN '' || o_orderdate END AS revoked_at FROM orders) AS inline_rows"


@query("p04_live_tokens", f"SELECT family, count(*) AS live FROM {TOKENS} WHERE revoked_at IS NULL GROUP BY family")
def live_tokens(spark, sf_dir):
    """Only rows that the partial index covers: not revoked."""
    return derived(spark, sf_dir, TOKENS).where(F.col("revoked_at").isNull()).groupBy("family").agg(F.count("*").alias("live"))


@query("p15_renamed_keys", "SELECT n_nationkey AS id, n_name AS title, n_regionkey AS region_id FROM nation")
def renamed_keys(spark, sf_dir):
    """Stored keys under the names that readers see."""
    names = {"n_nationkey": "id", "n_name": "title", "n_regionkey": "region_id"}
    return table(spark, sf_dir, "nation").select(*names).withColumnsRenamed(names)


TERMS = "(SELECT p_name || CASE WHEN p_size % 3 = 0 THEN ', ' || p_partkey ELSE ' ' || p_partkey END AS source_term, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'das \"' || p_name || '\"' ELSE p_type END AS target_term, CASE WHEN p_size % 5 > 0 THEN p_brand END AS note, p_size % 2 = 0 AS case_sensitive, p_size % 7 = 0 AS do_not_translate FROM part) AS inline_rows"


@query("k05_glossary_lines", """
SELECT list_aggregate(list_transform([source_term, target_term, coalesce(note, ''), CASE WHEN case_sensitive THEN 'yes' ELSE 'no' END, CASE WHEN do_not_translate THEN 'yes' ELSE 'no' END],
 lambda x: CASE WHEN contains(x, ',') OR contains(x, '"') THEN '"' || replace(x, '"', '""') || '"' ELSE x END), 'string_agg', ',') AS line FROM """ + TERMS)
def glossary_lines(spark, sf_dir):
    """Glossary entries as CSV lines (K5); `glossary_lines` of the sources gives the same for a file."""
    return files.glossary_lines(derived(spark, sf_dir, TERMS))


NATION_CHANGES = inline("n_nationkey, n_name", [(1, "Changed"), (3, None), (99, "Nobody")])


@query("p18_updated_rows", f"SELECT n.n_nationkey, coalesce(c.n_name, n.n_name) AS n_name, n_regionkey FROM nation n LEFT JOIN {NATION_CHANGES.replace('inline_rows', 'c')} ON c.n_nationkey = n.n_nationkey")
def updated_rows(spark, sf_dir):
    """Rows updated in allowed columns only."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return records.updated(nation, values(spark, NATION_CHANGES), "n_nationkey", ("n_name", "n_regionkey"))


DUTIES = inline("n, txt", [
    (1, "The Quality Manager informs the Manager."), (2, "QA Manager and Site QA Manager sign."), (3, "The Site QA Manager signs; the QA Manager files."), (4, "Each Head of Quality Control reviews it."), (5, "nobody signs"), (6, None),
    (7, "It goes to the Head of Quality Control."),
])


@query("f13_roles")
def role_phrases(spark, sf_dir):
    """Role phrases, those within longer ones left out unless they stand alone too (F13); known cases in the tests."""
    return values(spark, DUTIES).select("n", F.array_join(S.roles(F.col("txt")), ", ").alias("roles"))


PROFILE = inline("n, body", [
    (1, '{"template_id": "t", "icons": [1], "sections": [{"section_number": " 1 ", "title": "Scope", "required": false, "font_color_hex": "0", "instructions": [{"text": " Say where. ", "directive_type": "", "paragraph_index": 3}, {"text": "Be brief.", "directive_type": "formatting"}]}]}'),
    (2, '{"template_id": "u", "sections": [{"section_number": "2", "section_name": "Roles", "instructions": []}]}'),
])


@query("p17_slim_profiles", f"""
WITH s AS (SELECT n, body->>'template_id' AS template_id, unnest((body->'sections')::JSON[]) AS sec FROM (SELECT n, body::JSON AS body FROM {PROFILE}))
SELECT n, template_id, trim(sec->>'section_number') AS section_number, trim(coalesce(sec->>'title', sec->>'section_name')) AS section_name, coalesce((sec->>'required')::BOOLEAN, true) AS required,
 coalesce(array_to_string(list_transform((sec->'instructions')::JSON[], lambda i: coalesce(nullif(trim(i->>'directive_type'), ''), 'guidance') || ': ' || trim(i->>'text')), '; '), '') AS instructions FROM s""")
def slim_profiles(spark, sf_dir):
    """Template profiles cut down to their instructions; a directive that is missing is guidance."""
    schema = "template_id string, sections array<struct<section_number:string,title:string,section_name:string,required:boolean,instructions:array<struct<text:string,directive_type:string>>>>"
    s = values(spark, PROFILE).select("n", F.from_json("body", schema).alias("p")).select("n", "p.template_id", F.inline("p.sections"))
    told = F.transform("instructions", lambda i: F.concat(F.coalesce(F.nullif(F.trim(i["directive_type"]), F.lit("")), F.lit("guidance")), F.lit(": "), F.trim(i["text"])))
    return s.select("n", "template_id", F.trim("section_number").alias("section_number"), F.trim(F.coalesce("title", "section_name")).alias("section_name"), F.coalesce("required", F.lit(True)).alias("required"), F.coalesce(F.array_join(told, "; "), F.lit("")).alias("instructions"))

"""Queries over joins."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from folium.functions import text as T
from folium.operators import relations as R
from folium.registry import inline, query, table, values


@query("j01_three_way", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal < 0")
def three_way(spark, sf_dir):
    """Inner equi joins over three tables (J1); Catalyst sees the small sides."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.where("c_acctbal < 0").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("j02_first_match", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'P')")
def first_match(spark, sf_dir):
    """A session with its user and role (J2); an order stands for a session."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").orderBy("o_orderkey").limit(1)
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("j03_nested_children", "SELECT o_orderkey, array_to_string(list_sort(list(l_linenumber) FILTER (l_linenumber IS NOT NULL)), ' ') AS lines, count(l_linenumber) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def nested_children(spark, sf_dir):
    """Children as a list of their parent."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("c"), F.count("*").alias("n"))
    both = table(spark, sf_dir, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return both.select("o_orderkey", F.array_join(F.col("c").cast("array<string>"), " ").alias("lines"), F.coalesce("n", F.lit(0)).alias("n"))


@query("j04_trace", """
SELECT DISTINCT o_orderkey AS claim_id, l_suppkey AS unit_id, s_nationkey AS section_id, n_name AS heading FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal >= 0 LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey <> 0""")
def trace(spark, sf_dir):
    """Claims with their cited units and sections (J4, J5): orders cite suppliers, which stand in nations; some of both are unknown."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("unit_ids"))
    claims = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("claim_id"), "unit_ids")
    units = table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("unit_id"), F.col("s_nationkey").alias("section_id"))
    return R.trace(claims, units, table(spark, sf_dir, "nation").where("n_regionkey <> 0").select(F.col("n_nationkey").alias("section_id"), F.col("n_name").alias("heading")))


@query("j06_missing_keys", """
SELECT 'order without customer' AS problem, o_custkey::VARCHAR AS value, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') GROUP BY 2
UNION ALL SELECT 'line without part', l_partkey::VARCHAR, count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 49) GROUP BY 2""")
def missing_keys(spark, sf_dir):
    """Foreign keys that do not resolve, all checks in one list."""
    return R.missing_keys([
        ("order without customer", table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer").where("c_mktsegment != 'BUILDING'"), "c_custkey"),
        ("line without part", table(spark, sf_dir, "lineitem"), "l_partkey", table(spark, sf_dir, "part").where("p_size < 49"), "p_partkey"),
    ])


@query("j08_dangling_to_null", "SELECT d.doc_id, l.doc_id AS label_id FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def dangling_to_null(spark, sf_dir):
    """An optional reference that does not resolve becomes null."""
    l = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_id")).distinct()
    return table(spark, sf_dir, "documents").select("doc_id").join(l, F.col("doc_id") == F.col("label_id"), "left")


@query("j09_in_use", "SELECT p_partkey, count(DISTINCT l_orderkey) AS n_orders, array_to_string((list_sort(list(DISTINCT l_orderkey)))[1:5], ' ') AS first_orders FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_size = 1 GROUP BY p_partkey")
def in_use(spark, sf_dir):
    """Records that cannot go as others use them, with who does."""
    both = table(spark, sf_dir, "part").where("p_size = 1").join(table(spark, sf_dir, "lineitem"), F.col("l_partkey") == F.col("p_partkey"))
    ids = F.slice(F.array_sort(F.collect_set("l_orderkey")), 1, 5)
    return both.groupBy("p_partkey").agg(F.countDistinct("l_orderkey").alias("n_orders"), F.array_join(ids.cast("array<string>"), " ").alias("first_orders"))


@query("j11_first_cited", "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS first_event, count(*) AS n FROM events GROUP BY user_id, event_type")
def first_cited(spark, sf_dir):
    """The first citation of a target within a unit wins."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"), F.count("*").alias("n"))


TARGETS = inline("target_id, name", [(1, "purpose"), (2, "records and forms"), (3, "procedure"), (4, "the erre"), (5, "anin of that")])
TOPIC = "list_distinct(list_filter(string_split(lower(trim(regexp_replace({0}, '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g'))), ' '), lambda w: w <> '' AND w NOT IN " + str(T.STOP_WORDS) + "))"


@query("j19_scored_targets", f"""
WITH h AS (SELECT page_id, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS h FROM pages), a AS (SELECT page_id, {TOPIC.format('h')} AS a FROM h), b AS (SELECT target_id, {TOPIC.format('name')} AS b FROM {TARGETS}),
s AS (SELECT page_id, target_id, len(list_intersect(a, b)) AS same, len(list_distinct(list_concat(a, b))) AS al, least(len(a), len(b)) AS le, greatest(len(a), len(b)) AS mo FROM a, b)
SELECT page_id, target_id, floor(1000 * CASE WHEN al = 0 THEN 0e0 WHEN same = al THEN 1e0 WHEN same = le AND le > 0 THEN 0.55e0 + 0.4e0 * le / mo ELSE 0.4e0 * same / al END) AS score_1000 FROM s""")
def scored_targets(spark, sf_dir):
    """Every section heading scored against the few targets (J19, F17); the targets are a constant list."""
    topics = lambda c: F.array_distinct(F.filter(F.split(T.normal(c), " "), lambda w: (w != "") & ~w.isin(*T.STOP_WORDS)))
    h = table(spark, sf_dir, "pages").select("page_id", topics(F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1)).alias("a"))
    t = values(spark, TARGETS).select("target_id", topics("name").alias("b"))
    return h.crossJoin(F.broadcast(t)).select("page_id", "target_id", F.floor(1000 * R.name_score(F.col("a"), F.col("b"))).cast("double").alias("score_1000"))


@query("j20_issue_sections", "SELECT l.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'label' END, CASE WHEN d.lang = 'en' THEN d.source END, d.lang) AS section FROM labels l JOIN documents d USING (doc_id)")
def issue_sections(spark, sf_dir):
    """An issue's section: its own, else its claims', else its units' (J20)."""
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return both.select("doc_id", F.coalesce(F.when(F.col("toxic") == 1, F.lit("label")), F.when(F.col("lang") == "en", F.col("source")), "lang").alias("section"))


@query("j21_carried_over", "SELECT md5(d.text) AS issue, min(d.doc_id) AS doc_id, max(l.quality) AS resolution FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.text")
def carried_over(spark, sf_dir):
    """Findings keep the resolution that their signature had before."""
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return both.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("quality").alias("resolution")).select(F.md5("text").alias("issue"), "doc_id", "resolution")


@query("j22_exactly_once", "SELECT count(*) AS n_rows, count(*) FILTER (l.doc_id IS NULL) AS without, count(*) FILTER (d.doc_id IS NULL) AS unknown FROM documents d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def exactly_once(spark, sf_dir):
    """Segments and their translations: what lacks one, what is unknown."""
    l = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_id")).distinct()
    both = table(spark, sf_dir, "documents").select("doc_id").join(l, F.col("doc_id") == F.col("l_id"), "full")
    return both.agg(F.count("*").alias("n_rows"), F.count_if(F.col("l_id").isNull()).alias("without"), F.count_if(F.col("doc_id").isNull()).alias("unknown"))


@query("j23_draft_diff", """
WITH a AS (SELECT conv_id AS k, string_agg(text, '|' ORDER BY turn) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id), b AS (SELECT conv_id AS k, string_agg(text, '|' ORDER BY turn) AS t FROM conversations WHERE role = 'user' OR length(text) < 200 GROUP BY conv_id)
SELECT * FROM (SELECT coalesce(a.k, b.k) AS conv_id, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.t <> b.t THEN 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k) WHERE change IS NOT NULL""")
def draft_diff(spark, sf_dir):
    """Changed, added and removed between two versions (J23): what users say, and that with short answers."""
    c = table(spark, sf_dir, "conversations")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "|").alias("t")
    return R.diff(c.where("role = 'user'").groupBy("conv_id").agg(joined), c.where("role = 'user' OR length(text) < 200").groupBy("conv_id").agg(joined), "conv_id", ["t"])


GLOSSARY = "(SELECT DISTINCT regexp_extract(lower(text), '[a-zà-ÿ]{4,}', 0) AS term FROM benchmark)"


@query("j26_glossary_hits", f"""
SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(lower(text), '[a-zà-ÿ]+'), lambda w: CASE WHEN length(w) > 3 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, length(w) - 1) ELSE w END)) AS w FROM documents) JOIN {GLOSSARY} ON w = term GROUP BY ALL""")
def glossary_hits(spark, sf_dir):
    """Glossary terms, plural forms too, found by an equi join on tokens (J26); the first longer word of each benchmark item is a term."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]+"), F.lit(0))).alias("w"))
    plural = (F.length("w") > 3) & F.col("w").endswith("s") & ~F.col("w").endswith("ss")
    w = w.select("doc_id", F.when(plural, F.expr("left(w, length(w) - 1)")).otherwise(F.col("w")).alias("term"))
    terms = table(spark, sf_dir, "benchmark").select(F.regexp_extract(F.lower("text"), "[a-zà-ÿ]{4,}", 0).alias("term")).distinct()
    return w.join(terms, "term").groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query("j27_contained_needles", r"""
WITH b AS (SELECT item_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS t FROM benchmark), d AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents)
SELECT item_id, count(*) AS n_docs, min(doc_id) AS first_doc FROM b JOIN d ON b.t <> '' AND contains(' ' || d.t || ' ', ' ' || b.t || ' ') GROUP BY item_id""")
def contained_needles(spark, sf_dir):
    """Golden phrases that a text contains, words normalised."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("needle"))
    found = R.contained(table(spark, sf_dir, "documents").select("doc_id", "text"), items, "doc_id", "item_id")
    return found.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))



@query("p02_status_in", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('P', 'O')")
def status_in(spark, sf_dir):
    """Status in a list; an empty list gives no row."""
    wanted = ["P", "O"]
    o = table(spark, sf_dir, "orders")
    o = o.where(F.col("o_orderstatus").isin(wanted)) if wanted else o.limit(0)
    return o.select("o_orderkey")


@query("p03_case_insensitive", "SELECT a.doc_id, b.n FROM documents a JOIN (SELECT lower(text) AS t, count(*) AS n FROM documents GROUP BY 1) b ON lower(a.text) = b.t")
def case_insensitive(spark, sf_dir):
    """How many documents have each one's text, whatever the case of letters."""
    d = table(spark, sf_dir, "documents").withColumn("t", F.lower("text"))
    return d.select("doc_id", "t").join(d.groupBy("t").agg(F.count("*").alias("n")), "t").select("doc_id", "n")


@query("p05_domain_checks", "SELECT o_orderkey, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'status' WHEN o_totalprice < 1000 THEN 'price' END AS problem FROM orders WHERE o_orderstatus NOT IN ('O', 'F') OR o_totalprice < 1000")
def domain_checks(spark, sf_dir):
    """Rows outside their domains, to quarantine (P5)."""
    problem = F.when(~F.col("o_orderstatus").isin("O", "F"), "status").when(F.col("o_totalprice") < 1000, "price")
    return table(spark, sf_dir, "orders").select("o_orderkey", problem.alias("problem")).where("problem is not null")


@query("p07_substantive", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents), f AS (SELECT doc_id, t, length(t) >= 60 AS s, bool_or(length(t) >= 60) OVER (PARTITION BY doc_id) AS some_s FROM l WHERE trim(t) <> '')
SELECT doc_id, count(*) AS n FROM f WHERE s OR NOT some_s GROUP BY doc_id""")
def substantive(spark, sf_dir):
    """Substantive lines of each document, or all that are not blank where none is."""
    l = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("t")).where("trim(t) != ''")
    s = F.length("t") >= 60
    l = l.select("doc_id", s.alias("s"), F.bool_or(s).over(Window.partitionBy("doc_id")).alias("some_s"))
    return l.where("s or not some_s").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("f18_vector_cosine", "SELECT a.vec_id AS a, b.vec_id AS b, floor(10000 * list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND a.label = b.label")
def vector_cosine(spark, sf_dir):
    """Cosine of neighbours."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b"), "label", F.col("v").alias("w"))
    return e.join(b, ["vec_id", "label"]).select(F.col("vec_id").alias("a"), "b", F.floor(10000 * R.cosine(F.col("v"), F.col("w"))).cast("double").alias("cos"))

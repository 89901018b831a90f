"""Queries over graphs, trees, coverage, layout and patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import coverage as cv
from ..operators import graph as gr
from ..operators import layout as ly
from ..operators import patch as pt
from ..operators import tree as tr
from .catalog_text import BLOCKS, blocks
from .registry import query, table

#: A tree of four levels from the driver tables: world, regions, nations, customers and suppliers.
TREE = """tree AS (SELECT 'w' AS id, CAST(NULL AS VARCHAR) AS parent, 'WORLD' AS name, 0 AS pos UNION ALL SELECT 'r' || r_regionkey, 'w', r_name, r_regionkey FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, n_nationkey FROM nation
        UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name, CAST(c_custkey AS INTEGER) FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name, CAST(s_suppkey AS INTEGER) FROM supplier)"""


def tree(spark, d) -> DataFrame:
    def part(t, prefix, key, up, parent, name):
        df = table(spark, d, t)
        above = F.concat(F.lit(up), F.col(parent).cast("string")) if parent else F.lit(up)
        return df.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), above.alias("parent"), F.col(name).alias("name"), F.col(key).cast("int").alias("pos"))

    root = spark.createDataFrame([("w", None, "WORLD", 0)], "id string, parent string, name string, pos int")
    levels = [part("region", "r", "r_regionkey", "w", None, "r_name"), part("nation", "n", "n_nationkey", "r", "n_regionkey", "n_name"), part("customer", "c", "c_custkey", "n", "c_nationkey", "c_name"), part("supplier", "s", "s_suppkey", "n", "s_nationkey", "s_name")]
    for x in levels:
        root = root.unionByName(x)
    return root


@query(f"WITH RECURSIVE {TREE}, t AS (SELECT id, parent, 0 AS depth, id AS root FROM tree WHERE parent IS NULL UNION ALL SELECT c.id, c.parent, t.depth + 1, t.root FROM tree c JOIN t ON c.parent = t.id) SELECT id, parent, name, pos, depth, root FROM tree JOIN t USING (id, parent) UNION ALL SELECT 'w', NULL, 'WORLD', 0, 0, 'w'")
def tree_depth(spark, d):
    """Depth and root of each node."""
    return tr.ancestors_to_root(tree(spark, d))


@query(f"""WITH {TREE}, out AS (SELECT parent, count(*) AS n FROM tree WHERE parent IS NOT NULL GROUP BY 1)
    SELECT (SELECT count(*) FROM tree) AS node_count, greatest((SELECT count(*) FROM tree) - 150, 0) AS budget_excess, (SELECT count(*) FROM tree) - 1 AS edge_count, 1 AS root_count, 0 AS multi_parent_count, 0 AS unreachable_count, 3 AS max_depth,
    (SELECT count(*) FROM out WHERE n > CASE WHEN parent = 'w' THEN 8 ELSE 12 END) AS fanout_violations, (SELECT coalesce(CAST(sum(c - 1) AS BIGINT), 0) FROM (SELECT count(*) AS c FROM tree GROUP BY lower(name))) AS duplicate_labels, 0 AS invalid_edges, TRUE AS topology_valid,
    array_to_string(list_filter([CASE WHEN (SELECT count(*) FROM out WHERE n > CASE WHEN parent = 'w' THEN 8 ELSE 12 END) > 0 THEN 'fanout' END, CASE WHEN (SELECT count(*) FROM tree) > 150 THEN 'node_budget' END], lambda x: x IS NOT NULL), ',') AS failures""")
def tree_validation(spark, d):
    """Counts of what keeps the tree from being one, and the gates that fail."""
    t = tree(spark, d)
    edges = t.where("parent is not null").select(F.col("parent").alias("source"), F.col("id").alias("target"))
    return tr.gate_failures(tr.validate(t.select("id", "name"), edges))


@query(f"WITH {TREE}, p AS (SELECT id, parent, name, pos, length(name) + pos AS score FROM tree WHERE parent IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY score DESC, id) - 1 AS position FROM p) SELECT * FROM r WHERE position < 3")
def topk_children(spark, d):
    """The first three children of each node."""
    return tr.children(tree(spark, d).withColumn("score", F.length("name") + F.col("pos")), 3)


@query(f"WITH {TREE} SELECT parent, count(*) AS children FROM tree WHERE parent IS NOT NULL GROUP BY parent HAVING count(*) > CASE WHEN parent = 'w' THEN 4 ELSE 12 END")
def fanout_violations(spark, d):
    """Nodes with too many children."""
    n = tree(spark, d).where("parent is not null").groupBy("parent").agg(F.count("*").alias("children"))
    return n.where(F.col("children") > F.when(F.col("parent") == "w", 4).otherwise(12))


_PATHS = f"""WITH RECURSIVE {TREE}, s AS (SELECT *, lpad(CAST(row_number() OVER (PARTITION BY parent ORDER BY pos, id) - 1 AS VARCHAR), 8, '0') AS step FROM tree), t AS (SELECT id, 0 AS depth, step AS path FROM s WHERE parent IS NULL UNION ALL SELECT s.id, t.depth + 1, t.path || '.' || s.step FROM s JOIN t ON s.parent = t.id)"""


@query(_PATHS + " SELECT tree.*, depth, path FROM tree JOIN t USING (id)")
def tree_preorder(spark, d):
    """Paths that sort the tree in pre-order."""
    return tr.preorder(tree(spark, d))


@query(_PATHS + ", sz AS (SELECT a.id, a.depth, count(*) AS size FROM t a JOIN t b ON b.path = a.path OR starts_with(b.path, a.path || '.') GROUP BY ALL) SELECT * FROM sz")
def subtree_sizes(spark, d):
    """Nodes below each node."""
    return tr.subtree_sizes(tree(spark, d))


@query(_PATHS + """, v AS (SELECT *, row_number() OVER (ORDER BY depth, path) AS r FROM t), u AS (SELECT * FROM v WHERE r <= 60), h AS (SELECT v.id, max_by(u.id, u.depth) AS shown FROM v JOIN u ON starts_with(v.path, u.path || '.') WHERE v.r > 60 GROUP BY v.id)
    SELECT u.id, u.depth, coalesce(n, 0) AS hidden FROM u LEFT JOIN (SELECT shown, count(*) AS n FROM h GROUP BY 1) ON shown = u.id""")
def collapsed_tree(spark, d):
    """The tree in sixty nodes; a limit that is the feature."""
    return tr.collapse(tree(spark, d), 60)


@query("""SELECT o_orderkey, round(greatest(0, least(0.5 * s + 0.5 * CASE WHEN a > 0 AND b > 0 THEN (a + b) / 2 WHEN a > 0 THEN a WHEN b > 0 THEN b ELSE s END - 0.25 * p + CASE o_orderstatus WHEN 'F' THEN 0.08 WHEN 'O' THEN -0.12 ELSE -0.5 END, 1)), 4) AS score
    FROM (SELECT o_orderkey, o_orderstatus, (o_orderkey % 8) / 8.0::DOUBLE AS s, (o_custkey % 4) / 4.0::DOUBLE AS a, (o_orderkey % 4) / 4.0::DOUBLE AS b, (o_orderkey % 2) / 2.0::DOUBLE AS p FROM orders)""")
def parent_scores(spark, d):
    """Combined scores of parent candidates."""
    o = table(spark, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "direct_parent").when(F.col("o_orderstatus") == "O", "ancestor_only").otherwise("uncertain")
    score = gr.parent_score((F.col("o_orderkey") % 8) / 8.0, [(F.col("o_custkey") % 4) / 4.0, (F.col("o_orderkey") % 4) / 4.0], [(F.col("o_orderkey") % 2) / 2.0], kind)
    return o.select("o_orderkey", score.alias("score"))


def _links(spark, d):
    """Supplier to part links with a score, as candidates of parents."""
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("parent"), F.col("l_partkey").alias("child"), (F.col("l_quantity") / 50).alias("score"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), (F.col("l_returnflag") == "N").alias("provisional"))


_LINKS = "links AS (SELECT l_suppkey AS parent, l_partkey AS child, l_quantity / 50 AS score, l_orderkey * 8 + l_linenumber AS seq, l_returnflag = 'N' AS provisional FROM lineitem)"


@query(f"WITH {_LINKS} SELECT parent, child, max(score) AS score FROM links GROUP BY ALL")
def best_pairs(spark, d):
    """The best candidate of each pair."""
    return gr.best_per_pair(_links(spark, d), "seq").select("parent", "child", "score")


@query(f"""WITH {_LINKS}, g AS (SELECT child, parent, score, provisional FROM (SELECT child, parent, max(score) AS score, bool_or(provisional) AS provisional FROM links GROUP BY ALL)),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY child ORDER BY score DESC, parent) AS r FROM g WHERE NOT provisional) WHERE r <= 3), s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY child ORDER BY score DESC, parent) AS r FROM g WHERE provisional) WHERE r = 1)
    SELECT 's' || parent AS parent, 'p' || child AS child, score, provisional FROM f UNION ALL SELECT 's' || parent, 'p' || child, score, provisional FROM s UNION ALL
    SELECT 's0', 'p' || p_partkey, 0.12, TRUE FROM part WHERE p_partkey NOT IN (SELECT child FROM g) UNION ALL SELECT 's0', 's' || s_suppkey, 0.12, TRUE FROM supplier WHERE s_suppkey <> 0""")
def ranked_parents(spark, d):
    """Three formal parents per child, the best provisional one, the root where there is none."""
    g = _links(spark, d).groupBy(F.concat(F.lit("s"), F.col("parent").cast("string")).alias("parent"), F.concat(F.lit("p"), F.col("child").cast("string")).alias("child")).agg(F.max("score").alias("score"), F.bool_or("provisional").alias("provisional"), F.min("seq").alias("seq"))
    # ranks go by number, not by text
    g = g.withColumn("n", F.substring("parent", 2, 20).cast("long"))
    p = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.lit(False).alias("is_root"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), (F.col("s_suppkey") == 0).alias("is_root"))
    return gr.ranked_parents(g, p.unionByName(s), tie="n")


@query("""WITH n AS (SELECT p_partkey AS id, p_brand || p_type AS b, p_name || p_type AS name, p_type AS definition, CASE p_size % 5 WHEN 0 THEN 'branch_topic' WHEN 1 THEN 'concept' WHEN 2 THEN 'method' WHEN 3 THEN 'step' ELSE 'example' END AS role, CASE WHEN p_size % 7 = 0 THEN 'structural' ELSE 'explicit' END AS origin, p_size / 64.0::DOUBLE AS confidence, lower(regexp_replace(p_name || p_type, '\\s+', '', 'g')) AS k FROM part),
    s AS (SELECT *, list_distinct(list_transform(range(1, length(k)), lambda i: substr(k, CAST(i AS INTEGER), 2))) AS s FROM n),
    j AS (SELECT p.id AS parent_id, c.id AS child_id, round(greatest(0, least(greatest(0, least(1, CASE p.role || '>' || c.role WHEN 'branch_topic>concept' THEN 0.64 WHEN 'branch_topic>method' THEN 0.62 WHEN 'branch_topic>example' THEN 0.5 WHEN 'concept>example' THEN 0.58 WHEN 'method>step' THEN 0.7 WHEN 'method>example' THEN 0.58 ELSE 0.24 END + CASE WHEN p.origin = 'structural' THEN 0.12 ELSE 0 END - CASE WHEN p.role IN ('example', 'step') THEN 0.2 ELSE 0 END))
        + 0.14 + CASE WHEN contains(lower(c.name || ' ' || c.definition), lower(p.name)) THEN 0.16 ELSE 0 END + 0.08 * len(list_intersect(p.s, c.s)) / len(list_distinct(list_concat(p.s, c.s))) + CASE WHEN p.confidence >= c.confidence THEN 0.03 ELSE 0 END, 0.92)), 4) AS score
        FROM s p JOIN s c ON p.b = c.b AND p.id <> c.id WHERE (p.role = 'branch_topic' OR p.origin = 'structural') AND c.role <> 'branch_topic'),
    r AS (SELECT *, row_number() OVER (PARTITION BY child_id ORDER BY score DESC, parent_id) AS rank FROM j WHERE score >= 0.28) SELECT * FROM r WHERE rank <= 4""")
def suggested_parents(spark, d):
    """Parents suggested within a branch (parts of a brand and type)."""
    p = table(spark, d, "part")
    k = F.col("p_size") % 5
    role = F.when(k == 0, "branch_topic").when(k == 1, "concept").when(k == 2, "method").when(k == 3, "step").otherwise("example")
    n = p.select(F.col("p_partkey").alias("node_id"), F.concat("p_brand", "p_type").alias("branch_id"), F.concat("p_name", "p_type").alias("name"), F.col("p_type").alias("definition"), role.alias("role"), F.when(F.col("p_size") % 7 == 0, "structural").otherwise("explicit").alias("origin"), F.lit(False).alias("is_root"), (F.col("p_size") / 64.0).alias("confidence"))
    return gr.suggest_parents(n)


_VOTES = "votes AS (SELECT l_partkey AS child, l_suppkey AS parent, CASE l_returnflag WHEN 'R' THEN 'direct_parent' ELSE 'sibling' END AS classification, l_quantity AS score FROM lineitem)"


def _votes(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("child"), F.col("l_suppkey").alias("parent"), F.when(F.col("l_returnflag") == "R", "direct_parent").otherwise("sibling").alias("classification"), F.col("l_quantity").alias("score"), "l_linenumber")


@query(f"WITH {_VOTES} SELECT child, parent, CASE WHEN count(DISTINCT classification) = 1 THEN min(classification) ELSE 'uncertain' END AS classification, round(CASE WHEN count(DISTINCT classification) = 1 THEN avg(score) ELSE min(score) END, 4) AS score, count(*) AS n_votes FROM votes GROUP BY child, parent")
def vote_consensus(spark, d):
    """Votes on a pair as one."""
    return gr.consensus(_votes(spark, d))


@query("""WITH g AS (SELECT l_partkey AS child, l_suppkey AS parent, max(l_quantity) / 64 AS score FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS second FROM g WINDOW w AS (PARTITION BY child ORDER BY score DESC, parent))
    SELECT child, parent, score, round(score - coalesce(second, 0), 6) AS lead, score < 0.78 OR round(score - coalesce(second, 0), 6) < 0.15 AS "check" FROM r WHERE r = 1""")
def verification_needs(spark, d):
    """Children whose best parent needs a second look."""
    g = _votes(spark, d).groupBy("child", "parent").agg((F.max("score") / 64).alias("score"))
    return gr.needs_check(g)


@query("""WITH v AS (SELECT o_custkey AS child, o_orderkey AS parent, o_orderstatus AS c, (o_orderkey % 16) / 16.0::DOUBLE AS s FROM orders)
    SELECT a.child, a.parent, CASE WHEN a.parent % 5 = 0 THEN 'Z' WHEN a.parent % 2 = 1 OR a.c = 'F' THEN a.c ELSE 'uncertain' END AS classification, round(CASE WHEN a.parent % 5 = 0 THEN 0.5 WHEN a.parent % 2 = 1 THEN a.s WHEN a.c = 'F' THEN (a.s + 0.25) / 2 ELSE least(a.s, 0.25) END, 4) AS score FROM v a""")
def arbitrated_votes(spark, d):
    """Two votes and an arbiter per pair."""
    v = table(spark, d, "orders").select(F.col("o_custkey").alias("child"), F.col("o_orderkey").alias("parent"), F.col("o_orderstatus").alias("classification"), ((F.col("o_orderkey") % 16) / 16.0).alias("score"))
    second = v.where("parent % 2 = 0").withColumns({"classification": F.lit("F"), "score": F.lit(0.25)})
    third = v.where("parent % 5 = 0").withColumns({"classification": F.lit("Z"), "score": F.lit(0.5)})
    return gr.settled_votes(v, second, third)


@query("""WITH l AS (SELECT l_suppkey AS source, l_partkey % 40 AS target, l_linestatus AS relation, max(l_quantity / 50) AS score, bool_or(l_discount > 0.09) AS e FROM lineitem WHERE l_suppkey <> l_partkey % 40 GROUP BY ALL),
    k AS (SELECT *, source < 35 AND target < 35 AS known FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY source, known AND score >= 0.7 AND e ORDER BY score DESC, target, relation) AS n FROM k)
    SELECT source, target, relation, score, CASE WHEN NOT known THEN 'unknown_end' WHEN score < 0.7 THEN 'low_score' WHEN NOT e THEN 'review' WHEN n <= 2 THEN 'selected' ELSE 'over_limit' END AS state FROM r""")
def cross_links(spark, d):
    """What becomes of each cross link."""
    li = table(spark, d, "lineitem")
    g = li.groupBy(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 40).alias("target"), F.col("l_linestatus").alias("relation")).agg(F.max(F.col("l_quantity") / 50).alias("score"), F.bool_or(F.col("l_discount") > 0.09).alias("has_evidence"))
    return gr.cross_links(g, spark.range(35).select("id"))


@query("""WITH i AS (SELECT user_id AS id, event_type AS scope, min(CASE WHEN value > 400 THEN 1 WHEN value > 300 THEN 2 WHEN value > 100 THEN 3 ELSE 4 END) AS sev FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sev, scope) AS r FROM i) SELECT id, scope, CAST(sev AS INTEGER) AS sev FROM r WHERE r = 1 ORDER BY sev, scope, id LIMIT 36""")
def worst_issues(spark, d):
    """The worst report of each issue; the limit is the feature."""
    v = F.col("value")
    sev = F.when(v > 400, "critical").when(v > 300, "major").when(v > 100, "minor").otherwise("info")
    return gr.aggregate_issues(table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("scope"), sev.alias("severity"))).select("id", "scope", F.col("sev").cast("int"))


@query("""WITH l AS (SELECT user_id AS id, max_by(event_type, event_id) AS decision FROM events WHERE event_id % 3 = 0 GROUP BY 1) SELECT c_custkey AS id, c_mktsegment AS severity, coalesce(decision, 'none') AS decision FROM customer LEFT JOIN l ON id = c_custkey WHERE decision IS NULL OR decision <> 'accept'""")
def unresolved_issues(spark, d):
    """Issues without an accepted decision."""
    i = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("severity"))
    return gr.unresolved(i, table(spark, d, "events").where("event_id % 3 = 0").select(F.col("user_id").alias("issue_id"), F.col("event_type").alias("decision"), F.col("event_id").alias("seq")))


@query("""SELECT p_partkey AS idx, p_name AS name, CASE WHEN lower(p_name) = 'red ring' THEN 3 WHEN starts_with(lower(p_name), 'red ring') THEN 2 ELSE 1 END AS match FROM part WHERE contains(lower(p_name), 'red ring')""")
def ranked_matches(spark, d):
    """Names that match a query."""
    return gr.rank_matches(table(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("name")), "red ring")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1) // 2 AS batch FROM lineitem")
def vote_batches(spark, d):
    """Lines of an order in batches of two."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return gr.batches(li, "l_orderkey", [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_quantity")], 2)


@query("""WITH u AS (SELECT l_orderkey AS id, list_distinct(list(l_suppkey)) AS u FROM lineitem GROUP BY 1), e AS (SELECT o_orderkey AS parent, o_orderkey + 1 AS child FROM orders), j AS (SELECT parent, child, list_sort(coalesce(list_intersect(a.u, b.u), [])) AS s FROM e LEFT JOIN u a ON a.id = parent LEFT JOIN u b ON b.id = child)
    SELECT parent, child, CAST(len(s) AS INTEGER) AS n_shared, array_to_string(s[1:4], ',') AS shared FROM j""")
def shared_support(spark, d):
    """Units that support both ends of an edge."""
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("parent"), (F.col("o_orderkey") + 1).alias("child"))
    return gr.shared_support(e, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("unit_id")))


@query()
def greedy_trees(spark, d):
    """One tree per customer over the orders, by greedy picks."""
    o = table(spark, d, "orders")
    first = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    n = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("seq"), (first == 1).alias("is_root"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = o.withColumn("ups", F.array(F.lag("o_orderkey", 1).over(w), F.lag("o_orderkey", 3).over(w)))
    c = o.select(F.col("o_custkey").alias("doc_id"), F.explode("ups").alias("parent"), F.col("o_orderkey").cast("string").alias("child"), ((F.col("o_orderkey") * 7 % 10) / 10).alias("score")).where("parent is not null").withColumn("parent", F.col("parent").cast("string"))
    return tr.greedy_tree(n, c, 2, 3)


@query(f"""WITH {TREE}, e AS (SELECT parent AS source, id AS target, (pos % 10) / 10.0::DOUBLE AS score FROM tree WHERE parent IS NOT NULL)
    SELECT source, target, score, FALSE AS provisional FROM e WHERE source <> 'r1' AND target <> 'r1' UNION ALL SELECT 'w', target, round(0.8 * least((SELECT score FROM e WHERE target = 'r1'), score), 4), TRUE FROM e WHERE source = 'r1'""")
def deleted_node(spark, d):
    """Edges after an inner node is deleted."""
    t = tree(spark, d)
    e = t.where("parent is not null").select(F.col("parent").alias("source"), F.col("id").alias("target"), ((F.col("pos") % 10) / 10.0).alias("score"), F.lit(False).alias("provisional"))
    return tr.delete_node(t, e, "r1")[1]


@query("""WITH u AS (SELECT doc_id AS id, lang, n_chars / 1000.0::DOUBLE AS importance FROM documents), c AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1)
    SELECT lang, count(*) AS units, count(doc_id) AS covered, round(coalesce(sum(importance) FILTER (doc_id IS NOT NULL), 0) / sum(importance), 4) AS weighted FROM u LEFT JOIN c ON doc_id = id GROUP BY lang""")
def weighted_coverage(spark, d):
    """Covered share of the importance per language."""
    u = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", (F.col("n_chars") / 1000.0).alias("importance"))
    return cv.coverage(u, table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id")), ["lang"])


@query("""SELECT d.doc_id AS id, CASE WHEN n_chars < 100 THEN 'rejected' ELSE 'uncovered' END AS was, CASE WHEN n_chars < 100 THEN 'rejected' WHEN l.doc_id IS NOT NULL THEN 'covered' WHEN n_chars < 700 THEN 'deferred' ELSE 'uncovered' END AS status FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def audited_units(spark, d):
    """Status of units after the audit."""
    u = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("n_chars") < 100, "rejected").otherwise("uncovered").alias("status"), (F.col("n_chars") / 1000).alias("importance"))
    return cv.audit(u, table(spark, d, "labels").select(F.col("doc_id").alias("id")))


@query(f"""WITH {BLOCKS}, e AS (SELECT doc_id * 100000 + ordinal AS id, doc_id + ordinal % 2 AS unit_id, text AS excerpt FROM blocks),
    f AS (SELECT e.*, lower(regexp_replace(text, '\\s+', '', 'g')) AS t, lower(regexp_replace(excerpt, '\\s+', '', 'g')) AS x FROM e JOIN documents ON doc_id = unit_id)
    SELECT id, unit_id, excerpt FROM f WHERE x <> '' AND contains(t, x)""")
def matched_evidence(spark, d):
    """Evidence whose unit holds its excerpt: each block, cited by turns from its own document and from the next."""
    e = blocks(spark, d).select((F.col("doc_id") * 100000 + F.col("ordinal")).alias("id"), (F.col("doc_id") + F.col("ordinal") % 2).alias("unit_id"), F.col("text").alias("excerpt"))
    return cv.evidence_matches(e, table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), "text"), ["text"]).select("id", "unit_id", "excerpt")


@query()
def stratified_sample(spark, d):
    """Units round-robin over sources, far ones first; a sampling operator."""
    return cv.stratified(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 64)


@query("""WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id, array_to_string(list_distinct(list_transform(range(0, least(n, 5)), lambda i: CAST(CASE WHEN (i * (n - 1)) % greatest(least(n, 5) - 1, 1) * 2 = greatest(least(n, 5) - 1, 1) THEN 2 * round((i * (n - 1)) / greatest(least(n, 5) - 1, 1) / 2) ELSE round((i * (n - 1)) / greatest(least(n, 5) - 1, 1)) END AS INTEGER) + 1)), ',') AS picks FROM n WHERE n <= 5 OR TRUE""".replace("list_distinct(list_transform", "list_sort(list_distinct(list_transform").replace("+ 1)), ',')", "+ 1))), ',')").replace(" WHERE n <= 5 OR TRUE", ""))
def even_pages(spark, d):
    """Five evenly spaced positions of each user's events."""
    n = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", F.array_join(F.array_sort(cv.even_positions(F.col("n"), 5)), ",").alias("picks"))


@query()
def balanced_leaves(spark, d):
    """Contiguous parts of each customer's orders, priorities as pages."""
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("branch"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("seq"), F.floor(F.col("o_orderkey") / 3).alias("page"), (F.col("o_totalprice") / 1e5).alias("weight"))
    return cv.balanced_parts(o, 6, 12.0)


@query("""WITH t AS (SELECT l_suppkey AS topic, round(avg(l_quantity), 2) AS confidence, count(*) AS n_support FROM lineitem GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, n_support DESC, topic) AS place FROM t)
    SELECT l_partkey AS unit, min_by(topic, place) AS topic FROM lineitem JOIN p ON topic = l_suppkey WHERE place <= 8 GROUP BY 1""")
def claimed_units(spark, d):
    """Each unit goes to the best topic that claims it."""
    li = table(spark, d, "lineitem")
    t = li.groupBy(F.col("l_suppkey").alias("topic")).agg(F.round(F.avg("l_quantity"), 2).alias("confidence"), F.count("*").alias("n_support"))
    return cv.claims(t, li.select(F.col("l_suppkey").alias("topic"), F.col("l_partkey").alias("unit")).distinct())


@query("""WITH p AS (SELECT user_id, event_id AS "at", event_type AS plan FROM events WHERE event_id % 4 = 0), q AS (SELECT user_id, event_id AS "at", event_id AS id FROM events WHERE event_id % 4 <> 0),
    b AS (SELECT q.*, p."at" AS b_at, p.plan AS b_plan FROM q ASOF LEFT JOIN p ON q.user_id = p.user_id AND q."at" >= p."at"), a AS (SELECT b.*, p."at" AS a_at, p.plan AS a_plan FROM b ASOF LEFT JOIN p ON b.user_id = p.user_id AND b."at" <= p."at")
    SELECT id, user_id, "at", CASE WHEN b_at IS NOT NULL AND (a_at IS NULL OR "at" - b_at <= a_at - "at") THEN b_plan ELSE a_plan END AS plan, CASE WHEN b_at IS NOT NULL AND (a_at IS NULL OR "at" - b_at <= a_at - "at") THEN "at" - b_at ELSE a_at - "at" END AS distance FROM a""")
def nearest_plan(spark, d):
    """The plan nearest to each pending unit."""
    e = table(spark, d, "events")
    placed = e.where("event_id % 4 = 0").select("user_id", F.col("event_id").alias("at"), F.col("event_type").alias("plan"))
    return cv.nearest(e.where("event_id % 4 <> 0").select("user_id", F.col("event_id").alias("at"), F.col("event_id").alias("id")), placed, "user_id", "at")


@query("""WITH RECURSIVE c AS (SELECT CAST(l_orderkey AS VARCHAR) AS branch, CAST(l_linenumber AS BIGINT) AS id, list_distinct(list(l_suppkey % 4)) AS units FROM lineitem GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY id) AS n FROM c),
    w AS (SELECT branch, id, n, units AS seen, 1 AS taken, TRUE AS cover FROM o WHERE n = 1
        UNION ALL SELECT o.branch, o.id, o.n, CASE WHEN w.taken < 3 THEN list_distinct(list_concat(w.seen, o.units)) ELSE w.seen END,
            w.taken + CASE WHEN w.taken < 3 AND NOT list_has_all(w.seen, o.units) THEN 1 ELSE 0 END, w.taken < 3 AND NOT list_has_all(w.seen, o.units) FROM w JOIN o ON o.branch = w.branch AND o.n = w.n + 1),
    f AS (SELECT branch, id, cover, row_number() OVER (PARTITION BY branch ORDER BY NOT cover, id) AS place FROM w)
    SELECT branch, id, CASE WHEN cover THEN 'cover' ELSE 'fill' END AS how FROM f WHERE place <= 3""")
def covering_candidates(spark, d):
    """Lines of an order that cover its suppliers."""
    li = table(spark, d, "lineitem")
    c = li.groupBy(F.col("l_orderkey").cast("string").alias("branch"), F.col("l_linenumber").cast("long").alias("id")).agg(F.collect_set(F.col("l_suppkey") % 4).alias("units")).withColumn("rank", F.col("id"))
    return cv.set_cover(c, 3)


@query("""WITH g AS (SELECT source, lang, text, min(doc_id) AS o, max(n_chars) AS i, count(*) AS n FROM documents GROUP BY source, lang, text) SELECT source, lang, max(i) AS importance, CAST(sum(n) AS BIGINT) AS units, substr(string_agg(text, chr(10) ORDER BY o), 1, 400) AS text FROM g GROUP BY source, lang""")
def planning_units(spark, d):
    """Units of a place as one: distinct texts in order, cut to the length of a prompt."""
    u = table(spark, d, "documents").withColumn("importance", F.col("n_chars"))
    return cv.planning_units(u, ["source", "lang"], "doc_id", "text")


@query("""WITH g AS (SELECT source AS h, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, h) AS r, count(*) OVER () AS c FROM g) SELECT CASE WHEN c > 8 AND r > 7 THEN 'other' ELSE h END AS theme, CAST(sum(n) AS BIGINT) AS units, count(*) AS headings FROM r GROUP BY 1""")
def theme_plan(spark, d):
    """The largest sources as themes, and a rest."""
    return cv.theme_plan(table(spark, d, "documents"), F.col("source"))


@query("SELECT l_returnflag AS branch, l_partkey AS key, count(DISTINCT l_suppkey) AS units FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_suppkey) >= 3")
def supported_keys(spark, d):
    """Candidates with enough distinct support."""
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("branch"), F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("unit"))
    return cv.grouped_support(li, 3)


@query("""WITH n AS (SELECT l_orderkey AS id, count(*) AS t FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1) SELECT coalesce(id, o_orderkey) AS id, coalesce(t, 0) AS times FROM n FULL JOIN orders ON o_orderkey = id WHERE coalesce(t, 0) <> 1""")
def partition_faults(spark, d):
    """Orders that the first lines don't hold just once."""
    return cv.partition_faults(table(spark, d, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("id")), table(spark, d, "orders").select(F.col("o_orderkey").alias("id")))


@query("SELECT l_orderkey, round(min(l_discount), 6) AS \"left\", round(min(l_tax), 6) AS top, round(max(l_discount + 0.25), 6) AS \"right\", round(max(l_tax + 0.25), 6) AS bottom, count(*) AS boxes FROM lineitem GROUP BY 1")
def union_boxes(spark, d):
    """The box around the boxes of an order."""
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_discount").alias("left"), F.col("l_tax").alias("top"), (F.col("l_discount") + 0.25).alias("right"), (F.col("l_tax") + 0.25).alias("bottom"))
    return ly.union_box(li, ["l_orderkey"])


@query("""WITH o AS (SELECT o_custkey, o_orderkey, CAST(o_orderkey % 50 AS DOUBLE) AS h FROM orders) SELECT o_custkey, o_orderkey, h, round(coalesce(sum(h + 32) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - (sum(h) OVER (PARTITION BY o_custkey) + 32 * (count(*) OVER (PARTITION BY o_custkey) - 1)) / 2 + h / 2, 6) AS centre FROM o""")
def stacked_centres(spark, d):
    """Centres of stacked boxes."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 50).cast("double").alias("h"))
    return ly.stack_centres(o, "o_custkey", "o_orderkey", "h", 32)


@query("""WITH o AS (SELECT o_custkey, o_orderkey, CAST(o_orderkey % 50 AS DOUBLE) AS h FROM orders), u AS (SELECT *, CASE WHEN sum(h) OVER w + 32 * (count(*) OVER w - 1) > 0.62 * (sum(h) OVER (PARTITION BY o_custkey) + 32 * (count(*) OVER (PARTITION BY o_custkey) - 1)) AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS v FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
    SELECT o_custkey, o_orderkey, h, CASE WHEN max(v) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 THEN 'left' ELSE 'right' END AS side FROM u""")
def split_sides(spark, d):
    """The prefix that fits goes right."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 50).cast("double").alias("h"))
    return ly.split_prefix(o, "o_custkey", "o_orderkey", "h", 0.62, 32)


@query("""SELECT o_orderkey, least(1, 8192 / (1 + o_totalprice / 20), 8192 / (1 + o_custkey * 10.0::DOUBLE), sqrt(16000000 / ((1 + o_totalprice / 20) * (1 + o_custkey * 10.0::DOUBLE)))) AS scale FROM orders""")
def raster_scales(spark, d):
    """Scales that keep a raster within bounds."""
    o = table(spark, d, "orders")
    return o.select("o_orderkey", ly.raster_scale(1 + F.col("o_totalprice") / 20, 1 + F.col("o_custkey") * 10.0).alias("scale"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber * 10000000 + l_extendedprice AS n, l_discount AS l, l_discount + 0.25 AS r, l_tax AS t, l_tax + 0.0625 AS b FROM lineitem), f AS (SELECT *, CASE WHEN least(r, lag(r) OVER w) - greatest(l, lag(l) OVER w) >= 0.1 * least(r - l, lag(r) OVER w - lag(l) OVER w) AND t - lag(b) OVER w BETWEEN -0.03 AND 0.12 THEN 0 ELSE 1 END AS f FROM b WINDOW w AS (PARTITION BY l_orderkey ORDER BY n))
    SELECT l_orderkey, CAST(run AS BIGINT) AS run, round(min(l), 6) AS "left", round(min(t), 6) AS top, round(max(r), 6) AS "right", round(max(b), 6) AS bottom, count(*) AS boxes FROM (SELECT *, sum(f) OVER (PARTITION BY l_orderkey ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM f) GROUP BY l_orderkey, run""")
def merged_continuations(spark, d):
    """Boxes folded into those they continue."""
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 10000000 + F.col("l_extendedprice")).alias("n"), F.col("l_discount").alias("left"), F.col("l_tax").alias("top"), (F.col("l_discount") + 0.25).alias("right"), (F.col("l_tax") + 0.0625).alias("bottom"))
    return ly.merge_continuations(li, ["l_orderkey"], "n")


@query()
def tree_layout(spark, d):
    """Places of the nodes of the tree."""
    return ly.layout(tree(spark, d).withColumns({"tree": F.lit(0).cast("long"), "width": (F.length("name") * 8 + 24).cast("double"), "height": F.lit(40.0)}))


@query("""WITH b AS (SELECT o_custkey AS tree, o_orderkey AS id, o_totalprice / 100 - 42 AS l, o_totalprice / 100 + 42 AS r, o_orderkey % 500 - 32.0::DOUBLE AS t, o_orderkey % 500 + 32.0::DOUBLE AS b FROM orders)
    SELECT x.tree, CAST(x.id AS VARCHAR) AS a, CAST(y.id AS VARCHAR) AS b FROM b x JOIN b y ON x.tree = y.tree AND CAST(x.id AS VARCHAR) < CAST(y.id AS VARCHAR) AND x.l < y.r AND y.l < x.r AND x.t < y.b AND y.t < x.b""")
def layout_violations(spark, d):
    """Boxes of a customer's orders that are too near to each other."""
    boxes = table(spark, d, "orders").select(F.col("o_custkey").alias("tree"), F.col("o_orderkey").cast("string").alias("id"), (F.col("o_totalprice") / 100).alias("x"), (F.col("o_orderkey") % 500).cast("double").alias("y"))
    return ly.violations(boxes.withColumns({"width": F.lit(60.0), "height": F.lit(40.0)}))


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 11 <> 0), n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 10 = 0 THEN 'Y' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 13 <> 0),
    j AS (SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, o.o_orderkey AS a, n.o_orderkey AS b, array_to_string(list_filter([CASE WHEN o.o_orderstatus IS DISTINCT FROM n.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN o.o_orderpriority IS DISTINCT FROM n.o_orderpriority THEN 'o_orderpriority' END], lambda x: x IS NOT NULL), ',') AS f FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey)
    SELECT o_orderkey, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'deleted' ELSE 'changed' END AS effect, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN f ELSE '' END AS fields FROM j WHERE a IS NULL OR b IS NULL OR f <> ''""")
def patch_effects(spark, d):
    """What a patch changed."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    k = F.col("o_orderkey")
    new = o.where(k % 13 != 0).withColumns({"o_orderstatus": F.when(k % 5 == 0, "X").otherwise(F.col("o_orderstatus")), "o_orderpriority": F.when(k % 10 == 0, "Y").otherwise(F.col("o_orderpriority"))})
    return pt.effects(o.where(k % 11 != 0), new, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("""WITH d AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) SELECT coalesce(k, o_orderkey) AS k, CASE WHEN o_orderkey IS NULL THEN 'extra' WHEN n IS NULL THEN 'missing' ELSE 'duplicate' END AS fault FROM d FULL JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 9 <> 0) ON k = o_orderkey WHERE o_orderkey IS NULL OR n IS NULL OR n > 1""")
def decision_faults(spark, d):
    """Issues that don't have just one decision."""
    i = table(spark, d, "orders").where("o_orderkey % 9 <> 0").select(F.col("o_orderkey").alias("k"))
    return pt.decision_faults(i, table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("k")), "k")


@query("""SELECT p_brand, sha256('[' || string_agg('{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '","p_size":' || p_size || '}', ',' ORDER BY p_partkey) || ']') AS digest, count(*) AS n FROM part GROUP BY p_brand""")
def fingerprints(spark, d):
    """Digests of brands."""
    return pt.fingerprint(table(spark, d, "part"), ["p_brand"], "p_partkey", ["p_name", "p_size"])


@query("""WITH own AS (SELECT o_custkey AS k, o_orderstatus AS v, o_orderdate AS t, 0 AS p, o_orderkey FROM orders WHERE o_orderkey % 5 = 0), oth AS (SELECT o_custkey, o_orderstatus, o_orderdate, 1, o_orderkey FROM orders WHERE o_orderkey % 5 = 1), u AS (SELECT k, v, t, p FROM own UNION ALL SELECT * EXCLUDE (o_orderkey) FROM oth), b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p, t, v) AS r FROM u)
    SELECT c_custkey AS k, v, v IS NOT NULL AS hit FROM customer LEFT JOIN (SELECT * FROM b WHERE r = 1) ON k = c_custkey""")
def cache_lookup(spark, d):
    """The first usable cache entry."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("v"), F.col("o_orderdate").alias("created_at"))
    return pt.cached(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), o.where("o_orderkey % 5 = 0"), o.where("o_orderkey % 5 = 1"), "k", "v")


@query(f"WITH {TREE} SELECT id, parent, name, pos, row_number() OVER (PARTITION BY parent ORDER BY id) - 1 AS sibling FROM tree")
def sibling_numbers(spark, d):
    """Numbers among siblings."""
    return pt.sibling_index(tree(spark, d), ["parent"], "id")


@query()
def line_diffs(spark, d):
    """Line diffs of successive messages."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").select("conv_id", "turn", F.lag("text").over(w).alias("a"), F.col("text").alias("b")).where("a is not null")
    return c.select("conv_id", "turn", pt.diff_column(F.col("a"), F.col("b")).alias("diff")).select("conv_id", "turn", F.size("diff").alias("lines"), pt.diff_stats(F.col("diff")).alias("s")).select("conv_id", "turn", "lines", "s.added", "s.deleted")


@query("""WITH l AS (SELECT conv_id, turn, role, text FROM conversations), n AS (SELECT conv_id, turn, role, text, sum(CASE WHEN role <> 'assistant' THEN 1 ELSE 0 END) OVER w AS o, sum(CASE WHEN role <> 'user' THEN 1 ELSE 0 END) OVER w AS nw FROM (SELECT conv_id, turn, role, replace(text, chr(10), ' ') AS text FROM l) WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
    SELECT conv_id, CAST(turn + 3 AS INTEGER) AS n, CASE role WHEN 'assistant' THEN 'add' WHEN 'user' THEN 'del' ELSE 'context' END AS kind, CASE WHEN role <> 'assistant' THEN CAST(4 + o AS INTEGER) END AS old_no, CASE WHEN role <> 'user' THEN CAST(6 + nw AS INTEGER) END AS new_no, text FROM n
    UNION ALL SELECT conv_id, 2, 'hunk', NULL, NULL, '@@ -5,9 +7,9 @@ x' FROM l GROUP BY conv_id""")
def parsed_diffs(spark, d):
    """Unified diffs, put together from conversations, as numbered lines."""
    c = table(spark, d, "conversations")
    line = F.concat(F.when(F.col("role") == "assistant", "+").when(F.col("role") == "user", "-").otherwise(" "), F.replace("text", F.lit("\n"), F.lit(" ")))
    g = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("t"))
    return pt.parse_unified(g.select("conv_id", F.concat(F.lit("diff --git a b\n--- a\n@@ -5,9 +7,9 @@ x\n"), "t").alias("t")), "conv_id", "t")


@query("""SELECT conv_id, array_to_string(list_sort(list_distinct(list(turn % 4))), ',') AS numbers FROM conversations GROUP BY 1""")
def source_numbers(spark, d):
    """Numbers of the sources of a conversation."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.concat(F.lit("slide-"), (F.col("turn") % 4).cast("string"))).alias("ids"))
    return c.select("conv_id", F.array_join(pt.source_numbers(F.col("ids")), ",").alias("numbers"))

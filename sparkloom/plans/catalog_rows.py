"""Queries over rules of single rows: candidates, reviews, plans, boxes, messages and client lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import client as cl
from ..operators import coverage as cv
from ..operators import graph as gr
from ..operators import layout as ly
from ..operators import metrics as mt
from ..operators import patch as pt
from ..operators import resolve as rs
from ..operators import review as rv
from ..operators import segment as sg
from ..operators import tree as tr
from ..sources import documents as sd
from ..streaming import events as ev
from . import store as st
from .catalog_graph import TREE, tree
from .catalog_text import BLOCKS, blocks
from .registry import query, table


def _words(c):
    return F.split(c, " ")


def _empty():
    return F.array().cast("array<string>")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linestatus = 'O' THEN 'degraded' ELSE 'accepted' END AS status
    FROM lineitem""")
def page_statuses(spark, d):
    """Pages of runs as failed, degraded or accepted."""
    state = mt.page_status(F.col("l_returnflag") == "R", F.col("l_linestatus") == "O")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", state.alias("status"))


@query("""SELECT l_linestatus AS role, count(*) AS calls, count(*) FILTER (l_returnflag = 'R') AS errors, quantile_disc(l_quantity, 0.5) AS p50,
        quantile_disc(l_quantity, 0.95) AS p95, max(l_quantity) AS highest, round(avg(l_quantity), 3) AS mean, bool_and(l_returnflag <> 'R') AS all_ok
    FROM lineitem GROUP BY 1""")
def verifier_roles(spark, d):
    """Calls, failures and latencies per role of a verifier."""
    status = F.when(F.col("l_returnflag") == "R", "error").otherwise("ok")
    calls = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("role"), status.alias("status"), "l_quantity")
    return mt.call_summary(calls, ["role"], "status", "l_quantity")


@query("""WITH e AS (SELECT *, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END AS z FROM orders),
        x AS (SELECT *, coalesce(max(z) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), -1) AS epoch FROM e)
    SELECT o_custkey, max_by(o_orderstatus, o_orderkey) FILTER (o_orderstatus <> 'P') AS status,
        (max(struct_pack(e := epoch, p := greatest(0, least(o_totalprice / 1000, 100))))).p AS progress,
        min_by(CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END, o_orderkey) AS "first", count(*) AS updates
    FROM x GROUP BY 1""")
def set_jobs(spark, d):
    """Jobs in memory after their updates: blanks change nothing, progress only rises unless it is reset."""
    status = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus"))
    log = table(spark, d, "orders").withColumn("status", status).withColumn("progress", F.col("o_totalprice") / 1000)
    return st.merge_jobs(log, "o_custkey", "o_orderkey", ["status"], "progress", F.col("o_orderpriority") == "1-URGENT")


@query("""WITH p AS (SELECT p_partkey, p_name, lag(split_part(p_name, ' ', -1)) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part)
    SELECT p_partkey, contains(p_name, b) AND list_contains(string_split(p_name, ' '), b) AS covered FROM p WHERE b IS NOT NULL""")
def covered_messages(spark, d):
    """Whether a message holds the text and the ids of the one before."""
    before = F.lag(F.element_at(_words("p_name"), -1)).over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    p = table(spark, d, "part").withColumn("b", before).where("b is not null")
    return p.select("p_partkey", ev.covers(F.col("p_name"), F.col("b"), _words("p_name"), F.array("b")).alias("covered"))


@query("""WITH l AS (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1)
    SELECT c_custkey FROM customer LEFT JOIN l ON c_custkey = o_custkey ORDER BY last DESC NULLS LAST, c_custkey LIMIT 20""")
def recent_customers(spark, d):
    """The 20 workspaces used last."""
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("at"))
    c = table(spark, d, "customer").select("c_custkey").join(last, "c_custkey", "left")
    return cl.by_recency(c, "at", "c_custkey").limit(20).select("c_custkey")


@query("""WITH r AS (SELECT user_id, min(event_id) AS rank FROM events GROUP BY 1)
    SELECT c_custkey FROM customer LEFT JOIN r ON c_custkey = user_id ORDER BY rank ASC NULLS FIRST, c_custkey LIMIT 30""")
def first_by_saved_order(spark, d):
    """The first 30 rows by a saved order; new ones come first."""
    ranks = table(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.min("event_id").alias("rank"))
    return cl.by_saved_order(table(spark, d, "customer").select("c_custkey"), ranks, "c_custkey").limit(30).select("c_custkey")


@query("""WITH p AS (SELECT *, string_split(p_name || ' ' || p_type, ' ') AS l FROM part),
        q AS (SELECT p_partkey, l, p_size % len(l) AS s, p_partkey % len(l) AS t FROM p),
        r AS (SELECT *, l[1:s] || l[s + 2:] AS r FROM q)
    SELECT p_partkey, array_to_string(r[1:t] || [l[s + 1]] || r[t + 1:], ' ') AS items FROM r""")
def moved_items(spark, d):
    """Lists with one element dragged to another place."""
    p = table(spark, d, "part").withColumn("l", _words(F.concat_ws(" ", "p_name", "p_type")))
    target = (F.col("p_partkey") % F.size("l")).cast("int")
    return p.select("p_partkey", F.array_join(cl.moved(F.col("l"), F.col("p_size") % F.size("l"), target), " ").alias("items"))


@query("""WITH p AS (SELECT p_partkey, string_split(p_name, ' ') || string_split(p_type, ' ') || [p_brand, p_brand] AS l FROM part)
    SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS ids FROM p""")
def distinct_members(spark, d):
    """The ids of several lists, distinct, in order."""
    ids = cl.distinct_flat([_words("p_name"), _words("p_type"), F.array("p_brand", "p_brand")])
    return table(spark, d, "part").select("p_partkey", F.array_join(ids, ",").alias("ids"))


@query("""SELECT o_orderkey, 'changed' AS effect, 'o_orderstatus' AS fields FROM orders
    WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' AND o_totalprice <= 200000""")
def undeclared_changes(spark, d):
    """Rows that a patch changed without saying so."""
    o = table(spark, d, "orders")
    after = o.withColumn("o_orderstatus", F.when(F.col("o_orderpriority") == "1-URGENT", "F").otherwise(F.col("o_orderstatus")))
    return pt.locality(pt.effects(o, after, "o_orderkey", ["o_orderstatus"]), o.where("o_totalprice > 200000"), "o_orderkey")


@query("""WITH p AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a,
            list_distinct(string_split(lag(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey), ' ')) AS b FROM part)
    SELECT p_partkey, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS likeness FROM p WHERE b IS NOT NULL""")
def target_likeness(spark, d):
    """Overlap of the targets of patches that follow each other."""
    before = F.lag(_words("p_name")).over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    p = table(spark, d, "part").withColumn("b", before).where("b is not null")
    return p.select("p_partkey", pt.set_likeness(_words("p_name"), F.col("b")).alias("likeness"))


@query("""WITH n AS (SELECT c_custkey FROM customer WHERE c_acctbal < 2000)
    SELECT o_orderkey AS issue_id FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT * FROM n) AND o_custkey + 1 NOT IN (SELECT * FROM n)""")
def ineffective_decisions(spark, d):
    """Accepted decisions none of whose nodes changed."""
    decision = F.when(F.col("o_orderstatus") == "F", "accept").otherwise("reject")
    nodes = F.array("o_custkey", F.col("o_custkey") + 1)
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("issue_id"), decision.alias("decision"), nodes.alias("nodes"))
    changed = table(spark, d, "customer").where("c_acctbal < 2000").select(F.col("c_custkey").alias("node"))
    return pt.ineffective(o, changed).select("issue_id")


@query("""WITH l AS (SELECT c_nationkey, c_mktsegment, max_by(c_name, c_custkey) AS n FROM customer GROUP BY 1, 2)
    SELECT c_nationkey, string_agg(c_mktsegment || '=' || n, ',' ORDER BY c_mktsegment) AS names FROM l GROUP BY 1""")
def node_names(spark, d):
    """Names of a tree's nodes by id; of repeated ids the last."""
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey", F.col("c_mktsegment").alias("id"), F.col("c_name").alias("name"))
    named = F.transform(F.map_entries("names"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return pt.names_by_id(c, "c_nationkey", "c_custkey").select("c_nationkey", F.array_join(named, ",").alias("names"))


@query("""WITH c AS (SELECT conv_id, list(CASE role WHEN 'user' THEN 'open' ELSE role END ORDER BY turn) AS l FROM conversations GROUP BY 1)
    SELECT conv_id, array_to_string(l[:len(l) - 1] || ['done'], ',') AS finished,
        array_to_string(l[:len(l) - 1] || [CASE WHEN l[-1] = 'open' THEN 'closed' ELSE l[-1] END, 'open'], ',') AS queued FROM c""")
def interactions(spark, d):
    """Interactions of a run: the last one finished, and with a new one queued behind them."""
    status = F.when(F.col("role") == "user", "open").otherwise(F.col("role"))
    rows = F.array_sort(F.collect_list(F.struct("turn", status.alias("status"))))
    items = F.transform(rows, lambda x: F.struct(x["status"].alias("status"), x["turn"].alias("turn")))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(items.alias("l"))
    new = F.struct(F.lit("open").alias("status"), F.lit(-1).cast("long").alias("turn"))
    shown = [F.array_join(x["status"], ",").alias(n) for n, x in (("finished", pt.last_overlaid(F.col("l"), F.lit("done"))), ("queued", pt.queued(F.col("l"), new)))]
    return c.select("conv_id", *shown)


@query("""SELECT c_custkey, 'node_' || substr(sha256('{"c_mktsegment":"' || c_mktsegment || '","c_nationkey":' || c_nationkey || '}'), 1, 10) AS identity
    FROM customer""")
def page_node_identities(spark, d):
    """Identities of page nodes: equal content, equal identity."""
    return table(spark, d, "customer").select("c_custkey", sg.stable_id("node_", "c_nationkey", "c_mktsegment").alias("identity"))


@query("""SELECT event_type, user_id, 'issue_' || substr(sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}'), 1, 10) AS signature,
        count(*) AS n FROM events GROUP BY 1, 2""")
def issue_signatures(spark, d):
    """Issues told by their signature, and how often each came."""
    e = table(spark, d, "events").withColumn("signature", sg.stable_id("issue_", "user_id", "event_type"))
    return e.groupBy("event_type", "user_id", "signature").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS hash FROM orders""")
def input_hashes(spark, d):
    """The whole digest of a step's input."""
    return table(spark, d, "orders").select("o_orderkey", sg.stable_id("", "o_orderstatus", "o_custkey", digits=64).alias("hash"))


_PAIRS = "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS x, CAST(l_linenumber AS DOUBLE) AS y, lag(l_quantity) OVER w AS bx, CAST(lag(l_linenumber) OVER w AS DOUBLE) AS b_y FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity)"


@query(f"""WITH p AS ({_PAIRS}), s AS (SELECT *, greatest(0, least(x + 20, bx + 20) - greatest(x, bx)) AS w, greatest(0, least(y + 3, b_y + 3) - greatest(y, b_y)) AS h FROM p WHERE bx IS NOT NULL)
    SELECT l_orderkey, l_linenumber, l_partkey, x, w * h / (20 * 3 + 20 * 3 - w * h) AS iou FROM s""")
def box_ious(spark, d):
    """Overlap of boxes that follow each other."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")
    x, y = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    li = table(spark, d, "lineitem").withColumns({"x": x, "y": y, "bx": F.lag(x).over(w), "b_y": F.lag(y).over(w)}).where("bx is not null")
    wide, high = F.lit(20.0), F.lit(3.0)
    overlap = rs.iou([F.col("x"), F.col("y"), wide, high], [F.col("bx"), F.col("b_y"), wide, high])
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "x", overlap.alias("iou"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, least(1, greatest(0, (l_quantity * 20 - 100) / 640)) AS x, least(1, l_linenumber * 80 / 400) AS y, (l_quantity * 20 - 20) / 640 AS r, (l_linenumber * 80 + 40) / 400 AS b FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, x, y, round(least(1, greatest(x, r)) - x, 6) AS w, round(least(1, greatest(y, b)) - y, 6) AS h FROM b""")
def clipped_boxes(spark, d):
    """Boxes as shares of their page."""
    box = ly.clipped_box(F.col("l_quantity") * 20 - 100, F.col("l_linenumber") * 80, F.lit(80), F.lit(40), 640, 400)
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", box.alias("b"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", *[F.get("b", i).alias(n) for i, n in enumerate("xywh")])


_ROLE = "CASE p_type WHEN 'ECONOMY' THEN 'definition' WHEN 'STANDARD' THEN 'formula' WHEN 'PROMO' THEN 'example' ELSE lower(p_type) END"


def _role():
    t = F.col("p_type")
    return F.when(t == "ECONOMY", "definition").when(t == "STANDARD", "formula").when(t == "PROMO", "example").otherwise(F.lower(t))


@query(f"""SELECT p_partkey, greatest(0, least(1, CASE WHEN {_ROLE} IN ('definition', 'principle', 'formula') THEN 0.84::DOUBLE ELSE 0.74::DOUBLE END * 0.6::DOUBLE + (p_size / 50::DOUBLE) * 0.4::DOUBLE)) AS weight FROM part""")
def node_weights(spark, d):
    """How much a node matters by its role and confidence."""
    return table(spark, d, "part").select("p_partkey", sg.node_weight(_role(), F.col("p_size") / 50).alias("weight"))


@query("""SELECT conv_id, 'unit_' || lpad(CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS VARCHAR), 4, '0') AS unit_id, text
    FROM conversations WHERE trim(text) <> ''""")
def numbered_units(spark, d):
    """Blocks that aren't blank as numbered units."""
    return sg.page_units(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query("""SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_returnflag = 'R' OR (l_returnflag = 'A' AND l_linenumber > 3) THEN 'text' ELSE 'slide' END AS kind,
        CASE WHEN l_returnflag = 'A' AND l_linenumber > 3 THEN l_linenumber - 3 ELSE l_linenumber END AS "local" FROM lineitem""")
def source_references(spark, d):
    """Global numbers of a source as slides and texts."""
    flag = F.col("l_returnflag")
    ref = sg.source_reference(F.col("l_linenumber"), F.when(flag == "R", "text").when(flag == "A", "mixed").otherwise("slides"), F.lit(3))
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", ref.alias("r")).select("l_orderkey", "l_partkey", "l_linenumber", "r.kind", "r.local")


@query("""SELECT p_partkey, 2 * p_size AS start_1, 2 * p_size + 9 AS end_1, 3 * p_size AS start_2, 3 * p_size + 1 AS end_2 FROM part""")
def shifted_ranges(spark, d):
    """Ranges of a source after those before it."""
    s = F.col("p_size")
    r = F.array(F.struct(s.alias("start"), (s + 9).alias("end")), F.struct((2 * s).alias("start"), (2 * s + 1).alias("end")))
    p = table(spark, d, "part").select("p_partkey", sg.shifted(r, s).alias("r"))
    return p.select("p_partkey", *[F.get("r", i)[k].alias(f"{k}_{i + 1}") for i in (0, 1) for k in ("start", "end")])


@query("""WITH c AS (SELECT *, '[{"turn":' || turn || ',"role":"' || role || '"}]' AS h FROM conversations)
    SELECT conv_id, turn, h || chr(10) || substr(text, 1, greatest(120 - length(h) - 1, 0)) AS context FROM c""")
def compact_contexts(spark, d):
    """Packets, then as much text as a prompt of 120 characters takes."""
    packets = F.array(F.struct("turn", "role"))
    return table(spark, d, "conversations").select("conv_id", "turn", sg.compacted(packets, F.col("text"), 120).alias("context"))


@query("""SELECT n_name AS label, CASE WHEN n_regionkey < 2 THEN 'b' || n_nationkey ELSE lower(replace(n_name, '_', '')) END AS branch, 'branch_topic' AS role,
        n_regionkey / 8 AS confidence FROM nation""")
def topic_nodes(spark, d):
    """Topics as branch nodes, with their plan's branch or their own."""
    n = table(spark, d, "nation")
    plans = n.where("n_regionkey < 2").select(F.lower("n_name").alias("label"), F.concat(F.lit("b"), F.col("n_nationkey").cast("string")).alias("branch"))
    return sg.theme_nodes(n.select(F.col("n_name").alias("label"), (F.col("n_regionkey") / 8).alias("confidence")), plans)


@query("""SELECT l_orderkey AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INTEGER) AS n, l_linenumber, l_partkey, l_suppkey
    FROM lineitem""")
def page_candidates(spark, d):
    """Nodes nested in pages as rows."""
    nodes = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    return sg.page_records(table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(nodes.alias("nodes")), "nodes")


_LAGGED = "SELECT *, lag(p_type) OVER w AS parent_type, lag(p_size) OVER w AS s, lag(split_part(p_name, ' ', 1)) OVER w AS word FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)"


@query(f"""WITH p AS ({_LAGGED}), q AS (SELECT *, s > 45 AS root, CASE WHEN p_size > 40 THEN 'branch_topic' ELSE lower(p_type) END AS child_role, CASE parent_type WHEN 'ECONOMY' THEN 'branch_topic' WHEN 'PROMO' THEN 'step' ELSE parent_type END AS parent_role,
            s % 3 = p_size % 3 AS together, contains(p_name, word) AS named FROM p WHERE word IS NOT NULL),
        k AS (SELECT *, CASE WHEN root AND child_role = 'branch_topic' THEN 1 WHEN root THEN 2 WHEN parent_role = 'branch_topic' AND together THEN 3 WHEN NOT together THEN 4 WHEN parent_role = 'step' THEN 5 WHEN named THEN 6 WHEN p_size < 20 THEN 7 ELSE 8 END AS rule, p_size / 50 AS c FROM q)
    SELECT p_partkey, ['direct_parent', 'ancestor_only', 'direct_parent', 'unrelated', 'sibling', 'direct_parent', 'uncertain', 'recalled'][rule] AS classification,
        CASE rule WHEN 1 THEN greatest(c, 0.94) WHEN 2 THEN least(greatest(c, 0.4), 0.62) WHEN 3 THEN greatest(c, 0.82) WHEN 4 THEN least(c, 0.28) WHEN 5 THEN least(c, 0.3) WHEN 6 THEN greatest(c, 0.72) ELSE c END::DOUBLE AS score FROM k""")
def parent_votes(spark, d):
    """Votes on parents without a model."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    s = F.col("p_size")
    p = table(spark, d, "part").withColumns({"t": F.lag("p_type").over(w), "s": F.lag(s).over(w), "word": F.lag(F.get(_words("p_name"), 0)).over(w)}).where("word is not null")
    role = F.when(F.col("t") == "ECONOMY", "branch_topic").when(F.col("t") == "PROMO", "step").otherwise(F.col("t"))
    child = F.when(s > 40, "branch_topic").otherwise(F.lower("p_type"))
    branches = [(c % 3).cast("string") for c in (F.col("s"), s)]
    vote = gr.heuristic_vote(F.col("s") > 45, role, child, *branches, F.contains("p_name", "word"), s < 20, F.lit("recalled"), s / 50)
    return p.select("p_partkey", vote.alias("v")).select("p_partkey", "v.*")


@query("""WITH p AS (SELECT p_partkey, p_size / 25::DOUBLE AS s, CASE p_type WHEN 'ECONOMY' THEN 'direct_parent' WHEN 'STANDARD' THEN 'ancestor_only' WHEN 'PROMO' THEN 'sibling' ELSE 'unrelated' END AS k FROM part),
        b AS (SELECT *, CASE k WHEN 'direct_parent' THEN 0.45::DOUBLE * s + 0.55::DOUBLE * 0.8::DOUBLE ELSE 0.35::DOUBLE * s + 0.25::DOUBLE * 0.8::DOUBLE END AS b FROM p)
    SELECT p_partkey, round(least(1, b * CASE k WHEN 'direct_parent' THEN 1::DOUBLE WHEN 'ancestor_only' THEN 0.55::DOUBLE WHEN 'sibling' THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END), 4) AS score FROM b""")
def voted_scores(spark, d):
    """Parent scores after a vote of .8."""
    t = F.col("p_type")
    kind = F.when(t == "ECONOMY", "direct_parent").when(t == "STANDARD", "ancestor_only").when(t == "PROMO", "sibling").otherwise("unrelated")
    return table(spark, d, "part").select("p_partkey", gr.with_vote(F.col("p_size") / 25, kind, F.lit(0.8)).alias("score"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(list_sort(list_distinct([l_partkey, l_suppkey, l_orderkey, l_suppkey])), ',') AS ids FROM lineitem")
def verification_scopes(spark, d):
    """The units that a verification looks at."""
    ids = gr.scope_ids([F.array("l_partkey", "l_suppkey"), F.array("l_orderkey", "l_suppkey")])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(ids.cast("array<string>"), ",").alias("ids"))


@query("""SELECT c_custkey AS branch, CASE WHEN c_acctbal < 0 THEN c_mktsegment WHEN n_regionkey = 1 THEN n_name ELSE 'all' END AS topic
    FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def nearest_topics(spark, d):
    """The topic of each branch, or of the nearest one above that has one."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    nation = -(F.col("n_nationkey") + 2)
    above = -(F.col("c_nationkey") + 2)
    branches = c.select(F.col("c_custkey").alias("branch"), F.array(F.col("c_custkey"), above.cast("long"), F.lit(-1).cast("long")).alias("path"))
    topics = c.where("c_acctbal < 0").select(F.col("c_custkey").alias("branch"), F.col("c_mktsegment").alias("topic"))
    topics = topics.unionByName(n.where("n_regionkey = 1").select(nation.cast("long").alias("branch"), F.col("n_name").alias("topic")))
    root = spark.range(1).select(F.lit(-1).cast("long").alias("branch"), F.lit("all").alias("topic"))
    return gr.nearest_topic(branches, topics.unionByName(root))


@query("""SELECT DISTINCT o_orderkey AS page FROM orders WHERE o_orderstatus = 'P' UNION SELECT -c_nationkey - 1 FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'""")
def revised_pages(spark, d):
    """Pages that issues name, or that their nodes are on."""
    o = table(spark, d, "orders").where("o_orderstatus = 'P'")
    issues = o.select(F.col("o_orderkey").alias("issue_id"), F.array("o_orderkey").alias("pages"), F.array("o_custkey").alias("node_ids"))
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array((-F.col("c_nationkey") - 1).cast("long")).alias("pages"))
    return gr.revision_pages(issues, nodes)


@query("""WITH e AS (SELECT CASE event_type WHEN 'click' THEN 'structure' WHEN 'view' THEN 'wording' ELSE 'evidence' END AS role, CASE WHEN value > 200 THEN 'rename' WHEN value > 100 THEN 'delete' ELSE 'keep' END AS action, user_id AS node, event_type AS text FROM events)
    SELECT DISTINCT 'issue_' || substr(sha1('{"action":"' || action || '","node":' || node || ',"role":"' || role || '","text":"' || text || '"}'), 1, 10) AS issue_id, role, action, node,
        CASE WHEN node NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'unknown_node' WHEN action = 'keep' OR (role = 'structure' AND action = 'delete') OR (role = 'wording' AND action = 'rename') OR (role = 'evidence' AND action = 'delete') THEN '' ELSE 'not_permitted' END AS fault FROM e""")
def report_faults(spark, d):
    """Reports of reviewers: their issues by content, and what is wrong with them."""
    t, v = F.col("event_type"), F.col("value")
    role = F.when(t == "click", "structure").when(t == "view", "wording").otherwise("evidence")
    action = F.when(v > 200, "rename").when(v > 100, "delete").otherwise("keep")
    issues = table(spark, d, "events").select(role.alias("role"), action.alias("action"), F.col("user_id").alias("node"), t.alias("text"))
    return rv.checked_report(issues, table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id")))


@query("SELECT p_partkey, p_size >= 5 AND (p_size > 45 OR p_type = 'ECONOMY' OR p_retailprice > 950) AS eligible FROM part")
def eligible_nodes(spark, d):
    """Nodes that a tree may have: a label without issues, and support or a claim to the root."""
    issues = F.when(F.col("p_size") < 5, F.array(F.lit("too_short"))).otherwise(_empty())
    support = F.when(F.col("p_type") == "ECONOMY", F.array("p_name")).otherwise(_empty())
    evidence = F.when(F.col("p_retailprice") > 950, F.array("p_name")).otherwise(_empty())
    return table(spark, d, "part").select("p_partkey", tr.is_eligible(issues, F.col("p_size") > 45, evidence, support).alias("eligible"))


@query("SELECT p_partkey AS id, CASE WHEN p_size < 3 OR p_size + 5 > 45 THEN 'page' ELSE 'depth' END AS fault FROM part WHERE p_size < 3 OR p_size + 5 > 45 OR p_size > 30")
def node_faults(spark, d):
    """Nodes that name pages that aren't there, or lie too deep."""
    s = F.col("p_size")
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("id"), s.alias("depth"), F.array(s - 2, s + 5).alias("pages"))
    return tr.bad_pages(nodes, 45, 30)


@query("""WITH e AS (SELECT l_partkey AS source, l_orderkey AS target, l_linestatus = 'O' AS provisional, l_returnflag <> 'R' AS has_evidence FROM lineitem),
        c AS (SELECT min(target) AS child FROM (SELECT target FROM e GROUP BY 1 HAVING count(*) = 1 AND bool_and(has_evidence AND provisional)))
    SELECT source, target, has_evidence, provisional AND target <> child AS provisional FROM e, c""")
def confirmed_edges(spark, d):
    """Edges after the only one into a child is confirmed."""
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_orderkey").alias("target"), (F.col("l_linestatus") == "O").alias("provisional"), (F.col("l_returnflag") != "R").alias("has_evidence"))
    lone = e.groupBy("target").agg(F.count("*").alias("n"), F.bool_and(F.col("has_evidence") & F.col("provisional")).alias("ok"))
    return tr.confirm_edge(e, lone.where("n = 1 and ok").agg(F.min("target")).first()[0])


@query("""WITH p AS (SELECT *, ['root_choice', 'competing_parent', 'cross_link', 'label'][1 + p_size % 4] AS kind FROM part)
    SELECT p_partkey, CASE WHEN kind = 'root_choice' OR (kind <> 'competing_parent' AND p_size > 40) THEN -1 WHEN kind = 'competing_parent' AND p_size <= 20 THEN p_partkey + 1000000 WHEN p_size > 40 THEN -1 ELSE p_partkey END AS id,
        CASE WHEN kind = 'root_choice' THEN 'root' WHEN kind = 'competing_parent' AND p_size <= 20 THEN 'tree_edge' WHEN kind = 'cross_link' THEN 'cross_link' ELSE 'node' END AS what FROM p""")
def review_subjects(spark, d):
    """What each review is about."""
    k, s = F.col("p_partkey"), F.col("p_size")
    other = k + 1_000_000
    none = F.array().cast("array<bigint>")
    kind = F.get(F.array(*[F.lit(x) for x in ("root_choice", "competing_parent", "cross_link", "label")]), s % 4)
    subjects = F.when(s > 40, none).otherwise(F.array(k, other))
    targets = F.when(s <= 20, F.array(other, F.lit(-2).cast("long"))).otherwise(F.array(k, other))
    return table(spark, d, "part").select("p_partkey", rv.subject_of(kind, subjects, F.lit(-1).cast("long"), targets).alias("v")).select("p_partkey", "v.*")


@query(f"""WITH {BLOCKS} SELECT DISTINCT doc_id FROM blocks WHERE length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 12""")
def signal_pages(spark, d):
    """Pages with a block that says something."""
    return cv.signal_pages(blocks(spark, d), "doc_id", "text")


@query("""WITH u AS (SELECT l_suppkey, CASE l_returnflag WHEN 'R' THEN 'image' ELSE 'text' END AS kind, CASE WHEN l_linestatus = 'F' THEN l_linenumber END AS page,
            CASE WHEN l_returnflag <> 'N' THEN l_linenumber + 1 END AS slide, l_orderkey AS idx, l_partkey AS id FROM lineitem)
    SELECT l_suppkey, idx, id, row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE WHEN page IS NOT NULL THEN 0 WHEN slide IS NOT NULL THEN 1 ELSE 2 END, coalesce(page, slide) NULLS FIRST, kind <> 'text', idx, id) AS place FROM u""")
def source_order(spark, d):
    """Units in order of their sources."""
    n = F.col("l_linenumber")
    kind = F.when(F.col("l_returnflag") == "R", "image").otherwise("text")
    u = table(spark, d, "lineitem").select("l_suppkey", kind.alias("kind"), F.when(F.col("l_linestatus") == "F", n).alias("page"), F.when(F.col("l_returnflag") != "N", n + 1).alias("slide"), F.col("l_orderkey").alias("idx"), F.col("l_partkey").alias("id"))
    return cv.in_source_order(u, "l_suppkey").select("l_suppkey", "idx", "id", "place")


@query("""WITH o AS (SELECT o_custkey AS plan, min(o_orderkey) AS n, min(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS page, min(CASE WHEN o_orderstatus = 'O' THEN o_orderkey // 8 END) AS slide FROM orders GROUP BY 1)
    SELECT plan, row_number() OVER (ORDER BY CASE WHEN page IS NOT NULL THEN 0 WHEN slide IS NOT NULL THEN 1 ELSE 2 END, coalesce(page, slide), n, plan) AS place FROM o""")
def plan_order(spark, d):
    """Plans by the first place of their units."""
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    members = table(spark, d, "orders").select(F.col("o_custkey").alias("plan"), k.alias("n"), F.when(status == "F", k).alias("page"), F.when(status == "O", F.floor(k / 8)).alias("slide"))
    return cv.plan_places(members).select("plan", "place")


@query("""WITH o AS (SELECT l_partkey AS node, min(l_orderkey) AS unit FROM lineitem GROUP BY 1)
    SELECT node, unit, count(*) OVER (PARTITION BY unit) AS owned FROM o""")
def seed_owners(spark, d):
    """The earliest unit of each seeded node, and how many each unit has."""
    return cv.owners(table(spark, d, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_orderkey").alias("unit"), F.col("l_orderkey").alias("place")))


@query("SELECT o_orderkey, greatest(coalesce(n, 2), 1) AS weight FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def planning_weights(spark, d):
    """How many nodes each unit stands for."""
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "orders").join(n, "o_orderkey", "left").select("o_orderkey", cv.planning_weight(F.col("n")).alias("weight"))


@query("""WITH h AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R')
    SELECT p_partkey AS id, CASE p_type WHEN 'PROMO' THEN 'rejected' ELSE 'uncovered' END AS was,
        CASE WHEN p_type = 'PROMO' THEN 'rejected' WHEN l_partkey IS NOT NULL THEN 'covered' WHEN p_size / 50 < 0.7 THEN 'deferred' ELSE 'uncovered' END AS status
    FROM part LEFT JOIN h ON l_partkey = p_partkey""")
def discarded_units(spark, d):
    """Units after an audit: what was discarded stays so."""
    status = F.when(F.col("p_type") == "PROMO", "rejected").otherwise("uncovered")
    units = table(spark, d, "part").select(F.col("p_partkey").alias("id"), status.alias("status"), (F.col("p_size") / 50).alias("importance"))
    return cv.audit(units, table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("id")))


@query("SELECT DISTINCT l_orderkey AS page FROM lineitem WHERE l_returnflag = 'N' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def formula_risk_pages(spark, d):
    """Accepted pages that have clean candidates."""
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_returnflag") == "N").alias("clean"))
    return rv.risk_pages(c, table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("page")))


@query("""WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS a, p_size, lag(string_split(p_name, ' ')) OVER w AS b, lag(p_size) OVER w AS s FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey))
    SELECT p_partkey, len(list_intersect(a, b)) > 0 OR p_size = s AS shared FROM p WHERE b IS NOT NULL""")
def shared_sources(spark, d):
    """Whether rows share a unit or a page."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    a = {"units": _words("p_name"), "pages": F.array("p_size")}
    p = table(spark, d, "part").withColumns({f"b_{k}": F.lag(v).over(w) for k, v in a.items()}).where("b_units is not null")
    return p.select("p_partkey", rs.shared_provenance(a, {k: F.col(f"b_{k}") for k in a}).alias("shared"))


@query("""WITH p AS (SELECT *, p_brand || p_name AS page, CAST(p_size AS DOUBLE) AS x FROM part), j AS (SELECT a.page, a.p_partkey AS idx, b.p_partkey AS n, greatest(0, least(a.x, b.x) + 20 - greatest(a.x, b.x)) AS w
            FROM p a JOIN p b ON a.page = b.page AND a.p_type = 'ECONOMY' AND b.p_type <> 'ECONOMY' AND bit_count(xor(a.p_size, b.p_size)) <= 4)
    SELECT page, idx, min(n) AS native FROM j WHERE w * 3 / (120 - w * 3) >= 0.5 GROUP BY ALL""")
def native_matches(spark, d):
    """The native picture that each extracted one is a copy of."""
    boxes = {"page": F.concat("p_brand", "p_name"), "idx": F.col("p_partkey"), "x": F.col("p_size").cast("double"), "y": F.lit(0.0), "w": F.lit(20.0), "h": F.lit(3.0), "hash": F.lower(F.lpad(F.hex("p_size"), 4, "0"))}
    p = table(spark, d, "part").withColumns(boxes)
    return rs.match_native(*[p.where(t).select(*boxes) for t in ("p_type = 'ECONOMY'", "p_type <> 'ECONOMY'")])


@query("""WITH j AS (SELECT l_partkey AS asset, o_custkey AS candidate, count(*) AS overlap, max(o_totalprice) AS confidence FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
    SELECT asset, candidate, overlap, confidence FROM j QUALIFY row_number() OVER (PARTITION BY asset ORDER BY overlap DESC, confidence DESC, candidate) = 1""")
def media_owners(spark, d):
    """The candidate that shares most units with each picture."""
    assets = table(spark, d, "lineitem").select(F.col("l_partkey").alias("asset"), F.col("l_orderkey").alias("unit")).distinct()
    return rs.owner_of(assets, table(spark, d, "orders").select(F.col("o_custkey").alias("candidate"), F.col("o_orderkey").alias("unit"), F.col("o_totalprice").alias("confidence")))


@query("""WITH i AS (SELECT p_brand AS page, p_partkey AS n, p_name AS identity, CASE WHEN p_size >= 15 THEN p_size END AS temp_id, starts_with(p_name, 'c') AS known, p_size BETWEEN 30 AND 40 AS open FROM part),
        r AS (SELECT *, row_number() OVER (PARTITION BY page, NOT known AND NOT open AND temp_id IS NULL ORDER BY n) AS r FROM i)
    SELECT page, n, identity, temp_id FROM r WHERE known OR open OR (temp_id IS NULL AND r <= 2)""")
def repairable_nodes(spark, d):
    """Nodes that a repair of a page may use."""
    p = table(spark, d, "part")
    incoming = p.select(F.col("p_brand").alias("page"), F.col("p_partkey").alias("n"), F.col("p_name").alias("identity"), F.when(F.col("p_size") >= 15, F.col("p_size")).alias("temp_id"))
    return rs.repairable(incoming, p.where("p_name like 'c%'").select(F.col("p_name").alias("identity")), p.where("p_size between 30 and 40").select(F.col("p_size").alias("temp_id")), 2)


@query("""WITH n AS (SELECT p_partkey, p_brand, p_name FROM part WHERE p_size < 5) SELECT * FROM n
    UNION ALL SELECT p_partkey, p_brand, p_name FROM part f WHERE p_size >= 5 AND NOT EXISTS (SELECT 1 FROM n WHERE n.p_name = f.p_name AND n.p_brand = f.p_brand)""")
def supplemented_nodes(spark, d):
    """Nodes, and the formulas of the layout that none of them has."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_name", "p_size")
    nodes, formulas = (p.where(t).drop("p_size") for t in ("p_size < 5", "p_size >= 5"))
    return rs.supplemented(nodes, formulas, ["p_name", "p_brand"])


@query("""WITH c AS (SELECT conv_id, turn, string_split(text || chr(13) || chr(10) || ' ' || turn || chr(10) || '第 ' || turn || ' 页' || chr(10) || role, chr(10)) AS l FROM conversations),
        t AS (SELECT *, list_filter(list_transform(l, lambda x: trim(x, ' ' || chr(13))), lambda x: x <> '' AND NOT regexp_matches(x, '^(第 )?[0-9]+( 页)?$')) AS k FROM c)
    SELECT conv_id, turn, array_to_string(k, chr(10)) AS text FROM t""")
def unmarked_texts(spark, d):
    """Texts without page numbers."""
    n = F.col("turn").cast("string")
    text = F.concat("text", F.lit("\r\n "), n, F.lit("\n第 "), n, F.lit(" 页\n"), "role")
    return table(spark, d, "conversations").select("conv_id", "turn", tx.without_page_markers(text).alias("text"))


@query("""WITH p AS (SELECT p_partkey, p_type IN ('PROMO', 'ECONOMY') AS bad, p_size > 25 AND p_type <> 'LARGE' AS worse, p_retailprice > 950 AS mends, p_size % 2 = 0 AS trims FROM part)
    SELECT p_partkey, CASE WHEN bad AND NOT mends THEN CASE WHEN worse THEN 'reject_entire_node' ELSE 'reextract_candidate' END WHEN bad AND worse THEN CASE WHEN trims THEN 'repair_label_and_trim_definition_keep_claim' ELSE 'reextract_candidate' END
        WHEN bad THEN 'repair_label_keep_claim' WHEN worse THEN CASE WHEN trims THEN 'trim_definition_keep_claim' ELSE 'reextract_candidate' END ELSE 'accept' END AS action FROM p""")
def field_actions(spark, d):
    """What to do with candidates by the issues of their fields."""
    label = F.when(F.col("p_type").isin("PROMO", "ECONOMY"), F.array(F.lit("ellipsis"))).otherwise(_empty())
    definition = F.when(F.col("p_size") > 25, F.array(F.lit("dependent_fragment"))).otherwise(_empty())
    action = tx.field_action(label, definition, F.col("p_retailprice") > 950, F.col("p_size") % 2 == 0, F.col("p_type") != "LARGE")
    return table(spark, d, "part").select("p_partkey", action.alias("action"))


@query("""WITH p AS (SELECT p_partkey, p_size, substr(p_name, 1, p_size % 7) AS t FROM part), x AS (SELECT *, length(replace(t, ' ', '')) AS n FROM p)
    SELECT p_partkey, p_size <= 48 AND (n >= 6 OR (p_size > 40 AND n >= 1) OR (p_size BETWEEN 31 AND 40 AND n >= 3)) AS specific FROM x""")
def specific_excerpts(spark, d):
    """Whether an excerpt of evidence says enough."""
    s = F.col("p_size")
    t = F.substring("p_name", F.lit(1), s % 7)
    excerpt = F.when(s > 48, "基本概念").when(s > 40, F.concat(t, F.lit("=3"))).when(s > 30, F.concat(t, F.lit("+"))).otherwise(t)
    return table(spark, d, "part").select("p_partkey", tx.is_specific(excerpt).alias("specific"))


@query("""SELECT p_partkey, least(1, length(split_part(p_name, ' ', 1)) / least(length(replace(p_name, ' ', '')), length(p_type))) AS share FROM part""")
def anchor_shares(spark, d):
    """How much of the shorter text its shared anchors are."""
    share = tx.anchor_coverage(F.array(F.get(_words("p_name"), 0)), F.col("p_name"), F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", share.alias("share"))


@query(f"""WITH p AS (SELECT p_partkey, {_ROLE} AS role, p_size / 50 AS importance, p_type = 'LARGE' AS edge, p_retailprice < 1000 AS used, contains(p_name, 'widget') AS passing FROM part)
    SELECT p_partkey, used AND role NOT IN ('definition', 'principle', 'step', 'formula', 'warning') AND importance < 0.7 AND CASE WHEN edge THEN importance <= 0.35 ELSE importance <= 0.55 AND passing END AS may_go FROM p""")
def discard_proposals(spark, d):
    """Units that a proposal may discard."""
    status = F.when(F.col("p_retailprice") < 1000, "uncovered").otherwise("rejected")
    category = F.when(F.col("p_type") == "LARGE", "edge").otherwise("introduction")
    source = F.replace("p_name", F.lit("widget"), F.lit("Overview"))
    return table(spark, d, "part").select("p_partkey", rv.discard_eligible(status, _role(), F.col("p_size") / 50, category, source).alias("may_go"))


_ISSUES = "CASE WHEN p_size < 5 THEN ['too_short'] WHEN p_size < 10 THEN ['generic', 'control_character'] WHEN p_size < 12 THEN ['ellipsis', 'generic'] ELSE [] END"


def _issues():
    def some(*names):
        return F.array(*[F.lit(n) for n in names])

    s = F.col("p_size")
    return F.when(s < 5, some("too_short")).when(s < 10, some("generic", "control_character")).when(s < 12, some("ellipsis", "generic")).otherwise(_empty())


@query(f"""WITH p AS (SELECT CASE WHEN p_type = 'PROMO' THEN '' ELSE p_name END AS id, {_ISSUES} AS i FROM part)
    SELECT id, array_to_string(list_sort(list_distinct(flatten(list(i)))), ',') AS issues, count(*) AS n FROM p WHERE len(i) > 0 GROUP BY id""")
def invalid_items(spark, d):
    """Issues of the items that a page's payload is refused for."""
    ident = F.when(F.col("p_type") != "PROMO", F.col("p_name"))
    bad = rv.split_valid(table(spark, d, "part").select(ident.alias("id"), _issues().alias("issues")), "issues")[1]
    return bad.select("id", F.array_join("issues", ",").alias("issues"), "n")


@query("""SELECT p_partkey, p_name FROM part WHERE p_size >= 12""")
def valid_items(spark, d):
    """Items of a payload without issues."""
    items = table(spark, d, "part").select("p_partkey", "p_name", F.col("p_name").alias("id"), _issues().alias("issues"))
    return rv.split_valid(items, "issues")[0].select("p_partkey", "p_name")


@query("SELECT p_partkey, p_size < 40 AND p_size % 3 <> 0 AS may_discard FROM part")
def discardable_nodes(spark, d):
    """Nodes whose issues allow to drop them."""
    s = F.col("p_size")
    last = F.when(s % 3 == 0, "n:source_missing").when(s % 3 == 1, "n:label_too_long").otherwise("n:confidence_below_threshold")
    issues = F.when(s >= 40, _empty()).otherwise(F.array(F.lit("n:evidence_not_specific"), last))
    return table(spark, d, "part").select("p_partkey", rv.may_discard(issues).alias("may_discard"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem)
    SELECT l_suppkey, l_orderkey, l_partkey, rank FROM r WHERE rank <= 3""")
def best_candidates(spark, d):
    """The three best candidates of each page."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    return gr.top_per(li, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 3).select("l_suppkey", "l_orderkey", "l_partkey", "rank")


@query("""WITH c AS (SELECT *, lag(CASE WHEN role = 'user' THEN text END) OVER w AS label, role = 'user' AND lead(turn) OVER w IS NOT NULL AS gone FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, concat_ws(' ', label, text) AS text FROM c WHERE NOT gone""")
def absorbed_labels(spark, d):
    """Blocks with the label before them."""
    return ly.merge_labels(table(spark, d, "conversations"), ["conv_id"], "turn", F.col("role") == "user", "text").select("conv_id", "turn", "text")


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_custkey END, CASE WHEN o_orderpriority = '1-URGENT' THEN 7 END, CASE WHEN o_totalprice > 100000 THEN o_orderkey END, 0) AS used FROM orders""")
def context_usage(spark, d):
    """Tokens in context by the best source there is."""
    live, manifest = F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")), F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(7).cast("long"))
    ratio = F.when(F.col("o_totalprice") > 100000, F.lit(0.5))
    return table(spark, d, "orders").select("o_orderkey", tx.context_used(live, manifest, ratio, 2 * F.col("o_orderkey"), F.lit(0).cast("long")).alias("used"))


@query("""SELECT p_partkey, p_size % 3 AS completed, 1 AS failed, p_size % 3 + 1 AS "rows" FROM part""")
def swarm_results(spark, d):
    """Counts of a tagged result; tags inside a result are text."""
    ok = F.concat(F.lit('<task id="a" status="completed"><result><task status="failed">'), "p_name", F.lit("</result></task>"))
    bad = F.lit('<task status="failed"><result>x</result></task>')
    return table(spark, d, "part").select("p_partkey", tx.swarm_counts(F.concat(F.repeat(ok, F.col("p_size") % 3), bad)).alias("c")).select("p_partkey", "c.*")


@query("""WITH c AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN chr(96) || chr(96) || chr(96) || chr(10) || text || chr(10) || chr(96) || chr(96) || chr(96)
            WHEN 'assistant' THEN '> ' || replace(text, chr(10), chr(10) || '> ') ELSE text END AS t FROM conversations)
    SELECT conv_id, string_agg(t, chr(10) || chr(10) ORDER BY turn) AS markdown FROM c GROUP BY 1""")
def turn_texts(spark, d):
    """Turns as Markdown: tools as code, thoughts as quotes."""
    kind = F.when(F.col("role") == "user", "tool").when(F.col("role") == "assistant", "thinking").otherwise("text")
    rows = F.array_sort(F.collect_list(F.struct("turn", kind.alias("type"), "text")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(tx.turn_markdown(F.transform(rows, lambda x: F.struct(x["type"].alias("type"), x["text"].alias("text")))).alias("markdown"))


_FILE = """SELECT p_partkey, 'in/' || p_partkey || CASE WHEN p_size < 5 THEN '.bin' ELSE '.md' END AS path, p_size < 5 AS odd, p_size > 45 AS blank, p_name FROM part"""


@query(f"""SELECT path AS doc_id, CASE WHEN blank THEN CAST(p_partkey AS VARCHAR) ELSE p_name END AS title, CASE WHEN NOT odd THEN 'text' END AS kind,
        CASE WHEN blank THEN 0 ELSE 2 END AS n_blocks, CASE WHEN odd THEN 'unsupported' WHEN blank THEN 'empty' END AS error FROM ({_FILE})""")
def parsed_files(spark, d):
    """Files as documents: title, kind, number of blocks, what is wrong."""
    s = F.col("p_size")
    path = F.concat(F.lit("in/"), F.col("p_partkey").cast("string"), F.when(s < 5, ".bin").otherwise(".md"))
    text = F.when(s > 45, " \n").otherwise(F.concat(F.lit("# "), "p_name", F.lit("\n\n \n\n"), "p_type"))
    return sd.parse(table(spark, d, "part").select(path.alias("path"), text.alias("text")))


@query("SELECT p_partkey, p_name || ' | ' || p_type || ' | ' || p_size AS text FROM part")
def table_rows(spark, d):
    """Rows of a document's tables as text."""
    cells = F.array(F.concat(F.lit(" "), "p_name"), F.concat("p_type", F.lit("  ")), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", sd.table_text(cells).alias("text"))


@query("SELECT p_partkey, CASE WHEN p_size < 20 THEN 'x = ' || p_size ELSE p_name END AS text FROM part")
def better_extractions(spark, d):
    """Of two extractions of a page the better one."""
    first = F.when(F.col("p_size") < 20, "").otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", sd.better_of(first, F.concat(F.lit("x = "), F.col("p_size").cast("string"))).alias("text"))


@query(f"""WITH {BLOCKS} SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id, ordinal) - 1 AS ordinal, b.text, '[' || lang || ']' AS heading
    FROM blocks b JOIN (SELECT doc_id, source, lang FROM documents) USING (doc_id) WHERE lang IS NOT NULL""")
def concatenated_sources(spark, d):
    """The blocks of a bundle's documents as one document."""
    s = table(spark, d, "documents").where("lang is not null").select("source", F.col("doc_id").alias("idx"), F.col("lang").alias("name"), "doc_id")
    return sd.concatenated(s, blocks(spark, d), "source")


@query("""SELECT conv_id, count(*) AS files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, CAST(sum(turn) AS BIGINT) AS pages,
        sha256(string_agg(sha256(text), '' ORDER BY turn)) AS digest FROM conversations GROUP BY 1""")
def upload_jobs(spark, d):
    """Totals and digest of each job's uploads."""
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("idx"), F.encode("text", "UTF-8").alias("content"), F.col("turn").alias("pages"))
    return sd.upload_totals(c, "conv_id")


@query("""SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}' AS json FROM customer""")
def exported_json(spark, d):
    """Rows as canonical JSON."""
    return sd.export_json(table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_name"), "c_custkey")


@query("""SELECT p_partkey AS doc_id, p_size AS page, 'text' AS category, p_name AS text, 0.1::DOUBLE AS x0, 0.1::DOUBLE AS y0, round((64 + 8 * p_size) / 640, 6) AS x1, 0.2::DOUBLE AS y1,
        0.5::DOUBLE AS confidence, p_size BETWEEN 1 AND 72 AS valid FROM part""")
def page_layout_blocks(spark, d):
    """Blocks of page layouts with boxes as shares of the page."""
    right = (64 + 8 * F.col("p_size")).cast("string")
    json = F.concat(F.lit('[{"category":"text","text":"'), "p_name", F.lit('","bbox":[64,40,'), right, F.lit(',80]},{"category":"figure","text":"","bbox":[0,0,9,9]}]'))
    layouts = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_size").alias("page"), F.lit(640.0).alias("width"), F.lit(400.0).alias("height"), F.lit(0.5).alias("confidence"), json.alias("json"))
    b = sd.layout_blocks(layouts)
    return b.select("doc_id", "page", "category", "text", *[F.get("bbox", i).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))], "confidence", "valid")


@query("""WITH p AS (SELECT p_partkey, replace(p_name, ' ', '') AS a, lag(replace(p_name, ' ', '')) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part),
        s AS (SELECT *, list_distinct(list_transform(range(1, length(a)), lambda i: substr(a, CAST(i AS INTEGER), 2))) AS x, list_distinct(list_transform(range(1, length(b)), lambda i: substr(b, CAST(i AS INTEGER), 2))) AS y FROM p WHERE b IS NOT NULL)
    SELECT p_partkey, CASE WHEN contains(a, b) OR contains(b, a) THEN 1 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END AS similarity FROM s""")
def label_likenesses(spark, d):
    """How alike labels are that follow each other."""
    key = F.replace("p_name", F.lit(" "))
    p = table(spark, d, "part").withColumn("a", key).withColumn("b", F.lag("a").over(Window.partitionBy("p_brand").orderBy("p_partkey"))).where("b is not null")
    return p.select("p_partkey", tx.label_similarity(F.col("a"), F.col("b")).alias("similarity"))


@query("SELECT event_id, props AS json FROM events")
def answers_json(spark, d):
    """The JSON inside a model's answer."""
    answer = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone."))
    return table(spark, d, "events").select("event_id", tx.outer_json(answer).alias("json"))


@query("""SELECT p_partkey, CASE WHEN p_size < 20 THEN 'chapter ' || p_size || ' ' || p_name WHEN p_size < 40 THEN '§' || p_size || '.2 ' || p_name END AS heading FROM part""")
def page_headings(spark, d):
    """Chapter and section headings of pages."""
    n = F.col("p_size").cast("string")
    first = F.when(F.col("p_size") < 20, F.concat(F.lit("## Chapter "), n, F.lit(":  "), "p_name")).when(F.col("p_size") < 40, F.concat(n, F.lit(" . 2 "), "p_name")).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", tx.infer_heading(F.concat(F.lit("\n7\n"), first, F.lit("\nbody"))).alias("heading"))


@query("SELECT p_partkey, p_size || '/' || p_partkey || '*2<=alpha' AS key FROM part")
def formula_texts(spark, d):
    """LaTeX as plain signs."""
    latex = F.concat(F.lit(r"\frac{"), F.col("p_size").cast("string"), F.lit("}{"), F.col("p_partkey").cast("string"), F.lit(r"} \times 2 \leq \Alpha"))
    return table(spark, d, "part").select("p_partkey", tx.latex_canonical(latex).alias("key"))


@query("""WITH p AS (SELECT p_partkey, p_name || p_type AS t FROM part)
    SELECT p_partkey, CASE WHEN length(t) <= 14 THEN t WHEN length(t) <= 28 THEN substr(t, 1, 14) || '|' || substr(t, 15) ELSE substr(t, 1, 14) || '|' || substr(t, 15, 14) || '…' END AS lines FROM p""")
def wrapped_labels(spark, d):
    """Labels in two lines."""
    return table(spark, d, "part").select("p_partkey", F.array_join(tx.wrap_label(F.concat("p_name", "p_type")), "|").alias("lines"))


@query("SELECT p_partkey, CASE WHEN p_size > 45 THEN '待复核课程要点' WHEN p_size > 40 THEN 'other' ELSE p_name END AS label FROM part")
def short_labels(spark, d):
    """Labels from the first clause of a text."""
    text = F.concat(F.lit("## 3.2 "), "p_name", F.when(F.col("p_size") > 40, F.lit(" and something that is much too long")).otherwise(""), F.lit(": and more\nnext"))
    return table(spark, d, "part").select("p_partkey", tx.short_label(text, F.when(F.col("p_size") > 45, " ").otherwise(" other")).alias("label"))


@query("SELECT p_partkey, p_size < 30 AS low FROM part")
def weak_pages(spark, d):
    """Pages whose text says nothing."""
    s = F.col("p_size")
    text = F.when(s < 10, " \n").when(s < 20, "12\n").when(s < 30, "---").otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", tx.is_low_quality(text).alias("low"))


@query("""SELECT p_partkey, CASE WHEN p_size < 20 THEN p_name || '是蓝色的零件。' WHEN p_size < 40 THEN p_name || '是红色的零件。' END AS definition FROM part""")
def repaired_definitions(spark, d):
    """Definitions cut before their first broken place; none where nothing whole is left."""
    s = F.col("p_size")
    text = F.when(s < 20, F.concat("p_name", F.lit("是蓝色的零件。"))).when(s < 40, F.concat("p_name", F.lit("是红色的零件。由上式可得"))).otherwise("由上式可得")
    return table(spark, d, "part").select("p_partkey", tx.repaired_definition(text).alias("definition"))


@query("""WITH c AS (SELECT o_orderkey, o_orderstatus = 'F' AS stated, o_orderpriority < '3' AS optional, c_acctbal > 2000 AS own, c_nationkey < 10 AS second FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT o_orderkey FROM c WHERE CASE WHEN stated THEN own ELSE NOT optional OR (own AND second) END""")
def verified_candidates(spark, d):
    """Candidates that a branch may keep: evidence or support in its valid units."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_nationkey")
    o = table(spark, d, "orders").join(c, "o_custkey")
    one, two = F.when(F.col("c_acctbal") > 2000, F.lit(1)).otherwise(F.lit(8)), F.when(F.col("c_nationkey") < 10, F.lit(2)).otherwise(F.lit(9))
    origin = F.when(F.col("o_orderstatus") == "F", "explicit").otherwise("abstractive")
    nodes = o.select("o_orderkey", origin.alias("origin"), F.array(one).alias("evidence"), F.array(one, two).alias("support"), (F.col("o_orderpriority") < "3").alias("optional"), F.array(F.lit(1), F.lit(2)).alias("valid"))
    return cv.verified(nodes, "valid").select("o_orderkey")


_BAND = "SELECT p_brand || '/' || (p_partkey // 1000) AS page, p_partkey AS id, p_type, p_size, CAST(80 + p_size AS DOUBLE) AS top FROM part"


@query(f"""WITH p AS ({_BAND}), l AS (SELECT page, id AS line FROM p WHERE p_type = 'ECONOMY'), t AS (SELECT DISTINCT page, p_size, p_type, top FROM p WHERE p_type <> 'ECONOMY'),
        j AS (SELECT page, line, string_agg(p_type, '' ORDER BY p_size, p_type) FILTER (top + 8 <= 101 AND 100 - (top + 8) <= 12) AS numerator,
            string_agg(p_type, '' ORDER BY p_size, p_type) FILTER (top >= 99 AND top - 100 <= 12) AS denominator FROM l JOIN t USING (page) GROUP BY ALL)
    SELECT * FROM j WHERE numerator IS NOT NULL AND denominator IS NOT NULL""")
def rule_fractions(spark, d):
    """Numerators and denominators at the rules of pages."""
    s = F.col("p_size").cast("double")
    p = table(spark, d, "part").withColumns({"page": F.concat("p_brand", F.lit("/"), F.floor(F.col("p_partkey") / 1000).cast("string")), "line": F.col("p_partkey"), "text": F.col("p_type")})
    rules = p.where("p_type = 'ECONOMY'").select("page", "line", F.lit(0.0).alias("left"), F.lit(100.0).alias("right"), F.lit(100.0).alias("y"))
    tokens = p.where("p_type <> 'ECONOMY'").select("page", s.alias("left"), (s + 5).alias("right"), (s + 80).alias("top"), (s + 88).alias("bottom"), "text")
    return ly.fractions(rules, tokens)


@query(f"""WITH p AS ({_BAND}), b AS (SELECT page, id FROM p WHERE p_type = 'ECONOMY'), t AS (SELECT page, p_type AS text, 10 + p_size / 10 AS l, top + 5 AS m FROM p WHERE p_type <> 'ECONOMY'),
        j AS (SELECT page, id, CASE WHEN m < 105 THEN 'super' WHEN m > 115 THEN 'sub' END AS kind, l, text FROM b JOIN t USING (page) WHERE l - 10 BETWEEN 0 AND 4)
    SELECT page, id, kind, arg_min(text, struct_pack(l := l, t := text)) AS script FROM j WHERE kind IS NOT NULL GROUP BY ALL""")
def formula_scripts(spark, d):
    """Super- and subscripts beside the bases of formulas."""
    s = F.col("p_size")
    p = table(spark, d, "part").withColumn("page", F.concat("p_brand", F.lit("/"), F.floor(F.col("p_partkey") / 1000).cast("string")))
    bases = p.where("p_type = 'ECONOMY'").select("page", F.col("p_partkey").alias("id"), *[F.lit(v).alias(n) for n, v in (("left", 0.0), ("right", 10.0), ("top", 100.0), ("bottom", 120.0))])
    tokens = p.where("p_type <> 'ECONOMY'").select("page", F.col("p_type").alias("text"), (10 + s / 10).alias("left"), (80.0 + s).alias("top"), (90.0 + s).alias("bottom"))
    return ly.scripts(tokens, bases)


@query(f"""WITH {TREE} SELECT t.id, CASE WHEN t.parent IS NULL THEN '' WHEN p.parent IS NULL THEN p.id WHEN g.parent IS NULL THEN g.id || '>' || p.id ELSE h.id || '>' || g.id || '>' || p.id END AS ancestors,
        count(*) OVER (PARTITION BY t.parent) - 1 AS siblings FROM tree t LEFT JOIN tree p ON t.parent = p.id LEFT JOIN tree g ON p.parent = g.id LEFT JOIN tree h ON g.parent = h.id""")
def branch_contexts(spark, d):
    """What a branch is told of the tree above it."""
    return tr.context_of(tree(spark, d))


@query(f"""WITH {TREE} SELECT CASE WHEN id = 'n1' THEN 'r0' ELSE parent END AS source, id AS target, CASE WHEN id = 'n1' THEN 0.9 ELSE (pos % 10) / 10 END AS score
    FROM tree WHERE parent IS NOT NULL""")
def changed_parents(spark, d):
    """A tree's edges after a node is moved under another parent."""
    e = tree(spark, d).where("parent is not null").select(F.col("parent").alias("source"), F.col("id").alias("target"), ((F.col("pos") % 10) / 10).alias("score"))
    alternatives = spark.range(1).select(F.lit("n1").alias("child"), F.lit("r0").alias("parent"), F.lit("direct_parent").alias("classification"), F.lit(True).alias("has_evidence"), F.lit(0.9).alias("score"))
    return tr.change_parent(e, alternatives, "n1", "r0")

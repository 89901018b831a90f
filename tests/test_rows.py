"""Rules of single inventory rows that no query shows, on rows made for them."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from sparkloom.functions import claims as cm
from sparkloom.functions import text as tx
from sparkloom.operators import client as cl
from sparkloom.operators import coverage as cv
from sparkloom.operators import graph as gr
from sparkloom.operators import metrics as mt
from sparkloom.operators import patch as pt
from sparkloom.operators import resolve as rs
from sparkloom.operators import segment as sg
from sparkloom.operators import tree as tr
from sparkloom.plans import storage, store
from sparkloom.streaming import events as ev


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first().v


def rows(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()))


def strings(*values):
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def test_text_rules(spark):
    assert one(spark, tx.without_page_markers(F.lit("a\r\n 12 \n\n第 3 页\nb "))) == "a\nb"
    assert one(spark, tx.is_low_quality(F.lit("a"))) and not one(spark, tx.is_low_quality(F.lit("plain text ")))
    act = lambda label, definition, mends, trims, stated: one(spark, tx.field_action(strings(*label), strings(*definition), F.lit(mends), F.lit(trims), F.lit(stated)))
    assert act("i", "d", False, True, True) == "reject_entire_node" and act("i", "d", False, True, False) == "reextract_candidate" == act("i", "d", True, False, True) == act("", "d", True, False, True)
    assert act("i", "d", True, True, True) == "repair_label_and_trim_definition_keep_claim" and act("i", "d", True, False, False) == "repair_label_keep_claim"
    assert act("", "d", False, True, True) == "trim_definition_keep_claim" and act("", "d", False, False, False) == "accept" == act("", "", False, False, True)
    assert one(spark, tx.short_label(F.lit("## Heat flow: and more\nnext"), F.lit("other"))) == "Heat flow"
    assert one(spark, tx.short_label(F.lit("x" * 40), F.lit("other"))) == "other"
    for text, specific in (("ab", False), ("abcdef", True), ("力学 学", True), ("a = b", True), ("=", False), ("基本概念", False), ("a->b", True), ("ab+c", True), ("ab+", False), ("x = ", False)):
        assert one(spark, tx.is_specific(F.lit(text))) is specific, text
    cover = lambda anchors, a, b: one(spark, tx.anchor_coverage(strings(*anchors), F.lit(a), F.lit(b)))
    assert cover(["heat"], "heat flow", "heat") == 1.0 and cover(["heat"], "heat flow", "heat sink") == 0.5 and cover([], "", "x") == 0.0
    assert [(a, s, b) for a, s, b in cm.relation_claims("so E = 3 and a<=b")] == [("E", "=", "3"), ("a", "<=", "b")] or len(cm.relation_claims("so E = 3 and a<=b")) == 2


def test_resolution_rules(spark):
    share = lambda a, b: one(spark, rs.shared_provenance({"u": strings(*a[0]), "p": strings(*a[1])}, {"u": strings(*b[0]), "p": strings(*b[1])}))
    assert share((["u1"], []), (["u2", "u1"], [])) and share(([], ["3"]), (["u"], ["3"])) and not share((["u1"], ["3"]), (["u2"], ["4"]))
    box = "page int, idx int, x double, y double, w double, h double, hash string"
    assets = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0, "ff00"), (1, 1, 50.0, 50.0, 10.0, 10.0, "ff00"), (2, 0, 0.0, 0.0, 10.0, 10.0, "ff00")], box)
    natives = spark.createDataFrame([(1, 7, 1.0, 0.0, 10.0, 10.0, "ff01"), (1, 3, 0.0, 0.0, 10.0, 10.0, "00ff"), (1, 9, 0.0, 0.0, 10.0, 10.0, "ff00"), (1, 8, 56.0, 50.0, 10.0, 10.0, "ff00")], box)
    assert rows(rs.match_native(assets, natives)) == [(1, 0, 7)]
    owned = rs.owner_of(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "asset string, unit int"), spark.createDataFrame([("x", 1, 0.9), ("y", 1, 0.5), ("y", 2, 0.5), ("z", 1, 0.9)], "candidate string, unit int, confidence double"))
    assert rows(owned, "asset", "candidate") == [("a", "y"), ("b", "x")]
    df = spark.createDataFrame([(1, "x", 2.0), (1, "x", 2.0), (2, "x", 2.0)], "a int, b string, c double")
    ids = [r[0] for r in df.select(sg.stable_id("p_", "c", "a", "b")).collect()]
    assert ids[0] == ids[1] != ids[2] and ids == [r[0] for r in df.select(sg.stable_id("p_", "b", "c", "a")).collect()] and ids[0].startswith("p_")
    topics = rs.upsert(spark.createDataFrame([("k", "old"), ("l", "kept")], "key string, name string"), spark.createDataFrame([("k", "new"), ("m", "added")], "key string, name string"), "key", ["name"])
    assert rows(topics) == [("k", "new", "conflict"), ("l", "kept", "kept"), ("m", "added", "added")]


def test_graph_and_tree_rules(spark):
    nodes = spark.createDataFrame([("heat", "n1"), ("light", "n2")], "key string, node_id string")
    edges = spark.createDataFrame([("Heat", "makes", " LIGHT ", 0.5), ("heat", "makes", "light", 0.7), ("heat", "is", "unknown", 0.9), ("heat", "is", "HEAT", 0.9)], "source string, predicate string, target string, confidence double")
    assert rows(gr.build_edges(edges, nodes), "source", "predicate", "target", "confidence", "n") == [("n1", "makes", "n2", 0.6, 2)]
    links = spark.createDataFrame([("a", t, "r", s, e) for t, s, e in (("b", 0.9, True), ("c", 0.8, True), ("d", 0.75, True), ("e", 0.95, False), ("f", 0.6, True), ("zz", 0.9, True), ("a", 1.0, True))], "source string, target string, relation string, score double, has_evidence boolean")
    state = dict(rows(gr.cross_links(links, spark.createDataFrame([(x,) for x in "abcdef"], "id string")), "target", "state"))
    assert state == {"b": "selected", "c": "selected", "d": "over_limit", "e": "review", "f": "low_score", "zz": "unknown_end"}
    n = spark.createDataFrame([("r", "b", "Heat", "", "branch_topic", "extracted", False, 0.9), ("s", "b", "Sun", "", "concept", "structural", False, 0.5), ("c", "b", "Heat flow", "of heat", "concept", "extracted", False, 0.5), ("o", "x", "Other", "", "concept", "extracted", False, 0.5)], "node_id string, branch_id string, name string, definition string, role string, origin string, is_root boolean, confidence double")
    found = rows(gr.suggest_parents(n), "child_id", "parent_id", "rank")
    assert ("c", "r", 1) in found and not any("o" in (c, p) or c == p for c, p, _ in found)
    assert rows(gr.top_per(spark.createDataFrame([("k", 1.0, "b"), ("k", 2.0, "a"), ("k", 2.0, "c"), ("l", 0.0, "d")], "k string, s double, v string"), ["k"], [F.desc("s"), F.col("v")], 1), "k", "v") == [("k", "a"), ("l", "d")]
    for issues, support, evidence, ok in ([], ["u"], [], True), ([], [], ["e"], True), (["x"], ["u"], [], False), ([], [], [], False):
        assert one(spark, tr.is_eligible(strings(*issues), F.lit(False), strings(*support), strings(*evidence))) is ok
    t = spark.createDataFrame([("r", None, 0), ("b", "r", 1), ("a", "r", 0), ("c", "a", 0), ("d", "a", 1)], "id string, parent string, pos int")
    assert [x.id for x in tr.preorder(t).orderBy("path").collect()] == ["r", "a", "c", "d", "b"]
    assert rows(tr.collapse(t, 3)) == [("a", 1, 2), ("b", 1, 0), ("r", 0, 0)]
    e = spark.createDataFrame([("r", "a", 0.5), ("a", "c", 0.5), ("r", "b", 0.5)], "source string, target string, score double")
    alt = spark.createDataFrame([("c", "b", "direct_parent", True, 0.8), ("a", "c", "direct_parent", True, 0.9)], "child string, parent string, classification string, has_evidence boolean, score double")
    assert ("b", "c", 0.8) in rows(tr.change_parent(e, alt, "c", "b")) and rows(tr.change_parent(e, alt, "a", "c")) == rows(e)


def test_coverage_rules(spark):
    u = spark.createDataFrame([(g, i) for g, n in (("a", 9), ("b", 3), (None, 2)) for i in range(n)], "g string, i int")
    assert [(r.g, r.i) for r in cv.stratified(u, "g", "i", 7).orderBy("rank").collect()] == [(None, 0), ("a", 0), ("b", 0), (None, 1), ("a", 8), ("b", 2), ("a", 4)]
    at = spark.createDataFrame([(3, 5), (None, 5), (None, None)], "p int, s int").select(cv.coordinate(F.col("p"), F.col("s")).alias("c"))
    assert [r.c for r in at.collect()] == [3, 5, None]
    assert [one(spark, cv.planning_weight(F.lit(x).cast("int"))) for x in (None, 0, 1, 5)] == [2, 1, 1, 5]
    units = spark.createDataFrame([(1, "uncovered", 0.9), (2, "uncovered", 0.5), (3, "rejected", 0.9), (4, "uncovered", 0.9)], "id int, status string, importance double")
    assert dict(rows(cv.audit(units, spark.createDataFrame([(4,)], "id int")), "id", "status")) == {1: "uncovered", 2: "deferred", 3: "rejected", 4: "covered"}
    plans = spark.createDataFrame([("x", 3, 5, None), ("x", 3, None, 1), ("y", 1, 6, None), ("z", 0, None, None), ("a", 2, None, 1), ("b", 1, None, 1)], "plan string, n int, page int, slide int")
    assert rows(cv.plan_places(plans), "place", "plan") == [(1, "x"), (2, "y"), (3, "b"), (4, "a"), (5, "z")]
    v = spark.createDataFrame([(1, "explicit", [1], [], False), (2, "explicit", [9], [1, 2], False), (3, "abstractive", [], [1], True), (4, "abstractive", [], [1, 2], True), (5, "structural", [], [1], False)], "id int, origin string, evidence array<int>, support array<int>, optional boolean")
    assert rows(cv.verified(v.withColumn("valid", F.array(F.lit(1), F.lit(2))), "valid"), "id") == [(1,), (4,), (5,)]
    many = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"))
    assert all(r.n == r.v + 1 for r in storage.numbered(many, [F.col("v")], "n").collect())


def test_patch_rules(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "id string") for xs in (["n1", "n2"], ["n2"]))
    assert rows(pt.locality(a, b, "id")) == [("n1",)]
    item = Row("status", "text")
    df = spark.createDataFrame([Row(i=[item("open", "a"), item("open", "b")])])
    assert [tuple(x) for x in df.select(pt.last_overlaid(F.col("i"), F.lit("done"))).first()[0]] == [("open", "a"), ("done", "b")]
    assert df.select(pt.last_overlaid(F.slice("i", 1, 0), F.lit("done"))).first()[0] == []
    nodes = [{"id": i, "parent_id": p} for i, p in (("r", None), ("a", "r"), ("x", "a"), ("b", "r"))]
    moved, idle = pt.apply_patch(nodes, [{"op": "move", "target": "x", "new_parent": "b"}, {"op": "position", "target": "b", "before": "a"}, {"op": "move", "target": "x", "new_parent": "b"}, {"op": "add", "node": {"id": "y", "parent_id": "a"}}, {"op": "delete", "target": "x"}])
    assert [n["id"] for n in moved] == ["r", "b", "a", "y"] and idle == [2] and [n["id"] for n in nodes] == ["r", "a", "x", "b"]
    for bad in ({"op": "move", "target": "a", "new_parent": "x"}, {"op": "delete", "target": "a"}, {"op": "update", "target": "q", "changes": {}}, {"op": "add", "node": {"id": "a", "parent_id": "r"}}, {"op": "position", "target": "x", "after": "b"}):
        try:
            pt.apply_patch(nodes, [bad])
            raise AssertionError(bad)
        except pt.PatchError:
            pass


def test_events_metrics_and_client_rules(spark):
    c = lambda a, b, x, y: one(spark, ev.covers(F.lit(a), F.lit(b), strings(*x), strings(*y)))
    assert c("abc", "b", ["1", "2"], ["2"]) and not c("abc", "d", ["1"], []) and not c("abc", "b", ["1"], ["2"])
    log = spark.createDataFrame([("j", 1, "run", 30, False), ("j", 2, "", 20, False), ("j", 3, "again", 0, True), ("j", 4, None, 150, False), ("j", 5, "end", 40, False)], "job string, seq int, status string, progress int, reset boolean")
    assert rows(store.merge_jobs(log, "job", "seq", ["status"], "progress", F.col("reset")), "status", "progress", "updates") == [("end", 100.0, 5)]
    status = spark.createDataFrame([(True, True), (False, True), (False, False)], "f boolean, d boolean").select(mt.page_status(F.col("f"), F.col("d")).alias("s"))
    assert [r.s for r in status.collect()] == ["failed", "degraded", "accepted"]
    calls = spark.createDataFrame([("a", "ok", 10.0), ("a", "error", 30.0), ("a", "ok", 20.0), ("b", "ok", 5.0)], "role string, status string, ms double")
    assert rows(mt.call_summary(calls, ["role"], "status", "ms"), "role", "calls", "errors", "p50", "highest", "mean", "all_ok") == [("a", 3, 1, 20.0, 30.0, 20.0, False), ("b", 1, 0, 5.0, 5.0, 5.0, True)]
    w = spark.createDataFrame([("x", 5), ("y", None), ("z", 9), ("a", 5)], "id string, at int")
    assert [r.id for r in cl.by_recency(w, "at", "id").collect()] == ["z", "a", "x", "y"]
    assert [r.id for r in cl.by_saved_order(w, spark.createDataFrame([("x", 1), ("z", 0)], "id string, rank int"), "id").collect()] == ["a", "y", "z", "x"]
    assert one(spark, cl.distinct_flat([strings("b", "a"), strings("a", "c", "b")])) == ["b", "a", "c"]
    for s, t, want in ((0, 2, ["b", "c", "a"]), (2, 0, ["c", "a", "b"]), (1, 1, ["a", "b", "c"])):
        assert one(spark, cl.moved(strings("a", "b", "c"), F.lit(s), F.lit(t))) == want


def test_event_slices_hold_order_barriers_and_bound(spark):
    log = [(1, i, i % 90 == 50) for i in range(500)]
    got = ev.slices(spark.createDataFrame(log, "k int, seq int, control boolean"), "k", "seq", F.col("control")).orderBy("first").collect()
    assert [r.first for r in got] == [0] + [r.last + 1 for r in got][:-1] and got[-1].last == 499 and max(r.n for r in got) <= 100
    assert {r.last for r in got if r.barrier} == {i for _, i, control in log if control}


def test_store_rules(spark):
    runs = spark.createDataFrame([(1, "running", "a", 40), (2, "running", "b", 50)], "run_id int, status string, stage string, progress int")
    updates = spark.createDataFrame([(1, "completed", None), (3, "completed", "x")], "run_id int, status string, stage string")
    assert rows(store.update_runs(runs, updates), "run_id", "status", "stage", "progress") == [(1, "completed", "a", 100), (2, "running", "b", 50)]
    calls = spark.createDataFrame([(1, "r", "i", "m1", "ok"), (2, "r", "i", "m2", "error"), (3, "", "i", "m", "ok"), (4, None, "i", "m", "ok"), (5, "r", "", "m", "ok")], "seq int, run_id string, item_id string, model string, status string")
    assert rows(store.record_calls(calls, "seq", ["model"], ["status"])) == [("r", "i", "m1", "error")]
    names = spark.createDataFrame([(1, " Ann"), (2, "ann "), (3, "Bo")], "seq int, name string")
    assert rows(store.register(names, "seq", "name")) == [("ann", 1, 1, True), ("bo", 3, 0, False)]
    old = spark.createDataFrame([("r1", "a"), ("r2", "b")], "run string, item string")
    assert rows(store.save_items(old, old.where("item = 'x'"), spark.createDataFrame([("r1",)], "run string"), "run")) == [("r2", "b")]


def test_no_private_folder_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    def session(master, setting=None, checkpoint=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: setting), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: checkpoint))

    assert storage.folder(session("spark://host:7077", "hdfs://x/c/")) == "hdfs://x/c" and storage.folder(session("yarn", None, "hdfs://y")) == "hdfs://y"
    with pytest.raises(RuntimeError):
        storage.folder(session("spark://host:7077"))
    assert storage.folder(session("local[2]")).startswith("file://")

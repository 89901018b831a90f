"""Smaller operators on rows made for them."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from sparkloom.functions import text as tx
from sparkloom.operators import coverage as cv
from sparkloom.operators import graph as gr
from sparkloom.operators import layout as ly
from sparkloom.operators import patch as pt
from sparkloom.operators import resolve as rs
from sparkloom.operators import review as rv
from sparkloom.operators import segment as sg
from sparkloom.operators import tree as tr
from sparkloom.sources import documents as sd


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first().v


def test_text(spark):
    assert one(spark, tx.latex_canonical(F.lit(r"\frac{a}{b} \times 10^{-3} \leq X"))) == "a/b*10^-3<=x"
    assert one(spark, tx.repaired_definition(F.lit("Fine. Then it is □ broken"))) == "Fine." and one(spark, tx.repaired_definition(F.lit("whole"))) == "whole"
    assert tuple(one(spark, tx.swarm_counts(F.lit('<task id="1" status="completed"><result><task status="failed"></result></task><task status="failed">')))) == (1, 1, 2)
    n = F.lit(None).cast("long")
    assert [one(spark, tx.context_used(a, b, r, F.lit(1000), F.lit(7).cast("long"))) for a, b, r in ((F.lit(5).cast("long"), n, n), (n, F.lit(6).cast("long"), n), (n, n, F.lit(0.25)), (n, n, n))] == [5, 6, 250, 7]
    df = spark.createDataFrame([Row(b=[Row(type="text", text="hi"), Row(type="tool", text="ls"), Row(type="thinking", text="a\nb")])])
    assert df.select(tx.turn_markdown(F.col("b"))).first()[0] == "hi\n\n```\nls\n```\n\n> a\n> b"


def test_sources(spark):
    s = spark.createDataFrame([("j", 1, "b.md", "d2"), ("j", 0, "a.md", "d1")], "job string, idx int, name string, doc_id string")
    b = spark.createDataFrame([("d1", 0, "x", None), ("d2", 0, "y", "H"), ("d1", 1, "z", "G")], "doc_id string, ordinal int, text string, heading string")
    assert rows(sd.concatenated(s, b, "job")) == [("j", 0, "x", "[a.md]"), ("j", 1, "z", "[a.md] G"), ("j", 2, "y", "[b.md] H")]
    u = spark.createDataFrame([("j", 0, bytearray(b"ab"), 2), ("j", 1, bytearray(b"c"), 3)], "job string, idx int, content binary, pages int")
    t = sd.upload_totals(u, "job").first()
    assert (t.files, t.bytes, t.pages) == (2, 3, 5)
    assert rows(sd.export_json(s.where("idx = 0"), "job")) == [("j", '{"doc_id":"d1","idx":0,"job":"j","name":"a.md"}')]
    assert one(spark, sd.better_of(F.lit("?!"), F.lit("E = mc^2"))) == "E = mc^2" and one(spark, sd.better_of(F.lit("good text"), F.lit("E = mc^2"))) == "good text"


def test_segments(spark):
    p = spark.createDataFrame([(1, 0, "a"), (1, 1, " "), (1, 2, "b")], "doc long, n int, t string")
    assert rows(sg.page_units(p, "doc", "n", "t")) == [(1, "unit_0001", "a"), (1, "unit_0002", "b")]
    assert [tuple(one(spark, sg.source_reference(F.lit(n), F.lit(m), F.lit(s)))) for n, m, s in ((5, "mixed", 3), (3, "mixed", 3), (5, "text", 3), (5, "slides", 0))] == [("text", 2), ("slide", 3), ("text", 5), ("text", 5)]
    df = spark.createDataFrame([Row(r=[Row(start=1, end=2)], p=[Row(k=1)])])
    assert [tuple(x) for x in df.select(sg.shifted(F.col("r"), F.lit(10))).first()[0]] == [(11, 12)]
    assert df.select(sg.compacted(F.col("p"), F.lit("abcdef"), 13)).first()[0] == '[{"k":1}]\nabc'
    assert abs(one(spark, sg.node_weight(F.lit("definition"), F.lit(0.5))) - 0.704) < 1e-9 and abs(one(spark, sg.node_weight(F.lit("step"), F.lit(0.5))) - 0.644) < 1e-9
    t = sg.theme_nodes(spark.createDataFrame([("Heat Flow", 0.5), ("Light", 0.4)], "label string, confidence double"), spark.createDataFrame([("heat-flow", "b1")], "label string, branch string"))
    assert rows(t, "label") == [("Heat Flow", "b1", "branch_topic", 0.5), ("Light", "light", "branch_topic", 0.4)]
    nested = spark.createDataFrame([Row(page=1, nodes=[Row(id="x"), Row(id="y")])])
    assert rows(sg.page_records(nested, "nodes")) == [(1, 0, "x"), (1, 1, "y")]
    nodes, edges = sg.extract(spark.createDataFrame([("c", "力学", "牛顿力是指物体之间的相互作用。\n牛顿定律")], "chunk_id string, heading string, text string"))
    assert {"牛顿力", "力学", "牛顿定律"} <= {r.name for r in nodes.collect()} and ("力学", "includes", "牛顿力", 0.42) in [tuple(r)[1:] for r in edges.collect()]


def test_graph(spark):
    v = lambda *a: tuple(one(spark, gr.heuristic_vote(*map(F.lit, a))))
    assert v(True, "x", "branch_topic", "a", "b", False, False, "k", 0.5) == ("direct_parent", 0.94) and v(True, "x", "y", "a", "b", False, False, "k", 0.9) == ("ancestor_only", 0.62)
    assert v(False, "branch_topic", "y", "a", "a", False, False, "k", 0.5) == ("direct_parent", 0.82) and v(False, "branch_topic", "y", "a", "b", True, False, "k", 0.5) == ("unrelated", 0.28)
    assert v(False, "step", "y", "a", "a", True, False, "k", 0.2) == ("sibling", 0.2) and v(False, "x", "y", "", "b", True, False, "k", 0.5) == ("direct_parent", 0.72)
    assert v(False, "x", "y", "a", "a", False, True, "k", 0.5) == ("uncertain", 0.5) and v(False, "x", "y", "a", "a", False, False, "k", 0.5) == ("k", 0.5)
    assert one(spark, gr.with_vote(F.lit(0.5), F.lit("direct_parent"), F.lit(1.0))) == 0.775 and one(spark, gr.with_vote(F.lit(0.5), F.lit("sibling"), F.lit(1.0))) == 0.1275
    assert one(spark, gr.scope_ids([F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a"))])) == ["a", "b"]
    b = spark.createDataFrame([("x", ["x", "y", "r"]), ("z", ["z", "r"])], "branch string, path array<string>")
    assert rows(gr.nearest_topic(b, spark.createDataFrame([("y", "t1"), ("r", "t0")], "branch string, topic string"))) == [("x", "t1"), ("z", "t0")]
    i = spark.createDataFrame([("i", [1], ["n"])], "issue_id string, pages array<int>, node_ids array<string>")
    assert rows(gr.revision_pages(i, spark.createDataFrame([("n", [3, 1]), ("m", [9])], "id string, pages array<int>"))) == [(1,), (3,)]


def test_trees(spark):
    e = spark.createDataFrame([("a", "b", True, True), ("a", "c", True, False), ("a", "d", True, True), ("b", "d", True, True)], "source string, target string, provisional boolean, has_evidence boolean")
    assert [r.provisional for r in tr.confirm_edge(e, "b").orderBy("target", "source").collect()] == [False, True, True, True]
    assert all(r.provisional for r in tr.confirm_edge(e, "d").collect())
    n = spark.createDataFrame([("r", None, 0), ("a", "r", 0), ("b", "r", 1), ("c", "a", 0)], "id string, parent string, pos int")
    assert rows(tr.context_of(n)) == [("a", "r", 1), ("b", "r", 1), ("c", "r>a", 0), ("r", "", 0)]
    p = spark.createDataFrame([("a", 1, [1, 9]), ("b", 7, [1]), ("c", 1, [2])], "id string, depth int, pages array<int>")
    assert rows(tr.bad_pages(p, 5, 6)) == [("a", "page"), ("b", "depth")]
    nodes = spark.createDataFrame([(1, x, i, i == 0) for i, x in enumerate("rabc")] + [(2, x, i, i == 0) for i, x in enumerate("rab")], "doc_id long, id string, seq int, is_root boolean")
    cands = spark.createDataFrame([(1, "r", "a", 0.9), (1, "r", "b", 0.8), (1, "a", "b", 0.7), (1, "b", "c", 0.4), (1, "r", "c", 0.6), (2, "a", "b", 1.0), (2, "b", "a", 1.0)], "doc_id long, parent string, child string, score double")
    got = {(r.doc_id, r.id): r.parent for r in tr.exact_tree(nodes, cands, 2, 3).collect()}
    assert got == {(1, "r"): None, (1, "a"): "r", (1, "b"): "a", (1, "c"): "r"}
    alt = spark.createDataFrame([("c", "b", "direct_parent", True, 1.7), ("a", "c", "direct_parent", True, 0.5)], "child string, parent string, classification string, has_evidence boolean, score double")
    edges = spark.createDataFrame([("r", "a", 0.5), ("r", "b", 0.5), ("a", "c", 0.5)], "source string, target string, score double")
    assert rows(tr.change_parent(edges, alt, "c", "b")) == [("b", "c", 1.0), ("r", "a", 0.5), ("r", "b", 0.5)]
    assert rows(tr.change_parent(edges, alt, "a", "c")) == rows(edges)
    bad = tr.gate_failures(tr.validate(spark.createDataFrame([("a", "x"), ("b", "X"), ("c", "y")], "id string, name string"), spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "zz")], "source string, target string"))).first()
    assert (bad.root_count, bad.unreachable_count, bad.invalid_edges, bad.duplicate_labels, bad.topology_valid) == (1, 2, 1, 1, False) and bad.failures == "unreachable,invalid_edges,duplicate_labels"


def test_coverage(spark):
    c = spark.createDataFrame([("a", [1, 2], [1], False), ("b", [1], [1], True), ("c", [9], [1], False)], "id string, u array<int>, bu array<int>, abstract boolean")
    assert [r.id for r in cv.supported(c, "u", "bu").collect()] == ["a"]
    b = spark.createDataFrame([(1, "short"), (2, "long enough text")], "page int, t string")
    assert rows(cv.signal_pages(b, "page", "t")) == [(2,)]
    u = spark.createDataFrame([("d", "visual", 1, None, 0, "v"), ("d", "text", None, 1, 1, "t"), ("d", "text", None, None, 2, "n")], "d string, kind string, page int, slide int, idx int, id string")
    assert [r.id for r in cv.in_source_order(u, "d").orderBy("place").collect()] == ["v", "t", "n"]
    m = spark.createDataFrame([("p", 0, 5, None), ("q", 1, 2, None), ("x", 2, None, None)], "plan string, n int, page int, slide int")
    assert [r.plan for r in cv.plan_places(m).orderBy("place").collect()] == ["q", "p", "x"]
    o = spark.createDataFrame([("n1", "u1", 1), ("n1", "u2", 0), ("n2", "u2", 0)], "node string, unit string, place int")
    assert rows(cv.owners(o).select("node", "unit", "owned")) == [("n1", "u2", 2), ("n2", "u2", 2)]
    p = spark.createDataFrame([("b", i, i, n) for i, n in enumerate([3, 3, 2, 4])] + [("c", i, i, 1) for i in range(12)], "branch string, plan long, seq long, leaves long")
    got = cv.consolidated(p, 6).collect()
    assert [r.part for r in sorted(got) if r.branch == "b"] == [0, 0, 1, 1] and [r.part for r in sorted(got) if r.branch == "c"] == [0] * 6 + [1] * 6


def test_resolution(spark):
    flat = [float((i * 7 + (i // 32) * 3) % 50) for i in range(1024)]
    df = spark.createDataFrame([(flat,), ([v * 2 + 1 for v in flat],), ([50 - v for v in flat],)], "p array<double>")
    a, b, c = (r[0] for r in df.select(rs.dct_hash(F.col("p"))).collect())
    assert a == b and len(a) == 16 and a != c
    inc = spark.createDataFrame([(1, 0, "i1", None), (1, 1, "i2", None), (1, 2, "i3", "t"), (1, 3, "i4", None), (1, 4, "i5", "zz")], "page int, n int, identity string, temp_id string")
    got = rs.repairable(inc, spark.createDataFrame([("i1",)], "identity string"), spark.createDataFrame([("t",)], "temp_id string"), 1)
    assert [r.identity for r in got.orderBy("n").collect()] == ["i1", "i2", "i3"]
    assert rs.supplemented(df.limit(0).select(F.lit("k").alias("k")), spark.createDataFrame([("x",)], "k string"), "k").count() == 1
    assert [r.id for r in rs.lone_scaffolds(spark.createDataFrame([(1, "b", "k", True), (2, "b", "k", False), (3, "b", "z", True)], "id long, branch_id string, key string, is_scaffold boolean")).collect()] == [1]


def test_layout_rows(spark):
    lines = spark.createDataFrame([(1, 0, 10.0, 60.0, 100.0), (1, 1, 0.0, 5.0, 50.0)], "page int, line int, left double, right double, y double")
    tokens = spark.createDataFrame([(1, 20.0, 30.0, 88.0, 98.0, "a"), (1, 31.0, 40.0, 88.0, 98.0, "b"), (1, 25.0, 35.0, 102.0, 112.0, "c"), (1, 25.0, 35.0, 300.0, 310.0, "far")], "page int, left double, right double, top double, bottom double, text string")
    assert rows(ly.fractions(lines, tokens)) == [(1, 0, "ab", "c")]
    base = spark.createDataFrame([(1, "x", 0.0, 10.0, 0.0, 20.0)], "page int, id string, left double, right double, top double, bottom double")
    tok = spark.createDataFrame([(1, 11.0, 15.0, -2.0, 6.0, "2"), (1, 12.0, 15.0, 16.0, 24.0, "i"), (1, 30.0, 33.0, 0.0, 4.0, "9")], "page int, left double, right double, top double, bottom double, text string")
    assert rows(ly.scripts(tok, base)) == [(1, "x", "sub", "i"), (1, "x", "super", "2")]
    lab = spark.createDataFrame([(1, 0, "(1)", True), (1, 1, "E=mc", False), (1, 2, "(2)", True)], "page int, n int, text string, is_label boolean")
    assert [r.text for r in ly.merge_labels(lab, ["page"], "n", F.col("is_label"), "text").orderBy("n").collect()] == ["(1) E=mc", "(2)"]
    assert one(spark, ly.clipped_box(F.lit(-5.0), F.lit(50.0), F.lit(60.0), F.lit(100.0), 100, 100)) == [0.0, 0.5, 0.55, 0.5]


def test_patch_rows(spark):
    n = spark.createDataFrame([("t", "a", "x", 0), ("t", "a", "y", 1), ("t", "b", "z", 0)], "t string, id string, name string, n int")
    assert pt.names_by_id(n, "t", "n").first().names == {"a": "y", "b": "z"}
    df = spark.createDataFrame([Row(i=[Row(status="open", n=1)]), Row(i=[])], "i array<struct<status:string,n:int>>")
    new = F.struct(F.lit("open").alias("status"), F.lit(2).alias("n"))
    assert [[tuple(x) for x in r[0]] for r in df.select(pt.queued(F.col("i"), new)).collect()] == [[("closed", 1), ("open", 2)], [("open", 2)]]
    assert one(spark, pt.set_likeness(F.array().cast("array<int>"), F.array().cast("array<int>"))) == 1.0
    d = spark.createDataFrame([("i", "accept", ["a"]), ("j", "accept", ["b"]), ("k", "reject", ["c"])], "issue_id string, decision string, nodes array<string>")
    assert [r.issue_id for r in pt.ineffective(d, spark.createDataFrame([("a",)], "node string")).collect()] == ["j"]


def test_reviews(spark):
    assert one(spark, rv.formula_issues(F.lit("a = b"), F.lit(r"\frac{a}{b"))) == ["relation_lost", "unbalanced_braces"]
    assert one(spark, rv.may_discard(F.array(F.lit("n1:label_generic"), F.lit("n1:evidence_not_specific")))) and not one(spark, rv.may_discard(F.array(F.lit("n1:label_generic"), F.lit("n1:other")))) and not one(spark, rv.may_discard(F.array().cast("array<string>")))
    items = spark.createDataFrame([("a", ["x"]), (None, ["y"]), ("a", ["w", "x"]), ("b", [])], "id string, issues array<string>")
    good, bad = rv.split_valid(items, "issues")
    assert good.count() == 1 and rows(bad) == [("", ["y"], 1), ("a", ["w", "x"], 2)]
    i = spark.createDataFrame([("wording", "rename", "n", "t"), ("wording", "delete", "n", "t"), ("structure", "keep", "zz", "t"), ("wording", "rename", "n", "t")], "role string, action string, node string, text string")
    assert sorted(r.fault for r in rv.checked_report(i, spark.createDataFrame([("n",)], "id string")).collect()) == ["", "not_permitted", "unknown_node"]
    go = lambda *a: one(spark, rv.discard_eligible(*map(F.lit, a)))
    assert go("covered", "other", 0.3, "edge", "x") and not go("covered", "step", 0.1, "edge", "x") and not go("rejected", "other", 0.1, "edge", "x") and not go("covered", "other", 0.4, "edge", "背景")
    assert go("uncovered", "other", 0.5, "introduction", "An Overview") and not go("uncovered", "other", 0.5, "introduction", "x") and not go("uncovered", "other", 0.6, "introduction", "背景")
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    about = lambda k, x, t: tuple(one(spark, rv.subject_of(F.lit(k), arr(*x) if x else F.array().cast("array<string>"), F.lit("r"), arr(*t))))
    assert about("root_choice", "ab", "b") == ("r", "root") and about("competing_parent", "ab", "bz") == ("b", "tree_edge") and about("competing_parent", "ab", "ab") == ("a", "node")
    assert about("cross_link", "", "z") == ("r", "cross_link") and about("other", "ba", "z") == ("b", "node")
    assert rows(rv.risk_pages(spark.createDataFrame([(1, True), (2, False), (3, True)], "page int, clean boolean"), spark.createDataFrame([(1,), (2,)], "page int"))) == [(1,)]

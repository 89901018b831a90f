"""Operators against invariants and slower definitions."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.operators import coverage as cv
from sparkloom.operators import layout as ly
from sparkloom.operators import patch as pt
from sparkloom.operators import resolve as rs
from sparkloom.operators import segment as sg
from sparkloom.operators import tree as tr
from sparkloom.sources import documents as sd


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab .!?\n", max_size=80), max_size=12), st.integers(5, 60), st.integers(0, 20))
def test_packing_loses_nothing(texts, limit, overlap):
    blocks = [(t, i // 3 or None, None) for i, t in enumerate(texts)]
    chunks = sg.pack(blocks, limit, min(overlap, limit - 1))
    squeeze = lambda s: "".join(s.split())
    assert squeeze("".join(c["text"] for c in chunks)) == squeeze("".join(texts))
    assert all(len(c["text"]) <= limit for c in chunks)
    assert all(c["context_before"] == "" or a["page"] == c["page"] for a, c in zip(chunks, chunks[1:]))


def test_chunk_ids_do_not_depend_on_row_order(spark):
    rows = [(d, i, f"line {i} of {d}. " * 30, None, "h" if i > 3 else None) for d in range(3) for i in range(8)]
    schema = "doc_id long, ordinal int, text string, page int, heading string"
    a = sg.chunks(spark.createDataFrame(rows, schema)).collect()
    random.Random(1).shuffle(rows)
    b = sg.chunks(spark.createDataFrame(rows, schema).repartition(5)).collect()
    assert sorted(a) == sorted(b) and len({r.chunk_id for r in a}) == len(a)


def test_headings_carry_forward(spark):
    df = spark.createDataFrame([(1, "# One\n\npara\n\n\n## Two\ntext\n\n  \n\nlast"), (2, None), (3, "")], "d long, t string")
    got = [(r.doc_id, r.text, r.heading) for r in sd.text_blocks(df, "d", "t").orderBy("doc_id", "ordinal").collect()]
    assert got == [(1, "# One", "One"), (1, "para", "One"), (1, "## Two\ntext", "Two"), (1, "last", "Two")]
    parsed = {r.doc_id: (r.title, r.error) for r in sd.parse(spark.createDataFrame([("x/a.md", "# T\n\nb"), ("x/b.txt", "plain"), ("c.exe", "z"), ("d.txt", " ")], "path string, text string")).collect()}
    assert parsed == {"x/a.md": ("T", None), "x/b.txt": ("b", None), "c.exe": ("c", "unsupported"), "d.txt": ("d", "empty")}


def test_visible_text_and_layout_blocks(spark):
    assert sd.visible("<p>a&amp;b<br>c</p><table><tr><td>1</td><td>2</td></tr></table><script>x()</script>") == "a&b\nc\n1\t2\nx()"
    j = '[{"category":"text","text":"t","bbox":[10,20,500,1000]},{"category":"figure","text":"","bbox":[0,0,1,1]},{"category":"text","text":"u","bbox":[0.5,0.5,0.2,0.9],"confidence":0.3}]'
    got = sd.layout_blocks(spark.createDataFrame([(1, 1, None, None, 0.9, j)], "doc_id long, page int, width double, height double, confidence double, json string")).orderBy("ordinal").collect()
    assert [(r.text, r.bbox, r.confidence, r.valid) for r in got] == [("t", [0.01, 0.02, 0.5, 1.0], 0.9, True), ("u", [0.5, 0.5, 0.2, 0.9], 0.3, False)]


def test_depth_with_cycles_and_unknown_parents(spark):
    chain = [(str(i), str(i - 1) if i else None) for i in range(300)]
    odd = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "nowhere"), ("f", "e"), ("r2", None), ("g", "r2"), ("s", "s")]
    got = {r.id: (r.depth, r.root) for r in tr.ancestors_to_root(spark.createDataFrame(chain + odd, "id string, parent string")).collect()}
    assert all(got[str(i)] == (i, "0") for i in range(300))
    assert got["g"] == (1, "r2") and all(got[x] == (None, None) for x in "abcdefs")


def test_greedy_tree_is_a_tree(spark):
    rnd = random.Random(4)
    nodes = [(d, f"n{i}", i, i == 0) for d in range(3) for i in range(40)]
    cands = [(d, f"n{rnd.randrange(40)}", f"n{rnd.randrange(40)}", rnd.random()) for d in range(3) for _ in range(150)]
    got = tr.greedy_tree(spark.createDataFrame(nodes, "doc_id long, id string, seq int, is_root boolean"), spark.createDataFrame(cands, "doc_id long, parent string, child string, score double"), 4, 5).collect()
    assert len(got) == 120
    for d in range(3):
        up = {r.id: r.parent for r in got if r.doc_id == d}
        assert [i for i, p in up.items() if p is None] == ["n0"]
        for i in up:
            seen = set()
            while up[i] is not None:
                assert i not in seen
                seen.add(i)
                i = up[i]
        formal = [r.parent for r in got if r.doc_id == d and not r.provisional and r.parent]
        assert max(formal.count(p) for p in set(formal)) <= 4


@pytest.mark.parametrize("n", [1, 10, 120, 336])
def test_layouts_keep_their_distance(spark, n):
    rows = [(1, str(i), str((i - 1) // 4) if i else None, i, 80.0 + i * 37 % 90, 30.0 + i * 13 % 40) for i in range(n)]
    df = spark.createDataFrame(rows, "tree long, id string, parent string, pos int, width double, height double")
    placed = ly.layout(df)
    got = placed.collect()
    assert len(got) == n and ly.violations(placed).count() == 0
    assert {r.side for r in got} <= {"root", "right", "left"} and ly.canvas(placed).first().nodes == n


def test_violations_are_found(spark):
    rnd = random.Random(9)
    boxes = [(1, f"{i:03d}", rnd.uniform(-900, 900), rnd.uniform(-900, 900), rnd.uniform(10, 700), rnd.uniform(10, 90)) for i in range(90)]
    df = spark.createDataFrame(boxes, "tree long, id string, x double, y double, width double, height double")
    want = {(a[1], b[1]) for a in boxes for b in boxes if a[1] < b[1] and abs(a[2] - b[2]) - (a[4] + b[4]) / 2 < 24 and abs(a[3] - b[3]) - (a[5] + b[5]) / 2 < 24}
    assert {(r.a, r.b) for r in ly.violations(df).collect()} == want and want


NODES = [{"id": i, "parent_id": p, "name": i} for i, p in (("root", None), ("a", "root"), ("b", "root"), ("bc", "b"))]


def test_patches_are_all_or_nothing(spark):
    ids = lambda t: [(n["id"], n["parent_id"]) for n in t]
    tree, idle = pt.apply_patch(NODES, [{"op": "move", "target": "b", "new_parent": "a"}, {"op": "add", "node": {"id": "x", "parent_id": "root", "name": "x"}}, {"op": "update", "target": "a", "changes": {"name": "a"}}])
    assert ids(tree) == [("root", None), ("a", "root"), ("b", "a"), ("bc", "b"), ("x", "root")] and idle == [2]
    assert ids(pt.apply_patch(NODES, [{"op": "position", "target": "b", "before": "a"}])[0])[1:3] == [("b", "root"), ("bc", "b")]
    for bad in ({"op": "delete", "target": "b"}, {"op": "move", "target": "b", "new_parent": "bc"}, {"op": "add", "node": {"id": "a", "parent_id": "root"}}, {"op": "delete", "target": "none"}, {"op": "position", "target": "a", "after": "bc"}):
        with pytest.raises(pt.PatchError):
            pt.apply_patch(NODES, [bad])
    df = spark.createDataFrame([(t, k, n["id"], n["parent_id"], n["name"]) for t in (1, 2) for k, n in enumerate(NODES)], "tree long, pos int, id string, parent_id string, name string")
    ops = spark.createDataFrame([(1, 0, '{"op": "delete", "target": "bc"}'), (2, 0, '{"op": "delete", "target": "bc"}'), (2, 1, '{"op": "delete", "target": "nope"}')], "tree long, idx int, operation string")
    got = pt.apply_patches(df, ops).collect()
    assert sum(r.tree == 1 for r in got) == 3 and sum(r.tree == 2 for r in got) == 4 and {r.error for r in got if r.tree == 2} == {"no node nope"}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
def test_diffs_rebuild_both_texts(a, b):
    d = pt.diff_lines("\n".join(a), "\n".join(b))
    assert [t for k, t in d if k != "add"] == a and [t for k, t in d if k != "del"] == b
    assert pt.diff_lines("x\n" * 6000, "y") is None


def test_similar_pairs_against_all_pairs(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 9))) for _ in range(150)]
    df = spark.createDataFrame([(i, w, "x" if i % 2 else "y") for i, w in enumerate(words)], "id long, k string, g string")
    sets = [{w[j : j + 2] for j in range(max(1, len(w) - 1))} for w in words]
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if i % 2 == j % 2 and len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])}
    assert {(r.a, r.b) for r in rs.similar_pairs(df, "id", "k", ["g"], 0.6).collect()} == want


def test_spread_and_parts(spark):
    assert cv.spread_order(5) == [0, 4, 2, 1, 3] and sorted(cv.spread_order(37)) == list(range(37))
    rows = [("b", i, i, i // 2, float(i % 5 + 1)) for i in range(40)]
    got = cv.balanced_parts(spark.createDataFrame(rows, "branch string, id long, seq long, page long, weight double"), 6, 15.0).collect()
    assert sorted(r.id for r in got) == list(range(40))
    part = {r.id: r.part for r in got}
    assert all(part[i] == part[i + 1] for i in range(0, 40, 2)) and all(part[i] <= part[i + 1] for i in range(39))


def test_boxes_and_hashes(spark):
    df = spark.createDataFrame([("ffffffffffffffff", "0000000000000000"), ("0f", "0e"), ("abc", "ab"), ("8000000000000000", "0000000000000001")], "a string, b string")
    assert [r[0] for r in df.select(rs.hash_distance(F.col("a"), F.col("b"))).collect()] == [64, 1, 12, 2]
    one = df.limit(1).select(rs.iou([F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(2.0)], [F.lit(1.0), F.lit(0.0), F.lit(2.0), F.lit(2.0)]).alias("v")).first()
    assert abs(one.v - 1 / 3) < 1e-9
    assets = spark.createDataFrame([(1, 1, 0, "00000000000000ff"), (1, 1, 1, "00000000000000fe"), (1, 2, 2, "00000000000000ff"), (1, 2, 3, "ffff0000000000ff")], "deck long, slide int, idx int, hash string")
    assert [(r.idx, r.action, r.canonical) for r in sd.near_assets(assets).orderBy("idx").collect()] == [(0, "kept", 0), (1, "dropped", 0), (2, "reuse", 0), (3, "kept", 3)]

"""Queries without SQL beside plain versions of what they compute."""

import difflib
import itertools
import re

import duckdb
import pytest

from sparkloom.plans import catalog_graph, catalog_review, catalog_state, catalog_text  # noqa: F401
from sparkloom.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: QUERIES[name](spark, SF).collect()


def fetch(sql):
    return duckdb.sql(re.sub(r"\b(documents|part|orders|conversations)\b", lambda m: f"'{SF}/{m[1]}.parquet'", sql)).fetchall()


def pieces(text, limit):
    """Sentence by sentence, a character count at a time."""
    if len(text) <= limit:
        return [text]
    out, now = [], ""
    for s in [x for x in re.split(r"(?<=[。！？.!?；;])\s*", text) if x]:
        if now and len(now + s) > limit:
            out.append(now.strip())
            now = ""
        if len(s) > limit:
            out += [s[i : i + limit] for i in range(0, len(s), limit)]
        else:
            now += s
    return out + ([now.strip()] if now else [])


def test_chunks(run):
    got = {r.doc_id: (r.chunks, r.chars, r.longest) for r in run("chunk_summary")}
    for i, text in fetch("select doc_id, text from documents"):
        chunks, now = [], []
        for p in [p for line in text.split("\n") if line.strip() for p in pieces(line.strip(), 1800)]:
            if now and len("\n\n".join([*now, p])) > 1800:
                chunks.append("\n\n".join(now).strip())
                now = []
            now.append(p)
        chunks += ["\n\n".join(now).strip()] if now else []
        assert got.get(i, (0, 0, 0)) == (len(chunks), sum(map(len, chunks)), max(map(len, chunks), default=0)), i


def test_clusters(run):
    got = {r.id: r.cluster for r in run("name_clusters")}
    blocks = {}
    for i, kind, brand, name in sorted(fetch("select p_partkey, p_type, p_brand, p_name from part")):
        key = re.sub(r"[\s·•,，。；;:：()（）【】\[\]{}《》<>_-]+", "", name).lower()
        own = {key[j : j + 2] for j in range(max(1, len(key) - 1))}
        clusters = blocks.setdefault((kind, brand), [])
        at = next((n for n, c in enumerate(clusters) if all(len(own & s) >= 0.5 * len(own | s) for s in c)), len(clusters))
        if at == len(clusters):
            clusters.append([])
        clusters[at].append(own)
        assert got[i] == at


def test_stratified_sample(run):
    groups = {}
    for i, source in sorted(fetch("select doc_id, source from documents")):
        groups.setdefault(source, []).append(i)
    turns = []
    for source, ids in groups.items():
        n, order = len(ids), [0, len(ids) - 1][: len(ids)]
        while len(order) < n:
            wide = max(zip(sorted(order), sorted(order)[1:]), key=lambda g: (g[1] - g[0], -g[0]))
            order.append(sum(wide) // 2)
        turns += [(t, ids[0], source, ids[p]) for t, p in enumerate(order)]
    assert [(r.rank, r.doc_id) for r in sorted(run("stratified_sample"), key=lambda r: r.rank)] == [(n + 1, t[3]) for n, t in enumerate(sorted(turns)[:64])]


def test_line_diffs(run):
    text = {(c, t): x for c, t, x in fetch("select conv_id, turn, text from conversations")}
    before = {}
    for c, t in sorted(text):
        before[c, t] = before.get((c, "last"))
        before[c, "last"] = text[c, t]
    for r in run("line_diffs"):
        a, b = before[r.conv_id, r.turn].split("\n"), text[r.conv_id, r.turn].split("\n")
        common = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            common[i + 1][j + 1] = common[i][j] + 1 if a[i] == b[j] else max(common[i][j + 1], common[i + 1][j])
        n = common[-1][-1]
        assert (r.added, r.deleted, r.lines) == (len(b) - n, len(a) - n, len(a) + len(b) - n)


def test_balanced_leaves(run):
    part = {r.id: r.part for r in run("balanced_leaves")}
    customers = {}
    for c, o, price in sorted(fetch("select o_custkey, o_orderkey, o_totalprice from orders")):
        customers.setdefault(c, []).append((o, o // 3, price / 1e5))
    tried = 0
    for orders in customers.values():
        pages = [list(g) for _, g in itertools.groupby(orders, key=lambda x: x[1])]
        if len(pages) > 13:
            continue
        best = None
        for cut in itertools.product((0, 1), repeat=len(pages) - 1):
            groups = [[*pages[0]]]
            single = [True]
            for c, p in zip(cut, pages[1:]):
                if c:
                    groups.append([])
                    single.append(True)
                else:
                    single[-1] = False
                groups[-1] += p
            loads = [sum(x[2] for x in g) for g in groups]
            if all(s or (len(g) <= 6 and w <= 12.0) for g, w, s in zip(groups, loads, single)):
                cost = sum(w * w for w in loads)
                best = cost if best is None else min(best, cost)
        own = {}
        for o, _, w in orders:
            own[part[o]] = own.get(part[o], 0) + w
        assert abs(sum(w * w for w in own.values()) - best) < 1e-9
        tried += 1
    assert tried > 50


def test_formula_audit(run):
    p = fetch("select p_partkey, p_brand, p_size, p_name, p_type from part")
    got = {r.id: r.ratio for r in run("formula_audit")}
    assert len(got) == sum(s == 1 for _, _, s, _, _ in p)
    for i, brand, size, name, kind in p:
        if size == 1:
            seen = [t + n for _, b, s, n, t in p if b == brand and s != 1] or [""]
            want = max(1.0 if name + kind in x else round(difflib.SequenceMatcher(None, name + kind, x, autojunk=False).ratio(), 4) for x in seen)
            assert abs(got[i] - want) < 1e-9


def test_suppression_has_both_outcomes(run):
    assert {r.kept for r in run("suppressed_boxes")} == {True, False}

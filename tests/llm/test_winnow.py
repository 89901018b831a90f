import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import winnow as wn
from sparkloom.llm.queries import QUERIES


def slow_marks(hs, k=5, w=4):
    """Marks by the definition, over word hashes."""
    a = [h % wn.PRIME for h in hs]
    return a, [sum(x * pow(wn.BASE, k - 1 - j, wn.PRIME) for j, x in enumerate(a[i : i + k])) % wn.PRIME for i in range(len(a) - k + 1)]


def slow_select(g, w=4):
    if not g:
        return []
    if len(g) < w:
        v = min(g)
        return [(v, max(i for i, x in enumerate(g) if x == v))]
    out = []
    for s in range(len(g) - w + 1):
        v = min(g[s : s + w])
        at = max(i for i in range(s, s + w) if g[i] == v)
        if (v, at) not in out:
            out.append((v, at))
    return out


@pytest.mark.parametrize(("k", "w"), [(5, 4), (3, 3), (1, 1), (4, 5)])
def test_marks_against_definition(spark, k, w):
    texts = ["a b c d e f g h i j k l", "x x x x x x x x x x x x x", "one two", "", None, " ".join(str(i * i % 17) for i in range(300)), "a b c d e", "a b c d e f"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    rows = wn.winnow(df.withColumn("h", F.transform(wn.words_of(F.col("t")), lambda x: F.xxhash64(x))), "t", "m", k, w).select("i", "h", wn.positions(F.col("m")).alias("p"), F.transform("m", lambda x: F.shiftright(x, 32)).alias("v")).collect()
    for r in rows:
        a, g = slow_marks(r.h, k)
        if 0 < len(a) < k:
            assert r.p == [0]
        else:
            assert list(zip(r.v, r.p)) == slow_select(g, w), texts[r.i]


def xxhash(word):
    """The engine's hash of a string, in Python."""
    import xxhash as x

    h = x.xxh64_intdigest(word.encode(), 42)
    return h - 2**64 if h >= 2**63 else h


def slow_fingerprint(text, k=wn.RUN, w=wn.WINDOW):
    """(hash, position) of a text's marks by the definition."""
    units = [u for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x for u in (list(x) if len(x) > wn.LONG else [x])]
    a, g = slow_marks([xxhash(u) for u in units], k)
    return slow_select(g, w) if len(a) >= k else [(None, 0)] * (len(a) > 0)


def slow_hashes(text):
    found = {h for h, _ in slow_fingerprint(text)}
    return {(None, " ".join(re.split(r"[\x20\x09-\x0D]+", text).copy()).strip())} if None in found else found


def like(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_query_digests(spark):
    d = "/root/testdata/sf0.01"
    docs = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet' order by doc_id").fetchall()
    got = {r.doc_id: r for r in QUERIES["op7_fingerprint"](spark, d).collect()}
    assert len(got) == len(docs)
    marks = {}
    for n, (i, t) in enumerate(docs):
        nxt = docs[(n + 1) % len(docs)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert marks.setdefault(t, r.fingerprint) == r.fingerprint
        assert (nxt != t) or r.near_next == 1
        a, b, c = slow_hashes(t), slow_hashes(edited), slow_hashes(nxt)
        assert abs(r.near_edited - like(a, b)) < 1e-12 and abs(r.near_next - like(a, c)) < 1e-12, i
        assert int(r.fingerprint.split("-")[0]) == len(slow_fingerprint(t)) and int(r.edited_fingerprint.split("-")[0]) == len(slow_fingerprint(edited))
    assert len(set(marks.values())) >= len(marks) - 5  # texts that differ in white space alone share theirs


def test_next_row_over_ranges(spark):
    ids = [None, None, 5, 5, 5, 7, 9, 20, 21, 22, 23, 100, 10**12, -4]
    df = spark.createDataFrame([(i, f"t{n:02d}", "clash") for n, i in enumerate(ids)], "id long, v string, _partition string")
    for each in (1, 2, 5, 100):
        got = wn.with_next(df, "id", "v", "nx", rows_each=each).collect()
        assert len(got) == len(ids)
        follow = {r.v: r.nx for r in got}
        at, seen = "t00", []
        for _ in ids:
            seen.append(at)
            at = follow[at]
        assert at == "t00" and len(set(seen)) == len(ids)
        order = [ids[int(v[1:])] for v in seen]
        start = order.index(None) if order[-1] is not None else 0
        turned = [x if x is not None else -(2**63) for x in order]
        assert sum(x > y for x, y in zip(turned, turned[1:] + turned[:1])) == 1, start


def test_odd_rows(spark):
    rows = [(1, None, 3), (1, "", 3), (2, "a " * 30000, 1), (None, "é ü", 1), (9, "same text of six words here", 0), (9, "same text of six words here", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = wn.fingerprints(df).collect()
    assert len(got) == 6 and len({r.fingerprint for r in got if r.doc_id == 9}) == 1
    assert {r.n_chars for r in got} == {0, 60000, 3, 27}
    assert wn.fingerprints(df.limit(0)).count() == 0
    one = wn.fingerprints(df.where("doc_id = 2")).first()
    assert one.near_next == 1.0


def test_scripts_without_spaces(spark):
    han = "".join(chr(0x4E00 + i * 7919 % 5000) for i in range(4000))
    one = han[:2000] + "!" + han[2001:]
    got = {r.doc_id: r for r in wn.fingerprints(spark.createDataFrame([(1, han), (2, one), (3, "plain words " + "x" * 30)], "doc_id long, text string")).collect()}
    assert got[1].near_next > 0.99 and 0.25 < got[1].near_edited < 1 and got[1].fingerprint != got[2].fingerprint
    assert len(got[1].marks) > 1000 and len(got[3].marks) > 5


def test_heavy_orders_are_cut_by_hash(spark):
    ids = [None] * 60 + [5] * 50 + list(range(6, 40)) + [40] * 30
    df = spark.createDataFrame([(i, f"t{n:03d}", n) for n, i in enumerate(ids)], "id long, v string, _at long")
    got = wn.with_next(df.drop("_at"), "id", "v", "nx", rows_each=10).collect()
    follow, at, seen = {r.v: r.nx for r in got}, "t000", []
    for _ in ids:
        seen.append(at)
        at = follow[at]
    assert at == "t000" and len(set(seen)) == len(ids)
    turned = [-1 if ids[int(v[1:])] is None else ids[int(v[1:])] for v in seen]
    assert sum(x > y for x, y in zip(turned, turned[1:] + turned[:1])) == 1

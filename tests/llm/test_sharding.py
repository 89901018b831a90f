import hashlib
from collections import Counter

import pytest

from sparkloom.llm import sharding as sd
from sparkloom.llm.queries import ORACLES, QUERIES, SHARD_BYTES

from .oracle import same


def slow(rows, limit):
    """Extendible hashing by its definition: split what is too large."""
    out = {}

    def put(part, depth, bits):
        if sum(n for _, _, n in part) > limit and len({h for h, _, _ in part}) > 1:
            for b in "01":
                put([x for x in part if x[0][depth] == b], depth + 1, bits + b)
        elif part:
            for _, i, _ in part:
                out.setdefault(i, []).append(bits)

    put(rows, 0, "")
    return out


def bits(i):
    return f"{int(hashlib.md5(str('null' if i is None else i).encode()).hexdigest()[:15], 16):060b}"


@pytest.mark.parametrize("limit", [1, 700, 5000, 10**9])
def test_shards_by_definition(spark, limit):
    rows = [(i, "x" * (i * 37 % 211)) for i in range(300)] + [(7, "again"), (7, "again"), (None, None), (None, "é" * 10), (1000, ""), (1001, "y" * 30000)]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, prefix string")
    out = sd.assign(df, limit)
    assert out.columns[:3] == df.columns
    got = out.collect()
    want = slow([(bits(i), i, len((t or "").encode())) for i, t in rows], limit)
    assert len(got) == len(rows)
    assert all(r.shard == want[r.doc_id][0] for r in got)
    total = Counter()
    for r in got:
        total[r.shard] += len((r.text or "").encode())
    assert all(r.shard_bytes == total[r.shard] and r.oversize == (total[r.shard] > limit) for r in got)
    assert sd.assign(df.limit(0), limit).count() == 0


def test_further_rounds(spark):
    """One heavy id among many light ones: its neighbours are parted far below the expected depth."""
    rows = [(i, "z" * (20000 if bits(i).startswith("0101") else 1)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow([(bits(i), i, len(t)) for i, t in rows], 20001)
    got = {r.doc_id: r.shard for r in sd.assign(df, 20001).select("doc_id", "shard").collect()}
    assert got == {i: s[0] for i, s in want.items()}


def test_query_against_sql(spark):
    assert same(spark, "/root/testdata/sf0.1", QUERIES["op1_shard"], ORACLES["op1_shard"]) == 10000
    assert SHARD_BYTES == 16 << 20


def test_clashing_columns(spark):
    names = ["doc_id", "text", "_h", "_bytes", "_d", "_P", "_row", "_b", "_o", "Shard", "oversize", "depth", "a.b"]
    rows = [(i, "x" * i, *[i * 100 + k for k in range(11)]) for i in range(40)]
    got = sd.assign(spark.createDataFrame(rows, names), 200)
    assert got.columns == [c for c in names if c.lower() not in sd.ADDED] + list(sd.ADDED)
    at = [i for i, c in enumerate(names) if c.lower() not in sd.ADDED]
    assert sorted(tuple(r)[: len(at)] for r in got.collect()) == [tuple(r[i] for i in at) for r in rows]
    want = slow([(bits(i), i, i) for i in range(40)], 200)
    assert {r.doc_id: [r.shard] for r in got.collect()} == want and all(isinstance(r.oversize, bool) for r in got.collect())


def test_a_hot_id_and_many_buckets(spark, monkeypatch):
    """Beyond the broadcast's bound, rows find their bucket by a salted join."""
    rows = [(7 if i % 3 == 0 else i, "x" * (i % 50)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, sd.assign(df, 300).collect()))
    real = sd.DataFrame.count
    monkeypatch.setattr(sd.DataFrame, "count", lambda self: 10**9)
    wide = sd.assign(df, 300)
    monkeypatch.setattr(sd.DataFrame, "count", real)
    assert sorted(map(tuple, wide.collect())) == want

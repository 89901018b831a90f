import random

import duckdb
import numpy as np
import pytest
import xxhash

from sparkloom.llm import simhash as sh
from sparkloom.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, fp string, root string"


def slow_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(rows):
    fps = {i: f for i, f in rows}
    ids, arr = list(fps), np.array(list(fps.values()), dtype=np.uint64)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, i in enumerate(ids):
        for m in np.flatnonzero(np.bitwise_count(arr ^ arr[n]) <= 3):
            a, b = find(i), find(ids[m])
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall()
    want = [(i, slow_fingerprint(t)) for i, t in docs]
    comp = slow_components(want)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op8_simhash_neardup"](spark, d).collect()}
    assert got == {i: (f"{f:016x}", comp[i]) for i, f in want}


@pytest.mark.parametrize("blocks", [4, 5, 6])
@pytest.mark.parametrize("bucket", [7, 4096])
def test_links_of_dense_balls(spark, blocks, bucket):
    rnd = random.Random(blocks)
    centre = [rnd.getrandbits(64) for _ in range(3)]
    fps = {c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))) for c in centre for _ in range(120)} | {rnd.getrandbits(64) for _ in range(200)}
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.node: r.root for r in sh.components(sh.near_links(df, 3, max_bucket=bucket, blocks=blocks)).collect()}
    want = slow_components([(s, f) for s, f in zip(signed, fps)])
    assert {s: roots.get(s, s) for s in signed} == want


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40000))
    rows = [(1, None, "en", "x", "y"), (2, "", None, None, None), (3, " \t\n", "en", None, "z"), (4, "A b", "en", None, None), (4, "A b", "en", None, None), (None, "a B", None, None, None), (7, long, None, None, None), (6, long + " tail", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((str(r.doc_id), r.component_id, r.fingerprint) for r in sh.near_duplicates(df).collect())
    assert [g[1] for g in got] == [1, 1, 1, 4, 4, 6, 6, 4] and got[0][2] == "0" * 16
    kept = sh.dedup(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 6]
    assert sh.near_duplicates(df.limit(0)).count() == 0 and sh.dedup(df.limit(0)).count() == 0

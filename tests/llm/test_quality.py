import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import quality as q
from sparkloom.llm.queries import QUERIES


def test_chunks_cover_every_byte():
    for n in (0, 1, 159, 160, 161, 288, 289, 5000):
        t = bytes(1 + i % 250 for i in range(n))
        x, firsts = q.chunks_of([t, b"z", t])
        step = q.CHUNK - q.OVERLAP
        for d in (0, 2):
            rows = x[firsts[d] : firsts[d + 1]]
            flat = bytearray((len(rows) - 1) * step + q.CHUNK + q.WIDTH - 1)
            for i, r in enumerate(rows):
                flat[i * step : i * step + len(r)] = r.tobytes()
            assert bytes(flat[:n]) == t and not any(flat[n:])


def test_responses_and_gradients():
    net = q.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["a0"] += 0.3  # away from the kink
    texts = [b"abc def " * 60, b"x", b"Zz!! " * 100, b""]
    x, firsts = q.chunks_of(texts)
    slow = sum(net.p["w"][j][x[:, j : q.CHUNK + j]] for j in range(q.WIDTH))
    assert np.allclose(net.responses(x), slow)
    y = np.array([1.0, 0.0, 1.0, 0.0])

    def loss():
        net.pairs = None
        z, _ = net.logits(net.features(net.pooled(x)[0], firsts, np.array([len(t) for t in texts])).astype(float))
        return float(np.mean(np.logaddexp(0, z) - y * z))

    g = net.gradients(texts, y)
    for k, at in (("w", (2, ord("e"), 3)), ("w", (0, ord("!"), 7)), ("a", (5, 2)), ("a0", (1,)), ("v", (4,)), ("v0", (0,))):
        e = 1e-3
        net.p[k][at] += e
        up = loss()
        net.p[k][at] -= 2 * e
        down = loss()
        net.p[k][at] += e
        assert abs((up - down) / (2 * e) - g[k][at]) < 2e-3 + 0.1 * abs(g[k][at]), (k, at)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op10_quality"](spark, d).collect()}
    assert len(got) == 1000
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    labels = duckdb.sql(f"select doc_id, quality from '{d}/labels.parquet'").fetchall()
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    good = [p for p, y in held if y == 1]
    assert np.mean([p == y for p, y in held]) > 0.92 and np.mean(good) > 0.95


def test_odd_rows(spark):
    rows = [(i, f"good words of text number {i} and so on", 1) for i in range(40)] + [(100 + i, f"BAD!! JUNK!! {i}!! " * 9, 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (3, None, 0), (10**9, 1, 1)], "doc_id long, quality int, toxic int")
    model = q.fit(docs, labels)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "BAD!! JUNK!! " * 30000), (None, "good words of text number 4 and so on"), (4, "good words of text number 4 and so on")], "doc_id long, text string")
    s = [r[0] for r in odd.select(q.score_column(model, F.col("text"), spark)).collect()]
    assert s[0] == s[1] and s[3] == s[4] > 0.5 > s[2] and all(0 <= v <= 1 for v in s)
    assert q.fit(docs, labels.where("quality = 1")) == 1.0 and q.fit(docs, labels.limit(0)) == 0.5
    assert odd.select(q.score_column(0.5, F.col("text"), spark)).count() == 5
    assert odd.limit(0).select(q.score_column(model, F.col("text"), spark)).count() == 0


def slow_score(net, text):
    """The network's answer without numpy: chunk by chunk, filter by filter."""
    import math

    t = (text or "").encode()
    step = q.CHUNK - q.OVERLAP
    tops = []
    for c in range(max(1, -(-(len(t) - q.OVERLAP) // step))):
        chunk = [t[c * step + i] if c * step + i < len(t) else 0 for i in range(q.CHUNK + q.WIDTH - 1)]
        tops.append([max(0.0, max(sum(float(net["w"][j][chunk[p + j]][f]) for j in range(q.WIDTH)) for p in range(q.CHUNK))) for f in range(q.FILTERS)])
    per = list(zip(*tops))
    features = [sum(x) / len(x) for x in per] + [max(x) for x in per] + [min(x) for x in per] + [math.log1p(len(t)) / 12]
    hidden = [max(0.0, sum(x * float(net["a"][i][h]) for i, x in enumerate(features)) + float(net["a0"][h])) for h in range(q.HIDDEN)]
    return 1 / (1 + math.exp(-sum(x * float(net["v"][h]) for h, x in enumerate(hidden)) - float(net["v0"][0])))


def test_scores_against_plain_python(spark):
    net = q.Network().train([b"good words here", b"BAD!! BAD!!"] * 6, np.array([1.0, 0.0] * 6, dtype=np.float32), 3)
    texts = ["", None, "short", "a sentence of some words. " * 9, "é" * 100 + "x" * 77, "y" * 160, "z" * 289]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r[0] for r in df.select("i", q.score_column(net, F.col("text"), spark).alias("s")).orderBy("i").select("s").collect()]
    assert np.allclose(got, [slow_score(net.p, t) for t in texts], atol=1e-4)


def test_sample_is_bounded_by_bytes(spark):
    rows = [(i, ("good words " if i % 2 else "BAD!! ") * 50) for i in range(200)] + [(1000, "x" * 3_000_000), (3, "good words again and again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(1000, 0)], "doc_id long, quality int")
    seen = []
    q_train, q.Network.train = q.Network.train, lambda self, texts, labels, passes: seen.append([len(t) for t in texts]) or self
    try:
        q.fit(docs, labels, most_bytes=10_000)
    finally:
        q.Network.train = q_train
    assert 20 <= len(seen[0]) <= 60 and sum(seen[0]) <= 30_000 and 3_000_000 not in seen[0]

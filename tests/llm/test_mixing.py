from collections import Counter, defaultdict

import pytest

from sparkloom.llm import mixing as mx
from sparkloom.llm.queries import ORACLES, QUERIES

from .oracle import same


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_against_sql(spark, sf):
    assert same(spark, f"/root/testdata/{sf}", QUERIES["op9_mix"], ORACLES["op9_mix"]) > 200


def corpus(spark):
    rows = [(i, "w " * (i % 50 + 1), f"s{min(i % 13, 4)}", 1) for i in range(2000)] + [(None, None, None, 2), (None, "", "", 3), (5, "a b", "", 3), (5, "a b", "", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, epoch int"), rows


def tokens(t):
    return max(1, len((t or "").split()))


def test_budget_and_repeats(spark):
    df, rows = corpus(spark)
    total = Counter()
    for _, t, s, _ in rows:
        total[s] += tokens(t)
    got = mx.mix(df, max_repeats=3.0).collect()
    read = Counter()
    for r in got:
        read[r.source] += r.n_tokens
    # the largest source once, the smallest three times, each document once at least
    assert read[max(total, key=total.get)] == max(total.values())
    assert all(total[s] <= read[s] <= 3 * total[s] + 1e-6 for s in total)
    assert {(r.doc_id, r.source) for r in got} == {(i, s) for i, _, s, _ in rows}
    blocks = defaultdict(Counter)
    for r in got:
        blocks[r.mix_block][r.source] += r.n_tokens
    whole = mx.mixed(df, max_repeats=3.0)
    assert whole.columns == df.columns and whole.count() == len(got)


def test_given_budget(spark):
    df, rows = corpus(spark)
    got = mx.mix(df.where("source like 's%'"), max_repeats=2.0, budget=9000, block_tokens=1000).collect()
    read = sum(r.n_tokens for r in got)
    assert 9000 - 5 * 51 <= read <= 9000
    assert {r.mix_block for r in got} == set(range(9))
    shares = Counter(r.source for r in got)
    assert len(shares) == 5


def test_entropy(spark):
    df, _ = corpus(spark)
    import math

    t = df.groupBy("source").count().selectExpr("coalesce(source, '-') as _src", "count as _tokens")
    w = [r.weight for r in mx.weights(t, None, 0.9).collect()]
    assert abs(sum(w) - 1) < 1e-9
    assert abs(-sum(x * math.log(x) for x in w) / math.log(len(w)) - 0.9) < 1e-6


def test_empty(spark):
    df, _ = corpus(spark)
    assert mx.mix(df.limit(0), max_repeats=2.0).count() == 0
    one = spark.createDataFrame([(1, "a b", "s", 0)], df.schema)
    assert [(r.doc_id, r.epoch, r.mix_block) for r in mx.mix(one, max_repeats=2.0).collect()] == [(1, 0, 0)]


def test_clashing_columns_keep_their_values(spark):
    names = ["doc_id", "text", "source", "epoch", "mix_block", "_n", "_full", "_key", "_SRC", "_row", "n_tokens", "_copies", "_epoch", "a.b"]
    rows = [(i, "w " * (i + 1), f"s{i % 2}", *[i * 100 + k for k in range(11)]) for i in range(30)]
    df = spark.createDataFrame(rows, names)
    got = mx.mixed(df, max_repeats=2.0)
    assert got.columns == names
    copies = Counter(tuple(r) for r in got.collect())
    assert set(copies) == set(rows) and set(copies.values()) <= {1, 2}
    assert sum(copies.values()) == mx.mix(df, max_repeats=2.0).count()


def test_scripts_without_spaces_count_by_character(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "漢字かな交じり文"), (3, "ab漢字cd e"), (4, "ไทย x"), (5, ""), (6, None)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(mx.tokens_of(df.t)).collect()] == [2, 8, 5, 4, 1, 1]

"""What a reviewer found on odd rows and larger tables."""

import difflib
import random
from collections import Counter
from fractions import Fraction

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import client as cl
from sparkloom.operators import graph as gr
from sparkloom.operators import metrics as mt
from sparkloom.operators import resolve as rs
from sparkloom.plans import catalog_graph, catalog_review, catalog_rows, catalog_state, catalog_store, catalog_text  # noqa: F401
from sparkloom.plans.registry import ORACLES, QUERIES

from .compare import connect, rows


def both(spark, d, name):
    """The rows of a query and of its SQL."""
    df = QUERIES[name](spark, str(d))
    want = connect(d).sql(ORACLES[name])
    return rows(df.collect(), df.columns), rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", ["term_graph_nodes", "term_graph_edges", "term_graph_report"])
def test_words_end_at_letters_beyond_ascii(spark, tmp_path, name):
    text = "The end of Oiaiè stays.\nèlater than with wordsé and éname is some text\nplain is plain text"
    df = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "one of two", "en", None, 10)], "doc_id long, text string, lang string, source string, n_chars long")
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    next((tmp_path / "d").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    got, want = both(spark, tmp_path, name)
    assert got == want and want[1]


def test_means_of_just_a_half(spark):
    rnd = random.Random(4)
    groups = {}
    for g in range(300):
        cents = [rnd.randint(0, 30000) for _ in range(20)]
        cents[-1] += (1000 - sum(cents)) % 2000  # the mean is a half
        groups[g] = [(-1 if g % 3 == 0 else 1) * x for x in cents]
    data = [(g, x / 100) for g, xs in groups.items() for x in xs] + [(300, None), (301, 1 / 3), (301, None)]
    rnd.shuffle(data)
    df = spark.createDataFrame(data, "g long, v double").repartition(7)
    got = {r.g: r.mean for r in cl.request_totals(df, ["g"], F.col("v") > 1e9, "v").collect()}
    half = {g: Fraction(sum(xs), 100 * len(xs)) for g, xs in groups.items()}
    assert all((2 * x).denominator == 1 and x.denominator == 2 for x in half.values())
    assert got == {g: int(abs(x) + Fraction(1, 2)) * (1 if x > 0 else -1) for g, x in half.items()} | {300: None, 301: 0}


@pytest.mark.parametrize("size", [5000, 700])
def test_means_of_just_a_half_sum_rows_as_sql(spark, tmp_path, size):
    rnd = random.Random(5)
    kinds = ["click", "error", "view", None]
    data = []
    for u in range(200):
        own = [(u or None, rnd.choice(kinds), rnd.randint(0, 30000)) for _ in range(18)]
        known = [v for _, k, v in own if k in ("click", "error")]
        n = len(known) + 1
        data += own + [(u or None, "click", (50 * n - sum(known)) % (100 * n)), (u or None, "click", None)]  # the mean is a half
    data.append((200, "view", 100))
    rnd.shuffle(data)
    ids = rnd.sample(range(len(data)), len(data))  # ids don't tell the order of rows
    df = pd.DataFrame([(i, u, k, None if v is None else v / 100) for i, (u, k, v) in zip(ids, data)], columns=["event_id", "user_id", "event_type", "value"])
    df.astype({"user_id": "Int64"}).to_parquet(tmp_path / "events.parquet", row_group_size=size)
    con = connect(tmp_path)
    con.execute("set threads = 1")  # more threads sum several row groups in any order
    want = con.sql(ORACLES["request_totals"])
    spark.conf.set("spark.sql.files.maxPartitionBytes", 8000)
    try:
        got = QUERIES["request_totals"](spark, str(tmp_path))
        assert rows(got.collect(), got.columns) == rows(want.fetchall(), want.columns)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_repeated_formulas_are_compared_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    ratio = mt.sequence_ratio

    def counted(a, b):
        @F.pandas_udf("string")
        def count(x: pd.Series) -> pd.Series:
            seen.add(len(x))
            return x

        return ratio(count(a), b)

    monkeypatch.setattr(mt, "sequence_ratio", counted)
    texts = ["a=b", "a=c+d", "f=m*a", None]
    e = spark.createDataFrame([(i % 3 or None, i, texts[i % 4]) for i in range(240)], "page long, id long, formula string")
    o = spark.createDataFrame([(i % 3 or None, texts[i % 3] + "x" * (i % 2)) for i in range(240)], "page long, formula string")
    got = {r.id: (r.ratio, r.best) for r in mt.audit_formulas(e, o).collect()}
    for i in range(240):
        own = texts[i % 4]
        found = sorted({texts[j % 3] + "x" * (j % 2) for j in range(240) if i % 3 and j % 3 == i % 3} or {""})
        assert got[i] == max((1.0 if own is not None and own in s else round(difflib.SequenceMatcher(None, own or "", s, autojunk=False).ratio(), 4), s) for s in found)
    assert 0 < seen.value <= 4 * 7


def test_copies_become_pairs_without_a_shuffle(spark):
    def written():
        found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    keys = ["abcdefghijkl", "abcdefghijklm", "abababab", "ababab", "z"]
    data = [(i, keys[0], "x") for i in range(1500)] + [(2000 + i, keys[i % 5], "y" if i % 3 else None) for i in range(60)] + [(2000, keys[1], "y"), (None, keys[0], "x")]
    df = spark.createDataFrame(data, "id long, k string, g string").repartition(5)
    before = written()
    got = Counter((r.a, r.b, r.similarity) for r in rs.similar_pairs(df, "id", "k", ["g"], 0.8, chunk=100).where("a >= 2000").collect())
    assert rs.similar_pairs(df, "id", "k", ["g"], 0.8).where("b < 2000").count() == 1500 * 1499 // 2
    assert written() - before < 2_000_000
    sets = {k: {k[j : j + 2] for j in range(max(1, len(k) - 1))} for k in keys}
    like = lambda k, m: round(len(sets[k] & sets[m]) / len(sets[k] | sets[m]), 6)
    few = [x for x in data if x[2] == "y"]
    assert got == Counter((i, j, like(k, m)) for i, k, _ in few for j, m, _ in few if i < j and like(k, m) >= 0.8)


def test_copies_of_parents_are_scored_once(spark, tmp_path, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    fit = gr.role_fit

    def counted(parent, *rest):
        @F.pandas_udf("string")
        def count(x: pd.Series) -> pd.Series:
            seen.add(len(x))
            return x

        return fit(count(parent), *rest)

    monkeypatch.setattr(gr, "role_fit", counted)
    rnd = random.Random(3)
    kinds = [(rnd.choice(["hot ring", "old ring", "hot bolt"]), "B", "LARGE" if i % 2 else "SMALL", rnd.randint(1, 50)) for i in range(60)]
    ids = rnd.sample(range(10000), 20 * 60)
    df = spark.createDataFrame([(ids[i], *kinds[i % 60], 1.0) for i in range(20 * 60)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    next((tmp_path / "d").glob("*.parquet")).rename(tmp_path / "part.parquet")
    got, want = both(spark, tmp_path, "suggested_parents")
    assert got == want and len(want[1]) > 1000 and 0 < seen.value <= 2 * 30 * 30

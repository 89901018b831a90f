from collections import Counter

from pyspark.sql import functions as F

from sparkloom.llm import common as cm


def test_salted_lookup_is_a_join(spark):
    left = [(None if i % 97 == 0 else ("hot" if i % 3 else f"k{i % 50}"), i) for i in range(3000)]
    right = [("hot", "h"), (None, "null")] + [(f"k{i}", f"v{i}") for i in range(0, 40)] + [("unused", "u")]
    a, b = spark.createDataFrame(left, "key string, n long"), spark.createDataFrame(right, "key string, v string")
    got = cm.salted_lookup(a, b, "key", F.col("n"))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, a.join(b, "key", "left").collect()))
    inner = cm.salted_lookup(a, b, "key", F.col("n"), how="inner")
    assert inner.count() == a.join(b, "key").count()
    assert cm.salted_lookup(a.limit(0), b, "key", F.col("n")).count() == 0


def test_words_and_tables(spark):
    df = spark.createDataFrame([("a\u00a0b \t\nc\x0b",), ("",), (None,), ("  ",)], "t string")
    assert [r[0] for r in df.select(cm.words_of(F.col("t"))).collect()] == [["a\u00a0b", "c"], [], [], []]
    again = cm.stored(df, "t")
    assert again.schema == df.schema and again.count() == 4
    assert cm.shared_dir(spark) == cm.shared_dir(spark) and cm.fresh_path(spark, "x") != cm.fresh_path(spark, "x")
    assert cm.sized_broadcast(df, 1) is df


def test_no_private_folder_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    def session(master, setting=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: setting), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))

    assert cm.shared_dir(session("spark://host:7077", "hdfs://x/c/")) == "hdfs://x/c"
    with pytest.raises(RuntimeError):
        cm.shared_dir(session("spark://host:7077"))

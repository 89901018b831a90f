import math
import unicodedata
import zlib
from collections import Counter

import duckdb
import numpy as np

from sparkloom.llm import langid as li
from sparkloom.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs = {r[0]: r for r in duckdb.sql(f"select doc_id, lang, text from '{d}/documents.parquet'").fetchall()}
    got = QUERIES["op2_language"](spark, d).collect()
    assert len(got) == len(docs)
    right = held = 0
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if r.held_out:
            held += 1
            right += r.lang_pred == docs[r.doc_id][1]
    print("held out", held, "right", right)
    assert right / held > 0.97


def test_backs_off_to_shorter_grams():
    v = np.array
    tables = {0: (["known"], v([[5.0, 1.0]])), 4: (["<abc"], v([[9.0, 7.0]])), 3: (["xyz"], v([[8.0, 9.0]])), 1: (["q"], v([[9.0, 8.0]]))}
    m = li.Model(["aa", "bb"], tables)
    assert m.of_words(["known", "abc", "xyzq", "zzz"]).tolist() == [[5.0, 1.0], [9.0, 7.0], [8.5, 8.5], [0.0, 0.0]]
    assert [p[0] for p in m.predict(["known KNOWN known!", None, "zzz", "12", "abc"])] == ["aa", "und", "aa", "und", "aa"]
    assert m.predict(["zzz"]) == [("aa", 0.5)] and m.predict([None, ""]) == [("und", 0.0)] * 2 and m.predict([]) == []


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog " * 20, "en"), (2, "der hund und die katze " * 20, "de"), (3, None, "en"), (4, "", None), (None, "un chat", "fr"), (5, "un chien et un chat", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.fit(df)
    assert model.langs == ["de", "en"]
    test = spark.createDataFrame([(1, "THE DOG", 1), (2, None, 2), (3, "", 3), (4, "123 !?", 4), (5, "katze " * 50000, 5), (5, "katze", 5)], "doc_id long, text string, value int")
    got = [(r.lang_pred, round(r.score, 3)) for r in li.identify(test, model).collect()]
    assert got[0][0] == "en" and got[1:4] == [("und", 0.0)] * 3 and got[4][0] == got[5][0] == "de"
    assert li.identify(test.limit(0), model).count() == 0
    empty = li.fit(df.limit(0))
    assert {r.lang_pred for r in li.identify(test, empty).collect()} == {"und"}


def slow_query(docs):
    """The whole query by its definition, in plain Python; all rows fit the sample here."""
    letters = lambda t: "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (t or "").lower()).split()
    grams = lambda w, k: [f"<{w}>"[i : i + k] for i in range(max(len(w) + 2 - k + 1, 1))]
    seen = {}
    for i, lang, t in docs:
        if zlib.crc32(str(i).encode()) % 4 != 2 and lang is not None and t is not None:
            own = seen.setdefault(lang, {0: Counter(), 1: Counter(), 2: Counter(), 3: Counter(), 4: Counter()})
            for w in letters(t):
                own[0][w] += 1
                for k in (1, 2, 3, 4):
                    own[k].update(grams(w, k))
    langs = sorted(seen)
    every = {k: set().union(*(seen[x][k] for x in langs)) for k in range(5)}
    total = {(x, k): sum(seen[x][k].values()) + 0.5 * max(1, len(every[k])) for x in langs for k in range(5)}
    value = lambda x, k, v: math.log((seen[x][k][v] + 0.5) / total[x, k]) - math.log(0.5 / total[x, k])

    def score(x, w):
        if w in every[0]:
            return value(x, 0, w)
        found = []
        for i in range(len(w) + 2):
            for k in (4, 3, 2, 1):
                g = f"<{w}>"[i : i + k]
                if g in every[k]:
                    found.append(value(x, k, g))
                    break
        return sum(found) / len(found) if found else 0.0

    def table(k):
        return {v: [value(x, k, v) for x in langs] for v in every[k]}

    out = {}
    for i, _, t in docs:
        words = Counter(letters(t))
        sums = [sum(n * score(x, w) for w, n in words.items()) for x in langs]
        best = max(sums, default=0)
        out[i] = (langs[sums.index(best)], 1 / sum(math.exp(v - best) for v in sums)) if words else ("und", 0.0)
    return out, table


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"select doc_id, lang, text from '{d}/documents.parquet'").fetchall()
    want, table = slow_query(docs)
    model = li.fit(spark.createDataFrame([x for x in docs if zlib.crc32(str(x[0]).encode()) % 4 != 2], "doc_id long, lang string, text string"))
    for k in range(5):
        rows, at = (model.word_rows, model.words) if k == 0 else (model.gram_rows, model.grams[k])
        slow = table(k)
        assert set(at) == set(slow) and all(np.allclose(rows[at[v]], x) for v, x in slow.items())
    got = {r.doc_id: (r.lang_pred, r.score) for r in QUERIES["op2_language"](spark, d).collect()}
    assert set(got) == set(want)
    for i, (lang, score) in want.items():
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-6, i


def test_letters_only_ties_and_clashing_columns(spark):
    once = " ".join(f"aa{chr(97 + i // 26 // 26)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(3000))
    df = spark.createDataFrame([(1, once, "aa"), (2, "bee bee sea sea dee dee", "bb")], "doc_id long, text string, lang string")
    model = li.fit(df, words=1000)
    assert len(model.words) == 1003 and set(once.split()[:1000]) < set(model.words)
    assert len(li.fit(df).words) == 3003
    names = ["doc_id", "text", "lang_pred", "Score", "_p", "_row", "x.y"]
    rows = [(1, "² ½ ¾ Ⅷ ① 12 _", *range(5)), (2, "sea 5", *range(5)), (None, None, *range(5))]
    got = li.identify(spark.createDataFrame(rows, names), model)
    assert got.columns == ["doc_id", "text", "_p", "_row", "x.y", "lang_pred", "score"]
    assert [(r.lang_pred, tuple(r)[2:5]) for r in got.collect()] == [("und", (2, 3, 4)), ("bb", (2, 3, 4)), ("und", (2, 3, 4))]

import itertools
import random
import re
import time
from collections import Counter

import duckdb

from sparkloom.llm import decontam as dc
from sparkloom.llm.queries import QUERIES


def tokens(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def slow(docs, items, similarity=0.8, least=13, fewest=8):
    """Every alignment of every item and document, without any seeds: (agreeing, compared) of the best that counts."""
    out = {}
    for d, t in docs:
        x = tokens(t)
        where = {}
        for p, w in enumerate(x):
            where.setdefault(w, []).append(p)
        for i, u in items:
            y = tokens(u)
            if len(y) < fewest:
                if y and x == y:
                    out[d, i] = max(out.get((d, i), (0, 0)), (len(y), -len(y)))
                continue
            need = min(least, len(y))
            agree = Counter(p - j for j, w in enumerate(y) for p in where.get(w, ()))
            for shift, n in agree.items():
                same = [x[j + shift] == y[j] for j in range(max(0, -shift), min(len(y), len(x) - shift))]
                if len(same) < need or n < similarity * need - 1e-9:
                    continue
                if sum(same) >= similarity * len(same) - 1e-9:
                    found = (sum(same), -len(same))
                else:
                    ends = [e for e in range(need, len(same) + 1) if sum(same[e - need : e]) >= similarity * need - 1e-9]
                    if not ends:
                        continue
                    part = same[ends[0] - need : ends[-1]]
                    found = (sum(part), -len(part))
                out[d, i] = max(out.get((d, i), (0, -(10**9))), found)
    return {k: (a, round(a / -n, 6)) for k, (a, n) in out.items()}


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{d}/benchmark.parquet'").fetchall()
    got = {(r.doc_id, r.item_id): (r.n_tokens, r.similarity) for r in QUERIES["op4_decontaminate"](spark, d).collect()}
    assert got and got == slow(docs, items)


def test_substitutions_blocks_and_odd_rows(spark):
    item = "the quick brown fox jumps over the lazy dog while seven small birds sing in tall green trees"
    swapped = item.replace("fox", "cat").replace("small", "large").upper()
    other = "nothing in here is like any of the passages that the benchmark holds so it has to stay clean"
    items = [(1, item), (2, "short item"), (3, None), (4, "?!"), (5, item), (5, item), (None, item), (None, "eight other words that are in no other text"), (1, "a second text of the first item is here too")]
    docs = [(1, f"some words before {swapped} and some after", "k"), (1, other, "k"), (2, other, None), (3, None, "k"), (4, "", "k"), (None, item, "k"), (6, "Short, item!", "k"), (7, "a short item inside", "k"), (8, " ".join(["w"] * 50000) + " " + item, "k"), (9, "here a second text of the first item is here too", "k")]
    a = spark.createDataFrame(docs, "doc_id long, text string, _item string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = slow([(n, t) for n, (_, t, _) in enumerate(docs)], items)
    for at_once in (7, 500_000):
        got = {(r.doc_id, r.item_id): (r.n_tokens, r.similarity) for r in dc.overlaps(a, b, seeds_at_once=at_once).collect()}
        best = {}
        for (d, i), v in want.items():
            best[docs[d][0], i] = max(v, best.get((docs[d][0], i), (0, 0)))
        assert got == best
    assert {k[0] for k in got} == {1, None, 6, 8, 9} and (8, None) in got and (9, 1) in got
    kept = dc.clean(a, b)
    assert kept.columns == a.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 7]
    assert dc.overlaps(a.limit(0), b).count() == 0 and dc.overlaps(a, b.limit(0)).count() == 0 and dc.clean(a, b.limit(0)).count() == 10


def test_masks_lose_no_alignment_that_counts():
    """Each pattern of substitutions that leaves 80 % of 8 to 13 tokens leaves a seed."""
    for n in range(dc.FEWEST, dc.LEAST + 1):
        masks = dc.HEAVY if n >= dc.LEAST else dc.LIGHT
        places = [{a + j for j, c in enumerate(m) if c == "1"} for m in masks for a in range(n - len(m) + 1)]
        for k in range(int(0.2 * n + 1e-9) + 1):
            assert all(any(not p & set(gone) for p in places) for gone in itertools.combinations(range(n), k)), (n, k)


def test_recall_under_substitutions(spark):
    """Items of 8 to 60 tokens, a fifth of them substituted, inside other text: the query's recall, without masks."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(6))
    items, docs = [], []
    for n in [*range(8, 24), 30, 40, 50, 60]:
        for _ in range(12):
            item = [word() for _ in range(n)]
            copy = list(item)
            for at in rnd.sample(range(n), n // 5):
                copy[at] = word()
            docs.append((len(items), " ".join([word() for _ in range(rnd.randint(0, 30))] + copy + [word() for _ in range(rnd.randint(0, 30))])))
            items.append((len(items), " ".join(item)))
            if n >= 30:  # an excerpt of 13 tokens of a longer item
                at = rnd.randint(0, n - 13)
                docs.append((1000 + len(items) - 1, " ".join([word() for _ in range(40)] + item[at : at + 13] + [word() for _ in range(40)])))
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.overlaps(a, b).collect()}
    want = {(d, d % 1000) for d, _ in docs}
    print("recall", len(got & want) / len(want))
    assert got <= want and len(got & want) >= 0.99 * len(want)


def test_repeats_scripts_and_clashing_columns(spark):
    na = spark.createDataFrame([(1, "na " * 2000)], "item_id long, text string")
    began = time.time()
    assert [(r.n_tokens, r.similarity) for r in dc.overlaps(na.withColumnRenamed("item_id", "doc_id"), na).collect()] == [(2000, 1.0)]
    assert time.time() - began < 120
    han = "".join(chr(0x4E00 + i * 7919 % 5000) for i in range(600))
    item = spark.createDataFrame([(1, han[150:350])], "item_id long, text string")
    names = ["doc_id", "text", "_bad", "_d1", "_D2", "_row", "item_id", "_id", "a`b", "c.d"]
    rows = [(1, han[100:400], *range(8)), (2, han[400:], *range(10, 18)), (None, han[100:400], *range(8)), (None, "clean text", *range(20, 28)), (1, "clean", *range(30, 38))]
    docs = spark.createDataFrame(rows, names)
    assert {(r.doc_id, r.n_tokens) for r in dc.overlaps(docs, item).collect()} == {(1, 200), (None, 200)}
    kept = dc.clean(docs, item)
    assert kept.columns == names and sorted(map(tuple, kept.collect()), key=str) == sorted((rows[i] for i in (1, 3, 4)), key=str)

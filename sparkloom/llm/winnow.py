"""Document fingerprints by winnowing, in DataFrame functions only.

Words are hashed; a polynomial rolling hash covers each run of `k` words; of each window of `w` adjacent run
hashes the smallest is kept, the rightmost of equal ones, with its position. Any passage of w + k - 1 words that
two texts share therefore leaves a common mark in both. A word over LONG characters, as texts without spaces have,
counts as its characters, so such texts are fingerprinted too.

Array functions work on whole columns of hashes by shifted pairs: a run hash of k words is put together from
hashes of 1, 2, 4.. words, a window minimum from minima of 1, 2, 4.. positions. So no position looks at its whole
window, nothing is exploded, and nothing but `lead` moves rows.

Cases: null and blank texts have no marks; texts under k words have one mark for the whole; equal texts have equal
fingerprints; likeness is the Jaccard index of the sets of mark hashes, 1 for two texts without marks, whatever
they are. Repeated rows and ids stay as they are and follow each other in order of id, then text hash, then text;
null ids come first. An empty table gives an empty result. Other input columns are ignored.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words_of

#: Words of a run and runs of a window: passages of RUN + WINDOW - 1 = 5 words leave a mark.
RUN, WINDOW = 3, 3
PRIME = 2**31 - 1
BASE = 1_000_003
_TOP = 2**32
#: A word of more characters is read character by character.
LONG = 24


def _pairs(a: str, shift: int, join) -> Column:
    """join(x[i], x[i + shift]) for all i where both are."""
    n = F.greatest(F.size(a) - shift, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(shift + 1), n), join)


def _appended(length: int):
    power = pow(BASE, length, PRIME)
    return lambda x, y: (x * power + y) % PRIME


def _steps(size: int) -> list[int]:
    """Shifts that put runs of `size` together: 1, 2, 4.. and then what is missing."""
    out, have = [], 1
    while have * 2 <= size:
        out.append(have)
        have *= 2
    return [*out, size - have] if size > have else out


def units_of(text: Column) -> Column:
    """The words of a text, long ones as their characters."""
    words = words_of(text)
    single = F.flatten(F.transform(words, lambda x: F.when(F.length(x) > LONG, F.split(x, "")).otherwise(F.array(x))))
    return F.when(F.exists(words, lambda x: F.length(x) > LONG), single).otherwise(words)


def winnow(df: DataFrame, text_col: str, out: str, k: int = RUN, w: int = WINDOW) -> DataFrame:
    """df with `out`: array of hash * 2**32 + (2**32 - 1 - position), in order of position."""
    a, g, m, words = f"{out}_a", f"{out}_g", f"{out}_m", f"{out}_w"
    df = df.withColumn(words, units_of(F.col(text_col))).withColumn(a, F.transform(words, lambda x: F.pmod(F.xxhash64(x), F.lit(PRIME))))
    # run hashes: runs of `have` words, doubled; then the words that are missing, one by one
    df, have = df.withColumn(g, F.col(a)), 1
    while have * 2 <= k:
        df = df.withColumn(g, _pairs(g, have, _appended(have)))
        have *= 2
    while have < k:
        n = F.greatest(F.size(a) - have, F.lit(0))
        df = df.withColumn(g, F.zip_with(F.slice(g, F.lit(1), n), F.slice(a, F.lit(have + 1), n), _appended(1)))
        have += 1
    whole = F.when(F.size(a) > 0, F.array(F.pmod(F.xxhash64(a), F.lit(PRIME)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(g, F.when(F.size(a) >= k, F.col(g)).otherwise(whole))
    df = df.withColumn(g, F.transform(g, lambda x, i: x * _TOP + (_TOP - 1 - i)))
    df = df.withColumn(m, F.col(g))
    for shift in _steps(w):
        df = df.withColumn(m, _pairs(m, shift, lambda x, y: F.least(x, y)))
    few = F.when(F.size(g) > 0, F.array(F.array_min(g))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(out, F.array_distinct(F.when(F.size(g) >= w, F.col(m)).otherwise(few)))
    return df.drop(words, a, g, m)


def hashes(marks: Column) -> Column:
    return F.array_distinct(F.transform(marks, lambda x: F.shiftright(x, 32)))


def positions(marks: Column) -> Column:
    return F.transform(marks, lambda x: _TOP - 1 - x.bitwiseAND(F.lit(_TOP - 1)))


def digest(marks: Column) -> Column:
    """128 bits of hashes and positions, and their number."""
    return F.concat_ws("-", F.size(marks).cast("string"), F.lpad(F.lower(F.hex(F.xxhash64(marks))), 16, "0"), F.lpad(F.lower(F.hex(F.xxhash64(F.lit(1), marks))), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def with_next(df: DataFrame, order: str, value: str, out: str, rows_each: int = 2000, most: int = 100_000) -> DataFrame:
    """df with `out`: the `value` of the next row by `order` (a long), after the last row that of the first.

    Rows are dealt to ranges of about rows_each rows (at most `most` ranges, then larger ones), cut at approximate
    quantiles; an order that takes several quantiles, such as a null or repeated id of many rows, is cut further by the
    hash of its values. The first row of each range is also put, marked, behind the last one of the range before it.
    """
    key = F.coalesce(F.col(order), F.lit(-(2**63)))
    df = df.withColumn("_at", F.struct(key.alias("k"), F.xxhash64(value).alias("h")))
    count = df.count()
    if not count:
        return df.withColumn(out, F.col(value)).drop("_at")
    n = min(most, max(1, -(-count // rows_each)))
    quantiles = df.select(F.percentile_approx(key, [i / n for i in range(1, n)], max(10_000, 10 * n))).first()[0] if n > 1 else []
    times = Counter(quantiles)
    cuts = sorted(times)
    if cuts:
        side = max(1, int(len(cuts) ** 0.5))
        runs = [cuts[i : i + side] for i in range(0, len(cuts), side)]

        def folded(values: list, kind: str) -> Column:
            """A constant that the optimizer reads once, not one expression a value."""
            return F.from_json(F.lit(json.dumps(values)), kind)

        nested = folded(runs, "array<array<bigint>>")
        run = F.size(F.filter(folded([r[0] for r in runs], "array<bigint>"), lambda x: x <= key))
        at = (F.col("_run") - 1) * side + F.size(F.filter(F.element_at(nested, F.greatest(F.col("_run"), F.lit(1))), lambda x: x <= key))
        df = df.withColumn("_run", run).withColumn("_part", F.when(F.col("_run") == 0, 0).otherwise(at)).drop("_run")
        # the hashes of a heavy order, as that many equal shares of all hashes; larger orders of its range follow them
        heavy = {cut: times[cut] for cut in cuts if times[cut] > 1}
        if heavy:
            shares = F.try_element_at(F.map_from_entries(F.transform(folded([[k, v] for k, v in heavy.items()], "array<array<bigint>>"), lambda x: F.struct(x[0], x[1]))), key)
            first = F.element_at(folded([cuts[0], *cuts], "array<bigint>"), F.col("_part") + 1)
            of_range = F.try_element_at(F.map_from_entries(F.transform(folded([[k, v] for k, v in heavy.items()], "array<array<bigint>>"), lambda x: F.struct(x[0], x[1]))), first)
            share = F.floor((F.shiftright(F.col("_at.h"), 1).cast("double") / 2.0**63 + 0.5) * shares)
            sub = F.when(shares.isNotNull(), F.least(F.greatest(share, F.lit(0)), shares - 1)).otherwise(F.coalesce(of_range, F.lit(0)))
        else:
            sub = F.lit(0)
        df = df.withColumn("_part", F.struct(F.col("_part").cast("int").alias("a"), sub.cast("int").alias("b")))
    else:
        df = df.withColumn("_part", F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))
    firsts = sorted((tuple(r["_part"]), tuple(r["k"])) for r in df.groupBy("_part").agg(F.min("_at").alias("k")).collect())  # a row per range
    spark = df.sparkSession
    before = spark.createDataFrame([(p, k, firsts[i - 1][0]) for i, (p, k) in enumerate(firsts)], "_part struct<a:int,b:int>, _first struct<k:bigint,h:bigint>, _before struct<a:int,b:int>")
    marked = df.join(F.broadcast(before), "_part").withColumn("_mark", F.explode(F.when(F.col("_at") == F.col("_first"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    marked = marked.withColumn("_part", F.when(F.col("_mark") == 1, F.col("_before")).otherwise(F.col("_part")))
    w = Window.partitionBy("_part").orderBy("_mark", "_at", value)
    return marked.withColumn(out, F.lead(value).over(w)).where("_mark = 0").drop("_part", "_first", "_before", "_mark", "_at")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = RUN, w: int = WINDOW) -> DataFrame:
    """Per document: marks of its text, of its edited text and of the next document's, digests and likenesses."""
    df = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    df = with_next(df, "_id", "_text", "_next")
    n = F.length("_text")
    half = F.floor(n / 2).cast("int")
    df = df.withColumn("n_chars", n.cast("bigint")).withColumn("_edited", F.concat(F.substring("_text", F.lit(1), n - half), F.substring("_next", F.lit(1), half)))
    for text, marks in (("_text", "marks"), ("_edited", "edited_marks"), ("_next", "next_marks")):
        df = winnow(df, text, marks, k, w).withColumn(f"_{marks}", hashes(F.col(marks)))
    return df.select(
        F.col("_id").alias(id_col),
        "n_chars",
        F.sha2(F.encode("_edited", "UTF-8"), 256).alias("edited_sha256"),
        digest(F.col("marks")).alias("fingerprint"),
        digest(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("_marks"), F.col("_edited_marks")).alias("near_edited"),
        likeness(F.col("_marks"), F.col("_next_marks")).alias("near_next"),
        "marks",
        "edited_marks",
    )

"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed is a fixed mask over adjacent tokens of which some positions are ignored, so a substituted token there
leaves the seed intact. Seeds of the benchmark items meet seeds of the documents in a join on their hashes; each
meeting fixes an alignment of an item and a document. Each distinct alignment is then compared once, position by
position, as far as both go.

An alignment counts if `similarity` of all its tokens agree, or of `least` adjacent ones; it must have `least`
tokens, or all of an item that has fewer. Within 20 % of substitutions no alignment of `least` = 13 tokens or of a
whole item of 8 to 12 lacks a seed (HEAVY and LIGHT masks; a test tries all patterns), so what counts is found.
Items under `fewest` tokens are no evidence inside other text; they count where they are a whole document.

The documents are not shuffled: the benchmark's seeds are broadcast in blocks of at most `seeds_at_once` rows,
each block against all documents. What meets is reduced to distinct alignments, five numbers each; only documents
that have one are read again with their tokens.

Cases: null, blank and letterless texts and items match nothing. Letters and digits count, in lower case; anything
else separates tokens, and each character of a script without spaces is a token. Repeated documents and items count
once for their id; a null id is an id. Empty tables give an empty result. Other columns are ignored (or kept, in
`clean`, whatever they are called).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UNSPACED, col, packed, salted_lookup, sized_broadcast, stored, unpacked

#: 1 takes a token, 0 ignores it. The first masks are for items of `least` tokens or more, the others for shorter ones.
HEAVY = ("110110100111", "1101010011", "11100101")
LIGHT = ("1111", "11011")
LEAST, FEWEST = 13, 8


def token_hashes(text: Column) -> Column:
    plain = F.lower(F.coalesce(text, F.lit("")))
    spaced = F.when(plain.rlike(f"[{UNSPACED}]"), F.regexp_replace(plain, f"([{UNSPACED}])", " $1 ")).otherwise(plain)
    words = F.array_remove(F.split(spaced, r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda x: F.xxhash64(x))


def seeds(df: DataFrame, tokens: str, at: str, masks: dict[int, str]) -> DataFrame:
    """df with a row per position `at` (from 0) and mask (by number) that fits there, and the seed's hash."""
    shortest = min(map(len, masks.values()))
    df = df.where(F.size(tokens) >= shortest).withColumn(at, F.explode(F.sequence(F.lit(0), F.size(tokens) - shortest)))
    found = []
    for i, mask in masks.items():
        taken = [F.get(F.col(tokens), F.col(at) + j) for j, c in enumerate(mask) if c == "1"]
        found.append(F.when(F.col(at) + len(mask) <= F.size(tokens), F.xxhash64(F.lit(i), *taken)))
    return df.withColumn("seed", F.explode(F.array(*found))).where("seed is not null")


def compared(similarity: float, least: int) -> dict[str, Column]:
    """Columns of an alignment (_it, _dt, _shift): _n tokens of which _same agree; _n is 0 if it doesn't count.

    One pass adds up the last `need` positions at each place and notes the first and the last place at which enough of
    them agree; what lies between counts, or all if enough of all agree."""
    low = F.greatest(F.lit(0), -F.col("_shift"))
    size = F.least(F.size("_it"), F.size("_dt") - F.col("_shift")) - low
    same = F.zip_with(F.slice("_it", low + 1, size), F.slice("_dt", low + F.col("_shift") + 1, size), lambda x, y: (x == y).cast("int"))
    need = F.least(F.lit(least), F.size("_it"))
    fits = F.col("_m") >= F.col("_need")
    change = F.zip_with("_eq", F.slice(F.concat(F.array_repeat(F.lit(0), F.col("_need")), F.col("_eq")), F.lit(1), F.col("_m")), lambda x, y: x - y)

    def step(s: Column, x: Column) -> Column:
        now, i = s["now"] + x, s["i"] + 1
        enough = (i >= F.col("_need")) & (now + 1e-9 >= similarity * F.col("_need"))
        return F.struct(now.alias("now"), i.alias("i"), F.when(enough & (s["first"] < 0), i).otherwise(s["first"]).alias("first"), F.when(enough, i).otherwise(s["last"]).alias("last"))

    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("i"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    ends = F.aggregate(change, start, step)
    begin = F.col("_w.first") - F.col("_need")
    whole = fits & (F.col("_all") + 1e-9 >= similarity * F.col("_m"))
    part = fits & (F.col("_w.first") > 0)
    inside = F.aggregate(F.slice("_eq", begin + 1, F.col("_w.last") - begin), F.lit(0), lambda s, x: s + x)
    return {
        "_eq": F.when(size > 0, same).otherwise(F.array().cast("array<int>")),
        "_m": F.size("_eq"),
        "_need": need,
        "_all": F.aggregate("_eq", F.lit(0), lambda s, x: s + x),
        "_w": F.when(fits, ends),
        "_n": F.when(whole, F.col("_m")).when(part, F.col("_w.last") - begin).otherwise(0),
        "_same": F.when(whole, F.col("_all")).when(part, inside).otherwise(0),
    }


def _keys(ident: Column, text: Column) -> dict[str, Column]:
    """128 bits that tell rows apart by id and text, since an id may be null or stand for several texts."""
    return {f"_{i}": F.xxhash64(F.lit(i), ident.isNull(), ident, text.isNull(), text) for i in ("d1", "d2")}


def found(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = 0.8, least: int = LEAST, fewest: int = FEWEST, seeds_at_once: int = 1_000_000) -> DataFrame:
    """A row per distinct document (_d1, _d2, _id) and item (_item) that overlap: _same tokens of _n, the most of all alignments."""
    bench = items.select(col(item_col).alias("_item"), token_hashes(col(item_text)).alias("_it")).where("size(_it) > 0")
    bench = stored(bench.withColumns({"_k1": F.xxhash64("_item", "_it"), "_k2": F.xxhash64(F.lit(1), F.col("_item").isNull(), "_item", "_it")}).dropDuplicates(["_k1", "_k2"]), "items")
    masks = dict(enumerate((*HEAVY, *LIGHT)))
    heavy, light = {i: m for i, m in masks.items() if i < len(HEAVY)}, {i: m for i, m in masks.items() if i >= len(HEAVY)}
    size = F.size("_it")
    index = seeds(bench.where(size >= least), "_it", "_ip", heavy).unionByName(seeds(bench.where((size >= fewest) & (size < least)), "_it", "_ip", light))
    index = stored(index.select("_k1", "_k2", "_ip", "seed"), "seeds")
    # masks that no item uses can't meet anything
    short, little, total, weight = bench.agg(F.count_if((size >= fewest) & (size < least)), F.count_if(size < fewest), F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    read = docs.select(col(id_col).alias("_id"), col(text_col).alias("_text")).withColumns(_keys(F.col("_id"), F.col("_text")))
    placed = seeds(read.select("_d1", "_d2", token_hashes(F.col("_text")).alias("_dt")), "_dt", "_dp", masks if short else heavy)
    blocks = max(1, -(-index.count() // seeds_at_once))
    met = None
    for b in range(blocks):
        part = F.broadcast(index.where(F.pmod("seed", F.lit(blocks)) == b))
        hit = placed.join(part, "seed").select("_d1", "_d2", "_k1", "_k2", (F.col("_dp") - F.col("_ip")).alias("_shift"))
        met = hit if met is None else met.unionByName(hit)
    aligned = stored(met.distinct(), "alignments")
    seen = sized_broadcast(aligned.select("_d1", "_d2").distinct(), 500_000)
    again = stored(read.join(seen, ["_d1", "_d2"], "left_semi").dropDuplicates(["_d1", "_d2"]).select("_d1", "_d2", "_id", token_hashes(F.col("_text")).alias("_dt")), "met-documents")
    if total <= 200_000 and weight <= 4_000_000:  # 32 MB of token hashes
        aligned = aligned.join(F.broadcast(bench), ["_k1", "_k2"])
    else:
        keyed = aligned.withColumn("_k", F.struct("_k1", "_k2")).drop("_k1", "_k2")
        aligned = salted_lookup(keyed, bench.select(F.struct("_k1", "_k2").alias("_k"), "_item", "_it"), "_k", F.col("_d1"), how="inner")
    alike = aligned.join(again, ["_d1", "_d2"])
    for name, value in compared(similarity, least).items():
        alike = alike.withColumn(name, value)
    alike = alike.where("_n > 0").select("_d1", "_d2", "_id", "_item", "_same", "_n")
    if little:
        tiny = bench.where(size < fewest).select("_item", F.xxhash64("_it").alias("_whole"), size.alias("_n"))
        small = read.withColumn("_dt", token_hashes(F.col("_text"))).where((F.size("_dt") > 0) & (F.size("_dt") < fewest))
        whole = small.select("_d1", "_d2", "_id", F.xxhash64("_dt").alias("_whole"), F.size("_dt").alias("_n")).join(tiny, ["_whole", "_n"])
        alike = alike.unionByName(whole.select("_d1", "_d2", "_id", "_item", F.col("_n").alias("_same"), "_n"))
    # most agreeing tokens, then fewest compared, as one number
    best = alike.groupBy("_d1", "_d2", "_id", "_item").agg(F.max(F.col("_same").cast("long") * 2**32 - F.col("_n")).alias("_b"))
    same = F.ceil(F.col("_b") / 2**32).cast("bigint")
    return best.select("_d1", "_d2", "_id", "_item", same.alias("_same"), (same * 2**32 - F.col("_b")).alias("_n"), "_b")


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", **how) -> DataFrame:
    """A row per document and item that overlap: the ids, the most agreeing tokens, and their share of those compared."""
    rows = found(docs, items, id_col, text_col, item_col, item_text, **how)
    best = rows.groupBy("_id", "_item").agg(F.max_by(F.struct("_same", "_n"), "_b").alias("b"))
    return best.select(F.col("_id").alias(id_col), F.col("_item").alias(item_col), F.col("b._same").alias("n_tokens"), F.round(F.col("b._same") / F.col("b._n"), 6).alias("similarity"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without those that overlap an item; all columns are kept. A row goes for its own text: others of its id stay."""
    bad = stored(found(docs, items, id_col, text_col, **how).select("_d1", "_d2").distinct(), "contaminated")
    rows = packed(docs, **_keys(col(id_col), col(text_col)))
    return rows.join(sized_broadcast(bad, 500_000), ["_d1", "_d2"], "left_anti").select(*unpacked(docs.columns))

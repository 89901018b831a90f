"""Sharding by extendible hashing.

A row's shard is a prefix of its hash bits. Starting from the empty prefix, a bucket whose bytes exceed the limit
splits on one more bit; buckets that fit stay, however deep others go. The directory lists the buckets.

Bits are looked at STEP at a time: the bytes of all prefixes of the next STEP bits come from one aggregation, over
rows that were summed per hash first (so a frequent id is one row), and the next round reads only what lies below
buckets that are still too large. No level scans all rows again and no bucket is gathered in one task.

Cases: a bucket can exceed the limit only where one row alone does, or where rows of the same hash do (rows of
one id); those are marked `oversize`. Null ids share one hash, null texts have 0 bytes; repeated
rows count each; an empty table gives an empty directory. Other columns are ignored (or kept, in `assign`; its own
columns take the place of input columns of the same name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, packed, quoted, salted_lookup, sized_broadcast, stored, unpacked

#: Bits of the hash, from the first 15 hex digits of an MD5.
HASH_BITS = 60
#: Bits that one round looks at.
STEP = 8


def hash_of(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("bigint")


def _prefix(h: str, depth: str) -> Column:
    return F.expr(f"shiftright({h}, {HASH_BITS} - {depth})")


def directory(sized: DataFrame, limit: int) -> DataFrame:
    """The buckets of sized (_h, _bytes): depth, prefix, bytes, rows, oversize."""
    rows = stored(sized.groupBy("_h").agg(F.sum("_bytes").alias("_bytes"), F.count("*").alias("_rows")), "sized")
    found, open_, first, deep = None, None, 0, STEP
    while True:
        below = rows.withColumn("_c", F.shiftright("_h", HASH_BITS - deep))
        if open_ is not None:
            below = below.join(sized_broadcast(open_.select(F.col("_p").alias("_open"))), F.shiftright("_h", HASH_BITS - first + 1) == F.col("_open"), "left_semi")
        cells = below.groupBy("_c").agg(F.sum("_bytes").alias("bytes"), F.sum("_rows").alias("rows"), F.min("_h").alias("low"), F.max("_h").alias("high"))
        levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(first), F.lit(deep)))).withColumn("prefix", F.expr(f"shiftright(_c, {deep} - depth)"))
        sums = stored(levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high")), "prefixes")
        splits = (F.col("bytes") > limit) & (F.col("low") < F.col("high"))
        split = sums.where(splits).select(F.col("depth").alias("_d"), F.col("prefix").alias("_p"))
        above = split if open_ is None else split.unionByName(open_)
        stay = sums.where(~splits)
        leaves = stay.join(above, (F.col("depth") == F.col("_d") + 1) & (F.shiftright("prefix", 1) == F.col("_p")), "left_semi")
        if first == 0:
            leaves = leaves.unionByName(stay.where("depth = 0"))
        found = leaves if found is None else found.unionByName(leaves)
        open_ = split.where(F.col("_d") == deep)
        if open_.isEmpty():
            break
        first, deep = deep + 1, min(HASH_BITS, deep + STEP)
    return stored(found.select("depth", "prefix", "bytes", "rows", (F.col("bytes") > limit).alias("oversize")), "directory")


def shard_name(depth: Column, prefix: Column) -> Column:
    """The prefix as bits; the root bucket has none."""
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.conv(prefix.cast("string"), 10, 2), depth, F.lit("0")))


#: The columns that `assign` adds.
ADDED = ("shard", "shard_depth", "shard_bytes", "oversize")


def assign(docs: DataFrame, limit: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with shard (hash prefix bits), shard_depth, shard_bytes and oversize; all other columns are kept."""
    hashed = packed(docs, _h=hash_of(col(id_col)), _bytes=F.coalesce(F.octet_length(col(text_col)), F.lit(0)).cast("bigint"))
    buckets = directory(hashed.select("_h", "_bytes"), limit)
    depths = sorted(r[0] for r in buckets.select("depth").distinct().collect()) or [0]  # at most HASH_BITS + 1
    listed = buckets.select(F.col("depth").alias("_d"), F.col("prefix").alias("_p"), F.col("bytes").alias("_b"), F.col("oversize").alias("_o"))

    def tried(df: DataFrame) -> DataFrame:
        """df with its prefix of each depth that the directory has; exactly one of them is there."""
        return df.withColumn("_d", F.explode(F.array(*[F.lit(d) for d in depths]))).withColumn("_p", _prefix("_h", "_d"))

    if buckets.count() <= 200_000:
        placed = tried(hashed).join(F.broadcast(listed), ["_d", "_p"])
    else:
        keys = tried(hashed.select("_h").distinct()).join(listed, ["_d", "_p"])
        placed = salted_lookup(hashed, keys, "_h", F.xxhash64(F.col(f"_row.{quoted(text_col)}")), how="inner")
    own = (shard_name(F.col("_d"), F.col("_p")), F.col("_d"), F.col("_b"), F.col("_o"))
    return placed.select(*unpacked(docs.columns, ADDED), *[c.alias(n) for n, c in zip(ADDED, own)])

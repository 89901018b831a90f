"""Mixing sources to target weights by temperature, in DataFrame functions only.

Source shares of the tokens are raised to an exponent and normalised. The exponent is bisected between 0 (equal
weights) and 1 (shares as they are): with `max_repeats` to the flattest weights under which no source is read more
often than that, with `target_entropy` to the steepest whose entropy, as a share of the highest, is still that.

The token budget is split by weight. A source's documents are read in whole epochs, then in part of one more: its
documents in a fixed pseudo-random order, up to the last that fits. The order is by an MD5 of seed and id, whose
leading digits cut a source into blocks. Token sums per block tell where the budget ends; only that one block is
summed document by document, so no task holds a whole source.

Each copy of a document gets a place: the fraction of its source's reading at which it comes, by which the copies
are dealt to `mix_block`s of about block_tokens tokens. Every block holds the sources by weight; within a block
the order is mix_key.

Without a budget, it is the least that reads each source once at least, so no document is left out.

Cases: null and empty sources are two sources of their own; a document without words counts one token, a character of a
script without spaces too; repeated rows
and ids with equal keys are read together or not at all in the partial epoch; an empty table gives an empty result.
Other columns are ignored (or kept, in `mixed`). Sources are assumed to be no more than a driver-side table would
be (the totals of all sources are one row); documents per source are not bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import UNSPACED, col, packed, quoted, sized_broadcast, stored, unpacked

#: Steps of the bisection.
STEPS = 40
#: Hex digits of the order key that name a block of a source's documents, and that give a place.
BLOCK_DIGITS, PLACE_DIGITS = 3, 13


#: A word, or one character of a script without spaces.
TOKEN = rf"[{UNSPACED}]|[^\x20\x09-\x0D{UNSPACED}]+"


def tokens_of(text: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN))).cast("bigint")


def order_key(id_col: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))))


def weights(totals: DataFrame, max_repeats: float | None = 2.0, target_entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """totals (_src, _tokens) with exponent, weight, and the tokens to read (_budget)."""
    if (max_repeats is None) == (target_entropy is None):
        raise ValueError("give max_repeats or target_entropy")
    one = totals.agg(F.array_sort(F.collect_list(F.struct("_src", F.col("_tokens").cast("double").alias("t")))).alias("all"))
    one = one.withColumn("sum", F.aggregate("all", F.lit(0.0), lambda s, x: s + x["t"]))

    def total(f) -> Column:
        return F.aggregate("all", F.lit(0.0), lambda s, x: s + f(x["t"] / F.col("sum")))

    def fits(a: Column) -> Column:
        z = total(lambda p: F.pow(p, a))
        if target_entropy is not None:
            entropy = F.aggregate("all", F.lit(0.0), lambda s, x: s - F.pow(x["t"] / F.col("sum"), a) / z * F.ln(F.pow(x["t"] / F.col("sum"), a) / z))
            return entropy >= F.lit(target_entropy) * F.ln(F.size("all").cast("double"))
        read = F.transform("all", lambda x: F.pow(x["t"] / F.col("sum"), a) / z / x["t"])
        return F.array_max(read) * (F.lit(float(budget)) if budget is not None else 1 / F.array_min(read)) <= F.lit(float(max_repeats))

    def step(s: Column, _i: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        up = fits(mid) if target_entropy is not None else ~fits(mid)
        return F.struct(F.when(up, mid).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(mid).alias("hi"))

    ends = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), step)
    one = one.withColumn("exponent", F.round(ends["lo" if target_entropy is not None else "hi"], 9))
    one = one.withColumn("z", total(lambda p: F.pow(p, F.col("exponent"))))
    rows = one.select("exponent", "z", "sum", F.explode("all").alias("x"), F.aggregate("all", F.lit(0.0), lambda m, x: F.greatest(m, x["t"] / (F.pow(x["t"] / F.col("sum"), F.col("exponent")) / F.col("z")))).alias("whole"))
    w = F.pow(F.col("x.t") / F.col("sum"), F.col("exponent")) / F.col("z")
    goal = F.lit(float(budget)) if budget is not None else F.col("whole")
    return rows.select("x._src", F.col("x.t").cast("bigint").alias("_tokens"), "exponent", w.alias("weight"), F.floor(w * goal * F.lit(1 + 1e-12) + F.lit(1e-6)).cast("bigint").alias("_budget"))


def _plan(sized: DataFrame, how: dict) -> DataFrame:
    """Per source: whole epochs (_full), and the last order key of the partial one (_cut; null: none)."""
    totals = stored(sized.groupBy("_src").agg(F.sum("_n").alias("_tokens")), "totals")
    plan = stored(weights(totals, **how), "weights")
    plan = plan.withColumn("_full", F.floor(F.col("_budget") / F.col("_tokens"))).withColumn("_rest", F.col("_budget") - F.col("_full") * F.col("_tokens"))
    blocks = sized.groupBy("_src", F.substring("_key", 1, BLOCK_DIGITS).alias("_block")).agg(F.sum("_n").alias("_sum"))
    ahead = F.sum("_sum").over(Window.partitionBy("_src").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("_ahead", F.coalesce(ahead, F.lit(0)))
    last = stored(blocks.join(plan.select("_src", "_rest"), "_src").where("_ahead <= _rest and _rest < _ahead + _sum").select("_src", "_block", (F.col("_rest") - F.col("_ahead")).alias("_room")), "last")
    # the block in which the budget ends, document by document; equal keys go together
    inside = sized.withColumn("_block", F.substring("_key", 1, BLOCK_DIGITS)).join(sized_broadcast(last), ["_src", "_block"])
    keys = inside.groupBy("_src", "_room", "_key").agg(F.sum("_n").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_src").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0))
    cut = keys.withColumn("_upto", upto).where("_upto <= _room").groupBy("_src").agg(F.max("_key").alias("_in"))
    # no document of that block fits: the cut lies before the block
    return stored(plan.join(last, "_src", "left").join(cut, "_src", "left").select("_src", "_full", (F.col("_budget") / F.col("_tokens")).alias("_epochs"), F.coalesce("_in", "_block").alias("_cut"), F.sum("_budget").over(Window.partitionBy()).alias("_all")), "plan")


def _copies(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, block_tokens: int, how: dict) -> DataFrame:
    """A row per copy: the input row as `_row`, _n, _epoch, _block, _place. Nothing but these and `_row` is carried."""
    source = col(source_col)
    src = F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), source))
    keyed = packed(docs, _src=src, _key=order_key(col(id_col), seed), _n=tokens_of(col(text_col)))
    sized = stored(keyed.select("_src", "_key", "_n"), "sized")
    plan = _plan(sized, how)
    n = F.col("_full") + F.when(F.col("_key") <= F.col("_cut"), 1).otherwise(0)
    read = keyed.join(sized_broadcast(plan), "_src").withColumn("_copies", n.cast("int")).where("_copies > 0")
    read = read.withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    place = (F.col("_epoch") + F.conv(F.substring("_key", 1, PLACE_DIGITS), 16, 10).cast("double") / float(16**PLACE_DIGITS)) / F.col("_epochs")
    blocks = F.ceil(F.col("_all") / block_tokens)
    return read.withColumn("_block", F.least(F.floor(place * blocks), blocks - 1).cast("bigint")).withColumn("_place", F.md5(F.concat_ws(":", "_key", F.col("_epoch").cast("string"))))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, block_tokens: int = 1_000_000, **how) -> DataFrame:
    """A row per copy to read: id, source, n_tokens, epoch, mix_block, mix_key. `how`: max_repeats, target_entropy, budget."""
    found = _copies(docs.select(*[col(c) for c in dict.fromkeys((id_col, text_col, source_col))]), id_col, text_col, source_col, seed, block_tokens, how)
    return found.select(F.col(f"_row.{quoted(id_col)}").alias(id_col), F.col(f"_row.{quoted(source_col)}").alias(source_col), F.col("_n").alias("n_tokens"), F.col("_epoch").alias("epoch"), F.col("_block").alias("mix_block"), F.col("_place").alias("mix_key"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, block_tokens: int = 1_000_000, **how) -> DataFrame:
    """docs with each row as often as it is to be read; all columns and their values are kept, none is added."""
    return _copies(docs, id_col, text_col, source_col, seed, block_tokens, how).select(*unpacked(docs.columns))

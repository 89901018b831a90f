"""Deduplication and entity resolution."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans.folds import fold
from ..plans.storage import stored


def exact_survivors(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """One row per key: its digest, the smallest id, the number of rows. Counts are combined before the shuffle."""
    return df.groupBy(F.sha2(key, 256).alias("digest")).agg(F.min(id_col).alias("survivor"), F.count("*").alias("copies"))


def shared_provenance(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two rows share a unit, an asset, a page or a slide (arrays by name)."""
    test = F.lit(False)
    for k in a:
        test = test | F.coalesce(F.arrays_overlap(a[k], b[k]), F.lit(False))
    return test


def similar_pairs(df: DataFrame, id_col: str, key: str, block: list[str], least: float, most_shared: int | None = None, chunk: int = 512) -> DataFrame:
    """Pairs within a block whose bigram sets have a Jaccard index of `least` or more: a, b, similarity.

    Keys repeat, so distinct ones of a block are compared, and their rows become pairs only in the last step, which
    shuffles lists of `chunk` ids at most and no pair.

    Prefix filtering: a pair that similar shares one of the rarest pieces of either set, so only those meet in the
    join. Pieces are ranked by how many keys have them; a set of n pieces needs its n - ceil(least * n) + 1 rarest."""
    rows = df.select(F.col(id_col).alias("id"), *block, F.col(key).alias("k")).dropna(subset=["id", *block, "k"])
    keys = rows.groupBy(*block, "k").agg(F.collect_list("id").alias("ids")).withColumn("set", tx.bigrams(F.col("k"))).where(F.size("set") > 0)
    keys = stored(keys, "keys")
    sets = keys.select(*block, "k", "set")
    pieces = sets.select(*block, "k", F.explode("set").alias("p"))
    counts = pieces.groupBy(*block, "p").agg(F.count("*").alias("c"))
    ranked = pieces.join(counts, [*block, "p"]).withColumn("r", F.row_number().over(Window.partitionBy(*block, "k").orderBy("c", "p"))).withColumn("n", F.count("*").over(Window.partitionBy(*block, "k")))
    prefix = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * F.lit(least)) + 1).select(*block, "k", "p", "n")
    x, y = prefix.select(*block, "p", F.col("k").alias("ka"), F.col("n").alias("na")), prefix.select(*block, "p", F.col("k").alias("kb"), F.col("n").alias("nb"))
    near = x.join(y, [*block, "p"]).where((F.col("ka") < F.col("kb")) & (F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb"))).select(*block, "ka", "kb").distinct()
    j = near.join(sets.select(*block, F.col("k").alias("ka"), F.col("set").alias("sa")), [*block, "ka"]).join(sets.select(*block, F.col("k").alias("kb"), F.col("set").alias("sb")), [*block, "kb"])
    alike = j.select(*block, "ka", "kb", F.round(tx.jaccard(F.col("sa"), F.col("sb")), 6).alias("similarity")).where(F.col("similarity") >= least)
    alike = alike.unionByName(sets.select(*block, F.col("k").alias("ka"), F.col("k").alias("kb"), F.lit(1.0).alias("similarity")))

    starts = F.sequence(F.lit(1), F.size("ids"), F.lit(chunk))
    lists = keys.select(*block, "k", F.explode(F.transform(starts, lambda i: F.slice("ids", i, F.lit(chunk)))).alias("ids"))
    met = alike.join(lists.select(*block, F.col("k").alias("ka"), F.col("ids").alias("x")), [*block, "ka"]).join(lists.select(*block, F.col("k").alias("kb"), F.col("ids").alias("y")), [*block, "kb"])
    # few bytes that become many rows: dealt by number, or they would be put together in one task
    dealt = met.select("similarity", F.col("ka") == F.col("kb"), "x", "y").toDF("similarity", "same", "x", "y").repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = dealt.select("similarity", "same", "y", F.explode("x").alias("a")).select("similarity", "same", "a", F.explode("y").alias("b"))
    pairs = pairs.where((F.col("a") < F.col("b")) | (~F.col("same") & (F.col("a") > F.col("b"))))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def mergeable(pairs: DataFrame) -> DataFrame:
    """pairs (a_name, a_definition, b_name, b_definition, shares) with verdict: the first veto that applies, else the
    ground on which they merge, else distinct. There is no merging by similar names alone."""
    own = [c for c in pairs.columns]
    for side in "ab":
        d = F.col(f"{side}_definition")
        pairs = pairs.withColumns({f"_{side}c": F.replace(tx.prose(d), F.lit(" ")), f"_{side}e": tx.causal_edges(d), f"_{side}n": tx.numeric_claims(d)})
    same_name = tx.normalized_key(F.col("a_name")) == tx.normalized_key(F.col("b_name"))
    covered = tx.jaccard(tx.bigrams(F.col("_ac")), tx.bigrams(F.col("_bc")))
    verdict = (
        F.when(tx.opposite_terms(F.col("a_definition"), F.col("b_definition")), "veto_opposite")
        .when(tx.reversed_causality(F.col("_ae"), F.col("_be")), "veto_causality")
        .when(tx.numeric_conflict(F.col("_an"), F.col("_bn")), "veto_numbers")
        .when(same_name & (F.col("_ac") == F.col("_bc")) & (F.length("_ac") >= 8), "same_claim")
        .when(same_name & F.col("shares") & (covered >= 0.75), "same_prose")
        .otherwise("distinct")
    )
    return pairs.withColumn("verdict", verdict).select(*own, "verdict")


CLUSTERS = "block string, id long, cluster int"


def complete_link(rows: DataFrame, least: float) -> DataFrame:
    """Greedy complete-link clusters of rows (block, id, seq, key): in order of seq a row joins the first cluster all of
    whose members it resembles, else opens one. The order matters, so a block is one group. Only clusters whose opener
    shares a piece with the row are looked at: `least` is above 0, so others can't take it."""
    if least <= 0:
        raise ValueError("least must be above 0")

    def of_block(rows: list[dict]) -> list[tuple]:
        clusters: list[list[frozenset]] = []
        opened: dict[str, list[int]] = {}
        out = []
        for r in rows:
            k = r["key"]
            own = frozenset(k[j : j + 2] for j in range(max(1, len(k) - 1)))
            shared = Counter(n for piece in own for n in opened.get(piece, ()))
            near = sorted(n for n, c in shared.items() if c >= least * (len(own) + len(clusters[n][0]) - c))
            at = next((n for n in near if all(len(own & s) >= least * len(own | s) for s in clusters[n])), len(clusters))
            if at == len(clusters):
                clusters.append([])
                for piece in own:
                    opened.setdefault(piece, []).append(at)
            clusters[at].append(own)
            out.append((r["block"], r["id"], at))
        return out

    return fold(rows.select("block", "id", "seq", "key"), ["block"], ["seq", "id"], of_block, CLUSTERS)


def merge_clusters(rows: DataFrame, by: list[str]) -> DataFrame:
    """One node per cluster of rows (name, definition, confidence, cost, optional, is_root, seq, unit_id): named by the
    surest, then earliest; longest definition (the greater text of equal ones); mean confidence; highest cost;
    optional only if all are; root if any is; units united."""
    n = rows.groupBy(*by).agg(
        F.min(F.struct((-F.col("confidence")).alias("c"), "seq", "name"))["name"].alias("name"),
        F.max(F.struct(F.length("definition").alias("n"), "definition"))["definition"].alias("definition"),
        F.round(F.avg("confidence"), 4).alias("confidence"),
        F.max("cost").alias("cost"),
        F.bool_and("optional").alias("optional"),
        F.bool_or("is_root").alias("is_root"),
        F.array_sort(F.collect_set("unit_id")).alias("units"),
        F.count("*").alias("merged"),
    )
    key = tx.normalized_key(F.col("name"))
    ident = F.concat(F.lit("node_"), F.substring(F.sha1(key), 1, 12))
    twin = F.row_number().over(Window.partitionBy(ident).orderBy(*by))
    return n.withColumn("node_id", F.when(twin > 1, F.concat(ident, F.lit("_"), twin.cast("string"))).otherwise(ident))


def distinct_evidence(evidence: DataFrame, by: str, order: str, fields: list[str], most: int = 16) -> DataFrame:
    """The first occurrence of each evidence of a node, `most` at most, numbered."""
    first = evidence.groupBy(by, *fields).agg(F.min(order).alias("first"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy("first", *fields))).where(F.col("n") <= most)


def lone_scaffolds(rows: DataFrame) -> DataFrame:
    """Placeholders of rows (id, branch_id, key, is_scaffold) that fold into a node: one placeholder and one other row
    have that branch and key. Returns id, into."""
    g = rows.groupBy("branch_id", "key").agg(F.count_if("is_scaffold").alias("s"), F.count_if(~F.col("is_scaffold")).alias("t"), F.max(F.when(F.col("is_scaffold"), F.col("id"))).alias("id"), F.max(F.when(~F.col("is_scaffold"), F.col("id"))).alias("into"))
    return g.where("s = 1 and t = 1").select("id", "into")


def contained_keys(keys: Column) -> Column:
    """An array of keys without those that another one strictly holds, and without repeats."""
    return F.array_distinct(F.filter(keys, lambda x: ~F.exists(keys, lambda y: (y != x) & y.contains(x))))


def upsert(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """old and new by key with state: added, same, kept (only in old), conflict (fields differ)."""
    j = old.alias("o").join(new.alias("n"), key, "full_outer")
    differ = F.lit(False)
    for f in fields:
        differ = differ | ~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}"))
    in_old, in_new = F.col(f"o.{fields[0]}").isNotNull(), F.col(f"n.{fields[0]}").isNotNull()
    state = F.when(in_old & ~in_new, "kept").when(in_new & ~in_old, "added").when(differ, "conflict").otherwise("same")
    return j.select(key, *[F.coalesce(F.col(f"n.{f}"), F.col(f"o.{f}")).alias(f) for f in fields], state.alias("state"))


def by_priority(df: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("_r = 1").drop("_r")


def missing_from(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return expected.join(found, key, "left_anti")


def hash_distance(a: Column, b: Column) -> Column:
    """Differing bits of two hex hashes; 4 per digit of the longer one where their lengths differ. 16 digits at most,
    taken in halves since 64 bits don't fit a bigint."""

    def bits(x: Column, y: Column) -> Column:
        return F.bit_count(F.conv(x, 16, 10).cast("bigint").bitwiseXOR(F.conv(y, 16, 10).cast("bigint")))

    far = bits(F.substring(a, 1, 8), F.substring(b, 1, 8)) + F.when(F.length(a) > 8, bits(F.substring(a, 9, 8), F.substring(b, 9, 8))).otherwise(0)
    return F.when(F.length(a) != F.length(b), 4 * F.greatest(F.length(a), F.length(b))).otherwise(far)


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes x, y, width, height."""
    w = F.greatest(F.lit(0.0), F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1]))
    union = a[2] * a[3] + b[2] * b[3] - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


NMS = "page long, idx int, kept boolean"


def suppress_overlaps(boxes: DataFrame, most: float = 0.8) -> DataFrame:
    """boxes (page, idx, x, y, w, h) with kept: in order of idx, a box that covers an earlier kept one of its page at
    `most` or more goes. A fold per page."""

    def of_page(rows: list[dict]) -> list[tuple]:
        kept: list[dict] = []
        out = []
        for r in rows:
            ok = True
            for k in kept:
                w = max(0.0, min(r["x"] + r["w"], k["x"] + k["w"]) - max(r["x"], k["x"]))
                h = max(0.0, min(r["y"] + r["h"], k["y"] + k["h"]) - max(r["y"], k["y"]))
                u = r["w"] * r["h"] + k["w"] * k["h"] - w * h
                ok = ok and not (u > 0 and w * h / u >= most)
            if ok:
                kept.append(r)
            out.append((r["page"], r["idx"], ok))
        return out

    return fold(boxes.select("page", "idx", "x", "y", "w", "h"), ["page"], ["idx", "x", "y", "w"], of_page, NMS)


def match_native(assets: DataFrame, natives: DataFrame, overlap: float = 0.5, bits: int = 4) -> DataFrame:
    """Per asset (page, idx, x, y, w, h, hash) the first native one of its page that overlaps and looks alike."""
    n = natives.select("page", *[F.col(c).alias(f"n_{c}") for c in ("idx", "x", "y", "w", "h", "hash")])
    j = assets.join(n, "page").where((iou([F.col(c) for c in "xywh"], [F.col(f"n_{c}") for c in "xywh"]) >= overlap) & (hash_distance(F.col("hash"), F.col("n_hash")) <= bits))
    return j.groupBy("page", "idx").agg(F.min("n_idx").alias("native"))


def owner_of(assets: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per asset (asset, unit) the candidate (candidate, unit, confidence) that shares most units, then the surest,
    then the first."""
    j = assets.join(candidates, "unit").groupBy("asset", "candidate").agg(F.count("*").alias("overlap"), F.max("confidence").alias("confidence"))
    return by_priority(j, "asset", [F.desc("overlap"), F.desc("confidence"), F.col("candidate")])


def sample(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement by a seeded hash, in order of id."""
    return df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))).orderBy("_h", id_col).limit(n).drop("_h").orderBy(id_col)


def dct_hash(pixels: Column) -> Column:
    """Perceptual hash of 32x32 grey values (row by row): the 8x8 lowest cosine terms against their median, 16 hex digits."""
    k = np.arange(32)
    basis = np.cos(np.pi / 32 * (k[None, :] + 0.5) * np.arange(8)[:, None])

    def of(s: pd.Series) -> pd.Series:
        out = []
        for v in s:
            g = np.asarray(v, dtype=float).reshape(32, 32)
            low = (basis @ g @ basis.T).ravel()
            bits = low > np.median(low[1:])
            out.append(f"{int(''.join('1' if b else '0' for b in bits), 2):016x}")
        return pd.Series(out, dtype=object)

    return F.pandas_udf(of, "string")(pixels)


def repairable(incoming: DataFrame, known: DataFrame, open_ids: DataFrame, anonymous: int) -> DataFrame:
    """Nodes (page, n, identity, temp_id) that a repair may use: known ones, ones that fill an open id, and of those
    without an id the first `anonymous` of a page."""
    j = incoming.join(known.select("identity", F.lit(1).alias("_k")).distinct(), "identity", "left").join(open_ids.select("temp_id", F.lit(1).alias("_o")).distinct(), "temp_id", "left")
    free = F.col("_k").isNull() & F.col("_o").isNull() & F.col("temp_id").isNull()
    r = F.row_number().over(Window.partitionBy("page", free).orderBy("n"))
    return j.where("true").withColumn("_r", r).where(F.col("_k").isNotNull() | F.col("_o").isNotNull() | (free & (F.col("_r") <= anonymous))).select("page", "n", "identity", "temp_id")


def supplemented(nodes: DataFrame, formulas: DataFrame, key: str) -> DataFrame:
    """nodes and those formulas that no node has."""
    return nodes.unionByName(formulas.join(nodes, key, "left_anti").select(*nodes.columns))

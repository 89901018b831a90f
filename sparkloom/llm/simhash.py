"""SimHash near-duplicates over pivot distance tables.

A text becomes a 64-bit fingerprint; two fingerprints link at `max_bits` or fewer differing bits, and the
connected components of those links are the near-duplicate classes.

How links are found without comparing all pairs, and without losing any:

1. The distinct fingerprints are cut into n blocks of bits. Two of them that differ in at most d bits agree in
   n-d whole blocks at least, so they meet in the bucket of one of the C(n, d) block choices. n grows with the
   number of fingerprints, which keeps the expected bucket small; every n is exact.
2. In a bucket, the distances of each member to the reference fingerprints ("pivots") form a table. By the
   triangle inequality a pair whose largest coordinate difference exceeds d can't link and is discarded; the
   survivors are verified by their exact distance.
3. Small buckets compare by shifts of the sorted table. Larger ones search outward from one member to another
   and look only at members not reached so far, so a dense group of near copies costs about its size and gives
   one link per member. Buckets beyond `max_bucket` are cut into blocks that meet pairwise in separate tasks.

Cases: null or blank text has fingerprint zero and links like any other; equal texts have equal fingerprints;
repeated rows stay repeated; an empty table gives an empty result; a null id never becomes a component id unless
its component has nothing else. Input columns other than id and text are ignored (or kept, in `dedup`).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, packed, salted_lookup, stored, unpacked

BITS = 64
SEED = 42
SMALL = 48
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def lower_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash: a bit is set if it is set in over half of the shingle hashes."""
    words = lower_words(text)
    n = len(words) - shingle + 1
    if not words:
        return 0
    joined = b" ".join(words)
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[: n - 1]]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 32768):
        to = min(n, at + 32768)
        h = np.array([digest(joined[s : e - 1], SEED) for s, e in zip(starts[at:to], ends[at + shingle - 1 : to + shingle - 1])], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * counts > n).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = 3) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf(T.LongType())
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).astype(np.int64))

    return hashed(text)


def pivots(count: int) -> np.ndarray:
    """Reference fingerprints from a splitmix64 sequence."""
    out, state = [], 0
    for _ in range(count):
        state = (state + 0x9E3779B97F4A7C15) % 2**64
        z = state
        z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB % 2**64
        out.append(z ^ (z >> 31))
    return np.array(out, dtype=np.uint64)


def block_masks(blocks: int, max_bits: int) -> list[int]:
    """The masks of all choices of blocks - max_bits blocks out of `blocks`."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    one = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(blocks)]
    return [sum(one[i] for i in chosen) for chosen in combinations(range(blocks), blocks - max_bits)]


def blocks_for(count: int, max_bits: int, per_bucket: int = 64) -> int:
    """The fewest blocks whose buckets are expected to hold at most `per_bucket` unrelated fingerprints."""
    blocks = max_bits + 1
    while blocks < 12 and count / 2 ** (BITS * (blocks - max_bits) // blocks) > per_bucket:
        blocks += 1
    return blocks


def survivors(table: np.ndarray, a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Which of the pairs (a, b) are within max_bits of each other in every pivot's coordinate."""
    keep = np.arange(len(a))
    for part in np.array_split(table, max(1, table.shape[1] // 4), axis=1):
        x, y = part[a[keep]], part[b[keep]]
        keep = keep[(np.abs(x - y) <= max_bits).all(axis=1)]
    return keep


def links_of(fps: np.ndarray, groups: np.ndarray, max_bits: int, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, within each group (equal adjacent values of `groups`), what its near pairs connect."""
    table = np.bitwise_count(fps[:, None] ^ references[None, :]).astype(np.int8)
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[starts, len(fps)])
    left, right = [], []
    small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    if small.any():
        at = np.flatnonzero(small)
        f, g, t = fps[at], groups[at], table[at]
        for k in range(1, int(sizes[sizes <= SMALL].max())):
            a = np.flatnonzero(g[k:] == g[:-k])
            if not len(a):
                break
            b = a + k
            keep = survivors(t, a, b, max_bits)
            keep = keep[np.bitwise_count(f[a[keep]] ^ f[b[keep]]) <= max_bits]
            left.append(f[a[keep]])
            right.append(f[b[keep]])
    for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        f, t = fps[s : s + n], table[s : s + n]
        rest = np.arange(n)
        while len(rest):
            root, queue, rest = rest[0], [rest[0]], rest[1:]
            while queue and len(rest):
                x = queue.pop()
                near = survivors(t, np.full(len(rest), x), rest, max_bits)
                near = near[np.bitwise_count(f[rest[near]] ^ f[x]) <= max_bits]
                if len(near):
                    found = rest[near]
                    left.append(np.full(len(found), f[root]))
                    right.append(f[found])
                    queue.extend(found.tolist())
                    rest = np.delete(rest, near)
    if not left:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def near_links(fps: DataFrame, max_bits: int = 3, pivot_count: int = 32, max_bucket: int = 4096, blocks: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) with the same components as all pairs within max_bits."""
    masks = block_masks(blocks or blocks_for(fps.count(), max_bits), max_bits)
    signed = [m - 2**64 if m >= 2**63 else m for m in masks]
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(signed)])).alias("_b")).select("fp", "_b.t", "_b.k")
    counts = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    cuts = F.ceil(F.col("n") / max_bucket).cast("int")
    mine = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("c"))
    parts = (
        keyed.join(counts.select("t", "k", cuts.alias("c")), ["t", "k"])
        .withColumn("x", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
        .select("fp", F.xxhash64("t", "k", F.least(mine, "x"), F.greatest(mine, "x")).alias("g"), "t", "k", F.least(mine, "x").alias("i"), F.greatest(mine, "x").alias("j"))
    )
    references = pivots(pivot_count)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail: pd.DataFrame | None = None

        def out(pdf: pd.DataFrame) -> pd.DataFrame:
            ids = pdf[["t", "k", "i", "j"]].to_numpy()
            changed = np.r_[False, (ids[1:] != ids[:-1]).any(axis=1)]
            a, b = links_of(pdf["fp"].to_numpy().astype(np.uint64), np.cumsum(changed), max_bits, references)
            return pd.DataFrame({"a": a.astype(np.int64), "b": b.astype(np.int64)})

        for pdf in batches:
            if not len(pdf):
                continue
            tail = pdf if tail is None else pd.concat([tail, pdf], ignore_index=True)
            last = (tail[["t", "k", "i", "j"]] == tail[["t", "k", "i", "j"]].iloc[-1]).all(axis=1).to_numpy()
            cut = int(np.argmax(last))
            if cut:
                yield out(tail.iloc[:cut])
                tail = tail.iloc[cut:]
        if tail is not None:
            yield out(tail)

    dealt = parts.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j", "fp").select("fp", "t", "k", "i", "j")
    return dealt.mapInPandas(search, "a long, b long").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from each node of links (a, b), by alternating star contraction. The
    centre of a star can have a third of all links, so joins on it are salted by the other end."""
    pairs = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    sign = None
    for _ in range(max_rounds):
        now = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first()
        if now == sign:
            break
        sign = now
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = salted_lookup(both.where("v > u"), least, "u", F.col("v"), how="inner").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "large-stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_lookup(large, low, "u", F.col("v"), how="inner").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(hashed: DataFrame, max_bits: int = 3, **search: int) -> DataFrame:
    """(fp, root, component_id, kept) for each distinct fp of hashed (_id, fp): component_id is the smallest id reached,
    kept marks the one fp of a component (the smallest of several) that has it."""
    fps = stored(hashed.groupBy("fp").agg(F.min("_id").alias("first_id")), "fingerprints")
    return classes_of(fps, near_links(fps, max_bits, **search))


def classes_of(fps: DataFrame, links: DataFrame) -> DataFrame:
    """The classes of fps (fp, first_id) that links (a, b) connect."""
    roots = components(links)
    rooted = fps.join(roots, fps.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "fp")).alias("b"))
    found = salted_lookup(rooted.drop("first_id"), best, "root", F.col("fp"))
    return stored(found.select("fp", "root", F.col("b.first_id").alias("component_id"), (F.col("fp") == F.col("b.fp")).alias("kept")), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3) -> DataFrame:
    """One row per document: its id, fingerprint (16 hex digits) and component_id."""
    hashed = stored(docs.select(col(id_col).alias("_id"), fingerprint_column(col(text_col)).alias("fp")), "hashed")
    found = salted_lookup(hashed, classes(hashed, max_bits), "fp", F.col("_id"))
    return found.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3, by_shingles: bool = False) -> DataFrame:
    """docs with one row of each class, that of its smallest id; all columns are kept. With by_shingles, fingerprints are
    of five-word shingles, link at a wide radius and are verified by an exact similarity of 0.8 (shingles.py)."""
    if by_shingles:
        from . import shingles

        return shingles.dedup(docs, id_col, text_col)
    hashed = stored(packed(docs, _id=col(id_col), fp=fingerprint_column(col(text_col))), "hashed")
    return kept_rows(hashed, classes(hashed.select("_id", "fp"), max_bits), docs.columns)


def kept_rows(keyed: DataFrame, classed: DataFrame, columns: list[str], key: str = "fp") -> DataFrame:
    """The rows of keyed (_row, _id, and the key) that their classes keep."""
    kept = classed.where("kept").select(F.struct(F.col("component_id").alias("_id"), key).alias("_key"))
    # one shuffle of the rows: join and removal of repeats use the same key, of which no value is frequent but for repeats
    return keyed.withColumn("_key", F.struct("_id", key)).join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select(*unpacked(columns))


def coordinates_fit(a: Column, b: Column, max_bits: int, references: np.ndarray) -> Column:
    """Whether two fingerprints (signed longs) are within max_bits in every pivot's coordinate, and then in truth."""
    test = F.lit(True)
    for p in references.astype(np.int64).tolist():
        x, y = (F.bit_count(c.bitwiseXOR(F.lit(p))) for c in (a, b))
        test = test & (F.abs(x - y) <= max_bits)
    return test & (F.bit_count(a.bitwiseXOR(b)) <= max_bits)

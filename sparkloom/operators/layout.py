"""Boxes and tree layouts as rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACED = "tree long, id string, side string, depth int, x double, y double, width double, height double"


class _Tree:
    """Nodes in order with their children; the first parent wins, nodes off the root's tree hang under the root."""

    def __init__(self, ids: list[str], parents: list[str | None]):
        self.root = next(i for i, p in zip(ids, parents) if p is None)
        known = set(ids)
        up = {i: (p if p in known else self.root) for i, p in zip(ids, parents) if i != self.root}
        for i in up:  # a cycle is cut where it is entered first
            seen, j = set(), i
            while j != self.root and j not in seen:
                seen.add(j)
                j = up[j]
            if j != self.root:
                up[i] = self.root
        self.below: dict[str, list[str]] = {i: [] for i in ids}
        for i in ids:
            if i != self.root:
                self.below[up[i]].append(i)
        self.order, self.level = [self.root], {self.root: 0}
        for i in self.order:  # grows while it is read
            for c in self.below[i]:
                self.level[c] = self.level[i] + 1
                self.order.append(c)


def layout(nodes: DataFrame, right_share: float = 0.62, v_gap: float = 32, h_gap: float = 72) -> DataFrame:
    """Centre and side of every node of trees (tree, id, parent, pos, width, height): a subtree takes the height of its
    children or its own box; the root's children go right until their share of the height is used, then left; a
    column is as far out as the widest boxes before it demand. A tree is one group."""

    def of_tree(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        w, h = dict(zip(pdf["id"], pdf["width"])), dict(zip(pdf["id"], pdf["height"]))
        t = _Tree(pdf["id"].tolist(), [None if pd.isna(p) else p for p in pdf["parent"]])
        room: dict[str, float] = {}
        for i in reversed(t.order):
            inner = [room[c] for c in t.below[i]]
            room[i] = max(h[i], sum(inner) + v_gap * max(0, len(inner) - 1))
        widest = pd.Series(w).groupby(pd.Series(t.level)).max()
        column = [0.0]
        for d in range(1, len(widest)):
            column.append(column[-1] + (widest[d - 1] + widest[d]) / 2 + h_gap)
        top = t.below[t.root]
        limit = right_share * (sum(room[c] for c in top) + v_gap * max(0, len(top) - 1))
        ends = pd.Series([room[c] for c in top], dtype=float).cumsum() + v_gap * pd.Series(range(len(top)), dtype=float)
        n_right = max(1, int((ends <= limit).cummin().sum())) if top else 0
        place = {t.root: ("root", 0.0)}

        def stack(parts: list[str], centre: float, side: str) -> None:
            at = centre - (sum(room[c] for c in parts) + v_gap * max(0, len(parts) - 1)) / 2
            for c in parts:
                place[c] = (side, at + room[c] / 2)
                at += room[c] + v_gap

        stack(top[:n_right], 0.0, "right")
        stack(top[n_right:], 0.0, "left")
        for i in t.order[1:]:
            stack(t.below[i], place[i][1], place[i][0])
        sign = {"root": 0, "right": 1, "left": -1}
        rows = [(pdf["tree"].iloc[0], i, place[i][0], t.level[i], sign[place[i][0]] * column[t.level[i]], place[i][1], float(w[i]), float(h[i])) for i in t.order]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in PLACED.split(", ")])

    return nodes.select("tree", "id", "parent", "pos", "width", "height").groupBy("tree").applyInPandas(of_tree, PLACED)


def violations(placed: DataFrame, gap: float = 24, cell: float = 512) -> DataFrame:
    """Pairs of boxes of a tree that are nearer than `gap` on both axes. Boxes meet by the grid cells that they, widened
    by the gap, touch; a pair counts in the cell that holds the upper left corner of what they share."""
    half_w, half_h = F.col("width") / 2 + gap / 2, F.col("height") / 2 + gap / 2
    b = placed.select("tree", "id", (F.col("x") - half_w).alias("l"), (F.col("x") + half_w).alias("r"), (F.col("y") - half_h).alias("t"), (F.col("y") + half_h).alias("b"))

    def cells(lo: str, hi: str) -> Column:
        return F.sequence(F.floor(F.col(lo) / cell).cast("int"), F.floor(F.col(hi) / cell).cast("int"))

    g = b.withColumn("cx", F.explode(cells("l", "r"))).withColumn("cy", F.explode(cells("t", "b")))
    o = g.select("tree", "cx", "cy", *[F.col(c).alias(f"{c}2") for c in ("id", "l", "r", "t", "b")])
    j = g.join(o, ["tree", "cx", "cy"]).where((F.col("id") < F.col("id2")) & (F.col("l") < F.col("r2")) & (F.col("l2") < F.col("r")) & (F.col("t") < F.col("b2")) & (F.col("t2") < F.col("b")))
    own = (F.floor(F.greatest("l", "l2") / cell) == F.col("cx")) & (F.floor(F.greatest("t", "t2") / cell) == F.col("cy"))
    return j.where(own).select("tree", F.col("id").alias("a"), F.col("id2").alias("b"))


def canvas(placed: DataFrame, margin: float = 72, title: float = 84) -> DataFrame:
    """Size of the canvas that holds each tree."""
    g = placed.groupBy("tree").agg((F.max(F.col("x") + F.col("width") / 2) - F.min(F.col("x") - F.col("width") / 2)).alias("w"), (F.max(F.col("y") + F.col("height") / 2) - F.min(F.col("y") - F.col("height") / 2)).alias("h"), F.count("*").alias("nodes"))
    return g.select("tree", "nodes", F.greatest(F.lit(1200), F.ceil(F.col("w") + 2 * margin)).cast("long").alias("width"), F.greatest(F.lit(720), F.ceil(F.col("h") + 2 * margin + title)).cast("long").alias("height"))


def raster_scale(width: Column, height: Column, pixels: int = 16_000_000, side: int = 8192) -> Column:
    """The largest scale, 1 at most, within a number of pixels and a side."""
    return F.least(F.lit(1.0), side / width, side / height, F.sqrt(pixels / (width * height)))


def stack_centres(df: DataFrame, by: str, order: str, extent: str, gap: float) -> DataFrame:
    """Centres of boxes stacked with a gap around 0."""
    w = Window.partitionBy(by)
    before = F.coalesce(F.sum(F.col(extent) + gap).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum(extent).over(w) + gap * (F.count("*").over(w) - 1)
    return df.withColumn("centre", F.round(before - total / 2 + F.col(extent) / 2, 6))


def split_prefix(df: DataFrame, by: str, order: str, extent: str, share: float, gap: float) -> DataFrame:
    """The prefix that fits a share of the height goes right, with the first that doesn't all others left."""
    w = Window.partitionBy(by)
    run = w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(extent).over(run) + gap * (F.count("*").over(run) - 1)
    limit = share * (F.sum(extent).over(w) + gap * (F.count("*").over(w) - 1))
    over = (used > limit) & (F.row_number().over(w.orderBy(order)) > 1)
    return df.withColumn("_over", over.cast("int")).withColumn("side", F.when(F.max("_over").over(run) == 1, "left").otherwise("right")).drop("_over")


def union_box(df: DataFrame, by: list[str]) -> DataFrame:
    """The box around boxes left, top, right, bottom."""
    return df.groupBy(*by).agg(F.round(F.min("left"), 6).alias("left"), F.round(F.min("top"), 6).alias("top"), F.round(F.max("right"), 6).alias("right"), F.round(F.max("bottom"), 6).alias("bottom"), F.count("*").alias("boxes"))


def continues(left: str, right: str, top: str, bottom: str, w) -> Column:
    """Whether a box continues the one before it: they overlap by a tenth of the narrower and nearly touch."""
    shared = F.least(F.col(right), F.lag(right).over(w)) - F.greatest(F.col(left), F.lag(left).over(w))
    narrow = F.least(F.col(right) - F.col(left), F.lag(right).over(w) - F.lag(left).over(w))
    gap = F.col(top) - F.lag(bottom).over(w)
    return F.coalesce((shared >= 0.1 * narrow) & gap.between(-0.03, 0.12), F.lit(False))


def merge_continuations(blocks: DataFrame, by: list[str], order: str) -> DataFrame:
    """Blocks (left, top, right, bottom) folded into the block they continue."""
    w = Window.partitionBy(*by).orderBy(order)
    run = F.sum(F.when(continues("left", "right", "top", "bottom", w), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return union_box(blocks.withColumn("run", run), [*by, "run"])


def merge_labels(blocks: DataFrame, by: list[str], order: str, is_label: Column, text: str) -> DataFrame:
    """A label block is absorbed by the block that follows it."""
    w = Window.partitionBy(*by).orderBy(order)
    before = F.lag(F.when(is_label, F.col(text))).over(w)
    last = F.lead(order).over(w).isNull()
    rows = blocks.withColumns({"_label": before, "_drop": is_label & ~last})
    return rows.where("not _drop").withColumn(text, F.concat_ws(" ", "_label", text)).drop("_label", "_drop")


def clipped_box(left: Column, top: Column, width: Column, height: Column, page_w: float, page_h: float) -> Column:
    """A box x, y, width, height as shares of its page, within 0..1."""

    def span(low: Column, size: Column, whole: float) -> tuple[Column, Column]:
        start = F.least(F.greatest(low / whole, F.lit(0.0)), F.lit(1.0))
        return start, F.least(F.greatest((low + size) / whole, start), F.lit(1.0)) - start

    (x, w), (y, h) = span(left, width, page_w), span(top, height, page_h)
    return F.array(*[F.round(v, 6) for v in (x, y, w, h)])


def fractions(lines: DataFrame, tokens: DataFrame, near: float = 12, beside: float = 3) -> DataFrame:
    """Numerator and denominator of each rule line (page, line, left, right, y) of 20..220 width: tokens (page, left,
    right, top, bottom, text) above and below it. Both meet by page and by the bands of y they reach."""
    band = 4 * near
    ln = lines.where((F.col("right") - F.col("left")).between(20, 220)).select("page", "line", F.col("left").alias("ll"), F.col("right").alias("lr"), "y", F.explode(F.array_distinct(F.array(F.floor((F.col("y") - near) / band), F.floor((F.col("y") + near) / band)))).alias("band"))
    tk = tokens.select("page", "left", "right", "text", F.col("top"), F.col("bottom"), F.explode(F.array_distinct(F.array(F.floor(F.col("top") / band), F.floor(F.col("bottom") / band)))).alias("band"))
    j = ln.join(tk, ["page", "band"]).where((F.col("left") >= F.col("ll") - beside) & (F.col("right") <= F.col("lr") + beside)).drop("band").distinct()
    up = (F.col("bottom") <= F.col("y") + 1) & (F.col("y") - F.col("bottom") <= near)
    down = (F.col("top") >= F.col("y") - 1) & (F.col("top") - F.col("y") <= near)

    def joined(test: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("left", "text")))), lambda x: x["text"]), "")

    return j.groupBy("page", "line").agg(joined(up).alias("numerator"), joined(down).alias("denominator")).where("numerator <> '' and denominator <> ''")


def pixels(width: float, height: float, scale: float) -> int:
    return math.ceil(width * scale) * math.ceil(height * scale)


def scripts(tokens: DataFrame, bases: DataFrame, far: float = 4.0) -> DataFrame:
    """The nearest token that stands as a script beside each base (page, id, left, right, top, bottom): to its right
    within `far`, its middle above or below the base's middle half. super or sub."""
    t = tokens.select("page", F.col("text"), F.col("left").alias("tl"), ((F.col("top") + F.col("bottom")) / 2).alias("tm"), F.explode(F.array(F.floor(F.col("left") / far), F.floor(F.col("left") / far) - 1)).alias("cell"))
    b = bases.withColumn("cell", F.floor(F.col("right") / far))
    quarter = (F.col("bottom") - F.col("top")) / 4
    kind = F.when(F.col("tm") < F.col("top") + quarter, "super").when(F.col("tm") > F.col("bottom") - quarter, "sub")
    j = b.join(t, ["page", "cell"]).withColumn("d", F.col("tl") - F.col("right")).withColumn("kind", kind).where((F.col("d") >= 0) & (F.col("d") <= far) & F.col("kind").isNotNull())
    return j.groupBy("page", "id", "kind").agg(F.min_by("text", F.struct("d", "text")).alias("script"))

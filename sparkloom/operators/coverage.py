"""Coverage, sampling and partitioning of units."""

from __future__ import annotations

from heapq import heappop, heappush
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.folds import fold
from ..plans.storage import numbered, stored


def coverage(units: DataFrame, covered: DataFrame, by: list[str]) -> DataFrame:
    """Per group of units (id, importance): how many are covered (ids), and the covered share of the importance; 1 if
    there is none."""
    c = units.join(covered.select("id").distinct().withColumn("hit", F.lit(1)), "id", "left")
    g = c.groupBy(*by) if by else c.groupBy()
    total, hit = F.sum("importance"), F.sum(F.when(F.col("hit") == 1, F.col("importance")).otherwise(0.0))
    return g.agg(F.count("*").alias("units"), F.count("hit").alias("covered"), F.round(F.when(F.coalesce(total, F.lit(0.0)) > 0, hit / total).otherwise(1.0), 4).alias("weighted"))


def audit(units: DataFrame, covered: DataFrame, least: float = 0.7) -> DataFrame:
    """units (id, status, importance) with the status they move to: covered, else deferred if they matter little."""
    c = units.join(covered.select("id").distinct().withColumn("hit", F.lit(1)), "id", "left")
    state = F.when(F.col("status") == "rejected", "rejected").when(F.col("hit") == 1, "covered").when(F.col("importance") < least, "deferred").otherwise("uncovered")
    return c.select("id", F.col("status").alias("was"), state.alias("status"))


def evidence_matches(evidence: DataFrame, units: DataFrame, fields: list[str]) -> DataFrame:
    """Evidence (id, unit_id, excerpt) whose unit exists and holds the excerpt in one of its fields, spaces and case aside."""

    def flat(c: Column) -> Column:
        return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))

    j = evidence.join(units, "unit_id")
    test = F.lit(False)
    for f in fields:
        test = test | F.contains(flat(F.col(f)), flat(F.col("excerpt")))
    return j.where(test & (flat(F.col("excerpt")) != "")).select(*evidence.columns)


def spread_order(n: int, most: int | None = None) -> list[int]:
    """The first `most` of 0..n-1 in farthest-point order: the start, the end, then the middle of the widest gap, the
    leftmost of equal ones."""
    most = n if most is None else min(n, most)
    order, gaps = [0, n - 1][: min(n, most)], [(1 - n, 0)]
    while len(order) < most:
        wide, a = heappop(gaps)
        b = a - wide
        m = (a + b) // 2
        order.append(m)
        for c, e in ((a, m), (m, b)):
            if e - c > 1:
                heappush(gaps, (c - e, c))
    return order


def stratified(units: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """k units, round-robin over groups (in order of their first unit), each in farthest-point order: rank. No group
    gives more than k, so what is chosen of each has a bound whatever its size."""

    @F.pandas_udf("array<int>")
    def places(sizes: pd.Series) -> pd.Series:
        return pd.Series([spread_order(int(n), k) for n in sizes], dtype=object)

    groups = units.groupBy(group).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    turns = groups.select(F.col(group).alias("_g"), "_first", F.posexplode(places("_n")).alias("_turn", "_i"))
    rows = units.withColumn("_at", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1)
    met = rows.join(turns, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_at") == F.col("_i")))
    first = met.orderBy("_turn", "_first", group).limit(k)
    return first.withColumn("rank", F.row_number().over(Window.orderBy("_turn", "_first", group))).drop("_at", "_g", "_i", "_first", "_turn")


def even_positions(n: Column, k: int) -> Column:
    """k distinct, evenly spaced numbers of 1..n; halves go to the even one."""
    if k == 1:
        return F.array(F.lit(1))
    at = F.transform(F.sequence(F.lit(0), F.least(n, F.lit(k)) - 1), lambda i: F.bround(i * (n - 1) / F.greatest(F.least(n, F.lit(k)) - 1, F.lit(1)), 0).cast("int") + 1)
    return F.array_distinct(at)


PARTS = "branch string, id long, part int"


def balanced_parts(units: DataFrame, most: int, weight_cap: float) -> DataFrame:
    """Contiguous parts of each branch's units (branch, id, seq, page, weight): units of a page stay together, no part
    has over `most` units or weight_cap weight unless a page alone does, and the sum of squared weights is least.
    A dynamic programme per branch."""

    def of_branch(rows: list[dict]) -> list[tuple]:
        atoms = [list(g) for _, g in groupby(rows, key=lambda r: r["page"])]
        size, load = [len(a) for a in atoms], [sum(r["weight"] for r in a) for a in atoms]
        best: list[tuple[float, int]] = [(0.0, 0)]
        for j in range(1, len(atoms) + 1):
            options = []
            n, w = 0, 0.0
            for i in range(j - 1, -1, -1):
                n, w = n + size[i], w + load[i]
                if i < j - 1 and (n > most or w > weight_cap):
                    break
                options.append((best[i][0] + w * w, i))
            best.append(min(options))
        ends, j = set(), len(atoms)
        while j:
            ends.add(j)
            j = best[j][1]
        out, part = [], 0
        for n, a in enumerate(atoms):
            part += n in ends
            out += [(r["branch"], r["id"], part) for r in a]
        return out

    return fold(units.select("branch", "id", "seq", "page", "weight"), ["branch"], ["seq", "id"], of_branch, PARTS)


def claims(topics: DataFrame, support: DataFrame, most: int = 8) -> DataFrame:
    """Each unit of support (topic, unit) goes to one topic (topic, confidence, n_support): the surest, then the best
    supported, then the first; of the topics only the first `most` take part."""
    order = [F.desc("confidence"), F.desc("n_support"), F.col("topic")]
    # cut before it is numbered, so that the one task of the window sees `most` rows
    top = topics.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    j = support.join(F.broadcast(top), "topic")
    return j.groupBy("unit").agg(F.min_by("topic", "place").alias("topic"))


def nearest(pending: DataFrame, placed: DataFrame, by: str, at: str) -> DataFrame:
    """For each pending row (id, by, at) the placed one (plan) nearest by position in its group, the earlier of equals.
    One sort per group: the last placed row before and the first one after, no join of all with all."""
    u = placed.select(by, at, "plan", F.lit(None).cast("long").alias("id")).unionByName(pending.select(by, at, F.lit(None).cast(placed.schema["plan"].dataType).alias("plan"), F.col("id").cast("long")))
    mark = F.when(F.col("plan").isNotNull(), F.struct(F.col(at).alias("at"), F.col("plan").alias("plan")))
    w = Window.partitionBy(by).orderBy(at, F.col("plan").isNull(), "plan")
    back = F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(mark, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    r = u.withColumns({"b": back, "a": ahead}).where("id is not null")
    use_back = F.col("b").isNotNull() & (F.col("a").isNull() | (F.col(at) - F.col("b.at") <= F.col("a.at") - F.col(at)))
    return r.select("id", by, F.col(at).alias("at"), F.when(use_back, F.col("b.plan")).otherwise(F.col("a.plan")).alias("plan"), F.when(use_back, F.col(at) - F.col("b.at")).otherwise(F.col("a.at") - F.col(at)).alias("distance"))


PICKED = "branch string, id long, how string"


def set_cover(candidates: DataFrame, budget: int) -> DataFrame:
    """Per branch: candidates (branch, id, rank, units array) picked in order of rank while they cover something new,
    then by rank up to the budget. A fold per branch."""

    def of_branch(rows: list[dict]) -> list[tuple]:
        seen, out, taken = set(), [], set()
        for r in rows:
            if len(out) < budget and not set(r["units"]) <= seen:
                seen |= set(r["units"])
                taken.add(r["id"])
                out.append((r["branch"], r["id"], "cover"))
        for r in rows:
            if len(out) < budget and r["id"] not in taken:
                out.append((r["branch"], r["id"], "fill"))
        return out

    return fold(candidates.select("branch", "id", "rank", "units"), ["branch"], ["rank", "id"], of_branch, PICKED)


def planning_units(units: DataFrame, by: list[str], order: str, text: str, longest: int = 400) -> DataFrame:
    """One unit per group: highest importance, number, distinct texts in order, cut to length."""
    g = units.groupBy(*by, text).agg(F.min(order).alias("o"), F.max("importance").alias("i"), F.count("*").alias("n"))
    return g.groupBy(*by).agg(F.max("i").alias("importance"), F.sum("n").alias("units"), F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", F.col(text).alias("t")))), lambda x: x["t"]), "\n"), 1, longest).alias("text"))


def theme_plan(units: DataFrame, heading: str, most: int = 8, rest: str = "other") -> DataFrame:
    """Groups by heading; beyond `most`, the largest most - 1 and a rest."""
    g = stored(units.groupBy(F.coalesce(heading, F.lit("")).alias("h")).agg(F.count("*").alias("n")), "headings")
    if g.count() <= most:
        return g.select(F.col("h").alias("theme"), F.col("n").alias("units"), F.lit(1).cast("bigint").alias("headings"))
    own = g.orderBy(F.desc("n"), "h").limit(most - 1).select("h", F.col("h").alias("own"))
    named = g.join(F.broadcast(own), "h", "left")
    return named.groupBy(F.coalesce("own", F.lit(rest)).alias("theme")).agg(F.sum("n").alias("units"), F.count("*").alias("headings"))


def grouped_support(candidates: DataFrame, least: int) -> DataFrame:
    """Candidates (branch, key, unit) by key with `least` distinct units or more."""
    return candidates.groupBy("branch", "key").agg(F.count_distinct("unit").alias("units")).where(F.col("units") >= least)


def partition_faults(parts: DataFrame, units: DataFrame) -> DataFrame:
    """Units that the parts (id) hold not once: id, times."""
    n = parts.groupBy("id").agg(F.count("*").alias("times"))
    return units.select("id").join(n, "id", "full_outer").select("id", F.coalesce("times", F.lit(0)).alias("times")).where("times <> 1")


def supported(candidates: DataFrame, units: str, branch_units: str, least: int = 1, abstract_least: int = 2) -> DataFrame:
    """Candidates (arrays of units, abstract flag) with enough support inside their branch."""
    n = F.size(F.array_intersect(units, branch_units))
    return candidates.withColumn("n_support", n).where(n >= F.when(F.col("abstract"), abstract_least).otherwise(least))


def verified(nodes: DataFrame, valid: str) -> DataFrame:
    """nodes (origin, evidence, support, optional) that a branch may keep: stated ones with evidence in its valid units,
    optional abstract and structural ones with two of them as support; all others stay."""
    stated = (F.col("origin") == "explicit") & ~F.arrays_overlap("evidence", valid)
    weak = F.col("origin").isin("abstractive", "structural") & F.col("optional") & (F.size(F.array_intersect("support", valid)) < 2)
    return nodes.where(~(stated | weak))


def signal_pages(blocks: DataFrame, page: str, text: str, least: int = 12) -> DataFrame:
    """Pages with a block of enough letters and digits."""
    return blocks.where(F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")) >= least).select(page).distinct()


def coordinate(page: Column, slide: Column) -> Column:
    return F.coalesce(page, slide)


def source_place(page: Column, slide: Column) -> Column:
    """struct that sorts places: pages before slides, what has no place last."""
    kind = F.when(page.isNotNull(), 0).when(slide.isNotNull(), 1).otherwise(2)
    return F.struct(kind.alias("kind"), F.coalesce(page, slide).alias("at"))


def in_source_order(units: DataFrame, by: str) -> DataFrame:
    """units (kind, page, slide, idx, id) numbered by place: pages before slides, those without a place last, text
    before pictures, then the order they came in."""
    w = Window.partitionBy(by).orderBy(source_place(F.col("page"), F.col("slide")), F.col("kind") != "text", "idx", "id")
    return units.withColumn("place", F.row_number().over(w))


def plan_places(members: DataFrame) -> DataFrame:
    """Plans by the first place of their units (plan, n, page, slide): pages before slides, plans without a place last;
    among equals by the plan's number n, then its id."""
    p = members.groupBy("plan").agg(F.min("n").alias("n"), F.min(source_place(F.col("page"), F.col("slide"))).alias("at"))
    return numbered(p, [F.col("at"), F.col("n"), F.col("plan")], "place")


def owners(seeds: DataFrame) -> DataFrame:
    """Each seeded node (node, unit, place) goes to its earliest unit; and how many each unit owns."""
    o = seeds.groupBy("node").agg(F.min_by("unit", "place").alias("unit"))
    return o.join(o.groupBy("unit").agg(F.count("*").alias("owned")), "unit")


def planning_weight(owned: Column) -> Column:
    """Nodes that a unit stands for: those it owns, two if none."""
    return F.greatest(F.coalesce(owned, F.lit(2)), F.lit(1))


GROUPED = "branch string, plan long, part int"


def consolidated(plans: DataFrame, cap: int, most: int = 8) -> DataFrame:
    """Contiguous groups of each branch's plans (branch, plan, seq, leaves): of the groupings in which no group has over
    `cap` leaves, the one with fewest groups, then the most even. At most `most` plans are tried in every way; larger
    branches are cut greedily."""

    def of_branch(rows: list[dict]) -> list[tuple]:
        n = len(rows)
        best: tuple | None = None
        if n <= most:
            for mask in range(1 << max(0, n - 1)):
                parts, part = [], 0
                for i in range(n):
                    part += i > 0 and mask >> (i - 1) & 1
                    parts.append(part)
                sums = [sum(r["leaves"] for r, p in zip(rows, parts) if p == g) for g in range(part + 1)]
                if max(sums) <= cap or part == n - 1:
                    score = (max(sums) > cap, part, sum(s * s for s in sums), mask)
                    best = min(best, (score, parts)) if best else (score, parts)
            parts = best[1]
        else:
            parts, part, total = [], 0, 0
            for r in rows:
                if total and total + r["leaves"] > cap:
                    part, total = part + 1, 0
                total += r["leaves"]
                parts.append(part)
        return [(r["branch"], r["plan"], p) for r, p in zip(rows, parts)]

    return fold(plans.select("branch", "plan", "seq", "leaves"), ["branch"], ["seq", "plan"], of_branch, GROUPED)

"""Relational helpers over sessions, workspaces and request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def root_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"/+$", ""))


def merge_workspaces(registered: DataFrame, sessions: DataFrame, hidden: DataFrame) -> DataFrame:
    """Registered workspaces (id, root, session_count, pos) and those that only sessions (workspace_id, root) show, one
    per root key, without hidden ones; the count is the higher of the registered and the seen one. Registered ones
    come first in their order, then the others by root."""
    first = Window.partitionBy("key").orderBy("pos")
    reg = registered.withColumn("key", root_key(F.col("root"))).withColumn("r", F.row_number().over(first)).where("r = 1").select("key", "id", "root", "session_count", "pos")
    seen = sessions.where("root is not null and root <> ''").withColumn("key", root_key(F.col("root")))
    per = seen.groupBy("key").agg(F.count("*").alias("seen"), F.min("root").alias("root"), F.min("workspace_id").alias("id"))
    derived = per.join(reg, "key", "left_anti").select("key", "id", "root", F.lit(0).cast("long").alias("session_count"), F.lit(None).cast("int").alias("pos"))
    out = reg.unionByName(derived).join(hidden.select(root_key(F.col("root")).alias("key")), "key", "left_anti").join(per.select("key", "seen"), "key", "left")
    return out.select("id", "root", F.greatest("session_count", F.coalesce("seen", F.lit(0))).alias("sessions"), F.col("pos").isNull().alias("derived"), "pos").orderBy(F.col("pos").asc_nulls_last(), "root").drop("pos")


def reconciled_order(saved: Column, present: Column) -> Column:
    """New ids first, then the saved ones that are still there; null if that changes nothing."""
    now = F.concat(F.array_except(present, saved), F.array_intersect(saved, present))
    return F.when(now != saved, now)


def moved(items: Column, source: Column, target: Column) -> Column:
    """An array with the element at source (from 0) put at target."""
    rest = F.concat(F.slice(items, F.lit(1), source), F.slice(items, source + 2, F.size(items)))
    return F.concat(F.slice(rest, F.lit(1), target), F.slice(items, source + 1, F.lit(1)), F.slice(rest, target + 1, F.size(items)))


def by_recency(df: DataFrame, at: str, key: str) -> DataFrame:
    return df.orderBy(F.col(at).desc_nulls_last(), key)


def by_saved_order(df: DataFrame, ranks: DataFrame, key: str) -> DataFrame:
    """Rows by an outer rank, those without one first."""
    return df.join(ranks, key, "left").orderBy(F.col("rank").asc_nulls_first(), key)


def swarm_groups(members: DataFrame, parent: str, phase: str, phases: list[str], least: int = 2) -> DataFrame:
    """Members per parent and phase, for parents with `least` or more."""
    g = members.groupBy(parent).agg(F.count("*").alias("total"), *[F.count_if(F.col(phase) == p).alias(f"n_{p}") for p in phases])
    return g.where(F.col("total") >= least)


def pivot_counts(df: DataFrame, by: str, kind: str, kinds: list[str]) -> DataFrame:
    return df.groupBy(by).pivot(kind, kinds).count().na.fill(0)


def search(df: DataFrame, fields: list[str], query: str, most: int, order: list[Column]) -> DataFrame:
    """Rows that hold the query in any field, `most` at most."""
    test = F.lit(False)
    for f in fields:
        test = test | F.contains(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lit(query.lower()))
    return df.where(test).orderBy(*order).limit(most)


def with_parent_name(df: DataFrame, key: str, parent: str, name: str) -> DataFrame:
    return df.join(df.select(F.col(key).alias(parent), F.col(name).alias("parent_name")), parent, "left")


def socket_totals(log: DataFrame, by: list[str], seq: str) -> DataFrame:
    """Messages per group and the last sequence number, the most frequent first."""
    return log.groupBy(*by).agg(F.count("*").alias("n"), F.max(seq).alias("last_seq")).orderBy(F.desc("n"), *by)


def whole_mean(c: str) -> Column:
    """The mean of a column as a whole number, halves away from 0. Sums of doubles depend on the order of rows, by which a
    mean of just a half goes either way; so values of nine decimals at most are summed and divided exactly."""
    d = F.col(c).try_cast("decimal(24,9)")
    total, n = F.sum(d), F.count(c)
    size, by = F.abs(total), n.cast("decimal(20,0)")
    whole = F.call_function("div", size, by) + F.when(size % by * 2 >= by, 1).otherwise(0)
    exact = F.count_if(d.cast("double") == F.col(c)) == n
    return F.when(n == 0, F.lit(None)).when(exact, F.when(total < 0, -whole).otherwise(whole)).otherwise(F.round(F.avg(c)).cast("long"))


def request_totals(log: DataFrame, by: list[str], failed: Column, duration: str, order: list[str] | None = None) -> DataFrame:
    """Requests per group, failures, mean of the known durations. With `order`, distinct for each row of a group, durations
    are summed as doubles in that order, which decides a mean of just a half; without, the mean is exact."""
    mean = whole_mean(duration)
    if order:
        until = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        log = log.withColumn("_mean", F.avg(duration).over(until))
        mean = F.round(F.max_by("_mean", F.struct(*order))).cast("long")
    return log.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(failed).alias("errors"), mean.alias("mean"))


def fresh_over_cached(fresh: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    return fresh.withColumn("origin", F.lit("fresh")).unionByName(cached.join(fresh, key, "left_anti").withColumn("origin", F.lit("cached")))


def grouped_in_order(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return df.groupBy(by).agg(F.array_join(F.transform(rows, lambda x: x["_v"].cast("string")), ",").alias("members"))


def uncovered(results: DataFrame, live: DataFrame, block: list[str]) -> DataFrame:
    """Results (id, name) that no live row of their block covers by id or by holding the name."""
    x, y = results.alias("x"), live.alias("y")
    same = F.lit(True)
    for b in block:
        same = same & (F.col(f"x.{b}") == F.col(f"y.{b}"))
    return x.join(y, same & ((F.col("x.id") == F.col("y.id")) | F.contains("y.name", "x.name")), "left_anti")


def distinct_flat(lists: list[Column]) -> Column:
    """The elements of several arrays, distinct, in order."""
    return F.array_distinct(F.flatten(F.array(*lists)))


def planned_calls(reviewers: Column) -> Column:
    """One call, and one per round and one for each of its reviewers (array of arrays)."""
    return 1 + F.aggregate(reviewers, F.lit(0), lambda s, r: s + 1 + F.size(F.filter(r, lambda x: x.isNotNull())))

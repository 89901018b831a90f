"""Reports: percentiles by two rank rules, call summaries, roll-ups, audits."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import stored


def nearest_rank(c: str, p: float) -> Column:
    """sorted[ceil(p * n)], rounded to 3; 0 for nothing."""
    return F.coalesce(F.round(F.expr(f"percentile_disc({p}) within group (order by {c})"), 3), F.lit(0.0))


def index_rank(values: Column, p: float) -> Column:
    """sorted[round((n - 1) * p)] of an array, halves to the even index: another rule than nearest_rank."""
    return F.element_at(F.array_sort(values), F.bround((F.size(values) - 1) * F.lit(p), 0).cast("int") + 1)


def call_summary(calls: DataFrame, by: list[str], status: str, latency: str) -> DataFrame:
    """Per group: calls, failures, p50, p95, maximum and mean latency, and whether all calls succeeded."""
    g = calls.groupBy(*by).agg(
        F.count("*").alias("calls"),
        F.count_if(F.col(status) == "error").alias("errors"),
        nearest_rank(latency, 0.5).alias("p50"),
        nearest_rank(latency, 0.95).alias("p95"),
        F.max(latency).alias("highest"),
        F.round(F.avg(latency), 3).alias("mean"),
        F.bool_and(F.col(status) != "error").alias("all_ok"),
    )
    return g


def usage_totals(calls: DataFrame, by: list[str], usage: str) -> DataFrame:
    """Sum of every numeric key of a JSON object, per group and key; other values are left out."""
    pairs = calls.select(*by, F.explode(F.from_json(usage, "map<string,string>")).alias("key", "v"))
    n = pairs.withColumn("x", F.col("v").try_cast("double")).where("x is not null")
    return n.groupBy(*by, "key").agg(F.round(F.sum("x"), 6).alias("total"), F.count("*").alias("n"))


def required_text(required: DataFrame, observed: DataFrame, on: list[str]) -> DataFrame:
    """Per item of required (on, item, text): whether an observed text of its page holds it, spaces and case aside. The
    join is on the page (on)."""

    def flat(c: str) -> Column:
        return F.lower(F.regexp_replace(c, r"\s+", ""))

    j = required.join(observed.select(*on, F.col("text").alias("seen")), on, "left")
    return j.groupBy(*on, "item").agg(F.coalesce(F.bool_or(F.contains(flat("seen"), flat("text"))), F.lit(False)).alias("present"))


def rate(found: DataFrame, by: list[str]) -> DataFrame:
    """Share of present items per group, 1 if there are none."""
    return found.groupBy(*by).agg(F.round(F.coalesce(F.avg(F.col("present").cast("int")), F.lit(1.0)), 4).alias("rate"), F.count("*").alias("items"))


def sequence_ratio(a: Column, b: Column) -> Column:
    """Likeness of two strings by their matching blocks."""

    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, u or "", v or "", autojunk=False).ratio() for u, v in zip(x, y)])

    return F.pandas_udf(of, "double")(a, b)


def audit_formulas(expected: DataFrame, observed: DataFrame, page: str = "page") -> DataFrame:
    """Per expected formula (page, id, formula) the most similar observed one of its page; containment is exact. Formulas
    repeat within a page and from page to page, so distinct ones meet and each pair of texts is compared once."""
    e = expected.select(page, "formula").distinct()
    j = e.join(observed.select(page, F.col("formula").alias("seen")).distinct(), page, "left").withColumn("seen", F.coalesce("seen", F.lit("")))
    # a null formula counts as an empty one in the ratio and holds in nothing
    text = F.coalesce("formula", F.lit(""))
    # few bytes but long work: dealt by number, or they would be put together in one task
    pairs = j.select(text.alias("_t"), "seen").distinct().repartition(int(expected.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = stored(pairs.withColumn("_r", F.round(sequence_ratio(F.col("_t"), F.col("seen")), 4)), "formula-ratios")
    r = F.when(F.contains("seen", "formula"), 1.0).otherwise(F.col("_r"))
    j = j.withColumn("_t", text).join(pairs, ["_t", "seen"]).withColumn("ratio", r)
    best = j.groupBy(F.col(page).alias("_p"), F.col("formula").alias("_f")).agg(F.max(F.struct("ratio", "seen")).alias("b"))
    found = expected.join(best, F.col(page).eqNullSafe(F.col("_p")) & F.col("formula").eqNullSafe(F.col("_f")))
    return found.groupBy(page, "id").agg(F.max("b").alias("b")).select(page, "id", F.col("b.ratio").alias("ratio"), F.col("b.seen").alias("best"))


def extraction_metrics(rows: DataFrame, by: list[str], key: str, inherited: Column) -> DataFrame:
    """Per group: rows, share of repeated keys, share of inherited rows."""
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.round(1 - F.count_distinct(key) / F.count("*"), 4).alias("duplicate_rate"), F.round(F.avg(inherited.cast("int")), 4).alias("inherited_rate"))


def roll_up(pages: DataFrame, profile: str, ok: Column, done: Column, seconds: str) -> DataFrame:
    """Per profile: sums over pages, and ratios of the sums."""
    g = pages.groupBy(profile).agg(F.count("*").alias("pages"), F.count_if(ok).alias("ok"), F.count_if(done).alias("done"), F.round(F.sum(seconds), 2).alias("seconds"))
    return g.withColumn("success_rate", F.round(F.col("ok") / F.greatest("done", F.lit(1)), 4)).withColumn("completion_rate", F.round(F.col("done") / F.col("pages"), 4))


def page_reports(expected: DataFrame, results: DataFrame, checkpoints: DataFrame, key: str) -> DataFrame:
    """Status of every expected page: its result's, else checkpointed, else missing."""
    j = expected.join(results.select(key, F.col("status").alias("r")), key, "left").join(checkpoints.select(key, F.lit(1).alias("c")).distinct(), key, "left")
    return j.select(key, F.coalesce("r", F.when(F.col("c") == 1, "checkpointed"), F.lit("missing")).alias("status"))


def page_status(failed: Column, degraded: Column) -> Column:
    return F.when(failed, "failed").when(degraded, "degraded").otherwise("accepted")


def verdicts(report: DataFrame, oracle: DataFrame, key: str, value: str) -> DataFrame:
    """Report and oracle by key: missing, extra, equal or different."""
    j = report.select(key, F.col(value).alias("a"), F.lit(1).alias("ra")).join(oracle.select(key, F.col(value).alias("b"), F.lit(1).alias("ob")), key, "full_outer")
    return j.select(key, F.when(F.col("ra").isNull(), "missing").when(F.col("ob").isNull(), "extra").when(F.col("a").eqNullSafe(F.col("b")), "equal").otherwise("different").alias("verdict"))


def degraded_components(stats: DataFrame) -> DataFrame:
    """stats (role, requested, unavailable, fallback, fallback_ok): the distinct codes of each role, in the order of the rules."""
    codes = [((F.col("requested") > 0) & (F.col("unavailable") > 0), "unavailable"), ((F.col("fallback") > 0) & (F.col("fallback_ok") > 0), "partial"), ((F.col("fallback") > 0) & (F.col("fallback_ok") == 0), "failed")]
    return stats.select("role", F.array_join(F.array_distinct(F.array_compact(F.array(*[F.when(c, F.concat_ws("_", "role", F.lit(n))) for c, n in codes]))), ",").alias("codes"))

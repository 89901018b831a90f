"""The task store as tables: merges of update logs, latest versions, history, retention.

An append-only log with a sequence number takes the place of updates in place; every rule for how updates merge is
an aggregation or a window over the log, so replaying the log gives the same state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_non_empty(c: str, seq: str) -> Column:
    """The last value that is neither null nor empty."""
    return F.max(F.when(F.nullif(F.col(c).cast("string"), F.lit("")).isNotNull(), F.struct(F.col(seq).alias("s"), F.col(c).alias("v"))))["v"]


def merge_jobs(log: DataFrame, key: str, seq: str, fields: list[str], progress: str, reset: Column) -> DataFrame:
    """State per key: non-empty values win, progress is the highest since the last reset, within 0..100.

    One aggregation: progress is kept together with the epoch (the sequence number of the last reset before it)."""
    w = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    epoch = F.coalesce(F.max(F.when(reset, F.col(seq))).over(w), F.lit(-1))
    rows = log.withColumn("_epoch", epoch).withColumn("_p", F.greatest(F.lit(0.0), F.least(F.col(progress).cast("double"), F.lit(100.0))))
    return rows.groupBy(key).agg(
        *[last_non_empty(f, seq).alias(f) for f in fields],
        F.max(F.struct("_epoch", "_p"))["_p"].alias(progress),
        F.min_by(fields[0], seq).alias("first"),
        F.count("*").alias("updates"),
    )


def latest(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def as_of(df: DataFrame, by: list[str], at: str, when: Column) -> DataFrame:
    """The last row of each key up to a moment."""
    return latest(df.where(F.col(at) <= when), by, [at])


def next_version(versions: DataFrame, key: str) -> DataFrame:
    return versions.groupBy(key).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def version_conflicts(writes: DataFrame, versions: DataFrame, key: str) -> DataFrame:
    """Writes (key, expected) whose expected version isn't the current one."""
    now = versions.groupBy(key).agg(F.max("version").alias("current"))
    return writes.join(now, key, "left").withColumn("current", F.coalesce("current", F.lit(0))).where("expected <> current")


def history(jobs: DataFrame, versions: DataFrame, most: int = 100) -> DataFrame:
    """The latest jobs with their latest version, together with the latest versions of tasks that have no job row.

    jobs (task_id, status, updated_at), versions (task_id, version, created_at). One plan: no query per job."""
    top = latest(versions, ["task_id"], ["created_at", "version"]).select("task_id", "version", "created_at")
    own = jobs.join(top, "task_id", "left").select("task_id", "status", F.col("updated_at").alias("at"), "version", F.lit(False).alias("orphan"))
    lone = top.join(jobs, "task_id", "left_anti").select("task_id", F.lit("completed").alias("status"), F.col("created_at").alias("at"), "version", F.lit(True).alias("orphan"))
    return own.unionByName(lone).orderBy(F.desc("at"), "task_id").limit(most)


def list_jobs(jobs: DataFrame, statuses: list[str], most: int, order: str, key: str) -> DataFrame:
    """The most recent jobs in one of the statuses; the limit is kept within 1..500, equal times go by key."""
    return jobs.where(F.col("status").isin(*statuses)).orderBy(F.desc(order), key).limit(max(1, min(500, most)))


def merge_manifests(base: Column, overlay: Column, durable: list[str]) -> Column:
    """Two maps as one: the overlay wins, but for durable keys the base."""
    kept = F.map_filter(base, lambda k, _: k.isin(*durable))
    rest = F.map_filter(base, lambda k, _: ~k.isin(*durable) & ~F.map_contains_key(overlay, k))
    return F.map_concat(rest, F.map_filter(overlay, lambda k, _: ~k.isin(*durable) | ~F.map_contains_key(base, k)), kept)


def duplicate_keys(df: DataFrame, by: list[str]) -> DataFrame:
    """Keys that occur more than once, in order."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").orderBy(*by)


def first_and_last(log: DataFrame, key: list[str], seq: str, first: list[str], last: list[str]) -> DataFrame:
    """Upserts of which some columns keep their first value and others take the last."""
    return log.groupBy(*key).agg(*[F.min_by(c, seq).alias(c) for c in first], *[F.max_by(c, seq).alias(c) for c in last])


def reassign(df: DataFrame, column: str, old: int | str, new: int | str) -> DataFrame:
    """df with an owner replaced, and whether the row changed."""
    return df.withColumn("changed", F.col(column) == F.lit(old)).withColumn(column, F.when(F.col("changed"), F.lit(new)).otherwise(F.col(column)))


def apply_updates(df: DataFrame, updates: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """df with the fields that updates give (null: unchanged); updates of unknown keys change nothing."""
    u = updates.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    return df.join(u, key, "left").withColumns({f: F.coalesce(F.col(f"_{f}"), F.col(f)) for f in fields}).drop(*[f"_{f}" for f in fields])


def unknown_updates(df: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    return updates.join(df, key, "left_anti")


def reusable_checkpoints(checkpoints: DataFrame, runs: DataFrame, owner: int, stage: str, not_run: int, path: str, value: str, most: int) -> DataFrame:
    """Checkpoints of an owner's other runs at a stage whose JSON payload has the value at the path, newest first.
    Payloads that are no JSON are passed over."""
    own = runs.where(F.col("owner") == owner).select("run_id")
    hit = F.get_json_object("payload", path) == value
    return checkpoints.where((F.col("stage") == stage) & (F.col("run_id") != not_run)).join(own, "run_id", "left_semi").where(hit).orderBy(F.desc("created_at"), "run_id").limit(most)


def replace_partition(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """old with all rows of the groups that new has replaced by them."""
    return old.join(new.select(by).distinct(), by, "left_anti").unionByName(new)


def without_tasks(df: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """A child table after its tasks were deleted."""
    return df.join(tombstones, key, "left_anti")


def live_sessions(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    return sessions.where(F.col("expires_at") > now).join(users, "user_id")


def recovered(jobs: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Jobs that were queued or running: failed if their source is gone, else queued again from 0."""
    j = jobs.where(F.col("status").isin("queued", "running")).join(sources.select(key).distinct().withColumn("_s", F.lit(1)), key, "left")
    return j.withColumn("status", F.when(F.col("_s").isNull(), "failed").otherwise("queued")).withColumn("progress", F.when(F.col("_s").isNull(), F.col("progress")).otherwise(0.0)).drop("_s")


def expired(jobs: DataFrame, at: str, now: Column, hours: int) -> DataFrame:
    """Ended jobs that are older than the retention time."""
    return jobs.where(F.col("status").isin("completed", "failed", "cancelled") & (F.col(at) <= now - F.make_interval(hours=F.lit(hours))))


def pending_reviews(items: Column) -> Column:
    """Number of pending reviews in a nested array."""
    return F.size(F.filter(items, lambda x: x["status"] == "pending"))


def add_column(df: DataFrame, name: str, kind: str, default=None) -> DataFrame:
    """df with the column, if it doesn't have it yet."""
    return df if name in df.columns else df.withColumn(name, F.lit(default).cast(kind))


def commit_review(run: DataFrame, reviews: DataFrame, resolution: DataFrame) -> DataFrame:
    """Which resolutions (run_id, review_id, expected, status) may be committed: code ok, or the first precondition
    that fails. Tables are then written under a new version, and the manifest row that names it comes last."""
    cur = run.groupBy("run_id").agg(F.max("version").alias("current"))
    j = resolution.join(cur, "run_id", "left").join(reviews.select("run_id", "review_id", F.col("status").alias("state")), ["run_id", "review_id"], "left")
    code = F.when(F.col("current").isNull(), "unknown_run").when(F.col("state").isNull(), "unknown_review").when(F.col("state") != "pending", "not_pending").when(F.col("expected") != F.col("current"), "version_conflict").otherwise("ok")
    return j.select("run_id", "review_id", code.alias("code"), F.when(code == "ok", F.col("current") + 1).alias("new_version"))


def update_runs(runs: DataFrame, updates: DataFrame) -> DataFrame:
    """runs (run_id, status, stage, progress) after updates (run_id, status, stage; null: unchanged). A run that an
    update completes is at 100."""
    done = updates.select("run_id", (F.col("status") == "completed").alias("_done"))
    changed = apply_updates(runs, updates, "run_id", ["status", "stage"]).join(done, "run_id", "left")
    return changed.withColumn("progress", F.when(F.col("_done"), 100).otherwise(F.col("progress"))).drop("_done")


def save_items(old: DataFrame, new: DataFrame, saving: DataFrame, by: str) -> DataFrame:
    """old with all rows of the groups that save (saving) replaced by theirs of new, which may be none."""
    return old.join(saving, by, "left_anti").unionByName(new)


def resolve_items(items: DataFrame, resolutions: DataFrame, by: list[str]) -> DataFrame:
    """resolutions with state: resolved, or unknown_item where no item has that key."""
    known = items.select(*by).distinct().withColumn("_known", F.lit(True))
    j = resolutions.join(known, by, "left")
    return j.withColumn("state", F.when(F.col("_known"), "resolved").otherwise("unknown_item")).drop("_known")


def numbered_rows(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows of each group numbered in order."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def record_calls(log: DataFrame, seq: str, first: list[str], last: list[str]) -> DataFrame:
    """Calls (run_id, item_id) from their log: some columns keep the first value, others take the last. Calls without a
    run or an item aren't kept."""
    inside = log.where((F.coalesce(F.col("run_id").cast("string"), F.lit("")) != "") & (F.coalesce(F.col("item_id").cast("string"), F.lit("")) != ""))
    return first_and_last(inside, ["run_id", "item_id"], seq, first, last)


def latest_result(versions: DataFrame, runs: DataFrame) -> DataFrame:
    """Per task and owner of runs (run_id, task_id, owner) the payload of the latest version (run_id, version,
    created_at, payload) of all their runs: by time, then number."""
    j = versions.join(runs, "run_id")
    return j.groupBy("task_id", "owner").agg(F.max_by("payload", F.struct("created_at", "version", "run_id", "payload")).alias("payload"))


def register(names: DataFrame, seq: str, name: str) -> DataFrame:
    """Accounts from registrations in order of seq: the first of a name, trimmed and in lower case, has it; how many
    were refused after it, and whether it is the first account of all."""
    n = names.select(F.lower(F.trim(name)).alias("username_key"), F.col(seq).alias("seq"))
    g = n.groupBy("username_key").agg(F.min("seq").alias("seq"), (F.count("*") - 1).alias("refused"))
    return g.crossJoin(F.broadcast(n.agg(F.min("seq").alias("_first")))).select("username_key", "seq", "refused", (F.col("seq") == F.col("_first")).alias("first_account"))


def run_of_task(runs: DataFrame, run: str, manifest: str) -> DataFrame:
    """The last run of each task and owner with its manifest; an empty object where there is none."""
    g = runs.groupBy("task_id", "owner").agg(F.max(F.struct(run, F.coalesce(manifest, F.lit("{}")).alias("m"))).alias("r"))
    return g.select("task_id", "owner", F.col(f"r.{run}").alias("run_id"), F.col("r.m").alias("manifest"))

"""Queries over the rows that a task store writes and reads; the driver tables stand for its tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..streaming import events as ev
from . import store as st
from .catalog_state import events
from .registry import query, table


def _runs(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("task_id"), (F.col("o_custkey") % 5).alias("owner"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("stage"), (F.col("o_orderkey") % 97).alias("progress"))


@query("""WITH r AS (SELECT o_orderkey AS run_id, o_orderstatus AS status, o_orderpriority AS stage, o_orderkey % 97 AS progress FROM orders),
    u AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 2 = 0 THEN 'completed' END AS s, CASE WHEN o_orderkey % 5 = 0 THEN 'done' END AS g FROM orders WHERE o_orderkey % 3 = 0)
    SELECT run_id, coalesce(s, status) AS status, coalesce(g, stage) AS stage, CASE WHEN s = 'completed' THEN 100 ELSE progress END AS progress FROM r LEFT JOIN u USING (run_id)""")
def updated_runs(spark, d):
    """Runs after updates that give some fields; a completed one is at 100."""
    r = _runs(spark, d).select("run_id", "status", "stage", "progress")
    k = F.col("run_id")
    u = r.where("run_id % 3 = 0").select("run_id", F.when(k % 2 == 0, "completed").alias("status"), F.when(k % 5 == 0, "done").alias("stage"))
    return st.update_runs(r, u)


@query("SELECT user_id AS run_id, event_type AS item_id, min_by(ts, event_id) AS created_at, max_by(props, event_id) AS payload FROM events GROUP BY 1, 2")
def saved_decisions(spark, d):
    """Decision records: the payload of the last save, the time of the first."""
    log = events(spark, d).select(F.col("user_id").alias("run_id"), F.col("event_type").alias("item_id"), "event_id", F.col("ts").alias("created_at"), F.col("props").alias("payload"))
    return st.first_and_last(log, ["run_id", "item_id"], "event_id", ["created_at"], ["payload"])


@query("""SELECT l_orderkey AS run_id, l_linenumber AS item_id, l_linestatus AS status FROM lineitem WHERE l_orderkey % 4 <> 0
    UNION ALL SELECT l_orderkey, l_linenumber, 'pending' FROM lineitem WHERE l_orderkey % 8 = 0""")
def saved_reviews(spark, d):
    """Review items after runs saved theirs: a run's old ones go, also where it saves none."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("item_id"), F.col("l_linestatus").alias("status"))
    saving = li.where("run_id % 4 = 0").select("run_id").distinct()
    return st.save_items(li, li.where("run_id % 8 = 0").withColumn("status", F.lit("pending")), saving, "run_id")


@query("""WITH i AS (SELECT l_orderkey AS run_id, l_linenumber AS item_id FROM lineitem WHERE l_linenumber < 4), s AS (SELECT l_orderkey AS run_id, l_linenumber AS item_id, 'by ' || l_suppkey AS resolution FROM lineitem WHERE l_orderkey % 3 = 0)
    SELECT DISTINCT run_id, item_id, resolution, CASE WHEN i.run_id IS NULL THEN 'unknown_item' ELSE 'resolved' END AS state FROM s LEFT JOIN i USING (run_id, item_id)""".replace("CASE WHEN i.run_id IS NULL", "CASE WHEN item_id >= 4"))
def resolved_reviews(spark, d):
    """What becomes of resolutions: an item that isn't there is an error."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("item_id"), F.concat(F.lit("by "), F.col("l_suppkey").cast("string")).alias("resolution"))
    return st.resolve_items(li.where("item_id < 4"), li.where("run_id % 3 = 0").distinct(), ["run_id", "item_id"])


@query("SELECT user_id AS run_id, event_type AS stage, props AS payload, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events")
def listed_checkpoints(spark, d):
    """Checkpoints of each run in order of time."""
    c = events(spark, d).select(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), F.col("props").alias("payload"), "ts", "event_id")
    return st.numbered_rows(c, ["run_id"], ["ts", "event_id"]).drop("ts", "event_id")


@query("""SELECT user_id AS run_id, event_type AS item_id, min_by(value, event_id) AS model, max_by(value, event_id) AS latency, max_by(props, event_id) AS details FROM events WHERE user_id % 10 <> 0 GROUP BY 1, 2""")
def recorded_calls(spark, d):
    """Model calls: the first says who was called, the last how it ended; calls outside a run aren't kept."""
    log = events(spark, d).select(F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("run_id"), F.col("event_type").alias("item_id"), "event_id", F.col("value").alias("model"), F.col("value").alias("latency"), F.col("props").alias("details"))
    return st.record_calls(log, "event_id", ["model"], ["latency", "details"])


@query("SELECT user_id AS run_id, event_id AS item_id, value AS latency, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events")
def listed_calls(spark, d):
    """Calls of each run by time, equal times by id."""
    c = events(spark, d).select(F.col("user_id").alias("run_id"), F.col("event_id").alias("item_id"), F.col("value").alias("latency"), "ts")
    return st.numbered_rows(c, ["run_id"], ["ts", "item_id"]).drop("ts")


@query("""WITH r AS (SELECT o_orderkey AS run_id, o_custkey AS task_id, o_custkey % 5 AS owner FROM orders), v AS (SELECT l_orderkey AS run_id, l_linenumber AS version, l_shipdate AS created_at, l_comment AS payload FROM (SELECT *, CAST(l_partkey AS VARCHAR) || ':' || l_suppkey || ':' || l_quantity AS l_comment FROM lineitem))
    SELECT task_id, owner, max_by(payload, row(created_at, version, run_id, payload)) AS payload FROM v JOIN r USING (run_id) GROUP BY task_id, owner""")
def latest_results(spark, d):
    """The latest graph of each task of an owner, over all its runs."""
    li = table(spark, d, "lineitem")
    v = li.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("version"), F.col("l_shipdate").alias("created_at"), F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("string")).alias("payload"))
    return st.latest_result(v, _runs(spark, d).select("run_id", "task_id", "owner"))


@query("""WITH n AS (SELECT c_custkey, lower(trim(c_mktsegment)) || (c_custkey % 400) AS username_key, ' ' || c_mktsegment || (c_custkey % 400) AS username FROM customer)
    SELECT username_key, min(c_custkey) AS seq, count(*) - 1 AS refused, min(c_custkey) = (SELECT min(c_custkey) FROM n) AS first_account FROM n GROUP BY username_key""")
def registered_accounts(spark, d):
    """Accounts by the order of registration: the first of a name has it, whatever its case; the very first is marked."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("seq"), F.concat(F.lit(" "), F.col("c_mktsegment"), (F.col("c_custkey") % 400).cast("string")).alias("username"))
    return st.register(c, "seq", "username")


@query("SELECT user_id AS run_id, event_type AS stage, max_by(props, event_id) AS payload FROM events GROUP BY 1, 2")
def loaded_checkpoints(spark, d):
    """The checkpoint of each run and stage, the last that was written."""
    e = events(spark, d).select(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), F.col("props").alias("payload"), "event_id")
    return st.latest(e, ["run_id", "stage"], ["event_id"]).drop("event_id")


@query("SELECT o_custkey AS task_id, o_custkey % 5 AS owner, max(o_orderkey) AS run_id, max_by(CASE WHEN o_orderkey % 3 = 0 THEN '{}' ELSE '{\"k\":' || (o_orderkey % 97) || '}' END, o_orderkey) AS manifest FROM orders GROUP BY 1, 2")
def run_manifests(spark, d):
    """The run of each task and owner with its manifest, an empty one where none was written."""
    r = _runs(spark, d).withColumn("manifest", F.when(F.col("run_id") % 3 != 0, F.to_json(F.struct(F.col("progress").alias("k")))))
    return st.run_of_task(r, "run_id", "manifest")


@query("SELECT n_nationkey, n_name, CAST(NULL AS VARCHAR) AS note, 'x' AS kind FROM nation")
def added_columns(spark, d):
    """A table with the columns that an older one lacks; those it has stay."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name", F.lit("x").alias("kind"))
    return st.add_column(st.add_column(n, "note", "string"), "kind", "string", "default")


@query("""WITH b AS (SELECT *, event_type = 'purchase' AS control, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stretch FROM events),
    s AS (SELECT *, (row_number() OVER (PARTITION BY user_id, stretch ORDER BY event_id) - 1) // 4 AS slice FROM b)
    SELECT user_id, CAST(stretch AS BIGINT) AS stretch, CAST(slice AS BIGINT) AS slice, min(event_id) AS first, max(event_id) AS last, count(*) AS n, bool_or(control) AS barrier FROM s GROUP BY ALL""")
def event_slices(spark, d):
    """Slices in which a client takes in events: four at most here, none across a control event."""
    return ev.slices(events(spark, d), "user_id", "event_id", F.col("event_type") == "purchase", 4)

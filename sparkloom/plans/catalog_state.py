"""Queries over the task store, events, metrics and client tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import client as cl
from ..operators import metrics as mt
from ..streaming import events as ev
from . import store as st
from .catalog_text import BLOCKS, blocks
from .registry import query, table


def events(spark, d) -> DataFrame:
    return table(spark, d, "events")


@query("""WITH e AS (SELECT *, CASE WHEN event_type = 'signup' THEN event_id END AS z FROM events), x AS (SELECT *, coalesce(max(z) OVER (PARTITION BY user_id ORDER BY event_id), -1) AS epoch FROM e)
    SELECT user_id, max_by(CASE WHEN event_type = 'view' THEN NULL ELSE event_type END, event_id) FILTER (event_type <> 'view') AS status, max_by(props, event_id) AS props, (max(struct_pack(e := epoch, p := greatest(0, least(value, 100))))).p AS progress, min_by(CASE WHEN event_type = 'view' THEN '' ELSE event_type END, event_id) AS "first", count(*) AS updates FROM x GROUP BY user_id""")
def nonempty_wins_merge(spark, d):
    """Jobs from their update log: non-empty values win, progress is the highest since the last reset."""
    log = events(spark, d).withColumn("status", F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")))
    return st.merge_jobs(log.withColumn("progress", F.col("value")), "user_id", "event_id", ["status", "props"], "progress", F.col("event_type") == "signup")


@query("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1".replace("SELECT * FROM (", "SELECT event_id, user_id, event_type, value, props FROM (", 1))
def latest_per_key(spark, d):
    """The last event of each user."""
    return st.latest(events(spark, d), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("SELECT event_id, user_id, event_type, value, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events)) WHERE r = 1")
def as_of_version(spark, d):
    """The last event of each user up to a moment."""
    e = events(spark, d)
    middle = (e.agg(F.max("event_id")).first()[0] or 0) // 2
    return st.as_of(e, ["user_id"], "event_id", F.lit(middle)).drop("ts")


_VERSIONS = "v AS (SELECT o_custkey AS task_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version, o_orderdate AS created_at FROM orders)"


def versions(spark, d) -> DataFrame:
    return ev.numbered(table(spark, d, "orders").select(F.col("o_custkey").alias("task_id"), "o_orderkey", F.col("o_orderdate").alias("created_at")), "task_id", ["o_orderkey"]).withColumnRenamed("id", "version")


@query(f"WITH {_VERSIONS} SELECT task_id, max(version) + 1 AS next_version FROM v GROUP BY 1")
def next_versions(spark, d):
    """The version that a save would get."""
    return st.next_version(versions(spark, d), "task_id")


@query(f"WITH {_VERSIONS}, m AS (SELECT task_id, max(version) AS c FROM v GROUP BY 1) SELECT c_custkey AS task_id, c_custkey % 15 AS expected, coalesce(c, 0) AS current FROM customer LEFT JOIN m ON task_id = c_custkey WHERE c_custkey % 15 <> coalesce(c, 0)")
def version_conflicts(spark, d):
    """Writes whose expected version isn't the current one."""
    w = table(spark, d, "customer").select(F.col("c_custkey").alias("task_id"), (F.col("c_custkey") % 15).alias("expected"))
    return st.version_conflicts(w, versions(spark, d), "task_id")


@query(f"""WITH {_VERSIONS}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY created_at DESC, version DESC) AS r FROM v) WHERE r = 1), j AS (SELECT c_custkey AS task_id, c_mktsegment AS status, TIMESTAMP '1997-01-01' + to_days(CAST(c_custkey % 900 AS INTEGER)) AS "at" FROM customer WHERE c_custkey % 3 <> 0)
    SELECT task_id, status, version, orphan FROM (SELECT j.task_id, status, j."at", version, FALSE AS orphan FROM j LEFT JOIN l USING (task_id) UNION ALL SELECT l.task_id, 'completed', created_at, version, TRUE FROM l WHERE task_id NOT IN (SELECT task_id FROM j)) ORDER BY "at" DESC, task_id LIMIT 100""")
def history_with_orphans(spark, d):
    """Jobs with their latest version, and versions without a job; the newest hundred, as asked."""
    j = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("task_id"), F.col("c_mktsegment").alias("status"), F.expr("timestamp_ntz '1997-01-01' + make_interval(0, 0, 0, cast(c_custkey % 900 as int))").alias("updated_at"))
    return st.history(j, versions(spark, d)).drop("at")


@query("SELECT o_orderkey, o_orderstatus AS status FROM orders WHERE o_orderstatus IN ('F', 'P') ORDER BY o_orderdate DESC, o_orderkey LIMIT 500")
def listed_jobs(spark, d):
    """The newest jobs in some statuses, 500 at most as the store allows."""
    o = table(spark, d, "orders").withColumn("status", F.col("o_orderstatus"))
    return st.list_jobs(o, ["F", "P"], 9999, "o_orderdate", "o_orderkey").select("o_orderkey", "status")


@query("SELECT p_partkey, 'base' AS source, CASE WHEN p_size % 2 = 0 THEN 'new' ELSE 'old' END AS name, p_brand AS extra FROM part")
def merged_manifests(spark, d):
    """Two manifests as one, durable keys from the base."""
    p = table(spark, d, "part")
    base = F.create_map(F.lit("source"), F.lit("base"), F.lit("name"), F.lit("old"))
    over = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("name"), F.lit("new"), F.lit("extra"), F.col("p_brand"), F.lit("source"), F.lit("x"))).otherwise(F.create_map(F.lit("extra"), F.col("p_brand")))
    m = p.select("p_partkey", st.merge_manifests(base, over, ["source"]).alias("m"))
    return m.select("p_partkey", F.col("m")["source"].alias("source"), F.col("m")["name"].alias("name"), F.col("m")["extra"].alias("extra"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    """Keys that occur more than once."""
    return st.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT user_id, min_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value, max_by(props, event_id) AS props FROM events GROUP BY user_id")
def first_and_last(spark, d):
    """Upserts that keep some first values and take other last ones."""
    return st.first_and_last(events(spark, d), ["user_id"], "event_id", ["event_type"], ["value", "props"])


@query("SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN 99 ELSE s_nationkey END AS s_nationkey, s_nationkey = 3 AS changed FROM supplier")
def reassigned_owner(spark, d):
    return st.reassign(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", 3, 99)


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def applied_updates(spark, d):
    """Fields that an update gives."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    u = c.where("c_custkey % 4 = 0").select("c_custkey", F.lit("new").alias("c_mktsegment"))
    return st.apply_updates(c, u, "c_custkey", ["c_mktsegment"])


@query("""SELECT event_id AS run_id, '{"k":' || (event_id % 4) || '}' AS payload FROM events WHERE event_type = 'click' AND event_id <> 5 AND user_id % 3 = 1 AND event_id % 4 = 2
    ORDER BY ts DESC, event_id LIMIT 20""")
def reusable_checkpoints(spark, d):
    """Checkpoints of an owner's other runs with the same input hash, the newest twenty as asked."""
    e = events(spark, d)
    c = e.select(F.col("event_id").alias("run_id"), F.col("event_type").alias("stage"), F.to_json(F.struct((F.col("event_id") % 4).alias("k"))).alias("payload"), F.col("ts").alias("created_at"))
    r = e.select(F.col("event_id").alias("run_id"), (F.col("user_id") % 3).alias("owner"))
    return st.reusable_checkpoints(c, r, 1, "click", 5, "$.k", "2", 20).select("run_id", "payload")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey % 5 <> 0 UNION ALL SELECT o_orderkey, o_custkey, 'new' FROM orders WHERE o_custkey % 5 = 0 AND o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey % 5 = 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)")
def replaced_items(spark, d):
    """Groups replaced as a whole."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return st.replace_partition(o, o.where("o_custkey % 5 = 0 and o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("new")), "o_custkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def deleted_tasks(spark, d):
    """Lines that stay when their orders are deleted."""
    dead = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return st.without_tasks(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), dead, "l_orderkey")


@query("SELECT event_id, c_custkey AS user_id, c_name FROM events JOIN customer ON c_custkey = user_id WHERE value > 250")
def live_sessions(spark, d):
    """Sessions that haven't expired, with their users."""
    s = events(spark, d).select("event_id", "user_id", F.col("value").alias("expires_at"))
    return st.live_sessions(s, table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name"), F.lit(250)).select("event_id", "user_id", "c_name")


@query("SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'failed' ELSE 'queued' END AS status, CASE WHEN c_custkey IS NULL THEN o_totalprice ELSE 0 END AS progress FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) ON c_custkey = o_custkey WHERE o_orderstatus IN ('O', 'P')")
def recovered_jobs(spark, d):
    """Interrupted jobs after a restart."""
    s = F.col("o_orderstatus")
    j = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.when(s == "O", "queued").when(s == "P", "running").otherwise("completed").alias("status"), F.col("o_totalprice").alias("progress"))
    return st.recovered(j, table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k")), "k").select("o_orderkey", "status", "progress")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate <= TIMESTAMP '1998-01-01' - INTERVAL 48 HOUR")
def expired_sources(spark, d):
    """Ended jobs beyond the retention time."""
    j = table(spark, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "F", "failed").otherwise("running"))
    return st.expired(j, "o_orderdate", F.expr("timestamp_ntz '1998-01-01'"), 48).select("o_orderkey")


@query("SELECT user_id, CAST(count(*) FILTER (event_type = 'click') AS INTEGER) AS pending FROM events GROUP BY 1")
def pending_reviews(spark, d):
    """Pending items of a nested array."""
    g = events(spark, d).groupBy("user_id").agg(F.collect_list(F.struct(F.when(F.col("event_type") == "click", "pending").otherwise("done").alias("status"))).alias("r"))
    return g.select("user_id", st.pending_reviews(F.col("r")).alias("pending"))


@query(f"""WITH {_VERSIONS}, m AS (SELECT task_id, max(version) AS c FROM v GROUP BY 1), r AS (SELECT c_custkey AS run_id, c_custkey * 2 AS review_id, c_nationkey % 20 AS expected FROM customer), s AS (SELECT c_custkey AS run_id, c_custkey * 2 AS review_id, CASE WHEN c_custkey % 3 = 0 THEN 'done' ELSE 'pending' END AS state FROM customer WHERE c_custkey % 7 <> 0)
    SELECT run_id, review_id, CASE WHEN c IS NULL THEN 'unknown_run' WHEN state IS NULL THEN 'unknown_review' WHEN state <> 'pending' THEN 'not_pending' WHEN expected <> c THEN 'version_conflict' ELSE 'ok' END AS code, CASE WHEN c IS NOT NULL AND state = 'pending' AND expected = c THEN c + 1 END AS new_version FROM r LEFT JOIN m ON task_id = run_id LEFT JOIN s USING (run_id, review_id)""")
def review_commits(spark, d):
    """Which resolutions may be committed."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    reviews = c.where(k % 7 != 0).select(k.alias("run_id"), (k * 2).alias("review_id"), F.when(k % 3 == 0, "done").otherwise("pending").alias("status"))
    return st.commit_review(versions(spark, d).withColumnRenamed("task_id", "run_id"), reviews, c.select(k.alias("run_id"), (k * 2).alias("review_id"), (F.col("c_nationkey") % 20).alias("expected")))


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS id FROM events")
def numbered_events(spark, d):
    """Dense numbers per key."""
    return ev.numbered(events(spark, d).select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"]).drop("ts")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 20")
def retained_events(spark, d):
    """The ring buffer of each key, a bound that is the feature."""
    return ev.retained(events(spark, d).select("event_id", "user_id"), "user_id", ["event_id"], 20)


@query("WITH n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS id FROM events) SELECT * FROM n WHERE id > CASE WHEN user_id % 2 = 0 THEN 30 ELSE 0 END")
def replayed_events(spark, d):
    """Events after each reader's cursor."""
    log = ev.numbered(events(spark, d).select("event_id", "user_id"), "user_id", ["event_id"])
    c = log.where("user_id % 2 = 0").select("user_id").distinct().withColumn("after", F.lit(30))
    return ev.replay(log, c, "user_id")


@query("SELECT user_id, 'failed' AS kind FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'purchase' AND value > 480) = 0")
def synthetic_ends(spark, d):
    """Ends of tasks whose log has none."""
    log = events(spark, d).select("user_id", F.when((F.col("event_type") == "purchase") & (F.col("value") > 480), "completed").otherwise("step").alias("kind"))
    return ev.closed(log, log.select("user_id").distinct().withColumn("status", F.lit("failed")), "user_id")


@query("SELECT event_id, user_id, value, greatest(0, least(100, max(value) OVER (PARTITION BY user_id ORDER BY event_id))) AS progress FROM events")
def monotone_progress(spark, d):
    """Progress that never falls."""
    return ev.monotone(events(spark, d).select("event_id", "user_id", "value"), "user_id", ["event_id"], "value")


@query("""WITH e AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS s FROM events)
    SELECT user_id, max_by(event_type, event_id) AS last_kind, max(event_id) AS last_seq, CAST(sum(s) AS BIGINT) AS steps, right(string_agg(event_type || ';', '' ORDER BY event_id), 60) AS output FROM e GROUP BY user_id""")
def folded_jobs(spark, d):
    """State of each task after its events; the replayed ones count once."""
    e = events(spark, d)
    return ev.fold_jobs(e.unionByName(e.where("event_id % 5 = 0")), "user_id", "event_id", "event_type", F.concat("event_type", F.lit(";")), 60)


@query("""WITH e AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS s FROM events), r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM e), g AS (SELECT user_id, CAST(step AS BIGINT) AS step, min_by(event_type, event_id) AS event_type, min(event_id) AS begin_at, count(*) AS events FROM r GROUP BY user_id, step)
    SELECT *, lead(begin_at) OVER (PARTITION BY user_id ORDER BY step) AS finish FROM g""".replace("begin_at", '"begin"'))
def job_steps(spark, d):
    """Runs of one kind with their begin and end."""
    return ev.steps(events(spark, d), "user_id", "event_id", "event_type", "event_id")


@query("SELECT user_id, max(event_id) FILTER (event_type <> 'view') AS cursor, count(*) FILTER (event_type = 'view') AS volatile FROM events GROUP BY 1")
def cursors(spark, d):
    """Highest durable sequence numbers."""
    return ev.high_water(events(spark, d), "user_id", "event_id", F.col("event_type") != "view")


_DELTAS = """e AS (SELECT user_id, event_id, event_type || ' ' AS value FROM events), o AS (SELECT *, coalesce(sum(length(value)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS "offset" FROM e)"""


def deltas(spark, d) -> DataFrame:
    from pyspark.sql import Window

    e = events(spark, d).select("user_id", "event_id", F.concat("event_type", F.lit(" ")).alias("value"))
    before = F.sum(F.length("value")).over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    return e.withColumn("offset", F.coalesce(before, F.lit(0)) + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0))


@query(f"""WITH {_DELTAS}, f AS (SELECT *, CASE WHEN "offset" = lag("offset" + length(value)) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS f FROM o), r AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM f), p AS (SELECT *, (sum(length(value)) OVER (PARTITION BY user_id, run ORDER BY event_id) - length(value)) // 64 AS part FROM r)
    SELECT user_id, CAST(run AS BIGINT) AS run, CAST(min("offset") AS BIGINT) AS "offset", string_agg(value, '' ORDER BY event_id) AS value, count(*) AS merged FROM p GROUP BY user_id, run, part""")
def coalesced_deltas(spark, d):
    """Contiguous deltas as one, up to a size."""
    return ev.coalesce_deltas(deltas(spark, d), ["user_id"], "event_id", 64)


@query("""SELECT conv_id, turn, CAST(p AS INTEGER) AS part, CAST(100 * p AS BIGINT) AS "offset", substr(text, CAST(100 * p + 1 AS BIGINT), 100) AS value FROM (SELECT *, unnest(range(0, greatest(CAST(ceil(length(text) / 100) AS BIGINT), 1))) AS p FROM conversations)""")
def split_deltas(spark, d):
    """Long values in parts."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.lit(0).cast("long").alias("offset"), F.col("text").alias("value"))
    return ev.split_deltas(c, 100)


@query("""WITH t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM conversations)
    SELECT conv_id, CAST(turn_no AS BIGINT) AS turn_no, CAST(count(*) AS INTEGER) AS messages, min(turn) AS "first", CAST(count(*) FILTER (role = 'assistant') AS INTEGER) AS answers, CAST(coalesce(length(string_agg(text, chr(10)) FILTER (role = 'assistant')), 0) AS INTEGER) AS answer_chars FROM t GROUP BY conv_id, turn_no""")
def turns(spark, d):
    """Turns of conversations."""
    return ev.turns(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")


@query("""WITH t AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS s FROM conversations), r AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM t) SELECT conv_id, CAST(run AS BIGINT) AS run, min(role) AS role, count(*) AS n FROM r GROUP BY conv_id, run""")
def message_runs(spark, d):
    """Consecutive messages of one role."""
    return ev.runs_of(table(spark, d, "conversations"), "conv_id", "turn", "role")


@query("""SELECT event_id, user_id, round(sum(value) OVER w / 86400, 6) AS rate, count(*) OVER w AS events_in_window FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECOND PRECEDING AND CURRENT ROW)""")
def sliding_rate(spark, d):
    """Amount per second over the trailing day."""
    return ev.sliding_rate(events(spark, d), "user_id", "ts", "value", 86_400).select("event_id", "user_id", "rate", "events_in_window")


@query("""WITH s AS (SELECT conv_id, turn FROM conversations WHERE turn >= 2 AND conv_id % 2 = 0), l AS (SELECT conv_id, turn FROM conversations WHERE turn < 4)
    SELECT conv_id, turn, 'snapshot' AS origin FROM s UNION ALL SELECT conv_id, turn, 'loaded' FROM l WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.conv_id = l.conv_id AND s.turn <= l.turn)""")
def merged_snapshot(spark, d):
    """Loaded messages and a snapshot as one list."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.col("turn").alias("id"))
    return ev.merge_snapshot(c.where("turn < 4"), c.where("turn >= 2 and conv_id % 2 = 0"), "conv_id", "id", "turn").drop("id")


@query("""WITH r AS (SELECT s_suppkey AS k, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'completed' ELSE 'running' END AS a FROM supplier), v AS (SELECT user_id AS k, CASE WHEN count(*) % 2 = 0 THEN 'failed' ELSE 'running' END AS b, max(event_type) AS output FROM events GROUP BY 1)
    SELECT coalesce(r.k, v.k) AS k, coalesce(name, 'task ' || v.k) AS name, CASE WHEN a = 'completed' THEN a WHEN b = 'failed' THEN b ELSE coalesce(b, a) END AS status, coalesce(output, '') AS output FROM r FULL JOIN v ON r.k = v.k""")
def merged_subagents(spark, d):
    """Roster and live state as one."""
    r = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, "completed").otherwise("running").alias("status"))
    v = events(spark, d).groupBy(F.col("user_id").alias("k")).agg(F.when(F.count("*") % 2 == 0, "failed").otherwise("running").alias("status"), F.max("event_type").alias("output"))
    return ev.merge_live(r, v, "k")


@query("SELECT user_id, max_by(props, event_id) AS props, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1")
def newest_payload(spark, d):
    """The newest message that carries a payload."""
    return ev.newest_with(events(spark, d), "user_id", "event_id", "props", F.col("event_type") == "purchase")


@query("SELECT event_id, CAST(least(10000, 900 * pow(2, user_id % 6)) AS BIGINT) AS poll, greatest(0, least(CASE WHEN event_id % 2 = 0 THEN value ELSE pow(2, user_id % 9) END, 60)) AS retry FROM events")
def delays(spark, d):
    """Delays of polls and retries."""
    after = F.when(F.col("event_id") % 2 == 0, F.col("value").cast("string")).otherwise("soon")
    return events(spark, d).select("event_id", ev.poll_delay(F.col("user_id") % 6).alias("poll"), ev.retry_delay(after, F.col("user_id") % 9).alias("retry"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE coalesce(nullif(o_orderpriority, '1-URGENT'), 'running') END AS phase, CASE WHEN o_orderkey % 5 = 0 THEN 'invalid' WHEN o_orderkey % 7 < 4 THEN 'incomplete' WHEN o_orderkey % 3 = 0 THEN 'needs_review' ELSE 'good' END AS verdict FROM orders")
def phases(spark, d):
    """Phases and verdicts of tasks."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "failed").otherwise("running")
    return o.select("o_orderkey", ev.phase(status, F.nullif("o_orderpriority", F.lit("1-URGENT"))).alias("phase"), ev.quality_verdict(k % 5 != 0, F.when(k % 7 < 4, 0.5).otherwise(0.9), F.when(k % 3 == 0, 1).otherwise(0)).alias("verdict"))


@query("""SELECT event_type, round(quantile_disc(value, 0.5), 3) AS p50, round(quantile_disc(value, 0.95), 3) AS p95, list_sort(list(value))[CAST(CASE WHEN (count(*) - 1) % 2 = 1 THEN 2 * round((count(*) - 1) / 4) ELSE (count(*) - 1) / 2 END AS BIGINT) + 1] AS p50_index FROM events GROUP BY event_type""")
def latency_percentiles(spark, d):
    """Percentiles by both rank rules."""
    g = events(spark, d).groupBy("event_type").agg(mt.nearest_rank("value", 0.5).alias("p50"), mt.nearest_rank("value", 0.95).alias("p95"), F.collect_list("value").alias("v"))
    return g.select("event_type", "p50", "p95", mt.index_rank(F.col("v"), 0.5).alias("p50_index"))


@query("""SELECT user_id, count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors, round(quantile_disc(value, 0.5), 3) AS p50, round(quantile_disc(value, 0.95), 3) AS p95, max(value) AS highest, round(avg(value), 3) AS mean, bool_and(event_type <> 'error') AS all_ok FROM events GROUP BY 1""")
def status_rollup(spark, d):
    """Calls, failures and latencies per task."""
    return mt.call_summary(events(spark, d), ["user_id"], "event_type", "value")


@query("SELECT event_type, 'k' AS key, CAST(sum(CAST(json_extract(props, '$.k') AS DOUBLE)) AS DOUBLE) AS total, count(*) AS n FROM events GROUP BY event_type")
def json_usage_totals(spark, d):
    """Sums of the numeric keys of a JSON column."""
    return mt.usage_totals(events(spark, d), ["event_type"], "props")


@query(f"""WITH {BLOCKS}, r AS (SELECT doc_id // 2 AS page, doc_id * 100000 + ordinal AS item, text AS t FROM blocks), o AS (SELECT doc_id // 2 AS page, text FROM documents WHERE doc_id % 2 = 0)
    SELECT page, item, coalesce(bool_or(contains(lower(regexp_replace(o.text, '\\s+', '', 'g')), lower(regexp_replace(t, '\\s+', '', 'g')))), FALSE) AS present FROM r LEFT JOIN o USING (page) GROUP BY page, item""")
def required_text_audit(spark, d):
    """Whether required texts, the blocks of two documents, occur on their page, the text of the first of them."""
    page = F.floor(F.col("doc_id") / 2).alias("page")
    r = blocks(spark, d).select(page, (F.col("doc_id") * 100000 + F.col("ordinal")).alias("item"), "text")
    return mt.required_text(r, table(spark, d, "documents").where("doc_id % 2 = 0").select(page, "text"), ["page"])


@query("""WITH p AS (SELECT source, quality = 1 AS present FROM labels JOIN documents USING (doc_id)) SELECT source, round(coalesce(avg(CAST(present AS INTEGER)), 1), 4) AS rate, count(*) AS items FROM p GROUP BY source""")
def text_rates(spark, d):
    """Share of present items per group."""
    p = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("source", (F.col("quality") == 1).alias("present"))
    return mt.rate(p, ["source"])


@query()
def formula_audit(spark, d):
    """The observed formula most similar to each expected one of its page; parts of a brand stand for formulas."""
    p = table(spark, d, "part")
    e = p.where("p_size = 1").select(F.col("p_brand").alias("page"), F.col("p_partkey").alias("id"), F.concat("p_name", "p_type").alias("formula"))
    return mt.audit_formulas(e, p.where("p_size <> 1").select(F.col("p_brand").alias("page"), F.concat("p_type", "p_name").alias("formula")))


@query("SELECT source, count(*) AS \"rows\", round(1 - count(DISTINCT text) / count(*), 4) AS duplicate_rate, round(avg(CAST(lang = 'en' AS INTEGER)), 4) AS inherited_rate FROM documents GROUP BY source")
def extraction_metrics(spark, d):
    """Repeats and inherited rows per source."""
    return mt.extraction_metrics(table(spark, d, "documents"), ["source"], "text", F.col("lang") == "en")


@query("""WITH g AS (SELECT event_type, count(*) AS pages, count(*) FILTER (value > 100) AS ok, count(*) FILTER (value > 50) AS done, round(sum(value), 2) AS seconds FROM events GROUP BY 1) SELECT *, round(ok / greatest(done, 1), 4) AS success_rate, round(done / pages, 4) AS completion_rate FROM g""")
def profile_rollup(spark, d):
    """Pages rolled up to profiles: ratios of sums."""
    return mt.roll_up(events(spark, d), "event_type", F.col("value") > 100, F.col("value") > 50, "value")


@query("SELECT o_orderkey AS k, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END, CASE WHEN o_orderkey % 2 = 0 THEN 'checkpointed' END, 'missing') AS status FROM orders")
def page_reports(spark, d):
    """Status of every expected page."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))
    return mt.page_reports(o.select("k"), o.where("k % 3 = 0"), o.where("k % 2 = 0").select("k"), "k")


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'missing' WHEN o_orderkey % 7 = 0 THEN 'extra' WHEN o_orderkey % 2 = 0 THEN 'equal' WHEN o_orderstatus = 'F' THEN 'equal' ELSE 'different' END AS verdict FROM orders WHERE NOT (o_orderkey % 5 = 0 AND o_orderkey % 7 = 0)")
def report_verdicts(spark, d):
    """A report against its oracle."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    k = F.col("k")
    return mt.verdicts(o.where(k % 5 != 0), o.where(k % 7 != 0).withColumn("v", F.when(k % 2 == 0, F.col("v")).otherwise("F")), "k", "v")


@query("""SELECT s_name AS role, array_to_string(list_filter([CASE WHEN s_suppkey % 4 > 0 AND s_suppkey % 3 > 0 THEN s_name || '_unavailable' END, CASE WHEN s_suppkey % 5 > 0 AND s_suppkey % 2 > 0 THEN s_name || '_partial' END, CASE WHEN s_suppkey % 5 > 0 AND s_suppkey % 2 = 0 THEN s_name || '_failed' END], lambda x: x IS NOT NULL), ',') AS codes FROM supplier""")
def degraded_components(spark, d):
    """Codes of degraded roles."""
    k = F.col("s_suppkey")
    return mt.degraded_components(table(spark, d, "supplier").select(F.col("s_name").alias("role"), (k % 4).alias("requested"), (k % 3).alias("unavailable"), (k % 5).alias("fallback"), (k % 2).alias("fallback_ok")))


@query("""WITH reg AS (SELECT n_name AS id, '/W/' || n_name AS root, n_nationkey % 7 AS session_count, n_nationkey AS pos FROM nation WHERE n_nationkey < 12), ses AS (SELECT 'S' || (c_nationkey) AS wid, '/w/nation_' || c_nationkey || '/' AS root FROM customer),
    s AS (SELECT lower(regexp_replace(root, '/+$', '')) AS key, count(*) AS seen, min(root) AS root, min(wid) AS id FROM ses GROUP BY 1), r AS (SELECT lower(root) AS key, * FROM reg),
    u AS (SELECT key, id, root, session_count, FALSE AS derived FROM r UNION ALL SELECT key, id, root, 0, TRUE FROM s WHERE key NOT IN (SELECT key FROM r))
    SELECT u.id, u.root, CAST(greatest(session_count, coalesce(seen, 0)) AS BIGINT) AS sessions, derived FROM u LEFT JOIN s USING (key) WHERE key <> '/w/nation_3'""")
def workspaces(spark, d):
    """Registered and derived workspaces as one list."""
    reg = table(spark, d, "nation").where("n_nationkey < 12").select(F.col("n_name").alias("id"), F.concat(F.lit("/W/"), "n_name").alias("root"), (F.col("n_nationkey") % 7).cast("long").alias("session_count"), F.col("n_nationkey").alias("pos"))
    ses = table(spark, d, "customer").select(F.concat(F.lit("S"), F.col("c_nationkey").cast("string")).alias("workspace_id"), F.concat(F.lit("/w/nation_"), F.col("c_nationkey").cast("string"), F.lit("/")).alias("root"))
    return cl.merge_workspaces(reg, ses, spark.createDataFrame([("/W/NATION_3/",)], "root string"))


@query("""WITH g AS (SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'error') AS n_error FROM events GROUP BY 1) SELECT * FROM g WHERE total >= 60""")
def swarm_groups(spark, d):
    """Members per phase of groups that are large enough."""
    return cl.swarm_groups(events(spark, d), "user_id", "event_type", ["click", "error"], 60)


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS \"view\" FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def pivoted_kinds(spark, d):
    """Events per user and kind, as columns."""
    return cl.pivot_counts(events(spark, d).where("event_type in ('click', 'view')"), "user_id", "event_type", ["click", "view"])


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_type), 'red') ORDER BY p_partkey LIMIT 200")
def session_search(spark, d):
    """Rows that hold a query in some field, 200 at most as the dialog shows."""
    return cl.search(table(spark, d, "part"), ["p_name", "p_type"], "red", 200, [F.col("p_partkey")]).select("p_partkey", "p_name")


@query("SELECT n_name, r_name AS parent_name FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT r_name, NULL FROM region")
def parent_names(spark, d):
    """Rows with the name of their parent, by a self join."""
    n = table(spark, d, "nation").select(F.col("n_name"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("up"))
    r = table(spark, d, "region").select(F.col("r_name").alias("n_name"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("up"))
    return cl.with_parent_name(n.unionByName(r), "id", "up", "n_name").select("n_name", "parent_name")


@query("SELECT event_type, user_id % 3 AS session, count(*) AS n, max(event_id) AS last_seq FROM events GROUP BY ALL")
def socket_totals(spark, d):
    """Messages per kind and session."""
    return cl.socket_totals(events(spark, d).withColumn("session", F.col("user_id") % 3), ["event_type", "session"], "event_id")


@query("SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, CAST(round(avg(CASE WHEN event_type <> 'view' THEN value END)) AS BIGINT) AS mean FROM events GROUP BY 1")
def request_totals(spark, d):
    """Requests, failures and mean durations, summed in the order of the table's rows as the SQL does."""
    v = F.when(F.col("event_type") != "view", F.col("value"))
    e = events(spark, d).select("user_id", "event_type", v.alias("v"), "_metadata.file_path", "_metadata.row_index")
    return cl.request_totals(e, ["user_id"], F.col("event_type") == "error", "v", ["file_path", "row_index"])


@query("SELECT o_orderkey, 'fresh' AS origin FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'cached' FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0")
def merged_sessions(spark, d):
    """Fresh rows win over cached ones."""
    o = table(spark, d, "orders").select("o_orderkey")
    return cl.fresh_over_cached(o.where("o_orderkey % 3 = 0"), o.where("o_orderkey % 2 = 0"), "o_orderkey")


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS members FROM orders GROUP BY 1")
def workspace_groups(spark, d):
    """Members of each group in order."""
    return cl.grouped_in_order(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey")


@query("SELECT p.p_partkey AS id, p.p_name AS name, p.p_brand AS brand FROM part p WHERE p.p_size < 10 AND NOT EXISTS (SELECT 1 FROM part q WHERE q.p_brand = p.p_brand AND q.p_size >= 10 AND contains(q.p_name || ' ' || q.p_type, p.p_name))")
def uncovered_results(spark, d):
    """Results that no live row covers by name."""
    p = table(spark, d, "part")
    r = p.where("p_size < 10").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    live = p.where("p_size >= 10").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("name"), F.col("p_brand").alias("brand"))
    return cl.uncovered(r, live, ["brand"])


@query("""WITH h AS (SELECT user_id, event_type, 2 * row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= count(*) OVER (PARTITION BY user_id) AS early FROM events),
    l AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS k FROM h WHERE early GROUP BY 1), p AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS p FROM h WHERE NOT early GROUP BY 1)
    SELECT user_id, array_to_string(list_concat(list_filter(p, lambda x: NOT list_contains(k, x)), list_filter(k, lambda x: list_contains(p, x))), ',') AS ordered, CAST(1 + len(k) + len(p) AS INTEGER) AS calls FROM l JOIN p USING (user_id)""")
def workspace_order(spark, d):
    """Saved orders, of the first half of each user's events, with the ids that the second half adds first."""
    own = Window.partitionBy("user_id")
    e = events(spark, d).withColumn("early", 2 * F.row_number().over(own.orderBy("event_id")) <= F.count("*").over(own))
    a = e.where("early").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("k"))
    b = e.where("not early").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("p"))
    j = a.join(b, "user_id")
    return j.select("user_id", F.array_join(F.coalesce(cl.reconciled_order(F.col("k"), F.col("p")), F.col("k")), ",").alias("ordered"), (cl.planned_calls(F.array("k", "p")) - 2).alias("calls"))

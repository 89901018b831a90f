"""Event logs and their folds, in batch and as streams with the same result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds that end a task.
TERMINAL = ("completed", "failed", "cancelled")


def numbered(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """log with a dense id per key, from 1."""
    return log.withColumn("id", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def retained(log: DataFrame, key: str, order: list[str], most: int = 8000) -> DataFrame:
    """The last `most` events of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def replay(log: DataFrame, cursors: DataFrame, key: str) -> DataFrame:
    """Events after each reader's cursor (key, after)."""
    return log.join(cursors, key, "left").where(F.col("id") > F.coalesce("after", F.lit(0))).drop("after")


def closed(log: DataFrame, tasks: DataFrame, key: str) -> DataFrame:
    """A synthetic terminal event for each ended task (key, status) whose log has none."""
    has = log.where(F.col("kind").isin(*TERMINAL)).select(key)
    return tasks.where(F.col("status").isin(*TERMINAL)).join(has, key, "left_anti").select(key, F.col("status").alias("kind"))


def monotone(log: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """log with the highest value so far, within 0..100."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("progress", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.max(value).over(w))))


def fold_jobs(log: DataFrame, key: str, seq: str, kind: str, text: Column, most: int = 160_000) -> DataFrame:
    """The state of each key after its events: repeats of a sequence number count once; the last kind, the number of
    step changes, and the output in order, its last `most` characters."""
    e = log.dropDuplicates([key, seq])
    w = Window.partitionBy(key).orderBy(seq)
    e = e.withColumn("_step", (F.lag(kind).over(w).isNull() | (F.lag(kind).over(w) != F.col(kind))).cast("int")).withColumn("_t", text)
    g = e.groupBy(key).agg(F.max_by(kind, seq).alias("last_kind"), F.max(seq).alias("last_seq"), F.sum("_step").alias("steps"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col("_t").alias("t")))), lambda x: x["t"]), "").alias("o"))
    return g.select(key, "last_kind", "last_seq", "steps", F.right("o", F.lit(most)).alias("output"))


def steps(log: DataFrame, key: str, seq: str, kind: str, at: str) -> DataFrame:
    """Runs of one kind: begin, end (the begin of the next run), number of events."""
    w = Window.partitionBy(key).orderBy(seq)
    new = (F.lag(kind).over(w).isNull() | (F.lag(kind).over(w) != F.col(kind))).cast("int")
    run = log.withColumn("_n", new).withColumn("step", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = run.groupBy(key, "step").agg(F.min_by(kind, seq).alias(kind), F.min(at).alias("begin"), F.count("*").alias("events"))
    return g.withColumn("finish", F.lead("begin").over(Window.partitionBy(key).orderBy("step")))


def high_water(log: DataFrame, key: str, seq: str, durable: Column) -> DataFrame:
    """The highest durable sequence number per key; volatile events don't count."""
    return log.groupBy(key).agg(F.max(F.when(durable, F.col(seq))).alias("cursor"), F.count_if(~durable).alias("volatile"))


def coalesce_deltas(deltas: DataFrame, key: list[str], seq: str, most: int = 32_768) -> DataFrame:
    """deltas (key, seq, offset, value): adjacent ones whose offsets follow each other as one, `most` characters each."""
    w = Window.partitionBy(*key).orderBy(seq)
    follows = F.col("offset") == F.lag("offset").over(w) + F.length(F.lag("value").over(w))
    d = deltas.withColumn("_run", F.sum(F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_before", F.sum(F.length("value")).over(Window.partitionBy(*key, "_run").orderBy(seq)) - F.length("value"))
    d = d.withColumn("_part", F.floor(F.col("_before") / most))
    rows = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col("value").alias("v"))))
    return d.groupBy(*key, "_run", "_part").agg(F.min("offset").alias("offset"), F.array_join(F.transform(rows, lambda x: x["v"]), "").alias("value"), F.count("*").alias("merged")).drop("_part").withColumnRenamed("_run", "run")


def split_deltas(deltas: DataFrame, most: int = 32_768) -> DataFrame:
    """Values over `most` characters in parts, with their offsets."""
    n = F.greatest(F.ceil(F.length("value") / most) - 1, F.lit(0)).cast("int")
    d = deltas.withColumn("_i", F.explode(F.sequence(F.lit(0), n)))
    return d.withColumn("offset", F.col("offset") + F.col("_i") * most).withColumn("value", F.substring("value", F.col("_i") * most + 1, F.lit(most))).withColumnRenamed("_i", "part")


def turns(messages: DataFrame, conv: str, order: str, role: str, text: str) -> DataFrame:
    """Turns of conversations: a user message opens one, what follows belongs to it."""
    w = Window.partitionBy(conv).orderBy(order)
    m = messages.withColumn("turn_no", F.sum(F.when(F.col(role) == "user", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("r"), F.col(text).alias("t"))))
    g = m.groupBy(conv, "turn_no").agg(rows.alias("m"))
    said = F.filter("m", lambda x: x["r"] == "assistant")
    return g.select(conv, "turn_no", F.size("m").alias("messages"), F.element_at("m", 1)["o"].alias("first"), F.size(said).alias("answers"), F.length(F.array_join(F.transform(said, lambda x: x["t"]), "\n")).alias("answer_chars"))


def runs_of(messages: DataFrame, conv: str, order: str, kind: str) -> DataFrame:
    """Consecutive messages of one kind: run number, kind, length."""
    w = Window.partitionBy(conv).orderBy(order)
    new = (F.lag(kind).over(w).isNull() | (F.lag(kind).over(w) != F.col(kind))).cast("int")
    return messages.withColumn("_n", new).withColumn("run", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(conv, "run").agg(F.first(kind).alias(kind), F.count("*").alias("n"))


def covers(a: Column, b: Column, ids_a: Column, ids_b: Column) -> Column:
    """Whether one message holds the text and all ids of another."""
    return F.contains(a, b) & (F.size(F.array_except(ids_b, ids_a)) == 0)


def sliding_rate(log: DataFrame, key: str, at: str, amount: str, seconds: int) -> DataFrame:
    """log with the amount per second over the trailing window."""
    t = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(t).rangeBetween(-(seconds * 1_000_000), 0)
    return log.withColumn("rate", F.round(F.sum(amount).over(w) / seconds, 6)).withColumn("events_in_window", F.count("*").over(w))


def merge_snapshot(loaded: DataFrame, snapshot: DataFrame, key: str, id_col: str, order: str) -> DataFrame:
    """Loaded messages older than the snapshot's first that it doesn't hold, then the snapshot's."""
    low = snapshot.groupBy(key).agg(F.min(order).alias("_low"))
    old = loaded.join(low, key, "left").where(F.col("_low").isNull() | (F.col(order) < F.col("_low"))).drop("_low").join(snapshot.select(key, id_col), [key, id_col], "left_anti")
    return old.withColumn("origin", F.lit("loaded")).unionByName(snapshot.withColumn("origin", F.lit("snapshot")))


def merge_live(roster: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Roster (key, name, status) and live state (key, status, output): the roster names, an end sticks, output is the
    live one's."""
    j = roster.select(key, "name", F.col("status").alias("a")).join(live.select(key, F.col("status").alias("b"), "output"), key, "full_outer")
    state = F.when(F.col("a").isin(*TERMINAL), F.col("a")).when(F.col("b").isin(*TERMINAL), F.col("b")).otherwise(F.coalesce("b", "a"))
    return j.select(key, F.coalesce("name", F.concat(F.lit("task "), F.col(key).cast("string"))).alias("name"), state.alias("status"), F.coalesce("output", F.lit("")).alias("output"))


def newest_with(messages: DataFrame, key: str, order: str, payload: str, test: Column) -> DataFrame:
    """The newest payload of each key that passes the test."""
    return messages.where(test).groupBy(key).agg(F.max_by(payload, order).alias(payload), F.max(order).alias(order))


def poll_delay(failures: Column) -> Column:
    """Milliseconds until the next poll: doubled per failure, 10 seconds at most."""
    return F.least(F.lit(10_000.0), F.lit(900.0) * F.pow(F.lit(2.0), failures)).cast("long")


def retry_delay(after: Column, attempt: Column, most: float = 60.0) -> Column:
    """Seconds to wait: as asked, else doubled per attempt; within 0..most."""
    return F.greatest(F.lit(0.0), F.least(F.coalesce(after.try_cast("double"), F.pow(F.lit(2.0), attempt)), F.lit(most)))


def phase(status: Column, current: Column) -> Column:
    """An ended status beats a stale phase."""
    return F.when(status.isin(*TERMINAL), status).otherwise(F.coalesce(current, status))


def quality_verdict(valid: Column, weighted: Column, pending: Column) -> Column:
    return F.when(~valid, "invalid").when(weighted < 0.7, "incomplete").when(pending > 0, "needs_review").otherwise("good")


STATE = "last_seq long, last_kind string, steps long, output string"
FOLDED = "user_id long, last_kind string, last_seq long, steps long, output string"


def stream_fold(stream: DataFrame, most: int = 160_000) -> DataFrame:
    """fold_jobs() over a stream (user_id, event_id, event_type, text): keyed state, one row per key and batch with the
    state after it. Events at or below the last sequence number are repeats and change nothing; of a batch the order
    of arrival doesn't matter."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, kind, count, out = state.get if state.exists else (-1, None, 0, "")
        rows = pd.concat(list(batches)).drop_duplicates("event_id").sort_values("event_id")
        for s, k, t in rows[["event_id", "event_type", "text"]].itertuples(index=False):
            if s > last:
                count += k != kind
                last, kind, out = int(s), k, (out + t)[-most:]
        state.update((last, kind, count, out))
        yield pd.DataFrame([(key[0], kind, last, count, out)], columns=["user_id", "last_kind", "last_seq", "steps", "output"])

    from pyspark.sql.streaming.state import GroupStateTimeout

    return stream.groupBy("user_id").applyInPandasWithState(fold, FOLDED, STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, at: str, kind: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """An extra beside the folds: counts per event-time window and kind, with a watermark for late events."""
    t = stream.withColumn("_t", F.col(at).cast("timestamp")).withWatermark("_t", late)
    return t.groupBy(F.window("_t", width), kind).agg(F.count("*").alias("events"))


class NodeTracker:
    """Complete objects of a top-level `nodes` array in JSON text that arrives in pieces."""

    def __init__(self) -> None:
        self.text, self.at, self.inside = "", 0, False

    def push(self, piece: str) -> list[str]:
        """The objects that this piece completes."""
        self.text += piece
        found = []
        if not self.inside:
            start = self.text.find('"nodes"')
            start = self.text.find("[", start) if start >= 0 else -1
            if start < 0:
                return []
            self.inside, self.at = True, start + 1
        while True:
            depth, quoted, begin = 0, False, None
            for i in range(self.at, len(self.text)):
                c = self.text[i]
                if quoted:
                    quoted = c != '"' or self._escaped(i)
                elif c == '"':
                    quoted = True
                elif c == "{":
                    begin = i if depth == 0 else begin
                    depth += 1
                elif c == "}":
                    depth -= 1
                    if depth == 0:
                        found.append(self.text[begin : i + 1])
                        self.at = i + 1
                        break
                elif c == "]" and depth == 0:
                    return found
            else:
                return found

    def _escaped(self, i: int) -> bool:
        n = 0
        while i - 1 - n >= 0 and self.text[i - 1 - n] == "\\":
            n += 1
        return n % 2 == 1


def streamed_nodes(pieces: DataFrame) -> DataFrame:
    """pieces (call_id, seq, piece): the node objects of each call, in order, by batch. A fold per call."""

    def of_call(pdf: pd.DataFrame) -> pd.DataFrame:
        t, out = NodeTracker(), []
        for s, p in pdf.sort_values("seq")[["seq", "piece"]].itertuples(index=False):
            out += [(pdf["call_id"].iloc[0], s, n) for n in t.push(p)]
        return pd.DataFrame(out, columns=["call_id", "seq", "node"]) if out else pd.DataFrame({"call_id": pd.Series(dtype="int64"), "seq": pd.Series(dtype="int64"), "node": pd.Series(dtype="object")})

    return pieces.groupBy("call_id").applyInPandas(of_call, "call_id long, seq long, node string")


def slices(log: DataFrame, key: str, seq: str, control: Column, most: int = 100) -> DataFrame:
    """Slices in which a client takes in the events of a key: in order, `most` at most, and none goes on behind a control
    event, which is the last of its slice (barrier)."""
    w = Window.partitionBy(key).orderBy(seq)
    before = F.coalesce(F.sum(F.when(control, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = log.withColumn("_control", control).withColumn("stretch", before.cast("long"))
    n = F.row_number().over(Window.partitionBy(key, "stretch").orderBy(seq)) - 1
    return rows.withColumn("slice", F.floor(n / most)).groupBy(key, "stretch", "slice").agg(F.min(seq).alias("first"), F.max(seq).alias("last"), F.count("*").alias("n"), F.bool_or("_control").alias("barrier"))

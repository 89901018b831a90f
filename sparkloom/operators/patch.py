"""Patches, diffs and versions of editable trees and texts."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class PatchError(ValueError):
    """A patch that can't be applied; nothing of it is."""


def apply_patch(nodes: list[dict], operations: list[dict]) -> tuple[list[dict], list[int]]:
    """nodes (dicts with id, parent_id, in pre-order) after all operations, and the numbers of those without effect.

    Operations: add (node), update (target, changes), delete (target, a leaf), move (target, new_parent), position
    (target, before or after a sibling). The tree is held as lists of children, so an operation touches the siblings
    it names and no other node. The first operation that can't be applied raises, and the nodes given stay as they
    were."""
    by_id = {n["id"]: dict(n) for n in nodes}
    below: dict[str | None, list[str]] = {}
    for n in nodes:
        below.setdefault(n.get("parent_id"), []).append(n["id"])
    idle: list[int] = []

    def known(i: str) -> dict:
        if i not in by_id:
            raise PatchError(f"no node {i}")
        return by_id[i]

    def add(n: int, op: dict) -> None:
        new = dict(op["node"])
        if new["id"] in by_id:
            raise PatchError(f"node {new['id']} exists")
        if new.get("parent_id") is None:
            raise PatchError("a second root")
        known(new["parent_id"])
        by_id[new["id"]] = new
        below.setdefault(new["parent_id"], []).append(new["id"])

    def update(n: int, op: dict) -> None:
        node = known(op["target"])
        if all(node.get(k) == v for k, v in op["changes"].items()):
            idle.append(n)
        node.update(op["changes"])

    def delete(n: int, op: dict) -> None:
        node = known(op["target"])
        if below.get(node["id"]) or node["parent_id"] is None:
            raise PatchError(f"{node['id']} is no leaf")
        below[node["parent_id"]].remove(node["id"])
        del by_id[node["id"]]

    def move(n: int, op: dict) -> None:
        node, to = known(op["target"]), op["new_parent"]
        up = to
        while up is not None and up != node["id"]:
            up = by_id[up]["parent_id"] if up in by_id else None
        if up is not None or node["parent_id"] is None:
            raise PatchError(f"{node['id']} can't move below {to}")
        known(to)
        if node["parent_id"] == to:
            idle.append(n)
            return
        below[node["parent_id"]].remove(node["id"])
        below.setdefault(to, []).append(node["id"])
        node["parent_id"] = to

    def position(n: int, op: dict) -> None:
        node, mate = known(op["target"]), op.get("before") or op.get("after")
        if known(mate)["parent_id"] != node["parent_id"] or mate == node["id"]:
            raise PatchError(f"{mate} is no sibling of {node['id']}")
        siblings = below[node["parent_id"]]
        rest = [i for i in siblings if i != node["id"]]
        rest.insert(rest.index(mate) + (0 if op.get("before") else 1), node["id"])
        if rest == siblings:
            idle.append(n)
        below[node["parent_id"]] = rest

    kinds = {"add": add, "update": update, "delete": delete, "move": move, "position": position}
    for n, op in enumerate(operations):
        if op["op"] not in kinds:
            raise PatchError(f"unknown operation {op['op']}")
        kinds[op["op"]](n, op)
    out, todo = [], list(reversed(below.get(None, [])))
    while todo:
        i = todo.pop()
        out.append(by_id[i])
        todo += reversed(below.get(i, []))
    return out, idle


PATCHED = "tree long, pos int, id string, parent_id string, name string, error string"


def apply_patches(nodes: DataFrame, patches: DataFrame) -> DataFrame:
    """Trees (tree, pos, id, parent_id, name) after their patch (tree, idx, operation as JSON): all of it or, with the
    error, nothing. Operations build on each other, so a tree is one group."""

    def of_tree(n: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        before = [{"id": i, "parent_id": None if pd.isna(u) else u, "name": t} for i, u, t in n.sort_values("pos")[["id", "parent_id", "name"]].itertuples(index=False)]
        error = None
        try:
            after, _ = apply_patch(before, [json.loads(o) for o in p.sort_values("idx")["operation"]])
        except PatchError as e:
            after, error = before, str(e)
        return pd.DataFrame([(n["tree"].iloc[0], k, x["id"], x["parent_id"], x["name"], error) for k, x in enumerate(after)], columns=["tree", "pos", "id", "parent_id", "name", "error"])

    own = nodes.select("tree", "pos", "id", "parent_id", "name")
    return own.groupBy("tree").cogroup(patches.select("tree", "idx", "operation").groupBy("tree")).applyInPandas(of_tree, PATCHED)


def sibling_index(nodes: DataFrame, by: list[str], order: str) -> DataFrame:
    return nodes.withColumn("sibling", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)


def effects(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """What became of each row: added, deleted, changed (and which fields); unchanged rows are left out."""
    j = before.select(key, *[F.col(f).alias(f"a_{f}") for f in fields], F.lit(1).alias("_a")).join(after.select(key, *[F.col(f).alias(f"b_{f}") for f in fields], F.lit(1).alias("_b")), key, "full_outer")
    changed = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields])), ",")
    state = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(changed != "", "changed")
    return j.select(key, state.alias("effect"), F.when(state == "changed", changed).otherwise("").alias("fields")).where("effect is not null")


def locality(changes: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """Changed rows that were not declared."""
    return changes.join(declared, key, "left_anti")


def decision_faults(issues: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Issues that don't have exactly one decision: missing, extra or duplicate."""
    d = decisions.groupBy(key).agg(F.count("*").alias("n"))
    j = issues.select(key, F.lit(1).alias("i")).join(d, key, "full_outer")
    return j.select(key, F.when(F.col("i").isNull(), "extra").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").alias("fault")).where("fault is not null")


def ineffective(decisions: DataFrame, changed: DataFrame) -> DataFrame:
    """Accepted decisions (issue_id, nodes array) none of whose nodes changed (node)."""
    hit = decisions.select("issue_id", F.explode("nodes").alias("node")).join(changed, "node", "left_semi").select("issue_id")
    return decisions.where("decision = 'accept'").join(hit, "issue_id", "left_anti")


def fingerprint(df: DataFrame, by: list[str], key: str, fields: list[str]) -> DataFrame:
    """A digest of the rows of each group, sorted by key."""
    rows = F.array_sort(F.collect_list(F.struct(key, *[f for f in fields if f != key])))
    return df.groupBy(*by).agg(F.sha2(F.to_json(rows), 256).alias("digest"), F.count("*").alias("n"))


def cached(keys: DataFrame, own: DataFrame, others: DataFrame, key: str, value: str) -> DataFrame:
    """The first usable value per key: the own cache before those of others, the earlier before the later."""
    u = own.select(key, value, "created_at", F.lit(0).alias("_p")).unionByName(others.select(key, value, "created_at", F.lit(1).alias("_p"))).where(F.col(value).isNotNull())
    best = u.groupBy(key).agg(F.min_by(value, F.struct("_p", "created_at", value)).alias(value))
    return keys.join(best, key, "left").withColumn("hit", F.col(value).isNotNull())


def set_likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays as sets; 1 if both are empty."""
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / u)


def diff_lines(before: str, after: str, cells: int = 1_000_000, lines: int = 5000) -> list[tuple[str, str]] | None:
    """Lines as (same | add | del, text) along a longest common subsequence; null if that would be too large."""
    a, b = before.split("\n") if before else [], after.split("\n") if after else []
    if max(len(a), len(b)) > lines or (len(a) + 1) * (len(b) + 1) > cells:
        return None
    tail = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]  # of the suffixes from here on
    for i in reversed(range(len(a))):
        row, under = tail[i], tail[i + 1]
        for j in reversed(range(len(b))):
            row[j] = 1 + under[j + 1] if a[i] == b[j] else max(under[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append(("same", a[i]))
            i, j = i + 1, j + 1
        elif i < len(a) and (j == len(b) or tail[i + 1][j] >= tail[i][j + 1]):
            out.append(("del", a[i]))
            i += 1
        else:
            out.append(("add", b[j]))
            j += 1
    return out


def diff_column(before: Column, after: Column) -> Column:
    """array(struct(kind, text)) of the lines of two texts."""

    def one(a, b):
        d = diff_lines(a or "", b or "")
        return None if d is None else [{"kind": k, "text": t} for k, t in d]

    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=object)

    return F.pandas_udf(of, "array<struct<kind:string,text:string>>")(before, after)


def diff_stats(diff: Column) -> Column:
    """struct(added, deleted) of a diff."""
    return F.struct(F.size(F.filter(diff, lambda x: x["kind"] == "add")).alias("added"), F.size(F.filter(diff, lambda x: x["kind"] == "del")).alias("deleted"))


def parse_unified(diffs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Lines of unified diffs with their old and new numbers: id, n, kind (hunk, add, del, context), old_no, new_no, text.
    Lines before a file's first hunk, and file headers, are left out."""
    w = Window.partitionBy(id_col).orderBy("n")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    ln = diffs.select(id_col, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    head, hunk = F.col("line").startswith("diff --git"), F.col("line").startswith("@@")
    ln = ln.withColumn("_mark", F.when(head, F.lit("head")).when(hunk, F.lit("hunk"))).withColumn("_in", F.last("_mark", ignorenulls=True).over(run))
    ln = ln.withColumn("_hunk", F.sum(hunk.cast("int")).over(run)).where("_in = 'hunk'")
    kind = F.when(hunk, "hunk").when(F.col("line").startswith("+"), "add").when(F.col("line").startswith("-"), "del").when(F.col("line").startswith(" "), "context")
    ln = ln.withColumn("kind", kind).where("kind is not null")
    inside = Window.partitionBy(id_col, "_hunk").orderBy("n")
    start = [F.first(F.regexp_extract("line", rf"^@@ -(\d+)(?:,\d+)? \+(\d+)", i).try_cast("int")).over(inside) for i in (1, 2)]
    count = [F.count_if(F.col("kind").isin(k, "context")).over(inside.rowsBetween(Window.unboundedPreceding, 0)) for k in ("del", "add")]
    return ln.select(id_col, "n", "kind", F.when(F.col("kind").isin("del", "context"), start[0] + count[0] - 1).cast("int").alias("old_no"), F.when(F.col("kind").isin("add", "context"), start[1] + count[1] - 1).cast("int").alias("new_no"), F.when(hunk, F.col("line")).otherwise(F.substring("line", 2, 1 << 30)).alias("text"))


def source_numbers(ids: Column) -> Column:
    """Numbers in ids, distinct and in order; 1 if there are none."""
    found = F.array_sort(F.array_distinct(F.transform(F.filter(ids, lambda x: x.rlike(r"\d")), lambda x: F.regexp_extract(x, r"(\d+)", 1).cast("int"))))
    return F.when(F.size(found) == 0, F.array(F.lit(1))).otherwise(found)


def last_overlaid(items: Column, status: Column) -> Column:
    """An array of structs (status first) whose last element takes a status."""
    n = F.size(items)
    return F.when(n == 0, items).otherwise(F.concat(F.slice(items, F.lit(1), n - 1), F.array(F.try_element_at(items, F.lit(-1)).withField("status", status))))


def names_by_id(nodes: DataFrame, by: str, order: str) -> DataFrame:
    """A map of id to name per group; of repeated ids the last."""
    last = nodes.groupBy(by, "id").agg(F.max_by("name", order).alias("name"))
    return last.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", "name")))).alias("names"))


def queued(items: Column, item: Column) -> Column:
    """An array of interactions (status first) with a new one behind; the open one before it is closed."""
    return F.array_append(last_overlaid(items, F.when(F.try_element_at(items, F.lit(-1))["status"] == "open", "closed").otherwise(F.try_element_at(items, F.lit(-1))["status"])), item)

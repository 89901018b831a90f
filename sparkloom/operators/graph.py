"""Graphs of named concepts: aggregation, parent scores, ranking and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def exact_mean(c: str) -> Column:
    """A mean that doesn't depend on the order of its rows: summed in whole millionths."""
    return F.sum(F.round(F.col(c) * 1e6).cast("bigint")) / (F.count("*") * 1e6)


def build_nodes(candidates: DataFrame) -> DataFrame:
    """Nodes of candidates (chunk_id, name, definition, confidence): one per key, named by the surest candidate."""
    c = candidates.withColumn("key", tx.narrow_key(F.col("name"))).where("key <> ''")
    definition = F.max(F.when(F.col("definition") != "", F.struct(F.length("definition").alias("n"), F.col("definition").alias("d"))))["d"]
    n = c.groupBy("key").agg(
        F.min(F.struct((-F.col("confidence")).alias("c"), F.col("name").alias("n")))["n"].alias("name"),
        F.coalesce(definition, F.lit("")).alias("definition"),
        F.array_sort(F.collect_set("name")).alias("names"),
        F.round(exact_mean("confidence"), 3).alias("confidence"),
        F.count_distinct("chunk_id").alias("n_chunks"),
    )
    aliases = F.filter("names", lambda x: x != F.col("name"))
    return n.select(F.concat(F.lit("node_"), F.substring(F.sha1("key"), 1, 10)).alias("node_id"), "key", "name", "definition", F.array_join(aliases, "|").alias("aliases"), "confidence", "n_chunks")


def build_edges(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of candidates (source, predicate, target, confidence) between nodes, one per pair and predicate; edges
    to unknown names and from a node to itself go."""
    ids = nodes.select("key", "node_id")
    e = candidates.withColumns({"sk": tx.narrow_key(F.col("source")), "tk": tx.narrow_key(F.col("target"))}).where("sk <> tk")
    # names repeat, so pairs are counted before they meet the node table
    g = e.groupBy("sk", "predicate", "tk").agg(exact_mean("confidence").alias("c"), F.count("*").alias("n"))
    j = g.join(ids.select(F.col("key").alias("sk"), F.col("node_id").alias("source")), "sk").join(ids.select(F.col("key").alias("tk"), F.col("node_id").alias("target")), "tk")
    name = F.concat(F.lit("edge_"), F.substring(F.sha1(F.concat_ws(":", "source", "predicate", "target")), 1, 10))
    return j.select(name.alias("edge_id"), "source", "predicate", "target", F.round("c", 3).alias("confidence"), "n")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with degree, 0 for isolated ones."""
    ends = edges.groupBy(F.col("source").alias("node_id")).count().unionByName(edges.groupBy(F.col("target").alias("node_id")).count())
    d = ends.groupBy("node_id").agg(F.sum("count").alias("degree"))
    return nodes.join(d, "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source").alias("node_id")).unionByName(edges.select(F.col("target").alias("node_id")))
    return nodes.join(ends, "node_id", "left_anti")


def graph_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts of nodes, edges and isolated nodes, share of nodes with a definition."""
    d = degrees(nodes, edges).agg(F.count("*").alias("node_count"), F.count_if(F.col("degree") == 0).alias("isolated_count"), F.count_if(F.col("definition") != "").alias("defined"))
    share = F.when(F.col("node_count") > 0, F.round(F.col("defined") / F.col("node_count"), 3)).otherwise(0.0)
    return d.crossJoin(edges.agg(F.count("*").alias("edge_count"))).select("node_count", "edge_count", "isolated_count", share.alias("defined_share"))


#: How well a parent's role fits a child's; other pairs have .24.
ROLE_FIT = (
    ("branch_topic", "concept", 0.64), ("branch_topic", "principle", 0.64), ("branch_topic", "method", 0.62), ("branch_topic", "process", 0.62),
    ("branch_topic", "formula", 0.56), ("branch_topic", "example", 0.5), ("concept", "example", 0.58), ("concept", "formula", 0.48),
    ("principle", "method", 0.62), ("principle", "formula", 0.6), ("principle", "example", 0.5), ("method", "step", 0.7),
    ("method", "example", 0.58), ("process", "step", 0.78), ("system", "concept", 0.52), ("system", "method", 0.46), ("visual_knowledge", "concept", 0.34),
)


def role_fit(parent: Column, child: Column, parent_origin: Column, parent_is_root: Column) -> Column:
    """The table above; more for structural parents, less for roles that rarely have children. A root fits at .35."""
    table = F.create_map(*[F.lit(x) for p, c, v in ROLE_FIT for x in (f"{p}>{c}", v)])
    v = F.coalesce(F.try_element_at(table, F.concat(parent, F.lit(">"), child)), F.lit(0.24))
    v = v + F.when(parent_origin.isin("abstractive", "structural"), 0.12).otherwise(0.0) - F.when(parent.isin("example", "warning", "formula", "step"), 0.2).otherwise(0.0)
    return F.when(parent_is_root, 0.35).otherwise(F.greatest(F.lit(0.0), F.least(v, F.lit(1.0))))


def suggest_parents(nodes: DataFrame, least: float = 0.28, quota: int = 4) -> DataFrame:
    """Up to `quota` parents per child of nodes (node_id, branch_id, name, definition, role, origin, is_root,
    confidence). Only branch topics and structural nodes of the child's own branch are tried, by an equi-join.

    Nodes that agree in all that a score reads have the same scores. So only kinds of children meet kinds of parents, of
    each of which the first quota + 1 ids can be chosen: a child leaves out itself at most."""
    of_parent, of_child = ["name", "role", "origin", "is_root", "confidence"], ["name", "definition", "role", "confidence"]
    p = nodes.where("(role = 'branch_topic' or origin in ('abstractive', 'structural')) and branch_id is not null and node_id is not null")
    p = top_per(p.select("node_id", "branch_id", *of_parent), ["branch_id", *of_parent], [F.col("node_id")], quota + 1)
    p = p.groupBy("branch_id", *of_parent).agg(F.array_sort(F.collect_list("node_id")).alias("p_ids"))
    p = p.select("p_ids", *[F.col(c).alias(f"p_{c}") for c in ("branch_id", *of_parent)], tx.bigrams(tx.normalized_key(F.col("name"))).alias("p_b"))
    children = nodes.where("not is_root and role <> 'branch_topic' and branch_id is not null")
    kinds = children.select("branch_id", *of_child).distinct().withColumn("b", tx.bigrams(tx.normalized_key(F.col("name"))))
    j = kinds.join(p, F.col("branch_id") == F.col("p_branch_id"))
    holds = F.lower(F.concat_ws(" ", "name", "definition")).contains(F.lower("p_name"))
    v = role_fit(F.col("p_role"), F.col("role"), F.col("p_origin"), F.col("p_is_root")) + 0.14
    v = v + F.when(holds, 0.16).otherwise(0.0) + F.when(F.col("p_confidence") >= F.col("confidence"), 0.03).otherwise(0.0)
    # names add .08 at most: pairs that can't reach `least` go before their sets are compared
    j = j.withColumn("_v", v).where(F.col("_v") + 0.08 >= least - 1e-4)
    v = F.col("_v") + 0.08 * tx.jaccard(F.col("p_b"), F.col("b"))
    scored = j.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(v, F.lit(0.92))), 4)).where(F.col("score") >= least)
    # the first kinds of parents hold all that can be chosen, as each has an id at least
    first = top_per(scored.select("branch_id", *of_child, "score", "p_ids"), ["branch_id", *of_child], [F.desc("score"), F.col("p_ids")[0]], quota + 1)
    met = first.select("branch_id", *of_child, "score", F.explode("p_ids").alias("parent_id"))
    best = top_per(met, ["branch_id", *of_child], [F.desc("score"), F.col("parent_id")], quota + 1)
    best = best.groupBy("branch_id", *of_child).agg(F.collect_list(F.struct("score", "parent_id")).alias("_p"))
    same = F.lit(True)
    for c in ("branch_id", *of_child):
        same = same & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    found = children.alias("x").join(best.alias("y"), same).select(F.col("x.node_id").alias("child_id"), F.explode("y._p").alias("_p"))
    found = found.select("child_id", "_p.*").where("child_id <> parent_id")
    return top_per(found, ["child_id"], [F.desc("score"), F.col("parent_id")], quota).select("parent_id", "child_id", "score", "rank")


def top_per(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows per group, with their rank; Spark cuts to k before it shuffles."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


#: What a class adds to a parent score.
CLASS_BONUS = {"direct_parent": 0.08, "ancestor_only": -0.12, "sibling": -0.35, "cross_link": -0.35, "unrelated": -0.5, "uncertain": -0.5}


def parent_score(score: Column, components: list[Column], penalties: list[Column], kind: Column) -> Column:
    """Half the score, half the mean of the components above 0, less a quarter of each penalty, plus the class's bonus."""
    used = F.filter(F.array(*components), lambda x: x > 0)
    mean = F.when(F.size(used) > 0, F.aggregate(used, F.lit(0.0), lambda s, x: s + x) / F.size(used)).otherwise(score)
    bonus = F.create_map(*[F.lit(x) for kv in CLASS_BONUS.items() for x in kv])
    v = 0.5 * score + 0.5 * mean + F.coalesce(F.try_element_at(bonus, kind), F.lit(0.0))
    for p in penalties:
        v = v - 0.25 * p
    return F.round(F.greatest(F.lit(0.0), F.least(v, F.lit(1.0))), 4)


def best_per_pair(candidates: DataFrame, seq: str) -> DataFrame:
    """The highest score per (parent, child), the first of equal ones."""
    return top_per(candidates, ["parent", "child"], [F.desc("score"), F.col(seq)], 1).drop("rank")


def ranked_parents(candidates: DataFrame, nodes: DataFrame, keep: int = 3, fallback: float = 0.12, tie: str = "parent") -> DataFrame:
    """Best per pair; k formal parents per child, then the best provisional one; a child without any gets the root."""
    best = best_per_pair(candidates.where("parent <> child"), "seq").join(nodes.select(F.col("id").alias("child")), "child", "left_semi").join(nodes.select(F.col("id").alias("parent")), "parent", "left_semi")
    formal = top_per(best.where("not provisional"), ["child"], [F.desc("score"), F.col(tie)], keep)
    spare = top_per(best.where("provisional"), ["child"], [F.desc("score"), F.col(tie)], 1)
    chosen = formal.unionByName(spare).select("parent", "child", "score", "provisional")
    root = nodes.where("is_root").select(F.col("id").alias("parent"))
    lone = nodes.where("not is_root").select(F.col("id").alias("child")).join(chosen, "child", "left_anti")
    return chosen.unionByName(lone.crossJoin(F.broadcast(root.limit(1))).select("parent", "child", F.lit(fallback).alias("score"), F.lit(True).alias("provisional")))


def consensus(votes: DataFrame) -> DataFrame:
    """Per (child, parent): the class and mean score of votes that agree; uncertain and the least score otherwise."""
    g = votes.groupBy("child", "parent").agg(F.count_distinct("classification").alias("k"), F.min("classification").alias("c"), F.avg("score").alias("a"), F.min("score").alias("m"), F.count("*").alias("n_votes"))
    return g.select("child", "parent", F.when(F.col("k") == 1, F.col("c")).otherwise("uncertain").alias("classification"), F.round(F.when(F.col("k") == 1, F.col("a")).otherwise(F.col("m")), 4).alias("score"), "n_votes")


def needs_check(ranked: DataFrame, least: float = 0.78, margin: float = 0.15) -> DataFrame:
    """Children whose best parent scores low or leads by little."""
    w = Window.partitionBy("child").orderBy(F.desc("score"), "parent")
    r = ranked.withColumn("r", F.row_number().over(w)).withColumn("second", F.lead("score").over(w)).where("r = 1")
    lead = F.round(F.col("score") - F.coalesce("second", F.lit(0.0)), 6)
    return r.select("child", "parent", "score", lead.alias("lead"), ((F.col("score") < least) | (lead < margin)).alias("check"))


def settled_votes(first: DataFrame, second: DataFrame, arbiter: DataFrame) -> DataFrame:
    """The arbiter's class where there is one, else the class both votes share, else the first vote's if it is alone."""
    key = ["child", "parent"]
    j = first.select(*key, F.col("classification").alias("a"), F.col("score").alias("x")).join(second.select(*key, F.col("classification").alias("b"), F.col("score").alias("y")), key, "left").join(arbiter.select(*key, F.col("classification").alias("c"), F.col("score").alias("z")), key, "left")
    kind = F.when(F.col("c").isNotNull(), F.col("c")).when(F.col("b").isNull() | (F.col("a") == F.col("b")), F.col("a")).otherwise("uncertain")
    value = F.when(F.col("c").isNotNull(), F.col("z")).when(F.col("b").isNull(), F.col("x")).when(F.col("a") == F.col("b"), (F.col("x") + F.col("y")) / 2).otherwise(F.least("x", "y"))
    return j.select(*key, kind.alias("classification"), F.round(value, 4).alias("score"))


def cross_links(links: DataFrame, nodes: DataFrame, least: float = 0.7, per_source: int = 2) -> DataFrame:
    """links (source, target, relation, score, has_evidence) with what becomes of each: selected, review, over_limit,
    low_score, unknown_end. Best per (source, target, relation), no self loops; two per source in order of score."""
    ids = nodes.select("id")
    best = top_per(links.where("source <> target"), ["source", "target", "relation"], [F.desc("score")], 1).drop("rank")
    known = best.join(ids.select(F.col("id").alias("source"), F.lit(1).alias("s")), "source", "left").join(ids.select(F.col("id").alias("target"), F.lit(1).alias("t")), "target", "left")
    ok = F.col("s").isNotNull() & F.col("t").isNotNull() & (F.col("score") >= least) & F.col("has_evidence")
    n = F.row_number().over(Window.partitionBy("source", ok).orderBy(F.desc("score"), "target", "relation"))
    state = F.when(F.col("s").isNull() | F.col("t").isNull(), "unknown_end").when(F.col("score") < least, "low_score").when(~F.col("has_evidence"), "review").when(n <= per_source, "selected").otherwise("over_limit")
    return known.select("source", "target", "relation", "score", state.alias("state"))


#: Severities from the worst.
SEVERITIES = ("critical", "major", "minor", "info")


def aggregate_issues(issues: DataFrame, most: int = 36) -> DataFrame:
    """The worst report of each issue, ordered by severity, scope and id, the first `most`."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity")), F.lit(0)), F.lit(99))
    one = top_per(issues.withColumn("sev", rank), ["id"], [F.col("sev"), F.col("scope")], 1).drop("rank")
    return one.orderBy("sev", "scope", "id").limit(most)


def unresolved(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """Issues whose latest decision is not accepted, or that have none."""
    last = decisions.groupBy("issue_id").agg(F.max_by("decision", "seq").alias("decision"))
    return issues.join(last, issues.id == last.issue_id, "left").where("decision is null or decision <> 'accept'").select("id", "severity", F.coalesce("decision", F.lit("none")).alias("decision"))


def rank_matches(names: DataFrame, query: str, col: str = "name") -> DataFrame:
    """Names that match: exact 3, prefix 2, substring 1; in that order, then as they were (idx)."""
    n, q = F.lower(col), query.lower()
    score = F.when(n == q, 3).when(n.startswith(q), 2).when(n.contains(q), 1).otherwise(0)
    return names.withColumn("match", score).where("match > 0").orderBy(F.desc("match"), "idx")


def batches(df: DataFrame, by: str, order: list[Column], size: int = 4) -> DataFrame:
    """df with the number of the batch of `size` rows within its group."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1) / size))


def shared_support(edges: DataFrame, units: DataFrame, most: int = 4) -> DataFrame:
    """Per edge (parent, child): up to `most` unit ids that support both ends, and their number. units (id, unit_id)."""
    u = units.groupBy("id").agg(F.collect_set("unit_id").alias("u"))
    j = edges.join(u.select(F.col("id").alias("parent"), F.col("u").alias("a")), "parent", "left").join(u.select(F.col("id").alias("child"), F.col("u").alias("b")), "child", "left")
    both = F.array_sort(F.coalesce(F.array_intersect("a", "b"), F.array().cast("array<bigint>")))
    return j.select("parent", "child", F.size(both).alias("n_shared"), F.array_join(F.slice(both, 1, most), ",").alias("shared"))


#: Roles that head nothing.
NO_PARENTS = ("example", "warning", "formula", "step")


def heuristic_vote(root: Column, parent_role: Column, child_role: Column, parent_branch: Column, child_branch: Column, named: Column, provisional: Column, kind: Column, score: Column) -> Column:
    """struct(classification, score) without a model: by the first rule that fits a candidate (kind, score) of a parent,
    which may be the root, and a child, whose name or definition may hold the parent's name (`named`)."""

    def vote(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("classification"), value.alias("score"))

    def at_least(low: float) -> Column:
        return F.greatest(score, F.lit(low))

    def at_most(high: float, s: Column = score) -> Column:
        return F.least(s, F.lit(high))

    apart = (parent_branch != "") & (child_branch != "") & (parent_branch != child_branch)
    rules = (
        (root & (child_role == "branch_topic"), vote("direct_parent", at_least(0.94))),
        (root, vote("ancestor_only", at_most(0.62, at_least(0.4)))),
        ((parent_role == "branch_topic") & parent_branch.eqNullSafe(child_branch), vote("direct_parent", at_least(0.82))),
        (apart, vote("unrelated", at_most(0.28))),
        (parent_role.isin(*NO_PARENTS), vote("sibling", at_most(0.3))),
        (named, vote("direct_parent", at_least(0.72))),
        (provisional, vote("uncertain", score)),
    )
    found = F.coalesce(*[F.when(test, v) for test, v in rules], F.struct(kind.alias("classification"), score.alias("score")))
    return F.struct(found["classification"].alias("classification"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), found["score"])), 4).alias("score"))


#: What remains of a parent score by the class of its vote.
VOTE_FACTORS = {"ancestor_only": 0.55, "sibling": 0.3, "cross_link": 0.3, "unrelated": 0.1, "uncertain": 0.45}


def with_vote(score: Column, kind: Column, vote: Column) -> Column:
    """A parent score after a verified vote: blended, the more of it if the vote confirms, damped by its class else."""
    blend = F.when(kind == "direct_parent", 0.45 * score + 0.55 * vote).otherwise(0.35 * score + 0.25 * vote)
    factors = F.create_map(*[F.lit(x) for kv in VOTE_FACTORS.items() for x in kv])
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), blend * F.coalesce(F.try_element_at(factors, kind), F.lit(1.0)))), 4)


def scope_ids(arrays: list[Column]) -> Column:
    """The ids of several arrays, distinct and in order."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*arrays))))


def nearest_topic(branches: DataFrame, topics: DataFrame) -> DataFrame:
    """Per branch (branch, path array from itself to the root) the topic of the nearest branch up that has one."""
    up = branches.select("branch", F.posexplode("path").alias("d", "above"))
    return up.join(topics.select(F.col("branch").alias("above"), "topic"), "above").groupBy("branch").agg(F.min_by("topic", "d").alias("topic"))


def revision_pages(issues: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pages that issues (issue_id, pages, node_ids) name, or the nodes (id, pages) that they are about."""
    own = issues.select(F.explode("pages").alias("page"))
    about = issues.select(F.explode("node_ids").alias("id")).join(nodes, "id").select(F.explode("pages").alias("page"))
    return own.unionByName(about).distinct()

"""Pages under review: rules per block and node, review items, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def codes(rules: list[tuple[Column, str]]) -> Column:
    """The codes of the rules that apply, in order."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(t, F.lit(c)) for t, c in rules])))


def formula_issues(text: Column, latex: Column) -> Column:
    """Where a formula's text and its LaTeX don't fit each other."""
    signs = r"[=≈≤≥<>]"
    return codes([
        (F.coalesce(F.trim(latex), F.lit("")) == "", "missing_latex"),
        (F.coalesce(F.trim(text), F.lit("")) == "", "missing_text"),
        (text.rlike(signs) & ~latex.rlike(signs + r"|\\(?:approx|leq|geq|le|ge)"), "relation_lost"),
        (F.regexp_count(latex, F.lit(r"(?<!\\)\{")) != F.regexp_count(latex, F.lit(r"(?<!\\)\}")), "unbalanced_braces"),
    ])


def layout_issues(blocks: DataFrame, by: list[str], order: str, least: float = 0.5) -> DataFrame:
    """blocks (id, category, text, confidence) with the issues of each: repeated ids, empty text, low confidence, a label
    that no formula follows."""
    w = Window.partitionBy(*by).orderBy(order)
    twice = F.count("*").over(Window.partitionBy(*by, "id")) > 1
    nxt = F.lead("category").over(w)
    rules = [(twice, "duplicate_id"), (F.trim("text") == "", "empty_text"), (F.col("confidence") < least, "low_confidence"), ((F.col("category") == "label") & (nxt.isNull() | (nxt != "formula")), "dangling_label")]
    return blocks.withColumn("issues", codes(rules))


def split_valid(items: DataFrame, issues: str) -> tuple[DataFrame, DataFrame]:
    """Rows without issues, and the issues of the others by id (those without an id as one row)."""
    bad = items.where(F.size(issues) > 0).withColumn("id", F.coalesce("id", F.lit("")))
    grouped = bad.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(issues)))).alias("issues"), F.count("*").alias("n"))
    return items.where(F.size(issues) == 0), grouped


#: Issues for which a node may be dropped: codes that end so or hold a label issue.
DISCARDABLE = r":(?:confidence_below_threshold|evidence_not_specific|field_reextract_candidate)$|:label_"


def may_discard(issues: Column) -> Column:
    """There are issues, and all are of the discardable kind."""
    return (F.size(issues) > 0) & F.forall(issues, lambda x: x.rlike(DISCARDABLE))


#: Roles that stay, and words of passages that may go.
KEPT_ROLES = ("definition", "principle", "step", "formula", "warning")
PASSING = r"(?i)简介|介绍|科普|背景|拓展|扩展阅读|延伸阅读|趣闻|导入|历史沿革|人物生平|前言|绪论|了解即可|知识窗|小资料|introduction|background|further reading|fun fact|overview"


def discard_eligible(status: Column, role: Column, importance: Column, category: Column, source: Column) -> Column:
    """Whether a proposal may discard a unit: one in use, of no protected role, that matters little at the edge, or not
    much in a passage whose words say that it is by the way."""
    little = F.when(category == "edge", importance <= 0.35).otherwise((importance <= 0.55) & source.rlike(PASSING))
    return status.isin("uncovered", "covered") & ~F.coalesce(role, F.lit("")).isin(*KEPT_ROLES) & (importance < 0.7) & little


def structure_reviews(edges: DataFrame, gap: float = 0.08) -> DataFrame:
    """Review items of a selected tree (child, parent, score, provisional, second score): provisional edges, near ties,
    children whose candidates disagree on the parent's class."""
    a = edges.where("provisional").select(F.col("child").alias("subject"), F.lit("provisional_edge").alias("kind"), F.lit(0.8).alias("risk"))
    b = edges.where(F.col("second").isNotNull() & (F.round(F.col("score") - F.col("second"), 6) < gap)).select(F.col("child").alias("subject"), F.lit("parent_gap").alias("kind"), F.round(1 - (F.col("score") - F.col("second")), 4).alias("risk"))
    c = edges.groupBy("parent").agg(F.count("*").alias("n")).where("n = 1").select(F.col("parent").alias("subject"), F.lit("weak_abstraction").alias("kind"), F.lit(0.5).alias("risk"))
    return a.unionByName(b).unionByName(c)


#: What reviewers of a role may propose.
PERMITTED = {"structure": ("change_parent", "delete", "keep"), "wording": ("rename", "keep"), "evidence": ("delete", "keep")}


def checked_report(issues: DataFrame, nodes: DataFrame) -> DataFrame:
    """issues (role, action, node, text) with an id from their content and a fault: unknown node or an action that the
    role may not propose; repeats count once."""
    pairs = issues.sparkSession.createDataFrame([(r, a) for r, v in PERMITTED.items() for a in v], "role string, action string")
    j = issues.join(nodes.select(F.col("id").alias("node"), F.lit(1).alias("_n")), "node", "left").join(F.broadcast(pairs.withColumn("_p", F.lit(1))), ["role", "action"], "left")
    ident = F.concat(F.lit("issue_"), F.substring(F.sha1(F.to_json(F.struct("action", "node", "role", "text"))), 1, 10))
    fault = F.when(F.col("_n").isNull(), "unknown_node").when(F.col("_p").isNull(), "not_permitted").otherwise("")
    return j.select(ident.alias("issue_id"), "role", "action", "node", fault.alias("fault")).distinct()


def decision_records(nodes: DataFrame, active: DataFrame, edges: DataFrame) -> DataFrame:
    """Audit rows: each node accepted or rejected, each edge selected."""
    n = nodes.join(active.select("id", F.lit(1).alias("_a")), "id", "left").select(F.concat(F.lit("node:"), F.col("id").cast("string")).alias("subject"), F.when(F.col("_a") == 1, "accepted").otherwise("rejected").alias("decision"))
    return n.unionByName(edges.select(F.concat(F.lit("edge:"), F.col("source").cast("string"), F.lit(">"), F.col("target").cast("string")).alias("subject"), F.lit("selected").alias("decision")))


def subject_of(kind: Column, subjects: Column, root: Column, targets: Column) -> Column:
    """struct(id, what): what a review is about, by its kind: the root, the only selected edge's target (`targets`)
    among its subjects, a cross link, else a node; the first subject, or the root where there is none."""
    first = F.coalesce(F.get(subjects, 0), root)
    lone = F.array_distinct(F.array_intersect(targets, subjects))
    edge = (kind == "competing_parent") & (F.size(lone) == 1)
    what = F.when(kind == "root_choice", "root").when(edge, "tree_edge").when(kind == "cross_link", "cross_link").otherwise("node")
    return F.struct(F.when(kind == "root_choice", root).when(edge, F.get(lone, 0)).otherwise(first).alias("id"), what.alias("what"))


def node_states(nodes: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per node the highest risk of its pending reviews, and its state."""
    r = reviews.where("status = 'pending'").groupBy(F.col("subject").alias("id")).agg(F.max("risk").alias("risk"), F.count("*").alias("pending"))
    j = nodes.select("id").join(r, "id", "left")
    return j.select("id", F.coalesce("risk", F.lit(0.0)).alias("risk"), F.coalesce("pending", F.lit(0)).alias("pending"), F.when(F.col("pending").isNull(), "confirmed").otherwise("needs_review").alias("state"))


#: Actions per kind of review.
ACTIONS = {"provisional_edge": ("keep", "change_parent", "delete"), "parent_gap": ("keep", "change_parent"), "weak_abstraction": ("keep", "rename", "delete")}


def resolution_faults(resolutions: DataFrame, reviews: DataFrame, labels: DataFrame) -> DataFrame:
    """resolutions (review_id, action, branch, label) with the first precondition that fails, or ok: the review is there and
    pending, its kind allows the action, a new label is free in its branch."""
    allowed = F.create_map(*[x for k, v in ACTIONS.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]))])
    j = resolutions.join(reviews.select("review_id", "kind", "status"), "review_id", "left").join(labels.select("branch", F.lower("label").alias("_l"), F.lit(1).alias("_used")).distinct(), (resolutions.branch == labels.branch) & (F.lower(resolutions.label) == F.col("_l")), "left")
    code = F.when(F.col("kind").isNull(), "unknown_review").when(F.col("status") != "pending", "not_pending").when(~F.array_contains(F.try_element_at(allowed, F.col("kind")), F.col("action")), "not_allowed").when((F.col("action") == "rename") & F.col("_used").isNotNull(), "label_taken").otherwise("ok")
    return j.select("review_id", "action", code.alias("code"))


def guidance(nodes: DataFrame, order: str, most: int = 160) -> DataFrame:
    """The first nodes in order with the names of their parents, as a reviewer sees them; the bound is the feature."""
    n = nodes.orderBy(order).limit(most).withColumn("position", F.row_number().over(Window.orderBy(order)))
    return n.join(nodes.select(F.col("id").alias("parent"), F.col("name").alias("parent_name")), "parent", "left").select("id", "name", "parent_name", "position")


def merged_profiles(direct: DataFrame, fallback: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Per expected page: the fallback's result before the direct one's; failed where there is neither."""
    j = expected.select(key).join(direct.select(key, F.col("value").alias("a")), key, "left").join(fallback.select(key, F.col("value").alias("b")), key, "left")
    return j.select(key, F.coalesce("b", "a").alias("value"), F.when(F.coalesce("b", "a").isNull(), "failed").when(F.col("b").isNotNull(), "degraded").otherwise("accepted").alias("status"))


def appended_nodes(have: DataFrame, incoming: DataFrame, identity: str, temp: str) -> DataFrame:
    """incoming with what becomes of each: known (its identity is there), rejected (its temporary id is another node's), new."""
    j = incoming.join(have.select(identity, F.lit(1).alias("_i")).distinct(), identity, "left").join(have.select(temp, F.lit(1).alias("_t")).distinct(), temp, "left")
    return j.select(identity, temp, F.when(F.col("_i") == 1, "known").when(F.col("_t") == 1, "rejected").otherwise("new").alias("state"))


def risk_pages(candidates: DataFrame, accepted: DataFrame) -> DataFrame:
    """Accepted pages that have clean candidates."""
    return candidates.where("clean").select("page").distinct().join(accepted, "page", "left_semi")

"""Main text of web pages by wrapper induction.

Pages of one host share a template. A number of pages of each host are parsed and their DOM trees aligned with each
other by simple tree matching: nodes match if their labels do, and among the children the order-preserving matching
with most matched nodes wins (of equal ones, that with most equal texts). A text that is the same at aligned nodes of
enough pages is template: constant nodes; where texts differ is a slot. The wrapper of a host is its template texts, by
the path to them.

Enough is a third of the aligned pages and three at least, so that one odd page or a second layout doesn't undo what
the others agree on. Pages that are copies of each other are one page here: what two copies share is no template.
Copies are told by what is their own, the texts that at most half of the pages have, not by how much is shared: that
is large where the template is. Under three different pages there is no wrapper.

A page's blocks are then read with its host's wrapper: template texts go, slots stay as content, except in
regions that are no part of an article: by their element (menus, headers, footers, sidebars, forms), or because a whole
class or id names one (`ads`, `cookie-notice`, `top-menu`; but not `overflow-hidden`, `share-prices`). If a page has an
article or main element with text, the content is what it holds; a header inside an article is part of it.

The one bound, a parameter: `exemplars` pages per host are aligned, those of the smallest hashes of the id, pages of up
to `longest` characters before longer ones. Every page is then read whole.

Cases: a null or empty page gives an empty text; a page without a host, or whose host has no wrapper, is read by its
regions alone; repeated rows are read alike; an empty table gives an empty result. Truncated and unbalanced
markup is read as browsers do, roughly. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from itertools import combinations

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, salted_lookup, sized_broadcast, stored
from .dom import MAIN, Node, parse

#: Elements that are no part of an article, and words for such regions in id, class or role.
OUTSIDE = frozenset("nav header footer aside form dialog menu button select".split())
WORDS = frozenset("ad ads advert adverts advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer copyright sidebar aside widget widgets related recommended cookie cookies consent gdpr notice notices alert newsletter subscribe popup modal comment comments disqus respond replies share sharing social toolbar login signup search contentinfo complementary".split())
#: What such a name may have beside them: where a region is, or what it is made of.
BESIDE = frozenset("site page top bottom left right main global primary secondary box bar block container wrapper wrap list item items links section area zone panel slot form button buttons icons bars posts articles stories trail unit".split())
COMMENT = frozenset("comment comments disqus respond replies".split())
#: In an article, its own header, notices and search results are text.
IN_MAIN = WORDS - frozenset("header masthead notice notices alert search copyright".split())
WHOLE = frozenset(("html", "body"))
SEPARATOR = re.compile(r"[^a-z0-9]+")
DEEPEST = 150


def names_region(mark: str, words: frozenset[str] = WORDS) -> bool:
    """Whether one of the names in `mark` says a region: one of the words, alone or put together with others and with
    what may stand beside them. A name with any other part, like `card-related`, says something else."""
    for name in mark.split():
        parts = [p for p in SEPARATOR.split(name) if p and not p.isdigit()]
        if any(p in words for p in parts) and all(p in words or p in BESIDE for p in parts):
            return True
    return False


def outside(node: Node, inside_main: bool) -> bool:
    if node.tag in WHOLE:
        return False
    if node.hidden and not node.holds_main:
        return True
    if node.tag in MAIN:
        return bool(node.mark) and names_region(node.mark, COMMENT)
    if node.holds_main:
        # what holds an article is outside only by a plain name: "sidebar", but not "page-header" or a page-wide form
        return (node.tag in OUTSIDE and node.tag != "form") or any(n in WORDS for n in node.mark.split())
    if inside_main and node.tag == "header":
        return False
    if node.tag in OUTSIDE:
        return True
    return bool(node.mark) and names_region(node.mark, IN_MAIN if inside_main else WORDS)


def below(path: str, node: Node) -> str:
    """The path of node's children: a hash of the labels down to it."""
    return xxhash.xxh64_hexdigest(f"{path}/{node.label}")


def blocks(root: Node) -> list[tuple[str, str, bool]]:
    """(path, text, in an article or main element) of the blocks outside of other regions, in page order."""
    out, todo = [], [(root, "", False)]
    while todo:
        node, path, main = todo.pop()
        if node.tag == "#":
            out.append((path, node.text, main))
        elif not outside(node, main):
            inner = below(path, node)
            todo += [(c, inner, main or node.tag in MAIN) for c in reversed(node.children)]
    return out


def same_tree(a: Node, b: Node) -> bool:
    """Whether two trees are equal in labels and texts."""
    return a.digest == b.digest


def align(a: Node, b: Node, memo: dict | None = None) -> tuple[float, list[tuple[Node, Node]]]:
    """Simple tree matching: its size and the matched nodes. Equal texts count a little more."""
    memo = {} if memo is None else memo
    if a.label != b.label:
        return 0.0, []
    if a.tag == "#":
        return (1.001 if a.text == b.text else 1.0), [(a, b)]
    key = id(a), id(b)
    if key in memo:
        return memo[key]
    # children that are equal as a whole at both ends match each other; the middle is tried in every order-preserving way
    rows, columns = a.children, b.children
    total, pairs = 1.0, [(a, b)]
    ends = []
    while rows and columns and same_tree(rows[0], columns[0]):
        ends.append((rows[0], columns[0]))
        rows, columns = rows[1:], columns[1:]
    while rows and columns and same_tree(rows[-1], columns[-1]):
        ends.append((rows[-1], columns[-1]))
        rows, columns = rows[:-1], columns[:-1]
    for x, y in ends:
        value, matched = align(x, y, memo)
        total += value
        pairs += matched
    best = [[0.0] * (len(columns) + 1) for _ in range(len(rows) + 1)]
    for i, x in enumerate(rows, 1):
        up, now = best[i - 1], best[i]
        for j, y in enumerate(columns, 1):
            value = up[j] if up[j] >= now[j - 1] else now[j - 1]
            if x.label == y.label:
                both = up[j - 1] + align(x, y, memo)[0]
                value = both if both > value else value
            now[j] = value
    i, j = len(rows), len(columns)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            pairs += align(rows[i - 1], columns[j - 1], memo)[1]
            i, j = i - 1, j - 1
    memo[key] = total + best[-1][-1], pairs
    return memo[key]


def depth(root: Node) -> int:
    deepest, todo = 0, [(root, 1)]
    while todo:
        node, d = todo.pop()
        deepest = max(deepest, d)
        todo += [(c, d + 1) for c in node.children]
    return deepest


def distinct_pages(trees: list[Node]) -> list[Node]:
    """trees without copies of earlier ones: pages without texts of their own, or that share half of them. A text is a
    page's own if at most half of the pages have it at that path."""
    texts = [{(p, t) for p, t, _ in blocks(tree)} for tree in trees]
    times = Counter(x for own in {frozenset(t) for t in texts} for x in own)
    half = len({frozenset(t) for t in texts}) / 2
    kept, seen = [], []
    for tree, have in zip(trees, texts):
        own = {x for x in have if times[x] <= half}
        if own and not any(2 * len(own & s) >= min(len(own), len(s)) for s in seen):
            kept.append(tree)
            seen.append(own)
    return kept


def induce(pages: list[str], least: int = 3) -> dict[str, list[str]]:
    """The wrapper of pages of one host: template texts by path; empty if under `least` of them differ."""
    trees = distinct_pages([t for t in map(parse, pages) if depth(t) <= DEEPEST])
    if len(trees) < least:
        return {}
    # at how many other pages' aligned nodes each text is the same
    constant: Counter = Counter()
    for a, b in combinations(trees, 2):
        for x, y in align(a, b)[1]:
            if x.tag == "#" and x.text == y.text:
                constant[id(x)] += 1
                constant[id(y)] += 1
    enough = max(least, -(-len(trees) // 3)) - 1
    found: dict[str, set[str]] = {}
    for tree in trees:
        todo = [(tree, "")]
        while todo:
            node, path = todo.pop()
            if node.tag == "#" and constant[id(node)] >= enough:
                found.setdefault(path, set()).add(node.text)
            elif node.children:
                inner = below(path, node)
                todo += [(c, inner) for c in node.children]
    return {k: sorted(v) for k, v in found.items()}


def main_text(page: str | None, template: dict[str, list[str]] | None = None) -> str:
    if not page:
        return ""
    kept = [b for b in blocks(parse(page)) if not template or b[1] not in template.get(b[0], ())]
    if any(main for _, _, main in kept):
        kept = [b for b in kept if b[2]]
    return "\n".join(t for _, t, _ in kept)


def host_of(url: Column) -> Column:
    """The host in lower case; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def induce_all(pages: DataFrame, exemplars: int = 9, longest: int = 100_000, salts: int = 32) -> DataFrame:
    """(host, template) of pages (_id, host, html); the template is JSON. Hosts without one are left out."""
    order = ["_long", "_at", "_id"]
    usable = pages.where(F.col("host").isNotNull() & (F.length("html") > 0)).select("host", "_id", (F.length("html") > longest).alias("_long"), F.xxhash64("html", "_id").alias("_at")).distinct()
    # first of each part of a host, then of the host: no task sees all pages of one
    usable = usable.withColumn("_salt", F.pmod(F.col("_at"), F.lit(salts)))
    parts = usable.withColumn("_r", F.row_number().over(Window.partitionBy("host", "_salt").orderBy(*order))).where(F.col("_r") <= exemplars)
    first = parts.withColumn("_r", F.row_number().over(Window.partitionBy("host").orderBy(*order))).where(F.col("_r") <= exemplars)
    chosen = stored(first.select("host", "_id", "_at").distinct(), "exemplars")
    keyed = pages.withColumn("_at", F.xxhash64("html", "_id"))
    same_id = keyed["_id"].eqNullSafe(F.col("_i"))
    read = keyed.join(sized_broadcast(chosen.select(F.col("host").alias("_h"), F.col("_id").alias("_i"), F.col("_at").alias("_a"))), (F.col("host") == F.col("_h")) & (F.col("_at") == F.col("_a")) & same_id, "left_semi")
    # a repeated row is one page
    read = read.select("host", "_at", "html").dropDuplicates(["host", "_at"])

    def of_host(pdf: pd.DataFrame) -> pd.DataFrame:
        found = induce(pdf.sort_values("_at")["html"].drop_duplicates().tolist())
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "template": [json.dumps(found)]})

    return stored(read.groupBy("host").applyInPandas(of_host, "host string, template string").where("template <> '{}'"), "wrappers")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most_broadcast: int = 16 << 20) -> DataFrame:
    """Per page: id, url, text, n_chars."""
    read = pages.select(col(id_col).alias("_id"), col(url_col).alias("_url"), host_of(col(url_col)).alias("host"), col(html_col).alias("html"))
    templates = induce_all(read)

    @F.pandas_udf("string")
    def text_of(html: pd.Series, template: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for h, t in zip(html, template):
            if t is not None and t not in known:
                known[t] = {k: frozenset(v) for k, v in json.loads(t).items()}
            out.append(main_text(h, known.get(t)))
        return pd.Series(out, dtype=object)

    size = templates.agg(F.coalesce(F.sum(F.length("host") + F.length("template")), F.lit(0))).first()[0]
    joined = read.join(F.broadcast(templates), "host", "left") if size <= most_broadcast else salted_lookup(read, templates, "host", F.col("_id"))
    done = joined.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), text_of("html", "template").alias("text"))
    return done.withColumn("n_chars", F.length("text").cast("bigint"))

"""Documents as tables of blocks: text, Markdown, HTML and layout JSON; gates and digests of files.

Every block has an explicit ordinal, made when the document is read. Binary formats (PDF, slides, word processors)
are decoded outside; what these functions take is their output table.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans.folds import fold

#: Suffixes that can be parsed, as bundle kinds.
KINDS = {"txt": "text", "md": "text", "docx": "text", "pdf": "visual", "pptx": "visual"}


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def text_blocks(docs: DataFrame, id_col: str, text_col: str, separator: str = r"\n\s*\n") -> DataFrame:
    """Blocks of plain text or Markdown: doc_id, ordinal, text, heading. A block that begins with # sets the heading
    of the blocks from it on; blocks without text are left out."""
    parts = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), separator)).alias("ordinal", "text"))
    parts = parts.withColumn("text", tx.strip(F.col("text"))).where("text <> ''")
    own = F.when(F.col("text").startswith("#"), F.trim(F.regexp_replace(F.element_at(F.split("text", "\n"), 1), "^#+", "")))
    w = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("heading", F.last(own, ignorenulls=True).over(w))


def parse(files: DataFrame) -> DataFrame:
    """files (path, text): doc_id, title, kind, n_blocks, error. The first code that applies is the error."""
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[suffix(F.col("path"))]
    named = files.withColumn("kind", kind)
    blocks = text_blocks(named, "path", "text").groupBy("doc_id").agg(F.count("*").alias("n"), F.min_by("heading", "ordinal").alias("title"))
    stem = F.regexp_replace(F.regexp_replace("path", r"^.*/", ""), r"\.[^.]*$", "")
    joined = named.join(blocks, F.col("path") == F.col("doc_id"), "left")
    return joined.select(
        F.col("path").alias("doc_id"), F.coalesce("title", stem).alias("title"), "kind", F.coalesce("n", F.lit(0)).alias("n_blocks"),
        F.when(F.col("kind").isNull(), "unsupported").when(F.coalesce("n", F.lit(0)) == 0, "empty").alias("error"),
    )


def bundle_kind(kinds: DataFrame, by: str) -> DataFrame:
    """Per bundle: visual, text or mixed."""
    return kinds.groupBy(by).agg(F.collect_set("kind").alias("k")).select(by, F.when(F.size("k") > 1, "mixed").otherwise(F.element_at("k", 1)).alias("kind"))


def bundle_offsets(sources: DataFrame, by: str, order: str, count: str) -> DataFrame:
    """sources with block_start (inclusive) and block_end (exclusive) in their bundle."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(count).over(w)
    return sources.withColumn("block_end", total).withColumn("block_start", total - F.col(count))


def combined(sources: DataFrame, by: str, order: str) -> DataFrame:
    """Bundle header: first title, names joined in order, digest of the source ids in order."""
    rows = F.array_sort(F.collect_list(F.struct(order, "name", "doc_id", "title")))
    one = sources.groupBy(by).agg(rows.alias("r"))
    title = F.element_at(F.filter(F.transform("r", lambda x: x["title"]), lambda t: t.isNotNull()), 1)
    return one.select(by, F.when(F.exists("r", lambda x: x["title"].isNotNull()), title).alias("title"), F.array_join(F.transform("r", lambda x: x["name"]), ", ").alias("names"), F.sha2(F.array_join(F.transform("r", lambda x: x["doc_id"].cast("string")), "\n"), 256).alias("bundle_id"))


def slide_blocks(shapes: DataFrame) -> DataFrame:
    """shapes (doc_id, slide, idx, is_title, top, left, text): a block per slide, titles first, then by place; a
    text that differs from an earlier one in case only is left out."""
    order = (F.col("is_title").desc(), F.col("top"), F.col("left"), F.col("idx"))
    first = F.row_number().over(Window.partitionBy("doc_id", "slide", F.lower("text")).orderBy(*order))
    kept = shapes.withColumn("r", first).where("r = 1 and trim(text) <> ''")
    place = F.struct((~F.col("is_title")).alias("a"), F.col("top").alias("b"), F.col("left").alias("c"), F.col("idx").alias("d"), F.col("text").alias("t"))
    return kept.groupBy("doc_id", "slide").agg(F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["t"]), "\n").alias("text"))


def table_text(cells: Column) -> Column:
    """A table row as text."""
    return F.array_join(F.transform(cells, lambda c: F.trim(c)), " | ")


def better_of(a: Column, b: Column) -> Column:
    """Of two extractions, the second if the first is weak and the second scores higher."""
    return F.when(tx.is_low_quality(a) & (tx.math_score(b) > tx.math_score(a)), b).otherwise(a)


#: Signatures by suffix, in hex.
SIGNATURES = {"pdf": "25504446", "png": "89504E47", "pptx": "504B0304", "docx": "504B0304"}


def upload_error(path: Column, content: Column, most: int = 50 << 20) -> Column:
    """The first failing check of an upload: its code, or null."""
    s = suffix(path)
    signature = F.create_map(*[F.lit(x) for kv in SIGNATURES.items() for x in kv])[s]
    return F.coalesce(
        F.when(~s.isin(*KINDS, "png"), "suffix"),
        F.when(F.length(content) == 0, "empty"),
        F.when(F.length(content) > most, "too_large"),
        F.when(signature.isNotNull() & ~F.startswith(F.hex(content), signature), "signature"),
        F.when(s.isin("txt", "md") & F.contains(F.hex(F.substring(content, 1, 1024)), F.lit("00")) & (F.locate("\x00", content.cast("string")) > 0), "nul_bytes"),
        F.when(s.isin("txt", "md") & F.try_validate_utf8(content.cast("string")).isNull(), "encoding"),
    )


def archive_issues(entries: DataFrame, most: int = 500 << 20, ratio: float = 100.0) -> DataFrame:
    """entries (file, name, size, packed): totals, ratio and the first issue of each archive."""
    t = entries.groupBy("file").agg(F.sum("size").alias("size"), F.sum("packed").alias("packed"), F.count_if(F.col("name") == "[Content_Types].xml").alias("markers"))
    r = F.col("size") / F.greatest(F.col("packed"), F.lit(1))
    return t.withColumn("ratio", r).withColumn("issue", F.when(F.col("size") > most, "too_large").when(r > ratio, "bomb").when(F.col("markers") == 0, "no_marker"))


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files below path, one per content (the first path in order): path, length, digest."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    named = found.select("path", "length", F.sha2("content", 256).alias("digest"))
    return named.groupBy("digest").agg(F.min("path").alias("path"), F.first("length").alias("length"))


def verify_manifest(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Artifacts whose size or digest differs, that are missing, or that are not in the manifest."""
    j = manifest.alias("m").join(actual.alias("a"), "name", "full_outer")
    issue = F.when(F.col("a.digest").isNull(), "missing").when(F.col("m.digest").isNull(), "unexpected").when(F.col("m.size") != F.col("a.size"), "size").when(F.col("m.digest") != F.col("a.digest"), "digest")
    return j.select("name", issue.alias("issue")).where("issue is not null")


def remap_pages(pages: DataFrame, chosen: DataFrame, by: str = "doc_id") -> DataFrame:
    """The chosen pages, numbered densely from 1."""
    kept = pages.join(chosen, [by, "page"], "left_semi")
    return kept.withColumn("new_page", F.row_number().over(Window.partitionBy(by).orderBy("page")))


BREAKS = frozenset("p div li tr h1 h2 h3 h4 h5 h6 section article header footer table ul ol blockquote pre".split())


class _Visible(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.parts.append("\t")
        elif tag in BREAKS:
            self.parts.append("\n")

    def handle_data(self, data):
        self.parts.append(data)


def visible(source: str | None) -> str:
    """All text of a page by lines: breaks and ends of blocks end lines, cells end in tabs, script text stays."""
    p = _Visible()
    p.feed(source or "")
    p.close()
    lines = (re.sub(r"[ \t]*\t[ \t]*", "\t", re.sub(r"[ \xa0]+", " ", x)).strip() for x in "".join(p.parts).split("\n"))
    return "\n".join(x for x in lines if x)


def visible_html(source: Column) -> Column:
    def of(pages: pd.Series) -> pd.Series:
        return pd.Series([visible(x) for x in pages], dtype=object)

    return F.pandas_udf(of, "string")(source)


def layout_blocks(layouts: DataFrame) -> DataFrame:
    """layouts (doc_id, page, width, height, confidence, json): blocks with boxes scaled to 0..1 whatever the scale
    they come in (pixels, thousandths or shares); figures without text are left out; a block without a confidence has
    its page's; valid says whether the box is one."""
    item = "array<struct<category:string,text:string,bbox:array<double>,confidence:double>>"
    j = F.trim("json")
    rows = F.when(j.startswith("["), F.from_json(j, item)).otherwise(F.from_json(F.get_json_object(j, "$.blocks"), item))
    b = layouts.select("doc_id", "page", "width", "height", F.col("confidence").alias("page_confidence"), F.posexplode(rows).alias("ordinal", "b"))
    top = F.array_max("b.bbox")
    scale_x = F.when(top <= 1, 1.0).when((F.array_max("b.bbox") <= 1000) & F.col("width").isNull(), 1000.0).otherwise(F.col("width"))
    scale_y = F.when(top <= 1, 1.0).when((F.array_max("b.bbox") <= 1000) & F.col("height").isNull(), 1000.0).otherwise(F.col("height"))
    box = F.transform("b.bbox", lambda v, i: F.round(v / F.when(i % 2 == 0, scale_x).otherwise(scale_y), 6))
    b = b.withColumn("bbox", box).withColumn("confidence", F.coalesce("b.confidence", "page_confidence"))
    ok = (F.size("bbox") == 4) & (F.get("bbox", 0) < F.get("bbox", 2)) & (F.get("bbox", 1) < F.get("bbox", 3)) & (F.array_min("bbox") >= 0) & (F.array_max("bbox") <= 1)
    return b.where("not (b.category = 'figure' and coalesce(trim(b.text), '') = '')").select("doc_id", "page", "ordinal", F.col("b.category").alias("category"), F.col("b.text").alias("text"), "bbox", "confidence", ok.alias("valid"))


def near_assets(assets: DataFrame, most: int = 3) -> DataFrame:
    """assets (deck, slide, idx, hash in 16 hex digits) with action: of a near copy of an earlier canonical asset
    within `most` bits, dropped on the same slide and reuse on another; kept otherwise. A fold per deck."""

    def of_deck(rows: list[dict]) -> list[tuple]:
        canon: list[tuple[int, int, int]] = []
        out = []
        for r in rows:
            v = int(r["hash"], 16)
            near = next((c for c in canon if (c[0] ^ v).bit_count() <= most), None)
            if near is None:
                canon.append((v, r["slide"], r["idx"]))
            action = "kept" if near is None else ("dropped" if near[1] == r["slide"] else "reuse")
            out.append((r["deck"], r["slide"], r["idx"], action, r["idx"] if near is None else near[2]))
        return out

    return fold(assets.select("deck", "slide", "idx", "hash"), ["deck"], ["slide", "idx"], of_deck, "deck long, slide int, idx int, action string, canonical int")


def concatenated(sources: DataFrame, blocks: DataFrame, by: str) -> DataFrame:
    """Blocks of several sources (by, idx, name, doc_id) as one document each: in order of source and block, headings
    prefixed by the source's name."""
    j = blocks.join(sources.select(by, "idx", "name", "doc_id"), "doc_id")
    n = F.row_number().over(Window.partitionBy(by).orderBy("idx", "ordinal")) - 1
    return j.select(by, n.alias("ordinal"), "text", F.concat(F.lit("["), F.col("name"), F.lit("]"), F.coalesce(F.concat(F.lit(" "), F.col("heading")), F.lit(""))).alias("heading"))


def upload_totals(uploads: DataFrame, by: str) -> DataFrame:
    """Per job: files, bytes, pages, digest of the files in order. uploads (idx, content, pages)."""
    parts = F.array_sort(F.collect_list(F.struct("idx", F.sha2("content", 256).alias("d"))))
    return uploads.groupBy(by).agg(F.count("*").alias("files"), F.sum(F.length("content")).alias("bytes"), F.sum("pages").alias("pages"), F.sha2(F.array_join(F.transform(parts, lambda x: x["d"]), ""), 256).alias("digest"))


def export_json(df: DataFrame, key: str) -> DataFrame:
    """Each row as JSON under its key, fields in alphabetical order."""
    return df.select(key, F.to_json(F.struct(*sorted(df.columns))).alias("json"))

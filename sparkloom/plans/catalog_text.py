"""Queries over text: sources, text functions, segmentation, resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import graph as gr
from ..operators import resolve as rs
from ..operators import segment as sg
from ..sources import documents as sd
from .registry import query, table
from .storage import stored

#: Blocks of documents in DuckDB: the lines of a text that aren't blank.
BLOCKS = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ordinal FROM documents),
        blocks AS (SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, trim(text) AS text FROM lines WHERE trim(text) <> '')"""


def blocks(spark, d) -> DataFrame:
    return sd.text_blocks(table(spark, d, "documents"), "doc_id", "text", "\n")


@query(f"WITH {BLOCKS} SELECT *, CAST(NULL AS VARCHAR) AS heading FROM blocks")
def text_blocks(spark, d):
    """Lines of documents as blocks with ordinals and headings."""
    return blocks(spark, d)


@query("SELECT source, CASE WHEN count(DISTINCT lang = 'en') > 1 THEN 'mixed' WHEN bool_and(lang = 'en') THEN 'text' ELSE 'visual' END AS kind FROM documents GROUP BY source")
def bundle_kind(spark, d):
    """Kind of each source's bundle."""
    kinds = table(spark, d, "documents").select("source", F.when(F.col("lang") == "en", "text").otherwise("visual").alias("kind"))
    return sd.bundle_kind(kinds, "source")


@query("""SELECT source, doc_id, n_blocks, CAST(sum(n_blocks) OVER w AS BIGINT) AS block_end, CAST(sum(n_blocks) OVER w - n_blocks AS BIGINT) AS block_start
    FROM (SELECT source, doc_id, len(string_split(text, chr(10))) AS n_blocks FROM documents) WINDOW w AS (PARTITION BY source ORDER BY doc_id)""")
def bundle_offsets(spark, d):
    """Cumulative block ranges of the documents of a source."""
    n = table(spark, d, "documents").select("source", "doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_blocks"))
    return sd.bundle_offsets(n, "source", "doc_id", "n_blocks")


@query("""SELECT user_id AS bundle, min_by(event_type, event_id) AS title, string_agg(event_type, ', ' ORDER BY event_id) AS names, sha256(string_agg(CAST(event_id AS VARCHAR), chr(10) ORDER BY event_id)) AS bundle_id FROM events GROUP BY user_id""")
def bundle_header(spark, d):
    """Header of each bundle: first title, names, digest of its parts."""
    e = table(spark, d, "events").select(F.col("user_id").alias("bundle"), F.col("event_id").alias("idx"), F.col("event_type").alias("name"), F.col("event_id").alias("doc_id"), F.col("event_type").alias("title"))
    return sd.combined(e, "bundle", "idx")


@query()
def visible_html(spark, d):
    """Visible text of pages by lines, script text included."""
    p = table(spark, d, "pages").select("page_id", sd.visible_html("html").alias("text"))
    return p.select("page_id", "text", F.size(F.split("text", "\n")).alias("n_lines"))


@query("""SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'suffix' WHEN octet_length(encode(text)) = 0 THEN 'empty' WHEN octet_length(encode(text)) > 8000 THEN 'too_large' WHEN doc_id % 50 = 1 THEN 'signature' END AS error FROM documents""")
def upload_checks(spark, d):
    """The first failing check of each upload; some are named as what they are not."""
    docs = table(spark, d, "documents")
    name = F.when(F.col("doc_id") % 50 == 0, "a.exe").when(F.col("doc_id") % 50 == 1, "a.pdf").otherwise("a.txt")
    return docs.select("doc_id", sd.upload_error(name, F.encode("text", "UTF-8"), 8000).alias("error"))


@query("""WITH t AS (SELECT l_orderkey AS file, CAST(sum(CAST(l_quantity AS BIGINT) * 1000) AS BIGINT) AS size, CAST(sum(CAST(round(l_tax * 1000) AS BIGINT)) AS BIGINT) AS packed, count(*) FILTER (l_linenumber = 1) AS markers FROM lineitem GROUP BY 1)
    SELECT *, CAST(size AS DOUBLE) / greatest(packed, 1) AS ratio, CASE WHEN size > 150000 THEN 'too_large' WHEN CAST(size AS DOUBLE) / greatest(packed, 1) > 1000 THEN 'bomb' WHEN markers = 0 THEN 'no_marker' END AS issue FROM t""")
def archive_checks(spark, d):
    """Totals, ratio and first issue of archives, with lines of orders as entries."""
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.when(F.col("l_linenumber") == 1, "[Content_Types].xml").otherwise("x").alias("name"), (F.col("l_quantity").cast("long") * 1000).alias("size"), F.round(F.col("l_tax") * 1000).cast("long").alias("packed"))
    return sd.archive_issues(e, 150_000, 1000.0)


@query("""WITH m AS (SELECT p_name AS name, count(*) AS size, max(p_brand) AS digest FROM part WHERE p_size < 40 GROUP BY 1), a AS (SELECT p_name AS name, count(*) AS size, max(p_brand) AS digest FROM part WHERE p_size > 10 GROUP BY 1)
    SELECT name, CASE WHEN a.digest IS NULL THEN 'missing' WHEN m.digest IS NULL THEN 'unexpected' WHEN m.size <> a.size THEN 'size' ELSE 'digest' END AS issue FROM m FULL JOIN a USING (name) WHERE a.digest IS NULL OR m.digest IS NULL OR m.size <> a.size OR m.digest <> a.digest""")
def manifest_check(spark, d):
    """A manifest against what is there."""
    p = table(spark, d, "part")

    def part(test):
        return p.where(test).groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("size"), F.max("p_brand").alias("digest"))

    return sd.verify_manifest(part("p_size < 40"), part("p_size > 10"))


@query("""SELECT l_orderkey AS doc_id, l_linenumber AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS new_page FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_returnflag = 'R'))""")
def remapped_pages(spark, d):
    """Chosen pages numbered densely."""
    li = table(spark, d, "lineitem")
    pages = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page")).distinct()
    chosen = li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page")).distinct()
    return sd.remap_pages(pages, chosen)


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, lower(text) ORDER BY role = 'system' DESC, length(text), turn) AS r FROM conversations)
    SELECT conv_id AS doc_id, role AS slide, string_agg(text, chr(10) ORDER BY role <> 'system', length(text), turn) AS text FROM k WHERE r = 1 AND trim(text) <> '' GROUP BY ALL""")
def slide_blocks(spark, d):
    """Shapes of a slide as one block, titles first, repeats left out."""
    c = table(spark, d, "conversations")
    return sd.slide_blocks(c.select(F.col("conv_id").alias("doc_id"), F.col("role").alias("slide"), F.col("turn").alias("idx"), (F.col("role") == "system").alias("is_title"), F.length("text").alias("top"), F.lit(0).alias("left"), "text"))


_KEY = r"[\s·•,，。；;:：()（）【】\[\]{}《》<>_-]+"
_NARROW = r"[\s·•,，。；;:：()（）_-]+"


@query(f"""WITH {BLOCKS} SELECT doc_id, ordinal, lower(regexp_replace(text, '{_KEY}', '', 'g')) AS name_key, lower(regexp_replace(text, '{_NARROW}', '', 'g')) AS narrow, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS prose FROM blocks""")
def block_keys(spark, d):
    """Keys of each block: wide, narrow, prose."""
    t = F.col("text")
    return blocks(spark, d).select("doc_id", "ordinal", tx.normalized_key(t).alias("name_key"), tx.narrow_key(t).alias("narrow"), tx.prose(t).alias("prose"))


@query(f"""WITH {BLOCKS}, c AS (SELECT *, regexp_replace(text, '\\s+', '', 'g') AS s FROM blocks),
    f AS (SELECT *, CASE WHEN regexp_matches(s, '[=≈≃≅≤≥<>]') THEN regexp_matches(regexp_replace(s, '[=≈≃≅≤≥<>].*$', ''), '[\\p{{L}}\\p{{N}}_]') AND regexp_matches(regexp_replace(s, '^.*?[=≈≃≅≤≥<>]', ''), '[\\p{{L}}\\p{{N}}_]') ELSE FALSE END AS formula, list_transform(regexp_extract_all(text, '[A-Za-z]+|[Α-ω]+|[㐀-鿿]+'), lambda x: lower(x)) AS t FROM c),
    x AS (SELECT *, NOT formula AND NOT regexp_matches(text, '[㐀-鿿]{{2,}}|[A-Za-z]{{3,}}|[Α-ω]{{2,}}') AND (
        (len(t) >= 2 AND len(list_filter(t, lambda y: y NOT IN ('x','y','z','r','t','o','θ','φ','ϕ','ρ','ψ'))) = 0 AND (len(t) <= 3 OR len(list_distinct(t)) <= greatest(2, len(t) // 2))) OR (len(t) = 0 AND regexp_matches(text, '[^\\p{{L}}\\p{{N}}_\\s]'))) AS axes FROM f)
    SELECT doc_id, ordinal, CASE WHEN regexp_matches(text, '^\\d{{1,4}}$') THEN 'rejected' WHEN formula THEN 'uncovered' WHEN NOT regexp_matches(s, '[\\p{{L}}\\p{{N}}_]') THEN 'rejected' WHEN axes THEN 'deferred' ELSE 'uncovered' END AS status,
        CASE WHEN regexp_matches(text, '^\\d{{1,4}}$') THEN 0.02 WHEN formula THEN NULL WHEN NOT regexp_matches(s, '[\\p{{L}}\\p{{N}}_]') THEN 0.04 WHEN axes THEN 0.1 END::DOUBLE AS ceiling, formula,
        CASE WHEN regexp_matches(text, '^\\d{{1,4}}$') THEN 0 ELSE CAST(8 * len(regexp_extract_all(s, '[=≈≃≅≤≥<>]')) + 4 * len(regexp_extract_all(s, '/')) + 3 * len(regexp_extract_all(text, '(?i)\\d(?:\\.\\d+)?\\s*(?:×|x|\\*)\\s*10\\s*(?:\\^|[-−])?\\s*\\d+')) + least(len(regexp_extract_all(s, '[∫∑Σ√Δλνπħ×÷^]')), 12) AS INTEGER) END AS math FROM x""")
def block_gates(spark, d):
    """Gate and math score of each block."""
    return tx.gates(blocks(spark, d), "text").select("doc_id", "ordinal", "status", "ceiling", "formula", F.col("math_score").cast("int").alias("math"))


@query(f"""WITH {BLOCKS}, h AS (SELECT *, substr(text, 1, 240) AS h FROM blocks)
    SELECT doc_id, ordinal, CASE WHEN regexp_matches(h, '(?i)(is the|are the|is a )') THEN 'definition' WHEN regexp_matches(h, '(?i)(first|then|finally)') THEN 'step' WHEN regexp_matches(h, '(?i)(rule|law|that)') THEN CASE WHEN regexp_matches(h, '[=|]') THEN 'formula' ELSE 'principle' END WHEN regexp_matches(h, '(?i)(for example|such as)') THEN 'example' WHEN regexp_matches(h, '(?i)(note|never|avoid)') THEN 'warning' ELSE 'other' END AS unit_role,
    round(least(0.42 + CASE WHEN ordinal > 0 THEN 0.18 ELSE 0 END + CASE WHEN regexp_matches(substr(text, 1, 500), '(?i)(tion|rule|method|step)') THEN 0.16 ELSE 0 END + least(length(text), 1800) / 1800 * 0.12, 1), 4) AS importance FROM h""")
def block_importance(spark, d):
    """Role and importance of each block under the Latin rules."""
    t = F.col("text")
    head = F.when(F.col("ordinal") > 0, "h")
    return blocks(spark, d).select("doc_id", "ordinal", tx.unit_role(t, tx.LATIN).alias("unit_role"), tx.importance(t, head, tx.LATIN).alias("importance"))


_WORDS = """names AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS name FROM documents)"""


def _names(spark, d):
    return table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("name")).distinct()


def _unbalanced(s: str) -> str:
    """SQL: whether brackets are left after innermost pairs were removed as often as there are pairs."""
    only = f"regexp_replace({s}, '[^()（）\\[\\]【】{{}}《》]', '', 'g')"
    pairs = r"\(\)|（）|\[\]|【】|\{\}|《》"
    rounds = f"list_transform(range(0, CAST(length({only}) // 2 AS BIGINT)), lambda i: '')"
    return f"list_reduce(list_concat([{only}], {rounds}), lambda x, y: regexp_replace(x, '{pairs}', '', 'g')) <> ''"


def _codes(tests: list[tuple[str, str]]) -> str:
    """SQL: the codes whose tests hold, joined."""
    cases = ", ".join(f"CASE WHEN {test} THEN '{code}' END" for code, test in tests)
    return f"array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ',')"


def _listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_RE = "regexp_matches(s, '{}')".format
_KEY = r"lower(regexp_replace(s, '[\s·•,，。；;:：()（）【】\[\]{}《》<>_-]+', '', 'g'))"
_ATOMS = "regexp_extract_all(s, '[A-Za-z]+')"
_LABEL_TESTS = [
    ("too_short", "length(s) < 2"),
    ("too_long", "length(s) > 48"),
    ("multiline", _RE(r"[\n\r]")),
    ("control_character", _RE(r"[\p{Cc}\p{Cf}]")),
    ("control_marker", " OR ".join(f"contains(lower(s), '{m}')" for m in tx.CONTROL_MARKERS)),
    ("generic", f"{_KEY} IN ({_listed(tx.GENERIC)})"),
    ("generic_summary", "ends_with(s, '关键要点')"),
    ("sentence_stem", _RE(tx.SENTENCE_STEM)),
    ("raw_section_echo", _RE(tx.SECTION_ECHO)),
    ("biography_caption", _RE(tx.BIOGRAPHY)),
    ("generic_visual", _RE(tx.GENERIC_VISUAL)),
    ("photo_caption", _RE(tx.PHOTO)),
    ("layout_visual_caption", _RE(tx.LAYOUT_VISUAL)),
    ("standalone_connective", f"s IN ({_listed(tx.CONNECTIVES)})"),
    ("dangling_prefix", "starts_with(s, '的')"),
    ("dangling_suffix", " OR ".join(f"ends_with(s, '{x}')" for x in tx.SUFFIXES)),
    ("truncated_trailing_character", " OR ".join(f"(ends_with(s, '{c}') AND length(s) >= {n})" for c, n in tx.CUT_OFF)),
    ("sentence_fragment", _RE("[，,；;：:。！？!?]$")),
    ("ellipsis", _RE(r"(?:…{1,2}|\.{3,})$")),
    ("placeholder_glyph", _RE("[□�]")),
    ("unbalanced_brackets", _unbalanced("s")),
    ("bare_quantity", _RE(tx.QUANTITY)),
    (
        "spaced_chemical_structure_fragment",
        f"len({_ATOMS}) >= 4 AND NOT {_RE(tx.CJK)} AND NOT {_RE(tx.REACTION)}"
        f" AND len(list_filter({_ATOMS}, lambda w: NOT regexp_matches(w, '^(?:[A-Z][a-z]?)+$') AND lower(w) NOT IN ('r', 'x'))) = 0"
        f" AND len(list_filter({_ATOMS}, lambda w: lower(w) IN ({_listed(tx.LONE_ATOMS)}))) >= 2",
    ),
    ("formula_label_requires_formula_role", f"{_RE(tx.FORMULA_RELATION)} AND NOT regexp_matches(regexp_replace(s, '_{tx.CJK}+', '_x', 'g'), '{tx.CJK}')"),
]


@query(f"""WITH {_WORDS}, n AS (SELECT name, regexp_replace(name, '^[\\s]+|[\\s]+$', '', 'g') AS s FROM names)
    SELECT name, CASE WHEN s = '' THEN 'empty' ELSE {_codes(_LABEL_TESTS)} END AS issues FROM n""")
def label_issues(spark, d):
    """What makes each word unfit as a label."""
    return _names(spark, d).select("name", F.array_join(tx.label_issues(F.col("name")), ",").alias("issues"))


_DEFINITION_TESTS = [("placeholder_glyph", _RE("[□�]")), ("unbalanced_brackets", _unbalanced("s"))] + [
    (code, _RE(pattern) + (f" AND NOT {_RE(tx.PREDICATES)}" if code == "dependent_fragment" else "")) for code, pattern in tx.DEFINITION_PATTERNS.items()
]


@query(f"""WITH {BLOCKS}, d AS (SELECT doc_id, ordinal, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM blocks)
    SELECT doc_id, ordinal, {_codes(_DEFINITION_TESTS)} AS issues FROM d""")
def definition_issues(spark, d):
    """What makes each block unfit as a definition."""
    return blocks(spark, d).select("doc_id", "ordinal", F.array_join(tx.definition_issues(F.col("text")), ",").alias("issues"))


@query("""WITH b AS (SELECT doc_id, text, ordinal, lag(text) OVER (PARTITION BY doc_id ORDER BY ordinal) AS before FROM (WITH """ + BLOCKS + """ SELECT * FROM blocks)),
    n AS (SELECT doc_id, ordinal, list_sort(list_distinct(list_transform(regexp_extract_all(before, '[+\\-]?\\d+(?:\\.\\d+)?'), lambda x: ltrim(x, '+')))) AS a, list_sort(list_distinct(list_transform(regexp_extract_all(text, '[+\\-]?\\d+(?:\\.\\d+)?'), lambda x: ltrim(x, '+')))) AS b FROM b WHERE before IS NOT NULL)
    SELECT doc_id, ordinal, len(a) AS n_before, len(b) AS n_now, len(a) > 0 AND len(b) > 0 AND a <> b AND (NOT list_has_any(a, b) OR (len(a) = 1 AND len(b) = 1)) AS conflict, len(list_filter(b, lambda x: NOT list_contains(a, x))) AS unsupported FROM n""")
def number_conflicts(spark, d):
    """Numbers of each block against those of the block before it."""
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    b = blocks(spark, d).withColumn("before", F.lag("text").over(w)).where("before is not null")
    b = b.withColumn("a", tx.numeric_claims(F.col("before"))).withColumn("b", tx.numeric_claims(F.col("text")))
    return b.select("doc_id", "ordinal", F.size("a").cast("long").alias("n_before"), F.size("b").cast("long").alias("n_now"), tx.numeric_conflict(F.col("a"), F.col("b")).alias("conflict"), F.size(tx.unsupported_numbers(F.col("text"), F.array("before"))).cast("long").alias("unsupported"))


@query("""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents), a AS (SELECT *, instr(lower(f), 'the') - 1 AS i FROM f), c AS (SELECT *, greatest(i - 40, 0) AS a, least(length(f), i + 43) AS b FROM a)
    SELECT doc_id, CASE WHEN i < 0 THEN CASE WHEN length(f) <= 80 THEN f ELSE substr(f, 1, 80) || '…' END ELSE CASE WHEN a > 0 THEN '…' ELSE '' END || substr(f, a + 1, b - a) || CASE WHEN b < length(f) THEN '…' ELSE '' END END AS snippet FROM c""")
def snippets(spark, d):
    """Text around the first hit of a query."""
    return table(spark, d, "documents").select("doc_id", tx.snippet(F.col("text"), "the").alias("snippet"))


@query("""SELECT doc_id, regexp_replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;'), '(an)', '<mark>\\1</mark>', 'gi') AS marked FROM documents""")
def highlights(spark, d):
    """Escaped text with every hit marked."""
    return table(spark, d, "documents").select("doc_id", tx.highlight(F.col("text"), "an").alias("marked"))


def _tenths(t: str, trim: bool) -> str:
    """SQL: tenths as text."""
    rest = f"'.' || ({t}) % 10"
    return f"(({t}) // 10) || " + (f"CASE WHEN ({t}) % 10 = 0 THEN '' ELSE {rest} END" if trim else rest)


def _seconds(ms: str) -> str:
    """SQL: seconds with a tenth, rounded by the exact value of the double."""
    x = f"({ms} / 1000.0::DOUBLE)"
    high = f"(floor({x} * 1048576) / 1048576)"
    up = f"({ms} % 100 > 50 OR ({ms} % 100 = 50 AND ({high} * 1000 - {ms}) + ({x} - {high}) * 1000 >= 0))"
    return _tenths(f"{ms} // 100 + CASE WHEN {up} THEN 1 ELSE 0 END", False)


#: Prices as small and as large numbers, so that every unit and every rounding occurs.
_AMOUNTS = "n AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * CASE WHEN o_orderkey % 3 = 0 THEN 16 ELSE 1 END AS n FROM orders)"


@query(f"""WITH {_AMOUNTS}
    SELECT o_orderkey, CASE WHEN n >= 1048576 THEN {_tenths("(20 * n + 1048576) // 2097152", True)} || 'M' WHEN n >= 102400 THEN ((2 * n + 1024) // 2048) || 'k'
        WHEN n >= 1024 THEN {_tenths("(20 * n + 1024) // 2048", True)} || 'k' ELSE CAST(n AS VARCHAR) END AS tokens,
    CASE WHEN n < 1000 THEN n || 'ms' WHEN n < 60000 THEN {_seconds("n")} || 's' ELSE (n // 60000) || 'm' || {_seconds("(n % 60000)")} || 's' END AS duration FROM n""")
def formats(spark, d):
    """Token counts and durations as people write them."""
    n = table(spark, d, "orders").select("o_orderkey", (F.floor("o_totalprice") * F.when(F.col("o_orderkey") % 3 == 0, 16).otherwise(1)).alias("n"))
    return n.select("o_orderkey", tx.format_tokens(F.col("n")).alias("tokens"), tx.format_duration(F.col("n")).alias("duration"))


@query("""WITH c AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '* * * * *' WHEN 1 THEN '*/' || (user_id % 7 + 1) || ' * * * *' WHEN 2 THEN '0 */' || (user_id % 7 + 1) || ' * * *' WHEN 3 THEN (user_id % 60) || ' ' || (event_id % 24) || ' * * 1-5' ELSE (user_id % 60) || ' ' || (event_id % 24) || ' * * *' END AS cron, user_id % 7 + 1 AS n, lpad(CAST(event_id % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(user_id % 60 AS VARCHAR), 2, '0') AS t FROM events)
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'every minute' WHEN 1 THEN CASE WHEN n = 1 THEN 'every minute' ELSE 'every ' || n || ' minutes' END WHEN 2 THEN 'every ' || n || ' hours' WHEN 3 THEN 'weekdays at ' || t ELSE 'daily at ' || t END AS phrase FROM c""")
def cron_phrases(spark, d):
    """Cron expressions as phrases."""
    e = table(spark, d, "events")
    n, m, h = (F.col("user_id") % 7 + 1).cast("string"), (F.col("user_id") % 60).cast("string"), (F.col("event_id") % 24).cast("string")
    k = F.col("event_id") % 5
    cron = F.when(k == 0, "* * * * *").when(k == 1, F.concat(F.lit("*/"), n, F.lit(" * * * *"))).when(k == 2, F.concat(F.lit("0 */"), n, F.lit(" * * *"))).when(k == 3, F.concat(m, F.lit(" "), h, F.lit(" * * 1-5"))).otherwise(F.concat(m, F.lit(" "), h, F.lit(" * * *")))
    return e.select("event_id", tx.humanize_cron(cron).alias("phrase"))


@query("""SELECT p_partkey, substr(regexp_replace(regexp_replace(p_name || ' ' || p_brand || '/' || p_type, '[^A-Za-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 12) AS slug, 'Brand#' || p_size AS name FROM part""")
def slugs(spark, d):
    """Slugs of part names, and cleaned list items."""
    p = table(spark, d, "part")
    return p.select("p_partkey", tx.slug(F.concat("p_name", F.lit(" "), "p_brand", F.lit("/"), "p_type"), 12).alias("slug"), tx.clean_name(F.concat(F.lit("- Brand#"), F.col("p_size").cast("string"))).alias("name"))


@query()
def reflowed(spark, d):
    """Wrapped lines of messages joined."""
    return table(spark, d, "conversations").select("conv_id", "turn", tx.reflow(F.col("text")).alias("text"))


@query()
def chunk_summary(spark, d):
    """Chunks of documents: number, characters, ids."""
    b = blocks(spark, d).withColumn("page", F.lit(None).cast("int"))
    c = sg.chunks(b)
    return c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest"), F.min_by("chunk_id", "idx").alias("first_chunk"))


def _lines(spark, d):
    """Blocks as chunks: id, heading (the document's source), text."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    return blocks(spark, d).drop("heading").join(docs, "doc_id").select(F.concat_ws(":", "doc_id", "ordinal").alias("chunk_id"), F.col("source").alias("heading"), "text")


def _graph(spark, d):
    nodes, edges = sg.extract(stored(_lines(spark, d), "lines"), sg.LATIN_DEFINITIONS, sg.LATIN_RELATIONS)
    n = stored(gr.build_nodes(nodes), "nodes")
    return n, gr.build_edges(edges, n)


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace({0}, '^(?:\s*#+\s*|\s*[-•●▪◦‣⁃]\s*|\s*(?:\d+|[一二三四五六七八九十]+)[、.)）]\s*)', ''), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_STRIPPED = r"regexp_replace({0}, '^[\s 　]+|[\s 　]+$', '', 'g')"


def _found(pattern: str, group: int) -> str:
    return f"unnest(regexp_extract_all(text, '{pattern}', {group}))"


_RELATED = " UNION ALL ".join(f"SELECT chunk_id, '{predicate}' AS predicate, {i} AS rank, {_found(p, 1)} AS a, {_found(p, 2)} AS b FROM chunk" for i, (predicate, p) in enumerate(sg.LATIN_RELATIONS))
_DEFINED = " UNION ALL ".join(f"SELECT chunk_id, {_found(p, 1)} AS name, {_found(p, 2)} AS d FROM chunk" for p in sg.LATIN_DEFINITIONS)
_MEAN = "sum(CAST(round(confidence * 1000000) AS BIGINT)) / (count(*) * 1000000.0::DOUBLE)"
#: The whole graph in SQL: candidates of each chunk, what stays of them, nodes by key, edges between them.
_TERM_GRAPH = f"""WITH {BLOCKS}, chunk AS (SELECT b.doc_id || ':' || b.ordinal AS chunk_id, d.source AS heading, b.text FROM blocks b JOIN documents d ON d.doc_id = b.doc_id),
    related AS (SELECT chunk_id, predicate, rank, {_CLEAN.format("a")} AS source, {_CLEAN.format("b")} AS target FROM ({_RELATED})),
    first_names AS (SELECT DISTINCT unnest([source, target]) AS s FROM related), good_ends AS (SELECT s FROM first_names WHERE length(s) <= 36 AND s <> '' AND {_codes(_LABEL_TESTS)} = ''),
    relations AS (SELECT * FROM related WHERE source IN (SELECT s FROM good_ends) AND target IN (SELECT s FROM good_ends)),
    raw AS (SELECT chunk_id, heading AS name, 'chapter topic' AS definition, 0.62::DOUBLE AS confidence FROM chunk WHERE heading IS NOT NULL
        UNION ALL SELECT chunk_id, name, 'topic or term', 0.48 FROM (SELECT chunk_id, {_STRIPPED.format("regexp_replace(" + _STRIPPED.format("text") + ", '^#+', '')")} AS name FROM chunk) WHERE length(name) BETWEEN 2 AND 32 AND NOT regexp_matches(name, '[。！？]')
        UNION ALL SELECT chunk_id, name, substr({_STRIPPED.format("d")}, 1, 160), 0.72 FROM ({_DEFINED})
        UNION ALL SELECT chunk_id, unnest([source, target]), '', 0.55 FROM relations),
    cleaned AS (SELECT chunk_id, {_CLEAN.format("name")} AS name, definition, confidence FROM raw),
    names AS (SELECT DISTINCT name AS s FROM cleaned), good AS (SELECT s FROM names WHERE length(s) <= 36 AND s <> '' AND {_codes(_LABEL_TESTS)} = ''),
    best AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, lower(name) ORDER BY confidence DESC, name, definition) AS r FROM cleaned WHERE name IN (SELECT s FROM good)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY confidence DESC, name) AS place FROM best WHERE r = 1),
    kept AS (SELECT chunk_id, name, definition, confidence FROM placed WHERE place <= 14),
    both_ends AS (SELECT r.*, row_number() OVER (PARTITION BY r.chunk_id ORDER BY rank, source, target) AS place FROM relations r
        SEMI JOIN kept a ON a.chunk_id = r.chunk_id AND a.name = r.source SEMI JOIN kept b ON b.chunk_id = r.chunk_id AND b.name = r.target),
    firsts AS (SELECT chunk_id, source, predicate, target, 0.58::DOUBLE AS confidence FROM both_ends WHERE place <= 18),
    found_edges AS (SELECT * FROM firsts UNION ALL SELECT c.chunk_id, c.heading, 'includes', k.name, 0.42 FROM chunk c JOIN kept k ON k.chunk_id = c.chunk_id
        WHERE c.heading IS NOT NULL AND c.heading <> k.name AND c.chunk_id IN (SELECT chunk_id FROM kept GROUP BY 1 HAVING count(*) > 1) AND NOT EXISTS (SELECT 1 FROM firsts f WHERE f.chunk_id = c.chunk_id AND f.source = c.heading AND f.target = k.name)),
    keyed AS (SELECT *, lower(regexp_replace(name, '{tx.NARROW_KEY_CLASS}', '', 'g')) AS key FROM kept),
    grouped AS (SELECT key, min(row(-confidence, name)) AS top, coalesce(max(row(length(definition), definition)) FILTER (definition <> ''), row(0, '')) AS d, list_sort(list_distinct(list(name))) AS names, round({_MEAN}, 3) AS confidence, count(DISTINCT chunk_id) AS n_chunks FROM keyed WHERE key <> '' GROUP BY key),
    nodes AS (SELECT 'node_' || substr(sha1(key), 1, 10) AS node_id, key, top[2] AS name, d[2] AS definition, names, confidence, n_chunks FROM grouped),
    pairs AS (SELECT lower(regexp_replace(source, '{tx.NARROW_KEY_CLASS}', '', 'g')) AS sk, predicate, lower(regexp_replace(target, '{tx.NARROW_KEY_CLASS}', '', 'g')) AS tk, {_MEAN} AS c, count(*) AS n FROM found_edges GROUP BY ALL),
    edges AS (SELECT 'edge_' || substr(sha1(a.node_id || ':' || predicate || ':' || b.node_id), 1, 10) AS edge_id, a.node_id AS source, predicate, b.node_id AS target, round(c, 3) AS confidence, n FROM pairs JOIN nodes a ON a.key = sk JOIN nodes b ON b.key = tk WHERE sk <> tk)"""


@query(_TERM_GRAPH + " SELECT node_id, key, name, definition, array_to_string(list_filter(names, lambda x: x <> name), '|') AS aliases, confidence, n_chunks FROM nodes")
def term_graph_nodes(spark, d):
    """Concepts of the documents, one per key."""
    return _graph(spark, d)[0]


@query(_TERM_GRAPH + " SELECT * FROM edges")
def term_graph_edges(spark, d):
    """Relations between them."""
    return _graph(spark, d)[1]


@query(_TERM_GRAPH + """, ends AS (SELECT source AS node_id FROM edges UNION SELECT target FROM edges)
    SELECT count(*) AS node_count, (SELECT count(*) FROM edges) AS edge_count, count(*) FILTER (node_id NOT IN (SELECT node_id FROM ends)) AS isolated_count, CASE WHEN count(*) > 0 THEN round(count(*) FILTER (definition <> '') / count(*), 3) ELSE 0 END AS defined_share FROM nodes""")
def term_graph_report(spark, d):
    """Counts and shares of that graph."""
    return gr.graph_report(*_graph(spark, d))


@query("""WITH t AS (SELECT conv_id, turn, role, text, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS b FROM conversations), r AS (SELECT *, sum(b) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM t)
    SELECT conv_id, CAST(run AS BIGINT) AS run, string_agg(text, '' ORDER BY turn) AS text, min(turn) AS "first", count(*) AS n FROM r GROUP BY conv_id, run""")
def merged_runs(spark, d):
    """Adjacent messages of one role joined."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    same = F.coalesce(F.col("role") == F.lag("role").over(w), F.lit(False))
    return sg.merge_runs(table(spark, d, "conversations"), ["conv_id"], "turn", same)


@query("""WITH n AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) SELECT conv_id, string_agg('[S' || n || '] ' || text, chr(10) ORDER BY n) AS context FROM n GROUP BY conv_id""")
def numbered_context(spark, d):
    """Messages of a conversation as numbered context."""
    return sg.numbered_context(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query("""SELECT p_partkey, 'unit_' || substr(sha256('{"p_brand":"' || p_brand || '","p_name":"' || p_name || '"}'), 1, 10) AS unit_id FROM part""")
def stable_ids(spark, d):
    """Ids from canonical JSON."""
    return table(spark, d, "part").select("p_partkey", sg.stable_id("unit_", "p_name", "p_brand").alias("unit_id"))


@query("""WITH a AS (SELECT conv_id AS doc_id, turn AS idx, md5(role) AS digest, CASE role WHEN 'user' THEN '' ELSE text END AS ocr, CASE turn % 3 WHEN 0 THEN 'chart' WHEN 1 THEN 'photo' ELSE 'full_page' END AS kind FROM conversations)
    SELECT doc_id, idx, CASE WHEN row_number() OVER (PARTITION BY doc_id, digest ORDER BY idx) > 1 THEN 'rejected' ELSE 'uncovered' END AS status, CASE WHEN trim(ocr) <> '' OR kind = 'chart' THEN 0.72::DOUBLE ELSE 0.18::DOUBLE END AS importance, CASE WHEN trim(ocr) <> '' OR kind = 'chart' THEN 'standalone_node' ELSE 'attach_as_media' END AS visual_action FROM a WHERE kind <> 'full_page'""")
def visual_units(spark, d):
    """Units of visual assets; repeats are rejected."""
    c = table(spark, d, "conversations")
    kind = F.when(F.col("turn") % 3 == 0, "chart").when(F.col("turn") % 3 == 1, "photo").otherwise("full_page")
    return sg.visual_units(c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), F.md5("role").alias("digest"), F.when(F.col("role") == "user", "").otherwise(F.col("text")).alias("ocr_text"), kind.alias("visual_kind")))


@query("SELECT sha256(text) AS digest, min(doc_id) AS survivor, count(*) AS copies FROM documents GROUP BY text")
def exact_dup_survivor(spark, d):
    """One document per text."""
    return rs.exact_survivors(table(spark, d, "documents"), F.col("text"), "doc_id")


@query("""WITH k AS (SELECT p_partkey AS id, p_brand AS brand, lower(regexp_replace(p_name || p_type, '[\\s_-]+', '', 'g')) AS k FROM part), s AS (SELECT id, brand, list_distinct(list_transform(range(1, length(k)), lambda i: substr(k, CAST(i AS INTEGER), 2))) AS s FROM k)
    SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS similarity FROM s a JOIN s b ON a.brand = b.brand AND a.id < b.id WHERE len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) >= 0.8""")
def bigram_jaccard_pairs(spark, d):
    """Parts of a brand with similar names; a brand is bounded, pairs of equal names are among the result."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", tx.normalized_key(F.concat("p_name", "p_type")).alias("k"))
    return rs.similar_pairs(p, "p_partkey", "k", ["p_brand"], 0.8)


def _prose(t: str) -> str:
    return f"trim(regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _opposite(a: str, b: str) -> str:
    """SQL: whether one text has the one term of a pair only, the other the other."""
    one = "(contains({x}, '{p}') AND contains({y}, '{q}') AND NOT contains({y}, '{p}') AND NOT contains({x}, '{q}'))"
    return " OR ".join(one.format(x=x, y=y, p=p, q=q) for p, q in tx.OPPOSITES for x, y in ((a, b), (b, a)))


def _edges(t: str) -> str:
    """SQL: causes and effects of a text, by the first place of each marker in each sentence."""
    parts = []
    for m in tx.CAUSAL:
        before, after = f"substr(s, 1, instr(s, '{m}') - 1)", f"substr(s, instr(s, '{m}') + {len(m)})"
        pack = f"struct_pack(c := right(replace({_prose(before)}, ' ', ''), 24), e := left(replace({_prose(after)}, ' ', ''), 24))"
        parts.append(f"list_transform(list_filter(regexp_split_to_array(lower({t}), '{tx.CAUSAL_END}'), lambda s: contains(s, '{m}')), lambda s: {pack})")
    return f"list_filter(flatten([{', '.join(parts)}]), lambda e: length(e.c) >= 2 AND length(e.e) >= 2)"


_SAME = "({x} = {y} OR (length({x}) >= 4 AND contains({y}, {x})) OR (length({y}) >= 4 AND contains({x}, {y})))"
_PIECES = "list_distinct(list_transform(range(1, greatest(length({0}), 2)), lambda i: substr({0}, i, 2)))"
_NUMBERS = r"list_sort(list_distinct(list_transform(regexp_extract_all({0}, '[+\-]?\d+(?:\.\d+)?'), lambda x: ltrim(x, '+'))))"


@query(f"""WITH {BLOCKS}, p AS (SELECT doc_id, ordinal, lag(text) OVER (PARTITION BY doc_id ORDER BY ordinal) AS a, text AS b, ordinal % 2 = 0 AS shares FROM blocks),
    x AS (SELECT *, {_prose("a")} AS pa, {_prose("b")} AS pb, {_edges("a")} AS ea, {_edges("b")} AS eb, {_NUMBERS.format("a")} AS na, {_NUMBERS.format("b")} AS nb FROM p WHERE a IS NOT NULL),
    c AS (SELECT *, replace(pa, ' ', '') AS ca, replace(pb, ' ', '') AS cb FROM x), k AS (SELECT *, {_PIECES.format("ca")} AS ka, {_PIECES.format("cb")} AS kb FROM c)
    SELECT doc_id, ordinal, CASE WHEN {_opposite("pa", "pb")} THEN 'veto_opposite'
        WHEN len(list_filter(ea, lambda u: len(list_filter(eb, lambda v: {_SAME.format(x="u.c", y="v.e")} AND {_SAME.format(x="u.e", y="v.c")})) > 0)) > 0 THEN 'veto_causality'
        WHEN len(na) > 0 AND len(nb) > 0 AND na <> nb AND (NOT list_has_any(na, nb) OR (len(na) = 1 AND len(nb) = 1)) THEN 'veto_numbers'
        WHEN ca = cb AND length(ca) >= 8 THEN 'same_claim'
        WHEN shares AND ca <> '' AND cb <> '' AND len(list_intersect(ka, kb)) >= 0.75 * len(list_distinct(list_concat(ka, kb))) THEN 'same_prose' ELSE 'distinct' END AS verdict FROM k""")
def mergeable_claims(spark, d):
    """Whether adjacent blocks claim the same, and why or why not."""
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    b = blocks(spark, d).select("doc_id", "ordinal", F.lit("n").alias("a_name"), F.lag("text").over(w).alias("a_definition"), F.lit("N").alias("b_name"), F.col("text").alias("b_definition"), (F.col("ordinal") % 2 == 0).alias("shares")).where("a_definition is not null")
    return rs.mergeable(b).select("doc_id", "ordinal", "verdict")


@query()
def name_clusters(spark, d):
    """Complete-link clusters of part names within a type."""
    p = table(spark, d, "part").select(F.concat_ws("/", "p_type", "p_brand").alias("block"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("seq"), tx.normalized_key(F.col("p_name")).alias("key"))
    return rs.complete_link(p, 0.5)


@query("""WITH g AS (SELECT p_brand, p_type, min(struct_pack(c := -p_size, s := p_partkey, n := p_name)).n AS name, max(struct_pack(n := length(p_name), d := p_name)).d AS definition, round(avg(p_size), 4) AS confidence, max(p_size) AS cost, bool_and(p_size > 5) AS optional, bool_or(p_size = 50) AS is_root, array_to_string(list_sort(list_distinct(list(p_size))), ',') AS units, count(*) AS merged FROM part GROUP BY ALL),
    i AS (SELECT *, 'node_' || substr(sha1(lower(regexp_replace(name, '\\s+', '', 'g'))), 1, 12) AS i FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY p_brand, p_type) AS r FROM i)
    SELECT p_brand, p_type, name, definition, confidence, cost, optional, is_root, units, merged, CASE WHEN r > 1 THEN i || '_' || r ELSE i END AS node_id FROM r""")
def merged_nodes(spark, d):
    """Survivorship over clusters of parts."""
    p = table(spark, d, "part").select("p_brand", "p_type", F.col("p_name").alias("name"), F.col("p_name").alias("definition"), F.col("p_size").cast("double").alias("confidence"), F.col("p_size").alias("cost"), (F.col("p_size") > 5).alias("optional"), (F.col("p_size") == 50).alias("is_root"), F.col("p_partkey").alias("seq"), F.col("p_size").alias("unit_id"))
    return rs.merge_clusters(p, ["p_brand", "p_type"]).withColumn("units", F.array_join("units", ","))


@query("""WITH f AS (SELECT l_orderkey AS node, l_returnflag, l_linestatus, min(l_linenumber) AS first FROM lineitem GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY first, l_returnflag, l_linestatus) AS n FROM f) SELECT * FROM n WHERE n <= 2""")
def node_evidence(spark, d):
    """First occurrences of evidence, two per node."""
    li = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "node")
    return rs.distinct_evidence(li, "node", "l_linenumber", ["l_returnflag", "l_linestatus"], 2)


@query("""SELECT * FROM (SELECT p_brand AS branch_id, p_name AS key, count(*) FILTER (p_size < 5) AS s, count(*) FILTER (p_size >= 5) AS t, max(p_partkey) FILTER (p_size < 5) AS id, max(p_partkey) FILTER (p_size >= 5) AS "into" FROM part GROUP BY ALL) WHERE s = 1 AND t = 1""".replace("SELECT * FROM (", 'SELECT id, "into" FROM (', 1))
def folded_scaffolds(spark, d):
    """Placeholders that fold into the one node of their key."""
    p = table(spark, d, "part")
    return rs.lone_scaffolds(p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("branch_id"), F.col("p_name").alias("key"), (F.col("p_size") < 5).alias("is_scaffold")))


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 2 = 0)
    SELECT o_orderkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus, coalesce(n.o_orderpriority, o.o_orderpriority) AS o_orderpriority, CASE WHEN n.o_orderkey IS NULL THEN 'kept' WHEN o.o_orderkey IS NULL THEN 'added' WHEN o.o_orderpriority <> n.o_orderpriority THEN 'conflict' ELSE 'same' END AS state FROM o FULL JOIN n USING (o_orderkey)""")
def upserted(spark, d):
    """Two states of a table by key."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    new = o.where("o_orderkey % 2 = 0").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(F.col("o_orderpriority")))
    return rs.upsert(o.where("o_orderkey % 3 <> 0"), new, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("""WITH h AS (SELECT o_orderkey, md5(o_orderpriority) AS a, md5(o_orderstatus || o_orderkey) AS b FROM orders)
    SELECT o_orderkey, CAST(bit_count(xor(('0x' || substr(a, 1, 8))::BIGINT, ('0x' || substr(b, 1, 8))::BIGINT)) + bit_count(xor(('0x' || substr(a, 9, 8))::BIGINT, ('0x' || substr(b, 9, 8))::BIGINT)) AS INTEGER) AS distance FROM h""")
def hash_distances(spark, d):
    """Bits in which two 64-bit hashes differ."""
    o = table(spark, d, "orders")
    a, b = F.substring(F.md5("o_orderpriority"), 1, 16), F.substring(F.md5(F.concat("o_orderstatus", F.col("o_orderkey").cast("string"))), 1, 16)
    return o.select("o_orderkey", rs.hash_distance(a, b).alias("distance"))


_MET = "greatest(0, least(x + s, k.x + k.s) - greatest(x, k.x)) * greatest(0, least(y + s, k.y + k.s) - greatest(y, k.y))"


@query(f"""WITH RECURSIVE b AS (SELECT l_orderkey AS page, l_linenumber AS idx, l_discount * 100 AS x, l_tax * 100 AS y, l_quantity AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_discount * 100, l_tax * 100, l_quantity) AS n FROM lineitem),
    w AS (SELECT page, idx, n, [struct_pack(x := x, y := y, s := s)] AS held, TRUE AS kept FROM b WHERE n = 1
        UNION ALL SELECT page, idx, n, CASE WHEN ok THEN list_append(held, struct_pack(x := x, y := y, s := s)) ELSE held END, ok FROM (SELECT b.*, w.held,
            len(list_filter(w.held, lambda k: s * s + k.s * k.s - {_MET} > 0 AND {_MET} / (s * s + k.s * k.s - {_MET}) >= 0.3)) = 0 AS ok
            FROM w JOIN b ON b.page = w.page AND b.n = w.n + 1))
    SELECT page, idx, kept FROM w""")
def suppressed_boxes(spark, d):
    """Overlapping boxes of a page, the earlier ones kept; lines of orders stand for boxes."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("idx"), (F.col("l_discount") * 100).alias("x"), (F.col("l_tax") * 100).alias("y"), F.col("l_quantity").alias("w"), F.col("l_quantity").alias("h"))
    return rs.suppress_overlaps(li, 0.3)


@query("""WITH j AS (SELECT l_orderkey AS asset, l_suppkey % 10 AS candidate, count(*) AS overlap, max(l_quantity) AS confidence FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY overlap DESC, confidence DESC, candidate) AS r FROM j) SELECT asset, candidate, overlap, confidence FROM r WHERE r = 1""")
def asset_owners(spark, d):
    """Each order's supplier group with most lines, then most pieces."""
    li = table(spark, d, "lineitem")
    j = li.groupBy(F.col("l_orderkey").alias("asset"), (F.col("l_suppkey") % 10).alias("candidate")).agg(F.count("*").alias("overlap"), F.max("l_quantity").alias("confidence"))
    return rs.by_priority(j, "asset", [F.desc("overlap"), F.desc("confidence"), F.col("candidate")])


@query("SELECT p_partkey, p_name FROM (SELECT * FROM part ORDER BY md5('7:' || p_partkey), p_partkey LIMIT 50)")
def seeded_sample(spark, d):
    """A seeded sample of parts, a sampling operator."""
    return rs.sample(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", 50, 7)


@query("""WITH k AS (SELECT l_orderkey, list(l_shipmode ORDER BY n) AS k FROM (SELECT l_orderkey, l_linenumber AS n, substr('abcdefgh', 1 + l_linenumber % 3, 1 + CAST(l_quantity AS INTEGER) % 4) AS l_shipmode FROM lineitem) GROUP BY l_orderkey)
    SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_filter(k, lambda x: len(list_filter(k, lambda y: y <> x AND contains(y, x))) = 0))), ',') AS keys FROM k""")
def contained_keys(spark, d):
    """Keys without those that another holds."""
    li = table(spark, d, "lineitem").select("l_orderkey", F.expr("substr('abcdefgh', 1 + l_linenumber % 3, 1 + cast(l_quantity as int) % 4)").alias("k"))
    g = li.groupBy("l_orderkey").agg(F.collect_list("k").alias("k"))
    return g.select("l_orderkey", F.array_join(F.array_sort(rs.contained_keys(F.col("k"))), ",").alias("keys"))

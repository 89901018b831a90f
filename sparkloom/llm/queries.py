"""The queries opN_<name> of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, mixing, quality, secrets, sharding, simhash, warc, winnow, wrapper
from .common import table


SHARD_BYTES = 16 << 20
MAX_REPEATS = 2.0
KEEP_FROM = 0.3


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's shard of at most SHARD_BYTES of text."""
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_BYTES).drop("text")


def _fold(n: int) -> Column:
    """The fold of a document, crc32 of its id as text mod n; null ids are in fold 0."""
    return F.pmod(F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)), F.lit(n))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(_fold(4) != 2))
    return langid.identify(docs.select("doc_id", (_fold(4) == 2).alias("held_out"), "text"), model).drop("text")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", secrets.scan_column(F.col("text")).alias("s")).select("doc_id", "s.*")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item: doc_id, item_id, n_tokens, similarity."""
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"), min_bytes=0)


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprints(table(spark, sf_dir, "documents")).drop("marks", "edited_marks")


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each copy of a document that the mixture reads, and where."""
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), max_repeats=MAX_REPEATS)


def op8_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Network | float:
    """Learnt from the labels outside fold 0 of 5."""
    labels = table(spark, sf_dir, "labels").where(_fold(5) != 0)
    return quality.fit(docs, labels)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    score = quality.score_column(quality_model(spark, docs, sf_dir), F.col("text"), spark)
    scored = docs.select("doc_id", (_fold(5) == 0).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= KEEP_FROM).cast("int"))


QUERIES = {f.__name__: f for f in (op1_shard, op2_language, op3_secrets, op4_decontaminate, op5_main_text, op6_warc, op7_fingerprint, op8_simhash_neardup, op9_mix, op10_quality)}

ORACLES: dict[str, str] = {
    "op1_shard": f"""
        WITH d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT AS h,
                          coalesce(strlen(text), 0) AS n FROM documents),
        levels AS (SELECT CAST(range AS INTEGER) AS depth FROM range(0, 61)),
        sums AS (SELECT depth, h >> (60 - depth) AS prefix, sum(n) AS bytes, min(h) < max(h) AS many FROM d, levels GROUP BY ALL),
        splits AS (SELECT depth, prefix FROM sums WHERE bytes > {SHARD_BYTES} AND many),
        leaves AS (SELECT s.* FROM sums s LEFT JOIN splits u ON u.depth = s.depth - 1 AND u.prefix = s.prefix >> 1
                   WHERE NOT (s.bytes > {SHARD_BYTES} AND s.many) AND (s.depth = 0 OR u.depth IS NOT NULL))
        SELECT d.doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard, depth AS shard_depth,
               CAST(bytes AS BIGINT) AS shard_bytes, bytes > {SHARD_BYTES} AS oversize
        FROM d JOIN leaves ON prefix = h >> (60 - depth)""",
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        h AS (SELECT page_id, strlen(html) AS n, sha1(html) AS x FROM p),
        k AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY x) > 1 THEN max(page_id) OVER (PARTITION BY x) END AS leader FROM h)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
               list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST(((('0x' || substr(x, CAST(i // 4 * 5 + 1 AS INTEGER), 5))::INTEGER >> CAST(15 - i % 4 * 5 AS INTEGER)) & 31) + 1 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN leader IS NULL OR page_id IS NOT DISTINCT FROM leader THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM leader THEN leader END AS refers_to
        FROM k""",
    "op9_mix": f"""
        WITH d AS (SELECT doc_id, source, coalesce('=' || source, '-') AS src, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k,
                          greatest(1, len(regexp_extract_all(coalesce(text, ''), '{mixing.TOKEN}'))) AS n FROM documents),
        t AS (SELECT src, CAST(sum(n) AS DOUBLE) AS t FROM d GROUP BY src),
        a AS (SELECT round(CASE WHEN max(t) = min(t) THEN 0 ELSE greatest(0, 1 - ln({MAX_REPEATS}) / ln(max(t) / min(t))) END, 9) AS a, sum(t) AS s FROM t),
        w AS (SELECT src, t, pow(t / s, a) / sum(pow(t / s, a)) OVER () AS w FROM t, a),
        b AS (SELECT src, t, floor(w * max(t / w) OVER () * (1 + 1e-12) + 1e-6) AS b FROM w),
        p AS (SELECT src, t, b, floor(b / t) AS full_reads, b - floor(b / t) * t AS rest, sum(b) OVER () AS everything FROM b),
        r AS (SELECT d.*, p.*, sum(n) OVER (PARTITION BY d.src ORDER BY k) AS upto FROM d JOIN p ON p.src = d.src),
        e AS (SELECT *, unnest(range(0, CAST(full_reads + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT))) AS epoch FROM r)
        SELECT doc_id, source, CAST(n AS BIGINT) AS n_tokens, CAST(epoch AS INTEGER) AS epoch,
               CAST(least(floor((epoch + ('0x' || substr(k, 1, 13))::BIGINT / 4503599627370496.0) / (b / t) * ceil(everything / 1000000)), ceil(everything / 1000000) - 1) AS BIGINT) AS mix_block,
               md5(k || ':' || epoch) AS mix_key
        FROM e""",
}

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary folder of our
    own, in local mode only: elsewhere executors would write to disks that no other one can read."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or getattr(spark, "_sparkloom_shared", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = spark._sparkloom_shared = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salted_lookup(left: DataFrame, right: DataFrame, key: str, row_key: Column, salts: int = 32, how: str = "left") -> DataFrame:
    """Join many rows of `left` to one row per key of `right`, however many rows one key has.

    Rows of a key are dealt over `salts` parts by `row_key`; each row of `right` is repeated only for
    the parts that occur, so at most `salts` times and never more often than its key has rows.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(row_key), F.lit(salts)))
    parts = salted.select(key, "_salt").distinct()
    copies = parts.join(right, key, "inner")
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


def sized_broadcast(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df (cheap to count, narrow) with a broadcast hint if it has at most `most` rows."""
    return F.broadcast(df) if df.count() <= most else df


def quoted(name: str) -> str:
    """A column's name as it is, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """df's rows as one struct `_row`, beside `more`: whatever the columns are called, none meets an operator's own."""
    return df.select(F.struct(*[col(c) for c in df.columns]).alias("_row"), *[c.alias(n) for n, c in more.items()])


def unpacked(columns: list[str], but: tuple[str, ...] = ()) -> list[Column]:
    """The columns of `_row` again, without those that are called like one of `but` (case aside): what an operator adds
    takes the place of an input column of that name."""
    gone = {x.lower() for x in but}
    return [F.col(f"_row.{quoted(c)}").alias(c) for c in columns if c.lower() not in gone]


#: Characters of scripts that set no spaces between words (Thai to Khmer, kana, Han); each is a word of its own.
UNSPACED = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"


def words_of(text: Column) -> Column:
    """Runs of anything but ASCII white space; an empty array for null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")

"""Prefix statistics that steer the distribution of keys: counts, owners, filter capacities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.functions import sequence as S
from kmerloom.operators.skew import lpt

FLOOR = 1000
LEAST_WORDS = 1 << 15
BITS_PER_KEY = 4.81


def prefix_counts(counts: DataFrame) -> DataFrame:
    """prefix, n: sightings of every root prefix that occurs; keys shorter than 4 bases are left out."""
    return counts.where(F.length("kmer") >= 4).groupBy(F.substring("kmer", 1, 4).alias("prefix")).agg(F.sum("cnt").cast("bigint").alias("n"))


def node_counts(counts: DataFrame, depth: int) -> DataFrame:
    """prefix, node, n: sightings of the two bases below a root prefix at depth 0, 1 or 2."""
    if depth not in (0, 1, 2):
        raise ValueError("depth must be 0, 1 or 2")
    keys = counts.where(F.length("kmer") >= 6 + 2 * depth)
    return keys.groupBy(F.substring("kmer", 1, 4).alias("prefix"), S.node_prefix(F.col("kmer"), depth).alias("node")).agg(F.sum("cnt").cast("bigint").alias("n"))


def all_roots(counts: DataFrame, floor: int = FLOOR) -> DataFrame:
    """root, prefix, n for all 256 roots; counts below the floor are raised to it."""
    roots = counts.sparkSession.range(256).select(F.col("id").cast("int").alias("root"))
    named = roots.select("root", S.root_text(F.col("root")).alias("prefix"))
    return named.join(prefix_counts(counts), "prefix", "left").select(
        "root", "prefix", F.greatest(F.coalesce("n", F.lit(0)), F.lit(floor)).cast("bigint").alias("n")
    )


def floored_average(roots: DataFrame) -> DataFrame:
    """total, average (whole number) over the roots."""
    return roots.agg(F.sum("n").cast("bigint").alias("total"), F.floor(F.sum("n") / F.count(F.lit(1))).cast("bigint").alias("average"))


def bloom_capacity(roots: DataFrame, raw_bytes: int) -> DataFrame:
    """root, n, capacity: 64-bit words of the prefix's filter for an input of raw_bytes.

    A third of the bytes are taken as windows and shared out in proportion to n, with 4.81 bits a window; the
    next power of two, 32768 at least.
    """
    total = roots.agg(F.sum("n")).first()[0]  # of 256 rows
    words = F.floor(F.lit(raw_bytes // 3) * (F.col("n").cast("double") / F.lit(total)) * BITS_PER_KEY / 64).cast("bigint")
    fit = F.expr("shiftleft(1L, length(bin(_words - 1)))")  # next power of two
    sized = roots.withColumn("_words", F.greatest(words, F.lit(1)))
    return sized.select("root", "n", F.greatest(fit, F.lit(LEAST_WORDS)).cast("bigint").alias("capacity"))


def by_load(roots: DataFrame) -> DataFrame:
    """root, n, turn: roots in descending order of n, equal ones in order of root; a window over 256 rows."""
    order = Window.orderBy(F.desc("n"), F.asc("root"))
    return roots.select("root", "n", F.row_number().over(order).alias("turn"))


def prefix_owners(roots: DataFrame, owners: int) -> DataFrame:
    """root, n, owner: longest-processing-time assignment of the 256 roots; equal counts in order of root."""
    rows = roots.select("root", "n").orderBy("root").collect()  # 256 rows
    at = lpt([(r["root"], r["n"]) for r in rows], owners)
    return roots.sparkSession.createDataFrame([(r["root"], r["n"], at[r["root"]]) for r in rows], "root int, n bigint, owner int")


def owner_loads(owned: DataFrame) -> DataFrame:
    """owner, prefixes, load."""
    return owned.groupBy("owner").agg(F.count(F.lit(1)).alias("prefixes"), F.sum("n").cast("bigint").alias("load"))


def raw_size_estimate(size: int, gzipped: bool) -> int:
    """Bytes of the raw text of a file: four times the size if it is compressed."""
    return size * 4 if gzipped else size

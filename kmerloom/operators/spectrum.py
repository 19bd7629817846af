"""K-mer frequency spectra: how many keys have each count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_RANGE = (1, 10_000)


def precise(counts: DataFrame) -> DataFrame:
    """freq, n over true counts, without zero rows."""
    return counts.groupBy(F.col("cnt").alias("freq")).agg(F.count(F.lit(1)).alias("n"))


def approximate(root: DataFrame) -> DataFrame:
    """freq, n over the repeat counts as stored: frequency f shows at f-1, singletons are missing."""
    return root.groupBy(F.col("cnt").alias("freq")).agg(F.count(F.lit(1)).alias("n"))


def legacy(low: DataFrame, root: DataFrame) -> DataFrame:
    """freq, n: repeats at cnt+1, and first sightings that are no repeat at 1."""
    many = root.select((F.col("cnt") + 1).alias("freq"), F.lit(1).alias("one"))
    alone = low.select("kmer").distinct().join(root.select("kmer"), "kmer", "left_anti")
    both = many.unionByName(alone.select(F.lit(1).cast("bigint").alias("freq"), F.lit(1).alias("one")))
    return both.groupBy("freq").agg(F.count(F.lit(1)).alias("n"))


def dense(spectrum: DataFrame, min_freq: int = DEFAULT_RANGE[0], max_freq: int = DEFAULT_RANGE[1]) -> DataFrame:
    """freq, n for every frequency of the closed range, zeros included; others are dropped."""
    if not 1 <= min_freq <= max_freq:
        raise ValueError("1 <= min_freq <= max_freq must hold")
    grid = spectrum.sparkSession.range(min_freq, max_freq + 1).select(F.col("id").alias("freq"), F.lit(0).cast("bigint").alias("n"))
    kept = spectrum.where(F.col("freq").between(min_freq, max_freq)).select(F.col("freq").cast("bigint").alias("freq"), "n")
    return grid.unionByName(kept).groupBy("freq").agg(F.sum("n").alias("n"))


def reachable(root: DataFrame, min_freq: int) -> DataFrame:
    """root without the rows that stay below the range even with a first sighting: skipped before any shuffle.

    Should their keys be in low, they count there as single sightings, which lie below the range as well.
    """
    return root.where(F.coalesce("cnt", F.lit(0)) + 1 >= min_freq) if min_freq > 1 else root


def spectrum(low: DataFrame, root: DataFrame, min_freq: int = 1, max_freq: int = 10_000, mode: str = "precise") -> DataFrame:
    """Dense spectrum of the two pieces: precise merges them, approximate buckets root as stored."""
    from kmerloom.operators.counting import merge_low_root

    if mode == "precise":
        return dense(precise(merge_low_root(low, reachable(root, min_freq))), min_freq, max_freq)
    if mode == "approximate":
        return dense(approximate(root), min_freq, max_freq)
    raise ValueError("mode must be precise or approximate")

"""K-mer counts, their split into first sightings and repeats, and look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.functions import sequence as S
from kmerloom.operators import kmers, segments

MAX_COUNT = 2**32 - 1


def in_count_range(df: DataFrame, col: str, min_count: int = 1, max_count: int | None = None) -> DataFrame:
    """Rows with min_count <= col <= max_count."""
    if max_count is not None and max_count < min_count:
        raise ValueError("max_count must be at least min_count")
    out = df.where(F.col(col) >= min_count) if min_count > 1 else df
    return out.where(F.col(col) <= max_count) if max_count is not None else out


def count_chunks(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """c0, c1, ..., cnt: counts of keys as numbers of 31 bases each, which sort like their texts.

    Keys of several columns are counted without a shuffle of keys, except over a stream.
    """
    if len(kmers.chunk_widths(k)) > 1 and not reads.isStreaming:
        return segments.segment_counts(reads, k, seq)
    chunks = kmers.chunk_counts(reads, k, seq)
    names = [c for c in chunks.columns if c != "n"]
    return chunks.groupBy(*names).agg(F.sum("n").alias("cnt"))


def count_kmers(
    reads: DataFrame,
    k: int,
    seq: str = "seq",
    min_count: int = 1,
    max_count: int | None = None,
    compat: str | None = None,
    method: str = "arrays",
) -> DataFrame:
    """kmer, cnt of every stored key of the reads.

    The count range holds for the true count; with ``compat="root_count"`` for the number of repeats
    (true count less 1), keys without a repeat passing always. ``method`` is arrays (keys are counted
    within each batch before the shuffle) or sql. A hot key leaves one row a batch or task. Null, empty and
    short reads add nothing.
    """
    if method == "arrays":
        chunks = _in_range(count_chunks(reads, k, seq), min_count, max_count, compat)
        counts = chunks.select(kmers.chunk_text(k).alias("kmer"), "cnt")
    elif method == "sql":
        keys = kmers.key_rows(reads.select(seq), k, seq)
        counts = _in_range(keys.groupBy("kmer").agg(F.count(F.lit(1)).alias("cnt")), min_count, max_count, compat)
    else:
        raise ValueError("method must be arrays or sql")
    return counts


def _in_range(counts: DataFrame, min_count: int, max_count: int | None, compat: str | None) -> DataFrame:
    if compat is None:
        return in_count_range(counts, "cnt", min_count, max_count)
    if compat != "root_count":
        raise ValueError("compat must be None or root_count")
    repeats = F.col("cnt") - 1
    kept = (repeats >= min_count) & (F.lit(True) if max_count is None else repeats <= max_count)
    # a dropped repeat count leaves the first sighting alone
    return counts.withColumn("cnt", F.when((repeats == 0) | kept, F.col("cnt")).otherwise(F.lit(1)).cast("bigint"))


def first_sightings(counts: DataFrame) -> DataFrame:
    """kmer: each key once (``low``)."""
    return counts.select("kmer")


def repeats(counts: DataFrame, min_count: int = 1, max_count: int | None = None) -> DataFrame:
    """root, kmer, cnt: repeat sightings (true count less 1) of the keys seen at least twice, within the range."""
    out = counts.where(F.col("cnt") >= 2).select("kmer", (F.col("cnt") - 1).alias("cnt"))
    return in_count_range(out, "cnt", min_count, max_count).select(S.root_number(F.col("kmer")).alias("root"), "kmer", "cnt")


def merge_low_root(low: DataFrame, root: DataFrame) -> DataFrame:
    """kmer, cnt: the full outer merge of first sightings and repeats; true counts.

    A key in both has cnt + 1, in root only cnt, in low only 1. Written as union and sum: one shuffle with
    partial sums on both sides. Repeated rows of low are one sighting; repeated rows of root that agree
    are one row, null counts count as 0, null keys are left out.
    """
    ones = low.where(F.col("kmer").isNotNull()).select("kmer").distinct().select("kmer", F.lit(1).cast("bigint").alias("cnt"))
    many = root.where(F.col("kmer").isNotNull()).groupBy("kmer").agg(F.coalesce(F.max("cnt"), F.lit(0)).cast("bigint").alias("cnt"))
    return ones.unionByName(many).groupBy("kmer").agg(F.sum("cnt").alias("cnt")).where(F.col("cnt") > 0)


def lookup_counts(counts: DataFrame, wanted: DataFrame, key: str = "kmer") -> DataFrame:
    """wanted with the column cnt: the count of its key, 0 for keys that do not occur; a null key has a null count.

    A column cnt of wanted gives way; repeated rows stay.
    """
    found = counts.select(F.col("kmer").alias("_k"), F.col("cnt").alias("_n"))
    out = wanted.drop("cnt").join(found, F.col(key) == F.col("_k"), "left")
    return out.withColumn("cnt", F.when(F.col(key).isNotNull(), F.coalesce("_n", F.lit(0)))).drop("_k", "_n")


def members(wanted: DataFrame, counts: DataFrame, key: str = "kmer") -> DataFrame:
    """Rows of wanted whose key occurs."""
    return wanted.join(counts.select(F.col("kmer").alias("_k")), F.col(key) == F.col("_k"), "left_semi")


def low_minus_root(low: DataFrame, root: DataFrame) -> DataFrame:
    """kmer: distinct first sightings that never repeat."""
    return low.select("kmer").distinct().join(root.select("kmer"), "kmer", "left_anti")


def totals(counts: DataFrame) -> DataFrame:
    """One row: total windows, distinct keys, keys that repeat, largest count. Zeros for an empty table."""
    return counts.agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).cast("bigint").alias("total"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.count(F.when(F.col("cnt") >= 2, 1)).alias("repeated_keys"),
        F.coalesce(F.max("cnt"), F.lit(0)).cast("bigint").alias("largest"),
    )


def top_kmers(counts: DataFrame, n: int) -> DataFrame:
    """kmer, cnt of the n largest counts; ties go to the smaller key."""
    return counts.select("kmer", "cnt").orderBy(F.desc("cnt"), F.asc("kmer")).limit(n)

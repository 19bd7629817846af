"""Sorted final tables from first sightings and repeats."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.operators.counting import count_chunks, low_minus_root
from kmerloom.operators.kmers import chunk_text
from kmerloom.operators.spectrum import legacy
from kmerloom.session import materialize


@dataclass(frozen=True)
class PostProcessed:
    final_low: DataFrame
    final_root: DataFrame
    histogram: DataFrame


def root_keys(root: DataFrame) -> DataFrame:
    """Distinct keys of the repeats."""
    return root.select("kmer").distinct()


def sorted_keys(df: DataFrame, *by: str) -> DataFrame:
    """df in key order: range partitions, sorted within, written as ordered files."""
    return df.repartitionByRange(*[F.col(c) for c in by]).sortWithinPartitions(*by)


def ranked(df: DataFrame, *by: str) -> DataFrame:
    """df with ``rank``, its row number in the order of ``by``, without a window over all rows.

    Range partitions are sorted and numbered on their own; the partitions' sizes, a row each, give the offsets.
    """
    spark = df.sparkSession
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    parts = materialize(sorted_keys(df, *by).withColumn("_part", F.spark_partition_id()).withColumn("_at", inside), "ranked")
    sizes = sorted(tuple(r) for r in parts.groupBy("_part").count().collect())
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    shift = spark.createDataFrame(offsets, "_part int, _shift bigint")
    out = parts.join(F.broadcast(shift), "_part")
    return out.select(*df.columns, (F.col("_shift") + F.col("_at") + 1).alias("rank"))


def written_places(df: DataFrame, label: str) -> DataFrame:
    """df as written to Parquet files, with ``place``: the number of each row through the files in order of their names."""
    spark = df.sparkSession
    rows = materialize(df, label).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    before, shifts = 0, []
    for name, n in sorted(tuple(r) for r in rows.groupBy("_file").count().collect()):  # a row a file
        shifts.append((name, before))
        before += n
    out = rows.join(F.broadcast(spark.createDataFrame(shifts, "_file string, _before bigint")), "_file")
    return out.select(*df.columns, (F.col("_before") + F.col("_at") + 1).alias("place"))


def ranked_counts(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """kmer, cnt, rank in key order; keys are sorted as numbers and spelled last."""
    chunks = count_chunks(reads, k, seq)
    out = ranked(chunks, *[c for c in chunks.columns if c != "cnt"])
    return out.select(chunk_text(k).alias("kmer"), "cnt", "rank")


def postprocess(low: DataFrame, root: DataFrame) -> PostProcessed:
    """final_low: sorted keys that never repeat; final_root: repeats by root and key; histogram: freq, n."""
    return PostProcessed(
        sorted_keys(low_minus_root(low, root), "kmer"),
        sorted_keys(root.select("root", "kmer", "cnt"), "root", "kmer"),
        legacy(low, root),
    )

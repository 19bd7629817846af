"""Parquet layouts and text sinks of counts and spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_counts(low: DataFrame, root: DataFrame, path: str) -> None:
    """low and root as Parquet; root is partitioned by root number, so that readers prune by prefix.

    Tasks hold ranges of keys of about one size, whichever root they are in: a root that holds most keys is written by many.
    """
    low.select("kmer").write.mode("overwrite").parquet(f"{path}/low")
    root.repartitionByRange("root", "kmer").write.mode("overwrite").partitionBy("root").parquet(f"{path}/root")


def read_counts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    root = spark.read.schema("kmer string, cnt bigint, root int").parquet(f"{path}/root")
    return spark.read.schema("kmer string").parquet(f"{path}/low"), root.select("root", "kmer", "cnt")


def write_spectrum(spectrum: DataFrame, path: str) -> None:
    """freq, tab, n in order of freq, without header: a spectrum has as many rows as its range."""
    spectrum.select("freq", "n").orderBy("freq").coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=False)


def write_histogram(spectrum: DataFrame, path: str) -> None:
    """Sparse histogram in order of count, with the header count, num_kmers."""
    rows = spectrum.where(F.col("n") > 0).select(F.col("freq").alias("count"), F.col("n").alias("num_kmers"))
    rows.orderBy("count").coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_fastq(reads: DataFrame, path: str) -> None:
    """Four lines a read (header, seq, qual) as text files; nulls are empty lines."""
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    reads.select(F.concat_ws("\n", F.concat(F.lit("@"), part("header")), part("seq"), F.lit("+"), part("qual")).alias("value")).write.mode("overwrite").text(path)

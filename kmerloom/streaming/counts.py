"""K-mer counts over a stream of reads; the state is one count for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.operators import kmers


def streaming_counts(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """kmer, cnt so far; output modes update and complete. Batches are counted before the state is touched."""
    chunks = kmers.chunk_counts(reads, k, seq)
    names = [c for c in chunks.columns if c != "n"]
    return chunks.groupBy(*names).agg(F.sum("n").alias("cnt")).select(kmers.chunk_text(k).alias("kmer"), "cnt")


def windowed_counts(reads: DataFrame, k: int, time: str, length: str, late: str, seq: str = "seq") -> DataFrame:
    """window, kmer, cnt by event time; windows close once the watermark ``late`` has passed them."""
    timed = reads.withWatermark(time, late)
    keys = kmers.key_rows(timed.select(time, seq), k, seq)
    return keys.groupBy(F.window(time, length), "kmer").agg(F.count(F.lit(1)).alias("cnt"))

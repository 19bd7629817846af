"""Sightings and reads of every k-mer through the term count store (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.functions import sequence as S
from kmerloom.llm.term_counts import TermCountStore, mark_terms
from kmerloom.operators.sightings import K, usable_rows


def load_sightings(sightings: DataFrame, store: TermCountStore | None = None) -> TermCountStore:
    """Load a table of sightings: first the rows that came while sightings were still made, then the late ones.

    Records are reads, items sighting ids, terms packed keys. The second load is an increment like any
    later delivery: its re-delivered rows change nothing, its late rows change the reads they belong to.
    """
    spark = sightings.sparkSession
    store = store or TermCountStore(spark)
    end = sightings.agg(F.max("seen_at")).first()[0]
    late = F.coalesce(F.col("loaded_at") > F.lit(end), F.lit(False))
    rows = usable_rows(sightings, F.col("read_id"), late.alias("late"))
    changes = rows.select(F.col("read_id").alias("record"), F.col("sighting_id").alias("item"), F.col("key").alias("term"), "late")
    store.apply(changes.where(~F.col("late")).drop("late"))
    store = TermCountStore(spark, store.path)  # as a later run would
    store.apply(changes.where(F.col("late")).drop("late"))
    return store


def kmer_frequencies(sightings: DataFrame) -> DataFrame:
    """kmer, sightings, reads of every k-mer."""
    return load_sightings(sightings).counts().select(
        S.unpack_key(F.col("term"), K).alias("kmer"), F.col("occ").alias("sightings"), F.col("rec").alias("reads")
    )


def count_bounds(run_params: DataFrame, k: int = K) -> tuple[int | None, int | None]:
    """min_count and max_count of the run with this k; None where there is none."""
    row = run_params.where(F.col("k") == k).agg(F.max("min_count"), F.min("max_count")).first()
    return row[0], row[1]


def marked_kmers(sightings: DataFrame, run_params: DataFrame) -> DataFrame:
    """kmer, mark: keys in fewer reads than min_count (rare) or with more sightings than max_count (common)."""
    marked = mark_terms(load_sightings(sightings).counts(), *count_bounds(run_params))
    return marked.select(S.unpack_key(F.col("term"), K).alias("kmer"), "mark")

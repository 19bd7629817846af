"""Usable sightings: one row for each sighting_id whose stored key is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.functions import sequence as S
from kmerloom.session import require_columns

K = 21


def sighting_key(kmer_data: Column, window_text: Column, k: int = K) -> Column:
    """Packed key: kmer_data if not null, else the key of window_text if that is k bases, else null."""
    text = S.clean_window(window_text)
    return F.when(kmer_data.isNotNull(), kmer_data).when(S.is_kmer(text, k), S.pack_key(S.stored_key(text), k))


def usable_rows(sightings: DataFrame, *extra: Column, k: int = K) -> DataFrame:
    """Rows of sightings with a known key, re-delivered ones included: sighting_id, key and the extra columns."""
    require_columns(sightings, ("sighting_id", "kmer_data", "window_text"))
    key = sighting_key(sightings["kmer_data"], sightings["window_text"], k)
    return sightings.select(sightings["sighting_id"], key.alias("key"), *extra).where(F.col("key").isNotNull())


def usable_sightings(sightings: DataFrame, *extra: Column, k: int = K) -> DataFrame:
    """One row for each usable sighting_id.

    Rows of one id are one record; where they differ the smallest value of each column counts. A null
    sighting_id is no record and is left out. Fixed-width columns aggregate in hash maps on both sides
    of the only shuffle, which spreads by sighting_id and so does not see hot keys or samples.
    """
    rows = usable_rows(sightings, *extra, k=k).where(F.col("sighting_id").isNotNull())
    return rows.groupBy("sighting_id").agg(*[F.min(F.col(f"`{c}`")).alias(c) for c in rows.columns if c != "sighting_id"])

"""Driver queries of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kmerloom.operators import prefixes
from kmerloom.plans.counter_queries import QUERIES as COUNTER
from kmerloom.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return prefixes.dominant_prefixes(table(spark, d, "kmer_sightings"), table(spark, d, "prefix_plan"))


def p1_prefix_load(spark: SparkSession, d: str) -> DataFrame:
    return prefixes.prefix_load(table(spark, d, "kmer_sightings"), table(spark, d, "prefix_plan"))


def p1_owner_load(spark: SparkSession, d: str) -> DataFrame:
    return prefixes.owner_load(table(spark, d, "kmer_sightings"), table(spark, d, "prefix_plan"))


QUERIES = {f.__name__: f for f in (p1_found, p1_prefix_load, p1_owner_load)} | COUNTER

"""Driver queries of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.functions import sequence as S
from kmerloom.llm import distinct, iceberg, leakage, packing, seen_keys, sighting_counts, truncation
from kmerloom.operators.sightings import K, usable_sightings
from kmerloom.session import materialize, table


def _sighting_keys(spark: SparkSession, d: str) -> DataFrame:
    return materialize(usable_sightings(table(spark, d, "kmer_sightings")).select("key"), "keys")


def _heap_keys(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "heap_items").where(F.col("item_key").isNotNull() & F.col("item_id").isNotNull())
    return materialize(items.groupBy("item_id").agg(F.min(F.upper("item_key")).alias("key")).select("key"), "heap")


def p2_topk(spark: SparkSession, d: str) -> DataFrame:
    """src, kmer, n, rank of the most frequent keys."""
    seen = iceberg.iceberg_topk(_sighting_keys(spark, d), "key", 20)
    heap = iceberg.iceberg_topk(_heap_keys(spark, d), "key", 10)
    return seen.select(F.lit("kmer_sightings").alias("src"), S.unpack_key(F.col("value"), K).alias("kmer"), "n", "rank").unionByName(
        heap.select(F.lit("heap_items").alias("src"), F.col("value").alias("kmer"), "n", "rank")
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_topk(spark, d).select("src", "kmer")


def p2_iceberg_counts(spark: SparkSession, d: str) -> DataFrame:
    """kmer, n of all keys with at least 100 usable sightings."""
    counts = iceberg.iceberg_counts(_sighting_keys(spark, d), "key", 100)
    return counts.select(S.unpack_key(F.col("value"), K).alias("kmer"), "n")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return distinct.diverse_groups(table(spark, d, "kmer_sightings"))


def p3_distinct_cube(spark: SparkSession, d: str) -> DataFrame:
    return distinct.distinct_cube(table(spark, d, "kmer_sightings"))


def p3_cube_bounds(spark: SparkSession, d: str) -> DataFrame:
    """grouping, groups, sightings, within: whether 99.8 % of the cube's groups have their exact number of distinct keys in [low, high]."""
    return distinct.audited_cube(table(spark, d, "kmer_sightings"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return sighting_counts.marked_kmers(table(spark, d, "kmer_sightings"), table(spark, d, "run_params"))


def p4_kmer_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return sighting_counts.kmer_frequencies(table(spark, d, "kmer_sightings"))


def _arrivals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "kmer_arrivals"), table(spark, d, "low_keys"), table(spark, d, "prefix_plan")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return seen_keys.seen_before(*_arrivals(spark, d))


def p5_filter_report(spark: SparkSession, d: str) -> DataFrame:
    return seen_keys.SeenKeys(*_arrivals(spark, d)).report()


def p5_filter_audit(spark: SparkSession, d: str) -> DataFrame:
    return seen_keys.SeenKeys(*_arrivals(spark, d)).audit()


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    """Containers of documents sized in code tokens."""
    docs = table(spark, d, "documents").select("doc_id", packing.code_token_count(F.col("text")).alias("size"))
    return packing.pack(docs, table(spark, d, "pack_specs"))


def p6_pack_check(spark: SparkSession, d: str) -> DataFrame:
    """What a packing must keep, for each container size, and whether at least 95 % of the containers' room is used."""
    return packing.checked_packing(p6_pack(spark, d), table(spark, d, "pack_specs"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.split_documents(p6_pack(spark, d))


def p6_fill_report(spark: SparkSession, d: str) -> DataFrame:
    """Fill of the containers of documents sized in tokens of a public byte-level vocabulary."""
    docs = table(spark, d, "documents").select("doc_id", packing.bpe_token_count(F.col("text")).alias("size"))
    specs = table(spark, d, "pack_specs")
    return packing.fill_report(packing.pack(docs, specs), specs)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_documents(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_leak_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_exact_leaks(spark: SparkSession, d: str) -> DataFrame:
    """item_id, suite, exact_docs of the report, which takes more seeds than the found query."""
    return p7_leak_report(spark, d).select("item_id", "suite", "exact_docs")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated_documents(table(spark, d, "documents"))


def p8_truncation_report(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_report(table(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p3_found, p4_found, p5_found, p6_found, p7_found, p8_found, p2_topk, p2_iceberg_counts, p3_distinct_cube, p3_cube_bounds,
        p4_kmer_frequencies, p5_filter_report, p5_filter_audit, p6_pack, p6_pack_check, p6_fill_report, p7_leak_report, p7_exact_leaks, p8_truncation_report,
    )
}

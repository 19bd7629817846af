"""Driver queries of the k-mer counter's own operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kmerloom.functions import sequence as S
from kmerloom.functions.udtf import register_sql
from kmerloom.operators import counting, kmers, postprocess, prefix_stats, spectrum
from kmerloom.session import materialize, new_path, table
from kmerloom.sources import binary, tables
from kmerloom.streaming.counts import streaming_counts, windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
K = 21
RAW_BYTES = 60_000_000


# -- inputs --------------------------------------------------------------------------------------------
def reads(spark: SparkSession, d: str) -> DataFrame:
    """read_id, seq: one row a read."""
    rows = table(spark, d, "fastq_reads").where(F.col("read_id").isNotNull())
    return rows.groupBy("read_id").agg(F.min("seq").alias("seq"))


def text_reads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("seq"))


def _hex(column, letters: str):
    return F.translate(F.md5(column), "0123456789abcdef", letters)


def hexn_reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads of 32 bases with breaks, and many repeats."""
    return table(spark, d, "lineitem").select(_hex(F.col("l_partkey").cast("string"), "ACGTACGTACGTACGN").alias("seq"))


def wide_reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads of 160 bases without breaks; customers with several orders repeat theirs."""
    group = F.col("o_custkey").cast("string")
    parts = [_hex(F.concat(group, F.lit(x)), "ACGTACGTACGTACGT") for x in "abcde"]
    return table(spark, d, "orders").select(F.concat(*parts).alias("seq"))


def counts(spark: SparkSession, d: str) -> DataFrame:
    return counting.count_kmers(reads(spark, d), K)


def low_root(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """low and root of the earlier run, cleaned: one row a key."""
    low = table(spark, d, "low_keys").select(S.clean_window(F.col("kmer")).alias("kmer"))
    root = table(spark, d, "root_counts").select(S.clean_window(F.col("kmer")).alias("kmer"), "cnt")
    root = root.where(F.col("kmer").isNotNull()).groupBy("kmer").agg(F.max("cnt").alias("cnt"))
    return low.where(F.col("kmer").isNotNull()), root.where(F.col("cnt").isNotNull())


def wanted_keys(spark: SparkSession, d: str) -> DataFrame:
    """kmer: distinct stored keys of the arrivals, given as keys or as windows."""
    text = S.clean_window(F.col("canonical_kmer"))
    key = F.when(F.lower(F.trim("form")) == "window", S.stored_key(text)).otherwise(text)
    return table(spark, d, "kmer_arrivals").where(S.is_kmer(text, K)).select(key.alias("kmer")).distinct()


# -- scans, projections ---------------------------------------------------------------------------------
def _written_reads(spark: SparkSession, d: str) -> str:
    path = new_path(spark, "fastq")
    tables.write_fastq(table(spark, d, "fastq_reads"), path)
    binary.register(spark)
    return path


def fastq_source_reads(spark: SparkSession, d: str) -> DataFrame:
    """seq, n: written as FASTQ and read again through the data source, which decodes the sequences only."""
    rows = spark.read.format("fastq").schema("seq string").load(_written_reads(spark, d))
    return rows.groupBy("seq").agg(F.count(F.lit(1)).alias("n"))


def fastq_split_reads(spark: SparkSession, d: str) -> DataFrame:
    """header, seq, qual, n: read in splits of 64 kB, each of which finds the first of its records."""
    rows = spark.read.format("fastq").option("splitBytes", 1 << 16).load(_written_reads(spark, d))
    return rows.groupBy("header", "seq", "qual").agg(F.count(F.lit(1)).alias("n"))


def fastq_sampling_scan(spark: SparkSession, d: str) -> DataFrame:
    """complete, within: the sampling scan at the start, middle and end of each file gives whole records only, and no more than asked for."""
    path, most = _written_reads(spark, d), 60_000
    whole = spark.read.format("fastq").load(path)
    part = spark.read.format("fastq").option("sampleBytes", most).load(path)
    lost = part.join(whole, ["file", "read_id", "header", "seq", "qual"], "left_anti").count()
    size = part.groupBy("file").agg(F.sum(F.length("header") + F.length("seq") + F.length("qual") + 5).alias("b"), F.max(F.length("seq")).alias("m"))
    over = size.where(F.col("b") > most + 3 * (2 * F.col("m") + 200)).count()
    return spark.createDataFrame([(lost == 0 and part.count() > 0, over == 0)], "complete boolean, within boolean")


def base_runs(spark: SparkSession, d: str) -> DataFrame:
    """read_id, runs, bases, longest."""
    runs = kmers.base_runs(reads(spark, d), "seq")
    return runs.groupBy("read_id").agg(
        F.count(F.lit(1)).alias("runs"), F.sum(F.length("run")).cast("bigint").alias("bases"), F.max(F.length("run")).cast("bigint").alias("longest")
    )


def invalid_base_stats(spark: SparkSession, d: str) -> DataFrame:
    """read_id, length, invalid: characters that are no base."""
    s = F.coalesce(F.col("seq"), F.lit(""))
    rows = reads(spark, d)
    return rows.select("read_id", F.length(s).cast("bigint").alias("length"), F.length(F.translate(s, "ACGTUacgtu", "")).cast("bigint").alias("invalid"))


def kmer_windows(spark: SparkSession, d: str) -> DataFrame:
    """read_id, windows, first, last window text in sort order."""
    return kmers.windows(reads(spark, d), K).groupBy("read_id").agg(
        F.count(F.lit(1)).alias("windows"), F.min("window").alias("least"), F.max("window").alias("greatest")
    )


def reverse_complement(spark: SparkSession, d: str) -> DataFrame:
    rows = kmers.base_runs(reads(spark, d), "seq", K)
    return rows.select("read_id", "run", S.reverse_complement(F.col("run")).alias("revcomp")).distinct()


def canonical_key(spark: SparkSession, d: str) -> DataFrame:
    """window, canonical, kmer of every distinct window."""
    w = kmers.windows(reads(spark, d).select("seq"), K).distinct()
    return w.select("window", S.canonical(F.col("window")).alias("canonical"), S.stored_key(F.col("window")).alias("kmer"))


def kmers_of_read(spark: SparkSession, d: str) -> DataFrame:
    """read_id, kmer, n with the array expression of a read's keys."""
    rows = reads(spark, d).select("read_id", F.explode(kmers.kmers_of(F.col("seq"), K)).alias("kmer"))
    return rows.groupBy("read_id", "kmer").agg(F.count(F.lit(1)).alias("n"))


def sql_kmers_table_function(spark: SparkSession, d: str) -> DataFrame:
    """kmer, n through SQL: the table function over distinct heap keys."""
    register_sql(spark)
    table(spark, d, "heap_items").createOrReplaceTempView("kmerloom_heap_items")
    return spark.sql(
        "SELECT t.kmer, count(*) AS n FROM (SELECT DISTINCT upper(item_key) AS seq FROM kmerloom_heap_items) h, LATERAL kmers(h.seq, 11) t GROUP BY t.kmer"
    )


def packed_key_hex(spark: SparkSession, d: str) -> DataFrame:
    """kmer, hex of the packed word, root number, and the key unpacked again."""
    keys = counts(spark, d).select("kmer", S.pack_key(F.col("kmer"), K).alias("p"))
    return keys.select("kmer", F.lpad(F.hex("p"), 16, "0").alias("word"), S.packed_root(F.col("p")).alias("root"), S.unpack_key(F.col("p"), K).alias("again"))


# -- counts ---------------------------------------------------------------------------------------------
def _counts_of(source: Query, k: int, method: str = "arrays") -> Query:
    return lambda spark, d: counting.count_kmers(source(spark, d), k, method=method)


COUNTS: dict[str, tuple[Query, int, str]] = {
    "kmer_counts_reads_k21": (reads, 21, "arrays"),
    "kmer_counts_reads_k21_sql": (reads, 21, "sql"),
    "kmer_counts_reads_k31": (reads, 31, "arrays"),
    "kmer_counts_text_k3": (text_reads, 3, "arrays"),
    "kmer_counts_text_k4": (text_reads, 4, "sql"),
    "kmer_counts_hexn_k11": (hexn_reads, 11, "arrays"),
    "kmer_counts_wide_k1": (wide_reads, 1, "arrays"),
    "kmer_counts_wide_k32": (wide_reads, 32, "arrays"),
    "kmer_counts_wide_k33": (wide_reads, 33, "arrays"),
    "kmer_counts_wide_k64": (wide_reads, 64, "arrays"),
    "kmer_counts_wide_k65": (wide_reads, 65, "arrays"),
    "kmer_counts_wide_k128": (wide_reads, 128, "arrays"),
}


def kmer_counts_min_max(spark: SparkSession, d: str) -> DataFrame:
    return counting.count_kmers(reads(spark, d), K, min_count=2, max_count=50)


def kmer_counts_compat(spark: SparkSession, d: str) -> DataFrame:
    return counting.count_kmers(reads(spark, d), K, min_count=2, max_count=50, compat="root_count")


def low_first_sightings(spark: SparkSession, d: str) -> DataFrame:
    return counting.first_sightings(counts(spark, d))


def root_repeats(spark: SparkSession, d: str) -> DataFrame:
    return counting.repeats(counts(spark, d))


def low_root_full_outer_merge(spark: SparkSession, d: str) -> DataFrame:
    return counting.merge_low_root(*low_root(spark, d))


def low_minus_root(spark: SparkSession, d: str) -> DataFrame:
    return counting.low_minus_root(*low_root(spark, d))


def distinct_root_keys(spark: SparkSession, d: str) -> DataFrame:
    return postprocess.root_keys(table(spark, d, "root_counts").select(S.clean_window(F.col("kmer")).alias("kmer")).where(F.col("kmer").isNotNull()))


def count_lookup(spark: SparkSession, d: str) -> DataFrame:
    return counting.lookup_counts(counting.merge_low_root(*low_root(spark, d)), wanted_keys(spark, d))


def kmer_membership(spark: SparkSession, d: str) -> DataFrame:
    return counting.members(wanted_keys(spark, d), low_root(spark, d)[0])


def kmer_totals(spark: SparkSession, d: str) -> DataFrame:
    return counting.totals(counts(spark, d))


def top_kmers(spark: SparkSession, d: str) -> DataFrame:
    return counting.top_kmers(counts(spark, d), 50)


def sorted_export(spark: SparkSession, d: str) -> DataFrame:
    """rank, kmer, cnt in key order."""
    return postprocess.ranked_counts(reads(spark, d), K)


def postprocess_final_root(spark: SparkSession, d: str) -> DataFrame:
    low, root = low_root(spark, d)
    return postprocess.postprocess(low, root.withColumn("root", S.root_number(F.col("kmer")))).final_root


# -- spectra --------------------------------------------------------------------------------------------
def spectrum_reads_k21(spark: SparkSession, d: str) -> DataFrame:
    return spectrum.precise(counts(spark, d))


def spectrum_precise(spark: SparkSession, d: str) -> DataFrame:
    return spectrum.precise(counting.merge_low_root(*low_root(spark, d)))


def spectrum_ranged_dense(spark: SparkSession, d: str) -> DataFrame:
    return spectrum.spectrum(*low_root(spark, d), 3, 400)


def spectrum_approximate(spark: SparkSession, d: str) -> DataFrame:
    return spectrum.spectrum(*low_root(spark, d), 1, 400, "approximate")


def spectrum_legacy(spark: SparkSession, d: str) -> DataFrame:
    return spectrum.legacy(*low_root(spark, d))


# -- prefixes -------------------------------------------------------------------------------------------
def root_prefix_counts(spark: SparkSession, d: str) -> DataFrame:
    return prefix_stats.prefix_counts(counts(spark, d))


def _nodes(depth: int) -> Query:
    return lambda spark, d: prefix_stats.node_counts(counts(spark, d), depth)


def prefix_floor_avg(spark: SparkSession, d: str) -> DataFrame:
    return prefix_stats.floored_average(prefix_stats.all_roots(counts(spark, d)))


def bloom_capacity(spark: SparkSession, d: str) -> DataFrame:
    return prefix_stats.bloom_capacity(materialize(prefix_stats.all_roots(counts(spark, d)), "roots"), RAW_BYTES)


def prefix_owner_lpt(spark: SparkSession, d: str) -> DataFrame:
    return prefix_stats.prefix_owners(prefix_stats.all_roots(counts(spark, d)), 12)


def prefix_owner_totals(spark: SparkSession, d: str) -> DataFrame:
    """prefixes and load over all owners: nothing may be lost by the assignment."""
    loads = prefix_stats.owner_loads(prefix_owner_lpt(spark, d))
    return loads.agg(F.count(F.lit(1)).alias("owners"), F.sum("prefixes").cast("bigint").alias("prefixes"), F.sum("load").cast("bigint").alias("load"))


def prefix_load_order(spark: SparkSession, d: str) -> DataFrame:
    return prefix_stats.by_load(prefix_stats.all_roots(counts(spark, d)))


def packed_shifts(spark: SparkSession, d: str) -> DataFrame:
    """kmer, and its packed word without the first base and with one more before it, spelled again."""
    packed = S.pack_key(F.col("kmer"), K)
    left, right = S.shift_bases_left(packed, 1), S.shift_bases_right(packed, 1)
    return low_root(spark, d)[0].distinct().select("kmer", S.unpack_key(left, K).alias("shorter"), S.unpack_key(right, K + 1).alias("longer"))


def observed_totals(spark: SparkSession, d: str) -> DataFrame:
    """total, distinct_keys: metrics observed while the counts are written, without another pass."""
    seen = Observation("kmers")
    c = counts(spark, d).observe(seen, F.sum("cnt").alias("total"), F.count(F.lit(1)).alias("distinct_keys"))
    materialize(c, "observed")
    return spark.createDataFrame([(seen.get["total"], seen.get["distinct_keys"])], "total bigint, distinct_keys bigint")


def sampled_prefix_counts(spark: SparkSession, d: str) -> DataFrame:
    """prefix, n: the counts that precede a run, over the reads that the sampling scan gives; files within its bound are read whole."""
    reads = spark.read.format("fastq").schema("seq string").option("sampleBytes", 1 << 40).load(_written_reads(spark, d))
    return prefix_stats.prefix_counts(counting.count_kmers(reads, K))


# -- codecs and streams -----------------------------------------------------------------------------------
def low_bin_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "low-bin")
    binary.write_low(counting.first_sightings(counts(spark, d)), path, K)
    return binary.read_low(spark, path, K)


def low_packed_read(spark: SparkSession, d: str) -> DataFrame:
    """record: the packed bytes of every first sighting, from one file that several tasks wrote, as hexadecimal text."""
    path = f"{new_path(spark, 'low-one')}.bin"
    binary.write_low(counting.first_sightings(counts(spark, d)), path, K, single=True)
    return binary.read_packed(spark, path, K).select(F.lower(F.hex("packed")).alias("record"))


def root_bin_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "root-bin")
    binary.write_root(counting.repeats(counts(spark, d)), path, K)
    return binary.read_root(spark, path, K)


def spectrum_text(spark: SparkSession, d: str) -> DataFrame:
    """freq, n of the dense spectrum from 1 to 400, as written to a text file and read again."""
    path = new_path(spark, "spectrum")
    tables.write_spectrum(spectrum.spectrum(*low_root(spark, d), 1, 400), path)
    return spark.read.csv(path, schema="freq bigint, n bigint", sep="\t")


def histogram_text(spark: SparkSession, d: str) -> DataFrame:
    """count, num_kmers of the sparse histogram, as written to a text file with a header and read again."""
    path = new_path(spark, "histogram")
    tables.write_histogram(spectrum.legacy(*low_root(spark, d)), path)
    return spark.read.csv(path, schema="count bigint, num_kmers bigint", sep="\t", header=True)


def _pieces_written(spark: SparkSession, d: str) -> postprocess.PostProcessed:
    low, root = low_root(spark, d)
    return postprocess.postprocess(low, root.withColumn("root", S.root_number(F.col("kmer"))))


def final_low_sorted(spark: SparkSession, d: str) -> DataFrame:
    """kmer, place: the keys that never repeat, in the order in which they were written."""
    return postprocess.written_places(_pieces_written(spark, d).final_low, "final-low")


def final_root_sorted(spark: SparkSession, d: str) -> DataFrame:
    """root, kmer, cnt, place: the repeats in the order in which they were written."""
    return postprocess.written_places(_pieces_written(spark, d).final_root, "final-root")


def parquet_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """kmer, cnt of the repeats of all roots, as written by root and read again."""
    path, c = new_path(spark, "pieces"), materialize(counts(spark, d), "counts")
    tables.write_counts(counting.first_sightings(c), counting.repeats(c), path)
    return tables.read_counts(spark, path)[1].select("kmer", "cnt")


def parquet_merge_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """kmer, cnt: low and all roots as written and read again, merged to the true counts."""
    path, c = new_path(spark, "pieces"), materialize(counts(spark, d), "counts")
    tables.write_counts(counting.first_sightings(c), counting.repeats(c), path)
    return counting.merge_low_root(*tables.read_counts(spark, path))


def _read_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "fastq_reads").schema
    return spark.readStream.schema(schema).parquet(f"{d}/fastq_reads.parque[t]")


def _drained(stream: DataFrame) -> DataFrame:
    """The complete result of a stream once its input ends."""
    spark = stream.sparkSession
    out, log = new_path(spark, "stream"), new_path(spark, "stream-log")

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    stream.writeStream.outputMode("complete").option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def streaming_kmer_counts(spark: SparkSession, d: str) -> DataFrame:
    """kmer, cnt of a stream over all rows of the reads table, in complete mode until its input ends."""
    return _drained(streaming_counts(_read_stream(spark, d).select("seq"), 11))


def streaming_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    """day, kmer, cnt: keys of 5 bases by the day of the run, as an event-time stream."""
    timed = _read_stream(spark, d).select(F.col("run_ts").cast("timestamp").alias("run_ts"), "seq")
    counts = windowed_counts(timed, 5, "run_ts", "1 day", "60 days")
    return _drained(counts.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "kmer", "cnt"))


_PLAIN = (
    fastq_source_reads, fastq_split_reads, fastq_sampling_scan, base_runs, invalid_base_stats, kmer_windows, reverse_complement, canonical_key, kmers_of_read,
    sql_kmers_table_function, packed_key_hex, kmer_counts_min_max, kmer_counts_compat, low_first_sightings, root_repeats, low_root_full_outer_merge,
    low_minus_root, distinct_root_keys, count_lookup, kmer_membership, kmer_totals, top_kmers, sorted_export, postprocess_final_root,
    spectrum_reads_k21, spectrum_precise, spectrum_ranged_dense, spectrum_approximate, spectrum_legacy, root_prefix_counts, prefix_floor_avg,
    bloom_capacity, prefix_owner_lpt, prefix_owner_totals, prefix_load_order, packed_shifts, observed_totals, sampled_prefix_counts, low_bin_round_trip, low_packed_read,
    root_bin_round_trip, parquet_round_trip, spectrum_text, histogram_text, final_low_sorted, final_root_sorted,
    parquet_merge_round_trip, streaming_kmer_counts, streaming_windowed_counts,
)

QUERIES: dict[str, Query] = {
    **{name: _counts_of(*spec) for name, spec in COUNTS.items()},
    **{f.__name__: f for f in _PLAIN},
    **{f"node_prefix_counts_d{x}": _nodes(x) for x in (0, 1, 2)},
}

"""Command line: count, spectrum and postprocess."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from kmerloom.operators import counting, postprocess, spectrum
from kmerloom.session import scratch
from kmerloom.sources import binary, tables


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kmerloom")
    sub = top.add_subparsers(dest="command", required=True)
    c = sub.add_parser("count", help="count the k-mers of FASTQ files")
    c.add_argument("fastq")
    c.add_argument("k", type=int)
    c.add_argument("output")
    c.add_argument("--min-count", type=int, default=1)
    c.add_argument("--max-count", type=int, default=counting.MAX_COUNT)
    c.add_argument("--format", choices=("parquet", "binary"), default="parquet")
    s = sub.add_parser("spectrum", help="k-mer spectrum of a count output")
    s.add_argument("mode", choices=("precise", "approximate"))
    s.add_argument("input")
    s.add_argument("k", type=int)
    s.add_argument("output")
    s.add_argument("--min-freq", type=int, default=1)
    s.add_argument("--max-freq", type=int, default=10_000)
    s.add_argument("--format", choices=("parquet", "binary"), default="parquet")
    p = sub.add_parser("postprocess", help="sorted final tables and the sparse histogram")
    p.add_argument("input")
    p.add_argument("k", type=int)
    p.add_argument("output")
    p.add_argument("--format", choices=("parquet", "binary"), default="parquet")
    return top


def _pieces(spark: SparkSession, a: argparse.Namespace):
    if a.format == "parquet":
        return tables.read_counts(spark, a.input)
    return binary.read_low(spark, f"{a.input}/low.bin", a.k), binary.read_root(spark, a.input, a.k)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.k < 1 or a.k > 128:
        raise SystemExit("k must be 1..128")
    if a.command == "count" and a.max_count < a.min_count:
        raise SystemExit("max count must be at least min count")
    spark = spark or SparkSession.builder.appName("kmerloom").getOrCreate()
    binary.register(spark)
    with scratch(spark):
        _run(spark, a)
    return 0


def _run(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.command == "count":
        counts = counting.count_kmers(spark.read.format("fastq").schema("seq string").load(a.fastq), a.k)
        # both pieces come from one written table: reads are counted once
        counts.write.mode("overwrite").parquet(f"{a.output}/counts")
        counts = spark.read.schema(counts.schema).parquet(f"{a.output}/counts")
        report = counting.totals(counts).first()
        print(f"k-mers read: {report['total']}, distinct: {report['distinct_keys']}, repeated: {report['repeated_keys']}")
        low, root = counting.first_sightings(counts), counting.repeats(counts, a.min_count, a.max_count)
        if a.format == "parquet":
            tables.write_counts(low, root, a.output)
        else:
            binary.write_root(root, f"{a.output}/bin", a.k)
            binary.write_low(low, f"{a.output}/bin/low.bin", a.k, single=True)
    elif a.command == "spectrum":
        low, root = _pieces(spark, a)
        tables.write_spectrum(spectrum.spectrum(low, root, a.min_freq, a.max_freq, a.mode), a.output)
    else:
        done = postprocess.postprocess(*_pieces(spark, a))
        done.final_low.write.mode("overwrite").parquet(f"{a.output}/final_low")
        done.final_root.write.mode("overwrite").parquet(f"{a.output}/final_root")
        tables.write_histogram(done.histogram, f"{a.output}/freq_hist")


if __name__ == "__main__":
    raise SystemExit(main())

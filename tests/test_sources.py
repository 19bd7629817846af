import gzip
import os

import numpy as np
import pytest
from brute import FIXTURE, bases
from pyspark.sql import functions as F

from kmerloom import cli
from kmerloom.operators import counting
from kmerloom.sources import binary, codecs, fastq, tables
from kmerloom.streaming.counts import streaming_counts, windowed_counts


def fastq_text(reads, quality="@"):
    """Quality lines begin with @; no final newline."""
    return "\n".join(f"@r{i}\n{r}\n+\n{quality * len(r)}" for i, r in enumerate(reads))


def load(spark, path, **options):
    binary.register(spark)
    return spark.read.format("fastq").options(**options).load(str(path))


def test_fastq_plain_and_gzip(spark, tmp_path):
    text = fastq_text(FIXTURE)
    (tmp_path / "plain.txt").write_bytes(text.encode())
    (tmp_path / "named.fastq").write_bytes(gzip.compress(text.encode()))  # told by its bytes
    for name in ("plain.txt", "named.fastq"):
        rows = load(spark, tmp_path / name).orderBy("read_id").collect()
        assert [r.seq for r in rows] == FIXTURE
        assert rows[0].header == "@r0" and rows[0].qual == "@" * 14
    both = counting.count_kmers(load(spark, tmp_path), 3)
    assert {r.kmer: r.cnt for r in both.collect()} == {"AAT": 4, "ATG": 18, "GCA": 32}


@pytest.mark.parametrize("split", [64, 100, 333, 5000])
def test_fastq_splits(spark, tmp_path, split):
    import random

    rng = random.Random(split)
    reads = [bases(rng, rng.randrange(5, 60)) for _ in range(300)]
    (tmp_path / "r.fastq").write_text(fastq_text(reads) + "\n")
    df = load(spark, tmp_path / "r.fastq", splitBytes=split)
    assert [r.seq for r in df.orderBy("read_id").collect()] == reads
    if split <= 333:
        assert len(fastq.split_offsets(str(tmp_path / "r.fastq"), split)) > 3


def test_fastq_ambiguous_and_short(spark, tmp_path):
    (tmp_path / "odd.fastq").write_text("@\n@\n+\n@\n" * 50)  # any phase of two fits
    assert load(spark, tmp_path / "odd.fastq", splitBytes=20).count() == 50
    (tmp_path / "cut.fastq").write_text("@a\nACGT\n+\nIIII\n@b\nAC")
    assert [(r.seq, r.qual) for r in load(spark, tmp_path / "cut.fastq").orderBy("read_id").collect()] == [("ACGT", "IIII"), ("AC", None)]
    (tmp_path / "empty.fastq").write_text("")
    assert load(spark, tmp_path / "empty.fastq").count() == 0
    with pytest.raises(Exception, match="nowhere"):
        load(spark, tmp_path / "nowhere.fastq").count()
    assert fastq.raw_size(str(tmp_path / "cut.fastq")) == (tmp_path / "cut.fastq").stat().st_size
    spans = fastq.sampled_bytes(str(tmp_path / "odd.fastq"), 30)
    assert len(spans) == 3 and all(b - a == 10 for a, b in spans)


def test_fastq_sample(spark, tmp_path):
    import random

    rng = random.Random(11)
    reads = [bases(rng, 50) for _ in range(2000)]
    (tmp_path / "r.fastq").write_text(fastq_text(reads))
    rows = load(spark, tmp_path / "r.fastq", sampleBytes=30_000).orderBy("read_id").collect()
    assert 200 < len(rows) < 320 and rows[0].seq == reads[0] and rows[-1].seq == reads[-1]
    assert len({r.read_id for r in rows}) == len(rows) and {r.seq for r in rows} <= set(reads)
    assert load(spark, tmp_path / "r.fastq", sampleBytes=10_000_000).count() == 2000
    (tmp_path / "r.gz").write_bytes(gzip.compress(fastq_text(reads).encode()))
    head = load(spark, tmp_path / "r.gz", sampleBytes=10_000).orderBy("read_id").collect()
    assert 60 < len(head) < 110 and [r.seq for r in head] == reads[: len(head)]


def test_fastq_columns_and_long_records(spark, tmp_path, monkeypatch):
    """Only the asked columns are decoded; records longer than a probe and a block are cut and read whole; odd bytes are replaced."""
    import random

    rng = random.Random(12)
    reads = [bases(rng, rng.choice([3, 2000, 9000])) for _ in range(120)]
    path = tmp_path / "long.fastq"
    path.write_bytes(fastq_text(reads).encode() + b"\n@bad \xff\nAC\xc3\n+\n\n")
    monkeypatch.setattr(fastq, "PROBE_BYTES", 1 << 10)
    monkeypatch.setattr(fastq, "BLOCK_BYTES", 1 << 12)
    assert len(fastq.split_offsets(str(path), 50_000)) > 8
    reader = fastq.FastqReader({"path": str(path), "splitBytes": "50000"}, ["seq"])
    got = [b for p in reader.partitions() for b in reader.read(p)]
    assert got[0].schema.names == ["seq"] and [s for b in got for s in b.column("seq").to_pylist()] == [*reads, "AC\ufffd"]
    binary.register(spark)
    assert spark.read.format("fastq").schema("seq string").load(str(path)).columns == ["seq"]
    last = load(spark, path, splitBytes=50_000).orderBy("read_id").collect()[-1]
    assert (last.header, last.qual) == ("@bad \ufffd", "") and len({r.file for r in load(spark, path).select("file").collect()}) == 1
    with pytest.raises(Exception, match="no such column"):
        spark.read.format("fastq").schema("sequence string").load(str(path)).count()


def test_fastq_without_qualities(spark, tmp_path):
    text = "".join(f"@r{i}\nACGTACGT\n+\n{'IIIIIIII' if i % 3 else ''}\n" for i in range(500))
    (tmp_path / "q.fastq").write_text(text)
    assert len(fastq.split_offsets(str(tmp_path / "q.fastq"), 2000)) > 4
    assert load(spark, tmp_path / "q.fastq", splitBytes=2000).select("header").distinct().count() == 500


def test_hot_root_and_single_file(spark, tmp_path):
    """A root with nearly all records, and one file of first sightings, are written by several tasks side by side."""
    keys = ["AAAA" + "".join("ACGT"[i >> s & 3] for s in range(0, 14, 2)) for i in range(1 << 14)] + ["TTTTACGTACG", "CGCGACGTACG"]
    df = spark.createDataFrame([(k, i % 50 + 1) for i, k in enumerate(keys)], "kmer string, cnt long").distinct()
    rows = df.selectExpr("IF(kmer LIKE 'AAAA%', 0, IF(kmer LIKE 'TTTT%', 255, 102)) AS root", "kmer", "cnt").repartition(5)
    binary.write_root(rows, f"{tmp_path}/r", 11)
    assert {tuple(r) for r in binary.read_root(spark, f"{tmp_path}/r", 11).collect()} == {tuple(r) for r in rows.collect()}
    assert binary.root_catalog(f"{tmp_path}/r", 11)[0] == df.where("kmer LIKE 'AAAA%'").count() and len(os.listdir(tmp_path / "r")) == 256
    binary.write_low(df, f"{tmp_path}/low.bin", 11, single=True)
    binary.write_low(df, f"{tmp_path}/low.bin", 11, single=True)  # again, over the old one
    want = sorted(r.kmer for r in df.collect())
    assert [r.kmer for r in binary.read_low(spark, f"{tmp_path}/low.bin", 11).collect()] == want
    packed = binary.read_packed(spark, f"{tmp_path}/low.bin", 11).collect()
    assert b"".join(bytes(r.packed) for r in packed) == codecs.pack_low(codecs.keys_to_words(want, 11), 11) == (tmp_path / "low.bin").read_bytes()
    assert not [x for x in os.listdir(tmp_path) if "writing" in x]


WORDS33 = [(0x0123456789ABCDEF, 0xC0000000000000FF), (0xFEDCBA9876543210, 0x8000000000001234), (0x1111222233334444, 0x40000000FFFFFFFF)]


def test_low_layout():
    words = np.array(WORDS33, np.uint64)
    packed = codecs.pack_low(words, 33)
    assert packed.hex() == "efcdab8967452301c01032547698badcfe80444433332222111140"
    assert (codecs.unpack_low(packed, 33) == codecs.mask_words(words, 33)).all()
    names = {"0123456789abcdefc000000000000000": "AAACAGATCACCCGCTGAGCGGGTTATCTGTTT", "11111111111111118000000000000000": "ACACACACACACACACACACACACACACACACG"}
    for hexed, key in names.items():
        w = np.array([[int(hexed[:16], 16), int(hexed[16:], 16)]], np.uint64)
        assert codecs.words_to_keys(w, 33) == [key] and (codecs.keys_to_words([key], 33) == w).all()


@pytest.mark.parametrize("k", [1, 4, 21, 31, 32, 33, 41, 63, 64, 65, 96, 127, 128])
def test_codec_round_trips(k):
    import random

    rng = random.Random(k)
    keys = [bases(rng, k) for _ in range(500)] + ["T" * k, "A" * k]
    words = codecs.keys_to_words(keys, k)
    assert codecs.words_to_keys(codecs.unpack_low(codecs.pack_low(words, k), k), k) == keys
    counts = np.arange(len(keys)) % 100_000 + 1
    again, n = codecs.unpack_root(codecs.pack_root(words, counts, k), k)
    assert (again == words).all() and (n == counts).all()
    assert len(codecs.pack_root(words, counts, k)) == len(keys) * {1: 16, 2: 24, 4: 40}[words.shape[1]]


def test_codec_large_and_errors():
    i = np.arange(60_000, dtype=np.uint64)
    words = np.stack([np.uint64(0x0123456789ABCDEF) ^ (i * np.uint64(0x9E3779B97F4A7C15)), np.uint64(0xC000000000000000) | i], 1)
    assert (codecs.unpack_low(codecs.pack_low(words, 33), 33) == codecs.mask_words(words, 33)).all()
    assert codecs.unpack_low(b"", 33).shape == (0, 2)
    for f in (lambda: codecs.unpack_low(b"x" * 10, 33), lambda: codecs.unpack_root(b"x", 33), lambda: codecs.keys_to_words(["AN"], 2), lambda: codecs.keys_to_words(["A"], 2), lambda: codecs.pack_root(words[:1], [2**32], 64)):
        with pytest.raises(ValueError):
            f()


def test_binary_sources(spark, tmp_path):
    import random

    rng = random.Random(3)
    keys = sorted({bases(rng, 33) for _ in range(3000)})
    low = spark.createDataFrame([(k,) for k in keys], "kmer string").repartition(5)
    for single, name in ((True, "low.bin"), (False, "low_parts")):
        binary.write_low(low, str(tmp_path / name), 33, single)
        assert sorted(r.kmer for r in binary.read_low(spark, str(tmp_path / name), 33).collect()) == keys
    assert (tmp_path / "low.bin").stat().st_size == 9 * len(keys)
    rooted = low.select(F.pmod(F.xxhash64("kmer"), F.lit(256)).cast("int").alias("root"), "kmer", F.length("kmer").cast("long").alias("cnt"))
    binary.write_root(rooted, str(tmp_path / "roots"), 33)
    assert len(os.listdir(tmp_path / "roots")) == 256
    got = binary.read_root(spark, str(tmp_path / "roots"), 33)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rooted.collect()))
    assert sum(binary.root_catalog(str(tmp_path / "roots"), 33).values()) == len(keys)
    split = spark.read.format("kmer_low").option("k", 33).option("splitRecords", 100).load(str(tmp_path / "low.bin"))
    assert split.rdd.getNumPartitions() == -(-len(keys) // 100) and split.count() == len(keys)
    for r in range(256):
        os.remove(tmp_path / "roots" / f"root_{r}.bin")
    (tmp_path / "roots" / "root_0.bin").write_bytes(b"x")
    with pytest.raises(Exception, match="not divisible"):
        binary.read_root(spark, str(tmp_path / "roots"), 33).count()


def test_empty_binary_output(spark, tmp_path):
    low = spark.createDataFrame([], "kmer string")
    binary.write_low(low, str(tmp_path / "none"), 21)
    assert binary.read_low(spark, str(tmp_path / "none"), 21).count() == 0
    binary.write_root(spark.createDataFrame([], "root int, kmer string, cnt long"), str(tmp_path / "roots"), 21)
    assert binary.read_root(spark, str(tmp_path / "roots"), 21).count() == 0


def test_scratch_is_dropped(spark):
    from kmerloom import session

    with pytest.raises(KeyError), session.scratch(spark):
        path = session.materialize(spark.range(3), "gone").inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
        raise KeyError
    assert not os.path.exists(os.path.dirname(path))


def test_drop_written(spark):
    from kmerloom import session

    df = session.materialize(spark.range(5), "x")
    path = session._WRITTEN[-1].removeprefix("file://")
    assert df.count() == 5 and os.path.isdir(path)
    kept, session._WRITTEN[:] = session._WRITTEN[:-1], session._WRITTEN[-1:]
    assert session.drop_written(spark) == 1 and not os.path.isdir(path)
    session._WRITTEN[:] = kept


def test_text_sinks(spark, tmp_path):
    s = spark.createDataFrame([(2, 0), (1, 5), (3, 7)], "freq long, n long")
    tables.write_spectrum(s, str(tmp_path / "s"))
    (name,) = [x for x in os.listdir(tmp_path / "s") if x.endswith(".csv")]
    assert (tmp_path / "s" / name).read_text() == "1\t5\n2\t0\n3\t7\n"
    tables.write_histogram(s, str(tmp_path / "h"))
    (name,) = [x for x in os.listdir(tmp_path / "h") if x.endswith(".csv")]
    assert (tmp_path / "h" / name).read_text() == "count\tnum_kmers\n1\t5\n3\t7\n"


@pytest.mark.parametrize("kind", ["parquet", "binary"])
def test_command_line(spark, tmp_path, kind):
    (tmp_path / "r.fastq").write_text(fastq_text(FIXTURE))
    out = str(tmp_path / "out")
    assert cli.main(["count", str(tmp_path / "r.fastq"), "3", out, "--format", kind], spark) == 0
    pieces = out if kind == "parquet" else out + "/bin"
    cli.main(["spectrum", "precise", pieces, "3", str(tmp_path / "s"), "--max-freq", "16", "--format", kind], spark)
    (name,) = [x for x in os.listdir(tmp_path / "s") if x.endswith(".csv")]
    lines = dict(map(int, x.split("\t")) for x in (tmp_path / "s" / name).read_text().splitlines())
    assert len(lines) == 16 and {f: n for f, n in lines.items() if n} == {2: 1, 9: 1, 16: 1}
    cli.main(["postprocess", pieces, "3", str(tmp_path / "p"), "--format", kind], spark)
    assert spark.read.parquet(str(tmp_path / "p/final_root")).count() == 3
    with pytest.raises(SystemExit):
        cli.main(["count", "x", "129", "y"], spark)


def test_streams(spark, tmp_path):
    reads = spark.createDataFrame([(r, f"2026-03-0{1 + i % 3} 00:00:00") for i, r in enumerate(FIXTURE)], "seq string, t string").select("seq", F.to_timestamp("t").alias("t"))
    reads.repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = streaming_counts(source, 3).writeStream.outputMode("complete").format("memory").queryName("kmers_so_far").trigger(availableNow=True).start()
    run.awaitTermination()
    assert {r.kmer: r.cnt for r in spark.table("kmers_so_far").collect()} == {"AAT": 2, "ATG": 9, "GCA": 16}
    run = windowed_counts(source, 3, "t", "1 day", "1 day").writeStream.outputMode("update").format("memory").queryName("kmers_by_day").trigger(availableNow=True).start()
    run.awaitTermination()
    final = spark.table("kmers_by_day").groupBy("window", "kmer").agg(F.max("cnt").alias("c"))
    assert final.agg(F.sum("c")).first()[0] <= 27 and final.count() >= 3


def test_partition_pruning(spark, tmp_path):
    counts = counting.count_kmers(spark.createDataFrame([(r,) for r in FIXTURE * 2], "seq string"), 4)
    tables.write_counts(counting.first_sightings(counts), counting.repeats(counts), str(tmp_path))
    roots = counting.repeats(counts).collect()
    for root in {r.root for r in roots}:
        one = tables.read_counts(spark, str(tmp_path))[1].where(F.col("root") == root)
        assert {(r.kmer, r.cnt) for r in one.collect()} == {(r.kmer, r.cnt) for r in roots if r.root == root}
        assert "root#" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1].split("]")[0]

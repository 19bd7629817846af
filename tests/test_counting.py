import random

import pytest
from brute import FIXTURE, bases, count_reads, stored_key
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kmerloom.functions import sequence as S
from kmerloom.operators import counting, kmers, postprocess, spectrum

WIDTHS = (1, 4, 21, 31, 32, 33, 41, 62, 63, 64, 65, 96, 127, 128)


def frame(spark, reads):
    return spark.createDataFrame([(r,) for r in reads], "seq string")


def as_dict(df):
    return {r["kmer"]: r["cnt"] for r in df.collect()}


@pytest.mark.parametrize("method", ["arrays", "sql"])
@pytest.mark.parametrize("k,total,expected", [(3, 27, {"AAT": 2, "ATG": 9, "GCA": 16}), (4, 21, {"AATG": 2, "ATGC": 9, "CATG": 3, "TGCA": 7})])
def test_fixture_counts(spark, method, k, total, expected):
    got = as_dict(counting.count_kmers(frame(spark, FIXTURE), k, method=method))
    assert got == expected
    assert sum(got.values()) == total


@pytest.mark.parametrize("k", WIDTHS)
def test_arrays_equal_sql_and_brute_force(spark, k):
    rng = random.Random(k)
    reads = [bases(rng, 150) for _ in range(12)]
    reads += [reads[0], reads[1][::-1].translate(str.maketrans("ACGT", "TGCA")), reads[2].lower(), reads[3].replace("T", "U"), reads[4][:70] + "N" + reads[4][71:], None, "", "é" * 9 + reads[5]]
    expected = dict(count_reads(reads, k))
    assert as_dict(counting.count_kmers(frame(spark, reads), k)) == expected
    assert as_dict(counting.count_kmers(frame(spark, reads), k, method="sql")) == expected


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ACGTacgtuUN\r-é", max_size=40), max_size=6), st.integers(1, 12))
def test_random_texts(spark, reads, k):
    assert as_dict(counting.count_kmers(frame(spark, reads), k)) == dict(count_reads(reads, k))


def test_invariants(spark):
    rng = random.Random(5)
    reads = [bases(rng, 80) for _ in range(5)]
    twin = [r[::-1].translate(str.maketrans("ACGT", "TGCA")) for r in reads]
    assert count_reads(reads, 21) == count_reads(twin, 21)
    counts = as_dict(counting.count_kmers(frame(spark, reads), 21))
    assert counts == as_dict(counting.count_kmers(frame(spark, twin), 21))
    assert sum(counts.values()) == sum(max(0, len(r) - 20) for r in reads)


def test_very_long_read_and_extra_columns(spark):
    rng = random.Random(6)
    long = bases(rng, 300_000)
    df = spark.createDataFrame([(long, 1, "x")], "seq string, kmer int, cnt string")
    assert as_dict(counting.count_kmers(df, 31)) == dict(count_reads([long], 31))


def test_empty_and_errors(spark):
    empty = frame(spark, [])
    assert counting.count_kmers(empty, 5).count() == 0
    assert counting.totals(counting.count_kmers(empty, 5)).first().asDict() == {"total": 0, "distinct_keys": 0, "repeated_keys": 0, "largest": 0}
    for k in (0, 129):
        with pytest.raises(ValueError):
            counting.count_kmers(empty, k)
    with pytest.raises(ValueError):
        counting.count_kmers(empty, 5, min_count=3, max_count=2)
    with pytest.raises(ValueError):
        counting.count_kmers(empty, 5, method="tree")


def test_count_range_and_compat(spark):
    reads = ["AAAAAAAA", "CCGT", "CCGT", "CATC"]  # AAAA/TTTT 5, CCGT 2, CATC 1
    raw = as_dict(counting.count_kmers(frame(spark, reads), 4))
    assert sorted(raw.values()) == [1, 2, 5]
    assert sorted(as_dict(counting.count_kmers(frame(spark, reads), 4, min_count=2, max_count=4)).values()) == [2]
    compat = as_dict(counting.count_kmers(frame(spark, reads), 4, min_count=2, compat="root_count"))
    assert sorted(compat.values()) == [1, 1, 5]


def test_merge_and_spectra(spark):
    """Keys in both pieces, in root only, in low only, repeated rows, nulls."""
    low = spark.createDataFrame([("A",), ("B",), ("B",), ("C",), (None,)], "kmer string")
    root = spark.createDataFrame([("A", 2), ("A", 2), ("D", 4), ("C", None), (None, 3)], "kmer string, cnt long")
    merged = counting.merge_low_root(low, root)
    assert as_dict(merged) == {"A": 3, "B": 1, "C": 1, "D": 4}
    assert {r.freq: r.n for r in spectrum.precise(merged).collect()} == {1: 2, 3: 1, 4: 1}
    wanted = spark.createDataFrame([("A",), ("Z",), (None,)], "kmer string")
    assert [(r.kmer, r.cnt) for r in counting.lookup_counts(merged, wanted).orderBy("kmer").collect()] == [(None, None), ("A", 3), ("Z", 0)]
    assert [r.kmer for r in counting.members(wanted, merged).collect()] == ["A"]


GOLDEN = [
    # low, root, range, expected
    (["a", "b", "c", "e"], {"a": 2, "c": 1, "e": 4}, (1, 4), [1, 1, 1, 0]),
    (["g", "h", "i", "j"], {"g": 1, "h": 2, "i": 5}, (3, 5), [1, 0, 0]),
    (["x"], {"x": 1}, (1, 3), [0, 1, 0]),
]


@pytest.mark.parametrize("low,root,span,expected", GOLDEN)
def test_golden_spectra(spark, low, root, span, expected):
    lo = spark.createDataFrame([(x,) for x in low], "kmer string")
    ro = spark.createDataFrame(list(root.items()), "kmer string, cnt long")
    got = [r.n for r in spectrum.spectrum(lo, ro, *span).orderBy("freq").collect()]
    assert got == expected


def test_approximate_and_legacy(spark):
    lo = spark.createDataFrame([("a",), ("b",), ("c",), ("e",)], "kmer string")
    ro = spark.createDataFrame([("a", 2), ("c", 1), ("e", 4)], "kmer string, cnt long")
    assert [r.n for r in spectrum.spectrum(lo, ro, 1, 4, "approximate").orderBy("freq").collect()] == [1, 1, 0, 1]
    assert {r.freq: r.n for r in spectrum.legacy(lo, ro).collect()} == {1: 1, 2: 1, 3: 1, 5: 1}
    with pytest.raises(ValueError):
        spectrum.spectrum(lo, ro, 1, 4, "exact")
    with pytest.raises(ValueError):
        spectrum.dense(spectrum.legacy(lo, ro), 5, 4)


def test_spectrum_under_false_positives(spark):
    """A first sighting that is taken for a repeat moves from low to root; the merged counts stay."""
    rng = random.Random(7)
    truth = {bases(rng, 12): rng.choice([1, 1, 2, 3, 9]) for _ in range(300)}
    low, root = [], []
    for key, n in truth.items():
        wrong = rng.random() < 0.1
        if not wrong:
            low.append((key,))
        if n - (not wrong):
            root.append((key, n - (not wrong)))
    merged = counting.merge_low_root(spark.createDataFrame(low, "kmer string"), spark.createDataFrame(root, "kmer string, cnt long"))
    assert as_dict(merged) == truth


def test_postprocess_and_rank(spark):
    low = spark.createDataFrame([("CCCC",), ("AAAA",), ("AAAA",), ("GGGG",)], "kmer string")
    root = spark.createDataFrame([(170, "GGGG", 3), (255, "TTTT", 1)], "root int, kmer string, cnt long")
    done = postprocess.postprocess(low, root)
    assert [r.kmer for r in done.final_low.collect()] == ["AAAA", "CCCC"]
    assert [r.kmer for r in done.final_root.collect()] == ["GGGG", "TTTT"]
    assert {r.freq: r.n for r in done.histogram.collect()} == {1: 2, 2: 1, 4: 1}
    many = spark.createDataFrame([(f"{(i * 37) % 1000:04d}",) for i in range(1000)], "kmer string").repartition(7)
    assert [(r.rank, r.kmer) for r in postprocess.ranked(many, "kmer").orderBy("rank").collect()] == [(i + 1, f"{i:04d}") for i in range(1000)]


def test_column_functions(spark):
    rng = random.Random(8)
    rows = [(bases(rng, 21),) for _ in range(200)]
    df = spark.createDataFrame(rows, "w string").select("w", S.stored_key(F.col("w")).alias("key"), S.canonical(F.col("w")).alias("c"))
    df = df.withColumn("p", S.pack_key(F.col("key"), 21)).select("*", S.unpack_key(F.col("p"), 21).alias("again"), S.packed_root(F.col("p")).alias("r"), S.root_number(F.col("key")).alias("r2"), S.root_text(S.packed_root(F.col("p"))).alias("t"))
    for r in df.collect():
        assert r.key == stored_key(r.w) == r.again == r.c[::-1]
        assert r.r == r.r2 and r.t == r.key[:4]
    arrays = spark.createDataFrame([("ACGTNacgtu",), (None,), ("AC",)], "s string").select(kmers.kmers_of(F.col("s"), 3).alias("k")).collect()
    assert arrays[0].k == [stored_key(x) for x in ("ACG", "CGT", "ACG", "CGT", "GTT")] and arrays[1].k is None and arrays[2].k == []


def test_record_sizes():
    assert {k: S.packed_bytes(k) for k in (1, 4, 21, 31, 32, 33, 41, 63, 64, 65, 96, 127, 128)} == {
        1: 1, 4: 1, 21: 6, 31: 8, 32: 8, 33: 9, 41: 11, 63: 16, 64: 16, 65: 17, 96: 24, 127: 32, 128: 32,
    }
    assert [S.words_for_k(k) for k in (1, 32, 33, 64, 65, 128)] == [1, 1, 2, 2, 4, 4]


@pytest.mark.parametrize("k", [3, 31, 64])
def test_long_texts_are_cut_with_overlap(spark, monkeypatch, k):
    """A text far longer than a chunk gives the counts of its windows, by arrays and by SQL; nothing is lost or doubled at cuts."""

    rng = random.Random(k)
    text = bases(rng, 30_000) + "N" + bases(rng, 4099)
    want = count_reads([text], k)
    monkeypatch.setattr(kmers, "CHUNK_BYTES", 1000)
    assert all(len(p) <= 1000 + k - 1 + 1000 for p in kmers.overlapping([text.encode()], k))
    reads = spark.createDataFrame([(text,)], "seq string")
    for method in ("arrays", "sql"):
        assert {r.kmer: r.cnt for r in counting.count_kmers(reads, k, method=method).collect()} == want


def test_build_side_skip_changes_no_spectrum(spark):

    low = spark.createDataFrame([(x,) for x in ("A", "B", "C", "D", "D")], "kmer string")
    root = spark.createDataFrame([("B", 1), ("C", 4), ("E", 2), ("F", 9), ("D", None)], "kmer string, cnt long")
    for lo, hi in ((1, 12), (2, 6), (3, 5), (4, 12)):
        got = {r.freq: r.n for r in spectrum.spectrum(low, root, lo, hi).collect()}
        counts = {"A": 1, "B": 2, "C": 5, "D": 1, "E": 2, "F": 9}
        assert got == {f: sum(v == f for v in counts.values()) for f in range(lo, hi + 1)}
    assert spectrum.reachable(root, 4).count() == 2

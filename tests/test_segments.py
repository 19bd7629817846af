"""Counts of wide keys: what is shuffled, and the same counts under small limits."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import bases, count_reads

from kmerloom.operators import counting, kmers, segments


def shuffled_bytes(df) -> int:
    """Bytes that the plan of df, which has run, wrote for its shuffles."""

    def walk(node) -> int:
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if name.endswith("QueryStage"):
            return walk(node.plan())
        own = node.metrics().get("shuffleBytesWritten")
        n = own.get().value() if name.startswith("Exchange") and own.isDefined() else 0
        return n + sum(walk(node.children().apply(i)) for i in range(node.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("k", [64, 65])
def test_shuffle_of_wide_keys_is_small(spark, k):
    """Reads of 160 bases, ten times each: the shuffle is a few times the reads at 2 bits a base, not the keys (8 to 24 bytes a window)."""
    rng = random.Random(k)
    reads = [bases(rng, 160) for _ in range(2000)]
    df = counting.count_kmers(spark.createDataFrame([(r,) for r in reads for _ in range(10)], "seq string"), k)
    got = {r.kmer: r.cnt for r in df.collect()}
    assert got == {key: 10 * n for key, n in count_reads(reads, k).items()}
    assert 0 < shuffled_bytes(df) < 8 * 40 * len(reads)


def _by_bucket(batches) -> list[pa.RecordBatch]:
    """The rows as a shuffle brings them."""
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["bucket"])
    return [pa.RecordBatch.from_pylist(rows[a : a + 9], schema=segments.SCHEMA) for a in range(0, len(rows), 9)]


def _tally(reads, k) -> Counter:
    batches = [pa.RecordBatch.from_pydict({"seq": pa.array(reads[a : a + 7], pa.string())}) for a in range(0, len(reads), 7)]
    pieces = _by_bucket(segments._piece_rows(iter(batches), k))
    parts = _by_bucket(segments._segment_rows(iter(pieces), k))
    got: Counter = Counter()
    for bucket in segments._bucketed(iter(parts)):
        for columns, n in segments._tallied(*bucket, k):
            for *key, count in zip(*(c.tolist() for c in columns), n.tolist(), strict=True):
                text = "".join("ACGT"[(v >> 2 * (w - 1 - i)) & 3] for v, w in zip(key, kmers.chunk_widths(k), strict=True) for i in range(w))
                assert text not in got  # a key comes once
                got[text] = count
    return got


@pytest.mark.parametrize("k", [32, 33, 64, 65, 128])
def test_small_limits_change_nothing(monkeypatch, k):
    """Several rounds before the shuffle, texts and buckets in many pieces, keys in parts by hash; long runs of few bases."""
    rng = random.Random(k)
    reads = [bases(rng, 150) for _ in range(12)]
    reads += [*reads[:3], reads[1][::-1].translate(str.maketrans("ACGT", "TGCA")), reads[3].lower().replace("t", "u"), reads[4][:70] + "N" + reads[4][71:]]
    reads += [None, "", "é" * 9 + reads[5], "A" * 3000, "AC" * 900, reads[6] * 5, "N" * 300]
    want = count_reads(reads, k)
    assert _tally(reads, k) == want
    monkeypatch.setattr(segments, "HELD_BYTES", 2000)
    monkeypatch.setattr(segments, "HELD_KEYS", 60)
    monkeypatch.setattr(kmers, "CHUNK_BYTES", 700)
    assert _tally(reads, k) == want


def test_equal_hashes_keep_keys_apart(monkeypatch):
    """Different keys that share a hash are still one row each."""
    monkeypatch.setattr(kmers, "mixed", lambda columns: np.zeros(len(columns[0]), np.uint64))
    columns, n = kmers.counted([np.array([1, 2, 1, 2, 1]), np.array([5, 5, 5, 6, 5])], np.array([1, 10, 100, 1000, 10000]))
    assert sorted(zip(*(c.tolist() for c in columns), n.tolist(), strict=True)) == [(1, 5, 10101), (2, 5, 10), (2, 6, 1000)]

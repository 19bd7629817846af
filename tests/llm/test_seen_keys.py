import random

import numpy as np
import pyarrow as pa
import pytest
from brute import bases, pack, stored_key

from kmerloom.llm import seen_keys
from kmerloom.llm.golomb import GolombSet, GrowingSet, bounded_set, reduce_hashes, target_range

ARRIVALS = "arrival_id long, canonical_kmer string, form string, feed string, kmer string"
PLAN = "root int, prefix string, bloom_filter_capacity long"


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 129, 5000])
@pytest.mark.parametrize("r", [0, 1, 7, 12])
def test_round_trip(n, r):
    rng = np.random.default_rng(n + r)
    values = np.unique(rng.integers(0, max(1, n) << r, n))
    s = GolombSet.encode(values, r)
    assert (s.decode() == values).all() and s.size == len(values)
    probes = rng.integers(0, max(1, n) << r, 700)
    assert (s.contains(probes) == np.isin(probes, values)).all()
    assert not len(s.contains(np.zeros(0, np.int64)))


def test_wide_gaps_and_size():
    values = np.array([0, 5, 10_000, 10_001, 9_000_000])
    assert (GolombSet.encode(values, 4).decode() == values).all()
    rng = np.random.default_rng(1)
    n = 50_000
    s = GolombSet.encode(np.unique(rng.integers(0, n << 10, n)), 10)
    assert s.bits / s.size < 10 + 2.6
    assert 900 << 20 < target_range(1000, 64 * 1000, 20) <= 1000 << 20
    assert 16 < target_range(1000, 8000, 20) / 1000 < 64 and target_range(1000, 100, 20) == 0 == target_range(0, 1e9, 20)
    assert (reduce_hashes(np.array([-1, 5, -(2**63)]), 100) < 100).all()


def make(rng, n=900):
    low = [bases(rng, 21) for _ in range(250)]
    low = [stored_key(x) for x in low]
    hot = bases(rng, 21)
    rows = []
    for i in range(n):
        pick = rng.random()
        w = hot if pick < 0.33 else rng.choice(low)[::-1] if pick < 0.5 else bases(rng, 21)
        form = rng.choice(["key", "window"])
        text = w if form == "window" else stored_key(w)
        if rng.random() < 0.1:
            text = rng.choice([text.lower(), text.replace("T", "U"), f" {text}\r", text[:20], text[:20] + "N", None, ""])
        rows.append((i if i != 5 else None, text, form, None, "clash"))
    rows += rng.choices(rows, k=n // 6)
    rng.shuffle(rows)
    return low, rows


def brute(low, rows):
    known, first, seen = set(low), {}, set()
    keyed = []
    for i, text, form, *_ in rows:
        if i is None or text is None:
            continue
        t = text.strip(" \r\n\t").translate(str.maketrans("acgtuU", "ACGTTT"))
        if len(t) == 21 and not set(t) - set("ACGT"):
            keyed.append((i, stored_key(t) if form == "window" else t))
    for i, k in keyed:
        first[k] = min(i, first.get(k, i))
    for i, k in keyed:
        if k in known or first[k] < i:
            seen.add(i)
    return seen


@pytest.mark.parametrize("bits", [1, 12])
def test_equals_brute_force(spark, bits):
    """One bit a key gives many false positives: none may reach the result, none may be missed."""
    low, rows = make(random.Random(bits))
    a = spark.createDataFrame(rows, ARRIVALS)
    lo = spark.createDataFrame([(k, 1) for k in [*low, *low[:20], low[0].lower(), None, "ACGT"]], "kmer string, batch int")
    plan = spark.createDataFrame([(i, "x", 32768) for i in range(200)], PLAN)
    s = seen_keys.SeenKeys(a, lo, plan, most_bits=bits)
    assert sorted(r.arrival_id for r in s.seen().collect()) == sorted(brute(low, rows))
    report = s.report().collect()
    assert all(r.used_bits <= r.granted_bits for r in report)
    assert sum(r.old_keys for r in report) == len(set(low))
    ids = {i for i, t, *_ in rows if i is not None}
    assert sum(r.probes + r.folded for r in report) >= len(brute(low, rows)) and len(ids) > 0
    assert all(r.positives == r.right + r.wrong for r in report)
    if bits == 1:
        assert sum(r.wrong for r in report) > 20
        fresh = sum(r.wrong / r.audited_rate for r in report if r.wrong)
        assert fresh > 0 and all(0 <= r.theoretical_rate <= 0.85 for r in report if r.theoretical_rate is not None)


@pytest.mark.parametrize("n", [1, 50, 3000, 40_000])
@pytest.mark.parametrize("bits", [0, 60, 200, 3000, 40_000, 200_000])
def test_sets_stay_within_any_grant(n, bits):
    """Used is never above granted, nothing is missed, and the wrong answers follow the occupancy."""
    rng = np.random.default_rng(n + bits)
    keys, others = rng.integers(-(2**63), 2**63 - 1, n), rng.integers(-(2**63), 2**63 - 1, 20_000)
    s, modulus = bounded_set(keys, bits, 12)
    if s is None:
        assert modulus == 0 and bits < 600
    else:
        assert s.bits <= bits and s.contains(reduce_hashes(keys, modulus)).all()
        share = s.size / modulus
        assert abs(s.contains(reduce_hashes(others, modulus)).mean() - share) < 6 * (share * (1 - share) / 20_000) ** 0.5 + 2e-4
    new, wrong, chances = GrowingSet(n, bits, 12, 4096, 4), 0, 0.0
    twice = np.concatenate([keys, keys])
    answers = []
    for a in range(0, len(twice), new.batch):
        part = twice[a : a + new.batch]
        found, chance = new.probe(part, np.zeros(len(part), bool))
        answers.append(found)
        first = np.arange(a, a + len(part)) < n
        wrong, chances = wrong + int((found & first).sum()), chances + float(chance[first].sum())
    assert new.peak_bits <= bits and np.concatenate(answers)[n:].all()
    assert abs(wrong - chances) <= 6 * chances**0.5 + 3


@pytest.mark.parametrize("words", [0, 1, 30, 400])
def test_tiny_grants(spark, words):
    """The answer stays exact; the audited rate is near the theoretical one."""
    low, rows = make(random.Random(77), 700)
    plan = spark.createDataFrame([(i, "x", words) for i in range(256)], PLAN)
    s = seen_keys.SeenKeys(spark.createDataFrame(rows, ARRIVALS), spark.createDataFrame([(k,) for k in low], "kmer string"), plan)
    assert {r.arrival_id for r in s.seen().collect()} == brute(low, rows)
    report = s.report().collect()
    assert all(r.used_bits <= r.granted_bits == 64 * words for r in report)
    assert all(r.within_grant and r.as_expected for r in s.audit().collect())
    assert words > 1 or all(r.theoretical_rate in (1.0, None) for r in report)


def test_no_aggregate_over_all_old_keys(spark):
    """Old keys and arrivals are cut down to the positives' keys before any exact aggregate."""
    low, rows = make(random.Random(3), 300)
    plan = spark.createDataFrame([], PLAN)
    s = seen_keys.SeenKeys(spark.createDataFrame(rows, ARRIVALS), spark.createDataFrame([(k,) for k in low], "kmer string"), plan)
    text = s.seen()._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join LeftSemi") == 2


def test_small_batches_and_runs(spark, monkeypatch):
    """Many runs are merged: a later batch still sees all earlier ones."""
    monkeypatch.setattr(seen_keys, "BATCH", 3)
    monkeypatch.setattr(seen_keys, "RUNS", 2)
    low, rows = make(random.Random(9), 400)
    rows = [(i, "AAAA" + t[4:] if t and len(t) == 21 and f == "key" and i and i % 3 else t, f, x, y) for i, t, f, x, y in rows]
    plan = spark.createDataFrame([], PLAN)
    got = seen_keys.seen_before(spark.createDataFrame(rows, ARRIVALS), spark.createDataFrame([(k,) for k in low], "kmer string"), plan)
    assert {r.arrival_id for r in got.collect()} == brute(low, rows)


def test_hot_key_leaves_few_rows(spark):
    """A third of all rows hold one key: a row a batch is left of them; other keys go to the sets with all their rows."""
    key = "IF(id % 3 = 0, repeat('G', 21), lpad(translate(conv(id div 5, 10, 4), '0123', 'ACGT'), 21, 'A'))"
    rows = spark.range(0, 30_000, 1, 1).selectExpr("30000 - id AS arrival_id", f"{key} AS canonical_kmer", "'key' AS form")
    out = seen_keys.fold_hot(rows)
    hot = f"key = {pack('G' * 21)}"
    assert out.count() == 30_000 and out.where(f"{hot} AND NOT folded").count() <= 3 and out.where(f"NOT {hot} AND folded").count() == 0


def test_packed_keys():
    """The array form equals the plain one, whatever stands in the text."""
    rng = random.Random(6)
    texts = [bases(rng, 21) for _ in range(200)] + [None, "", "A" * 20, "A" * 22, "A" * 20 + "N", "É" * 21, "A" * 19 + "É", "x" * 10_000]
    texts += [f" \t{t}\r\n" for t in texts[:9]] + [t.lower().replace("t", "u") for t in texts[:9]] + ["A" * 10 + " " + "A" * 10]
    window = np.array([rng.random() < 0.5 for _ in texts])
    keys, rows = seen_keys.packed_keys(pa.array(texts), window)
    want = {}
    for i, t in enumerate(texts):
        t = (t or "").strip(" \t\r\n").translate(str.maketrans("acgtuU", "ACGTTT"))
        if len(t) == 21 and not set(t) - set("ACGT"):
            want[i] = pack(stored_key(t) if window[i] else t)
    assert dict(zip(rows.tolist(), keys.tolist(), strict=True)) == want
    assert not len(seen_keys.packed_keys(pa.array([], pa.string()))[0])


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(seen_keys, "SHARD_KEYS", 2)
    low, rows = make(random.Random(10), 300)
    s = seen_keys.SeenKeys(spark.createDataFrame(rows, ARRIVALS), spark.createDataFrame([(k,) for k in low], "kmer string"), spark.createDataFrame([], PLAN))
    assert s.blocks.select("shard").distinct().count() > 1
    assert {r.arrival_id for r in s.seen().collect()} == brute(low, rows)


def test_nothing(spark):
    a, lo, plan = spark.createDataFrame([], ARRIVALS), spark.createDataFrame([], "kmer string"), spark.createDataFrame([], PLAN)
    assert seen_keys.seen_before(a, lo, plan).count() == 0
    one = spark.createDataFrame([(1, "A" * 21, "key", None, None), (2, "A" * 21, "key", None, None)], ARRIVALS)
    assert [r.arrival_id for r in seen_keys.seen_before(one, lo, plan).collect()] == [2]

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from brute import SIGHTINGS, bases, pack, stored_key
from pyspark.sql import functions as F

from kmerloom.functions import sequence as S
from kmerloom.llm import distinct, pcsa


def test_estimates_and_errors(spark):
    sizes = {"a": 0, "b": 1, "c": 40, "d": 900, "e": 20_000}
    rows = spark.createDataFrame([(g, n) for g, n in sizes.items()], "g string, n int")
    df = rows.select("g", F.explode(F.sequence(F.lit(1), F.lit(20_000))).alias("v"), "n").where(F.col("v") <= F.col("n"))
    df = df.unionByName(df).unionByName(spark.createDataFrame([("b", None, 1)], "g string, v int, n int"))
    got = {r.g: r for r in pcsa.estimate(pcsa.sketch(df, ["g"], "v"), ["g"]).collect()}
    assert set(got) == {"b", "c", "d", "e"}
    for g, r in got.items():
        assert r.n == 2 * sizes[g]
        assert abs(r.estimate - sizes[g]) <= 5 * r.std_error + 0.01 and r.std_error < 0.03 * sizes[g] + 0.1


def test_union_of_parts_is_the_whole(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("g"), (F.col("id") % 1234).alias("v"))
    whole = {(r.row, r.bits) for r in pcsa.sketch(df, [], "v").collect()}
    parts = pcsa.merge(pcsa.sketch(df, ["g"], "v").unionByName(pcsa.sketch(df.limit(100), ["g"], "v")), [])
    assert {(r.row, r.bits) for r in parts.collect()} == whole


def test_likelihood_is_calibrated():
    rng = np.random.default_rng(3)
    m = 256
    for n in (50, 3000):
        lines = []
        for _ in range(150):
            row = rng.integers(0, m, n)
            z = rng.integers(0, 2**40, n) | (1 << 39)
            bits = np.zeros(m, np.int64)
            np.bitwise_or.at(bits, row, z & -z)
            lines.append([((bits >> r) & 1).sum() for r in range(pcsa.RANKS)])
        est, se = pcsa.likelihood_estimate(np.array(lines), m)
        assert abs(est.mean() - n) < 4 * se.mean() / 150**0.5
        assert 0.75 < est.std() / se.mean() < 1.3
    assert pcsa.likelihood_estimate(np.zeros((1, pcsa.RANKS)), m)[0] == 0


def test_bad_width(spark):
    with pytest.raises(ValueError):
        pcsa.sketch(spark.range(3), [], "id", 100)


def rows_of(rng):
    out, i = [], 0
    for sample, share in (("S1", 0.2), (" s2\r", 0.9), ("S3", 0.75), ("S4", 0.74)):
        for day in (1, 2, 3):
            n = 200 if day < 3 else 30
            pool = [bases(rng, 21) for _ in range(round(n * share))]
            for j in range(n):
                key = stored_key(pool[j % len(pool)])
                out.append((i, i, 0, None, pack(key), sample, 1, f"2026-03-0{day} 10:00:00", None))
                i += 1
    out += [(i + 1, 1, 0, None, pack("A" * 21), None, None, "2026-03-01 00:00:00", None), (i + 2, 1, 0, None, pack("A" * 21), "S1", None, None, None)]
    return out + out[::9]


def test_groups_equal_brute_force(spark):
    """Ratios at the bar, below it and far from it; small groups, nulls, repeated rows."""
    rows = rows_of(random.Random(1))
    df = spark.createDataFrame(rows, SIGHTINGS.replace("timestamp", "string")).withColumn("seen_at", F.to_timestamp("seen_at"))
    groups = defaultdict(dict)
    for r in rows:
        if r[5] and r[7]:
            groups[r[7][:10], r[5].strip().upper()][r[0]] = r[4]
            groups["*", r[5].strip().upper()][r[0]] = r[4]
    want = {g for g, x in groups.items() if len(x) >= 50 and len(set(x.values())) >= 0.75 * len(x)}
    assert {(r.seen_day, r.sample_id) for r in distinct.diverse_groups(df).collect()} == want
    assert len(want) >= 4
    cube = {(r.grouping, r.seen_day, r.sample_id, r.lane, r.prefix): r for r in distinct.distinct_cube(df).collect()}
    for (day, sample), x in groups.items():
        r = cube["seen_day+sample_id" if day != "*" else "sample_id", day, sample, "*", "*"]
        if day != "*":
            assert r.n == len(x)
        assert r.low - 1 <= len(set(x.values())) <= r.high + 1
    assert ("sample_id", "*", "?", "*", "*") in cube


def test_cube_has_every_combination(spark):
    """All 16 groupings, each with its groups, rows and distinct keys; a sample named ? is one with the unknown."""
    rng = random.Random(4)
    pool = [stored_key(bases(rng, 21)) for _ in range(40)]
    rows = [
        (i, i, 0, None, pack(key), rng.choice(["S1", " s2", "?", None]), rng.choice([1, 2, None]), rng.choice(["2026-03-01 10:00:00", "2026-03-02 10:00:00", None]), None)
        for i, key in enumerate(rng.choices(pool, k=400))
    ]
    df = spark.createDataFrame(rows + rows[::9], SIGHTINGS.replace("timestamp", "string")).withColumn("seen_at", F.to_timestamp("seen_at"))
    names = ("seen_day", "sample_id", "lane", "prefix")
    usable = distinct.dated_sightings(df).withColumn("prefix", S.root_text(S.packed_root(F.col("key")))).collect()
    assert len(usable) == 400
    want = defaultdict(list)
    for r in usable:
        for size in range(5):
            for g in combinations(names, size):
                want["+".join(g) or "all", *["*" if d not in g else "?" if r[d] is None else str(r[d]) for d in names]].append(r.key)
    got = {(r.grouping, *[r[d] for d in names]): r for r in distinct.distinct_cube(df).collect()}
    assert len({x[0] for x in want}) == 16 and set(got) == set(want)
    for g, keys in want.items():
        assert got[g].n == len(keys) and got[g].low - 1 <= len(set(keys)) <= got[g].high + 1


def test_groupings_roll_up():
    assert len(set(distinct.GROUPINGS)) == 16
    assert all(set(g) < set(distinct.parent_of(g)) and len(distinct.parent_of(g)) == len(g) + 1 for g in distinct.GROUPINGS[1:])


def test_nothing(spark):
    df = spark.createDataFrame([], SIGHTINGS)
    assert distinct.diverse_groups(df).count() == 0
    assert distinct.distinct_cube(df).count() == 0

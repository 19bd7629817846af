import random
from collections import Counter, defaultdict

import pytest
from brute import SIGHTINGS, bases, pack, stored_key
from pyspark.sql import functions as F

from kmerloom.operators import prefix_stats, prefixes, skew
from kmerloom.operators.sightings import usable_sightings


def test_lpt():
    assert skew.lpt([("a", 5), ("b", 4), ("c", 3), ("d", 3)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}
    with pytest.raises(ValueError):
        skew.lpt([], 0)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_equals_plain_join(spark, how):
    rng = random.Random(1)
    keys = [7] * 3000 + [rng.randrange(50) for _ in range(2000)] + [None] * 50
    left = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id long, k int")
    right = spark.createDataFrame([(7, "x", 1), (7, "y", 2), (3, "z", 3), (None, "n", 4), (99, "q", 5)], "k int, v string, id long")
    got = skew.fragment_replicate_join(left, right, "k", ["id"], how, n_tasks=8).select("id", "k", "v").collect()
    want = left.join(right.drop("id"), "k", how).select("id", "k", "v").collect()
    assert Counter(got) == Counter(want)


def test_hot_key_is_spread(spark):
    left = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 500).cast("int").alias("k"))
    plan = skew.plan_tasks(left, "k", 8)
    assert len(set(plan.heavy[1])) >= 2
    sizes = [r["count"] for r in skew.place_fragments(left, "k", plan, ["id"]).groupBy("_task").count().collect()]
    assert max(sizes) < 1.5 * sum(sizes) / 8
    copies = skew.replicate_side(spark.createDataFrame([(1,), (2,)], "k int"), "k", plan).groupBy("k").count().collect()
    assert {r.k: r["count"] for r in copies} == {1: len(set(plan.heavy[1])), 2: 1}


def test_empty_sides(spark):
    left, right = spark.createDataFrame([], "id long, k int"), spark.createDataFrame([], "k int, v string")
    assert skew.fragment_replicate_join(left, right, "k", ["id"]).count() == 0
    one = spark.createDataFrame([(1, 1)], "id long, k int")
    assert [r.v for r in skew.fragment_replicate_join(one, right, "k", ["id"]).collect()] == [None]
    with pytest.raises(ValueError):
        skew.fragment_replicate_join(left, right, "k", ["id"], "full")


def make_sightings(rng, n=600):
    hot = bases(rng, 21)
    rows = []
    for i in range(n):
        w = hot if rng.random() < 0.33 else bases(rng, 21)
        text, data = w, pack(stored_key(w))
        kind = rng.random()
        if kind < 0.1:
            data = None
            text = rng.choice([w.lower(), w + " \r", w.replace("T", "U"), "\r" + w])
        elif kind < 0.15:
            data, text = None, rng.choice([None, w[:20], w[:20] + "N", ""])
        elif kind < 0.2:
            text = None
        rows.append((i, i % 97 if rng.random() < 0.98 else None, 0, text, data, "s", 1, None, None, stored_key(w) if kind < 0.1 or kind >= 0.15 else None))
    rows += rng.choices(rows, k=n // 5)  # delivered again
    return rows


def test_prefix_and_owner_load(spark):
    rows = make_sightings(random.Random(2))
    df = spark.createDataFrame([r[:9] for r in rows], SIGHTINGS)
    plan = spark.createDataFrame([(i, "x", 1, i % 3 if i % 5 else None, 1) for i in range(250)], "root int, prefix string, prefix_counts long, prefix_owners int, bloom_filter_capacity long")
    plan = plan.unionByName(plan.limit(1))
    keys = {r[0]: (r[9], r[1]) for r in rows if r[9]}
    root = lambda k: sum("ACGT".index(c) * 4 ** (3 - i) for i, c in enumerate(k[:4]))
    owner = lambda k: root(k) % 3 if root(k) < 250 and root(k) % 5 else None
    by_prefix, by_owner = defaultdict(list), defaultdict(list)
    for k, r in keys.values():
        by_prefix[k[:4], owner(k)].append((k, r))
        by_owner[owner(k)].append((k, r))
    count = lambda x: (len(x), len({r for _, r in x if r is not None}), len({k for k, _ in x}))
    got = {(r.prefix, r.owner): (r.sightings, r.reads, r.distinct_keys) for r in prefixes.prefix_load(df, plan, 5).collect()}
    assert got == {k: count(v) for k, v in by_prefix.items()}
    got = {r.owner: (r.sightings, r.reads, r.distinct_keys) for r in prefixes.owner_load(df, plan, 5).collect()}
    assert got == {k: count(v) for k, v in by_owner.items()}
    total = Counter(k[:4] for k, _ in keys.values())
    want = {p for p, n in total.items() if n >= 0.04 * len(keys)}
    assert {r.prefix for r in prefixes.dominant_prefixes(df, plan).collect()} == want
    assert usable_sightings(df).count() == len(keys)


@pytest.mark.parametrize("query", [prefixes.dominant_prefixes, prefixes.prefix_load, prefixes.owner_load])
def test_the_plans_side_is_replicated(spark, query):
    """The plan that ran joins the fragments with the copies of the matching side; nothing of it was optimized away."""
    df = spark.createDataFrame([r[:9] for r in make_sightings(random.Random(3))], SIGHTINGS)
    plan = spark.createDataFrame([(i, "x", 1, i % 3, 1) for i in range(256)], "root int, prefix string, prefix_counts long, prefix_owners int, bloom_filter_capacity long")
    out = query(df, plan, n_tasks=5)
    out.collect()
    ran = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ShuffledHashJoin" in ran and ran.count("REPARTITION_BY_ID") + ran.count("shufflepartitionid") + ran.count("ShufflePartitionId") >= 2, ran


def test_loads_are_counted_in_one_pass(spark):
    df = spark.createDataFrame([r[:9] for r in make_sightings(random.Random(4))], SIGHTINGS)
    rows = spark.sparkContext.accumulator(0)
    left = df.select("sighting_id", "lane").mapInArrow(lambda bs: ((rows.add(b.num_rows), b)[1] for b in bs), "sighting_id long, lane int")
    skew.plan_tasks(left, "lane", 4)
    assert rows.value == df.count()


def test_prefixes_of_nothing(spark):
    df = spark.createDataFrame([], SIGHTINGS)
    plan = spark.createDataFrame([], "root int, prefix string, prefix_counts long, prefix_owners int, bloom_filter_capacity long")
    assert prefixes.prefix_load(df, plan).count() == 0
    assert prefixes.dominant_prefixes(df, plan).count() == 0


def test_prefix_statistics(spark):
    counts = spark.createDataFrame([("AAAACCCCGG", 5000), ("AAAATTTTGG", 1), ("TTTTAAAACC", 20), ("AC", 9)], "kmer string, cnt long")
    assert {r.prefix: r.n for r in prefix_stats.prefix_counts(counts).collect()} == {"AAAA": 5001, "TTTT": 20}
    assert {(r.prefix, r.node): r.n for r in prefix_stats.node_counts(counts, 1).collect()} == {("AAAA", "CC"): 5000, ("AAAA", "TT"): 1, ("TTTT", "AA"): 20}
    roots = prefix_stats.all_roots(counts)
    assert prefix_stats.floored_average(roots).first().asDict() == {"total": 5001 + 255_000, "average": (5001 + 255_000) // 256}
    cap = {r.root: r.capacity for r in prefix_stats.bloom_capacity(roots, 600_000_000).collect()}
    words = int((600_000_000 // 3) * (5001 / 260_001) * 4.81 / 64)
    assert cap[0] == 1 << (words - 1).bit_length() and cap[1] == max(1 << 15, 1 << (int((600_000_000 // 3) * (1000 / 260_001) * 4.81 / 64) - 1).bit_length())
    owned = prefix_stats.prefix_owners(roots, 7)
    loads = [r.load for r in prefix_stats.owner_loads(owned).collect()]
    assert sum(loads) == 260_001 and max(loads) - min(loads) <= 1000

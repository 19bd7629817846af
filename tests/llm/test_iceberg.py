import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kmerloom.llm import iceberg


def frame(spark, values, kind="string"):
    return spark.createDataFrame([(v, 1) for v in values], f"v {kind}, value int")


def top(values, k):
    return sorted(Counter(v for v in values if v is not None).items(), key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize("buckets", [4, 64, 1 << 16])
def test_topk_equals_counter(spark, buckets):
    """Few buckets make every value collide: the answer stays exact."""
    rng = random.Random(buckets)
    values = [f"k{min(int(rng.expovariate(0.02)), 400)}" for _ in range(4000)] + ["hot"] * 2000 + [None] * 100
    got = iceberg.iceberg_topk(frame(spark, values), "v", 10, buckets, max(buckets, 64)).orderBy("rank").collect()
    assert [(r.value, r.n) for r in got] == top(values, 10)
    assert [r.rank for r in got] == list(range(1, 11))


def test_ties_and_few_values(spark):
    values = ["b", "a", "c", "a", "b", "c", "d"]
    assert [r.value for r in iceberg.iceberg_topk(frame(spark, values), "v", 2).orderBy("rank").collect()] == ["a", "b"]
    assert [(r.value, r.n) for r in iceberg.iceberg_topk(frame(spark, values), "v", 9).orderBy("rank").collect()] == top(values, 9)


def test_threshold(spark):
    rng = random.Random(2)
    values = [rng.randrange(-300, 300) ** 3 for _ in range(5000)]
    got = {r.value: r.n for r in iceberg.iceberg_counts(frame(spark, values, "long"), "v", 12).collect()}
    assert got == {v: n for v, n in Counter(values).items() if n >= 12}
    got = {r.value: r.n for r in iceberg.iceberg_counts(frame(spark, values, "long"), "v", 12, most_cells=256).collect()}  # seven groups
    assert got == {v: n for v, n in Counter(values).items() if n >= 12}
    cells = iceberg.cell_counts(frame(spark, values, "long").selectExpr("v AS value"), 128, 2).toPandas()
    assert set(cells.h) == {0, 1} and cells.cell.max() < 128 and (cells.groupby("h").n.sum() == 5000).all()


def test_plan_follows_rows_and_threshold():
    assert iceberg.plan_cells(0, 5) == (iceberg.LEAST_CELLS, 1)
    assert iceberg.plan_cells(6_000_000, 50) == (1 << 19, 1)
    assert iceberg.plan_cells(10**10, 100_000) == (1 << 19, 1)
    cells, groups = iceberg.plan_cells(10**10, 1000)
    assert cells == iceberg.MOST_CELLS and groups == 39
    assert 10**10 / (cells * groups) <= 1000 / iceberg.SPREAD


@pytest.mark.parametrize("most", [1 << 20, 1 << 12])
def test_survivors_stay_few(spark, most):
    """300 values of 100 rows among 30,000 of 20: hardly one other passes, with cells enough or with several groups of few."""
    df = spark.range(600_000).selectExpr("id % 30000 AS v").unionByName(spark.range(80 * 300).selectExpr("id % 300 AS v"))
    values = iceberg._values(df, "v")
    cells, groups = iceberg.plan_cells(624_000, 50, most)
    assert (groups > 1) == (most < 1 << 16)
    passed = 0
    for g in range(min(groups, 2)):
        mine = values.where(iceberg._cell(F.col("value"), iceberg.GROUP_SEED, groups) == g)
        passed += iceberg.survivors(mine, iceberg.passing_words(iceberg.cell_counts(mine, cells), 50), cells).distinct().count()
    assert passed <= 0.02 * 30_000 * min(groups, 2) / groups + 300
    if groups == 1:
        assert iceberg.iceberg_counts(df, "v", 50, most).count() == 300


def test_flat_column(spark):
    """No value stands out: the answer is exact all the same."""
    values = [i % 500 for i in range(1000)] + [7]
    got = iceberg.iceberg_topk(frame(spark, values, "int"), "v", 3, 4, 16).orderBy("rank").collect()
    assert [(r.value, r.n) for r in got] == [(7, 3), (0, 2), (1, 2)]


def test_empty_null_long(spark):
    assert iceberg.iceberg_topk(frame(spark, []), "v", 3).count() == 0
    assert iceberg.iceberg_topk(frame(spark, [None, None]), "v", 3).count() == 0
    long = "x" * 100_000
    assert iceberg.iceberg_topk(frame(spark, ["", long, long]), "v", 3).orderBy("rank").first().value == long
    with pytest.raises(ValueError):
        iceberg.iceberg_topk(frame(spark, []), "v", 0)
    with pytest.raises(ValueError):
        iceberg.iceberg_counts(frame(spark, []), "w", 2)


def test_bitmap_holds_the_sign_bit(spark):
    values = spark.range(3000).select(F.col("id").alias("value"))
    counts = spark.createDataFrame([(0, 63, 9), (0, 62, 4)], "h int, cell int, n bigint")
    kept = iceberg.survivors(values, iceberg.passing_words(counts, 5), 128, 1)
    assert kept.where(iceberg._cell(F.col("value"), 0, 128) != 63).count() == 0 and kept.count() > 0

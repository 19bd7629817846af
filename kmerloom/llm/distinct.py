"""Distinct k-mers by day, sample, lane and prefix from mergeable sketches (problem 3)."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.functions import sequence as S
from kmerloom.llm import pcsa
from kmerloom.operators.sightings import usable_sightings
from kmerloom.session import materialize

SIGMAS = 4.0
SLACK = 3.0  # keys: in small groups a few keys share places by chance, and their number is far from normal
DIMENSIONS = ("seen_day", "sample_id", "lane", "prefix")


def sample_label(sample: Column) -> Column:
    return F.upper(F.btrim(sample, F.lit(S.BLANKS)))


def dated_sightings(sightings: DataFrame) -> DataFrame:
    """One row a usable sighting_id: key, seen_day, sample_id, lane; unknown dimensions stay null."""
    return usable_sightings(
        sightings,
        F.to_date("seen_at").alias("seen_day"),
        sample_label(F.col("sample_id")).alias("sample_id"),
        F.col("lane").alias("lane"),
    )


def sighting_sketches(sightings: DataFrame, m: int = pcsa.ROWS) -> DataFrame:
    """Sketches of the finest groups: day, sample, lane and prefix, ``?`` if unknown. All coarser ones are unions of these."""
    base = dated_sightings(sightings).withColumn("prefix", S.root_text(S.packed_root(F.col("key"))))
    known = [F.coalesce(F.col(d).cast("string"), F.lit("?")).alias(d) for d in DIMENSIONS]
    return pcsa.sketch(base.select("key", *known), DIMENSIONS, "key", m)


#: All combinations of the dimensions, finest first: distinct_cube reports each of them.
GROUPINGS = tuple(g for size in range(len(DIMENSIONS), -1, -1) for g in combinations(DIMENSIONS, size))


def parent_of(grouping: tuple[str, ...]) -> tuple[str, ...]:
    """The grouping of one dimension more from which the sketches of grouping are united."""
    more = next(d for d in ("lane", "sample_id", "seen_day", "prefix") if d not in grouping)  # few values first
    return tuple(d for d in DIMENSIONS if d in grouping or d == more)


def distinct_cube(sightings: DataFrame, m: int = pcsa.ROWS) -> DataFrame:
    """grouping, seen_day, sample_id, lane, prefix, n, estimate, std_error, low, high for every grouping.

    Dimensions outside the grouping are ``*``, unknown values ``?``. low and high are 4 standard errors and ``SLACK`` keys off.
    Sketches are rolled up step by step, each grouping from one of one dimension more; sightings are sketched
    once. An empty table gives no rows.
    """
    name = "+".join
    by = ["grouping", *DIMENSIONS]
    fine = sighting_sketches(sightings, m).withColumn("grouping", F.lit(name(DIMENSIONS)))
    level = materialize(fine.select(*by, "row", "bits", "n"), "sketches")
    levels = [level]
    for size in range(len(DIMENSIONS) - 1, -1, -1):
        views: dict[str, list] = {}
        for g in (x for x in GROUPINGS if len(x) == size):
            view = F.struct(F.lit(name(g) or "all").alias("grouping"), *[(F.col(d) if d in g else F.lit("*")).alias(d) for d in DIMENSIONS])
            views.setdefault(name(parent_of(g)), []).append(view)
        children = F.coalesce(*[F.when(F.col("grouping") == p, F.array(*v)) for p, v in views.items()])  # null without any
        rows = level.select(F.explode(children).alias("g"), "row", "bits", "n").select(*[f"g.{c}" for c in by], "row", "bits", "n")
        level = materialize(pcsa.merge(rows, by), "sketches")
        levels.append(level)
    out = pcsa.estimate(reduce(DataFrame.unionByName, levels), by, m)
    error = F.col("std_error") * SIGMAS + SLACK
    return out.withColumns({"low": F.greatest(F.col("estimate") - error, F.lit(0.0)), "high": F.col("estimate") + error})


def audited_cube(sightings: DataFrame, m: int = pcsa.ROWS, share: float = 0.998) -> DataFrame:
    """grouping, groups, sightings, within of every grouping of the cube.

    within: for at least ``share`` of its groups the exact number of distinct keys lies in [low, high]. The exact numbers come from all sightings; this is an audit of the sketches and costs what they save.
    """
    known = [F.coalesce(F.col(d).cast("string"), F.lit("?")).alias(d) for d in DIMENSIONS]
    base = dated_sightings(sightings).withColumn("prefix", S.root_text(S.packed_root(F.col("key"))))
    fine = base.groupBy(*known, "key").agg(F.count(F.lit(1)).alias("c"))
    # A key has one prefix: the groups without a prefix are sums of those with one, and 8 rows a finest key are shuffled.
    # What is left of a group is told by a 64-bit hash of its grouping and values.
    others = [d for d in DIMENSIONS if d != "prefix"]
    subsets = [g for g in GROUPINGS if "prefix" not in g]
    groups = [F.xxhash64(F.lit("+".join(g)), *[F.col(d) if d in g else F.lit("*") for d in others]) for g in subsets]
    each = fine.select(F.explode(F.array(*groups)).alias("g"), "key", "c").groupBy("g", "key").agg(F.sum("c").alias("c"))
    parts = each.groupBy("g", S.packed_root(F.col("key")).alias("root")).agg(F.count(F.lit(1)).alias("exact"), F.sum("c").alias("rows"))
    parts = materialize(parts.select("g", S.root_text(F.col("root")).alias("prefix"), "exact", "rows"), "exact")
    sums = parts.groupBy("g").agg(F.sum("exact").alias("exact"), F.sum("rows").alias("rows"))
    exact = parts.unionByName(sums.withColumn("prefix", F.lit("*")))
    name = F.regexp_replace(F.when(F.col("grouping") == "all", "").otherwise(F.col("grouping")), r"[+]?prefix$", "")
    cube = distinct_cube(sightings, m).withColumn("g", F.xxhash64(name, *others))
    judged = cube.join(exact, ["g", "prefix"], "full_outer")
    inside = F.coalesce(F.col("exact").between(F.col("low"), F.col("high")) & (F.col("n") == F.col("rows")), F.lit(False))
    return judged.groupBy("grouping").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("rows").cast("bigint").alias("sightings"), (F.avg(inside.cast("double")) >= share).alias("within")
    )


def diverse_groups(sightings: DataFrame, least: int = 50, share: float = 0.75, m: int = pcsa.ROWS) -> DataFrame:
    """seen_day, sample_id of the groups of at least ``least`` usable sightings of which ``share`` are distinct keys.

    Groups are each day and sample, and each sample over all days (seen_day ``*``). The sketch decides
    wherever the estimate is 4 standard errors and ``SLACK`` keys off the bar; only the groups between are counted exactly.
    Sightings without day or sample belong to no group.
    """
    base = dated_sightings(sightings).where(F.col("seen_day").isNotNull() & F.col("sample_id").isNotNull())
    base = materialize(base.select("key", F.col("seen_day").cast("string").alias("seen_day"), "sample_id"), "dated")
    daily = materialize(pcsa.sketch(base, ["seen_day", "sample_id"], "key", m), "daily")
    total = pcsa.merge(daily, ["sample_id"]).withColumn("seen_day", F.lit("*"))
    by = ["seen_day", "sample_id"]
    judged = pcsa.estimate(daily.unionByName(total), by, m).where(F.col("n") >= least)
    bar, error = F.col("n") * share, F.col("std_error") * SIGMAS + SLACK
    judged = judged.withColumn(
        "verdict", F.when(F.col("estimate") - error >= bar, 1).when(F.col("estimate") + error < bar, 0)
    )
    judged = materialize(judged, "judged")  # a row a group
    open_ = judged.where(F.col("verdict").isNull()).select(*by)
    dated = base.join(open_.where(F.col("seen_day") != "*"), by, "left_semi")
    undated = base.join(open_.where(F.col("seen_day") == "*").select("sample_id"), "sample_id", "left_semi")
    exact = (
        dated.unionByName(undated.withColumn("seen_day", F.lit("*")))
        .groupBy(*by, "key")
        .agg(F.count(F.lit(1)).alias("c"))
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("d"), F.sum("c").alias("n"))
        .where(F.col("d") >= F.col("n") * share)
    )
    return judged.where(F.col("verdict") == 1).select(*by).unionByName(exact.select(*by))

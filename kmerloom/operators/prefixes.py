"""Sightings, reads and distinct keys of every prefix and owner, balanced by load (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.functions import sequence as S
from kmerloom.operators.sightings import usable_rows
from kmerloom.operators.skew import fragment_replicate_join


def owner_plan(prefix_plan: DataFrame) -> DataFrame:
    """One row for each root number: the planned owner and count; null roots are left out."""
    return (
        prefix_plan.where(F.col("root").isNotNull())
        .groupBy(F.col("root").cast("int").alias("root"))
        .agg(F.min("prefix_owners").alias("owner"), F.min("prefix_counts").alias("planned"))
    )


def all_owners(prefix_plan: DataFrame) -> DataFrame:
    """root, prefix, owner, planned of all 256 roots; a root without a row in the plan has no owner."""
    roots = prefix_plan.sparkSession.range(256).select(F.col("id").cast("int").alias("root"))
    named = roots.select("root", S.root_text(F.col("root")).alias("prefix"))
    return named.join(F.broadcast(owner_plan(prefix_plan)), "root", "left")  # 256 rows


def balanced_sightings(sightings: DataFrame, prefix_plan: DataFrame, n_tasks: int | None = None) -> DataFrame:
    """Usable sightings with root, prefix and owner, in tasks of about equal load; one row a sighting_id.

    Prefix and owner come from the plan's side, which is copied to the tasks that hold a part of its root.
    Re-delivered rows of an id carry the same key, hence meet in the same task and are merged there
    without another shuffle.
    """
    rows = usable_rows(sightings, F.col("read_id")).where(F.col("sighting_id").isNotNull())
    rows = rows.withColumn("root", S.packed_root(F.col("key")))
    joined = fragment_replicate_join(rows, all_owners(prefix_plan), "root", ["sighting_id"], "inner", n_tasks)
    return joined.groupBy("_task", "root", "prefix", "sighting_id").agg(
        F.min("key").alias("key"), F.min("read_id").alias("read_id"), F.min("owner").alias("owner")
    )


def _items(sightings: DataFrame, prefix_plan: DataFrame, n_tasks: int | None) -> DataFrame:
    """Distinct (prefix, kind, item): kind 0 are keys with their sightings, kind 1 reads."""
    base = balanced_sightings(sightings, prefix_plan, n_tasks)
    both = base.select(
        "prefix",
        "owner",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("kind"), F.col("key").alias("item")),
                F.struct(F.lit(1).alias("kind"), F.col("read_id").alias("item")),
            )
        ).alias("i"),
    )
    return both.groupBy("prefix", "owner", F.col("i.kind").alias("kind"), F.col("i.item").alias("item")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _totals(items: DataFrame, *by: str) -> DataFrame:
    key, read = F.col("kind") == 0, F.col("kind") == 1
    return items.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(key, F.col("n"))), F.lit(0)).cast("bigint").alias("sightings"),
        F.count(F.when(read & F.col("item").isNotNull(), 1)).alias("reads"),
        F.count(F.when(key, 1)).alias("distinct_keys"),
    )


def prefix_load(sightings: DataFrame, prefix_plan: DataFrame, n_tasks: int | None = None) -> DataFrame:
    """prefix, owner, sightings, reads, distinct_keys for every prefix that has a usable sighting.

    A prefix without a row or without an owner in the plan has a null owner. Null read ids count in
    sightings but are no read. Empty tables give no rows.
    """
    return _totals(_items(sightings, prefix_plan, n_tasks), "prefix", "owner")


def owner_load(sightings: DataFrame, prefix_plan: DataFrame, n_tasks: int | None = None) -> DataFrame:
    """owner, sightings, reads, distinct_keys; a read is counted once an owner, prefixes without owner are one group."""
    items = _items(sightings, prefix_plan, n_tasks).groupBy("owner", "kind", "item").agg(F.sum("n").alias("n"))
    return _totals(items, "owner")


def dominant_prefixes(sightings: DataFrame, prefix_plan: DataFrame, share: float = 0.04, n_tasks: int | None = None) -> DataFrame:
    """prefix of at least ``share`` of all usable sightings."""
    base = balanced_sightings(sightings, prefix_plan, n_tasks)
    # at most 256 rows leave the balanced tasks, so one row may hold them all
    loads = base.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
    packed = loads.agg(F.sum("n").alias("total"), F.collect_list(F.struct("prefix", "n")).alias("all"))
    rows = packed.select("total", F.explode("all").alias("r"))
    return rows.where(F.col("r.n") >= F.col("total") * share).select("r.prefix")

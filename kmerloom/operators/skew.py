"""Joins and per-key results when a few keys hold most rows: fragment and replicate by load.

Loads of keys are counted first. Keys are bin-packed into tasks (longest first, into the least loaded
task); a key heavier than a task's share is split into shards in proportion to its load, and the rows
of the matching side are replicated to exactly those shards. The driver only ever holds the heavy
keys and the light keys' hash buckets, both bounded by a multiple of the number of tasks.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerloom.session import materialize, require_columns, shuffle_width

HEAVY_SHARE = 4  # a key with more than 1/4 of a task's share is placed by itself
LIGHT_BUCKETS = 8  # hash buckets of light keys for each task


def lpt(loads: list[tuple[object, float]], bins: int) -> dict[object, int]:
    """Longest-processing-time assignment of loads to bins; equal loads go in the given order."""
    if bins < 1:
        raise ValueError("bins must be at least 1")
    heap = [(0.0, b) for b in range(bins)]
    out: dict[object, int] = {}
    for name, load in sorted(loads, key=lambda x: -x[1]):
        total, b = heapq.heappop(heap)
        out[name] = b
        heapq.heappush(heap, (total + load, b))
    return out


@dataclass(frozen=True)
class TaskPlan:
    """Tasks of every heavy key and of every bucket of light keys."""

    n_tasks: int
    buckets: int
    key_type: T.DataType
    heavy: dict[object, list[int]]
    light: list[int]
    loads: list[float]

    def frames(self, spark) -> tuple[DataFrame, DataFrame]:
        """Both assignments; at most HEAVY_SHARE x n_tasks and LIGHT_BUCKETS x n_tasks rows."""
        heavy = spark.createDataFrame(
            [(k, t) for k, t in self.heavy.items()],
            T.StructType([T.StructField("_hk", self.key_type), T.StructField("_ht", T.ArrayType(T.IntegerType()))]),
        )
        light = spark.createDataFrame([(b, t) for b, t in enumerate(self.light)], "_lb int, _lt int")
        return heavy, light


def plan_tasks(df: DataFrame, key: str, n_tasks: int | None = None) -> TaskPlan:
    """Count loads and bin-pack keys into tasks. Null keys count as one bucket of light keys."""
    require_columns(df, [key])
    n_tasks = n_tasks or shuffle_width(df.sparkSession)
    buckets = LIGHT_BUCKETS * n_tasks
    # the only pass over df: keys and their loads, written with the bucket that each has as a light key
    bucket = F.pmod(F.xxhash64("k"), F.lit(buckets)).cast("int").alias("b")
    counts = df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts.select("k", bucket, "n"), "loads")
    loads = {r["b"]: r["n"] for r in counts.groupBy("b").agg(F.sum("n").alias("n")).collect()}  # a row a bucket
    share = max(1.0, sum(loads.values()) / n_tasks)
    # at most HEAVY_SHARE x n_tasks keys can be heavier than this
    rows = counts.where(F.col("k").isNotNull() & (F.col("n") > share / HEAVY_SHARE))
    big = [(r["k"], r["b"], r["n"]) for r in rows.orderBy(F.desc("n"), "b", "k").collect()]
    for _, b, n in big:
        loads[b] -= n
    shards = [((k, i), n / s) for k, _, n in big for s in [math.ceil(n / share)] for i in range(s)]
    items = shards + [(("light", None, b), float(loads.get(b, 0))) for b in range(buckets)]
    where = lpt(items, n_tasks)
    heavy: dict[object, list[int]] = {}
    totals = [0.0] * n_tasks
    for (k, i), n in shards:
        heavy.setdefault(k, []).append(where[(k, i)])
    for name, n in items:
        totals[where[name]] += n
    light = [where[("light", None, b)] for b in range(buckets)]
    return TaskPlan(n_tasks, buckets, df.schema[key].dataType, heavy, light, totals)


def place_fragments(df: DataFrame, key: str, plan: TaskPlan, spread: list[str]) -> DataFrame:
    """df in its tasks with the column ``_task``; rows of a split key are spread by a hash of ``spread``."""
    heavy, light = plan.frames(df.sparkSession)
    out = df.join(F.broadcast(heavy), F.col(key).eqNullSafe(F.col("_hk")), "left")
    out = out.withColumn("_b", F.pmod(F.xxhash64(F.col(key)), F.lit(plan.buckets)).cast("int"))
    out = out.join(F.broadcast(light), F.col("_b") == F.col("_lb"), "left")
    shard = F.pmod(F.xxhash64(*[F.col(c) for c in spread], F.lit(7)), F.size("_ht")).cast("int")
    task = F.when(F.col("_hk").isNull(), F.col("_lt")).otherwise(F.get("_ht", shard))
    return out.withColumn("_task", task).drop("_hk", "_ht", "_b", "_lb", "_lt").repartitionById(plan.n_tasks, F.col("_task"))


def replicate_side(df: DataFrame, key: str, plan: TaskPlan) -> DataFrame:
    """df with one copy of each row in every task that holds a fragment of its key."""
    heavy, light = plan.frames(df.sparkSession)
    out = df.join(F.broadcast(heavy), F.col(key).eqNullSafe(F.col("_hk")), "left")
    out = out.withColumn("_b", F.pmod(F.xxhash64(F.col(key)), F.lit(plan.buckets)).cast("int"))
    out = out.join(F.broadcast(light), F.col("_b") == F.col("_lb"), "left")
    tasks = F.when(F.col("_hk").isNull(), F.array("_lt")).otherwise(F.array_distinct("_ht"))
    return out.withColumn("_task", F.explode(tasks)).drop("_hk", "_ht", "_b", "_lb", "_lt").repartitionById(plan.n_tasks, F.col("_task"))


def fragment_replicate_join(
    left: DataFrame, right: DataFrame, key: str, spread: list[str], how: str = "left", n_tasks: int | None = None
) -> DataFrame:
    """Join on ``key`` where a few keys of ``left`` hold most rows.

    left is cut into balanced tasks, right is replicated to the tasks of its keys; the result keeps the
    column ``_task``. ``how`` is inner or left. Null keys match nothing. Columns of right that left
    has too are not taken. The join is co-located: both sides are already in their tasks.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    require_columns(right, [key])
    plan = plan_tasks(left, key, n_tasks)
    own = place_fragments(left, key, plan, spread)
    other = replicate_side(right.select(key, *[c for c in right.columns if c not in left.columns]), key, plan)
    return own.join(other.hint("shuffle_hash"), ["_task", key], how)

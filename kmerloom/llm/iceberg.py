"""Most frequent values in bounded memory: iceberg multi-hash filtering (problem 2).

Rows are counted exactly in coarse cells under several hashes. A value can only reach a threshold if
each of its cells does, so the values that pass every hash are few; they are counted exactly.

The number of cells follows rows and threshold: ``SPREAD`` cells for each threshold's worth of rows, so that the mean
cell holds a quarter of the threshold. Memory is bounded by ``MOST_CELLS`` cells a hash: a task holds
``HASHES x MOST_CELLS`` counters at most (it may spill them), the driver and every executor the bitmaps of the cells that pass,
``HASHES x MOST_CELLS / 8`` bytes (393 kB). Where that many cells are too few, a second level of hashing parts the
values into groups, each with cells of its own, one after the other. For 10^10 rows and a threshold of
100,000 that is one group; for a threshold of 1,000, 39. Beyond ``MOST_GROUPS`` groups (a threshold under a 16-millionth
of the rows) a filter costs more than it saves, and all values are counted by a plain aggregate, which spills.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.session import require_columns

HASHES = 3
SPREAD = 4
LEAST_CELLS = 1 << 12
FIRST_CELLS = 1 << 16
MOST_CELLS = 1 << 20
MOST_GROUPS = 64
GROUP_SEED = 1 << 20


def plan_cells(rows: int, threshold: int, most: int = MOST_CELLS) -> tuple[int, int]:
    """Cells a hash (a power of two) and groups for so many rows and this threshold."""
    need = max(1, -(-SPREAD * rows // max(1, threshold)))
    return min(most, max(min(LEAST_CELLS, most), 1 << (need - 1).bit_length())), max(1, -(-need // most))


def _cell(value: Column, seed: int, cells: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), value), F.lit(cells)).cast("int")


def cell_counts(values: DataFrame, cells: int, hashes: int = HASHES) -> DataFrame:
    """h, cell, n: exact rows of every cell under every hash that has any. ``values`` has the column value, without nulls."""
    pairs = F.array(*[F.struct(F.lit(h).alias("h"), _cell(F.col("value"), h, cells).alias("cell")) for h in range(hashes)])
    return values.select(F.explode(pairs).alias("c")).groupBy("c.h", "c.cell").agg(F.count(F.lit(1)).alias("n"))


def passing_words(counts: DataFrame, threshold: int) -> pa.Table:
    """h, word, bits: the cells that reach the threshold as bits of 64-bit words; hashes x cells / 64 rows at most."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("cell").bitwiseAND(63))
    words = counts.where(F.col("n") >= threshold).groupBy("h", F.shiftright("cell", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.toArrow()


def survivors(values: DataFrame, words: pa.Table, cells: int, hashes: int = HASHES) -> DataFrame:
    """Rows of values whose cells all pass: a look-up in a broadcast bitmap for each hash."""
    spark = values.sparkSession
    for h in range(hashes):
        mine = words.filter(pc.equal(words["h"], h))
        mine = pa.table({"_word": mine["word"].cast(pa.int32()), "_bits": mine["bits"].cast(pa.int64())})
        cell = _cell(F.col("value"), h, cells)
        values = values.join(F.broadcast(spark.createDataFrame(mine)), F.shiftright(cell, 6) == F.col("_word"))
        values = values.where(F.getbit("_bits", cell.bitwiseAND(63)) == 1).select("value")
    return values


def _values(df: DataFrame, col: str) -> DataFrame:
    require_columns(df, [col])
    return df.where(F.col(col).isNotNull()).select(F.col(col).alias("value"))


def _exact(values: DataFrame, threshold: int) -> DataFrame:
    return values.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= threshold)


def iceberg_counts(df: DataFrame, col: str, threshold: int, most_cells: int = MOST_CELLS) -> DataFrame:
    """value, n of every value with at least ``threshold`` rows; counts are exact.

    Nulls are no value. An empty table, or one whose values all stay below, gives no rows.
    """
    values = _values(df, col)
    return _counts(values, values.count(), threshold, most_cells)


def _counts(values: DataFrame, rows: int, threshold: int, most_cells: int) -> DataFrame:
    cells, groups = plan_cells(rows, threshold, most_cells)
    if groups > MOST_GROUPS:
        return _exact(values, threshold)
    parts = []
    for g in range(groups):
        mine = values if groups == 1 else values.where(_cell(F.col("value"), GROUP_SEED, groups) == g)
        parts.append(_exact(survivors(mine, passing_words(cell_counts(mine, cells), threshold), cells), threshold))
    return reduce(DataFrame.unionByName, parts)


def iceberg_topk(df: DataFrame, col: str, k: int, first_cells: int = FIRST_CELLS, most_cells: int = MOST_CELLS) -> DataFrame:
    """value, n, rank of the k most frequent values; ties go to the smaller value.

    The values of the heaviest cells are counted exactly first: the k-th of them bounds the k-th count of all from below, and
    with this bound as the threshold nothing of the answer can be missed. df is read three times as a rule, once more where the
    bound asks for more cells than the first pass had.
    Fewer than k distinct values give fewer rows; nulls are left out; an empty table gives no rows.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    values = _values(df, col)
    counts = cell_counts(values, first_cells).toArrow()  # hashes x first_cells rows: 4 MB
    h, cell, n = (counts[c].to_numpy() for c in ("h", "cell", "n"))
    first = h == 0
    heavy = cell[first][np.lexsort((cell[first], -n[first]))[: max(64, 4 * k)]]
    chosen = values.sparkSession.createDataFrame(pa.table({"_cell": pa.array(heavy, pa.int32())}))
    near = values.join(F.broadcast(chosen), _cell(F.col("value"), 0, first_cells) == F.col("_cell"))
    sure = [r["n"] for r in _exact(near.select("value"), 1).orderBy(F.desc("n")).limit(k).collect()]
    threshold = sure[k - 1] if len(sure) == k else 1
    rows = int(n[first].sum())
    cells, groups = plan_cells(rows, threshold, most_cells)
    if groups == 1 and cells <= first_cells:  # the first pass had cells enough
        passed = n >= threshold
        bits = np.left_shift(np.int64(1), (cell[passed] & 63).astype(np.int64))
        place = (h[passed].astype(np.int64) << 32) | (cell[passed] >> 6)
        where, at = np.unique(place, return_inverse=True)
        packed = np.zeros(len(where), np.int64)
        np.bitwise_or.at(packed, at, bits)
        words = pa.table({"h": pa.array(where >> 32, pa.int32()), "word": pa.array(where & (2**32 - 1), pa.int32()), "bits": packed})
        found = _exact(survivors(values, words, first_cells), threshold)
    else:
        found = _counts(values, rows, threshold, most_cells)
    top = found.orderBy(F.desc("n"), F.asc("value")).limit(k)
    ranked = [(*r, i + 1) for i, r in enumerate(top.collect())]  # k rows at most
    return df.sparkSession.createDataFrame(ranked, top.schema.add("rank", "integer"))

"""Has this key been seen before? Golomb-coded sets of earlier keys by prefix (problem 5).

Keys of the earlier run are hashed, sorted and stored as compressed gaps in blocks, one set for each
prefix (and shard of a large prefix). Arrivals go to their prefix in order of arrival_id and are decided
in batches against that set and the set of earlier arrivals, whose runs are merged like those of a log. The
sets hold reduced hashes only and never take more bits than the plan grants the prefix: a small grant makes
the range of the hashes small and wrong answers frequent, which the report shows. Positives are then checked
against the keys themselves; a key that no set answered yes to is never looked up again.

The sets decide every arrival, with one stated exception: within one Arrow batch, a key with ``HOT`` rows or more
goes on once and its later rows are known to be repeats. So a key that holds a third of all rows leaves a few
rows a batch, and no group of one key grows with the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.functions import sequence as S
from kmerloom.llm.golomb import INDEX_BITS, GolombSet, GrowingSet, bounded_set, reduce_hashes
from kmerloom.operators.sightings import K
from kmerloom.session import materialize

SHARD_KEYS = 100_000
BATCH = 4096
RUNS = 4
HOT = 8
MOST_BITS = 12
DEFAULT_WORDS = 32_768

_CODES = np.full(256, 4, np.uint8)
for _i, _letters in enumerate((b"Aa", b"Cc", b"Gg", b"TtUu")):
    _CODES[list(_letters)] = _i

_BLOCKS = "root int, shard int, keys bigint, r int, modulus bigint, block int, first bigint, cnt int, payload binary"
_DECIDED = "root int, shard int, arrival_id bigint, key bigint, in_old boolean, in_new boolean, chance double, run_bits bigint"


def packed_keys(texts: pa.Array, window: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Packed stored keys of texts of k bases, and the rows they are from; other texts and nulls are left out.

    Blanks and line ends around a text go, case does not count, U is T. Texts marked in ``window`` are raw windows, the
    others keys.
    """
    texts = pc.utf8_trim(texts.cast(pa.string()), characters=S.BLANKS)
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.binary_length(texts), K), False).to_numpy(zero_copy_only=False))
    codes = _CODES[np.frombuffer(b"".join(texts.take(pa.array(rows)).cast(pa.binary()).to_pylist()), np.uint8)].reshape(-1, K)
    good = (codes < 4).all(1)
    rows, codes = rows[good], codes[good].astype(np.int64)
    shift = 2 * np.arange(K - 1, -1, -1)
    keys = (codes << shift).sum(1)
    if window is not None:
        w = window[rows]
        keys[w] = np.minimum((codes[w] << shift[::-1]).sum(1), ((3 - codes[w]) << shift).sum(1))  # reversed, complement
    return keys << (64 - 2 * K), rows


def low_rows(low_keys: DataFrame) -> DataFrame:
    """key: packed keys of the earlier run, each once a batch; texts that are no key are left out."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(packed_keys(b.column("kmer"))[0]))], ["key"])

    return low_keys.select("kmer").where(F.col("kmer").isNotNull()).mapInArrow(once, "key bigint")


def fold_hot(arrivals: DataFrame) -> DataFrame:
    """arrival_id, key, folded of the arrivals whose text gives a key: of a key with ``HOT`` rows or more in an Arrow batch only the first arrival goes on to the sets.

    Its other rows are folded: they repeat a row of their own batch. Nothing is kept from batch to batch.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            window = pc.equal(pc.utf8_lower(pc.utf8_trim(b.column("form").cast(pa.string()), characters=" ")), "window")
            keys, rows = packed_keys(b.column("canonical_kmer"), pc.fill_null(window, False).to_numpy(zero_copy_only=False))
            ids = b.column("arrival_id").to_numpy()[rows]
            order = np.lexsort((ids, keys))
            ids, keys = ids[order], keys[order]
            head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            size = np.diff(np.append(head, len(keys)))
            folded = (np.repeat(size, size) >= HOT) & (ids > np.repeat(ids[head], size))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys), pa.array(folded)], ["arrival_id", "key", "folded"])

    some = arrivals.where(F.col("arrival_id").isNotNull() & F.col("canonical_kmer").isNotNull())
    return some.select(F.col("arrival_id").cast("bigint").alias("arrival_id"), "canonical_kmer", "form").mapInArrow(fold, "arrival_id bigint, key bigint, folded boolean")


def filter_plan(low: DataFrame, probes: DataFrame, prefix_plan: DataFrame) -> DataFrame:
    """root, shards, granted bits, rows and the bits of one shard for old and for new keys, of every prefix: 256 rows."""
    spark = low.sparkSession
    root = S.packed_root(F.col("key")).alias("root")
    old = {r[0]: r[1] for r in low.groupBy(root).count().collect()}
    new = {r[0]: r[1] for r in probes.groupBy(root).count().collect()}
    words = {r[0]: r[1] for r in prefix_plan.where(F.col("root").between(0, 255)).groupBy("root").agg(F.max("bloom_filter_capacity")).collect()}
    rows = []
    for p in range(256):
        o, n = old.get(p, 0), new.get(p, 0)
        granted = 64 * (DEFAULT_WORDS if words.get(p) is None else max(0, words[p]))
        shards = max(1, -(-(o + n) // SHARD_KEYS))
        each = granted / shards / max(1, o + n)
        rows.append((p, shards, granted, o, n, each * o, each * n))
    return spark.createDataFrame(rows, "root int, shards int, granted_bits bigint, old_rows bigint, new_rows bigint, old_bits double, new_bits double")


def _in_shards(df: DataFrame, plan: DataFrame, bits: str) -> DataFrame:
    out = df.withColumn("root", S.packed_root(F.col("key"))).join(F.broadcast(plan.select("root", "shards", F.col(bits).alias("bits"))), "root")
    shard = F.pmod(F.xxhash64("key", F.lit(11)), F.col("shards")).cast("int")
    return out.withColumn("shard", shard).withColumn("h", F.xxhash64("key")).drop("shards")


def build_filter(low: DataFrame, plan: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """Blocks of the Golomb-coded sets of the keys ``low``: a table that later loads can probe again.

    A grant that holds no set at all leaves one row with modulus 0, which stands for yes to everything.
    """

    def build(group: pd.DataFrame) -> pd.DataFrame:
        h = np.unique(group["h"].to_numpy())
        s, modulus = bounded_set(h, float(group["bits"].iloc[0]), most_bits)
        if s is None:
            s, payload = GolombSet(0, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint8)), [b""]
        else:
            ends = np.append(s.start[1:], len(s.payload))
            payload = [s.payload[a:b].tobytes() for a, b in zip(s.start, ends, strict=True)]
        return pd.DataFrame(
            {
                "root": group["root"].iloc[0], "shard": group["shard"].iloc[0], "keys": len(h), "r": s.r, "modulus": modulus,
                "block": np.arange(len(s.first), dtype=np.int32), "first": s.first, "cnt": s.count.astype(np.int32), "payload": payload,
            }
        )

    return _in_shards(low, plan, "old_bits").select("root", "shard", "h", "bits").groupBy("root", "shard").applyInPandas(build, _BLOCKS)


def _old_set(blocks: pd.DataFrame) -> tuple[GolombSet | None, int]:
    """The stored set and its range; (None, 0) stands for yes to everything, (None, 1) for no key."""
    if not len(blocks):
        return None, 1
    modulus = int(blocks["modulus"].iloc[0])
    if not modulus:
        return None, 0
    blocks = blocks.sort_values("block")
    size = blocks["payload"].map(len).to_numpy()
    payload = np.frombuffer(b"".join(blocks["payload"]), np.uint8)
    return GolombSet(int(blocks["r"].iloc[0]), blocks["first"].to_numpy(), blocks["cnt"].to_numpy(np.int64), np.cumsum(size) - size, payload), modulus


def probe(probes: DataFrame, blocks: DataFrame, plan: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """in_old and in_new, the sets' answers for every probe, and the chance of a yes for a key never seen.

    Rows of one arrival_id and key are one probe. run_bits is the most that the set of earlier arrivals took.
    """

    def decide(key: tuple, arrivals: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        old, modulus = _old_set(stored)
        arrivals = arrivals.sort_values(["arrival_id", "h"]).drop_duplicates(["arrival_id", "h"])
        ids, keys, h = (arrivals[c].to_numpy() for c in ("arrival_id", "key", "h"))
        n = len(ids)
        in_old, in_new, chance = np.full(n, not modulus), np.zeros(n, bool), np.zeros(n)
        new = GrowingSet(n, float(arrivals["bits"].iloc[0]) if n else 0.0, most_bits, BATCH, RUNS)
        old_chance = old.size / modulus if old is not None else 1.0 - modulus
        for a in range(0, n, new.batch):
            part = slice(a, a + new.batch)
            if old is not None:
                in_old[part] = old.contains(reduce_hashes(h[part], modulus))
            in_new[part], p = new.probe(h[part], in_old[part])
            chance[part] = 1 - (1 - old_chance) * (1 - p)
        return pd.DataFrame(
            {
                "root": np.int32(key[0]), "shard": np.int32(key[1]), "arrival_id": ids, "key": keys, "in_old": in_old, "in_new": in_new,
                "chance": chance, "run_bits": np.int64(new.peak_bits),
            }
        )

    left = _in_shards(probes, plan, "new_bits").groupBy("root", "shard")
    return left.cogroup(blocks.groupBy("root", "shard")).applyInPandas(decide, _DECIDED)


class SeenKeys:
    """Decisions for a table of arrivals against the keys of an earlier run.

    Arrivals without an id or without k bases are no cases and count as no earlier ones. Repeated rows of
    an id are one arrival. Empty tables are sets without keys. A prefix without a grant has ``DEFAULT_WORDS``,
    a grant of 0 words holds no set: every probe of it is checked. ``plan``, ``blocks`` and ``decided`` are tables.
    """

    def __init__(self, arrivals: DataFrame, low_keys: DataFrame, prefix_plan: DataFrame, most_bits: int = MOST_BITS):
        self.arrivals = materialize(fold_hot(arrivals), "arrivals")
        self.low = materialize(low_rows(low_keys), "low")
        self.probes = self.arrivals.where(~F.col("folded")).select("arrival_id", "key")
        self.plan = filter_plan(self.low, self.probes, prefix_plan)
        self.blocks = materialize(build_filter(self.low, self.plan, most_bits), "golomb")
        self.decided = materialize(probe(self.probes, self.blocks, self.plan, most_bits), "decided")

    def checked(self) -> DataFrame:
        """root, arrival_id, key, chance, seen of every positive of the sets: seen is exact.

        Only keys of positives are looked up: both the earlier run and the arrivals are cut down to them first.
        """
        hits = self.decided.where(F.col("in_old") | F.col("in_new")).select("root", "arrival_id", "key", "chance")
        asked = hits.select("key").distinct()
        old = self.low.join(asked, "key", "left_semi").select("key", F.lit(-(2**63)).cast("bigint").alias("since"))
        new = self.decided.select("key", F.col("arrival_id").alias("since")).join(asked, "key", "left_semi")
        earlier = old.unionByName(new).groupBy("key").agg(F.min("since").alias("since"))
        return hits.join(earlier, "key").select("root", "arrival_id", "key", "chance", (F.col("since") < F.col("arrival_id")).alias("seen"))

    def seen(self) -> DataFrame:
        """arrival_id of every arrival whose key came before."""
        folded = self.arrivals.where("folded").select("arrival_id")
        return folded.unionByName(self.checked().where("seen").select("arrival_id")).distinct()

    def report(self) -> DataFrame:
        """prefix, old_keys, used_bits, granted_bits, probes, positives, folded, right, wrong, and the theoretical and audited rates.

        ``probes`` are decided by the sets, ``folded`` rows repeat a hot key of their own batch. ``wrong`` are positives that are
        no earlier key; both rates are over the probes of keys not seen before. The theoretical one is the mean, over
        these probes, of the share of the sets' places that were taken when they came. Nothing can be missed: a set
        answers yes to all its keys.
        """
        count = F.count(F.lit(1))
        bits = F.when(F.col("modulus") > 0, F.lit(8) * F.length("payload") + F.lit(INDEX_BITS)).otherwise(0)
        used = self.blocks.groupBy("root", "shard").agg(F.sum(bits).alias("b"), F.max("keys").alias("k"))
        used = used.groupBy("root").agg(F.sum("b").cast("bigint").alias("set_bits"), F.sum("k").cast("bigint").alias("keys"))
        runs = self.decided.groupBy("root", "shard").agg(F.max("run_bits").alias("b")).groupBy("root").agg(F.sum("b").cast("bigint").alias("run_bits"))
        folded = self.arrivals.where("folded").groupBy(S.packed_root(F.col("key")).alias("root")).agg(count.alias("folded"))
        probes = self.decided.groupBy("root").agg(
            count.alias("probes"), F.count(F.when(F.col("in_old") | F.col("in_new"), 1)).alias("positives"), F.sum("chance").alias("all_chance")
        )
        right = self.checked().groupBy("root").agg(
            F.count(F.when(F.col("seen"), 1)).alias("right"), F.count(F.when(~F.col("seen"), 1)).alias("wrong"), F.sum(F.when(F.col("seen"), F.col("chance"))).alias("seen_chance")
        )
        out = self.plan.where(F.col("old_rows") + F.col("new_rows") > 0)
        for part in (used, runs, folded, probes, right):  # 256 rows at most each
            out = out.join(F.broadcast(part), "root", "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        fresh = zero("probes") - zero("right")
        return out.select(
            S.root_text(F.col("root")).alias("prefix"), zero("keys").alias("old_keys"), (zero("set_bits") + zero("run_bits")).alias("used_bits"), "granted_bits",
            *[zero(c).alias(c) for c in ("probes", "positives", "folded", "right", "wrong")],
            F.when(fresh > 0, (zero("all_chance") - zero("seen_chance")) / fresh).alias("theoretical_rate"),
            F.when(fresh > 0, zero("wrong") / fresh).alias("audited_rate"),
        )

    def audit(self, sigmas: float = 5.0) -> DataFrame:
        """prefix, old_keys, arrivals, seen, within_grant, as_expected of every prefix.

        arrivals and seen are distinct ids, seen exactly. as_expected: the wrong answers are within so many standard deviations,
        and 3 more, of what the sets' occupancy says.
        """
        ids = self.arrivals.select("arrival_id", S.root_text(S.packed_root(F.col("key"))).alias("prefix")).distinct()
        cases = ids.join(self.seen().withColumn("_s", F.lit(1)), "arrival_id", "left")
        cases = cases.groupBy("prefix").agg(F.count(F.lit(1)).alias("arrivals"), F.count("_s").alias("seen"))
        expected = F.col("theoretical_rate") * (F.col("probes") - F.col("right"))
        off = F.coalesce(F.abs(F.col("wrong") - expected) <= sigmas * F.sqrt(expected) + 3, F.lit(True))
        out = self.report().select("prefix", "old_keys", (F.col("used_bits") <= F.col("granted_bits")).alias("within_grant"), off.alias("as_expected"))
        return out.join(F.broadcast(cases), "prefix", "left").select(
            "prefix", "old_keys", F.coalesce("arrivals", F.lit(0)).alias("arrivals"), F.coalesce("seen", F.lit(0)).alias("seen"), "within_grant", "as_expected"
        )


def seen_before(arrivals: DataFrame, low_keys: DataFrame, prefix_plan: DataFrame) -> DataFrame:
    return SeenKeys(arrivals, low_keys, prefix_plan).seen()

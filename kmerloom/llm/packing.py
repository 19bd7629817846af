"""Documents packed into containers of fixed capacity by best-two-fit (problem 6).

Only documents larger than a container are split: into full containers and a rest, which is packed like
a document. Items go to blocks of about ``BLOCK_BINS`` containers by a hash of their id; a block is packed
in one task, so that only its last container is poorly filled. The number of blocks follows the total.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.session import materialize

BLOCK_BINS = 2000
BLOCK_ITEMS = 100_000
CODE_TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]"
#: Fixed value: the split pattern of the public byte-level vocabularies.
BYTE_BPE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZER_DIR = "/opt/tokenizers"

_PACKED = "spec_id int, container bigint, doc_id bigint, piece int, pieces int, start bigint, size bigint"


class SizePool:
    """Unpacked items by size; items of one size are alike."""

    def __init__(self, sizes: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        self.sizes, at = np.unique(sizes[order], return_index=True)
        self.items = {int(s): list(x[::-1]) for s, x in zip(self.sizes, np.split(order, at[1:]), strict=True)} if len(sizes) else {}
        self.sizes = [int(s) for s in self.sizes]

    def take(self, size: int) -> int:
        stack = self.items[size]
        item = stack.pop()
        if not stack:
            del self.items[size]
            del self.sizes[bisect.bisect_left(self.sizes, size)]
        return int(item)

    def put_back(self, size: int, item: int) -> None:
        if size not in self.items:
            self.items[size] = []
            bisect.insort(self.sizes, size)
        self.items[size].append(item)

    def largest(self, room: int) -> int | None:
        at = bisect.bisect_right(self.sizes, room)
        return self.sizes[at - 1] if at else None

    def best_pair(self, more_than: int, room: int) -> tuple[int, int] | None:
        """Two items whose sum is the largest above more_than and within room."""
        sizes = self.sizes
        a, b = 0, bisect.bisect_right(sizes, room) - 1
        best, found = more_than, None
        while a <= b:
            total = sizes[a] + sizes[b]
            if total > room:
                b -= 1
                continue
            if total > best and (a < b or len(self.items[sizes[a]]) > 1):
                best, found = total, (sizes[a], sizes[b])
                if best == room:
                    break
            a += 1
        return found


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of every item; sizes are 0..capacity.

    A container is filled with the largest items that still fit. If room is left, its smallest item gives
    way to the two unpacked items that fill the widened gap best, if they fill it better.
    """
    pool, out, n = SizePool(np.asarray(sizes)), np.zeros(len(sizes), np.int64), 0
    while pool.sizes:
        room, held = capacity, []
        while (size := pool.largest(room)) is not None:
            held.append((size, pool.take(size)))
            room -= size
        if room and len(pool.sizes):
            small, item = held[-1]  # sizes are taken in descending order
            pair = pool.best_pair(small, small + room)
            if pair:
                held.pop()
                held += [(s, pool.take(s)) for s in pair]
                pool.put_back(small, item)
        for _, item in held:
            out[item] = n
        n += 1
    return out


def code_token_count(text: Column) -> Column:
    """Matches of CODE_TOKEN; null for a null text.

    Words shrink to one letter and blanks go, so that the length is the count: no list of matches is built.
    """
    return F.length(F.translate(F.regexp_replace(text, "[A-Za-z0-9_]+", "w"), " \t\r\n", "")).cast("bigint")


def bpe_token_count(text: Column, vocabulary: str = "byte_bpe_50k.tiktoken", tokenizer_dir: str = TOKENIZER_DIR) -> Column:
    """Tokens of a public byte-level vocabulary; special tokens in a text are ordinary text; null for a null text.

    The vocabulary file (about a megabyte) is read by the driver and goes along with the function: executors need no such folder.
    """
    with open(f"{tokenizer_dir}/{vocabulary}", "rb") as f:
        lines = f.read()

    @F.pandas_udf("bigint")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines())}
        coder = tiktoken.Encoding("public", pat_str=BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        for texts in parts:
            yield pd.Series([None if t is None else len(coder.encode_ordinary(t)) for t in texts], dtype="Int64")

    return count(text)


def pack(items: DataFrame, specs: DataFrame) -> DataFrame:
    """spec_id, container, doc_id, piece, pieces, start, size of items (doc_id, size) in the containers of each spec.

    Items without a size hold nothing and are left out; size 0 goes along with others. Repeated rows are
    items of their own. Specs without a positive capacity are left out; repeated specs count once.
    """
    spark = items.sparkSession
    items = materialize(items.where(F.col("size").isNotNull()).select("doc_id", F.col("size").cast("bigint").alias("size")), "sizes")
    wanted = specs.where((F.col("capacity") > 0) & F.col("spec_id").isNotNull()).select("spec_id", "capacity").distinct()
    total = items.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    blocks = F.greatest(
        F.ceil(F.lit(total[0]) / (F.col("capacity").cast("double") * BLOCK_BINS)), F.ceil(F.lit(total[1]) / BLOCK_ITEMS), F.lit(1)
    ).cast("bigint")
    # every item is packed once for each spec: copies are made of ids and sizes only
    each = wanted.select("spec_id", F.col("capacity").cast("bigint").alias("capacity"), blocks.alias("blocks"))
    each = [r.asDict() for r in each.collect()]  # containers on offer: a handful of rows
    if not each:
        return spark.createDataFrame([], _PACKED)
    copies = F.explode(F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in ("spec_id", "capacity", "blocks")]) for r in each])).alias("s")
    rows = items.select("doc_id", "size", copies).select("doc_id", "size", "s.*")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))

    def pack_block(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        capacity = int(part["capacity"].iloc[0])
        part = part.sort_values(["size", "doc_id"])
        ids, size = part["doc_id"].to_numpy(), part["size"].to_numpy()
        pieces = np.maximum(1, -(-size // capacity))
        line = np.repeat(np.arange(len(ids)), pieces)
        piece = np.arange(len(line)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * capacity
        length = np.minimum(size[line] - start, capacity)
        container = best_two_fit(length, capacity)
        return pd.DataFrame(
            {
                "spec_id": np.int32(key[0]), "container": (np.int64(key[1]) << 32) + container, "doc_id": part["doc_id"].array[line] if part["doc_id"].hasnans else ids[line],
                "piece": piece.astype(np.int32), "pieces": pieces[line].astype(np.int32), "start": start, "size": length,
            }
        )

    return rows.groupBy("spec_id", "block").applyInPandas(pack_block, _PACKED)


def split_documents(packed: DataFrame) -> DataFrame:
    """spec_id, doc_id of the documents that take more than one piece."""
    return packed.where((F.col("pieces") > 1) & (F.col("piece") == 0)).select("spec_id", "doc_id")


def checked_packing(packed: DataFrame, specs: DataFrame, least_fill: float = 0.95) -> DataFrame:
    """spec_id, documents, tokens, split, in_capacity, in_order, well_filled of a packing.

    in_capacity: no container holds more than its capacity. in_order: the pieces of every document follow each other from 0 to
    its end. well_filled: the containers are used to ``least_fill`` at least, but for one a block.
    """
    capacity = specs.where(F.col("spec_id").isNotNull()).groupBy("spec_id").agg(F.max("capacity").alias("capacity"))
    bins = packed.groupBy("spec_id", "container").agg(F.sum("size").alias("used"))
    room = bins.groupBy("spec_id").agg(
        F.max("used").alias("fullest"), F.sum("used").alias("used"), F.count(F.lit(1)).alias("bins"), F.countDistinct(F.shiftright("container", 32)).alias("blocks")
    )
    docs = packed.groupBy("spec_id", "doc_id").agg(
        F.sum("size").cast("bigint").alias("size"), F.count(F.lit(1)).alias("n"), F.max("pieces").alias("pieces"),
        F.sum("start").alias("starts"), F.countDistinct("piece").alias("distinct"), F.max(F.col("start") + F.col("size")).alias("end"),
    )
    whole = (F.col("n") == F.col("pieces")) & (F.col("distinct") == F.col("n")) & (F.col("end") == F.col("size"))
    totals = docs.groupBy("spec_id").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("size").cast("bigint").alias("tokens"), F.count(F.when(F.col("pieces") > 1, 1)).alias("split"), F.bool_and(whole).alias("in_order")
    )
    out = totals.join(room, "spec_id").join(capacity, "spec_id")  # a row a spec
    filled = F.col("used") >= least_fill * (F.col("bins") - F.col("blocks")) * F.col("capacity")
    return out.select("spec_id", "documents", "tokens", "split", (F.col("fullest") <= F.col("capacity")).alias("in_capacity"), "in_order", filled.alias("well_filled"))


def fill_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """spec_id, containers, items, fill (share of the capacity used) for each spec."""
    bins = packed.groupBy("spec_id", "container").agg(F.count(F.lit(1)).alias("items"), F.sum("size").alias("used"))
    totals = bins.groupBy("spec_id").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("items").cast("bigint").alias("items"), F.sum("used").cast("bigint").alias("used")
    )
    capacity = specs.groupBy("spec_id").agg(F.max("capacity").alias("capacity"))
    return totals.join(capacity, "spec_id").select(
        "spec_id", "containers", "items", (F.col("used") / (F.col("containers") * F.col("capacity"))).alias("fill")
    )

"""From reads to windows and canonical keys: a SQL path for any k, and an array path that counts.

Semantics: bases are A, C, G, T in either case, U is T; any other byte ends a run and no window spans it.
A run of length L has max(0, L-k+1) windows. Null reads and reads shorter than k have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.functions import sequence as S

MAX_K = 128
CHUNK_BASES = 31  # bases in one signed 64-bit column
CHUNK_BYTES = 2 << 20
PIECE_WINDOWS = 1000


def check_k(k: int) -> None:
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be 1..{MAX_K}")


def base_runs(reads: DataFrame, seq: str = "seq", least: int = 1) -> DataFrame:
    """reads' other columns and ``run``: every maximal run of at least ``least`` bases, normalised."""
    run = F.explode(F.split(S.normalize_bases(F.col(seq)), "[^ACGT]+")).alias("run")
    return reads.select(*[c for c in reads.columns if c != seq], run).where(F.length("run") >= least)


def run_pieces(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """reads' other columns and ``run``: the runs in pieces of ``PIECE_WINDOWS`` windows, which overlap by k-1 bases.

    No window is lost or doubled, and no piece grows with its sequence.
    """
    check_k(k)
    runs = base_runs(reads, seq, k)
    rest = [c for c in runs.columns if c != "run"]
    starts = F.explode(F.sequence(F.lit(1), F.length("run") - (k - 1), F.lit(PIECE_WINDOWS))).alias("_at")
    return runs.select(*rest, "run", starts).select(*rest, F.substring(F.col("run"), F.col("_at"), F.lit(PIECE_WINDOWS + k - 1)).alias("run"))


def windows(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """reads' other columns and ``window``: every k bases of every run, in either strand as it stands."""
    runs = run_pieces(reads, k, seq)
    starts = F.explode(F.sequence(F.lit(1), F.length("run") - (k - 1))).alias("_at")
    rest = [c for c in runs.columns if c != "run"]
    return runs.select(*rest, "run", starts).select(*rest, F.substring(F.col("run"), F.col("_at"), F.lit(k)).alias("window"))


def kmers_of(seq: Column, k: int) -> Column:
    """Array of the stored keys of a read, in order: for SQL users with a single expression."""
    check_k(k)
    runs = F.filter(F.split(S.normalize_bases(seq), "[^ACGT]+"), lambda r: F.length(r) >= k)
    each = F.transform(
        runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - (k - 1)), lambda i: S.stored_key(r.substr(i, F.lit(k))))
    )
    return F.flatten(each)


def key_rows(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """reads' other columns and ``kmer``: the stored key of every window.

    A piece is reversed and complemented once; the two forms of a window are parts of these.
    """
    runs = run_pieces(reads, k, seq)
    rest = [c for c in runs.columns if c != "run"]
    both = runs.select(*rest, F.reverse("run").alias("_back"), S.complement(F.col("run")).alias("_comp"), F.length("run").alias("_n"))
    each = both.select(*rest, "_back", "_comp", "_n", F.explode(F.sequence(F.lit(1), F.col("_n") - (k - 1))).alias("_at"))
    back = F.substring(F.col("_back"), F.col("_n") - F.col("_at") - (k - 2), F.lit(k))
    return each.select(*rest, F.least(back, F.substring(F.col("_comp"), F.col("_at"), F.lit(k))).alias("kmer"))


# -- array path ----------------------------------------------------------------------------------------


def chunk_widths(k: int) -> list[int]:
    """Bases held by each 64-bit column of a key of k bases."""
    return [min(CHUNK_BASES, k - a) for a in range(0, k, CHUNK_BASES)]


def _span_codes(codes: np.ndarray, width: int, backward: bool) -> np.ndarray:
    """Base-4 number of every ``width`` bases, by doubling; backward reads them from the last to the first."""
    out, done, power, size = np.zeros(len(codes) - width + 1, np.int64), 0, codes, 1
    while True:
        if width & size:
            part = power[done : done + len(out)]
            out = out + (part << (2 * done)) if backward else (out << (2 * size)) + part
            done += size
        if done == width:
            return out
        n = len(power) - size
        power = power[:n] + (power[size:] << (2 * size)) if backward else (power[:n] << (2 * size)) + power[size:]
        size *= 2


def canonical_chunks(codes: np.ndarray, k: int, starts: np.ndarray | None = None) -> list[np.ndarray]:
    """Stored keys of all windows of codes, or of those at starts, as base-4 numbers of 31 bases each; codes must be 0..3."""
    n = len(codes) - k + 1
    spans = {w: (_span_codes(3 - codes, w, False), _span_codes(codes, w, True)) for w in set(chunk_widths(k))}
    forward, backward, at = [], [], 0
    for width in chunk_widths(k):
        end = k - at - width
        f, b = spans[width][0][at : at + n], spans[width][1][end : end + n]
        forward.append(f if starts is None else f[starts])
        backward.append(b if starts is None else b[starts])
        at += width
    less = np.zeros(len(forward[0]), bool)
    equal = np.ones(len(forward[0]), bool)
    for f, b in zip(forward, backward, strict=True):
        less |= equal & (f < b)
        equal &= f == b
    return [np.where(less, f, b) for f, b in zip(forward, backward, strict=True)]


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of keys of several columns."""
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = (out ^ c.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def counted(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Different keys and the sums of their n. Keys are brought together by their hash; where different ones share it, by all columns."""
    hashes = mixed(columns)
    order = np.argsort(hashes)
    hashes, sorted_columns = hashes[order], [c[order] for c in columns]
    new = _changes(sorted_columns)
    if (new[1:] & (hashes[1:] == hashes[:-1])).any():
        order = np.lexsort(columns[::-1])
        sorted_columns = [c[order] for c in columns]
        new = _changes(sorted_columns)
    at = np.flatnonzero(new)
    return [c[at] for c in sorted_columns], np.add.reduceat(n[order], at) if len(at) else n[:0]


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Where a row differs from the one before; the first does."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _counts(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys and their numbers. Keys of several columns are brought together by a hash of them: should two keys
    share it, a key may come out in several rows, which are summed later."""
    if len(columns) == 1:
        columns = [np.sort(columns[0])]
    else:
        order = np.argsort(mixed(columns))
        columns = [c[order] for c in columns]
    new = _changes(columns)
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.diff(np.append(at, len(new)))


def overlapping(texts: list[bytes], k: int) -> list[bytes]:
    """texts, the long ones in pieces of ``CHUNK_BYTES`` windows that overlap by k-1 bytes: every window is in one piece."""
    out = []
    for t in texts:
        out += [t] if len(t) < CHUNK_BYTES + k else [t[a : a + CHUNK_BYTES + k - 1] for a in range(0, len(t) - k + 1, CHUNK_BYTES)]
    return out


def base_codes(text: bytes) -> np.ndarray:
    """0 to 3 for a base, 4 for any other byte."""
    lut = np.full(256, 4, np.uint8)
    for i, letters in enumerate((b"Aa", b"Cc", b"Gg", b"TtUu")):
        for b in letters:
            lut[b] = i
    return lut[np.frombuffer(text, np.uint8)]


def chunk_counts(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """c0, c1, ..., n: keys as numbers of 31 bases each, counted within every batch before the shuffle."""
    check_k(k)
    names = [f"c{i}" for i in range(len(chunk_widths(k)))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = overlapping([t for t in batch.column(0).cast(pa.binary()).to_pylist() if t is not None and len(t) >= k], k)
            a = 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b]) <= CHUNK_BYTES):
                    size += len(texts[b]) + 1
                    b += 1
                codes = base_codes(b"\n".join(texts[a:b]))
                a = b
                bad = np.concatenate([[0], np.cumsum(codes > 3)])
                good = bad[k:] == bad[:-k]
                if good.any():
                    keys = canonical_chunks((codes & 3).astype(np.int64), k)
                    columns, n = _counts([c[good] for c in keys])
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(n)], [*names, "n"])

    return reads.select(seq).mapInArrow(count, ", ".join(f"{c} bigint" for c in [*names, "n"]))


def chunk_text(k: int) -> Column:
    """Key text of the columns c0, c1, ... of chunk_counts."""
    parts = [S.left_aligned_text(F.shiftleft(F.col(f"c{i}"), 64 - 2 * w), w) for i, w in enumerate(chunk_widths(k))]
    return parts[0] if len(parts) == 1 else F.concat(*parts)

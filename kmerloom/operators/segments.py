"""Counts of keys of more than one column (k over 31): runs of windows are shuffled, 2 bits a base, instead of windows.

A window belongs to the bucket of the least 16 bases in it, under a hash and in either strand, so that all windows of one key
are in one bucket. Neighbours mostly share it: a segment is a run of windows of one bucket. Each bucket is counted by itself,
so no key is shuffled. Reads come first to the buckets of a hash of them, so that equal ones are cut once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from kmerloom.operators import kmers
from kmerloom.session import shuffle_width

MARK_BASES = 16
BUCKET_BITS = 12
SPAN = 256  # windows of a segment at most
HELD_BYTES = 32 << 20  # text whose reads and segments are brought together before the shuffle
HELD_KEYS = 1 << 21  # keys counted at a time
SCHEMA = pa.schema([("bucket", pa.int32()), ("spans", pa.large_binary()), ("weights", pa.large_binary()), ("bases", pa.large_binary())])
_FACTORS = np.random.default_rng(0).integers(0, 1 << 63, (SPAN + kmers.MAX_K) // 4 + 1, np.uint64)
_FOUR = ((np.arange(256)[:, None] >> np.array([6, 4, 2, 0])) & 3).astype(np.int64)


def _before(sizes: np.ndarray) -> np.ndarray:
    """Sum of the sizes before each."""
    return np.cumsum(sizes) - sizes


def _buckets(codes: np.ndarray, k: int) -> np.ndarray:
    """Bucket of every window. Marks that repeat 1 to 3 bases come last: many different windows have them."""
    mark = kmers.canonical_chunks(codes, MARK_BASES)[0].astype(np.uint32)
    rank = mark * np.uint32(0x9E3779B1)
    rank ^= rank >> np.uint32(15)
    rank *= np.uint32(0x85EBCA6B)
    rank = (rank ^ (rank >> np.uint32(13))) >> np.uint32(1)
    for p in (1, 2, 3):
        rank |= ((mark >> np.uint32(2 * p)) == (mark & np.uint32(4 ** (MARK_BASES - p) - 1))).astype(np.uint32) << np.uint32(31)
    least, size, width = rank, 1, k - MARK_BASES + 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    n = len(codes) - k + 1
    least = np.minimum(least[:n], least[width - size : width - size + n])
    return (least * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BUCKET_BITS)


def _runs(codes: np.ndarray, good: np.ndarray, bucket: np.ndarray | None, starts: np.ndarray, n: np.ndarray, k: int) -> pa.Table:
    """bucket, span, bases, n: runs of good windows of one bucket, four bases a byte, zeros after the last; those from starts on
    occur n times. Without buckets the runs are as long as may be, and their bucket is a hash of their bases."""
    new = np.ones(len(good), bool)
    new[1:] = good[1:] != good[:-1]
    if bucket is not None:
        new[1:] |= bucket[1:] != bucket[:-1]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(good)))[good[at]]
    at = at[good[at]]
    parts = -(-size // SPAN)
    start = np.repeat(at, parts) + SPAN * (np.arange(parts.sum()) - np.repeat(_before(parts), parts))
    span = np.minimum(SPAN, np.repeat(at + size, parts) - start)
    packed = (span + k + 2) // 4
    within = np.arange(4 * packed.sum()) - np.repeat(4 * _before(packed), 4 * packed)
    there = within < np.repeat(span + k - 1, 4 * packed)
    four = np.where(there, codes[np.where(there, np.repeat(start, 4 * packed) + within, 0)], 0).astype(np.uint8).reshape(-1, 4)
    data = (four[:, 0] << 6) | (four[:, 1] << 4) | (four[:, 2] << 2) | four[:, 3]
    if bucket is not None:
        own = bucket[start]
    elif len(start):
        place = np.arange(len(data)) - np.repeat(_before(packed), packed)
        own = np.add.reduceat((data + np.uint64(1)) * _FACTORS[place], _before(packed)) * np.uint64(0x9E3779B97F4A7C15)
        own = (own ^ (own >> np.uint64(32))) % np.uint64(1 << BUCKET_BITS)
    else:
        own = start
    return pa.table({
        "bucket": own.astype(np.int32),
        "span": (span - 1).astype(np.uint8),
        "bases": _slices(np.append(0, np.cumsum(packed)), data),
        "n": n[np.searchsorted(starts, start, "right") - 1],
    })


def _pieces(texts: list[bytes], n: np.ndarray, k: int) -> pa.Table:
    """Runs of the bases of texts that occur n times each."""
    codes = kmers.base_codes(b"\n".join(texts))
    bad = np.concatenate([[0], np.cumsum(codes > 3)])
    return _runs(codes, bad[k:] == bad[:-k], None, _before(np.array([len(t) + 1 for t in texts])), n, k)


def _segments(spans: np.ndarray, weights: np.ndarray, bases: np.ndarray, k: int) -> pa.Table:
    """Segments of such runs."""
    codes = _FOUR[bases].reshape(-1)
    starts = 4 * _before((spans + k + 2) // 4)
    edges = np.zeros(len(codes) - k + 2, np.int8)
    edges[starts] = 1
    edges[starts + spans] = -1  # the k-1 bases after a run's last window are its own, so that the next begins later
    return _runs(codes, np.cumsum(edges[:-1]) > 0, _buckets(codes, k), starts, weights, k)


def _slices(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    """Binary values that lie one after the other in data."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def _data(values: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and data of binary values."""
    one = pa.concat_arrays(values.chunks)  # from offset 0 if of several chunks
    offsets = np.frombuffer(one.buffers()[1], np.int64)[one.offset : one.offset + len(one) + 1]
    return offsets - offsets[0], np.frombuffer(one.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]


def _together(parts: list[pa.Table]) -> pa.Table:
    """Equal rows are one, with the sum of n."""
    table = pa.concat_tables(parts)
    names = [c for c in table.column_names if c != "n"]
    return table.group_by(names, use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})


def _distinct_texts(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.Table]:
    """seq, n: the different texts of k bytes or more, about ``HELD_BYTES`` at a time."""
    held: list[pa.Table] = []
    for batch in batches:
        text = batch.column(0).cast(pa.large_binary())
        text = text.filter(pc.greater_equal(pc.binary_length(text), k))
        held.append(pa.table({"seq": text, "n": np.ones(len(text), np.int64)}))
        if sum(t.nbytes for t in held) > HELD_BYTES:
            held = [_together(held)]
            if held[0].nbytes > HELD_BYTES // 2:
                yield held.pop()
    if held:
        yield _together(held)


def _rows(segments: list[pa.Table]) -> pa.RecordBatch:
    """A row a bucket: windows of its segments less 1 (a byte each), how often they occur, and their bases."""
    table = _together(segments).sort_by("bucket").combine_chunks()
    bucket, n = table["bucket"].to_numpy(), table["n"].to_numpy()
    offsets, data = _data(table["bases"])
    edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
    weights = n.astype(np.min_scalar_type(int(n.max())))
    columns = [
        pa.array(bucket[edges[:-1]]),
        _slices(edges, table["span"].to_numpy()),
        _slices(edges * weights.itemsize, weights.view(np.uint8)),
        _slices(offsets[edges], data),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=SCHEMA)


def _in_rows(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
    """Rows of the tables, each from about ``HELD_BYTES`` of bases."""
    held: list[pa.Table] = []
    size = 0
    for table in tables:
        if len(table):
            held.append(table)
            size += 4 * table["bases"].nbytes
        if size > HELD_BYTES:
            yield _rows(held)
            held, size = [], 0
    if held:
        yield _rows(held)


def _piece_rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows of the runs of the texts."""
    for table in _distinct_texts(batches, k):
        yield from _in_rows(_pieces(texts, n, k) for texts, n in _chunks(table, k))


def _segment_rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows of the segments of runs; equal runs are in one bucket and are cut once."""

    def tables() -> Iterator[pa.Table]:
        for spans, weights, bases in _bucketed(batches):
            ends = np.append(0, np.cumsum((spans + k + 2) // 4))
            runs = _together([pa.table({"span": spans, "bases": _slices(ends, bases), "n": weights})]).combine_chunks()
            for part in _parts(runs["span"].to_numpy(), runs["n"].to_numpy(), _data(runs["bases"])[1], k):
                yield _segments(*part, k)

    yield from _in_rows(tables())


def _chunks(table: pa.Table, k: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Texts of about ``kmers.CHUNK_BYTES`` together, and how often they occur; long ones in pieces that overlap."""
    texts: list[bytes] = []
    weights: list[int] = []
    size = 0
    for batch in table.to_batches(max_chunksize=10_000):
        for text, n in zip(batch.column("seq"), batch.column("n").to_pylist(), strict=True):
            for piece in kmers.overlapping([text.as_py()], k):
                if texts and size + len(piece) > kmers.CHUNK_BYTES:
                    yield texts, np.array(weights)
                    texts, weights, size = [], [], 0
                texts.append(piece)
                weights.append(n)
                size += len(piece) + 1
    if texts:
        yield texts, np.array(weights)


def _parts(spans: np.ndarray, weights: np.ndarray, bases: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The runs, about ``kmers.CHUNK_BYTES`` bases at a time."""
    packed = (spans + k + 2) // 4
    ends = np.cumsum(packed)
    groups = (ends - 1) // (kmers.CHUNK_BYTES // 4)
    edges = np.append(np.flatnonzero(np.append(True, groups[1:] != groups[:-1])), len(spans))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield spans[a:b], weights[a:b], bases[ends[a] - packed[a] : ends[b - 1]]


def _tallied(spans: np.ndarray, weights: np.ndarray, bases: np.ndarray, k: int, digits: int = 0, part: int = 0) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Keys of the segments and their counts; beyond ``HELD_KEYS`` in eight parts by a hash of the key, one after the other."""
    columns, n = None, None
    left = len(spans)
    for span, weight, data in _parts(spans, weights, bases, k):
        left -= len(span)
        starts = np.repeat(4 * _before((span + k + 2) // 4) - _before(span), span) + np.arange(span.sum())
        more, more_n = kmers.canonical_chunks(_FOUR[data].reshape(-1), k, starts), np.repeat(weight, span)
        if digits:
            mine = (kmers.mixed(more) & np.uint64(8**digits - 1)) == np.uint64(part)
            more, more_n = [c[mine] for c in more], more_n[mine]
        if columns is not None:
            more, more_n = [np.concatenate(x) for x in zip(columns, more, strict=True)], np.concatenate([n, more_n])
        columns, n = kmers.counted(more, more_n)
        if len(n) > HELD_KEYS and left:
            for digit in range(8):
                yield from _tallied(spans, weights, bases, k, digits + 1, part + digit * 8**digits)
            return
    if n is not None and len(n):
        yield columns, n


def segment_counts(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """c0, c1, ..., cnt: every key once, with its count."""
    kmers.check_k(k)
    names = [*(f"c{i}" for i in range(len(kmers.chunk_widths(k)))), "cnt"]
    plain = pa.schema([(f.name, pa.binary() if i else f.type) for i, f in enumerate(SCHEMA)])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (rows.cast(plain) for rows in _piece_rows(batches, k))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (rows.cast(plain) for rows in _segment_rows(batches, k))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for spans, weights, bases in _bucketed(batches):
            for columns, n in _tallied(spans, weights, bases, k):
                yield from _in_batches(pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(n)], names))

    rows = reads.select(seq)
    for step in (pieces, cut):
        rows = rows.mapInArrow(step, "bucket int, spans binary, weights binary, bases binary")
        rows = rows.repartition(shuffle_width(reads.sparkSession), "bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(count, ", ".join(f"{c} bigint" for c in names))


def _in_batches(batch: pa.RecordBatch, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(batch), rows):
        yield batch.slice(a, rows)


def _bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows, numbers and bases of the segments of whole buckets, small ones together; rows come by bucket."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    last, size = None, 0
    for batch in batches:
        for bucket, *parts in zip(*batch.columns, strict=True):
            if bucket != last and size >= kmers.CHUNK_BYTES // 4:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
            last = bucket
            spans, weights, bases = (x.as_py() for x in parts)
            kind = np.dtype(f"u{len(weights) // len(spans)}")
            held.append((np.frombuffer(spans, np.uint8).astype(np.int64) + 1, np.frombuffer(weights, kind).astype(np.int64), np.frombuffer(bases, np.uint8)))
            size += len(bases)
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))

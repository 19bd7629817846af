"""FASTQ as a Spark data source: ``spark.read.format("fastq").load(path)``.

A record is four lines, split on newline only; a carriage return stays in the line. gzip is told by its
first two bytes, not by its name, and read as one partition. Plain files are cut near every
``splitBytes``; a cut is taken only where exactly one line phase shows records (``@`` line, sequence,
``+`` line, quality of the sequence's length), so quality lines that begin with ``@`` do no harm. The text that is looked at
grows until it holds whole records, however long they are; a cut that can't be told stays out.

Lines are found in blocks with array operations. A schema with some of the columns only, as in
``spark.read.format("fastq").schema("seq string").load(path)``, spares the others: nothing of them is decoded.

With ``sampleBytes`` only about so many bytes of each file are read: a third each at its start, middle and end,
or the head of a compressed file.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kmerloom.sources.files import data_files, open_file, size_of

SPLIT_BYTES = 64 << 20
PROBE_BYTES = 1 << 18
LEAST_MARKED = 8
BLOCK_BYTES = 8 << 20
BATCH_RECORDS = 8192
SCHEMA = "read_id bigint, header string, seq string, qual string, file string"
_LINE_OF = {"header": 0, "seq": 1, "qual": 3}


def is_gzip(path: str) -> bool:
    with open_file(path) as f:
        return f.read(2) == b"\x1f\x8b"


def record_start(probe: bytes, at_end: bool) -> int | None:
    """Offset in probe of the first record after its first newline; None if no single phase fits.

    Where qualities are missing or of another length, no phase fits in full: then the marks alone tell it, from
    ``LEAST_MARKED`` records on.
    """
    cut = probe.find(b"\n") + 1
    if not cut:
        return None
    lines = probe[cut:].split(b"\n")
    if not at_end or lines[-1] == b"":
        lines.pop()  # incomplete
    fits, marked = [], []
    for phase in range(4):
        body = lines[phase:]
        records = len(body) // 4
        if records < 1:
            continue
        whole = [body[4 * i : 4 * i + 4] for i in range(records)]
        if all(r[0][:1] == b"@" and r[2][:1] == b"+" for r in whole):
            if records >= LEAST_MARKED:
                marked.append(phase)
            if all(len(r[1]) == len(r[3]) for r in whole):
                fits.append(phase)
    fits = fits or marked
    if len(fits) != 1:
        return None
    return cut + sum(len(x) + 1 for x in lines[: fits[0]])


def first_record(f, at: int, size: int) -> int | None:
    """Offset of the first record after ``at``; the probe grows until it shows one, to the end of the file if need be."""
    probe = PROBE_BYTES
    while True:
        f.seek(at)
        text = f.read(probe)
        start = record_start(text, at + len(text) >= size)
        if start is not None or at + len(text) >= size:
            return None if start is None else at + start
        probe *= 4


def split_offsets(path: str, split_bytes: int) -> list[int]:
    """Record offsets at which the file is cut, 0 and its size included."""
    size = size_of(path)
    cuts = [0]
    with open_file(path) as f:
        for at in range(split_bytes, size, split_bytes):
            if at <= cuts[-1]:  # within a record that the last cut went past
                continue
            start = first_record(f, at, size)
            if start is None:
                break
            if cuts[-1] < start < size:
                cuts.append(start)
    return [*cuts, size]


def sample_offsets(path: str, most: int) -> list[tuple[int, int]]:
    """Record-aligned byte ranges of a sampling scan, without overlap; a range that can't be aligned stays out."""
    out: list[tuple[int, int]] = []
    size = size_of(path)
    with open_file(path) as f:
        for a, b in sampled_bytes(path, most):
            start = first_record(f, a, size) if a else 0
            if start is None:
                continue
            start = max(start, out[-1][1] if out else 0)
            if start < b:
                out.append((start, b))
    return out


class FastqPart(InputPartition):
    def __init__(self, path: str, start: int, end: int | None, most: int | None = None):
        self.path, self.start, self.end, self.most = path, start, end, most


class FastqReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.paths = data_files(options["path"])
        self.split_bytes = int(options.get("splitBytes", SPLIT_BYTES))
        self.sample = int(options["sampleBytes"]) if "sampleBytes" in options else None
        self.columns = columns

    def partitions(self) -> list[InputPartition]:
        parts: list[InputPartition] = []
        for path in self.paths:
            if is_gzip(path):
                parts.append(FastqPart(path, 0, None, self.sample))
            elif self.sample:
                parts += [FastqPart(path, a, b) for a, b in sample_offsets(path, self.sample)]
            else:
                cuts = split_offsets(path, self.split_bytes)
                parts += [FastqPart(path, a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return parts or [FastqPart("", 0, 0)]

    def read(self, part: FastqPart) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        with open_file(part.path) as f:
            if part.end is None:
                yield from record_batches(gzip.GzipFile(fileobj=f), part.path, 0, part.most, self.columns)
            else:
                f.seek(part.start)
                yield from record_batches(f, part.path, part.start, part.end, self.columns)


def record_batches(f, path: str, at: int, end: int | None, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of the records that begin from offset ``at`` up to ``end``; a last record needs its first two lines only."""
    rest, place, over = b"", at, False  # place: offset of the first byte of rest
    while not over:
        # records are read past the end by the rest of the last one only
        block = f.read(BLOCK_BYTES if end is None else max(1 << 16, min(BLOCK_BYTES, end - place - len(rest))))
        over = not block
        data = rest + block
        buf = np.frombuffer(data, np.uint8)
        breaks = np.flatnonzero(buf == 10)
        if over and len(buf) and (not len(breaks) or breaks[-1] != len(buf) - 1):
            breaks = np.append(breaks, len(buf))  # the last line has no newline
        lines = len(breaks) if over else len(breaks) // 4 * 4
        starts = np.append(0, breaks[:-1] + 1)[:lines] if lines else np.zeros(0, np.int64)
        ends = breaks[:lines]
        heads = np.arange(0, lines, 4)
        if over and lines % 4 == 1:
            heads = heads[:-1]
        if end is not None:
            inside = place + starts[heads] < end
            heads, over = heads[inside], over or not inside.all()
        for a in range(0, len(heads), BATCH_RECORDS):
            yield _batch(buf, starts, ends, heads[a : a + BATCH_RECORDS], path, place, columns)
        used = int(breaks[lines - 1]) + 1 if lines else 0
        rest, place = data[used:], place + used
        if end is not None and place >= end:
            return


def _texts(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, missing: np.ndarray) -> pa.Array:
    """Strings between starts and ends; bytes that are no UTF-8 are replaced."""
    size = np.where(missing, 0, ends - starts)
    offsets = np.concatenate([[0], np.cumsum(size)])
    data = buf[np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])]
    if len(data) and data.max() >= 128:
        raw = data.tobytes()
        return pa.array([None if m else raw[a:b].decode("utf-8", "replace") for a, b, m in zip(offsets[:-1], offsets[1:], missing, strict=True)], pa.string())
    valid = pa.py_buffer(np.packbits(~missing, bitorder="little").tobytes()) if missing.any() else None
    return pa.Array.from_buffers(pa.string(), len(size), [valid, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _batch(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, heads: np.ndarray, path: str, place: int, columns: list[str]) -> pa.RecordBatch:
    out = []
    for c in columns:
        if c == "read_id":
            out.append(pa.array(place + starts[heads], pa.int64()))
        elif c == "file":
            out.append(pa.array([path], pa.string()).take(pa.array(np.zeros(len(heads), np.int64))))
        else:
            line = heads + _LINE_OF[c]
            missing = line >= len(starts)
            line = np.minimum(line, len(starts) - 1)
            out.append(_texts(buf, starts[line], ends[line], missing))
    return pa.RecordBatch.from_arrays(out, columns)


class FastqDataSource(DataSource):
    """Options: path (file, folder or pattern), splitBytes, sampleBytes. read_id is the record's byte offset in its file."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastqReader:
        unknown = [c for c in schema.names if c not in ("read_id", "file", *_LINE_OF)]
        if unknown:
            raise ValueError(f"no such column of a FASTQ record: {', '.join(unknown)}")
        return FastqReader(self.options, schema.names)


def raw_size(path: str) -> int:
    """Estimated bytes of the raw text of the files of a path: four times the size of a compressed one."""
    from kmerloom.operators.prefix_stats import raw_size_estimate

    return sum(raw_size_estimate(size_of(p), is_gzip(p)) for p in data_files(path))


def sampled_bytes(path: str, most: int = 256 << 20) -> list[tuple[int, int]]:
    """Byte ranges of a sampling scan of a plain file: start, middle and end, a third of ``most`` each."""
    size = size_of(path)
    part = min(size, most) // 3 or 1
    return [(a, min(size, a + part)) for a in (0, max(0, size // 2 - part // 2), max(0, size - part))]

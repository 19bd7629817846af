"""Data sources of the binary key files: ``kmer_low`` (first sightings) and ``kmer_root`` (repeats).

Read options: path, k, splitRecords. ``kmer_low`` reads a file or a folder of part files; ``kmer_root`` reads
root_0.bin .. root_255.bin of a folder, missing and empty ones included. A file that is no whole number of
records is an error. ``kmer_low`` writes a folder of part files; the format ``kmer_root`` needs all rows of a root in one task.
The functions write_low and write_root below write one file, or all 256, from any number of tasks.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from kmerloom.functions.sequence import packed_bytes
from kmerloom.operators.postprocess import ranked
from kmerloom.sources import codecs
from kmerloom.sources.files import data_files, open_file, size_of

SPLIT_RECORDS = 1 << 20
BATCH = 1 << 16
_ROOT_NAME = re.compile(r"root_(\d+)\.bin\Z")


class RecordPart(InputPartition):
    def __init__(self, path: str, start: int, records: int, root: int | None = None):
        self.path, self.start, self.records, self.root = path, start, records, root


def record_parts(path: str, size: int, split: int, root: int | None = None) -> list[RecordPart]:
    total = size_of(path)
    if total % size:
        raise ValueError(f"invalid size of {path}: {total} is not divisible by the record size {size}")
    records = total // size
    return [RecordPart(path, a * size, min(split, records - a), root) for a in range(0, records, split)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict, root: bool, packed: bool = False):
        self.k, self.root, self.packed = int(options["k"]), root, packed
        self.size = codecs.root_record(self.k).itemsize if root else packed_bytes(self.k)
        self.split = int(options.get("splitRecords", SPLIT_RECORDS))
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        parts: list[InputPartition] = []
        if self.root:
            for path in data_files(f"{self.path}/root_*.bin"):
                at = _ROOT_NAME.search(path)
                if at and int(at[1]) < 256:
                    parts += record_parts(path, self.size, self.split, int(at[1]))
        else:
            for path in data_files(self.path):
                parts += record_parts(path, self.size, self.split)
        return parts or [RecordPart("", 0, 0)]

    def read(self, part: RecordPart) -> Iterator[pa.RecordBatch]:
        if not part.records:
            return
        with open_file(part.path) as f:
            f.seek(part.start)
            for a in range(0, part.records, BATCH):
                data = f.read(self.size * min(BATCH, part.records - a))
                if self.root:
                    words, counts = codecs.unpack_root(data, self.k)
                    cols = [pa.array([part.root] * len(counts), pa.int32()), pa.array(codecs.words_to_keys(words, self.k), pa.string()), pa.array(counts)]
                    yield pa.RecordBatch.from_arrays(cols, ["root", "kmer", "cnt"])
                elif self.packed:
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(data, f"V{self.size}").tolist(), pa.binary())], ["packed"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(codecs.words_to_keys(codecs.unpack_low(data, self.k), self.k), pa.string())], ["kmer"])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # written under, to be named


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, root: bool, overwrite: bool):
        self.k, self.root, self.overwrite = int(options["k"]), root, overwrite
        self.path = options["path"].removeprefix("file://")
        self.stage = f"{self.path}.writing-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.stage, exist_ok=True)
        tag, files = uuid.uuid4().hex, {}
        try:
            for b in batches:
                words = codecs.keys_to_words(b.column("kmer").to_pylist(), self.k)
                if not self.root:
                    if None not in files:
                        name = f"part-{tag}.bin"
                        files[None] = (open(os.path.join(self.stage, name), "wb"), name)  # noqa: SIM115
                    files[None][0].write(codecs.pack_low(words, self.k))
                    continue
                roots, counts = b.column("root").to_numpy(), b.column("cnt").to_numpy()
                for r in set(roots.tolist()):
                    if r not in files:
                        files[r] = (open(os.path.join(self.stage, f"{tag}-{r}"), "wb"), f"root_{r}.bin")  # noqa: SIM115
                    files[r][0].write(codecs.pack_root(words[roots == r], counts[roots == r], self.k))
        finally:
            for f, _ in files.values():
                f.close()
        return Written([(f.name, name) for f, name in files.values()])

    def commit(self, messages) -> None:
        files = [x for m in messages if m for x in m.files]
        names = [n for _, n in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("rows of one root came from several tasks: repartition by root first")
        if os.path.exists(self.path):
            if not self.overwrite:
                self.abort(messages)
                raise FileExistsError(self.path)
            shutil.rmtree(self.path) if os.path.isdir(self.path) else os.remove(self.path)
        os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
        os.makedirs(self.path)
        for path, name in files:
            os.replace(path, os.path.join(self.path, name))
        if self.root:
            for r in range(256):
                open(os.path.join(self.path, f"root_{r}.bin"), "ab").close()
        elif not files:
            open(os.path.join(self.path, "part-empty.bin"), "wb").close()
        shutil.rmtree(self.stage, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.stage, ignore_errors=True)


class LowDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kmer_low"

    def schema(self) -> str:
        return "kmer string"

    def reader(self, schema) -> _Reader:
        if schema.names not in (["kmer"], ["packed"]):
            raise ValueError("columns of kmer_low are kmer, or packed for the records as they stand")
        return _Reader(self.options, False, schema.names == ["packed"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, False, overwrite)


class RootDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kmer_root"

    def schema(self) -> str:
        return "root int, kmer string, cnt bigint"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options, root=True)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, True, overwrite)


def register(spark: SparkSession) -> None:
    """Make the formats fastq, kmer_low and kmer_root known to the session."""
    from kmerloom.sources.fastq import FastqDataSource

    for source in (FastqDataSource, LowDataSource, RootDataSource):
        spark.dataSource.register(source)


def read_low(spark: SparkSession, path: str, k: int) -> DataFrame:
    register(spark)
    return spark.read.format("kmer_low").option("k", k).load(path)


def read_root(spark: SparkSession, path: str, k: int) -> DataFrame:
    register(spark)
    return spark.read.format("kmer_root").option("k", k).load(path)


def write_low(low: DataFrame, path: str, k: int, single: bool = False) -> None:
    """Part files in a folder; with ``single`` one file in key order, which the tasks write side by side."""
    if single:
        _write_places(ranked(low.select("kmer"), "kmer"), {None: (path, 0)}, k, packed_bytes(k))
        return
    register(low.sparkSession)
    low.select("kmer").write.format("kmer_low").option("k", k).mode("overwrite").save(path)


def write_root(root: DataFrame, path: str, k: int) -> None:
    """All 256 files in key order. A record's place follows from its rank, so a root is written by as many tasks as it fills."""
    rows = ranked(root.select("root", "kmer", "cnt"), "root", "kmer")
    counts = {r["root"]: r["count"] for r in rows.groupBy("root").count().collect()}  # 256 rows
    if any(r is None or not 0 <= r < 256 for r in counts):
        raise ValueError("root must be 0..255")
    files, before = {}, 0
    for r in range(256):
        files[r] = (f"{path}/root_{r}.bin", before)
        before += counts.get(r, 0)
    _write_places(rows, files, k, codecs.root_record(k).itemsize, path)


def _write_places(rows: DataFrame, files: dict[int | None, tuple[str, int]], k: int, size: int, folder: str | None = None) -> None:
    """Write rows (kmer, rank and for repeats root and cnt) at the places of their ranks; files: path and ranks before, by root.

    Files get their full length first, in a folder beside the target, and are moved when all tasks are done: a task that
    is run again writes the same bytes to the same place. The file system must take writes at any place (a mounted one).
    """
    target = (folder or files[None][0]).removeprefix("file://")
    stage = f"{target}.writing-{uuid.uuid4().hex}"
    os.makedirs(stage)
    try:
        total = rows.groupBy("root").count().collect() if folder else [(None, rows.count())]
        lengths = {r[0]: r[1] * size for r in total}
        inner = {r: (os.path.join(stage, os.path.basename(p)), before) for r, (p, before) in files.items()}
        for r, (p, _) in inner.items():
            with open(p, "wb") as f:
                f.truncate(lengths.get(r, 0))

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rank = b.column("rank").to_numpy()
                words = codecs.keys_to_words(b.column("kmer").to_pylist(), k)
                roots = b.column("root").to_numpy() if folder else np.zeros(len(rank), np.int64)
                cut = np.flatnonzero((np.diff(rank) != 1) | (np.diff(roots) != 0)) + 1
                for a, e in zip([0, *cut.tolist()], [*cut.tolist(), len(rank)], strict=True):
                    if a == e:
                        continue
                    p, before = inner[int(roots[a]) if folder else None]
                    data = codecs.pack_root(words[a:e], b.column("cnt").to_numpy()[a:e], k) if folder else codecs.pack_low(words[a:e], k)
                    with open(p, "r+b") as f:
                        f.seek((int(rank[a]) - 1 - before) * size)
                        f.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64())], ["done"])

        rows.mapInArrow(write, "done bigint").agg({"done": "sum"}).collect()
        if os.path.exists(target):
            shutil.rmtree(target) if os.path.isdir(target) else os.remove(target)
        os.makedirs(os.path.dirname(os.path.abspath(target)), exist_ok=True)
        os.replace(stage if folder else inner[None][0], target)
    finally:
        shutil.rmtree(stage, ignore_errors=True)


def read_packed(spark: SparkSession, path: str, k: int) -> DataFrame:
    """Raw records of a low file or folder as they stand: packed, of packed_bytes(k) bytes each."""
    register(spark)
    return spark.read.format("kmer_low").option("k", k).schema("packed binary").load(path)


def root_catalog(path: str, k: int) -> dict[int, int]:
    """Records of every root file that is there; sizes are checked."""
    size, out = codecs.root_record(k).itemsize, {}
    for r in range(256):
        p = os.path.join(path.removeprefix("file://"), f"root_{r}.bin")
        if os.path.exists(p):
            out[r] = sum(x.records for x in record_parts(p, size, SPLIT_RECORDS, r))
    return out

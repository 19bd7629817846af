"""Session helpers: tables of a data directory and tables written to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: list[str] = []
_WRITTEN: list[str] = []


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Single-machine session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("kmerloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local master may go without the setting; a private temporary folder is set then. Any other
    master without it is an error, as a machine-local folder would be invisible to other executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="kmerloom-")
    _LOCAL_SCRATCH.append(path)
    spark.conf.set("spark.checkpoint.dir", f"file://{path}")
    return f"file://{path}"


@atexit.register
def _drop_local_scratch() -> None:
    for path in _LOCAL_SCRATCH:
        shutil.rmtree(path, ignore_errors=True)


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/kmerloom/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def drop_written(spark: SparkSession) -> int:
    """Delete all intermediate tables that this process wrote; results that still read them must be saved first."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    dropped = 0
    while _WRITTEN:
        p = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        dropped += bool(p.getFileSystem(conf).delete(p, True))
    return dropped


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written within are deleted at the end, also after an error: results must be saved or collected inside.

    ``with scratch(spark): query(spark, d).write.parquet(out)``
    """
    kept = _WRITTEN[:]
    _WRITTEN.clear()
    try:
        yield
    finally:
        drop_written(spark)
        _WRITTEN.extend(kept)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: the plan is cut and survives a lost executor."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")

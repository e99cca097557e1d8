"""Session helpers: shared scratch space and joins that check what they broadcast."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# A side is broadcast only after it was counted to hold at most this many bytes.
BROADCAST_BYTES = 32 * 1024 * 1024


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="ridgework-")


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the shared folder named by ``spark.checkpoint.dir``.

    Where the setting is missing, a local session gets a temporary folder; a cluster session must
    name one, since executors on other machines could not see a local path.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stage(df: DataFrame, purpose: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to shared scratch space and read it back, which also cuts its lineage.

    ``by`` names columns (the last of ``df``) whose values get a folder each, which later filters prune.
    """
    path = scratch_dir(df.sparkSession, purpose)
    df.write.partitionBy(*by).parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged._staged_at = path
    return staged


def discard(*staged: DataFrame) -> None:
    """Free the scratch tables behind frames that ``stage`` returned.

    Only for tables whose every reader has been stored itself: nothing that is still to run, or
    could have to run again, may read them.
    """
    for df in staged:
        drop_folder(df.sparkSession, df._staged_at)


def _at(spark: SparkSession, folder: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def drop_folder(spark: SparkSession, folder: str) -> None:
    files, path = _at(spark, folder)
    files.delete(path, True)


def folder_exists(spark: SparkSession, folder: str) -> bool:
    files, path = _at(spark, folder)
    return files.exists(path)


@contextlib.contextmanager
def listing_lightly(spark: SparkSession):
    """Meanwhile, frames over many folders list them in as many tasks as a shuffle has, and the driver keeps no copy of what they list.

    By default a listing takes 10,000 tasks, each of which the driver remembers, and fills a cache of 250 MB that later frames share.
    """
    held = {
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": spark.conf.get("spark.sql.shuffle.partitions"),
        "spark.sql.hive.filesourcePartitionFileCacheSize": "0",
    }
    before = {name: spark.conf.get(name) for name in held}
    try:
        for name, value in held.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def broadcastable(rows: int, row_bytes: int) -> bool:
    return rows * row_bytes <= BROADCAST_BYTES


def fits(df: DataFrame, row_bytes: int) -> bool:
    """Whether ``df`` is small enough to broadcast; every task sends one count."""
    return broadcastable(df.count(), row_bytes)


def checked_broadcast(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if it was counted small enough, else unmarked."""
    return F.broadcast(df) if fits(df, row_bytes) else df


def only_keys(big: DataFrame, keys: DataFrame, on: list[str], key_bytes: int = 32) -> DataFrame:
    """Drop rows of ``big`` that cannot meet ``keys``, ahead of a shuffle that would move them.

    Does nothing when there are too many keys to broadcast: the shuffled join drops the rows then.
    """
    if not fits(keys, key_bytes):
        return big
    return big.join(F.broadcast(keys), on, "left_semi")


def spread(df: DataFrame, on: list[str], rows: int | None = None) -> DataFrame:
    """Rows dealt over all shuffle partitions by key, for kernels that cost far more than bytes.

    Adaptive execution sizes partitions by bytes and would put a few heavy tiles into one task; a
    partition count given outright is left as it is. Fewer ``rows`` than that get one each.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions if rows is None else max(min(partitions, rows), 1), *on)


def stream_join(big: DataFrame, small: DataFrame, on: list[str], how: str, is_small: bool) -> DataFrame:
    """Join wide tile rows to a lighter side without ever sorting the tile rows.

    The light side is broadcast when it was found small; otherwise both are shuffled and the hash
    table is built on the light side.
    """
    side = F.broadcast(small) if is_small else small.hint("shuffle_hash")
    return big.join(side, on, how)


def merge_join(big: DataFrame, other: DataFrame, on: list[str], how: str, is_small: bool) -> DataFrame:
    """Join two sides that may both be heavy: broadcast if counted small, else sorted, which can spill."""
    return big.join(F.broadcast(other) if is_small else other.hint("merge"), on, how)

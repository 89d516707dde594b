"""Helpers shared by operators: table access, written intermediates, heavy keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder of this machine.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    made = tempfile.mkdtemp(prefix="propgraph-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, which ``release`` deletes."""
    path = f"{shared_dir(spark)}/propgraph-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once into the shared folder and return a DataFrame that reads it.

    Cuts lineage, so that a costly or non-repeatable plan runs once although it is used twice,
    and survives the loss of executors. ``release`` deletes what was written.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every intermediate written by ``materialize``, or to a ``scratch_path``, for this session."""
    jvm = spark._jvm
    for owner, path in [x for x in _WRITTEN if x[0] is spark]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _WRITTEN.remove((owner, path))


def heavy_keys(df: DataFrame, keys: list[str], blocks: int, total: int | None = None) -> DataFrame:
    """Keys holding more than one ``blocks``-th of the rows (or of ``total``, at least as many): fewer than ``blocks`` of them, whatever the data.

    Counts are combined on the map side. The result is written, so reading it back has a known,
    small size; that bound is what allows callers to broadcast it.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    total = df.count() if total is None else total
    return materialize(counts.where(F.col("n_rows") * F.lit(blocks) > F.lit(total)).coalesce(1))


def block_of(value: Column, bounds: list[int]) -> Column:
    """Number of sorted ``bounds`` that lie below ``value``: the block of a quantile split, by binary search."""
    if not bounds:
        return F.lit(0)
    size = 1 << len(bounds).bit_length()
    padded = F.lit([*bounds, *[(1 << 63) - 1] * (size - 1 - len(bounds))]).cast("array<bigint>")
    halves = F.lit([size >> i for i in range(1, size.bit_length())]).cast("array<int>")
    return F.aggregate(halves, F.lit(0), lambda at, step: F.when(F.element_at(padded, at + step) < value, at + step).otherwise(at))


def ensure_columns(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


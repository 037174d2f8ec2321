"""What the operators share: reading tables, the shared folder, whole-row identity, and offsets without one large window."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each context, as their workers may not have it installed."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        package = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="milepost-")) / "milepost.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, source.relative_to(package.parent))
        context.addPyFile(str(archive))


_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, of spark.checkpoint.dir; where that is unset, as in tests, a temporary one.

    On a cluster it has to be set, as a temporary folder of the driver is no place that executors can reach.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="milepost-"))
    return context.getCheckpointDir()


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name like `wanted` that df does not have."""
    taken = {name.lower() for name in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def stored(df: DataFrame, label: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """df written to the shared folder and read again: computed once, and safe from the loss of an executor."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: What this worker keeps from task to task, by the operator that keeps it.
kept: dict[str, object] = {}


def forget(but: str = "") -> None:
    """Drops what the operators other than `but` have kept in this worker."""
    for name in kept.keys() - {but}:
        del kept[name]


def give_back() -> None:
    """Returns memory that is freed but still held, by Arrow or the C library, to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def lean(work: Work, keeps: str = "") -> Work:
    """`work`, for mapInArrow, in a worker that holds no more memory than it needs.

    A worker serves one stage after another, and waits beside the executor's JVM while stages without Python run. So it drops
    what other operators than `keeps` have kept in it, and after a task gives back what was freed. Results do not change.
    """

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keeps)
        try:
            yield from work(batches)
        finally:
            give_back()

    return done


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def with_offsets(df: DataFrame, group: str, bucket: str, order: list[Column], weight: Column, name: str) -> DataFrame:
    """Adds the sum of `weight` over the rows of the same group that come before, in the order (bucket, order).

    The buckets' sums are added up per group, then the rows within a bucket, so no window holds a whole group.
    """
    keys = df.groupBy(group, bucket).agg(F.sum(weight).alias("_sum"))
    ahead = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = keys.select(
        F.col(group).alias("_group"), F.col(bucket).alias("_bucket"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_start")
    )
    within = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("_inner", F.coalesce(F.sum(weight).over(within), F.lit(0)))
    joined = inner.join(starts, (F.col(group) == F.col("_group")) & (F.col(bucket) == F.col("_bucket")))
    return joined.withColumn(name, F.col("_start") + F.col("_inner")).drop("_group", "_bucket", "_start", "_inner")

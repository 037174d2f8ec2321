"""Equi-joins of a large table with a table keyed by the join column, safe for hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Items a sketch tracks for each shuffle partition. It can miss a key only if
# the key holds less than about a quarter of a partition's share.
TRACKED_PER_PARTITION = 16
# What the sketch function accepts at most; beyond 62500 partitions it tracks
# fewer items for each, and still more than there can be hot keys.
TRACKED_LIMIT = 1_000_000
# Tasks that merge the sketches of all scan tasks before the last one does. Only their fan-in depends on it.
MERGE_TASKS = 256


def shuffle_partitions(spark: SparkSession) -> int:
    """Partitions that a shuffle of this session starts with."""
    for name in ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.shuffle.partitions"):
        value = spark.conf.get(name, None)
        if value and value.isdigit():
            return int(value)
    return spark.sparkContext.defaultParallelism


def hot_keys(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Keys holding more than one shuffle partition's share of ``df``.

    Returns (key, parts) with the number of partitions worth of rows each key
    holds. One pass over the key column. Fewer than ``partitions`` keys can
    hold more than a share each, so that many are asked for and none is left
    out; ``parts`` adds up to at most twice the number of partitions.

    Each scan task sends one sketch of bounded size. They are merged in two
    steps, so that no task gets one from every scan task.
    """
    partitions = partitions or shuffle_partitions(df.sparkSession)
    tracked = min(TRACKED_LIMIT, max(1024, TRACKED_PER_PARTITION * partitions))
    share = F.col("top.count") / F.col("total")
    sketches = (
        df.where(F.col(key).isNotNull())
        .select(key, (F.spark_partition_id() % MERGE_TASKS).alias("merge_task"))
        .groupBy("merge_task")
        .agg(
            F.count(key).alias("rows"),
            F.expr(f"approx_top_k_accumulate(`{key}`, {tracked})").alias("sketch"),
        )
    )
    # Grouped by a constant: of an empty table there is no sketch to merge, and no row.
    return (
        sketches.groupBy(F.lit(0).alias("all"))
        .agg(
            F.sum("rows").alias("total"),
            F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {tracked}), {min(partitions, tracked)})").alias("tops"),
        )
        .select("total", F.explode("tops").alias("top"))
        .select(F.col("top.item").alias(key), F.ceil(share * partitions).cast("int").alias("parts"))
        .where("parts > 1")
    )


def join_split(many: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """Inner join on ``key`` that adaptive execution can split where ``many`` holds a large share of its rows under one key.

    Spark splits a skewed partition only if both sides are shuffled for the join. Where ``one`` already sits on the key it
    would stay as it is, so the join is on the key and a hash of it, which neither side is laid out by. Each table is read
    once; the price is one more shuffle of ``one``. How large a partition must be to be split are Spark's settings, and
    without adaptive execution none is: ``join_many_to_one`` does not depend on it, and finds hot keys by a second pass.
    """
    mark = F.xxhash64(key)
    return many.withColumn("_mark", mark).join(one.withColumn("_mark", mark), [key, "_mark"]).drop("_mark")


def join_many_to_one(many: DataFrame, one: DataFrame, key: str, row_id: str, unmatched: bool = False) -> DataFrame:
    """Inner join on ``key`` where ``many`` may hold a large share of its rows under one key.

    The rows of a hot key are dealt over several parts by ``row_id``, a column
    that tells them apart, so other columns can still be pruned. Only the matching rows of ``one`` are copied to each part, so no task gets
    a whole hot group. Other keys have a single part. The broadcast side is the
    list of hot keys, fewer than there are shuffle partitions. Rows of one id
    get the same part, also when a lost task is run again; a large group of
    them is left to Spark's own skew splitting, which applies to this join.
    Finding the hot keys costs a second pass over the key column of ``many``.

    With ``unmatched``, rows of ``one`` that no row of ``many`` matches stay,
    with nulls. Adaptive execution cannot split that side of an outer join. A
    hot key has matches for certain, so of its copies only matched ones count.
    """
    hot = F.broadcast(hot_keys(many, key))
    part = F.pmod(F.xxhash64(row_id), F.col("parts")).cast("int")
    dealt = (
        many.where(F.col(key).isNotNull())
        .join(hot, key, "left")
        .withColumn("_part", F.coalesce(part, F.lit(0)))
        .drop("parts")
    )
    parts = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    copied = one.join(hot, key, "left").withColumn("_part", F.explode(parts))
    if not unmatched:
        return dealt.join(copied.drop("parts"), [key, "_part"]).drop("_part")
    joined = copied.join(dealt.withColumn("_met", F.lit(True)), [key, "_part"], "left")
    return joined.where(F.col("_met") | F.col("parts").isNull()).drop("_part", "_met", "parts")

"""Resharding by minimum-cost flow: the fewest bytes leave the shard they lie in.

Old shard sizes are supplies, new capacities are demands. A byte that stays costs nothing, a byte that moves costs 1. The
network has one node per shard and a hub through which moved bytes go, so it grows with the number of shards, is solved in
linear time, and only shard sizes come to the driver. The flow is turned into blocks, each a range of bytes of one old shard in the order of its
documents; a document goes where its middle byte falls. Only files of shards that gain or lose documents are rewritten.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from milepost.llm.common import shared_folder, table, with_offsets

#: Bytes that a document takes besides its text.
OVERHEAD = 16
#: Rows that a bucket of an old shard holds on average; the running sums are taken per bucket.
ROWS_PER_BUCKET = 2000
#: More old shards than this are refused, as their sizes are handled on the driver.
MAX_SHARDS = 100_000


@dataclass(frozen=True)
class Block:
    """Bytes start (inclusive) to end (exclusive) of an old shard that belong in a new one."""

    old: int
    new: int
    start: int
    end: int


def flow_by_cost(old_sizes: list[int], capacities: list[int]) -> tuple[list[int], list[int], list[int]]:
    """A cheapest largest flow: what stays in each place, what leaves each old shard and what arrives in each new one.

    Every path of the network costs 0 (old shard to new shard of one place) or 1 (through the hub), and paths of cost 0 share
    no arc with each other. Successive cheapest paths therefore fill those first and never take flow back, in linear time.
    """
    stay = [min(a, b) for a, b in zip(old_sizes, capacities, strict=False)]
    leave = [size - (stay[i] if i < len(stay) else 0) for i, size in enumerate(old_sizes)]
    arrive = [capacity - (stay[j] if j < len(stay) else 0) for j, capacity in enumerate(capacities)]
    return stay, leave, arrive


def blocks(old_sizes: list[int], capacities: list[int]) -> list[Block]:
    """The blocks of a cheapest plan. Old and new shard of one number are the same place; the sums must be equal."""
    if sum(old_sizes) != sum(capacities):
        raise ValueError("capacities must add up to the sizes")
    stay, leave, arrive = flow_by_cost(old_sizes, capacities)
    plan, wanted = [], [[j, amount] for j, amount in enumerate(arrive) if amount][::-1]
    for i, left in enumerate(leave):
        at = stay[i] if i < len(stay) else 0
        if at:
            plan.append(Block(i, i, 0, at))
        while left:
            taken = min(left, wanted[-1][1])
            plan.append(Block(i, wanted[-1][0], at, at + taken))
            at, left, wanted[-1][1] = at + taken, left - taken, wanted[-1][1] - taken
            if not wanted[-1][1]:
                wanted.pop()
    return plan


def cut_rows(plan: list[Block]) -> list[tuple[int, int, int, int, int, int]]:
    """(old, step, nth, new, start, end): each block once for every step of its old shard that it reaches into.

    A shard is divided into as many equal steps as it has blocks, so there are at most twice as many rows as blocks.
    """
    number, size = Counter(b.old for b in plan), Counter()
    for b in plan:
        size[b.old] = max(size[b.old], b.end)
    rows = []
    for b in plan:
        step = -(-size[b.old] // number[b.old])
        rows += [(b.old, step, k, b.new, b.start, b.end) for k in range(b.start // step, (b.end - 1) // step + 1)]
    return rows


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def sized(docs: DataFrame, old_shard: Column) -> DataFrame:
    """doc_id, text, size, text_crc32 and the name of the shard that a document lies in; a missing name is a name too."""
    return docs.select(
        "doc_id",
        "text",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), old_shard.cast("string")), F.lit("")).alias("old_name"),
    )


def reshard(docs: DataFrame, old_shard: Column, shards: int) -> tuple[DataFrame, list[Block]]:
    """Every document with its new shard (0 to shards - 1), old and new sizes as near equal as whole documents allow.

    Old shards are numbered by name; those beyond `shards` are emptied. More than MAX_SHARDS, old or new, are refused. Equal rows are separate rows. Without rows there
    are no blocks. Only doc_id, text and the old shard's name are read; other columns may have any name.
    """
    rows = sized(docs, old_shard)
    found = rows.groupBy("old_name").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).limit(MAX_SHARDS + 1).collect()
    if max(len(found), shards) > MAX_SHARDS:
        raise ValueError(f"more than {MAX_SHARDS} shards")
    found.sort(key=lambda r: r["old_name"])
    sizes = [r["bytes"] for r in found]
    plan = blocks(sizes, even_capacities(sum(sizes), shards))
    spark = docs.sparkSession
    olds = spark.createDataFrame(
        [(r["old_name"], i, -(-r["n"] // ROWS_PER_BUCKET)) for i, r in enumerate(found)], "old_name string, old int, buckets int"
    )
    pieces = cut_rows(plan)
    steps = spark.createDataFrame(sorted({(old, step) for old, step, *_ in pieces}), "_old int, _step long")
    cuts = spark.createDataFrame([(x[0], *x[2:]) for x in pieces], "_old int, _nth long, shard int, _from long, _to long")
    rows = rows.join(F.broadcast(olds), "old_name").withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("buckets")).cast("int")
    )
    rows = with_offsets(rows, "old", "bucket", [F.col("doc_id"), F.col("text_crc32")], F.col("size"), "at")
    rows = rows.withColumn("_middle", F.col("at") + F.expr("size div 2"))
    # A row meets the few blocks of its step, not all blocks of its shard. Both tables grow with the shards only.
    stepped = rows.join(F.broadcast(steps), F.col("old") == F.col("_old")).drop("_old").withColumn("_at", F.expr("_middle div _step"))
    within = (F.col("_middle") >= F.col("_from")) & (F.col("_middle") < F.col("_to"))
    placed = stepped.join(F.broadcast(cuts), (F.col("old") == F.col("_old")) & (F.col("_at") == F.col("_nth")) & within)
    return placed.select("doc_id", "text", "size", "text_crc32", "old", "shard"), plan


def affected(plan: list[Block]) -> list[int]:
    """New shards that gain or lose bytes; the files of all others stay as they are."""
    return sorted({b.new for b in plan if b.new != b.old} | {b.old for b in plan if b.new != b.old})


def rewrite(placed: DataFrame, plan: list[Block], folder: str) -> DataFrame:
    """Writes the affected shards to folder/shard=N and returns all documents with their shard, those read from there."""
    changed = affected(plan)
    is_changed = F.col("shard").isin(changed) if changed else F.lit(False)
    placed.where(is_changed).write.partitionBy("shard").parquet(folder)
    written = placed.sparkSession.read.schema(placed.schema).parquet(folder)
    unchanged = len({b.new for b in plan} - set(changed))
    return written.unionByName(placed.where(~is_changed)) if unchanged else written


def with_slots(rows: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Numbers the documents of each shard from 0 without gaps."""
    n = rows.count()
    spread = rows.withColumn("_part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(max(1, n // (40 * rows_per_bucket)))).cast("int"))
    order = [F.col("doc_id"), F.col("text_crc32")]
    return with_offsets(spread, "shard", "_part", order, F.lit(1), "slot").drop("_part")


def op1_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves the documents from one shard per source to 40 shards of near equal bytes."""
    placed, plan = reshard(table(spark, sf_dir, "documents"), F.col("source"), 40)
    rows = rewrite(placed, plan, f"{shared_folder(spark)}/reshard-{uuid.uuid4().hex[:12]}")
    digest = rows.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        "old",
        "shard",
    )
    return with_slots(digest).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"),
        F.lit(None).cast("int").alias("grown_shard"), (F.col("old") != F.col("shard")).alias("moved"),
    )

"""Prefix trie of conversations, with sums over subtrees by depth bands.

A node is a sequence of turns that conversations start with. Its key is the exclusive or of two 64-bit hashes of (position,
turn) over its turns, so the keys along a conversation are running sums, which are built from parts: first within ranges of
the turns sorted over the whole table, then over the ranges. No task holds a conversation, and none holds a node's members.

Sums over subtrees go up in bands of BAND levels. Each node is counted at its ancestors of its own band only, which a node
finds on the path of its smallest member. The roots of the bands form a trie of their own, BAND times lower, whose sums are
found the same way; the completed sum of a band's root is then counted at its ancestors in the band above. So a node's row is
multiplied by at most BAND, and a trie of depth d takes log d / log BAND rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from milepost.llm.common import ship, stored, table
from milepost.operators.hot_keys import join_many_to_one

#: Levels of a band.
BAND = 8
#: Conversations whose ids lie between multiples of this begin with turns of the multiple before.
GROUP = 20
#: The first turns that can be taken from there are fewer than this.
HEADS = 4
_WORD = r"[^\x20\x09-\x0D]+"


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, bucket, turn, content, words, serial: the turns in ranges of the order (conv_id, turn, content), as stored.

    content tells role and text apart from others (128 bits), so texts are not sorted. Equal turns of one conversation are
    told apart by serial, so no run of rows is too long to be cut.
    """
    role, text = (F.coalesce(name, F.lit("")) for name in ("role", "text"))
    marked = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.unhex(F.md5(marked)).alias("content"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("serial"),
    )
    ranges = rows.repartitionByRange("conv_id", "turn", "content", "serial")
    return stored(ranges.withColumn("bucket", F.spark_partition_id()), "turns")


def rebuilt_sizes(rows: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, base, h, head (turns taken from the base), total (turns when rebuilt)."""
    own = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = own.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("long")
    sized = own.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base")).join(base, "base", "left")
    head = F.least("h", F.coalesce("n_base", F.lit(0)))
    return sized.select("conv_id", "base", "h", head.alias("head"), (head + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns (conv_id, bucket, pos from 0, content, words, last) and the conversations (conv_id, total), stored.

    A conversation c has the first h turns of conversation c - c % GROUP, then its own after its first h; h is crc32 of the
    decimal c, modulo HEADS. Turns are in the order of `turn`, null first; of equal ones, by MD5 of (bytes of role, colon,
    role, text). Rows alike in all are turns of their own. Rows without a conv_id are in no conversation.
    """
    rows = numbered_turns(conversations)
    sizes = stored(rebuilt_sizes(rows), "conversations")
    counts = rows.groupBy("conv_id", "bucket").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("conv_id", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start")).join(sizes, "conv_id")
    within = Window.partitionBy("conv_id", "bucket").orderBy("turn", "content", "serial")
    placed = rows.join(starts, ["conv_id", "bucket"]).withColumn("at", F.col("start") + F.row_number().over(within) - 1)
    own = placed.where("at >= h").select(
        "conv_id", "bucket", (F.col("at") - F.col("h") + F.col("head")).alias("pos"), "content", "words", "total"
    )
    heads = placed.where((F.col("conv_id") % GROUP == 0) & (F.col("at") < HEADS - 1)).select(
        F.col("conv_id").alias("base"), F.col("at").alias("pos"), "content", "words"
    )
    taken = sizes.where("head > 0").join(heads, "base").where("pos < head")
    taken = taken.select("conv_id", F.lit(-1).alias("bucket"), "pos", "content", "words", "total")
    turns = own.unionByName(taken).withColumn("last", F.col("pos") + 1 == F.col("total")).drop("total")
    return stored(turns, "rebuilt"), sizes.select("conv_id", "total")


def paths(turns: DataFrame) -> DataFrame:
    """conv_id, depth, words, last, the node's key k1, k2 and its parent's p1, p2, for each turn."""
    turns = turns.withColumns({f"f{n}": F.xxhash64(F.lit(n), "pos", "content") for n in (1, 2)})
    parts = turns.groupBy("conv_id", "bucket").agg(*[F.bit_xor(f"f{n}").alias(f"x{n}") for n in (1, 2)])
    ahead = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("conv_id", "bucket", *[F.coalesce(F.bit_xor(f"x{n}").over(ahead), F.lit(0)).alias(f"s{n}") for n in (1, 2)])
    within = Window.partitionBy("conv_id", "bucket").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    keyed = turns.join(starts, ["conv_id", "bucket"])
    keyed = keyed.withColumns({f"k{n}": F.col(f"s{n}").bitwiseXOR(F.bit_xor(f"f{n}").over(within)) for n in (1, 2)})
    return keyed.select(
        "conv_id",
        (F.col("pos") + 1).alias("depth"),
        "words",
        "last",
        "k1",
        "k2",
        *[F.col(f"k{n}").bitwiseXOR(F.col(f"f{n}")).alias(f"p{n}") for n in (1, 2)],
    )


def subtree_sums(nodes: DataFrame, lines: DataFrame, names: list[str], deepest: int, band: int = BAND) -> DataFrame:
    """k1, k2 and the sums of the columns `names` over the subtree of each node.

    nodes: k1, k2, conv_id (whose path leads to the node), depth, names; no node lacks its ancestors. lines: conv_id, depth,
    k1, k2 of all nodes on the paths. deepest: the greatest depth.
    """
    of = lambda depth: F.floor(depth / band).alias("band")
    place = F.sort_array(F.collect_list(F.struct("depth", "k1", "k2"))).alias("line")
    bands = lines.groupBy("conv_id", of(F.col("depth"))).agg(place)
    if deepest >= band:
        bands = stored(bands, "bands")

    def counted(rows: DataFrame, level: Column, up_to: Column) -> DataFrame:
        """Each row's values at the nodes of one band of its path, down to a depth."""
        joined = rows.withColumn("band", level).join(bands, ["conv_id", "band"])
        found = joined.select(F.explode(F.filter("line", lambda x: x["depth"] <= up_to)).alias("to"), *names)
        return found.select("to.k1", "to.k2", *names).groupBy("k1", "k2").agg(*[F.sum(name).alias(name) for name in names])

    inside = counted(nodes, of(F.col("depth")), F.col("depth"))
    if deepest < band:
        return inside
    inside = stored(inside, "inside")
    is_root = F.col("depth") % band == 0
    up = (F.col("depth") / band).cast("long").alias("depth")
    roots = nodes.where(is_root).select("k1", "k2", "conv_id", up)
    upper = lines.where(is_root).select("conv_id", up, "k1", "k2")
    completed = subtree_sums(roots.join(inside, ["k1", "k2"]), upper, names, deepest // band, band)
    below = roots.where("depth > 0").join(completed, ["k1", "k2"])
    carried = counted(below, (F.col("depth") - 1).alias("band"), F.col("depth") * band)
    return inside.unionByName(carried).groupBy("k1", "k2").agg(*[F.sum(name).alias(name) for name in names])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, int]]:
    """Key and range of the rows that follow on each other with the same key."""
    k1, k2 = (batch.column(name).to_numpy() for name in ("k1", "k2"))
    if len(k1):
        cuts = np.flatnonzero((np.diff(k1) != 0) | (np.diff(k2) != 0)) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(k1)], strict=True):
            yield (int(k1[start]), int(k2[start])), start, end


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("conv_id").to_pylist()
        rows = [(*key, ids[start], ",".join(map(str, ids[start:end]))) for key, start, end in _runs(batch)]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["k1", "k2", "first", "ids"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each key, whose lists come in order; a list is forgotten once it is hashed."""

    def out(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["k1", "k2", "ends_sha256"])

    held, digest = None, None
    for batch in batches:
        ids, done = batch.column("ids").to_pylist(), []
        for key, start, end in _runs(batch):
            if key != held:
                if held is not None:
                    done.append((*held, digest.hexdigest()))
                held, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(",".join(ids[start:end]).encode())
        yield out(done)
    if held is not None:
        yield out([(*held, digest.hexdigest())])


def id_digests(ends: DataFrame) -> DataFrame:
    """k1, k2 and the SHA-256 of the ids of the conversations that end at a node, ascending, joined by commas.

    The rows are sorted over the whole table, each task joins the ids of a node that follow on each other, and these lists,
    one for each of a node's batches, are then hashed one after the other.
    """
    order = ["k1", "k2", "conv_id"]
    lists = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    lists = lists.mapInArrow(_listed, "k1 long, k2 long, first long, ids string")
    return lists.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(_digested, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame, band: int = BAND) -> DataFrame:
    """One row for each node of the trie of the conversations' turns: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, and the key k1, k2.

    conversations: conv_id and total, the number of its turns, for every one, also those of no turn. turns: as `rebuilt` gives
    them. Conversations of no turn are members of the root alone; without conversations there is no row. Nulls are settled
    when turns are numbered: a null role or text is empty, rows without a conv_id are left out.
    """
    ship(turns.sparkSession)
    lines = stored(paths(turns), "paths")
    members = [F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")]
    found = lines.groupBy("k1", "k2").agg(
        *members, *[F.min(name).alias(name) for name in ("p1", "p2", "depth", "words")]
    )
    none = F.lit(None).cast("long")
    root = conversations.agg(*members).where("n_convs > 0")
    zeros = {name: F.lit(0).cast("long") for name in ("k1", "k2", "depth", "words")}
    found = stored(found.unionByName(root.withColumns({**zeros, "p1": none, "p2": none})), "nodes")
    children = found.where("depth > 0").groupBy("p1", "p2").agg(F.count("*").alias("n_children"))
    children = children.withColumnsRenamed({"p1": "k1", "p2": "k2"})
    nodes = found.join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))

    own = nodes.select(
        "k1", "k2", "conv_id", "depth",
        (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    )
    start = conversations.select("conv_id", *[F.lit(0).cast("long").alias(name) for name in ("depth", "k1", "k2")])
    whole = lines.select("conv_id", "depth", "k1", "k2").unionByName(start)
    deepest = found.agg(F.max("depth")).first()[0] or 0
    sums = subtree_sums(own, whole, ["n_leaves", "saved_tokens"], deepest, band)

    turnless = conversations.where("total = 0").select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id")
    digests = id_digests(lines.where("last").select("k1", "k2", "conv_id").unionByName(turnless))

    # A node may have any number of children. The parent's row is copied for as many tasks as they fill.
    parents = found.select(F.col("k1").alias("p1"), F.col("k2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    with_parent = join_many_to_one(nodes.where("depth > 0"), parents, "p1", "k1").where("p2 = q2").drop("q2")
    placed = with_parent.unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", none))
    joined = placed.join(sums, ["k1", "k2"]).join(digests, ["k1", "k2"], "left")
    return joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), "k1", "k2",
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return prefix_trie(*rebuilt(table(spark, sf_dir, "conversations"))).drop("k1", "k2")


SQL = rf"""
WITH o AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list({{'r': r, 't': t}} ORDER BY turn NULLS FIRST, md5(strlen(r)::VARCHAR || ':' || r || t)) AS ts,
         xor(list_reduce([4294967295::BIGINT] || [ord(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')],
             lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0],
                 lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295) % {HEADS} AS h
  FROM o GROUP BY conv_id),
f AS (
  SELECT c.conv_id, coalesce(list_slice(b.ts, 1, c.h), []) || list_slice(c.ts, c.h + 1, len(c.ts)) AS ts
  FROM c LEFT JOIN c AS b ON b.conv_id = c.conv_id - c.conv_id % {GROUP}),
m AS (SELECT conv_id, d, list_slice(ts, 1, d) AS k, d = len(ts) AS last FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM f)),
n AS (
  SELECT k, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM m GROUP BY k),
e AS (SELECT list_slice(k, 1, d - 1) AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
w AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children,
         (n_convs - 1) * (CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(n.k[d].t, '{_WORD}')) END) AS saved
  FROM n LEFT JOIN e USING (k)),
s AS (
  SELECT list_slice(k, 1, j) AS k, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM w) GROUP BY 1)
SELECT w.conv_id, w.d AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
FROM w JOIN s USING (k) LEFT JOIN n AS p ON w.d > 0 AND p.k = list_slice(w.k, 1, w.d - 1)
"""

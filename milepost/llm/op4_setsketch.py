"""Near-duplicate documents by SetSketch registers.

Each document's set of word shingles is sketched into registers: the exponent, to base BASE, of the smallest of exponentially
distributed values over the set. Registers of a union are the larger ones, so sketches can be merged, and two sets agree in
a register with about their Jaccard similarity. Bands of registers propose pairs; a joint likelihood of the numbers of
larger, smaller and equal registers drops pairs that are clearly less similar; the rest is confirmed on the full sets.

Documents with equal sets are one node; nodes are numbered in the order of their smallest ids. In a band's bucket every node is first paired with the smallest one. The links found
give components. Only nodes of buckets that still hold several components are looked at again: their shingles are ordered by
rarity, and since a link leaves few shingles out, two linked nodes share one among the rarest of both. Pairs that share such
a shingle early enough, from different components, are verified as well; the smaller set of a pair is found by fewer of its
shingles than the larger, so that pages which share a template, but too little of it, are not all paired. A large group of copies thus costs a pair per copy,
not per pair of copies, and no link between components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from milepost.llm import vectors
from milepost.llm.common import free_name, lean, stored, table

#: A register is floor(1 - log(x, BASE)) of the smallest x, exponential with rate RATE, kept between 0 and LIMIT.
BASE, RATE, LIMIT = 1.02, 20.0, 65535
#: A pair that shares a register with probability 0.8 is missed by all bands with probability (1 - 0.8**ROWS)**BANDS < 1e-8.
BANDS, ROWS = 36, 4
REGISTERS = BANDS * ROWS
#: A pair goes unverified if the threshold is less likely than the best similarity by as many natural logarithms.
MARGIN = 14.0


@dataclass(frozen=True)
class Rule:
    """Shingles of `words` words; a link has 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has its whole sequence as one."""
    factors = vectors.constants(words, 11)
    for start, end in vectors.text_batches(texts):
        hashes, bounds = vectors.words_of(texts[start:end])
        for k in range(end - start):
            own = hashes[bounds[k] : bounds[k + 1]]
            if len(own) >= words:
                rolled = sum(own[j : len(own) - words + 1 + j] * factors[j] for j in range(words))
                yield np.unique(vectors.mix(rolled))
            elif len(own):
                yield vectors.mix((own * factors[: len(own)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(own)))
            else:
                yield own


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """uint16 registers, one row per set, none of which may be empty."""
    multipliers = vectors.constants(REGISTERS, 23)
    bounds = np.cumsum([0] + [len(s) for s in sets])
    joined, result = np.concatenate(sets), np.empty((len(sets), REGISTERS), np.uint64)
    for j in range(REGISTERS):
        result[:, j] = np.minimum.reduceat(joined * multipliers[j], bounds[:-1])
    uniform = (result.astype(np.float64) + 0.5) / 2.0**64
    smallest = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(smallest) / np.log(BASE)), 0, LIMIT).astype(np.uint16)


def log_likelihood(more: np.ndarray, less: np.ndarray, equal: np.ndarray, share: np.ndarray, similarity: np.ndarray) -> np.ndarray:
    """Of similarity J, given the numbers of registers larger, smaller and equal in the first set.

    share is the first set's size over the sum of both; J cannot exceed the ratio of the sizes.
    """

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = p(share - (1 - share) * similarity), p(1 - share - share * similarity)
    tiny = 1e-9
    return more * np.log(np.maximum(up, tiny)) + less * np.log(np.maximum(down, tiny)) + equal * np.log(np.maximum(1 - up - down, tiny))


def estimate(first: np.ndarray, second: np.ndarray, n1: np.ndarray, n2: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Most likely similarity of pairs of register rows, and whether the pair may reach the threshold."""
    counts = [(first > second).sum(1), (first < second).sum(1), (first == second).sum(1)]
    share = n1 / (n1 + n2)
    top = np.minimum(n1, n2) / np.maximum(n1, n2)
    grid = np.linspace(0, 1, 41)
    tried = np.stack([log_likelihood(*counts, share, g * top) for g in grid], 1)
    best = tried.argmax(1)
    at = log_likelihood(*counts, share, np.minimum(percent / 100, top))
    similarity = grid[best] * top
    possible = (top * 100 >= percent - 1e-9) & ((similarity * 100 >= percent) | (tried.max(1) - at <= MARGIN))
    return similarity, possible


def sketches(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, text_key, n_shingles, a 128-bit key of the set (two longs), and the registers as bytes (null for an empty set)."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(vectors.parts, batches)):
            sets = list(shingle_sets(batch.column("text").to_pylist(), rule.words))
            full = [s for s in sets if len(s)]
            rows = iter(registers(full) if full else ())
            keys = np.array([[s.sum(dtype=np.uint64), vectors.mix(s).sum(dtype=np.uint64)] for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(keys[:, 0]),
                    pa.array(keys[:, 1]),
                    pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "text_key", "n_shingles", "key1", "key2", "registers"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        lean(sketched), "doc_id long, text_key long, n_shingles long, key1 long, key2 long, registers binary"
    )


def numbered(rows: DataFrame) -> DataFrame:
    """Each different set of `rows` (sketches) with a number, node, and the document it is named by.

    That is the one of smallest id, then text_key; documents without an id come last. Nodes are numbered in the same order,
    so the smallest node of a component has its smallest id, also where one id stands on several texts.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "text_key")).alias("first")
    same = rows.where("n_shingles > 0").groupBy("key1", "key2", "n_shingles").agg(first, F.min("registers").alias("registers"))
    ordered = same.select("key1", "key2", "n_shingles", "first.*", "registers").orderBy("bare", "doc_id", "text_key", "key1", "key2")
    return ordered.withColumn("node", F.monotonically_increasing_id()).drop("bare")


def buckets(nodes: DataFrame) -> DataFrame:
    """node, bucket, its smallest node and its number of nodes, for the buckets that hold at least two nodes."""
    width = 2 * ROWS
    bands = F.array(*[F.xxhash64(F.lit(b), F.substring("registers", b * width + 1, width)) for b in range(BANDS)])
    rows = nodes.select("node", F.explode(bands).alias("bucket"))
    # Aggregated before the shuffle, and a bucket of very many nodes is split in the join.
    shared = rows.groupBy("bucket").agg(F.min("node").alias("low"), F.count("*").alias("held")).where("held > 1")
    return rows.join(shared, "bucket")


def sets_of(docs: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """node and its whole set as bytes, for the rows of `wanted`: node, doc_id and text_key of the document it is named by."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(vectors.parts, batches)):
            own = [s.tobytes() for s in shingle_sets(batch.column("text").to_pylist(), rule.words)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(own, pa.binary())], ["node", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_key"), "text")
    # Shuffled at every size, so that the plan and its cost do not change with the number of ids.
    is_named = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key"))
    chosen = texts.join(wanted.hint("merge"), is_named).select("node", "text")
    return chosen.mapInArrow(lean(whole), "node long, shingles binary").groupBy("node").agg(F.max("shingles").alias("shingles"))


def _both(pairs: DataFrame, facts: DataFrame, columns: list[str]) -> DataFrame:
    for side in "ab":
        own = facts.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])
        pairs = pairs.join(own, side)
    return pairs


def plausible(pairs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose registers do not rule out the threshold."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = [np.frombuffer(b"".join(batch.column(f"registers_{s}").to_pylist()), np.uint16).reshape(-1, REGISTERS) for s in "ab"]
                sizes = [batch.column(f"n_shingles_{s}").to_numpy() for s in "ab"]
                keep = pa.array(estimate(*rows, *sizes, rule.percent)[1])
                yield batch.select(["a", "b"]).filter(keep)

    sized = _both(pairs, nodes, ["n_shingles"])
    least, most = (f("n_shingles_a", "n_shingles_b") for f in (F.least, F.greatest))
    sized = sized.where(100 * least >= rule.percent * most)
    return _both(sized, nodes, ["registers"]).mapInArrow(lean(judged), "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that are links on their full sets."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("shingles_a"), batch.column("shingles_b"), strict=True):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * common >= rule.percent * (len(one) + len(two) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _both(pairs, sets, ["shingles"]).mapInArrow(lean(linked), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node and component (smallest node reachable) for every node with a link.

    Each round points every node at the smallest label among itself and its neighbours, and then at that node's own label,
    so the number of rounds grows with the logarithm of a component's width. Rounds are stored, not kept in memory.
    """
    edges = stored(links.union(links.select("b", "a")).distinct(), "edges")
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component"))
    labels = stored(labels, "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("node").alias("_node"), F.col("component").alias("_far"))
        step = step.join(jump, F.col("next") == F.col("_node"), "left")
        step = stored(step.select("node", F.least("next", "_far").alias("component"), F.col("component").alias("before")), "labels")
        moved = step.where("component <> before").limit(1).count()
        labels = step.select("node", "component")
        if not moved:
            return labels


def pending(found: DataFrame, labels: DataFrame) -> DataFrame:
    """node and component of the nodes in buckets that hold several components; the one pair of two nodes is already known."""
    rows = found.where("held > 2").select("node", "bucket").join(labels, "node", "left").select("node", "bucket", F.coalesce("component", "node").alias("component"))
    several = rows.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return rows.join(several.select("bucket"), "bucket", "left_semi").select("node", "component").distinct()


def shingle_rows(sets: DataFrame) -> DataFrame:
    """component, n (size of the set), node and shingle."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("component").to_pylist(), batch.column("node").to_pylist(), batch.column("shingles"), strict=True)
            for component, node, x in rows:
                own = np.frombuffer(x.as_buffer(), np.int64)
                facts = [pa.array(np.full(len(own), v, np.int64)) for v in (component, len(own), node)]
                yield pa.RecordBatch.from_arrays([*facts, pa.array(own)], ["component", "n", "node", "shingle"])

    return sets.mapInArrow(lean(listed), "component long, n long, node long, shingle long")


def remaining_pairs(open_sets: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of different components that may be links; open_sets: node, component, shingles.

    With 100 I >= p U, that is (100 + p) I >= p (n1 + n2), two sets whose first common shingle, in an order of all shingles,
    stands at i and j can have at most 1 + min(n1 - i, n2 - j) - 1 in common. The order is by rarity; a shingle of one node
    only stands in front and needs no row. The smaller set of a pair has 2 p n / (100 + p) in common with the other one at
    least, the larger one p n / 100; so a row that stands too late for the first bound is only met by rows of smaller sets.
    """
    p = rule.percent
    rows = shingle_rows(open_sets)
    known = rows.groupBy("shingle").agg(F.count("*").alias("df"), F.min("component").alias("low"), F.max("component").alias("high"))
    known = known.where("df > 1").select("shingle", "df", (F.col("low") < F.col("high")).alias("crosses"))
    ranked = rows.join(known, "shingle").groupBy("node", "component", "n").agg(F.array_sort(F.collect_list(F.struct("df", "shingle", "crosses"))).alias("own"))
    early = ranked.withColumn("alone", F.col("n") - F.size("own")).select(
        "node", "component", "n", "alone", F.posexplode_outer("own").alias("k", "x")
    )
    early = early.select("node", "component", "n", (F.col("alone") + F.col("k")).alias("at"), F.col("x.shingle").alias("shingle"), F.col("x.crosses").alias("crosses"))
    # The other set has p percent of this one's size at least.
    early = early.where(F.col("crosses") & (100 * (F.col("n") - F.col("at")) >= p * F.col("n"))).drop("crosses")
    names = ["node", "component", "n", "at"]
    # First is the smaller set of a pair, of equally large ones that of the smaller node.
    small = early.where((100 + p) * (F.col("n") - F.col("at")) >= 2 * p * F.col("n"))
    first, second = (df.select("shingle", *[F.col(c).alias(f"{c}{k}") for c in names]) for k, df in ((1, small), (2, early)))
    most = F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2"))
    fits = (100 + p) * most >= p * (F.col("n1") + F.col("n2"))
    smaller = (F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("node1") < F.col("node2")))
    pairs = first.join(second, "shingle").where(smaller & (F.col("component1") != F.col("component2")) & fits)
    return pairs.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()


def grouped(docs: DataFrame, rule: Rule) -> DataFrame:
    """One row per row of `docs`: doc_id, text_key, n_shingles, component_id, and `stays`.

    A row stays if its text has no words or if the component is named by its id and text.
    """
    rows = stored(sketches(docs, rule), "sketches")
    nodes = stored(numbered(rows), "nodes")
    found = stored(buckets(nodes), "buckets")
    stars = found.where("low < node").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    stars = stored(plausible(stars, nodes, rule), "stars")
    named = nodes.select("node", "doc_id", "text_key")
    sets = stored(sets_of(docs, named.join(found.select("node").distinct(), "node"), rule), "sets")
    links = stored(confirmed(stars, sets, rule), "links")
    labels = components(links)
    more = remaining_pairs(sets.join(pending(found, labels), "node"), rule)
    more = stored(plausible(more, nodes, rule), "more")
    added = stored(confirmed(more, sets, rule), "links")
    if added.limit(1).count():
        labels = components(links.union(added))
    keys = ["key1", "key2", "n_shingles"]
    members = nodes.select(*keys, "node").join(labels, "node", "left").select(*keys, F.coalesce("component", "node").alias("component"))
    heads = named.select(F.col("node").alias("component"), F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    full = rows.select("doc_id", "text_key", *keys).join(members.join(heads, "component"), keys, "left")
    bare = F.col("n_shingles") == 0
    is_head = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text_key").eqNullSafe(F.col("_key"))
    own = F.when(bare, F.col("doc_id")).otherwise(F.col("_id"))
    return full.select("doc_id", "text_key", "n_shingles", own.alias("component_id"), (bare | is_head).alias("stays"))


def near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id (smallest id reachable by links, its own included).

    A text without words links with nothing. Rows that share an id but differ in text are nodes of their own as far as
    their sets differ, yet their component is named by ids. A row without an id links as others do; a component without
    any id has a null one. Equal rows get equal results. Other columns than doc_id and text are not read.
    """
    return grouped(docs, rule).select("doc_id", "n_shingles", "component_id")


def without_copies(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of `docs`, all columns, that name their component: smallest id, then text_key; of equal ones one stays.

    Rows without words stay, unless another row is equal in id and text. Rows are told apart by id and text: a text goes
    or stays whatever happens to another text of its id.
    """
    found = stored(grouped(docs, rule), "components")
    id_name, key_name = free_name(docs, "_gone"), free_name(docs, "_gone_key")
    gone = found.where(~F.col("stays")).select(F.col("doc_id").alias(id_name), F.col("text_key").alias(key_name)).distinct()
    is_gone = docs["doc_id"].eqNullSafe(gone[id_name]) & (F.xxhash64(docs["text"]) == gone[key_name])
    left = docs.join(gone, is_gone, "left_anti")
    repeated = found.where("stays").groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count()
    return left.dropDuplicates(["doc_id", "text"]) if repeated else left


def op4_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), Rule(words=4))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

"""Exact top-k by inner product, with vectors in buckets of similar length.

Vectors are rounded to integers, sorted by length over the whole table and stored. Queries are taken in blocks of BLOCK_BYTES;
a block is broadcast and every task walks its part of the sorted vectors in buckets of BUCKET rows. What a query needs is a
score above its k-th best so far; divided by its own length and the bucket's greatest, that is the cosine it needs there.

- Above 1: the bucket holds nothing for the query.
- Otherwise the vectors long enough to reach the score at a cosine of 1 are its candidates (length pruning), or, where the
  bucket's sorted coordinates leave fewer, those whose value in the query's largest coordinate, and then in its second
  largest, allows that cosine (coordinate pruning). The choice is made for each query and bucket from these two numbers.
- Candidates are verified with their products, which are exact: integers, in doubles as long as they fit.

The longest vectors go first, alone, so that all other tasks start with a score to beat. A task sends at most k rows for each
query, and only those that reach that score.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from milepost.llm.common import shared_folder, stored, table, with_offsets

TOP = 5
EVERY = 50
SCALE = 256
#: Vectors of a bucket.
BUCKET = 4096
#: Bytes of the queries that are broadcast at a time, as doubles. Also bounds the products held at once.
BLOCK_BYTES = 1 << 24
#: Vectors that are tried first, for every block of queries.
FIRST = 4096
#: Tasks that choose the best of their share of all tasks' results, before the last choice.
PARTS = 64
#: Doubles hold integers up to here; longs hold scores up to LONG.
EXACT, LONG = float(1 << 53), float(1 << 62)
#: Room for rounding where bounds are compared with scores.
SLACK = 1e-9


def rounded(embedding: Column) -> Column:
    """floor(SCALE * x) of each component; null where the vector takes no part."""
    usable = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(usable, F.transform(embedding, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double"))))


def sorted_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, row (its number in the table), values and length of the vectors that take part, by length over all files."""
    values = vectors.select(F.col("vec_id").cast("long"), rounded(F.col("embedding")).alias("values")).where("values IS NOT NULL")
    squares = F.aggregate("values", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    found = values.withColumn("length", F.sqrt(squares))
    # Vectors alike in length are told apart by their id, so a length that very many share is no single range.
    order = [F.desc("length"), F.asc("vec_id")]
    found = found.repartitionByRange(*order).sortWithinPartitions(*order)
    # Numbers are fixed by the writing: a file is committed by one attempt of its task.
    return stored(found.withColumn("row", F.monotonically_increasing_id()), "vectors")


def query_blocks(queries: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """The queries in blocks of `limit` bytes of their values, at least one query each."""
    size = 8 * (F.size("values") + 8)
    sized = queries.select("*", F.lit(0).alias("all"), F.pmod("row", F.lit(256)).alias("bucket"), size.cast("long").alias("size"))
    placed = with_offsets(sized, "all", "bucket", [F.col("row")], F.col("size"), "offset").select(
        "vec_id", "row", "values", "length", F.floor(F.col("offset") / limit).alias("block")
    )
    placed = stored(placed, "queries", ["block"])
    for row in sorted(placed.select("block").distinct().collect()):
        yield placed.where(F.col("block") == row["block"]).drop("block").orderBy("row").toArrow()


def by_size(rows: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of components, places of the rows that have as many, and their values."""
    column = rows.column("values")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    sizes = np.diff(ends, prepend=0)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield size, at, flat[(ends[at] - size)[:, None] + np.arange(size)]


@dataclass
class Queries:
    """Queries with as many components, and the best candidates of each: score, candidate's id (null last), row."""

    place: np.ndarray
    row: np.ndarray
    values: np.ndarray
    length: np.ndarray
    bar: np.ndarray
    top: int

    def __post_init__(self) -> None:
        shape = (len(self.row), self.top)
        self.score = np.full(shape, np.iinfo(np.int64).min)
        self.missing, self.vec_id = np.ones(shape, bool), np.zeros(shape, np.int64)
        self.found = np.zeros(shape, bool)
        with np.errstate(invalid="ignore", divide="ignore"):
            unit = np.where(self.length[:, None] > 0, self.values / self.length[:, None], 0.0)
        two = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :2]
        self.focus, self.along = two, np.take_along_axis(unit, two, 1)

    def take(self, at: np.ndarray, score: np.ndarray, own: np.ndarray, bucket: Bucket, rows: np.ndarray) -> None:
        """Scores of the queries `at` with the bucket's `rows` (in the order of ids), entered if they are among the best.

        `own` marks the products of a query with itself.
        """
        usable = ~own & (score >= self.bar[at][:, None])
        if not usable.any():
            return
        wanted = min(self.top, score.shape[1])
        lowest = np.iinfo(np.int64).min
        ranked = np.where(usable, score, lowest)
        last = np.partition(ranked, -wanted, axis=1)[:, -wanted][:, None]
        above = usable & (ranked > last)
        equal = usable & (ranked == last)
        # Of equal scores the smallest ids, which come first.
        chosen = above | (equal & (np.cumsum(equal, axis=1) <= wanted - above.sum(1, keepdims=True)))
        q, c = np.nonzero(chosen)
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        shape = (len(at), self.top)
        parts = [np.full(shape, lowest), np.ones(shape, bool), np.zeros(shape, np.int64), np.zeros(shape, bool)]
        new = (score[q, c], bucket.missing[rows[c]], bucket.vec_id[rows[c]], np.ones(len(q), bool))
        for part, value in zip(parts, new, strict=True):
            part[q, rank] = value
        held = (self.score, self.missing, self.vec_id, self.found)
        both = [np.concatenate([old[at], part], 1) for old, part in zip(held, parts, strict=True)]
        # ~x falls as x rises, for all longs.
        order = np.lexsort((both[2], both[1], ~both[0], ~both[3]), axis=1)[:, : self.top]
        for old, part in zip(held, both, strict=True):
            old[at] = np.take_along_axis(part, order, 1)
        self.bar[at] = np.maximum(self.bar[at], np.where(self.found[at, -1], self.score[at, -1], lowest))


@dataclass
class Bucket:
    """Some vectors of similar length with as many components, in the order of their ids (null last)."""

    vec_id: np.ndarray
    missing: np.ndarray
    row: np.ndarray
    values: np.ndarray
    length: np.ndarray

    def __post_init__(self) -> None:
        self.longest = self.length.max()
        self._units: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def unit(self, coordinate: int) -> tuple[np.ndarray, np.ndarray]:
        """Values of one coordinate of the vectors at length 1, in order, and the vectors' places in that order."""
        if coordinate not in self._units:
            with np.errstate(invalid="ignore", divide="ignore"):
                unit = np.where(self.length > 0, self.values[:, coordinate] / self.length, 0.0)
            order = np.argsort(unit, kind="stable")
            self._units[coordinate] = unit[order], order
        return self._units[coordinate]


def product(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of rows of a with rows of b. Partial sums stay below the product of the lengths."""
    if exact:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def allowed(along: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a coordinate that a vector of length 1 can have at this cosine or more to one that has `along` there."""
    room = np.sqrt(np.maximum(1 - along**2, 0) * np.maximum(1 - cosine**2, 0))
    low = np.where(along <= -cosine, -1.0, along * cosine - room)
    high = np.where(along >= cosine, 1.0, along * cosine + room)
    return low - SLACK, high + SLACK


def search_bucket(queries: Queries, bucket: Bucket) -> None:
    """Enters the bucket's vectors where they are among a query's best."""
    exact = float(queries.length.max(initial=0)) * float(bucket.longest) < EXACT
    chunk = max(1, BLOCK_BYTES // (8 * len(bucket.row)))
    positive = queries.bar > 0
    with np.errstate(invalid="ignore", divide="ignore"):
        need = np.where(positive, queries.bar / queries.length, 0.0)  # the length needed at a cosine of 1
        cosine = np.where(positive, need / bucket.longest, -1.0)
    cosine = np.where(positive & ~np.isfinite(cosine), 2.0, cosine)
    alive = np.flatnonzero(cosine <= 1 + SLACK)
    long_enough = np.sort(bucket.length)
    by_length = len(bucket.row) - np.searchsorted(long_enough, need[alive] * (1 - SLACK))
    by_coordinate = np.full(len(alive), len(bucket.row))
    if queries.focus.shape[1]:
        low, high = allowed(queries.along[alive, 0], np.minimum(cosine[alive], 1.0))
        for coordinate in np.unique(queries.focus[alive, 0]).tolist():
            own = np.flatnonzero((queries.focus[alive, 0] == coordinate) & positive[alive])
            values, _ = bucket.unit(coordinate)
            by_coordinate[own] = np.searchsorted(values, high[own], "right") - np.searchsorted(values, low[own])
    # Reading a list and verifying its vectors one query at a time costs more for each than a product of many queries.
    listed = 4 * by_coordinate < by_length
    for at in np.flatnonzero(listed).tolist():
        q = alive[at : at + 1]
        values, order = bucket.unit(int(queries.focus[q[0], 0]))
        rows = order[np.searchsorted(values, low[at]) : np.searchsorted(values, high[at], "right")]
        if queries.focus.shape[1] > 1:
            second = int(queries.focus[q[0], 1])
            low2, high2 = allowed(queries.along[q, 1], np.minimum(cosine[q], 1.0))
            with np.errstate(invalid="ignore", divide="ignore"):
                unit = np.where(bucket.length[rows] > 0, bucket.values[rows, second] / bucket.length[rows], 0.0)
            rows = rows[(unit >= low2) & (unit <= high2)]
        rows = np.sort(rows[bucket.length[rows] >= need[q] * (1 - SLACK)])
        if len(rows):
            score = product(queries.values[q], bucket.values[rows], exact)
            queries.take(q, score, queries.row[q][:, None] == bucket.row[rows], bucket, rows)
    whole = alive[~listed]
    whole = whole[np.argsort(-need[whole], kind="stable")]
    for start in range(0, len(whole), chunk):
        q = np.sort(whole[start : start + chunk])
        rows = np.flatnonzero(bucket.length >= need[q].min() * (1 - SLACK))
        if len(rows):
            score = product(queries.values[q], bucket.values[rows], exact)
            queries.take(q, score, queries.row[q][:, None] == bucket.row[rows], bucket, rows)


def buckets(batch: pa.RecordBatch) -> Iterator[tuple[int, Bucket]]:
    """Number of components and bucket, for runs of at most BUCKET rows whose length does not rise."""
    for size, at, values in by_size(batch):
        length = batch.column("length").to_numpy()[at]
        ids = batch.column("vec_id").take(pa.array(at))
        missing, vec_id = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        row = batch.column("row").to_numpy()[at]
        # Where the length rises another file begins.
        cuts = [0, *(np.flatnonzero(np.diff(length) > 0) + 1).tolist(), len(at)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            for first in range(start, end, BUCKET):
                part = np.arange(first, min(end, first + BUCKET))
                part = part[np.lexsort((row[part], vec_id[part], missing[part]))]
                yield size, Bucket(vec_id[part], missing[part], row[part], values[part], length[part])


def best_candidates(vectors: DataFrame, block: pa.Table, bars: np.ndarray, top: int) -> DataFrame:
    """place (of the query in the block), vec_id, row and score of the best candidates of each task, at `bars` or above."""
    spread = vectors.sparkSession.sparkContext.broadcast((block, bars))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, start = spread.value
        groups = {
            size: Queries(at, rows.column("row").to_numpy()[at], values, rows.column("length").to_numpy()[at], start[at].copy(), top)
            for size, at, values in by_size(rows)
        }
        for batch in batches:
            for size, bucket in buckets(batch):
                if size in groups:
                    search_bucket(groups[size], bucket)
        for group in groups.values():
            q, k = np.nonzero(group.found)
            ids = pa.array(group.vec_id[q, k], pa.int64(), mask=group.missing[q, k])
            yield pa.RecordBatch.from_arrays([pa.array(group.place[q]), ids, pa.array(group.score[q, k])], ["place", "vec_id", "score"])

    return vectors.mapInArrow(searched, "place long, vec_id long, score long")


def best_of(rows: DataFrame, top: int) -> DataFrame:
    """The `top` best rows of each place, with their rank; the tasks' results are first reduced in PARTS shares."""
    order = [F.desc("score"), F.asc_nulls_last("vec_id")]
    rows = rows.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    for keys in (["place", "part"], ["place"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return rows.drop("part")


def search(vectors: DataFrame, is_query: Column, top: int = TOP, limit: int = BLOCK_BYTES, first: int = FIRST) -> DataFrame:
    """query_id, rank, vec_id and score: the `top` rows of greatest inner product for each row that `is_query` holds for.

    Vectors that are null, or have a null, NaN or infinite component, take no part. Vectors are compared with those of as many
    components; a vector without components has score 0 with its like. Rows that share a vec_id, or a vector, are rows of their
    own: each is a query if the condition holds, and a candidate for all others. A row without an id is a candidate, ranked
    after rows of equal score, and a query if the condition holds for null. An empty table, or one without queries, gives no
    rows. Scores that no long could hold (lengths of 2**31 after rounding) are refused. Other columns are not read.
    """
    spark = vectors.sparkSession
    known = sorted_vectors(vectors)
    longest = known.agg(F.max("length")).first()[0]
    if longest is not None and longest * longest >= LONG:
        raise ValueError("vectors too long: their inner products do not fit a long")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    folder = f"{shared_folder(spark)}/topk-{uuid.uuid4().hex[:12]}"
    blocks = 0
    # The longest ones: the same few rows for every block of queries.
    ahead = stored(known.orderBy(F.desc("length"), "row").limit(first), "longest")
    for block in query_blocks(known.where(is_query), limit):
        lowest = np.iinfo(np.int64).min
        bars = np.full(block.num_rows, lowest)
        for r in best_of(best_candidates(ahead, block, bars.copy(), top), top).where(F.col("rank") == top).collect():
            bars[r["place"]] = r["score"]
        ids = pa.table({"place": np.arange(block.num_rows), "query_id": block.column("vec_id")})
        found = best_of(best_candidates(known, block, bars, top), top)
        found = found.join(F.broadcast(spark.createDataFrame(ids)), "place").select("query_id", "rank", "vec_id", "score")
        found.write.parquet(f"{folder}/block={blocks}")
        blocks += 1
    if not blocks:
        return empty
    return spark.read.schema(empty.schema).parquet(*[f"{folder}/block={k}" for k in range(blocks)])


def op12_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every fiftieth vector."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS xs
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, v.vec_id,
         coalesce(list_sum([q.xs[i] * v.xs[i] FOR i IN range(1, len(q.xs) + 1)]), 0)::BIGINT AS score
  FROM v AS q JOIN v ON q.r <> v.r AND len(q.xs) = len(v.xs)
  WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank, vec_id, score
FROM s
QUALIFY rank <= {TOP}
"""

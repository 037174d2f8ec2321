"""Sliding sentence spans: every run of SPAN consecutive sentences is hashed, and every shorter run that is long in words; the
hashes meet in one global aggregation, and each sentence covered by a repeated run that is not the run's first occurrence is
removed.

A run's rows are combined before the shuffle, so a run that very many documents share costs one row per task. Only runs
found more than once are joined back, and positions of a document to remove are gathered per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from milepost.llm.common import table

#: Consecutive sentences in a run.
SPAN = 3
#: A run needs as many words; shorter ones ("Yes. No. Yes.") are no passages.
MIN_WORDS = 8
#: Runs of fewer sentences need as many, so that a repeated passage of some length is found however few sentences it has.
LONG_WORDS = 25
#: A sentence ends after these and white space, or at a line's end.
BOUNDARY = r"(?<=[.!?])[\x20\x09-\x0D]+|\n+"


def sentences(text: Column) -> Column:
    """Sentences without outer white space; text without any, or null, has none."""
    return F.filter(
        F.transform(F.split(F.coalesce(text, F.lit("")), BOUNDARY), lambda s: F.regexp_replace(s, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")),
        lambda s: s != "",
    )


def split_documents(docs: DataFrame) -> DataFrame:
    """doc_id, key (of id and text: rows alike in both are one document), and the array `sentences`."""
    return docs.select(
        "doc_id", F.xxhash64("doc_id", "text").alias("key"), sentences(F.col("text")).alias("sentences")
    )


def runs(split: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """doc_id, key, start (0-based), length (sentences) and two hashes, h1 and h2, of every run.

    Runs are `span` sentences of `min_words` words or more, or fewer sentences of `long_words` or more. A document of fewer
    sentences is one run of `min_words` or more.
    """
    n = F.size("sentences")

    def hashed(seed: int) -> Column:
        return F.transform("sentences", lambda s: F.xxhash64(F.lit(seed), s)).alias(f"s{seed}")

    split = split.select(
        "doc_id",
        "key",
        F.transform("sentences", lambda s: F.size(F.split(s, r"[\x20\x09-\x0D]+"))).alias("sizes"),
        hashed(1),
        hashed(2),
        n.alias("n"),
    )

    # Element by element: slice() in a lambda would copy the whole array for each position.
    def run(i: Column, length: int) -> Column:
        words = sum((F.get("sizes", i + k) for k in range(1, length)), F.get("sizes", i))
        enough = F.when((F.lit(length) == span) | (F.col("n") == length), F.lit(min_words)).otherwise(F.lit(long_words))
        hashes = [F.xxhash64(F.lit(length), *[F.get(f"s{seed}", i + k) for k in range(length)]).alias(f"h{seed}") for seed in (1, 2)]
        found = F.struct(i.alias("start"), F.lit(length).alias("length"), *hashes)
        return F.when((i + length <= F.col("n")) & (words >= enough), found)

    all_runs = F.flatten(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.array(*[run(i, k) for k in range(span, 0, -1)])))
    found = F.when(F.col("n") > 0, F.filter(all_runs, lambda r: r.isNotNull()))
    # The outer form, as for the inner one Spark would test the array's size on the scan, where it is computed anew.
    rows = split.select("doc_id", "key", F.explode_outer(found).alias("run")).where("run IS NOT NULL")
    return rows.select("doc_id", "key", "run.*")


def repeated_positions(split: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """doc_id, key and the sorted positions of the sentences to remove.

    A run's first occurrence is the one with the smallest (doc_id, key, start); a null doc_id comes first. Runs are told apart
    by 128 bits.
    """
    rows = runs(split, span, min_words, long_words)
    place = F.struct("doc_id", "key", "start")
    firsts = (
        rows.groupBy("h1", "h2")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where(~F.col("first").eqNullSafe(F.col("last")))
        .select("h1", "h2", "first")
    )
    later = rows.join(firsts, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    found = later.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "length")).alias("runs"))
    covered = F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1)))
    return found.select("doc_id", "key", F.array_sort(F.array_distinct(covered)).alias("positions"))


def remove_repeats(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """One row per row of `docs`: doc_id, n_sentences, removed (positions), kept_text (remaining sentences, one a line).

    Rows alike in doc_id and text are one document and get the same result; rows that share an id and differ in text, or have
    no id, are documents of their own. An empty or null text has no sentences.
    """
    split = split_documents(docs)
    found = repeated_positions(split, span, min_words, long_words).withColumnsRenamed({"doc_id": "_doc_id", "key": "_key"})
    joined = split.join(found, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")), "left")
    joined = joined.withColumn("removed", F.coalesce("positions", F.array().cast("array<int>")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("sentences") - 1), F.col("removed"))
    kept = F.when(F.size("sentences") > 0, F.transform(kept, lambda i: F.get("sentences", i)))
    return joined.select(
        "doc_id",
        F.size("sentences").cast("long").alias("n_sentences"),
        "removed",
        F.coalesce(F.array_join(kept, "\n"), F.lit("")).alias("kept_text"),
    )


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the sentences that repeat an earlier passage removed."""
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_sentences",
        F.size("removed").cast("long").alias("n_removed"),
        F.array_join("removed", ",").alias("removed"),
        F.sha2("kept_text", 256).alias("kept_sha256"),
        (F.size("removed") > 0).alias("has_repeat"),
    )


SQL = rf"""
WITH d AS (
  SELECT doc_id, [s FOR s IN
      [regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') FOR x IN
       regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])[\x20\x09-\x0D]+|\n+', '\1' || chr(1), 'g'), chr(1))]
      IF s <> ''] AS ss
  FROM documents),
r AS (
  SELECT doc_id, i - 1 AS start, j, list_slice(ss, i, i + j - 1) AS run
  FROM (SELECT doc_id, ss, j, unnest(range(1, greatest(len(ss) - j + 1, 0) + 1)) AS i
        FROM d, (SELECT unnest(range(1, {SPAN} + 1)) AS j))),
p AS (
  SELECT r.*, row_number() OVER (PARTITION BY run ORDER BY doc_id, start) AS k FROM r JOIN d USING (doc_id)
  WHERE len(regexp_split_to_array(array_to_string(run, ' '), '[\x20\x09-\x0D]+'))
        >= CASE WHEN j = {SPAN} OR j = len(ss) THEN {MIN_WORDS} ELSE {LONG_WORDS} END),
c AS (SELECT DISTINCT doc_id, unnest(range(start, start + j)) AS pos FROM p WHERE k > 1),
g AS (SELECT doc_id, list(pos ORDER BY pos) AS removed FROM c GROUP BY doc_id),
f AS (
  SELECT doc_id, ss, coalesce(removed, []) AS removed,
         [ss[i + 1] FOR i IN range(0, len(ss)) IF NOT list_contains(coalesce(removed, []), i)] AS kept
  FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, len(ss)::BIGINT AS n_sentences, len(removed)::BIGINT AS n_removed, array_to_string(removed, ',') AS removed,
       sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256, len(removed) > 0 AS has_repeat
FROM f
"""

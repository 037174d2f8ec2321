"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive words that ignores some of them, so a text whose words were exchanged here and there
still shares seeds with the original. Seeds of all documents meet those of the benchmark in one join; each hit names an
alignment of an item with a document, which is verified word by word: the best stretch, +1 for an equal word and -PENALTY for
another, must reach a score. All of it is DataFrame expressions; words are compared as 64-bit hashes.

An item shorter than the masks has one seed, of all its words; documents get seeds of as many words only for the lengths
that such items have.

The benchmark's seeds are broadcast while they are few, which is counted; otherwise the join shuffles both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from milepost.llm.common import free_name, table

#: Masks of one length; words at 0 are ignored.
MASKS = ("1110110111", "1101111011", "1111001111")
SPAN = len(MASKS[0])
#: What an unequal word costs, and the score to reach: the smaller of MIN_SCORE and MIN_SHARE percent of the item's words.
PENALTY, MIN_SCORE, MIN_SHARE = 2, 12, 60
#: Seeds of the benchmark, about 50 bytes each, up to which they are broadcast.
BROADCAST_SEEDS = 100_000

NOT_WORD = r"[^\p{L}\p{N}]+"


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased runs of letters and digits."""
    return F.transform(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), ""), lambda w: F.xxhash64(w))


def _seeds_of(words: str, mask: str) -> Column:
    """Hashes of the words under the mask on each of its places; there must be one."""
    # Element by element: slice() in a lambda would copy the whole array for each position.
    used = [k for k, c in enumerate(mask) if c == "1"]
    places = F.sequence(F.lit(0), F.size(words) - len(mask))
    return F.transform(places, lambda i: F.xxhash64(F.lit(mask), *[F.get(words, i + k) for k in used]))


def seeds(words: str, short: list[int]) -> Column:
    """Hashes of all seeds of an array column: those of the first mask by position, then of the second, and so on.

    Those of all words in a run follow, for each length in `short`.
    """
    long = F.when(F.size(words) >= SPAN, F.concat(*[_seeds_of(words, mask) for mask in MASKS]))
    if not short:
        return long
    none = F.array().cast("array<bigint>")
    whole = [F.when(F.size(words) >= n, _seeds_of(words, "1" * n)).otherwise(none) for n in short]
    return F.concat(F.coalesce(long, none), *whole)


def short_lengths(items: DataFrame) -> list[int]:
    """The numbers of words, in order, of items that are shorter than the masks."""
    found = items.select(F.size("words").alias("n")).where(F.col("n").between(1, SPAN - 1)).distinct().collect()
    return sorted(r["n"] for r in found)


def _exploded(df: DataFrame, short: list[int]) -> DataFrame:
    """One row a seed: the frame's columns, `seed` and `at`, the 0-based position of its first word."""
    rows = df.withColumn("seeds", seeds("words", short))
    # The outer form, as for the inner one Spark would test the array's size on the scan, where it is computed anew.
    rows = rows.select(*df.columns, F.posexplode_outer("seeds").alias("k", "seed")).where("seed IS NOT NULL")
    if not short:
        return rows.withColumn("at", F.expr(f"k % (size(words) - {SPAN - 1})")).drop("k")
    places = F.greatest(F.size("words") - (SPAN - 1), F.lit(0))
    ahead = len(MASKS) * places
    at = F.when(F.col("k") < ahead, F.col("k") % F.greatest(places, F.lit(1)))
    for n in short:
        places = F.greatest(F.size("words") - (n - 1), F.lit(0))
        at, ahead = at.when(F.col("k") < ahead + places, F.col("k") - ahead), ahead + places
    return rows.withColumn("at", at).drop("k")


def beside(words: str, shift: Column, size: Column) -> Column:
    """The words of the document beside an item of `size` words whose first lies on position `shift` (0-based)."""
    first = F.greatest(F.lit(0), -shift)
    return F.slice(words, F.greatest(shift, F.lit(0)) + 1, size - first)


def best_stretch(item: str, window: str, shift: Column) -> Column:
    """Score of the best stretch of the item's words and those beside it."""
    here = F.slice(item, F.greatest(F.lit(0), -shift) + 1, F.size(item))
    equal = F.zip_with(here, window, lambda a, b: F.coalesce(a == b, F.lit(False)))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(state: Column, same: Column) -> Column:
        now = F.greatest(F.lit(0), state["now"] + F.when(same, 1).otherwise(-PENALTY))
        return F.struct(now.alias("now"), F.greatest(state["best"], now).alias("best"))

    return F.aggregate(equal, start, step, lambda state: state["best"])


def alignments(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, key, item_id, shift and the window beside the item, once for each alignment that some seed names.

    docs: doc_id, key and words; items: item_id and words.
    """
    places = ["doc_id", "key", "item_id", "shift"]
    short = short_lengths(items)
    # A short item has one seed, of all its words, and not those of shorter items.
    known = _exploded(items.where(F.size("words") >= SPAN), [])
    for n in short:
        known = known.union(_exploded(items.where(F.size("words") == n), [n]))
    known = known.select("item_id", F.size("words").alias("n"), "seed", F.col("at").alias("item_at"))
    window = beside("words", F.col("shift"), F.col("n"))
    if known.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS:
        hits = _exploded(docs, short).join(F.broadcast(known), "seed").withColumn("shift", F.col("at") - F.col("item_at"))
        # As an aggregate, the window keeps the scoring out of the join, which would not be compiled with it.
        return hits.groupBy(*places).agg(F.max(window).alias("window"))
    slim = _exploded(docs, short).select("doc_id", "key", "seed", "at")
    hits = slim.join(known, "seed").withColumn("shift", F.col("at") - F.col("item_at")).select(*places, "n").distinct()
    texts = docs.select("key", "words").dropDuplicates(["key"])
    return hits.join(texts, "key").select(*places, window.alias("window"))


def _document(docs: DataFrame) -> Column:
    """Tells apart texts that share an id, or have none."""
    return F.xxhash64(docs["doc_id"], docs["text"])


def _scored(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, key, item_id, score and shift of each alignment that reaches the score; `key` is that of _document."""
    items = benchmark.select("item_id", F.col("text").alias("item_text")).distinct()
    items = items.select("item_id", word_hashes(F.col("item_text")).alias("words"))
    rows = docs.select("doc_id", _document(docs).alias("key"), word_hashes(docs["text"]).alias("words"))
    named = items.select(F.col("item_id").alias("_item"), F.col("words").alias("item"))
    hits = alignments(rows, items).join(named, F.col("item_id").eqNullSafe(F.col("_item")))
    hits = hits.withColumn("score", best_stretch("item", "window", F.col("shift")))
    return hits.where((F.col("score") >= MIN_SCORE) | (100 * F.col("score") >= MIN_SHARE * F.size("item")))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, shift (word of the document on which the item's first one lies) of each contaminated pair.

    A pair has one row, with its best score and, of several such places, the first. Items of fewer than SPAN words are
    found where all their words stand in a row; longer ones in documents of SPAN words or more. Empty or null texts take part
    in no pair. Rows alike in doc_id and text are one document. Only doc_id, item_id and the texts are read.
    """
    best = _scored(docs, benchmark).groupBy("doc_id", "item_id")
    best = best.agg(F.max(F.struct("score", (-F.col("shift")).alias("back"))).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.score").cast("long").alias("score"), (-F.col("best.back")).cast("long").alias("shift"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, that overlap no benchmark item.

    A text goes or stays for its own words only: other texts of its id, or others without an id, do not matter.
    """
    name, key = free_name(docs, "_bad"), free_name(docs, "_bad_key")
    bad = _scored(docs, benchmark).select(F.col("doc_id").alias(name), F.col("key").alias(key)).distinct()
    same = docs["doc_id"].eqNullSafe(bad[name]) & (_document(docs) == bad[key])
    return docs.join(bad, same, "left_anti")


def op6_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it contains, exactly or with words exchanged."""
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _mask_key(mask: str, words: str) -> str:
    return f"'{mask}' || '/' || " + " || '/' || ".join(f"{words}[i + {k}]" for k, c in enumerate(mask) if c == "1")


SQL = rf"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w
  FROM documents),
b AS (
  SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w
  FROM benchmark),
ds AS (
  SELECT doc_id, i - 1 AS at, unnest([{", ".join(_mask_key(m, "w") for m in MASKS)}]) AS seed
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {SPAN - 2})) AS i FROM d WHERE len(w) >= {SPAN})),
bs AS (
  SELECT item_id, w AS item, i - 1 AS at, unnest([{", ".join(_mask_key(m, "w") for m in MASKS)}]) AS seed
  FROM (SELECT item_id, w, unnest(range(1, len(w) - {SPAN - 2})) AS i FROM b WHERE len(w) >= {SPAN})),
h AS (SELECT DISTINCT doc_id, item_id, item, ds.at - bs.at AS shift FROM ds JOIN bs USING (seed)),
e AS (
  SELECT doc_id, item_id, shift, len(item) AS n, k, CASE WHEN item[k] = w[k + shift] THEN 1 ELSE -{PENALTY} END AS v
  FROM (SELECT h.*, d.w, unnest(range(1, len(item) + 1)) AS k FROM h JOIN d USING (doc_id))
  WHERE k + shift BETWEEN 1 AND len(w)),
p AS (SELECT *, sum(v) OVER (PARTITION BY doc_id, item_id, shift ORDER BY k) AS s FROM e),
m AS (
  SELECT *, s - least(0, coalesce(min(s) OVER (PARTITION BY doc_id, item_id, shift ORDER BY k
                                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS best FROM p),
f AS (SELECT doc_id, item_id, shift, n, greatest(0, max(best)) AS score FROM m GROUP BY ALL),
g AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY score DESC, shift) AS r FROM f
  WHERE score >= {MIN_SCORE} OR 100 * score >= {MIN_SHARE} * n)
SELECT doc_id, item_id, score::BIGINT AS score, shift::BIGINT AS shift FROM g WHERE r = 1
"""

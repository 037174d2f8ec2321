"""Toxicity by a factorization machine over hashed terms.

Besides a weight per term the machine learns a short vector per term; the product of two vectors is what the pair adds
when both terms occur, so an insult next to the mention of a group can count more than the sum of the two.

It is fitted on a bounded sample of labelled rows: up to SAMPLE documents of each label, those of smallest hash. Terms
whose share differs most between the labels get a slot in the machine. Its bias is shifted from the sample's share of
toxic documents to that of all labelled rows. Every whole text is scored in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from milepost.llm import vectors
from milepost.llm.common import held_out, table

#: Most labelled documents of each label that the machine is fitted on.
SAMPLE = 4000
#: A document with more distinct terms is scored but not used for fitting.
SAMPLE_TERMS = 20_000
#: Terms are hashed to so many buckets; so many of these get a weight and a vector of FACTORS numbers.
BUCKETS, SLOTS, FACTORS = 1 << 20, 1024, 4
#: A term must occur in as many different documents of the sample, and its shares must differ by as many standard errors.
MIN_DOCS, MIN_Z = 5, 4.0
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.1, 1.0
#: Score from which a document is predicted toxic.
THRESHOLD = 0.3


@dataclass(frozen=True)
class Machine:
    """slot_of maps a bucket to its slot or -1; weights and factors are by slot."""

    slot_of: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, docs: np.ndarray, slots: np.ndarray, n: int) -> np.ndarray:
        """Probability for each of n documents, given its distinct slots."""
        sums = np.stack([np.bincount(docs, self.factors[slots, f], n) for f in range(self.factors.shape[1])], 1)
        squares = np.bincount(docs, (self.factors[slots] ** 2).sum(1), n)
        raw = self.bias + np.bincount(docs, self.weights[slots], n) + 0.5 * ((sums**2).sum(1) - squares)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def buckets_of(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (text numbers, term buckets) over parts of the texts."""
    for numbers, hashes in vectors.word_hashes(texts, vectors.TERMS):
        yield numbers, (hashes % np.uint64(BUCKETS)).astype(np.int64)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, labels = batch.column("text").to_pylist(), batch.column("toxic")
        for start, end in vectors.text_batches(texts):
            parts = list(buckets_of(texts[start:end]))
            keys = np.unique(np.concatenate([n * BUCKETS + b for n, b in parts]))
            bounds = np.searchsorted(keys, np.arange(end - start + 1) * BUCKETS)
            terms = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(keys % BUCKETS, pa.int32()))
            yield pa.RecordBatch.from_arrays([terms, labels.slice(start, end - start)], ["terms", "toxic"])


def sample_labels(labels: DataFrame, size: int = SAMPLE) -> tuple[DataFrame, float]:
    """Up to `size` labelled ids of either label that may be learnt from, and the share of label 1 among all such rows.

    A null label is none; a document labelled twice is toxic if either says so.
    """
    known = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    return known.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).drop("rank"), share


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Machine:
    sample, share = sample_labels(labels.select("doc_id", "toxic"), size)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")
    rows = (
        texts.mapInArrow(_terms, "terms array<int>, toxic int").where(F.size("terms") <= SAMPLE_TERMS).limit(3 * size)
    ).toPandas()
    # Copies count once, else their words would look typical; sorted, as the order of arrival differs between runs.
    different = sorted({(np.asarray(t, np.int32).tobytes(), int(y)) for t, y in zip(rows["terms"], rows["toxic"], strict=True)})
    terms = [np.frombuffer(t, np.int32).astype(np.int64) for t, _ in different]
    return train(terms, np.array([y for _, y in different], np.float64), share)


def choose_slots(terms: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """bucket -> slot for the terms whose shares of toxic and other documents differ most, by the two-sample z value."""
    counts = [
        np.bincount(np.concatenate([t for t, v in zip(terms, y, strict=True) if v == c] or [np.zeros(0, np.int64)]), minlength=BUCKETS)
        for c in (0, 1)
    ]
    n0, n1 = max(1, (y == 0).sum()), max(1, (y == 1).sum())
    both = (counts[0] + counts[1]) / (n0 + n1)
    spread = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n0 + 1 / n1))
    z = np.where(counts[0] + counts[1] >= MIN_DOCS, np.abs(counts[1] / n1 - counts[0] / n0) / spread, 0)
    best = np.argsort(-z, kind="stable")[:SLOTS]
    best = np.sort(best[z[best] >= MIN_Z])
    slot_of = np.full(BUCKETS, -1, np.int32)
    slot_of[best] = np.arange(len(best))
    return slot_of


def train(terms: list[np.ndarray], y: np.ndarray, share: float) -> Machine:
    """Stochastic gradient with AdaGrad steps. One label only gives a machine that answers the share throughout."""
    share = min(max(share, 1e-4), 1 - 1e-4)
    prior = np.log(share / (1 - share))
    if not (0 < y.sum() < len(y)):
        return Machine(np.full(BUCKETS, -1, np.int32), float(prior), np.zeros(1), np.zeros((1, FACTORS)))
    slot_of = choose_slots(terms, y)
    rows = [s[s >= 0] for s in (slot_of[t] for t in terms)]
    rng = np.random.default_rng(0)
    slots = int(slot_of.max()) + 1 or 1
    bias, w, v = 0.0, np.zeros(slots), rng.normal(0, 0.01, (slots, FACTORS))
    gb, gw, gv = 1e-8, np.full(slots, 1e-8), np.full((slots, FACTORS), 1e-8)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            sizes = [len(rows[k]) for k in chosen]
            s, d = np.concatenate([rows[k] for k in chosen]), np.repeat(np.arange(len(chosen)), sizes)
            sums = np.stack([np.bincount(d, v[s, f], len(chosen)) for f in range(FACTORS)], 1)
            squares = np.bincount(d, (v[s] ** 2).sum(1), len(chosen))
            raw = bias + np.bincount(d, w[s], len(chosen)) + 0.5 * ((sums**2).sum(1) - squares)
            g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[chosen]) / len(chosen)
            dw = np.bincount(s, g[d], slots) + DECAY * w / len(order)
            pull = g[d][:, None] * (sums[d] - v[s])
            dv = np.stack([np.bincount(s, pull[:, f], slots) for f in range(FACTORS)], 1) + DECAY * v / len(order)
            gb, gw, gv = gb + g.sum() ** 2, gw + dw**2, gv + dv**2
            bias, w, v = bias - RATE * g.sum() / gb**0.5, w - RATE * dw / gw**0.5, v - RATE * dv / gv**0.5
    there = y.mean()
    return Machine(slot_of, float(bias - np.log(there / (1 - there)) + prior), w, v)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every row; a null or empty text is scored by the bias. Other columns are not read."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            keys = [np.zeros(0, np.int64)]
            for numbers, buckets in buckets_of(texts):
                slots = m.slot_of[buckets]
                keys.append(np.unique(numbers[slots >= 0] * SLOTS + slots[slots >= 0]))
            found = np.unique(np.concatenate(keys))
            result = m.scores(found // SLOTS, found % SLOTS, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(result)], ["doc_id", "score"])

    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )

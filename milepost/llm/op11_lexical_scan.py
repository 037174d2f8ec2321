"""Ranked lexical search without an index: an Aho-Corasick automaton of all item terms is run over the documents' texts.

Texts are reduced to terms with one guard byte between them, and each term stands in the automaton between two guards, so a
match is a whole term. Two passes read the texts. The first counts, for the whole table, the documents of each term, the
documents with any term, and all terms; the second counts the terms again, scores each document for the items that the
matched terms belong to, and keeps the best of each task. Nothing is stored between the passes.

Items are taken in blocks of BLOCK_BYTES of term bytes (one larger item is a block of its own), so the automaton that is
broadcast is bounded however many items there are; each block is two more passes over the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from milepost.llm import vectors
from milepost.llm.common import table, with_offsets

TOP = 10
#: Term bytes of the items of a block, a term counted once for each item. Bounds what is broadcast.
BLOCK_BYTES = 1 << 20
#: Scores (documents x items) and entries (matched terms x their items) that are held at once.
CELLS = 1 << 21
#: Tasks that choose the best of their share of all tasks' results, before the last choice.
PARTS = 64
#: Everything that ends a term is one guard byte, and A-Z become a-z.
GUARD = b" "
_FOLD = bytes(32 if vectors.TERMS[0][c] else c + 32 if 65 <= c <= 90 else c for c in range(256))
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The contract's numbers: 100 - 90 + 90 n N / L, and 10^9 tf / (1000 tf + 8 m).
_SCALE, _TF, _LENGTH = 1_000_000_000, 1000, 8


@dataclass(frozen=True)
class Block:
    """Terms of some items. Term t belongs to the items owners[starts[t]:starts[t + 1]], given by their place in `items`."""

    items: list[int | None]
    terms: list[bytes]
    starts: np.ndarray
    owners: np.ndarray
    _automaton: list = field(default_factory=list, compare=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_automaton": []}

    def automaton(self) -> ahocorasick.Automaton:
        """Built once for each worker. Bytes are taken as the 256 first code points."""
        if not self._automaton:
            found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for number, term in enumerate(self.terms):
                found.add_word((GUARD + term + GUARD).decode("latin-1"), number)
            found.make_automaton()
            self._automaton.append(found)
        return self._automaton[0]


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and distinct `term`. Rows that share an id, or have none, are one item with the terms of all its texts."""
    folded = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    return items.select(F.col("item_id").cast("long"), F.explode(F.regexp_extract_all(folded, F.lit(_TERM), 0)).alias("term")).distinct()


def blocks(items: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The items' terms, a block at a time. Items without a term are in none."""
    sizes = (
        item_terms(items)
        .groupBy("item_id")
        .agg(F.sum(F.octet_length("term") + 2).alias("size"), F.collect_list("term").alias("terms"))
        .select("*", F.lit(0).alias("all"), F.pmod(F.xxhash64("item_id"), F.lit(256)).alias("bucket"))
    )
    placed = with_offsets(sizes, "all", "bucket", [F.col("item_id")], F.col("size"), "offset")
    placed = placed.select("item_id", "terms", F.floor(F.col("offset") / limit).alias("block"))
    for row in sorted(placed.select("block").distinct().collect()):
        own = placed.where(F.col("block") == row["block"]).select("item_id", "terms").collect()
        own.sort(key=lambda r: (r["item_id"] is None, r["item_id"]))
        owners: dict[bytes, list[int]] = {}
        for place, r in enumerate(own):
            for term in r["terms"]:
                owners.setdefault(term.encode(), []).append(place)
        yield Block(
            [r["item_id"] for r in own],
            list(owners),
            np.cumsum([0, *map(len, owners.values())]),
            np.concatenate([np.asarray(x) for x in owners.values()]),
        )


def scan(texts: list[bytes | None], block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and tf of each distinct pair, in this order, and the number of all terms of each document.

    Texts are joined and cut again at guards, so that what is held follows CHUNK, not the longest text.
    """
    automaton, counts = block.automaton(), np.zeros(len(texts), np.int64)
    pairs, tfs = np.zeros(0, np.int64), np.zeros(0, np.int64)
    pieces, owners, size = [], [], 0

    def take() -> None:
        nonlocal pairs, tfs
        joined = GUARD + GUARD.join(pieces) + GUARD
        ends = np.cumsum([len(p) + 1 for p in pieces])
        owner = np.asarray(owners)
        guard = np.frombuffer(joined, np.uint8) == GUARD[0]
        first = np.flatnonzero(guard[:-1] & ~guard[1:])
        np.add.at(counts, owner[np.searchsorted(ends, first, "right")], 1)
        hits = np.fromiter(automaton.iter(joined.decode("latin-1")), np.dtype([("end", np.int64), ("term", np.int64)]))
        if len(hits):
            document = owner[np.searchsorted(ends, hits["end"] - 1, "right")]
            new, n = np.unique(document * len(block.terms) + hits["term"], return_counts=True)
            both, where = np.unique(np.concatenate([pairs, new]), return_inverse=True)
            tfs = np.bincount(where, np.concatenate([tfs, n]), len(both)).astype(np.int64)
            pairs = both

    for number, text in enumerate(texts):
        folded = (text or b"").translate(_FOLD)
        at = 0
        while at < len(folded):
            cut = len(folded) if len(folded) - at <= vectors.CHUNK else folded.find(GUARD, at + vectors.CHUNK)
            cut = len(folded) if cut < 0 else cut
            pieces.append(folded[at:cut])
            owners.append(number)
            size += cut - at + 1
            at = cut
            if size > vectors.CHUNK:
                take()
                pieces, owners, size = [], [], 0
    if pieces:
        take()
    return pairs // len(block.terms), pairs % len(block.terms), tfs, counts


def slices(texts: list[bytes | None], items: int) -> Iterator[slice]:
    """Texts of about CHUNK bytes in all, and no more than CELLS scores."""
    rows = max(1, CELLS // max(items, 1))
    for start, end in vectors.text_batches(texts, vectors.CHUNK):
        for at in range(start, end, rows):
            yield slice(at, min(end, at + rows))


@dataclass(frozen=True)
class Statistics:
    """Documents with a term, all their terms, and for each term of a block the documents that hold it."""

    documents: int
    terms: int
    df: list[int]

    def weights(self) -> np.ndarray:
        return np.asarray([math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1))) for df in self.df], np.int64)

    def lengths(self, counts: np.ndarray) -> np.ndarray:
        """m of documents with these many terms. In Python's integers, as 90 n N may not fit 64 bits."""
        return np.asarray([100 - 90 + 90 * n * self.documents // max(self.terms, 1) for n in counts.tolist()], np.int64)


def statistics(texts: DataFrame, block: Block) -> Statistics:
    """First pass. Each task sends one row for each term it met."""
    spread = texts.sparkSession.sparkContext.broadcast(block)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(spread.value.terms) + 2, np.int64)
        for batch in batches:
            whole = batch.column("text").to_pylist()
            for part in slices(whole, len(spread.value.items)):
                _, term, _, counts = scan(whole[part], spread.value)
                df[2:] += np.bincount(term, minlength=len(df) - 2)
                df[:2] += np.count_nonzero(counts), counts.sum()
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(df[met])], ["place", "n"])

    found = dict.fromkeys(range(len(block.terms) + 2), 0)
    rows = texts.select("text").mapInArrow(counted, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    found.update({r["place"]: r["n"] for r in rows.collect()})
    spread.destroy()
    return Statistics(found[0], found[1], [found[k] for k in range(2, len(found))])


def _first(item: np.ndarray, score: np.ndarray, missing: np.ndarray, doc_id: np.ndarray, top: int) -> np.ndarray:
    """Places of the `top` best rows of each item: by score, then id, those without an id last."""
    order = np.lexsort((doc_id, missing, -score, item))
    sorted_items = item[order]
    begin = np.flatnonzero(np.r_[True, sorted_items[1:] != sorted_items[:-1]][: len(order)])
    rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.r_[begin, len(order)]))
    return order[rank < top]


def scores(docs: int, items: int, found: tuple[np.ndarray, ...], block: Block, weights: np.ndarray, stats: Statistics) -> np.ndarray:
    """Score of each document for each item."""
    document, term, tf, counts = found
    share = weights[term] * (_SCALE * tf // (_TF * tf + _LENGTH * stats.lengths(counts)[document]))
    wide = np.diff(block.starts)[term]
    out = np.zeros(docs * items, np.int64)
    cuts = np.unique(np.searchsorted(np.cumsum(wide), np.arange(0, wide.sum(), CELLS)))
    for start, end in zip(cuts, np.append(cuts[1:], len(term)), strict=False):
        n = wide[start:end]
        # One entry for each item of each pair: the owners of a pair's term stand in a row.
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item = block.owners[np.repeat(block.starts[term[start:end]], n) + inside]
        np.add.at(out, np.repeat(document[start:end], n) * items + item, np.repeat(share[start:end], n))
    return out.reshape(docs, items)


def best_documents(docs: DataFrame, block: Block, stats: Statistics, top: int = TOP) -> DataFrame:
    """Second pass: item_id, doc_id and score of the best documents of each task, for each item."""
    spread = docs.sparkSession.sparkContext.broadcast((block, stats))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = spread.value
        weights, items = known.weights(), len(own.items)
        best = [np.zeros(0, kind) for kind in (np.int64, np.int64, bool, np.int64)]
        bar = np.ones(items, np.int64)
        for batch in batches:
            whole, ids = batch.column("text").to_pylist(), batch.column("doc_id")
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            number = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for part in slices(whole, items):
                texts = whole[part]
                table = scores(len(texts), items, scan(texts, own), own, weights, known)
                row, item = np.nonzero(table >= bar)
                new = (item, table[row, item], missing[part][row], number[part][row])
                best = [np.concatenate(pair) for pair in zip(best, new, strict=True)]
                kept = _first(*best, top)
                best = [column[kept] for column in best]
                # An item with `top` documents takes no lower score; an equal one may have a smaller id.
                full = np.bincount(best[0], minlength=items) >= top
                lowest = np.full(items, np.iinfo(np.int64).max)
                np.minimum.at(lowest, best[0], best[1])
                bar = np.where(full, lowest, 1)
        ids = pa.array([own.items[place] for place in best[0]], pa.int64())
        columns = [ids, pa.array(best[3], pa.int64(), mask=best[2]), pa.array(best[1])]
        yield pa.RecordBatch.from_arrays(columns, ["item_id", "doc_id", "score"])

    return docs.mapInArrow(ranked, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, limit: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the `top` best documents of each item, of those with a score above 0.

    Every row of `docs` is a document of its own, also where ids or whole rows repeat; a row without an id is ranked after
    rows of equal score that have one. A null or empty text, like one of separators only, has no term: as a document it
    counts nowhere and has score 0, as an item it gets no row. Items that share an id are one item, also those without one.
    Without documents or without items there are no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    found = spark.createDataFrame([], "item_id long, doc_id long, score long, part int")
    for block in blocks(items, limit):
        best = best_documents(texts, block, statistics(texts, block), top)
        found = found.unionByName(best.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS))))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for keys in (["item_id", "part"], ["item_id"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return found.select("item_id", "rank", "doc_id", "score")


def op11_lexical_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}') AS terms FROM documents),
t AS (SELECT k, doc_id, unnest(terms) AS term, len(terms) AS n FROM d),
tf AS (SELECT k, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM t GROUP BY k, term),
total AS (SELECT count(DISTINCT k) AS docs, count(*) AS terms FROM t),
df AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, docs),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM benchmark),
s AS (
  SELECT item_id, k, any_value(doc_id) AS doc_id,
         sum(w * (({_SCALE} * tf) // ({_TF} * tf + {_LENGTH} * (100 - 90 + (90 * n * docs) // total.terms))))::BIGINT AS score
  FROM i JOIN tf USING (term) JOIN df USING (term), total GROUP BY item_id, k)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
FROM s WHERE score > 0
QUALIFY rank <= {TOP}
"""

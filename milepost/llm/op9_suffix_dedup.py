"""Removal of repeated byte strings by two-stage suffix sorting.

Every byte covered by a string of LENGTH bytes that also starts earlier is removed. Only places that can repeat are sorted:

1. A window of LENGTH bytes is owned by the short gram in it with the smallest hash. Equal windows have equal owners, so a
   window repeats only if its owner does. Each document sends one row per owner, with a hash of the stretch that holds all
   its windows. Rows alike in one batch are settled there, so a stretch that very many documents share costs a row a batch.
2. Rows meet by the owner's hash. Of those with the same stretch all but the first repeat. Where stretches differ, their
   first occurrences go on with their bytes.
3. These stretches are joined into one string per task and sorted in two stages: suffixes smaller than their successors
   are sorted directly, all others follow from them in one scan of the buckets of first bytes. Neighbours with a common
   prefix of LENGTH form classes, of which all but the first member repeat.

A gram with more than GROUP different stretches leaves the third step: its windows' hashes, 128 bits each, are aggregated by
Spark instead. Equal stretches of the second step have equal hashes of owner and stretch, 64 bits each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from milepost.llm import vectors
from milepost.llm.common import stored, table

LENGTH, GRAM = 100, 24
#: Grams in a window.
SPAN = LENGTH - GRAM + 1
#: Bytes of a document that are hashed at once, and bytes of stretches that are sorted at once.
CHUNK, SORTED = 1 << 18, 1 << 20
#: Different stretches of one gram up to which a task sorts them.
GROUP = 20_000
#: The place of a row without an id: before all others.
NO_ID = -(2**63)
#: What tells documents apart, and their order.
DOCUMENT = ["place", "copy"]


def rolling(data: np.ndarray, length: int, values: np.ndarray = vectors.BYTES) -> np.ndarray:
    """64-bit hashes of all substrings of a length; `values` are the numbers that stand for the 256 bytes."""
    up, down = vectors.powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[data] * up[: len(data)])])
    return vectors.mix((sums[length:] - sums[:-length]) * down[: len(data) - length + 1])


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


def owners(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run of windows of one owner: its first window, number of windows, the owner's place and hash."""
    parts: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(data) - LENGTH + 1, CHUNK):
        part = data[at : at + CHUNK + LENGTH - 1]
        hashes = rolling(part, GRAM)
        place = np.arange(len(hashes), dtype=np.uint64)
        low = np.uint64((1 << 20) - 1)
        own = (sliding_minimum((hashes & ~low) | place, SPAN) & low).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        counts = np.diff(np.append(starts, len(own)))
        parts.append((starts + at, counts, own[starts] + at, hashes[own[starts]].view(np.int64)))
    if not parts:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _stretch_hashes(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Hash of the bytes that a run's windows cover and of the owner's place in them."""
    ends = starts + counts + LENGTH - 1
    up, down = vectors.powers(CHUNK + 4 * LENGTH)
    out = np.empty(len(starts), np.uint64)
    chunk = starts // CHUNK
    for c in np.unique(chunk):
        rows, at = chunk == c, int(c) * CHUNK
        part = data[at : at + CHUNK + 3 * LENGTH]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(vectors.BYTES2[part] * up[: len(part)])])
        out[rows] = (sums[ends[rows] - at] - sums[starts[rows] - at]) * down[starts[rows] - at]
    return vectors.mix(out ^ vectors.mix((counts * 256 + places - starts).astype(np.uint64))).view(np.int64)


def documents_of(docs: DataFrame) -> DataFrame:
    """doc_id, text, place (the id) and copy: a hash of the text if any id stands on different texts, else 0."""
    kind = F.xxhash64("text")
    rows = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("place"), kind.alias("copy"))
    shared = rows.groupBy("place").agg(F.min("copy").alias("low"), F.max("copy").alias("high")).where("low < high")
    return rows if shared.limit(1).count() else rows.withColumn("copy", F.lit(0).cast("long"))


# start, count (up to SPAN) and owner's distance from the start in one long
def _packed(starts: np.ndarray, counts: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (starts << 16) | (counts << 8) | (places - starts)


def stretches(docs: DataFrame) -> DataFrame:
    """place, copy, part, stretch and meta of each run of windows; part is the owner's hash, or any number in settled rows.

    place and copy are those of `documents_of`. A settled row repeats another of its batch that comes before it, and is dealt by its document.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, kinds = batch.column("text").to_pylist(), np.asarray(batch.column("place")), np.asarray(batch.column("copy"))
            for first, last in vectors.text_batches(texts, 4 << 20):
                found = []
                for k in range(first, last):
                    data = _bytes(texts[k])
                    starts, counts, places, hashes = owners(data)
                    if len(starts):
                        own = np.full(len(starts), ids[k]), np.full(len(starts), kinds[k])
                        found.append((*own, hashes, _stretch_hashes(data, starts, counts, places), _packed(starts, counts, places)))
                if not found:
                    continue
                place, copy, part, stretch, meta = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((meta, copy, place, stretch, part))
                place, copy, part, stretch, meta = place[order], copy[order], part[order], stretch[order], meta[order]
                same = np.concatenate([[False], (part[1:] == part[:-1]) & (stretch[1:] == stretch[:-1])])
                # A repeated row is the same place and repeats nothing.
                twice = (place[1:] == place[:-1]) & (copy[1:] == copy[:-1]) & (meta[1:] == meta[:-1])
                keep = ~(np.concatenate([[False], twice]) & same)
                dealt = np.where(same, place * 31 + copy + (meta >> 24), part)
                columns = [x[keep] for x in (place, copy, dealt, stretch, meta, same)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["place", "copy", "part", "stretch", "meta", "settled"])

    return docs.select(*DOCUMENT, "text").mapInArrow(listed, "place long, copy long, part long, stretch long, meta long, settled boolean")


def met(rows: DataFrame) -> DataFrame:
    """place, copy, part, meta and `later`: rows that repeat an earlier one (true), or that have others to be compared with (false)."""
    dealt = rows.repartition("part")
    group = Window.partitionBy("settled", "part")
    same = Window.partitionBy("settled", "part", "stretch").orderBy(*DOCUMENT, "meta")
    whole = F.struct(*DOCUMENT, "meta")
    marked = dealt.select("*", F.row_number().over(same).alias("nth"), F.first(whole).over(same).alias("first"))
    is_first = F.col("first") == whole
    several = F.min("stretch").over(group) != F.max("stretch").over(group)
    marked = marked.withColumn("several", several).withColumn("later", F.col("settled") | ~is_first)
    return marked.where(F.col("later") | (F.col("several") & (F.col("nth") == 1))).select(*DOCUMENT, "part", "meta", "later")


def with_bytes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """part, place, copy, start, count and bytes of the wanted stretches (place, copy, part, meta)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ids = (batch.column(c).to_pylist() for c in DOCUMENT)
            for place, copy, text, found in zip(*ids, batch.column("text"), batch.column("found"), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                for x in found.as_py():
                    start, count = x["meta"] >> 16, (x["meta"] >> 8) & 255
                    rows.append((x["part"], place, copy, start, count, data[start : start + count + LENGTH - 1]))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64()] * 5 + [pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["part", "place", "copy", "start", "count", "bytes"])

    lists = wanted.groupBy(*DOCUMENT).agg(F.collect_list(F.struct("part", "meta")).alias("found")).hint("merge")
    texts = docs.select(*DOCUMENT, "text").join(lists, DOCUMENT)
    return texts.mapInArrow(cut, "part long, place long, copy long, start long, count long, bytes binary")


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of a byte string in the order of their first `depth` bytes, in two stages."""
    n = len(text)
    change = np.sign(np.diff(text.astype(np.int16)))
    turns = np.flatnonzero(change)
    following = np.searchsorted(turns, np.arange(n - 1))
    smaller = np.zeros(n, bool)  # than its successor; the last suffix is not smaller than the empty one
    known = following < len(turns)
    smaller[:-1][known] = change[turns[following[known]]] > 0
    direct = _direct_sort(text, np.flatnonzero(smaller), depth)
    heads = text[direct]
    bounds = np.searchsorted(heads, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    buckets = []
    for c in range(256):
        front = np.concatenate([np.zeros(0, np.int64), *waiting[c]])
        own = []
        while len(front):
            own.append(front)
            before = front[front > 0] - 1
            front = before[(text[before] == c)]
        bucket = np.concatenate([np.zeros(0, np.int64), *own, direct[bounds[c] : bounds[c + 1]]])
        if len(bucket):
            buckets.append(bucket)
            before = bucket[bucket > 0] - 1
            before = before[text[before] > c]
            values = text[before]
            order = np.argsort(values, kind="stable")
            ends = np.flatnonzero(np.diff(values[order])) + 1
            for part in np.split(before[order], ends):
                if len(part):
                    waiting[text[part[0]]].append(part)
    return np.concatenate(buckets)


def _words(text: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes at each place as one number, first byte highest; zeros follow the text."""
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    words = np.zeros(len(text) + depth + 8, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | padded[k : k + len(words)]
    return words


def _direct_sort(text: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes at `places` by their first `depth` bytes: sorted by eight bytes, then ties by the next eight."""
    words = _words(text, depth)
    order = places[np.argsort(words[places], kind="stable")]
    group = np.cumsum(np.concatenate([[0], words[order][1:] != words[order][:-1]])) if len(order) else order
    for at in range(8, depth, 8):
        sizes = np.bincount(group) if len(group) else group
        tied = np.flatnonzero(sizes[group] > 1) if len(group) else group
        if not len(tied):
            break
        word = words[order[tied] + at]
        sub = np.lexsort((word, group[tied]))
        order[tied], word = order[tied][sub], word[sub]
        split = np.zeros(len(group), np.int64)
        split[tied[1:]] = (word[1:] != word[:-1]) & (group[tied][1:] == group[tied][:-1])
        border = np.concatenate([[0], np.diff(group) != 0]).astype(np.int64)
        group = np.cumsum(border | split)
    return order


def repeated_windows(rows: list[tuple[int, int, int, int, bytes]]) -> list[tuple[int, int, int, int]]:
    """(place, copy, start, end) of the bytes in windows that also occur earlier; rows: place, copy, start, count of windows, bytes."""
    text = np.frombuffer(b"\0".join(x[4] for x in rows) + b"\0", np.uint8)
    lengths = np.array([len(x[4]) + 1 for x in rows])
    heads = np.cumsum(lengths) - lengths
    places, copies, starts, counts = (np.array([x[k] for x in rows], np.int64) for k in range(4))
    owner = np.repeat(np.arange(len(rows)), lengths)
    offset = np.arange(len(text)) - heads[owner]
    is_window = offset < counts[owner]
    order = suffix_array(text, LENGTH)
    order = order[is_window[order]]
    words, equal = _words(text, LENGTH), np.ones(len(order) - 1, bool)
    for at in [*range(0, LENGTH - 8, 8), LENGTH - 8]:  # adjacent common prefixes, up to LENGTH
        live = np.flatnonzero(equal)
        equal[live] = words[order[live] + at] == words[order[live + 1] + at]
    classes = np.concatenate([[0], np.cumsum(~equal)])
    place, copy, start = places[owner[order]], copies[owner[order]], starts[owner[order]] + offset[order]
    sort = np.lexsort((start, copy, place, classes))
    order, classes, place, copy, start = order[sort], classes[sort], place[sort], copy[sort], start[sort]
    heads_of = np.concatenate([[True], classes[1:] != classes[:-1]])
    first = np.maximum.accumulate(np.where(heads_of, np.arange(len(order)), 0))
    repeats = (place != place[first]) | (copy != copy[first]) | (start != start[first])
    found = np.sort(order[repeats])
    runs = np.flatnonzero(np.concatenate([[True], np.diff(found) != 1])) if len(found) else found
    ends = np.append(runs[1:], len(found)) - 1 if len(found) else found
    a, b = found[runs], found[ends]
    begin, end = starts[owner[a]] + offset[a], starts[owner[b]] + offset[b] + LENGTH
    return list(zip(*(x.tolist() for x in (places[owner[a]], copies[owner[a]], begin, end)), strict=True))


SORT_SCHEMA = "place long, copy long, start long, end long, window long, window2 long"
SORT_NAMES = ["place", "copy", "start", "end", "window", "window2"]


def sort_groups(contexts: DataFrame) -> DataFrame:
    """Ranges to remove (window null); of very large groups instead each window with its two hashes, to be compared by Spark."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ranges(rows: list[tuple]) -> pa.RecordBatch:
            found = repeated_windows(rows)
            columns = list(zip(*found, strict=True)) or [()] * 4
            arrays = [pa.array(c, pa.int64()) for c in columns]
            return pa.RecordBatch.from_arrays([*arrays, *[pa.nulls(len(found), pa.int64())] * 2], SORT_NAMES)

        def windows(rows: list[tuple]) -> pa.RecordBatch:
            place, copy = (np.repeat([x[k] for x in rows], [x[3] for x in rows]) for k in (0, 1))
            start = np.concatenate([np.arange(x[2], x[2] + x[3]) for x in rows])
            one, two = (
                np.concatenate([rolling(np.frombuffer(x[4], np.uint8), LENGTH, values)[: x[3]] for x in rows]).view(np.int64)
                for values in (vectors.BYTES, vectors.BYTES2)
            )
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (place, copy, start, start + LENGTH, one, two)], SORT_NAMES)

        held: list[tuple] = []  # of whole groups
        group: list[tuple] = []
        size, part, large = 0, None, False
        for batch in batches:
            values = (batch.column(c).to_pylist() for c in ("part", *DOCUMENT, "start", "count", "bytes"))
            for own, *row in zip(*values, strict=True):
                if own != part:
                    if large and group:
                        yield windows(group)
                    elif group:
                        held += group
                        size += sum(len(x[4]) for x in group)
                    group, part, large = [], own, False
                    if size > SORTED:
                        yield ranges(held)
                        held, size = [], 0
                group.append(tuple(row))
                if len(group) >= GROUP:
                    yield windows(group)
                    group, large = [], True
        if large and group:
            yield windows(group)
        elif group:
            held += group
        if held:
            yield ranges(held)

    return contexts.repartition("part").sortWithinPartitions("part").mapInArrow(spans, SORT_SCHEMA)


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """place, copy, start and end of ranges of bytes to remove; docs: place, copy and text."""
    known = stored(met(stretches(docs)), "stretches")
    start, count = F.shiftright("meta", 16), F.shiftright("meta", 8).bitwiseAND(F.lit(255))
    later = known.where("later").select(*DOCUMENT, start.alias("start"), (start + count + LENGTH - 1).alias("end"))
    sorted_ = stored(sort_groups(with_bytes(docs, known.where("NOT later"))), "ranges")
    windows = sorted_.where("window IS NOT NULL")
    at, both = F.struct(*DOCUMENT, "start"), ["window", "window2"]
    firsts = windows.groupBy(*both).agg(F.min(at).alias("first"))
    repeats = windows.join(firsts, both).where(at != F.col("first"))
    columns = [*DOCUMENT, "start", "end"]
    return later.unionByName(sorted_.where("window IS NULL").select(columns)).unionByName(repeats.select(columns))


def remaining(data: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left without the ranges, and the number of maximal runs removed. Ranges beyond the end are cut."""
    out, at, runs, end = [], 0, 0, -1
    for a, b in sorted(ranges):
        if a >= len(data):
            break
        if a > end:
            runs += 1
            out.append(data[at:a])
        end = max(end, min(b, len(data)))
        at = max(at, end)
    out.append(data[at:])
    return b"".join(out), runs


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans and `kept`, the bytes that are left.

    A null text is empty. Rows equal in id and text are one document and get equal results. Different texts of one id, or
    without an id, are documents of their own, in the order of a hash of their texts. Other columns are not read.
    """
    rows = documents_of(docs)
    lists = repeated_ranges(rows).groupBy(*DOCUMENT).agg(F.collect_set(F.struct("start", "end")).alias("ranges")).hint("merge")
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, ranges in zip(batch.column("text"), batch.column("ranges"), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                left, runs = remaining(data, [(x["start"], x["end"]) for x in ranges.as_py() or ()])
                out.append((len(data), len(data) - len(left), runs, left))
            columns = list(zip(*out, strict=True)) or [()] * 4
            types = [pa.int64()] * 3 + [pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = rows.join(lists, DOCUMENT, "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

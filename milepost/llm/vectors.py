"""Word hashes of many texts at once, as numpy arrays.

Words are runs of bytes other than ASCII white space, or, as TERMS, runs of ASCII letters, digits and other bytes over 127.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at once; a longer text is cut at white space, so memory does not grow with the text but with its longest word.
CHUNK = 1 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
WHITE = b" \t\n\v\f\r"
_WHITE = re.compile(rb"[\x20\x09-\x0D]")


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit integers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * MULTIPLIER + np.uint64(seed)) | np.uint64(1)


def _tables(breaks: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes end words, and a value for each byte, alike for A-Z and a-z, 0 for those that end words."""
    ends = np.zeros(256, bool)
    ends[list(breaks)] = True
    values = constants(256, 77)
    values[ends] = 0
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return ends, values


#: Two independent values for each byte as it is.
BYTES, BYTES2 = constants(256, 131), constants(256, 177)
WORDS = _tables(WHITE)
TERMS = _tables(bytes(c for c in range(128) if not chr(c).isalnum()))
Tables = tuple[np.ndarray, np.ndarray]
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        base = 0x27D4EB2F165667C5
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def pieces(texts: Iterable[str | None]) -> Iterator[tuple[int, bytes]]:
    """Parts of the texts, cut only at white space, with the text's number."""
    for k, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        at = 0
        while len(data) - at > CHUNK:
            cut = _WHITE.search(data, at + CHUNK)
            if not cut:
                break
            yield k, data[at : cut.start()]
            at = cut.start()
        yield k, data[at:]


def _hash_joined(data: bytes, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and where they start."""
    b = np.frombuffer(data, np.uint8)
    white = tables[0][b]
    starts = np.flatnonzero(white[:-1] & ~white[1:]) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    up, down = powers(len(b))
    return mix(np.add.reduceat(tables[1][b] * up, starts) * down[starts]), starts


def word_hashes(texts: list[str | None], tables: Tables = WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (text numbers, hashes), one entry a word in order, A-Z lower-cased; each pair covers at least one whole piece."""

    def done() -> tuple[np.ndarray, np.ndarray]:
        hashes, starts = _hash_joined(b"\n" + b"\n".join(held), tables)
        ends = np.cumsum([len(x) + 1 for x in held])
        return np.asarray(numbers)[np.searchsorted(ends, starts, "right")] if len(starts) else np.zeros(0, int), hashes

    held, numbers, size = [], [], 0
    for k, piece in pieces(texts):
        if held and size + len(piece) > CHUNK:
            yield done()
            held, numbers, size = [], [], 0
        held.append(piece)
        numbers.append(k)
        size += len(piece)
    if held:
        yield done()


def text_batches(texts: list[str | None], limit: int = 4 * CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` characters, at least one text each."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        if k > start and size + len(text or "") > limit:
            yield start, k
            start, size = k, 0
        size += len(text or "")
    if texts:
        yield start, len(texts)


def parts(batch: pa.RecordBatch, limit: int = 4 * CHUNK) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, cut where their texts (column `text`) exceed about `limit` bytes, at least one row each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start, spent = 0, 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(ends, spent + limit, "right")))
        yield batch.slice(start, end - start)
        start, spent = end, int(ends[end - 1])


def words_of(texts: list[str | None], tables: Tables = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """All word hashes of the texts and the bounds of each text in them (one more than texts)."""
    parts = list(word_hashes(texts, tables))
    numbers = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, int)
    hashes = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.uint64)
    return hashes, np.searchsorted(numbers, np.arange(len(texts) + 1))

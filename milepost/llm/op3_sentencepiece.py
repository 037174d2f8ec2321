"""SentencePiece encoding and decoding by a streaming Viterbi search.

A text is cut into the pieces of the vocabulary with the largest product of probabilities. The search goes forward one
character at a time; an automaton of all pieces names those that end there. Only the sums of the last boundaries are kept for
them, a few times as many as the longest piece has characters. The paths that survive all pass through one boundary some way
back; ids up to it are final and are given out. Behind the window a boundary that is not final yet takes one byte, the length
of the piece before it.

Between two characters that no piece holds side by side every path has a boundary. White space nearly always begins such a
place: the stretch up to it is final there and does not depend on what comes next, so each worker remembers the ids of the
stretches it has met. Remembering changes no ids.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from milepost.llm.common import kept, lean, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Log probabilities are whole numbers of this many to one, so that their sums are exact in any length of text.
UNIT = 1_000_000
#: A character that no piece covers is spelt as bytes; it costs so much more than the worst piece.
PENALTY = 10 * UNIT
#: A worker remembers the stretches met last, between one and two times so many, none longer than so many characters.
MEMORY, MEMORY_CHARS = 400_000, 48


def log_probabilities(scores: dict[str, float]) -> dict[str, int]:
    """Log probability of each piece by Zipf's law: the r-th best score has a share of 1/r.

    The scores of a merge vocabulary are no log probabilities but the order of its merges, the most frequent first. Equal
    scores go by the piece.
    """
    share = math.log(sum(1 / r for r in range(1, len(scores) + 1))) if scores else 0.0
    best_first = sorted(scores, key=lambda piece: (-scores[piece], piece))
    return {piece: -round(UNIT * (math.log(r) + share)) for r, piece in enumerate(best_first, 1)}


@dataclass(frozen=True)
class Vocabulary:
    """ids and scores of the ordinary pieces, ids of the 256 byte pieces, and the bytes that each id stands for."""

    pieces: dict[str, tuple[int, int]]
    byte_ids: tuple[int, ...]
    spelling: tuple[bytes, ...]
    #: The longest piece's length, the score of a character that no piece covers, and a digest of pieces and scores.
    longest: int
    unknown: int
    digest: int

    @staticmethod
    def load(path: str = MODEL) -> Vocabulary:
        """Reads a model's pieces and the order of their scores; the search itself is ours."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, scores, byte_ids, spelling = {}, {}, {}, []
        for i in range(model.get_piece_size()):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(text[3:5], 16)] = i
                spelling.append(bytes([int(text[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                spelling.append(b"")
            else:
                ids[text], scores[text] = i, model.get_score(i)
                spelling.append(text.replace(SPACE, " ").encode())
        shares = log_probabilities(scores)
        return Vocabulary.of({p: (ids[p], shares[p]) for p in ids}, [byte_ids[b] for b in range(256)], spelling)

    @staticmethod
    def of(pieces: dict[str, tuple[int, int]], byte_ids: list[int], spelling: list[bytes]) -> Vocabulary:
        unknown = min((s for _, s in pieces.values()), default=0) - PENALTY
        digest = zlib.crc32(repr(sorted(pieces.items())).encode())
        return Vocabulary(pieces, tuple(byte_ids), tuple(spelling), max(map(len, pieces), default=1), unknown, digest)

    def automaton(self) -> ahocorasick.Automaton:
        """Names, for each character of a text, the pieces that end there by length and score, the longest first."""
        found = ahocorasick.Automaton()
        for piece, (_, score) in self.pieces.items():
            found.add_word(piece, (len(piece), score))
        found.make_automaton()
        return found

    def stretches_stand_alone(self) -> bool:
        """Whether no piece has the space mark after another character, or a line end beside any."""
        return not any(re.search(f"[^{SPACE}]{SPACE}|\n.|.\n", p, re.DOTALL) for p in self.pieces)


def _bytes_of(char: str, v: Vocabulary) -> list[int]:
    return [v.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]


class Stream:
    """The search on one text, spaces already replaced by the space mark. Ties go to the piece that begins first."""

    def __init__(self, text: str, v: Vocabulary, automaton: ahocorasick.Automaton, every: int | None = None):
        self.text, self.v, self.automaton = text, v, automaton
        #: After so many characters the surviving paths are followed back.
        self.every = every or 4 * v.longest
        #: Sums of the best paths to the last boundaries.
        self.sums = [0]
        #: Length of the last piece of the best path to each boundary after `done`, 0 for a character spelt as bytes.
        self.lengths, self.done = bytearray(), 0

    def _ids(self, upto: int) -> list[int]:
        """Makes the best path to a boundary final."""
        own, at, text, pieces = [], upto, self.text, self.v.pieces
        while at > self.done:
            size = self.lengths[at - self.done - 1]
            if size:
                own.append(pieces[text[at - size : at]][0])
            else:
                own.extend(reversed(_bytes_of(text[at - 1], self.v)))
            at -= size or 1
        del self.lengths[: upto - self.done]
        self.done = upto
        return own[::-1]

    def _common(self) -> int:
        """The last boundary of all paths that a further piece can go on from."""
        at = self.done + len(self.lengths)
        alive = list(range(max(self.done, at - self.v.longest + 1), at + 1))
        while len(alive) > 1 and alive[-1] > self.done:
            last = alive.pop()
            before = last - (self.lengths[last - self.done - 1] or 1)
            if before not in alive:
                alive.append(before)
                alive.sort()
        return alive[0]

    def ids(self) -> Iterator[int]:
        """Ids as they become final."""
        sums, lengths, unknown, longest = self.sums, self.lengths, self.v.unknown, self.v.longest
        at, first, trim, check, top = 0, 0, self.every, self.every, 0
        n = len(self.text)
        end_of_text = [(n - 1, (1, unknown))] if n else []
        for end, (size, score) in chain(self.automaton.iter(self.text), end_of_text):
            while at <= end:
                if at >= trim:
                    if at >= check:
                        yield from self._ids(self._common())
                        check = at + max(self.every, len(lengths))
                    del sums[:-longest]
                    first, trim = at + 1 - len(sums), at + self.every
                top += unknown  # spelt as bytes, until a piece does better
                sums.append(top)
                lengths.append(0)
                at += 1
            through = sums[end + 1 - size - first] + score
            if through > top:
                sums[-1] = top = through
                lengths[-1] = size
        yield from self._ids(n)


def stream(text: str, v: Vocabulary, every: int | None = None) -> Iterator[int]:
    """Ids of a text, spaces already replaced by the space mark."""
    return Stream(text, v, v.automaton(), every).ids()


class Encoder(dict):
    """Packed ids by stretch; those not met lately are searched."""

    def __init__(self, v: Vocabulary):
        super().__init__()
        self.v, self.automaton = v, v.automaton()
        self.before: dict[str, bytes] = {}
        alone = v.stretches_stand_alone()
        self.stretches = re.compile(f"\n+|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+" if alone else r"[\s\S]+")
        self.mark = array("i", [v.byte_ids[b] for b in SPACE.encode()]).tobytes()

    def __missing__(self, stretch: str) -> bytes:
        packed = self.before.get(stretch)
        if packed is None:
            packed = array("i", Stream(stretch, self.v, self.automaton).ids()).tobytes()
            if len(stretch) > MEMORY_CHARS:
                return packed
        if len(self) >= MEMORY:
            self.before = dict(self)
            self.clear()
        self[stretch] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """int32 ids. A space goes before the text as in training; a space mark in the text itself is spelt as bytes."""
        if not text:
            return b""
        parts = (" " + text).split(SPACE)
        return self.mark.join(b"".join(map(self.__getitem__, self.stretches.findall(p.replace(" ", SPACE)))) for p in parts)


def encoder_of(v: Vocabulary) -> Encoder:
    """The encoder of this worker, kept from task to task."""
    if "op3" not in kept or kept["op3"].v.digest != v.digest:
        kept["op3"] = Encoder(v)
    return kept["op3"]


def decode(ids: np.ndarray, v: Vocabulary) -> str:
    """The text of ids: their bytes joined, without the space put before the text."""
    data = b"".join(map(v.spelling.__getitem__, ids.tolist()))
    return data[1:].decode("utf-8", "replace") if data[:1] == b" " else data.decode("utf-8", "replace")


def tokenize(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """`docs` with ids array<int> and decoded string, in place of its text; further columns but those two stay.

    An empty text has no ids, a null text null ids; decoding gives back every text that is valid UTF-8.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    others = [f for f in docs.schema.fields if f.name not in ("text", "ids", "decoded")]

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        encoder = encoder_of(v)
        for batch in batches:
            packed, texts, size, start = [], [], 0, 0
            for k, value in enumerate(batch.column("text")):
                text = value.as_py()
                packed.append(None if text is None else encoder.encode(text))
                texts.append(None if text is None else decode(np.frombuffer(packed[-1], np.int32), v))
                size += len(text or "")
                if size > 1 << 22 or k + 1 == batch.num_rows:
                    part = batch.slice(start, k + 1 - start)
                    ends = np.cumsum([0] + [len(x or b"") // 4 for x in packed]).astype(np.int32)
                    values = pa.array(np.frombuffer(b"".join(x or b"" for x in packed), np.int32))
                    missing = pa.array([x is None for x in packed])
                    ids = pa.ListArray.from_arrays(pa.array(ends), values, mask=missing)
                    columns = [part.column(f.name) for f in others]
                    yield pa.RecordBatch.from_arrays([*columns, ids, pa.array(texts, pa.string())], [*(f.name for f in others), "ids", "decoded"])
                    packed, texts, size, start = [], [], 0, k + 1

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "ids array<int>", "decoded string"])
    return docs.select(*[f.name for f in others], "text").mapInArrow(lean(tokenized, keeps="op3"), schema)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and whether decoding them gives the text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text").alias("before"), "text")
    found = tokenize(docs)
    return found.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"),
        F.crc32("decoded").alias("text_crc32"),
        (F.xxhash64("decoded") == F.col("before")).alias("round_trip"),
        "ids",
    )

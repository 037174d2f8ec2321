"""Language by cross-parsing entropy.

The suffix automaton of a language's labelled text accepts every substring of it. A text is parsed greedily into the longest
matches; the better the automaton's language fits, the fewer phrases. The number of phrases times the bits that name a place
in the labelled text, per character, estimates the cross entropy, and the language with the smallest one wins.

Texts are lower-cased and runs of other characters than letters become one space. They are parsed in blocks of BLOCK
characters, each beginning a new phrase, so that numpy can take one step in all blocks of many texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from milepost.llm import vectors
from milepost.llm.common import held_out, lean, table

#: Labelled documents of each language that are sent to the driver, and the length in characters of those that go first.
SAMPLE_DOCS, SAMPLE_MIN, SAMPLE_MAX = 60, 100, 4000
#: Characters of labelled text that the automaton of a language is built on.
SAMPLE_CHARS = 16_000
#: Languages beyond this number are refused, as their automata are held in memory.
MAX_LANGUAGES = 200
BLOCK = 512
#: Entries of a language's table of steps up to which it is kept whole; a larger one, as of a script of many letters, is kept sparse.
DENSE = 1 << 23
UNKNOWN = "und"
_SPACE, _OTHER = 0, 1


@dataclass(frozen=True)
class Automata:
    """alphabet: letters of all languages in order, from symbol 2; own: per language its own symbol for each of these."""

    languages: list[str]
    alphabet: str
    own: list[np.ndarray]
    steps: list[Steps]
    bits: list[float]

    @property
    def width(self) -> int:
        return len(self.alphabet) + 3  # space, other letters, the alphabet, padding


@dataclass(frozen=True)
class Steps:
    """Steps of one automaton: for (row start + symbol) twice the next row's start, odd if a phrase ends.

    Without keys, `to` is the whole table. With them, `to` has the steps that `keys` lists in order, and all others are
    those of `first`, by symbol; padding, the last symbol, changes nothing.
    """

    width: int
    rows: int
    to: np.ndarray
    keys: np.ndarray | None = None
    first: np.ndarray | None = None

    def take(self, state: np.ndarray, column: np.ndarray, at: np.ndarray) -> None:
        """Puts the step of each state by its symbol in its place; `at` is room for as many."""
        np.right_shift(state, 1, out=at)
        np.add(at, column, out=at)
        if self.keys is None:
            np.take(self.to, at, out=state, mode="clip")
            return
        place = np.minimum(np.searchsorted(self.keys, at), len(self.keys) - 1)
        following = np.where(self.keys[place] == at, self.to[place], self.first[column])
        np.copyto(state, np.where(column == self.width - 1, state & ~1, following))


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts all substrings; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


def parse_table(moves: list[dict[int, int]], width: int) -> Steps:
    """For (state, symbol) twice the start of the next state's row, plus 1 if a phrase ends before the symbol.

    Where no match goes on, the symbol begins the next phrase; one that never occurs is a phrase by itself and leads to an
    extra last state from which every symbol begins a new phrase. Padding, the last symbol, changes nothing.
    """
    lost = len(moves)
    first = np.full(width, lost * width * 2 + 1, np.int64)
    for c, to in moves[0].items():
        first[c] = to * width * 2 + 1
    if (lost + 1) * width > DENSE:
        known = sorted((state * width + c, to * width * 2) for state, own in enumerate(moves) for c, to in own.items())
        keys, to = np.array(known, np.int64).reshape(-1, 2).T.copy()
        return Steps(width, lost + 1, to, keys, first)
    steps = np.tile(first, (lost + 1, 1))
    for state, own in enumerate(moves):
        for c, to in own.items():
            steps[state, c] = to * width * 2
    steps[:, width - 1] = np.arange(lost + 1) * width * 2
    return Steps(width, lost + 1, steps.astype(np.int32).ravel())


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point whether it is a letter, and its lower case where that is one character."""
    if not _LETTERS:
        is_letter = np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)
        lower = np.arange(0x110000, dtype=np.uint32)
        for k in np.flatnonzero(is_letter):
            x = chr(k).lower()
            if len(x) == 1:
                lower[k] = ord(x)
        _LETTERS.append((is_letter, lower))
    return _LETTERS[0]


_LETTERS: list[tuple[np.ndarray, np.ndarray]] = []


def normalised(text: str) -> str:
    """Lower case, with one space for each run of other characters than letters."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter, lower = _letters()
    code = np.where(is_letter[code], lower[code], ord(" ")).astype(np.uint32)
    return code[_kept(code == ord(" "))].tobytes().decode("utf-32-le")


def _kept(space: np.ndarray) -> np.ndarray:
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    keep[:1] = True
    return keep


def build(samples: dict[str, str]) -> Automata:
    """samples: normalised labelled text by language. Letters that a language's text lacks are one symbol in its automaton."""
    languages = sorted(samples)
    alphabet = "".join(sorted(set().union(*samples.values()) - {" "}))
    own, steps = [], []
    for x in languages:
        symbol = {" ": _SPACE, **{c: k + 2 for k, c in enumerate(sorted(set(samples[x]) - {" "}))}}
        own.append(np.array([_SPACE, _OTHER, *(symbol.get(c, _OTHER) for c in alphabet), len(symbol) + 1], np.int32))
        steps.append(parse_table(suffix_automaton([symbol[c] for c in samples[x]]), len(symbol) + 2))
    return Automata(languages, alphabet, own, steps, [float(np.log2(max(2, len(samples[x])))) for x in languages])


def labelled(docs: DataFrame) -> DataFrame:
    """lang, fits, hash and text of the rows that can be learnt from; a text that does not fit is cut from its first letter on."""
    known = docs.select("doc_id", "lang", "text").where(
        F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}")
    )
    fits = F.length("text").between(SAMPLE_MIN, SAMPLE_MAX)
    part = F.regexp_extract("text", rf"(?s)\p{{L}}.{{0,{SAMPLE_MAX - 1}}}", 0)
    return known.select(
        "lang", fits.alias("fits"), F.xxhash64("doc_id", "text").alias("hash"), F.when(fits, F.col("text")).otherwise(part).alias("text")
    )


def sample_sizes(known: DataFrame) -> dict[str, int]:
    """How many documents of each language are taken: SAMPLE_DOCS, or, with fewer that fit, four, 16 and so on times as many.

    The rest is then likely to give SAMPLE_CHARS characters, if there are as many.
    """
    facts = known.groupBy("lang").agg(F.count_if("fits").alias("n"), F.avg(F.when(~F.col("fits"), F.length("text"))).alias("chars"))
    found = facts.limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    sizes = {}
    for r in found:
        size = SAMPLE_DOCS
        while r["n"] < SAMPLE_DOCS and r["chars"] and size * r["chars"] < 2 * SAMPLE_CHARS:
            size *= 4
        sizes[r["lang"]] = size
    return sizes


def learn(docs: DataFrame) -> Automata:
    """Automata of the languages in column lang, from documents of smallest hash for each of them.

    Documents of SAMPLE_MIN to SAMPLE_MAX characters go first; a language with fewer than SAMPLE_DOCS of them is filled up
    with shorter ones and the first SAMPLE_MAX characters of longer ones.
    """
    known = labelled(docs)
    sizes = sample_sizes(known)
    order = Window.partitionBy("lang").orderBy(F.desc("fits"), "hash")
    samples: dict[str, list[str]] = {}
    for size in sorted(set(sizes.values())):
        own = known.where(F.col("lang").isin([lang for lang, n in sizes.items() if n == size]))
        rows = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
        for r in sorted(rows.select("lang", "rank", "text").collect(), key=lambda r: (r["lang"], r["rank"])):
            samples.setdefault(r["lang"], []).append(normalised(r["text"]))
    return build({lang: x for lang, own in samples.items() if (x := " ".join(own)[:SAMPLE_CHARS]).strip()})


def phrases(texts: list[str | None], automata: Automata) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases by text and language, normalised characters and letters of each text."""
    width, is_letter, lower = automata.width, *_letters()
    symbols = np.zeros(0x110000, np.int32)
    symbols[is_letter] = _OTHER
    symbols[[ord(c) for c in automata.alphabet]] = np.arange(2, width - 1)
    symbols = symbols[lower] * is_letter
    counts = np.zeros((len(texts), len(automata.languages)), np.int64)
    sizes, letters = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for start, end in vectors.text_batches(texts, 1 << 20):
        blocks, owners = [], []
        for k in range(start, end):
            own = symbols[np.frombuffer((texts[k] or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
            own = own[_kept(own == _SPACE)]
            sizes[k], letters[k] = len(own), np.count_nonzero(own)
            n = -(-len(own) // BLOCK)
            if letters[k]:
                full = np.full(n * BLOCK, width - 1, np.int32)
                full[: len(own)] = own
                blocks.append(full.reshape(n, BLOCK))
                owners.append(np.full(n, k))
        if not blocks:
            continue
        owner = np.concatenate(owners)
        columns = np.ascontiguousarray(np.concatenate(blocks).T)
        for x, steps in enumerate(automata.steps):
            kind = steps.to.dtype
            # From the last state every symbol begins a phrase.
            state = np.full(len(owner), 2 * (steps.rows - 1) * steps.width, kind)
            at, flag, begun = (np.zeros(len(owner), kind) for _ in range(3))
            for column in columns:
                steps.take(state, automata.own[x][column], at)
                np.bitwise_and(state, 1, out=flag)
                np.add(begun, flag, out=begun)
            counts[:, x] += np.bincount(owner, begun, len(texts)).astype(np.int64)
    return counts, sizes, letters


def judged(texts: list[str | None], automata: Automata) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    counts, sizes, letters = phrases(texts, automata)
    known = (letters > 0) & bool(automata.languages)
    entropy = counts * np.asarray(automata.bits) / np.maximum(sizes, 1)[:, None]
    entropy = np.concatenate([entropy, np.full((len(texts), 2), np.inf)], 1)
    best, two = entropy.argmin(1), np.sort(entropy, 1)[:, :2]
    score = np.ones(len(texts))
    np.divide(two[:, 1], two.sum(1), out=score, where=np.isfinite(two[:, 1]))
    return [automata.languages[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)], np.where(known, score, 0.0)


def predict(docs: DataFrame, automata: Automata) -> DataFrame:
    """doc_id, lang_pred and score of every row.

    A text that is null or has no letter, and every text where no language was learnt, is `und` with score 0. Ties go to
    the first language by name. The score is the runner-up's entropy over the sum of both, 1 with one language only.
    """
    model = docs.sparkSession.sparkContext.broadcast(automata)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(vectors.parts, batches)):
            names, score = judged(batch.column("text").to_pylist(), model.value)
            columns = [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(predicted), f"doc_id {kind}, lang_pred string, score double")


def with_language(docs: DataFrame, automata: Automata) -> DataFrame:
    """The rows of `docs`, all columns, whose language is known; those that are `und` go. A null `lang` becomes the one found.

    Where no language was learnt, only rows without a letter go, and none gets a language.
    """
    model = docs.sparkSession.sparkContext.broadcast(automata)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(vectors.parts, batches)):
            texts = batch.column("text").to_pylist()
            if model.value.languages:
                names = judged(texts, model.value)[0]
                keep = [name != UNKNOWN for name in names]
                labels = [name if own is None else own for own, name in zip(batch.column("lang").to_pylist(), names, strict=True)]
                batch = batch.set_column(batch.schema.get_field_index("lang"), batch.schema.field("lang"), pa.array(labels, pa.string()))
            else:
                keep = (phrases(texts, model.value)[2] > 0).tolist()
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(kept), docs.schema)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, learn(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

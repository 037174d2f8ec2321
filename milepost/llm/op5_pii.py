"""Personal data by bootstrapped contextual extraction.

Four fixed patterns find e-mail and IP addresses, card and phone numbers. These are the seeds. The words before a seed form
lexical patterns, and other strings of a similar shape are candidates. Patterns and strings form a graph, scored in rounds on
Spark: a pattern's precision for a kind is the share of strings trusted for it among those of fitting shape that it precedes,
where a string of no known kind counts little; its selectivity is how often its last word precedes such strings at all in
their documents. High-confidence patterns make candidates trusted, which may raise further patterns, until no new string is
trusted. All occurrences of a trusted candidate are added as spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from milepost.llm import vectors
from milepost.llm.common import free_name, lean, stored, table

KINDS = ("email", "ip", "card", "phone")
#: A pattern needs as many different trusted strings, and at least this precision and selectivity.
MIN_SUPPORT, MIN_PRECISION, MIN_SELECTIVITY = 3, 0.7, 0.5
#: What a string of no known kind counts against a pattern, beside 1 for one that is trusted for another kind only.
UNKNOWN = 0.1
#: Characters before a string in which the words of its patterns are looked for.
REACH = 60

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++")
# A number cannot begin inside a run of digits, as the run's first digit would have matched alike.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9][0-9 ().-]{5,}[0-9]")
_IP6 = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Za-z])")
_WORD = re.compile(r"[^\W\d_]+")
_AROUND = re.compile(r"[^\s,;<>()\"']{1,64}")

Span = tuple[int, int]


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Each @ has one possible match, which begins with the run before it; so the time is linear in any text."""
    spans, least, at = [], 0, text.find("@")
    while at >= 0:
        before = text[least:at]
        start = least + len(before.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            spans.append((start, found.end()))
        least = found.end() if found else at + 1
        at = text.find("@", least)
    return spans


def _short(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> dict[str, list[Span]]:
    """The spans of the four fixed patterns, by kind in their order."""
    cards = [m for m in _CARD.finditer(text) if m.end() - m.start() >= 16]
    return {
        "email": emails(text),
        "ip": [m.span() for m in _IP.finditer(text) if all(map(_short, m[0].split(".")))],
        "card": [m.span() for m in cards if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)],
        "phone": [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15],
    }


def shapes(value: str) -> int:
    """Bit k is set if the string could be of kind k: at least its characters and their number fit."""
    n, letters = len(_digits(value)), any(c.isalpha() for c in value)
    marks = (
        value.count("@") == 1 and value[0] != "@" and value[-1] != "@",
        value.count(":") >= 3 or value.count(".") == 3 and not letters and " " not in value,
        12 <= n <= 19 and not letters,
        7 <= n <= 15 and not letters,
    )
    return sum(1 << k for k, mark in enumerate(marks) if mark)


def candidates(text: str, taken: list[Span]) -> list[Span]:
    """Strings of some kind's shape outside the spans taken."""
    taken = sorted(taken)
    starts, reach, ends = [s for s, _ in taken], 0, []
    for _, e in taken:
        reach = max(reach, e)
        ends.append(reach)

    def free(start: int, end: int) -> bool:
        k = bisect_left(starts, end)
        return not k or ends[k - 1] <= start

    found = [m.span() for m in _NUMBER.finditer(text)]
    if "@" in text:
        found += [m.span() for m in _AROUND.finditer(text) if "@" in m[0]]
    if text.count(":") >= 3:
        found += [m.span() for m in _IP6.finditer(text)]
    return sorted({x for x in found if free(*x) and shapes(text[slice(*x)])})


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def occurrences(text: str, base: dict[str, list[Span]]) -> list[tuple]:
    """(kind or -1, start, end, hash of the string, shapes, last word before, last two words, last word's count here)."""
    rows = [(k, s, e) for k, kind in enumerate(KINDS) for s, e in base[kind]]
    rows += [(-1, s, e) for s, e in candidates(text, [(s, e) for _, s, e in rows])]
    if not rows:
        return []
    counts = Counter(_WORD.findall(text.lower()))
    out = []
    for kind, start, end in rows:
        value = text[start:end]
        before = _WORD.findall(text[max(0, start - REACH) : start].lower())
        one, two = before[-1] if before else "", " ".join(before[-2:]) if len(before) > 1 else ""
        out.append((kind, start, end, _hash(value), shapes(value) | (1 << kind if kind >= 0 else 0), one, two, max(1, counts[one])))
    return out


OCCURRENCE = "array<struct<kind:int,start:int,end:int,value:bigint,shapes:int,one:string,two:string,n_one:int>>"
_TYPE = pa.list_(
    pa.struct(
        [("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.int64()), ("shapes", pa.int32())]
        + [("one", pa.string()), ("two", pa.string()), ("n_one", pa.int32())]
    )
)
_FIELDS = [f.name for f in _TYPE.value_type]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, key (of id and text), the number of base spans of each kind, their digest, and all occurrences."""
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(vectors.parts, batches)):
            rows = []
            for value in batch.column("text"):
                text = value.as_py() or ""
                base = base_spans(text)
                joined = ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in base[k])
                digest = hashlib.sha256(joined.encode()).hexdigest()
                own = [dict(zip(_FIELDS, x, strict=True)) for x in occurrences(text, base)]
                rows.append((*(len(base[k]) for k in KINDS), digest, own))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64()] * 4 + [pa.string(), _TYPE]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                ["doc_id", "key", *(f"n_{k}" for k in KINDS), "base_sha256", "found"],
            )

    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(lean(scanned), f"doc_id {kind}, key long, {counts}, base_sha256 string, found {OCCURRENCE}")


def patterns(edges: DataFrame, trusted: DataFrame, selective: DataFrame) -> DataFrame:
    """High-confidence patterns: pattern, kind, precision. edges: distinct (pattern, value, shapes)."""
    kinds = F.explode(F.array(*[F.lit(k) for k in range(len(KINDS))])).alias("kind")
    fitting = edges.select("pattern", "value", "shapes", kinds).where("(shapes & shiftleft(1, kind)) <> 0")
    known = trusted.groupBy("value").agg(F.collect_set("kind").alias("own"))
    marked = fitting.join(known, "value", "left")
    right = F.coalesce(F.array_contains("own", F.col("kind")), F.lit(False))
    against = F.when(F.col("own").isNull(), UNKNOWN).when(right, 0.0).otherwise(1.0)
    scores = marked.groupBy("pattern", "kind").agg(F.count_if(right).alias("support"), F.sum(against).alias("against"))
    scores = scores.withColumn("precision", F.col("support") / (F.col("support") + F.col("against")))
    good = scores.where((F.col("support") >= MIN_SUPPORT) & (F.col("precision") >= MIN_PRECISION))
    return good.join(selective, "pattern").select("pattern", "kind", "precision")


def bootstrap(scanned: DataFrame) -> DataFrame:
    """value and kind of the candidates that become trusted; scanned is what scan() returns, stored."""
    rows = scanned.select("key", F.explode("found").alias("o")).select("key", "o.*")
    texts = F.explode(F.array(F.concat(F.lit("1 "), "one"), F.concat(F.lit("2 "), "two")))
    links = rows.select("key", "kind", "value", "shapes", "n_one", texts.alias("pattern")).where("length(pattern) > 2")
    edges = stored(links.select("pattern", "value", "shapes").distinct(), "edges")
    uses = links.groupBy("pattern", "key").agg(F.count("*").alias("n"), F.max("n_one").alias("all"))
    selective = uses.groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("all").alias("all"))
    selective = stored(selective.where(F.col("n") >= MIN_SELECTIVITY * F.col("all")).select("pattern"), "selective")
    seeds = stored(rows.where("kind >= 0").select("value", "kind").distinct(), "seeds")
    unseen = rows.where("kind < 0").select("value").distinct()
    trusted = seeds
    while True:
        good = patterns(edges, trusted, selective)
        hits = edges.join(good, "pattern").where("(shapes & shiftleft(1, kind)) <> 0")
        scores = hits.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1.0001 - F.col("precision"))))).alias("score"))
        new = scores.where(F.col("score") >= MIN_PRECISION).join(unseen, "value", "left_semi").select("value", "kind")
        new = stored(new.join(trusted, ["value", "kind"], "left_anti"), "new")
        # Strings stay trusted, so the rounds come to an end.
        if not new.limit(1).count():
            break
        trusted = stored(trusted.union(new), "trusted")
    # A candidate that two kinds claim is of the first.
    return trusted.join(unseen, "value", "left_semi").groupBy("value").agg(F.min("kind").alias("kind"))


def find(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, key, counts and digest of the base spans, and `spans` (kind, start, end), all sorted.

    A null text is empty and has no spans; rows alike in doc_id and text get the same spans. Other columns are not read.
    """
    scanned = stored(scan(docs), "pii")
    new = bootstrap(scanned).select(F.col("value").alias("_value"), F.col("kind").alias("_kind"))
    extra = scanned.select("key", F.explode("found").alias("o")).where("o.kind < 0").join(new, F.col("o.value") == F.col("_value"))
    extra = extra.groupBy(F.col("key").alias("_key")).agg(
        F.collect_set(F.struct(F.col("_kind").alias("kind"), F.col("o.start").alias("start"), F.col("o.end").alias("end"))).alias("extra")
    )
    spans_type = "array<struct<kind:int,start:int,end:int>>"
    base = F.transform(F.filter("found", lambda o: o["kind"] >= 0), lambda o: F.struct(o["kind"], o["start"], o["end"]))
    joined = scanned.join(extra, F.col("key") == F.col("_key"), "left")
    added = F.coalesce(F.col("extra").cast(spans_type), F.array().cast(spans_type))
    spans = F.array_sort(F.concat(base.cast(spans_type), added))
    return joined.select("doc_id", "key", *[f"n_{k}" for k in KINDS], "base_sha256", spans.alias("spans"))


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the first kind's name in brackets."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with its columns, personal data in `text` replaced; n_chars, where there is one, is brought up to date."""
    own, found_id, found_key, found = (free_name(docs, name) for name in ("_own", "_found_id", "_found_key", "_found"))
    spans = find(docs).where(F.size("spans") > 0).groupBy(F.col("doc_id").alias(found_id), F.col("key").alias(found_key))
    spans = spans.agg(F.first("spans").alias(found))
    same = (F.col(own) == F.col(found_key)) & F.col("doc_id").eqNullSafe(F.col(found_id))
    joined = docs.withColumn(own, F.xxhash64("doc_id", "text")).join(spans, same, "left")

    @F.udf("string", useArrow=True)
    def cut(text, spans):
        return text if text is None or not spans else redacted(text, [(x["kind"], x["start"], x["end"]) for x in spans])

    clean = joined.withColumn("text", F.when(F.col(found).isNull(), F.col("text")).otherwise(cut("text", found)))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col(found).isNull(), F.col("n_chars")).otherwise(F.length("text")))
    return clean.select(*docs.columns)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.transform("spans", lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    found = find(table(spark, sf_dir, "documents"))
    counts = [f"n_{k}" for k in KINDS]
    return found.select("doc_id", *counts, "base_sha256", F.array_join(text, ",").alias("spans"))

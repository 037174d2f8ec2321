"""Ranked search, top-k search and the conversation trie against plain versions, with odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from milepost.llm import op11_lexical_scan, op12_norm_buckets, op13_prefix_trie
from tests.helpers import bag
from tests.llm.plain import CLASHING, odd_documents

EXTRA = ["rank", "part", "item", "values", "length", "row", "place", "query_id", "block", "size", "offset", "all", "depth", "k1", "n", "h", "pos"]


def _with_extras(df):
    return df.withColumns({name: F.lit(1) for name in {*CLASHING, *EXTRA} - set(df.columns)})


def _last(x):
    return (x is None, x or 0)


def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, top):
    counts = [(d, Counter(_terms(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = defaultdict(set)
    for i, text in items:
        wanted[i] |= set(_terms(text))
    out = Counter()
    for i, terms in wanted.items():
        scored = []
        for d, c in counts:
            score = 0
            for t in terms & set(c):
                m = 100 - 90 + 90 * c.total() * n_docs // n_terms
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, _last(d), d))
        out.update((i, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scored)[:top]))
    return out


DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def test_ranked_search_equals_a_plain_one(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(40)] + ["Ünï", "W3", "the", "he", "hen", "then"]
    docs = [(k, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for k in range(60)]
    docs += [(7, "the hen"), (None, "the hen"), (None, "the hen"), (100, None), (101, ""), (102, "?! \x00\n"), (103, "the-hen,THEN"), (104, "the " * 4000), (105, "hen" * 3000)]
    items = [(k, " ".join(rng.choices(words, k=8))) for k in range(6)]
    items += [(8, None), (9, ""), (10, " ?"), (None, "the"), (None, "hen"), (3, "then"), (11, "nowhere"), (12, "hen" * 3000)]
    tables = [_with_extras(spark.createDataFrame(rows, kind)) for rows, kind in ((docs, DOCS), (items, ITEMS))]
    want = plain_search(docs, items, 10)
    assert {r[0] for r in want} == {*range(6), None, 12}
    found = op11_lexical_scan.search(*tables)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, found.collect())) == want
    # Many blocks, pieces of a few words, and few scores at a time change nothing.
    text = "the hen, then. " * 50
    block = next(op11_lexical_scan.blocks(tables[1]))
    whole = op11_lexical_scan.scan([text.encode(), None, b"hen"], block)
    monkeypatch.setattr(op11_lexical_scan.vectors, "CHUNK", 16)
    monkeypatch.setattr(op11_lexical_scan, "CELLS", 3)
    assert all(np.array_equal(a, b) for a, b in zip(whole, op11_lexical_scan.scan([text.encode(), None, b"hen"], block), strict=True))
    assert len(list(op11_lexical_scan.blocks(tables[1], 40))) > 3
    assert Counter(map(tuple, op11_lexical_scan.search(*tables, limit=100).collect())) == want


def test_ranked_search_without_rows(spark):
    docs, items = odd_documents(spark), spark.createDataFrame([(1, "words")], ITEMS)
    assert op11_lexical_scan.search(odd_documents(spark, 0), items).count() == 0
    assert op11_lexical_scan.search(docs, items.limit(0)).count() == 0
    assert op11_lexical_scan.search(docs.where("text IS NULL"), items).count() == 0
    # The longer of the odd texts with this word stand behind the shorter; of equal ones the smaller id, and no id at last.
    found = op11_lexical_scan.search(docs, items).orderBy("rank").collect()
    assert [r["doc_id"] for r in found] == [6, 7, None]


VECTORS = "vec_id long, embedding array<float>"


def plain_nearest(rows, every, top):
    known = [(v, [math.floor(256 * float(np.float32(x))) for x in e]) for v, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = Counter()
    for a, (q, x) in enumerate(known):
        if q is not None and q % every == 0:
            found = sorted((-sum(s * t for s, t in zip(x, y, strict=True)), _last(v), v) for b, (v, y) in enumerate(known) if a != b and len(x) == len(y))
            out.update((q, k + 1, v, -s) for k, (s, _, v) in enumerate(found[:top]))
    return out


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_top_k_equals_a_plain_search(spark, monkeypatch, spread):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(5, 6))
    rows = []
    for k in range(400):
        x = centres[k % 5] + rng.normal(size=6) * 0.2
        rows.append((k, (x / np.linalg.norm(x) * np.exp(spread * rng.normal())).tolist()))
    nan, inf = float("nan"), float("inf")
    rows += [(k, [0.5, 0, 0, 0, 0, 0.5]) for k in range(400, 480)]  # one vector many times
    rows += [(50, rows[7][1]), (None, rows[0][1]), (500, None), (550, [1.0, None, 0, 0, 0, 0]), (600, [nan] * 6), (650, [inf] * 6)]
    rows += [(700, [0.0] * 6), (750, []), (751, []), (800, [1.0, 2.0]), (801, [2.0, 1.0]), (802, [-1.0, -1.0]), (-50, [-0.3] * 6), (850, [3.0])]
    rows = [(v, e and [None if x is None else float(x) for x in e]) for v, e in rows]
    table = _with_extras(spark.createDataFrame(rows, VECTORS))
    want = plain_nearest(rows, 10, 5)
    is_query = F.col("vec_id") % 10 == 0
    found = op12_norm_buckets.search(table, is_query)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert Counter(map(tuple, found.collect())) == want
    # Small buckets, several blocks of queries, and few or no vectors tried first.
    monkeypatch.setattr(op12_norm_buckets, "BUCKET", 16)
    few = table.coalesce(1)
    assert Counter(map(tuple, op12_norm_buckets.search(few, is_query, limit=2000, first=20).collect())) == want
    assert op12_norm_buckets.search(table, is_query, top=1).where("vec_id IS NULL").count() == len([1 for _, k, v, _ in plain_nearest(rows, 10, 1) if v is None])


def test_top_k_prunes_and_verifies_only_candidates(monkeypatch):
    """By length, by bucket and by coordinate: products are taken with a small part of the vectors, and nothing is lost."""
    rng = np.random.default_rng(6)
    values = np.floor(256 * rng.normal(size=(4000, 16)) * np.exp(rng.normal(size=(4000, 1)))).astype(np.int64)
    length = np.sqrt((values.astype(float) ** 2).sum(1))
    order = np.argsort(-length)
    values, length = values[order], length[order]
    row = np.arange(4000)
    queries = op12_norm_buckets.Queries(row[::50], row[::50], values[::50], length[::50], np.full(80, np.iinfo(np.int64).min), 5)
    verified = []
    plain = op12_norm_buckets.product
    monkeypatch.setattr(op12_norm_buckets, "product", lambda a, b, exact: verified.append(len(a) * len(b)) or plain(a, b, exact))
    for start in range(0, 4000, 250):
        part = row[start : start + 250]
        op12_norm_buckets.search_bucket(queries, op12_norm_buckets.Bucket(part, np.zeros(250, bool), part, values[part], length[part]))
    assert sum(verified) < 0.4 * 80 * 4000
    scores = values[::50] @ values.T
    scores[np.arange(80), row[::50]] = -(1 << 62)
    best = np.argsort(-scores, axis=1, kind="stable")[:, :5]
    assert np.array_equal(queries.vec_id, best)
    assert np.array_equal(queries.score, np.take_along_axis(scores, best, 1))


def test_products_beyond_doubles_are_exact_and_beyond_longs_refused(spark):
    big = [(0, [4.1e5, 3.0]), (1, [4.1e5, 1.0]), (2, [4.1e5, 2.0])]
    table = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    want = sorted(((math.floor(256 * 4.1e5)) ** 2 + 768 * math.floor(256 * x[1]) for _, x in big[1:]), reverse=True)
    assert want[0] > 1 << 53
    assert [r["score"] for r in op12_norm_buckets.search(table, F.col("vec_id") == 0).orderBy("rank").collect()] == want
    with pytest.raises(ValueError, match="do not fit a long"):
        op12_norm_buckets.search(spark.createDataFrame([(0, [1e30])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0)


def test_top_k_without_rows(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert op12_norm_buckets.search(empty, F.col("vec_id") == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0])], VECTORS)
    assert op12_norm_buckets.search(one, F.col("vec_id") == 0).count() == 0
    assert op12_norm_buckets.search(one, F.col("vec_id") == 1).count() == 0


TURNS = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            by[c].append((turn is not None, turn or 0, mark, role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in by.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = own.get(c - int(math.fmod(c, 20)), [])
        whole = tuple(base[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children = Counter(node[:-1] for node in members if node)
    leaves, saved = Counter(), Counter()
    for node, found in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(found) - 1) * words
    return Counter(
        (
            min(found), len(node), min(members[node[:-1]]) if node else None, len(found), children[node], leaves[node], saved[node],
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        )
        for node, found in members.items()
    )


def _trie(df, band=op13_prefix_trie.BAND):
    found = op13_prefix_trie.prefix_trie(*op13_prefix_trie.rebuilt(df), band=band).drop("k1", "k2")
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return Counter(map(tuple, found.collect()))


def test_trie_equals_a_plain_one(spark):
    rng = random.Random(8)
    texts = ["a", "b c", "", None, "d\te f"]
    rows = []
    for c in [*range(0, 70), *range(81, 90), -7, -20, -41, 10**12]:
        for k in range(rng.randint(1, 6)):
            rows.append((c, rng.choice([k, k, k, None, 3]), rng.choice(["user", None, ""]), rng.choice(texts)))
    rows += rows[:5]  # repeated turns
    rows += [(c, k, "user", "always the same") for c in range(200, 240) for k in range(5)]  # one conversation many times
    rows += [(300, k, "user", f"deep {k}") for k in range(60)] + [(301, k, "user", f"deep {k}") for k in range(55)]  # a deep path
    rows += [(None, 0, "user", "of no conversation"), (400, None, None, None), (401, 0, "user", "x" * 100_000)]
    df = _with_extras(spark.createDataFrame(rows, TURNS))
    want = plain_trie(rows)
    assert max(r[1] for r in want) > 50 and min(r[0] for r in want) == -41
    assert _trie(df) == want
    assert _trie(df.repartition(5), band=2) == want


def test_trie_of_little(spark):
    assert _trie(spark.createDataFrame([], TURNS)) == Counter()
    assert _trie(spark.createDataFrame([(None, 0, "user", "x")], TURNS)) == Counter()
    # h of 1 and of 21 is above 0 and there is no base: what is left of these conversations has no turn.
    alone = [(c, 0, "user", "x") for c in range(1, 100) if c % 20 and zlib.crc32(str(c).encode()) % 4][:3]
    found = _trie(spark.createDataFrame(alone, TURNS))
    assert found == plain_trie(alone) and found.total() == 1


def test_ids_of_a_node_are_hashed_in_order_over_many_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        ends = spark.range(500).select(F.lit(1).cast("long").alias("k1"), (F.col("id") % 2).alias("k2"), F.col("id").alias("conv_id"))
        found = {r["k2"]: r["ends_sha256"] for r in op13_prefix_trie.id_digests(ends).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found == {k: hashlib.sha256(",".join(map(str, range(k, 500, 2))).encode()).hexdigest() for k in (0, 1)}


def test_search_reads_no_other_columns(spark, testdata):
    docs = spark.read.parquet(f"{testdata}/sf0.001/documents.parquet")
    items = spark.read.parquet(f"{testdata}/sf0.001/benchmark.parquet")
    assert bag(op11_lexical_scan.search(_with_extras(docs).drop("lang", "source"), items)) == bag(op11_lexical_scan.search(docs, items))

"""Plain versions of the operators, and small tables with all kinds of odd rows."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns whose names the operators use inside.
CLASHING = ["key", "words", "seed", "shard", "node", "bucket", "place", "part", "found", "spans", "ids", "score", "size"]
CLASHING += ["_key", "_key2", "_own", "_found", "_found_id", "_found_key", "_spans", "_gone", "_bad", "_doc_id"]

ODD_TEXTS = [
    None,
    "",
    " \n\t ",
    "A",
    "12 345",
    "one two three",
    "Same words here, and the same again. Same words here, and the same again.",
    "Same words here, and the same again. Same words here, and the same again.",
    "x" * 5000,
    "la la " * 3000,
    "ü ▁ 日本 🙂 \x00 end",
]


def odd_documents(spark: SparkSession, rows: int = len(ODD_TEXTS)) -> DataFrame:
    """Null, empty and long texts, ties, a null id, one row three times, and extra columns with clashing names."""
    known = [(k, text, "en" if k % 2 else None, f"src{k % 3}", len(text or "")) for k, text in enumerate(ODD_TEXTS[:rows])]
    if known:
        known += [known[-1]] * 2 + [(None, "no id but some words in a row here", None, None, None)]
    df = spark.createDataFrame(known, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({name: F.lit(1) for name in CLASHING})


def shingles(text: str | None, n: int) -> frozenset:
    words = tuple((text or "").encode().lower().split())
    if len(words) < n:
        return frozenset([words] if words else [])
    return frozenset(words[k : k + n] for k in range(len(words) - n + 1))


def near_components(rows: list[tuple[int, str | None]], n: int, percent: int) -> dict[int, int]:
    """doc_id -> smallest doc_id reachable, by comparing each pair that shares a shingle."""
    sets = {d: shingles(t, n) for d, t in rows}
    by = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            by[x].add(d)
    root = {d: d for d in sets}

    def find(d: int) -> int:
        while root[d] != d:
            d = root[d]
        return d

    for d, s in sets.items():
        for e in set().union(*(by[x] for x in s)) if s else ():
            common = len(s & sets[e])
            if e < d and 100 * common >= percent * (len(s) + len(sets[e]) - common):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: find(d) for d in sets}


def personal(text: str) -> dict[str, list[tuple[int, int]]]:
    def digits(x: str) -> str:
        return re.sub("[^0-9]", "", x)

    def luhn(x: str) -> bool:
        doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(x))]
        return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0

    found = {
        "email": re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text),
        "ip": (m for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))),
        "card": (m for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
        "phone": (m for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15),
    }
    return {kind: [m.span() for m in matches] for kind, matches in found.items()}


def without_repeats(rows: list[tuple[int, str | None]], length: int) -> dict[int, tuple[int, int, int, str]]:
    """doc_id -> bytes, removed bytes, removed runs and digest of the rest, by a set of all substrings."""
    seen: set[bytes] = set()
    out = {}
    for d, text in sorted(rows):
        data, gone = (text or "").encode(), set()
        for k in range(len(data) - length + 1):
            piece = data[k : k + length]
            if piece in seen:
                gone.update(range(k, k + length))
            seen.add(piece)
        runs = sum(1 for k in gone if k - 1 not in gone)
        kept = bytes(c for k, c in enumerate(data) if k not in gone)
        out[d] = (len(data), len(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def min_cost_flow(arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost) of a cheapest largest flow, by successive shortest paths."""
    out: dict[int, list[int]] = {}
    head, room, price = [], [], []
    for a, b, capacity, cost in arcs:
        for x, y, c, p in ((a, b, capacity, cost), (b, a, 0, -cost)):
            out.setdefault(x, []).append(len(head))
            head.append(y)
            room.append(c)
            price.append(p)
    height: dict[int, int] = dict.fromkeys(out, 0)
    while True:
        far, via, queue = {source: 0}, {}, [(0, source)]
        while queue:
            d, x = heapq.heappop(queue)
            if d > far[x]:
                continue
            for e in out[x]:
                y = head[e]
                reach = d + price[e] + height[x] - height[y]
                if room[e] and reach < far.get(y, reach + 1):
                    far[y], via[y] = reach, e
                    heapq.heappush(queue, (reach, y))
        if sink not in far:
            return [room[2 * k + 1] for k in range(len(arcs))]
        most = max(far.values())
        height = {x: h + far.get(x, most) for x, h in height.items()}
        path, y = [], sink
        while y != source:
            path.append(via[y])
            y = head[via[y] ^ 1]
        amount = min(room[e] for e in path)
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount


def fewest_moved(old: list[int], new: list[int]) -> int:
    """Cost of a cheapest flow through the network of shards and a hub, by the general solver."""
    n, m = len(old), len(new)
    source, sink, hub = n + m, n + m + 1, n + m + 2
    arcs = [(source, i, size, 0) for i, size in enumerate(old)] + [(n + j, sink, size, 0) for j, size in enumerate(new)]
    arcs += [(i, n + i, old[i], 0) for i in range(min(n, m))] + [(i, hub, size, 1) for i, size in enumerate(old)]
    arcs += [(hub, n + j, size, 0) for j, size in enumerate(new)]
    flow = min_cost_flow(arcs, source, sink)
    assert sum(flow[:n]) == sum(old)
    return sum(f * arc[3] for f, arc in zip(flow, arcs, strict=True))

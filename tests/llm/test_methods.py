"""The methods against plain versions, on the smallest sample and on planted cases."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from milepost.llm import (
    op1_reshard,
    op2_toxicity,
    op3_sentencepiece,
    op4_setsketch,
    op5_pii,
    op6_spaced_seeds,
    op7_language,
    op9_suffix_dedup,
    op10_sentence_spans,
    vectors,
)
from milepost.llm.queries import all_queries
from tests.llm import plain

SCALE = "sf0.001"


@pytest.fixture(scope="module")
def documents(spark, testdata):
    return [tuple(r) for r in spark.read.parquet(f"{testdata}/{SCALE}/documents.parquet").select("doc_id", "text").collect()]


def test_word_hashes_follow_words(documents):
    texts = [t for _, t in documents] + ["", None, "A b\tA", "a B\x0ba "]
    hashes, bounds = vectors.words_of(texts)
    words = [w for t in texts for w in (t or "").encode().lower().split()]
    assert len(hashes) == len(words) == bounds[-1]
    assert len(set(zip(words, hashes.tolist(), strict=True))) == len(set(words)) == len(set(hashes.tolist()))


def test_long_texts_are_cut_at_white_space(monkeypatch):
    text = " ".join(map(str, range(5000)))
    whole = vectors.words_of([text])[0]
    monkeypatch.setattr(vectors, "CHUNK", 100)
    assert np.array_equal(vectors.words_of([text])[0], whole)


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(3)
    for _ in range(60):
        old = [rng.randint(0, 50) for _ in range(rng.randint(1, 7))]
        new = op1_reshard.even_capacities(sum(old), rng.randint(1, 7))
        plan = op1_reshard.blocks(old, new)
        for i, size in enumerate(old):
            cuts = sorted(x for b in plan if b.old == i for x in (b.start, b.end))
            assert cuts[::2] + [size] == [0, *cuts[1::2]] or not size  # the blocks follow on each other
        for j, size in enumerate(new):
            assert sum(b.end - b.start for b in plan if b.new == j) == size
        moved = sum(b.end - b.start for b in plan if b.new != b.old)
        assert moved == sum(max(0, size - (new[i] if i < len(new) else 0)) for i, size in enumerate(old))
        assert moved == plain.fewest_moved(old, new)


def test_a_hundred_thousand_shards_are_planned_at_once():
    rng = random.Random(4)
    old = [rng.randint(0, 10**9) for _ in range(60_000)]
    new = op1_reshard.even_capacities(sum(old), 100_000)
    plan = op1_reshard.blocks(old, new)
    pieces = op1_reshard.cut_rows(plan)
    assert len(plan) <= len(old) + len(new) and len(pieces) <= 3 * len(plan)
    assert sum(b.end - b.start for b in plan) == sum(old)


def test_documents_go_where_their_middle_byte_falls(spark):
    rng = random.Random(5)
    docs = [(k, "x" * rng.randint(0, 300), rng.choice(["a", "a", "a", "b", None])) for k in range(3000)]
    docs += [(k, None, "a") for k in range(5)] + docs[:3]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({n: F.lit(1) for n in plain.CLASHING})
    placed, plan = op1_reshard.reshard(df, F.col("source"), 400)
    rows = placed.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(d for d, *_ in docs)
    for old in range(3):
        own = sorted((b.start, b.end, b.new) for b in plan if b.old == old)
        held = {new: 0 for *_, new in own}
        for r in rows:
            if r["old"] == old:
                held[r["shard"]] += r["size"]
        # A shard starts within a document of where its block does, so sizes differ from the block's by two half documents.
        assert all(abs(held[new] - sum(e - s for s, e, j in own if j == new)) <= 316 for new in held)


def test_shards_are_whole_and_even(spark, testdata, documents):
    rows = all_queries()["op1_reshard"](spark, f"{testdata}/{SCALE}").collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(d for d, _ in documents)
    sizes = {d: len(t.encode()) + 16 for d, t in documents}
    assert all(r["size"] == sizes[r["doc_id"]] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    total = [sum(r["size"] for r in by.get(j, [])) for j in range(40)]
    assert max(total) - min(total) <= 2 * max(sizes.values())


def test_unaffected_shards_are_not_rewritten(spark, tmp_path):
    docs = spark.createDataFrame([(k, "x" * 84, f"s{k % 3}") for k in range(12)], "doc_id long, text string, source string")
    placed, plan = op1_reshard.reshard(docs, F.col("source"), 3)
    assert op1_reshard.affected(plan) == []
    assert op1_reshard.rewrite(placed, plan, f"{tmp_path}/none").count() == 12
    placed, plan = op1_reshard.reshard(docs, F.col("source"), 4)
    assert op1_reshard.affected(plan) == [0, 1, 2, 3]
    assert op1_reshard.rewrite(placed, plan, f"{tmp_path}/four").where("old <> shard").count() == 3


def test_scores_equal_a_sum_over_all_pairs():
    rng = np.random.default_rng(6)
    slots, n = 12, 30
    machine = op2_toxicity.Machine(np.arange(slots), -0.4, rng.normal(0, 0.5, slots), rng.normal(0, 0.6, (slots, op2_toxicity.FACTORS)))
    held = [np.flatnonzero(rng.random(slots) < 0.4) for _ in range(n)] + [np.zeros(0, np.int64)]
    got = machine.scores(np.repeat(np.arange(n + 1), [len(h) for h in held]), np.concatenate(held), n + 1)
    for h, score in zip(held, got, strict=True):
        raw = machine.bias + sum(machine.weights[i] for i in h)
        raw += sum(machine.factors[i] @ machine.factors[j] for a, i in enumerate(h) for j in h[a + 1 :])
        assert abs(score - 1 / (1 + np.exp(-raw))) < 1e-12


def test_documents_are_scored_as_their_terms_are(spark, documents):
    rng = np.random.default_rng(7)
    slot_of = np.full(op2_toxicity.BUCKETS, -1, np.int32)
    known = np.unique(np.concatenate([b for _, b in op2_toxicity.buckets_of([t for _, t in documents[:5]])]))[:40]
    slot_of[known] = np.arange(len(known))
    machine = op2_toxicity.Machine(slot_of, 0.1, rng.normal(0, 0.3, len(known)), rng.normal(0, 0.3, (len(known), op2_toxicity.FACTORS)))
    rows = [*documents[:40], (documents[0][0], documents[0][1]), (10**6, None), (10**6 + 1, "")]
    found = op2_toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), machine).collect()
    texts = dict(rows)
    assert len(found) == len(rows)
    for r in found:
        own = sorted({int(slot_of[b]) for _, bs in op2_toxicity.buckets_of([texts[r["doc_id"]]]) for b in bs} - {-1})
        raw = machine.bias + sum(machine.weights[i] for i in own)
        raw += sum(machine.factors[i] @ machine.factors[j] for a, i in enumerate(own) for j in own[a + 1 :])
        assert abs(r["score"] - 1 / (1 + np.exp(-raw))) < 1e-12


def test_machine_learns_pairs():
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 2, (3000, 2))
    noise = rng.integers(10, 400, (3000, 5))
    terms = [np.unique(np.concatenate([np.flatnonzero(r), n])) for r, n in zip(rows, noise, strict=True)]
    y = (rows.sum(1) == 2).astype(float)
    machine = op2_toxicity.train(terms, y, y.mean())
    slots = [machine.slot_of[np.array(x)] for x in ([0], [1], [0, 1])]
    docs = np.repeat([0, 1, 2], [len(s) for s in slots])
    scores = machine.scores(docs, np.concatenate(slots), 4)
    assert scores[2] > 0.9 and scores[:2].max() < 0.3 and scores[3] < 0.1


def test_toxicity_on_held_out_rows(spark, testdata):
    directory = f"{testdata}/sf0.1"
    labels = spark.read.parquet(f"{directory}/labels.parquet").select("doc_id", "toxic")
    found = all_queries()["op2_toxicity"](spark, directory).join(labels, "doc_id").where("held_out").collect()
    true = [r for r in found if r["toxic"] == 1]
    assert sum(r["predicted"] for r in true) >= 0.75 * len(true)
    assert sum(r["predicted"] for r in found if r["toxic"] == 0) <= 0.01 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)


def _viterbi(text: str, v: op3_sentencepiece.Vocabulary) -> list[int]:
    best, back = [0] + [-(10**18)] * len(text), [(0, [])] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - v.longest), end):
            known = v.pieces.get(text[start:end])
            score, ids = (known[1], [known[0]]) if known else (v.unknown, [v.byte_ids[b] for b in text[start:end].encode()])
            if (known or end == start + 1) and best[start] + score > best[end]:
                best[end], back[end] = best[start] + score, (start, ids)
    out, at = [], len(text)
    while at:
        out.append(back[at][1])
        at = back[at][0]
    return [i for ids in reversed(out) for i in ids]


def test_streaming_search_equals_the_whole_one(documents):
    v = op3_sentencepiece.Vocabulary.load()
    encoder = op3_sentencepiece.Encoder(v)
    for text in [t[:2000] for _, t in documents[:25]] + ["日本語 🙂 é", "aaaa" * 200, "  a  b\n\n c "]:
        marked = (" " + text).replace(" ", "▁")
        ids = np.frombuffer(encoder.encode(text), np.int32)
        assert ids.tolist() == _viterbi(marked, v) == list(op3_sentencepiece.stream(marked, v, 3))
        assert op3_sentencepiece.decode(ids, v) == text
    for text in ("▁", "a▁ b", "<s><0x0A>", "\x00\t"):
        assert op3_sentencepiece.decode(np.frombuffer(encoder.encode(text), np.int32), v) == text


def _letters(scores: dict[str, int]) -> op3_sentencepiece.Vocabulary:
    pieces = {piece: (256 + i, score) for i, (piece, score) in enumerate(scores.items())}
    return op3_sentencepiece.Vocabulary.of(pieces, list(range(256)), [bytes([b]) for b in range(256)] + [p.encode() for p in pieces])


def test_streaming_search_keeps_a_window(documents):
    """Sums never outgrow the window; lengths go as soon as the paths converge, here only where a `b` stands."""
    v = op3_sentencepiece.Vocabulary.load()
    text = "".join(t for _, t in documents[:200])[:40_000].replace(" ", "") + "\x01\u0378" * 500
    late = _letters({"aa": -3, "aab": -1, "ab": -9, "b": -9, "a": -9})
    rng = random.Random(3)
    runs = "".join("a" * rng.randint(1, 400) + "b" for _ in range(400))
    for words, vocabulary, held in ((text, v, 4 * 64 + 16), (runs, late, 2000)):
        search = op3_sentencepiece.Stream(words, vocabulary, vocabulary.automaton())
        found, most = [], 0
        for i in search.ids():
            found.append(i)
            most = max(most, len(search.lengths))
            assert len(search.sums) <= search.every + vocabulary.longest
        assert most <= held
        assert found == _viterbi(words, vocabulary)


def test_paths_that_never_converge():
    """Then the lengths stay, one byte a character, and following the paths back takes linear time in all."""
    v = _letters({"aa": -3, "a": -9, "aab": -1})
    for size in (40_000, 40_001):
        found = list(op3_sentencepiece.stream("a" * size, v))
        assert found == _viterbi("a" * size, v)


def test_probabilities_follow_the_order_of_scores():
    found = op3_sentencepiece.log_probabilities({"c": -1e9, "a": -2.0, "b": 0.0, "d": -2.0})
    assert sorted(found, key=lambda p: -found[p]) == ["b", "a", "d", "c"]
    assert abs(sum(np.exp(x / op3_sentencepiece.UNIT) for x in found.values()) - 1) < 1e-5
    assert op3_sentencepiece.log_probabilities({}) == {}


def test_ids_are_about_as_many_as_the_model_gives(documents):
    import sentencepiece

    v = op3_sentencepiece.Vocabulary.load()
    encoder = op3_sentencepiece.Encoder(v)
    model = sentencepiece.SentencePieceProcessor(model_file=op3_sentencepiece.MODEL)
    texts = [t for _, t in documents[:200]]
    own = sum(len(encoder.encode(t)) // 4 for t in texts)
    assert own <= 1.03 * sum(len(ids) for ids in model.encode(texts))


@pytest.mark.parametrize(("words", "percent"), [(4, 80), (5, 80), (2, 60)])
def test_components_equal_those_of_all_pairs(spark, documents, words, percent):
    rng = random.Random(words)
    base = [f"w{rng.randint(0, 60)}" for _ in range(60)]
    copies = []
    for k in range(150):  # a group of near copies, many close to the threshold
        own = base[:]
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(own))
            own[at : at + 1] = rng.choice([[], ["other"], ["w1", "w2"]])
        copies.append((10_000 + k, " ".join(own)))
    rows = documents + copies
    found = op4_setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), op4_setsketch.Rule(words, percent))
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in found.collect()}
    assert got == {d: (c, len(plain.shingles(dict(rows)[d], words))) for d, c in plain.near_components(rows, words, percent).items()}


def test_registers_tell_similarity():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8):
        common, a, b = (np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (int(4000 * share), int(2000 * (1 - share)), int(2000 * (1 - share))))
        sets = [np.concatenate([common, x]) for x in (a, b)]
        one, two = op4_setsketch.registers(sets)
        true = len(common) / (len(common) + len(a) + len(b))
        similarity, _ = op4_setsketch.estimate(one[None], two[None], np.array([len(sets[0])]), np.array([len(sets[1])]), 80)
        assert abs(similarity[0] - true) < 0.15
        both = op4_setsketch.registers([np.unique(np.concatenate(sets))])[0]
        assert np.array_equal(both, np.maximum(one, two))  # sketches merge


def test_base_patterns_equal_plain_search(documents):
    rng = random.Random(1)
    texts = ["".join(rng.choice("1234567890.@+- ()ab-.@1") for _ in range(rng.randint(0, 45))) for _ in range(20000)]
    assert all(op5_pii.base_spans(t) == plain.personal(t) for t in texts + [t for _, t in documents])
    assert op5_pii.base_spans("9" * 300_000 + "a" * 300_000 + "@" * 1000) == {"email": [], "ip": [], "card": [], "phone": []}


def test_contexts_find_unseen_identifiers(spark):
    rows = [(k, f"Filler words number. Reach desk phone +1 (202) 555-{1000 + k} now") for k in range(8)]
    rows += [(20, "Reach desk phone 555 0199 77 now"), (21, "The total of 555 0199 78 apples")]
    found = {r["doc_id"]: r for r in op5_pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [rows[8][1][s["start"] : s["end"]] for s in found[20]["spans"]] == ["555 0199 77"]
    assert found[20]["n_phone"] == 0 and found[21]["spans"] == [] and found[3]["n_phone"] == 1
    clean = {r["doc_id"]: r["text"] for r in op5_pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[20] == "Reach desk phone [phone] now" and "555" not in clean[3] and clean[21] == rows[9][1]


def test_contexts_reach_many_unseen_identifiers_and_on_from_them(spark):
    contexts = ["alpha", "bravo", "carol", "delta", "eagle", "fancy"]
    rows = [f"Reach alpha +1 (202) 555-{1000 + k} now" for k in range(8)]
    rows += [f"Some alpha 555 0100 {k} now" for k in range(10, 14)]
    # Each context shares three unseen numbers with the next one, so the last is reached in the sixth round.
    for n, (one, two) in enumerate(zip(contexts, contexts[1:], strict=False)):
        rows += [f"Some {word} 555 {200 + n} 10{k} now" for k in range(3) for word in (one, two)]
    rows += ["Some fancy 555 0900 77 now", "The total of 555 0199 78 apples"]
    # Servers' addresses are of a known kind, so they do count against the context of three numbers.
    rows += [f"Item zebra +1 (303) 555-{1000 + k} now" for k in range(3)] + [f"Item zebra 10.100.100.{100 + k} now" for k in range(9)]
    rows += ["Item zebra 555 0300 88 now"]
    found = op5_pii.find(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    spans = {r["doc_id"]: [rows[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"]] for r in found}
    assert {k for k, own in spans.items() if not own} == {rows.index("The total of 555 0199 78 apples"), rows.index("Item zebra 555 0300 88 now")}
    assert spans[rows.index("Some fancy 555 0900 77 now")] == ["555 0900 77"]


def test_personal_data_digest(spark, testdata, documents):
    texts = dict(documents)
    for r in all_queries()["op5_pii"](spark, f"{testdata}/{SCALE}").collect():
        base = plain.personal(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{s}:{e}" for k, own in base.items() for s, e in own)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(r["spans"].split(",")) or not joined


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_exchanged_words_do_not_hide_an_item(spark, monkeypatch, broadcast):
    monkeypatch.setattr(op6_spaced_seeds, "BROADCAST_SEEDS", broadcast)
    item = [f"Item{k}" for k in range(30)]
    changed = item[:]
    for k in (4, 11, 18, 25):
        changed[k] = "other"
    texts = ["intro " + " ".join(item) + " end", "a b c " + ", ".join(changed), " ".join(item[:8]) + " and more of the same words", " ".join(reversed(item))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = op6_spaced_seeds.overlaps(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["score"], r["shift"]) for r in found) == [(0, 7, 30, 1), (1, 7, 18, 3)]


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_short_items_are_found_whole(spark, monkeypatch, broadcast):
    monkeypatch.setattr(op6_spaced_seeds, "BROADCAST_SEEDS", broadcast)
    nine, long = [f"n{k}" for k in range(9)], [f"L{k}" for k in range(20)]
    items = [(1, "Paris"), (2, "who wrote it?"), (3, " ".join(nine)), (4, " ".join(long)), (5, "什么是水，水从哪里来。"), (6, "?!"), (7, None)]
    texts = ["so who wrote it", "Who, wrote: IT", "x " * 30 + " ".join(long + nine) + " y", "who wrote that", " ".join(nine[:8]), "paris", "答：什么是水，水从哪里来？", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = op6_spaced_seeds.overlaps(docs, benchmark).collect()
    pairs = sorted((r["doc_id"], r["item_id"], r["score"], r["shift"]) for r in found)
    assert pairs == [(0, 2, 3, 1), (1, 2, 3, 0), (2, 3, 9, 50), (2, 4, 20, 30), (5, 1, 1, 0), (6, 5, 2, 1)]
    assert sorted(r["doc_id"] for r in op6_spaced_seeds.decontaminate(docs, benchmark).collect()) == [3, 4, 7, 8]


def _phrases(text: str, sample: str) -> int:
    count = at = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and end - at < op7_language.BLOCK and text[at : end + 1] in sample:
            end += 1
        at, count = end, count + 1
    return count


def test_phrases_equal_a_plain_parse():
    rng = random.Random(4)
    samples = {x: "".join(rng.choice(letters) for _ in range(400)) for x, letters in (("a", "abc "), ("b", "bcd "))}
    samples = {k: op7_language.normalised(v) for k, v in samples.items()}
    automata = op7_language.build(samples)
    texts = ["".join(rng.choice("abcdé 1") for _ in range(rng.randint(1, 300))) for _ in range(60)]
    counts, sizes, _ = op7_language.phrases(texts, automata)
    for k, text in enumerate(texts):
        own = op7_language.normalised(text)
        if any(c.isalpha() for c in own):
            assert sizes[k] == len(own)
            assert counts[k].tolist() == [_phrases(own, samples[x]) for x in automata.languages], text


@pytest.mark.parametrize("size", [op7_language.BLOCK - 1, op7_language.BLOCK, op7_language.BLOCK + 1, 5 * op7_language.BLOCK + 7])
def test_a_block_begins_a_phrase(size):
    rng = random.Random(size)
    samples = {x: op7_language.normalised("".join(rng.choice(own) for _ in range(400))) for x, own in (("a", "ab "), ("b", "bcd "))}
    automata = op7_language.build(samples)
    text = "".join(rng.choice("abcd") for _ in range(size))
    blocks = [text[k : k + op7_language.BLOCK] for k in range(0, size, op7_language.BLOCK)]
    counts, sizes, _ = op7_language.phrases([text, text[:40]], automata)
    assert sizes[0] == size
    assert counts[0].tolist() == [sum(_phrases(b, samples[x]) for b in blocks) for x in automata.languages]
    # One phrase more for each border at most.
    whole = [_phrases_unbounded(text, samples[x]) for x in automata.languages]
    assert all(0 <= c - w < len(blocks) for c, w in zip(counts[0].tolist(), whole))


def _phrases_unbounded(text: str, sample: str) -> int:
    count = at = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in sample:
            end += 1
        at, count = end, count + 1
    return count


@pytest.mark.parametrize("dense", [0, 1 << 23])
def test_languages_of_many_letters_are_told_apart(monkeypatch, dense):
    monkeypatch.setattr(op7_language, "DENSE", dense)
    rng = random.Random(8)
    scripts = {"en": range(0x61, 0x7B), "ja": range(0x4E00, 0x5200), "ko": range(0xAC00, 0xB200), "zh": range(0x5000, 0x5800)}
    lexicon = {x: ["".join(chr(rng.choice(own)) for _ in range(rng.randint(2, 5))) for _ in range(300)] for x, own in scripts.items()}
    prose = {x: [" ".join(rng.choices(own, k=n)) for n in (1200, 8, 40)] for x, own in lexicon.items()}
    samples = {x: op7_language.normalised(own[0]) for x, own in prose.items()}
    automata = op7_language.build(samples)
    texts = [text for x in automata.languages for text in prose[x][1:]] + ["日本 mixed 中文 𐍈 z"]
    assert op7_language.judged(texts, automata)[0][:-1] == [x for x in automata.languages for _ in range(2)]
    counts = op7_language.phrases(texts, automata)[0]
    for k, text in enumerate(texts):
        assert counts[k].tolist() == [_phrases(op7_language.normalised(text), samples[x]) for x in automata.languages]


def test_languages_of_short_or_long_texts_are_learnt(spark):
    rng = random.Random(9)
    lexicon = {x: ["".join(rng.choice(own) for _ in range(rng.randint(2, 6))) for _ in range(80)] for x, own in (("book", "abcdef"), ("title", "defghi"), ("usual", "ghijkl"))}
    words = {"book": 2000, "title": 4, "usual": 60}
    rows = [(k, x, "... " + " ".join(rng.choices(lexicon[x], k=words[x]))) for k, x in enumerate(["book"] * 8 + ["title"] * 1500 + ["usual"] * 100)]
    rows += [(5000 + k, "title", "12 345") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert op7_language.sample_sizes(op7_language.labelled(docs)) == {"book": 60, "title": 3840, "usual": 60}
    automata = op7_language.learn(docs)
    assert automata.languages == ["book", "title", "usual"]
    assert min(automata.bits) > 13  # each has learnt from over 8,192 characters
    texts = [" ".join(rng.choices(lexicon[x], k=10)) for x in automata.languages]
    assert op7_language.judged(texts, automata)[0] == automata.languages


def test_language_of_held_out_rows(spark, testdata):
    directory = f"{testdata}/sf0.01"
    lang = spark.read.parquet(f"{directory}/documents.parquet").select("doc_id", "lang")
    rows = all_queries()["op7_language"](spark, directory).join(lang, "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)


def test_suffixes_come_out_in_order():
    rng = np.random.default_rng(2)
    for letters in (1, 2, 3, 250):
        for n in (1, 2, 50, 400):
            text = rng.integers(0, letters, n).astype(np.uint8)
            data = text.tobytes()
            order = op9_suffix_dedup.suffix_array(text, 100)
            assert sorted(order.tolist()) == list(range(n))
            keys = [data[k : k + 100] for k in order]
            assert all(a <= b for a, b in zip(keys, keys[1:], strict=False))


@pytest.mark.parametrize("group", [3, 20_000])
def test_repeated_bytes_equal_those_of_a_plain_search(spark, monkeypatch, documents, group):
    monkeypatch.setattr(op9_suffix_dedup, "GROUP", group)
    rng = random.Random(6)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = [(d, t) for d, t in documents[:60]]
    for k in range(40):
        a, b = sorted(rng.sample(range(300), 2))
        rows.append((5000 + k, "".join(rng.choice("xyz ") for _ in range(60)) + shared[a:b] + "é" * rng.randint(0, 80) + shared[a // 2 : b]))
    rows.append((6000, "ab" * 400))
    found = op9_suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("digest", F.sha2("kept", 256))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["digest"]) for r in found.collect()}
    assert got == plain.without_repeats(rows, 100)


def test_near_copies_among_texts_that_share_an_id(spark):
    def words(k: int, n: int = 40) -> str:
        return " ".join(f"w{j}" for j in range(k, k + n))

    rows = [
        (3, words(0)), (5, words(0) + " end"), (5, words(1000)), (5, words(1000) + " end"), (6, words(2000)),
        (None, words(2000) + " end"), (None, words(3000)), (None, words(3000) + " end"), (None, words(4000)), (7, words(1000).upper()),
        (2, words(5000, 60)), (2, words(5000, 60)), (1, "end " + words(5000, 60)), (None, None), (None, ""), (9, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({name: F.lit(1) for name in plain.CLASHING})
    found = op4_setsketch.near_duplicates(docs, op4_setsketch.Rule(5, 80)).select("doc_id", "n_shingles", "component_id")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    expected = [
        (3, 36, 3), (5, 37, 3), (5, 36, 5), (5, 37, 5), (6, 36, 6), (None, 37, 6), (None, 36, None), (None, 37, None), (None, 36, None),
        (7, 36, 5), (2, 56, 1), (2, 56, 1), (1, 57, 1), (None, 0, None), (None, 0, None), (9, 0, 9),
    ]
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(expected, key=key)
    left = op4_setsketch.without_copies(docs)
    assert left.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert (3, words(0)) in kept and (6, words(2000)) in kept and (None, words(4000)) in kept
    assert {(None, None), (None, ""), (9, None), (1, "end " + words(5000, 60))} <= set(kept)
    # One of the two texts of id 5 that are near copies stays, and one of the two without an id.
    assert [d for d, t in kept if t and t.startswith("w1000 ")] == [5] and len(kept) == 9
    assert [d for d, t in kept if t and t.startswith("w3000 ")] == [None]


def test_pages_of_one_template_are_not_all_paired(spark):
    # 15 % of their shingles are their own: less alike than the threshold, yet each shares the template with all.
    rng = np.random.default_rng(4)
    template = rng.integers(0, 2**62, 400)
    sets = [(k, k, np.concatenate([template, rng.integers(0, 2**62, 70)]).tobytes()) for k in range(300)]
    alike = [(k + 1000, k + 1000, np.concatenate([template, np.frombuffer(sets[k][2], np.int64)[400:450], rng.integers(0, 2**62, 20)]).tobytes()) for k in range(5)]
    df = spark.createDataFrame(sets + alike, "node long, component long, shingles binary")
    pairs = {(r["a"], r["b"]) for r in op4_setsketch.remaining_pairs(df, op4_setsketch.Rule()).collect()}
    assert pairs == {(k, k + 1000) for k in range(5)}


@pytest.mark.parametrize("group", [3, 20_000])
def test_texts_that_share_an_id_lose_only_what_they_repeat(spark, monkeypatch, group):
    monkeypatch.setattr(op9_suffix_dedup, "GROUP", group)
    rng = random.Random(8)

    def own(n: int) -> str:
        return "".join(rng.choice("abcdefgh ") for _ in range(n))

    shared, other, bare = own(350), own(350), own(350)
    rows = [(0, shared), (1, own(50) + shared), (1, other), (2, other[:200]), (None, bare), (None, own(400)), (None, own(9) + bare), (1, other)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in op9_suffix_dedup.remove_repeats(df).collect())
    assert found[:4] == [("0", 350, 0), ("1", 350, 0), ("1", 350, 0), ("1", 400, 350)] and found[4] == ("2", 200, 200)
    # Of two texts without an id that share a string, one has it removed; the third is left alone.
    assert found[7] == ("None", 400, 0) and found[5][2] + found[6][2] == 350


def test_repeated_passages_of_few_sentences_and_rows_that_share_an_id(spark):
    def sentence(start: int, words: int) -> str:
        return " ".join(f"w{k}" for k in range(start, start + words)) + "."

    two, one, three = f"{sentence(0, 20)} {sentence(20, 15)}", sentence(100, 40), " ".join(sentence(200 + 9 * k, 9) for k in range(3))
    short, pair = sentence(300, 10), f"{sentence(310, 9)} {sentence(320, 9)}"
    own = iter(range(1000, 9000, 5))

    def among(*parts: str) -> str:
        return " ".join(x for part in parts for x in (sentence(next(own), 5), part)) + f" {sentence(next(own), 5)}"

    rows = [
        (0, among(two, one, three, short, pair)),
        (1, among(two)), (2, among(one)), (3, among(three)), (4, among(short)), (5, among(pair)),
        (6, among("of its own") + "\n" + sentence(600, 30)), (6, among(two)),  # one id, two texts
        (None, among(one)), (None, among("no id either")), (None, among(one)), (7, pair), (8, pair),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({name: F.lit(1) for name in plain.CLASHING})
    found = sorted((str(r["doc_id"]), r["n_sentences"], r["removed"]) for r in op10_sentence_spans.remove_repeats(df).collect())
    gone = {"1": [1, 2], "2": [1], "3": [1, 2, 3], "4": [], "5": [], "7": [], "8": [0, 1]}
    assert all(removed == gone[d] for d, _, removed in found if d in gone)
    assert [removed for d, _, removed in found if d == "6"] == [[], [1, 2]]
    # A null id comes first, so of the rows with `one` a row without an id keeps it.
    assert sorted(removed for d, _, removed in found if d == "None") == [[], [], [1]]
    assert [removed for d, _, removed in found if d == "0"] == [[4]]

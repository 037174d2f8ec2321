"""Every operator on nulls, empty and long texts, ties, repeated rows, clashing columns, and tables without rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from milepost.llm import (
    op1_reshard,
    op2_toxicity,
    op3_sentencepiece,
    op4_setsketch,
    op5_pii,
    op6_spaced_seeds,
    op7_language,
    op8_quality,
    op9_suffix_dedup,
    op10_sentence_spans,
)
from milepost.llm.common import shared_folder
from tests.llm import plain
from tests.llm.plain import odd_documents

LABELS = "doc_id long, toxic int, words int"


def _labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, None, 0), (None, 1, 0), (5, 0, 0), (5, 1, 0)], LABELS)


def _items(spark):
    rows = [(0, None), (1, ""), (None, "la " * 20), (2, "no id but some words in a row here and there")]
    return spark.createDataFrame(rows, "item_id long, text string")


ROWWISE = {
    "op1": lambda s, d: op1_reshard.with_slots(op1_reshard.reshard(d, F.col("source"), 4)[0]),
    "op2": lambda s, d: op2_toxicity.score(d, op2_toxicity.fit(d, _labels(s))),
    "op3": lambda s, d: op3_sentencepiece.tokenize(d),
    "op4": lambda s, d: op4_setsketch.near_duplicates(d),
    "op5": lambda s, d: op5_pii.redact(d),
    "op7": lambda s, d: op7_language.predict(d, op7_language.learn(d)),
    "op8": lambda s, d: op8_quality.quality(d),
    "op9": lambda s, d: op9_suffix_dedup.remove_repeats(d),
    "op10": lambda s, d: op10_sentence_spans.remove_repeats(d),
}


@pytest.mark.parametrize("name", sorted(ROWWISE))
def test_one_row_for_each_row(spark, name):
    docs = odd_documents(spark)
    found = ROWWISE[name](spark, docs).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r["doc_id"]) for r in docs.collect())
    assert ROWWISE[name](spark, odd_documents(spark, 0)).count() == 0


def test_defined_results(spark):
    docs = odd_documents(spark)
    by_id = lambda df: {r["doc_id"]: r for r in df.collect()}
    near = by_id(ROWWISE["op4"](spark, docs))
    assert near[0]["n_shingles"] == near[1]["n_shingles"] == near[2]["n_shingles"] == 0
    assert near[7]["component_id"] == 6 and near[10]["component_id"] == 10 and near[2]["component_id"] == 2
    language = by_id(ROWWISE["op7"](spark, docs))
    assert [language[k]["lang_pred"] for k in (0, 1, 2, 4)] == ["und"] * 4 and language[0]["score"] == 0
    tokens = by_id(op3_sentencepiece.tokenize(docs))
    assert tokens[0]["ids"] is None and tokens[1]["ids"] == [] and all(tokens[k]["decoded"] == t for k, t in enumerate(r["text"] for r in docs.orderBy("doc_id").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()))
    repeats = by_id(ROWWISE["op9"](spark, docs))
    assert repeats[8]["n_removed"] == 4999 and repeats[10]["n_removed"] == 0 and repeats[0]["n_bytes"] == 0
    sentences = by_id(ROWWISE["op10"](spark, docs))
    assert sentences[7]["removed"] == [0, 1] and sentences[6]["removed"] == [] and sentences[0]["n_sentences"] == 0
    quality = by_id(ROWWISE["op8"](spark, docs))
    assert not quality[0]["kept"] and quality[9]["n_repeat_words"] == 6000


def test_contamination(spark):
    docs, items = odd_documents(spark), _items(spark)
    pairs = {(r["doc_id"], r["item_id"]) for r in op6_spaced_seeds.overlaps(docs, items).collect()}
    assert pairs == {(9, None)}
    assert op6_spaced_seeds.overlaps(odd_documents(spark, 0), items).count() == 0
    assert op6_spaced_seeds.overlaps(docs, items.limit(0)).count() == 0
    left = op6_spaced_seeds.decontaminate(docs, items)
    assert left.columns == docs.columns and left.count() == docs.count() - 1


def test_only_the_contaminated_text_of_an_id_goes(spark):
    item = " ".join(f"w{k}" for k in range(20))
    rows = [(1, f"before {item} after"), (1, "clean text"), (None, item), (None, "clean too"), (None, None), (2, "clean")]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string")
    docs = docs.withColumns({name: F.lit(1) for name in plain.CLASHING + ["_bad_key"]})
    items = spark.createDataFrame([(5, item), (6, None)], "item_id long, text string")
    left = op6_spaced_seeds.decontaminate(docs, items)
    assert left.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert sorted(kept, key=str) == sorted([rows[1], rows[1], rows[3], rows[4], rows[5]], key=str)
    assert {(r["doc_id"], r["item_id"]) for r in op6_spaced_seeds.overlaps(docs, items).collect()} == {(1, 5), (None, 5)}


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = odd_documents(spark)
    _items(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    first, second = (f for _, f in corpus_pipeline.STAGES[:2])
    kept = first(spark, docs, "")
    assert {r["doc_id"] for r in docs.drop("lang").exceptAll(kept.drop("lang")).collect()} == {0, 1, 2, 4}
    # A row without a language has the one that was found, which is the only one learnt; others keep theirs.
    assert docs.where("lang IS NULL").count() > 4 and {r["lang"] for r in kept.collect()} == {"en"}
    # Columns of the caller keep their values, whatever they are called.
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, docs, str(tmp_path)).select(*plain.CLASHING).distinct().collect() == [(1,) * len(plain.CLASHING)]
    # The copy of 6 goes, and two of the three equal rows.
    assert sorted(str(r["doc_id"]) for r in docs.exceptAll(second(spark, docs, "")).collect()) == ["10", "10", "7"]


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    class Context:
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = {}

    Context.master = master
    with pytest.raises(ValueError, match="spark.checkpoint.dir is not set"):
        shared_folder(Session())

"""What a Python worker holds between tasks, measured in a process of its own that does a stage's work without Spark."""

from __future__ import annotations

import random
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark import cloudpickle

from milepost.llm import op3_sentencepiece, op4_setsketch, op7_language, vectors

#: Reads functions for mapInArrow and a stream of batches; prints the MB that are held more once each has been at work, and which encoders are.
WORKER = r"""
import gc, pickle, re, sys
import pyarrow as pa, pyarrow.compute
works, data = pickle.load(sys.stdin.buffer)
works = [pickle.loads(w) for w in works]

def held():
    gc.collect()
    found = re.findall(r"\n(?:Private_Dirty|Swap):\s+(\d+)", open("/proc/self/smaps_rollup").read())
    return sum(map(int, found)) / 1024

def batches():
    for batch in pa.ipc.open_stream(data):
        yield batch

before = held()
for work in works:
    for _ in work(batches()):
        pass
    _ = None
print(held() - before, sum(type(x).__name__ == "Encoder" for x in gc.get_objects()))
"""


class Captured:
    """Stands for a DataFrame and its session, and returns the function given to mapInArrow."""

    def __init__(self, df):
        self.schema, self.sparkSession = df.schema, SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))

    def select(self, *columns):
        return self

    def mapInArrow(self, work, schema):  # noqa: N802
        return work


def worker(works, batch: pa.RecordBatch) -> tuple[float, int]:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        for _ in range(2):
            stream.write_batch(batch)
    given = cloudpickle.dumps(([cloudpickle.dumps(w) for w in works], sink.getvalue().to_pybytes()))
    root = Path(__file__).resolve().parents[2]
    done = subprocess.run([sys.executable, "-c", WORKER], input=given, capture_output=True, cwd=root, check=True)
    mb, encoders = done.stdout.split()
    return float(mb), int(encoders)


@pytest.fixture(scope="module")
def texts() -> list[str]:
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(5000)]
    return [" ".join(rng.choices(words, k=400)) for _ in range(6000)]


@pytest.fixture(scope="module")
def docs(spark):
    return Captured(spark.createDataFrame([], "doc_id long, text_key long, lang string, text string"))


@pytest.fixture(scope="module")
def batch(texts) -> pa.RecordBatch:
    ids = pa.array(range(len(texts)))
    return pa.RecordBatch.from_arrays([ids, ids, pa.array(["en"] * len(texts)), pa.array(texts)], ["doc_id", "text_key", "lang", "text"])


def test_freed_memory_goes_back(docs, texts, batch):
    automata = op7_language.build({"en": op7_language.normalised(" ".join(texts[:20]))})
    for work in (op7_language.with_language(docs, automata), op4_setsketch.sketches(docs, op4_setsketch.Rule())):
        assert worker([work], batch)[0] < 60


def test_other_work_drops_the_encoder(docs, texts, batch):
    tokens, sketches = op3_sentencepiece.tokenize(docs), op4_setsketch.sketches(docs, op4_setsketch.Rule())
    few = batch.slice(0, 50)
    assert worker([tokens], few)[1] == 1
    assert worker([tokens, sketches], few)[1] == 0


def test_parts_are_all_rows_in_order():
    texts = ["a" * 30, None, "é" * 40, "", "b" * 200, "c", None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]).slice(1)
    for limit in (1, 50, 10**6):
        found = list(vectors.parts(batch, limit))
        assert [x for p in found for x in p.column("text").to_pylist()] == texts[1:]
        for p in found:
            assert p.num_rows == 1 or sum(len((x or "").encode()) for x in p.column("text").to_pylist()) <= limit
    assert not list(vectors.parts(batch.slice(0, 0)))

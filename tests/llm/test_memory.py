"""What the pipeline's operators keep in a worker, and hand to it at once."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from tests.llm import util as U
from tillroll.llm import common, decontaminate, jaccard, pieces, quality


@pytest.fixture
def unbounded(spark):
    before = spark.conf.get(common.BATCH, None)
    spark.conf.unset(common.BATCH)
    yield spark
    spark.conf.unset(common.BATCH) if before is None else spark.conf.set(common.BATCH, before)


def test_one_model_in_a_worker():
    """The model of the next operator, or of a new run, takes the place of the one before."""
    made = []
    load = lambda x: lambda: made.append(x) or [x]
    first = common.worker_model("a", load("a"))
    assert common.worker_model("a", load("a")) is first and made == ["a"]
    assert common.worker_model("b", load("b")) == ["b"] and list(common._MODELS) == ["b"]
    assert common.worker_model() is None and not common._MODELS
    assert common.worker_model("a", load("a")) is not first and made == ["a", "b", "a"]
    common.worker_model()


@pytest.mark.parametrize("stage", [
    lambda d: quality.score(d, None), lambda d: quality.measure(d), lambda d: pieces.encode(d), jaccard.one_of_each,
    lambda d: decontaminate.scan(d, d.selectExpr("CAST(doc_id AS string) AS item_id", "text").limit(1))])
def test_texts_go_to_workers_in_bounded_batches(unbounded, stage):
    """Also when the caller runs the plan, after the operator has returned it."""
    docs = unbounded.createDataFrame([(1, "one two three four five six"), (2, "one two")], U.SCHEMA)
    done = stage(docs)
    assert unbounded.conf.get(common.BATCH) == str(common.BATCH_BYTES)
    assert done.count() == 2


def test_the_sessions_own_bound_stays(unbounded):
    unbounded.conf.set(common.BATCH, "123456")
    quality.measure(unbounded.createDataFrame([(1, "one two")], U.SCHEMA))
    assert unbounded.conf.get(common.BATCH) == "123456"


def test_texts_are_measured_in_small_slices(monkeypatch):
    """No more than half a megabyte of text is worked on at once, with the same figures."""
    taken, real = [], quality.text_buffer
    monkeypatch.setattr(quality, "text_buffer", lambda col: taken.append(sum(map(len, col.to_pylist()))) or real(col))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "text": [f"word{i} and more " * 500 for i in range(300)]})

    class Docs:
        sparkSession = type("S", (), {"conf": {common.BATCH: "1"}})
        schema = {"doc_id": T.StructField("doc_id", T.LongType())}

        def select(self, *names):
            return self

        def mapInArrow(self, run, out):
            return list(run([batch]))

    got = pa.Table.from_batches(quality.measure(Docs()))
    assert sum(taken) > 2 << 20 and max(taken) <= 512 << 10
    assert got.column("doc_id").to_pylist() == list(range(300))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 500])
def test_repeats(n):
    rng = np.random.default_rng(n)
    for _ in range(20):
        x = rng.integers(-n // 3 - 1, n // 3 + 1, n)
        token, count = np.unique(x, return_counts=True)
        got = jaccard.repeats(x)
        assert got[0].tolist() == token[count > 1].tolist() and got[1].tolist() == count[count > 1].tolist()

"""What the Jaccard join and its pipeline stage move between tasks and leave on disk."""

import glob
import random

import numpy as np

import corpus_pipeline
from tests.llm import util as U
from tillroll.llm import jaccard
from tillroll.llm import windows as W
from tillroll.llm.common import discard, written
from tillroll.session import local_path, shared_dir


def near_copies(groups=30):
    rnd, rows = random.Random(5), []
    for g in range(groups):
        words = [f"g{g}w{i}" for i in range(60)]
        for k in range(3):
            rows.append((10 * g + k, " ".join([*words[:59], f"x{k}"])))
        rows.append((10 * g + 5, " ".join(rnd.choices(words, k=60))))
    return rows


def test_sets_are_dealt_out_once(spark, monkeypatch):
    """The sets of nodes are joined by node in every round without being shuffled again."""
    plans, real = [], jaccard.open_groups

    def watched(members, queries, stored, percent):
        plan = stored.join(members.hint("shuffle_merge"), "node")._jdf.queryExecution().executedPlan().toString()
        plans.append(plan.count("Exchange hashpartitioning(node"))
        return real(members, queries, stored, percent)

    monkeypatch.setattr(jaccard, "open_groups", watched)
    rows = near_copies()
    got = jaccard.report(spark.createDataFrame(rows, U.SCHEMA)).collect()
    assert U.order(got) == U.order(U.jaccard(rows))
    assert plans == [1, 1, 1]  # of the members alone


def test_frames_in_buckets(spark):
    """A frame written by key comes back whole, and discard takes its files and its name."""
    df = spark.range(500).selectExpr("id", "IF(id % 9 = 0, NULL, id % 7) AS k")
    back = written(df, "buckets", "k")
    name, = [t.name for t in spark.catalog.listTables() if t.name.startswith("buckets_")]
    assert U.order(tuple(r) for r in back.collect()) == U.order(tuple(r) for r in df.collect())
    discard(back)
    assert not spark.catalog.tableExists(name)


def test_bitmap_probes(spark):
    """Every hash in a bitmap is found, and few others are."""
    h = np.array([r[0] for r in spark.range(100_000, 400_000).selectExpr("xxhash64(id)").collect()], np.int64)
    held = spark.range(100_000, 300_000).selectExpr("xxhash64(id) AS h")
    rates = []
    for probes in (1, jaccard.PROBES):
        got = W.may_have(W.bitmap(held, "h", probes), h, probes)
        assert got[:200_000].all()
        rates.append(got[200_000:].mean())
    assert rates[1] < 0.05 and rates[1] < rates[0] / 2


def test_the_stage_leaves_no_texts(spark):
    """Once the stage's rows are found, its files hold keys only, not the documents."""
    base = local_path(shared_dir(spark, "x")).rsplit("/", 1)[0]
    seen = set(glob.glob(f"{base}/**/part-*", recursive=True))
    docs = spark.createDataFrame([(i, t, "en", "web") for i, t in near_copies()], U.SCHEMA + ", lang string, source string")
    out = corpus_pipeline.ngram_jaccard_join(spark, docs, "")
    columns = [c for p in set(glob.glob(f"{base}/**/part-*", recursive=True)) - seen for c, kind in spark.read.parquet(p).dtypes
               if kind == "string" or "array" in kind]
    assert out.count() == len({r[2] for r in U.jaccard([tuple(r)[:2] for r in docs.collect()], 5, 80)})
    assert columns == []


def test_one_of_rows_with_one_id(spark):
    """Of linked rows of the smallest id the least by value stays, once; nulls in other columns tell rows apart."""
    line = " ".join(f"w{i}" for i in range(60))
    near, other = line + " x", " ".join(f"v{i}" for i in range(60))
    rows = [(1, near, "b", None), (1, line, None, "b"), (1, line, "b", None), (1, line, None, "b"), (4, line, "a", "a"), (None, near, "a", "a"),
            (None, other, None, None), (None, other, None, None), (7, "", "a", "a"), (7, "", "a", "a"), (7, None, None, None)]
    docs = spark.createDataFrame(rows, U.SCHEMA + ", lang string, source string")
    got = jaccard.one_of_each(docs, 5, 80).collect()
    want = [(1, line, None, "b"), (None, other, None, None), (7, "", "a", "a"), (7, "", "a", "a"), (7, None, None, None)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))

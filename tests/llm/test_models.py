"""Learned operators and the pipeline: accuracy, round trips, decisions."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tests.llm import util as U
from tillroll.llm import language, pieces, quality
from tillroll.llm.common import table

SF = "/root/testdata/sf0.001"


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    net = language.Network(["a", "b", "c"])
    x, y = rng.integers(0, 256, (6, 5)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    _, grads = net.gradients(x, y)
    for p, g in zip(net.params(), grads):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = p[i], 1e-2
        p[i] = old + step
        up = net.gradients(x, y)[0]
        p[i] = old - step
        down = net.gradients(x, y)[0]
        p[i] = old
        assert abs((up - down) / (2 * step) - g[i]) < 0.05 * abs(g[i]) + 1e-4


def test_language(spark):
    docs = table(spark, SF, "documents")
    net = language.train(language.training_windows(docs))
    truth = {r["doc_id"]: (r["lang"], len(r["text"] or "")) for r in docs.select("doc_id", "lang", "text").collect()}
    got = {r["doc_id"]: r for r in language.identify(docs, net, ["doc_id"]).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0 and truth[i][1] > 40]
    assert np.mean([got[i]["lang_pred"] == truth[i][0] for i in held]) > 0.9
    edge = language.identify(U.edge(spark), net, ["doc_id", "text"]).collect()
    assert len(edge) == len(U.EDGE)
    for r in edge:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] in net.labels) if letters else (r["lang_pred"], r["score"]) == ("und", 0.0)
        assert 0 <= r["score"] <= 1
    assert language.training_windows(docs.limit(0)) == [] and language.train([]) is None
    assert {r["lang_pred"] for r in language.identify(U.edge(spark), None).collect()} == {"und"}


def test_em_finds_accuracies():
    rng = np.random.default_rng(0)
    bad = rng.random(20_000) < 0.3
    votes = []
    for acc, cover in ((0.95, 0.8), (0.8, 0.9), (0.7, 0.6), (0.9, 0.5)):
        right = rng.random(len(bad)) < acc
        votes.append(np.where(rng.random(len(bad)) < cover, np.where(right, bad, ~bad).astype(int), quality.NONE))
    pats, counts = np.unique(np.stack(votes, 1), axis=0, return_counts=True)
    _, acc, prior = quality.em(pats, counts)
    assert np.abs(acc - [0.95, 0.8, 0.7, 0.9]).max() < 0.05 and abs(prior - 0.3) < 0.05


def test_quality(spark):
    """Low-quality and toxic documents go, clean ones stay."""
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.train(docs, labels)
    rows = quality.score(docs, model, ["doc_id"]).join(labels, "doc_id").collect()
    clean = [r["keep"] for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    rest = [r["keep"] for r in rows if r["quality"] == 0 or r["toxic"] == 1]
    assert np.mean(clean) > 0.95 and np.mean(rest) < 0.2
    edge = quality.score(U.edge(spark), model).collect()
    assert len(edge) == len(U.EDGE) and not any(r["keep"] for r in edge if not (r["text"] or "").split())
    assert quality.train(docs.limit(0)) is None
    assert all(r["keep"] == bool((r["text"] or "").split()) for r in quality.score(U.edge(spark), None).collect())


def test_few_labels_do_not_replace_the_other_documents(spark):
    """A labels table of a few rows leaves unlabelled documents in the training sample."""
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    few = labels.where("doc_id % 20 = 0")
    rows = quality.score(docs, quality.train(docs, few), ["doc_id"]).join(labels, "doc_id").collect()
    assert 0 < few.count() < 50 and np.mean([r["keep"] for r in rows if r["quality"] == 1 and r["toxic"] == 0]) > 0.95


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    with open(pieces.MODEL, "rb") as f:
        t = pieces.Transducer.load(f.read())
    rnd = random.Random(0)
    letters = "abcdetihs  \n\té𝔘▁.,<0x>A1" + "etaoin " * 3
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    texts += [" " * n + "x" for n in range(40)] + ["a" * 3000, "".join(rnd.choice(list(t.arcs)) for _ in range(300)).replace("▁", " ")]
    assert t.encode_all(texts) == lib.encode(texts)
    assert [t.encode(x) for x in texts[:500]] == lib.encode(texts[:500])
    assert [t.decode(t.encode(x)) for x in texts] == [x.replace("▁", " ") for x in texts]
    rows = pieces.report(U.edge(spark)).collect()
    assert all(r["round_trip"] for r in rows)
    assert U.order((r["doc_id"], str(r["ids"])) for r in rows) == U.order((i, str(None if x is None else lib.encode(x))) for i, x in U.EDGE)


def test_unigram_shortest_path():
    t = pieces.Transducer([("<unk>", 0, 2), ("a", -1.0, 1), ("b", -1.5, 1), ("ab", -2.0, 1), ("▁a", -1.2, 1), ("ba", -1.9, 1), ("▁", -3.0, 1)], False)

    def best(s):
        if not s:
            return (0.0, ())
        return min((best(s[:-n])[0] - t.score[t.arcs[s[-n:]]], best(s[:-n])[1] + (t.arcs[s[-n:]],)) for n in (1, 2) if s[-n:] in t.arcs)

    for text in ("abab", "ba ab", "aabb", "b a"):
        assert tuple(t.encode(text)) == best(t.normalise(text))[1]


@pytest.fixture(scope="module")
def stages(spark):
    from tillroll.llm.common import written
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, SF), "test-stage")
        out.append((name, before, docs))
    return out


def test_pipeline_stages(spark, stages):
    for name, before, after in stages[:-1]:
        assert after.columns == before.columns, name
    _, before, after = stages[1]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    want = {i for i, _, c in U.jaccard(rows, 5, 80) if i == c}
    assert {r["doc_id"] for r in after.collect()} == want and after.count() == len(want)
    _, before, after = stages[2]
    bench = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert {r["doc_id"] for r in after.collect()} == {r[0] for r in U.contaminated(rows, bench) if not r[-1]}
    _, before, after = stages[3]
    assert after.count() == before.count()
    assert all(r[1:4] == (0, 0, 0) for r in U.secrets([(r["doc_id"], r["text"]) for r in after.collect()]))
    _, before, after = stages[4]
    assert after.count() == before.count()


def test_pipeline_edge_rows(spark):
    """Every stage takes nulls, empty and repeated rows, clashing columns and no rows at all."""
    docs, extra = U.clashing(spark)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns or name == corpus_pipeline.STAGES[-1][0]
        assert got.count() <= len(U.EDGE)
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_long_texts_without_spaces(spark):
    """A text of 5 MB without a space, and one of 2 MB of one letter, encode whole and come back."""
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("etaoinshrdlué") for _ in range(400_000)), "x" * 2_000_000]
    texts.append(texts[0] * 12)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pieces.report(docs).collect()}
    assert all(got[i]["round_trip"] for i in range(3))
    assert got[0]["ids"] == lib.encode(texts[0]) and got[0]["n_ids"] == len(got[0]["ids"])


def test_output_names_are_renamed(spark):
    docs = spark.createDataFrame([(1, "a", "x")], "doc_id long, text string, IDS string")
    assert pieces.encode(docs).columns == ["doc_id", "text", "in_IDS", "ids"]
    assert pieces.encode(docs, columns=["doc_id"]).count() == 1

"""Clashing column names, very long texts and benchmarks searched in passes."""

import random
import re

import pytest

from tests.llm import util as U
from tillroll.llm import bwtmerge, decontaminate, fmindex, language, pieces, pii, quality, secrets
from tillroll.llm.common import handed_on

BENCH = [("a", U.LINE), ("b", "fox the quick brown fox the quick brown fox the quick"), ("c", "two words"), (None, "w1 w2 w3")]
OPERATORS = {
    "language": (lambda d: language.identify(d, None), ["lang_pred", "score"]),
    "secrets": (secrets.scan, ["spans"]),
    "bwtmerge": (bwtmerge.dedupe, ["n_bytes", "n_removed", "spans", "kept_sha256"]),
    "quality": (lambda d: quality.score(d, None), ["p_bad", "p_toxic", "keep"]),
    "fmindex": (fmindex.dedupe, ["n_words", "n_removed", "kept", "kept_sha256"]),
    "decontaminate": (lambda d: decontaminate.scan(d, d.sparkSession.createDataFrame(BENCH, "item_id string, text string")), ["n_words", "hits", "items"]),
    "pieces": (pieces.encode, ["ids"]),
    "decoded": (lambda d: pieces.decode(d.withColumn("in", F_ids(d)), ids_col="in"), ["decoded"]),
    "pii": (pii.find, ["base", "added"]),
}


def F_ids(d):
    from pyspark.sql import functions as F
    return F.array(F.lit(5).cast("int"))


def test_names_handed_on():
    assert handed_on(["a", "Score", "in_score", "b"], ["score"]) == ["a", "in_in_Score", "in_score", "b"]
    assert handed_on(["a", "b"], ["c"]) == ["a", "b"]


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_are_handed_on(spark, name):
    """All columns of docs come out beside the added ones, those of the same name as in_<name>."""
    op, added = OPERATORS[name]
    extra = [*added, "_ranges", "_items", "_key", "_id", "_c0", "key", "anchor", "kinds"]
    docs = U.edge(spark).selectExpr("*", *[f"concat('x', doc_id) as {c}" for c in extra])
    plain, got = op(U.edge(spark)), op(docs)
    assert set(got.columns) >= {*added, *[f"in_{c}" for c in added], "_ranges", "_key", "doc_id", "text"}
    assert U.order(got.select("doc_id", *added).collect()) == U.order(plain.select("doc_id", *added).collect())
    for r in got.collect():
        assert all(r[f"in_{c}"] == (None if r["doc_id"] is None else f"x{r['doc_id']}") for c in added)


def test_redact_keeps_other_columns(spark):
    docs = U.edge(spark).selectExpr("*", "'mine' as spans")
    got = secrets.redact(docs).collect()
    assert len(got) == len(U.EDGE) and all(r["spans"] == "mine" for r in got)


def redacted(text, mark="[SECRET]"):
    """Spans by the standard library, replaced from the end."""
    hit = set()
    for rule in secrets.RULES:
        for m in re.finditer(rule.pattern, text):
            if len(m.group(rule.group)) >= rule.least:
                hit.add((m.start(), m.end()))
    runs = []
    for a, z in sorted(hit):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], z)
        else:
            runs.append([a, z])
    for a, z in reversed(runs):
        text = text[:a] + mark + text[z:]
    return text


def test_texts_of_many_secrets(spark):
    """Far more secrets than are folded together, at the start, the end, touching, and between wide characters."""
    rnd = random.Random(5)
    some = ["password=abcdefgh1", "AKIAABCDEFGHIJKL12", "0af" * 12, "é𝔘", "token: shrt", "plain words", "secret=AKIAABCDEFGHIJKL12"]
    texts = [" ".join(rnd.choice(some) for _ in range(n)) for n in (1, 255, 256, 257, 1500)]
    texts += ["password=abcdefgh1 " * 600, ",".join(["0af" * 12] * 513), "x " + "AKIAABCDEFGHIJKL12 " * 256]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(secrets.redact(docs).collect())
    for i, t in enumerate(texts):
        assert got[i] == redacted(t)


def test_long_text_of_secrets(spark):
    """A text of 4 MB with 100,000 secrets ends, every secret replaced."""
    text = "password=abcdefgh1 and some more plain words " * 90_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert secrets.redact(docs).first()["text"] == "[SECRET] and some more plain words " * 90_000


def test_long_texts(spark):
    """20 MB in one text, a copy of its end, and a text of one repeated word."""
    rnd = random.Random(7)
    words = [f"w{rnd.randrange(10 ** 6)}" for _ in range(2_500_000)]
    long = " ".join(words)
    rows = [(1, long), (2, "before " + " ".join(words[-400:])), (3, "same " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in fmindex.report(docs).collect()}
    assert [got[i]["n_removed"] for i in (1, 2, 3)] == [0, 400, 0] and got[1]["n_words"] == len(words)
    bench = spark.createDataFrame([("a", " ".join(words[-10:]))], "item_id string, text string")
    got = {r["doc_id"]: r for r in decontaminate.report(docs, bench).collect()}
    assert [got[i]["n_hit"] for i in (1, 2, 3)] == [10, 10, 0]
    lang = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, None).collect()}
    assert set(lang.values()) == {"und"}


def test_no_letters(spark):
    net = language.train([("aa", "abc " * 50), ("bb", "xyz " * 50)])
    docs = spark.createDataFrame([(1, "½ ²³ ① 12_"), (2, "½ é"), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs, net).collect()}
    assert got[1] == got[3] == got[4] == ("und", 0.0) and got[2][0] in ("aa", "bb")


def test_benchmark_in_passes(spark):
    docs = U.edge(spark).selectExpr("*", "'x' as _ranges", "'y' as items")
    bench = spark.createDataFrame(BENCH, "item_id string, text string")
    one, many = decontaminate.report(docs, bench), decontaminate.report(docs, bench)
    got = decontaminate.scan(docs, bench, ["doc_id"], max_pattern_bytes=100)
    want = decontaminate.scan(docs, bench, ["doc_id"])
    key = lambda r: (r["doc_id"], r["n_words"], sum(h[1] - h[0] for h in r["hits"]), tuple(r["items"]))
    assert U.order(map(key, got.collect())) == U.order(map(key, want.collect()))
    assert U.order(one.collect()) == U.order(many.collect())


def test_quality_learns_from_long_documents(spark):
    """A table of documents past the window's length still gives a model."""
    text = "This is a plain sentence about the weather of the day. " * 600
    docs = spark.createDataFrame([(i, text + str(i)) for i in range(20)], "doc_id long, text string")
    assert quality.train(docs) is not None

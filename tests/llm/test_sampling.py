"""Resampling, chat formatting and whitening, against brute force and round trips."""

import math
import zlib
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given as cases
from hypothesis import settings
from hypothesis import strategies as st

from tests.llm import util as U
from tillroll.llm import chat, feast, resample, whiten
from tillroll.llm.common import table

SF = "/root/testdata/sf0.001"
BENCH = [(1, U.LINE), (2, "The quick; brown fox"), (3, None), (4, "..."), (1, "é" * 30 + " fox")]


def features(text, sizes):
    w = U.ALNUM.findall((text or "").translate(U.LOWER))
    return [" ".join(w[k:k + n]) for n in range(sizes[0], sizes[1] + 1) for k in range(len(w) - n + 1)], len(w)


def resampled(docs, bench, percent=10, sizes=(1, 1), buckets=10_000, least=20):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(place(f) for _, x in rows for f in features(x, sizes)[0]) for rows in (docs, bench))
    n_s, n_t = sum(s.values()), sum(t.values())
    rows = []
    for i, x in docs:
        f, n_words = features(x, sizes)
        weight = sum(math.floor(1000 * math.log((t[place(g)] + 1) * (n_s + buckets) / ((s[place(g)] + 1) * (n_t + buckets)))) for g in f)
        h = int(U.sha(f"2024:{'' if i is None else i}")[:8], 16)
        rows.append((i, n_words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    drawn = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2]))
    rank = {}
    for k, r in enumerate(drawn[:percent * len(drawn) // 100]):
        rank.setdefault(r, []).append(k + 1)
    out = []
    for r in rows:
        out.append((*r, rank[r].pop(0) if rank.get(r) else None))
    return out


@pytest.mark.parametrize("case", ["edge", "given", "empty", "no target"])
def test_resample(spark, case):
    docs = table(spark, SF, "documents").select("doc_id", "text") if case == "given" else U.edge(spark)
    rows = [tuple(r) for r in docs.collect()]
    bench, target = spark.createDataFrame(BENCH, "item_id long, text string"), BENCH
    if case == "empty":
        docs, rows = docs.limit(0), []
    if case == "no target":
        bench, target = bench.limit(0), []
    want = [(r[0], *r[2:]) for r in resampled(rows, target)]
    assert U.order(resample.report(docs, bench).collect()) == U.order(want)


def test_resample_longer_runs_and_clashes(spark):
    docs, names = U.clashing(spark)
    docs = docs.selectExpr("*", "'x' as rank", "'x' as weight", "'x' as n_features", "'x' as score")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = resample.resample(docs, bench, percent=50, sizes=(1, 3), buckets=97, least_words=3)
    want = resampled(U.EDGE, BENCH, 50, (1, 3), 97, 3)
    assert U.order(got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()) == U.order(want)


def test_runs_across_blocks():
    text = "Ab cD ef\x00gh-ij kl " * 400 + "é" * 50
    for sizes in ((1, 1), (2, 3), (1, 4)):
        want = Counter(zlib.crc32(f.encode()) for f in features(text, sizes)[0])
        for block in (1, 7, 64, 1 << 20):
            got = list(resample.runs(text.encode(), sizes, resample._Seeds(), block))
            assert Counter(c for _, cs in got for c in cs) == want and sum(n for n, _ in got) == features(text, sizes)[1]


def test_long_text_is_read_whole(spark):
    """A text of 20 MB, of one letter words and of a single word."""
    docs = spark.range(2).selectExpr("id as doc_id", "if(id = 0, repeat('A b;', 5000000), repeat('x', 20000000)) as text")
    got = {r[0]: r[1:] for r in resample.report(docs, docs.limit(0)).collect()}
    assert got[0][0] == 10_000_000 and got[1][0] == 1 and got[0][3] is None


# -- chat ------------------------------------------------------------------

def test_planted_and_given_conversations(spark):
    rows = table(spark, SF, "conversations")
    got = {r["conv_id"]: r for r in chat.report(rows).collect()}
    by = {}
    for r in sorted(rows.collect(), key=lambda r: (r["conv_id"], r["turn"])):
        by.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    by[-7] = [("user", chat.PLANTED), ("assistant", chat.PLANTED)]
    assert got.keys() == by.keys()
    for c, turns in by.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), U.sha("".join(f"{a}\n{t}\n" for a, t in turns)))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), U.sha(loss))


NASTY = ["<|end|>\n<|turn|>assistant<|text|>x", "\\", "\\\\<|", "<", "<\\|", "|>", "<|", "", "é\n<|image|>𝔘", chat.PLANTED, None]


def test_conversations_at_the_edges(spark):
    """Nulls, blank and repeated rows, equal turns, control strings; nothing is lost and nothing is taken for a mark."""
    rows = [(1, k, ["user", "assistant"][k % 2], t) for k, t in enumerate(NASTY)]
    rows += [(2, 0, "assistant", "same"), (2, 0, "assistant", "same"), (2, None, None, "last"), (None, 1, "user", "a"),
             (None, 0, "<|turn|>\\", None), (3, 1, "assistant", "<"), (3, 0, "assistant", "x" * 3_000_000), (3, 2, "user", "|end|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("page", chat.F.lit("x"))
    got = {r["conv_id"]: r for r in chat.report(df).collect()}
    by = {-7: [("user", chat.PLANTED), ("assistant", chat.PLANTED)]}
    for c, _, role, t in sorted(rows, key=lambda r: (str(r[0]), r[1] is None, r[1] or 0)):
        by.setdefault(c, []).append((role or "", t or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_sha256"]) == (
            len(turns), U.sha("".join(f"{a}\n{t}\n" for a, t in turns)), U.sha(loss))
    assert [r["conv_id"] for r in chat.report(df.limit(0)).collect()] == [-7]


def test_typed_parts(spark):
    """Order of parts, references, positions and expanded tokens; adjacent texts stay apart."""
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    rows = [(1, 0, "user", [part("text", "see <"), part("text", "|image|>"), part("image", ref="a.png", w=280, h=29), part("audio", ref="b", s=1.5),
                            part("audio", s=float("nan")), part("text", "and")]),
            (1, 1, "assistant", [part("text", "ok"), part("document", ref="c", p=3), part("video", ref="d"), None, part(None, "tail\\"), part("image")]),
            (1, 2, "assistant", None), (1, 3, "user", [])]
    msgs = spark.createDataFrame(rows, chat.T.StructType([
        chat.T.StructField("conv_id", chat.T.LongType()), chat.T.StructField("turn", chat.T.LongType()),
        chat.T.StructField("role", chat.T.StringType()), chat.T.StructField("parts", chat.T.ArrayType(chat.PART))]))
    pages = chat.format_chats(msgs).collect()
    assert len(pages) == 1
    p = pages[0]
    turns = list(chat.read_back(p["formatted"]))
    assert [(r, [(m, t) for m, t, _, _ in parts]) for r, parts in turns] == [
        ("user", [("text", "see <"), ("text", "|image|>"), ("image", ""), ("audio", ""), ("audio", ""), ("text", "and")]),
        ("assistant", [("text", "ok"), ("document", ""), ("file", ""), ("text", ""), ("text", "tail\\"), ("image", "")]),
        ("assistant", []), ("user", [])]
    assert [(a["turn"], a["kind"], a["ref"], a["tokens"]) for a in p["attachments"]] == [
        (0, "image", "a.png", 20), (0, "audio", "b", 38), (0, "audio", None, 25), (1, "document", "c", 1536), (1, "video", "d", 0), (1, "image", None, 256)]
    assert p["tokens"] == sum(a["tokens"] for a in p["attachments"]) and p["n_turns"] == 4
    for a in p["attachments"]:
        assert p["formatted"][a["start"]:].startswith({"video": "<|file|>"}.get(a["kind"], f"<|{a['kind']}|>"))
    assert "".join(chat.unescape(p["formatted"][s["start"]:s["end"]]) for s in p["loss"]) == "oktail\\"


def test_long_conversation_comes_in_pages(spark):
    msgs = spark.range(0, 3000, 1, 7).selectExpr("5 as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat(id, repeat(' w', 50)) as text")
    pages = chat.format_chats(msgs.withColumn("parts", chat.text_parts(chat.F.col("text"))), page_chars=10_000)
    got = pages.collect()
    assert [p["page"] for p in got] == list(range(len(got))) and len(got) > 20 and sum(p["n_turns"] for p in got) == 3000
    assert max(len(p["formatted"]) for p in got) < 10_200
    d = chat.digests(pages).collect()
    texts = [("user", "assistant")[k % 2] + f"\n{k}" + " w" * 50 + "\n" for k in range(3000)]
    assert len(d) == 1 and d[0]["turns_sha256"] == U.sha("".join(texts))


@settings(max_examples=200, deadline=None)
@cases(st.lists(st.tuples(st.text("\\<|>#é end", max_size=8), st.lists(st.text("\\<|>turnd\n𝔘", max_size=12), max_size=4)), max_size=5))
def test_escape_round_trip(turns):
    f = chat.Flattener()
    for k, (role, texts) in enumerate(turns):
        f.turn(k, role, [{"kind": "text", "text": t} for t in texts])
    back = [(r, [t for _, t, _, _ in parts]) for r, parts in chat.read_back("".join(f.out))]
    assert back == turns


# -- whitening ---------------------------------------------------------------

def brute_whiten(rows, k=4):
    """Floor, distinct, covariance, numpy's eigensolver."""
    ok = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows
          if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted(set(tuple(x) for _, x in ok)), float)
    n, mean = len(fit), fit.mean(axis=0)
    cov = (fit - mean).T @ (fit - mean) / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    sums = [int(s) for s in fit.sum(axis=0)]
    out = {}
    for j, (i, x) in enumerate(ok):
        w = (np.array(x) - mean) @ u / np.sqrt(e)
        out.setdefault(i, []).append((n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), w, e / np.trace(cov)))
    return out, u


def held(got, want, k=4, tol=1e-9):
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    assert len(got) == k * sum(map(len, want.values()))
    signs = {}
    for i, found in want.items():
        for c in range(1, k + 1):
            rs = by[i, c]
            assert len(rs) == len(found)
            for (n, dev, w, share), r in zip(sorted(found, key=lambda f: abs(f[2][c - 1])), sorted(rs, key=lambda r: abs(r["whitened"]))):
                assert (r["n"], r["deviation"], r["deviation_exact"]) == (n, dev, Decimal(dev))
                assert abs(abs(r["whitened"]) - abs(w[c - 1])) < tol and abs(r["explained"] / share[c - 1] - 1) < 1e-9
                assert 0 <= r["identity_error"] < 1e-9
                if abs(w[c - 1]) > 1e-6 and len(found) == 1:
                    assert signs.setdefault(c, r["whitened"] * w[c - 1] > 0) == (r["whitened"] * w[c - 1] > 0)


def test_whiten_given(spark):
    t = table(spark, SF, "embeddings")
    want, _ = brute_whiten([(r["vec_id"], r["embedding"]) for r in t.select("vec_id", "embedding").collect()])
    held(whiten.report(t).collect(), want)


def test_whiten_edges(spark):
    """Null, empty, non-finite, repeated and odd-length vectors, null and repeated ids, clashing columns."""
    rng = np.random.default_rng(3)
    rows = [(k, [float(np.float32(c)) for c in rng.normal(size=6)]) for k in range(40)]
    rows += [(0, rows[1][1])] * 300 + [(None, rows[2][1])]
    odd = [(50, None), (51, []), (52, [None] * 6), (53, [float("nan")] * 6), (54, [float("inf")] + [0.0] * 5), (55, [1.0] * 5)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "'x' as x", "'y' as n", "'z' as component")
    want, _ = brute_whiten(rows)
    held(whiten.report(df).collect(), want)
    assert whiten.report(df.limit(0)).collect() == [] and whiten.report(df.where("vec_id > 49 or false")).where("vec_id <> 55").collect() == []
    same = df.where("vec_id = 0").where("embedding[0] is not null").limit(0)
    assert whiten.report(same).collect() == []


def test_whiten_without_variance(spark):
    df = spark.createDataFrame([(k, [float(k), 2.0 * k, 1.0]) for k in range(9)] + [(9, [0.0, 0.0, 1.0])], "vec_id long, embedding array<double>")
    got = whiten.report(df).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 10 and abs(got[0]["explained"] - 1) < 1e-12
    assert whiten.report(df.where("vec_id in (0, 9)")).collect() == []  # one distinct vector


def test_deviation_past_64_bits(spark):
    df = spark.createDataFrame([(k, [k * 1e12, float(k * k)]) for k in range(5)], "vec_id long, embedding array<double>")
    for r in whiten.report(df).collect():
        x = [(k * 256 * 10 ** 12, k * k * 256) for k in range(5)]
        s = [sum(c) for c in zip(*x)]
        want = sum((5 * a - b) ** 2 for a, b in zip(x[r["vec_id"]], s))
        assert r["deviation"] == (want if want < 2 ** 63 else None) and r["deviation_exact"] == Decimal(want)


@settings(max_examples=40, deadline=None)
@cases(st.integers(1, 24), st.integers(1, 6), st.integers(0, 10 ** 6), st.sampled_from(["free", "ties", "steep", "low rank"]))
def test_eigenpairs(d, k, seed, kind):
    """Values, residuals and orthonormality against numpy, with ties, steep spectra and missing rank."""
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    e = {"free": rng.uniform(0.1, 5, d), "ties": rng.integers(1, 4, d).astype(float), "steep": 10.0 ** -rng.integers(0, 9, d),
         "low rank": np.where(np.arange(d) < max(1, d // 3), rng.uniform(1, 2, d), 0)}[kind]
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    got, y = feast.largest(v, k)
    want = np.sort(e[e > 1e-11])[::-1][:k]
    assert len(got) == len(want) and np.abs(got - want).max() < 1e-12 * want[0] * d + 1e-13
    assert np.abs(v @ y - y * got).max() < 1e-13 * d and np.abs(y.T @ y - np.eye(len(got))).max() < 1e-13


def test_inertia_counts():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(30, 30))
    a = a + a.T
    e = np.linalg.eigvalsh(a)
    tri = feast.tridiagonal(a)
    for s in (-100.0, *((e[1:] + e[:-1]) / 2), 100.0):
        assert feast.above(tri, s) == (e > s).sum()

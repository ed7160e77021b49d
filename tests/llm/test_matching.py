"""Operators with an exact answer, against brute force."""

import duckdb
import numpy as np
import pytest

from tests.llm import util as U
from tillroll.llm import bwtmerge, decontaminate, fmindex, jaccard, pii, secrets, topk
from tillroll.llm.common import table

SF = "/root/testdata/sf0.001"
BENCH = [(1, U.LINE), (2, "fox the quick"), (3, "nothing of this is there at all in any of the texts"), (None, U.LINE), (5, None), (6, "..."), (1, U.LINE)]


def given(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    return docs, [tuple(r) for r in docs.collect()]


@pytest.mark.parametrize("case", ["edge", "given", "empty"])
def test_exact_operators(spark, case):
    docs, rows = given(spark) if case == "given" else (U.edge(spark), U.EDGE)
    if case == "empty":
        docs, rows = docs.limit(0), []
    assert U.order(fmindex.report(docs).collect()) == U.order(U.substring(rows))
    assert U.order(bwtmerge.report(docs).collect()) == U.order(U.suffixes(rows))
    assert U.order(jaccard.report(docs).collect()) == U.order(U.jaccard(rows))
    got = secrets.report(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()
    assert U.order(got) == U.order(U.secrets(rows))
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert U.order(decontaminate.report(docs, bench).collect()) == U.order(U.contaminated(rows, BENCH))
    assert U.order(decontaminate.report(docs, bench.limit(0)).collect()) == U.order(U.contaminated(rows, []))


def test_items_without_an_id_contaminate(spark):
    """A benchmark row of null id counts for the hits, and is not among the items."""
    bench = spark.createDataFrame([(None, U.LINE), (4, "fox the quick")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.report(U.edge(spark), bench).collect()}
    assert (got[10]["n_hit"], got[10]["n_items"], got[10]["contaminated"], got[10]["items_sha256"]) == (14, 0, True, U.sha(""))
    assert got[9]["n_items"] == 1 and not got[4]["contaminated"]


def test_decontamination_in_passes(spark):
    """A benchmark over the size bound is searched in passes, with the same result."""
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    one, many = (decontaminate.scan(U.edge(spark), bench, max_pattern_bytes=m).collect() for m in (1 << 20, 100))
    assert U.order((r["doc_id"], r["n_words"], str(r["hits"]), str(r["items"])) for r in one) == U.order(
        (r["doc_id"], r["n_words"], str(r["hits"]), str(r["items"])) for r in many)


def test_near_copies_in_large_groups(spark):
    """A group of near copies beyond a chunk, chained so that its ends are not linked directly."""
    words = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(90):
        w = list(words)
        w[(k * 7) % 120] = f"x{k}"
        rows.append((1000 - k, " ".join(w)))
    chain = list(words)
    for k in range(20):
        chain[k * 3] = f"y{k}"
        rows.append((2000 + k, " ".join(chain)))
    docs = spark.createDataFrame(rows, U.SCHEMA)
    assert U.order(jaccard.report(docs).collect()) == U.order(U.jaccard(rows))


def test_salted_anchors(spark, monkeypatch):
    """Anchors with more content than a bucket are dealt out window by window."""
    from tillroll.llm import windows
    monkeypatch.setattr(windows, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(bwtmerge, "BUCKET", 2000)
    rows = [(k, " ".join(f"a{k}_{i}" for i in range(8)) + " " + U.LINE * 3 + " " + " ".join(f"b{k}_{i}" for i in range(8))) for k in range(60)]
    docs = spark.createDataFrame(rows, U.SCHEMA)
    assert U.order(fmindex.report(docs).collect()) == U.order(U.substring(rows))
    assert U.order(bwtmerge.report(docs).collect()) == U.order(U.suffixes(rows))


def test_bitmap_keeps_every_place(spark):
    """Place 0 has a bit of its own, and so has place 1."""
    from tillroll.llm import windows
    held, other = np.array([0, 5 << 44, -1]), np.array([1 << 44, 4 << 44, 6 << 44])
    bits = windows.bitmap(spark.createDataFrame([(int(x),) for x in held], "h long"), "h")
    assert windows.may_have(bits, held).all() and not windows.may_have(bits, other).any()


def test_hot_window_is_searched_once(spark, tmp_path, monkeypatch):
    """A window that many differing segments share is one row of its bucket, counted for all of them."""
    from tillroll.llm import windows
    monkeypatch.setattr(windows, "BUCKET_BYTES", 2000)
    rows = [(k, f"a{k} {U.LINE} b{k} c{k} d{k}") for k in range(300)]
    real = fmindex.shard

    def watched(t, size):
        got = t.column("content").to_pylist()
        (tmp_path / f"{len(got)}_{len(set(got))}_{id(t)}").touch()
        return real(t, size)

    monkeypatch.setattr(fmindex, "shard", watched)
    docs = spark.createDataFrame(rows, U.SCHEMA)
    assert U.order(fmindex.report(docs).collect()) == U.order(U.substring(rows))
    sizes = [tuple(map(int, f.name.split("_")[:2])) for f in tmp_path.iterdir()]
    assert sizes and all(n == distinct < 60 for n, distinct in sizes)


def test_copies_share_their_hits(spark):
    """However many copies a text has, its repeated windows are listed once."""
    from pyspark.sql import functions as F
    text = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(7, text)] * 40 + [(3, text)], U.SCHEMA)
    own = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.xxhash64("doc_id", "text").alias("_key"))
    for hits in (bwtmerge.repeated(own.withColumn("_key", F.xxhash64("_text")), bwtmerge.BYTES, "_text"),
                 fmindex.repeated(own, fmindex.WORDS, "_id", "_text")):
        for r in hits.collect():
            assert len(r["hits"]) == len(set(r["hits"])) > 0


def test_clashing_columns(spark):
    docs, extra = U.clashing(spark)
    plain = U.edge(spark)
    for op in (fmindex.report, bwtmerge.report, jaccard.report, secrets.report, pii.report):
        assert U.order(op(docs).collect()) == U.order(op(plain).collect())


def test_personal_data(spark):
    docs, rows = given(spark)
    for rows, docs in ((rows, docs), (U.EDGE, U.edge(spark))):
        want = []
        for i, x in rows:
            b = U.pii_spans(x)
            n = [sum(s[0] == k for s in b) for k in range(4)]
            want.append((i, *n, U.sha(",".join(f"{U.PII[k][0]}:{s}:{e}" for k, s, e in b))))
        got = pii.report(docs).collect()
        assert U.order(tuple(r)[:6] for r in got) == U.order(want)
        assert all(r["spans"].count(":") == 0 or r["spans"].count(",") + 1 >= r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in got)


def test_crf_learns_its_table_and_viterbi_is_exact():
    crf = pii.model()
    rows = pii.training_rows()
    assert np.mean(np.concatenate([crf.decode([x])[0] == y for x, y in rows])) > 0.98
    rng = np.random.default_rng(1)
    small = pii.Crf()
    small.unary[:] = rng.normal(size=small.unary.shape)
    small.trans[:] = rng.normal(size=small.trans.shape)
    seqs = [rng.integers(0, pii.BINS, (n, 7)) for n in (1, 2, 4, 4, 3)]
    from itertools import product
    for x, path in zip(seqs, small.decode(seqs)):
        e = small.unary[x].sum(-2)
        score = lambda p: sum(e[t, c] for t, c in enumerate(p)) + sum(small.trans[a, b] for a, b in zip(p, p[1:]))  # noqa: B023,E731
        assert tuple(path) == max(product(range(4), repeat=len(x)), key=score)
    text = "call (456) 555-2186 now"
    assert pii.added_spans([text], [pii.base_spans(text)], crf)[0] == [("crf_phone", 5, 19)]


def test_every_labelled_line_gives_its_spans():
    crf = pii.model()
    for line in pii.LABELLED.splitlines():
        text, want, last = "", [], 0
        for tok in line.split():
            w, _, t = tok.rpartition("/")
            tag = pii.TAGS.index(t) if w and t in pii.TAGS else 0
            w = w if tag else tok
            start = len(text) + bool(text)
            text += " " * bool(text) + w
            if tag:
                want = [*want[:-1], (want[-1][0], want[-1][1], len(text))] if tag == last else [*want, (f"crf_{t.lower()}", start, len(text))]
            last = tag
        base = pii.base_spans(text)
        want = [x for x in want if not any(s < x[2] and x[1] < z for _, s, z in base)]
        assert pii.added_spans([text], [base], crf)[0] == want, line
    plain = "the old man went home and said nothing more " * 50
    text = plain + "write to jane.doe (at) example.com soon " + plain
    assert [text[s:z] for _, s, z in pii.added_spans([text], [[]], crf)[0]] == ["jane.doe (at) example.com"]


def test_whole_texts_are_decoded_exactly():
    """Settling sure words first gives the path of a Viterbi pass over the whole text."""
    rng = np.random.default_rng(2)
    words = [f"{a}{b}" for a in ("Ab", "c.", "7", "@x", "(e)", "F&") for b in ("", "g", "HH", "1-2", ",")]
    texts = [[words[i] for i in rng.integers(0, len(words), n)] for n in (0, 1, 2, 300, 0, 40, 3)]
    for trans, bias in ((0.1, 4), (1, 2), (3, 0)):
        crf = pii.Crf()
        crf.unary[:], crf.trans[:] = rng.normal(size=crf.unary.shape), trans * rng.normal(size=crf.trans.shape)
        crf.unary[:, 0] += bias / 7
        want = crf.decode([pii.sequence_features(t) for t in texts if t])
        assert all((a == b).all() for a, b in zip([p for p, t in zip(crf.decode_texts(texts), texts) if t], want))


def test_trigram_queries_are_necessary():
    """Any text a rule matches satisfies its query."""
    def holds(q, t):
        return q is True or (q in t if isinstance(q, str) else (all if q[0] == "and" else any)(holds(x, t) for x in q[1]))

    for rule, text in (("assign", "api_KEY='abcdefgh'"), ("assign", "apikey:abcdefgh"), ("access", "AKIA1234567890AB"), ("hex", "0" * 40),
                       ("github", "ghp_" + "a" * 36), ("slack", "xoxb-1234567890"), ("google", "AIza" + "a" * 35),
                       ("stripe", "sk_live_" + "a" * 20), ("pem", "-----BEGIN RSA PRIVATE KEY-----")):
        r = next(r for r in secrets.RULES if r.kind == rule)
        assert holds(secrets.trigram_query(r.pattern), text.lower())
    assert secrets.trigram_query(r"[0-9a-f]{32,}") is True
    assert secrets.trigram_query(r"(abcd|xyz)") == ("or", (("and", ("abc", "bcd")), "xyz"))


def test_secrets_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = secrets.report(table(spark, SF, "documents")).collect()
    assert U.order(got) == U.order(con.sql(secrets.ORACLE).fetchall())


def test_topk(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 4]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0]), (302, [float("nan")] * 4), (303, [float("inf")] * 4), (None, [1.0] * 4), (350, []),
             (400, [1.0, 2.0]), (50, rows[50][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = {}
    for i, x in rows:
        if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x):
            v[i] = [int(np.floor(256 * c)) for c in x]
    want = []
    for q in (i for i in v if i % 50 == 0):
        s = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q and len(v[c]) == len(v[q]))[:5]
        want += [(q, r + 1, c, -n) for r, (n, c) in enumerate(s)]
    assert U.order(topk.report(df).collect()) == U.order(want)
    assert topk.report(df.limit(0)).count() == 0


def test_large_anchors_are_narrowed(spark, monkeypatch):
    """Segments of an anchor with more content than a bucket are never cut into all their windows."""
    from pyspark.sql import functions as F

    from tillroll.llm import windows
    monkeypatch.setattr(windows, "BUCKET_BYTES", 1000)
    monkeypatch.setattr(bwtmerge, "BUCKET", 1000)
    passage = " ".join(f"passage{i * i}" for i in range(60))
    rows = [(k, f"{'x' * (k % 7)} a{k} b{k * k} {passage} c{k} d{k * k} e{k}") for k in range(80)]
    rows += [(k, rows[k - 80][1].replace(f"passage{k}", "other")) for k in range(80, 110)]
    made, real = [], windows.narrowed

    def watched(hot, u, width, *rest):
        if width == 1:
            made.append(hot.agg(F.max(F.length("content"))).first()[0] // (8 if u.words else 1) - u.size + 1)
        else:
            made.append(width)
        return real(hot, u, width, *rest)

    monkeypatch.setattr(windows, "narrowed", watched)
    docs = spark.createDataFrame(rows, U.SCHEMA)
    assert U.order(bwtmerge.report(docs).collect()) == U.order(U.suffixes(rows))
    assert made and max(made) <= 22
    del made[:]
    assert U.order(fmindex.report(docs).collect()) == U.order(U.substring(rows))
    assert made and max(made) <= 2


def test_near_copies_under_the_threshold_meet_by_family(spark, monkeypatch):
    """Near copies that stay apart are not paired token by token."""
    seen, real = [], jaccard.candidates

    def watched(token, dealt, *rest):
        held = token.join(dealt, "node")
        seen.append((held.count(), held.select("token", "family").distinct().count(), dealt.count()))
        return real(token, dealt, *rest)

    monkeypatch.setattr(jaccard, "candidates", watched)
    rows = []
    for k in range(150):
        w = [f"w{i}" for i in range(300)]
        for j, at in enumerate(np.random.default_rng(k).permutation(300)[:6].tolist()):
            w[at] = f"x{k}_{j}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, U.SCHEMA)
    want = U.jaccard(rows)
    assert len({r[2] for r in want}) > 100
    assert U.order(jaccard.report(docs).collect()) == U.order(want)
    (held, entries, nodes), = seen
    assert nodes > 100 and entries < held / 20

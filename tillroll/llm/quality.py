"""Quality classifier from weak labels.

Overlapping labellers vote on every document: bad, good, or nothing. Two
questions are asked, quality and toxicity, each with its own heuristics; a
table of given labels, where there is one, is a further labeller that covers
part of the documents. The votes of the whole corpus are counted by pattern
(their number is bounded by the labellers, not by the documents), and
expectation-maximisation over the counts estimates every labeller's accuracy.
The posterior of a document's votes is the label a hashed linear scorer learns
from, on a bounded sample; the scorer then judges every whole text.

Features are hashed: the level of each measure together with its name (for
quality), and the lower-case words with their beginnings (present or not, with
sparse weights, for toxicity).
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm import tokens as K
from tillroll.llm.common import bounded, field, handed_on, schema, slices, text_buffer, worker_model

# Words (fixed values): insults, and frequent short function words.
INSULTS = ("idiot moron loser pathetic stupid worthless scum trash clown disgusting dumb imbecile jerk "
           "vermin filth filthy bastard creep freak garbage").split()
FUNCTION = ("the of and to in a is that for it was on are with as by this from or an de la le et les des en un une que "
            "est pour qui dans el los las y se del para con por no su der die und das den von zu mit ist für auf ein "
            "eine im dem nicht").split()
LEVELS = ("symbols", "capitals", "distinct", "table", "adjacent", "function")  # measures that are features
QUALITY = ("symbols", "capitals", "distinct", "table", "adjacent", "plain")  # labellers; given labels come last
TOXIC = ("insults", "density", "variety", "polite")
BAD, GOOD, NONE = 1, 0, 2
LEVEL_BINS, WORD_BINS = 1 << 16, 1 << 22
SAMPLE = 4000  # training documents, at most
WINDOW = 20_000  # characters of a document in the sample
SLICE = 512 << 10  # bytes of text measured at once: a task needs some 200 bytes for each
HEADS = (4, 5, 6)  # bytes of a word's beginning that are features

_CLASS = np.full(256, 5, np.uint8)  # 0 separator, 1 lower, 2 upper, 3 digit, 4 non-ASCII, from 5 marks
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:], _CLASS[K.SPACES] = 1, 2, 3, 4, 0
for _i, _c in enumerate(b"|.,;:!?*#$%&"):
    _CLASS[_c] = 6 + _i
_LOW_KEYS = K.BYTE_KEYS[K.LOWER]


class WordSet:
    """Membership of word hashes in a small fixed list."""

    def __init__(self, ws: list[str]):
        buf = np.frombuffer("".join(ws).encode(), np.uint8)
        off = np.cumsum([0] + [len(w.encode()) for w in ws])
        self.sorted = np.sort(K.span_hashes(K.prefix_sums(buf), off[:-1], off[1:]))
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.sorted >> np.uint64(48)] = True

    def has(self, h: np.ndarray) -> np.ndarray:
        out = self.maybe[h >> np.uint64(48)]
        at = np.flatnonzero(out)
        place = np.minimum(np.searchsorted(self.sorted, h[at]), len(self.sorted) - 1)
        out[at] = self.sorted[place] == h[at]
        return out


_INSULTS, _FUNCTION = WordSet(INSULTS), WordSet(FUNCTION)


class Measures:
    """Word-level measures of a batch of texts."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        start, end, self.n = K.words(buf, off)
        self.doc = np.repeat(np.arange(len(off) - 1), self.n)
        cls = _CLASS[buf]
        mark = cls >= 5
        per_word = lambda flag: (np.add.reduceat(flag.view(np.uint8), start, dtype=np.int32) if len(start)
                                 else np.zeros(0, np.int32))  # separators count as nothing
        self.marks, self.upper, digits = per_word(mark), per_word(cls == 2), per_word(cls == 3)
        self.inner = (end - start) - self.marks
        self.letters = self.inner - digits
        # The word without up to three marks on either side.
        left, right = start.copy(), end.copy()
        some = np.flatnonzero((self.marks > 0) & (self.inner > 0))
        lo, hi = left[some], right[some]
        for _ in range(3):
            lo += mark[lo]
            hi -= mark[hi - 1]
        left[some], right[some] = lo, hi
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_LOW_KEYS[buf] * K.powers(len(buf))[0][:len(buf)], out=sums[1:])
        self.word = K.span_hashes(sums, left, right)
        self.bin = (self.word >> np.uint64(42)).astype(np.int32)  # of WORD_BINS
        size = right - left
        heads = [np.where(size > k, (K.span_hashes(sums, left, np.minimum(left + k, right)) >> np.uint64(42)).astype(np.int32), -1)
                 for k in HEADS]
        self.bins = np.stack([self.bin, *heads])  # -1: the word is no longer than that
        self.same1 = np.zeros(len(self.word), bool)  # repeats the word before it
        self.same1[1:] = (self.word[1:] == self.word[:-1]) & (self.doc[1:] == self.doc[:-1])

    def total(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, x, len(self.n))

    def measures(self) -> dict[str, np.ndarray]:
        n = np.maximum(self.n, 1)
        order = np.lexsort((self.word, self.doc)) if len(self.word) < 1 << 14 else np.argsort(
            (self.doc.astype(np.uint64) << np.uint64(44)) | (self.word >> np.uint64(20)), kind="stable")
        w, d = self.word[order], self.doc[order]
        new = np.ones(len(w))
        new[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
        distinct = np.bincount(d, new, len(self.n))
        hit = np.flatnonzero(_INSULTS.has(self.word))
        kinds = np.unique(np.stack([self.doc[hit], self.bin[hit]], 1), axis=0)[:, 0]
        insults = np.bincount(self.doc[hit], minlength=len(self.n))
        return {
            "symbols": self.total(self.marks >= 2) / n,
            "capitals": self.total(self.upper) / np.maximum(self.total(self.letters), 1),
            # Long texts repeat words by nature: compared with the square-root law of vocabulary growth.
            "distinct": distinct / np.minimum(n, 40 * np.sqrt(n)),
            "table": self.total((self.inner == 0) & (self.marks > 0)) / n,
            "adjacent": self.total(self.same1) / n,
            "function": self.total(_FUNCTION.has(self.word)) / n,
            "insults": insults, "density": insults / n, "variety": np.bincount(kinds, minlength=len(self.n)),
        }

    def votes(self) -> np.ndarray:
        """One column per labeller, in the order QUALITY + TOXIC."""
        x, n = self.measures(), self.n
        plain = ((x["symbols"] < 0.05) & (x["capitals"] < 0.2) & (x["distinct"] > 0.4) & (x["table"] < 0.02) & (x["adjacent"] < 0.05))
        bad = {
            "symbols": (x["symbols"] > 0.2) & (n > 0), "capitals": (x["capitals"] > 0.45) & (n > 3),
            "distinct": (x["distinct"] < 0.22) & (n > 11), "table": (x["table"] > 0.08) & (n > 0),
            "adjacent": (x["adjacent"] > 0.2) & (n > 11), "insults": x["insults"] >= 2,
            "density": (x["density"] > 0.004) & (n > 11), "variety": x["variety"] >= 2}
        good = {"plain": plain & (n > 0), "polite": (x["insults"] == 0) & (n > 0)}
        none = np.zeros(len(n), bool)
        return np.stack([np.where(bad.get(k, none), BAD, np.where(good.get(k, none), GOOD, NONE)) for k in QUALITY + TOXIC],
                        1).astype(np.int8)

    def levels(self) -> np.ndarray:
        """(documents, bins): the level of each measure, hashed with its name."""
        x = self.measures()
        level = [np.minimum(np.sqrt(np.clip(x[k], 0, 1)) * 10, 9).astype(np.int64) for k in LEVELS]
        return np.stack([((k * 1009 + v * 104729) * 2654435761 >> 9) % LEVEL_BINS for k, v in enumerate(level)], 1).astype(np.int32)


def em(patterns: np.ndarray, counts: np.ndarray, given: int | None = None, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, float]:
    """Latent classes of vote patterns: (posterior of bad, accuracies, share of bad).

    A labeller that votes is right with its accuracy in either class and
    independently of the others; abstaining says nothing. Accuracies start at
    0.9 with a prior of that mean. ``given`` is the column of the given labels,
    whose accuracy is held at 0.999.
    """
    acc, prior = np.full(patterns.shape[1], 0.9), 0.2
    vote_bad, vote_good = patterns == BAD, patterns == GOOD
    covered = (vote_bad | vote_good).any(1)
    n = counts * covered
    p = np.full(len(patterns), prior)
    for _ in range(rounds):
        if given is not None:
            acc[given] = 0.999
        logit = np.log(acc / (1 - acc))
        p = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + (vote_bad - vote_good.astype(float)) @ logit, -50, 50)))
        right = (n * p) @ vote_bad + (n * (1 - p)) @ vote_good
        acc = np.clip((18 + right) / (20 + n @ (vote_bad | vote_good)), 0.55, 0.999)
        prior = float(np.clip((1 + n @ p) / (10 + n.sum()), 1e-3, 0.9))
    return p, acc, prior


def logistic(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, bins: int, l1: float, weight: np.ndarray,
             rounds: int = 30, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Sparse logistic regression by AdaGrad with a proximal L1 step; rows are (bins, values)."""
    w, g2, b, b2 = np.zeros(bins), np.full(bins, 1e-6), 0.0, 1e-6
    order = np.random.default_rng(0)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            d = (1 / (1 + np.exp(-np.clip((w[at] * x).sum() + b, -30, 30))) - y[i]) * weight[i]
            g = d * x
            g2[at] += g * g
            step = rate / np.sqrt(g2[at])
            v = w[at] - step * g
            w[at] = np.sign(v) * np.maximum(np.abs(v) - step * l1, 0)
            b2 += d * d
            b -= rate / np.sqrt(b2) * d
    return w, float(b)


def _fit(votes: np.ndarray, counts: np.ndarray, sample_votes: np.ndarray, sample_bins: list[np.ndarray], bins: int,
         l1: float, least: int) -> dict:
    """EM over the patterns of a question's labellers, then a scorer for their posterior.

    Sampled documents without any vote teach nothing. A bin takes part if at
    least ``least`` of the others hold it and, where ``least`` is over 1,
    nearly all of these are bad: rare and common bins are noise.
    """
    post, acc, prior = em(votes, counts, votes.shape[1] - 1)
    known = {tuple(p): q for p, q in zip(votes.tolist(), post)}
    rows = [(b, known[tuple(v)]) for v, b in zip(sample_votes.tolist(), sample_bins) if any(x != NONE for x in v)]
    if not rows:
        return {"at": np.zeros(0, np.int64), "w": np.zeros(0), "b": -5.0, "accuracy": acc, "prior": prior}
    y = np.array([q for _, q in rows])
    n, bad = np.zeros(bins), np.zeros(bins)
    for at, q in rows:
        n[at] += 1
        bad[at] += q
    use = (n >= least) & ((bad >= 0.9 * n) if least > 1 else True)
    share = np.clip(y.mean(), 0.02, 0.98)
    weight = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share))
    w, b = logistic([(at[use[at]], np.ones(int(use[at].sum()))) for at, _ in rows], y, bins, l1, weight)
    at = np.flatnonzero(w)
    return {"at": at, "w": w[at], "b": b, "accuracy": acc, "prior": prior}


def measure(docs: DataFrame, features: bool = False) -> DataFrame:
    """``(doc_id, votes)`` and, if asked for, ``levels`` and ``words``, the bins of the features."""
    ints = T.ArrayType(T.IntegerType())
    out = T.StructType([field(docs, "doc_id"), T.StructField("votes", T.ArrayType(T.ByteType()))] + (
        [T.StructField("levels", ints), T.StructField("words", ints)] if features else []))

    def run(batches):
        worker_model()
        for batch in slices(batches, "text", SLICE):
            m = Measures(*text_buffer(batch.column("text")))
            cols = [batch.column("doc_id"), pa.array(list(m.votes()), pa.list_(pa.int8()))]
            if features:
                cols.append(pa.array(list(m.levels()), pa.list_(pa.int32())))
                cut = np.cumsum(m.n)[:-1]
                cols.append(pa.array([np.unique(x[x >= 0]) for x in np.split(m.bins, cut, axis=1)], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=out.names)

    return bounded(docs).select("doc_id", "text").mapInArrow(run, out)


def given_votes(labels: DataFrame | None, docs: DataFrame) -> DataFrame:
    """``(doc_id, given)``: votes on quality and toxicity from a table of labels.

    Of several rows for one document the worst counts; null ids are left out.
    """
    if labels is None:
        return docs.select("doc_id", F.array(F.lit(NONE), F.lit(NONE)).alias("given")).limit(0)
    vote = lambda worst, bad: F.when(worst.isNull(), NONE).when(worst == bad, BAD).otherwise(GOOD)
    return (labels.where("doc_id IS NOT NULL").groupBy("doc_id")
            .agg(F.array(vote(F.min("quality"), 0), vote(F.max("toxic"), 1)).alias("given")))


def train(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE) -> dict | None:
    """Labeller accuracies from all documents, scorers from a sample; None for an empty table.

    The sample holds at most ``sample`` documents, of a longer one a window of
    WINDOW characters at a hashed place: by a hash of the id, up to a quarter
    each of those given as toxic and as of low quality, the rest from the
    others, labelled or not.
    """
    none = F.array(F.lit(NONE), F.lit(NONE))
    given = given_votes(labels, docs)
    with_given = lambda m: m.join(given, "doc_id", "left").withColumn("given", F.coalesce("given", none))
    table = with_given(measure(docs)).groupBy("votes", "given").agg(F.count(F.lit(1)).alias("n")).collect()  # bounded by the labellers
    if not table:
        return None
    order = F.xxhash64("doc_id", F.lit("draw"))
    ids = docs.where(F.length("text") > 0).select("doc_id").join(given, "doc_id", "left")
    ids = ids.select("doc_id", F.coalesce(F.get("given", F.lit(0)) * 10 + F.get("given", F.lit(1)), F.lit(22)).alias("g")).where("doc_id IS NOT NULL")
    toxic, low = F.col("g") % 10 == BAD, F.floor(F.col("g") / 10) == BAD
    picks = [(toxic, sample // 4), (~toxic & low, sample // 4), (~toxic & ~low, sample // 2)]
    if labels is None or not labels.take(1):
        picks = [(F.lit(True), sample)]
    chosen = [ids.where(w).orderBy(order).limit(k).select("doc_id") for w, k in picks]
    small = chosen[0]
    for c in chosen[1:]:
        small = small.union(c)
    small = F.broadcast(small.dropDuplicates())  # at most ``sample`` ids
    place = 1 + F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.length("text") - WINDOW + 1, F.lit(1)))
    few = docs.select("doc_id", "text").where(F.length("text") > 0).join(small, "doc_id", "left_semi")
    few = few.select("doc_id", F.substring(F.col("text"), place.cast("int"), F.lit(WINDOW)).alias("text"))
    got = with_given(measure(few, True)).limit(2 * sample).toArrow().combine_chunks().sort_by("doc_id")

    def matrix(votes, extra):
        q, t = len(QUALITY), len(TOXIC)
        votes, extra = np.array(votes, np.int8).reshape(-1, q + t), np.array(extra, np.int8).reshape(-1, 2)
        tox = np.concatenate([votes[:, q:], extra[:, 1:]], 1)
        tox[:, t - 1] = np.where(extra[:, 1] != NONE, NONE, tox[:, t - 1])  # a given label stands before "no insult"
        return np.concatenate([votes[:, :q], extra[:, :1]], 1), tox

    table = sorted((list(r["votes"]), list(r["given"]), r["n"]) for r in table)
    counts = np.array([n for *_, n in table], float)
    q_all, t_all = matrix([v for v, *_ in table], [g for _, g, _ in table])
    q_some, t_some = matrix(got.column("votes").to_pylist(), got.column("given").to_pylist())
    bins = {k: [x.values.to_numpy().astype(np.int64) for x in got.column(k)] for k in ("levels", "words")}
    gold = t_some[:, -1] != NONE
    first = _fit(t_all, counts, t_some[gold], [b for b, g in zip(bins["words"], gold) if g], WORD_BINS, 2e-2, 4)
    if len(first["at"]):  # "no insult" says nothing where the given labels' own scorer finds toxic words
        w = np.zeros(WORD_BINS)
        w[first["at"]] = first["w"]
        t_some[~gold & np.array([w[b].sum() + first["b"] > 0 for b in bins["words"]], bool), len(TOXIC) - 1] = NONE
    return {"quality": _fit(q_all, counts, q_some, bins["levels"], LEVEL_BINS, 1e-4, 1),
            "toxic": _fit(t_all, counts, t_some, bins["words"], WORD_BINS, 2e-2, 4)}


def _load(blob: bytes) -> dict:
    got = pickle.loads(blob)
    for head, bins in (("quality", LEVEL_BINS), ("toxic", WORD_BINS)):
        w = np.zeros(bins, np.float32)
        w[got[head]["at"]] = got[head]["w"]
        got[head]["table"] = w
    return got


def score(docs: DataFrame, model: dict | None, columns: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``columns`` of docs (default: all) plus ``p_bad``, ``p_toxic``, ``keep``.

    Null texts and texts without a word have p_bad 1 and are not kept; without
    a model (an empty training table) the others are kept. A probability of
    one half is too bad to be kept. One row per row. A column of docs with the
    name of an added one is handed on as ``in_<name>``.
    """
    keep = columns or docs.columns
    names = list(dict.fromkeys([*keep, text_col]))
    as_ = handed_on(keep, ["p_bad", "p_toxic", "keep"])
    out = schema(*[field(docs, c, a) for c, a in zip(keep, as_)], T.StructField("p_bad", T.DoubleType()),
                 T.StructField("p_toxic", T.DoubleType()), T.StructField("keep", T.BooleanType()))
    blob = pickle.dumps(model)
    key = hashlib.sha256(blob).hexdigest()

    def run(batches):
        t = worker_model(key, lambda: _load(blob)) if model is not None else worker_model()
        for batch in slices(batches, text_col, SLICE):
            m = Measures(*text_buffer(batch.column(text_col)))
            bad, toxic = np.zeros(len(m.n)), np.zeros(len(m.n))
            if t is not None:
                bad = 1 / (1 + np.exp(-np.clip(t["quality"]["table"][m.levels()].sum(1) + t["quality"]["b"], -30, 30)))
                kind, hot = np.nonzero((t["toxic"]["table"][m.bins] != 0) & (m.bins >= 0))
                pair = np.unique(np.stack([m.doc[hot], m.bins[kind, hot]], 1), axis=0)
                s = np.bincount(pair[:, 0], t["toxic"]["table"][pair[:, 1]], len(m.n)) + t["toxic"]["b"]
                toxic = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
            bad = np.where(m.n == 0, 1.0, bad)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(bad, pa.float64()), pa.array(toxic, pa.float64()),
                                                   pa.array((bad < 0.5) & (toxic < 0.5), pa.bool_())], names=out.names)

    return bounded(docs).select(*names).mapInArrow(run, out)


def report(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Probabilities and decision for every document, learned from the table itself."""
    return score(docs, train(docs, labels), ["doc_id"])

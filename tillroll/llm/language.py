"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in segments of ``SEGMENT`` positions, from the
left and from the right, and gives every position a probability per language;
a document's probabilities are the mean over all its positions. Segments are
independent sequences, so a batch of texts of any length becomes a rectangle
of lanes and memory does not grow with the text.

Gates are piecewise linear, ``clip(p + 1/2, 0, 1)``, and the reset gate acts
on the recurrent term of the candidate, so a step is one small matrix product
and a few vector operations over all lanes. Training is backpropagation
through time in numpy with Adam, on the driver, over a bounded sample of
labelled windows; prediction runs in the tasks over whole texts.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.common import field, handed_on, schema, slices, text_buffer

HIDDEN = 8
SEGMENT = 128  # positions per sequence
LANES = 4096  # sequences advanced together
SAMPLE_PER_LANGUAGE = 150  # training documents per language
SAMPLE_CHARS = 512  # characters of the window taken from each
MAX_LANGUAGES = 200  # the most frequent ones are learned
UNKNOWN = "und"


class Direction:
    """Weights of one reading direction."""

    def __init__(self, rng: np.random.Generator, hidden: int = HIDDEN):
        self.emb = (rng.normal(size=(3 * hidden, 256)) * 0.3).astype(np.float32)
        self.rec = (rng.normal(size=(3 * hidden, hidden)) * 0.3).astype(np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.emb, self.rec]

    def run(self, x: np.ndarray, live: np.ndarray | None, keep: list | None = None):
        """Yield (t, state) over the steps of ``x`` (steps, lanes); ``live`` masks padding."""
        n = self.rec.shape[1]
        lanes = x.shape[1]
        h = np.zeros((n, lanes), np.float32)
        a, e = np.empty((3 * n, lanes), np.float32), np.empty((3 * n, lanes), np.float32)
        for t in range(len(x)):
            np.take(self.emb, x[t], axis=1, out=e, mode="clip")
            np.matmul(self.rec, h, out=a)
            g = e[:2 * n]
            g += a[:2 * n]
            g += np.float32(0.5)
            raw = g.copy() if keep is not None else None
            np.clip(g, 0, 1, out=g)
            z, r, c = g[:n], g[n:], e[2 * n:]
            rec = a[2 * n:].copy() if keep is not None else None
            a[2 * n:] *= r
            c += a[2 * n:]
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((h, z.copy(), r.copy(), c.copy(), rec, raw))
            h = c + z * (h - c)
            if live is not None:
                h *= live[t]
            yield t, h

    def back(self, x: np.ndarray, keep: list, dh_out: np.ndarray) -> list[np.ndarray]:
        """Gradients of the weights, given those of the states (steps, hidden, lanes)."""
        n = self.rec.shape[1]
        d_rec = np.zeros_like(self.rec)
        d_emb_in = np.empty((len(x), 3 * n, x.shape[1]), np.float32)
        dh = np.zeros_like(dh_out[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, c, rec, raw = keep[t]
            dh = dh + dh_out[t]
            dc = dh * (1 - z) * (1 - c * c)
            inside = (raw > 0) & (raw < 1)
            dz = dh * (h - c) * inside[:n]
            dr = dc * rec * inside[n:]
            d_emb_in[t] = np.concatenate([dz, dr, dc])
            da = np.concatenate([dz, dr, dc * r])
            d_rec += da @ h.T
            dh = dh * z + self.rec.T @ da
        flat = x.ravel()
        d_emb = np.stack([np.bincount(flat, d_emb_in[:, k].ravel(), 256) for k in range(3 * n)]).astype(np.float32)
        return [d_emb, d_rec]


class Network:
    """Both directions and the output layer."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.fwd, self.bwd = Direction(rng, hidden), Direction(rng, hidden)
        self.out = (rng.normal(size=(2, len(labels), hidden)) * 0.1).astype(np.float32)
        self.bias = np.zeros((len(labels), 1), np.float32)

    def params(self) -> list[np.ndarray]:
        return [*self.fwd.params(), *self.bwd.params(), self.out, self.bias]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions of full segments, and its gradients."""
        keep: tuple[list, list] = ([], [])
        back = x[::-1]
        hf = np.stack([h for _, h in self.fwd.run(x, None, keep[0])])
        hb = np.stack([h for _, h in self.bwd.run(back, None, keep[1])])[::-1]
        s = self.out[0] @ hf + self.out[1] @ hb + self.bias
        s -= s.max(1, keepdims=True)
        p = np.exp(s)
        p /= p.sum(1, keepdims=True)
        lanes = np.arange(x.shape[1])
        loss = float(-np.log(p[:, y, lanes] + 1e-9).mean())
        p[:, y, lanes] -= 1
        p /= x.size
        d_out = np.stack([np.einsum("tlb,thb->lh", p, hf), np.einsum("tlb,thb->lh", p, hb)])
        gf = self.fwd.back(x, keep[0], np.matmul(self.out[0].T, p))
        gb = self.bwd.back(back, keep[1], np.matmul(self.out[1].T, p)[::-1])
        return loss, [*gf, *gb, d_out, p.sum((0, 2))[:, None]]

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 150, batch: int = 192, rate: float = 0.02, seed: int = 0) -> "Network":
        """Adam over random batches of segments; x is (segments, SEGMENT), y the label numbers."""
        rng = np.random.default_rng(seed)
        params = self.params()
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for k in range(1, steps + 1):
            pick = rng.integers(0, len(x), min(batch, 4 * len(x)))
            _, grads = self.gradients(np.ascontiguousarray(x[pick].T), y[pick])
            norm = max(1.0, float(np.sqrt(sum((g * g).sum() for g in grads))))
            lr = rate * min(1.0, 3 * (1 - k / (steps + 1)))
            for p, g, a, b in zip(params, grads, m, v):
                g = g / norm
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= (lr * (a / (1 - 0.9 ** k)) / (np.sqrt(b / (1 - 0.99 ** k)) + 1e-6)).astype(np.float32)
        return self

    def segment_sums(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Summed position probabilities (labels, lanes) of segments ``x`` (steps, lanes) of the given sizes."""
        steps, lanes = x.shape
        live = None if (size == steps).all() else (np.arange(steps)[:, None] < size[None, :]).astype(np.float32)
        left = np.empty((steps, len(self.labels), lanes), np.float32)
        for t, h in self.fwd.run(x, None):
            np.matmul(self.out[0], h, out=left[t])
        total = np.zeros((len(self.labels), lanes), np.float32)
        s = np.empty_like(total)
        for t, h in self.bwd.run(x[::-1], None if live is None else live[::-1]):
            np.matmul(self.out[1], h, out=s)
            s += left[steps - 1 - t]
            s += self.bias
            s -= s.max(0)
            np.exp(s, out=s)
            s *= (1 if live is None else live[steps - 1 - t]) / s.sum(0)
            total += s
        return total

    def predict(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Probabilities (documents, labels) of the texts in a buffer; empty texts get zeros."""
        n = len(off) - 1
        sums = np.zeros((n, len(self.labels)))
        count = -(-np.diff(off) // SEGMENT)
        doc = np.repeat(np.arange(n), count)
        within = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        start = off[doc] + within * SEGMENT
        size = np.minimum(off[doc + 1] - start, SEGMENT)
        order = np.argsort(size != SEGMENT, kind="stable")  # full segments first: they need no mask
        padded = np.concatenate([buf, np.zeros(SEGMENT, np.uint8)])
        at = np.arange(SEGMENT)[:, None]
        for i in range(0, len(order), LANES):
            ids = order[i:i + LANES]
            steps = int(size[ids].max())
            got = self.segment_sums(padded[start[ids][None, :] + at[:steps]], size[ids])
            np.add.at(sums, doc[ids], got.T)
        length = np.maximum(np.diff(off), 1)[:, None]
        return sums / length


def fold(df_id) -> "F.Column":  # type: ignore[name-defined]
    """crc32 of the id as text, mod 5 (null id: null)."""
    return F.crc32(F.col(df_id).cast("string").cast("binary")) % 5


def training_windows(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """A bounded sample of (lang, window of the text) of the learning folds.

    About ``per_language`` documents of each language, drawn by a hash, and of
    each a window of ``chars`` characters at a hashed place. The MAX_LANGUAGES
    most frequent languages are learned.
    """
    learn = docs.select("doc_id", "text", "lang").where(
        (fold("doc_id") != 0) & F.col("lang").isNotNull() & (F.length("text") > 0))
    sizes = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
             .orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()}
    if not sizes:
        return []
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(1.5 * per_language / n)) for k, n in sorted(sizes.items())])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1_000_003)) / 1_000_003
    place = 1 + F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.length("text") - chars + 1, F.lit(1)))
    rows = (learn.where(draw < share)
            .select("lang", F.substring(F.col("text"), place.cast("int"), F.lit(chars)).alias("w"), draw.alias("draw"))
            .orderBy("draw", "lang", "w").limit(4 * per_language * len(sizes)).collect())
    return sorted((r["lang"], r["w"]) for r in rows)


def train(windows: list[tuple[str, str]], steps: int = 150) -> Network | None:
    """The network of a sample; None without any window."""
    if not windows:
        return None
    labels = sorted({lang for lang, _ in windows})
    x, y = [], []
    for lang, w in windows:
        raw = np.frombuffer(w.encode(), np.uint8)
        if len(raw) < SEGMENT:
            raw = np.tile(raw, -(-SEGMENT // max(len(raw), 1)))[:SEGMENT]
        for i in range(0, len(raw) - SEGMENT + 1, SEGMENT):
            x.append(raw[i:i + SEGMENT])
            y.append(labels.index(lang))
    x, y = np.stack(x), np.array(y)
    # Languages in equal shares: the smaller ones are repeated.
    n = np.bincount(y, minlength=len(labels))
    pick = np.concatenate([np.resize(np.flatnonzero(y == k), n.max()) for k in range(len(labels))])
    return Network(labels).fit(x[pick], y[pick], steps)


_LOADED: dict[str, Network] = {}


def _network(key: str, blob: bytes) -> Network:
    if key not in _LOADED:
        _LOADED[key] = pickle.loads(blob)
    return _LOADED[key]


def identify(docs: DataFrame, network: Network | None, columns: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``columns`` of docs (default: all) plus ``lang_pred`` and ``score``.

    Only the text is an input. Null texts and texts without a letter (Unicode
    categories L) are ``und`` with score 0, and so is every text when nothing
    was learned. One row per row; on equal probabilities the first language by
    name. A column of docs with the name of an added one is handed on as
    ``in_<name>``.
    """
    keep = columns or docs.columns
    names = list(dict.fromkeys([*keep, text_col]))
    as_ = handed_on(keep, ["lang_pred", "score"])
    out = schema(*[field(docs, c, a) for c, a in zip(keep, as_)], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()))
    blob = pickle.dumps(network)
    key = hashlib.sha256(blob).hexdigest()

    def run(batches):
        net = _network(key, blob)
        for batch in slices(batches, text_col):
            has = [any(map(str.isalpha, t or "")) for t in batch.column(text_col).to_pylist()]
            buf, off = text_buffer(batch.column(text_col))
            if net is None:
                lang, score = [UNKNOWN] * len(has), [0.0] * len(has)
            else:
                p = net.predict(buf, off)
                best = p.argmax(1)
                lang = [net.labels[b] if h else UNKNOWN for b, h in zip(best.tolist(), has)]
                score = np.where(has, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             names=out.names)

    return docs.select(*names).mapInArrow(run, out)


def report(docs: DataFrame) -> DataFrame:
    """Learn from the folds other than 0, predict every document."""
    net = train(training_windows(docs))
    p = identify(docs, net, ["doc_id"])
    return p.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")

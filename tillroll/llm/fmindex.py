"""Substring deduplication with a compressed FM-index per shard.

Repeated word windows meet in shards (see ``windows``). A shard's index is the
Burrows-Wheeler transform of its segments, held in a wavelet matrix of packed
bits with block counts. The shard's segments are streamed against it: backward
search, one word per step for all window ends at once, narrows an interval of
the suffix order; the windows whose matching statistic reaches the threshold
are reported with the smallest document that holds them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm import tokens as K
from tillroll.llm import windows as W
from tillroll.llm.common import discard, handed_on, slices, text_buffer, written

WORDS = W.Units(size=13, gram=4, words=True, inside=False)
NO_ID = np.iinfo(np.int64).max  # stands for a null id: no document is larger
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("s", "e", "v")]))
RUNS_ARROW = pa.list_(pa.struct([(c, pa.int64()) for c in ("s", "e", "v")]))


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """Positions of s sorted by their next ``depth`` symbols at least (prefix doubling)."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    key = s[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).astype(np.int64)]))
    h = 1
    while h < depth:
        ahead = np.zeros(n, np.int64)
        ahead[:n - h] = rank[h:] + 1 if h < n else 0
        both = rank * (n + 1) + ahead
        order = np.argsort(both, kind="stable")
        key = both[order]
        new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        h *= 2
        if new[-1] == n - 1:
            break
    return order


class FmIndex:
    """Backward search over a sequence of symbols 0..sigma-1."""

    def __init__(self, s: np.ndarray, depth: int):
        self.sa = suffix_order(s, depth)
        self.n, sigma = len(s), int(s.max(initial=0)) + 1
        bwt = s[self.sa - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=sigma))])
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        cur = bwt
        for level in range(self.levels - 1, -1, -1):  # wavelet matrix, highest bit first
            bit = (cur >> level) & 1
            pad = np.zeros(-(-(self.n + 1) // 64) * 64, np.uint8)
            pad[:self.n] = bit
            packed = np.packbits(pad, bitorder="little").view("<u8")
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))])[:-1].astype(np.int32))
            self.zeros.append(int(self.n - bit.sum()))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])
        # Where each symbol's run starts on the last level.
        self.base = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            block = i >> 6
            ones = self.counts[k][block] + np.bitwise_count(
                self.words[k][block] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where((c >> level) & 1, self.zeros[k] + ones, i - ones)
        return i

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of c followed by what the intervals stand for."""
        start = self.first[c] - self.base[c]
        return start + self._descend(c, lo), start + self._descend(c, hi)

    def search(self, s: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of a text, capped: for each end (exclusive) the length of the
        longest match of at most ``length`` symbols that ends there, and its interval."""
        c = s[ends - 1]
        lo, hi = self.first[c].astype(np.int64), self.first[c + 1].astype(np.int64)
        found = (hi > lo).astype(np.int64)
        live = np.flatnonzero(found)
        for k in range(2, length + 1):
            if not len(live):
                break
            a, b = self.step(s[ends[live] - k], lo[live], hi[live])
            on = b > a
            live = live[on]
            lo[live], hi[live], found[live] = a[on], b[on], k
        return found, lo, hi


def shard(rows: pa.Table, size: int) -> list[tuple[int, int, list[dict]]]:
    """(anchor, seg, runs) per segment: windows [s, e) with the smallest id v that holds them."""
    content = [np.frombuffer(c, np.uint64) for c in rows.column("content").to_pylist()]
    first, least = rows.column("first").to_pylist(), rows.column("least").to_pylist()
    n = np.array([len(c) for c in content])
    words, ranks = np.unique(np.concatenate(content), return_inverse=True)
    begin = np.cumsum(n + 1) - (n + 1)
    s = np.zeros(int((n + 1).sum()), np.int64)  # 0 ends a segment
    at = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    s[at] = ranks + 1
    fm = FmIndex(s, size)
    ids = np.full(len(s), NO_ID, np.int64)
    ids[at] = np.repeat(np.array([NO_ID if x is None else x for x in least], np.int64), n)
    inside = n - size + 1
    owner = np.repeat(np.arange(len(n)), inside)
    start = np.arange(inside.sum()) - np.repeat(np.cumsum(inside) - inside, inside)
    matched, lo, hi = fm.search(s, begin[owner] + start + size, size)
    assert (matched == size).all()  # every window is in the index
    least_at = ids[fm.sa]
    ulo, inv = np.unique(lo, return_inverse=True)
    uhi = np.zeros(len(ulo), np.int64)
    uhi[inv] = hi
    pairs = np.stack([ulo, uhi], 1).ravel()
    best = np.minimum.reduceat(np.append(least_at, NO_ID), pairs)[::2][inv]
    cut = np.ones(len(best), bool)
    cut[1:] = (best[1:] != best[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(cut)
    tails = np.append(heads[1:], len(best))
    out: list[tuple[int, int, list[dict]]] = [(a, g, []) for a, g in zip(rows.column("anchor").to_pylist(), rows.column("seg").to_pylist())]
    for a, z in zip(heads.tolist(), tails.tolist()):
        o = int(owner[a])
        out[o][2].append({"s": first[o] + int(start[a]), "e": first[o] + int(start[z - 1]) + 1, "v": int(best[a])})
    return out


def runs_of(found: list[tuple[int, int, list[dict]]]) -> pa.Table:
    return pa.table({"anchor": pa.array([a for a, *_ in found], pa.int64()), "seg": pa.array([g for _, g, _ in found], pa.int64()),
                     "runs": pa.array([r for *_, r in found], RUNS_ARROW)})


RESULT = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("seg", T.LongType()), T.StructField("runs", RUNS)])


def repeated(docs: DataFrame, units: W.Units, id_col: str, text_col: str) -> DataFrame:
    """``(key, hits)``: per text the windows [s, e) that a smaller document holds too.

    ``docs`` has a column ``_key``, equal for equal (id, text).
    """
    bits = W.repeated_anchors(docs, units, text_col)
    rows = W.routed(docs, units, bits, "_key", id_col, text_col)
    copies, whole, hot, spent = W.distinct_segments(docs, rows, units, text_col, W.BUCKET_BYTES)
    copied = lambda c: c.select("anchor", "seg", F.array(F.struct(
        F.lit(0).cast("long").alias("s"), F.col("windows").alias("e"), F.coalesce("least", F.lit(NO_ID)).alias("v"))).alias("runs"))
    met, more = W.compared(whole, hot, units, lambda t: runs_of(shard(t, units.size)), RESULT, copied, W.BUCKET_BYTES)
    out = written(copied(copies).unionByName(met), "runs")
    discard(*spent, *more)
    places = rows.select("key", "id", "start", "anchor", "seg").distinct()  # once for all copies of a row
    hit = (places.join(out, ["anchor", "seg"])
           .select("key", "start", F.filter("runs", lambda r: r["v"] < F.coalesce("id", F.lit(NO_ID))).alias("runs")).where("size(runs) > 0")
           .select("key", F.expr("transform(runs, r -> struct(start + r.s as s, start + r.e as e))").alias("r")))
    return hit.groupBy("key").agg(F.flatten(F.collect_list("r")).alias("hits"))


def dedupe(docs: DataFrame, units: W.Units = WORDS, columns: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``columns`` of docs (default: all) plus n_words, n_removed, kept (the text left) and kept_sha256.

    A word goes if a window of ``units.size`` words that covers it also starts
    in a document with a smaller id. Rows with one id are not smaller than
    each other; a null id is larger than any. Null, empty and short texts lose
    nothing; kept words are joined by single spaces. One row per row. A column
    of docs with the name of an added one is handed on as ``in_<name>``.
    """
    keep = columns or docs.columns
    src = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)], F.col(id_col).cast("long").alias("_id"),
                      F.col(text_col).alias("_text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_key"))
    hits = repeated(src.select("_key", "_id", "_text"), units, "_id", "_text")
    both = src.join(hits.withColumnRenamed("key", "_key"), "_key", "left")
    names = [f"_c{i}" for i in range(len(keep))]
    added = [
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()),
        T.StructField("kept_sha256", T.StringType())]
    as_ = handed_on(keep, [f.name for f in added])
    out = T.StructType([T.StructField(a, docs.schema[c].dataType) for c, a in zip(keep, as_)] + added)

    def run(batches):
        for batch in slices(batches, "_text"):
            buf, off = text_buffer(batch.column("_text"))
            start, end, n = K.words(buf, off)
            first = np.concatenate([[0], np.cumsum(n)])
            raw, total, gone, texts = buf.tobytes(), [], [], []
            for d, hit in enumerate(batch.column("hits").to_pylist()):
                lo, hi = int(first[d]), int(first[d + 1])
                drop = np.zeros(hi - lo + 1, np.int64)
                for h in hit or ():
                    drop[h["s"]] += 1
                    drop[min(h["e"] - 1 + units.size, hi - lo)] -= 1
                left = lo + np.flatnonzero(np.cumsum(drop[:-1]) == 0)
                total.append(hi - lo)
                gone.append(hi - lo - len(left))
                texts.append(b" ".join([raw[a:z] for a, z in zip(start[left].tolist(), end[left].tolist())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(total, pa.int64()), pa.array(gone, pa.int64()),
                                                    pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()),
                                                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())], names=out.names)

    return both.select(*names, "_text", "hits").mapInArrow(run, out)


def report(docs: DataFrame) -> DataFrame:
    return dedupe(docs.select("doc_id", "text"), columns=["doc_id"]).select("doc_id", "n_words", "n_removed", "kept_sha256")

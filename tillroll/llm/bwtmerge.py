"""Suffix-array deduplication of byte strings by merging Burrows-Wheeler transforms.

Repeated 200-byte windows meet in buckets (see ``windows``). The segments of a
bucket form two shards with a suffix order and transform each; these are
merged by interleave refinement: starting from "all of one, then all of the
other", each pass sends the interleave through the transforms' symbols in a
stable counting sort and so settles eight more bytes of every suffix, without
sorting any suffix again. When the passes cover a window's length (or nothing
moves), the merged order has equal windows side by side: neighbours with a
common prefix of a window's length form one interval, and an interval that
counts two or more starts is repeated.

Symbols are strings of eight bytes, numbered in their order within the bucket,
with 0 after the end of a segment (0xFF, which UTF-8 never holds, makes room
for it). Buckets are small enough for 16-bit numbers and a core's cache.
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
from tillroll.llm.fmindex import RESULT, runs_of

STEP = 8  # bytes in a symbol, settled per pass
BUCKET = 48 << 10
BYTES = W.Units(size=200, gram=32, words=False, inside=True)


class Shard:
    """Suffix order and transform of some segments."""

    def __init__(self, contents: list[bytes], depth: int):
        size = np.array([len(c) for c in contents], np.int64)
        self.begin = np.cumsum(size + STEP) - (size + STEP)
        self.size = size
        end = b"\xff" * STEP
        raw = np.frombuffer(end.join(contents) + end if contents else b"", np.uint8)
        self.text = raw + np.uint8(1)  # the ends become 0
        n = len(self.text)
        pad = np.concatenate([self.text, np.zeros(8, np.uint8)])
        key = np.zeros(n, np.uint64)
        for j in range(STEP):
            key |= pad[j:n + j].astype(np.uint64) << np.uint64(56 - 8 * j)
        self.order = self._sorted(key, n, depth)
        # Predecessor one symbol on, round the segment's own end.
        back = np.arange(n) - STEP
        for j in range(STEP):
            back[self.begin + j] = self.begin + size + j
            key[self.begin + size + j] = 0
        self.symbols = key[back[self.order]]

    @staticmethod
    def _sorted(key: np.ndarray, n: int, depth: int) -> np.ndarray:
        """Suffixes sorted by their next ``depth`` bytes: eight at first, then doubling where tied."""
        order = np.argsort(key, kind="stable").astype(np.int32)
        k = key[order]
        new = np.ones(n, bool)
        new[1:] = k[1:] != k[:-1]
        rank = np.empty(n + depth + 8, np.int32)
        rank[n:] = 0
        rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]  # a group's rank is its first place
        h = 8
        while h < depth:
            tied = ~new
            tied[:-1] |= ~new[1:]
            at = np.flatnonzero(tied)
            if not len(at):
                break
            who = order[at]
            both = (rank[who].astype(np.int64) << 32) | rank[who + h]
            inner = np.argsort(both, kind="stable")
            who, both = who[inner], both[inner]
            order[at] = who
            fresh = np.ones(len(at), bool)
            fresh[1:] = both[1:] != both[:-1]
            new[at] = fresh
            places = at[fresh]
            rank[who] = places[np.cumsum(fresh) - 1]
            h *= 2
        return order


def interleave(a: np.ndarray, b: np.ndarray, passes: int) -> np.ndarray:
    """Which shard each place of the merged order comes from (True: b)."""
    values, number = np.unique(np.concatenate([a, b]), return_inverse=True)
    number = number.astype(np.uint16 if len(values) <= 1 << 16 else np.uint32)
    a, b = number[:len(a)], number[len(a):]
    z = np.zeros(len(number), bool)
    z[len(a):] = True
    merged = np.empty_like(number)
    for _ in range(passes):
        merged[np.flatnonzero(~z)] = a
        merged[np.flatnonzero(z)] = b
        after = z.take(np.argsort(merged, kind="stable"))
        if (after == z).all():
            break
        z = after
    return z


def bucket(rows: pa.Table, size: int) -> list[tuple[int, int, list[dict]]]:
    """(anchor, seg, runs) per segment: its repeated windows [s, e)."""
    content = rows.column("content").to_pylist()
    first, count = rows.column("first").to_pylist(), rows.column("n").to_numpy()
    half = np.arange(len(content)) % 2  # the shards
    sides = [[i for i in range(len(content)) if half[i] == k] for k in (0, 1)]
    shards = [Shard([content[i] for i in ids], size) for ids in sides]
    z = interleave(shards[0].symbols, shards[1].symbols, -(-size // STEP))
    shift = len(shards[0].text)
    order = np.empty(len(z), np.int64)
    order[~z], order[z] = shards[0].order, shards[1].order.astype(np.int64) + shift
    del z
    text = np.concatenate([s.text for s in shards])
    begin = np.concatenate([shards[0].begin, shards[1].begin + shift])
    length = np.concatenate([s.size for s in shards])
    seg = np.array(sides[0] + sides[1], np.int64)
    owner = np.repeat(np.arange(len(seg)), length + STEP)
    within = np.arange(len(text)) - begin[owner]
    starts = within <= length[owner] - size  # places where a window starts
    order = order[starts[order]]
    sums = K.prefix_sums(text)
    h = K.span_hashes(sums, order, order + size)
    new = np.ones(len(order), bool)  # a common prefix with the place before shorter than a window
    new[1:] = h[1:] != h[:-1]
    interval = np.cumsum(new) - 1
    times = np.bincount(interval, count[seg[owner[order]]])
    again = np.zeros(len(text), bool)
    again[order[times[interval] > 1]] = True
    out = [(a, g, []) for a, g in zip(rows.column("anchor").to_pylist(), rows.column("seg").to_pylist())]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], again, [False]]).astype(np.int8)))
    for a, e in zip(edge[::2].tolist(), edge[1::2].tolist()):  # the ends part the segments
        o = int(seg[owner[a]])
        out[o][2].append({"s": first[o] + int(within[a]), "e": first[o] + int(within[e - 1]) + 1, "v": 0})
    return [r for r in out if r[2]]


def repeated(docs: DataFrame, units: W.Units, text_col: str) -> DataFrame:
    """``(key, hits)``: per text the windows [s, e) that start anywhere else too."""
    bits = W.repeated_anchors(docs, units, text_col)
    rows = W.routed(docs, units, bits, "_key", None, text_col)
    copies, whole, hot, spent = W.distinct_segments(docs, rows, units, text_col, BUCKET)
    copied = lambda c: c.select("anchor", "seg", F.array(F.struct(
        F.lit(0).cast("long").alias("s"), F.col("windows").alias("e"), F.lit(0).cast("long").alias("v"))).alias("runs"))
    met, more = W.compared(whole, hot, units, lambda t: runs_of(bucket(t, units.size)), RESULT, copied, BUCKET)
    out = written(copied(copies).unionByName(met), "runs")
    discard(*spent, *more)
    places = rows.select("key", "start", "anchor", "seg").distinct()  # once for all copies of a text
    hit = (places.join(out, ["anchor", "seg"])
           .select("key", F.expr("transform(runs, r -> struct(start + r.s as s, start + r.e as e))").alias("r")))
    return hit.groupBy("key").agg(F.flatten(F.collect_list("r")).alias("hits"))


def dedupe(docs: DataFrame, units: W.Units = BYTES, columns: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``columns`` of docs (default: all) plus n_bytes, n_removed, spans and kept_sha256.

    Every byte covered by a string of ``units.size`` bytes that also starts
    anywhere else goes; spans are the maximal removed runs, [start, end).
    Null texts count as empty; texts shorter than a window lose nothing;
    repeated rows repeat each other. One row per row. A column of docs with the
    name of an added one is handed on as ``in_<name>``.
    """
    keep = columns or docs.columns
    src = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"))
    src = src.withColumn("_key", F.xxhash64("_text"))  # equal texts have equal spans
    hits = repeated(src.select("_key", "_text"), units, "_text")
    both = src.join(hits.withColumnRenamed("key", "_key"), "_key", "left")
    names = [f"_c{i}" for i in range(len(keep))]
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    added = [
        T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", span),
        T.StructField("kept_sha256", T.StringType())]
    as_ = handed_on(keep, [f.name for f in added])
    out = T.StructType([T.StructField(a, docs.schema[c].dataType) for c, a in zip(keep, as_)] + added)
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in slices(batches, "_text"):
            buf, off = text_buffer(batch.column("_text"))
            total, gone, spans, sha = [], [], [], []
            for d, hit in enumerate(batch.column("hits").to_pylist()):
                text = buf[off[d]:off[d + 1]]
                drop = np.zeros(len(text) + 1, np.int64)
                for h in hit or ():
                    drop[h["s"]] += 1
                    drop[h["e"] - 1 + units.size] -= 1
                removed = np.cumsum(drop[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], removed, [False]]).astype(np.int8)))
                total.append(len(text))
                gone.append(int(removed.sum()))
                spans.append([{"start": a, "end": e} for a, e in zip(edge[::2].tolist(), edge[1::2].tolist())])
                sha.append(hashlib.sha256(text[~removed].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, arrow),
                                                    pa.array(sha, pa.string())], names=out.names)

    return both.select(*names, "_text", "hits").mapInArrow(run, out)


def report(docs: DataFrame) -> DataFrame:
    d = dedupe(docs.select("doc_id", "text"), columns=["doc_id"])
    return d.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")

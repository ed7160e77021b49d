"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts are lower-cased (A-Z) and reduced to words of letters, digits and
non-ASCII characters, written as `` w1 w2 ... wn `` in UTF-8. Every window of
ten consecutive words of a benchmark item (or the whole of a shorter item) is
a pattern with a space on both ends, so byte occurrences are word occurrences.

Patterns of similar length form a class with its own minimal length m. Per
class: the SHIFT table holds, for the hash of a block of B bytes, how far the
search window may move on; a shift of 0 leads to the suffix-hash bucket, whose
patterns are compared directly. The text of a batch is cut into lanes of equal
length that walk in lockstep, one numpy step for all lanes.

Pattern bytes are measured before they are shipped to the tasks. Beyond
``max_pattern_bytes`` the windows are dealt into passes by hash, each pass
within the bound, and every document takes all the passes.
"""

from __future__ import annotations

import hashlib
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.common import bounded, discard, field, handed_on, schema, slices, text_buffer, worker_model, written

WINDOW = 10
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CLASS_FLOORS = (0, 8, 16, 32, 48)  # pattern classes by byte length
TABLE_BITS = 18
_ODD = np.uint64(0x9E3779B97F4A7C15)

# Byte -> lower-case word byte, or space. Bytes from 0x80 belong to non-ASCII
# characters, all of which are word characters.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words(col: Column) -> Column:
    """The words of a text as an array (null and wordless texts: empty)."""
    parts = F.split(F.translate(F.coalesce(col, F.lit("")), UPPER, LOWER), NON_WORD, -1)
    return F.filter(parts, lambda w: w != "")


def patterns(bench: DataFrame, window: int = WINDOW, text_col: str = "text",
             id_col: str = "item_id") -> DataFrame:
    """Distinct ``(pattern, items)`` of the benchmark; items are id strings.

    Items without words give no pattern; a null id is in no list of items.
    """
    w = bench.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
    w = w.where(F.size("w") > 0)
    n = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(n - F.lit(window - 1), F.lit(1)))
    p = w.select("item", F.explode(F.transform(
        starts, lambda i: F.concat(F.lit(" "), F.array_join(F.slice("w", i, F.lit(window)), " "), F.lit(" ")))).alias("pattern"))
    return p.groupBy("pattern").agg(F.sort_array(F.collect_set("item")).alias("items"))


class Matcher:
    """Wu-Manber tables for a list of byte patterns."""

    def __init__(self, pats: list[bytes]):
        self.pats = pats
        by_class: dict[int, list[int]] = {}
        for k, p in enumerate(pats):
            by_class.setdefault(max(i for i, f in enumerate(CLASS_FLOORS) if len(p) >= f), []).append(k)
        self.classes = [self._compile(ids) for ids in by_class.values()]

    def _compile(self, ids: list[int]) -> dict:
        m = min(len(self.pats[k]) for k in ids)
        b = min(8, max(1, m // 2))
        heads = np.frombuffer(b"".join(self.pats[k][:m] for k in ids), np.uint8).reshape(len(ids), m)
        shift = np.full(1 << TABLE_BITS, m - b + 1, np.int32)
        for end in range(b, m + 1):  # later ends give smaller shifts
            block = np.zeros((len(ids), 8), np.uint8)
            block[:, :b] = heads[:, end - b:end]
            shift[_hash(block.reshape(-1).view("<u8"))] = m - end
        buckets: dict[int, list[int]] = {}
        for k, h in zip(ids, _hash(block.reshape(-1).view("<u8")).tolist()):
            buckets.setdefault(h, []).append(k)
        return {"m": m, "b": b, "shift": shift, "buckets": buckets}

    def find(self, text: bytes, lane: int = 256) -> list[tuple[int, int]]:
        """All ``(start, pattern)`` occurrences in ``text``."""
        out: list[tuple[int, int]] = []
        n = len(text)
        padded = text + b"\0" * 8
        blocks = np.ndarray((n + 1,), "<u8", padded, 0, (1,))
        for c in self.classes:
            m, b, shift = c["m"], c["b"], c["shift"]
            mask = np.uint64((1 << (8 * b)) - 1)
            pos = np.arange(0, max(n - m + 1, 0), lane, dtype=np.int64)
            stop = np.minimum(pos + lane, n - m + 1)
            while len(pos):
                h = _hash(blocks[pos + (m - b)] & mask)
                s = shift[h]
                at = np.flatnonzero(s == 0)
                for start, bucket in zip(pos[at].tolist(), h[at].tolist()):
                    for k in c["buckets"].get(bucket, ()):
                        if text.startswith(self.pats[k], start):
                            out.append((start, k))
                pos = pos + np.maximum(s, 1)
                live = pos < stop
                pos, stop = pos[live], stop[live]
        return out


def _hash(block: np.ndarray) -> np.ndarray:
    return ((block * _ODD) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _compiled(blob: bytes) -> tuple[Matcher, list[list[str]]]:
    rows = pickle.loads(blob)
    return Matcher([p for p, _ in rows]), [i for _, i in rows]


def _hits(texts: list[bytes], found: list[tuple[int, int]], starts: np.ndarray, joined: bytes, lengths: list[int]):
    """Per text: merged word ranges ``[start, end)`` and matched patterns."""
    ranges: list[list[list[int]]] = [[] for _ in texts]
    pats: list[set[int]] = [set() for _ in texts]
    if found:
        pos = np.array([s for s, _ in found])
        doc = np.searchsorted(starts, pos, side="right") - 1
        spaces = np.cumsum(np.frombuffer(joined, np.uint8) == 32)
        first = spaces[pos] - spaces[starts[doc]]
        order = np.lexsort((first, doc))
        for j in order.tolist():
            d, lo, k = int(doc[j]), int(first[j]), found[j][1]
            hi = lo + lengths[k]
            pats[d].add(k)
            r = ranges[d]
            if r and lo <= r[-1][1]:
                r[-1][1] = max(r[-1][1], hi)
            else:
                r.append([lo, hi])
    return ranges, pats


def _scan_pass(docs: DataFrame, key: str, blob: bytes, names: list[str], text_col: str, more: bool) -> DataFrame:
    """This pass's hits in the columns ``_n_words``, ``_ranges``, ``_items``, with ``more`` added to what they hold."""
    out = T.StructType([field(docs, c) for c in names] + [
        T.StructField("_n_words", T.LongType()),
        T.StructField("_ranges", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("_items", T.ArrayType(T.StringType()))])

    def run(batches):
        m, items = worker_model(key, lambda: _compiled(blob))
        lengths = [p.count(b" ") - 1 for p in m.pats]
        for batch in slices(batches, text_col):
            buf, off = text_buffer(batch.column(text_col))
            raw, n_words, texts = buf.tobytes().translate(FOLD), [], []
            for a, z in zip(off[:-1].tolist(), off[1:].tolist()):
                w = raw[a:z].split()
                n_words.append(len(w))
                texts.append(b" " + b" ".join(w) + b" ")
            joined = b"\n".join(texts)
            starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]]).astype(np.int64)
            ranges, pats = _hits(texts, m.find(joined), starts, joined, lengths)
            got = [sorted({i for k in p for i in items[k]}) for p in pats]
            if more:
                before = batch.column("_ranges").to_pylist(), batch.column("_items").to_pylist()
                ranges = [(x or []) + r for x, r in zip(before[0], ranges)]
                got = [sorted({*(x or []), *g}) for x, g in zip(before[1], got)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names]
                + [pa.array(n_words, pa.int64()), pa.array(ranges, pa.list_(pa.list_(pa.int64()))),
                   pa.array(got, pa.list_(pa.string()))], names=[*names, "_n_words", "_ranges", "_items"])

    return bounded(docs).mapInArrow(run, out)


def scan(docs: DataFrame, bench: DataFrame, columns: list[str] | None = None, window: int = WINDOW,
         text_col: str = "text", item_text: str = "text", item_id: str = "item_id",
         max_pattern_bytes: int = 32 << 20) -> DataFrame:
    """Search every whole text of ``docs`` for the windows of ``bench``.

    Returns ``columns`` of docs (default: all) plus ``n_words``, ``hits``
    (word ranges ``[start, end)`` covered by occurrences) and ``items``
    (ids, as strings, of the items with an occurring window; an item of null
    id counts for ``hits`` alone). One row per row
    of docs; null, empty and wordless texts have no words and no hits, and an
    empty benchmark gives no hits. A benchmark of more than
    ``max_pattern_bytes`` is searched for in passes, written one by one. A
    column of docs with the name of an added one is handed on as ``in_<name>``.
    """
    keep = columns or docs.columns
    names = [*[f"_c{i}" for i in range(len(keep))], "_text"]
    pats = patterns(bench.select(item_id, item_text), window, item_text, item_id)
    size = pats.agg(F.sum(F.octet_length("pattern") + F.size("items") * 16)).first()[0] or 0
    passes = max(1, math.ceil(size / max_pattern_bytes))
    df = docs.select(*[F.col(c).alias(n) for c, n in zip([*keep, text_col], names)])
    for k in range(passes):
        part = pats if passes == 1 else pats.where(F.pmod(F.xxhash64("pattern"), F.lit(passes)) == k)
        rows = sorted((r["pattern"].encode(), r["items"]) for r in part.collect())  # within max_pattern_bytes
        blob = pickle.dumps(rows)
        before, df = df, _scan_pass(df, hashlib.sha256(blob).hexdigest(), blob, names, "_text", k > 0)
        if passes > 1:  # no plan holds the patterns of more than one pass
            df = written(df, "pass")
            discard(before)
    ranges = F.array_sort("_ranges")
    if passes > 1:
        ranges = F.aggregate(ranges, F.expr("cast(array() as array<array<bigint>>)"), _merge)
    as_ = handed_on(keep, ["n_words", "hits", "items"])
    return df.select(*[F.col(n).alias(a) for n, a in zip(names, as_)], F.col("_n_words").alias("n_words"), ranges.alias("hits"), F.col("_items").alias("items"))


def _merge(acc: Column, r: Column) -> Column:
    """Fold sorted ranges into disjoint ones."""
    last = F.element_at(acc, -1)
    joins = (F.size(acc) > 0) & (F.get(r, F.lit(0)) <= F.get(last, F.lit(1)))
    merged = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1),
                      F.array(F.array(F.get(last, F.lit(0)), F.greatest(F.get(last, F.lit(1)), F.get(r, F.lit(1))))))
    return F.when((F.size(acc) > 0) & F.coalesce(joins, F.lit(False)), merged).otherwise(F.concat(acc, F.array(r)))


def report(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Digest columns per document: counts, hash of the item ids, flag."""
    s = scan(docs, bench, ["doc_id"])
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, r: a + F.get(r, F.lit(1)) - F.get(r, F.lit(0)))
    return s.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
                    (n_hit > 0).alias("contaminated"))

"""Where fixed-length windows of many texts can repeat.

A window is a run of ``size`` units (words or bytes) of one text. Its anchor is
the least hash among its grams (runs of ``gram`` units), so equal windows have
equal anchors. Consecutive windows with one anchor form a segment. A segment
whose anchor occurs only once in the corpus holds no repeated window; the
others are routed by anchor, equal segments collapsed into one row with their
number and smallest id, and each bucket of anchors is searched by the caller's
index. An anchor with more content than a bucket is routed once more, by the
units around its gram. Nothing is lost on the way: anchors and buckets only
decide where windows meet.

Which anchors occur twice is told to the tasks by a bitmap of bounded size:
beyond its bound, more data make it denser (more segments are routed in vain),
never larger, and nothing is missed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm import tokens as K
from tillroll.llm.common import count_rows, discard, slices, text_buffer, written

LEAST_BITS, MOST_BITS = 20, 30  # a bitmap has between 128 kB and 128 MB
PROBE = 17  # bits of a hash from one place in a bitmap to the next
MAX_RUN = 4  # a segment holds at most so many times ``size`` windows
BUCKET_BYTES = 4 << 20  # content of a bucket
SINGLE_BYTES = 128 << 10  # content cut into single windows at once
LONG = T.LongType()


@dataclass(frozen=True)
class Units:
    """What a window is made of."""

    size: int  # units in a window
    gram: int  # units in a gram
    words: bool  # words, or bytes
    inside: bool  # whether a repeat inside one document counts

    def hashes(self, buf: np.ndarray, off: np.ndarray):
        """(unit hashes or bytes, units per text, gram hashes, hash of any run)."""
        if self.words:
            start, end, n = K.words(buf, off)
            unit = K.span_hashes(K.prefix_sums(buf), start, end)
            sums = np.zeros(len(unit) + 1, np.uint64)
            np.cumsum(unit * K.powers(len(unit))[0][:len(unit)], out=sums[1:])
        else:
            unit, n, sums = buf, np.diff(off), K.prefix_sums(buf)
        return unit, n, self.grams(sums), sums

    def grams(self, sums: np.ndarray) -> np.ndarray:
        """Hashes of all grams, from the prefix sums of the units."""
        m = max(0, len(sums) - self.gram)
        grams = (sums[self.gram:self.gram + m] - sums[:m]) * K.powers(len(sums))[1][:m]
        grams ^= grams >> np.uint64(32)
        grams *= np.uint64(0x9E3779B97F4A7C15)
        return grams


def slide_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    n = len(x) - w + 1
    if n <= 0:
        return np.zeros(0, x.dtype)
    rows = -(-len(x) // w)
    pad = np.full(rows * w, np.iinfo(x.dtype).max, x.dtype)
    pad[:len(x)] = x
    pad = pad.reshape(rows, w)
    head = np.minimum.accumulate(pad, 1).ravel()
    tail = np.minimum.accumulate(pad[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[w - 1:w - 1 + n])


def segments(u: Units, buf: np.ndarray, off: np.ndarray):
    """Segments of a batch: (text, first unit in it, windows, anchor, times, content getter, hash)."""
    unit, n, grams, sums = u.hashes(buf, off)
    least = slide_min(grams, u.size - u.gram + 1)
    first = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    begin, end = first[:-1], first[1:]
    brk = np.zeros(len(least) + 1, bool)
    brk[0] = True
    brk[1:-1] = least[1:] != least[:-1]
    for edge in (begin, np.maximum(begin, end - u.size + 1)):  # where a text's windows start and stop
        brk[edge[edge < len(brk)]] = True
    brk[-1] = True
    cuts = np.flatnonzero(brk)
    run, length = cuts[:-1], np.diff(cuts)
    owner = np.searchsorted(first, run, side="right") - 1
    ok = run + u.size <= first[np.minimum(owner + 1, len(n))]
    run, length, owner = run[ok], length[ok], owner[ok]
    cap = MAX_RUN * u.size
    if len(length) and length.max() > cap:  # cut long runs (texts of one period)
        parts = -(-length // cap)
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        run, owner = np.repeat(run, parts) + inner * cap, np.repeat(owner, parts)
        length = np.minimum(np.repeat(length, parts) - inner * cap, cap)
    start, anchor = run, K.mix(least[run])  # a least hash is small; spread it again
    end = start + length + u.size - 1
    times = np.ones(len(run), np.int64)
    if u.inside and len(run):  # is the anchor's gram in the text more than once?
        table = np.zeros(1 << 22, bool)
        low = least[run]
        table[(low >> np.uint64(34)) & np.uint64((1 << 22) - 1)] = True
        hit = np.flatnonzero(table[(grams >> np.uint64(34)) & np.uint64((1 << 22) - 1)])
        home = np.searchsorted(first, hit, side="right") - 1
        hit, home = hit[hit + u.gram <= first[home + 1]], home[hit + u.gram <= first[home + 1]]
        key = K.mix(grams[hit] ^ (home.astype(np.uint64) * np.uint64(K.BASE)))
        vals, counts = np.unique(key, return_counts=True)
        mine = K.mix(low ^ (owner.astype(np.uint64) * np.uint64(K.BASE)))
        times = np.minimum(counts[np.minimum(np.searchsorted(vals, mine), len(vals) - 1)], 2)
    return {"doc": owner, "start": start - first[owner], "windows": length, "anchor": anchor.view(np.int64), "times": times,
            "hash": K.span_hashes(sums, start, end).view(np.int64) if len(run) else np.zeros(0, np.int64),
            "unit": unit, "from": start, "to": end}


def repeated_anchors(docs: DataFrame, u: Units, text_col: str) -> np.ndarray:
    """Bitmap (packed bits) over the leading bits of anchors that occur twice or more."""
    out = T.StructType([T.StructField("anchor", LONG), T.StructField("times", LONG)])

    def run(batches):
        for batch in slices(batches, text_col):
            s = segments(u, *text_buffer(batch.column(text_col)))
            a, t = s["anchor"], s["times"]
            if not u.inside:  # once per document
                o = np.lexsort((a, s["doc"]))
                keep = np.ones(len(o), bool)
                keep[1:] = (a[o][1:] != a[o][:-1]) | (s["doc"][o][1:] != s["doc"][o][:-1])
                a, t = a[o][keep], t[o][keep]
            v, c = np.unique(a, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(np.minimum(np.bincount(c, t, len(v)), 2).astype(np.int64))], names=out.names)

    twice = docs.select(text_col).mapInArrow(run, out).groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1")
    twice = written(twice, "twice")
    bits = bitmap(twice, "anchor")
    discard(twice)
    return bits


def bitmap(df: DataFrame, column: str, probes: int = 1) -> np.ndarray:
    """Bitmap of a column of hashes, ``probes`` places for each by other bits of it: eight bits for each, 128 MB at most."""
    bits = min(max(LEAST_BITS, (8 * count_rows(df)).bit_length()), MOST_BITS)
    # the bitmap functions number positions from 1
    places = [F.shiftrightunsigned(F.shiftleft(column, PROBE * k), 64 - bits) + 1 for k in range(probes)]
    place = F.col("place")
    maps = (df.select((places[0] if probes == 1 else F.explode(F.array(*places))).alias("place"))
            .groupBy(F.bitmap_bucket_number(place).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in maps.toLocalIterator():  # at most 2^MOST_BITS bits in all
        lo = (r["bucket"] - 1) * 4096
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        if 0 <= lo < len(out):
            out[lo:lo + 4096] |= part[:len(out) - lo]
    return out


def may_have(bits: np.ndarray, h: np.ndarray, probes: int = 1) -> np.ndarray:
    """Whether each hash may be in the bitmap of as many probes (never a wrong no)."""
    u, down = h.view(np.uint64), np.uint64(64 - (len(bits) * 8).bit_length() + 1)
    got = np.ones(len(u), bool)
    for k in range(probes):
        p = ((u << np.uint64(PROBE * k)) >> down).astype(np.int64)
        got &= (bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0
    return got


def routed(docs: DataFrame, u: Units, bits: np.ndarray, key: str, ident: str | None, text_col: str) -> DataFrame:
    """Written segments that may hold repeats, by their hashes: (key, id, start, windows, anchor, times, seg)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bits.tobytes())  # bounded size
    out = T.StructType([T.StructField(c, LONG) for c in ("key", "id", "start", "windows", "anchor", "times", "seg")])

    def run(batches):
        seen = np.frombuffer(shared.value, np.uint8)
        for batch in slices(batches, text_col):
            s = segments(u, *text_buffer(batch.column(text_col)))
            pick = np.flatnonzero(may_have(seen, s["anchor"]))
            d = pa.array(s["doc"][pick])
            ids = batch.column("id").take(d) if ident else pa.nulls(len(pick), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(d), ids, *[pa.array(s[c][pick]) for c in ("start", "windows", "anchor", "times", "hash")]],
                names=out.names)

    src = docs.select(F.col(key).alias("key"), *([F.col(ident).cast("long").alias("id")] if ident else []), text_col)
    return written(src.mapInArrow(run, out), "segments")


def contents(docs: DataFrame, u: Units, anchors: DataFrame, text_col: str) -> DataFrame:
    """``(anchor, seg, content)`` of the segments of ``anchors`` (and of a few more), cut out of the texts anew; each once."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(anchors, "anchor").tobytes())  # bounded size
    out = T.StructType([T.StructField("anchor", LONG), T.StructField("seg", LONG), T.StructField("content", T.BinaryType())])

    def run(batches):
        seen = np.frombuffer(shared.value, np.uint8)
        for batch in slices(batches, text_col):
            s = segments(u, *text_buffer(batch.column(text_col)))
            pick = np.flatnonzero(may_have(seen, s["anchor"]))
            pick = pick[np.lexsort((s["hash"][pick], s["anchor"][pick]))]
            anchor, seg = s["anchor"][pick], s["hash"][pick]
            one = np.ones(len(pick), bool)
            one[1:] = (anchor[1:] != anchor[:-1]) | (seg[1:] != seg[:-1])
            pick, unit = pick[one], s["unit"].astype(np.uint64) if u.words else s["unit"]
            content = [unit[a:z].tobytes() for a, z in zip(s["from"][pick].tolist(), s["to"][pick].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(anchor[one]), pa.array(seg[one]), pa.array(content, pa.binary())], names=out.names)

    return docs.select(text_col).mapInArrow(run, out).groupBy("anchor", "seg").agg(F.first("content").alias("content"))


def distinct_segments(docs: DataFrame, rows: DataFrame, u: Units, text_col: str, bucket_bytes: int = BUCKET_BYTES
                      ) -> tuple[DataFrame, DataFrame, DataFrame | None, list[DataFrame | None]]:
    """Distinct segments: those whose anchor has one variant, and the rest in two parts; and the written frames they read.

    The first, (anchor, seg, windows, n, least), are copies: each window occurs
    as often as the segment. The rest, with content, are to be compared;
    contents are cut out and shuffled for these alone. The second have a bucket
    of anchors that holds about ``bucket_bytes``. The third, None where there
    are none, belong to anchors with more content: these are routed again.
    """
    d = written(rows.groupBy("anchor", "seg").agg(
        F.max("windows").alias("windows"), F.max("times").alias("times"), F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    return _dealt(d, lambda anchors: contents(docs, u, anchors, text_col), u, bucket_bytes)


def _dealt(d: DataFrame, content_of: Callable[[DataFrame], DataFrame], u: Units, bucket_bytes: int
           ) -> tuple[DataFrame, DataFrame, DataFrame | None, list[DataFrame | None]]:
    """As ``distinct_segments``, from the distinct segments (anchor, seg, windows, times, least, n)."""
    width = 8 if u.words else 1
    size = d.groupBy("anchor").agg(F.sum((F.col("windows") + u.size - 1) * width).alias("bytes"),
                                   F.sum("n").alias("all"), F.count(F.lit(1)).alias("variants"), F.max("times").alias("inner"),
                                   F.min("seg").alias("seg"), F.max("windows").alias("windows"), F.min("least").alias("least"))
    plain = (F.col("variants") == 1) & (F.col("all") > 1) & (F.col("inner") == 1)
    copies = size.where(plain).select("anchor", "seg", "windows", F.col("all").alias("n"), "least")  # one variant: its own figures
    rest = written(size.where(~plain & ((F.col("all") > 1) | (F.col("inner") > 1))).select("anchor", "bytes"), "anchors")
    fits = F.col("bytes") <= bucket_bytes
    total, large = rest.agg(F.sum(F.when(fits, F.col("bytes"))), F.count(F.when(~fits, True))).first()
    buckets = max(1, (total or 0) // bucket_bytes)

    def with_content(anchors: DataFrame) -> DataFrame:
        return content_of(anchors).join(d.join(anchors, "anchor"), ["anchor", "seg"])

    whole = with_content(rest.where(fits)).select("anchor", "seg", "windows", "n", "least", "content",
                                                  F.pmod(F.xxhash64("anchor"), F.lit(buckets)).cast("long").alias("bucket"))
    hot = written(with_content(rest.where(~fits)).select("anchor", "seg", "n", "least", "content"), "hot") if large else None
    return copies, whole, hot, [d, rest, hot]


def narrowed(hot: DataFrame, u: Units, width: int, bits: np.ndarray | None = None, content: bool = False) -> DataFrame:
    """``(anchor, seg, first, sub, part, windows, n, least)``, and ``content`` if asked for: segments in narrower ones.

    A window's place is where its anchor's gram first stands in it. Consecutive
    windows whose gram is the same one, and whose places agree but for the
    remainder by ``width``, share all but ``width`` - 1 of their units; ``sub``
    is the hash of what they share, and so equal for equal windows. ``part`` is
    the narrower segment's hash, ``first`` its first window. At a width of 1 it
    is a single window. With ``bits``, a bitmap, only subs that may be in it.
    """
    bytes_each = 8 if u.words else 1
    places = u.size - u.gram + 1
    names = ("anchor", "seg", "first", "sub", "part", "windows", "n", "least")
    out = T.StructType([T.StructField(c, LONG) for c in names] + ([T.StructField("content", T.BinaryType())] if content else []))
    shared = hot.sparkSession.sparkContext.broadcast(bits.tobytes()) if bits is not None else None  # bounded size

    def run(batches):
        for batch in slices(batches, "content", SINGLE_BYTES):
            parts = batch.column("content").to_pylist()
            raw = b"".join(parts)
            length = np.array([len(p) // bytes_each for p in parts], np.int64)
            begin, count = np.cumsum(length) - length, length - u.size + 1
            if u.words:
                unit = np.frombuffer(raw, np.uint64)
                sums = np.zeros(len(unit) + 1, np.uint64)
                np.cumsum(unit * K.powers(len(unit))[0][:len(unit)], out=sums[1:])
            else:
                sums = K.prefix_sums(np.frombuffer(raw, np.uint8))
            grams = u.grams(sums)
            least = slide_min(grams, places)[begin]  # the anchor's gram, of all windows of a segment
            hit = np.flatnonzero(grams == np.repeat(least, length)[:len(grams)])
            row = np.repeat(np.arange(len(parts)), count)
            at = begin[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            gram = hit[np.searchsorted(hit, at)]
            kind = (gram - at) // width
            cut = np.ones(len(at) + 1, bool)
            cut[1:-1] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1]) | (kind[1:] != kind[:-1])
            cuts = np.flatnonzero(cut)
            head, windows = cuts[:-1], np.diff(cuts)
            row, start, gram, kind = row[head], at[head], gram[head], kind[head]
            end = start + windows + u.size - 1
            stop = gram - np.minimum((kind + 1) * width, places) + 1 + u.size
            sub = K.span_hashes(sums, gram - kind * width, stop) ^ (kind.astype(np.uint64) * np.uint64(K.BASE))
            sub = K.mix(sub ^ batch.column("anchor").to_numpy().view(np.uint64)[row])
            pick = np.arange(len(row)) if shared is None else np.flatnonzero(may_have(np.frombuffer(shared.value, np.uint8), sub))
            row, start, end, windows, sub = row[pick], start[pick], end[pick], windows[pick], sub[pick]
            of = lambda c: batch.column(c).take(pa.array(row))  # noqa: B023,E731
            cols = [of("anchor"), of("seg"), pa.array(start - begin[row]), pa.array(sub.view(np.int64)),
                    pa.array(K.span_hashes(sums, start, end).view(np.int64)), pa.array(windows), of("n"), of("least")]
            if content:
                cols.append(pa.array([raw[a:z] for a, z in zip((start * bytes_each).tolist(), (end * bytes_each).tolist())], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=out.names)

    return hot.select("anchor", "seg", "n", "least", "content").mapInArrow(run, out)


def _searched(whole: DataFrame, search: Callable[[pa.Table], pa.Table], result: T.StructType) -> DataFrame:
    first = F.lit(0).cast("long").alias("first")
    return whole.select("bucket", "anchor", "seg", first, "n", "least", "content").groupBy("bucket").applyInArrow(search, result)


def _brought_back(answers: DataFrame, places: DataFrame) -> DataFrame:
    """Answers (anchor, seg, runs) for narrower segments, as one row for each segment that holds some."""
    moved = F.expr("transform(runs, r -> struct(first + r.s as s, first + r.e as e, r.v as v))")
    back = places.select("anchor", "seg", "first", "sub", "part").join(
        answers.select(F.col("anchor").alias("sub"), F.col("seg").alias("part"), "runs"), ["sub", "part"])
    return back.select("anchor", "seg", moved.alias("runs")).groupBy("anchor", "seg").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def compared(whole: DataFrame, hot: DataFrame | None, u: Units, search: Callable[[pa.Table], pa.Table], result: T.StructType,
             copied: Callable[[DataFrame], DataFrame], bucket_bytes: int) -> tuple[DataFrame, list[DataFrame | None]]:
    """``result``, (anchor, seg, runs), of the segments to be compared, and the written frames it reads.

    ``search`` finds the runs in a bucket, ``copied`` gives those of copies.
    Segments of anchors with more content than a bucket are routed again, as
    narrower ones by what these share, an eighth of the places each. Those that
    are still too many are single windows; of these the repeated ones are
    searched, once each, with the number and the least id of all their places.
    """
    found = _searched(whole, search, result)
    if hot is None:
        return found, []
    width = -(-(u.size - u.gram + 1) // 8)

    def distinct(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col("sub").alias("anchor"), F.col("part").alias("seg")).agg(
            F.max("windows").alias("windows"), F.lit(1).cast("long").alias("times"), F.min("least").alias("least"), F.sum("n").alias("n"))

    def content_of(source: DataFrame, w: int) -> Callable[[DataFrame], DataFrame]:
        return lambda subs: (narrowed(source, u, w, bitmap(subs, "anchor"), True)
                             .groupBy(F.col("sub").alias("anchor"), F.col("part").alias("seg")).agg(F.first("content").alias("content")))

    d = written(distinct(narrowed(hot, u, width)), "narrow")
    copies, some, many, spent = _dealt(d, content_of(hot, width), u, bucket_bytes)
    answers = copied(copies).unionByName(_searched(some, search, result))
    if many is not None:
        one = written(distinct(narrowed(many, u, 1)).where("n > 1"), "single")
        buckets = max(1, count_rows(one) * u.size * (8 if u.words else 1) // bucket_bytes)
        single = content_of(many, 1)(one).join(one, ["anchor", "seg"]).withColumn(
            "bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)).cast("long"))
        held = narrowed(many, u, 1, bitmap(one, "anchor"))
        answers = answers.unionByName(_brought_back(_searched(single, search, result), held))
        spent = [*spent, one]
    answers = written(answers, "answers")
    return found.unionByName(_brought_back(answers, narrowed(hot, u, width, bitmap(answers, "anchor")))), [*spent, answers]

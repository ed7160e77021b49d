"""Target-distribution importance resampling over hashed word n-grams.

A 256-byte table lower-cases A-Z and blanks every ASCII separator of the UTF-8
bytes, ``bytes.split`` yields the words, and chained ``zlib.crc32`` seeds extend
a run of words to the next size without joining it. One ``Counter`` per task
counts buckets; Spark sums the tasks' counters. The ratio of a bucket's share
in the target to its share in the source is its gain, a document's weight is
the sum over its features, and adding one Gumbel number per document makes the
highest scores a draw without replacement.

Two narrow passes read the texts; what is shuffled is one row per task and
bucket, and one row of numbers per document for the ranking. The gains are
``buckets`` numbers, whatever the size of the corpus.

Defined results: a null text is empty; an empty or wordless text has no
features and weight 0. A null id is hashed as an empty one and ranks after
equal scores with an id. Rows that repeat an id are documents of their own;
among equal scores and ids the smaller weight comes first. Empty tables give
gains of 0 and no draw. Only the id and text columns are read, so no other
column can clash.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.common import field, slices, text_buffer, written
from tillroll.operators.ranking import global_rank

SIZES = (1, 1)  # smallest and largest run of words
BUCKETS = 10_000
PERCENT = 10
LEAST_WORDS = 20
SEED = 2024

BLOCK = 1 << 20  # bytes of one text split at once
CACHE_BYTES = 8 << 20

TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
              for c in range(256))


class _Seeds(dict):
    """crc32 by word, forgotten as a whole when the words kept pass a number of bytes."""

    def __init__(self):
        super().__init__()
        self.held = 0

    def __missing__(self, word: bytes) -> int:
        c = zlib.crc32(word)
        if len(word) <= 64:
            self.held += len(word) + 150  # with the objects around it
            if self.held > CACHE_BYTES:
                self.clear()
                self.held = 0
            self[word] = c
        return c


def word_blocks(data: bytes, block: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of one text, in lists from about ``block`` bytes each."""
    data = data.translate(TABLE)
    at = 0
    while at < len(data):
        end = len(data) if len(data) - at <= block else data.find(b" ", at + block)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def runs(data: bytes, sizes: tuple[int, int], seed_of: _Seeds, block: int = BLOCK) -> Iterator[tuple[int, list[int]]]:
    """Per block of a text: its number of words, and the crc32 of every run that ends in it."""
    low, high = sizes
    carry: list[bytes] = []
    for words in word_blocks(data, block):
        old, n = len(carry), len(words)
        words = carry + words
        crc, out = [seed_of[w] for w in words], []
        for k in range(1, high + 1):
            if k > 1:
                crc = [zlib.crc32(w, zlib.crc32(b" ", c)) for w, c in zip(words[k - 1:], crc)]
            if k >= low:
                out += crc[max(0, old - k + 1):]
        yield n, out
        carry = words[max(0, len(words) - high + 1):] if high > 1 else []


def _texts(batches, text_col: str):
    for batch in slices(batches, text_col):
        buf, off = text_buffer(batch.column(text_col))
        raw = buf.tobytes()
        yield batch, (raw[a:z] for a, z in zip(off[:-1].tolist(), off[1:].tolist()))


def bucket_counts(texts: DataFrame, sizes: tuple[int, int] = SIZES, buckets: int = BUCKETS,
                  text_col: str = "text") -> DataFrame:
    """``(bucket, n)``: how many features of all whole texts fall into each bucket."""
    def run(batches):
        seed_of, total = _Seeds(), Counter()
        for _, raws in _texts(batches, text_col):
            for raw in raws:
                for _, crcs in runs(raw, sizes, seed_of):
                    total.update([c % buckets for c in crcs])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())],
                                         names=["bucket", "n"])

    return (texts.select(text_col).mapInArrow(run, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Gain of every bucket, from two frames of ``bucket_counts``.

    At most ``buckets`` rows of each come to the driver.
    """
    s, t = ({r["bucket"]: r["n"] for r in df.collect()} for df in (source, target))
    n_s, n_t = sum(s.values()), sum(t.values())
    return [math.floor(1000 * math.log((t.get(b, 0) + 1.0) * (n_s + buckets) / ((s.get(b, 0) + 1.0) * (n_t + buckets))))
            for b in range(buckets)]


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)) with u from the hash of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weigh(docs: DataFrame, gain: list[int], sizes: tuple[int, int] = SIZES, seed: int = SEED,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score)`` per row of docs."""
    buckets = len(gain)
    out = T.StructType([field(docs, id_col, "doc_id"), *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]])

    def run(batches):
        seed_of = _Seeds()
        for batch, raws in _texts(batches, text_col):
            cols = ([], [], [])
            for raw in raws:
                n_words = n_features = weight = 0
                for n, crcs in runs(raw, sizes, seed_of):
                    n_words += n
                    n_features += len(crcs)
                    weight += sum([gain[c % buckets] for c in crcs])
                for col, v in zip(cols, (n_words, n_features, weight)):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *[pa.array(c, pa.int64()) for c in cols]], names=out.names)

    w = docs.select(id_col, text_col).mapInArrow(run, out)
    return w.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, sizes: tuple[int, int] = SIZES,
             buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: int = SEED,
             id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """Draw ``percent`` of the documents with at least ``least_words`` words.

    Returns ``doc_id, n_words, n_features, weight, score, rank`` for every row
    of docs; ``rank`` counts the drawn ones from the highest score down and is
    null for the others. The numbers per document are written once; the ranks
    come from a range partitioning of them, without a single-task window.
    """
    gain = gains(bucket_counts(docs, sizes, buckets, text_col), bucket_counts(target, sizes, buckets, target_text), buckets)
    w = written(weigh(docs, gain, sizes, seed, id_col, text_col), "resample")
    enough = F.col("n_words") >= least_words
    draw = percent * (w.agg(F.count(F.when(enough, 1))).first()[0] or 0) // 100
    order = [F.when(enough, 0).otherwise(1).asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(),
             F.col("weight").asc(), F.col("n_features").asc()]
    ranked = global_rank(w, order, "rank")
    return ranked.withColumn("rank", F.when(enough & (F.col("rank") <= draw), F.col("rank")))


def report(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Contract columns per document."""
    return resample(docs, bench).select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = r"""
WITH tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
                          lambda c, x: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
texts AS (
  SELECT 'd' AS side, row_number() OVER () AS k, doc_id, text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
words AS (
  SELECT side, k, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
counts AS (SELECT side, k, w, count(*) AS n FROM words GROUP BY ALL),
crcs AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT,
                list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT)),
                lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::BIGINT) % 10000 AS bucket
  FROM (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM counts)), tab),
sums AS (
  SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t
  FROM counts JOIN crcs USING (w) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM sums),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all + 10000)
                                 / ((coalesce(s, 0)::DOUBLE + 1) * (t_all + 10000))))::BIGINT AS g FROM sums, totals),
weights AS (
  SELECT k, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight
  FROM counts JOIN crcs USING (w) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY k),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
                                                     + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM texts LEFT JOIN weights USING (k) WHERE side = 'd'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id ASC NULLS LAST, weight, n_features) AS r,
         count(*) FILTER (n_features >= 20) OVER () AS n_all
  FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND r <= 10 * n_all // 100 THEN r END AS rank
FROM ranked
"""

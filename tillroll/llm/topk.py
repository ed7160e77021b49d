"""Exact top-k by inner product: no-random-access aggregation over sorted lists.

Every component is a list of the rows sorted by it, read from the top for a
positive query weight and from the bottom for a negative one. Reading all
lists to a depth gives each row a lower and an upper bound on its score: the
values read count as they are, an unread one lies between the end of its list
and the value read last (the frontier). Rows, seen or not, whose upper bound
stays below the k-th best lower bound cannot qualify and are left behind; the
scores of the rest are resolved by reading their lists to the end.

Rows and queries are dealt into blocks of bounded size; each pair of blocks is
one task's work and yields k rows per query, merged by query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.common import count_rows

ROWS = 8192  # rows per block
QUERIES = 512  # queries per block
DEPTHS = (0.125, 0.25, 0.5)  # shares of the lists read before the bounds are compared


def quantised(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(id, v)`` with v = floor(scale * x) as long, one row per id.

    Rows with a null id or vector, or with a null or non-finite component,
    take no part. Of several rows with one id the smallest vector counts.
    """
    x = F.col(vec_col)
    ok = F.forall(x, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return (vectors.select(F.col(id_col).cast("long").alias("id"), F.when(ok, v).alias("v"))
            .where("id IS NOT NULL AND v IS NOT NULL").groupBy("id").agg(F.min("v").alias("v")))


def nra(x: np.ndarray, q: np.ndarray, k: int, depths: tuple[float, ...] = DEPTHS) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of x stay in play for each query, and the score matrix of these rows.

    Returns (rows, scores): indices of rows that could qualify for some query,
    and the exact scores, queries by rows; rows out of play for a query hold
    the least integer.
    """
    n, d = x.shape
    big = d * max(1, int(np.abs(x).max(initial=0))) * max(1, int(np.abs(q).max(initial=0)))
    kind = np.float64 if big < 1 << 53 else np.int64  # exact either way
    xs, pos, neg = x.astype(kind), np.maximum(q, 0).astype(kind), np.minimum(q, 0).astype(kind)
    lists = np.sort(xs, axis=0)
    rows, alive = np.arange(n), np.ones((len(q), n), bool)
    for share in depths if n > 4 * k else ():
        t = max(k, int(n * share))
        top, bottom = lists[n - t], lists[t - 1]  # frontiers; ties with them are read too
        part = xs[rows]
        upper = pos @ np.maximum(part, top).T + neg @ np.minimum(part, bottom).T
        lower = pos @ np.where(part >= top, part, lists[0]).T + neg @ np.where(part <= bottom, part, lists[-1]).T
        if len(rows) <= k:
            break
        bar = np.partition(lower, len(rows) - k, axis=1)[:, len(rows) - k]
        alive &= upper >= bar[:, None]
        stay = alive.any(axis=0)
        rows, alive = rows[stay], alive[:, stay]
    scores = (pos @ xs[rows].T + neg @ xs[rows].T).astype(np.int64)
    scores[~alive] = np.iinfo(np.int64).min
    return rows, scores


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per query the k best columns, the earlier column on equal scores."""
    m = scores.shape[1]
    if m > 4 * k:
        bar = np.partition(scores, m - k, axis=1)[:, m - k]
        at_q, at_c = np.nonzero(scores >= bar[:, None])
    else:
        at_q, at_c = np.nonzero(np.ones(scores.shape, bool))
    s = scores[at_q, at_c]
    keep = s > np.iinfo(np.int64).min
    at_q, at_c, s = at_q[keep], at_c[keep], s[keep]
    order = np.lexsort((at_c, -s, at_q))
    at_q, at_c = at_q[order], at_c[order]
    first = np.searchsorted(at_q, at_q)
    top = np.arange(len(at_q)) - first < k
    return at_q[top], at_c[top]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k best rows of ``vectors`` for every row of ``queries``, exactly.

    Both have (id, v). Vectors of another length than the query's, and the
    query's own id, are no candidates. Returns (query_id, rank, id, score),
    ties to the smaller id; a query without candidates has no row.
    """
    n, m = count_rows(vectors), count_rows(queries)
    row_blocks, query_blocks = max(1, math.ceil(n / ROWS)), max(1, math.ceil(m / QUERIES))
    block = lambda c, b: F.pmod(F.xxhash64(c), F.lit(b)).cast("int")  # noqa: E731  (both sides of the cogroup need one key type)
    every = lambda b: F.explode(F.sequence(F.lit(0), F.lit(b - 1)))
    left = vectors.select("id", "v", F.size("v").alias("dim"), block("id", row_blocks).alias("rb"), every(query_blocks).alias("qb"))
    right = queries.select("id", "v", F.size("v").alias("dim"), block("id", query_blocks).alias("qb"), every(row_blocks).alias("rb"))
    out = T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "id", "score")])

    def run(rows: pa.Table, qs: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if rows.num_rows and qs.num_rows:
            rid, qid = rows.column("id").to_numpy(), qs.column("id").to_numpy()
            dim = rows.column("dim")[0].as_py()
            x = rows.column("v").combine_chunks().flatten().to_numpy().reshape(len(rid), dim)
            q = qs.column("v").combine_chunks().flatten().to_numpy().reshape(len(qid), dim)
            order = np.argsort(rid, kind="stable")
            rid, x = rid[order], x[order]
            at, scores = nra(x, q, k + 1)  # one more: the query's own row may be among them
            scores[rid[at][None, :] == qid[:, None]] = np.iinfo(np.int64).min
            a, b = _best(scores, k)
            found = [(qid[a], rid[at][b], scores[a, b])]
        cols = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3)]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(out.names, cols)})

    near = left.groupBy("rb", "qb", "dim").cogroup(right.groupBy("rb", "qb", "dim")).applyInArrow(run, out)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return near.select("query_id", rank.alias("rank"), "id", "score").where(F.col("rank") <= k)


def report(vectors: DataFrame, k: int = 5) -> DataFrame:
    """Ids divisible by 50 against all other rows."""
    v = quantised(vectors)
    s = search(v, v.where("id % 50 = 0"), k)
    return s.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""

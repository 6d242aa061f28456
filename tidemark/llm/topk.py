"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, cut, table

#: Queries of one block, bins of one histogram, rows scored at once.
BLOCK = 2048
BINS = 1024
ROWS = 1024
_MAX = 2**63 - 1


def _vectors(batch: pa.RecordBatch):
    """Groups of equally long vectors: (ids, matrix of floor(1024 x) as float64).

    Vectors that are null or hold a null or a non-finite component are left out, as
    are rows without an id.
    """
    col = batch.column(1)
    lengths = pc.list_value_length(col).to_numpy(zero_copy_only=False)
    ids = batch.column(0)
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[~np.isnan(lengths)] if lengths.dtype.kind == "f" else lengths):
        if d == 0:
            continue
        rows = np.flatnonzero((lengths == d) & known)
        if not len(rows):
            continue
        flat = col.take(pa.array(rows)).flatten().cast(pa.float64())
        x = flat.to_numpy(zero_copy_only=False).reshape(len(rows), int(d))  # null: NaN
        ok = np.isfinite(x).all(1)
        if ok.any():
            take = ids.take(pa.array(rows[ok])).cast(pa.int64()).to_numpy()
            yield take, np.floor(x[ok] * 1024.0)


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products, rows by queries, exact; held to 64 bits."""
    most = np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * x.shape[1]
    if most < 2**53:
        return (x @ q.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    got = exact(x) @ exact(q).T
    return np.clip(got, -_MAX, _MAX).astype(np.int64)


def _scored(batches, block):
    """(ids, query numbers, scores) for each slice; the query's own row gets no score."""
    for b in batches:
        for ids, x in _vectors(b):
            at = np.flatnonzero([len(v) == x.shape[1] for v in block["vectors"]])
            if not len(at):
                continue
            q = np.stack([block["vectors"][i] for i in at])
            for lo in range(0, len(ids), ROWS):
                part = ids[lo : lo + ROWS]
                s = _scores(x[lo : lo + ROWS], q)
                yield part, at, s, part[:, None] != block["ids"][at][None, :]


def _histogram(block, lows, width, k):
    """Counts of scores by query and bin; only the top bins up to ``k`` scores.

    The k-th highest of all is never below the k-th highest of a task's own rows, so
    the lower bins of a task can't matter.
    """

    def run(batches):
        state = block.value
        low = np.array(lows, dtype=object)
        counts = np.zeros((len(low), BINS), dtype=np.int64)
        above = np.zeros(len(low), dtype=np.int64)
        for _, at, s, free in _scored(batches, state):
            if width * BINS >= 2**62:  # differences may pass 64 bits
                bins = ((s.astype(object) - low[at][None, :]) // width).astype(np.int64)
            else:
                bins = (s - low[at].astype(np.int64)[None, :]) // width
            above[at] += ((bins >= BINS) & free).sum(0)
            inside = free & (bins >= 0) & (bins < BINS)
            r, c = np.nonzero(inside)
            counts += np.bincount(at[c] * BINS + bins[r, c], minlength=counts.size).reshape(counts.shape)
        top = counts[:, ::-1].cumsum(1) + above[:, None]
        needed = (top - counts[:, ::-1] < k)[:, ::-1] & (counts > 0)
        qs, bs = np.nonzero(needed)
        yield pa.RecordBatch.from_arrays(
            [pa.array(qs.astype(np.int64)), pa.array(bs.astype(np.int64)), pa.array(counts[qs, bs])],
            names=["q", "bin", "n"],
        )

    return run


def _filter(block, kth, need, k):
    """Rows above the k-th score, and of those equal to it the smallest ids."""

    def run(batches):
        state = block.value
        kth_ = np.array(kth, dtype=np.int64)
        ties: dict[int, np.ndarray] = {}
        for ids, at, s, free in _scored(batches, state):
            r, c = np.nonzero(free & (s > kth_[at][None, :]))
            yield _rows(state["ids"][at[c]], ids[r], s[r, c])
            r, c = np.nonzero(free & (s == kth_[at][None, :]))
            for j in np.unique(c):
                q = int(at[j])
                both = np.concatenate([ties.get(q, ids[:0]), ids[r[c == j]]])
                ties[q] = np.sort(both)[: max(need[q], 0)]
        for q, ids in ties.items():
            yield _rows(np.repeat(state["ids"][q : q + 1], len(ids)), ids, np.repeat(kth_[q : q + 1], len(ids)))

    return run


def _rows(q, v, s):
    return pa.RecordBatch.from_arrays(
        [pa.array(q.astype(np.int64)), pa.array(v.astype(np.int64)), pa.array(s.astype(np.int64))],
        names=["query_id", "vec_id", "score"],
    )


def _bound(batches):
    """The largest component of all, as a power of two."""
    most = 0.0
    for b in batches:
        for _, x in _vectors(b):
            most = max(most, float(np.abs(x).max()))
    yield pa.RecordBatch.from_arrays([pa.array([most])], names=["most"])


def _select(vectors: DataFrame, ids, rows, most: float, k: int) -> DataFrame:
    """Exact top ``k`` for one block of queries."""
    spark = vectors.sparkSession
    block = spark.sparkContext.broadcast({"ids": np.array(ids, dtype=np.int64), "vectors": rows})
    n = len(ids)
    reach = [int(min(np.abs(v).sum() * max(most, 1.0) * 1.001 + 2, 2.0**62)) for v in rows]
    lows = [-r for r in reach]
    span = max(reach) * 2 + 1
    width = 1
    while width * BINS < span:
        width *= BINS
    need = [k] * n
    kth = [-_MAX - 1] * n  # all rows, if there are fewer than k
    while True:
        got = vectors.transform(arrow, _histogram(block, lows, width, k), "q long, bin long, n long")
        down = Window.partitionBy("q").orderBy(F.desc("bin"))
        got = got.groupBy("q", "bin").agg(F.sum("n").alias("n"))
        got = got.withColumn("run", F.sum("n").over(down))
        needs = spark.createDataFrame([(q, need[q]) for q in range(n)], "q long, need long")
        hit = (
            got.join(needs, "q")
            .filter((F.col("run") >= F.col("need")) & (F.col("run") - F.col("n") < F.col("need")))
            .select("q", "bin", (F.col("need") - (F.col("run") - F.col("n"))).alias("rest"))
        )
        found = {r.q: r for r in hit.collect()}  # one row for each query of the block
        for q in range(n):
            if q in found:
                lows[q] += found[q].bin * width
                need[q] = found[q].rest
                kth[q] = lows[q]
        if width == 1 or not found:
            break
        width //= BINS
    return vectors.transform(arrow, _filter(block, kth, need, k), "query_id long, vec_id long, score long")


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The ``k`` rows of highest integer inner product for each query.

    Components become floor(1024 * x). Queries are taken in blocks of BLOCK; each
    block is broadcast and scored against every row. A first histogram of all
    scores locates the bin that holds each query's k-th highest, further ones
    refine that bin until it is one score. Then rows above it are kept, and as many
    equal to it as are missing, smaller ids first. A task reports only its top bins
    and at most the missing number of ties, so equal vectors never meet in a task.

    Returns query_id, rank (from 1), vec_id, score. A query has fewer rows if there
    are fewer candidates; every row but those with the query's own id is one.
    Vectors that are null or empty, or hold null or non-finite components, and rows
    without an id take no part; vectors of another length than the query's are no
    candidates of it. Repeated ids: each row is a candidate; queries of one id are one
    query, of the smallest of their vectors that are finite. Scores beyond 64 bits are held at the limit. Empty tables give
    an empty result.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    most = v.transform(arrow, _bound, "most double").agg(F.max("most")).first()[0] or 0.0
    parts: list[DataFrame] = []
    ids: list[int] = []
    rows: list[np.ndarray] = []

    def flush() -> None:
        if ids:
            parts.append(_select(v, ids, rows, most, k))
            if len(parts) > 1 or len(ids) == BLOCK:
                parts[-1] = cut(parts[-1], "topk")
        ids.clear()
        rows.clear()

    finite = lambda c: c.isNotNull() & (F.abs(c) < float("inf"))  # noqa: E731  (NaN is larger)
    asked = asked.filter(F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", finite))
    for r in asked.groupBy("id").agg(F.min("v").alias("v")).toLocalIterator():
        ids.append(r.id)
        rows.append(np.floor(np.array(r.v, dtype=np.float64) * 1024.0))
        if len(ids) == BLOCK:
            flush()
    flush()
    if not parts:
        parts = [spark.createDataFrame([], "query_id long, vec_id long, score long")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return top_k(v, v.filter(F.col("vec_id") % 100 == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""

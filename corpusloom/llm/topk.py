"""Exact top-k by inner product through distributed histogram selection.

Vectors are turned into integers, floor(1024 x), once. Queries come in blocks of
at most QUERY_BLOCK, which are broadcast; the candidates are scored against a
block in each round. A first round counts scores in BINS bins over each query's
range; further rounds refine the bin that holds the kth score, until it is one
score wide. A last round keeps what lies above, and of the ties at the kth score
the smallest ids that are still needed; each task hands on k rows a query at
most, and so does each step that merges them.

Cases: vectors that are null or hold null or non-finite components take no part,
nor do rows with a null vec_id; a candidate with the query's vec_id is its own
row; repeated candidates count as often as they are there, repeated queries
once; fewer than k candidates are all returned; ties go to the smaller vec_id;
an empty table gives an empty result; a query meets candidates of its own length
only, and vectors without components score 0 with each other; a component whose
integer passes 63 bits and a score of 2**62 or more are refused with an error;
other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import durable, durable_parts, table

K, SCALE = 10, 1024
#: Queries that are broadcast at once (with 64 components, 4 MB).
QUERY_BLOCK = 8192
BINS = 256
#: Largest score: the distance of two scores fits 63 bits.
LARGEST = 2**62 - 1
#: Scores that are held at once.
CELLS = 1 << 22


def integers(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v (array of long) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    integer = lambda c: F.when(F.abs(c * scale) < F.lit(2.0**63), F.floor(c * scale)).otherwise(F.raise_error(F.lit("component too large")).cast("long"))
    return df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, integer).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exact: in doubles where no sum can pass 2**53, in Python's integers where one could pass LARGEST."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < LARGEST:
        return a @ b.T
    out = a.astype(object) @ b.T.astype(object)
    if out.size and max(abs(out.min()), abs(out.max())) > LARGEST:
        raise ValueError("a score is too large")
    return out.astype(np.int64)


def _scores(queries: np.ndarray, ids: np.ndarray, batches: Iterator[pa.RecordBatch]):
    """(candidate ids, scores by query and candidate, which are not the query's own row)."""
    rows = max(1, CELLS // max(1, len(ids)))
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            own = part.column("vec_id").to_numpy()
            yield own, _product(queries, _matrix(part.column("v"), queries.shape[1])), ids[:, None] != own


def _histogram(queries, ids, low, width):
    """Counts of the scores in BINS bins of each query's width from its low on; bin BINS: above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(ids), BINS + 1), np.int64)
        for _, s, other in _scores(queries, ids, batches):
            at = (s - low[:, None]) // width[:, None]
            ok = other & (at >= 0)
            cell = np.arange(len(ids))[:, None] * (BINS + 1) + np.minimum(at, BINS)
            total += np.bincount(cell[ok], minlength=total.size).reshape(total.shape)
        q, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(b, pa.int32()), pa.array(total[q, b], pa.int64())], names=["q", "bin", "n"])

    return run


def _best(queries, ids, least, k):
    """Of the scores of at least `least`, each task's k best of each query by (score, smaller id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, c, s = (np.empty(0, np.int64) for _ in range(3))
        for own, score, other in _scores(queries, ids, batches):
            i, j = np.nonzero((score >= least[:, None]) & other)
            q, c, s = np.concatenate([q, i]), np.concatenate([c, own[j]]), np.concatenate([s, score[i, j]])
            order = np.lexsort((c, -s, q))
            q, c, s = q[order], c[order], s[order]
            first = np.searchsorted(q, np.arange(len(ids)))
            keep = np.arange(len(q)) - first[q] < k
            q, c, s = q[keep], c[keep], s[keep]
        yield pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.int64())], names=["query_id", "vec_id", "score"])

    return run


def _thresholds(vectors: DataFrame, queries: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Each query's kth best score, or what is below all where there are fewer."""
    norm = np.abs(queries).astype(object).sum(1)
    most = vectors.agg(F.max(F.array_max(F.transform("v", lambda c: F.abs(c))))).first()[0] or 0
    high = np.array([min(int(x) * most, LARGEST) for x in norm], np.int64)
    low = none = -high
    few = np.zeros(len(ids), bool)
    while True:
        width = np.maximum(1, -(-(high - low + 1) // BINS))
        rows = vectors.mapInArrow(_histogram(queries, ids, low, width), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros((len(ids), BINS + 1), np.int64)  # bounded by the block, whatever the number of candidates
        counts[rows.column("q").to_numpy(), rows.column("bin").to_numpy()] = rows.column("n").to_numpy()
        down = counts[:, ::-1].cumsum(1)
        reach = down >= k
        few |= ~reach.any(1)
        at = BINS - reach.argmax(1)
        at = np.where(few, 0, np.minimum(at, BINS - 1))
        low, high = low + at * width, low + (at + 1) * width - 1
        if (few | (width == 1)).all():
            return np.where(few, none, low)


def top_k(df: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every row but the query's own, for the rows of df where is_query holds."""
    spark = df.sparkSession
    vectors = durable(integers(df, scale), "topk-vectors")
    chosen = durable(integers(df.where(is_query), scale).groupBy("vec_id").agg(F.min("v").alias("v")), "topk-queries")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))

    def blocks() -> Iterator[DataFrame]:
        lengths = chosen.groupBy(F.size("v").alias("length")).count().orderBy("length").collect()  # a row for each length of a vector
        for length, n in lengths:
            same, own = vectors.where(F.size("v") == length), chosen.where(F.size("v") == length)
            last = None
            for _ in range(0, n, query_block):
                part = (own if last is None else own.where(F.col("vec_id") > last)).orderBy("vec_id").limit(query_block).toArrow()
                ids = part.column("vec_id").to_numpy()
                last = int(ids[-1])
                queries = _matrix(part.column("v").combine_chunks(), length)
                least = _thresholds(same, queries, ids, k)
                best = same.mapInArrow(_best(queries, ids, least, k), "query_id long, vec_id long, score long")
                yield best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    return durable_parts(blocks(), spark, "query_id long, rank int, vec_id long, score long", "topk-found")


def op6_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

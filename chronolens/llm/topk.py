"""Exact top-k search by distributed histogram selection.

Queries come in blocks of bounded size. For each block every candidate is scored; global histograms of the scores,
first coarse, then ever finer inside the bin that holds the kth score, locate each query's kth score exactly. A last
scoring keeps what lies above it and, of the candidates equal to it, the smallest ids. A task reports only bins at or
above its own kth best, which cannot hide the global one, so its report stays near k rows a query whatever it reads.

Defined cases: vectors that are null or hold null, NaN or infinite components take no part, nor do rows without vec_id;
rows of one vec_id count once (the smallest vector); shorter vectors count as padded with zeros; with fewer than k
candidates all are returned; scores of 2**62 and beyond raise OverflowError; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import store, table
from .vectors import QUERY_STEP, matrix, prepared, query_blocks

WIDTHS = (256, 16, 1)
QUERIES_AT_ONCE = 2048
ROWS_AT_ONCE = 2048
NONE = -(2**62)


def inner_products(queries: np.ndarray, vecs: np.ndarray) -> np.ndarray:
    """Exact products of whole numbers. Beyond 2**53 they are formed modulo 2**64, which is exact for results below 2**62."""
    widest = [float(np.abs(x.astype(float)).max(initial=0)) for x in (queries, vecs)]
    near = queries.astype(float) @ vecs.astype(float).T
    bound = widest[0] * widest[1] * max(1, queries.shape[1])
    if bound < 2**53:
        return near.astype(np.int64)
    if np.abs(near).max(initial=0) + bound * queries.shape[1] * 2.0**-51 >= 2**62:
        raise OverflowError("scores do not fit 62 bits")
    return queries @ vecs.T


def _counted(q: np.ndarray, bins: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of n by (q, bin), in that order."""
    order = np.lexsort((bins, q))
    q, bins, n = q[order], bins[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (bins[1:] != bins[:-1])])) if len(q) else np.empty(0, np.int64)
    return q[first], bins[first], np.add.reduceat(n, first) if len(q) else n


def _scored(batches: Iterator[pa.RecordBatch], ids: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate ids and the scores of all queries against them; a query's own row scores NONE."""
    dim = queries.shape[1]
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(lo, ROWS_AT_ONCE)
            rows, vecs = part.column("vec_id").to_numpy(), matrix(part.column("v"), dim)
            scores = inner_products(queries, vecs)
            own, at = np.nonzero(ids[:, None] == rows[None, :])
            scores[own, at] = NONE
            yield rows, scores


def _histogram(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, width: int, within: tuple | None) -> DataFrame:
    """q, bin, n: how many scores of query q fall into bin (score // width), near the top; within: (wider width, bin of each q)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.full(len(ids), NONE, np.int64)
        held = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        for _, scores in _scored(batches, ids, queries):
            if within:
                keep = (scores // within[0] == within[1][:, None]) & (scores > NONE)
            else:
                if scores.shape[1] >= k:
                    floor = np.maximum(floor, np.partition(scores, -k, axis=1)[:, -k] // width * width)
                keep = (scores >= floor[:, None]) & (scores > NONE)
            q, at = np.nonzero(keep)
            own = q.astype(np.int64), scores[q, at] // width, np.ones(len(q), np.int64)
            held = _counted(*(np.concatenate(pair) for pair in zip(held, own, strict=True)))
            if not within:  # bins that can no longer hold the kth score
                top = held[1] >= floor[held[0]] // width
                held = tuple(x[top] for x in held)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["q", "bin", "n"])

    return vectors.mapInArrow(count, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))


def kth_scores(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The kth largest score of each query (NONE: fewer candidates) and how many scores are larger."""
    above, kth, within = np.zeros(len(ids), np.int64), np.full(len(ids), NONE, np.int64), None
    for width in WIDTHS:
        down = Window.partitionBy("q").orderBy(F.desc("bin"))
        missing = F.element_at(F.lit((k - above).tolist()), F.col("q").cast("int") + 1)
        reached = (
            _histogram(vectors, ids, queries, k, width, within)
            .withColumn("upto", F.sum("n").over(down))
            .filter((F.col("upto") >= missing) & (F.col("upto") - F.col("n") < missing))
            .select("q", "bin", (F.col("upto") - F.col("n")).alias("over")).collect()
        )
        bins = np.full(len(ids), NONE, np.int64)
        for q, bin_, over in reached:  # one row a query of the block
            bins[q] = bin_
            above[q] += over
            kth[q] = bin_ * width
        within = (width, bins)
    return kth, above


def _select(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, kth: np.ndarray, above: np.ndarray) -> DataFrame:
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ties: list[list[int]] = [[] for _ in ids]
        for rows, scores in _scored(batches, ids, queries):
            q, at = np.nonzero((scores > kth[:, None]) & (scores > NONE))
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(rows[at]), pa.array(scores[q, at])], ["query_id", "vec_id", "score"])
            equal = (scores == kth[:, None]) & (kth > NONE)[:, None]
            for i in np.nonzero(equal.any(axis=1))[0].tolist():
                ties[i] = sorted([*ties[i], *rows[equal[i]].tolist()])[: k - int(above[i])]
        q = np.repeat(np.arange(len(ids)), [len(t) for t in ties])
        rows = np.array([r for t in ties for r in t], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(rows), pa.array(kth[q])], ["query_id", "vec_id", "score"])

    return vectors.mapInArrow(pick, "query_id long, vec_id long, score long")


def top_k(embeddings: DataFrame, k: int = 20, scale: int = 64, query_step: int = QUERY_STEP) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of every query row with all other rows."""
    vectors, dim = prepared(embeddings, "long", lambda x: F.floor(x * scale))
    found = None
    for ids, queries in query_blocks(vectors, dim, QUERIES_AT_ONCE, query_step):
        kth, above = kth_scores(vectors, ids, queries, k)
        block = store(_select(vectors, ids, queries, k, kth, above))
        found = block if found is None else found.unionByName(block)
    if found is None:
        found = embeddings.sparkSession.createDataFrame([], "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

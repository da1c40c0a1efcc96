"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard, results of shards merged.

Rows are dealt over shards of bounded size by a hash of vec_id. Within a shard equal vectors share a node; vectors get
one more component so that all have one length, which turns the largest inner product into the smallest distance. Layers
are built from the top by inserting batches: the nearest of all inserted so far as candidates (one matrix product a batch,
which the size of a shard bounds), diverse neighbours among them, links both ways.
A shard's index is one row of flat arrays. Queries come in bounded blocks, every block descends through every shard's
graph in step, and the merged candidates are ranked by inner products of the original vectors in double precision.

Defined cases: vectors that are null, zero, or hold null, NaN or infinite components take no part, nor do rows without
vec_id; rows of one vec_id count once (the smallest vector); shorter vectors count as padded with zeros; with fewer
than k candidates all are returned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import store, table
from .vectors import QUERY_STEP, matrix, prepared, query_blocks

SHARD_ROWS = 8192
LINKS, LINKS_BELOW = 16, 32
EF_BUILD, EF_SEARCH = 96, 144
EXPAND, BATCH = 4, 512
QUERIES_AT_ONCE = 2048


def beam(queries: np.ndarray, vectors: np.ndarray, links: np.ndarray, entries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (-1: none) and inner products of the ef best nodes found from the entries, best first, for each query."""
    n = len(queries)
    ids, near = np.full((n, ef), -1, np.int32), np.full((n, ef), -np.inf, np.float32)
    ids[:, 0], near[:, 0] = entries, np.einsum("bd,bd->b", queries, vectors[entries])
    open_ = ids >= 0
    seen = np.zeros((n, len(vectors)), bool)
    seen[np.arange(n), entries] = True
    live = np.arange(n)
    while len(live):
        rank = np.argsort(-np.where(open_[live], near[live], -np.inf), axis=1)[:, : min(EXPAND, ef)]
        rows = live[:, None]
        usable = open_[rows, rank]
        open_[rows, rank] = False
        fresh = np.where(usable[:, :, None], links[ids[rows, rank]], -1).reshape(len(live), -1)
        fresh.sort(axis=1)
        ok = fresh >= 0
        ok[:, 1:] &= fresh[:, 1:] != fresh[:, :-1]
        ok &= ~seen[rows, fresh]
        seen[np.broadcast_to(rows, fresh.shape)[ok], fresh[ok]] = True
        scores = np.full(fresh.shape, -np.inf, np.float32)
        at, _ = np.nonzero(ok)
        scores[ok] = np.einsum("bd,bd->b", queries[live[at]], vectors[fresh[ok]])
        all_near = np.concatenate([near[live], scores], axis=1)
        best = np.argpartition(-all_near, ef - 1, axis=1)[:, :ef]
        take = np.arange(len(live))[:, None]
        ids[live] = np.concatenate([ids[live], np.where(ok, fresh, -1).astype(np.int32)], axis=1)[take, best]
        near[live] = all_near[take, best]
        open_[live] = np.concatenate([open_[live], ok], axis=1)[take, best]
        live = live[open_[live].any(axis=1)]
    order = np.argsort(-near, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)


def diverse(base: np.ndarray, ids: np.ndarray, vectors: np.ndarray, count: int) -> np.ndarray:
    """Of candidate nodes (rows of ids, -1: none) up to count for each base vector: those nearer to it than to any chosen before, then the nearest others."""
    out = np.full((len(ids), count), -1, np.int32)
    for lo in range(0, len(ids), 256):
        own = ids[lo : lo + 256]
        some = vectors[own]
        near = np.where(own >= 0, np.einsum("bd,bmd->bm", base[lo : lo + 256], some), -np.inf)
        order = np.argsort(-near, axis=1, kind="stable")
        own, near = np.take_along_axis(own, order, 1), np.take_along_axis(near, order, 1)
        some = vectors[own]
        between = some @ some.transpose(0, 2, 1)
        taken = np.zeros(own.shape, bool)
        worst = np.full(own.shape, -np.inf, np.float32)  # likeness to the nearest one chosen so far
        for k in range(own.shape[1]):
            pick = (own[:, k] >= 0) & (near[:, k] > worst[:, k]) & (taken.sum(axis=1) < count)
            taken[:, k] = pick
            worst = np.where(pick[:, None], np.maximum(worst, between[:, k]), worst)
        first = np.argsort(np.where(taken, 0, np.where(own >= 0, 1, 2)), axis=1, kind="stable")[:, :count]
        out[lo : lo + 256, : first.shape[1]] = np.take_along_axis(own, first, 1)
    return out


class Graph:
    """Layers from the top: nodes of a layer are the first sizes[l] nodes in order; links[l] has a row for each."""

    def __init__(self, vectors: np.ndarray, seed: int = 3):
        n = len(vectors)
        level = np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int)
        self.order = np.argsort(-level, kind="stable")
        self.vectors = vectors[self.order]
        self.sizes = [int((level >= k).sum()) for k in range(int(level.max(initial=0)), -1, -1)]
        self.links: list[np.ndarray] = []
        for depth, size in enumerate(self.sizes):
            self._build(depth, size, LINKS_BELOW if depth == len(self.sizes) - 1 else LINKS)

    def descend(self, queries: np.ndarray) -> np.ndarray:
        entries = np.zeros(len(queries), np.int32)
        for links in self.links:
            entries = beam(queries, self.vectors[: len(links)], links, entries, 4)[0][:, 0]
        return entries

    def _build(self, depth: int, size: int, degree: int) -> None:
        vectors, links = self.vectors[:size], np.full((size, degree), -1, np.int32)
        done = 0
        while done < size:
            new = np.arange(done, min(size, done + max(64, min(BATCH, done))))
            base = vectors[new]
            inner = base @ vectors[: new[-1] + 1].T
            inner[np.arange(len(new)), new] = -np.inf
            width = min(EF_BUILD, inner.shape[1])
            ids = np.argpartition(-inner, width - 1, axis=1)[:, :width].astype(np.int32)
            ids[ids == new[:, None]] = -1
            chosen = diverse(base, ids, vectors, degree // 2 if depth == len(self.sizes) - 1 else degree)
            links[new, : chosen.shape[1]] = chosen
            self._link_back(links, vectors, new, chosen, degree)
            done = new[-1] + 1
        self.links.append(links)

    def _link_back(self, links: np.ndarray, vectors: np.ndarray, new: np.ndarray, chosen: np.ndarray, degree: int) -> None:
        source, target = np.repeat(new, chosen.shape[1]), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        near = np.einsum("bd,bd->b", vectors[source], vectors[target])
        order = np.lexsort((-near, target))
        source, target = source[order], target[order]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, counts)
        keep = place < degree
        more = np.full((len(nodes), degree), -1, np.int32)
        more[np.repeat(np.arange(len(nodes)), counts)[keep], place[keep]] = source[keep]
        both = np.concatenate([links[nodes], more], axis=1)
        both.sort(axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        links[nodes] = diverse(vectors[nodes], both, vectors, degree)


def build_shard(rows: pa.Table, dim: int) -> pa.Table:
    ids, raw = rows.column("vec_id").to_numpy(), matrix(rows.column("v"), dim)
    unique, node = np.unique(raw, axis=0, return_inverse=True)
    node = node.ravel()
    length = np.einsum("nd,nd->n", unique, unique)
    extra = np.sqrt(np.maximum(length.max() - length, 0))[:, None]
    scale = 1.0 / np.sqrt(length.max())
    graph = Graph((np.concatenate([unique, extra], axis=1) * scale).astype(np.float32))
    rank = np.empty(len(unique), np.int64)
    rank[graph.order] = np.arange(len(unique))
    by = np.lexsort((ids, rank[node]))
    starts = np.concatenate([[0], np.cumsum(np.bincount(rank[node], minlength=len(unique)))])
    links = np.concatenate([x.ravel() for x in graph.links])
    shapes = np.array([x.shape for x in graph.links], np.int64).ravel()
    parts = {"vec_ids": ids[by], "starts": starts, "vectors": unique[graph.order], "graph": graph.vectors, "links": links, "shapes": shapes}
    return pa.table({"shard": rows.column("shard").slice(0, 1), **{k: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for k, v in parts.items()}})


def search_shard(row: dict, ids: np.ndarray, queries: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query_id, vec_id, score of each query's k nearest found in one shard."""
    dim = queries.shape[1]
    vec_ids, starts = np.frombuffer(row["vec_ids"], np.int64), np.frombuffer(row["starts"], np.int64)
    originals = np.frombuffer(row["vectors"], np.float64).reshape(-1, dim)
    graph = Graph.__new__(Graph)
    graph.vectors, graph.links, at = np.frombuffer(row["graph"], np.float32).reshape(-1, dim + 1), [], 0
    flat = np.frombuffer(row["links"], np.int32)
    for n, degree in np.frombuffer(row["shapes"], np.int64).reshape(-1, 2):
        graph.links.append(flat[at : at + n * degree].reshape(n, degree))
        at += n * degree
    out_q, out_v, out_s = [], [], []
    for lo in range(0, len(queries), 512):
        own = np.concatenate([queries[lo : lo + 512], np.zeros((len(queries[lo : lo + 512]), 1))], axis=1).astype(np.float32)
        nodes = beam(own, graph.vectors, graph.links[-1], graph.descend(own), max(ef, k + 1))[0]
        for i, found in enumerate(nodes, lo):
            found = found[found >= 0]
            scores = originals[found] @ queries[i]
            order, left = np.lexsort((vec_ids[starts[found]], -scores)), k
            pairs: list[tuple[float, int]] = []
            for j in order:
                if left <= 0 and scores[j] < pairs[-1][0]:
                    break
                same = vec_ids[starts[found[j]] : starts[found[j] + 1]][: k + 1]
                same = same[same != ids[i]][:k]
                pairs += [(float(scores[j]), int(v)) for v in same]
                left -= len(same)
            pairs = sorted(pairs, key=lambda p: (-p[0], p[1]))[:k]
            out_q += [ids[i]] * len(pairs)
            out_v += [v for _, v in pairs]
            out_s += [s for s, _ in pairs]
    return np.array(out_q, np.int64), np.array(out_v, np.int64), np.array(out_s, np.float64)


def build_index(embeddings: DataFrame, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame, int]:
    """The prepared vectors, the index (one row a shard) and the number of components."""
    vectors, dim = prepared(embeddings, "double", lambda x: x)
    vectors = vectors.filter(F.exists("v", lambda x: x != 0))
    shards = max(1, -(-vectors.count() // shard_rows))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    parts = ", ".join(f"{c} binary" for c in ("vec_ids", "starts", "vectors", "graph", "links", "shapes"))
    index = store(dealt.groupBy("shard").applyInArrow(lambda rows: build_shard(rows, dim), f"shard long, {parts}"))
    return vectors, index, dim


def nearest(embeddings: DataFrame, k: int = 20, query_step: int = QUERY_STEP, ef: int = EF_SEARCH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product found for every query row."""
    vectors, index, dim = build_index(embeddings, shard_rows)
    found = None
    for ids, queries in query_blocks(vectors, dim, QUERIES_AT_ONCE, query_step):

        def search(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, queries: np.ndarray = queries) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    columns = search_shard(row, ids, queries, k, ef)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

        spread = index.repartition(max(1, index.count()), "shard")
        block = store(spread.mapInArrow(search, "query_id long, vec_id long, score double"))
        found = block if found is None else found.unionByName(block)
    if found is None:
        found = embeddings.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_shard_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))

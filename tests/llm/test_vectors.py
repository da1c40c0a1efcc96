import numpy as np
import pytest

from chronolens.llm import hnsw, topk


def table(spark, vectors):
    return spark.createDataFrame([(k, v, 0, "clash") for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int, score string")


def sample(n=700, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dim)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[100:300] = v[100]  # one very common vector
    rows = [[float(x) for x in r] for r in v]
    rows[3], rows[20], rows[5], rows[6] = None, None, [float("nan")] * dim, [0.0] * dim
    rows[7] = [None, *rows[8][1:]]
    rows[9] = rows[9][:4]
    rows[40] = [float("inf")] * dim
    return rows


def good(row):
    return row is not None and all(x is not None and np.isfinite(x) for x in row)


def brute(rows, dim, k, usable, number):
    keep = [i for i, r in enumerate(rows) if usable(r)]
    m = np.array([[number(x) for x in rows[i]] + [0] * (dim - len(rows[i])) for i in keep])
    out = {}
    for a, i in enumerate(keep):
        if i % 20 == 0:
            scores = m @ m[a]
            order = sorted((-scores[b], j) for b, j in enumerate(keep) if j != i)[:k]
            out[i] = [(j, -s) for s, j in order]
    return out


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_exact_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES_AT_ONCE", 10)
    monkeypatch.setattr(topk, "ROWS_AT_ONCE", 64)
    rows = sample()
    want = brute(rows, 16, 20, good, lambda x: int(np.floor(64 * float(np.float32(x)))))
    assert collected(topk.top_k(table(spark, rows))) == want


@pytest.mark.parametrize("size", [1.0, 5e4, 1e5, 1e6, 3e8])
def test_large_components_have_exact_scores(spark, size):
    rng = np.random.default_rng(4)
    rows = [[float(x) for x in r] for r in rng.uniform(-size, size, (300, 12)).astype(np.float32)]
    want = {}
    exact = [[int(np.floor(64 * x)) for x in r] for r in rows]
    for q in range(0, 300, 2):
        scores = sorted((-sum(a * b for a, b in zip(exact[q], exact[j], strict=True)), j) for j in range(300) if j != q)[:5]
        want[q] = [(j, -s) for s, j in scores]
    if size > 1e8:  # 64 * 3e8 squared, twelve times
        with pytest.raises(Exception, match="62 bits"):
            topk.top_k(table(spark, rows), k=5, query_step=2).collect()
    else:
        assert collected(topk.top_k(table(spark, rows), k=5, query_step=2)) == want


def test_top_k_with_few_rows_repeats_and_nothing(spark):
    few = table(spark, [[1.0, 0.5], [0.5, 0.5], [0.25, -1.0]])
    assert [(r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(few.unionByName(few)).collect()] == [(1, 1, 64 * 32 + 32 * 32), (2, 2, 64 * 16 - 32 * 64)]
    assert topk.top_k(few.limit(0)).count() == 0 and hnsw.nearest(few.limit(0)).count() == 0


def test_graph_recall_scores_and_ties(spark):
    rows = sample(1500)
    nonzero = lambda r: good(r) and any(r)
    want = brute(rows, 16, 20, nonzero, lambda x: float(np.float32(x)))
    got = collected(hnsw.nearest(table(spark, rows), shard_rows=500))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    for q, found in got.items():
        exact = dict(want[q])
        assert all(s == pytest.approx(exact.get(j, s), abs=1e-12) for j, s in found)
        assert [(-s, j) for j, s in found] == sorted((-s, j) for j, s in found) and q not in dict(found)
    assert [j for j, _ in got[120]] == [100, *range(101, 120)]


def test_a_graph_is_built_without_searching_it(monkeypatch):
    rng, searches, search = np.random.default_rng(6), [], hnsw.beam
    v = rng.standard_normal((3000, 24)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    monkeypatch.setattr(hnsw, "beam", lambda *a: searches.append(1) or search(*a))
    graph = hnsw.Graph(v)
    assert not searches and graph.sizes[-1] == len(v) and all((x >= 0).any(axis=1).all() for x in graph.links if len(x) > 1)
    queries = graph.vectors[::20]
    found = hnsw.beam(queries, graph.vectors, graph.links[-1], graph.descend(queries), 144)[0][:, :20]
    exact = np.argsort(-(queries @ graph.vectors.T), axis=1)[:, :20]
    assert np.mean([len({*a} & {*b}) for a, b in zip(found.tolist(), exact.tolist(), strict=True)]) / 20 >= 0.98


def test_few_vectors_are_all_returned(spark):
    got = hnsw.nearest(table(spark, [[1.0, 0.5], [0.5, 0.5], [0.25, -1.0]]))
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got.collect()] == [(1, 1, 0.75), (2, 2, -0.25)]

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolens.llm import lexical

from .helpers import documents

TEXTS = [None, "", "...!? --", "Alpha beta alpha", "alpha", "ALPHA ÀLPHA àlpha", "日本語 alpha-beta_gamma", "beta " * 3000 + "alpha", "same words here", "same words here", "x\u0085y z w", "don't stop"]


def plain_terms(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain_rank(docs, items, k=10):
    """Scores of all documents for all items, then sorted."""
    rows = [(doc_id, Counter(t)) for doc_id, text in docs if (t := plain_terms(text))]
    n, total = len(rows), sum(c.total() for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    queries = {}
    for item, text in items:
        if item is not None:
            queries.setdefault(item, set()).update(plain_terms(text))
    out = []
    for item, terms in queries.items():
        scores = []
        for doc_id, c in rows:
            m = 100 - 90 + 90 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item, at, None if none else doc_id, -score) for at, (score, none, doc_id) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=lambda r: r[:2])


def query_over(spark, tmp_path, docs, items):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    found = lexical.op12_shard_wand(spark, str(tmp_path))
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted(map(tuple, found.collect()), key=lambda r: r[:2])


def corpus(seed, n):
    rng = random.Random(seed)
    words = [rng.choice(("the", "of", "Rare", "straße", "x1")) + str(int(rng.paretovariate(0.7)) % 60) for _ in range(400)]
    return TEXTS + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


@pytest.mark.parametrize(("shard_bytes", "shard_docs"), [(32 << 20, 1 << 16), (700, 1 << 16), (32 << 20, 7)])
def test_ranks_equal_all_scores_whatever_the_shards(spark, tmp_path, monkeypatch, shard_bytes, shard_docs):
    monkeypatch.setattr(lexical, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 5)
    texts = corpus(5, 250)
    items = [(k, t) for k, t in enumerate(texts[::9] + [None, "", "nothing of that kind", "alpha " * 50])] + [(3, "the1 another row"), (None, "alpha")]
    got = query_over(spark, tmp_path, documents(spark, texts).repartition(3), spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("t")).withColumn("shard", F.lit(1)))
    assert got == plain_rank(list(enumerate(texts)), items)


def test_repeated_rows_ties_and_rows_without_id(spark, tmp_path):
    rows = [(9, "a b"), (9, "a b"), (None, "a b"), (4, "a b"), (None, None), (5, "c " * 70000)] + [(k, f"a b {k}") for k in range(100, 130)]
    items = [(1, "A!b"), (1, "A!b"), (2, "c")]
    got = query_over(spark, tmp_path, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got == plain_rank(rows, items) and len(got) == 11


def test_nothing_gives_nothing(spark, tmp_path):
    docs, items = documents(spark, ["a b", None]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for k, (d, i) in enumerate([(docs.limit(0), items), (docs, items.limit(0)), (docs.filter("text IS NULL"), items)]):
        (tmp_path / str(k)).mkdir()
        assert query_over(spark, tmp_path / str(k), d, i) == []


def test_pivots_pass_over_documents_and_lose_none():
    rng = np.random.default_rng(2)
    for size in (40, 20_000):
        lists, total = [], np.zeros(size, np.int64)
        for share, top in ((0.9, 3), (0.5, 9), (0.05, 400), (0.002, 5000), (0.01, 5000)):
            places = np.flatnonzero(rng.random(size) < share)
            if len(places):
                gains = rng.integers(1, top, len(places))
                total[places] += gains
                lists.append((places, gains, int(gains.max())))
        heap = lexical.wand(lists, 10)
        best = np.lexsort((np.arange(size), -total))[:10]
        best = best[total[best] > 0]
        assert heap.places.tolist() == best.tolist() and heap.scores.tolist() == total[best].tolist()


def test_an_index_serves_later_queries(spark):
    index = lexical.build_index(documents(spark, TEXTS))
    heads = index.filter("term IS NULL").collect()
    assert sum(r["df"] for r in heads) == sum(bool(plain_terms(t)) for t in TEXTS) and sum(r["terms"] for r in heads) == sum(len(plain_terms(t)) for t in TEXTS)
    for k, text in ((3, "ALPHA"), (1, "same")):
        items = [("q", text)]
        got = lexical.rank(index, spark.createDataFrame(items, "item_id string, text string"), k).orderBy("rank").collect()
        assert list(map(tuple, got)) == plain_rank(list(enumerate(TEXTS)), items, k)

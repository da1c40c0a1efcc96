import hashlib
import random
import zlib

from pyspark.sql import functions as F

from chronolens.llm import periodic

from .helpers import documents

RESULT = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
AWKWARD = [None, "", " \n\t ", "one", "a a a a a", "a a a a a a", "a b a b a b a b", "a b a b a b a", "x " * 9 + "y " * 9 + "x " * 9, "a b " * 6, "\x1c " * 8, "z" * 9000, "p q r " * 4000, "same text here", "same text here"]


def planted(doc_id, words):
    """One text of ten repeats a stretch of its own words up to its end."""
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def plain_runs(words):
    """Every period at every place, without a grid."""
    n, out = len(words), {}
    for p in range(1, n // 4 + 1):
        s = 0
        while s + p < n:
            e = s + p
            while e < n and words[e] == words[e - p]:
                e += 1
            if e - s >= max(6, 4 * p):
                out.setdefault((s, e), p)
            s = max(s + 1, e - p + 1) if e < n else n
    return sorted((s, e - s, p) for (s, e), p in out.items())


def plain_row(doc_id, text):
    words = planted(doc_id, [w.decode() for w in (text or "").encode().split()])
    runs = plain_runs(words)
    dropped = {k for s, size, p in runs for k in range(s + p, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{size},{p}\n" for s, size, p in runs), " ".join(w for k, w in enumerate(words) if k not in dropped))]
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *sha)


def noisy(rng, n, kinds):
    words = [rng.choice("abcdefgh"[:kinds]) + rng.choice(("", "é")) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        at, q = rng.randrange(n), rng.randrange(1, 9)
        words[at:at] = words[at : at + q] * rng.randrange(2, 9)
    return " ".join(words)


def query_over(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = periodic.op11_harmonic_runs(spark, str(tmp_path))
    assert found.columns == RESULT and {t for _, t in found.dtypes} == {"bigint", "string"}
    return found


def test_runs_equal_every_period_at_every_place(spark, tmp_path):
    rng = random.Random(3)
    texts = AWKWARD + [noisy(rng, rng.randrange(1, 300), rng.randrange(1, 8)) for _ in range(150)]
    found = query_over(spark, tmp_path, documents(spark, texts))
    assert sorted(map(tuple, found.collect())) == sorted(plain_row(k, t) for k, t in enumerate(texts))


def test_rows_without_id_repeats_and_nothing(spark, tmp_path):
    rows = [(None, "a b " * 9), (7, "c " * 40), (7, "c " * 40), (7, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    (tmp_path / "some").mkdir()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, query_over(spark, tmp_path / "some", docs).collect()), key=key) == sorted((plain_row(*r) for r in rows), key=key)
    (tmp_path / "none").mkdir()
    assert query_over(spark, tmp_path / "none", docs.limit(0)).count() == 0


def test_small_batches_and_blocks_change_nothing(monkeypatch):
    rng = random.Random(9)
    texts = [noisy(rng, rng.randrange(1, 80), rng.randrange(1, 4)) for _ in range(60)] + ["a " * 700, "b c " * 500]
    want = [plain_runs(t.split()) for t in texts]
    for words, pairs in ((1, 32), (100, 64), (1 << 16, 1 << 20)):
        monkeypatch.setattr(periodic, "BATCH_WORDS", words)
        monkeypatch.setattr(periodic, "GRID_PAIRS", pairs)
        assert [[tuple(map(int, r)) for r in runs] for _, runs, _ in periodic.measure(texts)] == want


def test_results_replace_only_columns_of_their_name(spark):
    docs = documents(spark, ["a b " * 9, None]).withColumn("runs", F.lit("old")).withColumn("H", F.lit(1)).withColumn("n", F.lit(2)).withColumn("p", F.lit(3))
    found = periodic.periodic_runs(periodic.with_planted_periods(docs))
    assert found.columns == [c for c in docs.columns if c != "runs"] + ["n_words", "runs", "collapsed"]
    rows = {r["doc_id"]: r for r in found.collect()}
    assert [tuple(r) for r in rows[0]["runs"]] == [(0, 18, 2)] and rows[0]["collapsed"] == "a b" and rows[0]["found"] == "found"
    assert rows[1]["n_words"] == 0 and rows[1]["runs"] == [] and rows[1]["collapsed"] == "" and (rows[1]["H"], rows[1]["n"], rows[1]["p"]) == (1, 2, 3)

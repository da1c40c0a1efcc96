import random

from tokenizers import Tokenizer

import corpus_pipeline

from .helpers import brute_components, documents
from .test_text_operators import WORD_BPE, brute_lines, corpus, prose


def test_stages_keep_the_columns_and_clean_documents(spark, tmp_path):
    rng_words = [f"w{k}" for k in range(400)]
    clean = [" ".join(rng_words[k * 7 : k * 7 + 40]) for k in range(40)]
    texts = clean + [None, "", clean[0] + " more", "a\nb\nc\nd", "a\nb\nc", 'see token = "5d190bd7c06284de91015a36974748794293dd8a" now and then']
    docs = documents(spark, texts)
    spark.createDataFrame([(k, 1, 0) for k in range(10)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns
    kept = {r["doc_id"]: r for r in left.collect()}
    assert set(range(40)) <= set(kept) and 42 not in kept and 44 not in kept and 40 in kept
    assert kept[45]["text"] == 'see token = "[secret]" now and then' and kept[45]["n_chars"] == len(kept[45]["text"])
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == set(kept)


def test_the_pipeline_takes_repeats_and_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = documents(spark, ["a\nb\nc and more words here", "a\nb\nc and more words here", None, "", "other words " * 3000], ids=[7, 7, 8, 9, None])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({str(r["doc_id"]) for r in packed}) == ["7", "8", "9", "None"] and sum(r["doc_id"] == 7 for r in packed) == 2
    none = documents(spark, ["x"]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_stages_agree_with_plain_versions(spark, tmp_path):
    """Line dedup, near-dedup, redaction and packing of run() against versions without Spark, on rows no stage before rejects."""
    rng = random.Random(31)
    texts = corpus(31, 30) + [f"{prose(rng, 6)}\n{prose(rng, 6)}\nshared one\nshared two\nshared three\n{prose(rng, 9)}" for _ in range(6)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    lines = brute_lines(texts)
    left = [k for k, t in enumerate(lines) if t or not texts[k]]
    classes = brute_components([lines[k] for k in left])
    left = [k for i, k in enumerate(left) if classes[i] == i]
    library = Tokenizer.from_file(WORD_BPE)
    want = {k: len(library.encode(lines[k] or "", add_special_tokens=False).ids) + 1 for k in left}
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want


def test_columns_named_like_results_keep_their_values(spark, tmp_path):
    """Case does not tell columns apart in a session, so one spelling of each name is tried at a time."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    texts = ["keep", "a\nb\nc\nd", "a\nb\nc", None, "keep me too"]
    for names in (("score", "lines_in", "lines_kept", "component_id", "kept"), ("Score", "LINES_IN", "Lines_Kept", "Component_id", "n_shingles")):
        docs = spark.createDataFrame([(k, t, 7.5, "in", k, "c", "k") for k, t in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"{n} {t}" for n, t in zip(names, ("double", "string", "long", "string", "string"))))
        before = {r["doc_id"]: tuple(r)[2:] for r in docs.collect()}
        for _, stage in corpus_pipeline.STAGES[:-1]:
            left = stage(spark, docs, str(tmp_path))
            assert left.columns == docs.columns and left.dtypes == docs.dtypes
            rows = left.collect()
            assert len(rows) >= 4 and all(tuple(r)[2:] == before[r["doc_id"]] for r in rows)
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert sorted(r["doc_id"] for r in packed) == list(range(len(texts)))

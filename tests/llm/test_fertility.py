import base64
import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from chronolens.llm import fertility

from .helpers import documents

PATHS = fertility.public_paths()
RESULT = [("doc_id", "bigint"), *[(c, "bigint") for c in fertility.COUNTS], ("base_failed", "boolean"), ("kept", "boolean"), ("out_of_band", "string")]


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_counts(text):
    words, lines = plain_words(text), [x for x in (text or "").split("\n") if plain_words(x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    covered = {k + d for k, w in enumerate(windows) if often[w] > 1 for d in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(x in lines[:k] for k, x in enumerate(lines)), len(covered)


class Plain:
    """Measures of a text, word by word, with the libraries alone."""

    def __init__(self):
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=PATHS[0])
        with open(PATHS[1], "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = tiktoken.Encoding("plain", pat_str=PATHS[2], mergeable_ranks=self.ranks, special_tokens={})
        self.lone = {k for b, k in self.ranks.items() if len(b) == 1 and b[0] > 127}

    def __call__(self, text):
        words, out = plain_words(text), []
        chars = sum(map(len, words))
        for tokens, fallback in (([t for w in words for t in self.pieces.encode(w)], self.pieces.is_byte), ([t for w in words for t in self.bytes.encode_ordinary(" " + w)], self.lone.__contains__)):
            n, c = len(tokens), Counter(tokens)
            out += [chars / max(n, 1), sum(map(fallback, tokens)) / max(n, 1), -sum(v / n * math.log2(v / n) for v in c.values()) if n else 0.0]
        return out, n

    def script(self, text):
        c = Counter(s for w in plain_words(text) if (s := next((unicodedata.name(x, "").split(" ")[0] for x in w if x.isalpha()), "")))
        return min(c, key=lambda s: (-c[s], s)).lower() if c else "none"


PLAIN = Plain()


def plain_verdicts(rows, least):
    """base_failed and names out of band of each (text, lang)."""
    facts, values = [], defaultdict(list)
    for text, lang in rows:
        counts, (measures, tokens) = plain_counts(text), PLAIN(text)
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        group, size = lang if lang is not None else f"script {PLAIN.script(text)}", int(math.log2(max(tokens, 1)))
        facts.append((failed, group, size, measures))
        if not failed:
            for level in ((0, group, size), (1, group, 0), (2, "", 0)):
                values[level].append([math.floor(m * 1000) for m in measures])
    out = []
    for failed, group, size, measures in facts:
        beyond = []
        if not failed:
            level = next(x for x in ((0, group, size), (1, group, 0), (2, "", 0)) if x[0] == 2 or len(values[x]) >= least)
            for k, name in enumerate(fertility.MEASURES):
                own = sorted(v[k] for v in values[level])
                low, mid, high = (own[max(0, math.ceil(q * len(own)) - 1)] / 1000 for q in (0.25, 0.5, 0.75))
                spread = 4 * max((high - low) / 1.349, fertility.LEAST_SPREAD[name.split("_", 1)[1]])
                if measures[k] > mid + 0.001 + spread or measures[k] < mid - spread and not name.endswith("share"):
                    beyond.append(name)
        out.append((failed, ",".join(beyond)))
    return out


def texts(seed, n):
    rng = random.Random(seed)
    kinds = {"en": "the of and there was once letter window garden under morning river".split(), "de": "der Straße über schöne Häuser und Gärten nicht während größte".split(), None: "Привет мир река утро сад окно письмо дорога".split()}
    rows = [(None, None), ("", "en"), (" \n\t", None), ("one", "en"), ("12 34 !! " * 80, None), ("same line\nsame line\n\n\nsame  line", "de"), ("x" * 30000, "en"), ("日本語 🙂 " * 60, None), ("a\x1cb c \u0085 d " * 9, None)]
    for k in range(n):
        lang = rng.choice(list(kinds))
        words = [rng.choice(kinds[lang]) + rng.choice(("", "", ",", ".")) for _ in range(rng.choice((60, 70, 150, 300)))]
        if k % 15 == 0:
            words = [w.upper() + "***$$$" for w in words]
        if k % 21 == 0:
            words = ["".join(rng.choice("qzxj%&ÿ") for _ in range(6)) for _ in words]
        if k % 13 == 0:
            words = words[:9] * 9
        rows.append((" ".join(words).replace(".", ".\n"), lang))
    return rows + rows[:12]


def query_over(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = fertility.op13_fertility_bands(spark, str(tmp_path))
    assert found.dtypes == RESULT
    return found.collect()


@pytest.mark.parametrize("least", [1, 20, 10_000])
def test_counts_and_verdicts_equal_a_plain_version(spark, tmp_path, monkeypatch, least):
    monkeypatch.setattr(fertility, "LEAST_ROWS", least)
    rows = texts(4, 180)
    docs = spark.createDataFrame([(k, t, lang, "en") for k, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, script string")
    found = {r["doc_id"]: r for r in query_over(spark, tmp_path, docs)}
    want = plain_verdicts(rows, least)
    assert len(found) == len(rows) and any(w[1] for w in want) and any(w[0] for w in want)
    for k, (text, _) in enumerate(rows):
        r = found[k]
        assert tuple(r[c] for c in fertility.COUNTS) == plain_counts(text), text
        assert (r["base_failed"], r["out_of_band"]) == want[k] and r["kept"] == (want[k] == (False, ""))


def test_measures_equal_the_libraries_whatever_the_batches(monkeypatch):
    own, rows = fertility.Measurer(*PATHS), [t for t, _ in texts(8, 40)]
    monkeypatch.setattr(fertility, "CACHED_WORDS", 30)
    small = fertility.Measurer(*PATHS)
    parts = [small.batch(rows[k : k + 3]) for k in range(0, len(rows), 3)]
    whole = own.batch(rows)
    for k, text in enumerate(rows):
        want, tokens = PLAIN(text)
        assert [whole[m][k] for m in fertility.MEASURES] == pytest.approx(want, abs=1e-9) and whole["byte_tokens"][k] == tokens and whole["script"][k] == PLAIN.script(text)
        assert all(parts[k // 3][m][k % 3] == whole[m][k] for m in (*fertility.COUNTS, *fertility.MEASURES, "script"))


def test_junk_goes_and_clean_documents_stay(spark, tmp_path):
    rng = random.Random(6)
    words = "time people other water first number sound great right following little world".split()
    rows = [" ".join(rng.choice(words) for _ in range(rng.randrange(150, 200))) for _ in range(300)]
    junk = [" ".join(rng.choice(words) + "$$$%%%" for _ in range(180)) for _ in range(10)] + [" ".join("".join(rng.choice("qwxzßÿ0") for _ in range(8)) for _ in range(180)) for _ in range(10)]
    kept = {r["doc_id"]: r["kept"] for r in query_over(spark, tmp_path, documents(spark, rows + junk))}
    assert sum(kept[k] for k in range(300)) >= 297 and not any(kept[300 + k] for k in range(20))


def test_nothing_and_columns_of_any_name(spark, tmp_path):
    docs = documents(spark, ["a b c", None]).withColumn("group", F.lit(1)).withColumn("limits", F.lit(2)).withColumn("kept", F.lit("old")).withColumn("size", F.lit("s"))
    found = fertility.judged(fertility.store(fertility.measured(docs, *PATHS)))
    rows = found.collect()
    assert {(r["group"], r["limits"], r["size"], r["found"], r["kept"], r["base_failed"]) for r in rows} == {(1, 2, "s", "found", False, True)} and len(rows) == 2
    assert query_over(spark, tmp_path, docs.limit(0)) == []

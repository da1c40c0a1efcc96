"""Quality rules with tokeniser fertility: public vocabularies measure each text, bands per language or script judge it.

Two vocabularies see every word of a text (with the space before it): one of pieces, which falls back to bytes for what it
does not know, and one of byte sequences, where a token that is a lone byte of a longer character counts as a fallback.
Measured are code points per token, the share of fallback tokens and the entropy of the tokens, in bits. Text that is not
language, or not the language it says, breaks into other tokens than its neighbours do: symbols and tables into more and
fewer kinds, boilerplate into few kinds, foreign scripts into bytes.

Bands come from all documents that pass the base rules, as median and quartiles of values in thousandths, counted in
histograms before anything is shuffled. Documents belong to the group of their language (lang), or of the script of most of their words
where none is named, and within it to the others of their size, as the spread of every measure falls with length. A size
class with fewer than LEAST_ROWS documents takes the band of its whole group, a smaller group that of all documents. A
document is out of band where a measure lies more than SPREADS robust standard deviations from the median (for the share
of fallback tokens: above it), with a least deviation for each measure.

Words are measured once in a worker and remembered, up to a bound after which it starts anew. A row is measured by itself
in bounded batches; the bands are a small stored table whose size decides how it is joined, so a hot language or source
is not gathered anywhere.

Defined cases: null, empty and blank texts have no words and fail the base rules; texts of any length are read whole;
values on a band's edge are in band; repeated rows count and are judged each; rows without lang are grouped by script,
texts without letters as 'none'; an empty table gives an empty one; other columns are carried along, and columns named
like the results are replaced.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import free_name, store, table

LEAST_WORDS, MOST_REPEATED = 50, 50  # base rules: words, and per cent of words in repeated windows
SPREADS, LEAST_ROWS = 4.0, 100
QUARTILE = 1.349  # standard deviations between the quartiles of a normal distribution
BATCH_WORDS = 1 << 16
CACHED_WORDS = 300_000
SYMBOLS = re.compile(rb"[#*$%&|<>]")

MEASURES = [f"{kind}_{what}" for kind in ("piece", "byte") for what in ("chars_per_token", "fallback_share", "entropy")]
LEAST_SPREAD = {"chars_per_token": 0.01, "fallback_share": 0.005, "entropy": 0.05}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RESULTS = [*COUNTS, *MEASURES, "script", "base_failed", "out_of_band", "kept"]


def script_of(word: str) -> str:
    """The first part of the Unicode name of the first letter, '' without letters."""
    return next((unicodedata.name(c, "").split(" ")[0] for c in word if c.isalpha()), "")


class Vocabulary:
    """Tokens of words, as one array with the place of each word's first token."""

    size = 0

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.tokens, self.first = [np.empty(0, np.int64)], [np.zeros(1, np.int64)]

    def encode(self, words: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def learn(self, words: list[str]) -> None:
        found = self.encode(words)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((t for x in found for t in x), np.int64, int(sizes.sum()))
        self.tokens = [np.concatenate([self.tokens[0], flat])]
        self.first = [np.concatenate([self.first[0], self.first[0][-1] + np.cumsum(sizes)])]


class Pieces(Vocabulary):
    def __init__(self, path: str):
        super().__init__()
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.library.get_piece_size()
        self.fallback = np.array([self.library.is_byte(k) for k in range(self.size)])

    def encode(self, words: list[str]) -> list[list[int]]:
        return self.library.encode(words, num_threads=1)


class Bytes(Vocabulary):
    def __init__(self, path: str, pattern: str):
        super().__init__()
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.library = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.fallback = np.zeros(self.size, bool)
        self.fallback[[k for b, k in ranks.items() if len(b) == 1 and b[0] > 127]] = True

    def encode(self, words: list[str]) -> list[list[int]]:
        encode = self.library.encode_ordinary
        return [encode(" " + w) for w in words]


class Measurer:
    """Counts and measures of texts, many at a time."""

    def __init__(self, pieces: str, ranks: str, pattern: str):
        self.vocabularies = [Pieces(pieces), Bytes(ranks, pattern)]
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.scripts: dict[str, int] = {}
        self.each = np.empty((0, 3), np.int64)  # code points, symbols and script of each known word
        for v in self.vocabularies:
            v.clear()

    def _places(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new and len(self.known) + len(new) > CACHED_WORDS:
            self.clear()
            new = list(dict.fromkeys(words))
        if new:
            texts = [w.decode() for w in new]
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            rows = [(len(t), len(SYMBOLS.findall(w)), self.scripts.setdefault(script_of(t), len(self.scripts))) for w, t in zip(new, texts, strict=True)]
            self.each = np.concatenate([self.each, np.array(rows, np.int64)])
            for v in self.vocabularies:
                v.learn(texts)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def batch(self, texts: list[str | None]) -> dict[str, np.ndarray | list[str]]:
        n = len(texts)
        flat, counts, owner_sizes, sequences, lines, spans = [], [], [], [], [], 0
        for text in texts:
            raw = text.encode() if text else b""
            words = raw.split()
            number = {w: k for k, w in enumerate(dict.fromkeys(words))}
            order = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            flat += number
            owner_sizes.append(len(number))
            counts.append(np.bincount(order, minlength=len(number)))
            sequences.append(order + spans)
            spans += len(number)
            full = [x for x in raw.split(b"\n") if x.strip()]
            lines.append(len(full) - len(set(full)))
        places, count, own = self._places(flat), np.concatenate([*counts, np.empty(0, np.int64)]).astype(np.int64), np.repeat(np.arange(n), owner_sizes)
        each = self.each[places]
        out: dict[str, np.ndarray | list[str]] = {"n_words": _sums(own, count, n), "word_chars": _sums(own, count * each[:, 0], n), "n_symbols": _sums(own, count * each[:, 1], n), "n_dup_lines": np.array(lines, np.int64)}
        out["n_repeat_words"] = repeated_words(sequences, spans)
        for kind, v in zip(("piece", "byte"), self.vocabularies, strict=True):
            first = v.first[0]
            sizes = first[places + 1] - first[places]
            at = np.arange(int(sizes.sum())) + np.repeat(first[places] - (np.cumsum(sizes) - sizes), sizes)
            token, weight, of = v.tokens[0][at], np.repeat(count, sizes), np.repeat(own, sizes)
            total = _sums(of, weight, n)
            some = np.maximum(total, 1)
            out[f"{kind}_tokens"] = total
            out[f"{kind}_chars_per_token"] = out["word_chars"] / some
            out[f"{kind}_fallback_share"] = _sums(of, weight * v.fallback[token], n) / some
            out[f"{kind}_entropy"] = _entropy(of * v.size + token, weight, v.size, some)
        out["script"] = self._scripts(own, each[:, 2], count, n)
        return out

    def _scripts(self, own: np.ndarray, script: np.ndarray, count: np.ndarray, n: int) -> list[str]:
        names, best = list(self.scripts), [Counter() for _ in range(n)]
        keys, inverse = np.unique(own * max(1, len(names)) + script, return_inverse=True)
        for key, c in zip(keys.tolist(), _sums(inverse, count, len(keys)).tolist(), strict=True):
            if names[key % len(names)]:
                best[key // len(names)][names[key % len(names)]] += c
        return [min(c, key=lambda s: (-c[s], s)).lower() if c else "none" for c in best]


def _sums(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, of, values)
    return out


def _entropy(keys: np.ndarray, weight: np.ndarray, size: int, total: np.ndarray) -> np.ndarray:
    """Of the tokens of each text, in bits; keys hold text * size + token."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    counts = np.add.reduceat(weight[order], first) if len(first) else np.empty(0, np.int64)
    parts = np.bincount(keys[first] // size, counts * np.log2(np.maximum(counts, 1)), len(total))
    return np.maximum(np.log2(total) - parts / total, 0.0)


def repeated_words(sequences: list[np.ndarray], spans: int) -> np.ndarray:
    """Words of each text in three-word windows found twice or more in it; numbers of different texts differ."""
    sizes = np.array([len(s) for s in sequences], np.int64)
    ids = np.concatenate([*sequences, np.empty(0, np.int64)]).astype(np.int64)
    own = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(own[:-2] == own[2:])
    keys = ids[at] * spans + ids[at + 1]
    keys = (keys if spans < 1 << 21 else np.unique(keys, return_inverse=True)[1]) * spans + ids[at + 2]
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    covered = np.zeros(len(ids), bool)
    for step in range(3):
        covered[at[counts[inverse] > 1] + step] = True
    return np.bincount(own, covered, len(sizes)).astype(np.int64)


_measurers: dict[tuple, Measurer] = {}


def measurer(*paths: str) -> Measurer:
    if paths not in _measurers:
        _measurers[paths] = Measurer(*paths)
    return _measurers[paths]


def measured(docs: DataFrame, pieces: str, ranks: str, pattern: str) -> DataFrame:
    """docs with the counts, the measures of both vocabularies, their token counts and the script of most words."""
    names = [*COUNTS, "piece_tokens", "byte_tokens", *MEASURES, "script"]
    kinds = ["long"] * 7 + ["double"] * 6 + ["string"]

    def run(texts: pa.Array) -> pa.Array:
        own, parts = measurer(pieces, ranks, pattern), []
        held, size = [], 0
        for k in range(0, len(texts), 1000):
            for text in texts.slice(k, 1000).to_pylist():
                held.append(text)
                size += len(text) if text else 0
                if size >= 6 * BATCH_WORDS:
                    parts.append(own.batch(held))
                    held, size = [], 0
        parts.append(own.batch(held))
        columns = [pa.array(np.concatenate([p[c] for p in parts])) if c != "script" else pa.array([s for p in parts for s in p[c]], pa.string()) for c in names]
        return pa.StructArray.from_arrays(columns, names)

    docs = docs.drop(*names, *RESULTS)
    (found,) = free_name(docs, "found")
    kind = "struct<" + ",".join(f"{n}:{k}" for n, k in zip(names, kinds, strict=True)) + ">"
    return docs.withColumn(found, arrow_udf(run, kind)("text")).select("*", f"{found}.*").drop(found)


def bands(rows: DataFrame, group: str, size: str) -> DataFrame:
    """group, size and limits (low and high of each measure, in the order of MEASURES) for every group and size in rows."""
    values = F.array(*[F.struct(F.lit(k).alias("measure"), F.floor(F.col(m) * 1000).alias("bin")) for k, m in enumerate(MEASURES)])
    points = rows.select(F.col(group).alias("g"), F.col(size).alias("s"), F.explode(values).alias("v")).groupBy("g", "s", "v.measure", "v.bin").agg(F.count(F.lit(1)).alias("n"))
    # 0: of a size in a group, 1: of a group, 2: of all.
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.col("g") if k < 2 else F.lit("").alias("g"), F.col("s") if k < 1 else F.lit(0).alias("s")) for k in range(3)])
    binned = points.withColumn("at", F.explode(levels)).groupBy("at.level", "at.g", "at.s", "measure", "bin").agg(F.sum("n").alias("n"))
    key = ["level", "g", "s", "measure"]
    listed = binned.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("total"))

    def quantile(share: float) -> F.Column:
        step = F.aggregate(
            "bins",
            F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("found")),
            lambda a, b: F.struct((a["seen"] + b["n"]).alias("seen"), F.coalesce(a["found"], F.when(a["seen"] + b["n"] >= share * F.col("total"), b["bin"])).alias("found")),
        )
        return step["found"] / 1000

    least = F.element_at(F.array(*[F.lit(LEAST_SPREAD[m.split("_", 1)[1]]) for m in MEASURES]), F.col("measure") + 1)
    one_sided = F.col("measure").isin([k for k, m in enumerate(MEASURES) if m.endswith("fallback_share")])
    spread = SPREADS * F.greatest((F.col("high") - F.col("low")) / QUARTILE, least)
    # A value in the bin of a limit counts as on it: bins are a thousandth wide.
    limits = (
        listed.select(*key, "total", quantile(0.25).alias("low"), quantile(0.5).alias("mid"), quantile(0.75).alias("high"))
        .select(*key, "total", F.when(one_sided, float("-inf")).otherwise(F.col("mid") - spread).alias("low"), (F.col("mid") + 0.001 + spread).alias("high"))
        .groupBy("level", "g", "s").agg(F.array_sort(F.collect_list(F.struct("measure", "low", "high"))).alias("limits"), F.max("total").alias("total"))
        .filter((F.col("total") >= LEAST_ROWS) | (F.col("level") == 2)).drop("total")
    )
    wanted = points.select("g", "s").distinct().select(F.col("g").alias(group), F.col("s").alias(size), F.explode(levels).alias("at")).select(group, size, "at.level", "at.g", "at.s")
    return wanted.join(limits, ["level", "g", "s"]).groupBy(group, size).agg(F.min_by("limits", "level").alias("limits"))


def judged(rows: DataFrame) -> DataFrame:
    """Measured rows with base_failed, out_of_band (names of the measures beyond their band) and kept.

    rows is read twice: pass a stored table.
    """
    group, size, limits = free_name(rows, "group", "size", "limits")
    named = F.col("lang") if "lang" in rows.columns else F.lit(None)
    rows = rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    rows = rows.withColumn(group, F.coalesce(named.cast("string"), F.concat(F.lit("script "), "script"))).withColumn(size, F.floor(F.log2(F.greatest("byte_tokens", F.lit(1)))).cast("int"))
    found = store(bands(rows.filter("NOT base_failed"), group, size).withColumnRenamed("limits", limits))
    beyond = [F.when((F.col(m) < F.get(F.col(limits), F.lit(k))["low"]) | (F.col(m) > F.get(F.col(limits), F.lit(k))["high"]), m) for k, m in enumerate(MEASURES)]
    return (
        rows.join(found, [group, size], "left")
        .withColumn("out_of_band", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*beyond))))
        .withColumn("kept", ~F.col("base_failed") & (F.size("out_of_band") == 0))
        .drop(group, size, limits)
    )


def public_paths() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op13_fertility_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return judged(store(measured(docs, *public_paths()).drop("text"))).select("doc_id", *COUNTS, "base_failed", "kept", F.array_join("out_of_band", ",").alias("out_of_band"))

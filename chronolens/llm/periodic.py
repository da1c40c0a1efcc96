"""Periodic run detection: harmonic grid of longest common extensions over a suffix array and a reversed one.

A run is a stretch of consecutive words with smallest period q and at least max(6, 4 * q) words that no neighbouring word
extends keeping the period. For each period p the grid holds the places 0, p, 2p, ... of a text. A run of period p covers
at least four of them, so its pairs (jp, (j+1)p) stand in a row of three or more with equal words; every pair in such a row
is asked how far both places agree forward and backward, which gives the whole stretch of period p around them. Pairs of
different words agree over nothing, so they need no query, and a text without such a row has no run. An answer is the
minimum of a range of common prefixes of neighbouring suffixes. A stretch found with several periods has the smallest.

Texts are taken a few tens of thousands of words at a time; words of different texts are different symbols, so one suffix
array serves many texts and no extension leaves its text. Work for a text of n words is about n log n, memory about a
hundred bytes a word of the longest text. Every row is measured alone: there is no shuffle, so neither copies nor a hot
source matter, and a lost task is run again by itself.

Defined cases: null, empty and blank texts have no words, no run, and collapse to the empty text; texts of any length are
read whole; equal stretches with several periods keep the smallest, runs are listed by start, then period; repeated rows
are measured alike; an empty table gives an empty one; other columns are carried along, and columns named like the
results (n_words, runs, collapsed) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import free_name, table

LEAST, TIMES = 6, 4  # words, and periods, of a run
BATCH_WORDS = 1 << 16
GRID_PAIRS = 1 << 20
BLOCK = 32
WORD = r"([^\x20\x09-\x0D]+)"


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the rank of each, by doubling; only suffixes that are still tied are sorted again."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    ends = np.flatnonzero(np.diff(ids[order], prepend=ids[order[:1]] - 1))
    sizes = np.diff(ends, append=n)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(ends, sizes)
    tied = np.flatnonzero(np.repeat(sizes, sizes) > 1)
    step = 1
    while len(tied):
        suffixes = order[tied]
        after = suffixes + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        key = rank[suffixes] * (n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        suffixes, key = suffixes[by], key[by]
        order[tied] = suffixes
        first = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        sizes = np.diff(first, append=len(key))
        rank[suffixes] = np.repeat(tied[first], sizes)
        tied = tied[np.repeat(sizes, sizes) > 1]
        step *= 2
    return order, rank


def common_prefixes(ids: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of each suffix in order with the one before it (0 for the first)."""
    n, text = len(ids), ids.tolist()
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    found, size = [0] * n, 0
    for at, other in enumerate(before.tolist()):
        if other < 0:
            size = 0
            continue
        most = n - (at if at > other else other)
        while size < most and text[at + size] == text[other + size]:
            size += 1
        found[at] = size
        if size:
            size -= 1
    out = np.empty(n, np.int64)
    out[rank] = found
    return out


class RangeMinima:
    """Minima of ranges: within blocks from their ends, across blocks from a table of powers of two of block minima."""

    def __init__(self, values: np.ndarray):
        self.top = np.iinfo(np.int64).max
        blocks = -(-len(values) // BLOCK)
        self.rows = np.full((blocks, BLOCK), self.top, np.int64)
        self.rows.ravel()[: len(values)] = values
        self.from_left = np.minimum.accumulate(self.rows, axis=1).ravel()
        self.from_right = np.minimum.accumulate(self.rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [self.rows.min(axis=1)]
        while 2 ** len(self.levels) <= blocks:
            below, half = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(below[:-half], below[half:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least of the values from low to high, both included."""
        first, last = low // BLOCK, high // BLOCK
        out = np.minimum(self.from_right[low], self.from_left[high])
        wide = np.flatnonzero(last - first > 1)
        if len(wide):
            a, b = first[wide] + 1, last[wide]
            level = np.frexp((b - a).astype(float))[1] - 1
            for k in np.unique(level):
                of = wide[level == k]
                a, b = first[of] + 1, last[of] - (1 << int(k))
                out[of] = np.minimum(out[of], np.minimum(self.levels[k][a], self.levels[k][b]))
        inside = np.flatnonzero(first == last)
        places = np.arange(BLOCK)
        for lo in range(0, len(inside), GRID_PAIRS // BLOCK):
            of = inside[lo : lo + GRID_PAIRS // BLOCK]
            a, b = (low[of] % BLOCK)[:, None], (high[of] % BLOCK)[:, None]
            out[of] = np.where((places >= a) & (places <= b), self.rows[first[of]], self.top).min(axis=1)
        return out


class Extensions:
    """How far two places of a sequence agree forward."""

    def __init__(self, ids: np.ndarray):
        order, self.rank = suffix_array(ids)
        self.minima = RangeMinima(common_prefixes(ids, order, self.rank))

    def __call__(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        a, b = self.rank[one], self.rank[other]
        return self.minima(np.minimum(a, b) + 1, np.maximum(a, b))


def grid_pairs(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places jp with their periods p, in blocks, of pairs that stand in a row of TIMES - 1 with equal words."""
    most = np.where(sizes >= LEAST, sizes // TIMES, 0)
    of = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(of)) - np.repeat(np.cumsum(most) - most, most) + 1
    pairs = (sizes[of] - 1) // period
    if not len(of):
        return
    cuts = np.searchsorted(np.cumsum(pairs), np.arange(0, pairs.sum(), GRID_PAIRS))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(of)), strict=True):
        if lo == hi:
            continue
        p, count = period[lo:hi], pairs[lo:hi]
        begin = np.cumsum(count) - count
        steps = np.repeat(p, count)
        at = (np.arange(len(steps)) - np.repeat(begin, count)) * steps + np.repeat(starts[of[lo:hi]], count)
        same = ids[at] == ids[at + steps]
        row = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        group = np.searchsorted(begin, row, "right") - 1
        row = row[row - begin[group] <= count[group] - (TIMES - 1)]
        asked = np.unique((row[:, None] + np.arange(TIMES - 1)).ravel())
        if len(asked):
            yield at[asked], steps[asked]


def runs_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Rows of start, length and period, by start and period, of each sequence of word numbers."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    spans = np.cumsum([0, *(int(t.max()) + 1 if len(t) else 0 for t in texts)])
    ids = np.concatenate([t + s for t, s in zip(texts, spans, strict=False)]) if len(texts) else np.empty(0, np.int64)
    none = np.empty((0, 3), np.int64)
    asked = list(grid_pairs(ids, starts, sizes))
    if not asked:
        return [none] * len(texts)
    # Only texts with something to ask enter the suffix arrays.
    owner = [np.searchsorted(starts + sizes, at, "right") for at, _ in asked]
    used = np.unique(np.concatenate(owner))
    kept_sizes = sizes[used]
    kept_starts = np.cumsum(kept_sizes) - kept_sizes
    shift = np.zeros(len(sizes), np.int64)
    shift[used] = starts[used] - kept_starts
    ids = np.concatenate([ids[starts[k] : starts[k] + sizes[k]] for k in used])
    n, forward, backward = len(ids), Extensions(ids), Extensions(ids[::-1].copy())
    found = []
    for (at, p), own in zip(asked, owner, strict=True):
        at = at - shift[own]
        end = at + p + forward(at, at + p)
        before = np.zeros(len(at), np.int64)
        inner = np.flatnonzero(at > 0)
        before[inner] = backward(n - at[inner], n - at[inner] - p[inner])
        begin = at - before
        good = end - begin >= np.maximum(LEAST, TIMES * p)
        found.append(np.unique(np.stack([begin[good], end[good], p[good]], axis=1), axis=0))
    found = np.unique(np.concatenate(found), axis=0)
    if not len(found):
        return [none] * len(texts)
    # np.unique sorts, so the first row of a stretch has its smallest period.
    fresh = np.append(True, (np.diff(found[:, :2], axis=0) != 0).any(axis=1))
    found = found[fresh]
    own = np.searchsorted(kept_starts + kept_sizes, found[:, 0], "right")
    rows = np.stack([found[:, 0] - kept_starts[own], found[:, 1] - found[:, 0], found[:, 2]], axis=1)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0], own))]
    out = [none] * len(texts)
    cuts = np.searchsorted(np.sort(own), np.arange(len(used) + 1))
    for k, text in enumerate(used):
        out[text] = rows[cuts[k] : cuts[k + 1]]
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """Words that no run contains after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(edges[:-1]) == 0)])


def measure(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """Number of words, runs and collapsed text of each text, in order."""
    held, numbers, total = [], [], 0

    def flush() -> Iterator[tuple[int, np.ndarray, bytes]]:
        for words, runs in zip(held, runs_of(numbers), strict=True):
            yield len(words), runs, collapsed(words, runs)

    for text in texts:
        words = text.encode().split() if text else []
        number = {w: k for k, w in enumerate(dict.fromkeys(words))}
        held.append(words)
        numbers.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        total += len(words)
        if total >= BATCH_WORDS:
            yield from flush()
            held, numbers, total = [], [], 0
    yield from flush()


_RESULT = "struct<n_words:long,runs:array<struct<start:long,length:long,period:long>>,collapsed:string>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _measured(texts: pa.Array) -> pa.Array:
    counts, runs, left = [], [], []
    for k in range(0, len(texts), 1000):
        for n, rows, text in measure(texts.slice(k, 1000).to_pylist()):
            counts.append(n)
            runs.append(rows)
            left.append(text)
    rows = np.concatenate(runs) if runs else np.empty((0, 3), np.int64)
    each = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], fields=list(_RUN))
    offsets = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
    return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.ListArray.from_arrays(offsets, each), pa.array([t.decode() for t in left], pa.string())], ["n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """docs with n_words, runs (start, length and period of each, in order) and collapsed (the text without repeats)."""
    docs = docs.drop("n_words", "runs", "collapsed")
    (found,) = free_name(docs, "found")
    return docs.withColumn(found, arrow_udf(_measured, _RESULT)("text")).select("*", f"{found}.*").drop(found)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """docs in which one text of ten (by crc32 of its doc_id) repeats a stretch of its own words up to its end.

    The other texts, those without words and rows without doc_id stay as they are.
    """
    h, words, n, a, p = free_name(docs, "h", "words", "n", "a", "p")
    g = F.floor(F.col(h) / 10)
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, F.col(a) + 1, F.col(p)), F.ceil((F.col(n) - F.col(a)) / F.col(p)).cast("int"))), F.lit(1), F.col(n) - F.col(a))
    return (
        docs.withColumn(h, F.crc32(F.col("doc_id").cast("string").cast("binary")))
        .withColumn(words, F.when(F.col(h) % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), 1)))
        .withColumn(n, F.when(F.size(words) > 0, F.size(words)))
        .withColumn(a, (g % F.col(n)).cast("int"))
        .withColumn(p, (1 + F.floor((F.col(n) - F.col(a)) / (3 + g % 8))).cast("int"))
        .withColumn("text", F.when(F.col(n).isNull(), F.col("text")).otherwise(F.array_join(F.concat(F.slice(words, F.lit(1), F.col(a)), tail), " ")))
        .drop(h, words, n, a, p)
    )


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op11_harmonic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return (
        periodic_runs(docs).withColumn("best", best)
        .select(
            "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
            F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"),
            _digest(F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")).alias("runs_sha256"),
            _digest(F.col("collapsed")).alias("collapsed_sha256"),
        )
    )

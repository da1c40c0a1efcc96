"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as an embedding of the word, if the training texts hold it often enough, and the mean embedding of its
character 3- and 4-grams. Runs of more than LONGEST word characters, as in texts without spaces, enter as overlapping
pieces. Windows of WINDOW words overlap by half and cover the whole text; a document's score is its
most toxic window's. Training is multiple-instance: each epoch picks the window of a document that scores highest and
learns from it, for clean documents also from a random one.

The network is fitted on the driver to at most MAX_PER_CLASS labelled documents of each class, of at most MAX_CHARS
characters each, chosen by a hash of doc_id. Everything is scored. The input matrices are applied once per distinct
word, so a window costs its recurrent steps only.

Defined cases: a text that is null or without words has no window and gets the score of one empty window; without
labelled documents of both classes every score is the share of toxic ones (0 without any); labels that are neither 0
nor 1 are left out; rows that repeat are scored each; an empty table gives an empty result; a column named like the
result is replaced; no column but text is ever an input of a score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

WINDOW, STRIDE = 32, 16
WORD_DIM, GRAM_DIM, HIDDEN, ATTENTION = 8, 16, 12, 12
GRAM_BUCKETS, MIN_DOCS, MAX_VOCABULARY = 16_384, 3, 3000
MAX_PER_CLASS, MAX_CHARS = 1500, 6_000
EPOCHS, MIN_STEPS, BATCH, RATE, DECAY, DROP = 8, 200, 128, 0.01, 0.1, 0.5
CACHED_WORDS, CHUNK = 300_000, 1024
LONGEST = 40
FOLDS = 5

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    """Words in lower case; a longer run becomes pieces of LONGEST characters that overlap by half, the last ending with it."""
    found = _WORD.findall(text.lower()) if text else []
    if not found or max(map(len, found)) <= LONGEST:
        return found
    step = LONGEST // 2
    return [run[i : i + LONGEST] for run in found for i in ([0] if len(run) <= LONGEST else [*range(0, len(run) - LONGEST, step), len(run) - LONGEST])]


def grams_of(word: str) -> list[int]:
    padded = f"<{word}>"
    return [zlib.crc32(padded[i : i + n].encode("utf-8", "surrogatepass")) % GRAM_BUCKETS for n in (3, 4) for i in range(max(1, len(padded) - n + 1))]


def window_starts(n: int) -> list[int]:
    """Starts of overlapping windows over n words; the last one ends with the text."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """The parameters, the forward pass over windows and, for training, the gradient."""

    def __init__(self, vocabulary: dict[str, int], seed: int = 7):
        rng = np.random.default_rng(seed)
        h, d = HIDDEN, WORD_DIM + GRAM_DIM

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.vocabulary = vocabulary
        self.p = {"word": normal(len(vocabulary) + 1, WORD_DIM, scale=0.1), "gram": normal(GRAM_BUCKETS, GRAM_DIM, scale=0.1)}
        for side in "fb":
            self.p |= {f"x{side}": normal(d, 3 * h, scale=0.3), f"c{side}": np.zeros(3 * h, np.float32)}
            self.p |= {f"g{side}": normal(h, 2 * h, scale=0.25), f"n{side}": normal(h, h, scale=0.25)}
        self.p |= {"a": normal(2 * h, ATTENTION, scale=0.3), "a0": np.zeros(ATTENTION, np.float32), "v": normal(ATTENTION, scale=0.3)}
        self.p |= {"w": normal(2 * h, scale=0.3), "w0": np.zeros(1, np.float32)}

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Input vectors of distinct words, with what their gradient needs: word rows, gram ids, gram counts."""
        rows = np.array([self.vocabulary.get(w, 0) for w in words], np.int64)
        grams = [grams_of(w) for w in words]
        counts = np.array([len(g) for g in grams], np.int64)
        flat = np.fromiter((g for own in grams for g in own), np.int64, int(counts.sum()))
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        mean = np.add.reduceat(self.p["gram"][flat], starts, axis=0) / np.sqrt(counts)[:, None] if len(words) else np.empty((0, GRAM_DIM))
        return np.concatenate([self.p["word"][rows], mean], axis=1).astype(np.float32), rows, flat, counts

    def projected(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ self.p["xf"] + self.p["cf"], x @ self.p["xb"] + self.p["cb"]], axis=1)

    def _run(self, side: str, x: np.ndarray, mask: np.ndarray | None, keep: list | None) -> np.ndarray:
        """Hidden states (T, N, H) of one direction from projected inputs (T, N, 3H)."""
        steps, n, h = x.shape[0], x.shape[1], HIDDEN
        gates, new, state = self.p[f"g{side}"], self.p[f"n{side}"], np.zeros((n, HIDDEN), np.float32)
        out = np.empty((steps, n, h), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            zr = _sigmoid(x[t, :, : 2 * h] + state @ gates)
            z, r = zr[:, :h], zr[:, h:]
            fresh = np.tanh(x[t, :, 2 * h :] + (r * state) @ new)
            after = fresh + z * (state - fresh)
            if mask is not None:
                after = np.where(mask[t][:, None], after, state)
            if keep is not None:
                keep.append((t, state, z, r, fresh))
            out[t] = state = after
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray | None, kept: dict | None = None) -> np.ndarray:
        """Logits of N windows from projected inputs (T, N, 6H); mask (T, N) marks real words."""
        h = HIDDEN
        if kept is not None:
            kept |= {"f": [], "b": []}
        both = np.concatenate(
            [self._run("f", x[:, :, : 3 * h], mask, kept and kept["f"]), self._run("b", x[:, :, 3 * h :], mask, kept and kept["b"])], axis=2
        )
        hidden = np.tanh(both @ self.p["a"] + self.p["a0"])
        weight = hidden @ self.p["v"]
        if mask is not None:
            weight = np.where(mask, weight, np.float32(-1e9))
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, both)
        if kept is not None:
            kept |= {"both": both, "hidden": hidden, "weight": weight, "pooled": pooled}
        return pooled @ self.p["w"] + self.p["w0"]

    def _back(self, side: str, steps: list, down: np.ndarray, mask: np.ndarray, grad: dict) -> np.ndarray:
        h, gates, new = HIDDEN, self.p[f"g{side}"], self.p[f"n{side}"]
        dx, carry = np.zeros((*down.shape[:2], 3 * h), np.float32), np.zeros(down.shape[1:], np.float32)
        for t, state, z, r, fresh in reversed(steps):
            total = down[t] + carry
            live = total * mask[t][:, None]
            dn = live * (1 - z) * (1 - fresh * fresh)
            dz = live * (state - fresh) * z * (1 - z)
            dreset = dn @ new.T
            dr = dreset * state * r * (1 - r)
            dzr = np.concatenate([dz, dr], axis=1)
            grad[f"g{side}"] += state.T @ dzr
            grad[f"n{side}"] += (r * state).T @ dn
            dx[t] = np.concatenate([dzr, dn], axis=1)
            carry = total - live + live * z + dreset * r + dzr @ gates.T
        return dx

    def gradient(self, windows: list[list[str]], labels: np.ndarray, weights: np.ndarray, rng: np.random.Generator | None = None) -> tuple[float, dict]:
        """Loss and gradient; with rng a share DROP of the distinct words enters without its word embedding."""
        words = sorted({w for own in windows for w in own} | {""})
        at = {w: i for i, w in enumerate(words)}
        ids = np.zeros((WINDOW, len(windows)), np.int64)
        mask = np.zeros((WINDOW, len(windows)), bool)
        for k, own in enumerate(windows):
            ids[: len(own), k] = [at[w] for w in own]
            mask[: max(1, len(own)), k] = True
        x, rows, grams, counts = self.inputs(words)
        if rng is not None:
            stays = rng.random(len(words)) >= DROP
            x[:, :WORD_DIM] *= stays[:, None]
        kept: dict = {"on": True}
        logits = self.forward(self.projected(x)[ids], mask, kept)
        chance = _sigmoid(logits)
        loss = float(-(weights * np.where(labels == 1, np.log(chance + 1e-7), np.log(1 - chance + 1e-7))).sum())
        up = ((chance - labels) * weights).astype(np.float32)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        both, hidden, weight, h = kept["both"], kept["hidden"], kept["weight"], HIDDEN
        grad["w"], grad["w0"] = kept["pooled"].T @ up, up.sum(keepdims=True)
        dpool = up[:, None] * self.p["w"]
        down = weight[:, :, None] * dpool
        share = np.einsum("tnh,nh->tn", both, dpool)
        dweight = weight * (share - (weight * share).sum(axis=0))
        grad["v"] = np.einsum("tn,tnk->k", dweight, hidden)
        dhidden = dweight[:, :, None] * self.p["v"] * (1 - hidden * hidden)
        grad["a"], grad["a0"] = np.einsum("tnh,tnk->hk", both, dhidden), dhidden.sum(axis=(0, 1))
        down = down + dhidden @ self.p["a"].T
        dwords = np.zeros_like(x)
        for side, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            dx = self._back(side, kept[side], down[:, :, part], mask, grad)
            dproj = np.zeros((len(words), 3 * h), np.float32)
            np.add.at(dproj, ids.ravel(), dx.reshape(-1, 3 * h))
            grad[f"x{side}"], grad[f"c{side}"] = x.T @ dproj, dproj.sum(axis=0)
            dwords += dproj @ self.p[f"x{side}"].T
        np.add.at(grad["word"], rows, dwords[:, :WORD_DIM] * (1 if rng is None else stays[:, None]))
        np.add.at(grad["gram"], grams, np.repeat(dwords[:, WORD_DIM:] / np.sqrt(counts)[:, None], counts, axis=0))
        return loss, grad


class Scorer:
    """Scores whole texts; projected inputs of frequent words are remembered."""

    def __init__(self, network: Network):
        self.network = network
        self.at: dict[str, int] = {}
        self.table = np.empty((0, 6 * HIDDEN), np.float32)
        self._add([""])

    def _add(self, words: list[str]) -> None:
        self.at.update(zip(words, range(len(self.table), len(self.table) + len(words)), strict=True))
        self.table = np.concatenate([self.table, self.network.projected(self.network.inputs(words)[0])])

    def window_logits(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Logits of every window of every text, given as words."""
        fresh = set().union(*texts) - self.at.keys()
        if fresh and len(self.at) + len(fresh) > CACHED_WORDS:
            self.at, self.table = {}, self.table[:0]
            fresh = {""}.union(*texts)
        if fresh:
            self._add(sorted(fresh))
        at, blank = self.at, self.at[""]
        spans = [window_starts(len(w)) for w in texts]
        out = np.empty(sum(map(len, spans)), np.float32)
        flat = np.fromiter((at[w] for own in texts for w in own), np.int64, sum(map(len, texts)))
        firsts, short, k, base = [], [], 0, 0
        for own, starts in zip(texts, spans, strict=True):
            if len(own) < WINDOW:
                short.append((k, base, len(own)))
            firsts += [base + s for s in starts]
            k, base = k + len(starts), base + len(own)
        small = {k for k, _, _ in short}
        whole = np.array([i for i in range(len(out)) if i not in small], np.int64)
        firsts = np.array(firsts, np.int64)
        for lo in range(0, len(whole), CHUNK):
            some = whole[lo : lo + CHUNK]
            ids = flat[firsts[some][None, :] + np.arange(WINDOW)[:, None]]
            out[some] = self.network.forward(self.table[ids], None)
        for lo in range(0, len(short), CHUNK):
            some = short[lo : lo + CHUNK]
            ids, mask = np.full((WINDOW, len(some)), blank, np.int64), np.zeros((WINDOW, len(some)), bool)
            for j, (_, start, n) in enumerate(some):
                ids[:n, j], mask[: max(1, n), j] = flat[start : start + n], True
            out[[k for k, _, _ in some]] = self.network.forward(self.table[ids], mask)
        return np.split(out, np.cumsum([len(s) for s in spans])[:-1])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        found: list[float] = []
        for lo in range(0, len(texts), 200):
            own = [words_of(t) for t in texts[lo : lo + 200]]
            found += [float(w.max()) for w in self.window_logits(own)] if own else []
        return _sigmoid(np.array(found, np.float64))


def fit(texts: list[str], labels: list[int], seed: int = 11) -> Network:
    """A network fitted to whole texts with labels 0 and 1 (both present)."""
    rng = np.random.default_rng(seed)
    words = [words_of(t) for t in texts]
    known = Counter(w for own in words for w in set(own))
    frequent = sorted((-n, w) for w, n in known.items() if n >= MIN_DOCS)[:MAX_VOCABULARY]
    network = Network({w: i + 1 for i, (_, w) in enumerate(frequent)})
    y = np.array(labels)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    turn, epochs = 0, max(EPOCHS, min(60, MIN_STEPS * BATCH // (len(texts) + int((y == 0).sum()))))
    for epoch in range(epochs):
        logits = Scorer(network).window_logits(words)
        chosen = [(d, int(own.argmax()) if epoch else int(rng.integers(len(own)))) for d, own in enumerate(logits)]
        chosen += [(d, int(rng.integers(len(logits[d])))) for d in range(len(words)) if y[d] == 0]
        order = rng.permutation(len(chosen))
        rate = RATE * min(1.0, 2 * (1 - epoch / epochs))
        positives = sum(y[d] for d, _ in chosen)
        balance = min(4.0, (len(chosen) - positives) / max(1, positives)) ** 0.5
        for lo in range(0, len(order), BATCH):
            picks = [chosen[i] for i in order[lo : lo + BATCH]]
            windows = [words[d][window_starts(len(words[d]))[k] :][:WINDOW] for d, k in picks]
            own = np.array([y[d] for d, _ in picks])
            weights = np.where(own == 1, balance, 1.0) / len(picks)
            _, grad = network.gradient(windows, own, weights.astype(np.float32), rng)
            turn += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            for k, g in grad.items():  # Adam with clipped gradients and decoupled decay
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                network.p[k] *= np.float32(1 - rate * DECAY)
                network.p[k] -= (rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-7)).astype(np.float32)
    return network


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, max_chars: int = MAX_CHARS) -> list:
    """At most max_per_class (text, toxic) rows of each class, outside the held-out fold, in an order fixed by doc_id."""
    own = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", "text").filter(F.length("text") <= max_chars)
    usable = own.join(texts.select("doc_id"), "doc_id", "left_semi")
    picked = None
    for kind in (0, 1):
        some = usable.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class)
        picked = some if picked is None else picked.unionByName(some)
    return texts.join(F.broadcast(picked), "doc_id").orderBy("doc_id", "text").limit(2 * max_per_class).select("text", "toxic").collect()


def score_documents(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, result: str = "score") -> DataFrame:
    """docs (or its columns named in keep) with the chance of the label toxic, in a column named by result."""
    sample = labelled_sample(docs, labels)
    targets = [int(r["toxic"]) for r in sample]
    network = fit([r["text"] for r in sample], targets) if 0 < sum(targets) < len(targets) else None
    constant = sum(targets) / len(targets) if targets else 0.0
    rows = docs.drop(result) if keep is None else docs.select(*dict.fromkeys([*keep, "text"]))
    names = rows.columns
    [found_name] = free_name(rows, "result")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(network) if network else None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = scorer.scores(texts) if scorer else np.full(len(texts), constant)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found)], [*names, found_name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    out = rows.mapInArrow(score, f"{schema}, `{found_name}` double").withColumnRenamed(found_name, result)
    return out if keep is None or "text" in keep else out.drop("text")


def op5_attention_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )

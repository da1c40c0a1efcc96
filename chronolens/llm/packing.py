"""Best-fit packing of token sequences with a certified bin count.

Documents become pieces of at most `capacity` tokens. Pieces are dealt evenly over partitions of bounded size; each is
packed by best-fit decreasing and compared with lower bounds from dual-feasible functions. Where bins and bound agree
the partition is certified and final. The others keep their full bins and give the rest back; those pieces meet in
fewer partitions and are packed again, until nothing is left, one partition holds all that is left, or a round saves
no sequence.

Defined cases: a null text packs as an empty one (the end id alone); rows that repeat are packed once each; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, free_name, store, table

CAPACITY = 2048
GROUP_ROWS = 40_000
MAX_ROUNDS = 8
CACHED_WORDS = 700_000
TEXT_AT_ONCE = 1 << 23  # characters
LONG_PART = 64  # characters; longer stretches of several words are not remembered

# Within these characters lower case and normal form C act on single characters, so a word's ids do not depend on its
# neighbours; texts with any other character, or with the string of an added token, go to the library whole.
_OTHER = re.compile(r"[^\t\n\r -~¡-ÿ]")
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes; ids of words, and of the stretches between white space
    that they make up, are looked up. What has not been met since the last full store of them is forgotten."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _ask(self, words: list[str]) -> None:
        for lo in range(0, len(words), 20_000):
            some = words[lo : lo + 20_000]
            code = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids, of = np.array(code.ids, "<u4").tobytes(), np.array([-1 if w is None else w for w in code.word_ids])
            ends = (4 * np.searchsorted(of, np.arange(len(some)), "right")).tolist()
            self.known.update(zip(some, map(ids.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))

    def _unknown(self, strings: list[str]) -> list[str]:
        """Those of which nothing is known; what was known before is known again."""
        unknown = set(filterfalse(self.known.__contains__, strings))
        again = set(filter(self.before.__contains__, unknown))
        self.known.update(zip(again, map(self.before.__getitem__, again), strict=True))
        return sorted(unknown - again)

    def _ids_of(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct stretches of a text without white space, in lower case."""
        if len(self.known) > CACHED_WORDS:
            self.before, self.known = self.known, {}
        found = list(map(self.known.get, parts))
        unknown = self._unknown([part for part, ids in zip(parts, found, strict=True) if ids is None])
        words = [_WORDS.findall(part) for part in unknown]
        self._ask(self._unknown(list(chain.from_iterable(words))))
        known, long = self.known, {}
        for part, own in zip(unknown, words, strict=True):
            if len(own) != 1:
                (known if len(part) <= LONG_PART else long)[part] = b"".join(map(known.__getitem__, own))
        return [ids if ids is not None else long[part] if part in long else known[part] for part, ids in zip(parts, found, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [bool(_OTHER.search(t)) or any(a in t for a in self.added) for t in texts]
        parts = pc.ascii_split_whitespace(pa.array(["" if w else t.lower() for t, w in zip(texts, whole, strict=True)], pa.large_string()))
        coded = parts.flatten().dictionary_encode()
        found, codes = self._ids_of(coded.dictionary.to_pylist()), coded.indices.to_numpy()
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts, counts = np.cumsum(sizes) - sizes, sizes[codes]
        ends = np.concatenate([[0], np.cumsum(counts)])
        shift = np.repeat((starts[codes] - ends[:-1]).astype("int32"), counts)  # a call's ids are far fewer than 2**31
        ids = np.frombuffer(b"".join(found), "<u4")[shift + np.arange(ends[-1], dtype="int32")]
        at = ends[parts.offsets.to_numpy()].tolist()
        return [
            np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if w else ids[lo:hi].tobytes()
            for t, w, lo, hi in zip(texts, whole, at, at[1:], strict=False)
        ]


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, last, step = encoder(tokenizer).encode, end_id.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            read = batch["text"].fillna("").str.len().cumsum().to_numpy() // TEXT_AT_ONCE
            bounds = [0, *(np.flatnonzero(np.diff(read)) + 1).tolist(), len(batch)]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                part, rows = batch.iloc[lo:hi], []
                for doc_id, ids in zip(part["doc_id"], encode(part["text"].fillna("").tolist()), strict=True):
                    ids += last
                    for piece, at in enumerate(range(0, len(ids), step)):
                        own = ids[at : at + step]
                        row = (doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own))
                        rows.append((*row, np.frombuffer(own, "<u4").astype("int32")) if keep_ids else row)
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids])
                out["doc_id"] = pd.array(out["doc_id"], "Int64") if kind in ("int", "bigint") else out["doc_id"]
                yield out

    more = ", ids array<int>" if keep_ids else ""
    return docs.select("doc_id", "text").mapInPandas(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long{more}")


def lower_bound(lengths: Counter, capacity: int) -> int:
    """Fewest bins that can hold these lengths, by three families of dual-feasible functions."""
    if not lengths:
        return 0
    x, n = np.array(sorted(lengths)), np.array([lengths[k] for k in sorted(lengths)], dtype=np.int64)
    best = -(-int((x * n).sum()) // capacity)
    suffix, volume = np.append(np.cumsum(n[::-1])[::-1], 0), np.append(0, np.cumsum(x * n))
    for small in x[x <= capacity // 2].tolist():  # small items vanish, items that leave less than that fill a bin
        lo, hi = np.searchsorted(x, small), np.searchsorted(x, capacity - small, "right")
        best = max(best, int(suffix[hi]) - (-int(volume[hi] - volume[lo]) // capacity))
    for k in range(1, 65):  # rounding to multiples of 1/k
        times = (k + 1) * x
        scaled = np.where(times % capacity == 0, x * k, (times // capacity) * capacity)
        best = max(best, -(-int((scaled * n).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, fill of each bin. A bit mask of the free spaces in use finds the tightest fit."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    mask = 0
    order = np.argsort(-lengths, kind="stable")
    for item, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = mask >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            bin_ = free[space].pop()
            if not free[space]:
                mask ^= 1 << space
        else:
            space, bin_ = capacity, len(fill)
            fill.append(0)
        bins[item], offsets[item] = bin_, capacity - space
        fill[bin_] += size
        if space > size:
            free[space - size].append(bin_)
            mask |= 1 << (space - size)
    return bins, offsets, np.array(fill, np.int64)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """pieces (length between 1 and capacity) plus sequence_id, offset and certified (its partition met its bound); columns of these names are replaced."""
    pieces = pieces.drop("sequence_id", "offset", "certified")
    row, group, space = free_name(pieces, "row", "group", "space")
    todo = store(pieces.withColumn(row, F.monotonically_increasing_id()))
    own = todo.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in todo.schema)
    full = todo.filter(F.col("length") >= capacity).withColumns(
        {"sequence_id": -1 - F.col(row), "offset": F.lit(0).cast("long"), "certified": F.lit(True)}
    )
    done, todo, used = [full], todo.filter(F.col("length") < capacity), 0
    for turn in range(MAX_ROUNDS):
        count = todo.count()
        if not count:
            break
        groups = -(-count // group_rows)

        def packed(key: tuple, rows: pd.DataFrame, turn: int = turn) -> pd.DataFrame:
            lengths = rows["length"].to_numpy(np.int64)
            bins, offsets, fill = best_fit_decreasing(lengths, capacity)
            rows["sequence_id"] = (turn << 56) + (int(key[0]) << 28) + bins
            rows["offset"] = offsets
            rows["certified"] = len(fill) <= lower_bound(Counter(lengths.tolist()), capacity)
            rows[space] = fill[bins] < capacity
            return rows

        dealt = todo.withColumn(group, F.pmod(F.xxhash64(row, F.lit(turn)), F.lit(groups)))
        result = store(
            dealt.groupBy(group).applyInPandas(
                lambda key, rows: packed(key, rows).drop(columns=group),
                f"{schema}, sequence_id long, offset long, certified boolean, `{space}` boolean",
            )
        )
        bins = result.filter(~F.col("certified") & F.col(space)).agg(F.count_distinct("sequence_id")).first()[0]
        if groups == 1 or not bins or bins == used:
            done.append(result.drop(space))
            break
        again = ~F.col("certified") & F.col(space)
        done.append(result.filter(~again).drop(space))
        todo, used = result.filter(again).select(own), bins
    else:
        done.append(result.filter(again).drop(space))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop(row)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id and ids (array<int>, documents in offset order) from pieces packed with keep_ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    return pack(token_pieces(docs, tokenizer, capacity, keep_ids=keep_ids), capacity)


def op2_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    placed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")

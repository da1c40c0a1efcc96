"""Ranked lexical search: an index per document shard, searched by pivots that must be able to beat a heap's threshold.

build_index() cuts the documents of each partition into shards of at most SHARD_BYTES of text and SHARD_DOCS rows and
writes one row for each shard and term: the places of its documents, in doc_id order, and its counts there; a row without
term holds the shard's doc_ids and lengths. Nothing is shuffled for that.

rank() takes the terms of all queries, counts their documents from the index (partial sums, one row a shard and term),
turns the counts into whole weights, and sends the postings of these terms alone to (shard, query block), never those of
other terms. There each query runs WAND: its lists stand at a document each; the first document at which the largest
possible gains of the lists up to it add up to more than the worst score of the full heap is the pivot; lists behind it
jump to it. From the pivot a window of documents is tested at once: a document is scored only if the largest gains of the
lists that hold it exceed the threshold, and the others are passed over. The heaps of the shards, k rows a query and
shard, are merged by a limit in each task before the shuffle, so what is shuffled does not depend on the matches.

Scores are whole numbers in 64 bits and each row of docs is a document of its own, so results are exact and do not depend
on how documents are dealt into shards. A frequent term has a posting row in each shard, so no key holds more than a
shard's documents; a hot source or a group of copies is spread like any other rows.

Defined cases: documents without terms (null, empty, punctuation only) count nowhere and are found by nothing; very long
texts are read whole and are a shard of their own where they exceed its size; rows that share a doc_id or a text are
documents of their own, equal scores go to the smaller doc_id, rows without doc_id come last; queries without terms give
no rows; rows that share an item_id are one query with the terms of all, rows without one are no query; an empty table on either side gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_stored, store, table

TOP = 10
SHARD_BYTES = 32 << 20
SHARD_DOCS = 1 << 16  # a place in a shard takes two bytes
BLOCK_ITEMS = 256
FIRST_WINDOW, LAST_WINDOW = 256, 8192
NO_ID = np.iinfo(np.int64).max  # stands for a missing doc_id, after all others

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = bytes(c if c > 127 or chr(c).isalnum() and not 65 <= c <= 90 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_INDEX = "shard long, term string, df long, terms long, places binary, counts binary"


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are put in lower case."""
    return text.encode().translate(_TERMS).split() if text else []


class Shard:
    """Documents of one shard while it is gathered."""

    def __init__(self):
        self.numbers: dict[bytes, int] = defaultdict(lambda: len(self.numbers))
        self.ids: list[int] = []
        self.lists: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        terms = terms_of(text)
        self.size += len(text) if text else 0
        if terms:
            self.ids.append(NO_ID if doc_id is None else doc_id)
            self.lists.append(np.fromiter(map(self.numbers.__getitem__, terms), np.int32, len(terms)))

    def full(self) -> bool:
        return self.size >= SHARD_BYTES or len(self.ids) >= SHARD_DOCS

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        ids = np.array(self.ids, np.int64)
        order = np.argsort(ids, kind="stable")
        lengths = np.array([len(x) for x in self.lists], np.int64)
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        keys = np.concatenate(self.lists).astype(np.int64) << 16 | np.repeat(place, lengths)
        keys, tf = np.unique(keys, return_counts=True)
        places, tf = (keys & 0xFFFF).astype("<u2"), tf.astype("<i4")
        cuts = np.append(np.searchsorted(keys, np.arange(len(self.numbers)) << 16), len(keys)).tolist()
        narrow = tf.astype("u1") if tf.max() < 256 else None
        terms = [None, *(t.decode() for t in self.numbers)]
        where, counts = places.tobytes(), (tf if narrow is None else narrow).tobytes()
        wide = 4 if narrow is None else 1
        spans = list(zip(cuts, cuts[1:], strict=False))
        first = [[ids[order].tobytes()], [lengths[order].tobytes()]]
        columns = [
            pa.array(np.full(len(terms), shard)),
            pa.array(terms, pa.string()),
            pa.array([len(ids), *(b - a for a, b in spans)], pa.int64()),
            pa.array([int(lengths.sum()), *[0] * len(spans)], pa.int64()),
            pa.array(first[0] + [where[2 * a : 2 * b] for a, b in spans], pa.binary()),
            pa.array(first[1] + [counts[wide * a : wide * b] for a, b in spans], pa.binary()),
        ]
        batch = pa.RecordBatch.from_arrays(columns, ["shard", "term", "df", "terms", "places", "counts"])
        for lo in range(0, len(terms), 20_000):
            yield batch.slice(lo, 20_000)


def build_index(docs: DataFrame) -> DataFrame:
    """shard, term, df, terms, places and counts; without term: number of documents, of their terms, doc_ids and lengths.

    A stored table, since shards are numbered by the task that writes them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard = (context.partitionId() if context else 0) << 32
        held = Shard()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    held.add(doc_id, text)
                    if held.full():
                        if held.ids:
                            yield from held.rows(shard)
                        held, shard = Shard(), shard + 1
        if held.ids:
            yield from held.rows(shard)

    return store(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _INDEX))


def query_terms(items: DataFrame) -> DataFrame:
    """item_id and term, once each."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return items.filter("item_id IS NOT NULL").select("item_id", F.explode(F.regexp_extract_all(lower, F.lit(f"({TERM})"), 1)).alias("term")).distinct()


class Heap:
    """The k best of the documents seen, in ascending order of place; threshold is what a later one must exceed."""

    def __init__(self, k: int):
        self.k, self.threshold = k, 0
        self.places, self.scores = np.empty(0, np.int64), np.empty(0, np.int64)

    def push(self, places: np.ndarray, scores: np.ndarray) -> None:
        places, scores = np.concatenate([self.places, places]), np.concatenate([self.scores, scores])
        best = np.lexsort((places, -scores))[: self.k]
        self.places, self.scores = places[best], scores[best]
        if len(best) == self.k:
            self.threshold = int(self.scores[-1])


def wand(lists: list[tuple[np.ndarray, np.ndarray, int]], k: int) -> Heap:
    """Best k by the sum of gains over lists of (places ascending, gains, largest gain); equal sums to the smaller place."""
    heap, width = Heap(k), FIRST_WINDOW
    at = [0] * len(lists)
    now = np.array([x[0][0] for x in lists], np.int64)
    most = np.array([x[2] for x in lists], np.int64)
    end = np.iinfo(np.int64).max
    while True:
        order = np.argsort(now, kind="stable")
        live = order[now[order] < end]
        beats = np.flatnonzero(np.cumsum(most[live]) > heap.threshold)
        if not len(beats):
            return heap
        pivot = int(now[live[beats[0]]])
        # Lists that stand behind the pivot jump to it; all are read up to the window's end.
        slices = []
        for t in live.tolist():
            places = lists[t][0]
            if now[t] >= pivot + width:
                continue
            lo = at[t] if now[t] >= pivot else at[t] + int(np.searchsorted(places[at[t] :], pivot))
            hi = lo + int(np.searchsorted(places[lo:], pivot + width))
            if hi > lo:
                slices.append((t, lo, hi))
            at[t] = hi
            now[t] = places[hi] if hi < len(places) else end
        inside = np.concatenate([lists[t][0][lo:hi] for t, lo, hi in slices]) - pivot
        bound = np.zeros(width, np.int64)
        np.add.at(bound, inside, np.repeat(most[[t for t, _, _ in slices]], [hi - lo for _, lo, hi in slices]))
        able = bound > heap.threshold
        if able.any():
            scored = able[inside]
            gains = np.concatenate([lists[t][1][lo:hi] for t, lo, hi in slices])[scored]
            scores = np.zeros(width, np.int64)
            np.add.at(scores, inside[scored], gains)
            good = np.flatnonzero(scores > heap.threshold)
            heap.push(good + pivot, scores[good])
        width = min(2 * width, LAST_WINDOW)


def search_shard(rows: pa.Table, documents: int, total: int, k: int) -> pa.Table:
    """item_id, doc_id and score of the k best of each item in the one shard and block that rows hold."""
    lists: dict[object, list[tuple[np.ndarray, np.ndarray, int]]] = defaultdict(list)
    head = rows.column("term").to_pylist().index(None)
    ids, lengths = (np.frombuffer(rows.column(c)[head].as_py(), "<i8") for c in ("places", "counts"))
    norm = 8 * (100 - 90 + 90 * lengths * documents // total)
    for row in range(rows.num_rows):
        if row == head:
            continue
        places = np.frombuffer(rows.column("places")[row].as_py(), "<u2").astype(np.int64)
        counts = rows.column("counts")[row].as_py()
        tf = np.frombuffer(counts, "u1" if len(counts) == len(places) else "<i4").astype(np.int64)
        gains = rows.column("weight")[row].as_py() * (1_000_000_000 * tf // (1000 * tf + norm[places]))
        one = places, gains, int(gains.max())
        if one[2] > 0:
            for item in rows.column("items")[row].as_py():
                lists[item].append(one)
    found: list[list] = [[], [], []]
    for item, own in lists.items():
        heap = wand(own, k)
        found[0] += [item] * len(heap.places)
        found[1] += [None if x == NO_ID else x for x in ids[heap.places].tolist()]
        found[2] += heap.scores.tolist()
    return pa.Table.from_arrays([pa.array(found[0], rows.schema.field("items").type.value_type), pa.array(found[1], pa.int64()), pa.array(found[2], pa.int64())], ["item_id", "doc_id", "score"])


def rank(index: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item (columns item_id and text)."""
    kind = items.schema["item_id"].dataType.simpleString()
    heads, postings = index.filter("term IS NULL"), index.filter("term IS NOT NULL")
    documents, total = heads.agg(F.sum("df"), F.sum("terms")).first()
    wanted = store(query_terms(items))
    blocks = -(-wanted.select("item_id").distinct().count() // BLOCK_ITEMS)
    if not documents or not blocks:
        return index.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    held = postings.select("term", "df").join(wanted.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("n"))
    weights = held.select("term", F.floor(1000 * F.log(F.lit(2 * documents + 2) / (2 * F.col("n") + 1))).cast("long").alias("weight"))
    by_term = store(  # its size decides how it is joined with the index
        wanted.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
        .groupBy("term", "block").agg(F.collect_list("item_id").alias("items")).join(weights, "term")
    )
    drop_stored(wanted)
    rows = postings.join(by_term, "term").select("shard", "block", "term", "weight", "items", "places", "counts")
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    heads = heads.select("shard", every_block, "term", F.lit(None).cast("long").alias("weight"), F.lit(None).cast(f"array<{kind}>").alias("items"), "places", "counts")
    found = rows.unionByName(heads).groupBy("shard", "block").applyInArrow(lambda t: search_shard(t, documents, total, k), f"item_id {kind}, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_shard_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH own AS (
  SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), lengths AS (SELECT row, any_value(doc_id) AS doc_id, count(*) AS n FROM own GROUP BY row
), total AS (SELECT count(*) AS documents, sum(n)::BIGINT AS terms FROM lengths
), wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL
), counts AS (
  SELECT row, term, count(*) AS tf FROM own WHERE term IN (SELECT term FROM wanted) GROUP BY row, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, total GROUP BY term, documents
), gains AS (
  SELECT row, term, doc_id, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * documents) // terms))) AS gain
  FROM counts JOIN lengths USING (row) JOIN weights USING (term), total
), scores AS (
  SELECT item_id, row, any_value(doc_id) AS doc_id, sum(gain)::BIGINT AS score FROM wanted JOIN gains USING (term) GROUP BY item_id, row
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

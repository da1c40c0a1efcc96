"""MinHash near-dedup by a chosen-path set similarity join.

Documents with equal shingle sets form one node of the join. In each of several independent trees a node goes to the
place of its minwise token under the hash function of that tree. Places of bounded weight (nodes and bytes of text) are
compared exhaustively: sketches (agreement of the minhashes) first, then exact intersections of the full sets of those
with a possible partner. Heavier places are dealt into chunks of that weight that all share a few pivots and compared
likewise; where all but a bounded rest of a place is one component already, the rest meets every chunk of it. The
number of trees follows from the recall wanted of a pair at the threshold that is separated only by its first token.

Nodes of places that stay crowded branch once more, by the minwise of their tokens that are not frequent among these
nodes, so places stay small. Two sets at the threshold of which a share h is frequent still agree there in
(threshold - h) / (1 - h) of the functions, and each node takes as many of these trees as its own share asks for; nodes
with too large a share go to the places of a whole prefix of their tokens besides, which loses nothing. What is crowded
even then is finished block against block, in groups of the same bounded weight, so there is no further level.

The sketch keeps a pair whose minhashes agree in at least SKETCH_FLOOR of SKETCH places; a pair at similarity 0.75
falls below with a probability of 4e-7.

Defined cases: texts that are null or hold no word have an empty set, are linked with nothing and form their own
component; rows that share a doc_id have their own text's component, and ``keep_one`` drops the doc_id if one of them
goes; rows without doc_id are linked like all others, have the smallest doc_id of their component (null if it has none)
and are always kept; equal texts, repeated rows and very long texts are ordinary cases; an empty table gives an empty
result; other columns are carried along by ``keep_one`` and never read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, free_name, store, table
from .components import component_map
from .shingles import SHINGLE_WORDS, MinHasher, mixed, set_digest, shingle_set

SKETCH = 64
SKETCH_FLOOR = 30
LIMIT = 2048  # nodes of a group; comparing a node's sketch with so many costs less than further places for it
BYTE_LIMIT = 8_000_000  # of the texts of a group
HOT_TOKENS = 100_000  # known to be frequent; recall does not depend on the number
MOST_TREES = 64  # beyond the share of frequent tokens that asks for more, a prefix
PIVOTS = 4
RECALL = 0.99999
FIRST_TREES = 2
DENSE_CELLS, RANGE_MEMBERS = 4_000_000, 500_000


def trees_for(recall: float, threshold: float, most: int = SKETCH) -> int:
    """Independent functions of which two sets at the threshold agree in one, with probability recall."""
    if threshold >= 1:
        return 1
    return min(most, math.ceil(math.log(1 - recall) / math.log(1 - threshold))) if threshold > 0 else most


def set_features(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, mark (a hash of the text), size (its bytes), n_shingles, node (128-bit digest of the shingle set, null if empty) and sig (its minhashes)."""
    kind = docs.schema["doc_id"].dataType
    hasher = MinHasher(SKETCH)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, nodes, sigs = [], [], []
            for text in batch.column("text"):
                own = shingle_set(text.as_py(), width)
                counts.append(len(own))
                nodes.append(set_digest(own) if len(own) else None)
                sigs.append(hasher(own).tobytes() if len(own) else None)
            columns = [*(batch.column(c) for c in ("doc_id", "mark", "size")), pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "size", "n_shingles", "node", "sig"])

    schema = f"doc_id {kind.simpleString()}, mark long, size long, n_shingles long, node binary, sig binary"
    size = F.octet_length("text").cast("long").alias("size")
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), size, "text").mapInArrow(features, schema)


def whole_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text of wanted (node, id, mark); the text is another one where two have one mark."""
    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"), "text")
    named = texts.filter(F.col("id").isNotNull()).join(wanted.filter(F.col("id").isNotNull()), ["id", "mark"])
    named = named.groupBy("id", "mark", "node").agg(F.first("text").alias("text"))  # repeated rows once; no further exchange
    nameless = texts.filter(F.col("id").isNull()).groupBy("mark").agg(F.first("text").alias("text"))
    rest = nameless.join(wanted.filter(F.col("id").isNull()), "mark")
    return named.select("node", "text").unionByName(rest.select("node", "text"))


def coordinate(sig: str, at) -> Column:
    return F.substring(F.col(sig), at * 4 + 1, F.lit(4)) if not isinstance(at, int) else F.substring(sig, at * 4 + 1, 4)


def by_group(rows: DataFrame, key: str, handle: Callable[[pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """handle() on the rows of each key; keys must have a bounded number of rows. Many small groups share one call into Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def groups(last: bool) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            keys = whole.column(key).to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            held.clear()
            for lo, hi in zip(cuts[: None if last else -1], cuts[1 : None if last else -1], strict=False):
                if hi - lo > 1 and (out := handle(whole.slice(lo, hi - lo))) is not None:
                    yield from out.to_batches()
            if not last:
                held.extend(whole.slice(cuts[-2]).to_batches())

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                yield from groups(False)
        if held:
            yield from groups(True)

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def possible_partners(group: pa.Table, floor: int, share: float) -> pa.Table | None:
    """Members of a group whose sketch agrees enough with one of another component and similar size."""
    sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.int32).reshape(group.num_rows, -1)
    size = group.column("n_shingles").to_numpy()
    comp = np.unique(np.array(group.column("comp").to_pylist(), dtype=object), return_inverse=True)[1]
    if not comp.any():
        return None
    agree = np.zeros((len(sig), len(sig)), np.int16)
    for column in sig.T:
        agree += column[:, None] == column[None, :]
    near = (agree >= floor) & (comp[:, None] != comp[None, :])
    near &= np.minimum.outer(size, size) >= share * np.maximum.outer(size, size) - 1e-9
    return group.filter(pa.array(near.any(axis=1))).select(["group", "node", "comp"])


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of ascending sets (not of a set with itself), by products of 0-1 matrices.

    One range of values after the other and, within it, blocks of the members that sets share, so memory stays bounded.
    """
    shared = np.zeros((len(sets), len(sets)), np.float32)
    parts = max(1, -(-sum(map(len, sets)) // RANGE_MEMBERS))
    bounds = [int(k * 2**64 / parts) for k in range(1, parts)]
    cuts = [[0, *np.searchsorted(s, np.array(bounds, np.uint64)).tolist(), len(s)] for s in sets]
    for part in range(parts):
        own = [s[c[part] : c[part + 1]] for s, c in zip(sets, cuts, strict=True)]
        _, inverse, counts = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        keep = counts[inverse] > 1
        columns = (np.cumsum(counts > 1) - 1)[inverse[keep]]
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in own])[keep]
        order = np.argsort(columns, kind="stable")
        rows, columns = rows[order], columns[order]
        step, total = max(1, DENSE_CELLS // len(sets)), int((counts > 1).sum())
        for lo in range(0, total, step):
            first, last = np.searchsorted(columns, [lo, lo + step])
            block = np.zeros((len(sets), min(step, total - lo)), np.float32)
            block[rows[first:last], columns[first:last] - lo] = 1
            shared += block @ block.T
    return shared.astype(np.int64)


def exact_links(group: pa.Table, percent: int, width: int) -> pa.Table | None:
    """Links (a, b) from the smallest to every other component that confirmed links on full shingle sets join to it."""
    rows = {}
    for node, comp, text in zip(group.column("node").to_pylist(), group.column("comp").to_pylist(), group.column("text"), strict=True):
        if node not in rows:
            own = shingle_set(text.as_py(), width)
            if set_digest(own) == node:
                rows[node] = (comp, own)
    comps, sets = [c for c, _ in rows.values()], [s for _, s in rows.values()]
    sizes = np.array([len(s) for s in sets])
    if len(sets) < 2:
        return None
    parent = {c: c for c in comps}

    def root(c: bytes) -> bytes:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    shared = intersections(sets)
    own = np.unique(np.array(comps, dtype=object), return_inverse=True)[1]
    both = sizes[:, None] + sizes[None, :]
    linked = ((100 + percent) * shared >= percent * both) & (own[:, None] < own[None, :])
    for i, j in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
        a, b = root(comps[i]), root(comps[j])
        if a != b:
            parent[max(a, b)] = min(a, b)
    links = [(root(c), c) for c in parent if root(c) != c]
    if not links:
        return None
    return pa.table({"a": pa.array([a for a, _ in links], pa.binary()), "b": pa.array([b for _, b in links], pa.binary())})


def weight(nodes: str, size: str) -> Column:
    """Of nodes and their texts, in groups."""
    return F.col(nodes) / LIMIT + F.col(size) / BYTE_LIMIT


def places(active: DataFrame) -> DataFrame:
    """path, whole (its weight), major (its largest component), rest (weight of the nodes outside that) of places with two components or more."""
    comps = active.groupBy("path", "comp").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("s"))
    top = F.max(F.struct("m", "comp", "s"))
    info = comps.groupBy("path").agg(F.sum("m").alias("n"), F.sum("s").alias("s"), top.alias("top"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    info = info.select("path", "n", "s", F.col("top.comp").alias("major"), (F.col("n") - F.col("top.m")).alias("m2"), (F.col("s") - F.col("top.s")).alias("s2"))
    return info.select("path", "major", weight("n", "s").alias("whole"), weight("m2", "s2").alias("rest"))


def is_crowded() -> Column:
    return (F.col("whole") > 1) & (F.col("rest") > 1)


OWN = ["node", "comp", "n_shingles", "size", "sig"]


def work_groups(active: DataFrame, info: DataFrame, seed: int) -> DataFrame:
    """group and the columns OWN: every place as groups of bounded weight (a pivot may come twice)."""
    rows = active.join(info, "path").withColumn("chunks", F.ceil("whole").cast("long"))
    everywhere = (F.col("whole") > 1) & (F.col("rest") <= 1) & (F.col("comp") != F.col("major"))
    every = F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)
    at = F.when(everywhere, every).otherwise(F.array(F.pmod(F.xxhash64("node", F.lit(seed)), F.col("chunks"))))
    groups = rows.select("path", *OWN, F.explode(at).alias("chunk"))
    picks = [F.min_by(F.struct(*OWN), F.xxhash64("node", F.lit(seed), F.lit(k))) for k in range(PIVOTS)]
    pivots = (
        rows.filter(is_crowded()).groupBy("path").agg(F.array_distinct(F.array(*picks)).alias("p"), F.first("chunks").alias("chunks"))
        .select("path", F.explode("p").alias("p"), "chunks").select("path", "p.*", F.explode(every).alias("chunk"))
    )
    return groups.unionByName(pivots).select(F.xxhash64("path", "chunk").alias("group"), *OWN)


def block_groups(active: DataFrame, info: DataFrame) -> DataFrame:
    """group and the columns OWN: crowded places as groups of two blocks, one for each two blocks of a place."""
    rows = active.join(info, "path").withColumn("blocks", F.ceil(2 * F.col("whole")).cast("long"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    pair = F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other"))
    return rows.select("path", *OWN, "own", other).select(pair.alias("group"), *OWN)


def selected_places(crowd: DataFrame, texts: DataFrame, percent: int, recall: float, width: int) -> DataFrame:
    """path, node, comp, size: crowd (node, comp, size) at the places of selected tokens of each node; see above.

    Of n tokens in one order for all, the first n - ceil(n * percent / 100) + 1 are a prefix such that two sets at the
    threshold share a token of both prefixes; frequent tokens come last in it.
    """
    rows = store(crowd.join(texts, "node").select("node", "comp", "size", "text"))

    def sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for k, (node, text) in enumerate(zip(batch.column("node").to_pylist(), batch.column("text"), strict=True)):
            own = shingle_set(text.as_py(), width)
            if set_digest(own) == node:
                yield k, own

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                found = [own for _, own in sets(batch.slice(lo, 500))]
                values, n = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], ["token", "n"])

    counts = rows.mapInArrow(tokens, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") > LIMIT)
    frequent = [r["token"] for r in counts.orderBy(F.desc("n"), "token").limit(HOT_TOKENS).collect()]  # at most HOT_TOKENS
    known = np.sort(np.array(frequent, np.int64).view(np.uint64))
    trees = np.array([trees_for(recall, (percent - h) / (100 - h), MOST_TREES) for h in range(percent)] + [MOST_TREES] * (101 - percent))
    hasher = MinHasher(MOST_TREES, seed=2, bits=64)
    salts = mixed(np.arange(1, MOST_TREES + 1, dtype=np.uint64))

    def places_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, paths = [], []
            for k, own in sets(batch):
                hot = np.isin(own, known, assume_unique=True)
                count = int(trees[-(-100 * int(hot.sum()) // len(own))])
                if not hot.all():
                    paths.append(mixed(hasher(own[~hot], count) ^ salts[:count]))
                    at += [k] * count
                if count == MOST_TREES:
                    prefix = own[np.lexsort((own, hot))][: len(own) - -(-len(own) * percent // 100) + 1]
                    paths.append(prefix)
                    at += [k] * len(prefix)
            paths = np.concatenate([np.empty(0, np.uint64), *paths]).view(np.int64)
            own = batch.select(["node", "comp", "size"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(paths), *own.columns], ["path", "node", "comp", "size"])

    found = store(rows.mapInArrow(places_of, "path long, node binary, comp binary, size long"))
    drop_stored(rows)
    return found


class Merger:
    """The component (its smallest node) of every node that is no longer alone."""

    def __init__(self) -> None:
        self.comps: DataFrame | None = None

    def add(self, links: DataFrame) -> None:
        if not links.limit(1).count():
            return
        merged = component_map(links)
        if self.comps is not None:
            last = self.comps
            roots = merged.select(F.col("c").alias("comp"), "root")
            known = last.join(roots, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"))
            fresh = merged.select(F.col("c").alias("node"), F.col("root").alias("comp")).join(last.select("node"), "node", "left_anti")
            self.comps = store(known.unionByName(fresh))
            drop_stored(last)
        else:
            self.comps = store(merged.select(F.col("c").alias("node"), F.col("root").alias("comp")))

    def named(self, rows: DataFrame) -> DataFrame:
        """rows (node and others) with comp."""
        if self.comps is None:
            return rows.withColumn("comp", F.col("node"))
        return rows.join(self.comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def near_components(docs: DataFrame, percent: int = 75, recall: float = RECALL, width: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    share = percent / 100
    features = store(set_features(docs, width))
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), "mark", "size")).alias("row")
    nodes = store(
        features.filter(F.col("node").isNotNull())
        .groupBy("node").agg(first_row, F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
        .select("node", "row.id", "row.mark", "row.size", "n_shingles", "sig")
    )
    trees = trees_for(recall, share)
    first = F.array(*[F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), coordinate("sig", t)).alias("path")) for t in range(trees)])
    placed = nodes.select("node", F.explode(first).alias("p")).select("node", "p.tree", "p.path")
    placed = store(placed.join(placed.groupBy("path").count().filter("count > 1").select("path"), "path"))
    members = store(nodes.join(placed.select("node").distinct(), "node"))
    texts = store(whole_texts(docs, members.select("node", "id", "mark")))
    about = members.select("node", "n_shingles", "size", "sig")
    merger = Merger()

    def compare(groups: DataFrame) -> None:
        maybe = store(by_group(groups, "group", lambda g: possible_partners(g, SKETCH_FLOOR, share), "group long, node binary, comp binary"))
        if maybe.limit(1).count():
            links = store(by_group(maybe.join(texts, "node"), "group", lambda g: exact_links(g, percent, width), "a binary, b binary"))
            merger.add(links)
            drop_stored(links)
        drop_stored(maybe)

    def settle(active: DataFrame, info: DataFrame, seed: int, last: bool) -> DataFrame:
        """Compare places; of those that were crowded, close what one component nearly fills and return the others (with last: finish them too)."""
        compare(work_groups(active, info, seed))
        again = store(active.drop("comp").join(info.filter(is_crowded()).select("path"), "path"))
        left = store(places(merger.named(again)))
        if left.limit(1).count():
            rows, closable = merger.named(again), left.filter(~is_crowded())
            groups = work_groups(rows, closable, seed)
            compare(groups.unionByName(block_groups(rows, left.filter(is_crowded()))) if last else groups)
        open_ = store(again.join(left.filter(is_crowded()).select("path"), "path").select("node", "size").distinct())
        drop_stored(again, left)
        return open_

    crowds = []
    for batch in (F.col("tree") < FIRST_TREES, F.col("tree") >= FIRST_TREES):
        active = store(merger.named(placed.filter(batch).select("path", "node").join(about, "node")))
        info = store(places(active))
        crowds.append(settle(active, info, 0, last=False))
        drop_stored(active, info)
    drop_stored(placed)
    crowd = crowds[0].unionByName(crowds[1]).distinct()
    if crowd.limit(1).count():
        chosen = selected_places(merger.named(crowd), texts, percent, recall, width)
        info = store(places(chosen))
        active = store(chosen.join(info.select("path"), "path").join(about.drop("size"), "node"))
        crowds.append(settle(active, info, 1, last=True))
        drop_stored(chosen, info, active)
    drop_stored(texts, members, *crowds)
    found = merger.named(nodes.select("node", "id"))
    smallest = found.groupBy("comp").agg(F.min("id").alias("component_id"))
    classes = store(found.join(smallest, "comp").select("node", "component_id"))
    drop_stored(nodes)
    return (
        features.select("doc_id", "n_shingles", "node").join(classes, "node", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    )


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs without the documents that have a near copy of smaller doc_id in their component."""
    [name] = free_name(docs, "gone")
    gone = near_components(docs, percent).filter("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def op10_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

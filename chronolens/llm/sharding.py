"""Sharding by histogram sort: exact byte counts below candidate boundaries, refined until every splitter is close enough.

Rows are ordered by a 64-bit key whose upper 40 bits hash the text and whose lower 24 bits hash the document id. Equal
texts are therefore neighbours, yet one text that fills a third of the corpus can still be cut, because its copies
spread over 2**24 keys. Each round sums the bytes of the bins that can hold a splitter still open, with map-side
partial sums; only these sums (at most bins x open splitters) reach the driver. Rows move once, after the last round.

Defined cases: a null text has size 1 and the checksum of an empty one; rows that repeat in full share a key and stay
together; an empty table gives an empty result; other columns are written by ``write_shards`` (one named shard is
replaced) and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_stored, free_name, interval_index, store, table

TEXT_BITS = 40
ROUND_BITS = (10, 10, 10, 10, 12, 12)
LAST_KEY = 2**63 - 1
# of a range, a sixteenth of a shard: a boundary anywhere lies within 0.13 % of a shard, one between texts may lie 3 % off
TOLERANCE, TEXT_SLACK = 0.02, 0.5


def sort_key(text: Column, doc_id: Column) -> Column:
    low = 2 ** (64 - TEXT_BITS) - 1
    return F.xxhash64(text).bitwiseAND(F.lit(~low)).bitwiseOR(F.xxhash64(doc_id, F.lit("id")).bitwiseAND(F.lit(low)))


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def find_splitters(keys: DataFrame, parts: int, tolerance: float, text_slack: float) -> list[int]:
    """Ascending keys that cut `keys` (key long, size long) into parts of near-equal summed size.

    A boundary is taken when it lies within tolerance x (total / parts) of its target. The first rounds only offer
    boundaries between different texts, and their last one takes whatever lies within text_slack; copies of one text
    are cut only where no boundary between texts is that near.
    """
    open_bins: dict[int, tuple[int, list[int]]] = {}
    found: dict[int, int] = {}
    bits, total, goal = 0, 0, []
    for step in ROUND_BITS:
        wanted = keys if bits == 0 else keys.filter(F.shiftright("key", 64 - bits).isin(list(open_bins)))
        bits += step
        sums = wanted.groupBy(F.shiftright("key", 64 - bits).alias("bin")).agg(F.sum("size").alias("size")).collect()
        children: dict[int, list[tuple[int, int]]] = {}
        for bin_, size in sorted(sums):
            children.setdefault(bin_ >> step if bits > step else 0, []).append((bin_, size))
        if bits == step:
            total = sum(size for _, size in sums)
            if not total:
                return [LAST_KEY] * (parts - 1)
            goal = [total * (j + 1) / parts for j in range(parts - 1)]
            open_bins = {0: (0, list(range(parts - 1)))}
        slack, narrower = (text_slack if bits == TEXT_BITS else tolerance) * total / parts, {}
        for parent, (below, targets) in open_bins.items():
            waiting = iter(targets)
            j = next(waiting, None)
            for bin_, size in children[parent]:
                while j is not None and goal[j] <= below + size:
                    under, over = goal[j] - below, below + size - goal[j]
                    if min(under, over) <= slack or bits == 64:
                        found[j] = min((bin_ + (over < under)) << (64 - bits), LAST_KEY)
                    else:
                        narrower.setdefault(bin_, (below, []))[1].append(j)
                    j = next(waiting, None)
                below += size
        open_bins = narrower
        if not open_bins:
            break
    return [found[j] for j in range(parts - 1)]


def assign_ranges(keyed: DataFrame, shards: int, ranges_per_shard: int, tolerance: float, text_slack: float) -> DataFrame:
    """Add shard, range (a slice of one shard) and slot (gapless position in the shard, in key order).

    Slots come from the row counts of the ranges plus a position within one range, so no task ever holds a shard.
    """
    splitters = find_splitters(keyed.select("key", "size"), shards * ranges_per_shard, tolerance, text_slack)
    ranged = keyed.withColumn("range", interval_index(F.col("key"), splitters))
    shard = F.floor(F.col("range") / ranges_per_shard).cast("int")
    before = (
        ranged.groupBy("range").count().withColumn("shard", shard)
        .withColumn("first_slot", F.sum("count").over(Window.partitionBy("shard").orderBy("range")) - F.col("count"))
        .select("range", "shard", "first_slot")
    )
    place = F.row_number().over(Window.partitionBy("range").orderBy("key", *[c for c in ("doc_id", "text_crc32") if c in keyed.columns]))
    return (
        ranged.withColumn("place", place)
        .join(F.broadcast(before), "range")  # shards x ranges_per_shard rows at most
        .withColumn("slot", (F.col("first_slot") + F.col("place") - 1).cast("long"))
        .drop("place", "first_slot")
    )


def shard_documents(docs: DataFrame, shards: int = 16, ranges_per_shard: int = 16, tolerance: float = TOLERANCE, text_slack: float = TEXT_SLACK) -> DataFrame:
    """doc_id, size, text_crc32, shard, range and slot of every document; sizes of shards are near equal."""
    keyed = store(
        docs.select(
            "doc_id", text_size(F.col("text")).alias("size"),
            F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
            sort_key(F.col("text"), F.col("doc_id")).alias("key"),
        )
    )
    return assign_ranges(keyed, shards, ranges_per_shard, tolerance, text_slack)


def write_shards(docs: DataFrame, path: str, shards: int = 16, ranges_per_shard: int = 16, tolerance: float = TOLERANCE, text_slack: float = TEXT_SLACK) -> None:
    """Write whole documents in key order under path/shard=N/, one exchange after the splitters are known."""
    key = sort_key(F.col("text"), F.col("doc_id"))
    parts = shards * ranges_per_shard
    keys = store(docs.select(key.alias("key"), text_size(F.col("text")).alias("size")))  # texts are hashed once, whatever the rounds
    splitters = find_splitters(keys, parts, tolerance, text_slack)
    drop_stored(keys)
    own, range_ = free_name(docs.drop("shard"), "key", "range")
    (
        docs.withColumn(own, key).withColumn(range_, interval_index(F.col(own), splitters))
        .withColumn("shard", F.floor(F.col(range_) / ranges_per_shard).cast("int"))
        .repartitionByRange(parts, range_, own).sortWithinPartitions(range_, own)
        .drop(own, range_).write.partitionBy("shard").parquet(path)
    )


def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

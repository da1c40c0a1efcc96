"""Vector preparation that the search operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store

QUERY_STEP = 20


def usable(v: Column) -> Column:
    """Neither null nor holding a null, NaN or infinite component."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True))


def prepared(embeddings: DataFrame, kind: str, component) -> tuple[DataFrame, int]:
    """vec_id, v (array of `kind`, shorter vectors padded with zeros) of every usable row; rows of one vec_id count once."""
    v = F.transform("embedding", lambda x: component(x.cast("double")).cast(kind))
    rows = (
        embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        .filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
        .groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        .select("vec_id", v.alias("v"))
    )
    rows = store(rows)
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0
    padded = F.concat("v", F.array_repeat(F.lit(0).cast(kind), F.lit(dim) - F.size("v")))
    return rows.select("vec_id", padded.alias("v")), dim


def query_blocks(rows: DataFrame, dim: int, size: int, step: int = QUERY_STEP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the queries, at most `size` at a time on the driver."""
    queries, last = rows.filter(F.col("vec_id") % step == 0), None
    while True:
        block = (queries if last is None else queries.filter(F.col("vec_id") > last)).orderBy("vec_id").limit(size).collect()
        if block:
            last = block[-1]["vec_id"]
            yield np.array([r["vec_id"] for r in block], np.int64), np.array([r["v"] for r in block]).reshape(len(block), dim)
        if len(block) < size:
            return


def matrix(column, dim: int) -> np.ndarray:
    """A 2-d array of an Arrow list column whose lists all have dim elements."""
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)

"""Session helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where the session names none and is one process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="chronolens-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Files of the shuffles of queries run within go when each query ends, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def store(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and no executor owns the data.

    Shuffle files of the write go with it; until then lost ones are made again. What drop_stored() has not deleted
    before is deleted when the driver ends, since results read their tables lazily.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    hadoop, files = _file_system(spark, path)
    files.deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables made by store() that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/table-" in path:
                hadoop, files = _file_system(df.sparkSession, path)
                files.delete(hadoop, True)


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that no column of df has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def interval_index(value: Column, splitters: Sequence[int]) -> Column:
    """How many of the ascending splitters are <= value, as a balanced tree of comparisons (log2 of them a row)."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < F.lit(splitters[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(splitters))

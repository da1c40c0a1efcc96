"""Partitioned event store with a manifest, so that a day without rows is told from a day never processed."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import canonical_text

MANIFEST = "domain string, day date, stage string, rows long"


class PacketIntegrityError(ValueError):
    """A stored packet line is not the canonical text of its own content."""


class Store:
    """Tables under one root: root/stage/domain=…/day=… and root/manifest."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, stage: str, domain: str, day: str) -> str:
        return f"{self.root}/{stage}/domain={domain}/day={day}"

    def replace(self, rows: DataFrame, domain: str, day: str, schema: T.StructType, stage: str = "events") -> int:
        """Replace one partition, cast to the declared schema; an empty result removes the old rows and is recorded as processed."""
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        rows.write.mode("overwrite").parquet(self._path(stage, domain, day))
        n = self.spark.read.schema(rows.schema).parquet(self._path(stage, domain, day)).count()
        self._record(domain, day, stage, n)
        return n

    def _record(self, domain: str, day: str, stage: str, n: int) -> None:
        entry = self.spark.createDataFrame([(domain, day, stage, n)], "domain string, day string, stage string, rows long")
        entry.withColumn("day", F.to_date("day")).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/{stage}-{domain}-{day}")

    def manifest(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{self.root}/manifest")

    def exists(self, domain: str, day: str, stage: str = "events") -> bool:
        return bool(self.manifest().filter((F.col("domain") == domain) & (F.col("day") == F.to_date(F.lit(day))) & (F.col("stage") == stage)).limit(1).count())

    def days(self, domain: str, stage: str = "events") -> DataFrame:
        return self.manifest().filter((F.col("domain") == domain) & (F.col("stage") == stage)).select("day").distinct().orderBy("day")

    def read(self, domain: str, day: str, schema: T.StructType, stage: str = "events", position: str | None = None) -> DataFrame:
        """Rows of a day; columns an old partition lacks are NULL, a day never processed is an error. position: name of a column of the stored order."""
        if not self.exists(domain, day, stage):
            raise FileNotFoundError(f"{stage} of {domain} on {day} were never stored")
        rows = self.spark.read.schema(schema).parquet(self._path(stage, domain, day))
        return rows.withColumn(position, F.struct("_metadata.file_name", "_metadata.row_index")) if position else rows

    def read_days(self, domain: str, days: list[str], schema: T.StructType, stage: str = "events") -> DataFrame:
        """One partition-pruned scan over those of the days that are stored, with their day."""
        wanted = T.StructType([*schema.fields, T.StructField("domain", T.StringType()), T.StructField("day", T.DateType())])
        rows = self.spark.read.schema(wanted).parquet(f"{self.root}/{stage}")
        return rows.filter((F.col("domain") == domain) & F.col("day").isin([F.to_date(F.lit(d)) for d in days])) if days else rows.limit(0)

    def write_packets(self, packets: DataFrame, domain: str, day: str, column: str = "canonical") -> int:
        """Gzip text whose lines are the hashed bytes, recorded as processed."""
        path = self._path("packets", domain, day)
        packets.select(column).write.mode("overwrite").text(path, compression="gzip")
        n = self.spark.read.text(path).count()
        self._record(domain, day, "packets", n)
        return n

    def read_packets(self, domain: str, day: str) -> DataFrame:
        """canonical, content_hash; every line must survive parsing and re-rendering unchanged."""
        @F.pandas_udf(T.BooleanType())
        def same(lines: pd.Series) -> pd.Series:
            return lines.map(lambda x: canonical_text(json.loads(x)) == x)

        rows = self.spark.read.text(self._path("packets", domain, day)).select(F.col("value").alias("canonical"))
        if rows.filter(~same("canonical")).limit(1).count():
            raise PacketIntegrityError(f"a packet of {domain} on {day} does not render to its own bytes")
        return rows.withColumn("content_hash", F.sha2("canonical", 256))

    def complete(self, domains: list[str], packets: bool = False) -> DataFrame:
        """day, complete: events and labels of every domain are stored, and packets if asked."""
        need = [(d, s) for d in domains for s in ("events", "labels", *(["packets"] if packets else []))]
        checks = [F.bool_or((F.col("domain") == d) & (F.col("stage") == s)) for d, s in need]
        whole = checks[0]
        for c in checks[1:]:
            whole = whole & c
        return self.manifest().groupBy("day").agg(whole.alias("complete"))

"""Quarterly archives of tab-separated members as a data source: a partition an archive and member, only the columns asked for.

    spark.dataSource.register(ArchiveMembers)
    spark.read.format("tsv_archives").schema("quarter string, TRANS_CODE string").option("member", "NONDERIV_TRANS").load("/data/*_form345.zip")

The schema names the columns to read; `quarter` is the archive's own. A task opens its archive where it lies (a local or
shared folder, or a store that Arrow knows by its URI), reads the directory at the end of the file and inflates one member
in batches, so nothing holds a whole archive and each member is inflated once.

Defined cases: quotes are ordinary characters; bytes that are no UTF-8 become replacement characters; blank lines are
skipped; rows with too few cells have nulls, further cells are ignored; a column or member that an archive lacks is an
error, since the format has changed; a pattern that matches nothing gives no rows.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructType

BATCH_ROWS = 20_000
QUARTER = re.compile(r"(\d{4}q\d)_form345")


class ArchiveFormatError(ValueError):
    """An archive without a member, or a member without a column, that it must have."""


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or a plain path."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Member(InputPartition):
    def __init__(self, path: str, member: str):
        self.path, self.member = path, member


def member_rows(file: io.IOBase, name: str, columns: list[str], path: str = "") -> Iterator[list[list[str | None]]]:
    """Batches of the named columns of one member, column by column."""
    with zipfile.ZipFile(file) as archive:
        if f"{name}.tsv" not in archive.namelist():
            raise ArchiveFormatError(f"{path} has no {name}.tsv")
        with archive.open(f"{name}.tsv") as raw:
            rows = csv.reader(io.TextIOWrapper(raw, "utf-8", "replace", newline=""), delimiter="\t", quoting=csv.QUOTE_NONE)
            header = next(rows, [])
            if missing := [c for c in columns if c not in header]:
                raise ArchiveFormatError(f"{name} of {path} has no columns {missing}")
            at, held = [header.index(c) for c in columns], []
            for row in rows:
                if row:
                    held.append([row[i] if i < len(row) else None for i in at])
                if len(held) == BATCH_ROWS:
                    yield [list(c) for c in zip(*held, strict=True)] if at else [held]
                    held = []
            if held:
                yield [list(c) for c in zip(*held, strict=True)] if at else [held]


class ArchiveReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.pattern, self.member = schema, options["path"], options["member"]
        if wrong := [f.name for f in schema if not isinstance(f.dataType, StringType)]:
            raise ArchiveFormatError(f"columns {wrong} must be read as strings")

    def partitions(self) -> list[InputPartition]:
        store, path = located(self.pattern)
        folder, name = path.rsplit("/", 1) if "/" in path else (".", path)
        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        head = self.pattern[: len(self.pattern) - len(name)]
        return [Member(head + f.base_name, self.member) for f in sorted(found, key=lambda f: f.base_name) if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, name)]

    def read(self, partition: Member | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no archive
            return
        store, path = located(partition.path)
        names = [f.name for f in self.schema]
        wanted = [n for n in names if n != "quarter"]
        quarter = m[1] if (m := QUARTER.search(path)) else None
        with store.open_input_file(path) as file:
            for columns in member_rows(file, partition.member, wanted, path):
                n = len(columns[0])
                cells = dict(zip(wanted, columns, strict=False)) | {"quarter": [quarter] * n}
                yield pa.RecordBatch.from_arrays([pa.array(cells[c], pa.string()) for c in names], names)


class ArchiveMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tsv_archives"

    def schema(self) -> str:
        return "quarter string"

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(schema, dict(self.options))

"""Zipped CSV archives as a data source: a partition for each member, found in the archives' directories; dates in file names prune archives.

``spark.dataSource.register(ZippedCsv)``, then ``spark.read.format("zipped_csv").schema(...).load(path)``, or ``read_zipped``. Columns of the schema are those of the
file, by name with a header, by position without one; besides, ``file_date`` (from the archive's name), ``archive`` and ``member`` may be in the schema.
Members (.csv, or .csv.gz within the archive) are streamed in blocks, so an archive of any size is read in bounded memory; a member is one task, as deflated
data has no other entry points. Filters on file_date (=, <, <=, >, >=, IN) are applied to the names before any archive is opened.

Paths are folders, files or patterns of any file system that Arrow opens (local, hdfs://, s3://).
"""

from __future__ import annotations

import csv
import fnmatch
import gzip
import itertools
import posixpath
import re
import zipfile
from collections.abc import Iterator
from contextlib import closing

import pyarrow as pa
from pyarrow import csv as pacsv
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

OWN = ("file_date", "archive", "member")
DATE = r"\d{4}-\d{2}-\d{2}"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path without patterns, and the path in it."""
    return pafs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (pafs.LocalFileSystem(), path)


def _files(path: str) -> tuple[pafs.FileSystem, list[str]]:
    """The archives of a path: a file, the .zip files below a folder, or those that match a pattern."""
    fixed = re.split(r"[*?\[]", path)[0]
    if fixed == path:
        system, top = _open(path)
        if system.get_file_info(top).type == pafs.FileType.File:
            return system, [top]
        pattern = posixpath.join(top.rstrip("/"), "*.zip")
    else:
        folder = fixed.rpartition("/")[0]
        system, top = _open(folder or "/")
        pattern = posixpath.join(top, path[len(folder) + 1 :])
    found = system.get_file_info(pafs.FileSelector(top, recursive=True))
    return system, sorted(f.path for f in found if f.type == pafs.FileType.File and fnmatch.fnmatch(f.path, pattern))


class Member(InputPartition):
    def __init__(self, archive: str, member: str, date: str | None):
        self.archive, self.member, self.date = archive, member, date


class ZippedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.header = str(options.get("header", "true")).lower() == "true"
        self.date, self.only_first = re.compile(options.get("datepattern", DATE)), str(options.get("firstmember", "false")).lower() == "true"
        self.tests: list[tuple[str, object]] = []

    def pushFilters(self, filters):
        kinds = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}
        for f in filters:
            if type(f) in kinds and tuple(f.attribute) == ("file_date",):
                self.tests.append((kinds[type(f)], f.value))
            else:
                yield f

    def wanted(self, date: str | None) -> bool:
        if not self.tests:
            return True
        check = {"=": lambda a, b: a == b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "in": lambda a, b: a in b}
        return date is not None and all(check[k](date, v) for k, v in self.tests)

    def partitions(self) -> list[Member]:
        system, files = _files(self.path)
        out = []
        for path in files:
            found = self.date.search(posixpath.basename(path))
            date = found[0] if found else None
            if not self.wanted(date):
                continue
            with closing(system.open_input_file(path)) as f, zipfile.ZipFile(f) as z:
                names = [n for n in z.namelist() if n.lower().endswith((".csv", ".csv.gz"))]
            out += [Member(path, n, date) for n in (names[:1] if self.only_first else names)]
        return out

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Member):  # nothing was found
            return
        system, _ = _open(re.split(r"[*?\[]", self.path)[0])
        whole = to_arrow_schema(self.schema)
        own = [f for f in whole if f.name not in OWN]
        constant = {"file_date": partition.date, "archive": partition.archive, "member": partition.member}
        with closing(system.open_input_file(partition.archive)) as f, zipfile.ZipFile(f) as z, z.open(partition.member) as raw:
            stream = gzip.GzipFile(fileobj=raw) if partition.member.lower().endswith(".gz") else raw
            names = None if self.header else [f.name for f in own]
            convert = pacsv.ConvertOptions(column_types={f.name: f.type for f in own}, include_columns=[f.name for f in own], include_missing_columns=True, strings_can_be_null=True)
            try:
                reader = pacsv.open_csv(stream, pacsv.ReadOptions(column_names=names, block_size=4 << 20), convert_options=convert)
            except pa.ArrowInvalid as e:
                if "Empty CSV" in str(e):
                    return
                raise
            for batch in reader:
                columns = [batch.column(f.name) if f.name not in OWN else pa.array(itertools.repeat(constant[f.name], batch.num_rows), f.type) for f in whole]
                yield pa.RecordBatch.from_arrays(columns, schema=whole)


class ZippedCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def schema(self) -> str:
        """The header of the first member, all text."""
        reader = ZippedReader(StructType(), self.options)
        members = reader.partitions()
        if not members:
            raise ValueError(f"no csv member in {reader.path}")
        system, _ = _open(re.split(r"[*?\[]", reader.path)[0])
        with closing(system.open_input_file(members[0].archive)) as f, zipfile.ZipFile(f) as z, z.open(members[0].member) as raw:
            line = (gzip.GzipFile(fileobj=raw) if members[0].member.lower().endswith(".gz") else raw).readline().decode()
        names = next(csv.reader([line]))
        names = names if reader.header else [f"c{k}" for k in range(len(names))]
        return ", ".join(f"`{n}` string" for n in [*names, *OWN])

    def reader(self, schema: StructType) -> ZippedReader:
        return ZippedReader(schema, self.options)


def read_zipped(spark: SparkSession, path: str, schema: str | None = None, header: bool = True, first_member: bool = False, date_pattern: str = DATE) -> DataFrame:
    """Rows of the CSV members of the archives at ``path``. Filters on file_date reach the source (a setting of the session allows it)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZippedCsv)
    reader = spark.read.format("zipped_csv").option("header", str(header).lower()).option("firstMember", str(first_member).lower()).option("datePattern", date_pattern)
    return (reader.schema(schema) if schema else reader).load(path)

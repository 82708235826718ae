"""A data source of the first and last bytes of files, which are sought and not read whole."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from fnmatch import fnmatch
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, length long, head binary, tail binary"
FILES = 256  #: of a partition


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    return fs.FileSystem.from_uri(path) if urlsplit(path).scheme else (fs.LocalFileSystem(), path)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class EndsReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size
        scheme = urlsplit(path).scheme
        self.prefix = f"{scheme or 'file'}:" + ("//" if scheme not in ("", "file") else "")

    def partitions(self) -> list[Files]:
        """Files of the folder, or the one file, or those that the last part of the path matches; hidden ones are left out."""
        system, path = _located(self.path)
        one = system.get_file_info(path)
        if one.type == fs.FileType.File:
            found = [one]
        else:
            folder, pattern = (path, "*") if one.type == fs.FileType.Directory else posixpath.split(path)
            found = [f for f in system.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File and fnmatch(f.base_name, pattern) and f.base_name[0] not in "._"]
        paths = sorted(f.path for f in found)
        return [Files(paths[i : i + FILES]) for i in range(0, len(paths), FILES)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _located(self.path)
        rows = []
        for path in partition.paths:
            with system.open_input_file(path) as f:
                n = f.size()
                head = f.read_at(min(self.size, n), 0)
                tail = f.read_at(min(self.size, n), max(0, n - self.size))
            rows.append((self.prefix + path, n, head, tail))
        columns = zip(*rows, strict=True) if rows else [()] * 4
        types = (pa.string(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["file", "length", "head", "tail"])


class Ends(DataSource):
    """``spark.read.format("ends").option("size", 4096).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "ends"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EndsReader:
        del schema
        return EndsReader(self.options["path"], int(self.options.get("size", 4096)))

"""Signed blobs as a data source: a partition a file, whole writes only, broken blobs as rows.

    spark.dataSource.register(Blobs)
    df.write.format("factloom_blobs").option("key", key).save(folder)
    spark.read.format("factloom_blobs").option("key", key).load(folder)

Rows are ``(name, json)``. A task writes its file under a hidden name; the commit
of the job gives all their final names, so a failed task or job leaves nothing to
read. Reading gives ``(name, json, error)``: a blob whose signature or coding is
broken, or that is too large, is a row without JSON and with a code.

The folder is any file system of Arrow's (a path, ``file://``, ``hdfs://``,
``s3://``), shared by driver and executors; a path without a scheme is local.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from factloom.sources.codec import MAX_BLOB, seal, unseal

SCHEMA = "name string, json string, error string"
_HIDDEN = "_part-"


def _files(path: str):
    """Arrow's file system, and the folder on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class File(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    names: tuple[tuple[str, str], ...]


class Blobs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "factloom_blobs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(self.options, overwrite)


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.key = options["path"], options["key"].encode()

    def partitions(self) -> list[File]:
        from pyarrow import fs

        files, folder = _files(self.path)
        found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return [File(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and not f.base_name.startswith(("_", "."))]

    def read(self, partition: File | None):
        if partition is None:  # an empty folder
            return
        files, _ = _files(self.path)
        with files.open_input_stream(partition.path) as lines:
            rest = b""
            while block := lines.read(1 << 20):
                *whole, rest = (rest + block).split(b"\n")
                if len(rest) > 2 * MAX_BLOB:
                    whole, rest = [*whole, rest[: 2 * MAX_BLOB]], b""
                yield from map(self._row, filter(None, whole))
            if rest:
                yield self._row(rest)

    def _row(self, line: bytes):
        try:
            own = json.loads(line)
        except ValueError:
            own = None
        name, blob, signature = (own.get(k) if isinstance(own, dict) else None for k in ("name", "blob", "signature"))
        name = name if isinstance(name, str) else None
        if not isinstance(blob, str) or not isinstance(signature, str):
            return name, None, "invalid_blob"
        return name, *unseal(blob, signature, self.key)


class Writer(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.key, self.overwrite = options["path"], options["key"].encode(), overwrite
        self.job = uuid.uuid4().hex

    def write(self, batches) -> Written:
        """One hidden file. A text that cannot be sealed ends the write."""
        files, folder = _files(self.path)
        files.create_dir(folder, recursive=True)
        final = f"{uuid.uuid4().hex}.blobs"
        hidden, rows = f"{folder}/{_HIDDEN}{self.job}-{final}", 0
        with files.open_output_stream(hidden) as out:
            for batch in batches:
                for name, text in zip(batch.column("name").to_pylist(), batch.column("json").to_pylist(), strict=True):
                    blob, signature, error = seal(text or "", self.key)
                    if error:
                        raise ValueError(f"{name}: {error}")
                    out.write(json.dumps({"name": name, "blob": blob, "signature": signature}).encode() + b"\n")
                    rows += 1
        if not rows:
            files.delete_file(hidden)
            return Written(())
        return Written(((hidden, f"{folder}/{final}"),))

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = _files(self.path)
        if self.overwrite:
            for old in Reader({"path": self.path, "key": ""}).partitions():
                files.delete_file(old.path)
        for message in filter(None, messages):
            for hidden, final in message.names:
                files.move(hidden, final)
        self._sweep(files, folder)  # of attempts that were made again

    def abort(self, messages: list[Written | None]) -> None:
        self._sweep(*_files(self.path))

    def _sweep(self, files, folder: str) -> None:
        from pyarrow import fs

        for f in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if os.path.basename(f.path).startswith(f"{_HIDDEN}{self.job}"):
                files.delete_file(f.path)

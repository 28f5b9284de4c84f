"""Files of type-length-value records as a Spark data source.

``spark.dataSource.register(TlvSource)`` makes ``format("tlv")`` readable and
writable. Options: ``type_bytes`` and ``length_bytes`` (1, 2, 4 or 8; default 1
and 2), little-endian. Rows are ``type bigint, payload binary``. A file that
ends inside a record ends the stream at its last whole record.

A path with a scheme (``hdfs://``, ``s3://``, ``gs://``, ``file://``) is reached
through Arrow's file systems by driver and executors alike; one without is a
folder that is mounted on all of them. Records are read as a stream. Parts are
written under names that readers ignore and moved when all are whole.
:func:`read_tlv` reads any store that Spark reads, a file at a time (2 GB).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "type bigint, payload binary"
WIDTHS = (1, 2, 4, 8)


def _widths(options) -> tuple[int, int]:
    widths = int(options.get("type_bytes", 1)), int(options.get("length_bytes", 2))
    if any(w not in WIDTHS for w in widths):
        raise ValueError("widths are 1, 2, 4 or 8 bytes")
    return widths


def encode_record(kind: int, payload: bytes, type_bytes: int = 1, length_bytes: int = 2) -> bytes:
    """Type and length are cut to their widths."""
    return (kind & ((1 << 8 * type_bytes) - 1)).to_bytes(type_bytes, "little") + (len(payload) & ((1 << 8 * length_bytes) - 1)).to_bytes(length_bytes, "little") + payload


def decode_records(data: bytes, type_bytes: int = 1, length_bytes: int = 2) -> Iterator[tuple[int, bytes]]:
    at, head = 0, type_bytes + length_bytes
    while at + head <= len(data):
        kind = int.from_bytes(data[at : at + type_bytes], "little")
        size = int.from_bytes(data[at + type_bytes : at + head], "little")
        if at + head + size > len(data):
            return
        yield kind, data[at + head : at + head + size]
        at += head + size


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """A file, or the record files of a folder, by name."""
    store, at = _store(path)
    if store.get_file_info(at).type == fs.FileType.File:
        return [at]
    return sorted(i.path for i in store.get_file_info(fs.FileSelector(at)) if i.type == fs.FileType.File and i.path.endswith(".tlv"))


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.widths = options["path"], _widths(options)

    def partitions(self):
        return [InputPartition(f) for f in _files(self.path)]

    def read(self, partition):
        type_bytes, length_bytes = self.widths
        with _store(self.path)[0].open_input_stream(partition.value, buffer_size=1 << 20) as file:
            while len(head := file.read(type_bytes + length_bytes)) == type_bytes + length_bytes:
                size = int.from_bytes(head[type_bytes:], "little")
                payload = file.read(size)
                if len(payload) < size:
                    return
                yield int.from_bytes(head[:type_bytes], "little"), payload


class _Writer(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.widths, self.overwrite = options["path"], _widths(options), overwrite

    def write(self, rows):
        store, at = _store(self.path)
        store.create_dir(at, recursive=True)
        name = f"{at}/part-{uuid.uuid4().hex}"
        with store.open_output_stream(f"{name}.tmp") as file:
            for row in rows:
                file.write(encode_record(row[0], bytes(row[1] or b""), *self.widths))
        message = WriterCommitMessage()
        message.name = name
        return message

    def commit(self, messages):
        store = _store(self.path)[0]
        for f in _files(self.path) if self.overwrite else ():
            store.delete_file(f)
        for m in messages:
            store.move(f"{m.name}.tmp", f"{m.name}.tlv")

    def abort(self, messages):
        store = _store(self.path)[0]
        for m in messages:
            if m is not None and store.get_file_info(f"{m.name}.tmp").type == fs.FileType.File:
                store.delete_file(f"{m.name}.tmp")


class TlvSource(DataSource):
    @classmethod
    def name(cls):
        return "tlv"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def read_tlv(spark: SparkSession, path: str, type_bytes: int = 1, length_bytes: int = 2) -> DataFrame:
    """``type, payload`` of the records of all files under ``path``, through Spark's own binary reader; one file goes to one task."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for content in pdf["content"]:
                records = list(decode_records(bytes(content), type_bytes, length_bytes))
                yield pd.DataFrame({"type": [k for k, _ in records], "payload": [p for _, p in records]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(split, SCHEMA)

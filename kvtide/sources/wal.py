"""The binary write-ahead log as a source and a sink.

A frame is a CRC-32 and a payload, all numbers big-endian. Single: type, seq, expiry, key
length, key, value length, value. Batch: type 3, first seq, count, then for each
operation type, expiry, key length, key, value length, value.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.mutations import WriteBatch
from ..schema import BATCH, DELETE, KV_SCHEMA, MAX_KEY_BYTES, MAX_VALUE_BYTES


class CorruptLog(ValueError):
    """A frame in the middle of a log fails its check."""


class Record(NamedTuple):
    key: bytes
    value: bytes
    seq: int
    op: int
    expires_at_ms: int


class Recovered(NamedTuple):
    records: list[Record]
    max_seq: int
    valid_bytes: int
    truncated: bool


def _framed(payload: bytes) -> bytes:
    return struct.pack(">I", zlib.crc32(payload)) + payload


def _sized(x: bytes) -> bytes:
    return struct.pack(">i", len(x)) + x


def encode_record(r: Record) -> bytes:
    return _framed(struct.pack(">bqq", r.op, r.seq, r.expires_at_ms) + _sized(r.key) + _sized(r.value))


def encode_batch(batch: WriteBatch, first_seq: int) -> bytes:
    if batch.is_empty():
        return b""
    body = b"".join(struct.pack(">bq", op, e) + _sized(k) + _sized(v) for op, k, v, e in batch.ops)
    return _framed(struct.pack(">bqi", BATCH, first_seq, len(batch)) + body)


class _Torn(Exception):
    """The log ends, or a length can't be right: what follows is a torn tail."""


class _Cursor:
    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise _Torn
        self.at += n
        return self.data[self.at - n : self.at]

    def unpack(self, form: str) -> tuple:
        return struct.unpack(form, self.take(struct.calcsize(form)))

    def sized(self, most: int) -> bytes:
        (n,) = self.unpack(">i")
        if not 0 <= n <= most:
            raise _Torn
        return self.take(n)


def _frame(c: _Cursor) -> list[Record]:
    start = c.at
    (crc,) = c.unpack(">I")
    (kind,) = c.unpack(">b")
    out = []
    if kind == BATCH:
        first, count = c.unpack(">qi")
        for i in range(count):
            op, expires = c.unpack(">bq")
            out.append((op, first + i, expires, c.sized(MAX_KEY_BYTES), c.sized(MAX_VALUE_BYTES)))
    else:
        seq, expires = c.unpack(">qq")
        out.append((kind, seq, expires, c.sized(MAX_KEY_BYTES), c.sized(MAX_VALUE_BYTES)))
    if zlib.crc32(c.data[start + 4 : c.at]) != crc:
        if c.at >= len(c.data):
            raise _Torn
        raise CorruptLog(f"CRC-32 mismatch at offset {start}")
    return [Record(k, b"" if op == DELETE else v, seq, op, e) for op, seq, e, k, v in out]


def recover(data: bytes) -> Recovered:
    """Records of a log up to its torn tail, if it has one. Damage before the end is an error."""
    records, at = [], 0
    while at < len(data):
        c = _Cursor(data, at)
        try:
            records += _frame(c)
        except _Torn:
            break
        at = c.at
    return Recovered(records, max((r.seq for r in records), default=0), at, at < len(data))


class WalFile(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class WalReader(DataSourceReader):
    """A partition a log file: frames have no marks to split at. The files must be where every executor can open them."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"].removeprefix("file://")

    def partitions(self) -> list[InputPartition]:
        names = sorted(n for n in os.listdir(self.path) if n.endswith(".wal")) if os.path.isdir(self.path) else [""]
        return [WalFile(os.path.join(self.path, n).rstrip("/")) for n in names]

    def read(self, partition: WalFile) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            yield from map(tuple, recover(f.read()).records)


class WalWriter(DataSourceWriter):
    """A log file a partition, its records in the order of the rows."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"].removeprefix("file://")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        name = os.path.join(self.path, f"{uuid.uuid4().hex}.wal")
        with open(name + ".tmp", "wb") as f:
            for r in rows:
                f.write(encode_record(Record(bytes(r.key), bytes(r.value or b""), r.seq, r.op, r.expires_at_ms)))
        os.rename(name + ".tmp", name)
        return WriterCommitMessage()


class WalDataSource(DataSource):
    """spark.read.format("kvwal").load(path), df.write.format("kvwal").save(path): the records of log files on a shared disk."""

    @classmethod
    def name(cls) -> str:
        return "kvwal"

    def schema(self) -> StructType:
        return KV_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WalReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WalWriter(self.options)


def read_wal(spark: SparkSession, path: str):
    """Log files of any file system that Spark reads, as rows; each is decoded on an executor."""
    import pandas as pd

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for data in pdf["content"]:
                yield pd.DataFrame(recover(bytes(data)).records, columns=KV_SCHEMA.names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, KV_SCHEMA)

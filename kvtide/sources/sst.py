"""Sorted table files (.sst): binary reader and writer.

Blocks of records, a sparse index of the blocks' first keys, a bloom filter, and a
footer with its length, version and magic number in the last 12 bytes. All
numbers are big-endian. A block has an envelope: codec, raw length, stored length (0 if
it isn't compressed).
"""

from __future__ import annotations

import os
import struct
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.hashing import BloomFilter
from ..schema import KV_SCHEMA
from .wal import Record, _Cursor, _sized

MAGIC, VERSION = 0x50454242, 1
NONE, LZ4 = 0, 1
BLOCK_BYTES = 4096


class Footer(NamedTuple):
    index: tuple[int, int]
    bloom: tuple[int, int]
    entries: int
    min_key: bytes | None
    max_key: bytes | None

    def to_bytes(self) -> bytes:
        body = struct.pack(">qiqiq", *self.index, *self.bloom, self.entries) + _sized(self.min_key or b"") + _sized(self.max_key or b"")
        return body + struct.pack(">iiI", len(body), VERSION, MAGIC)

    @classmethod
    def of(cls, data: bytes) -> Footer:
        if len(data) < 12:
            raise ValueError(f"not a table file: {len(data)} bytes")
        size, version, magic = struct.unpack(">iiI", data[-12:])
        if magic != MAGIC:
            raise ValueError(f"not a table file: magic {magic:#x}")
        if version != VERSION:
            raise ValueError(f"unknown version {version}")
        if size < 0 or size + 12 > len(data):
            raise ValueError("the footer is longer than the file")
        c = _Cursor(data, len(data) - 12 - size)
        a, b, x, y, n = c.unpack(">qiqiq")
        lo, hi = c.sized(len(data)), c.sized(len(data))
        return cls((a, b), (x, y), n, lo or None, hi or None)


def _block(records: list[Record], lz4: bool) -> bytes:
    raw = struct.pack(">i", len(records)) + b"".join(_sized(r.key) + _sized(r.value) + struct.pack(">qqb", r.seq, r.expires_at_ms, r.op) for r in records)
    if not lz4:
        return struct.pack(">bii", NONE, len(raw), 0) + raw
    packed = pa.compress(raw, codec="lz4_raw", asbytes=True)
    return struct.pack(">bii", LZ4, len(raw), len(packed)) + packed


def _records(block: bytes) -> list[Record]:
    codec, size, _ = struct.unpack(">bii", block[:9])
    raw = block[9:] if codec == NONE else pa.decompress(block[9:], size, codec="lz4_raw", asbytes=True)
    c, out = _Cursor(raw, 4), []
    for _ in range(struct.unpack(">i", raw[:4])[0]):
        k, v = c.sized(len(raw)), c.sized(len(raw))
        out.append(Record(k, v, *(lambda s, e, o: (s, o, e))(*c.unpack(">qqb"))))
    return out


def encode_table(records: list[Record], lz4: bool = True, block_bytes: int = BLOCK_BYTES) -> bytes:
    """A file of records, which must be sorted by key with one version of each."""
    out, index, held, size = bytearray(), [], [], 4

    def flush() -> None:
        nonlocal size
        block = _block(held, lz4)
        index.append((held[0].key, len(out), len(block)))
        out.extend(block)
        held.clear()
        size = 4

    for r in records:
        held.append(r)
        size += 25 + len(r.key) + len(r.value)
        if size >= block_bytes:
            flush()
    if held:
        flush()
    ibytes = struct.pack(">i", len(index)) + b"".join(_sized(k) + struct.pack(">qi", at, n) for k, at, n in index)
    bloom = BloomFilter(len(records)).add([r.key for r in records]).to_bytes()
    lo, hi = (records[0].key, records[-1].key) if records else (None, None)
    foot = Footer((len(out), len(ibytes)), (len(out) + len(ibytes), len(bloom)), len(records), lo, hi)
    return bytes(out) + ibytes + bloom + foot.to_bytes()


class Table:
    """A file that can be searched: bounds, then bloom filter, then index, then one block."""

    def __init__(self, data: bytes) -> None:
        self.data, self.footer = data, Footer.of(data)
        at, _ = self.footer.index
        c = _Cursor(data, at)
        self.index = []
        for _ in range(c.unpack(">i")[0]):
            key = c.sized(len(data))
            self.index.append((key, *c.unpack(">qi")))
        self.first_keys = [k for k, *_ in self.index]
        x, n = self.footer.bloom
        self.bloom = BloomFilter.from_bytes(data[x : x + n])

    def _read(self, i: int) -> list[Record]:
        _, at, n = self.index[i]
        return _records(self.data[at : at + n])

    def get(self, key: bytes, max_seq: int | None = None) -> Record | None:
        f = self.footer
        if f.min_key is None or not f.min_key <= key <= f.max_key or not self.bloom.might_contain([key])[0]:
            return None
        block = self._read(bisect_right(self.first_keys, key) - 1)
        i = bisect_left(block, key, key=lambda r: r.key)
        found = block[i] if i < len(block) and block[i].key == key else None
        return found if found is None or max_seq is None or found.seq <= max_seq else None

    def __iter__(self) -> Iterator[Record]:
        for i in range(len(self.index)):
            yield from self._read(i)


class SstWriter(DataSourceArrowWriter):
    """A file a partition, whose rows are sorted by key with one version of each. The folder must be where every executor can write."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"].removeprefix("file://")
        self.lz4, self.block = options.get("codec", "lz4") == "lz4", int(options.get("blockBytes", BLOCK_BYTES))

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        records = []
        for b in batches:
            for k, v, s, o, e in zip(*(b.column(b.schema.names.index(c)).to_pylist() for c in KV_SCHEMA.names), strict=True):
                records.append(Record(k, v or b"", s, o, e))
        if not records:
            return WriterCommitMessage()
        if any(a.key >= b.key for a, b in zip(records, records[1:], strict=False)):
            raise ValueError("rows of a table file must be sorted by key, with one version of each")
        os.makedirs(self.path, exist_ok=True)
        name = os.path.join(self.path, f"{uuid.uuid4().hex}.sst")
        with open(name + ".tmp", "wb") as f:
            f.write(encode_table(records, self.lz4, self.block))
        os.rename(name + ".tmp", name)  # a file is whole or isn't there
        return SstFile(name)

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        for m in messages:
            if isinstance(m, SstFile):
                os.remove(m.path)


class SstFile(WriterCommitMessage):
    def __init__(self, path: str) -> None:
        self.path = path


class SstDataSource(DataSource):
    """df.write.format("kvsst").mode("append").save(path): rows as table files on a shared disk; read_sst reads them."""

    @classmethod
    def name(cls) -> str:
        return "kvsst"

    def schema(self) -> StructType:
        return KV_SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> SstWriter:
        return SstWriter(self.options)


def write_sst(rows: DataFrame, path: str, files: int, codec: str = "lz4") -> None:
    """One version of each key, as so many table files with ranges of keys of their own."""
    rows.sparkSession.dataSource.register(SstDataSource)
    sorted_ = rows.select(*KV_SCHEMA.names).repartitionByRange(files, "key").sortWithinPartitions("key")
    sorted_.write.format("kvsst").option("codec", codec).mode("append").save(path)


def lookup_sst(spark: SparkSession, path: str, keys: list[bytes], max_seq: int | None = None) -> DataFrame:
    """The versions of some keys in table files: bounds, filter, index and one block of each file a key."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for data in pdf["content"]:
                t = Table(bytes(data))
                yield pd.DataFrame([r for k in keys if (r := t.get(k, max_seq)) is not None], columns=KV_SCHEMA.names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, KV_SCHEMA)


def read_sst(spark: SparkSession, path: str) -> DataFrame:
    """Table files of any file system that Spark reads, as rows; each is decoded on an executor."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for data in pdf["content"]:
                yield pd.DataFrame(list(Table(bytes(data))), columns=KV_SCHEMA.names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, KV_SCHEMA)

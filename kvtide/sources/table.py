"""A table of versions: Parquet files under a commit log.

A read takes the file list of one version, so it sees the same rows however
long it runs and whatever is committed or compacted meanwhile. Files are sorted
by key and carry their key and sequence ranges in the log, so that reads skip whole files
before Spark plans a scan; Parquet's own statistics and bloom filters
do the rest.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resolve as R
from ..operators.compaction import FileMeta, Options, merged, picked
from ..operators.mutations import WriteBatch, as_bytes, numbered, placed
from ..schema import DELETE, KV_COLUMNS, KV_SCHEMA, MAX_KEY_BYTES, MAX_VALUE_BYTES, PUT
from .commitlog import CommitConflict, CommitLog, Version


@dataclass(frozen=True)
class Snapshot:
    """A sequence number and the instant it was taken."""

    seq: int
    created_at_ms: int


class KVTable:
    def __init__(self, spark: SparkSession, path: str, options: Options | None = None) -> None:
        self.spark, self.path, self.options = spark, path.rstrip("/"), options or Options()
        self.log = CommitLog(spark, self.path)

    # ---- files

    def _write(self, rows: DataFrame, level: int) -> list[FileMeta]:
        """Rows as sorted files of a level, with their statistics from one aggregate over what was written."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        out = rows.select(*KV_COLUMNS).write.option("compression", self.options.codec).option("parquet.bloom.filter.enabled#key", "true")
        # a filter as large as the file's keys need; the fixed size would be 1 MiB even for one key
        out.option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.bloom.filter.candidates.number#key", "12").parquet(folder)
        got = self.spark.read.schema(KV_SCHEMA).parquet(folder).withColumn("path", F.col("_metadata.file_path"))
        stats = got.groupBy("path").agg(F.count("*").alias("n"), F.hex(F.min("key")).alias("lo"), F.hex(F.max("key")).alias("hi"), F.min("seq").alias("a"), F.max("seq").alias("b")).collect()  # a row a file
        return [FileMeta(r.path, level, r.n, self.log.size(r.path), r.lo, r.hi, r.a, r.b) for r in sorted(stats, key=lambda r: r.lo)]

    def version(self, number: int | None = None) -> Version:
        return self.log.version(number)

    def rows(self, lo: bytes | None = None, hi: bytes | None = None, max_seq: int | None = None, version: int | None = None) -> DataFrame:
        """All versions in the files that a range and a snapshot can need."""
        ends = [None if x is None else as_bytes(x).hex().upper() for x in (lo, hi)]
        files = [f.path for f in self.version(version).files if f.overlaps(*ends) and (max_seq is None or f.min_seq <= max_seq)]
        return self.spark.read.schema(KV_SCHEMA).parquet(*files) if files else self.spark.createDataFrame([], KV_SCHEMA)

    # ---- writing

    def write(self, batch: WriteBatch | None) -> int:
        """One atomic commit of a batch; returns the last sequence number. Nothing to write is no commit."""
        if batch is None or batch.is_empty():
            return self.version().max_seq
        return self._publish(lambda first: batch.to_df(self.spark, first).coalesce(1).sortWithinPartitions("key", "seq"), len(batch), sum(op == DELETE for op, *_ in batch.ops))

    def put(self, key: bytes | str, value: bytes | str | None, ttl_ms: int | None = None, expires_at_ms: int | None = None) -> int:
        return self.write(WriteBatch().put(key, value, ttl_ms, expires_at_ms))

    def delete(self, key: bytes | str) -> int:
        return self.write(WriteBatch().delete(key))

    def append(self, rows: DataFrame, *order: str, stream: str = "", batch: int = -1) -> int:
        """Commits a frame of mutations (key, value, op, expires_at_ms and the ordering columns), however large.

        With stream and batch, a batch that was committed before is left out, so that a
        stream may send it again.
        """
        if stream and self.version().batches.get(stream, -1) >= batch:
            return self.version().max_seq
        self.relieved()
        staged = f"{self.path}/_staging/{uuid.uuid4().hex}"
        ok = F.col("key").isNotNull() & (F.length("key") > 0) & (F.length("key") <= MAX_KEY_BYTES) & (F.coalesce(F.length("value"), F.lit(0)) <= MAX_VALUE_BYTES)
        checked = F.when(ok, F.col("key")).otherwise(F.raise_error(F.lit("a key is empty, or a key or value is too large")).cast("binary"))
        placed(rows.withColumn("key", checked), *order).write.parquet(staged)
        try:
            got = self.spark.read.parquet(staged)
            n = got.groupBy("op").count().collect()
            total = sum(r["count"] for r in n)
            if not total:
                return self.version().max_seq
            return self._publish(lambda first: numbered(got, first).sortWithinPartitions("key", "seq"), total, sum(r["count"] for r in n if r["op"] == DELETE), stream, batch)
        finally:
            self.log.delete(staged)

    def relieved(self) -> None:
        """Bulk writers wait for compaction while level 0 has too many files."""
        while sum(f.level == 0 for f in self.version().files) >= self.options.l0_stop and self.compact():
            pass

    def _publish(self, rows, total: int, deletes: int, stream: str = "", batch: int = -1) -> int:
        for _ in range(10):
            base = self.version()
            files = self._write(rows(base.max_seq + 1), 0)
            try:
                return self.log.publish(base, files, [], base.max_seq + total, {"writes": total, "deletes": deletes}, stream, batch).max_seq
            except CommitConflict:  # numbered anew after the other writer's rows
                for f in files:
                    self.log.delete(f.path)
        raise CommitConflict("too many writers")

    # ---- reading

    def snapshot(self) -> Snapshot:
        return Snapshot(self.version().max_seq, R.now_ms())

    def get(self, key: bytes | str, snapshot: Snapshot | int | None = None, as_of_ms: int | None = None) -> bytes | None:
        s = snapshot.seq if isinstance(snapshot, Snapshot) else snapshot
        k = as_bytes(key)
        got = R.get(self.rows(k, k, s), k, s, as_of_ms).select("value").collect()
        return bytes(got[0].value) if got else None

    def get_string(self, key: str, snapshot: Snapshot | int | None = None) -> str | None:
        v = self.get(key, snapshot)
        return None if v is None else v.decode()

    def get_entry(self, key: bytes | str, max_seq: int | None = None):
        """The newest version as a row, tombstone or expired, or None."""
        k = as_bytes(key)
        got = R.get_entry(self.rows(k, k, max_seq), k, max_seq).collect()
        return got[0] if got else None

    def scan(self, lo: bytes | str | None = None, hi: bytes | str | None = None, snapshot: Snapshot | int | None = None, limit: int | None = None, as_of_ms: int | None = None) -> DataFrame:
        s = snapshot.seq if isinstance(snapshot, Snapshot) else snapshot
        a, b = (None if x is None else as_bytes(x) for x in (lo, hi))
        return R.scan(self.rows(a, b, s), a, b, s, as_of_ms, limit)

    def multi_get(self, keys: list[bytes | str], snapshot: Snapshot | int | None = None) -> list[bytes | None]:
        """Values in the order of the request, None for keys that have none."""
        if not keys:
            return []
        s = snapshot.seq if isinstance(snapshot, Snapshot) else snapshot
        ks = [as_bytes(k) for k in keys]
        request = self.spark.createDataFrame([(i, bytearray(k)) for i, k in enumerate(ks)], "pos int, key binary")
        got = R.multi_get(self.rows(min(ks), max(ks), s), request, s).orderBy("pos").collect()
        return [None if r.value is None else bytes(r.value) for r in got]

    # ---- maintenance

    def compact(self, force: bool = False, retain_seq: int | None = None, as_of_ms: int | None = None) -> bool:
        """Merges a level that is over its threshold into the next. All versions stay unless retain_seq lets go of older ones."""
        base = self.version()
        choice = picked(base.files, self.options, force)
        if choice is None:
            return False
        level, inputs = choice
        gone = {f.path for f in inputs}
        lo, hi = min(f.min_key for f in inputs), max(f.max_key for f in inputs)
        droppable = not any(f.overlaps(lo, hi) for f in base.files if f.path not in gone)
        rows = merged(self.spark.read.schema(KV_SCHEMA).parquet(*gone), retain_seq, R.now_ms() if as_of_ms is None else as_of_ms, droppable)
        parts = max(1, -(-sum(f.bytes for f in inputs) // self.options.target_file_bytes))
        files = self._write(rows.repartitionByRange(parts, "key").sortWithinPartitions("key", F.col("seq").desc()), level)
        while True:  # others may commit meanwhile: their rows are newer, so what was merged stays right as long as its inputs are there
            try:
                self.log.publish(base, files, sorted(gone), base.max_seq)
                return True
            except CommitConflict:
                base = self.version()
                if not gone <= {f.path for f in base.files}:  # another compaction took them
                    for f in files:
                        self.log.delete(f.path)
                    return False

    def vacuum(self, retain_versions: int = 1) -> list[str]:
        """Deletes files that none of the last versions uses, orphans of failed writes among them. Older versions can't be read afterwards."""
        numbers = self.log.numbers()
        used = {f.path for n in numbers[-max(1, retain_versions) :] for f in self.version(n).files}
        gone = [p for p in self.log.data_files() if p.endswith(".parquet") and not any(p.split("/data/")[-1] == u.split("/data/")[-1] for u in used)]
        for p in gone:
            self.log.delete(p)
        return gone

    # ---- metrics

    def files(self) -> DataFrame:
        """A row a file: path, level, rows, bytes, first and last key, first and last sequence number."""
        rows = [(f.path, f.level, f.rows, f.bytes, bytearray.fromhex(f.min_key), bytearray.fromhex(f.max_key), f.min_seq, f.max_seq) for f in self.version().files]
        return self.spark.createDataFrame(rows, "path string, level int, rows long, bytes long, min_key binary, max_key binary, min_seq long, max_seq long")

    def levels(self) -> DataFrame:
        """A row a level: files, rows and bytes."""
        files = self.version().files
        df = self.spark.createDataFrame([(f.level, f.rows, f.bytes) for f in files], "level int, rows long, bytes long")
        return df.groupBy("level").agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))

    def metrics(self) -> dict[str, int]:
        v = self.version()
        out = {"writes": v.counters.get("writes", 0), "deletes": v.counters.get("deletes", 0), "last_seq": v.max_seq, "version": v.number}
        for n in range(3):
            mine = [f for f in v.files if f.level == n]
            out |= {f"l{n}_files": len(mine), f"l{n}_bytes": sum(f.bytes for f in mine)}
        return out | {"total_files": len(v.files), "total_bytes": sum(f.bytes for f in v.files)}

    def size(self, as_of_ms: int | None = None) -> int:
        """Number of live keys."""
        return R.resolve(self.rows(), as_of_ms=as_of_ms).count()


__all__ = ["DELETE", "PUT", "KVTable", "Snapshot"]

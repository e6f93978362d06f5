"""Writing: batches, checks and sequence numbers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DELETE, KV_SCHEMA, MAX_KEY_BYTES, MAX_VALUE_BYTES, PUT
from .resolve import now_ms


def as_bytes(x: bytes | bytearray | str | None) -> bytes:
    """Strings as UTF-8; null is the empty value, which isn't the same as no value."""
    return b"" if x is None else x.encode() if isinstance(x, str) else bytes(x)


def checked(key: bytes, value: bytes) -> None:
    """Keys are not empty, and both sizes are what a reader of the log accepts."""
    if not key:
        raise ValueError("a key must not be empty")
    if len(key) > MAX_KEY_BYTES or len(value) > MAX_VALUE_BYTES:
        raise ValueError(f"key or value too large: {len(key)} and {len(value)} bytes")


def deadline_of(ttl_ms: int | None, now: int | None = None) -> int:
    return (now_ms() if now is None else now) + ttl_ms if ttl_ms and ttl_ms > 0 else 0


@dataclass
class WriteBatch:
    """Puts and deletes that are committed together, in order."""

    ops: list[tuple[int, bytes, bytes, int]] = field(default_factory=list)  # op, key, value, deadline

    def put(self, key: bytes | str, value: bytes | str | None, ttl_ms: int | None = None, expires_at_ms: int | None = None) -> WriteBatch:
        k, v = as_bytes(key), as_bytes(value)
        checked(k, v)
        self.ops.append((PUT, k, v, max(0, expires_at_ms) if expires_at_ms is not None else deadline_of(ttl_ms)))
        return self

    def delete(self, key: bytes | str) -> WriteBatch:
        k = as_bytes(key)
        checked(k, b"")
        self.ops.append((DELETE, k, b"", 0))
        return self

    def clear(self) -> None:
        self.ops.clear()

    @property
    def operations(self) -> tuple[tuple[int, bytes, bytes, int], ...]:
        return tuple(self.ops)

    def __len__(self) -> int:
        return len(self.ops)

    def is_empty(self) -> bool:
        return not self.ops

    def approximate_bytes(self) -> int:
        return sum(len(k) + len(v) + 32 for _, k, v, _ in self.ops)

    def to_df(self, spark: SparkSession, first_seq: int) -> DataFrame:
        """The batch as rows with consecutive sequence numbers."""
        return spark.createDataFrame([(k, v, first_seq + i, op, e) for i, (op, k, v, e) in enumerate(self.ops)], KV_SCHEMA)


def puts(df: DataFrame, key: Column, value: Column, ttl_ms: Column | None = None, now: int | None = None) -> DataFrame:
    """Rows of a frame as puts, without sequence numbers; other columns stay for ordering."""
    at = now_ms() if now is None else now
    e = F.lit(0).cast("long") if ttl_ms is None else F.when(ttl_ms > 0, F.lit(at) + ttl_ms).otherwise(F.lit(0)).cast("long")
    return df.withColumns({"key": key.cast("binary"), "value": F.coalesce(value.cast("binary"), F.lit(bytearray(b""))), "op": F.lit(PUT).cast("byte"), "expires_at_ms": e})


def deletes(df: DataFrame, key: Column) -> DataFrame:
    """Rows of a frame as tombstones, without sequence numbers."""
    return df.withColumns({"key": key.cast("binary"), "value": F.lit(bytearray(b"")), "op": F.lit(DELETE).cast("byte"), "expires_at_ms": F.lit(0).cast("long")})


def placed(df: DataFrame, *order: str) -> DataFrame:
    """df sorted over range partitions, with each row's partition and place in it. Written once, it feeds numbered()."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return ranged.withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))


def numbered(written: DataFrame, first_seq: int) -> DataFrame:
    """seq: dense from first_seq in the order of placed().

    The partitions' sizes, a row each, give the offsets. No row passes
    through a single task.
    """
    sizes = {r["_part"]: r["count"] for r in written.groupBy("_part").count().collect()}
    offset, pairs = first_seq, []
    for p in sorted(sizes):
        pairs += [F.lit(p), F.lit(offset).cast("long")]
        offset += sizes[p]
    seq = (F.create_map(*pairs)[F.col("_part")] + F.col("_nth")).cast("long") if pairs else F.lit(None).cast("long")
    return written.withColumn("seq", seq).drop("_part", "_nth")
